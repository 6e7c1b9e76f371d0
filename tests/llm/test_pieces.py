"""Piece ids against the library's own, and the round trip."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from marginalia.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"

ODD = [
    "Hello  world", " a\nb\t c ", "", "　é x", "▁a ▁", "ﬁ", "a" * 30, "\x00x\x00", "<s> </s> <unk>", "日本語 text", "     x     日   ", " ",
    "0" * 700, "ab" * 200 + "é" * 100, "the" * 90, "=" * 65 + " " + "-" * 64, "\U0001f600 \U0001f600", "word. " * 50, "aaabbbaaab " * 20,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(texts, library):
    m = pieces.model(PATH)
    ids, at = pieces.encode(texts, m)
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(text)
        assert pieces.decode(ids[a:b].tolist(), m) == library.decode(library.encode(text)) == text.replace("▁", " ")


def test_odd_texts(library):
    check(ODD, library)
    check([""], library)


def test_rounds_and_heap_agree(library, monkeypatch):
    monkeypatch.setattr(pieces, "ROUND_SYMBOLS", 2)
    check(ODD, library)


def test_random_texts(library):
    draw = np.random.default_rng(3)
    letters = list("aabehinorst  ▁.é\n")
    check(["".join(draw.choice(letters, int(n))) for n in draw.integers(0, 150, 300)], library)


def test_documents(spark, library):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    got = pieces.encoded(table, PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    odd = spark.createDataFrame([(1, None, 5), (None, "x", 5), (1, "x", 5)], "doc_id long, text string, n_tokens int")
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in pieces.encoded(odd, PATH).collect()) == [("1", 0), ("1", 1), ("None", 1)]
    assert pieces.encoded(odd.limit(0), PATH).count() == 0
