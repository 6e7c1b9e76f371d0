"""Token ids against the tokenizer itself on whole texts; token files and packing against a plain account of both."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marginalia.llm import packing, token_files, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    "Hello WORLD\n\n  it's\x1cx\x85y <|endoftext|> a<|endoftext|>b", "", None, "a). b., c.d. e,", "ÉCOLE école école İstanbul ΣΑΣ",
    "don't we'll 12.5% 　 x y", "   ", "word. " * 3000, "0" * 5000, "x<|ENDOFTEXT|> Big <b>Bold</b> a-b c-d e-f 1. 2, .", "E\u0301COLE I\u0307 ΟΔΟΣ ΟΔΟΣ. ﬁn Å","一二三 ひらがな. абв,", "same", "same",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, k) for k, t in enumerate(TEXTS)] + [(None, "no id", 0), (3, "again the same id", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)


def plain(text):
    ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]
    return np.array(ids, "<u4")


def crc(ids):
    return zlib.crc32(ids.tobytes())


def each(ids, offsets):
    return [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_words_encode_as_whole_texts():
    found = tokens.Encoder(PATH).encode(pa.array(TEXTS), 1)
    assert each(*found) == [plain(x).tobytes() for x in TEXTS]
    assert each(*tokens.Encoder(PATH).encode(pa.array(["", None]))) == [b"", b""]


def test_a_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 3)
    encoder = tokens.Encoder(PATH)
    for text in TEXTS * 2:
        assert each(*encoder.encode(pa.array(["x", text]).slice(1), 1)) == [plain(text).tobytes()]


def test_token_files(spark, docs):
    got = token_files.write(docs, PATH).read().collect()
    want, start = [], 0
    rows = sorted(((k, t) for k, t in [*enumerate(TEXTS), (3, "again the same id")]), key=lambda r: (r[0], r[1] or ""))
    for doc_id, text in [*rows, (None, "no id")]:
        ids = plain(text)
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_token_files_of_an_empty_table(spark, docs):
    assert token_files.write(docs.limit(0), PATH).read().count() == 0


def test_packing_holds_every_token_once(spark, docs):
    rows = packing.packed(docs, PATH).collect()
    texts = [(k, t) for k, t in enumerate(TEXTS) if k != 3] + [(None, "no id")]
    for doc_id, text in texts:
        ids = plain(text)
        mine = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(ids) == mine[0]["doc_tokens"]
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_pack_pads_once(seed):
    lengths = np.random.default_rng(seed).integers(1, 5000, 300).tolist()
    sequences = packing.pack(lengths)
    held = defaultdict(int)
    for tier, pieces in sequences:
        assert 0 < sum(p[2] for p in pieces) <= tier
        for doc, _, length in pieces:
            held[doc] += length
    assert [held[d] for d in range(300)] == lengths
    assert sum(tier != sum(p[2] for p in pieces) for tier, pieces in sequences) <= 1
