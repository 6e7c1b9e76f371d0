"""The pipeline's stages against plain accounts of what each has to do."""

import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from test_near_dedup import brute as near_brute
from test_pii import brute as pii_brute

SF = "/root/testdata/sf0.001"


def staged(spark, docs):
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        out[name] = [r.asDict() for r in docs.collect()]
        docs = spark.createDataFrame([tuple(r.values()) for r in out[name]], docs.schema)
    return out, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


@pytest.fixture(scope="module")
def given(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in table.collect()}
    odd = [(900, None, None, None, None), (901, "12 34", "en", "s", 5), (902, text[7] + " ", "en", "s", 0), (903, "\u4e00\u4e8c\u4e09\u56db" * 60, None, "s", 240)]
    odd += [(3, text[3], "en", "again", 0), (None, "the words of a text without an id that are in english", None, None, None)]
    return table.union(spark.createDataFrame(odd, table.schema))


def test_stages(spark, given):
    rows = [r.asDict() for r in given.collect()]
    out, pieces = staged(spark, given)
    left = [r for r in rows if r["text"] and re.search(r"[^\W\d_]", r["text"]) and r["doc_id"] != 903]
    order = lambda x: sorted(x, key=str)
    assert order(r["doc_id"] for r in out["language_id"]) == order(r["doc_id"] for r in left)
    best = {}
    for r in left:
        body = re.sub(r"[\x20\x09-\x0D]", "", r["text"])
        rank = (-len(r["text"]), r["doc_id"] is None, r["doc_id"] or 0)
        best[body] = min(best.get(body, (rank, r["doc_id"])), (rank, r["doc_id"]))
    assert order(r["doc_id"] for r in out["exact_dedup"]) == order(d for _, d in best.values())
    single = [(r["doc_id"], r["text"]) for r in out["exact_dedup"]]
    assert order(r["doc_id"] for r in out["near_dedup"]) == order(d for d, _, _, stays in near_brute(single) if stays or d is None)
    texts = {r["doc_id"]: r["text"] for r in out["near_dedup"]}
    assert order(r["doc_id"] for r in out["pii"]) == order(texts)
    for r in out["pii"]:
        spans = pii_brute(texts[r["doc_id"]])
        assert r["text"] == texts[r["doc_id"]] if not spans else all(texts[r["doc_id"]][a:b] not in r["text"] for k, a, b in spans if k == "email")
        assert set(r) == set(rows[0])
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    held = {}
    for p in pieces:
        held.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["ids_crc32"]))
    for r in out["pii"]:
        ids = np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [1], "<u4")
        mine = sorted(held[r["doc_id"]])
        assert sum(n for _, n, _ in mine) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in mine)


def test_empty(spark, given):
    assert corpus_pipeline.STAGES[0][1](spark, given.limit(0), SF).count() == 0
    out, pieces = staged(spark, given.limit(0))
    assert not pieces and not any(out.values())
