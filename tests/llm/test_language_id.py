"""Code lengths against a byte-by-byte account of the same trees; accuracy on held-out documents."""

from collections import Counter
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import language_id, queries

SF = "/root/testdata/sf0.01"


def counts(texts):
    c = Counter()
    for text in texts:
        data = bytes([language_id.PAD] * 3) + text
        for i in range(len(text)):
            c[data[i : i + 4]] += 1
    return c


def slow_length(c, text):
    orders = {k: Counter() for k in (1, 2, 3, 4)}
    for gram, n in c.items():
        for k in orders:
            orders[k][gram[4 - k :]] += n
    followers = {k: {} for k in orders}
    for k, found in orders.items():
        for gram, n in found.items():
            followers[k].setdefault(gram[:-1], {})[gram[-1]] = n
    total, data = 0.0, bytes([language_id.PAD] * 3) + text
    for i in range(len(text)):
        gram = data[i : i + 4]
        for k in (4, 3, 2, 1):
            seen = followers[k].get(gram[4 - k : 3], {})
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if gram[3] in seen:
                total -= log2(seen[gram[3]] / (n + d))
                break
            total -= log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths():
    train = {"aa": [b"abra cadabra", b"a man a plan"], "bb": [b"the quick brown fox \xc3\xa9", b"x"]}
    tables = []
    for texts in train.values():
        c = counts(texts)
        keys = np.array([int.from_bytes(g, "big") for g in c], np.uint32)
        order = np.argsort(keys)
        tables.append((keys[order], np.array(list(c.values()), float)[order]))
    model = language_id.Model.fit(list(train), tables)
    tests = [b"abra", b"", b"the fox \xff\x00 abracadabra", b"x", b"\n\n\nzz", b"the quick brown"]
    data = np.frombuffer(b"".join(tests), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in tests])))
    got = model.lengths(data, offsets) / language_id.UNIT
    want = [[slow_length(counts(texts), t) for texts in train.values()] for t in tests]
    assert np.allclose(got, want, atol=0.01)


def test_held_out_accuracy(spark):
    got = queries.op1_partial_matching(spark, SF)
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = got.join(lang, "doc_id").filter("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got.count() == 1000 and right > 0.97
    assert got.filter("score < 0 or score > 1 or score is null or lang_pred is null").count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    rows = [] if empty else [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "fr"), (4, "x", None)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(1, None, 0), (2, "", 0), (3, "12 .. 34", 0), (None, "the dog", 0), (5, "le chien", 0), (5, "le chien", 0)]
    got = language_id.predict(spark.createDataFrame(odd, "doc_id long, text string, score int"), model).collect()
    kinds = ["und", "und", "und"] + (["und"] * 3 if empty else ["en", "fr", "fr"])
    assert [r["lang_pred"] for r in got] == kinds and got[0]["score"] == 0


def test_every_language_has_a_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAINING_BYTES", 4000)
    rows = [(k, "the cat and the dog " * 2, "en") for k in range(1000)]
    rows += [(2000 + k, "le chat et le chien de la ville " * 1000, f"f{k % 20}") for k in range(40)] + [(None, "der Hund und die Katze " * 9, "de")] * 3
    rows += [(3000, "x", "xx")]
    seen = {}
    monkeypatch.setattr(language_id.Model, "fit", lambda languages, counts: seen.update({x: n.sum() for x, (_, n) in zip(languages, counts, strict=True)}))
    language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    share = 4000 // 23
    assert set(seen) == {"en", "de", "xx"} | {f"f{k}" for k in range(20)}
    assert seen.pop("xx") == 1 and all(share - 3 < n <= share for n in seen.values())
