"""Indicators against a plain account of them, the solver against its optimum conditions, held-out accuracy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import quality, queries

SF = "/root/testdata/sf0.01"


def plain_shape(word, before):
    upper = sum(65 <= b <= 90 for b in word)
    lower = sum(97 <= b <= 122 or b >= 128 for b in word)
    case = 3 if not upper + lower else 0 if not upper else 2 if not lower else 1
    last = word[-1]
    ending = 0 if 65 <= last <= 90 or 97 <= last <= 122 or last >= 128 else 1 if last in b".,;:" else 2
    return case + 4 * ending + 12 * (word == before)


def plain(text):
    spread = lambda g: ((g * 2654435769) & 0xFFFFFFFF) >> (32 - quality.BITS)
    data = bytes([2, 2]) + text.encode() + bytes([3])
    grams = {data[i] | data[i + 1] << 8 | data[i + 2] << 16 for i in range(len(data) - 2)}
    words = text.encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ")
    words = [w for w in words if w]
    lined = [24, *(plain_shape(w, words[i - 1] if i else None) for i, w in enumerate(words)), 24]
    return sorted({spread(g) for g in grams} | {spread((a * 25 + b) * 25 + c + (1 << 24)) for a, b, c in zip(lined, lined[1:], lined[2:], strict=False)})


def test_indicators():
    texts = ["", "a", "Ab ab ab ab. CD!! 12 é", " \n\t", "same same", "same", "x " * 5000 + "Y", None, "Ünder *** | ;", "\x00 \x1c a b"]
    got = {}
    for first, last, found, begin in quality.portions(pa.array(texts, pa.string())):
        for k in range(first, last):
            got[k] = found[begin[k - first] : begin[k - first + 1]].tolist()
    assert [got[k] for k in range(len(texts))] == [plain(t or "") for t in texts]
    many = [f"w{i} x" for i in range(20_000)]
    assert sum(last - first for first, last, _, _ in quality.portions(pa.array(many))) == len(many)


def test_descent_reaches_the_optimum(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 2000)
    draw = np.random.default_rng(1)
    rows = [np.unique(draw.integers(0, 60, 12)) for _ in range(80)]
    good = np.array([(r < 25).mean() + draw.normal(0, 0.1) > 0.4 for r in rows])
    scale = draw.normal(0, 1, quality.FEATURES)
    w, constant = quality.descended(rows, good, scale)
    x = np.array([np.bincount(r, scale[r], 60) / np.sqrt(np.square(scale[r]).sum()) for r in rows])
    y = np.where(good, 1.0, -1.0)

    def loss(v):
        return v @ v / 2 + quality.BOUND * np.maximum(0, 1 - y * (x @ v[:60] + v[60])).sum()

    best = np.concatenate((w[:60], [constant]))
    assert not w[60:].any()
    # The loss is convex: no direction leads down from its least value.
    for _ in range(300):
        step = draw.normal(0, 1, 61) * 10.0 ** draw.uniform(-4, 0)
        assert loss(best + step) >= loss(best) - 1e-6


def test_ratios():
    r = quality.ratios([np.array([1, 2]), np.array([1]), np.array([3])], np.array([True, True, False]))
    p, q = 3 + quality.FEATURES, 1 + quality.FEATURES
    assert r[1] == pytest.approx(np.log(3 / p / (1 / q))) and r[3] == pytest.approx(np.log(1 / p / (2 / q)))


def test_held_out_documents(spark):
    got = queries.op11_support_vectors(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert len(good) > 40 and len(bad) > 5
    order = (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean()
    assert order > 0.97
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.8
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_labels_of_held_out_documents_are_not_learnt(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, t.filter(~quality.held_out())) for t in (labels, turned))
    assert np.array_equal(a.parts, b.parts) and (a.slope, a.place, a.constant) == (b.slope, b.place, b.constant)


def test_odd_tables(spark):
    docs = [(1, "Good text here. And more."), (2, "BAD!! BAD!! BAD!!"), (2, "BAD!! BAD!! BAD!!"), (3, None), (None, "no id"), (4, ""), (5, "long word " * 100_000), (6, "both ways")]
    docs = spark.createDataFrame([(*d, 9.0, "x") for d in docs], "doc_id long, text string, score double, predicted string")
    labels = [(1, 1), (2, 0), (2, 0), (3, None), (None, 1), (6, 0), (6, 1), (77, 1), (5, 4)]
    labels = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, text string")
    rows = quality.scored(docs, quality.train(docs, labels)).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[1] > score[2] and score[3] == score[4]
    # Labels of one kind, and none.
    for some, share in ((labels.filter("doc_id = 1"), 1.0), (labels.filter("doc_id = 2"), 0.0), (labels.limit(0), 0.5)):
        assert {round(r["score"], 5) for r in quality.scored(docs, quality.train(docs, some)).collect()} == {round(share, 5)}
    nothing = docs.limit(0)
    assert quality.scored(nothing, quality.train(nothing, labels)).collect() == []
