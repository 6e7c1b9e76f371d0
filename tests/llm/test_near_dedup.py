"""Near duplicates against all pairs of full sets."""

import re

import numpy as np
import pytest

from marginalia.llm import near_dedup

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    out = [(d, len(sets[i]), least[root(i)] if d is not None else None) for i, (d, _) in enumerate(rows)]
    return sorted(((d, n, c, d == c) for d, n, c in out), key=str)


def planted():
    draw = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + c) for c in draw.integers(0, 26, 5))
    rows, doc = [], 0
    for family in range(6):
        base = [word() for _ in range(150)]
        for _ in range(25):
            copy = list(base)
            for at in draw.integers(0, 150, int(draw.integers(0, 7))):
                copy[at] = word()
            rows.append((doc, " ".join(copy)))
            doc += 1
    chain = [word() for _ in range(200)]
    for step in range(12):  # each is like the next one, the ends are not alike
        rows.append((doc, " ".join(chain)))
        chain = chain[18:] + [word() for _ in range(18)]
        doc += 1
    rows += [(500, rows[3][1]), (501, rows[3][1].upper()), (2, "other words under a used id here"), (2, rows[40][1]), (None, rows[3][1]), (None, None)]
    rows += [(600, None), (601, ""), (602, "one two"), (603, "One  two"), (604, "one two three four five six"), (605, " \t "), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("block", [512, 4])
def test_planted(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = planted()
    table = spark.createDataFrame([(d, t, 1, b"") for d, t in rows], "doc_id long, text string, key int, class binary").repartition(3)
    got = near_dedup.classified(table).drop("key").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in table.collect()]
    assert sorted(map(tuple, near_dedup.classified(table).drop("key").collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert near_dedup.classified(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_that_a_polynomial_takes_for_each_other(spark):
    one, other = "a", "b"
    for _ in range(10):
        one, other = one + other, other + one
    rows = [(1, f"x y {one} z w"), (2, f"x y {other} z w"), (3, one), (4, other), (5, "a b " * 2 + "b a " * 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.classified(table).collect()} == {(k, k) for k in range(1, 6)}
