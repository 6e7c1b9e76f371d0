"""Exact duplicates: the trie by itself, and owners against a plain account."""

import hashlib
import re

import pytest

from marginalia.llm import exact_dedup


def test_trie():
    trie, keys = exact_dedup.Trie(), [b"abc", b"abd", b"", b"ab", b"abcde", b"xyz", b"abc", b"x" * 3000, b"x" * 2999 + b"y"]
    for value, key in enumerate(keys):
        assert trie.insert(key, value) == (None if key not in keys[:value] else keys.index(key))
    assert dict(trie) == {k: keys.index(k) for k in keys}
    deep = exact_dedup.Trie()
    assert all(deep.insert(b"a" * n, n) is None for n in range(3000)) and len(dict(deep)) == 3000


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    out = []
    for body, group in groups.items():
        keep = min(group)[3]
        out += [(x[3], keep, len(group), hashlib.sha256(body.encode()).hexdigest()) for x in group]
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [64 << 20, 10])
def test_owners(spark, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", limit)
    rows = [(k, "hot text") for k in range(40)] + [(50, "hot  text"), (51, "hot text"), (52, None), (53, ""), (54, " \n"), (55, "é"), (56, "é "), (None, "hot text "), (57, "x" * 5000)]
    rows += [(60, "one"), (60, "one"), (60, "two"), (61, "one\t")]
    table = spark.createDataFrame([(d, t, 1, "r") for d, t in rows], "doc_id long, text string, task int, row string").repartition(4)
    got = exact_dedup.owners(table).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(rows)
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
    assert exact_dedup.owners(table.limit(0)).count() == 0
    stay = exact_dedup.kept(table).collect()
    assert len(stay) == len({r["text_sha256"] for r in got}) and set(stay[0].asDict()) == {"doc_id", "text", "task", "row"}
