"""The trie against a plain one of all prefixes; small shards so that much of it is skeleton."""

import random
import zlib
from hashlib import sha256

import pytest

from marginalia.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows):
    own = {}
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    for said in own.values():
        said.sort(key=lambda t: (*t[:3], len(t[3].encode()), sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(t[2:] for t in own.get(lender, [])[:h] + own[c][h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (
            min(of), len(node), min(members[node[:-1]]) if node else None, len(of), children.get(node, 0), leaves[node], saved[node],
            sha256(",".join(str(c) for c in sorted(of) if len(paths[c]) == len(node)).encode()).hexdigest(),
        )
        for node, of in members.items()
    )


def found(spark, rows):
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in prefix_trie.nodes(table).collect())


def drawn(seed, n, deepest=6):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(draw.randint(1, deepest)):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["a", "bé", "", "a" * 40])))
    return rows


@pytest.mark.parametrize("seed,n", [(1, 3), (2, 40), (3, 400)])
def test_random_conversations(spark, seed, n):
    rows = drawn(seed, n)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("sampled", [1, 500])
def test_copies_deep_paths_and_cut_splitters(spark, monkeypatch, sampled):
    monkeypatch.setattr(prefix_trie, "SPLITTER_TURNS", 5)
    monkeypatch.setattr(prefix_trie, "SAMPLED", sampled)
    monkeypatch.setattr(prefix_trie, "ENDS_BYTES", 64)
    rows = drawn(9, 50)
    # A third of all conversations are copies, others share a deep beginning, one is longer than all.
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1200) for t in range(3)]
    rows += [(c, t, "user", f"deep {t}" if t < 20 else f"{c}") for c in range(2000, 2060) for t in range(21 + c % 3)]
    rows += [(5000, t, "user", f"long {t}") for t in range(120)]
    rows += [(c, t, "user", "x") for c in range(3000, 3050) for t in range(c % 7 + 1)]
    got, want = found(spark, rows), brute(rows)
    assert got == want


def test_nulls_ties_and_turnless(spark):
    rows = [
        (None, 0, "user", "nobody's"), (5, None, None, None), (5, None, "user", ""), (5, 1, "u", "ser"), (5, 1, "us", "er"),
        (5, 1, "us", "er"), (6, 0, "a", "x"), (7, 0, None, "y" * 100_000), (8, 3, "a", "x"), (9, 2, "é", None), (-3, 0, "n", "neg"),
        (-5, 0, "n", "lender"), (-5, 1, "n", "second"), (0, 0, "n", "zero"), (4, 0, "n", "four"), (12, 0, "b", "no lender"),
    ]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(None, 0, "a", "b")]) == []


def test_order_of_splitters_and_shards():
    trie = prefix_trie.Skeleton([(b"", 5), (b"a" * 32, 7), (b"a" * 64, -9)])
    assert [trie.shard(*x) for x in [(b"", 4), (b"", 5), (b"a" * 32, 6), (b"a" * 32, 7), (b"a" * 64, -10), (b"b" * 32, 0)]] == [0, 1, 1, 2, 2, 3]
    assert trie.depths == [0, 1, 2] and trie.parents == [-1, 0, 1]
