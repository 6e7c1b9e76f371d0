"""Removal of repeated passages against a plain account of every window."""

import hashlib
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import passages, phrase_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"


def brute(rows, symbols, window, glue):
    texts = [(d, symbols((t or "").encode())) for d, t in rows]
    least = {}
    for d, x in texts:
        for i in range(len(x) - window + 1):
            w = tuple(x[i : i + window])
            if d is not None:
                least[w] = min(d, least.get(w, d))
    out = []
    for d, x in texts:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - window + 1):
            if d is not None and least[tuple(x[i : i + window])] < d:
                gone[i : i + window] = True
        kept = glue([s for s, g in zip(x, gone[:-1], strict=True) if not g])
        out.append((d, len(x), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def byte_rows(rows):
    return brute(rows, list, 50, bytes)


def word_rows(rows):
    cut = lambda data: re.findall(rb"[^\x20\x09-\x0D]+", data)
    return sorted(((d, n, gone, sha) for d, n, gone, _, sha in brute(rows, cut, 50, b" ".join)), key=str)


def planted():
    draw = np.random.default_rng(5)
    words = lambda n: " ".join("".join(chr(97 + c) for c in draw.integers(0, 26, 4)) for _ in range(n))
    passage, line, short = words(120), words(60), words(49)
    rows = [(k, f"{words(30)} {passage if k % 3 else line}\n{words(int(draw.integers(0, 90)))} {short}") for k in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[4][1]), (2, rows[5][1]), (None, rows[1][1])]
    rows += [(200, None), (201, ""), (202, "a" * 300), (203, "a" * 200 + "b" * 70), (204, "ab" * 150), (205, "x " * 120), (206, "x " * 90 + "y " * 60)]
    rows += [(207, "b" * 70), (208, "y\t" * 55), (209, passage.replace(" ", "\n")), (210, "é" * 60), (211, "é" * 40), (5, rows[5][1]), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("blocks", [64, 2])
def test_planted(spark, monkeypatch, blocks):
    monkeypatch.setattr(passages, "HOT_BLOCKS", blocks)
    rows = planted()
    table = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n_words int, key string").repartition(5)
    assert sorted(map(tuple, suffix_dedup.digests(table).collect()), key=str) == byte_rows(rows)
    assert sorted(map(tuple, phrase_dedup.digests(table).collect()), key=str) == word_rows(rows)


def test_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(4)
    rows = [tuple(r) for r in table.collect()]
    assert sorted(map(tuple, phrase_dedup.digests(table).collect()), key=str) == word_rows(rows)
    assert sorted(map(tuple, suffix_dedup.digests(table).collect()), key=str) == byte_rows(rows)


def test_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.digests(table).count() == 0 and phrase_dedup.digests(table).count() == 0


def opposite(n):
    """Two words of 2^n letters that a polynomial modulo 2^64 cannot tell apart."""
    one, other = "a", "b"
    for _ in range(n):
        one, other = one + other, other + one
    return one, other


def test_words_that_a_polynomial_takes_for_each_other(spark):
    one, other = opposite(10)
    head, tail = " ".join(f"h{k}" for k in range(30)), " ".join(f"t{k}" for k in range(19))
    rows = [(1, f"{head} {one} {tail}"), (2, f"{head} {other} {tail}"), (3, f"{head} {one} {tail}")]
    for n in (1, 3):
        table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(n)
        assert sorted(map(tuple, phrase_dedup.digests(table).collect()), key=str) == word_rows(rows)
        assert sorted(map(tuple, suffix_dedup.digests(table).collect()), key=str) == byte_rows(rows)


def test_pieces_of_one_hash_are_compared_by_their_bytes():
    data = np.frombuffer(b"abcabdabcxabcabc", np.uint8)
    starts, ends = np.array([0, 3, 6, 10, 13, 9]), np.array([3, 6, 9, 13, 16, 13])
    assert passages._equal(data, starts, ends, np.array([0, 1, 2, 3, 4])).tolist() == [False, False, True, True, False]


def asked(texts, docs, columns):
    words = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, words)])
    windows = np.array([len(w.split()) - phrase_dedup.WINDOW + 1 for w in words])
    return passages.Asked(np.frombuffer(b"".join(words), np.uint8), offsets, np.array(docs), windows, np.array(columns))


def test_removals_come_from_the_finds(monkeypatch):
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "vw")
    both = asked([one, one, two, two], [5, 9, 6, 7], [20, 20, 20, 20])
    assert phrase_dedup.solve(both).tolist() == [5] * 22 + [6] * 22
    whole = phrase_dedup.automaton
    lost = [" ".join(f"w{k}" for k in range(20, 28))]
    # A phrase that is missing in the automaton loses its own removals, and no others.
    monkeypatch.setattr(phrase_dedup, "automaton", lambda phrases: whole([p if p not in lost else "no such phrase" for p in phrases]))
    got = phrase_dedup.solve(both)
    assert got[:22].tolist() == [5] * 22 and (got[22:] > 9).all()
    # Columns only say where a shard's phrases are cut; a text is laid where the automaton finds one.
    monkeypatch.setattr(phrase_dedup, "automaton", whole)
    assert phrase_dedup.solve(asked([one, one], [5, 9], [20, 25])).tolist() == [5] * 22


def test_what_is_exchanged_is_small(monkeypatch):
    monkeypatch.setattr(passages, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    draw = np.random.default_rng(7)
    words = ["".join(chr(97 + c) for c in draw.integers(0, 26, int(n))) for n in draw.integers(2, 9, 400)]
    text = lambda n: " ".join(words[k] for k in draw.integers(0, 400, n))
    passage = text(300)
    texts = [f"{text(250)} {passage if k % 2 else text(300)}".encode() for k in range(200)]
    docs, keys = pa.array(range(200), pa.int64()), pa.array(range(200), pa.int64())
    whole, shards = sum(map(len, texts)), [0, 1]
    size = lambda batches: sum(c.nbytes for b in batches for c in b.columns)
    batch = pa.RecordBatch.from_pydict({"doc_id": docs, "key": keys, "text": pa.array(texts, pa.binary())})
    asked = list(passages._anchors(suffix_dedup.read, 50, 16, shards)(iter([batch])))
    # Hashes of eight bytes, a count and a row were over 0.7 of the texts.
    assert size(asked) < 0.35 * whole
    dealt = lambda batches, name: iter(pa.Table.from_batches(batches).sort_by([(name, "ascending"), ("kind", "ascending")]).to_batches())
    known = pa.Table.from_batches(passages._per_row(dealt(list(passages._recurring(dealt(asked, "shard"))), "block"))).to_pydict()
    assert max(len(x) / len(h) for x, h in zip(known["anchors"], known["hot"], strict=True)) == passages.ASKED_BYTES
    row = {d: (a, h) for d, a, h in zip(known["doc_id"], known["anchors"], known["hot"], strict=True)}
    packed = pa.Table.from_batches(passages._packed(iter([batch])))
    assert packed.nbytes < 0.6 * whole
    packed = packed.append_column("anchors", pa.array([row.get(d, (None, None))[0] for d in range(200)], pa.binary()))
    packed = packed.append_column("hot", pa.array([row.get(d, (None, None))[1] for d in range(200)], pa.binary()))
    found = list(passages._found(suffix_dedup.read, 50, 16, shards)(iter(packed.to_batches())))
    parked = [x for b in found for x in b.to_pylist() if x["kind"] == passages.PARKED]
    pieces = sum(len(passages._array(x, "e", np.uint64)) for x in parked)
    # Sixteen bytes before.
    assert sum(len(x[c]) for x in parked for c in "cde") < 3.5 * pieces
    answers = list(passages._solved(suffix_dedup.solve)(dealt(found, "shard")))
    told = sum(len(passages._array(x, "b", np.uint16)) for b in answers for x in b.to_pylist() if x["kind"] == passages.ANSWER)
    assert told < pieces
    cut = pa.Table.from_batches(passages._ranges(50)(dealt(answers, "block"))).to_pylist()
    gone = {x["doc_id"]: int((np.frombuffer(x["ends"], np.int64) - np.frombuffer(x["starts"], np.int64)).sum()) for x in cut}
    assert [gone.get(d, 0) for d in range(200)] == [n for _, _, n, _, _ in sorted(byte_rows(list(enumerate(t.decode() for t in texts))))]


def test_places_are_told_once():
    draw = np.random.default_rng(3)
    home, piece = draw.integers(0, 3, 50), draw.integers(0, 20, 500)
    shard = home[piece]
    want, told, numbers, next_ = [], [], {}, [0, 0, 0]
    for p, s in zip(piece.tolist(), shard.tolist(), strict=True):
        told.append((s << 40) | (numbers[p] + 1 if p in numbers else 0))
        if p not in numbers:
            numbers[p], next_[s] = next_[s], next_[s] + 1
        want.append((s << 40) + numbers[p])
    assert passages._places(np.array(told, np.uint64)).tolist() == want


def test_blocks_of_little_text_and_ids_at_both_ends(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 700)
    low, high = -(2**63), 2**63 - 1
    rows = [({0: low, 1: high, 2: 0}.get(d, d), t) for d, t in planted()]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, suffix_dedup.digests(table).collect()), key=str) == byte_rows(rows)
    assert sorted(map(tuple, phrase_dedup.digests(table).collect()), key=str) == word_rows(rows)
