"""Exact duplicates: radix tries over length-and-hash partitions own the texts.

Texts are equal when they are identical after every character of `[\\x20\\x09-\\x0D]` is deleted. A task first puts its
own rows into a trie, so that a text leaves it once however often it occurs there. Tasks' texts then meet in partitions
by length and content hash; there a compressed radix trie holds whole byte strings, and its terminal nodes the best row.
Rows come sorted by their bytes: Spark's external sort spills, and as everything left of the string in hand is complete,
a full trie hands over whole subtrees and goes on with an empty one. What a terminal decided returns to the rows by the
place of the task's own copy, a key no larger than one task's input.
"""

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import BLANKS, UNIT_BYTES, documents, rows_with, shuffle_partitions, text_key
from marginalia.scratch import written_once

#: Bytes of text that a task's own trie may hold; then it starts a new one.
TRIE_BYTES = 64 << 20

_STAGED = "task long, row long, place long, doc_id long, key long, n_chars long, length long, hash long, n long, body binary, text_sha256 string"
_ARROW = pa.schema([(x.split()[0], {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]]) for x in _STAGED.split(", ")])


class Trie:
    """A compressed radix trie over byte strings; each terminal holds one value."""

    def __init__(self):
        # A node: [label, value or None, children by first byte].
        self.root = [b"", None, {}]

    def insert(self, key: bytes, value):
        """The value already at this string, or else None once the new one is put there."""
        node, at = self.root, 0
        while at < len(key):
            child = node[2].get(key[at])
            if child is None:
                node[2][key[at]] = [key[at:], value, {}]
                return None
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = len(commonprefix((label, key[at : at + len(label)])))
            upper = [label[:shared], None, {label[shared]: child}]
            child[0] = label[shared:]
            node[2][key[at]] = upper
            node, at = upper, at + shared
        if node[1] is None:
            node[1] = value
            return None
        return node[1]


    def __iter__(self):
        """All (string, value), without recursion: a chain of prefixes may be long."""
        stack = [(self.root, b"")]
        while stack:
            (label, value, children), before = stack.pop()
            key = before + label
            if value is not None:
                yield key, value
            stack += [(child, key) for child in children.values()]


class Best:
    """What a terminal holds: the row that stays, the number of rows, and the tasks' copies that ended here."""

    __slots__ = ("rank", "n", "copies")

    def __init__(self, rank: tuple, n: int, copy):
        self.rank, self.n, self.copies = rank, n, [copy]

    def add(self, other: "Best", copy) -> None:
        self.rank, self.n = min(self.rank, other.rank), self.n + other.n
        self.copies.append(copy)


def _rank(n_chars: int, doc_id: int | None, task: int, row: int) -> tuple:
    """Least for the row that stays."""
    return -n_chars, doc_id is None, doc_id or 0, task, row


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _ARROW], schema=_ARROW)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one with the body for each string in a task's trie."""
    task, row, held, trie = TaskContext.get().partitionId(), 0, 0, Trie()

    def left() -> Iterator[pa.RecordBatch]:
        columns, size = {f.name: [] for f in _ARROW}, 0
        for body, best in trie:
            chars, _, doc_id, _, at = best.rank
            digest = hashlib.sha256(body).digest()
            values = (task, at, best.copies[0], None if best.rank[1] else doc_id, None, -chars, len(body), int.from_bytes(digest[:8], "little", signed=True), best.n, body, None)
            for f, value in zip(_ARROW, values, strict=True):
                columns[f.name].append(value)
            size += len(body)
            if size > UNIT_BYTES:
                yield _batch(columns)
                columns, size = {f.name: [] for f in _ARROW}, 0
        yield _batch(columns)

    for batch in batches:
        places, digests = [], []
        chars = pc.utf8_length(batch.column("text")).to_pylist()
        for text, n, doc_id in zip(batch.column("text").cast(pa.large_binary()), chars, batch.column("doc_id").to_pylist(), strict=True):
            body = text.as_py().translate(None, BLANKS)
            mine = Best(_rank(n, doc_id, task, row), 1, row)
            found = trie.insert(body, mine)
            if found is None:
                held += len(body) + 500
            else:
                found.rank, found.n = min(found.rank, mine.rank), found.n + 1
            places.append((found or mine).copies[0])
            digests.append(hashlib.sha256(body).hexdigest())
            row += 1
            if held > TRIE_BYTES:
                yield from left()
                trie, held = Trie(), 0
        empty = [None] * len(batch)
        yield _batch(
            {
                "task": [task] * len(batch), "row": range(row - len(batch), row), "place": places, "doc_id": batch.column("doc_id").to_pylist(), "key": batch.column("key").to_pylist(),
                "n_chars": chars, "length": empty, "hash": empty, "n": empty, "body": empty, "text_sha256": digests,
            }
        )
    yield from left()


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bodies of a partition, sorted: for each task's copy the row that stays.

    When the trie is full, all but the string in hand is complete, whole subtrees leave.
    """
    trie, held = Trie(), 0

    def told(terminals) -> Iterator[pa.RecordBatch]:
        columns = {name: [] for name in ("task", "place", "keep_id", "keep_task", "keep_row", "group_size")}
        for best in terminals:
            _, no_id, doc_id, task, row = best.rank
            for copy in best.copies:
                for name, value in zip(columns, (*copy, None if no_id else doc_id, task, row, best.n), strict=True):
                    columns[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns.values()], names=list(columns))

    for batch in batches:
        names = ("task", "row", "place", "doc_id", "n_chars", "n")
        bodies = batch.column("body")
        for at, (task, row, place, doc_id, chars, n) in enumerate(zip(*(batch.column(x).to_pylist() for x in names), strict=True)):
            body = bodies[at].as_py()
            mine = Best(_rank(chars, doc_id, task, row), n, (task, place))
            found = trie.insert(body, mine)
            if found is not None:
                found.add(mine, (task, place))
                continue
            held += len(body) + 500
            if held > TRIE_BYTES:
                yield from told(best for key, best in trie if key != body)
                trie, held = Trie(), len(body) + 500
                trie.insert(body, mine)
    yield from told(best for _, best in trie)


def owners(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): which row of its group of equal texts stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, key (hash of the text), and task and row, which together tell rows apart. A null
    text is empty; empty texts equal each other. The row with most code points in its original text stays, then the
    smallest doc_id, null ids last; of wholly repeated rows exactly one is ``kept``. Other columns are ignored, empty
    tables give empty results.
    """
    staged = written_once(documents(docs).withColumn("key", text_key()).mapInArrow(_local, _STAGED))
    decided = (
        staged.filter(F.col("body").isNotNull())
        .select("task", "row", "place", "doc_id", "n_chars", "n", "length", "hash", "body")
        .repartition(shuffle_partitions(docs), "length", "hash")
        .sortWithinPartitions("body")
        .mapInArrow(_owners, "task long, place long, keep_id long, keep_task long, keep_row long, group_size long")
    )
    members = staged.filter(F.col("body").isNull()).select("task", "row", "place", "doc_id", "key", "text_sha256")
    return members.join(decided, ["task", "place"]).select(
        "doc_id", "keep_id", "group_size",
        ((F.col("keep_task") == F.col("task")) & (F.col("keep_row") == F.col("row"))).alias("kept"),
        "text_sha256", "task", "row", "key",
    )


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns."""
    return rows_with(docs, owners(docs).filter("kept").select("doc_id", "key"), once=True)
