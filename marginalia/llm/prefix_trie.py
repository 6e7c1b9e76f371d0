"""The trie of all conversations' beginnings, built around the skeleton of the splitters' paths.

A turn is the digest of its role and text, a conversation the path of its turns. Conversations are dealt to shards by the order of
(path, conv_id); the splitters between shards are conversations of a sample. A node whose conversations lie in several shards has a
splitter between them that begins with it, so it is on a splitter's path. The trie of these paths, the skeleton, is broadcast.
Every shard, sorted, is one walk that keeps the nodes of the path in hand open: other nodes are finished where they close, those of
the skeleton give partial counts, which are added up by node. As splitters order copies of one path by conv_id, a path of
however many conversations is dealt to several shards too.

What the nodes below a node save is a sum over them of (conversations - 1) * bytes; the first part is added up like the
counts, the second is known once for each node.
"""

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import shard_keys, shuffle_partitions
from marginalia.scratch import written_once

#: Bytes of a turn's digest.
DIGEST = 32

#: Paths in the sample for each shard; a splitter is cut after so many turns, so that the skeleton has a bound.
SAMPLED, SPLITTER_TURNS = 32, 256

#: Bytes of conv_ids that travel together for the digest of a skeleton node's ends.
ENDS_BYTES = 1 << 16

_EMPTY = sha256().hexdigest()

_PATHS = pa.schema([("conv_id", pa.int64()), ("path", pa.large_binary()), ("sizes", pa.large_binary())])
_FOUND = pa.schema(
    [
        ("skeleton", pa.int64()), ("part", pa.int64()), ("size", pa.int64()), ("above", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
        ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.binary()),
    ]
)
_FOUND_TYPES = "skeleton long, part long, size long, above long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends binary"

#: What a rebuilt conversation takes from the first of its five, by the digest of its own id.
MEMBERS, SHARED = 5, 9


def turns(conversations: DataFrame) -> DataFrame:
    """base, conv_id, turn, digest and size of every turn with a conv_id; base is the conversation that lends the first turns.

    The digest covers role and text apart: the role's length stands before them.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    conv_id = F.col("conv_id").cast("long")
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        (conv_id - conv_id % MEMBERS).alias("base"), conv_id.alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(said.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("size"),
    )


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by base, the lender first, and by turn: a path for each conversation."""
    base, head, current, path, sizes = None, [], None, [], []
    out: list[tuple] = []

    def closed() -> None:
        """Puts the conversation in hand out; a lender's first turns stay for the others of its base."""
        if current == base:
            head.extend(zip(path[: SHARED - 1], sizes[: SHARED - 1], strict=True))
        h = zlib.crc32(str(current).encode()) % SHARED
        whole = head[:h] + list(zip(path[h:], sizes[h:], strict=True))
        out.append((current, b"".join(d for d, _ in whole), np.array([s for _, s in whole], np.int64).tobytes()))

    def left() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PATHS, strict=True)], schema=_PATHS)
        out.clear()
        return batch

    for batch in batches:
        for of, conv_id, digest, size in zip(*(batch.column(c).to_pylist() for c in ("base", "conv_id", "digest", "size")), strict=True):
            if conv_id != current or of != base:
                if current is not None:
                    closed()
                if of != base:
                    base, head = of, []
                current, path, sizes = conv_id, [], []
            path.append(digest)
            sizes.append(size)
        if out:
            yield left()
    if current is not None:
        closed()
        yield left()


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path (digests of the rebuilt turns, one after the other) and sizes (their texts' bytes) of every conversation."""
    rows = turns(conversations).repartition(shuffle_partitions(conversations), "base")
    order = ["base", (F.col("conv_id") != F.col("base")).cast("int"), "conv_id", F.col("turn").asc_nulls_first(), "role", "size", "digest"]
    return rows.sortWithinPartitions(*order).mapInArrow(_rebuilt, "conv_id long, path binary, sizes binary")


@dataclass
class Skeleton:
    """The splitters, in order, and the trie of their paths: nodes by the path to them."""

    splitters: list[tuple[bytes, int]]
    number: dict[bytes, int] = field(default_factory=dict)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)

    def __post_init__(self):
        for path in [b"", *(p for p, _ in self.splitters)]:
            for depth in range(len(path) // DIGEST + 1):
                at = path[: depth * DIGEST]
                if at not in self.number:
                    self.parents.append(self.number[at[:-DIGEST]] if at else -1)
                    self.depths.append(depth)
                    self.number[at] = len(self.depths) - 1

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))


def skeleton(rows: DataFrame, shards: int) -> Skeleton:
    """Splitters that deal the paths to about equal shards: quantiles of a sample by a hash of conv_id.

    The driver gets about SAMPLED paths for each shard and, like each task later, at most SPLITTER_TURNS nodes for each splitter.
    A splitter that is cut stands before all paths that begin with it.
    """
    n = rows.count()
    share = max(1, n // (SAMPLED * shards))
    cut = F.length("path") > SPLITTER_TURNS * DIGEST
    sample = rows.filter(F.pmod(F.xxhash64("conv_id"), F.lit(share)) == 0).select(
        F.when(cut, F.substr("path", F.lit(1), F.lit(SPLITTER_TURNS * DIGEST))).otherwise(F.col("path")).alias("path"),
        F.when(cut, F.lit(-(1 << 63))).otherwise(F.col("conv_id")).alias("conv_id"),
    )
    found = sorted((bytes(r["path"]), r["conv_id"]) for r in sample.collect())
    return Skeleton(sorted({found[len(found) * k // shards] for k in range(1, shards)}) if found else [])


class Node:
    """An open node: what is known of its conversations so far."""

    __slots__ = ("skeleton", "size", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends", "closed")

    def __init__(self, skeleton: int, size: int):
        self.skeleton, self.size, self.conv_id = skeleton, size, 1 << 63
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.ends = None
        self.closed: list[tuple] = []


class Walk:
    """One walk over a shard's sorted paths."""

    def __init__(self, trie: Skeleton, part: int):
        self.trie, self.part, self.open = trie, part << 32, []
        self.path, self.rows = b"", []

    def add(self, conv_id: int, path: bytes, sizes: bytes) -> None:
        shared, most = 0, min(len(path), len(self.path)) // DIGEST
        if path.startswith(self.path):
            shared = most
        else:
            before = self.path
            while shared < most and path[shared * DIGEST : (shared + 1) * DIGEST] == before[shared * DIGEST : (shared + 1) * DIGEST]:
                shared += 1
        while len(self.open) > shared + 1:
            self.close()
        depth = len(path) // DIGEST
        if len(self.open) <= depth:
            bytes_of = np.frombuffer(sizes, np.int64)
            for d in range(len(self.open), depth + 1):
                known = not d or self.open[-1].skeleton >= 0
                at = self.trie.number.get(path[: d * DIGEST], -1) if known else -1
                self.open.append(Node(at, int(bytes_of[d - 1]) if d else 0))
        self.path = path
        last = self.open[-1]
        last.n_convs += 1
        last.conv_id = min(last.conv_id, conv_id)
        if last.skeleton < 0:
            text = str(conv_id).encode()
            if last.ends is None:
                last.ends = sha256(text)
            else:
                last.ends.update(b"," + text)
        else:
            last.ends = last.ends or []
            last.ends.append(str(conv_id))
            if len(last.ends) * 8 > ENDS_BYTES:
                self.ended(last)

    def row(self, **values) -> None:
        self.rows.append(values)

    def ended(self, node: Node) -> None:
        """Puts out the ends of a skeleton node so far."""
        self.part += 1
        self.row(skeleton=node.skeleton, part=self.part, ends=",".join(node.ends).encode())
        node.ends = None

    def close(self) -> None:
        """The deepest open node has no more conversations here; its counts go to the node above."""
        node, depth = self.open.pop(), len(self.open) - 1
        above = self.open[-1] if self.open else None
        if node.skeleton < 0:
            node.n_leaves = node.n_leaves or 1
            node.saved += (node.n_convs - 1) * node.size
            for child in node.closed:
                self.row(**child, parent_conv_id=node.conv_id)
            told = {
                "conv_id": node.conv_id, "depth": depth + 1, "n_convs": node.n_convs, "n_children": node.n_children, "n_leaves": node.n_leaves,
                "saved_tokens": node.saved, "ends_sha256": node.ends.hexdigest() if node.ends else _EMPTY,
            }
            if above.skeleton >= 0:
                self.row(**told, above=above.skeleton)
            else:
                above.closed.append(told)
            above.n_children += 1
        else:
            if node.ends:
                self.ended(node)
            # Of a skeleton node the number above is subtracted once, when all parts are together.
            node.saved += node.n_convs * node.size
            self.row(
                skeleton=node.skeleton, conv_id=node.conv_id, depth=depth + 1, n_convs=node.n_convs, n_children=node.n_children,
                n_leaves=node.n_leaves, saved_tokens=node.saved, size=node.size,
            )
        if above:
            above.conv_id = min(above.conv_id, node.conv_id)
            above.n_convs += node.n_convs
            above.n_leaves += node.n_leaves
            above.saved += node.saved

    def left(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in self.rows], f.type) for f in _FOUND], schema=_FOUND)
        self.rows = []
        return batch


def _dealt(shared, keys: list[int]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            shards = [trie.shard(p, c) for p, c in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)]
            dealt = [pa.array(shards, pa.int32()), pa.array([keys[s] for s in shards], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *dealt], names=[*batch.schema.names, "shard", "key"])

    return task


def _walked(shared):
    """Shards, sorted by (path, conv_id): finished nodes, parts of skeleton nodes, and parts of their ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, shard = None, None
        for batch in batches:
            for of, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "sizes")), strict=True):
                if of != shard:
                    while walk and walk.open:
                        walk.close()
                    if walk:
                        yield walk.left()
                    walk, shard = Walk(shared.value, of), of
                walk.add(*row)
                if len(walk.rows) > 10_000:
                    yield walk.left()
        while walk and walk.open:
            walk.close()
        if walk:
            yield walk.left()

    return task


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each skeleton node's ends, whose parts come in order."""
    skeleton, digest = None, None
    for batch in batches:
        done = []
        for at, ends in zip(batch.column("skeleton").to_pylist(), batch.column("ends"), strict=True):
            if at != skeleton:
                if digest:
                    done.append((skeleton, digest.hexdigest()))
                skeleton, digest = at, sha256(ends.as_py())
            else:
                digest.update(b"," + ends.as_py())
        if done:
            yield pa.RecordBatch.from_pydict({"skeleton": [s for s, _ in done], "ends_sha256": [h for _, h in done]})
    if digest:
        yield pa.RecordBatch.from_pydict({"skeleton": [skeleton], "ends_sha256": [digest.hexdigest()]})


def _finished(found: DataFrame, trie: Skeleton) -> list[tuple]:
    """The skeleton's nodes: parts added up by node, then leaves and what was subtracted too seldom passed on upwards.

    (skeleton, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) of each; the driver holds the skeleton anyway.
    """
    counts = found.filter("skeleton IS NOT NULL AND ends IS NULL").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    )
    of = {r["skeleton"]: r.asDict() for r in counts.collect()}
    children = np.zeros(len(trie.parents), np.int64)
    for at in of:
        if trie.parents[at] >= 0:
            children[trie.parents[at]] += 1
    leaves, once = np.zeros(len(trie.parents), np.int64), np.zeros(len(trie.parents), np.int64)
    for at in sorted(of, reverse=True):  # a node's number is above its parent's
        of[at]["n_children"] += int(children[at])
        leaves[at] += of[at]["n_children"] == 0
        once[at] += of[at]["size"]
        if at:
            leaves[trie.parents[at]] += leaves[at]
            once[trie.parents[at]] += once[at]
    return [
        (at, r["conv_id"], trie.depths[at], of[trie.parents[at]]["conv_id"] if at else None, r["n_convs"], r["n_children"], r["n_leaves"] + int(leaves[at]), r["saved_tokens"] - int(once[at]))
        for at, r in of.items()
    ]


def nodes(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of the rebuilt ``conversations`` (conv_id, turn, role, text).

    Returns conv_id (the node's smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    Turns stand in order of turn, nulls first; rows with one turn number by role, bytes of the text, and the digest of both, repeated
    rows are repeated turns. Null roles and texts are empty. Rows without conv_id belong to no conversation. Negative ids
    lend as ``%`` of SQL has it. An empty table has no node, not even the root. Other columns are ignored.

    One conversation is one row of 40 bytes a turn, whatever the length of its texts.
    """
    shards = shuffle_partitions(conversations)
    spark, columns = conversations.sparkSession, ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = written_once(paths(conversations))
    trie = skeleton(rows, shards)
    shared = spark.sparkContext.broadcast(trie)
    dealt = rows.mapInArrow(_dealt(shared, shard_keys(rows, shards)), "conv_id long, path binary, sizes binary, shard int, key int")
    sorted_ = dealt.repartition(shards, "key").sortWithinPartitions("shard", "path", "conv_id")
    found = written_once(sorted_.mapInArrow(_walked(shared), _FOUND_TYPES))
    finished = _finished(found, trie)
    upper = spark.createDataFrame(
        finished, "skeleton long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    )
    ends = found.filter("ends IS NOT NULL").select("skeleton", "part", "ends").repartition("skeleton").sortWithinPartitions("skeleton", "part")
    ends = ends.mapInArrow(_digested, "skeleton long, ends_sha256 string")
    upper = upper.join(ends, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    # As many rows as the skeleton that was broadcast before.
    above = F.broadcast(spark.createDataFrame([r[:2] for r in finished], "above long, above_conv_id long"))
    lower = found.filter("skeleton IS NULL").join(above, "above", "left")
    lower = lower.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_conv_id"))
    return lower.select(*columns).unionByName(upper.select(*columns))
