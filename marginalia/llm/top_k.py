"""Exact top-k by inner product: columnar branch and bound.

Candidates lie in strips, each a matrix with one row per dimension. Queries come to every strip in blocks. A query's partial
products are summed over one block of dimensions after the other; what the remaining dimensions can add is at most the
product of the two remaining norms. Candidates that cannot reach the k-th best score are dropped after each block and the
others moved together. The bar is the k-th best of a few candidates summed in full first; the strip's best answer raises it.
Each strip returns its k best for a query, and these are merged.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import mixed, shard_keys, shuffle_partitions

#: Dimensions summed before candidates are dropped, and rows that travel together.
DIMENSIONS, ROWS = 8, 1024

#: Candidates of a strip, about, at most.
STRIP_ROWS = 1 << 17

_BLOCKS = "strip int, kind int, block long, rows long, ids binary, uids binary, vectors binary"
_BEST = "block long, ids binary, uids binary, counts binary, found binary, found_uids binary, scores binary"


def _blocks(strips: list[int]):
    """Rows of whole numbers as blocks: each to one strip as candidates, in turn, its queries to all strips."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, number = TaskContext.get().partitionId(), 0, 0

        def block(strip: int, kind: int, ids, uids, vectors):
            return {
                "strip": strip, "kind": kind, "block": (part << 32) + number, "rows": len(ids),
                "ids": ids.tobytes(), "uids": uids.tobytes(), "vectors": vectors.tobytes(),
            }

        schema = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in _BLOCKS.split(", ")])
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                piece = batch.slice(first, ROWS)
                ids = piece.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
                lists = piece.column("vector")
                sizes = np.diff(lists.offsets.to_numpy())
                vectors = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
                vectors[np.arange(vectors.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
                uids = (np.int64(part) << 36) + np.arange(row, row + len(ids))
                row, number = row + len(ids), number + 1
                # In turn, from another strip in each task.
                strip = strips[(int(mixed(np.array([part], np.uint64))[0]) + number) % len(strips)]
                yield pa.RecordBatch.from_pylist([block(strip, 0, ids, uids, vectors)], schema)
                asked = piece.column("asked").to_numpy(zero_copy_only=False)
                if asked.any():
                    mine = (ids[asked], uids[asked], vectors[asked])
                    for strip in strips:
                        yield pa.RecordBatch.from_pylist([block(strip, 1, *mine)], schema)

    return task


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, uids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["uids"], np.int64)
    return ids, uids, np.frombuffer(row["vectors"], np.int64).reshape(len(ids), -1)


def _wide(vectors: np.ndarray, width: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def _rest(vectors: np.ndarray) -> np.ndarray:
    """Norms of what is left of each vector from each block of dimensions on, rounded up."""
    squares = np.square(vectors.astype(np.float64))
    starts = range(0, vectors.shape[1], DIMENSIONS)
    return np.array([np.sqrt(squares[:, at:].sum(axis=1)) for at in starts]).reshape(len(starts), len(vectors)) * (1 + 1e-12)


class Strip:
    """Candidates in vertical layout."""

    def __init__(self, ids: np.ndarray, uids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(-np.square(vectors.astype(np.float64)).sum(axis=1), kind="stable")  # long vectors score high
        self.ids, self.uids = ids[order], uids[order]
        self.columns, self.rest = np.ascontiguousarray(vectors[order].T), _rest(vectors[order])

    def best(self, query: np.ndarray, rest: np.ndarray, uid: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best candidates beside the query itself; ties to the smaller id."""
        seeds, bar = min(len(self.ids), 4 * k), -np.inf
        if seeds > k:
            sums = np.where(self.uids[:seeds] == uid, np.iinfo(np.int64).min, query @ self.columns[:, :seeds])
            bar = np.partition(sums, seeds - k)[seeds - k]
        alive = np.flatnonzero(self.uids != uid)
        sums = np.zeros(len(alive), np.int64)
        for b, at in enumerate(range(0, len(query), DIMENSIONS)):
            sums = sums + query[at : at + DIMENSIONS] @ self.columns[at : at + DIMENSIONS, alive]
            if b + 1 < len(rest) and bar > -np.inf:
                keep = sums + self.rest[b + 1][alive] * rest[b + 1] + 1 >= bar
                if not keep.all():
                    alive, sums = alive[keep], sums[keep]
        if len(alive) > k:
            last = np.partition(sums, len(sums) - k)[len(sums) - k]
            keep = sums >= last
            alive, sums = alive[keep], sums[keep]
        order = np.lexsort((self.uids[alive], self.ids[alive], -sums))[:k]
        return alive[order], sums[order]


def _searched(k: int):
    """For each block of queries the best of this strip; candidates stand before queries."""

    def answer(strips: list, row: dict) -> dict:
        ids, uids, queries = _matrix(row)
        counts, found, found_uids, scores = [], [], [], []
        if strips and not isinstance(strips[0], Strip):
            width = max(v.shape[1] for _, _, v in strips)
            strips[:] = [Strip(*(np.concatenate(x) for x in zip(*((i, u, _wide(v, width)) for i, u, v in strips), strict=True)))]
        if strips:
            strip, width = strips[0], strips[0].columns.shape[0]
            # A vector that is shorter than others has zeros behind it.
            queries = _wide(queries, width) if queries.shape[1] < width else queries[:, :width]
            rests = _rest(queries)
            for j, query in enumerate(queries):
                at, sums = strip.best(query, rests[:, j], uids[j], k)
                counts.append(len(at))
                found.append(strip.ids[at])
                found_uids.append(strip.uids[at])
                scores.append(sums)
        flat = lambda x: np.concatenate(x or [np.zeros(0, np.int64)]).tobytes()
        counts = np.array(counts or [0] * len(ids), np.int64).tobytes()
        return {"block": row["block"], "ids": row["ids"], "uids": row["uids"], "counts": counts, "found": flat(found), "found_uids": flat(found_uids), "scores": flat(scores)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, strips = None, []
        schema = pa.schema([(x.split()[0], {"long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in _BEST.split(", ")])
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["strip"] != current:
                    current, strips = row["strip"], []
                if row["kind"] == 0:
                    strips.append(_matrix(row))
                else:
                    yield pa.RecordBatch.from_pylist([answer(strips, row)], schema)

    return task


def _merged(k: int):
    """The strips' answers to a block of queries, which stand together: the best of all."""

    def told(rows: list[dict]) -> pa.RecordBatch:
        ids, uids = np.frombuffer(rows[0]["ids"], np.int64), np.frombuffer(rows[0]["uids"], np.int64)
        number = lambda name: np.concatenate([np.frombuffer(r[name], np.int64) for r in rows])
        query = np.concatenate([np.repeat(np.arange(len(ids)), np.frombuffer(r["counts"], np.int64)) for r in rows])
        found, found_uids, scores = number("found"), number("found_uids"), number("scores")
        order = np.lexsort((found_uids, found, -scores, query))
        query, found, scores = query[order], found[order], scores[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        keep = rank <= k
        return pa.RecordBatch.from_pydict({"query_id": ids[query[keep]], "rank": rank[keep].astype(np.int32), "vec_id": found[keep], "score": scores[keep]})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[0]["block"] != row["block"]:
                    yield told(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield told(rows)

    return task


def top_k(vectors: DataFrame, asked: Column, k: int = 20, scale: float = 64) -> DataFrame:
    """The k candidates of ``vectors`` (vec_id, embedding) with the highest inner product for each row that ``asked`` holds for.

    Components are taken as floor(scale * x); scores are whole 64-bit numbers. Every row but the query's own is a candidate,
    also one with the same vec_id. Ties go to the smaller vec_id. Rows with a null vec_id, a null vector, or a null or
    non-finite component take no part; a shorter vector has zeros behind it, an empty one scores 0. An empty table has no
    rows; fewer than k candidates are all returned. Other columns are ignored.
    """
    strips = max(shuffle_partitions(vectors), -(-vectors.count() // STRIP_ROWS))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.withColumn("asked", F.coalesce(asked, F.lit(False))).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    whole = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), "asked", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector")
    )
    blocks = whole.mapInArrow(_blocks(shard_keys(vectors, strips)), _BLOCKS)
    found = blocks.repartition(strips, "strip").sortWithinPartitions("strip", "kind").mapInArrow(_searched(k), _BEST)
    return found.repartition(strips, "block").sortWithinPartitions("block").mapInArrow(_merged(k), "query_id long, rank int, vec_id long, score long")
