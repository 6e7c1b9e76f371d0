"""Near duplicates by MinHash with sequential Bayesian verification.

A document's set is its distinct shingles of five words. Documents with one set are one class from the start, so copies cost
nothing further. Classes that share a band of their signatures are candidates. Whether a candidate pair may reach the
threshold is decided from the signatures batch by batch: after n compared values with m equal, the posterior of the similarity
under a uniform prior is Beta(1 + m, 1 + n - m); when its mass above the threshold falls below MISS, the pair goes. Survivors
are verified on their full sets.

Only components are asked for, so pairs inside one component need no second look. First each class is compared with one
other: each bucket is led by the member that shares most with others, and a class follows the leader it meets in most buckets. Buckets that then still hold several components are compared in full
between components, in blocks of bounded size within tasks, and only links that join components leave a task. So the buckets of a
large group of near copies fall silent after the first step, and no link between different components is lost.
"""

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import buffers, documents, mixed, ranges, rows_with, run_hashes, shuffle_partitions, spans_of_words, text_key, units, word_hashes
from marginalia.scratch import written_once

WORDS = 5

#: Signatures have BANDS bands of BAND values: a pair at the threshold shares none with probability (1 - 0.75 ** 4) ** 28 = 2.4e-5.
BANDS, BAND = 28, 4

#: Linked are sets with PERCENT * union <= 100 * intersection.
PERCENT = 75

#: Signature values compared at a time, and the posterior chance below which a pair is given up.
STEP, MISS = 16, 1e-7

#: Members of a bucket that are compared with each other at a time.
BLOCK = 512

VALUES = BANDS * BAND
_FACTORS = mixed(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
_TERMS = mixed(np.arange(1001, VALUES + 1001, dtype=np.uint64))


def _above(n: int, m: int) -> float:
    """Mass of Beta(1 + m, 1 + n - m) above the threshold: the chance of at most m successes in n + 1 draws."""
    p = PERCENT / 100
    return sum(comb(n + 1, i) * p**i * (1 - p) ** (n + 1 - i) for i in range(m + 1))


#: After each step the least number of equal values with which a pair stays.
LEAST = [next(m for m in range(n + 1) if _above(n, m) >= MISS) for n in range(STEP, VALUES + 1, STEP)]


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of all texts as sorted 64-bit hashes, one after the other, second hashes beside them, and their offsets.

    Letters A-Z are lowered. Sets are one class only if both hashes of all their shingles agree, 128 bits of each. Intersections
    are taken by the first alone: that it is wrong by one has a chance below |A| * |B| / 2^64.
    """
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, first = spans_of_words(data, offsets)
    n = np.diff(first)
    size = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    head = ranges(first[:-1], size)
    count = np.repeat(np.minimum(n, WORDS), size)
    found, second = (run_hashes(word_hashes(data, starts, ends, lane), head, count, WORDS, lane) for lane in (0, 1))
    of = np.repeat(np.arange(len(n)), size)
    order = np.lexsort((second, found, of))
    found, second, of = found[order], second[order], of[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (second[1:] != second[:-1]) | (of[1:] != of[:-1])
    return found[keep], second[keep], np.searchsorted(of[keep], np.arange(len(n) + 1))


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """VALUES 32-bit values for each set that is not empty."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(full), VALUES), np.uint32)
    for j in range(VALUES):
        out[:, j] = np.minimum.reduceat((sets * _FACTORS[j] + _TERMS[j]) >> np.uint64(32), offsets[:-1][full]) if len(full) else 0
    return out


_SIGNED = "doc_id long, key long, n_shingles long, class binary, signature binary"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        sizes, classes, signed = [], [], []
        for first, last in units(np.diff(offsets)):
            part = offsets[first : last + 1]
            sets, seconds, at = shingles(data[part[0] : part[-1]], part - part[0])
            values, k = signatures(sets, at), 0
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                sizes.append(b - a)
                classes.append(hashlib.blake2b(sets[a:b].tobytes() + seconds[a:b].tobytes(), digest_size=16).digest() if a < b else None)
                signed.append(values[k].tobytes() if a < b else None)
                k += a < b
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(signed, pa.binary())],
            names=["doc_id", "key", "n_shingles", "class", "signature"],
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of each class."""
    salt = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        values = np.frombuffer(buffers(batch.column("signature"))[0], np.uint32).reshape(-1, BANDS, BAND).astype(np.uint64)
        bucket = np.broadcast_to(salt, values.shape[:2])
        for i in range(BAND):
            bucket = mixed(bucket + values[:, :, i])
        rep = batch.column("rep").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_pydict({"bucket": bucket.ravel().view(np.int64), "rep": np.repeat(rep, BANDS)})


def surviving(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the pairs of signatures (rows) stay after all steps."""
    alive, equal = np.arange(len(left)), np.zeros(len(left), np.int64)
    for step, least in enumerate(LEAST):
        at = slice(step * STEP, (step + 1) * STEP)
        equal = equal + (left[alive, at] == right[alive, at]).sum(axis=1)
        keep = equal >= least
        alive, equal = alive[keep], equal[keep]
    return alive


def _pair_survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (np.frombuffer(buffers(batch.column(x))[0], np.uint32).reshape(-1, VALUES) for x in ("sa", "sb"))
        yield batch.select(["a", "b"]).take(pa.array(surviving(left, right)))


def _shared(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with each of the others."""
    flat, sizes = np.concatenate(others), np.array([len(o) for o in others])
    same = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    return np.add.reduceat(same, np.cumsum(sizes) - sizes, dtype=np.int64)


def _enough(both: np.ndarray, size: int, others: np.ndarray) -> np.ndarray:
    return 100 * both >= PERCENT * (size + others - both)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of two blocks of a bucket, sorted by (bucket, x, y): links that join its components, verified on full sets.

    A pair is looked at in the first band that it shares. Of links between the same two components one is enough.
    """

    def told(reps: list, components: list, blocks: list, signed: list, sets: list, x: int, y: int) -> pa.RecordBatch:
        rep, component, block = np.array(reps, np.int64), np.array(components, np.int64), np.array(blocks)
        values = np.frombuffer(b"".join(signed), np.uint32).reshape(-1, VALUES)
        members = [np.frombuffer(s, np.uint64) for s in sets]
        sizes = np.array([len(m) for m in members])
        bands = values.reshape(-1, BANDS, BAND)
        # The bucket is a band that all members share; hashes of other bands may meet here only by chance.
        own = int((bands == bands[0]).all(axis=(0, 2)).argmax())
        found = ([], [])
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        for i in left.tolist():
            others = right[(component[right] != component[i]) & ((rep[right] > rep[i]) if x == y else True)]
            if own:
                others = others[~(bands[others, :own] == bands[i, :own]).all(axis=2).any(axis=1)]
            others = others[surviving(np.broadcast_to(values[i], (len(others), VALUES)), values[others])]
            if not len(others):
                continue
            linked = others[_enough(_shared(members[i], [members[j] for j in others]), sizes[i], sizes[others])]
            for j in linked.tolist():
                if component[i] != component[j]:
                    found[0].append(min(rep[i], rep[j]))
                    found[1].append(max(rep[i], rep[j]))
                    component[component == component[j]] = component[i]
        return pa.RecordBatch.from_pydict({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    key, held = None, ([], [], [], [], [])
    for batch in batches:
        names = ("bucket", "x", "y", "rep", "component", "block", "signature", "set")
        for i in range(len(batch)):
            bucket, x, y, *rest = (batch.column(c)[i].as_py() for c in names)
            if key is not None and key != (bucket, x, y):
                yield told(*held, *key[1:])
                held = ([], [], [], [], [])
            key = (bucket, x, y)
            for column, value in zip(held, rest, strict=True):
                column.append(value)
    if key is not None:
        yield told(*held, *key[1:])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for first, last in units(np.diff(offsets)):
            part = offsets[first : last + 1]
            sets, _, at = shingles(data[part[0] : part[-1]], part - part[0])
            found = [sets[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(first, last - first), pa.array(found, pa.binary())], names=["rep", "set"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for one, other in zip(batch.column("one"), batch.column("other"), strict=True):
            x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
            keep.append(bool(_enough(_shared(x, [y])[0], len(x), len(y))))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b); nodes without links are not listed.

    Each round every node hears the smallest label among its neighbours and itself, then takes its label's label. Labels
    are written to the shared folder after each round.
    """
    both = written_once(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = written_once(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "component").union(labels)
        least = heard.groupBy("node").agg(F.min("component").alias("component"))
        parent = least.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = written_once(least.join(parent, "component", "left").select("node", F.coalesce("further", "component").alias("component")))
        moved = new.join(labels.withColumnRenamed("component", "old"), "node").filter(F.col("component") != F.col("old")).limit(1).count()
        labels = new
        if not moved:
            return labels


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    with_a = pairs.join(sets, F.col("a") == F.col("rep")).select("a", "b", F.col("set").alias("one"))
    with_b = with_a.join(sets, F.col("b") == F.col("rep")).select("a", "b", "one", F.col("set").alias("other"))
    return with_b.mapInArrow(_verified, "a long, b long")


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lowered; fewer than five words are one shingle. Texts without words
    (null ones too) are linked with nothing, and so are rows with a null doc_id: their component is their own doc_id. Rows
    with one doc_id and different texts link as different documents, under one id. ``kept`` is doc_id = component_id,
    null-safe. Empty tables give empty results; other columns are ignored.
    """
    rows = documents(docs).withColumn("key", text_key())
    n = shuffle_partitions(docs)
    signed = written_once(rows.mapInArrow(_signed, _SIGNED))
    linked = signed.filter(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    # Classes are numbered by a hash: doc_id alone does not tell rows apart.
    first = F.min(F.struct("doc_id", "key", "signature"))
    classes = written_once(linked.groupBy("class").agg(first.alias("x")).select(F.xxhash64("class").alias("rep"), "class", "x.*"))
    reps = classes.select("rep", "signature")
    banded = reps.mapInArrow(_bands, "bucket long, rep long")
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    crowded = written_once(banded.join(sizes, "bucket"))
    # Among near copies of one text the least altered shares most buckets with the others, and it is like most of them.
    known = crowded.groupBy("rep").agg(F.sum("members").alias("known"))
    leaders = crowded.join(known, "rep").groupBy("bucket").agg(F.max(F.struct("known", "rep")).alias("x")).select("bucket", F.col("x.rep").alias("leader"))
    buckets = written_once(crowded.join(leaders, "bucket"))
    shared = buckets.filter("rep <> leader").groupBy("rep", "leader").agg(F.count("*").alias("n"))
    lead = shared.groupBy("rep").agg(F.max(F.struct("n", "leader")).alias("x")).select(F.col("x.leader").alias("a"), F.col("rep").alias("b"))
    signed_pairs = lead.join(reps.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a")
    signed_pairs = signed_pairs.join(reps.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
    sources = classes.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "key")
    texts = rows.join(sources, ["doc_id", "key"]).select("rep", "text")
    sets = written_once(texts.mapInArrow(_sets, "rep long, set binary"))
    links = written_once(_exact(signed_pairs.select("a", "b", "sa", "sb").mapInArrow(_pair_survivors, "a long, b long"), sets))
    label = components(links)
    named = buckets.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "members", F.coalesce("component", "rep").alias("component"))
    mixed_buckets = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    left = named.join(mixed_buckets, "bucket")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    left = left.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    left = left.select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "rep", "component", "block")
    left = left.join(reps, "rep").join(sets, "rep")
    dealt = left.repartition(n, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").select("bucket", "x", "y", "rep", "component", "block", "signature", "set")
    more = written_once(dealt.mapInArrow(_compared, "a long, b long"))
    joined = components(links.union(more))
    ids = classes.select("class", "rep", "doc_id").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    ids = ids.select("class", "doc_id", F.coalesce("component", "rep").alias("component"))
    least = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    answer = ids.join(least, "component").select("class", "component_id")
    out = signed.select("doc_id", "key", "n_shingles", "class").join(answer, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns."""
    return rows_with(docs, classified(docs).filter("kept").select("doc_id", "key"))
