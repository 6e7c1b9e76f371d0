"""Helpers of the operators: Arrow columns as byte buffers, row identity, whitespace, hashing."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters `[\x20\x09-\x0D]`.
BLANKS = b" \t\n\x0b\x0c\r"

#: Bytes of text that numpy code works on at a time.
UNIT_BYTES = 1 << 21


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text, null texts empty; all other columns are left behind."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def rows_with(docs: DataFrame, keys: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, hash of the text) is among ``keys``; ``once``: one of wholly repeated rows.

    Plain equality on columns without nulls, so that the rows' one exchange serves both steps.
    """
    doc_id = F.col("doc_id").cast("long")
    identity = {"_id": F.coalesce(doc_id, F.lit(0)), "_no_id": doc_id.isNull()}
    marked = docs.withColumns(identity | {"_key": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    found = marked.join(keys.withColumns(identity).withColumnRenamed("key", "_key"), ["_id", "_no_id", "_key"], "left_semi")
    return (found.dropDuplicates(["_id", "_no_id", "_key"]) if once else found).select(*docs.columns)


def shuffle_partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: str = "text") -> Column:
    """With doc_id the identity of a row: rows with the same id and text need not be told apart."""
    return F.xxhash64(text)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its values; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def longs(column: pa.Array, null: int = 0) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def units(lengths: np.ndarray, limit: int = UNIT_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of values of at most ``limit`` together, or of one value."""
    total, first = np.concatenate(([0], np.cumsum(lengths))), 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(total, total[first] + limit, "right")) - 1)
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def spans_of_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of all values, and for each value its first word."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inner = ~blank[1:]
    starts = np.flatnonzero(inner[: len(data)] & (blank[:-2] | edge[:-1]))
    ends = np.flatnonzero(~blank[1:-1] & (blank[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Odd, so that it has an inverse.
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                values = np.full(n, base, np.uint64)
                values[:1] = 1
                _POWERS[name] = np.multiply.accumulate(values)
    return _POWERS["up"], _POWERS["down"]


#: A well-spread 64-bit number for each byte.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of the values, which are well-spread 64-bit numbers; ranges may overlap.

    For finding candidates only: a polynomial modulo 2^64 gives long unequal ranges of a regular kind one hash whatever its base.
    """
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Set the two lanes of the hashes below apart.
_LANES = mixed(np.arange(7001, 7003, dtype=np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each range; ranges are not empty. Two lanes together are 128 bits.

    The sum of a well-spread number for every (place in the range, byte), so no arithmetic relation between places makes
    unequal ranges equal.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    at = ranges(starts, sizes)
    values = (at - np.repeat(starts, sizes)).astype(np.uint64) << np.uint64(8)
    values |= data[at]
    values += _LANES[lane]
    return mixed(np.add.reduceat(mixed(values), np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))


def run_hashes(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int, lane: int = 0) -> np.ndarray:
    """The same for runs of at most ``most`` values, which may overlap."""
    salts = mixed(_LANES[lane] + np.arange(1, most + 1, dtype=np.uint64))
    out = sizes.astype(np.uint64)
    for j in range(most):
        longer = sizes > j
        out[longer] += mixed(values[starts[longer] + j] + salts[j])
    return mixed(out)


def shard_keys(frame: DataFrame, n: int) -> list[int]:
    """A number for each of n partitions that Spark's hash partitioning puts there."""
    spark, found, size = frame.sparkSession, {}, 16 * n
    while len(found) < n:
        ids = spark.range(size).select(F.col("id").cast("int").alias("id"))
        found = {r[0]: r[1] for r in ids.groupBy(F.pmod(F.hash("id"), F.lit(n))).agg(F.min("id")).collect()}
        size *= 4
    return [found[i] for i in range(n)]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(begin - starts, lengths)
