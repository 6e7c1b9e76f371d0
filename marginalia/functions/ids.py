"""Ids that stay the same when the same list is read again."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset basis of the 64-bit FNV-1a hash, as two 32-bit halves, and the
# low part of its prime (2**40 + 435).
FNV_HIGH, FNV_LOW = 0xCBF29CE4, 0x84222325
FNV_PRIME_LOW = 435
WORD = 1 << 32


def stable_id(url: Column, salt: Column) -> Column:
    """``gen_`` and the 64-bit FNV-1a of ``salt``, NUL and ``url`` over UTF-16 code units.

    Products of 64-bit numbers overflow, so the state is kept as two 32-bit halves.
    """
    text = F.concat(F.coalesce(salt, F.lit("")), F.lit("\0"), url)
    unit_hex = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    units = F.transform(unit_hex, lambda h: F.conv(h, 16, 10).cast("bigint"))
    start = F.struct(F.lit(FNV_HIGH).cast("bigint").alias("hi"), F.lit(FNV_LOW).cast("bigint").alias("lo"))

    def step(state, unit):
        low = state["lo"].bitwiseXOR(unit)
        product = low * FNV_PRIME_LOW
        carry = F.shiftright(product, 32)
        high = state["hi"] * FNV_PRIME_LOW + F.shiftleft(low, 8) + carry
        return F.struct((high % WORD).alias("hi"), (product % WORD).alias("lo"))

    def finish(state):
        digits = [F.lpad(F.lower(F.hex(state[half])), 8, "0") for half in ("hi", "lo")]
        return F.concat(F.lit("gen_"), *digits)

    return F.aggregate(units, start, step, finish)


def new_source_id(path: Column | None = None) -> Column:
    """A source id: random, or derived from ``path`` where a run must be repeatable."""
    return F.concat(F.lit("file_"), F.expr("uuid()") if path is None else F.sha2(path, 256))
