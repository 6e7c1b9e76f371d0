"""Counts that follow a journal's changes instead of being taken anew.

Kept are, by kind and key, how many rows have the key and the first position of one: hosts, folders and states of the rows (hosts and
folders of live rows only), and tags of all rows. A change takes what its rows counted before away and adds what they count now. A
first position can only be lost with the row that has it; for the keys where that happened, and only there, it is looked for again.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values, web
from ..scratch import written_once

DOMAIN, TAG, FOLDER, STATE = "domain", "tag", "folder", "state"

# Keys whose first position is looked for again are broadcast up to so many.
BROADCAST_KEYS = 200_000


def keys(rows: DataFrame) -> DataFrame:
    """(kind, key, seq): all that a row counts for."""

    def one(kind: str, key: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), key.alias("key")))

    live, host = ~values.trashed(), web.domain(F.col("url"))
    single = [
        one(DOMAIN, host, live & (host != "")),
        one(FOLDER, F.col("source_file_id"), live & F.col("source_file_id").isNotNull()),
        one(STATE, F.when(live, "active").otherwise("trashed"), F.lit(True)),
    ]
    named = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    tags = F.transform(named, lambda t: F.struct(F.lit(TAG).alias("kind"), t.alias("key")))
    return rows.select("seq", F.explode(F.concat(F.array_compact(F.array(*single)), tags)).alias("k")).select("k.*", "seq")


def counted(rows: DataFrame) -> DataFrame:
    """(kind, key, cnt, first_seq) of a table of rows."""
    return keys(rows).groupBy("kind", "key").agg(F.count("*").alias("cnt"), F.min("seq").alias("first_seq"))


def updated(kept: DataFrame, before: DataFrame, after: DataFrame, library: DataFrame) -> DataFrame:
    """The counts of ``library``, from those kept of an older version and the rows between, as they were and as they are."""
    parts = [
        kept.select("kind", "key", "cnt", F.col("first_seq").alias("kept")),
        counted(before).select("kind", "key", (-F.col("cnt")).alias("cnt"), F.col("first_seq").alias("gone")),
        counted(after).select("kind", "key", "cnt", F.col("first_seq").alias("come")),
    ]
    every = parts[0].unionByName(parts[1], True).unionByName(parts[2], True).groupBy("kind", "key")
    summed = every.agg(F.sum("cnt").alias("cnt"), *(F.min(c).alias(c) for c in ("kept", "gone", "come")))
    lost = (F.col("gone") <= F.col("kept")) & (F.col("come").isNull() | (F.col("come") > F.col("kept")))
    told = written_once(summed.where(F.col("cnt") > 0).withColumn("lost", F.coalesce(lost, F.lit(False))))
    missing = told.where("lost").select("kind", "key")
    n = missing.limit(BROADCAST_KEYS + 1).count()
    fine = told.where(~F.col("lost")).select("kind", "key", "cnt", F.least("kept", "come").alias("first_seq"))
    if not n:
        return fine
    asked = F.broadcast(missing) if n <= BROADCAST_KEYS else missing
    first = keys(library).join(asked, ["kind", "key"], "left_semi").groupBy("kind", "key").agg(F.min("seq").alias("first_seq"))
    found = told.where("lost").select("kind", "key", "cnt").join(first, ["kind", "key"])
    return fine.unionByName(found.select("kind", "key", "cnt", "first_seq"))
