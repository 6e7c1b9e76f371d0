"""Changes to the library; each takes tables and returns the changed table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..schema import LIBRARY, SOURCES
from ..scratch import written_once

RECORD_COLUMNS = [f.name for f in LIBRARY.fields if f.name not in ("id", "seq", "is_favorite")]


def newest(incoming: DataFrame) -> DataFrame:
    """One row per id: the last record, where the id first appeared, and its last known star.

    ``max_by`` keeps one row per id in every task before anything is moved, so an id repeated any
    number of times costs no large group.
    """
    starred = F.when(F.col("is_favorite").isNotNull(), F.col("in_seq"))
    return incoming.groupBy("id").agg(
        F.max_by(F.struct(*RECORD_COLUMNS), "in_seq").alias("record"),
        F.max_by("is_favorite", starred).alias("star"),
        F.min("in_seq").alias("first_in"),
    )


def merge(library: DataFrame, incoming: DataFrame) -> DataFrame:
    """The library with ``incoming`` (library columns, ``in_seq`` for ``seq``) written over it by id.

    A known id keeps its position and, unless the new record says otherwise, its star. New ids
    follow in order of appearance. Both joins have the incoming rows on the side Spark may
    broadcast, so a small import does not repartition the library. The incoming rows are aggregated once.
    """
    new = written_once(newest(incoming))
    known = library.join(
        new.select(F.col("id"), F.col("record"), F.col("star"), F.col("first_in")), "id", "left"
    )
    hit = F.col("first_in").isNotNull()
    updated = known.select(
        "id",
        "seq",
        *[F.when(hit, F.col("record")[c]).otherwise(F.col(c)).alias(c) for c in RECORD_COLUMNS],
        F.when(hit, F.coalesce("star", "is_favorite")).otherwise(F.col("is_favorite")).alias("is_favorite"),
    )
    present = library.select("id").join(new.select("id"), "id", "left_semi")
    following = F.coalesce(library.agg(F.max("seq")).scalar(), F.lit(-1)) + 1
    added = new.join(present, "id", "left_anti").select(
        "id",
        (following + F.col("first_in")).alias("seq"),
        *[F.col("record")[c].alias(c) for c in RECORD_COLUMNS],
        F.col("star").alias("is_favorite"),
    )
    return updated.unionByName(added)


def displaced(library: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: how many trashed records an import brings back or replaces."""
    gone = library.where(values.trashed()).select("id")
    return gone.join(incoming.select("id"), "id", "left_semi").agg(F.count("*").alias("displaced"))


def _with_hit(library: DataFrame, ids) -> tuple[DataFrame, Column]:
    """The library and a column telling the rows named by ``ids``, a DataFrame or a list; null names no row."""
    if not isinstance(ids, DataFrame):
        ids = library.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    marks = ids.select("id").where(F.col("id").isNotNull()).distinct().withColumn("hit", F.lit(True))
    return library.join(marks, "id", "left"), F.coalesce("hit", F.lit(False))


def _set(library: DataFrame, ids, column: str, change) -> DataFrame:
    rows, hit = _with_hit(library, ids)
    return rows.withColumn(column, change(hit)).select(*library.columns)


def trash_rows(library: DataFrame, ids, at: str) -> DataFrame:
    """Stamp live rows as deleted; rows already in the trash keep their stamp."""
    return _set(
        library, ids, "deleted_at", lambda hit: F.when(hit & ~values.trashed(), at).otherwise(F.col("deleted_at"))
    )


def restore_rows(library: DataFrame, ids) -> DataFrame:
    return _set(library, ids, "deleted_at", lambda hit: F.when(~(hit & values.trashed()), F.col("deleted_at")))


def purge_rows(library: DataFrame, ids) -> DataFrame:
    rows, hit = _with_hit(library, ids)
    return rows.where(~hit).select(*library.columns)


def empty_trash(library: DataFrame) -> DataFrame:
    return library.where(~values.trashed())


def set_favorite(library: DataFrame, ids, flag: bool) -> DataFrame:
    return _set(library, ids, "is_favorite", lambda hit: F.when(hit, F.lit(flag)).otherwise(F.col("is_favorite")))


def toggle_favorite(library: DataFrame, record_id: str) -> DataFrame:
    """Flip the star of one live row."""
    hit = (F.col("id") == record_id) & ~values.trashed()
    return library.withColumn("is_favorite", F.when(hit, ~values.favorite()).otherwise(F.col("is_favorite")))


def delete_source(library: DataFrame, sources: DataFrame, source_id: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a source and all its rows, trashed ones included."""
    keep = F.coalesce(F.col("source_file_id") != source_id, F.lit(True))
    return library.where(keep), sources.where(F.col("id") != source_id)


def replace_source(library: DataFrame, sources: DataFrame, source_id: str, incoming: DataFrame):
    """Both tables with a source's rows given up for ``incoming``; an empty import changes nothing."""
    if incoming.isEmpty():
        raise ValueError("the new file holds no valid record; the old source is kept")
    rest, other_sources = delete_source(library, sources, source_id)
    return merge(rest, incoming), other_sources


def clear(library: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark = library.sparkSession
    return spark.createDataFrame([], LIBRARY), spark.createDataFrame([], SOURCES)
