"""Unified exports: one file that holds the rows of many sources."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import FILE, SOURCE_TYPES, UNIFIED, profile_or_default, type_from_name


def with_owner(rows: DataFrame, files: DataFrame, fields: dict) -> DataFrame:
    """Raw rows with ``owner``, the source they name, where the unified profile lets them."""
    named = {}
    for column in ("source_file_id", "source_file_name"):
        named[column] = fields[column][0].cast("string") if column in fields else F.lit(None).cast("string")
    profiles = files.select(F.col("file").alias(FILE), F.col("profile").alias("_profile"))
    return (
        rows.withColumn("_named", F.nullif(named["source_file_name"], F.lit("")))
        .withColumn("_named_id", named["source_file_id"])
        .join(F.broadcast(profiles), FILE)
        .withColumn("owner", F.when((F.col("_profile") == UNIFIED) & (F.col("_named_id") != ""), F.col("_named_id")))
        .withColumn("keep_meta", F.col("_profile") == UNIFIED)
        .drop("_named_id", "_profile")
    )


def owners(rows: DataFrame, files: DataFrame, manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, owner, name, type, profile, known) of every source named in the files' rows.

    A source already there keeps its name. Others take it from the manifest, else from their first
    named row, else from the file.
    """
    ordered = F.when(F.col("_named").isNotNull(), F.struct("_block", "_row"))
    named = (
        rows.where(F.col("owner").isNotNull())
        .groupBy(F.col(FILE).alias("file"), "owner")
        .agg(F.min_by("_named", ordered).alias("row_name"))
    )
    listed = manifest.groupBy("file", F.col("id").alias("owner")).agg(
        F.max_by("name", "entry").alias("listed_name"),
        F.max_by("type", "entry").alias("listed_type"),
        F.max_by("profile", "entry").alias("listed_profile"),
    )
    present = sources.select(F.col("id").alias("owner"), F.col("name").alias("known_name"))
    own = files.select(
        "file", "pos", F.col("name").alias("file_name"), F.col("type").alias("file_type"), F.col("profile").alias("file_profile")
    )
    name = F.coalesce("known_name", F.nullif("listed_name", F.lit("")), "row_name", "file_name")
    found = named.join(listed, ["file", "owner"], "left").join(present, "owner", "left").join(own, "file")
    return found.withColumn("name", name).select(
        "file",
        "pos",
        "owner",
        "name",
        F.coalesce(
            F.when(F.col("listed_type").isin(*SOURCE_TYPES), F.col("listed_type")),
            F.nullif(type_from_name(F.col("name")), F.lit("")),
            "file_type",
        ).alias("type"),
        profile_or_default(
            F.coalesce(F.nullif("listed_profile", F.lit("")), "file_profile"), F.col("file_profile")
        ).alias("profile"),
        F.col("known_name").isNotNull().alias("known"),
    )


def new_sources(found: DataFrame) -> DataFrame:
    """Sources to add; one named by several files belongs to the first of them."""
    return (
        found.where(~F.col("known"))
        .groupBy(F.col("owner").alias("id"))
        .agg(
            F.min("pos").alias("pos"),
            F.min_by("name", "pos").alias("name"),
            F.min_by("type", "pos").alias("type"),
            F.min_by("profile", "pos").alias("profile"),
        )
    )
