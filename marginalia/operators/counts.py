"""Counts over the library: domains, folders, tags, trash."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values, web
from .search import active


def domain_counts(library: DataFrame) -> DataFrame:
    """(domain, cnt, first_seq) of every host; rows without one are skipped."""
    return (
        library.select(web.domain(F.col("url")).alias("domain"), "seq")
        .where(F.col("domain") != "")
        .groupBy("domain")
        .agg(F.count("*").alias("cnt"), F.min("seq").alias("first_seq"))
    )


def top_domains(library: DataFrame, limit: int = 15) -> DataFrame:
    """Most frequent hosts; ties go to the one seen first."""
    return domain_counts(library).orderBy(F.desc("cnt"), "first_seq").limit(limit)


def domain_share(library: DataFrame, limit: int = 15) -> DataFrame:
    """Top hosts with their whole percentage of the largest."""
    largest = F.max("cnt").over(W.partitionBy())
    return top_domains(library, limit).withColumn("share", values.share_of_max(F.col("cnt"), largest))


def trash_split(library: DataFrame) -> DataFrame:
    return library.agg(
        F.count_if(~values.trashed()).alias("active"), F.count_if(values.trashed()).alias("trashed")
    )


def folder_counts(library: DataFrame, sources: DataFrame) -> DataFrame:
    """Live rows per source, sources without rows included."""
    counts = active(library).groupBy("source_file_id").agg(F.count("*").alias("cnt"))
    return sources.join(counts, sources.id == counts.source_file_id, "left").select(
        sources.id, sources.name, F.coalesce("cnt", F.lit(0)).alias("cnt")
    )


def source_count(sources: DataFrame) -> DataFrame:
    return sources.agg(F.count("*").alias("sources"))


def tag_counts(library: DataFrame) -> DataFrame:
    """Trimmed tags over all rows, trashed ones too, with the place each was first seen."""
    return (
        library.select("seq", F.posexplode("tags").alias("pos", "tag"))
        .select(F.trim("tag").alias("tag"), values.first_seen("seq", "pos").alias("seen"))
        .where(F.col("tag") != "")
        .groupBy("tag")
        .agg(F.count("*").alias("cnt"), F.min("seen").alias("first_seen"))
    )


def folder_name(sources: DataFrame, source_id: str | None) -> DataFrame:
    """One row with the name of a folder; all folders and unknown ids have fixed names."""
    if source_id is None:
        return sources.sparkSession.range(1).select(F.lit("all").alias("name"))
    found = sources.where(F.col("id") == source_id).agg(F.max("name").alias("name"))
    return found.select(F.coalesce("name", F.lit("unknown")).alias("name"))
