"""The given tables, read as a library of articles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import web


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an article: the first line is its title, the rest its preview."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    title = F.substring_index("text", "\n", 1)
    return documents.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").alias("seq"),
        title.alias("title"),
        F.substr("text", F.length(title) + 2).alias("article_preview"),
        F.col("text").alias("content"),
        F.col("source").alias("source_file_id"),
        F.concat("source", F.lit(".csv")).alias("source_file_name"),
        F.col("lang").alias("detected_language"),
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles with addresses from ``pages`` and flags from ``labels``."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.col("url").alias("page_url"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), "quality", "toxic")
    rows = texts(spark, sf_dir).join(labels, "seq", "left").join(pages, "seq", "left")
    good, bad = F.coalesce("quality", F.lit(0)) == 1, F.coalesce("toxic", F.lit(0)) == 1
    day = F.lpad((F.col("seq") % 28 + 1).cast("string"), 2, "0")
    return rows.select(
        "id",
        "seq",
        "title",
        F.coalesce("page_url", F.lit("#")).alias("url"),
        "article_preview",
        "content",
        "source_file_id",
        "source_file_name",
        "detected_language",
        F.array_compact(F.array(F.when(good, "quality"), F.when(bad, " toxic"), F.col("detected_language"))).alias(
            "tags"
        ),
        web.reader_url(F.lit("instapaper"), F.col("id")).alias("instapaper_url"),
        F.lit("instapaper").alias("provider"),
        good.alias("is_favorite"),
        F.when(bad, F.concat(F.lit("2024-01-"), day, F.lit("T00:00:00.000Z"))).alias("deleted_at"),
    )


def page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("id"), F.col("page_id").alias("seq"), "url"
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per document source, and one that owns no article."""
    owned = (
        table(spark, sf_dir, "documents")
        .groupBy(F.col("source").alias("id"))
        .agg(F.min("doc_id").alias("pos"))
        .withColumn("name", F.concat("id", F.lit(".csv")))
    )
    unused = table(spark, sf_dir, "region").agg(
        F.lit("unused").alias("id"), F.count("*").alias("pos"), F.lit("unused.csv").alias("name")
    )
    return owned.unionByName(unused)
