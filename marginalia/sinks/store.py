"""The library on disk: one folder per version, and a log of the versions that are complete."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LIBRARY, SOURCES

# Positions of one source that are written by one task.
STRETCH = 100_000

COMMIT = "number long, folder string, batch long"


def _commits(spark: SparkSession, root: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/commits")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(COMMIT).json(f"{root}/commits") if files.exists(path) else None


def latest(spark: SparkSession, root: str):
    """The last complete version: number, folder, and the stream batch it came from."""
    commits = _commits(spark, root)
    return commits and commits.orderBy(F.desc("number")).first()


def save(library: DataFrame, sources: DataFrame, root: str, batch: int | None = None) -> None:
    """Write both tables as a new version, then publish it.

    Rows are kept together by source in stretches of positions: a folder filter skips most row
    groups, and a source of any size is spread over as many tasks as it needs. Hashing does that
    without the extra run over the data that ranges take for sampling. A version that fails
    half-way is never published.
    """
    spark = library.sparkSession
    last = latest(spark, root)
    folder = f"{root}/versions/{uuid.uuid4().hex}"
    stretch = F.floor(F.col("seq") / STRETCH)
    placed = library.select(*LIBRARY.names).repartition("source_file_id", stretch)
    placed.sortWithinPartitions("source_file_id", "seq").write.parquet(f"{folder}/library")
    sources.select(*SOURCES.names).write.parquet(f"{folder}/sources")
    row = (last["number"] + 1 if last else 0, folder, batch)
    spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("append").json(f"{root}/commits")


def load(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Library and sources of the last complete version; empty tables where there is none."""
    last = latest(spark, root)
    if last is None:
        return spark.createDataFrame([], LIBRARY), spark.createDataFrame([], SOURCES)
    folder = last["folder"]
    return (
        spark.read.schema(LIBRARY).parquet(f"{folder}/library"),
        spark.read.schema(SOURCES).parquet(f"{folder}/sources"),
    )
