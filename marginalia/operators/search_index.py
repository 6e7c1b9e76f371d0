"""Search that reads only the files that can hold an answer.

For every file of a stored library the index knows the trigrams (three characters in a row, in lower case) of its titles, previews,
addresses and tags. A search word of three characters or more can only be in files that have all its trigrams. These files are read
and searched as ever, so rows and scores are those of ``search.view`` over the whole library.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LIBRARY
from . import search

# Length of the indexed pieces of text.
PIECE = 3

# Parts of the index; a search reads those of its trigrams.
PARTS = 64

# Trigrams a task holds before it tells them.
HELD = 500_000


def _part(trigram):
    return F.pmod(F.xxhash64(trigram), F.lit(PARTS)).cast("int")


def pieces(text: str) -> list[str]:
    return sorted({text[k : k + PIECE] for k in range(len(text) - PIECE + 1)})


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, trigram) of the texts of files, told when there are ``HELD`` and at the end."""
    held: dict[str, set[str]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for file, trigrams in held.items():
            yield pa.RecordBatch.from_pydict({"file": [file] * len(trigrams), "trigram": list(trigrams)})
        held.clear()

    for batch in batches:
        for file, texts in zip(batch.column("file").to_pylist(), batch.column("texts").to_pylist(), strict=True):
            mine = held.setdefault(file, set())
            for text in texts:
                mine.update([text[k : k + PIECE] for k in range(len(text) - PIECE + 1)])
        if sum(map(len, held.values())) > HELD:
            yield from told()
    yield from told()


def build(library: DataFrame, path: str) -> None:
    """Writes the index of the files of ``library``, a table as it was read from them.

    Trigrams are made distinct within each task's files before anything is moved.
    """
    fields = F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "article_preview", "url")])
    texts = F.concat(fields, F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.coalesce(t, F.lit("")))))
    rows = library.select(F.col("_metadata.file_path").alias("file"), texts.alias("texts"))
    found = rows.mapInArrow(_distinct, "file string, trigram string")
    dealt = found.distinct().withColumn("part", _part(F.col("trigram"))).repartition("part")
    dealt.sortWithinPartitions("part", "trigram", "file").write.partitionBy("part").parquet(path)


def candidates(spark: SparkSession, path: str, query: str | None) -> list[str] | None:
    """The files that have all trigrams of all words of a query; None if no word is long enough to tell."""
    wanted = sorted({p for t in search.search_terms(query) if not t["favorite"] for p in pieces(t["text"])})
    if not wanted:
        return None
    asked = spark.createDataFrame([(p,) for p in wanted], "trigram string")
    parts = [r[0] for r in asked.select(_part(F.col("trigram"))).distinct().collect()]
    index = spark.read.schema("trigram string, file string, part int").parquet(path)
    held = index.where(F.col("part").isin(parts) & F.col("trigram").isin(wanted))
    whole = held.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
    # Names of files, as the reader keeps them on the driver as well.
    return [r["file"] for r in whole.select("file").collect()]


def view(spark: SparkSession, path: str, library: DataFrame, query: str | None, **arguments) -> DataFrame:
    """``search.view`` of the stored ``library`` that the index at ``path`` was built from."""
    files = candidates(spark, path, query)
    if files is None:
        return search.view(library, query=query, **arguments)
    jvm = spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in files]
    held = spark.read.schema(LIBRARY).parquet(*paths) if paths else spark.createDataFrame([], LIBRARY)
    return search.view(held, query=query, **arguments)
