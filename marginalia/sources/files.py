"""What every scan returns, and the list of files of an import."""

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import SOURCE_TYPES
from ..schema import CSV_DIALECT, SQLITE_LAYOUT

FILES = "file string, pos long, name string, type string, profile string, id string"


@dataclass
class RawRows:
    """Rows as read: bookkeeping columns and the fields known under their lower-cased names."""

    rows: DataFrame
    fields: dict


@dataclass
class Scan:
    """All a format's reader has to tell about its files."""

    parts: list[RawRows]
    # (file, headers): column names or keys of each file.
    headers: DataFrame
    # (file, csv_columns, csv_dialect, sqlite_layout), where the format records them.
    layouts: DataFrame | None = None
    # (file, entry, id, name, type, profile) of documents with their own list of sources.
    manifest: DataFrame | None = None
    # Files that could not be read at all, with a reason.
    failed: dict[str, str] = field(default_factory=dict)


# Bytes of Arrow columns that are Python objects at a time.
SLICE = 2_000_000


def slices(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[Iterator[tuple]]:
    """The rows of batches as tuples, a bounded number of bytes at a time: a batch may hold thousands of long texts, and they cost several
    times their bytes as Python objects."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield zip(*(part.column(n).to_pylist() for n in names), strict=True)


# What a path stands for more than itself by.
_GLOB = re.compile(r"[][{}*?\\]")


def _statuses(spark: SparkSession, path: str) -> list:
    """The files a path or pattern stands for; of a folder all that are not hidden, in folders of a partitioned table too."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    todo, found = list(files.globStatus(jvm_path) or ()), []
    while todo:
        status = todo.pop()
        if not status.isDirectory():
            found.append(status)
            continue
        for inner in files.listStatus(status.getPath()):
            name = inner.getPath().getName()
            if not name.startswith(("_", ".")) and (not inner.isDirectory() or "=" in name):
                todo.append(inner)
    return found


def listed(
    spark: SparkSession, paths: list[str], profile: str, source_id: Callable[[str], str] | None = None
) -> list[dict]:
    """One dict per file, in the order the paths were given; files in a folder go by path.

    Files without a byte are listed too, though no reader sees them. Only names and sizes are read. The list
    has one short entry per file, which Spark's own file index keeps on the driver as well.
    """
    make_id = source_id or (lambda name: f"file_{uuid.uuid4()}")
    found = {}
    for path in paths:
        statuses = _statuses(spark, path)
        if not statuses:
            raise FileNotFoundError(path)
        # Written as the readers write it.
        written = {spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath().toString()).toUri().toString(): s for s in statuses}
        found |= dict(sorted(written.items()))
    files = []
    for pos, (file, status) in enumerate(found.items()):
        name = status.getPath().getName()
        kind = name.rpartition(".")[2].lower()
        files.append(
            {
                "file": file,
                "path": _GLOB.sub(r"\\\g<0>", status.getPath().toString()),
                "size": status.getLen(),
                "pos": pos,
                "name": name,
                "type": kind if kind in SOURCE_TYPES else "",
                "profile": profile,
                "id": make_id(name),
            }
        )
    return files


def layout_schema() -> str:
    return (
        f"file string, csv_columns array<string>, csv_dialect {CSV_DIALECT.simpleString()}, "
        f"sqlite_layout {SQLITE_LAYOUT.simpleString()}"
    )


def bookkeeping(block=None):
    """File, split and row number, to be selected directly over a scan."""
    from ..operators.ingest import BLOCK, FILE, ROW

    return [
        F.col("_metadata.file_path").alias(FILE),
        (F.col("_metadata.file_block_start") if block is None else block).alias(BLOCK),
        F.monotonically_increasing_id().alias(ROW),
    ]
