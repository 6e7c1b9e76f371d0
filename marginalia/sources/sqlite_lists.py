"""SQLite files: the first table of each."""

import sqlite3

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import ALIASES, BLOCK, FILE, PARSE_ERROR, ROW, entries_of, lower_keys
from ..scratch import written_once
from .files import RawRows, Scan

BATCH = 5000


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _opened(content: bytes):
    """A database and its first table, if it has one; neither where it cannot be read to its end."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(content)
        found = db.execute("SELECT name FROM sqlite_master WHERE type = 'table' LIMIT 1").fetchone()
        if found and db.execute("PRAGMA quick_check").fetchone()[0] != "ok":
            raise sqlite3.DatabaseError("damaged pages")
        return db, found and found[0]
    except sqlite3.Error:
        db.close()
        return None, None


def _text(name: str, value):
    """A cell as text; a numeric zero counts as missing, except in a star column, where it says no."""
    if value is None or isinstance(value, bytes):
        return None
    if isinstance(value, (int, float)):
        if name.lower() in ALIASES["favorite"]:
            return "true" if value else "false"
        if value == 0:
            return ""
        if isinstance(value, float) and value.is_integer():
            return str(int(value))
    return str(value)


def _read_rows(batches):
    for batch in batches:
        for file, content in zip(batch["path"], batch["content"]):
            db, table = _opened(content)
            if table is not None:
                cursor = db.execute(f"SELECT * FROM {_quoted(table)}")
                names = [c[0] for c in cursor.description]
                row = 0
                while rows := cursor.fetchmany(BATCH):
                    entries = [[(n, _text(n, v)) for n, v in zip(names, values)] for values in rows]
                    yield pd.DataFrame({"file": file, "row": range(row, row + len(rows)), "entries": entries})
                    row += len(rows)
            if db:
                db.close()


def _read_layouts(batches):
    for batch in batches:
        for file, content in zip(batch["path"], batch["content"]):
            db, table = _opened(content)
            columns = [r[1] for r in db.execute(f"PRAGMA table_info({_quoted(table)})")] if table else []
            yield pd.DataFrame({"file": [file], "table": [table], "columns": [columns], "broken": [db is None]})
            if db:
                db.close()


def scan(spark: SparkSession, files: list[dict]) -> Scan:
    """Rows as maps from column name to text; each database is read inside a task."""
    paths = [f["path"] for f in files]
    binary = spark.read.format("binaryFile").load(paths)
    content = binary.select(F.col("_metadata.file_path").alias("path"), "content")
    layouts = written_once(content.mapInPandas(_read_layouts, "file string, table string, columns array<string>, broken boolean"))
    failed = {r["file"]: "malformed" for r in layouts.where("broken").select("file").collect()}
    rows = content.mapInPandas(_read_rows, "file string, row long, entries array<struct<key:string,value:string>>")
    rows = rows.select(
        F.col("file").alias(FILE),
        F.lit(0).cast("bigint").alias(BLOCK),
        F.col("row").alias(ROW),
        F.lit(False).alias(PARSE_ERROR),
        lower_keys(F.col("entries")).alias("entries"),
    )
    recorded = layouts.where(~F.col("broken")).select(
        "file",
        F.lit(None).cast("array<string>").alias("csv_columns"),
        F.lit(None).cast("struct<delimiter:string,linebreak:string>").alias("csv_dialect"),
        F.when(F.col("table").isNotNull(), F.struct("table", "columns")).alias("sqlite_layout"),
    )
    # Databases are not checked against a header.
    headers = spark.createDataFrame([], "file string, headers array<string>")
    return Scan([RawRows(rows, entries_of("entries"))], headers, recorded, None, failed)
