"""CSV files with any header and dialect."""

import csv
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import BLOCK, FILE, PARSE_ERROR, ROW
from .files import RawRows, Scan, bookkeeping, layout_schema, slices

# Characters tried as delimiter, the one used when none occurs, and the line ends
# that are recorded.
DELIMITERS = (",", "\t", "|", ";", "\x1e", "\x1f")
DEFAULT_DELIMITER = ","
LINE_ENDS = ("\r\n", "\n", "\r")
DEFAULT_LINE_END = "\r\n"


# How a file is read: by lines, by records that may hold line ends, or whole by one task.
LINES, RECORDS, WHOLE = "lines", "records", "whole"

# One character that a file may be cut at: a tab, or anything printable but quotes, DEL and the byte order mark.
CUTTING = re.compile('\t|[^\\x00-\\x1f\\x7f"\ufeff]')


def usable_delimiter(value) -> bool:
    return isinstance(value, str) and CUTTING.fullmatch(value) is not None


def writer_dialect(delimiter, linebreak) -> tuple[str, str]:
    """The dialect to write with; what was not recorded gets the default."""
    return (
        delimiter if usable_delimiter(delimiter) else DEFAULT_DELIMITER,
        linebreak if linebreak in LINE_ENDS else DEFAULT_LINE_END,
    )


def sniff(spark: SparkSession, paths: list[str]):
    """(file, header, spans_lines): first written line, and whether a quoted value may hold a line end.

    Every line with an odd number of quotes may be part of such a value. Files without any are read by lines; the others
    by records, see ``records``.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select("value", *bookkeeping())
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    first = F.when((F.col(BLOCK) == 0) & (F.trim(F.regexp_replace("value", "[\r﻿]", "")) != ""), F.col(ROW))
    return (
        lines.select(FILE, F.when(first.isNotNull(), F.col("value")).alias("value"), first.alias("at"), (quotes % 2 == 1).alias("open"))
        .groupBy(FILE)
        .agg(F.min_by("value", "at").alias("header"), F.bool_or("open").alias("spans_lines"))
    )


def header_layout(line: str) -> tuple[str, str, list[str]]:
    """(delimiter, line end, column names) of a first line."""
    line = line.removeprefix("﻿")
    if line.endswith("\r"):
        line_end, line = "\r\n", line[:-1]
    elif "\r" in line:
        line_end, line = "\r", line.split("\r", 1)[0]
    else:
        line_end = "\n"
    outside = "".join(line.split('"')[::2])
    best = max(DELIMITERS, key=outside.count)
    delimiter = best if outside.count(best) else DEFAULT_DELIMITER
    return delimiter, line_end, next(csv.reader([line], delimiter=delimiter))


def ends_inside(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a line ends inside a quoted value, given whether it starts in one.

    A quote opens a value only where the value begins; what stands between a closing quote and the next delimiter belongs to the value.
    """
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            inside = True
            at += 1
            continue
        at = line.find(delimiter, at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    # One byte that is no UTF-8 must not end the task that reads it.
    return spark.read.option("lineSep", "\n").text(paths).select(F.make_valid_utf8("value").alias("value"), *bookkeeping())


def _turns(delimiter: str):
    """Of every split: whether it ends inside a value when it starts outside, and when it starts inside."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ends = None, [False, True]

        def told():
            return pa.RecordBatch.from_pydict({FILE: [split[0]], BLOCK: [split[1]], "outside": [ends[0]], "inside": [ends[1]]})

        for part in slices(batches, ("value", FILE, BLOCK)):
            for line, *of in part:
                if of != split:
                    if split:
                        yield told()
                    split, ends = of, [False, True]
                if '"' in line:
                    line = line.removesuffix("\r")
                    ends = [ends_inside(line, e, delimiter) for e in ends]
        if split:
            yield told()

    return task


def starts(spark: SparkSession, paths: list[str], delimiter: str) -> DataFrame:
    """(file, block, open): whether each split starts inside a quoted value. One small row for each split.

    A split turns the state it starts with into the state it ends with: it keeps it, turns it round, or ends the same way whatever it was.
    The state before a split follows from the last split of the third kind and the number of those that turned it round since.
    """
    found = _lines(spark, paths).mapInArrow(_turns(delimiter), f"{FILE} string, {BLOCK} long, outside boolean, inside boolean")
    earlier = W.partitionBy(FILE).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    round_ = F.coalesce(F.count_if(F.col("outside") & ~F.col("inside")).over(earlier), F.lit(0))
    turned = found.withColumn("round", round_)
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("state"), F.col("round").alias("at")))
    known = turned.withColumn("fixed", F.last(fixed, ignorenulls=True).over(earlier))
    odd = (F.col("round") - F.coalesce("fixed.at", F.lit(0))) % 2 == 1
    return known.select(FILE, BLOCK, (F.coalesce("fixed.state", F.lit(False)) != odd).alias("open"))


def _cut(delimiter: str):
    """Lines of splits as records. What a split does not hold whole is a piece: the first of a record ``begins`` it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inside, begins, held, row = None, False, False, [], 0
        names = (FILE, BLOCK, ROW, "whole", "begins", "text")
        out: list[tuple] = []

        def closed(ended: bool) -> None:
            nonlocal held, row, begins
            text, whole = "\n".join(held), ended and begins
            if ended:
                text = text.removesuffix("\r")
            # Blank lines are no records; a piece is one whatever it holds.
            if not whole or text.strip():
                out.append((*split, row if begins else -1, whole, begins, text))
                row += begins
            held, begins = [], True

        def left() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

        for part in slices(batches, ("value", FILE, BLOCK, "open")):
            for line, file, block, opened in part:
                if (file, block) != split:
                    if held:
                        closed(False)
                    split, inside, begins, held, row = (file, block), opened, not opened, [], 0
                held.append(line)
                if '"' in line:
                    inside = ends_inside(line.removesuffix("\r"), inside, delimiter)
                if not inside:
                    closed(True)
            yield left()
        if held:
            closed(False)
            yield left()

    return task


def records(spark: SparkSession, paths: list[str], delimiter: str) -> DataFrame:
    """The records of files whose quoted values may hold line ends, read in splits: text, _file, _block and _row.

    Rows are numbered within the split that a record begins in, the files' first records (their headers) are left out. A record over several
    splits is put together from one piece of each. A quote that is never closed makes the rest of its file one record.
    """
    opened = F.broadcast(starts(spark, paths, delimiter))  # one row for each split
    lines = _lines(spark, paths).join(opened, [FILE, BLOCK])
    found = lines.mapInArrow(_cut(delimiter), f"{FILE} string, {BLOCK} long, {ROW} long, whole boolean, begins boolean, text string")
    order = F.struct(BLOCK, ROW)
    pieces = found.where(~F.col("whole")).withColumn("record", F.count_if("begins").over(W.partitionBy(FILE).orderBy(BLOCK, F.col("begins"))))
    joined = pieces.groupBy(FILE, "record").agg(
        F.min_by(F.struct(BLOCK, ROW), F.struct(~F.col("begins"), order)).alias("place"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(BLOCK, "begins", "text"))), lambda p: p["text"]), "\n").alias("text"),
    )
    stitched = joined.select(FILE, "place.*", "text").select(FILE, BLOCK, ROW, "text")
    every = found.where("whole").select(FILE, BLOCK, ROW, "text").unionByName(stitched)
    return every.where((F.col(BLOCK) > 0) | (F.col(ROW) > 0))


def scan(spark: SparkSession, files: list[dict]) -> Scan:
    """One reader per distinct header and dialect; every value is text."""
    headers = {r[FILE]: r for r in sniff(spark, [f["path"] for f in files]).collect()}
    groups, layouts, failed = defaultdict(list), [], {}
    for f in files:
        found = headers.get(f["file"])
        if found is None or found["header"] is None:
            failed[f["file"]] = "empty"
            continue
        if re.search("[\x00\ufffd]", found["header"]):
            failed[f["file"]] = "not text in UTF-8"
            continue
        delimiter, line_end, columns = header_layout(found["header"])
        # Line ends of a kind that splits cannot be found by leave a file to one task.
        reading = WHOLE if line_end == "\r" else RECORDS if found["spans_lines"] and len(delimiter) == 1 else LINES
        groups[(delimiter, tuple(columns), reading)].append(f["path"])
        dialect = (delimiter if usable_delimiter(delimiter) else None, line_end)
        layouts.append((f["file"], list(columns), dialect, None))
    parts = []
    for (delimiter, columns, reading), paths in groups.items():
        names = [f"c{i}" for i in range(len(columns))]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, PARSE_ERROR)])
        options = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": reading != LINES, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": PARSE_ERROR}
        # A value is read along, or else a file none of whose columns is wanted would be read for its errors alone.
        wrong = F.col(PARSE_ERROR).isNotNull() & (F.length(F.coalesce(names[0], F.lit(""))) >= 0)
        if reading == RECORDS:
            given = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}
            ddl = ", ".join(f"`{f.name}` string" for f in schema.fields)
            parsed = records(spark, paths, delimiter).select(F.from_csv("text", ddl, given).alias("r"), FILE, BLOCK, ROW)
            rows = parsed.select("r.*", FILE, BLOCK, ROW).select(*names, wrong.alias(PARSE_ERROR), FILE, BLOCK, ROW)
        else:
            read = spark.read.schema(schema).options(header=True, **options).csv(paths)
            rows = read.select(*names, wrong.alias(PARSE_ERROR), *bookkeeping())
        # An empty cell is an empty text, not a missing value.
        fields = {c.lower(): (F.coalesce(n, F.lit("")), T.StringType()) for c, n in zip(columns, names)}
        parts.append(RawRows(rows, fields))
    table = spark.createDataFrame(layouts, layout_schema())
    return Scan(parts, table.select("file", F.col("csv_columns").alias("headers")), table, None, failed)
