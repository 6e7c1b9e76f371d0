"""Lists of records in JSON documents, read in splits.

A document is cut behind closing braces, which the text reader finds from anywhere. Whether a split starts inside a string, and how
deep, follows from one small row per split; then every split finds its own records. Brackets are counted, and what stands outside of
the records of a list is put together (the frame) and has to be JSON by itself.
"""

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ingest import BLOCK, FILE, ROW
from ..scratch import written_once
from .files import bookkeeping, slices

LIST, SOURCES, OTHER = "bookmarks", "sources", ""

# What a split tells: a record, a part of one, a list or another value begins or ends, text outside of all lists, a list of more than
# records, no JSON.
RECORD, PART, REGION, FRAME, MIXED, BROKEN = range(6)

# What becomes of a document: its records are read in splits, it is read whole, or no reader would take it.
SPLIT, WHOLE, BROKEN_FILE = "split", "whole", "broken"

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+("?)'
_STRINGS = re.compile(_STRING, re.DOTALL)
_CLOSING = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
_TOKEN = re.compile(_STRING + r'|[{}\[\]]|[^"{}\[\]]+', re.DOTALL)
_NEXT = re.compile(r"[ \t\r\n]*,[ \t\r\n]*(?=\{)")
_BLANK = " \t\r\n"


def after(text: str, inside: bool) -> tuple[bool, int]:
    """Whether a text ends inside a string, given whether it starts in one, and by how much the depth changes."""
    if inside:
        closing = _CLOSING.match(text)
        if not closing:
            return True, 0
        text = text[closing.end() :]
    opened = 0
    if '"' in text:
        # A string that is closed leaves one quote behind.
        text, opened = _STRINGS.subn(r"\1", text)
    change = text.count("{") + text.count("[") - text.count("}") - text.count("]")
    return opened > text.count('"'), change


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    read = spark.read.option("lineSep", "}").text(paths)
    size = F.col("_metadata.file_size").alias("size")
    return read.select(F.make_valid_utf8("value").alias("value"), F.octet_length("value").alias("bytes"), size, *bookkeeping())


_TURNS = (
    f"{FILE} string, {BLOCK} long, size long, root string, bytes long, outside boolean, outside_change long, "
    "inside boolean, inside_change long"
)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every split: how it ends, and by how much the depth changes, when it starts outside of strings and when it starts inside."""
    names = [c.split()[0] for c in _TURNS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, _TURNS.split(", "), strict=True)])

    def row(values: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, values, strict=True))], schema)

    split = told = None
    for part in slices(batches, ("value", "bytes", "size", FILE, BLOCK)):
        for text, length, size, *of in part:
            if of != split:
                if told:
                    yield row(told)
                split = of
                first = re.match("﻿?[ \t\r\n]*([\\[{])(?!\x00)", text + "}") if of[1] == 0 else None
                told = [*of, size, first and first[1], 0, False, 0, True, 0]
            told[4] += length + 1
            for at in (5, 7):
                told[at], change = after(text + "}", told[at])
                told[at + 1] += change
    if told:
        yield row(told)


def starts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, root, open, depth, braced, closed): the state each split starts with, whether its file ends with a brace and with
    all it opened closed.

    A split keeps the state it starts with, turns it round, or ends the same way whatever it was; the state before a split follows from
    the last split of the third kind and the number of those that turned it round since. The depth is a sum over the splits before.
    """
    found = _lines(spark, paths).mapInArrow(_turns, _TURNS)
    earlier = W.partitionBy(FILE).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(FILE)
    turned = found.withColumn("round", F.coalesce(F.count_if(F.col("outside") & ~F.col("inside")).over(earlier), F.lit(0)))
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("state"), F.col("round").alias("at")))
    known = turned.withColumn("fixed", F.last(fixed, ignorenulls=True).over(earlier))
    odd = (F.col("round") - F.coalesce("fixed.at", F.lit(0))) % 2 == 1
    known = known.withColumn("open", F.coalesce("fixed.state", F.lit(False)) != odd)
    change = F.when(F.col("open"), F.col("inside_change")).otherwise(F.col("outside_change"))
    ends_open = F.when(F.col("open"), F.col("inside")).otherwise(F.col("outside"))
    # The reader tells nothing of a brace behind the last text, but the size does; a byte order mark is not counted.
    braced = (F.first("size").over(every) - F.sum("bytes").over(every)).isin(0, 3)
    placed = known.select(
        FILE,
        BLOCK,
        F.min("root").over(every).alias("root"),
        "open",
        F.coalesce(F.sum(change).over(earlier), F.lit(0)).alias("depth"),
        F.sum(change).over(every).alias("total"),
        F.max_by(ends_open, BLOCK).over(every).alias("ends_open"),
        braced.alias("braced"),
    )
    closed = ~F.col("ends_open") & (F.col("total") + F.when(F.col("braced"), 0).otherwise(1) == 0)
    return placed.select(FILE, BLOCK, "root", "open", "depth", "braced", closed.alias("closed"))


class _Split:
    """One split of a document, given the state it starts with; ``rows`` is what it found."""

    def __init__(self, file: str, block: int, root: str, inside: bool, depth: int):
        self.of = (file, block)
        self.inside, self.depth = inside, depth
        # Depth in a list of records, and the part of a document the splits before left off in, where that is not known here.
        self.inner = 1 if root == "[" else 2
        self.region = LIST if root == "[" else None
        self.held = [] if depth > self.inner else None
        self.begins = False
        self.row, self.changes = 0, 0
        self.opened = block > 0 or depth > 0
        self.key = ""
        self.seen, self.want = "", ","
        self.frame: list[str] = []
        self.broken = False
        self.rows: list[tuple] = []

    def tell(self, kind: int, row: int = -1, text: str | None = None) -> None:
        self.rows.append((*self.of, row, kind, self.region, self.begins, text))

    def _break(self) -> None:
        """No more is kept of what is no JSON, or of one document after the other."""
        if not self.broken:
            self.tell(BROKEN)
        self.broken, self.frame = True, []

    def _framed(self, text: str) -> None:
        if not self.broken:
            self.frame.append(text)

    def _listing(self) -> bool:
        return self.depth == self.inner and self.region != OTHER

    def _change(self, region: str) -> None:
        self.region, self.row = region, 0
        if not self.broken:
            self.tell(REGION, self.changes)
            self.changes += 1

    def _follow(self, text: str) -> None:
        self.held.append(text)
        self.inside, change = after(text, self.inside)
        self.depth += change
        if self.depth <= self.inner and not self.inside:
            if self.depth < self.inner:
                self._break()
            self._close(RECORD if self.begins else PART)

    def _begin(self, text: str) -> None:
        self.held, self.begins = [], True
        self._follow(text)

    def _close(self, kind: int) -> None:
        self.tell(kind, self.row if self.begins else -1, "".join(self.held))
        self.row += self.begins
        self.held, self.begins = None, False
        self.seen, self.want = "", ","

    def add(self, text: str) -> None:
        if self.held is not None:
            self._follow(text)
            return
        at = 0
        if self.inside:
            closing = _CLOSING.match(text)
            at = closing.end() if closing else len(text)
            self.inside = not closing
            self._aside(text[:at])
        elif self._listing():
            following = _NEXT.match(text)
            if following:
                self._begin(text[following.end() :])
                return
        for token in _TOKEN.finditer(text, at):
            if self._token(token[0], token.start(), text, token[1]):
                return

    def _aside(self, text: str) -> None:
        """Text outside of all records: of the frame, or something else in a list."""
        if self.depth < self.inner:
            self._framed(text)
            if self.depth == 0 and text.strip(_BLANK + "﻿" * (not self.opened)):
                self._break()
        elif self._listing():
            self.seen += text.strip(_BLANK)

    def _token(self, token: str, at: int, text: str, closing: str | None) -> bool:
        """Takes one token outside of records; whether a record begins with it."""
        if token in "{[":
            if self._listing():
                if token == "{" and self.seen == self.want:
                    self._begin(text[at:])
                    return True
                self.tell(MIXED)
            if self.depth < self.inner:
                self._framed(token)
            if self.depth == 0:
                if self.opened:
                    self._break()
                self.opened = True
            self.depth += 1
            if self.depth == self.inner:
                if self.inner == 2:
                    self._change(self.key if token == "[" and self.key in (LIST, SOURCES) else OTHER)
                self.seen, self.want = "", ""
        elif token in "}]":
            if self._listing() and self.seen:
                self.tell(MIXED)
            if self.depth == 2 == self.inner:
                self._change(OTHER)
            self.depth -= 1
            if self.depth < self.inner:
                self._framed(token)
        else:
            self._aside(token)
            if token[0] == '"':
                self.inside = not closing
                if self.depth == 1:
                    try:
                        self.key = json.loads(token)
                    except ValueError:
                        self.key = ""
        return False

    def end(self) -> list[tuple]:
        if self.held is not None:
            self._close(PART)
        if self.frame:
            self.tell(FRAME, text="".join(self.frame))
        return self.rows


_FOUND = f"{FILE} string, {BLOCK} long, {ROW} long, kind int, region string, begins boolean, text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string())
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    split = None
    for part in slices(batches, ("value", FILE, BLOCK, "root", "open", "depth")):
        for text, *of in part:
            if split is None or split.of != (of[0], of[1]):
                if split:
                    yield told(split.end())
                split = _Split(*of)
            split.add(text + "}")
        if split and split.rows:
            yield told(split.rows)
            split.rows = []
    if split:
        yield told(split.end())


@dataclass
class Records:
    # (_file, _block, _row, region, text) of records in lists.
    rows: DataFrame
    # What becomes of each file: ``split``, ``whole`` or ``broken``.
    reading: dict[str, str]


def records(spark: SparkSession, paths: list[str]) -> Records:
    """The records of documents that are an array of objects, or an object with a list of them.

    Rows are numbered within the split a record begins in. A record over several splits is put together from one part of each. Lists that
    hold anything but objects and documents without a list are left to a reader of whole documents. A document that ends too soon, or
    whose frame is no JSON, is broken; a record that is none is for the reader of records to find.
    """
    begun = written_once(starts(spark, paths))
    lines = _lines(spark, paths).join(F.broadcast(begun.where("root IS NOT NULL")), [FILE, BLOCK])  # one row for each split
    found = written_once(lines.select("value", FILE, BLOCK, "root", "open", "depth").mapInArrow(_cut, _FOUND))

    earlier = W.partitionBy(FILE).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    left_off = found.where(F.col("kind") == REGION).groupBy(FILE, BLOCK).agg(F.max_by("region", ROW).alias("left_off"))
    before = F.coalesce(F.last("left_off", ignorenulls=True).over(earlier), F.lit(OTHER))
    inherited = begun.join(left_off, [FILE, BLOCK], "left").select(FILE, BLOCK, before.alias("before"))
    known = found.join(F.broadcast(inherited), [FILE, BLOCK]).withColumn("region", F.coalesce("region", "before")).drop("before")

    def has(kind, more=F.lit(True)):
        return F.count_if((F.col("kind") == kind) & more)

    lists = F.col("region").isin(LIST, SOURCES)
    framed = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == FRAME, F.struct(BLOCK, "text")))), lambda p: p["text"])
    summed = known.where(F.col("kind") > PART).groupBy(FILE).agg(
        has(BROKEN).alias("broken"), has(MIXED, lists).alias("mixed"),
        has(REGION, F.col("region") == LIST).alias("listed"), has(REGION, F.col("region") == SOURCES).alias("sourced"),
        F.array_join(framed, "").alias("frame"),
    )
    states = begun.groupBy(FILE).agg(F.first("root").alias("root"), F.first("braced").alias("braced"), F.first("closed").alias("closed"))
    frame = F.when(F.col("braced"), F.col("frame")).otherwise(F.regexp_replace("frame", r"\}$", ""))
    parsed = F.from_json(frame, "`_bad` string, `_` string", {"columnNameOfCorruptRecord": "_bad"})
    array = F.regexp_like(frame, F.lit("^﻿?[ \t\r\n]*\\[[ \t\r\n]*\\][ \t\r\n]*$"))
    sound = F.when(F.col("root") == "[", array).otherwise(parsed["_bad"].isNull())
    reading = (
        F.when(F.col("root").isNull(), WHOLE)
        .when(~F.col("closed") | (F.col("broken") > 0) | ~F.coalesce(sound, F.lit(False)), BROKEN_FILE)
        .when((F.col("mixed") > 0) | (F.col("sourced") > 1), WHOLE)
        .when((F.col("root") == "[") | (F.col("listed") == 1), SPLIT)
        .otherwise(WHOLE)
    )
    verdicts = states.join(summed, FILE, "left").select(FILE, reading.alias("reading"))

    told = known.where((F.col("kind") <= PART) & lists)
    order = W.partitionBy(FILE).orderBy(BLOCK, F.col("begins"))
    parts = told.where(F.col("kind") == PART).withColumn("record", F.count_if("begins").over(order))
    first = F.struct(~F.col("begins"), BLOCK)
    joined = parts.groupBy(FILE, "record").agg(
        F.min_by(F.struct(BLOCK, ROW, "region"), first).alias("place"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(BLOCK, "begins", "text"))), lambda p: p["text"]), "").alias("text"),
    )
    rows = told.where(F.col("kind") == RECORD).select(FILE, BLOCK, ROW, "region", "text")
    rows = rows.unionByName(joined.select(FILE, "place.*", "text"))
    # One short row for each file, which the import has on the driver already.
    return Records(rows, {r[FILE]: r["reading"] for r in verdicts.collect()})
