"""JSON files: an array of records, a document with a list of them, or a single record."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import BLOCK, BOOKKEEPING, FILE, PARSE_ERROR, ROW, entries_of, fields_of
from . import json_records
from .files import RawRows, Scan, bookkeeping

LIST, SOURCES = json_records.LIST, json_records.SOURCES
MANIFEST = ("id", "name", "type", "profile")


def _records(kind) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def _manifest(documents: DataFrame) -> DataFrame:
    entries = documents.select(F.col(FILE).alias("file"), F.posexplode(SOURCES).alias("entry", "s"))
    known = {f.name for f in documents.schema[SOURCES].dataType.elementType.fields}
    columns = [(F.col(f"s.{n}") if n in known else F.lit(None)).cast("string").alias(n) for n in MANIFEST]
    return entries.select("file", "entry", *columns)


def _with_keys(rows: DataFrame) -> DataFrame:
    """(file, headers): what the first record of each file holds."""
    names = [F.when(F.col(f"`{f.name}`").isNotNull(), F.lit(f.name)) for f in rows.schema.fields if f.name not in BOOKKEEPING]
    keyed = rows.select(F.col(FILE).alias("file"), BLOCK, ROW, F.array_compact(F.array(*names)).alias("headers"))
    return keyed.groupBy("file").agg(F.min_by("headers", F.struct(BLOCK, ROW)).alias("headers"))


def record_schema(names) -> T.StructType:
    """Fields whose values keep the type each record gives them."""
    return T.StructType([T.StructField(n, T.VariantType()) for n in names])


def _document_schema(found: T.StructType) -> T.StructType:
    """The names Spark found; only lists of records and of sources have a type of their own."""
    schema = T.StructType()
    for f in found.fields:
        if f.name == LIST and _records(f.dataType):
            schema.add(LIST, T.ArrayType(record_schema(f.dataType.elementType.names)))
        elif f.name == SOURCES and _records(f.dataType):
            entries = [T.StructField(n, T.StringType()) for n in f.dataType.elementType.names]
            schema.add(SOURCES, T.ArrayType(T.StructType(entries)))
        elif f.name != PARSE_ERROR:
            schema.add(f.name, T.VariantType())
    # A reader needs a field besides the malformed text, and every row is asked for its address.
    if not {LIST, "url"} & set(schema.names):
        schema.add("url", T.VariantType())
    return schema.add(PARSE_ERROR, T.StringType())


def _whole(spark: SparkSession, paths: list[str]) -> Scan:
    """Documents that are read by one task each: single records, and lists of more than records."""
    options = {"multiLine": True, "columnNameOfCorruptRecord": PARSE_ERROR}
    schema = _document_schema(spark.read.options(**options).json(paths).schema)
    read = spark.read.options(**options).schema(schema).json(paths)
    own = [f"`{c}`" for c in read.columns if c != PARSE_ERROR]
    documents = read.select(*own, F.col(PARSE_ERROR).isNotNull().alias(PARSE_ERROR), *bookkeeping())
    kinds = {f.name: f.dataType for f in documents.schema.fields}
    manifest = _manifest(documents) if SOURCES in kinds and _records(kinds[SOURCES]) else None
    pieces = []
    single = documents
    if LIST in kinds and _records(kinds[LIST]):
        single = documents.where(F.col(LIST).isNull()).drop(LIST, SOURCES, "format", "version")
        pieces.append(
            documents.where(F.col(LIST).isNotNull())
            .select(FILE, F.lit(0).cast("bigint").alias(BLOCK), PARSE_ERROR, F.posexplode(LIST).alias(ROW, "r"))
            .select(FILE, BLOCK, F.col(ROW).cast("bigint").alias(ROW), PARSE_ERROR, "r.*")
        )
    pieces.append(single)
    keys = _with_keys(pieces[0])
    for piece in pieces[1:]:
        keys = keys.unionByName(_with_keys(piece))
    return Scan([RawRows(p, fields_of(p)) for p in pieces], keys, None, manifest)


def _split(records: DataFrame) -> Scan:
    """Records cut out of their documents. One that is no JSON is an error by itself and has no values."""
    rows = records.where(F.col("region") == LIST)
    options = {"columnNameOfCorruptRecord": PARSE_ERROR}
    # Names in all their spellings, of the known fields only: records may have any number of others.
    named = rows.select(F.explode(F.json_object_keys("text")).alias("name")).where(F.lower("name").isin(*entries_of(FILE))).distinct()
    names = sorted(r["name"] for r in named.collect()) or ["url"]
    schema = record_schema(names).add(PARSE_ERROR, T.StringType())
    parsed = rows.select(FILE, BLOCK, ROW, F.from_json("text", schema, options).alias("r"))
    broken = F.col(f"r.{PARSE_ERROR}").isNotNull()
    values = [F.when(~broken, F.col(f"r.`{n}`")).alias(n) for n in names]
    piece = parsed.select(*values, broken.alias(PARSE_ERROR), FILE, BLOCK, ROW)

    first = rows.groupBy(F.col(FILE).alias("file")).agg(F.min_by("text", F.struct(BLOCK, ROW)).alias("text"))
    held = F.map_filter(F.from_json("text", "map<string,string>"), lambda k, v: v.isNotNull())
    keys = first.select("file", F.map_keys(held).alias("headers"))

    listed = T.StructType([T.StructField(n, T.StringType()) for n in MANIFEST])
    order = W.partitionBy(FILE).orderBy(BLOCK, ROW)
    entries = records.where(F.col("region") == SOURCES).withColumn("entry", F.row_number().over(order) - 1)
    manifest = entries.select(F.col(FILE).alias("file"), "entry", F.from_json("text", listed).alias("s")).select("file", "entry", "s.*")
    return Scan([RawRows(piece, fields_of(piece))], keys, None, manifest)


def scan(spark: SparkSession, files: list[dict]) -> Scan:
    """Records whose values keep their own types: one file's list of tags is another file's text.

    Lists of records are read in splits, see ``json_records``, whatever their size. A broken record costs one record; a document that ends
    too soon, or that is broken outside of its records, fails as a whole.
    """
    found = json_records.records(spark, [f["path"] for f in files])
    reading = {f["file"]: found.reading.get(f["file"], json_records.WHOLE) for f in files}

    def of(kind):
        return [f for f in files if reading[f["file"]] == kind]

    scans = []
    if cut := of(json_records.SPLIT):
        kept = spark.createDataFrame([(f["file"],) for f in cut], f"{FILE} string")
        scans.append(_split(found.rows.join(F.broadcast(kept), FILE)))
    if whole := of(json_records.WHOLE):
        scans.append(_whole(spark, [f["path"] for f in whole]))
    if broken := of(json_records.BROKEN_FILE):
        rows = spark.createDataFrame([(f["file"], 0, 0, True) for f in broken], f"{FILE} string, {BLOCK} long, {ROW} long, {PARSE_ERROR} boolean")
        scans.append(Scan([RawRows(rows, {})], rows.select(F.col(FILE).alias("file"), F.array().cast("array<string>").alias("headers"))))
    manifests = [s.manifest for s in scans if s.manifest is not None]
    return Scan(
        [part for s in scans for part in s.parts],
        reduce(DataFrame.unionByName, [s.headers for s in scans]),
        None,
        reduce(DataFrame.unionByName, manifests) if manifests else None,
    )
