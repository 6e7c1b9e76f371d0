"""Importing files: scan, check, normalise, place, and merge into the library."""

import time
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import envelope, ingest, merge
from ..operators.ingest import BLOCK, FILE, PARSE_ERROR, ROW
from ..schema import LIBRARY, SOURCES
from ..scratch import written_once
from ..sources import csv_lists, json_lists, sqlite_lists
from ..sources import files as file_lists

READERS = {"csv": csv_lists.scan, "json": json_lists.scan, "sqlite": sqlite_lists.scan, "db": sqlite_lists.scan}

# What becomes of a file called like a source already there.
REFUSE, OVERWRITE, KEEP_BOTH = "refuse", "overwrite", "keep"

MANIFEST = "file string, entry int, id string, name string, type string, profile string"


@dataclass
class Import:
    """An import, not yet written: what would be merged, and what there is to say about it."""

    # Library columns with ``in_seq`` for ``seq``; rows without an address are left out.
    incoming: DataFrame
    # Sources the import adds.
    sources: DataFrame
    # (file, name, imported, parse_errors, dropped_no_url, verdict, suggested, failure) per file.
    report: DataFrame
    # Ids of the sources given up for new files of their names.
    replaced: DataFrame


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def prepare(
    spark: SparkSession,
    paths: list[str],
    profile: str = ingest.DEFAULT_PROFILE,
    sources: DataFrame | None = None,
    source_id: Callable[[str], str] | None = None,
    on_collision: str = KEEP_BOTH,
) -> Import:
    """Read files of any supported format as one import.

    Files of an unknown type, empty and unreadable ones and official exports fail for themselves; the
    others go on. A list that has a header and no rows is a source without rows. The normalised rows are staged once in the shared folder; positions, counts, owners and
    the later merge read that table instead of parsing the files again. The library is not touched.

    A file called like one of ``sources`` is kept beside it under a name of its own (``keep``), fails
    (``refuse``), or takes its place with all its rows (``overwrite``) if it holds a record at all.
    """
    if on_collision not in (REFUSE, OVERWRITE, KEEP_BOTH):
        raise ValueError(f"unknown on_collision: {on_collision}")
    sources = spark.createDataFrame([], SOURCES) if sources is None else sources
    listing = file_lists.listed(spark, paths, profile, source_id)
    failed = {f["file"]: "unsupported type" if not f["type"] else "empty" for f in listing if not f["type"] or not f["size"]}
    by_reader = defaultdict(list)
    for f in listing:
        if f["file"] not in failed:
            by_reader[READERS[f["type"]]].append(f)
    scans = [(reader, reader(spark, group)) for reader, group in by_reader.items()]
    for _, scan in scans:
        failed |= scan.failed
    names = ("file", "pos", "name", "type", "profile", "id")
    files = spark.createDataFrame([tuple(f[n] for n in names) for f in listing], file_lists.FILES)
    failures = spark.createDataFrame(list(failed.items()), "file string, failure string")
    clashes = written_once(ingest.same_name(files, sources))
    if on_collision == KEEP_BOTH:
        files = written_once(ingest.unique_names(files, sources, time.time_ns() // 1_000_000))
    clashing = clashes.select("file").distinct()
    if on_collision == REFUSE:
        named = clashing.join(failures, "file", "left_anti").withColumn("failure", F.lit("name already present"))
        failures = failures.unionByName(named)

    headers = [s.headers for _, s in scans]
    # What has one row for each file, or for each source it names, is made once and goes to the rows: rows of one file may be all there are,
    # so none are ever dealt by their file.
    verdicts = written_once(_checked(spark, files, headers, [s.manifest for _, s in scans]))
    refused = verdicts.where(F.col("verdict") == "unsupported").select(F.col("file").alias(FILE))
    if on_collision == REFUSE:
        refused = refused.unionByName(clashing.select(F.col("file").alias(FILE))).distinct()

    manifests = [s.manifest for _, s in scans if s.manifest is not None]
    manifest = _union(manifests) if manifests else spark.createDataFrame([], MANIFEST)
    normalized = []
    for reader, scan in scans:
        for part in scan.parts:
            rows = part.rows.join(F.broadcast(refused), FILE, "left_anti")
            rows = envelope.with_owner(rows, files, part.fields)
            if reader is sqlite_lists.scan:
                rows = rows.withColumn("owner", F.lit(None).cast("string"))
            own = files.select(F.col("file").alias(FILE), F.col("id").alias("_id"))
            rows = rows.join(F.broadcast(own), FILE)
            normalized.append(
                ingest.normalize(
                    rows,
                    part.fields,
                    F.coalesce("owner", "_id"),
                    F.lit(None).cast("string"),
                    F.col("keep_meta"),
                    keep=(FILE, BLOCK, ROW, PARSE_ERROR, "owner", "_named"),
                )
            )
    rows = written_once(_union(normalized) if normalized else _no_rows(spark))
    owners = written_once(envelope.owners(rows, files, manifest, sources))
    own_names = files.select(F.col("file").alias(FILE), F.col("name").alias("_file_name"))
    owner_names = owners.select(F.col("file").alias(FILE), "owner", F.col("name").alias("_owner_name"))
    rows = (
        rows.drop("source_file_name")
        .join(F.broadcast(own_names), FILE)
        .join(owner_names, [FILE, "owner"], "left")
        .withColumn("source_file_name", F.coalesce("_owner_name", "_file_name"))
    )
    placed = ingest.with_positions(rows, files)
    incoming = placed.where(ingest.has_url()).select("id", "in_seq", *merge.RECORD_COLUMNS, "is_favorite")

    counted = rows.groupBy(F.col(FILE).alias("file")).agg(
        F.count_if(ingest.has_url()).alias("imported"),
        F.count_if(F.col(PARSE_ERROR)).alias("parse_errors"),
        F.count_if(~ingest.has_url()).alias("dropped"),
        F.count_if(~ingest.has_url() & F.col(PARSE_ERROR)).alias("broken"),
        F.count_if(ingest.has_url() | ~F.col(PARSE_ERROR)).alias("rows"),
        F.count_if(F.col("owner").isNull()).alias("own_rows"),
    )
    # A broken JSON document holds no record that could lack an address; a ragged line does.
    no_url = F.when(F.col("type") == "json", F.col("dropped") - F.col("broken")).otherwise(F.col("dropped"))
    report = (
        files.join(counted, "file", "left")
        .withColumn("dropped_no_url", no_url)
        .join(verdicts.select("file", "verdict", "suggested"), "file", "left")
        .join(failures, "file", "left")
        .join(clashing.withColumn("clashes", F.lit(on_collision == OVERWRITE)), "file", "left")
        .select(
            "file",
            "pos",
            "name",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("imported", "parse_errors", "dropped_no_url", "own_rows")],
            F.coalesce("verdict", F.lit("ok")).alias("verdict"),
            "suggested",
            F.coalesce(
                "failure",
                F.when(F.col("verdict") == "unsupported", "unsupported source"),
                # Nothing but errors in it.
                F.when((F.col("rows") == 0) & (F.col("parse_errors") > 0), "malformed"),
                F.when(F.col("clashes") & (F.coalesce("imported", F.lit(0)) == 0), "no record to replace the source with"),
            ).alias("failure"),
        )
    )
    good = report.where(F.col("failure").isNull()).select("file") if on_collision == OVERWRITE else clashing.limit(0)
    replaced = clashes.join(good, "file", "left_semi").select(F.col("source_id").alias("id")).distinct()
    added = _added_sources(spark, files, report, owners, [s.layouts for _, s in scans])
    return Import(incoming, added, report, replaced)


def _no_rows(spark: SparkSession) -> DataFrame:
    """What the rows of no file look like once they are normalised."""
    keep = f"{FILE} string, {BLOCK} long, {ROW} long, {PARSE_ERROR} boolean, owner string, _named string"
    return ingest.normalize(
        spark.createDataFrame([], keep), {}, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False),
        keep=(FILE, BLOCK, ROW, PARSE_ERROR, "owner", "_named"),
    )


def _checked(spark, files: DataFrame, headers: list[DataFrame], manifests) -> DataFrame:
    """Files with the verdict on their column names."""
    empty = spark.createDataFrame([], "file string, headers array<string>")
    found = reduce(DataFrame.unionByName, headers, empty)
    listed = spark.createDataFrame([], "file string")
    for manifest in manifests:
        if manifest is not None:
            listed = listed.unionByName(manifest.select("file"))
    marked = (
        files.join(found, "file", "left")
        .join(listed.distinct().withColumn("listed", F.lit(True)), "file", "left")
        .withColumn("unified", F.coalesce("listed", F.lit(False)))
        .withColumn("headers", F.coalesce("headers", F.array().cast("array<string>")))
    )
    return ingest.header_verdicts(marked)


def _added_sources(spark, files, report, owners, layouts) -> DataFrame:
    """Files that keep rows of their own, and new sources named in unified exports.

    A file all of whose rows belong to other sources is not a source itself.
    """
    kept = report.where(F.col("failure").isNull()).select("file", "own_rows", "imported", "dropped_no_url")
    all_owned = (F.col("own_rows") == 0) & (F.col("imported") + F.col("dropped_no_url") > 0)
    recorded = [part for part in layouts if part is not None]
    own = files.join(kept.where(~all_owned), "file")
    if recorded:
        own = own.join(_union(recorded), "file", "left")
    columns = {f.name: f.dataType for f in SOURCES.fields}
    for name, kind in columns.items():
        if name not in own.columns:
            own = own.withColumn(name, F.lit(None).cast(kind))
    named = envelope.new_sources(owners)
    for name, kind in columns.items():
        if name not in named.columns:
            named = named.withColumn(name, F.lit(None).cast(kind))
    return own.select(*columns).unionByName(named.select(*columns))


def apply(library: DataFrame, sources: DataFrame, prepared: Import) -> tuple[DataFrame, DataFrame]:
    """Library and sources after an import; write both once, and the import is all or nothing."""
    library = library.join(prepared.replaced.select(F.col("id").alias("source_file_id")), "source_file_id", "left_anti")
    library = library.select(*LIBRARY.names)
    sources = sources.join(prepared.replaced, "id", "left_anti").select(*sources.columns)
    fresh = prepared.sources.join(sources.select("id"), "id", "left_anti")
    following = F.coalesce(sources.agg(F.max("pos")).scalar(), F.lit(-1)) + 1
    added = fresh.withColumn("pos", F.col("pos") + following)
    return merge.merge(library, prepared.incoming), sources.unionByName(added.select(*sources.columns))


def totals(library: DataFrame, prepared: Import) -> DataFrame:
    """One row for the whole import, with up to three names of failed files."""
    # How many failures a summary names.
    named = 3
    failed = F.col("failure").isNotNull()
    summed = prepared.report.agg(
        F.count_if(~failed).alias("files"),
        F.sum(F.when(~failed, F.col("imported"))).alias("imported"),
        F.sum(F.when(~failed, F.col("parse_errors"))).alias("parse_errors"),
        F.sum(F.when(~failed, F.col("dropped_no_url"))).alias("dropped_no_url"),
        F.count_if(failed).alias("failed"),
    )
    first = prepared.report.where(failed).orderBy("pos").limit(named).agg(F.collect_list("name")).scalar()
    replaced = merge.displaced(library, prepared.incoming).scalar()
    return summed.withColumn("displaced", replaced).withColumn("failed_names", first)
