"""From raw rows of any list to library rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids, text, values, web
from ..schema import EMPTY_TITLE, UNKNOWN_URL

# The names each field may have in a list, best first, whatever their case.
ALIASES = {
    "id": ("id", "bookmark_id", "uid"),
    "title": ("title", "name"),
    "url": ("url", "link", "original_url"),
    "preview": ("article_preview", "description", "preview", "excerpt", "summary"),
    "content": ("content",),
    "favorite": ("is_favorite", "favorite", "starred"),
}

# Texts that mean yes.
YES = ("1", "true", "yes", "y")

# Import profiles, what they are called, and which of them keep a row's own provider,
# reader link and source.
SCRAPER, UNIFIED = "scraper", "unified"
PROFILES = {SCRAPER: "Scraper export", UNIFIED: "Unified export"}
DEFAULT_PROFILE = SCRAPER
DEFAULT_PROVIDER = "instapaper"

# File types.
SOURCE_TYPES = ("csv", "json", "sqlite", "db")

# Bookkeeping columns every scan adds: file, place of the split in it, row in the split, and
# whether the row was malformed.
FILE, BLOCK, ROW, PARSE_ERROR = "_file", "_block", "_row", "_parse_error"
BOOKKEEPING = (FILE, BLOCK, ROW, PARSE_ERROR)


def fields_of(raw: DataFrame) -> dict[str, tuple[Column, T.DataType]]:
    """Columns by lower-cased name; of names differing only in case the last one counts."""
    return {f.name.lower(): (F.col(f"`{f.name}`"), f.dataType) for f in raw.schema.fields if f.name not in BOOKKEEPING}


def entries_of(column: str) -> dict[str, tuple[Column, T.DataType]]:
    """The known fields of rows given as a map with lower-cased names."""
    names = [n for group in ALIASES.values() for n in group]
    names += ["tags", "provider", "instapaper_url", "source_file_id", "source_file_name"]
    return {n: (F.try_element_at(F.col(column), F.lit(n)), T.StringType()) for n in names}


def lower_keys(entries: Column) -> Column:
    """Entries (key, value) as a map with lower-cased keys; of keys differing only in case the last counts."""
    pairs = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"])
    return F.map_from_arrays(names, last)


def first_of(fields: dict, names, default: Column | None = None) -> Column:
    """The first field of ``names`` that holds something, as text."""
    found = [values.loose_text(*fields[n]) for n in names if n in fields]
    if default is not None:
        found.append(default)
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def tags(fields: dict) -> Column:
    """Tags as they are given: a list, or text split at commas with blanks kept."""
    none = F.array().cast("array<string>")
    if "tags" not in fields:
        return none
    column, kind = fields["tags"]
    if isinstance(kind, T.ArrayType):
        return F.coalesce(column.cast("array<string>"), none)
    if isinstance(kind, T.VariantType):
        listed = F.schema_of_variant(column).startswith("ARRAY")
        text = F.split(values.loose_text(column, kind), ",")
        given = F.when(listed, F.try_variant_get(column, "$", "array<string>")).otherwise(text)
        return F.coalesce(given, none)
    return F.coalesce(F.split(values.loose_text(column, kind), ","), none)


def favorite_flag(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return column
    if isinstance(kind, T.NumericType):
        return column != 0
    if isinstance(kind, T.VariantType):
        # Numbers and flags are what they are; as JSON, only text is in quotes.
        written = F.to_json(column)
        text = favorite_flag(F.try_variant_get(column, "$", "string"), T.StringType())
        return F.when(F.startswith(written, F.lit('"')), text).when(written != "null", ~written.isin(*values.NOTHING))
    return F.lower(F.trim(column)).isin(*YES)


def favorite(fields: dict) -> Column:
    """The star of a row; null when the list says nothing about it."""
    given = [fields[n] for n in ALIASES["favorite"] if n in fields]
    if not given:
        return F.lit(None).cast("boolean")
    return F.coalesce(*[F.when(c.isNotNull(), favorite_flag(c, k)) for c, k in given])


def normalize(
    raw: DataFrame,
    fields: dict,
    source_id: Column,
    source_name: Column,
    keep_meta: Column,
    fallback_id: Column | None = None,
    keep=(),
) -> DataFrame:
    """Library rows (without ``seq``) of raw rows, the ones without an address included.

    ``keep_meta`` tells the rows whose own provider and reader link count; ``keep`` names columns
    of ``raw`` to carry along.
    """
    url = first_of(fields, ALIASES["url"], F.lit(UNKNOWN_URL))
    own_id = first_of(fields, ALIASES["id"], fallback_id)
    preview = first_of(fields, ALIASES["preview"], F.lit(""))
    provider = first_of(fields, ("provider",))
    reader = F.lit(None).cast("string")
    if "instapaper_url" in fields:
        reader = values.as_text(*fields["instapaper_url"])
    staged = raw.select(
        *keep,
        url.alias("url"),
        own_id.alias("own_id"),
        first_of(fields, ALIASES["title"], F.lit(EMPTY_TITLE)).alias("title"),
        preview.alias("article_preview"),
        first_of(fields, ALIASES["content"]).alias("own_content"),
        source_id.alias("source_file_id"),
        source_name.alias("source_file_name"),
        tags(fields).alias("tags"),
        F.coalesce(F.when(keep_meta, provider), F.lit(DEFAULT_PROVIDER)).alias("provider"),
        F.when(keep_meta, reader).alias("own_reader"),
        favorite(fields).alias("is_favorite"),
    )
    staged = staged.withColumn("id", F.coalesce("own_id", ids.stable_id(F.col("url"), F.col("source_file_id"))))
    return staged.select(
        *keep,
        "id",
        "title",
        "url",
        "article_preview",
        F.coalesce("own_content", "article_preview").alias("content"),
        "source_file_id",
        "source_file_name",
        text.detect_language(text.analysis_text(F.col("title"), F.col("article_preview"))).alias("detected_language"),
        "tags",
        F.coalesce("own_reader", web.reader_url(F.col("provider"), F.col("id"))).alias("instapaper_url"),
        "provider",
        "is_favorite",
        F.lit(None).cast("string").alias("deleted_at"),
    )


def has_url() -> Column:
    return F.col("url") != UNKNOWN_URL


def with_positions(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with ``in_seq``: dense, in file order and then as written.

    Spark rows have no order, but rows of one split are numbered as they are read. Adding up the
    counts of the splits, one small row each, places every split without sorting any data.
    """
    splits = rows.groupBy(FILE, BLOCK).agg(F.min(ROW).alias("first_row"), F.count("*").alias("rows"))
    before = W.orderBy("pos", BLOCK).rowsBetween(W.unboundedPreceding, -1)
    placed = splits.join(files.select(F.col("file").alias(FILE), "pos"), FILE).select(
        FILE, BLOCK, (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first_row")).alias("shift")
    )
    return rows.join(F.broadcast(placed), [FILE, BLOCK]).withColumn("in_seq", F.col(ROW) + F.col("shift")).drop("shift")


def profile_or_default(profile: Column, fallback: Column) -> Column:
    """A known profile, else a known fallback, else the default one."""
    offered = list(PROFILES)
    return (
        F.when(profile.isin(offered), profile).when(fallback.isin(offered), fallback).otherwise(F.lit(DEFAULT_PROFILE))
    )


def profile_label(profile: str) -> str:
    return PROFILES.get(profile, profile)


def type_from_name(name: Column) -> Column:
    """File type by extension, ``''`` when it is none we read."""
    extension = F.lower(F.regexp_extract(name, r"([^.]+)$", 1))
    return F.when(extension.isin(*SOURCE_TYPES), extension).otherwise(F.lit(""))


def unique_name(name: str, taken, stamp: int) -> str:
    """A source name not among ``taken``: the stem with a time stamp, then with a counter."""
    stem, dot, extension = name.rpartition(".")
    if not stem or not extension:
        stem, dot, extension = name, "", ""
    candidates = [f"{stem}_{stamp}{dot}{extension}"]
    candidates += [f"{stem}_{stamp}_{n}{dot}{extension}" for n in range(1, len(set(taken)) + 1)]
    used = set(taken)
    return next(c for c in candidates if c not in used)


def same_name(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, name, source_id): files called like a source already there."""
    return files.join(sources.select(F.col("id").alias("source_id"), "name"), "name").select("file", "name", "source_id")


def unique_names(files: DataFrame, sources: DataFrame, stamp: int) -> DataFrame:
    """Files with ``name`` changed where a source has it already: stamped, then counted up until it is free.

    Several files of one name take the free names in turn.
    """
    taken = sources.select("name").where(F.col("name").isNotNull()).distinct()
    stem, extension = F.regexp_extract("name", r"^(.+)\.[^.]+$", 1), F.regexp_extract("name", r"^.+(\.[^.]+)$", 1)
    whole = stem == ""
    start = F.concat(F.when(whole, F.col("name")).otherwise(stem), F.lit(f"_{stamp}"))
    turn = F.row_number().over(W.partitionBy("name").orderBy("pos"))
    clashing = (
        files.join(taken, "name", "left_semi")
        .select("file", "name", start.alias("start"), F.when(whole, "").otherwise(extension).alias("end"), turn.alias("turn"))
    )
    # A name can be taken by as many sources as are stamped alike; one more than these and the files in turn is enough.
    stamped = taken.select(F.regexp_extract("name", rf"^(.*_{stamp})(?:_[0-9]+)?(?:\.[^.]+)?$", 1).alias("start")).where(F.col("start") != "")
    used = clashing.select("name", "start").distinct().join(stamped, "start").groupBy("name").agg(F.count("*").alias("used"))
    tried = (
        clashing.groupBy("name", "start", "end").agg(F.max("turn").alias("turns"))
        .join(used, "name", "left")
        .withColumn("n", F.explode(F.sequence(F.lit(0), F.col("turns") + F.coalesce("used", F.lit(0)))))
        .select("name", "n", F.concat("start", F.when(F.col("n") > 0, F.concat(F.lit("_"), "n")).otherwise(""), "end").alias("free"))
    )
    free = tried.join(taken.withColumnRenamed("name", "free"), "free", "left_anti").select(
        "name", "free", F.row_number().over(W.partitionBy("name").orderBy("n")).alias("turn")
    )
    renamed = clashing.join(free, ["name", "turn"]).select("file", "free")
    return files.join(renamed, "file", "left").withColumn("name", F.coalesce("free", "name")).drop("free")


def header_verdicts(files: DataFrame) -> DataFrame:
    """Files (profile, headers, unified) with ``verdict`` and ``suggested`` profile.

    ``headers`` are column names or keys; ``unified`` marks a JSON document with its own list of
    sources. The reading service's official export has no previews and is refused.
    """
    clean = F.transform("headers", lambda h: F.lower(F.trim(F.regexp_replace(h, "^﻿", ""))))

    def has(name):
        return F.array_contains(clean, name)

    # Column names that give a format away.
    official = has("url") & has("title") & has("timestamp") & (has("folder") | has("selection"))
    matched = (
        F.when(F.col("unified"), F.lit(UNIFIED))
        .when(has("source_file_id") | has("detected_language"), F.lit(UNIFIED))
        .when(has("id") & has("url"), F.lit(SCRAPER))
    )
    refused = official & (F.col("type") == "csv")
    other = matched.isNotNull() & (matched != F.col("profile"))
    return files.withColumn(
        "verdict", F.when(refused, "unsupported").when(other, "mismatch").otherwise("ok")
    ).withColumn("suggested", F.when(~refused & other, matched))
