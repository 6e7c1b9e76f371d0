"""The two tables every operator works on: ``library`` and ``sources``."""

from pyspark.sql import types as T

# What a record gets when its input has none.
EMPTY_TITLE = "Untitled Article"
UNKNOWN_URL = "#"

# The languages the detector can answer.
KNOWN_LANGUAGES = ("en", "zh", "ja")

LIBRARY = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("seq", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("article_preview", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("source_file_id", T.StringType()),
        T.StructField("source_file_name", T.StringType()),
        T.StructField("detected_language", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("instapaper_url", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("is_favorite", T.BooleanType()),
        T.StructField("deleted_at", T.StringType()),
    ]
)

CSV_DIALECT = T.StructType(
    [T.StructField("delimiter", T.StringType()), T.StructField("linebreak", T.StringType())]
)

SQLITE_LAYOUT = T.StructType(
    [T.StructField("table", T.StringType()), T.StructField("columns", T.ArrayType(T.StringType()))]
)

SOURCES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("pos", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("profile", T.StringType()),
        T.StructField("csv_columns", T.ArrayType(T.StringType())),
        T.StructField("csv_dialect", CSV_DIALECT),
        T.StructField("sqlite_layout", SQLITE_LAYOUT),
    ]
)
