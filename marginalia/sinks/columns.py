"""Library rows in the columns of the list they came from."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values, web
from ..operators.ingest import SCRAPER

# What a scraper list without a recorded header is written with.
SCRAPER_COLUMNS = ("id", "title", "url", "article_preview", "content", "tags")


def known_columns() -> dict[str, Column]:
    """What each known column name is filled with."""
    # The names of the columns.
    star = values.favorite().cast("int")
    return {
        "id": F.col("id"),
        "title": F.col("title"),
        "url": F.col("url"),
        "preview": F.col("article_preview"),
        "article_preview": F.col("article_preview"),
        "content": F.col("content"),
        "tags": F.array_join("tags", ",", ""),
        "instapaper_url": F.col("instapaper_url"),
        "provider": F.col("provider"),
        "is_favorite": star,
        "favorite": star,
    }


def project(library: DataFrame, columns, keep=()) -> DataFrame:
    """The named columns in their order; names are matched in any case, unknown ones stay empty."""
    known = known_columns()
    filled = [known.get(c.lower(), F.lit(None).cast("string")).alias(c) for c in columns]
    return library.select(*keep, *filled)


def unmapped(columns: Column) -> Column:
    """How many of a list's columns the library has nothing for."""
    return F.size(F.filter(columns, lambda c: ~F.lower(c).isin(*known_columns())))


def export_columns(csv_columns, profile):
    """Columns to write a source with; None stands for all of the library's."""
    if csv_columns:
        return list(csv_columns)
    return list(SCRAPER_COLUMNS) if profile == SCRAPER else None


def hardened(frame: DataFrame, keep=()) -> DataFrame:
    """Every text column safe for spreadsheets."""
    texts = [f.name for f in frame.schema.fields if f.dataType.simpleString() == "string" and f.name not in keep]
    return frame.withColumns({f"`{c}`" if "." in c else c: web.harden_cell(F.col(f"`{c}`")) for c in texts})
