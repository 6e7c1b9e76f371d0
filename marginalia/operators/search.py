"""Filter, search, rank and order the library."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..schema import KNOWN_LANGUAGES
from ..scratch import written_once

# Points for a term found in a title, preview, address or tag.
TITLE_POINTS, PREVIEW_POINTS, URL_POINTS, TAG_POINTS = 10, 5, 3, 8

# The operators of the search box and the marks of a favourite.
LINK, IS, FAVORITE_MARKS = "link:", "is:", ("fav", "♥")


# Words whose matches are counted at a time.
MOST_WORDS = 1_000


def _take(text: str) -> tuple[str, bool, str]:
    """(value, quoted, what follows): a value in quotes where a second quote closes it, or all up to white space."""
    if text.startswith('"') and '"' in text[1:]:
        value, _, rest = text[1:].partition('"')
        return value, True, rest
    value = text.split(maxsplit=1)[0] if text and not text[0].isspace() else ""
    return value, False, text[len(value) :]


def _term(text: str, exact=False, url_only=False, favorite=False) -> dict:
    return {"text": text, "exact": exact, "url_only": url_only, "favorite": favorite}


def search_terms(query: str | None) -> list[dict]:
    """The words of a search box: ``is:fav``, ``link:...``, ``"a phrase"`` and plain words, in any case.

    A favourite mark ends where it ends, whatever follows it. An operator without a value is a plain word; an empty
    phrase is nothing, but an empty link phrase is looked for as it stands.
    """
    found, rest = [], (query or "").strip()
    while rest:
        start = rest[: len(LINK)].lower()
        mark = next((m for m in FAVORITE_MARKS if start.startswith(IS) and rest[len(IS) :].lower().startswith(m)), None)
        if mark:
            found.append(_term(mark, favorite=True))
            rest = rest[len(IS) + len(mark) :].lstrip()
            continue
        value, quoted, after = _take(rest[len(LINK) :]) if start == LINK else ("", False, "")
        if value or quoted:
            value = value.strip().lower()
            found.append(_term(value, quoted, True) if value else _term(LINK))
        else:
            value, quoted, after = _take(rest)
            value = value.strip().lower() if quoted else value.lower()
            if value:
                found.append(_term(value, exact=quoted))
        rest = after.lstrip()
    return found


def active(library: DataFrame) -> DataFrame:
    return library.where(~values.trashed())


def trash(library: DataFrame) -> DataFrame:
    """Trashed rows, latest stamp first; stamps are compared as text."""
    return library.where(values.trashed()).orderBy(F.desc("deleted_at"), "seq")


def in_folder(library: DataFrame, source_file_id: str | None) -> DataFrame:
    return library if source_file_id is None else library.where(F.col("source_file_id") == source_file_id)


def in_language(library: DataFrame, language: str | None) -> DataFrame:
    """Rows of one language; ``other`` is everything the detector does not know."""
    if language is None:
        return library
    if language == "other":
        language = F.col("detected_language")
        return library.where(language.isNull() | ~language.isin(*KNOWN_LANGUAGES))
    return library.where(F.col("detected_language") == language)


def with_tag(library: DataFrame, tag: str | None) -> DataFrame:
    """Rows carrying exactly this tag, blanks included."""
    return library.where(F.array_contains("tags", tag)) if tag else library


def favorites(library: DataFrame) -> DataFrame:
    return library.where(F.col("is_favorite"))


def term_score(term: dict) -> Column:
    """Points one search word earns on a row; 0 where it is not found."""
    text = F.lit(term["text"])

    def found(column: str) -> Column:
        return F.contains(F.lower(F.coalesce(column, F.lit(""))), text)

    points = F.when(found("url"), URL_POINTS).otherwise(0)
    if term["url_only"]:
        return points
    tagged = F.exists(F.coalesce("tags", F.array()), lambda t: F.contains(F.lower(t), text))
    return (
        F.when(found("title"), TITLE_POINTS).otherwise(0)
        + F.when(found("article_preview"), PREVIEW_POINTS).otherwise(0)
        + points
        + F.when(F.coalesce(tagged, F.lit(False)), TAG_POINTS).otherwise(0)
    )


def search(library: DataFrame, query: str | None) -> DataFrame:
    """Rows on which every search word is found, with their ``score``.

    ``score`` is null when the query has no words to score.
    """
    terms = search_terms(query)
    if any(t["favorite"] for t in terms):
        library = favorites(library)
    scores = [term_score(t) for t in terms if not t["favorite"]]
    if not scores:
        return library.withColumn("score", F.lit(None).cast("int"))
    total = scores[0]
    for score in scores:
        library = library.where(score > 0)
    for score in scores[1:]:
        total = total + score
    return library.withColumn("score", total)


def order_keys(sort: str, seed: int | None = None) -> list[Column]:
    """Sort keys; ties keep the library's order. Ids that are no numbers come last."""
    number = F.expr("try_cast(id AS double)")
    title = F.collate(F.coalesce("title", F.lit("")), "zh_Hant_TWN")
    keys = {
        "relevance": [F.desc_nulls_last("score")],
        "newer": [number.desc_nulls_last()],
        "older": [number.asc_nulls_last()],
        "title_asc": [title.asc()],
        "title_desc": [title.desc()],
        "random": [F.rand(seed) if seed is not None else F.rand()],
    }
    return [*keys[sort], F.asc("seq")]


def view(
    library: DataFrame,
    folder: str | None = None,
    language: str | None = None,
    tag: str | None = None,
    query: str | None = None,
    sort: str | None = "relevance",
    limit: int | None = None,
    seed: int | None = None,
) -> DataFrame:
    """The library as a reader sees it: live rows, filtered, searched and ordered.

    ``sort=None`` leaves the rows unordered for operators that do not need an order.
    """
    rows = with_tag(in_language(in_folder(active(library), folder), language), tag)
    rows = search(rows, query)
    if sort is not None:
        rows = rows.orderBy(*order_keys(sort, seed))
    return rows if limit is None else rows.limit(limit)


def ranked(ordered: DataFrame) -> DataFrame:
    """Sorted rows with ``rank``, from 1.

    Sorted partitions hold consecutive stretches, so their sizes, one small row each, place every row. The rows are
    written once, because partitions sorted anew may be cut elsewhere.
    """
    placed = ordered.withColumn("_place", F.monotonically_increasing_id())
    rows = written_once(placed).withColumn("_part", F.shiftright("_place", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.min("_place").alias("first"), F.count("*").alias("rows")).select(
        "_part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first") + 1).alias("shift")
    )
    # One row per task of the sort.
    return rows.join(F.broadcast(starts), "_part").select(
        *ordered.columns, (F.col("_place") + F.col("shift")).alias("rank")
    )


def domain_query(host: str) -> str:
    """The search a click on a domain starts."""
    return f"link:{host}"


def matches_per_word(library: DataFrame, words: DataFrame) -> DataFrame:
    """How many live rows a click on each word would show.

    ``words`` is a short report (a word cloud), of MOST_WORDS words at most; it travels as one array per row instead of a
    join, so the library is read once and never repartitioned.
    """
    words = written_once(words.select("word"))
    if words.count() > MOST_WORDS:
        raise ValueError(f"matches are counted for at most {MOST_WORDS} words")
    listed = words.agg(F.collect_set("word")).scalar()
    text = F.lower(
        F.concat_ws(
            "\0",
            F.coalesce("title", F.lit("")),
            F.coalesce("article_preview", F.lit("")),
            F.coalesce("url", F.lit("")),
            F.array_join(F.coalesce("tags", F.array()), "\0"),
        )
    )
    hits = active(library).select(text.alias("text")).withColumn("words", listed)
    return (
        hits.select(F.explode_outer(F.filter("words", lambda w: F.contains(F.col("text"), w))).alias("word"))
        .where(F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.count("*").alias("matches"))
    )


def all_selected(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: whether the view is not empty and every row of it is selected."""
    marks = selected.select(F.col("id")).distinct().withColumn("selected", F.lit(True))
    return rows.join(marks, "id", "left").agg(
        ((F.count("*") > 0) & F.coalesce(F.bool_and(F.coalesce("selected", F.lit(False))), F.lit(False))).alias(
            "all_selected"
        )
    )
