"""Registered queries; every one reads the given tables whole."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import ids, values, web
from marginalia.functions import text as tx
from marginalia.operators import counts, graph, ingest, lexicon, merge, neighbours, phrases, search, search_index, similarity, terms
from marginalia.plans import imports
from marginalia.schema import SOURCES
from marginalia.scratch import shared_folder, written_once
from marginalia.sinks import columns, exports, journal, kept_counts, store
from marginalia.streaming import drop_folder

from . import oracles, tables
from .oracles import TARGET

DIGITS = 6


def rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, DIGITS) for c in columns})


def _picked(spark: SparkSession, d: str) -> DataFrame:
    return graph.first_nodes(search.active(tables.library(spark, d)))


def _view(columns, **arguments):
    return lambda spark, d: search.view(tables.library(spark, d), **arguments).select(*columns)


def _ranked_view(columns, **arguments):
    return lambda spark, d: search.ranked(search.view(tables.library(spark, d), **arguments).select(*columns))


def _indexed(spark, d):
    root = shared_folder(spark)
    store.save(tables.library(spark, d), source_table(spark, d), root)
    rows, _ = store.load(spark, root)
    search_index.build(rows, root + "/index")
    return search_index.view(spark, root + "/index", rows, "tion the", sort=None).select("id", "score")


def _written_in_han(spark, d):
    """The articles with the letters of their first five hundred characters as Han characters, blanks as nothing."""
    text = F.lower(F.left("content", F.lit(500)))
    han = F.translate(text, oracles.LETTERS + " ", oracles.HAN)
    return tables.texts(spark, d).select("seq", F.lit("").alias("title"), F.regexp_replace(han, "[^一-龥]", " ").alias("article_preview"))


def _learnt_words(spark, d):
    told = lexicon.statistics(lexicon.grams(lexicon.runs(_written_in_han(spark, d))))
    fine = (F.col("cnt") >= 5) & (F.col("information") >= 2.0) & (F.least("before", "behind") >= 0.7)
    return rounded(told.where(fine), "information", "before", "behind")


def _similar(frame: DataFrame, *extra: str) -> DataFrame:
    return rounded(frame, "score", *[c for c in extra if c == "share"]).select("id", "seq", "score", *extra)


def _like_target(weighting: str):
    def run(spark, d):
        corpus = tables.texts(spark, d).withColumn("url", F.lit("#"))
        return _similar(similarity.most_similar(corpus, TARGET, weighting=weighting))

    return run


def _auto(spark, d):
    corpus = tables.texts(spark, d).withColumn("url", F.lit("#"))
    return _similar(similarity.most_similar_auto(corpus, TARGET), "share", "mode")


def _degrees(spark, d):
    picked = _picked(spark, d)
    nodes = graph.node_degrees(picked.select("seq"), graph.graph_edges(picked))
    return rounded(
        nodes.select(
            "seq",
            "degree",
            values.node_radius(F.col("degree")).alias("radius"),
            values.node_label_offset(F.col("degree")).alias("label_offset"),
        ),
        "radius",
        "label_offset",
    )


def _edges_at(spark, d):
    edges = graph.edges_at(graph.graph_edges(_picked(spark, d)), int(TARGET))
    return edges.select(
        "src", "dst", F.round("value", DIGITS).alias("value"), values.link_width(F.col("value")).alias("width")
    )


def _all_selected(spark, d):
    rows = tables.library(spark, d)
    shown = search.view(rows, folder="src3", sort=None)
    return search.all_selected(shown, search.in_folder(rows, "src3"))


def _cloud_term_counts(spark, d):
    surfaces = terms.cloud_surfaces(search.active(tables.library(spark, d)))
    return terms.cloud_counts(terms.cloud_terms(surfaces)).select("word", "cnt")


def _pairs(spark, d):
    surfaces = terms.cloud_surfaces(search.active(tables.library(spark, d)), "grouped")
    return terms.cloud_terms(surfaces, "grouped").select("key", "display", "cnt")


def _matches(spark, d):
    rows = tables.library(spark, d)
    return search.matches_per_word(rows, terms.word_cloud(search.active(rows)))


def _all_words(spark, d):
    found = terms.document_words(tables.texts(spark, d)).select(F.explode_outer("words").alias("word"))
    return found.where(F.col("word").isNotNull())


def read_queries() -> dict:
    """Searches, counts, terms, similarity and the graph."""
    t = tables
    return {
        "domain_counts": lambda s, d: counts.domain_counts(t.page_list(s, d)).select("domain", "cnt"),
        "top_domains": lambda s, d: counts.top_domains(t.page_list(s, d)),
        "domain_share": lambda s, d: counts.domain_share(t.page_list(s, d)).select("domain", "cnt", "share"),
        "trash_split": lambda s, d: counts.trash_split(t.library(s, d)),
        "folder_counts": lambda s, d: counts.folder_counts(t.library(s, d), t.sources(s, d)),
        "source_count": lambda s, d: counts.source_count(t.sources(s, d)),
        "tag_counts": lambda s, d: counts.tag_counts(t.library(s, d)).select(
            "tag", "cnt", F.expr(f"first_seen div {values.POSITIONS}").alias("first_seq"),
            F.expr(f"cast(first_seen % {values.POSITIONS} as bigint)").alias("first_pos"),
        ),
        "folder_name": lambda s, d: counts.folder_name(t.sources(s, d), "src3"),
        "view_active": _view(("id", "title", "url"), sort=None),
        "view_folder": _view(("id", "title", "url"), folder="src3"),
        "view_language": _view(("id", "title"), language="en"),
        "view_language_other": _view(("id", "detected_language"), language="other"),
        "view_tag": _view(("id", "title"), tag="quality"),
        "view_first_50": _view(("id", "title"), limit=50),
        "view_combined": _view(("id", "score"), folder="src3", language="en", query="tion"),
        "search_keywords": _view(("id", "score"), query="tion the"),
        "search_phrase": _view(("id", "score"), query='"of the"'),
        "search_link": _view(("id", "score"), query=search.domain_query("example.com")),
        "search_favorites": _view(("id", "score"), query="is:fav tion"),
        "search_favorites_only": _view(("id", "score"), query="is:♥"),
        "sort_newer": _ranked_view(("id", "seq"), sort="newer"),
        "sort_older": _ranked_view(("id", "seq"), sort="older"),
        "sort_relevance": _ranked_view(("id", "score"), query="tion the"),
        "sort_random": _view(("id",), sort="random", seed=7),
        "trash_list": lambda s, d: search.ranked(search.trash(t.library(s, d)).select("id", "deleted_at")),
        "point_lookup": lambda s, d: t.library(s, d).where(F.col("id") == TARGET).select("id", "title"),
        "all_selected": _all_selected,
        "select_all": _view(("id",), language="en", sort=None),
        "words": lambda s, d: _all_words(s, d).groupBy("word").agg(F.count("*").alias("cnt")),
        "stems": lambda s, d: _all_words(s, d).distinct().select("word", tx.stem("word").alias("stem")),
        "legacy_tokens": lambda s, d: terms.token_counts(terms.legacy_tokens(t.texts(s, d))),
        "detect_language": lambda s, d: t.texts(s, d).select(
            "id", tx.detect_language(tx.analysis_text(F.col("title"), F.col("article_preview"))).alias("language")
        ),
        "term_frequency": lambda s, d: terms.postings(t.texts(s, d)).where(F.col("term").isNotNull()),
        "cloud_term_counts": _cloud_term_counts,
        "keyword_pair_counts": _pairs,
        "collocations": lambda s, d: rounded(phrases.collocations(phrases.neighbours(search.active(tables.library(s, d)))), "ratio"),
        "phrase_counts": lambda s, d: phrases.phrases(search.active(tables.library(s, d))),
        "search_indexed": _indexed,
        "zh_words": _learnt_words,
        "idf_table": lambda s, d: rounded(terms.idf_table(t.texts(s, d)), "idf"),
        "word_cloud": lambda s, d: rounded(terms.word_cloud(search.active(t.library(s, d))), "size_ratio"),
        "matches_per_word": _matches,
        "most_similar_tf": _like_target("tf"),
        "most_similar_tfidf": _like_target("tfidf"),
        "most_similar_auto": _auto,
        "pair_similarity": lambda s, d: rounded(
            similarity.pair_similarity(t.texts(s, d), TARGET, "11"), "score"
        ),
        "graph_nodes": lambda s, d: graph.graph_nodes(_picked(s, d)).withColumn("tags", F.array_join("tags", "|")),
        "graph_domains": lambda s, d: graph.graph_domains(graph.graph_nodes(_picked(s, d))),
        "graph_edges_tf": lambda s, d: rounded(graph.graph_edges(_picked(s, d)), "value"),
        "graph_edges_tfidf": lambda s, d: rounded(graph.graph_edges(_picked(s, d), weighting="tfidf"), "value"),
        "graph_degree": _degrees,
        "graph_edges_at": _edges_at,
        "graph_neighbours": lambda s, d: rounded(neighbours.graph_at_scale(search.active(tables.library(s, d)))[0], "value"),
        "graph_neighbours_tfidf": lambda s, d: rounded(
            neighbours.graph_at_scale(search.active(tables.library(s, d)), weighting="tfidf")[0], "value"
        ).drop("dst"),
        "graph_components": lambda s, d: neighbours.graph_at_scale(search.active(tables.library(s, d)))[1],
        "graph_focus": lambda s, d: graph.in_graph(_picked(s, d), TARGET).select("seq", "id"),
    }


def raw_list(spark: SparkSession, d: str) -> DataFrame:
    """The articles as an unknown list: other names, ids for labelled ones only, numeric stars."""
    rows = tables.library(spark, d)
    labels = tables.table(spark, d, "labels").select(F.col("doc_id").alias("seq"), "quality")
    return rows.join(labels, "seq", "left").select(
        "seq",
        F.when(F.col("quality").isNotNull(), F.col("id")).alias("Bookmark_ID"),
        F.col("title").alias("Name"),
        F.nullif("url", F.lit("#")).alias("Link"),
        F.col("article_preview").alias("Excerpt"),
        F.concat_ws(",", "detected_language", "source_file_id").alias("Tags"),
        F.col("quality").alias("Starred"),
        F.col("source_file_id").alias("list"),
    )


def _normalized(spark, d):
    raw = raw_list(spark, d)
    fields = {n: f for n, f in ingest.fields_of(raw).items() if n not in ("seq", "list")}
    return ingest.normalize(raw, fields, F.col("list"), F.concat("list", F.lit(".csv")), F.lit(False), keep=("seq",))


def _normalized_rows(spark, d):
    rows = _normalized(spark, d).where(ingest.has_url())
    return rows.select(
        "id",
        "seq",
        "title",
        "url",
        F.md5("article_preview").alias("preview_md5"),
        F.md5("content").alias("content_md5"),
        "source_file_id",
        "source_file_name",
        "detected_language",
        F.array_join("tags", "|").alias("tags"),
        "instapaper_url",
        "provider",
        "is_favorite",
    )


def _url_less(spark, d):
    rows = _normalized(spark, d).groupBy("source_file_id")
    return rows.agg(
        F.count_if(ingest.has_url()).alias("imported"), F.count_if(~ingest.has_url()).alias("dropped_no_url")
    )


def incoming(spark: SparkSession, d: str) -> DataFrame:
    """An import made of ``pages`` (known ids) and ``events`` (one id per user, repeated many times)."""

    def record(rows, record_id, in_seq, title, url, star):
        return rows.select(
            record_id.alias("id"),
            in_seq.cast("bigint").alias("in_seq"),
            title.alias("title"),
            url.alias("url"),
            F.lit("").alias("article_preview"),
            F.lit("").alias("content"),
            F.lit("import").alias("source_file_id"),
            F.lit("import.csv").alias("source_file_name"),
            F.lit("en").alias("detected_language"),
            F.array().cast("array<string>").alias("tags"),
            F.lit("").alias("instapaper_url"),
            F.lit("instapaper").alias("provider"),
            F.lit(None).cast("string").alias("deleted_at"),
            star.alias("is_favorite"),
        )

    kind = F.col("event_type")
    pages = record(
        tables.table(spark, d, "pages"),
        F.col("page_id").cast("string"),
        F.col("page_id"),
        F.concat(F.lit("page "), "url"),
        F.col("url"),
        F.lit(None).cast("boolean"),
    )
    events = record(
        tables.table(spark, d, "events"),
        F.concat(F.lit("user"), "user_id"),
        F.col("event_id") + 1_000_000_000,
        kind,
        F.concat(F.lit("https://users.example/"), "user_id"),
        F.when(kind == "click", True).when(kind == "error", False),
    )
    return pages.unionByName(events)


def _merged(spark, d):
    rows = merge.merge(tables.library(spark, d), incoming(spark, d))
    star = F.coalesce("is_favorite", F.lit(False)).alias("is_favorite")
    return rows.select("id", "seq", "title", "url", "source_file_id", "deleted_at", star)


def _labelled(spark, d, quality):
    rows = tables.table(spark, d, "labels").where(F.col("quality") == quality)
    return rows.select(F.col("doc_id").cast("string").alias("id"))


def _trashed(spark, d):
    rows = merge.trash_rows(tables.library(spark, d), _labelled(spark, d, 0), "2024-06-01T00:00:00.000Z")
    return rows.select("id", "deleted_at")


def _replaced(spark, d):
    rows, _ = merge.replace_source(tables.library(spark, d), tables.sources(spark, d), "src3", incoming(spark, d))
    return rows.groupBy("source_file_id").agg(F.count("*").alias("cnt"))


def _favorite_flags(spark, d):
    labels = tables.table(spark, d, "labels")
    quality = F.col("quality")
    return labels.select(
        "doc_id",
        ingest.favorite_flag(quality, labels.schema["quality"].dataType).alias("from_number"),
        ingest.favorite_flag(F.when(quality == 1, " Yes ").otherwise("no"), T.StringType()).alias("from_text"),
    )


PROJECTED = ("ID", "Title", "preview", "Unknown", "tags", "favorite")
SQLITE_COLUMNS = ("id", "title", "url", "article_preview", "tags", "is_favorite", "note")


def source_table(spark: SparkSession, d: str, kind: str = "csv", profile: str = "unified") -> DataFrame:
    """The sources with all their columns, as CSV lists or as SQLite databases."""
    rows = tables.sources(spark, d).withColumns({"type": F.lit(kind), "profile": F.lit(profile)})
    if kind == "sqlite":
        names = F.array(*[F.lit(c) for c in SQLITE_COLUMNS])
        rows = rows.withColumn("sqlite_layout", F.struct(F.lit("articles").alias("table"), names.alias("columns")))
        rows = rows.withColumn("name", F.concat("id", F.lit(".sqlite")))
    for f in SOURCES.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    return rows.select(*SOURCES.names)


def _prepared(spark, path, profile="unified"):
    return imports.prepare(spark, [path], profile, source_id=lambda name: "file_fixed")


def _imported(prepared):
    return prepared.incoming.select(
        "id",
        "in_seq",
        "title",
        "url",
        F.md5("article_preview").alias("preview_md5"),
        F.array_join("tags", "|").alias("tags"),
        "is_favorite",
        "source_file_id",
        "source_file_name",
        "detected_language",
        "instapaper_url",
    )


def _csv_export(spark, d):
    folder = shared_folder(spark)
    exports.write_unified_csv(tables.library(spark, d), folder)
    return folder + "/*.csv"


def _json_round_trip(spark, d):
    folder = shared_folder(spark)
    exports.write_unified_json(tables.library(spark, d), source_table(spark, d), folder, rows_per_file=5000)
    return _imported(_prepared(spark, folder + "/*.json")).drop("in_seq")


def _sqlite_round_trip(spark, d):
    folder = shared_folder(spark)
    made = exports.sqlite_databases(tables.library(spark, d), source_table(spark, d, "sqlite"), 5000)
    exports.write_files(made, folder)
    return _imported(_prepared(spark, folder, "scraper")).drop("in_seq", "source_file_id", "source_file_name")


def _sqlite_databases(spark, d):
    made = exports.sqlite_databases(tables.library(spark, d), source_table(spark, d, "sqlite"), 1000)
    return made.select("source_file_id", "part", (F.octet_length("content") > 0).alias("filled"))


def _save_back(spark, d):
    (folder,) = exports.save_back(
        tables.library(spark, d), source_table(spark, d, profile="scraper"), shared_folder(spark)
    )
    schema = "id string, title string, url string, article_preview string, content string, tags string"
    rows = (
        spark.read.options(header=True, multiLine=True, escape='"')
        .schema(schema + ", source_file_id string")
        .csv(folder)
    )
    return rows.groupBy("source_file_id").agg(
        F.count("*").alias("cnt"), F.sum(F.length("content")).alias("content_chars"), F.min("id").alias("lowest_id")
    )


def _stored(spark, d):
    root = shared_folder(spark)
    store.save(tables.library(spark, d), source_table(spark, d), root)
    rows, _ = store.load(spark, root)
    return rows.select("id", "seq", "title", F.md5("content").alias("content_md5"), "is_favorite", "deleted_at")


def _import_report(spark, d):
    totals = imports.totals(tables.library(spark, d), _prepared(spark, _csv_export(spark, d)))
    return totals.select("imported", "parse_errors", "dropped_no_url", "failed", "displaced")


def _file(spark, path: str, data: bytes) -> str:
    """A small file beside those that are made of the tables."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(data))
    out.close()
    return path


def _lists_of_pages(spark, d, row, per_file: int) -> str:
    """The pages as CSV files with the columns id, url and title, every line as ``row`` writes it.

    Files of a folder go by path, so their numbers are padded: path order is page order.
    """
    pages = tables.table(spark, d, "pages").withColumn("file", F.lpad(F.floor(F.col("page_id") / per_file).cast("string"), 12, "0"))
    lines = pages.select("file", "page_id", row.alias("line"))
    heads = pages.select("file").distinct().select("file", F.lit(-1).cast("bigint").alias("page_id"), F.lit("id,url,title").alias("line"))
    folder = shared_folder(spark)
    dealt = lines.unionByName(heads).repartition("file").sortWithinPartitions("file", "page_id")
    dealt.select("file", "line").write.partitionBy("file").text(folder)
    exports.as_lists(spark, folder)
    return folder


def _mixed_report(spark, d):
    """Good and ragged lists beside files that fail: each for itself, the others go on."""
    page = F.col("page_id")
    url = F.when(page % 10 != 3, F.col("url")).otherwise("")
    row = F.concat(page.cast("string"), F.lit(","), url, F.lit(","), F.md5("html"), F.when(page % 10 == 0, ",one too many").otherwise(""))
    folder, good = shared_folder(spark), _lists_of_pages(spark, d, row, 50)
    odd = {
        "zero.csv": b"", "zero.json": b"", "broken.json": b'[{"id": 1, "url": "https://a.example", ', "notes.txt": b"no list", "head.csv": b"id,url,title\n",
        "wide.csv": "id,url,title\n1,https://a.example,t\n".encode("utf-16"), "official.csv": b"URL,Title,Selection,Folder,Timestamp\nhttps://a.example,t,,f,1\n",
        "mine.csv": b"id,url,title\n1,https://a.example,t\n",
    }
    paths = [_file(spark, f"{folder}/{name}", data) for name, data in odd.items()]
    known = source_table(spark, d).limit(1).withColumn("name", F.lit("mine.csv"))
    prepared = imports.prepare(spark, [*paths, good], sources=known, source_id=lambda name: f"file_{name}", on_collision=imports.REFUSE)
    totals = imports.totals(tables.library(spark, d), prepared)
    return totals.withColumn("failed_names", F.array_join("failed_names", ","))


def _quoted_split(spark, d):
    """The pages' markup, line ends and all, in quotes; every hundredth line has a cell too many."""
    quoted = F.concat(F.lit('"'), F.replace(F.concat(F.lit("first\nsecond "), "html"), F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat(F.col("page_id").cast("string"), F.lit(","), "url", F.lit(","), quoted, F.when(F.col("page_id") % 100 == 50, ",more").otherwise(""))
    prepared = _prepared(spark, _lists_of_pages(spark, d, row, 1000), "scraper")
    rows = prepared.incoming.select("id", "in_seq", F.md5("title").alias("title_md5"))
    return rows.withColumn("parse_errors", prepared.report.agg(F.sum("parse_errors")).scalar())


def _array_split(spark, d):
    """The pages as one array on one line for its records, braces and quotes in their titles; every hundredth record is no JSON."""
    pages = tables.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), "url", F.concat(F.lit('"}, {"'), "html").alias("title"), "page_id")
    ends = pages.agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    record = F.to_json(F.struct("id", "url", "title"))
    record = F.when(F.col("page_id") % 100 == 50, F.concat(F.lit('{"none" '), F.substr(record, F.lit(2)))).otherwise(record)
    before = F.when(F.col("page_id") == F.col("first"), "[").otherwise(",")
    line = F.concat(before, record, F.when(F.col("page_id") == F.col("last"), "]").otherwise(""))
    folder = shared_folder(spark)
    pages.join(F.broadcast(ends)).orderBy("page_id").select(line.alias("line")).write.option("lineSep", " ").text(folder)
    exports.join_parts(spark, folder, folder + ".json")
    prepared = _prepared(spark, folder + ".json", "scraper")
    rows = prepared.incoming.select("id", "in_seq", F.md5("title").alias("title_md5"))
    return rows.withColumn("parse_errors", prepared.report.agg(F.sum("parse_errors")).scalar())


def _header_verdicts(spark, d):
    return _prepared(spark, _csv_export(spark, d), "scraper").report.select("verdict", "suggested").distinct()


def _streamed(spark, d):
    root = shared_folder(spark)
    pages = tables.table(spark, d, "pages")
    # Every other file has its ids as numbers, the first too: its number 0 counts as no id.
    values = F.col("url").alias("link"), F.md5("html").alias("title")
    text, number = F.struct(F.col("page_id").cast("string").alias("uid"), *values), F.struct(F.col("page_id").alias("uid"), *values)
    rows = pages.select(F.floor(F.col("page_id") / 100).alias("file"), text.alias("text"), number.alias("number"))
    groups = rows.groupBy("file").agg(F.collect_list("text").alias("texts"), F.collect_list("number").alias("numbers"))
    groups.select(F.when(F.col("file") % 2 == 0, F.to_json("numbers")).otherwise(F.to_json("texts"))).write.option("maxRecordsPerFile", 1).text(root + "/in")
    drop_folder.import_folder(spark, root + "/in", root + "/library", root + "/log").awaitTermination()
    rows, _ = store.load(spark, root + "/library")
    return rows.select("id", "title", "url", "source_file_id", "instapaper_url")


def _journal_of(spark, d):
    held = journal.Journal(spark, shared_folder(spark), 16)
    held.create(tables.library(spark, d))
    return held


def _journal_merged(spark, d):
    """The import of ``merge_upsert`` as a change in the journal, half of its buckets compacted."""
    held = _journal_of(spark, d)
    held.put(incoming(spark, d))
    held.set_favorite(["no such id"], True)
    held.compact(1)
    star = F.coalesce("is_favorite", F.lit(False)).alias("is_favorite")
    return held.library().select("id", "seq", "title", "url", "source_file_id", "deleted_at", star)


def _journal_changes(spark, d):
    """Trash, stars, restoring and tombstones, one over the other, then an import that brings some back."""
    held = _journal_of(spark, d)
    held.trash(_labelled(spark, d, 0), "2024-06-01T00:00:00.000Z")
    held.set_favorite(_labelled(spark, d, 0), True)
    held.restore(_labelled(spark, d, 1))
    held.purge(tables.page_list(spark, d).where(F.col("seq") % 3 == 0).select("id"))
    held.put(incoming(spark, d).where(F.col("source_file_id").isNotNull() & ~F.col("id").startswith("user") & (F.col("in_seq") % 6 == 0)))
    return held.library().select("id", "title", "deleted_at", F.coalesce("is_favorite", F.lit(False)).alias("is_favorite"))


def _kept_counts(spark, d):
    """Counts kept through an import, tombstones and the trash."""
    held = _journal_of(spark, d)
    first = held.latest()
    kept = kept_counts.counted(held.library(first))
    held.put(incoming(spark, d))
    held.purge(tables.page_list(spark, d).where(F.col("seq") % 3 == 0).select("id"))
    last = held.trash(_labelled(spark, d, 0), "2024-06-01T00:00:00.000Z")
    return kept_counts.updated(kept, *held.changes(first, last), held.library(last))


def _stream_files(spark, d):
    """The pages as files: every fifth is cut short, and every tenth page has no address."""
    pages = tables.table(spark, d, "pages").withColumn("file", F.floor(F.col("page_id") / 20))
    url = F.when(F.col("page_id") % 10 != 3, F.col("url")).alias("url")
    record = F.struct(F.concat(F.lit("p"), "page_id").alias("id"), url, F.md5("html").alias("title"))
    texts = pages.groupBy("file").agg(F.to_json(F.sort_array(F.collect_list(record))).alias("text"))
    cut = F.when(F.col("file") % 5 == 4, F.substr("text", F.lit(1), F.length("text") - 20)).otherwise(F.col("text"))
    folder = shared_folder(spark)
    texts.select("file", cut.alias("text")).repartition("file").write.partitionBy("file").text(folder)
    return folder


def _streamed_changes(spark, d):
    root = shared_folder(spark)
    held = journal.Journal(spark, root + "/library", 16)
    files = _stream_files(spark, d) + "/*"
    drop_folder.import_changes(spark, files, held, root + "/log", files_per_batch=7).awaitTermination()
    return held


def _stream_counts(spark, d):
    told = drop_folder.report(spark, _streamed_changes(spark, d))
    return told.select(F.regexp_extract("file", "file=([0-9]+)", 1).cast("bigint").alias("file"), "imported", "dropped_no_url", "broken")


def _mixed_files(spark, d):
    """The pages as JSON documents that disagree: ids as number or text, tags as list or text, stars as number, text or flag."""
    pages = tables.table(spark, d, "pages").withColumn("file", F.floor(F.col("page_id") / 100))
    tag, odd = F.substr(F.md5("url"), F.lit(1), F.lit(8)), F.col("page_id") % 2
    listed, text = F.array(F.lit("page"), tag).alias("tags"), F.concat(F.lit("page,"), tag).alias("tags")
    kinds = [
        (listed, odd.alias("is_favorite")),
        (text, F.when(odd == 1, "Yes").otherwise("0").alias("starred")),
        (listed, (odd == 1).alias("favorite")),
    ]
    folder = shared_folder(spark)
    for n, kind in enumerate(kinds):
        # Page 0 has a number, which counts as no id.
        uid = F.col("page_id").cast("bigint" if n == 0 else "string").alias("id")
        record = F.struct(uid, "url", F.md5("html").alias("title"), *kind)
        files = pages.where(F.col("file") % len(kinds) == n).groupBy("file")
        made = files.agg(F.sort_array(F.collect_list(record)).alias("bookmarks")).select("bookmarks")
        made.write.option("maxRecordsPerFile", 1).json(f"{folder}/{n}")
    return folder


def _record_values(rows):
    return rows.select("id", "title", "url", F.array_join("tags", "|").alias("tags"), "is_favorite")


def _mixed_import(spark, d):
    return _record_values(_prepared(spark, _mixed_files(spark, d) + "/*/*.json").incoming)


def _mixed_stream(spark, d):
    root = shared_folder(spark)
    drop_folder.import_folder(spark, _mixed_files(spark, d) + "/*", root + "/library", root + "/log").awaitTermination()
    return _record_values(store.load(spark, root + "/library")[0])


LISTED = [str(k) for k in range(0, 400, 7)] + [None]


def _profiles(spark, d):
    seq = F.col("seq")
    given = F.when(seq % 3 == 0, "scraper").when(seq % 3 == 1, "odd")
    fallback = F.when(seq % 2 == 0, "unified").otherwise("?")
    return tables.texts(spark, d).select("seq", ingest.profile_or_default(given, fallback).alias("profile"))


def _fallback_ids(spark, d):
    raw = raw_list(spark, d)
    fields = {n: f for n, f in ingest.fields_of(raw).items() if n not in ("seq", "list")}
    fallback = F.concat(F.lit("row-"), F.col("seq"))
    rows = ingest.normalize(raw, fields, F.col("list"), F.col("list"), F.lit(False), fallback_id=fallback, keep=("seq",))
    return rows.select("seq", "id", "instapaper_url")


def _clashing_files(spark, d):
    """A file for each source, a second one of that name for every fifth; what every other source's stamped name is, is taken."""
    own = tables.sources(spark, d).select("id", "pos", "name").where(F.col("id") != "unused")
    again = own.where(F.col("pos") % 5 == 0).withColumn("pos", F.col("pos") + 1_000_000)
    files = own.unionByName(again).select(F.concat("id", F.lit("-"), "pos").alias("file"), "pos", "name")
    stamped = own.where(F.col("pos") % 2 == 0).select("id", F.concat("id", F.lit("_5.csv")).alias("name"))
    return files, own.select("id", "name").unionByName(stamped)


def _unique_names(spark, d):
    files, sources = _clashing_files(spark, d)
    return ingest.unique_names(files, sources, 5).select("file", "name")


def _same_names(spark, d):
    files, sources = _clashing_files(spark, d)
    return ingest.same_name(files, sources).select("file", "name", "source_id")


DIALECTS = [(";", "\n"), ("\t", "\r\n"), (None, None), ("|", "\n")]
LAYOUTS = [["id", "Title", "URL", "note", "tags"], ["uid", "link", "id", "url", "title", "content"]]


def _laid_out(spark, d, kind: str) -> DataFrame:
    """The sources with dialects and layouts that differ."""
    rows = source_table(spark, d, kind, "scraper")
    dialects = F.array(*[F.struct(F.lit(a).cast("string").alias("delimiter"), F.lit(b).cast("string").alias("linebreak")) for a, b in DIALECTS])
    layouts = F.array(*[F.array(*[F.lit(c) for c in names]) for names in LAYOUTS])
    return rows.withColumns(
        {"csv_dialect": dialects[(F.col("pos") % len(DIALECTS)).cast("int")], "csv_columns": layouts[(F.col("pos") % len(LAYOUTS)).cast("int")]}
    )


def _csv_layouts(spark, d):
    """Sources saved back in their dialects and layouts, and what an import finds these to be."""
    folders = exports.save_back(tables.library(spark, d), _laid_out(spark, d, "csv"), shared_folder(spark))
    prepared = imports.prepare(spark, folders, "scraper")
    ends = F.when(F.col("csv_dialect.linebreak") == "\r\n", "crlf").otherwise("lf")
    found = prepared.sources.select("csv_dialect.delimiter", ends.alias("line_end"), F.array_join("csv_columns", ",").alias("columns")).distinct()
    counted = {c: prepared.report.agg(F.sum(c)).scalar() for c in ("imported", "parse_errors")}
    return found.withColumns(counted)


def _save_back_json(spark, d):
    folders = exports.save_back(tables.library(spark, d), _laid_out(spark, d, "json"), shared_folder(spark))
    schema = "source_file_id string, id string, title string, url string, tags string, content string"
    rows = spark.read.schema(schema).json(folders[0])
    for folder in folders[1:]:
        rows = rows.unionByName(spark.read.schema(schema).json(folder))
    return rows.select("source_file_id", "id", F.md5(F.coalesce("title", F.lit(""))).alias("title_md5"), "tags")


def _kept_both(spark, d):
    """Lists called like sources that are there already, kept beside them."""
    folder = shared_folder(spark)
    body = F.concat(F.lit("id,url,title\n"), F.col("id"), F.lit(",https://a.example/"), "id", F.lit(","), "id")
    lists = tables.sources(spark, d).where(F.col("id") != "unused").select("id", body.alias("text"))
    lists.repartition("id").write.partitionBy("id").text(folder)
    exports.as_lists(spark, folder)
    names = spark.read.text(folder).select(F.col("_metadata.file_name").alias("name")).distinct()
    known = names.select(F.md5("name").alias("id"), F.lit(0).cast("bigint").alias("pos"), "name")
    known = known.withColumns({f.name: F.lit(None).cast(f.dataType) for f in SOURCES.fields if f.name not in known.columns}).select(*SOURCES.names)
    prepared = imports.prepare(spark, [folder], "scraper", sources=known, on_collision=imports.KEEP_BOTH)
    fresh = prepared.sources.join(names, "name", "left_anti").agg(F.count("*")).scalar()
    return prepared.incoming.select("id", "url", "title").withColumn("fresh_names", fresh)


def _json_document(spark, d):
    path = shared_folder(spark) + ".json"
    exports.write_unified_document(tables.library(spark, d), source_table(spark, d), path)
    return _imported(_prepared(spark, path))


def _similar_kept(spark, d):
    """Two targets over postings that were made once."""
    rows = tables.texts(spark, d).withColumn("url", F.lit("#"))
    corpus = written_once(terms.postings(rows))
    found = [similarity.most_similar(rows, t, weighting=w, corpus=corpus).withColumn("target", F.lit(t)) for t, w in ((TARGET, "tf"), (TARGET, "tfidf"), ("11", "tf"))]
    return rounded(found[0].unionByName(found[1]).unionByName(found[2]), "score").select("target", "id", "seq", "score")


def _in_han(spark, d):
    rows = _written_in_han(spark, d)
    return terms.cloud_counts(terms.cloud_terms(terms.cloud_surfaces(rows, "grouped"), "grouped")).select("word", "cnt")


def _similar_among(spark, d):
    rows = tables.library(spark, d)
    found = similarity.most_similar(rows, TARGET, candidates=search.favorites(rows))
    return rounded(found, "score").select("id", "seq", "score")


def covering_queries() -> dict:
    """Operators that no other query runs, or only on its easiest case."""
    t = tables
    return {
        "purge_id_list": lambda s, d: merge.purge_rows(t.library(s, d), LISTED).select("id", "seq"),
        "restore_id_list": lambda s, d: merge.restore_rows(t.library(s, d), LISTED).select("id", "deleted_at"),
        "profile_coercion": _profiles,
        "fallback_ids": _fallback_ids,
        "percent": lambda s, d: t.texts(s, d).select("seq", values.percent(F.col("seq") % 997 / 996).cast("bigint").alias("percent")),
        "source_ids": lambda s, d: t.sources(s, d).select("name", ids.new_source_id(F.col("name")).alias("source_id")),
        "unique_names": _unique_names,
        "same_names": _same_names,
        "csv_layouts": _csv_layouts,
        "save_back_json": _save_back_json,
        "import_keep_both": _kept_both,
        "delete_source_list": lambda s, d: merge.delete_source(t.library(s, d), t.sources(s, d), "src3")[1].select("id", "pos", "name"),
        "clear_library": lambda s, d: merge.clear(t.library(s, d))[0].agg(F.count("*").alias("cnt")),
        "most_similar_among": _similar_among,
        "most_similar_kept": _similar_kept,
        "json_document": _json_document,
        "han_languages": lambda s, d: terms.document_words(_written_in_han(s, d)).groupBy("language").agg(F.count("*").alias("cnt")),
        "han_words": lambda s, d: _written_in_han(s, d)
        .select(F.explode_outer(tx.words(tx.analysis_text(F.col("title"), F.col("article_preview")))).alias("word"))
        .where(F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.count("*").alias("cnt")),
        "han_keyword_counts": _in_han,
        "sort_title": lambda s, d: search.ranked(search.view(t.library(s, d), sort="title_asc").select("id", "title")),
    }


def write_queries() -> dict:
    """Ingest rules, changes to the library, exports and round trips through files."""
    t = tables

    return {
        "stable_id": lambda s, d: t.page_list(s, d).select(
            "id", ids.stable_id(F.col("url"), F.lit("pages")).alias("stable_id")
        ),
        "normalize_rows": _normalized_rows,
        "url_less_counts": _url_less,
        "favorite_flag": _favorite_flags,
        "reader_url": lambda s, d: t.page_list(s, d).select(
            "id",
            web.reader_url(F.lit("instapaper"), F.col("id")).alias("reader"),
            web.reader_url(F.lit("other"), F.col("id")).alias("none"),
        ),
        "page_domain": lambda s, d: t.page_list(s, d).select(
            "id",
            web.domain(F.col("url")).alias("domain"),
            web.display_domain(F.concat(F.lit("/"), "url")).alias("shown"),
        ),
        "safe_url": lambda s, d: t.library(s, d).select("id", web.safe_url(F.col("url")).alias("safe")),
        "escape_html": lambda s, d: t.table(s, d, "pages").select(
            "page_id", F.md5(web.escape_html(F.col("html"))).alias("escaped_md5")
        ),
        "harden_cells": lambda s, d: t.library(s, d).select(
            "id",
            F.md5(web.harden_cell(F.col("content"))).alias("content_md5"),
            web.harden_cell(F.concat(F.lit("="), "id")).alias("formula"),
            web.harden_cell(F.array_join("tags", ",")).alias("tags"),
        ),
        "node_labels": lambda s, d: t.library(s, d).select("id", values.node_label(F.col("title")).alias("label")),
        "deleted_labels": lambda s, d: t.library(s, d).select(
            "id", values.deleted_at_label(F.col("deleted_at")).alias("label")
        ),
        "source_types": lambda s, d: t.library(s, d).select(
            "id",
            ingest.type_from_name(F.col("source_file_name")).alias("type"),
            ingest.type_from_name(F.col("url")).alias("none"),
        ),
        "merge_upsert": _merged,
        "displaced_count": lambda s, d: merge.displaced(t.library(s, d), incoming(s, d)),
        "trash_ids": _trashed,
        "restore_ids": lambda s, d: merge.restore_rows(t.library(s, d), _labelled(s, d, 1)).select("id", "deleted_at"),
        "purge_ids": lambda s, d: merge.purge_rows(t.library(s, d), _labelled(s, d, 0)).select("id", "seq"),
        "empty_trash": lambda s, d: merge.empty_trash(t.library(s, d)).select("id", "seq"),
        "set_favorite": lambda s, d: merge.set_favorite(t.library(s, d), _labelled(s, d, 0), True).select(
            "id", "is_favorite"
        ),
        "toggle_favorite": lambda s, d: merge.toggle_favorite(t.library(s, d), TARGET).select("id", "is_favorite"),
        "delete_source": lambda s, d: merge.delete_source(t.library(s, d), t.sources(s, d), "src3")[0].select(
            "id", "source_file_id"
        ),
        "replace_source": _replaced,
        "export_projection": lambda s, d: columns.project(t.library(s, d), PROJECTED).withColumn(
            "preview", F.md5("preview")
        ),
        "exported_sources": lambda s, d: exports.exported_sources(t.library(s, d), t.sources(s, d)).select("id", "name"),
        "unified_csv_rows": lambda s, d: exports.csv_rows(search.active(t.library(s, d))).select(
            "id",
            F.md5("title").alias("title_md5"),
            F.md5("article_preview").alias("preview_md5"),
            "tags",
            "is_favorite",
        ),
        "unified_json_documents": lambda s, d: exports.unified_documents(
            t.library(s, d), source_table(s, d), 400
        ).select(
            F.size("sources").alias("sources"),
            F.size("bookmarks").alias("bookmarks"),
            "version",
            F.element_at("bookmarks", 1)["id"].alias("first_id"),
        ),
        "unmapped_columns": lambda s, d: exports.unmapped_report(source_table(s, d, "sqlite")).select("id", "unmapped"),
        "csv_round_trip": lambda s, d: _imported(_prepared(s, _csv_export(s, d))),
        "json_round_trip": _json_round_trip,
        "sqlite_round_trip": _sqlite_round_trip,
        "sqlite_databases": _sqlite_databases,
        "save_back_csv": _save_back,
        "store_round_trip": _stored,
        "import_report": _import_report,
        "import_mixed_report": _mixed_report,
        "csv_quoted_split": _quoted_split,
        "json_array_split": _array_split,
        "header_verdicts": _header_verdicts,
        "stream_import": _streamed,
        "json_mixed_types": _mixed_import,
        "stream_mixed": _mixed_stream,
        "store_merge": _journal_merged,
        "store_changes": _journal_changes,
        "kept_counts": _kept_counts,
        "stream_import_counts": _stream_counts,
        "stream_changes": lambda s, d: _streamed_changes(s, d).library().select("id", "title", "url", "source_file_id"),
    }


def all_queries() -> dict:
    return read_queries() | write_queries() | covering_queries()
