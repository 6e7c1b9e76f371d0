"""Term statistics: postings, document frequencies and word clouds."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values
from ..functions.stopwords import BASE_EN, CLOUD_EN

# Words in a cloud, and the size of the rarest and the most frequent one.
CLOUD_WORDS = 60
SMALLEST_SIZE, SIZE_RANGE = 0.75, 1.5

# Documents whose words are counted by one task, in the mean: more documents are more tasks, not larger ones.
TASK_DOCUMENTS = 4_000


def _tasks(library: DataFrame) -> int:
    """How many tasks the documents are dealt to. Left to Spark, partitions would be joined until there is one for each core."""
    return max(-(-library.count() // TASK_DOCUMENTS), library.sparkSession.sparkContext.defaultParallelism)


def document_words(library: DataFrame, words=tx.words) -> DataFrame:
    """(seq, language, words): one row per document, words in text order, keyed by position.

    Raw text is moved before it is split: it is smaller than its words, and documents that lie in few
    row groups, or in groups of unlike size, are then split by all tasks. Take the words apart with an outer ``explode``: for the plain one Spark adds a condition on the
    list's size and pushes it to the scan, where every document would be split once more.
    """
    body = F.lower(tx.analysis_text(F.col("title"), F.col("article_preview")))
    lowered = library.select("seq", body.alias("body")).repartition(_tasks(library), "seq")
    text = F.col("body")
    return lowered.select("seq", tx.detect_language(text).alias("language"), words(text).alias("words"))


def postings(library: DataFrame, stop_words=BASE_EN, words=tx.words) -> DataFrame:
    """(seq, term, tf) of every document, keyed by its position.

    Noise words share one row with a null term, so a document without terms stays visible. The
    text is moved by ``seq`` once; counting terms, and any later sum per document, then
    needs no further exchange.
    """
    return (
        document_words(library, words)
        .select("seq", "language", F.explode_outer("words").alias("word"))
        .select("seq", "language", tx.without_possessive("word").alias("base"))
        .select("seq", tx.term("base", "language", stop_words).alias("term"))
        .groupBy("seq", "term")
        .agg(F.count("*").alias("tf"))
        # Tied to the count, so that no condition on terms is pushed below it: there it would be
        # checked, with all the work of finding the term, for every occurrence.
        .select("seq", F.when(F.col("tf") > 0, F.col("term")).alias("term"), "tf")
    )


def document_frequency(library_postings: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term occurs."""
    return library_postings.where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, documents: Column) -> Column:
    return F.log(F.lit(1.0) + documents / (F.lit(1) + df))


def idf_table(library: DataFrame, library_postings: DataFrame | None = None) -> DataFrame:
    """(term, df, idf); empty documents count as documents."""
    frequency = document_frequency(postings(library) if library_postings is None else library_postings)
    documents = library.agg(F.count("*")).scalar()
    return frequency.withColumn("idf", idf(F.col("df"), documents))


def legacy_tokens(library: DataFrame) -> DataFrame:
    """(seq, token) of the older tokenizer, one row per occurrence."""
    body = tx.analysis_text(F.col("title"), F.col("article_preview"))
    return (
        library.select("seq", F.explode_outer(tx.legacy_pieces(body)).alias("piece"))
        .where(F.length("piece") >= tx.SHORTEST_TERM)
        .select("seq", F.explode_outer(tx.legacy_tokens("piece")).alias("token"))
        .where(F.col("token").isNotNull())
    )


def token_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("cnt"))


def cloud_surfaces(library: DataFrame, mode: str = "plain", words=tx.words) -> DataFrame:
    """(language, surface, cnt, seen): the words of all documents, counted as they are written.

    Whatever a word costs to filter and stem is then paid once per distinct word.
    """
    listed = document_words(library, words)
    if mode == "grouped":
        # Content words are a column of their own, so that they are found once and not again for pairs.
        english = F.col("language") == "en"
        listed = listed.withColumn("words", F.when(english, tx.content_words("words")).otherwise(F.col("words")))
        listed = listed.withColumn("words", F.when(english, tx.keyword_surfaces("words")).otherwise(F.col("words")))
    return (
        listed.select("seq", "language", F.posexplode_outer("words").alias("pos", "surface"))
        .where(F.col("surface").isNotNull())
        .groupBy("language", "surface")
        .agg(F.count("*").alias("cnt"), F.min(values.first_seen("seq", "pos")).alias("seen"))
    )


def cloud_terms(surfaces: DataFrame, mode: str = "plain") -> DataFrame:
    """(grouped, key, display, cnt, seen): surfaces as cloud terms, noise left out.

    English documents give stems (``plain``) or content words and pairs (``grouped``). Documents in
    Chinese or Japanese are always grouped.
    """
    english = F.col("language") == "en"
    # A condition on words alone would be pushed below the counting, to every single occurrence; one
    # that also names the count is not.
    counted = F.col("cnt") > 0
    if mode == "plain":
        rows = surfaces.withColumn("base", tx.without_possessive("surface"))
        other = F.when(tx.is_cjk_keyword("surface", "language"), tx.cjk_keyword_key("surface"))
        rows = rows.withColumn("key", F.when(english, tx.term("base", "language", CLOUD_EN)).otherwise(other))
        return rows.select(
            (~english).alias("grouped"),
            F.when(counted, F.col("key")).alias("key"),
            F.when(english, F.col("key")).otherwise(F.col("surface")).alias("display"),
            "cnt",
            "seen",
        ).where(F.col("key").isNotNull())
    # Judged before there is a key: a condition on the key would work it out a second time.
    rows = surfaces.where(F.when(counted, F.col("surface").isNotNull() & (english | tx.is_cjk_keyword("surface", "language"))))
    first, second = tx.keyword_parts("surface")
    rows = rows.select(
        "language",
        "surface",
        "cnt",
        "seen",
        F.when(english, first).otherwise(F.col("surface")).alias("first"),
        F.when(english, second).alias("second"),
    )
    key = F.when(english, tx.keyword_key("first", "second")).otherwise(tx.cjk_keyword_key("first"))
    return rows.select(F.lit(True).alias("grouped"), key.alias("key"), F.col("surface").alias("display"), "cnt", "seen")


def cloud_counts(terms: DataFrame) -> DataFrame:
    """(word, cnt, seen): counts per displayed word, both kinds of terms added up.

    A group is shown as its most frequent surface. ``seen`` orders ties: grouped terms first, each
    kind by first appearance.
    """
    groups = (
        terms.repartition("grouped", "key")
        .groupBy("grouped", "key", "display")
        .agg(F.sum("cnt").alias("cnt"), F.min("seen").alias("seen"))
        .groupBy("grouped", "key")
        .agg(
            F.min_by("display", F.struct((-F.col("cnt")).alias("less"), "seen")).alias("display"),
            F.sum("cnt").alias("cnt"),
            F.min("seen").alias("seen"),
        )
    )
    earlier = F.struct((~F.col("grouped")).alias("plain"), "seen")
    return groups.groupBy(F.lower("display").alias("word")).agg(
        F.sum("cnt").alias("cnt"), F.min(earlier).alias("seen")
    )


def word_cloud(library: DataFrame, mode: str = "plain", limit: int = CLOUD_WORDS, words=tx.words) -> DataFrame:
    """The most frequent words with their display size."""
    counted = cloud_counts(cloud_terms(cloud_surfaces(library, mode, words), mode))
    top = counted.orderBy(F.desc("cnt"), "seen").limit(limit)
    largest = F.max("cnt").over(W.partitionBy())
    size = F.lit(SMALLEST_SIZE) + F.col("cnt") / largest * SIZE_RANGE
    return top.select("word", "cnt", size.alias("size_ratio"))
