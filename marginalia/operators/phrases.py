"""Phrases of English articles: neighbouring words that stand together more often than chance has it.

One pass counts pairs of neighbouring content words; how often each word comes first or second follows from these counts. A
pair is a collocation if the log-likelihood ratio of its table against independence reaches SIGNIFICANT. A phrase is the longest run of words
of which all neighbours are collocations, and is counted as a whole, not in its parts.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..scratch import written_once
from .terms import document_words

# The ratio that one pair in a thousand reaches by chance, and how often a pair must stand somewhere.
SIGNIFICANT = 10.83
LEAST_COUNT = 2

# Keys with more than one part in this many of all rows are at most as many, and come by broadcast.
FREQUENT_PARTS = 200_000


def neighbours(library: DataFrame) -> DataFrame:
    """(seq, pos, a, b): different neighbouring content words of English articles, ``pos`` the place of the first."""
    listed = document_words(library).select("seq", F.when(F.col("language") == "en", tx.content_words("words")).alias("content"))
    following = F.slice(F.col("content"), 2, F.greatest(F.size("content"), F.lit(1)))
    both = F.zip_with("content", following, lambda a, b: F.when(a != b, F.struct(a.alias("a"), b.alias("b"))))
    # Outer, so that nothing is pushed below the splitting of the text.
    return listed.select("seq", F.posexplode_outer(both).alias("pos", "p")).where(F.col("p").isNotNull()).select("seq", "pos", "p.a", "p.b")


def _with_totals(counts: DataFrame, side: str, total: Column) -> DataFrame:
    """Counts of pairs with how often the word on one side stands there; a word in very many pairs is no large join group."""
    sums = counts.groupBy(side).agg(F.sum("cnt").alias(f"{side}_cnt"), F.count("*").alias("pairs"))
    many = F.col("pairs") * FREQUENT_PARTS > total
    common = F.broadcast(sums.where(many).drop("pairs"))
    rest = counts.join(common.select(side), side, "left_anti").join(sums.where(~many).drop("pairs"), side)
    return counts.join(common, side).unionByName(rest)


def _term(count: Column) -> Column:
    return F.when(count > 0, count * F.log(count)).otherwise(F.lit(0.0))


def collocations(pairs: DataFrame, least: float = SIGNIFICANT) -> DataFrame:
    """(a, b, cnt, ratio): the pairs that are collocations, from their occurrences."""
    # Read many times below, counted once.
    counts = written_once(pairs.groupBy("a", "b").agg(F.count("*").alias("cnt")))
    kinds = counts.agg(F.count("*")).scalar()
    told = _with_totals(_with_totals(counts, "a", kinds), "b", kinds).withColumn("n", counts.agg(F.sum("cnt")).scalar())
    both, a, b, n = (F.col(c).cast("double") for c in ("cnt", "a_cnt", "b_cnt", "n"))
    cells = _term(both) + _term(a - both) + _term(b - both) + _term(n - a - b + both)
    ratio = 2 * (cells - _term(a) - _term(n - a) - _term(b) - _term(n - b) + _term(n))
    scored = told.select("a", "b", "cnt", ratio.alias("ratio"), (both * n > a * b).alias("drawn"))
    return scored.where((F.col("ratio") >= least) & F.col("drawn") & (F.col("cnt") >= LEAST_COUNT)).drop("drawn")


def phrases(library: DataFrame, least: float = SIGNIFICANT) -> DataFrame:
    """(phrase, words, cnt, first_seq): the longest runs of collocations in all articles."""
    pairs = written_once(neighbours(library))
    known = written_once(collocations(pairs, least).select("a", "b", "cnt"))
    many = F.col("cnt") * FREQUENT_PARTS > pairs.agg(F.count("*")).scalar()
    common = F.broadcast(known.where(many).select("a", "b"))
    rare = known.where(~many).select("a", "b")
    found = pairs.join(common, ["a", "b"]).unionByName(pairs.join(common, ["a", "b"], "left_anti").join(rare, ["a", "b"]))
    # Places in a row differ from their rank by the same number.
    run = F.col("pos") - F.row_number().over(W.partitionBy("seq").orderBy("pos"))
    runs = found.withColumn("run", run).groupBy("seq", "run").agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b"))).alias("p"))
    words = F.concat(F.array(F.col("p")[0]["a"]), F.transform("p", lambda p: p["b"]))
    return (
        runs.select("seq", F.array_join(words, " ").alias("phrase"), F.size(words).alias("words"))
        .groupBy("phrase", "words")
        .agg(F.count("*").alias("cnt"), F.min("seq").alias("first_seq"))
    )
