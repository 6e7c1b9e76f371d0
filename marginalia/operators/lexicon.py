"""Words of Chinese and Japanese texts by a lexicon that is learnt from the corpus itself.

What characters stand together is counted once, for runs of up to LONGEST + 1 characters with their ends marked. A run of characters is a
word if its parts meet more often than chance (the least mutual information over all ways to cut it in two), and if what stands
before and behind it varies (the entropy of its neighbours). A text is then cut along the best path through all words that it
could be cut into, the one of the highest product of word frequencies; characters that are in no word stand for themselves.
"""

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..scratch import written_once

# Characters of a word at most; how often a word has to stand, how much its parts belong together and how much its surroundings vary.
LONGEST = 4
LEAST_COUNT, LEAST_INFORMATION, LEAST_ENTROPY = 5, 2.0, 0.7

# Words of a lexicon, the most frequent ones: what is broadcast has a bound.
WORDS = 200_000

# Stand for the ends of a run; no text has them in a run.
BEFORE, BEHIND = "^", "$"

_RUN = re.compile(tx.HAS_CJK)


def runs(library: DataFrame) -> DataFrame:
    """(seq, run): the runs of Han and kana of every article, in lower case like all words."""
    body = F.lower(tx.analysis_text(F.col("title"), F.col("article_preview")))
    rows = library.select("seq", body.alias("body")).where(tx.has_cjk(F.col("body")))
    return rows.select("seq", F.explode(F.regexp_extract_all("body", F.lit(f"({tx.CJK_RUN})"), F.lit(1))).alias("run"))


def grams(found: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(gram, n, cnt): how often every run of up to ``longest`` + 1 characters stands in the runs; their ends count as characters.

    The longest run from each place, or what is left there, is counted first, found in one pass over the text. Every shorter one that
    stands at a place begins the longest one there, so the others are summed from these counts.
    """
    marked = F.concat(F.lit(BEFORE), F.col("run"), F.lit(BEHIND))
    # An empty match at every character; the second half of a character outside the basic plane is no place.
    widest = F.regexp_extract_all(marked, F.lit(rf"(?s)(?=([^\uDC00-\uDFFF].{{0,{longest}}}))"), F.lit(1))
    places = found.select(F.explode(widest).alias("widest")).groupBy("widest").agg(F.count("*").alias("cnt"))
    pieces = places.select("cnt", F.explode(F.sequence(F.lit(1), F.length("widest"))).alias("n"), "widest")
    counts = pieces.groupBy(F.left("widest", "n").alias("gram")).agg(F.sum("cnt").alias("cnt"))
    return counts.select("gram", F.length("gram").alias("n"), "cnt").where(~F.col("gram").isin(BEFORE, BEHIND))


def _entropy(counts: DataFrame, part: Column, name: str) -> DataFrame:
    """(gram, name): the entropy of what stands at one side of each gram."""
    wider = counts.where(F.col("n") > 1).select(part.alias("gram"), "cnt")
    sums = wider.groupBy("gram").agg(F.sum("cnt").alias("total"), F.sum(F.col("cnt") * F.log("cnt")).alias("weighed"))
    return sums.select("gram", (F.log("total") - F.col("weighed") / F.col("total")).alias(name))


def statistics(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(gram, n, cnt, information, before, behind) of the grams of two characters or more, ends left out."""
    # Read many times below, counted once.
    counts = written_once(counts)
    plain = counts.where(~F.contains("gram", F.lit(BEFORE)) & ~F.contains("gram", F.lit(BEHIND)))
    # The number of characters, and single characters, are bounded by the script.
    total = plain.where(F.col("n") == 1).agg(F.sum("cnt")).scalar()
    single = F.broadcast(plain.where(F.col("n") == 1).select(F.col("gram").alias("part"), F.col("cnt").alias("part_cnt")))
    several = plain.where(F.col("n") > 1).select(F.col("gram").alias("part"), F.col("cnt").alias("part_cnt"))
    words = plain.where(F.col("n").between(2, longest)).withColumn("chars", total)
    cut = words.select("gram", "n", "cnt", "chars", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("at"))
    left, right = F.left(F.col("gram"), F.col("at")), F.substr("gram", F.col("at") + 1)

    def with_part(rows: DataFrame, part: Column, name: str) -> DataFrame:
        keyed = rows.withColumn("part", part)
        one = keyed.where(F.length("part") == 1).join(single, "part")
        more = keyed.where(F.length("part") > 1).join(several, "part")
        return one.unionByName(more).withColumnRenamed("part_cnt", name).drop("part")

    both = with_part(with_part(cut, left, "left_cnt"), right, "right_cnt")
    told = F.log(F.col("cnt").cast("double") * F.col("chars") / F.col("left_cnt") / F.col("right_cnt"))
    information = both.groupBy("gram", "n", "cnt").agg(F.min(told).alias("information"))
    size = F.length("gram")
    before, behind = _entropy(counts, F.substr("gram", F.lit(2)), "before"), _entropy(counts, F.left("gram", size - 1), "behind")
    return information.join(before, "gram").join(behind, "gram")


def learnt(
    found: DataFrame, count: int = LEAST_COUNT, information: float = LEAST_INFORMATION, entropy: float = LEAST_ENTROPY, limit: int = WORDS
) -> DataFrame:
    """(word, cnt): the words that ``statistics`` give away, the most frequent ``limit``."""
    fine = (F.col("cnt") >= count) & (F.col("information") >= information) & (F.least("before", "behind") >= entropy)
    return found.where(fine).select(F.col("gram").alias("word"), "cnt").orderBy(F.desc("cnt"), "word").limit(limit)


def best_path(run: str, costs: dict[str, float], unknown: float, longest: int) -> list[str]:
    """The cheapest way to cut a run into words of ``costs`` and single characters; of equal ones that with the longer first words."""
    least, size = [0.0] * (len(run) + 1), [1] * len(run)
    for at in range(len(run) - 1, -1, -1):
        least[at] = math.inf
        for n in range(1, min(longest, len(run) - at) + 1):
            cost = costs.get(run[at : at + n], unknown if n == 1 else math.inf) + least[at + n]
            if cost <= least[at]:
                least[at], size[at] = cost, n
    words, at = [], 0
    while at < len(run):
        words.append(run[at : at + size[at]])
        at += size[at]
    return words


def segmenter(words: DataFrame, chars: int) -> Callable[[Column], Column]:
    """A function like ``text.words`` that cuts runs along best paths through ``words`` (word, cnt), learnt from ``chars`` characters.

    Without a word learnt it is ``text.words`` itself, which takes overlapping pairs.
    """
    known = {r["word"]: r["cnt"] for r in words.collect()}  # at most WORDS
    if not known:
        return tx.words
    costs = words.sparkSession.sparkContext.broadcast({w: math.log(chars) - math.log(c) for w, c in known.items()})
    longest, unknown = max(map(len, known)), math.log(chars) + 1

    @F.pandas_udf("array<string>")
    def cut(pieces: pd.Series) -> pd.Series:
        table = costs.value
        out = []
        for listed in pieces:
            out.append([w for p in listed for w in (best_path(p, table, unknown, longest) if _RUN.match(p) else [p])])
        return pd.Series(out)

    def split(lowered: Column) -> Column:
        pieces = F.regexp_extract_all(lowered, F.lit(f"({tx.CJK_RUN}|{tx.WORD})"), F.lit(1))
        plain = F.regexp_extract_all(lowered, F.lit(tx.WORD), F.lit(1))
        # Texts without a run are not sent to Python with their words.
        marked = tx.has_cjk(lowered)
        return F.when(marked, cut(F.when(marked, pieces).otherwise(F.array().cast("array<string>")))).otherwise(plain)

    return split
