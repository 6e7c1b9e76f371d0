"""Learnt words, collocations and the search index against plain accounts of them."""

import itertools
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import lexicon, phrases, search, search_index, terms
from marginalia.schema import LIBRARY

WORDS = ["機器", "學習", "資料庫", "今天", "天氣", "人工智慧"]


def sentences(n, seed=1):
    draw = random.Random(seed)
    fill = [chr(0x5000 + 37 * k) for k in range(40)]
    return ["".join(draw.choice(WORDS) if draw.random() < 0.5 else draw.choice(fill) for _ in range(20)) for _ in range(n)]


def test_lexicon_finds_the_words(spark, library):
    rows = library(*[{"title": s} for s in sentences(150)], {"title": "plain words"}, {"title": ""})
    counts = lexicon.grams(lexicon.runs(rows))
    told = lexicon.statistics(counts)
    words = lexicon.learnt(told)
    assert set(WORDS) <= {r["word"] for r in words.collect()}
    # Parts of words never stand alone, so their surroundings do not vary.
    assert not {"資料", "料庫", "人工", "工智", "人工智"} & {r["word"] for r in words.collect()}
    chars = counts.where("n = 1").agg(F.sum("cnt")).first()[0]
    cut = lexicon.segmenter(words, chars)
    line = library({"title": "今天人工智慧學習 spark 資料庫"}, {"title": "only latin here"}, {"title": None, "article_preview": None})
    found = {r["seq"]: r["words"] for r in terms.document_words(line, cut).collect()}
    assert found == {0: ["今天", "人工智慧", "學習", "spark", "資料庫"], 1: ["only", "latin", "here"], 2: []}


def test_grams_and_entropies(spark, library):
    rows = library({"title": "甲乙丙甲乙"}, {"title": "乙甲"}, {"title": "甲"})
    counts = {r["gram"]: r["cnt"] for r in lexicon.grams(lexicon.runs(rows), 2).collect()}
    plain = Counter(m[i : i + n] for m in ("^甲乙丙甲乙$", "^乙甲$", "^甲$") for n in (1, 2, 3) for i in range(len(m) - n + 1))
    assert counts == {g: c for g, c in plain.items() if g not in "^$"}
    told = {r["gram"]: r for r in lexicon.statistics(lexicon.grams(lexicon.runs(rows), 2), 2).collect()}
    assert told["甲乙"]["information"] == pytest.approx(math.log(2 * 8 / 4 / 3))
    assert told["甲乙"]["before"] == pytest.approx(math.log(2)) and told["甲乙"]["behind"] == pytest.approx(math.log(2))


def test_grams_of_a_long_run(spark):
    # A run that is never broken, characters outside the basic plane among it; a text is gone through once, not once for every place.
    draw = random.Random(7)
    run = "".join(draw.choice("甲乙丙\U00020000\U00020001") for _ in range(60_000))
    began = time.time()
    counts = {r["gram"]: r["cnt"] for r in lexicon.grams(spark.createDataFrame([(run,), ("甲",)], "run string")).collect()}
    assert time.time() - began < 30
    plain = Counter(m[i : i + n] for m in (f"^{run}$", "^甲$") for n in range(1, 6) for i in range(len(m) - n + 1))
    assert counts == {g: c for g, c in plain.items() if g not in "^$"}


def test_best_path_is_the_cheapest():
    draw = random.Random(4)
    for _ in range(300):
        alphabet = "abc"
        costs = {"".join(draw.choice(alphabet) for _ in range(draw.randint(1, 3))): draw.uniform(0.5, 6) for _ in range(8)}
        run = "".join(draw.choice(alphabet) for _ in range(draw.randint(1, 9)))

        def price(words):
            return sum(costs.get(w, 7.0 if len(w) == 1 else math.inf) for w in words)

        every = []
        for ends in itertools.product([0, 1], repeat=len(run) - 1):
            cuts = [0, *[i + 1 for i, e in enumerate(ends) if e], len(run)]
            every.append([run[a:b] for a, b in itertools.pairwise(cuts)])
        found = lexicon.best_path(run, costs, 7.0, 3)
        assert "".join(found) == run and price(found) == pytest.approx(min(map(price, every)))


def test_pairs_where_nothing_was_learnt(spark):
    assert lexicon.segmenter(spark.createDataFrame([], "word string, cnt long"), 10) is tx.words


def test_phrases(spark, library):
    draw = random.Random(2)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(10) for b in range(10)]
    rows = []
    for k in range(120):
        text = [draw.choice(words) for _ in range(12)]
        if k % 3 == 0:
            text[4:4] = ["support", "vector", "machine"]
        elif k % 3 == 1:
            text[6:6] = ["vector", "space"]
        rows.append({"title": " ".join(text)})
    rows.append({"title": "", "article_preview": "the of and"})
    table = library(*rows)
    known = {(r["a"], r["b"]): r for r in phrases.collocations(phrases.neighbours(table)).collect()}
    assert {("support", "vector"), ("vector", "machine"), ("vector", "space")} <= set(known)
    assert all(r["ratio"] >= phrases.SIGNIFICANT and r["cnt"] >= 2 for r in known.values())
    found = {r["phrase"]: r["cnt"] for r in phrases.phrases(table).collect()}
    whole = [p for p in found if "support vector machine" in p]
    assert sum(found[p] for p in whole) == 40 and sum(c for p, c in found.items() if "vector space" in p) == 40
    # Its parts are not counted beside the longest phrase.
    assert "support vector" not in found and "vector machine" not in found


def test_index_reads_only_files_that_can_answer(spark, library, tmp_path):
    rows = library(*[{"id": str(k), "title": f"title {k}", "article_preview": "needle Öl" if k == 30 else None, "url": f"https://s{k % 4}.org/x", "source_file_id": f"s{k % 4}", "tags": ["Tag One"] if k % 9 == 0 else None} for k in range(60)])
    root, path = str(tmp_path / "a b"), str(tmp_path / "index")
    rows.repartition(6, "id").write.parquet(root)
    stored = spark.read.schema(LIBRARY).parquet(root)
    search_index.build(stored, path)
    every = stored.select("_metadata.file_path").distinct().count()
    assert every > 1
    for query in ("needle", "öl needle", '"needle öl"', "link:s2.org title", "tag", "ab", "is:fav", "", None, "nothing like it", "needle nothing"):
        want = {(r["id"], r["score"]) for r in search.view(stored, query=query, sort=None).collect()}
        assert {(r["id"], r["score"]) for r in search_index.view(spark, path, stored, query, sort=None).collect()} == want
    assert len(search_index.candidates(spark, path, "needle")) == 1 and search_index.candidates(spark, path, "ab") is None
    assert len(search_index.view(spark, path, stored, "needle", sort=None).inputFiles()) == 1


def test_texts_are_split_once_for_collocations(library):
    rows = library(*[{"title": "large data joins", "article_preview": "large data flows"}] * 3)
    found = [phrases.collocations(phrases.neighbours(rows), 0.0), phrases.phrases(rows, 0.0)]
    assert [f._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") for f in found] == [0, 0]


def test_index_of_a_very_long_text(spark, library, tmp_path):
    library({"title": "x" * 400_000 + " needle"}).write.parquet(str(tmp_path / "rows"))
    began = time.time()
    search_index.build(spark.read.schema(LIBRARY).parquet(str(tmp_path / "rows")), str(tmp_path / "index"))
    assert time.time() - began < 30
    assert len(search_index.candidates(spark, str(tmp_path / "index"), "needle")) == 1
