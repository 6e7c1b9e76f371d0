"""What the plans look like: what reaches the scan, and what is moved."""

import re

import pytest

from marginalia.operators import envelope, merge, search, similarity, terms
from marginalia.plans import imports
from marginalia.schema import SOURCES
from marginalia.sinks import store
from marginalia.sources import files, json_lists


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory, library):
    root = str(tmp_path_factory.mktemp("stored"))
    store.save(library(*[{"id": str(n), "title": f"word{n} other", "url": f"https://x{n}.org"} for n in range(20)]), spark.createDataFrame([], SOURCES), root)
    return store.load(spark, root)[0]


def columns_read(text):
    return {c for part in re.findall(r"ReadSchema: struct<(.*?)>", text) for c in re.findall(r"(\w+):", part)}


def test_view_filters_reach_the_scan(stored):
    text = plan(search.view(stored, folder="s", language="other", query="is:fav", sort=None).select("id"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    for wanted in ("EqualTo(source_file_id,s)", "IsNull(deleted_at)", "EqualTo(is_favorite,true)", "IsNull(detected_language)"):
        assert wanted in pushed
    assert "Exchange" not in text
    assert columns_read(text) == {"id", "source_file_id", "detected_language", "is_favorite", "deleted_at"}


def test_limited_view_does_not_sort_everything(stored):
    text = plan(search.view(stored, sort="newer", limit=50).select("id"))
    assert "TakeOrderedAndProject" in text and "Exchange rangepartitioning" not in text


def test_postings_move_once(stored):
    text = plan(terms.postings(stored))
    assert text.count("Exchange") == 1 and "hashpartitioning(seq" in text
    assert columns_read(text) == {"seq", "title", "article_preview"}


def test_texts_are_split_once(stored):
    # A plain explode would repeat the splitting in a pushed-down filter.
    text = plan(terms.cloud_surfaces(stored))
    assert not re.search(r"Filter .*regexp_extract_all", text)


def test_words_are_judged_after_counting(stored):
    text = plan(terms.cloud_terms(terms.cloud_surfaces(stored)))
    below = text[text.index("Exchange") :]
    assert "herself" not in below


def test_keywords_are_judged_and_cut_once(stored):
    text = plan(terms.cloud_terms(terms.cloud_surfaces(stored, "grouped"), "grouped"))
    above, below = text[: text.index("Exchange")], text[text.index("Exchange") :]
    assert below.count("herself") == 1
    # The parts of a pair are columns; stems name these, and no condition works out a stem.
    assert len(re.findall("(?i)split|substring_index", above)) == 2
    assert not re.search(r"Filter .*EndsWith", above)


def test_plain_similarity_moves_texts_once(stored):
    text = plan(similarity._tf_scores(terms.postings(stored), similarity.target_vector(stored, "1")))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "hashpartitioning(term" not in text


def test_small_import_does_not_move_the_library(spark, stored):
    new = stored.where("seq < 2").withColumnRenamed("seq", "in_seq")
    text = plan(merge.merge(stored, new))
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text


def test_rows_are_not_dealt_by_their_file(spark, tmp_path):
    # One file may hold all rows there are; what is known of a file goes to its rows.
    (tmp_path / "a.json").write_text('[{"id": "1", "url": "https://a.org", "source_file_id": "s"}, {"id": "2", "url": "https://b.org"}]')
    (tmp_path / "b.csv").write_text("id,title,url\n3,t,https://c.org\n")
    listing = files.listed(spark, [str(tmp_path)], "unified")
    table = spark.createDataFrame([tuple(f[n] for n in ("file", "pos", "name", "type", "profile", "id")) for f in listing], files.FILES)
    (part,) = json_lists.scan(spark, [f for f in listing if f["type"] == "json"]).parts
    frames = [part.rows, envelope.with_owner(part.rows, table, part.fields), imports.prepare(spark, [str(tmp_path)], "unified").incoming]
    for frame in frames:
        assert "SortMergeJoin [_file" not in plan(frame)
