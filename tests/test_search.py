import pytest
from conftest import ids

from marginalia.operators import counts, search


def texts(query):
    return [(t["text"], t["exact"], t["url_only"], t["favorite"]) for t in search.search_terms(query)]


@pytest.mark.parametrize(
    "query, expected",
    [
        ("", []),
        (None, []),
        ("Foo bar", [("foo", False, False, False), ("bar", False, False, False)]),
        ('"foo bar', [('"foo', False, False, False), ("bar", False, False, False)]),
        ('foo "" bar', [("foo", False, False, False), ("bar", False, False, False)]),
        ("link:", [("link:", False, False, False)]),
        ('link:""', [("link:", False, False, False)]),
        ('link:"Exact Phrase"', [("exact phrase", True, True, False)]),
        ("LINK:example.com", [("example.com", False, True, False)]),
        ('"Exact Phrase" x', [("exact phrase", True, False, False), ("x", False, False, False)]),
        ("is:unread", [("is:unread", False, False, False)]),
        ("is:fav", [("fav", False, False, True)]),
        ("IS:♥ x", [("♥", False, False, True), ("x", False, False, False)]),
        ("is:favorite", [("fav", False, False, True), ("orite", False, False, False)]),
    ],
)
def test_query_forms(query, expected):
    assert texts(query) == expected


@pytest.fixture(scope="module")
def shelf(library):
    return library(
        {"id": "10", "title": "Alpha", "tags": ["beta"], "url": "https://alpha.org", "source_file_id": "f1"},
        {"id": "9", "title": "alpha beta", "article_preview": "gamma", "detected_language": "zh", "is_favorite": True},
        {"id": "x", "title": "中文", "tags": [" news ", "News"], "detected_language": None, "is_favorite": None},
        {"id": "20", "title": "banana", "deleted_at": "2024-01-01", "tags": ["news"]},
        {"id": "21", "title": "Apple", "deleted_at": "", "url": "https://beta.example/alpha"},
        {"id": "22", "title": "late", "deleted_at": "2024-02-01"},
    )


def test_scores_and_relevance(shelf):
    rows = search.view(shelf, query="alpha beta").select("id", "score").collect()
    assert [tuple(r) for r in rows] == [("10", 21), ("9", 20), ("21", 6)]
    assert ids(search.view(shelf, query="link:beta")) == ["21"]
    assert ids(search.view(shelf, query="is:fav alpha")) == ["9"]
    assert ids(search.view(shelf, query='"alpha beta"')) == ["9"]


def test_filters(shelf):
    assert ids(search.view(shelf)) == ["10", "9", "x", "21"]
    assert ids(search.view(shelf, folder="f1")) == ["10"]
    assert ids(search.view(shelf, language="zh")) == ["9"]
    assert ids(search.view(shelf, language="other")) == ["x"]
    assert ids(search.view(shelf, tag="news")) == []
    assert ids(search.view(shelf, tag=" news ")) == ["x"]
    assert ids(search.trash(shelf)) == ["22", "20"]


def test_orders(shelf):
    assert ids(search.view(shelf, sort="newer")) == ["21", "10", "9", "x"]
    assert ids(search.view(shelf, sort="older", limit=2)) == ["9", "10"]
    assert ids(search.view(shelf, sort="title_asc")) == ["x", "10", "9", "21"]
    assert ids(search.view(shelf, sort="title_desc")) == ["21", "9", "10", "x"]
    first = ids(search.view(shelf, sort="random", seed=1))
    assert sorted(first) == ["10", "21", "9", "x"] and first == ids(search.view(shelf, sort="random", seed=1))


def test_selection(shelf, spark):
    view = search.view(shelf, sort=None)
    some = spark.createDataFrame([("10",), ("9",)], "id string")

    def chosen(rows, marks):
        return search.all_selected(rows, marks).first()[0]

    assert not chosen(view, some)
    assert chosen(search.view(shelf, folder="f1"), some)
    assert not chosen(search.view(shelf, folder="none"), some)


def test_counts(shelf, spark):
    tags = counts.tag_counts(shelf).orderBy("first_seen").select("tag", "cnt").collect()
    assert [tuple(r) for r in tags] == [("beta", 1), ("news", 2), ("News", 1)]
    assert tuple(counts.trash_split(shelf).first()) == (4, 2)
    sources = spark.createDataFrame([("f1", 0, "one"), ("none", 1, "two")], "id string, pos long, name string")
    assert {tuple(r) for r in counts.folder_counts(shelf, sources).collect()} == {("f1", "one", 1), ("none", "two", 0)}
    assert counts.folder_name(sources, "f1").first()[0] == "one"
    assert counts.folder_name(sources, "?").first()[0] == "unknown"
    assert counts.folder_name(sources, None).first()[0] == "all"


def test_domains(library):
    rows = library(
        {"url": "https://www.example.com"}, {"url": "https://other.org/"}, {"url": "http://example.com/x"}, {"url": "#"},
        {"url": "https://third.net"},
    )
    found = counts.domain_share(rows).select("domain", "cnt", "share").collect()
    assert [tuple(r) for r in found] == [("example.com", 2, 100), ("other.org", 1, 50), ("third.net", 1, 50)]
    assert counts.domain_share(rows, 1).count() == 1
