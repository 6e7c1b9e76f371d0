import math
from collections import Counter

import pytest

from marginalia.operators import graph, similarity, terms


def cloud(rows, **options):
    return [(r["word"], r["cnt"]) for r in terms.word_cloud(rows, **options).collect()]


def test_plain_cloud(library):
    rows = library({"title": "Running runs ends", "article_preview": "the time, Zebra's zebra zebra"}, {"title": "run runs 42"})
    assert cloud(rows) == [("run", 3), ("zebra", 3), ("runn", 1), ("end", 1)]
    sizes = [r["size_ratio"] for r in terms.word_cloud(rows).collect()]
    assert sizes[0] == 2.25 and sizes[-1] == pytest.approx(0.75 + 1.5 / 3)
    assert cloud(rows, limit=1) == [("run", 3)]


def test_cloud_adds_up_languages(library):
    rows = library(
        {"title": "machine learning AI"}, {"title": "AI 人工智能 AI 機器學習"}, {"title": "robots Robot robots 人工智能"}
    )
    found = dict(cloud(rows))
    assert found["ai"] == 3
    # Grouped under one stem and shown as the commoner surface; both documents count.
    assert found["robots"] == 3 and "robot" not in found
    assert found["人工"] == 2


def test_grouped_cloud(library):
    found = dict(cloud(library({"title": "machine learning and machine learning models models"}), mode="grouped"))
    assert found["machine learning"] == 2 and found["models"] == 2 and found["learning models"] == 1
    assert "models models" not in found and "learning and" not in found


def test_keyword_keys(library):
    rows = library({"title": "machines learned, learned the dog's 42 zebras"}, {"title": "AI 人工智能 的 robots 42"}, {"title": ""}, {"title": "the"})
    found = terms.cloud_terms(terms.cloud_surfaces(rows, "grouped"), "grouped").collect()
    assert sorted((r["key"], r["display"], r["cnt"]) for r in found) == [
        ("ai", "ai", 1), ("dog'", "dog's", 1), ("learn", "learned", 2), ("machin", "machines", 1), ("machin learn", "machines learned", 1),
        ("robot", "robots", 1), ("zebra", "zebras", 1), ("人工", "人工", 1), ("工智", "工智", 1), ("智能", "智能", 1)]


def test_statistics(library):
    rows = library({"title": "rare common common"}, {"title": "common"}, {"title": ""})
    found = {r["term"]: (r["df"], r["idf"]) for r in terms.idf_table(rows).collect()}
    assert found["common"] == (2, pytest.approx(math.log(2)))
    assert found["rare"] == (1, pytest.approx(math.log(2.5)))
    postings = {(r["seq"], r["term"]): r["tf"] for r in terms.postings(rows).collect()}
    assert postings[(0, "common")] == 2 and (2, None) in postings


WORDS = "ai briefing news update".split()
FILLER = "apple banana cherry date fig grape kiwi lemon mango olive orange papaya plum quince walnut".split()


def corpus(library):
    generic = [{"id": f"g{n}", "title": " ".join([*WORDS, w])} for n, w in enumerate(("zebra", "giraffe", "tiger", "lion", "wolf", "bear"))]
    filler = [{"id": f"f{n}", "title": f"{w} {w}tree"} for n, w in enumerate(FILLER)]
    return library(
        {"id": "t", "title": "ai briefing news update quantum entanglement"},
        *generic,
        {"id": "d", "title": "quantum entanglement study"},
        *filler,
        {"id": "e", "title": ""},
    )


def brute_force(rows, target, weighting):
    documents = {r["id"]: Counter() for r in rows.collect()}
    seqs = {r["seq"]: r["id"] for r in rows.collect()}
    for r in terms.postings(rows).collect():
        if r["term"] is not None:
            documents[seqs[r["seq"]]][r["term"]] = r["tf"]
    frequency = Counter(t for d in documents.values() for t in d)
    weight = {t: math.log(1 + len(documents) / (1 + n)) if weighting == "tfidf" else 1 for t, n in frequency.items()}

    def cosine(a, b):
        dot = sum(a[t] * b[t] * weight[t] ** 2 for t in a)
        size = math.sqrt(sum((a[t] * weight[t]) ** 2 for t in a)) * math.sqrt(sum((b[t] * weight[t]) ** 2 for t in b))
        return dot / size if size else 0.0

    scored = [(i, cosine(documents[target], d)) for i, d in documents.items() if i != target]
    return sorted(scored, key=lambda x: -x[1])


@pytest.mark.parametrize("weighting", ["tf", "tfidf"])
@pytest.mark.parametrize("parts", [similarity.FREQUENT_TERM_PARTS, 20])
def test_similarity_against_brute_force(library, monkeypatch, weighting, parts):
    # With 20 parts the commonest words go by broadcast and the others by shuffle.
    monkeypatch.setattr(similarity, "FREQUENT_TERM_PARTS", parts)
    rows = corpus(library)
    wanted = brute_force(rows, "t", weighting)
    found = similarity.most_similar(rows, "t", top=50, weighting=weighting).collect()
    assert [(r["id"], pytest.approx(r["score"])) for r in found] == wanted


def test_similarity_without_broadcast(library, monkeypatch):
    monkeypatch.setattr(similarity, "BROADCAST_TERMS", 0)
    rows = corpus(library)
    found = similarity.most_similar(rows, "t", top=50).collect()
    assert [(r["id"], pytest.approx(r["score"])) for r in found] == brute_force(rows, "t", "tf")


def test_automatic_mix(library):
    rows = corpus(library)
    generic = similarity.most_similar_auto(rows, "t").collect()
    assert generic[0]["id"] == "d" and generic[0]["share"] > 0.7 and generic[0]["mode"] == "tfidf"
    distinctive = similarity.most_similar_auto(rows, "d").collect()
    assert distinctive[0]["share"] < 0.3 and distinctive[0]["mode"] == "tf"
    small = similarity.most_similar_auto(rows.where("seq < 5"), "t").collect()
    assert small[0]["share"] == 0 and small[0]["mode"] == "tf" and len(small) == 4


def test_candidates_and_pairs(library):
    rows = library({"id": "a", "title": "one stone", "deleted_at": "x"}, {"id": "b", "title": "stone"}, {"id": "c", "title": "fish"})
    live = rows.where("deleted_at is null")
    found = similarity.most_similar(rows, "a", candidates=live).collect()
    assert [r["id"] for r in found] == ["b", "c"] and found[1]["score"] == 0
    assert similarity.pair_similarity(rows, "a", "b").first()[0] == similarity.pair_similarity(rows, "b", "a").first()[0]


def edges(rows, **options):
    found = graph.graph_edges(rows, **options).orderBy("src", "dst").collect()
    return [(r["src"], r["dst"], round(r["value"], 6)) for r in found]


def test_graph(library):
    rows = library(
        {"title": "alpha beta", "article_preview": "gamma delta"},
        {"title": "alpha beta", "article_preview": "gamma delta"},
        {"title": "deep fur", "article_preview": "fast hat", "url": "https://www.x.org/"},
        {"title": "alpha beta", "article_preview": "eager blue"},
    )
    assert edges(rows) == [(0, 1, 1.0), (0, 3, 0.5), (1, 3, 0.5)]
    assert edges(rows, threshold=1.0) == [] and edges(rows, threshold=0.999) == [(0, 1, 1.0)]
    nodes = graph.graph_nodes(rows)
    degrees = graph.node_degrees(nodes, graph.graph_edges(rows)).orderBy("seq").collect()
    assert [r["degree"] for r in degrees] == [2, 2, 0, 2]
    assert {r[0] for r in graph.graph_domains(nodes).collect()} == {"unknown", "x.org"}
    assert graph.first_nodes(rows, 2).count() == 2
    assert graph.edges_at(graph.graph_edges(rows), 3).count() == 2
    assert graph.in_graph(rows, "3").count() == 1 and graph.in_graph(rows, "9").count() == 0


def test_weighted_graph_drops_generic_links(library):
    private = ["zebra giraffe penguin walrus", "koala tiger lion horse", "mouse rabbit fox bear", "goat sheep deer camel",
               "snake eagle hawk owl", "shark whale salmon trout"]
    rows = library(
        *[{"title": f"ai briefing {p}"} for p in private], {"title": "quantum entanglement paper"}, {"title": "quantum entanglement study"}
    )
    assert len(edges(rows)) == 16
    assert [e[:2] for e in edges(rows, weighting="tfidf")] == [(6, 7)]


def test_more_documents_are_more_tasks(library, monkeypatch):
    monkeypatch.setattr(terms, "TASK_DOCUMENTS", 2)
    assert terms.postings(library(*[{"title": "large joins"}] * 20)).rdd.getNumPartitions() == 10
