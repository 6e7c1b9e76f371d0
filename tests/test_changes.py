import pytest
from pyspark.sql import functions as F

from marginalia.operators import merge
from marginalia.schema import LIBRARY


@pytest.fixture(scope="module")
def incoming(spark):
    def build(*records):
        rows = []
        for n, record in enumerate(records):
            row = {f.name: "" for f in LIBRARY.fields} | {"tags": [], "seq": n, "is_favorite": None, "deleted_at": None} | record
            rows.append(tuple(row[f.name] for f in LIBRARY.fields))
        return spark.createDataFrame(rows, LIBRARY).withColumnRenamed("seq", "in_seq")

    return build


def shelf(library):
    return library({"id": "a", "title": "old a", "is_favorite": True}, {"id": "b", "title": "old b", "deleted_at": "2024"}, {"id": "c", "is_favorite": True})


def titles(frame):
    return {r["id"]: (r["seq"], r["title"], bool(r["is_favorite"]), r["deleted_at"]) for r in frame.collect()}


def test_merge(library, incoming):
    new = incoming(
        {"id": "n2", "title": "x"}, {"id": "b", "title": "new b"}, {"id": "a", "title": "first a"}, {"id": "n1", "title": "n1", "is_favorite": True},
        {"id": "a", "title": "last a"}, {"id": "n2", "title": "last n2"}, {"id": "c", "title": "new c", "is_favorite": False},
    )
    assert titles(merge.merge(shelf(library), new)) == {
        "a": (0, "last a", True, None),
        "b": (1, "new b", False, None),
        "c": (2, "new c", False, None),
        "n2": (3, "last n2", False, None),
        "n1": (6, "n1", True, None),
    }
    assert merge.displaced(shelf(library), new).first()[0] == 1


def test_merge_again_changes_nothing(library, incoming):
    new = incoming({"id": "z", "title": "z"}, {"id": "a", "title": "again"})
    once = merge.merge(shelf(library), new)
    assert titles(merge.merge(once, new)) == titles(once)
    empty = library().select("*")
    assert titles(merge.merge(empty, new)) == {"z": (0, "z", False, None), "a": (1, "again", False, None)}


def test_merge_of_one_hot_id(library, spark, incoming):
    base = incoming({"id": "hot", "title": "t"})
    many = base.drop("in_seq", "title").crossJoin(spark.range(20000).select(F.col("id").alias("in_seq"), F.col("id").cast("string").alias("title")))
    found = titles(merge.merge(shelf(library), many.unionByName(base.withColumn("in_seq", F.lit(-1).cast("long")))))
    assert found["hot"][1] == "19999"


def test_marks(library, spark):
    rows = shelf(library)
    named = spark.createDataFrame([("a",), ("b",), ("a",), ("none",)], "id string")
    for chosen in (named, ["a", "b"]):
        assert {r["id"]: r["deleted_at"] for r in merge.trash_rows(rows, chosen, "now").collect()} == {"a": "now", "b": "2024", "c": None}
        assert merge.restore_rows(rows, chosen).where("deleted_at is not null").count() == 0
        assert [r["id"] for r in merge.purge_rows(rows, chosen).collect()] == ["c"]
        assert {r["id"]: r["is_favorite"] for r in merge.set_favorite(rows, chosen, False).collect()} == {"a": False, "b": False, "c": True}
    assert merge.purge_rows(rows, []).count() == 3
    assert merge.purge_rows(rows, [str(n) for n in range(2000)] + ["a"]).count() == 2
    assert [r["id"] for r in merge.empty_trash(rows).orderBy("seq").collect()] == ["a", "c"]
    toggled = merge.toggle_favorite(rows, "a").collect()
    assert [r["is_favorite"] for r in toggled if r["id"] == "a"] == [False]
    assert not any(r["is_favorite"] for r in merge.toggle_favorite(rows, "b").collect() if r["id"] == "b")


def test_sources(library, spark, incoming):
    rows = library({"id": "1", "source_file_id": "s1"}, {"id": "2", "source_file_id": "s2", "deleted_at": "x"})
    sources = spark.createDataFrame([("s1",), ("s2",)], "id string")
    left, listed = merge.delete_source(rows, sources, "s2")
    assert left.count() == 1 and listed.count() == 1
    with pytest.raises(ValueError):
        merge.replace_source(rows, sources, "s1", incoming().limit(0))
    replaced, _ = merge.replace_source(rows, sources, "s1", incoming({"id": "9", "source_file_id": "s3"}))
    assert {r["id"] for r in replaced.collect()} == {"2", "9"}
    assert [t.count() for t in merge.clear(rows)] == [0, 0]
