"""Imports from real files, and exports back to them."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from marginalia.operators import ingest
from marginalia.plans import imports
from marginalia.schema import LIBRARY, SOURCES
from marginalia.sinks import exports, store
from marginalia.sources import csv_lists
from marginalia.streaming import drop_folder


def write(folder, name, text):
    with open(os.path.join(folder, name), "w", newline="", encoding="utf-8") as out:
        out.write(text)


def prepare(spark, folder, profile="scraper", **options):
    return imports.prepare(spark, [str(folder)], profile, source_id=lambda name: f"file_{name}", **options)


def report(prepared):
    return {r["name"]: r for r in prepared.report.collect()}


def incoming(prepared):
    return [r.asDict() for r in prepared.incoming.orderBy("in_seq").collect()]


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """One folder with every kind of file, prepared under the unified profile."""
    folder = tmp_path_factory.mktemp("mixed")
    write(folder, "a.csv", 'id;Title;url;preview;tags;starred\n1;t1;https://a.com;p;news,x;1\n\n2;"t;2 ""q""\nline";https://b.com;;;\n3;bad\n4;nourl;;p;;\n')
    write(folder, "b.csv", "﻿id,title,url,article_preview\r\n1,t1 again,https://a.com,\r\n,gen,https://example.com/a,=1\r\n")
    write(folder, "c.json", json.dumps([{"id": 7, "name": "N", "link": "https://l.com", "description": "d", "tags": "a, b,", "favorite": 2}, {"title": "none"}]))
    rows = [
        {"id": "u1", "title": "T", "url": "https://u.com", "source_file_id": "s1", "source_file_name": "row.csv", "tags": ["k"], "instapaper_url": "", "provider": "pocket"},
        {"id": "u2", "title": "T2", "url": "https://u2.com"},
        {"id": "u3", "title": "T3", "url": "https://u3.com", "source_file_id": "s2", "source_file_name": "two.db"},
    ]
    write(folder, "e.json", json.dumps({"format": "x", "version": 2, "sources": [{"id": "s1", "name": "one.csv", "type": "odd", "profile": "?"}], "bookmarks": rows}))
    db = sqlite3.connect(folder / "f.db")
    db.execute('CREATE TABLE "my list"(ID TEXT, title TEXT, url TEXT, article_preview TEXT, starred INTEGER)')
    db.execute('INSERT INTO "my list" VALUES (\'9\', \'深度學習\', \'https://z.com\', \'你好\', 0)')
    db.commit()
    db.close()
    write(folder, "g.txt", "x")
    write(folder, "h.csv", "URL,Title,Selection,Folder,Timestamp,Tags\nhttps://x.com,t,,f,1,\n")
    return prepare(spark, folder, "unified")


def test_mixed_report(mixed):
    found = report(mixed)
    assert {n: (r["imported"], r["parse_errors"], r["dropped_no_url"], r["failure"]) for n, r in found.items()} == {
        "a.csv": (2, 1, 2, None),
        "b.csv": (2, 0, 0, None),
        "c.json": (1, 0, 1, None),
        "e.json": (3, 0, 0, None),
        "f.db": (1, 0, 0, None),
        "g.txt": (0, 0, 0, "unsupported type"),
        "h.csv": (0, 0, 0, "unsupported source"),
    }
    assert found["a.csv"]["verdict"] == "mismatch" and found["a.csv"]["suggested"] == "scraper"
    assert found["e.json"]["verdict"] == "ok"


def test_mixed_rows(mixed):
    rows = incoming(mixed)
    assert [r["id"] for r in rows] == ["1", "2", "1", rows[3]["id"], "7", "u1", "u2", "u3", "9"]
    assert rows[3]["id"].startswith("gen_") and rows[3]["article_preview"] == "=1"
    assert rows[0]["tags"] == ["news", "x"] and rows[0]["is_favorite"] is True
    assert rows[1]["title"] == 't;2 "q"\nline' and rows[1]["is_favorite"] is False and rows[1]["content"] == ""
    assert rows[2]["is_favorite"] is None
    assert rows[4]["tags"] == ["a", " b", ""] and rows[4]["is_favorite"] is True and rows[4]["title"] == "N"
    assert (rows[5]["source_file_id"], rows[5]["source_file_name"], rows[5]["provider"], rows[5]["instapaper_url"]) == ("s1", "one.csv", "pocket", "")
    assert rows[6]["source_file_id"] == "file_e.json" and rows[6]["instapaper_url"].endswith("/u2")
    assert rows[7]["source_file_name"] == "two.db"
    assert rows[8]["detected_language"] == "zh" and rows[8]["is_favorite"] is False
    assert len({r["in_seq"] for r in rows}) == len(rows)


def test_mixed_sources(mixed):
    found = {r["id"]: r for r in mixed.sources.collect()}
    assert set(found) == {"file_a.csv", "file_b.csv", "file_c.json", "file_e.json", "file_f.db", "s1", "s2"}
    assert found["file_a.csv"]["csv_columns"] == ["id", "Title", "url", "preview", "tags", "starred"]
    assert tuple(found["file_a.csv"]["csv_dialect"]) == (";", "\n") and tuple(found["file_b.csv"]["csv_dialect"]) == (",", "\r\n")
    assert found["file_f.db"]["sqlite_layout"]["table"] == "my list"
    assert (found["s1"]["type"], found["s1"]["profile"]) == ("csv", "unified") and found["s2"]["type"] == "db"


def test_known_source_keeps_its_name(spark, tmp_path):
    write(tmp_path, "x.csv", "id,title,url,source_file_id,source_file_name\n1,t,https://a.com,s1,other.csv\n")
    sources = spark.createDataFrame([("s1", 0, "mine.csv")], "id string, pos long, name string")
    prepared = prepare(spark, tmp_path, "unified", sources=sources)
    assert incoming(prepared)[0]["source_file_name"] == "mine.csv"
    assert prepared.sources.count() == 0
    # Under the other profile the file is the source of its rows, whatever they say.
    assert incoming(prepare(spark, tmp_path))[0]["source_file_id"] == "file_x.csv"


def test_name_collisions(spark, tmp_path, library):
    write(tmp_path, "a.csv", "id,title,url\n1,new,https://a.com\n")
    write(tmp_path, "b.csv", "id,title,url\n5,none,\n")
    write(tmp_path, "c.csv", "id,title,url\n6,other,https://c.com\n")
    before = library(*[{"id": i, "title": "old", "source_file_id": s} for i, s in (("1", "sa"), ("2", "sa"), ("3", "sb"))])
    known = [("sa", 0, "a.csv"), ("sb", 1, "b.csv"), ("sx", 2, None)]
    sources = spark.createDataFrame([(*k, "csv", "scraper", None, None, None) for k in known], SOURCES)

    def run(choice):
        prepared = prepare(spark, tmp_path, sources=sources, on_collision=choice)
        rows, listed = imports.apply(before, sources, prepared)
        failed = {n: r["failure"] for n, r in report(prepared).items() if r["failure"]}
        return {(r["id"], r["title"], r["source_file_id"]) for r in rows.collect()}, {r["id"]: r["name"] for r in listed.collect()}, failed

    kept = {("3", "old", "sb"), ("6", "other", "file_c.csv")}
    rows, listed, failed = run("refuse")
    assert rows == kept | {("1", "old", "sa"), ("2", "old", "sa")} and set(listed) == {"sa", "sb", "sx", "file_c.csv"}
    assert set(failed) == {"a.csv", "b.csv"}
    # The old source goes with all its rows, but not for a file without a record.
    rows, listed, failed = run("overwrite")
    assert rows == kept | {("1", "new", "file_a.csv")} and set(listed) == {"file_a.csv", "sb", "sx", "file_c.csv"}
    assert set(failed) == {"b.csv"}
    rows, listed, failed = run("keep")
    assert rows == kept | {("1", "new", "file_a.csv"), ("2", "old", "sa")} and not failed
    assert listed["sa"] == "a.csv" and listed["file_a.csv"].startswith("a_") and listed["file_a.csv"].endswith(".csv")
    with pytest.raises(ValueError):
        run("ask")


def test_unique_names(spark):
    files = spark.createDataFrame([("f1", 0, "a.csv"), ("f2", 1, "a.csv"), ("f3", 2, ".hidden"), ("f4", 3, "new.csv")], "file string, pos long, name string")
    sources = spark.createDataFrame([("a.csv",), ("a_5_1.csv",), (".hidden",), (None,)], "name string")
    named = {r["file"]: r["name"] for r in ingest.unique_names(files, sources, 5).collect()}
    assert named == {"f1": "a_5.csv", "f2": "a_5_2.csv", "f3": ".hidden_5", "f4": "new.csv"}


def test_apply_and_totals(spark, mixed, library):
    before = library({"id": "1", "title": "old", "deleted_at": "2024", "is_favorite": True})
    totals = imports.totals(before, mixed).first()
    assert (totals["files"], totals["imported"], totals["failed"], totals["displaced"]) == (5, 9, 2, 1)
    assert totals["failed_names"] == ["g.txt", "h.csv"]
    rows, sources = imports.apply(before, spark.createDataFrame([], SOURCES), mixed)
    first = rows.where("id = '1'").first()
    assert (first["seq"], first["title"], first["deleted_at"], first["is_favorite"]) == (0, "t1 again", None, True)
    assert rows.count() == 8 and sources.count() == 7


@pytest.mark.parametrize(
    "line, expected",
    [
        ("id;title;url", (";", "\n", ["id", "title", "url"])),
        ("id\ttitle", ("\t", "\n", ["id", "title"])),
        ("id,title\r", (",", "\r\n", ["id", "title"])),
        ('"a;b;c",x', (",", "\n", ["a;b;c", "x"])),
        ("only", (",", "\n", ["only"])),
        ("﻿a|b", ("|", "\n", ["a", "b"])),
    ],
)
def test_header_layout(line, expected):
    assert csv_lists.header_layout(line) == expected


def test_dialects():
    assert csv_lists.writer_dialect(";", "\n") == (";", "\n")
    assert csv_lists.writer_dialect('"', "x") == (",", "\r\n")
    assert csv_lists.writer_dialect("\x1f", None) == (",", "\r\n")
    assert csv_lists.writer_dialect("\t", "\r") == ("\t", "\r")


def test_names_and_profiles(spark):
    assert ingest.unique_name("a.csv", ["a.csv"], 5) == "a_5.csv"
    assert ingest.unique_name("a.csv", ["a_5.csv", "a_5_1.csv"], 5) == "a_5_2.csv"
    assert ingest.unique_name(".hidden", [], 5) == ".hidden_5"
    rows = spark.createDataFrame([("unified", "scraper"), ("x", "unified"), (None, "y")], "p string, f string")
    found = rows.select(ingest.profile_or_default(F.col("p"), F.col("f"))).collect()
    assert [r[0] for r in found] == ["unified", "unified", "scraper"]
    types = spark.createDataFrame([("a.CSV",), ("b.tar.gz",), ("db",)], "n string").select(ingest.type_from_name(F.col("n")))
    assert [r[0] for r in types.collect()] == ["csv", "", "db"]


def test_json_field_clash(spark):
    raw = spark.createDataFrame([([("ID", "1"), ("id", "2"), ("Url", "u")],)], "e array<struct<key:string,value:string>>")
    assert raw.select(ingest.lower_keys(F.col("e"))).first()[0] == {"id": "2", "url": "u"}


def test_json_values_by_record(spark, tmp_path):
    """One import of files that disagree on types, with an empty, a broken and an odd one."""
    write(tmp_path, "a.json", json.dumps([{"id": 1, "url": "a", "tags": ["x", "y"], "is_favorite": 2, "title": None}, {"id": 2.5, "url": "b", "tags": [], "starred": True, "title": 0}]))
    write(tmp_path, "b.json", json.dumps({"bookmarks": [{"id": "x", "url": "c", "tags": "x,y", "is_favorite": "yes", "title": {"a": 1}}, {"id": "0", "url": "d", "tags": 5, "is_favorite": "0"}]}))
    write(tmp_path, "c.json", '{"bookmarks":[{"id"')
    write(tmp_path, "d.json", "[]")
    write(tmp_path, "e.json", '{"id": 1e5, "url": "e", "tags": false, "is_favorite": false}')
    prepared = prepare(spark, tmp_path)
    assert [(r["id"], r["title"], r["tags"], r["is_favorite"]) for r in incoming(prepared)] == [
        ("1", "Untitled Article", ["x", "y"], True),
        ("2.5", "Untitled Article", [], True),
        ("x", '{"a":1}', ["x", "y"], True),
        ("0", "Untitled Article", ["5"], False),
        ("100000", "Untitled Article", [], False),
    ]
    found = report(prepared)
    assert (found["c.json"]["failure"], found["c.json"]["dropped_no_url"], found["c.json"]["parse_errors"]) == ("malformed", 0, 1)
    assert [found[n]["failure"] for n in ("a.json", "b.json", "d.json", "e.json")] == [None] * 4
    assert "file_c.json" not in {r["id"] for r in prepared.sources.collect()}
    drop, root, log = (str(tmp_path / n) for n in ("in", "library", "log"))
    os.makedirs(drop)
    for name in "abcde":
        os.link(tmp_path / f"{name}.json", os.path.join(drop, f"{name}.json"))
    drop_folder.import_folder(spark, drop, root, log).awaitTermination()
    streamed = {r["id"]: (r["tags"], r["is_favorite"]) for r in store.load(spark, root)[0].collect()}
    assert streamed == {r["id"]: (r["tags"], r["is_favorite"]) for r in incoming(prepared)}


def test_save_back(spark, tmp_path, library):
    rows = library(
        {"id": "1", "title": 'a "b"', "article_preview": "=x", "tags": ["ok", "=1"], "source_file_id": "s1"},
        {"id": "2", "title": "gone", "source_file_id": "s1", "deleted_at": "x"},
        {"id": "3", "title": "j", "is_favorite": True, "source_file_id": "s2"},
    )
    layout = [("s1", 0, "a.csv", "csv", "scraper", ["ID", "Title", "note", "preview", "tags"], (";", "\n"), None),
              ("s2", 1, "b.json", "json", "scraper", None, None, None)]
    sources = spark.createDataFrame(layout, SOURCES)
    folders = exports.save_back(rows, sources, str(tmp_path))
    text = {}
    for folder in folders:
        for at, _, names in os.walk(folder):
            for name in names:
                if name.endswith((".csv", ".json")):
                    text[os.path.basename(at)] = open(os.path.join(at, name), newline="").read()
    assert text["source_file_id=s1"] == 'ID;Title;note;preview;tags\n1;"a ""b""";;\'=x;ok,=1\n'
    assert json.loads(text["source_file_id=s2"]) == {"id": "3", "title": "j", "url": "#", "article_preview": "", "content": "", "tags": ""}
    assert {tuple(r) for r in exports.unmapped_report(sources).collect()} == {("s1", "a.csv", 1)}


def test_save_back_gives_the_bytes_back(spark, tmp_path):
    lists = {
        "a.csv": 'id;title;url;preview;tags\n1;t1;https://a.com;p;news\n2;"two\nlines";https://b.com;"a;b ""c""";"x,y "',
        "b.csv": "id,title,url\r\n1,t1,https://a.com\r\n" + '2,"line\r\nend, \n inner",https://b.com',
        "c.csv": "id\ttitle\turl\tsource_file_id\n" + "\n".join(f"{k}\tt{k}\thttps://c.com/{k}\t" for k in range(300)),
    }
    for name, text in lists.items():
        write(tmp_path, name, text)
    for name, text in lists.items():
        prepared = imports.prepare(spark, [str(tmp_path / name)], source_id=lambda name: "own")
        rows, sources = imports.apply(spark.createDataFrame([], LIBRARY), spark.createDataFrame([], SOURCES), prepared)
        (folder,) = exports.save_back(rows, sources, str(tmp_path / f"back-{name}"))
        (file,) = [os.path.join(at, n) for at, _, names in os.walk(folder) for n in names if n.endswith(".csv")]
        line_end = "\r\n" if name == "b.csv" else "\n"
        assert open(file, newline="").read() == text + line_end


def test_save_back_of_all_columns(spark, tmp_path, library):
    rows = library({"id": "1", "source_file_id": "s1"})
    sources = spark.createDataFrame([("s1", 0, "a.csv", "csv", "unified", None, None, None)], SOURCES)
    (folder,) = exports.save_back(rows, sources, str(tmp_path / "all"))
    back = spark.read.option("header", True).csv(f"{folder}/source_file_id=s1").first()
    assert back["source_file_id"] == "s1" and back["id"] == "1"


def test_files_that_fail_for_themselves(spark, tmp_path):
    write(tmp_path, "good list [1] 50%.csv", "id,title,url\n1,t,https://a.com\n")
    write(tmp_path, "zero.csv", "")
    write(tmp_path, "blank.csv", "\n\n  \n")
    write(tmp_path, "zero.json", "")
    write(tmp_path, "broken.json", '[{"id": 1, ')
    write(tmp_path, "head.csv", "id,title,url\n")
    (tmp_path / "wide.csv").write_bytes("id,title,url\n1,t,https://a.com\n".encode("utf-16"))
    (tmp_path / "bad.sqlite").write_bytes(b"SQLite format 3\0" + b"x" * 5000)
    (tmp_path / "zero.db").write_bytes(b"")
    prepared = prepare(spark, tmp_path)
    assert {n: (r["imported"], r["failure"]) for n, r in report(prepared).items()} == {
        "good list [1] 50%.csv": (1, None), "head.csv": (0, None), "zero.csv": (0, "empty"), "blank.csv": (0, "empty"), "zero.json": (0, "empty"),
        "broken.json": (0, "malformed"), "wide.csv": (0, "not text in UTF-8"), "bad.sqlite": (0, "malformed"), "zero.db": (0, "empty"),
    }
    assert {r["name"] for r in prepared.sources.collect()} == {"good list [1] 50%.csv", "head.csv"}
    with pytest.raises(FileNotFoundError):
        prepare(spark, tmp_path / "nowhere")


def test_an_import_of_failures_alone(spark, tmp_path):
    write(tmp_path, "zero.csv", "")
    write(tmp_path, "g.txt", "x")
    prepared = prepare(spark, tmp_path)
    assert {n: r["failure"] for n, r in report(prepared).items()} == {"zero.csv": "empty", "g.txt": "unsupported type"}
    assert incoming(prepared) == [] and prepared.sources.count() == 0


def test_sqlite_export(spark, tmp_path, library):
    rows = library({"id": "1", "title": "x", "tags": ["a", "b"], "is_favorite": True}, {"id": "2"}, {"id": "3"})
    layout = [("s", 0, "x.db", "db", "scraper", None, None, ("odd \"name\"", ["id", "Tags", "favorite", "zip"])), ("t", 1, "y.db", "db", "scraper", None, None, None)]
    made = exports.sqlite_databases(rows, spark.createDataFrame(layout, SOURCES), rows_per_file=2)
    exports.write_files(made, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["s-00000-x.db", "s-00001-x.db"]
    db = sqlite3.connect(tmp_path / "s-00000-x.db")
    assert db.execute('SELECT * FROM "odd ""name"""').fetchall() == [("1", "a,b", "1", None), ("2", "", "0", None)]
    db.close()


def test_unified_export_comes_back(spark, tmp_path, library):
    rows = library(*[{"id": f"r{n}", "title": f"t{n}", "url": f"https://x.org/{n}", "tags": ["a", "b"], "source_file_id": f"s{n % 2}", "source_file_name": f"n{n % 2}.csv"} for n in range(7)])
    sources = spark.createDataFrame([(f"s{n}", n, f"n{n}.csv", "csv", "scraper", None, None, None) for n in range(3)], SOURCES)
    folder = str(tmp_path / "out")
    exports.write_unified_json(rows, sources, folder, rows_per_file=3)
    files = [f for f in os.listdir(folder) if f.endswith(".json")]
    documents = [json.load(open(os.path.join(folder, f))) for f in files]
    assert sorted(len(d["bookmarks"]) for d in documents) == [1, 3, 3]
    back = imports.prepare(spark, [folder + "/*.json"], "unified", source_id=lambda name: "f")
    names = ["id", "title", "url", "tags", "source_file_id", "source_file_name"]
    assert sorted(map(tuple, back.incoming.select(*names).collect())) == sorted(map(tuple, rows.select(*names).collect()))
    assert {r["id"] for r in back.sources.collect()} == {"s0", "s1"}


def test_one_document_of_many_parts(spark, tmp_path, library):
    rows = library(*[{"id": f"r{n}", "title": 'q"\n' + str(n), "url": f"https://x.org/{n}", "tags": ["a"], "source_file_id": f"s{n % 2}"} for n in range(50)], {"id": "gone", "deleted_at": "x"})
    sources = spark.createDataFrame([(f"s{n}", n, f"n{n}.csv", "csv", "scraper", None, None, None) for n in range(3)], SOURCES)
    exports.write_unified_document(rows.repartition(5), sources, str(tmp_path / "all.json"))
    document = json.load(open(tmp_path / "all.json"))
    assert [b["id"] for b in document["bookmarks"]] == [f"r{n}" for n in range(50)] and document["bookmarks"][3]["title"] == 'q"\n3'
    assert [s["id"] for s in document["sources"]] == ["s0", "s1"] and document["version"] == 2 and document["format"] == exports.UNIFIED_FORMAT
    exports.write_unified_document(library(), sources, str(tmp_path / "none.json"))
    assert json.load(open(tmp_path / "none.json"))["bookmarks"] == []


def test_store(spark, tmp_path, library):
    root = str(tmp_path)
    assert [t.count() for t in store.load(spark, root)] == [0, 0]
    sources = spark.createDataFrame([], SOURCES)
    store.save(library({"id": "a"}), sources, root)
    rows, _ = store.load(spark, root)
    store.save(rows.unionByName(library({"id": "b"})), sources, root)
    assert sorted(r["id"] for r in store.load(spark, root)[0].collect()) == ["a", "b"]
    assert store.latest(spark, root)["number"] == 1 and store.load(spark, root)[0].schema.names == LIBRARY.names


def test_stream(spark, tmp_path):
    drop, root, log = (str(tmp_path / n) for n in ("in", "library", "log"))
    os.makedirs(drop)

    def run():
        drop_folder.import_folder(spark, drop, root, log).awaitTermination()
        return {r["id"]: (r["title"], r["seq"]) for r in store.load(spark, root)[0].collect()}

    write(drop, "1.json", json.dumps([{"id": "1", "title": "one", "url": "https://a.org"}, {"id": "2", "title": "two", "link": "https://b.org"}, {"title": "none"}]))
    assert run() == {"1": ("one", 0), "2": ("two", 1)}
    write(drop, "2.json", json.dumps([{"id": "2", "title": "new", "url": "https://b.org"}, {"title": "x", "url": "https://c.org"}]))
    found = run()
    assert found["2"] == ("new", 1) and len(found) == 3
    assert run() == found
    assert store.latest(spark, root)["number"] == 1 and store.load(spark, root)[1].count() == 1


def test_queries_read_numeric_ids(spark):
    from registry import queries

    folder = queries._mixed_files(spark, "/root/testdata/sf0.01")
    kinds = [dict(spark.read.json(f"{folder}/{n}").selectExpr("bookmarks[0].id").dtypes) for n in range(2)]
    # The first kind has page 0: its number counts as no id, and the SQL says so.
    assert [list(k.values()) for k in kinds] == [["bigint"], ["string"]]


def test_lists_of_pages_go_by_number(spark, tmp_path):
    from registry import queries

    spark.range(22).selectExpr("id AS page_id", "'https://a.example' AS url", "'x' AS html").write.parquet(str(tmp_path / "pages.parquet"))
    folder = queries._lists_of_pages(spark, str(tmp_path), F.concat(F.col("page_id").cast("string"), F.lit(",u,t")), 2)
    found = imports.prepare(spark, [folder], "scraper").incoming.select("id", "in_seq").collect()
    assert {(int(r["id"]), r["in_seq"]) for r in found} == {(k, k) for k in range(22)}
