"""JSON documents that are read in splits, against a parser that takes them whole."""

import json
import random

import pytest

from marginalia.plans import imports
from marginalia.sources import json_lists, json_records
from marginalia.sources.files import listed


def test_states_of_texts():
    cases = ['{"a": 1}', '{"a": "}', '"x\\"}', '"\\\\"}', '[[{}', "", 'x": {"b": "c}', '\\"}', '\\\\"}']
    assert [json_records.after(c, False) for c in cases] == [
        (False, 0), (True, 1), (True, 0), (False, -1), (False, 2), (False, 0), (False, -1), (True, 0), (True, 0),
    ]
    assert [json_records.after(c, True) for c in cases] == [
        (True, 0), (False, -1), (True, 0), (True, 0), (True, 0), (True, 0), (True, 1), (True, 0), (False, -1),
    ]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "3k")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def drawn(seed, n):
    draw = random.Random(seed)
    cells = ["", "plain", "two\nlines", 'say "x"', "}", "{", "]}", '\\"', "\\", '"}, {"id": "no"', "é漢", "x" * 900, "}{" * 400, '\\"' * 300, None, 7, 2.5, True, [], ["}", "a"], {"k": {"m": [1, {}]}}, [[{"y": "]"}]]]
    return [{"id": f"id{seed}-{k}", "url": f"https://x.org/{seed}/{k}", "title": draw.choice(cells), "other": draw.choice(cells), "content": draw.choice(cells)} for k in range(n)]


def read(spark, folder):
    scan = json_lists.scan(spark, listed(spark, [str(folder)], "scraper"))
    found = {}
    for part in scan.parts:
        wanted = [part.fields[c][0].cast("string").alias(c) for c in ("id", "url") if c in part.fields]
        for r in part.rows.select("_file", "_block", "_row", "_parse_error", *wanted).collect():
            found.setdefault(r["_file"].rsplit("/", 1)[1], []).append((r["_block"], r["_row"], r["_parse_error"], *[r[c] for c in ("id", "url") if c in part.fields]))
    return scan, {k: sorted(v) for k, v in found.items()}


def test_against_a_parser(spark, tmp_path, small_splits):
    rows = {f"f{n}.json": drawn(n, 40 if n else 1) for n in range(6)}
    manifest = [{"id": "s1", "name": "a}.csv", "type": "csv", "profile": "scraper"}, {"id": "s2", "name": "[", "x": {"y": [{}]}}]
    frames = [
        lambda r: json.dumps(r, ensure_ascii=False, separators=(",", ":")),
        lambda r: json.dumps(r, indent=1) + "\n\n",
        lambda r: "﻿ " + json.dumps(r),
        lambda r: json.dumps({"format": "a}b\"", "version": 2, "sources": manifest, "bookmarks": r}),
        lambda r: json.dumps({"bookmarks": r, "extra": {"x": {"bookmarks": [{"id": "no"}]}, "z": [{"id": "no"}, 5]}, "sources": manifest}, indent=2) + "\n",
        lambda r: json.dumps({"nothing": [], "tail": [{"a": 1}], "bookmarks": r, "end": "}]"}),
    ]
    for (name, r), frame in zip(rows.items(), frames, strict=True):
        (tmp_path / name).write_text(frame(r), encoding="utf-8")
    reading = json_records.records(spark, [str(tmp_path)]).reading
    assert set(reading.values()) == {json_records.SPLIT} and len(reading) == 6
    scan, found = read(spark, tmp_path)
    splits = set()
    for name, r in rows.items():
        assert [x[3:] for x in found[name]] == [(x["id"], x["url"]) for x in r], name
        assert not any(x[2] for x in found[name])
        by = {}
        for block, row, *_ in found[name]:
            splits.add((name, block))
            by.setdefault(block, []).append(row)
        assert all(v == list(range(v[0], v[0] + len(v))) for v in by.values())
    assert len(splits) > 20
    listing = {(r["file"].rsplit("/", 1)[1], r["entry"], r["id"], r["name"], r["type"]) for r in scan.manifest.collect()}
    assert listing == {(f, k, e["id"], e["name"], e.get("type")) for f in ("f3.json", "f4.json") for k, e in enumerate(manifest)}
    got = imports.prepare(spark, [str(tmp_path)])
    assert [r["id"] for r in got.incoming.orderBy("in_seq").collect()] == [x["id"] for r in rows.values() for x in r]


def test_broken_records_and_documents(spark, tmp_path):
    rows = drawn(9, 60)
    texts = [json.dumps(r) for r in rows]
    broken = [t.replace('": ', '" ', 1) if k in (5, 50) else t for k, t in enumerate(texts)]
    whole = "[" + ",".join(texts) + "]"
    documents = {
        "records.json": "[" + ", ".join(broken) + "]",
        "cut.json": whole[: len(whole) // 2],
        "end.json": whole[:-1],
        "brace.json": '{"bookmarks":' + whole,
        "string.json": whole[:-1] + ',{"id": "x]',
        "frame.json": '{"format" 1, "bookmarks": ' + whole + "}",
        "comma.json": '{"bookmarks": ' + whole + ",}",
        "behind.json": whole + " x",
        "lines.json": "\n".join(texts),
        "mixed.json": "[1, " + whole[1:],
        "twice.json": "[" + texts[0] + " " + texts[1] + "]",
        "single.json": texts[0],
        "none.json": "[]",
        "empty.json": ' {"bookmarks": []}',
        "wide.json": "",
    }
    for name, text in documents.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "wide.json").write_bytes(("[" + texts[0] + "]").encode("utf-16"))
    reading = {k.rsplit("/", 1)[1]: v for k, v in json_records.records(spark, [str(tmp_path)]).reading.items()}
    assert reading == {
        **dict.fromkeys(("records.json", "none.json", "empty.json"), json_records.SPLIT),
        **dict.fromkeys(("cut.json", "end.json", "brace.json", "string.json", "frame.json", "comma.json", "behind.json", "lines.json"), json_records.BROKEN_FILE),
        **dict.fromkeys(("mixed.json", "twice.json", "single.json", "wide.json"), json_records.WHOLE),
    }
    report = {r["name"]: r for r in imports.prepare(spark, [str(tmp_path)]).report.collect()}
    assert (report["records.json"]["imported"], report["records.json"]["parse_errors"], report["records.json"]["dropped_no_url"]) == (58, 2, 0)
    assert report["records.json"]["failure"] is None and report["none.json"]["failure"] is None and report["single.json"]["imported"] == 1
    assert {n for n, r in report.items() if r["failure"] == "malformed"} >= {n for n, v in reading.items() if v == json_records.BROKEN_FILE}


def test_long_texts_are_taken_some_at_a_time():
    import pyarrow as pa

    from marginalia.sources import files

    texts = [str(n) + "x" * (files.SLICE // 3) for n in range(10)]
    batches = [pa.RecordBatch.from_pydict({"value": texts, "at": list(range(10))}), pa.RecordBatch.from_pydict({"value": ["a", "b"], "at": [10, 11]})]
    taken = [list(part) for part in files.slices(iter(batches), ("value", "at"))]
    assert [row for part in taken for row in part] == list(zip([*texts, "a", "b"], range(12), strict=True))
    assert max(sum(len(t) for t, _ in part) for part in taken) <= files.SLICE and len(taken[-1]) == 2
