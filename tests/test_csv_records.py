"""Quoted line ends in CSV files that are read in splits, against the reader that takes a file whole."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from marginalia.plans import imports
from marginalia.sources import csv_lists
from marginalia.sources.files import listed


def test_states_of_lines():
    inside = csv_lists.ends_inside
    assert [inside(x, False, ",") for x in ("", "a,b", '"a,b', 'a,"b', 'a,"b"', '"a""', '"a"""', 'a"b', '5" x,"y', '"a"b"c,"d', ',,"')] == [
        False, False, True, True, False, True, False, False, True, True, True,
    ]
    assert [inside(x, True, ",") for x in ("", "a,b", '"', 'a",b', 'a","', 'a"","b', '"",x', 'x"y,"z"')] == [True, True, False, False, True, False, True, False]
    assert inside('a;"b', False, ";") and not inside('a;"b', False, ",")


def written(rows, line_end="\r\n", delimiter=","):
    out = io.StringIO()
    csv.writer(out, lineterminator=line_end, delimiter=delimiter).writerows(rows)
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "1k")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def drawn(seed, n):
    draw = random.Random(seed)
    cells = ["", "plain", "two\nlines", "a\r\nb\n\nc", 'say "x"', ",", '"', "\n", "é漢", '5" disk', "x" * 300, "line\n" * 40, " lead", "tail ", "12", "a,b\n"]
    return [[f"id{seed}-{k}", f"https://x.org/{seed}/{k}", draw.choice(cells), draw.choice(cells), draw.choice(cells)] for k in range(n)]


@pytest.mark.parametrize("line_end,delimiter", [("\n", ","), ("\r\n", ";"), ("\n", "\t")])
def test_against_the_csv_module(spark, tmp_path, small_splits, line_end, delimiter):
    files = {f"f{n}.csv": drawn(n, 150 if n else 1) for n in range(3)}
    for name, rows in files.items():
        (tmp_path / name).write_text(written([["id", "url", "title", "content", "note"], *rows], line_end, delimiter), newline="")
    scan = csv_lists.scan(spark, listed(spark, [str(tmp_path)], "scraper"))
    got = {}
    splits = set()
    for part in scan.parts:
        rows = part.rows.select("_file", "_block", "_row", "_parse_error", *[part.fields[c][0].alias(c) for c in ("id", "url", "title", "content", "note")])
        for r in rows.collect():
            assert not r["_parse_error"]
            got.setdefault(r["_file"].rsplit("/", 1)[1], []).append((r["_block"], r["_row"], [*r][4:]))
            splits.add((r["_file"], r["_block"]))
    for name, rows in files.items():
        assert [x[2] for x in sorted(got[name])] == rows
    assert len(splits) > 20
    # Numbers are dense within a split.
    for found in got.values():
        by = {}
        for block, row, _ in found:
            by.setdefault(block, []).append(row)
        assert all(sorted(v) == list(range(min(v), min(v) + len(v))) for v in by.values())


def test_ragged_records_and_quotes_that_do_not_open(spark, tmp_path, small_splits):
    lines = ["id,url,title", '1,https://a.org,"x\ny"', '2,https://b.org,5" disk', "3,https://c.org,t,too many", "", "4,https://d.org", '5,https://e.org,"q""\n\nq"', "   ", "6,https://f.org,z"]
    (tmp_path / "odd.csv").write_text("\n".join(lines * 1))
    got = imports.prepare(spark, [str(tmp_path / "odd.csv")])
    rows = [tuple(r) for r in got.incoming.orderBy("in_seq").select("id", "title", "in_seq").collect()]
    assert [r[0] for r in rows] == ["1", "2", "3", "4", "5", "6"] and [r[2] for r in rows] == list(range(6))
    assert rows[0][1] == "x\ny" and rows[1][1] == '5" disk' and rows[4][1] == 'q"\n\nq'
    report = got.report.first()
    assert (report["imported"], report["parse_errors"]) == (6, 2)


def test_a_quote_that_is_never_closed(spark, tmp_path, small_splits):
    lines = ["id,url,title", '0,https://z.org,"a\nb"', '1,https://a.org,"open'] + [f"{k},https://b{k}.org,t" for k in range(2, 200)]
    (tmp_path / "open.csv").write_text("\n".join(lines))
    rows = imports.prepare(spark, [str(tmp_path / "open.csv")]).incoming.orderBy("in_seq").select("id", F.length("title")).collect()
    assert [r[0] for r in rows] == ["0", "1"] and rows[1][1] > 3000


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "odd.csv").write_bytes(b'id,url,title\n1,https://a.org,"x\ny"\n2,https://b.org,caf\xe9\n3,https://c.org,"\xff\n"\n')
    rows = imports.prepare(spark, [str(tmp_path / "odd.csv")]).incoming.orderBy("in_seq").select("id", "title").collect()
    assert [tuple(r) for r in rows] == [("1", "x\ny"), ("2", "caf\ufffd"), ("3", "\ufffd\n")]
