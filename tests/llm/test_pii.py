"""Base spans against the patterns as they are written; disclosing terms on a corpus made for them."""

import hashlib
import re
import time
from math import log2

import numpy as np

from marginalia.llm import pii

SF = "/root/testdata/sf0.01"

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if fits(k, m[0])]


ODD = [
    "a@b a@b.c. x@@y.z @ a@b.c@d.e x.y%z@q-r.s-t.u", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3 9.9.9.9.", "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000",
    "+1 (555) 010-9999 +12345678 +49.30.1234567890123456 ++1 555 0109999 9", "é@x.y ü+1 555 010 99 99é", "", None, "5" * 6000, "a" * 6000 + "@b.c", "a@b." * 2000 + "c",
]


def test_base_spans(spark):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(300).collect()]
    for text in texts:
        assert pii.base_spans(text or "") == brute(text)


def test_digests(spark):
    table = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(ODD)] + [(None, "a@b.c", 1, 2), (1, ODD[0], 1, 2), (1, ODD[0], 1, 2)], "doc_id long, text string, row int, n_ip int")
    rows = pii.digests(table).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        if r["doc_id"] is not None and not (r["doc_id"] == 1 and r["n_email"]):
            want = brute(ODD[r["doc_id"]])
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
            assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)
            assert r["n_card"] == sum(k == "card" for k, _, _ in want)
    assert pii.digests(table.limit(0)).count() == 0


def test_disclosing_terms(spark):
    filler = [(k, f"plain words about thing {k} and the weather") for k in range(60)]
    told = [(100 + k, f"call {w} Quillfeather at x.q@mail.org {w} now") for k, w in enumerate(("alpha", "beta", "gamma"))]
    copies = [(200 + k, "only Copperfield once c.c@mail.org here") for k in range(5)]
    table = spark.createDataFrame([(d, t, len(t)) for d, t in filler + told + copies], "doc_id long, text string, n_chars long")
    spans = {r["doc_id"]: r["spans"] for r in pii.digests(table).collect()}
    assert all(spans[d] == "" for d, _ in filler)
    for d, text in told:
        start = text.index("Quillfeather")
        assert f"term:{start}:{start + 12}" in spans[d]
    assert all("term" not in spans[d] for d, _ in copies)
    clean = {r["doc_id"]: r for r in pii.sanitised(table).collect()}
    assert "Quillfeather" not in clean[100]["text"] and "[EMAIL]" in clean[100]["text"] and clean[100]["n_chars"] == len(clean[100]["text"])
    assert clean[200]["text"] == "only Copperfield once [EMAIL] here" and clean[5]["text"] == dict(filler)[5]


def test_terms_far_from_a_mention(spark):
    filler = [(k, f"plain words about thing {k} and the weather") for k in range(60)]
    gap = "one two three four five six seven eight nine ten eleven " * 5
    told = [(100 + k, f"Quillfeather {gap} {w} x.q@mail.org {w} {gap} quillfeather") for k, w in enumerate(("alpha", "beta", "gamma"))]
    near = [(200, "y.z@mail.org met Marrowgate today"), (201, f"y.z@mail.org {gap} Marrowgate")]
    long = [(300 + k, f"{w} z.z@mail.org {'\u4e00\u4e8c' * 150} end{k}") for k, w in enumerate(("first", "second"))]
    table = spark.createDataFrame(filler + told + near + long, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.digests(table).collect()}
    for d, text in told:
        last = text.rindex("quillfeather")
        assert "term:0:12" in spans[d] and f"term:{last}:{last + 12}" in spans[d]
    for d, text in near:
        assert f"term:{text.index('Marrowgate')}:{text.index('Marrowgate') + 10}" in spans[d]
    for d, text in long:
        start = text.index("\u4e00")
        assert f"term:{start}:{start + 300}" in spans[d]
    assert all(spans[d] == "" for d, _ in filler)


def test_documents_count_once(spark):
    filler = [(k, f"plain words about thing {k} and the weather") for k in range(200)]
    # One long document with an address in many surroundings: no evidence, and no more than one document.
    long = [(500, " ".join(f"word{k} Thornbury l.l@mail.org next{k}" for k in range(50)))]
    # Pennywhistle stands in two of four documents with the address; one of them repeats it.
    half = [(600, " ".join(f"a{k} Pennywhistle h.h@mail.org b{k}" for k in range(9))), (601, "see Pennywhistle at h.h@mail.org")]
    half += [(602, "write h.h@mail.org"), (603, "ask h.h@mail.org"), *((610 + k, f"Pennywhistle thing {k}") for k in range(3))]
    # Repeated rows are one document: Larkspur stands in one without the address, not in nine.
    rows = [(700, "r.r@mail.org knows Larkspur"), (701, "Larkspur was at r.r@mail.org")]
    rows += [rows[0]] * 7
    for extra in (long + half, rows + [(710, "Larkspur alone")] * 9):
        table = spark.createDataFrame(filler + extra, "doc_id long, text string")
        spans = {r["doc_id"]: r["spans"] for r in pii.digests(table).collect()}
        told = {d: [t[int(a) : int(b)] for k, a, b in (s.split(":") for s in spans[d].split(",") if s) if k == "term"] for d, t in extra}
        assert all("Thornbury" not in x and "Pennywhistle" not in x for x in told.values())
        assert 700 not in told or "Larkspur" in told[700] and "Larkspur" in told[701]


def test_frequencies_of_repeated_rows(spark):
    """Against a recount over distinct documents, with rows repeated and ids missing."""
    words = [f"w{k}" for k in range(12)]
    texts = [f"{' '.join(words[j] for j in range(12) if (k * 7 + j * j) % 5 == 0)} e{k % 4}@x.org own{k % 4} n{k // 3}" for k in range(24)]
    rows = [(k, t) for k, t in enumerate(texts)] * 2 + [(None, texts[0] + " more")] * 3 + [(100 + k, f"only {k}") for k in range(80)] + [(50, "own1")] * 20
    distinct = set(rows)
    terms = {r: {w.lower() for w in re.findall(r"\w+", r[1])} for r in distinct}
    held = {r: {r[1][a:b].lower() for _, a, b in brute(r[1])} for r in distinct}
    docs_of = lambda sets, x: {r for r in distinct if x in sets[r]}
    expected = set()
    for e in set().union(*held.values()):
        for t in set().union(*terms.values()):
            n_e, n_t, both = len(docs_of(held, e)), len(docs_of(terms, t)), docs_of(held, e) & docs_of(terms, t)
            around = {" ".join(w for w in re.findall(r"\w+", re.sub(r"\S+@\S+", " ", r[1]))) for r in both}
            if len(around) >= 2 and log2(len(both) * len(distinct) / n_t / n_e) >= 0.9 * log2(len(distinct) / n_e):
                expected |= {(*r, t) for r in both}
    got = set()
    for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = texts[0] + " more" if r["doc_id"] is None else dict(x for x in rows if x[0] is not None)[r["doc_id"]]
        got |= {(r["doc_id"], text, text[int(a) : int(b)].lower()) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k == "term"}
    outside = {(d, x, t) for d, x, t in expected if t in re.findall(r"\w+", re.sub(r"\S+@\S+", " ", x))}
    assert got == outside and got


def test_words_that_a_polynomial_takes_for_each_other(spark):
    one, other = "a", "b"
    for _ in range(10):
        one, other = one + other, other + one
    rows = [(1, f"reach me@x.org {one}"), (2, f"reach me@x.org {other} now")] + [(k, f"plain reach now {k}") for k in range(3, 40)]
    found = pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all("term" not in r["spans"] for r in found)


def test_addresses_begin_where_digits_do():
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    draw = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(draw.choice(list("1234.. x"), 30))
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in plain.finditer(text)]


def test_a_megabyte_of_digits_is_soon_read():
    began = time.time()
    assert pii.base_spans("7" * 1_000_000) == []
    assert pii.base_spans("7." * 500_000 + "x") != []
    assert time.time() - began < 5
