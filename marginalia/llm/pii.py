"""Personal data, and terms that give away whom it belongs to.

Base kinds are found by pattern: e-mail addresses, IP addresses, card and phone numbers. Each distinct value is a protected
entity. A term in a document that mentions it may identify the entity even when the value is gone. How much a term says of an
entity is their pointwise mutual information over the corpus, log2(p(t, e) / (p(t) p(e))); all that can be said of the entity is
its information content -log2 p(e). Terms that tell at least DISCLOSED of it are disclosing (information-theoretic
sanitisation): they become spans of kind ``term`` wherever they stand in a document that mentions that entity, outside of mentions.

Probabilities are shares of documents, counted over all documents; a document that mentions an entity or holds a term many
times counts once. A pair counts only in differing surroundings, at least SUPPORT of them. A surrounding is a document's words
without its mentions: copies of one document are one, and a single document is no evidence that a term belongs to an entity.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import buffers, documents, text_key, units, word_hashes
from marginalia.scratch import written_once

#: Share of an entity's information from which on a term discloses it; differing surroundings needed.
DISCLOSED, SUPPORT = 0.9, 2

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base kinds. An address can only begin where a run of digits does, as runs are taken whole; to say
# so keeps the search linear.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"\w+")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each @, leftmost first, without trying every word that has none."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            yield found.span()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then start."""
    found = [("email", *x) for x in emails(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def _hash(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in data], dtype=np.int64)
    joined = np.frombuffer(b"".join(data), np.uint8)
    return word_hashes(joined, ends - [len(w) for w in data], ends).view(np.int64)


def _outside(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[str], np.ndarray]:
    """The words of a text that overlap no span, in lower case, and their starts and ends."""
    words = np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)
    inner = np.array(sorted((a, b) for _, a, b in spans), np.int64).reshape(-1, 2)
    reach = np.concatenate(([0], np.maximum.accumulate(inner[:, 1])))
    words = words[reach[np.searchsorted(inner[:, 0], words[:, 1])] <= words[:, 0]]
    return [text[x:y].lower() for x, y in words.tolist()], words


def _terms(text: str) -> set[str]:
    """The distinct words of a text in lower case, those of its mentions too."""
    return {w.lower() for w in set(_WORD.findall(text))}


#: ``around`` stands for a document's words without its mentions; only rows with spans have a text.
_FOUND = """doc_id long, key long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>, around long,
    text string"""


#: Rows whose spans are sought at a time.
ROWS = 1000


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(first, ROWS) for b in batches for first in range(0, len(b), ROWS)):
        columns: dict[str, list] = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base", "entities", "around", "text")}
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            for kind in KINDS:
                columns[f"n_{kind}"].append(sum(s[0] == kind for s in spans))
            columns["base"].append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
            entities, around = [], None
            if spans:
                entities = np.unique(_hash([f"{kind} {text[a:b].lower()}" for kind, a, b in spans])).tolist()
                digest = hashlib.blake2b(" ".join(_outside(text, spans)[0]).encode(), digest_size=8).digest()
                around = int.from_bytes(digest, "big", signed=True)
            columns["entities"].append(entities)
            columns["around"].append(around)
            columns["text"].append(text if spans else None)
        arrays = [pa.array(columns[f"n_{k}"], pa.int64()) for k in KINDS]
        arrays += [pa.array(columns["base"], pa.string()), pa.array(columns["entities"], pa.list_(pa.int64()))]
        arrays += [pa.array(columns["around"], pa.int64()), pa.array(columns["text"], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *arrays], names=["doc_id", "key", *columns])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of a batch's documents and in how many of them they stand; a document counts its ``weight`` times if it has one."""
    for batch in batches:
        _, offsets = buffers(batch.column("text"))
        weights = batch.column("weight").to_numpy() if "weight" in batch.schema.names else np.ones(len(batch), np.int64)
        found, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, last in units(np.diff(offsets), 1 << 19):
            words = [_terms(t) for t in batch.column("text").slice(first, last - first).to_pylist()]
            flat = [w for x in words for w in x]
            if flat:
                terms, at = np.unique(_hash(flat), return_inverse=True)
                found.append(terms)
                counts.append(np.bincount(at, np.repeat(weights[first:last], list(map(len, words)))))
        terms, at = np.unique(np.concatenate(found), return_inverse=True)
        yield pa.RecordBatch.from_pydict({"term": terms, "n": np.bincount(at, np.concatenate(counts), len(terms)).astype(np.int64)})


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row (row, text) with each of its distinct terms."""
    for batch in batches:
        _, offsets = buffers(batch.column("text"))
        for first, last in units(np.diff(offsets), 1 << 19):
            words = [_terms(t) for t in batch.column("text").slice(first, last - first).to_pylist()]
            flat = [w for x in words for w in x]
            if flat:
                rows = np.repeat(batch.column("row").slice(first, last - first).to_numpy(), list(map(len, words)))
                yield pa.RecordBatch.from_pydict({"row": rows, "term": _hash(flat)})


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the terms in ``hits`` stand in the rows (row, text, base, hits), outside of mentions."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in (b.slice(first, ROWS) for b in batches for first in range(0, len(b), ROWS)):
        added = []
        for text, base, hits in zip(*(batch.column(c).to_pylist() for c in ("text", "base", "hits")), strict=True):
            words, at = _outside(text, [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base.split(","))])
            told = at[np.isin(_hash(words), hits)] if words else at
            added.append([{"start": a, "stop": b} for a, b in told.tolist()] or None)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(added, kind)], names=["row", "added"])


#: Keys with more than one part in COMMON of all rows are at most as many, so they are broadcast; all others are no hot groups.
COMMON = 200_000


def _joined(rows: DataFrame, known: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` with the columns of ``known``, which has each key once and in ``n`` about how many rows have it."""
    total = known.agg(F.sum(n)).first()[0] or 0
    many = F.col(n) * COMMON > total
    common = F.broadcast(known.filter(many))
    rest = rows.join(F.broadcast(known.filter(many).select(*keys)), keys, "left_anti").join(known.filter(~many), keys)
    return rows.join(common, keys).unionByName(rest)


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, key, term of terms in documents that mention an entity they disclose, from the scanned rows and their documents."""
    # Repeated rows are one document.
    distinct = found.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    total, repeated = distinct.agg(F.count("*"), F.count_if(F.col("n") > 1)).first()
    holders = found.filter(F.size("entities") > 0)
    firsts = holders.groupBy("doc_id", "key").agg(F.min("row").alias("row"), F.first("around").alias("around"), F.first("entities").alias("entities"))
    mentions = firsts.select("doc_id", "key", "row", "around", F.explode("entities").alias("entity"))
    counted = mentions.groupBy("entity", "around").agg(F.count("*").alias("n")).groupBy("entity").agg(F.count("*").alias("arounds"), F.sum("n").alias("n_entity"))
    entities = written_once(counted.filter(F.col("arounds") >= SUPPORT).select("entity", "n_entity"))
    # As n_pair <= n_entity, only terms in at most this many documents can disclose an entity; the last digits are left to the sums below.
    most = F.lit(float(total)) ** (1 - DISCLOSED) * F.col("n_entity") ** DISCLOSED * (1 + 1e-9)
    highest = entities.agg(F.max(most)).first()[0]
    if highest is None:
        return mentions.select("doc_id", "key", F.col("entity").alias("term")).limit(0)
    counts = docs.mapInArrow(_frequencies, "term long, n long")
    if repeated:
        twice = distinct.filter(F.col("n") > 1).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "n")
        twice = F.broadcast(twice) if repeated <= COMMON else twice
        again = docs.join(twice, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
        once = again.dropDuplicates(["doc_id", "key"]).select("text", (1 - F.col("n")).alias("weight"))
        counts = counts.unionByName(once.mapInArrow(_frequencies, "term long, n long"))
    counts = counts.groupBy("term").agg(F.sum("n").alias("n_term"))
    terms = written_once(counts.filter(F.col("n_term") >= SUPPORT))
    listed = _joined(holders.select("row", "text").mapInArrow(_listed, "row long, term long"), terms, ["term"], "n_term")
    pairs = _joined(mentions, entities, ["entity"], "n_entity").join(listed.filter(F.col("n_term") <= highest), "row")
    pairs = written_once(pairs.filter(F.col("n_term") <= most).select("doc_id", "key", "around", "entity", "term", "n_entity", "n_term"))
    # One row for each surrounding first: copies are no evidence.
    both = pairs.groupBy("entity", "term", "around").agg(F.count("*").alias("n"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    both = both.groupBy("entity", "term").agg(
        F.count("*").alias("arounds"), F.sum("n").alias("n_pair"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term")
    ).filter(F.col("arounds") >= SUPPORT)
    told = F.log2(F.col("n_pair") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    whole = F.log2(F.lit(float(total)) / F.col("n_entity"))
    told = written_once(both.filter((whole > 0) & (told >= DISCLOSED * whole)).select("entity", "term", "n_pair"))
    return _joined(pairs.select("doc_id", "key", "entity", "term"), told, ["entity", "term"], "n_pair").select("doc_id", "key", "term")


def scanned(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its spans, as a table in the shared folder.

    Columns doc_id, key, row, n_email, n_ip, n_card, n_phone, base (base spans in the order of KINDS, then start) and added
    (disclosing terms: array of start, stop, in order). A null text is empty; rows with a null doc_id or repeated rows are
    treated like any other, repeated ones count as one document. Empty tables give empty results; other columns are ignored.
    """
    rows = documents(docs).withColumn("key", text_key())
    found = written_once(rows.mapInArrow(_scanned, _FOUND).withColumn("row", F.monotonically_increasing_id()))
    told = disclosing(found, rows).groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_set("term").alias("hits"))
    hit = found.filter(F.col("base") != "").join(told, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    spans = hit.select("row", "text", "base", "hits").mapInArrow(_located, "row long, added array<struct<start: int, stop: int>>")
    return found.drop("entities", "around", "text").join(spans, "row", "left")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (all, terms last) of every row; see ``scanned``."""
    found = scanned(docs)
    terms = F.transform("added", lambda x: F.concat(F.lit("term:"), x["start"].cast("string"), F.lit(":"), x["stop"].cast("string")))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.array_join(terms, ","))
    return found.select("doc_id", *(f"n_{kind}" for kind in KINDS), F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))


#: What personal data becomes: its kind. Disclosing terms are removed.
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": ""}


def cleaned(text: str, base: str, added: list[tuple[int, int]]) -> str:
    """The text with base spans generalised to their kind and disclosing terms removed; of overlapping spans the first, then longer one counts."""
    spans = [(int(a), -int(b), kind) for kind, a, b in (x.split(":") for x in base.split(",") if x)]
    spans += [(a, -b, "term") for a, b in added]
    out, at = [], 0
    for start, minus, kind in sorted(spans):
        if start >= at:
            out += (text[at:start], MARKS[kind])
            at = -minus
        elif -minus > at:
            at = -minus
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; rows without any are unchanged, other columns stay as they are.

    Only rows with spans take new texts; n_chars follows the text if there is such a column.
    """
    found = scanned(docs).filter((F.col("base") != "") | F.col("added").isNotNull())
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.first("base").alias("_base"), F.first("added").alias("_added"))

    @F.pandas_udf("string")
    def clean(text: pd.Series, base: pd.Series, added: pd.Series) -> pd.Series:
        rows = zip(text, base, added, strict=True)
        return pd.Series([t if b is None else cleaned(t, b, [(x["start"], x["stop"]) for x in (() if a is None else a)]) for t, b, a in rows], dtype=object)

    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (key == F.col("_key")), "left")
    marked = joined.withColumn("text", F.when(F.col("_key").isNotNull(), clean("text", "_base", "_added")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.when(F.col("_key").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return marked.select(*docs.columns)
