"""Language identification by prediction by partial matching.

A language's model is a tree of byte contexts of up to three bytes with the counts of the bytes that followed them. A
byte costs -log2 of its probability in the longest context; if it never followed there, it costs that context's escape
and is looked up one byte shorter, down to a uniform order that knows every byte. Escapes follow method C: of a context seen
n times with d distinct followers, d / (n + d) goes to the escape. Contexts a language never saw cost no escape, and
lower orders exclude nothing. The counts are frozen after training, so the costs of all four-byte strings of the trees are
worked out once; a document's code length is a sum of whole numbers, 2^-16 bits each, the same in any order.

The language with the shortest code is predicted; ties go to the first name. The score is its share in the sum of 2^-length
over all languages: the posterior under equal priors.

Training takes the labelled documents of each language in the order of a hash of doc_id until its share of TRAINING_BYTES is
reached, at least one, and cuts the last one to the share: a bounded sample, so that model and driver stay small whatever the
table's size, and no labelled language is without text.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import buffers, documents, units

#: Bytes of text in the training sample, at most, but for a byte of each language's last document.
TRAINING_BYTES = 12 << 20

#: Bytes of text scored at a time.
SCORED_BYTES = 1 << 19

#: Units of a bit that code lengths are counted in.
UNIT = 1 << 16

#: Stands before a text, so that its first bytes have contexts.
PAD = 10

UNDECIDED = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte of the texts the number made of it and the three bytes before it, oldest first."""
    code = data.astype(np.uint32)
    starts, lengths = offsets[:-1], np.diff(offsets)
    for back in (1, 2, 3):
        before = np.full(len(data), PAD, np.uint8)
        before[back:] = data[:-back] if back < len(data) else data[:0]
        for into in range(back):
            before[starts[lengths > into] + into] = PAD
        code |= before.astype(np.uint32) << np.uint32(8 * back)
    return code


class Table:
    """Open addressing from 32-bit keys to rows; all lookups of an array at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.keys, self.rows = np.zeros(1 << bits, np.uint32), np.full(1 << bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.rows[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            taken = left[free][first]
            self.keys[slots], self.rows[slots] = keys[taken], taken
            open_ = np.ones(len(left), bool)
            open_[np.flatnonzero(free)[first]] = False
            at, left = (at[open_] + 1) & self.mask, left[open_]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the keys, -1 where absent."""
        at = self._slot(keys)
        found = self.rows[at]
        wrong = np.flatnonzero((self.keys[at] != keys) & (found >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            slots = at[wrong]
            found[wrong] = self.rows[slots]
            wrong = wrong[(self.keys[slots] != keys[wrong]) & (found[wrong] >= 0)]
        return found


@dataclass
class Model:
    """Costs by language (columns) in UNITs: of four- and three-byte strings' last bytes, and of leaving contexts."""

    languages: list[str]
    four: Table
    cost4: np.ndarray
    three: Table
    cost3: np.ndarray
    leave3: np.ndarray
    cost2: np.ndarray
    leave2: np.ndarray

    @classmethod
    def fit(cls, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> "Model":
        """counts: for each language its sorted four-byte strings and how often they occur."""
        n = len(languages)
        bits = lambda p: np.round(-np.log2(p) * UNIT).astype(np.int32)

        def order(k: int) -> list[tuple[np.ndarray, np.ndarray]]:
            out = []
            for keys, c in counts:
                short, at = np.unique(keys & np.uint32((1 << 8 * k) - 1), return_inverse=True)
                out.append((short, np.bincount(at, c, len(short))))
            return out

        def escapes(keys: np.ndarray, c: np.ndarray):
            """Contexts of the strings, cost of leaving each, cost of each string's last byte."""
            contexts, at, d = np.unique(keys >> np.uint32(8), return_inverse=True, return_counts=True)
            total = np.bincount(at, c, len(contexts)) + d
            return contexts, bits(d / total), bits(c / total[at])

        known = {k: order(k) for k in (1, 2, 3, 4)}
        cost1, cost2 = np.full((256, n), 0, np.int32), np.zeros((1 << 16, n), np.int32)
        leave2 = np.zeros((1 << 16, n), np.int32)
        for j in range(n):
            keys, c = known[1][j]
            _, leave, own = escapes(keys, c)
            cost1[:, j] = (leave[0] if len(leave) else 0) + 8 * UNIT
            cost1[keys, j] = own
            keys, c = known[2][j]
            contexts, leave, own = escapes(keys, c)
            leave1 = np.zeros(256, np.int32)
            leave1[contexts] = leave
            cost2[:, j] = leave1[np.arange(1 << 16) >> 8] + cost1[np.arange(1 << 16) & 255, j]
            cost2[keys, j] = own
            contexts, leave, _ = escapes(*known[3][j])
            leave2[contexts, j] = leave
        all3 = np.unique(np.concatenate([x for x, _ in known[3]] + [x >> np.uint32(8) for x, _ in known[4]]))
        all4 = np.unique(np.concatenate([x for x, _ in known[4]]))
        three, four = Table(all3), Table(all4)
        cost3 = leave2[all3 >> np.uint32(8)] + cost2[all3 & np.uint32(0xFFFF)]
        leave3 = np.zeros_like(cost3)
        context4 = three.find(all4 >> np.uint32(8))
        for j in range(n):
            keys, c = known[3][j]
            cost3[np.searchsorted(all3, keys), j] = escapes(keys, c)[2]
            contexts, leave, _ = escapes(*known[4][j])
            at = three.find(contexts)
            leave3[at, j] = leave
        cost4 = leave3[context4] + cost3[three.find(all4 & np.uint32(0xFFFFFF))]
        for j in range(n):
            keys, c = known[4][j]
            cost4[np.searchsorted(all4, keys), j] = escapes(keys, c)[2]
        return cls(languages, four, cost4, three, cost3, leave3, cost2, leave2)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths of the texts by language, in UNITs."""
        out = np.zeros((len(offsets) - 1, len(self.languages)), np.int64)
        code = grams(data, offsets)
        at = self.four.find(code)
        costs = self.cost4[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            code = code[new]
            low = self.three.find(code & np.uint32(0xFFFFFF))
            fresh = self.cost3[low]
            gone = np.flatnonzero(low < 0)
            fresh[gone] = self.leave2[(code[gone] >> np.uint32(8)) & np.uint32(0xFFFF)] + self.cost2[code[gone] & np.uint32(0xFFFF)]
            context = self.three.find(code >> np.uint32(8))
            costs[new] = fresh + np.where((context >= 0)[:, None], self.leave3[context], 0)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            out[full] = np.add.reduceat(costs, offsets[:-1][full], axis=0, dtype=np.int64)
        return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four-byte strings of each language in the sample and how often they occur."""
    for batch in batches:
        names = batch.column("lang").to_pylist()
        for lang in sorted(set(names)):
            texts = batch.column("text").filter(pa.array([x == lang for x in names]))
            data, offsets = buffers(texts)
            if len(data):
                keys, c = np.unique(grams(data, offsets), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(keys), "gram": keys.astype(np.int64), "n": c.astype(np.int64)})


def _taken(rows: DataFrame) -> list[tuple[str, int, int, int]]:
    """For each language (place, tie) of the last row of its sample and to how many bytes its text is cut.

    The bytes by the length of the place tell which places hold a share; only those rows' places come to the driver.
    """
    held: dict[str, dict[int, int]] = {}
    for r in rows.groupBy("lang", "bits").agg(F.sum("size").alias("n")).collect():
        held.setdefault(r["lang"], {})[r["bits"]] = r["n"]
    if not held:
        return []
    share, bounds = max(1, TRAINING_BYTES // len(held)), []
    for lang, n in held.items():
        bits = sorted(n)
        sums = np.cumsum([n[x] for x in bits])
        bounds.append((lang, bits[min(int(np.searchsorted(sums, share)), len(bits) - 1)]))
    bounds = F.broadcast(rows.sparkSession.createDataFrame(bounds, "lang string, most int"))
    table = rows.join(bounds, "lang").filter(F.col("bits") <= F.col("most")).select("lang", "place", "tie", "size").toArrow()
    names, place, tie, size = np.array(table["lang"].to_pylist(), object), *(table[c].to_numpy() for c in ("place", "tie", "size"))
    taken = []
    for lang in held:
        mine = np.flatnonzero(names == lang)
        mine = mine[np.lexsort((tie[mine], place[mine]))]
        before = np.cumsum(size[mine]) - size[mine]
        end = mine[np.searchsorted(before, share) - 1]
        # Repeated rows share what is left.
        same = np.flatnonzero((place[mine] == place[end]) & (tie[mine] == tie[end]))
        cut = min(int(size[end]), max(1, (share - int(before[same[0]])) // len(same)))
        taken.append((lang, int(place[end]), int(tie[end]), cut))
    return taken


def train(labelled: DataFrame) -> Model | None:
    """The model of documents (doc_id, text, lang); None if no language has text. Rows without text or lang are not used."""
    columns = (("doc_id", "long"), ("text", "string"), ("lang", "string"))
    rows = labelled.select(*(F.col(name).cast(kind).alias(name) for name, kind in columns))
    rows = rows.filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    # A place from the hash of the id, or of the text where there is none.
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("size", F.octet_length("text").cast("long"))
    place = F.xxhash64(F.coalesce("doc_id", "tie"), F.lit("training"))
    rows = rows.withColumn("place", F.shiftrightunsigned(place, 1)).withColumn("bits", F.length(F.bin("place")))
    taken = _taken(rows)
    if not taken:
        return None
    ends = F.broadcast(labelled.sparkSession.createDataFrame(taken, "lang string, last_place long, last_tie long, cut long"))
    last = (F.col("place") == F.col("last_place")) & (F.col("tie") == F.col("last_tie"))
    before = (F.col("place") < F.col("last_place")) | ((F.col("place") == F.col("last_place")) & (F.col("tie") < F.col("last_tie")))
    text = F.substr(F.col("text").cast("binary"), F.lit(1), F.when(last, F.col("cut")).otherwise(F.col("size")).cast("int"))
    sample = rows.join(ends, "lang").filter(before | last).select(text.alias("text"), "lang")
    found = sample.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = found.toArrow()
    names, keys, n = np.array(table["lang"].to_pylist(), object), table["gram"].to_numpy().astype(np.uint32), table["n"].to_numpy()
    languages, counts = sorted(set(names)), []
    for lang in languages:
        mine = names == lang
        order = np.argsort(keys[mine])
        counts.append((keys[mine][order], n[mine][order].astype(np.float64)))
    return Model.fit(languages, counts) if languages else None


def judged(batch: pa.RecordBatch, model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and bits per byte of the rows of a batch (text, lettered)."""
    names = np.array([*(model.languages if model else []), UNDECIDED], object)
    data, offsets = buffers(batch.column("text"))
    best = np.full(len(batch), len(names) - 1)
    score, rate = np.zeros(len(batch)), np.zeros(len(batch))
    for first, last in units(np.diff(offsets), SCORED_BYTES) if model else ():
        part = offsets[first : last + 1]
        costs = model.lengths(data[part[0] : part[-1]], part - part[0])
        least = costs.min(axis=1)
        best[first:last] = costs.argmin(axis=1)
        score[first:last] = 1 / np.exp2(np.maximum((least[:, None] - costs) / UNIT, -1000)).sum(axis=1)
        rate[first:last] = least / UNIT / np.maximum(np.diff(part), 1)
    silent = ~batch.column("lettered").to_numpy(zero_copy_only=False)
    best[silent], score[silent] = len(names) - 1, 0
    return names[best], score, rate


def _lettered() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"\p{L}")


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte of every row of ``docs`` (doc_id, text).

    ``und`` with score 0 where text is null or has no letter, or no language was learnt. bits_per_byte is the best
    language's code length over the text's length, null for ``und``. Repeated rows are answered one by one; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, score, rate = judged(batch, shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(name, pa.string()), pa.array(score), pa.array(rate, mask=name == UNDECIDED)],
                names=["doc_id", "lang_pred", "score", "bits_per_byte"],
            )

    rows = documents(docs).withColumn("lettered", _lettered())
    return rows.mapInArrow(task, "doc_id long, lang_pred string, score double, bits_per_byte double")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are text in a learnt language, with all their columns.

    Rejected are null texts, texts without a letter, and texts that no language's model codes in less than the 8 bits a
    byte has anyway. Without a model only the first two go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.select(["_text", "_lettered"]).rename_columns(["text", "lettered"])
            name, _, rate = judged(texts, shared.value)
            stays = (name != UNDECIDED) & (rate < 8) if shared.value else texts.column("lettered").to_numpy(zero_copy_only=False)
            yield batch.select(columns).filter(pa.array(np.asarray(stays, bool)))

    marked = docs.withColumns({"_text": F.coalesce(F.col("text").cast("string"), F.lit("")), "_lettered": _lettered()})
    return marked.mapInArrow(task, docs.schema)
