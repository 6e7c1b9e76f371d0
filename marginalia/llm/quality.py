"""Quality by naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, a linear hinge-loss model.

A text's n-grams are three bytes in a row and the shapes of three words in a row: how a word is cased, how it ends,
whether it repeats the word before. Both are hashed to FEATURES numbers, and only whether one occurs counts. An indicator weighs
log(p / q), p and q being the smoothed shares of the classes' indicators that are this one; a text's vector has length one. Dual coordinate
descent fits the hinge loss: one dual variable for each text of the sample, moved to its best value in turn. Margins of texts that a
fold's model did not see give the logistic curve from a margin to a score, each class weighted by its share of all labels.

The fit takes at most SAMPLE texts of each class, the first by a hash of doc_id, with at most INDICATORS indicators: a bounded
sample, whatever the table's size. Their texts are whole; only ids of the labels are ever sorted.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import buffers, documents, spans_of_words, units, word_hashes
from marginalia.scratch import written_once

#: Labelled texts of each class in the sample, and indicators of each class, at most (but at least one text).
SAMPLE, INDICATORS = 2_000, 4_000_000

#: Numbers that n-grams are hashed to, as a power of two.
BITS = 18
FEATURES = 1 << BITS

#: Added to every count; the bound of a dual variable; rounds over the sample; folds for the curve.
SMOOTHING, BOUND, ROUNDS, FOLDS = 1.0, 1.0, 12, 3

#: A score from here on predicts label 1.
THRESHOLD = 0.3

#: Texts and bytes of text worked on at a time.
TEXTS, BYTES = 8192, 1 << 20

#: Stand before and behind a text.
_BEFORE, _BEHIND = 2, 3

#: Codes of word shapes, one more for before and behind a text.
_SHAPES = 25


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The shape of each word: case (none of it upper, the first letter, all, no letter), last character, repetition."""
    upper = (data >= 65) & (data <= 90)
    lower = ((data >= 97) & (data <= 122)) | (data >= 128)
    within = lambda marks: (np.concatenate(([0], np.cumsum(marks)))[[ends, starts]] * [[1], [-1]]).sum(axis=0)
    uppers, lowers = within(upper), within(lower)
    case = np.select([uppers + lowers == 0, uppers == 0, lowers == 0], [3, 0, 2], 1)
    last = data[ends - 1]
    ending = np.select([upper[ends - 1] | lower[ends - 1], np.isin(last, list(b".,;:"))], [0, 1], 2)
    same = np.zeros(len(starts), np.int64)
    if len(starts) > 1:
        h = word_hashes(data, starts, ends)
        same[1:] = (h[1:] == h[:-1]) & (np.diff(ends - starts) == 0)
        same[first[first < len(starts)]] = 0
    return case + 4 * ending + 12 * same


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the n-grams that occur in each text, and where each text's begin. Every text has some."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    # Two bytes before each text and one behind.
    at = offsets[:-1] + 3 * np.arange(n)
    padded = np.full(len(data) + 3 * n, _BEFORE, np.uint32)
    padded[np.arange(len(data)) + 3 * np.repeat(np.arange(n), sizes) + 2] = data
    padded[at + sizes + 2] = _BEHIND
    grams = padded[:-2] | (padded[1:-1] << np.uint32(8)) | (padded[2:] << np.uint32(16))
    owner = np.repeat(np.arange(n, dtype=np.uint32), sizes + 3)
    whole = owner[:-2] == owner[2:]
    keys = [owner[:-2][whole] << np.uint32(BITS) | (grams[whole] * np.uint32(2654435769)) >> np.uint32(32 - BITS)]
    starts, ends, first = spans_of_words(data, offsets)
    if len(starts):
        counts = np.diff(first)
        lined = np.full(len(starts) + 2 * n, _SHAPES - 1, np.uint32)
        lined[np.arange(len(starts)) + 2 * np.repeat(np.arange(n), counts) + 1] = shapes(data, starts, ends, first)
        grams = (lined[:-2] * np.uint32(_SHAPES) + lined[1:-1]) * np.uint32(_SHAPES) + lined[2:] + np.uint32(1 << 24)
        owner = np.repeat(np.arange(n, dtype=np.uint32), counts + 2)
        whole = owner[:-2] == owner[2:]
        keys.append(owner[:-2][whole] << np.uint32(BITS) | (grams[whole] * np.uint32(2654435769)) >> np.uint32(32 - BITS))
    found = np.concatenate(keys)
    found.sort()
    found = found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found
    return (found & np.uint32(FEATURES - 1)).astype(np.int64), np.searchsorted(found, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS))


def portions(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last text of each portion of a column, and the indicators of its texts."""
    data, offsets = buffers(column)
    for begin in range(0, len(column), TEXTS):
        end = min(len(column), begin + TEXTS)
        for first, last in units(np.diff(offsets[begin : end + 1]), BYTES):
            part = offsets[begin + first : begin + last + 1]
            yield begin + first, begin + last, *indicators(data[part[0] : part[-1]], part - part[0])


@dataclass
class Model:
    """Of each indicator its squared scale and its part of a margin; the constant part; slope and place of the curve."""

    squares: np.ndarray
    parts: np.ndarray
    constant: float
    slope: float
    place: float

    def margins(self, found: np.ndarray, begin: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        sums, squares = (np.bincount(owner, x[found], len(begin) - 1) for x in (self.parts, self.squares))
        return sums / np.sqrt(np.maximum(squares, 1e-300)) + self.constant

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.place, -500, 500)))


def ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """log(p / q) of every indicator, p of the texts labelled 1 and q of the others."""
    shares = []
    for side in (good, ~good):
        of = [rows[i] for i in np.flatnonzero(side)]
        counts = SMOOTHING + np.bincount(np.concatenate(of), minlength=FEATURES)
        shares.append(counts / counts.sum())
    return np.log(shares[0] / shares[1])


def descended(rows: list[np.ndarray], good: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled indicators and the constant that minimise |w|^2 / 2 + BOUND * hinge losses, by dual coordinate descent."""
    y = np.where(good, 1.0, -1.0)
    lengths = [np.sqrt(np.maximum(np.square(scale[r]).sum(), 1e-300)) for r in rows]
    vectors = [scale[r] / n for r, n in zip(rows, lengths, strict=True)]
    squares = [float(v @ v) + 1.0 for v in vectors]
    alpha, w, constant = np.zeros(len(rows)), np.zeros(FEATURES), 0.0
    draw = np.random.default_rng(0)
    for _ in range(ROUNDS):
        most = 0.0
        for i in draw.permutation(len(rows)):
            r, v = rows[i], vectors[i]
            slope = y[i] * (float(w[r] @ v) + constant) - 1.0
            new = min(max(alpha[i] - slope / squares[i], 0.0), BOUND)
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                constant += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w, constant


def curve(margins: np.ndarray, good: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and place of the logistic curve through the margins, by Newton's steps with halving."""
    # Smoothed targets keep the curve finite where the classes lie apart.
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x = np.stack([margins, np.ones(len(margins))])

    def loss(theta):
        z = theta @ x
        return float((weights * (np.logaddexp(0, z) - target * z)).sum())

    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -500, 500)))
        gradient = x @ (weights * (p - target))
        step = np.linalg.solve((x * (weights * p * (1 - p))) @ x.T + 1e-9 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], good: np.ndarray, shares: tuple[float, float]) -> Model:
    """The model of texts' indicators and labels; shares of labels 0 and 1 in all labelled rows.

    Without texts of both classes every score is the share of label 1, one half without any.
    """
    if not good.any() or good.all():
        share = np.clip(shares[1] / sum(shares) if sum(shares) else 0.5, 1e-6, 1 - 1e-6)
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, float(np.log(share / (1 - share))))

    def trained(on: np.ndarray) -> Model:
        of = [rows[i] for i in np.flatnonzero(on)]
        scale = ratios(of, good[on])
        w, constant = descended(of, good[on], scale)
        return Model(np.square(scale), w * scale, constant, 1.0, 0.0)

    whole = trained(np.ones(len(rows), bool))
    fold = np.zeros(len(rows), np.int64)
    for side in (good, ~good):
        fold[side] = np.arange(side.sum()) % FOLDS
    margins, seen = np.zeros(len(rows)), np.zeros(len(rows), bool)
    for k in range(FOLDS):
        out = fold == k
        if out.any() and len({*good[~out]}) == 2:
            of = [rows[i] for i in np.flatnonzero(out)]
            margins[out] = trained(~out).margins(np.concatenate(of), np.concatenate(([0], np.cumsum([len(r) for r in of]))))
            seen |= out
    if len({*good[seen]}) < 2:
        margins, seen = whole.margins(np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))), np.ones(len(rows), bool)
    weights = np.where(good[seen], shares[1] / good[seen].sum(), shares[0] / (~good[seen]).sum())
    whole.slope, whole.place = curve(margins[seen], good[seen], weights / weights.sum() * seen.sum())
    return whole


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The indicators of each text of the sample."""
    for batch in batches:
        for first, last, found, begin in portions(batch.column("text")):
            of = [found[a:b].astype(np.uint32).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            part = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [part.column("quality"), part.column("place"), part.column("tie"), pa.array(np.diff(begin).astype(np.int64)), pa.array(of, pa.binary())],
                names=["quality", "place", "tie", "n", "found"],
            )


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of ``docs`` (doc_id, text) whose ids ``labels`` (doc_id, quality) gives a quality of 0 or 1.

    Ids labelled both ways are not used, nor null ids and ids without a document; null texts are empty. Ids are joined and
    sorted, texts only travel for the sample.
    """
    judged = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    judged = judged.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    there = documents(docs).select("doc_id").distinct()
    judged = judged.filter("quality = most").drop("most").join(there, "doc_id", "left_semi")
    judged = written_once(judged.withColumn("place", F.xxhash64("doc_id", F.lit("quality"))))
    counts = {r["quality"]: r["count"] for r in judged.groupBy("quality").count().collect()}
    chosen = [judged.filter(F.col("quality") == q).orderBy("place", "doc_id").limit(SAMPLE) for q in (0, 1)]
    # At most twice SAMPLE ids: a proven bound.
    sample = documents(docs).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").withColumn("tie", F.xxhash64("text"))
    marked = written_once(sample.mapInArrow(_marked, "quality int, place long, tie long, n long, found binary"))
    rows, good = [], []
    for q in (0, 1):
        mine = marked.filter(F.col("quality") == q)
        # Repeated ids may bring more rows than SAMPLE; the first that fit are taken.
        sizes = np.array([tuple(r) for r in mine.select("place", "tie", "n").orderBy("place", "tie").limit(SAMPLE).collect()], np.int64).reshape(-1, 3)
        if not len(sizes):
            continue
        last = sizes[max(0, int(np.searchsorted(np.cumsum(sizes[:, 2]), INDICATORS, "right")) - 1)]
        upto = (F.col("place") < int(last[0])) | ((F.col("place") == int(last[0])) & (F.col("tie") <= int(last[1])))
        table = mine.filter(upto).orderBy("place", "tie").limit(SAMPLE).select("found").toArrow()
        rows += [np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in table["found"]]
        good += [q == 1] * len(table)
    return fit(rows, np.array(good, bool), (counts.get(0, 0), counts.get(1, 0)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs`` (doc_id, text).

    score is between 0 and 1, higher where label 1 is likelier; predicted is 1 from THRESHOLD on. A null text is empty, and
    empty texts are scored like others: that a text ends at once is an indicator. Repeated rows are answered one by one;
    other columns are ignored, an empty table gives no rows. The model broadcast is of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = np.zeros(len(batch))
            for first, last, found, begin in portions(batch.column("text")):
                margins[first:last] = shared.value.margins(found, begin)
            score = shared.value.scores(margins)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    return documents(docs).mapInArrow(task, "doc_id long, score double, predicted int")
