"""SentencePiece encoding and decoding by suffix-array matching.

A unit's distinct words are laid end to end and indexed by a suffix array, sorted as far as the longest piece reaches. Every
piece of the model is searched for by bisection, symbol by symbol for all pieces at once; the range it ends with are its
occurrences. These are edges over the text, put in order by position. The model is of the merging kind, so the
edges are not relaxed to a shortest path (that gives other ids): an edge joins two neighbouring symbols when no pair of its
word has an edge with a better score, leftmost first, until no edge joins any two. All words advance together, one merge
each per round; words longer than ROUND_SYMBOLS take their merges from a heap.

Words can be encoded alone because pieces hold the space mark only in front. Symbols without a piece become their bytes' pieces.
"""

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from marginalia.llm.common import buffers, documents, ranges, units

MARK = "▁"

#: Bytes of text encoded at a time, and symbols of a word that merges in rounds.
TEXT_BYTES, ROUND_SYMBOLS = 4 << 20, 64

_UNITS = re.compile(f"{MARK}+[^{MARK}]*")

#: Stands behind each word; no character.
_END = 0x110000


class Model:
    """A model's pieces as arrays: symbols, lengths, scores; and each id's bytes for decoding."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        bytes_ = [model.is_byte(i) for i in range(n)]
        plain = [i for i in range(n) if not (bytes_[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = np.array(plain)
        self.lengths = np.array([len(pieces[i]) for i in plain])
        self.longest = int(self.lengths.max())
        self.symbols = np.full((len(plain), self.longest), -1, np.int64)
        for row, i in enumerate(plain):
            self.symbols[row, : len(pieces[i])] = [ord(c) for c in pieces[i]]
        self.scores = np.full(n + 1, -np.inf)
        self.scores[plain] = [model.get_score(i) for i in plain]
        self.byte_ids = np.zeros(256, np.int64)
        self.unknown = model.unk_id()
        self.texts = [b""] * n
        for i in range(n):
            if bytes_[i]:
                value = int(pieces[i][3:5], 16)
                self.byte_ids[value], self.texts[i] = i, bytes([value])
            elif not model.is_control(i):
                self.texts[i] = pieces[i].replace(MARK, " ").encode()
        self.texts[self.unknown] = " ⁇ ".encode()


@cache
def model(path: str) -> Model:
    """This Python worker's model."""
    return Model(path)


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` symbols from there on, at least; by doubling."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order, size = np.argsort(rank, kind="stable"), 1
    while size < depth:
        behind = np.zeros(len(rank), np.int64)
        behind[:-size] = rank[size:] + 1 if size < len(rank) else 0
        key = rank * (len(rank) + 2) + behind
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
        size *= 2
    return order


def occurrences(symbols: np.ndarray, order: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range of the suffix array whose suffixes begin with it."""
    low, high = np.zeros(len(m.ids), np.int64), np.full(len(m.ids), len(order), np.int64)
    padded = np.append(symbols, np.full(m.longest, -2))

    def bound(rows, depth, want, above):
        """The first place in each range whose symbol at ``depth`` is not below (or is above) the wanted one."""
        a, b = low[rows].copy(), high[rows].copy()
        while (open_ := a < b).any():
            middle = (a + b) >> 1
            here = padded[order[np.minimum(middle, len(order) - 1)] + depth]
            right = open_ & ((here <= want) if above else (here < want))
            a, b = np.where(right, middle + 1, a), np.where(open_ & ~right, middle, b)
        return a

    for depth in range(m.longest):
        rows = np.flatnonzero((m.lengths > depth) & (low < high))
        want = m.symbols[rows, depth]
        low[rows], high[rows] = bound(rows, depth, want, False), bound(rows, depth, want, True)
    return low, high


def _heap(edges: np.ndarray, scores: np.ndarray, start: int, n: int) -> list[tuple[int, int]]:
    """Merges of one long word: (start, length) of its symbols."""
    sizes, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
    best = lambda i, size: scores[edges[start + i, size]] if size < edges.shape[1] else -np.inf
    heap = [(-s, i, 1, 1) for i in range(n - 1) if (s := best(i, 2)) > -np.inf]
    heapify(heap)
    while heap:
        _, i, own, other = heappop(heap)
        j = after[i] if sizes[i] == own else n
        if j >= n or sizes[j] != other:
            continue
        sizes[i], sizes[j], after[i] = own + other, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (s := best(a, sizes[a] + sizes[b])) > -np.inf:
                heappush(heap, (-s, a, sizes[a], sizes[b]))
    out, i = [], 0
    while i < n:
        out.append((start + i, sizes[i]))
        i = after[i]
    return out


def merged(edges: np.ndarray, scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols that remain of each word: word, start, length, in order."""
    done = []
    for w in np.flatnonzero(sizes > ROUND_SYMBOLS).tolist():
        found = np.array(_heap(edges, scores, int(starts[w]), int(sizes[w])))
        done.append((np.full(len(found), w), found[:, 0], found[:, 1]))
    short = np.flatnonzero((sizes <= ROUND_SYMBOLS) & (sizes > 0))
    word, at = np.repeat(short, sizes[short]), ranges(starts[short], sizes[short])
    length = np.ones(len(at), np.int64)
    while len(word):
        score = np.full(len(word), -np.inf)
        both = length[:-1] + length[1:]
        pair = np.flatnonzero((word[1:] == word[:-1]) & (both < edges.shape[1]))
        score[pair] = scores[edges[at[pair], both[pair]]]
        head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        count = np.diff(np.append(head, len(word)))
        best = np.maximum.reduceat(score, head)
        over = np.repeat(best == -np.inf, count)
        done.append((word[over], at[over], length[over]))
        hit = np.flatnonzero((score == np.repeat(best, count)) & ~over)
        first = hit[np.append(True, word[hit][1:] != word[hit][:-1])] if len(hit) else hit
        length[first] += length[first + 1]
        keep = ~over
        keep[first + 1] = False
        word, at, length = word[keep], at[keep], length[keep]
    word, at, length = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((at, word))
    return word[order], at[order], length[order]


def encode_words(words: list[str], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words (each with the mark in front), one after the other, and the words' offsets."""
    joined = "".join(MARK + w + "\x00" for w in words)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    symbols[starts + sizes] = _END
    order = suffix_array(symbols, m.longest)
    low, high = occurrences(symbols, order, m)
    edges = np.full((len(symbols), m.longest + 1), len(m.scores) - 1, np.int32)
    count = high - low
    # By position: a place and a length have one piece at most.
    edges[order[ranges(low, count)], np.repeat(m.lengths, count)] = np.repeat(m.ids, count)
    word, at, length = merged(edges, m.scores, starts, sizes)
    ids = edges[at, length].astype(np.int64)
    odd = np.flatnonzero(ids == len(m.scores) - 1)
    many = np.ones(len(ids), np.int64)
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in symbols[at[odd]].tolist()]
    many[odd] = [len(x) for x in raw]
    out = np.repeat(ids, many)
    out[ranges((np.cumsum(many) - many)[odd], many[odd])] = m.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    total = np.concatenate(([0], np.cumsum(many)))
    return out, total[np.searchsorted(word, np.arange(len(words) + 1))]


def words_of(text: str) -> list[str]:
    """The words of a text without their marks; spaces that stand before another space's word stay with it."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    if text[0] == " " or "  " in text:
        return [u[1:] for u in _UNITS.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def encode(texts: list[str], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and the texts' offsets."""
    split = list(map(words_of, texts))
    number: dict[str, int] = {}
    at = np.array([number.setdefault(w, len(number)) for w in chain.from_iterable(split)], np.int64)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    ids, offsets = encode_words(list(number), m)
    size = np.diff(offsets)[at]
    total = np.concatenate(([0], np.cumsum(size)))
    return ids[ranges(offsets[at], size)], total[np.concatenate(([0], np.cumsum(list(map(len, split))))).astype(np.int64)]


def decode(ids: list[int], m: Model) -> str:
    """The text of ids; bytes that are no text become the replacement mark."""
    return b"".join(map(m.texts.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids) and decoded_sha256 of every row of ``docs`` (doc_id, text).

    decoded_sha256 is of the text that the ids decode to, which is the text itself with each space mark a space. Null and empty
    texts have no ids. Repeated rows are answered one by one; other columns are ignored; an empty table has no rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            column, counts, crcs, digests = batch.column("text"), [], [], []
            for first, last in units(np.diff(buffers(column)[1]), TEXT_BYTES):
                ids, at = encode(column.slice(first, last - first).to_pylist(), m)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    counts.append(b - a)
                    crcs.append(zlib.crc32(ids[a:b].astype("<u4")))
                    digests.append(hashlib.sha256(decode(ids[a:b].tolist(), m).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"],
            )

    return documents(docs).mapInArrow(task, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string")
