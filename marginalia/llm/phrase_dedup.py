"""Repeated passages of words: sharded Aho-Corasick automata over recurring phrases.

Every word covered by a window of WINDOW words that also starts in a document with a smaller doc_id goes. A passage recurs
only where its anchor phrase of ANCHOR words does. Recurring phrases are confirmed by an exchange of hashes (see ``passages``), which
routes to each shard the text around every place that can hold one of its phrases, so the work is linear and not shards times
documents. The shard compiles its phrases into one automaton and streams those texts through it. Where the automaton finds a
phrase, there the text is laid beside the others that hold it; windows around the finds are compared word by word, and equal ones
lead to a removal. What no automaton finds is not removed.
"""

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm import passages
from marginalia.llm.common import ranges, spans_of_words, word_hashes

WINDOW, ANCHOR = 50, 8

#: Pieces that are laid side by side, about; those with one phrase always are.
TOGETHER = 1 << 16


def read(data: np.ndarray, offsets: np.ndarray) -> passages.Symbols:
    starts, ends, first = spans_of_words(data, offsets)
    return passages.Symbols(word_hashes(data, starts, ends), first, starts, ends, data)


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Finds each phrase between spaces; its value is its place in the list."""
    found = ahocorasick.Automaton()
    for at, phrase in enumerate(phrases):
        found.add_word(f" {phrase} ", at)
    found.make_automaton()
    return found


def located(texts: list[list[str]], windows: list[int], found: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, phrase, word) of the first place at which all of a text's windows hold the phrase, for each phrase found there."""
    out: list[tuple[int, int, int]] = []
    for at, (words, n) in enumerate(zip(texts, windows, strict=True)):
        ends, seen = list(accumulate(len(w) + 1 for w in words)), set()
        for end, phrase in found.iter(f" {' '.join(words)} "):
            word = bisect_left(ends, end) + 1 - ANCHOR
            if phrase not in seen and n - 1 <= word <= WINDOW - ANCHOR:
                seen.add(phrase)
                out.append((at, phrase, word))
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def solve(asked: passages.Asked) -> np.ndarray:
    # A window that no find leads to takes nothing out.
    least = np.full(int(asked.windows.sum()), np.iinfo(np.int64).max)
    begin, span = np.cumsum(asked.windows) - asked.windows, WINDOW - ANCHOR + 1
    # One character for each byte, so that lengths agree.
    texts = [[x.decode("latin-1") for x in asked.data[a:b].tobytes().split()] for a, b in zip(asked.offsets[:-1], asked.offsets[1:], strict=True)]
    phrases = list(dict.fromkeys(" ".join(words[c : c + ANCHOR]) for words, c in zip(texts, asked.column.tolist(), strict=True)))
    if not phrases:
        return least
    text, phrase, word = located(texts, asked.windows.tolist(), automaton(phrases))
    groups = len(text) // TOGETHER + 1
    for g in range(groups):
        finds = np.flatnonzero(phrase % groups == g)
        if not len(finds):
            continue
        # A text that holds several phrases is laid beside the others at each.
        names: dict[str, int] = {}
        mine = text[finds]
        first = span - 1 - word[finds]
        windows = asked.windows[mine]
        size = windows + WINDOW - 1
        columns = np.zeros((span - 1 + WINDOW, len(mine)), np.uint32)
        symbols = [names.setdefault(w, len(names) + 1) for i in mine.tolist() for w in texts[i]]
        columns[ranges(first, size), np.repeat(np.arange(len(mine)), size)] = symbols
        told = passages.equal_windows(columns, first, windows, asked.docs[mine], WINDOW)
        np.minimum.at(least, ranges(begin[mine], windows), told)
    return least


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
        counts, removed, digests = [], [], []
        for text, a, b in zip(passages.unpacked(batch.column("packed")), starts, ends, strict=True):
            words = text.split()
            counts.append(len(words))
            if a:
                for low, high in reversed(list(zip(np.frombuffer(a, np.int64).tolist(), np.frombuffer(b, np.int64).tolist(), strict=True))):
                    del words[low:high]
            removed.append(counts[-1] - len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, key, packed) and the ranges of words to remove (doc_id, key, starts, ends)."""
    return passages.removable(docs, read, solve, WINDOW, ANCHOR)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by one space) of every row of ``docs`` (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; a null text has none. Rows with the same doc_id take nothing from each other,
    rows with a null doc_id take part in nothing; both are returned. Empty tables give empty results; other columns are
    ignored.
    """
    rows, cut = spans(docs)
    whole = rows.join(cut, ["doc_id", "key"], "left")
    return whole.mapInArrow(_applied, "doc_id long, n_words long, n_removed long, kept_sha256 string")
