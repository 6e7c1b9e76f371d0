"""Token ids of whole texts by a public tokenizer's file, word by word.

The tokenizer cuts texts at white space and never merges across it, so a text's ids are its words' ids in order. Only a
unit's distinct words are looked at one by one. Their ids are kept in a cache of bounded size, and new words go through the
tokenizer many at a time.
"""

from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from marginalia.llm.common import ranges

#: Words that a Python worker keeps beside those of the unit in hand, and ids for each of them.
CACHED_WORDS, CACHED_IDS = 1_000_000, 8

#: Words of letters that the tokenizer gets as one text.
JOINED = 200

#: A token of the vocabulary that the tokenizer finds before anything else, so it cuts a text without a trace.
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids as little-endian unsigned 32-bit integers; no special tokens are added."""

    def __init__(self, path: str, words: int | None = None):
        self.most = words or CACHED_WORDS
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        for token, at in self.tokenizer.get_vocab().items():
            self.ends[at] = token.endswith("</w>")
        self.special = np.zeros(self.size, bool)
        self.special[self.tokenizer.token_to_id(SPECIAL)] = True
        self._forget()

    def _forget(self) -> None:
        # Known words by number; where each begins in the ids, and how many it has.
        self.words: dict[str, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Few at a time: the tokenizer's answers are many times as large as the ids."""
        for first in range(0, len(texts), 32):
            for e in self.tokenizer.encode_batch_fast(texts[first : first + 32], add_special_tokens=False):
                yield np.array(e.ids, "<u4")

    def _each(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        ids = list(self._encoded(words))
        return ids, [np.array([0, len(x)]) for x in ids]

    def _joined(self, words: list[str], between: str, is_end: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Texts of many words each; their ids, and the ends of the words in them after a 0."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        ids, bounds = [], []
        for group, found in zip(groups, self._encoded([between.join(x) + between for x in groups]), strict=True):
            ends = np.flatnonzero(is_end[found]) + 1
            if len(ends) == len(group):
                ids.append(found)
                bounds.append(np.concatenate(([0], ends)))
            else:
                alone = self._each(group)
                ids += alone[0]
                bounds += alone[1]
        return ids, bounds

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        special = [w for w in words if "<" in w]
        odd = [w for w in words if w and not w.isalpha() and "<" not in w]
        parts = [(plain, 0, *self._joined(plain, " ", self.ends)), (odd, 1, *self._joined(odd, SPECIAL, self.special)), (special, 0, *self._each(special))]
        ids, starts, sizes = [self.ids], [self.starts], [self.sizes]
        base = len(self.ids)
        for names, between, found, bounds in parts:
            self.words.update(zip(names, range(len(self.words), len(self.words) + len(names)), strict=True))
            for x, b in zip(found, bounds, strict=True):
                # A word of the odd ones ends before the token that follows it.
                starts.append(base + b[:-1])
                sizes.append(np.diff(b) - between * (len(b) - 1 == np.count_nonzero(self.special[x])))
                ids.append(x)
                base += len(x)
        if "" in words:
            self.words[""] = len(self.words)
            starts.append(np.zeros(1, np.int64))
            sizes.append(np.zeros(1, np.int64))
        self.ids, self.starts, self.sizes = (np.concatenate(x) for x in (ids, starts, sizes))

    def _known(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct words."""
        find = lambda some: np.fromiter(map(self.words.get, some, repeat(-1)), np.int64, len(some))
        at = find(words)
        missing = np.flatnonzero(at < 0)
        if len(self.words) + len(missing) > self.most or len(self.ids) > CACHED_IDS * self.most:
            self._forget()
            missing = np.arange(len(words))
        new = [words[i] for i in missing.tolist()]
        if new:
            self._learn(new)
            at[missing] = find(new)
        return at

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other and each with ``end_id`` behind it, and the texts' offsets in them."""
        texts = texts.fill_null("")
        # The vocabulary is in lower case; a special token is one only as it is written.
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts)))
        coded = words.flatten().dictionary_encode()
        at = self._known(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        of_words, bounds = self.sizes[at], words.offsets.to_numpy() - words.offsets[0].as_py()
        tokens = self.ids[ranges(self.starts[at], of_words)]
        offsets = np.concatenate(([0], np.cumsum(of_words)))[bounds]
        if end_id is not None:
            tokens = np.insert(tokens, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
        return tokens.astype("<u4", copy=False), offsets


@cache
def encoder(path: str, words: int | None = None) -> Encoder:
    """This Python worker's encoder: its words serve all the tasks that run here, one after the other."""
    return Encoder(path, words)
