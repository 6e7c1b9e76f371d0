"""Hierarchical packing into sequences of several lengths.

Documents go by their length to tiers, each with its own context size (a power of two). The longest tier cuts its
documents into whole windows; a window's gap is filled with the longest documents of the shorter tiers that fit, and then
with a part of one more. What is left in a shorter tier fills sequences of that tier's size to the last token, cutting the
document at the seam. So only the last sequences of a block have padding. Sequences are dealt to step groups of equal
token counts, short ones together, so that the steps of a training run take equally long.

Packing needs no shuffle: a task packs blocks of its own documents, bounded in tokens.
"""

import zlib
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from marginalia.llm.common import buffers, documents, units
from marginalia.llm.tokens import encoder as worker_encoder

#: Context sizes, the longest last.
TIERS = (256, 512, 1024, 2048)

#: Bytes of text encoded at a time.
TEXT_BYTES = 4 << 20

#: Tokens that are packed together.
BLOCK_TOKENS = 2_000_000

#: Tokens of a step group.
STEP_TOKENS = 32 * 2048

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

#: A piece: number of the document in its block, start, length.
Piece = tuple[int, int, int]


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Sequences (context size, pieces) that hold each token of each document once."""
    longest, sequences = tiers[-1], []
    waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    open_windows: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        tier = tiers[min(int(np.searchsorted(tiers, n)), len(tiers) - 1)]
        if tier < longest or len(tiers) == 1:
            waiting[tier].append((n, doc, 0))
            continue
        whole = n // longest * longest
        sequences += [(longest, [(doc, at, longest)]) for at in range(0, whole, longest)]
        if n > whole:
            open_windows.append((n - whole, doc, whole))
    short = sorted(x for t in tiers for x in waiting[t])
    tails = deque(sorted(open_windows, reverse=True))
    while tails:
        n, doc, start = tails.popleft()
        pieces, gap = [(doc, start, n)], longest - n
        while gap and (short or tails):
            if not short:  # the shortest of the other windows is given up
                short.append(tails.pop())
            fits = bisect_right(short, (gap, len(lengths), 0)) - 1
            size, other, at = short.pop(max(fits, 0))
            pieces.append((other, at, min(size, gap)))
            if size > gap:
                insort(short, (size - gap, other, at + gap))
            gap -= min(size, gap)
        sequences.append((longest, pieces))
    left: list[Piece] = []
    for low, tier in zip((0, *tiers), tiers, strict=False):
        pieces, room = [], tier
        for size, doc, at in [x for x in short if low < x[0] <= tier]:
            while size:
                take = min(size, room)
                pieces.append((doc, at, take))
                size, at, room = size - take, at + take, room - take
                if not room:
                    sequences.append((tier, pieces))
                    pieces, room = [], tier
        left += pieces
    # What filled no sequence of its tier shares the last ones, of the longest size.
    pieces, room = [], longest
    for doc, at, size in left:
        while size:
            take = min(size, room)
            pieces.append((doc, at, take))
            size, at, room = size - take, at + take, room - take
            if not room:
                sequences.append((longest, pieces))
                pieces, room = [], longest
    if pieces:
        sequences.append((longest, pieces))
    return sequences


def _rows(docs: list[tuple[int | None, np.ndarray]], first_sequence: int, first_step: int) -> tuple[pa.RecordBatch, int, int]:
    sequences = sorted(pack([len(ids) for _, ids in docs]), key=lambda s: s[0])
    columns: list[list] = [[] for _ in range(9)]
    step, filled, size = first_step, 0, 0
    for k, (tier, pieces) in enumerate(sequences):
        if tier != size or filled + tier > STEP_TOKENS:
            step, filled, size = step + bool(filled), 0, tier
        filled, offset = filled + tier, 0
        for doc, start, length in pieces:
            doc_id, ids = docs[doc]
            crc = zlib.crc32(ids[start : start + length])
            row = (doc_id, start, length, crc, len(ids), first_sequence + k, offset, tier, step)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            offset += length
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
    arrays = [pa.array(c, pa.int32() if n == "tier" else pa.int64()) for n, c in zip(names, columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(names)), first_sequence + len(sequences), step + 1


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, cached_words: int | None = None) -> DataFrame:
    """Every document (doc_id, text), with ``end_id`` behind it, in pieces of sequences; see ``PIECES``.

    A sequence has its pieces at gapless offsets from 0 and is as long as a tier's context size, except for at most one in
    each block of BLOCK_TOKENS. Null and empty texts are the end id alone. Repeated rows are packed once each. An
    empty table has no pieces; other columns are ignored. Sequence and step numbers begin anew, far apart, in each task. ``cached_words`` bounds what a Python
    worker remembers, and changes nothing else.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, cached_words)
        block, held = [], 0
        sequence = step = TaskContext.get().partitionId() << 36
        for batch in batches:
            column = batch.column("text")
            for first, last in units(np.diff(buffers(column)[1]), TEXT_BYTES):
                ids, at = encoder.encode(column.slice(first, last - first), end_id)
                doc_ids = batch.column("doc_id").slice(first, last - first).to_pylist()
                block += [(doc_id, ids[a:b]) for doc_id, a, b in zip(doc_ids, at[:-1].tolist(), at[1:].tolist(), strict=True)]
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    rows, sequence, step = _rows(block, sequence, step)
                    block, held = [], 0
                    yield rows
        if block:
            yield _rows(block, sequence, step)[0]
        pa.default_memory_pool().release_unused()

    return documents(docs).mapInArrow(task, PIECES)
