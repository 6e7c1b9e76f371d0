"""Shared ground of the two operators that look for long repeats: where could equal windows be, and bringing them together.

A text is a row of symbols (bytes, or words). A window is WINDOW consecutive symbols. The least hash among the k-symbol
strings of a window, leftmost first, is its anchor: a function of the window's content alone, so equal windows have equal
anchors at equal places. Consecutive windows with one anchor form a piece; pieces hold every window exactly once.

1. Every task sends the anchors' hashes of a block of documents, each once, to shards by hash. A shard tells each block which
   of its anchors other documents have too. Only pieces at such anchors go on; all others hold no repeated window.
2. Pieces go to shards by anchor, equal pieces of a block once, with the block's smallest doc_id. A shard finds equal windows
   and each one's smallest doc_id; this is the part the two operators do by methods of their own.
3. What a shard found returns to the block, where the pieces' places were kept, and becomes ranges to remove.

Blocks travel as rows of arrays. Rows that only wait for an answer take the same exchanges as those that ask ("parked"), so
no stage is computed twice, and no key gathers more than one row of a block. Hot anchors, found in step 1 by their number of
blocks, send single windows by the windows' own hash, so a line of a third of all documents with ever new neighbours is spread
over all shards.

All that is exchanged is compressed before: texts one by one, arrays as differences where they ascend. Anchors are asked about with
some of their hash's bits, a piece's place in its shard is told only where it repeats an earlier piece, and of a piece that the
block has of one document only a shard tells the windows that a smaller doc_id has.
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import buffers, documents, hashes, longs, mixed, ranges, shard_keys, shuffle_partitions, text_key, units

#: An anchor that so many blocks have is hot.
HOT_BLOCKS = 64

_ROW = "shard int, block long, kind int, a binary, b binary, c binary, d binary, e binary"
_SCHEMA = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in _ROW.split(", ")])

#: Bytes of text that anchors are sought in at a time.
UNIT = 1 << 19

#: Text of a block of pieces, about.
BLOCK = 1 << 26

#: Bits of an anchor's hash that are left out when it is asked about. Anchors that agree in the others cost a comparison and no more.
SPARED, ASKED_BYTES = np.uint64(24), 5

#: Levels of compression: of what is kept as it is, and of the pieces' texts, of which most is moved.
LEVEL, TEXT_LEVEL = 3, 6

#: In the column of a piece that a block has of several doc_ids.
SHARED = 1 << 15

#: Kinds of rows; what is parked comes first.
PARKED, ASKING, ANSWER = 0, 1, 2


class Symbols(NamedTuple):
    """The symbols of some texts: values (bytes or word hashes), each text's first symbol, each symbol's bytes in the data."""

    values: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


class Pieces(NamedTuple):
    """Pieces in the symbols of a unit: first symbol, number of windows, place of the first window before the anchor, anchor."""

    first: np.ndarray
    windows: np.ndarray
    column: np.ndarray
    anchor: np.ndarray


def _planes(x: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones and so on, compressed: the exchanges' own compression finds less in them."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), LEVEL)


def _array(row: dict, name: str, kind) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(row[name]), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(data.T).view(kind).ravel()


def _row(shard: int, block: int, kind: int, *arrays) -> dict:
    """Arrays as planes; bytes stay as they are."""
    return {"shard": shard, "block": block, "kind": kind} | {n: x if isinstance(x, bytes) else _planes(x) for n, x in zip("abcde", arrays, strict=False)}


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences, the first value from 0; ``_summed`` undoes it, also where they overflow."""
    return np.diff(x, prepend=x.dtype.type(0))


def _summed(row: dict, name: str, kind) -> np.ndarray:
    return np.cumsum(_array(row, name, kind), dtype=kind)


def _asked(anchor: np.ndarray) -> np.ndarray:
    """What an anchor is asked about with."""
    return anchor >> SPARED


def _short(x: np.ndarray) -> np.ndarray:
    """The bytes that such numbers have, a row for each."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :ASKED_BYTES])


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // ASKED_BYTES, 8), np.uint8)
    out[:, :ASKED_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, ASKED_BYTES)
    return out.view(np.uint64).ravel()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdCompressor(LEVEL)
    for batch in batches:
        texts = [tool.compress(x.as_buffer()) for x in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(texts, pa.binary())], names=["doc_id", "key", "packed"])


def unpacked(column: pa.Array) -> Iterator[bytes]:
    """The texts of a column ``packed``."""
    tool = zstandard.ZstdDecompressor()
    for x in column:
        yield tool.decompress(x.as_buffer())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def pieces(symbols: Symbols, window: int, k: int) -> Pieces:
    """The pieces of all texts; texts shorter than a window have none."""
    n, span = len(symbols.values), window - k + 1
    none = Pieces(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64)))
    if n < window:
        return none
    levels = [hashes(symbols.values, np.arange(n - k + 1), np.arange(k, n + 1))]
    while 2 << (len(levels) - 1) <= span:
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    top = len(levels) - 1
    shift = span - (1 << top)
    least = np.minimum(levels[top][: n - window + 1], levels[top][shift : shift + n - window + 1])
    # Windows that reach into the next text are none.
    inside = np.ones(n - window + 1, bool)
    for end in symbols.offsets[1:]:
        inside[max(0, end - window + 1) : max(0, end)] = False

    def anchors(starts: np.ndarray) -> np.ndarray:
        """Where each window's least hash stands first, by halves."""
        want, at = least[starts], starts.copy()
        at += shift * (levels[top][at] != want)
        for level in range(top - 1, -1, -1):
            at += (1 << level) * (levels[level][at] != want)
        return at

    starts = np.flatnonzero(inside)
    if not len(starts):
        return none
    new = np.ones(len(starts), bool)
    new[1:] = (least[starts[1:]] != least[starts[:-1]]) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(starts)))
    at = anchors(starts[first])
    # A run of one least hash that goes on behind its first place has it again: those windows are looked at one by one.
    kept = np.minimum(size, at - starts[first] + 1)
    rest = starts[ranges(first + kept, size - kept)]
    if len(rest):
        place = anchors(rest)
        begin = np.ones(len(rest), bool)
        begin[1:] = (place[1:] != place[:-1]) | (np.diff(rest) != 1)
        more = np.flatnonzero(begin)
        head, at = np.concatenate((starts[first], rest[more])), np.concatenate((at, place[more]))
        kept = np.concatenate((kept, np.diff(np.append(more, len(rest)))))
        order = np.argsort(head)
        head, at, kept = head[order], at[order], kept[order]
    else:
        head = starts[first]
    return Pieces(head, kept, at - head, levels[0][at])


Reader = Callable[[np.ndarray, np.ndarray], Symbols]


def _segments(data: np.ndarray, offsets: np.ndarray, read: Reader) -> Iterator[tuple[int, int, Symbols]]:
    """Units of texts with their symbols."""
    for first, last in units(np.diff(offsets), UNIT):
        part = offsets[first : last + 1]
        yield first, last, read(data[part[0] : part[-1]], part - part[0])


def _by_shard(keys: np.ndarray, shards: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    shard = (mixed(keys) % np.uint64(len(shards))).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(len(shards) + 1))
    for s, name in enumerate(shards):
        if bounds[s] < bounds[s + 1]:
            yield name, order[bounds[s] : bounds[s + 1]]


def _any_shard(block: int, shards: list[int]) -> int:
    """Where a block's parked rows wait."""
    return shards[int(mixed(np.array([block], np.uint64))[0] % np.uint64(len(shards)))]


def _anchors(read: Reader, window: int, k: int, shards: list[int]):
    """Of each block: its rows' keys and distinct (row, anchor) to wait, its distinct anchors to ask about."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            docs, anchors = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for first, _, symbols in _segments(data, offsets, read):
                found = pieces(symbols, window, k)
                docs.append(first + np.searchsorted(symbols.offsets, found.first, "right") - 1)
                anchors.append(_asked(found.anchor))
            docs, anchors = np.concatenate(docs).astype(np.uint32), np.concatenate(anchors)
            order = np.lexsort((docs, anchors))
            docs, anchors = docs[order], anchors[order]
            keep = np.ones(len(docs), bool)
            keep[1:] = (docs[1:] != docs[:-1]) | (anchors[1:] != anchors[:-1])
            docs, anchors = docs[keep], anchors[keep]
            block, number = (TaskContext.get().partitionId() << 32) + number, number + 1
            keys = (longs(batch.column("doc_id")), longs(batch.column("key")))
            rows = [_row(_any_shard(block, shards), block, PARKED, *keys)]
            for shard, at in _by_shard(anchors, shards):
                mine = anchors[at]
                head = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
                twice = np.diff(np.append(head, len(mine))) > 1
                rows.append(_row(shard, block, ASKING, _steps(mine[head]), twice, np.diff(np.append(head, len(mine))).astype(np.uint32), docs[at]))
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return task


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a shard: for each block the (row, anchor) that another row has too, and whether the anchor is hot."""
    asking: list[dict] = []
    for row in _rows(batches):
        if row["kind"] == PARKED:
            yield pa.RecordBatch.from_pylist([row], _SCHEMA)
        else:
            asking.append(row)
    if not asking:
        return
    own = [_summed(r, "a", np.uint64) for r in asking]
    anchors = np.concatenate(own)
    twice = np.concatenate([_array(r, "b", bool) for r in asking])
    order = np.argsort(anchors, kind="stable")
    ordered = anchors[order]
    head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    blocks = np.diff(np.append(head, len(ordered)))
    shared = np.repeat((blocks > 1) | (np.add.reduceat(twice[order], head) > 0), blocks)
    again, hot = np.zeros(len(anchors), bool), np.zeros(len(anchors), bool)
    again[order], hot[order] = shared, np.repeat(blocks >= HOT_BLOCKS, blocks)
    at = 0
    for row, mine in zip(asking, own, strict=True):
        keep, heat = again[at : at + len(mine)], hot[at : at + len(mine)]
        at += len(mine)
        counts = _array(row, "c", np.uint32).astype(np.int64)
        docs = _array(row, "d", np.uint32)[ranges((np.cumsum(counts) - counts)[keep], counts[keep])]
        yield pa.RecordBatch.from_pylist([_row(row["shard"], row["block"], ANSWER, docs, _steps(np.repeat(mine[keep], counts[keep])), np.repeat(heat[keep], counts[keep]))], _SCHEMA)


def _groups(rows: Iterator[dict], name: str = "block") -> Iterator[list[dict]]:
    group: list[dict] = []
    for row in rows:
        if group and group[0][name] != row[name]:
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def _per_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The recurring anchors of each row of a block, as (doc_id, key, anchors, hot)."""
    for group in _groups(_rows(batches)):
        ids, keys = _array(group[0], "a", np.int64), _array(group[0], "b", np.int64)
        docs = np.concatenate([_array(r, "a", np.uint32) for r in group[1:]] or [np.zeros(0, np.uint32)])
        anchors = np.concatenate([_summed(r, "b", np.uint64) for r in group[1:]] or [np.zeros(0, np.uint64)])
        hot = np.concatenate([_array(r, "c", bool) for r in group[1:]] or [np.zeros(0, bool)])
        order = np.argsort(docs, kind="stable")
        rows, first = np.unique(docs[order], return_index=True)
        bounds = np.append(first, len(order))
        anchors, hot = _short(anchors[order]), hot[order]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": ids[rows], "key": keys[rows],
                "anchors": pa.array([anchors[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                "hot": pa.array([hot[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
            }
        )


def _equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each of the ranges at ``at`` holds the same bytes as the range after it; ranges are not empty."""
    sizes = ends - starts
    out = sizes[at] == sizes[at + 1]
    equal = at[out]
    told = np.zeros(len(equal), bool)
    for first, last in units(sizes[equal]):
        mine = equal[first:last]
        bytes_ = data[ranges(starts[mine], sizes[mine])] == data[ranges(starts[mine + 1], sizes[mine])]
        told[first:last] = np.logical_and.reduceat(bytes_, np.cumsum(sizes[mine]) - sizes[mine])
    out[out] = told
    return out


def _found(read: Reader, window: int, k: int, shards: list[int]):
    """Of each block of rows with recurring anchors: the pieces' places to wait, the distinct pieces to shards."""

    def unit(first: int, symbols: Symbols, batch: pa.RecordBatch):
        found = pieces(symbols, window, k)
        doc = np.searchsorted(symbols.offsets, found.first, "right") - 1
        keep, heat, asked = np.zeros(len(doc), bool), np.zeros(len(doc), bool), _asked(found.anchor)
        bounds = np.searchsorted(doc, np.arange(len(symbols.offsets)))
        anchors, hot = batch.column("anchors"), batch.column("hot")
        for d in range(len(symbols.offsets) - 1):
            a, b = bounds[d], bounds[d + 1]
            if a == b or not anchors[first + d].is_valid:
                continue
            known, warm = _long(anchors[first + d].as_py()), np.frombuffer(hot[first + d].as_py(), bool)
            order = np.argsort(known)
            at = np.minimum(np.searchsorted(known, asked[a:b], sorter=order), len(known) - 1)
            keep[a:b] = known[order[at]] == asked[a:b]
            heat[a:b] = keep[a:b] & warm[order[at]]
        found, doc, heat = Pieces(*(x[keep] for x in found)), doc[keep], heat[keep]
        # The windows of hot anchors go one by one.
        many = np.where(heat, found.windows, 1)
        step = ranges(np.zeros(len(many), np.int64), many)
        head = np.repeat(found.first, many) + step
        windows = np.where(np.repeat(heat, many), 1, np.repeat(found.windows, many))
        column, doc, heat, anchor = np.repeat(found.column, many) - step, np.repeat(doc, many), np.repeat(heat, many), np.repeat(found.anchor, many)
        body = hashes(symbols.values, head, head + windows + window - 1)
        begin = symbols.offsets[doc]
        return first + doc, head - begin, windows, column, np.where(heat, body, anchor), body, symbols.starts[head], symbols.ends[head + windows + window - 2]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            sizes = np.array([zstandard.frame_content_size(x.as_buffer()) for x in batch.column("packed")], np.int64)
            for first, last in units(sizes, BLOCK):
                part = batch.slice(first, last - first)
                yield part, np.frombuffer(b"".join(unpacked(part.column("packed"))), np.uint8), np.concatenate(([0], np.cumsum(sizes[first:last])))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch, data, offsets in blocks(batches):
            ids, keys = longs(batch.column("doc_id")), longs(batch.column("key"))
            parts = []
            for first, _, symbols in _segments(data, offsets, read):
                *own, a, b = unit(first, symbols, batch)
                base = offsets[first]
                parts.append((*own, base + a, base + b))
            if not parts or not sum(len(p[0]) for p in parts):
                continue
            doc, at, windows, column, shard_key, body, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
            block, number = (TaskContext.get().partitionId() << 32) + number, number + 1
            # Equal pieces once, with the smallest doc_id; their hashes bring them together, their bytes decide.
            order = np.lexsort((ids[doc], column, body))
            same = (body[order][1:] == body[order][:-1]) & (column[order][1:] == column[order][:-1])
            alike = np.flatnonzero(same)
            same[alike] = _equal(data, a[order], b[order], alike)
            begin = np.flatnonzero(np.append(True, ~same))
            # Numbered as they first come in the texts, so that most places need not be told.
            seen = np.minimum.reduceat(order, begin)
            turn = np.argsort(seen)
            rank = np.argsort(turn)
            head = order[begin][turn]
            piece = np.zeros(len(doc), np.int64)
            piece[order] = rank[np.cumsum(np.append(True, ~same)) - 1]
            least = ids[doc[head]]
            shared = np.zeros(len(head), bool)
            shared[piece[ids[doc] != least[piece]]] = True
            rows = []
            place, home = np.zeros(len(head), np.uint64), np.zeros(len(head), np.uint64)
            for shard, mine in _by_shard(shard_key[head], shards):
                place[mine], home[mine] = np.arange(len(mine)), shard
                at_ = head[mine]
                sizes = b[at_] - a[at_]
                text = data[ranges(a[at_], sizes)]
                marked = column[at_].astype(np.uint16) | shared[mine].astype(np.uint16) * np.uint16(SHARED)
                rows.append(_row(shard, block, ASKING, _steps(least[mine]), windows[at_].astype(np.uint16), marked, (sizes - windows[at_]).astype(np.uint32), zstandard.compress(text.tobytes(), TEXT_LEVEL)))
            used, count = np.unique(doc, return_counts=True)
            again = np.ones(len(doc), bool)
            again[seen] = False
            told = (home[piece] << np.uint64(40)) | np.where(again, place[piece] + np.uint64(1), np.uint64(0))
            rows.insert(0, _row(_any_shard(block, shards), block, PARKED, ids[used], keys[used], count.astype(np.uint32), _steps(at.astype(np.uint32)), told))
            for x in rows:
                yield pa.RecordBatch.from_pylist([x], _SCHEMA)

    return task


def _places(told: np.ndarray) -> np.ndarray:
    """The shard and the number there (from its 40th bit on, and below) of pieces in the texts' order; new ones count up."""
    home, number = told >> np.uint64(40), (told & np.uint64((1 << 40) - 1)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    new, first = number[order] == 0, np.flatnonzero(np.diff(home[order], prepend=home[order][:1] + np.uint64(1)))
    count = np.cumsum(new) - 1
    before = np.repeat(count[first] + 1 - new[first], np.diff(np.append(first, len(order))))
    out = np.zeros(len(told), np.int64)
    out[order] = np.where(new, count - before, number[order] - 1)
    return out + (home.astype(np.int64) << 40)


class Asked(NamedTuple):
    """The distinct pieces a shard has to compare: text, doc_id, windows, windows before the anchor."""

    data: np.ndarray
    offsets: np.ndarray
    docs: np.ndarray
    windows: np.ndarray
    column: np.ndarray


#: Of a shard's pieces: for each window, piece after piece, the smallest doc_id that has it.
Solver = Callable[[Asked], np.ndarray]


def _solved(solve: Solver):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking: list[dict] = []
        for row in _rows(batches):
            if row["kind"] == PARKED:
                yield pa.RecordBatch.from_pylist([row], _SCHEMA)
            else:
                asking.append(row)
        if not asking:
            return
        join = lambda name, kind: np.concatenate([_array(r, name, kind) for r in asking])
        windows = join("b", np.uint16).astype(np.int64)
        sizes = join("d", np.uint32).astype(np.int64) + windows
        docs, marked = np.concatenate([_summed(r, "a", np.int64) for r in asking]), join("c", np.uint16).astype(np.int64)
        text = np.frombuffer(b"".join(zstandard.decompress(r["e"]) for r in asking), np.uint8)
        least = solve(Asked(text, np.concatenate(([0], np.cumsum(sizes))), docs, windows, marked % SHARED))
        ends = np.cumsum(windows)
        at = 0
        for row in asking:
            n = len(_array(row, "b", np.uint16))
            mine = windows[at : at + n]
            a = ends[at] - windows[at] if n else 0
            own = least[a : a + mine.sum()]
            # Runs of windows of one piece with one smallest doc_id.
            first = np.zeros(len(own), bool)
            first[np.cumsum(mine) - mine] = True
            first[1:] |= own[1:] != own[:-1]
            head = np.flatnonzero(first)
            piece = np.repeat(np.arange(n), mine)[head]
            begin = head - (np.cumsum(mine) - mine)[piece]
            size = np.diff(np.append(head, len(own)))
            # What a block has of one doc_id, that doc_id takes no part of from itself; a smaller one need not be named.
            shared = marked[at + piece] >= SHARED
            told = np.flatnonzero(shared | (own[head] < docs[at + piece]))
            smaller = np.where(shared, own[head], np.iinfo(np.int64).min)[told]
            yield pa.RecordBatch.from_pylist([_row(row["shard"], row["block"], ANSWER, _steps(piece[told].astype(np.uint32)), begin[told].astype(np.uint16), size[told].astype(np.uint16), smaller)], _SCHEMA)
            at += n

    return task


def _ranges(window: int):
    """Of a block: the ranges of symbols to remove from each row, as (doc_id, key, starts, ends)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(_rows(batches)):
            parked, answers = group[0], group[1:]
            ids, keys = _array(parked, "a", np.int64), _array(parked, "b", np.int64)
            doc, at = np.repeat(np.arange(len(ids)), _array(parked, "c", np.uint32)), _summed(parked, "d", np.uint32).astype(np.int64)
            place = _places(_array(parked, "e", np.uint64))
            runs = [((r["shard"] << 40) + _summed(r, "a", np.uint32).astype(np.int64), *(_array(r, x, np.uint16).astype(np.int64) for x in "bc"), _array(r, "d", np.int64)) for r in answers]
            of, begin, size, least = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 4
            order = np.argsort(of, kind="stable")
            of, begin, size, least = of[order], begin[order], size[order], least[order]
            low = np.searchsorted(of, place)
            n = np.searchsorted(of, place, "right") - low
            run = ranges(low, n)
            doc, at = np.repeat(doc, n), np.repeat(at, n)
            keep = least[run] < ids[doc]
            doc, start = doc[keep], (at + begin[run])[keep]
            end = start + size[run][keep] + window - 1
            if not len(doc):
                continue
            order = np.lexsort((start, doc))
            doc, start, end = doc[order], start[order], end[order]
            # Ranges that touch become one.
            reach = np.maximum.accumulate(end + doc * (1 << 40))
            first = np.append(True, start[1:] + doc[1:] * (1 << 40) > reach[:-1])
            head = np.flatnonzero(first)
            last = np.append(head[1:], len(doc)) - 1
            doc, start, end = doc[head], start[head], reach[last] - doc[head] * (1 << 40)
            rows, begin = np.unique(doc, return_index=True)
            bounds = np.append(begin, len(doc))
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": ids[rows], "key": keys[rows], "starts": cut(start), "ends": cut(end)})

    return task


def removable(docs: DataFrame, read: Reader, solve: Solver, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, key, text as ``packed``) and the ranges of symbols (doc_id, key, starts, ends as arrays of 64-bit numbers).

    A range covers windows that also start in a document with a smaller doc_id. Rows with a null doc_id neither lose nor
    cover anything.
    """
    n = shuffle_partitions(docs)
    shards = shard_keys(docs, n)
    rows = documents(docs).withColumn("key", text_key())
    known = rows.filter(F.col("doc_id").isNotNull())
    rows = rows.mapInArrow(_packed, "doc_id long, key long, packed binary")
    shard, block = ("shard", "kind"), ("block", "kind")
    deal = lambda frame, keys: frame.repartition(n, keys[0]).sortWithinPartitions(*keys)
    asked = deal(known.mapInArrow(_anchors(read, window, k, shards), _ROW), shard).mapInArrow(_recurring, _ROW)
    recurring = deal(asked, block).mapInArrow(_per_row, "doc_id long, key long, anchors binary, hot binary")
    recurring = recurring.groupBy("doc_id", "key").agg(F.first("anchors").alias("anchors"), F.first("hot").alias("hot"))
    # A left join here and where the ranges are applied: Spark moves the texts once for both.
    found = rows.join(recurring, ["doc_id", "key"], "left").mapInArrow(_found(read, window, k, shards), _ROW)
    solved = deal(found, shard).mapInArrow(_solved(solve), _ROW)
    cut = deal(solved, block).mapInArrow(_ranges(window), "doc_id long, key long, starts binary, ends binary")
    return rows, cut.groupBy("doc_id", "key").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends"))


def equal_windows(columns: np.ndarray, first: np.ndarray, windows: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """Of aligned pieces: for each window, piece after piece, the smallest doc_id among equal windows.

    ``columns`` has a row for each column from left to right and a symbol for each piece, 0 where a piece has none. One column
    after the other is put before all pieces at once, from the right: the pieces' suffixes stay sorted by a stable sort
    of the symbols in their present order (those symbols, as they stand, are the column's part of the collection's
    Burrows-Wheeler transform), and a suffix shares with the one before it one symbol more than the least common prefix between
    the two places that they come from. Suffixes that share ``window`` symbols begin with equal windows.
    """
    n, least = columns.shape[1], np.zeros(int(windows.sum()), np.int64)
    base = np.cumsum(windows) - windows - first
    order, prefix = np.arange(n), np.zeros(n, np.uint8)
    log = np.zeros(n + 1, np.int64)
    log[1:] = np.floor(np.log2(np.arange(1, n + 1)))
    for x in range(len(columns) - 1, -1, -1):
        minima = [prefix]
        while 2 << (len(minima) - 1) <= n:
            half, last = 1 << (len(minima) - 1), minima[-1]
            minima.append(np.append(np.minimum(last[:-half], last[half:]), last[-half:]))
        table = np.stack(minima)
        symbols = columns[x][order]
        move = np.argsort(symbols, kind="stable")
        order, symbols = order[move], symbols[move]
        low, high = move[:-1] + 1, move[1:]
        joined = np.flatnonzero(symbols[1:] == symbols[:-1])
        low, high = low[joined], high[joined]
        level = log[high - low + 1]
        shared = np.minimum(table[level, low], table[level, high - (1 << level) + 1])
        prefix = np.zeros(n, np.uint8)
        prefix[joined + 1] = np.minimum(shared, 254) + 1
        if x <= first.max(initial=-1) + windows.max(initial=0):
            has = (first <= x) & (x < first + windows)
            heads = np.flatnonzero(prefix < window)
            best = np.minimum.reduceat(np.where(has, docs, np.iinfo(np.int64).max)[order], heads)
            mine = np.repeat(best, np.diff(np.append(heads, n)))
            at = has[order]
            least[(base + x)[order[at]]] = mine[at]
    return least
