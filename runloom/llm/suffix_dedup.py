"""Exact substring dedup: equal windows found by a depth-limited radix sort of suffixes.

A byte goes if a window of `width` bytes that covers it also starts in a
document with a smaller id. Windows are compared as suffixes that are sorted
by their first `width` bytes only, most significant digits (8 bytes) first; a
suffix that is alone after a pass leaves, and what is equal after the last pass
is exactly the repeated windows.

To sort only suffixes that can repeat, each window names an anchor: its k-byte
string with the smallest hash. Equal windows have equal anchors at equal
offsets, so

1. every document's anchors go to buckets by hash, which say for each document
   which of its anchors other documents have too (`_shared`);
2. the document sends those anchors again, with the bytes that windows around
   them can hold, to the buckets (`_contexts`); of equal contexts in a task
   only those of the smallest id go, the others are settled there;
3. a bucket sorts the contexts, and the suffixes around anchors whose contexts
   differ, by radix passes (`_repeated`), and returns removed ranges;
4. documents and ranges meet by document (`_finish`).

An anchor of very many documents would be one task's work. Such hot anchors
are found first (`hot_anchors`) and told to all tasks. Nobody is asked about
them; a task settles their windows among its own documents and sends those
that are left, those of the smallest id, to the bucket of the window's own hash.

Copies of a whole document are settled by digest and don't enter step 2. Rows
move as compressed blocks, a block for each pair of tasks. Nothing is dropped,
capped or sampled: anchors and the bounds on the bytes around them decide only
what cannot be equal.

Null text is an empty text. A row without id is returned whole. Rows with equal
ids don't remove from each other; repeated rows are returned each. Texts of any
length are taken whole, by one task. An empty table gives no rows; further
columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import cut, parts_for, spread

WIDTH = 50
K = 16
#: Bytes of text for each task of steps 2 and 4, and for each bucket of steps 1 and 3.
PART_BYTES = 12 << 20
#: Anchors in so many documents are hot, or in a millionth part of all anchors' documents, if that is more.
HOT_DOCUMENTS = 4096
_CHUNK = 1 << 18
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_MOST = _CHUNK + (1 << 14)  # bytes that are hashed at once
_POWERS = np.cumprod(np.concatenate(([_U(1)], np.full(_MOST, _U(_ODD)))))
_INVERSE = np.cumprod(np.concatenate(([_U(1)], np.full(_MOST, _U(pow(_ODD, -1, 1 << 64))))))
_LOW48 = _U((1 << 48) - 1)


def _sliding(f, x: np.ndarray, w: int) -> np.ndarray:
    """f over every window of w, by doubling."""
    have = 1
    while have < w:
        s = min(have, w - have)
        x = f(x[: len(x) - s], x[s:])
        have += s
    return x


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _piece_anchors(data: np.ndarray, ends: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of anchors in texts laid end to end; ends: where each text ends."""
    if len(data) < width:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[data] * _POWERS[: len(data)])))
    h = _mixed((sums[k:] - sums[:-k]) * _INVERSE[: len(data) - k + 1])
    w = width - k + 1
    least = _sliding(np.minimum, h, w)
    for e in ends[ends < len(data)]:  # no window crosses from a text to the next
        least[max(0, e - width + 1) : e] = 0
    edge = np.zeros(w - 1, _U)
    at = np.flatnonzero(_sliding(np.maximum, np.concatenate((edge, least, edge)), w) == h)
    return at, h[at]


def anchors(texts: list[bytes], width: int = WIDTH, k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text (number, positions, hashes) of the strings of k bytes that are smallest in some window.

    Short texts share the array work; a long one is cut into pieces that
    overlap by a window less one byte.
    """
    group: list[int] = []
    size = 0
    for i, text in enumerate([*texts, b""]):
        if group and (i == len(texts) or size + len(text) > _CHUNK):
            lengths = np.array([len(texts[j]) for j in group])
            ends = np.cumsum(lengths)
            at, h = _piece_anchors(np.frombuffer(b"".join(texts[j] for j in group), np.uint8), ends, width, k)
            cuts = np.searchsorted(at, np.concatenate(([0], ends)))
            for n, j in enumerate(group):
                part = slice(cuts[n], cuts[n + 1])
                yield j, at[part] - (ends[n] - lengths[n]), h[part]
            group, size = [], 0
        if i == len(texts):
            return
        if len(text) <= _CHUNK:
            group.append(i)
            size += len(text)
            continue
        data = np.frombuffer(text, np.uint8)
        found = [(p + beg, h) for beg in range(0, len(data) - width + 1, _CHUNK) for p, h in [_piece_anchors(data[beg : beg + _CHUNK + width - 1], np.zeros(0, np.int64), width, k)]]
        at, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
        yield i, at, np.concatenate([f[1] for f in found])[first]


def window_ranges(at: np.ndarray, h: np.ndarray, pick: np.ndarray, beg: np.ndarray, end: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start of which each picked anchor is the leftmost smallest string.

    beg and end bound the text of each picked anchor; texts are at least a
    window apart.

    An anchor's windows end where a neighbouring anchor takes over: on the left
    one that isn't larger, on the right one that is smaller. Every window of
    the text belongs to exactly one anchor.
    """
    w = width - k + 1
    low, high = np.maximum(at[pick] - w + 1, beg), np.minimum(at[pick], end - width)
    for step, bound, sign in ((-1, low, -1), (1, high, 1)):
        open_, j = np.arange(len(pick)), pick + step
        while len(open_):
            inside = (j >= 0) & (j < len(at))
            open_, j = open_[inside], j[inside]
            near = np.abs(at[j] - at[pick[open_]]) < w
            open_, j = open_[near], j[near]
            own, other = h[pick[open_]], h[j]
            takes = other <= own if sign < 0 else other < own
            if sign < 0:
                bound[open_[takes]] = np.maximum(bound[open_[takes]], at[j[takes]] + 1)
            else:
                bound[open_[takes]] = np.minimum(bound[open_[takes]], at[j[takes]] - w)
            open_, j = open_[~takes], j[~takes] + step
    return low, high


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length in one compressed block."""
    head = np.array([len(columns[0])], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _unpacked(block: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int(np.frombuffer(data, "<i8", 1)[0]), 8, []
    for kind in kinds:
        dtype = np.dtype(kind)
        out.append(np.frombuffer(data, dtype, n, at))
        at += n * dtype.itemsize
    return out


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    for beg, end in zip([0, *cuts], [*cuts, len(ordered)], strict=True):
        if end > beg:
            yield int(ordered[beg]), [c[order[beg:end]] for c in columns]


def _blocks(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["to", "kind", "block"])


_BLOCKS = "to int, kind int, block binary"
_DOC, _COPIES, _ANCHORS, _CONTEXTS, _RANGES, _WINDOWS = range(6)
_RANGE = ("<i8", "<i8", "<i8", "<i8")  # id, row, begin, end


def partition_marks(n: int) -> np.ndarray:
    """For each of n partitions a number that hash partitioning puts there: homes and buckets are as many, one in each."""
    marks, beg = np.full(n, -1, np.int64), 0
    while (marks < 0).any():
        x = np.arange(beg, beg + 8 * n, dtype=np.uint32)
        beg += 8 * n
        h = x * np.uint32(0xCC9E2D51)  # MurmurHash3 of one 32-bit number
        h = ((h << np.uint32(15)) | (h >> np.uint32(17))) * np.uint32(0x1B873593) ^ np.uint32(42)
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
        place = (h ^ (h >> np.uint32(16))).astype(np.int32).astype(np.int64) % n
        found, first = np.unique(place, return_index=True)
        new = marks[found] < 0
        marks[found[new]] = x[first[new]]
    return marks


def _home(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return marks[((ids.astype(np.int64).view(_U) * _U(_ODD)) >> _U(33)) % _U(len(marks))]


def _row_key(data: bytes) -> int:
    """Tells rows of one id apart by their text: the start of its SHA-256."""
    return int.from_bytes(hashlib.sha256(data).digest()[:8], "little", signed=True)


def _copies(blocks: dict[int, list[bytes]]) -> set[tuple[int, int]]:
    return {row for b in blocks.get(_COPIES, []) for row in zip(*(c.tolist() for c in _unpacked(b, "<i8", "<i8")), strict=True)}


def _read(marks: np.ndarray):
    """Documents as blocks of many, by home task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            # a row without id asks nobody and is told nothing: any task will do
            homes = _home(np.array([n if i is None else i for n, i in enumerate(ids)], np.int64), marks).tolist()
            held: dict[int, list[tuple[int | None, bytes]]] = {}
            sizes: dict[int, int] = {}
            out = []
            for i, home, text in zip(ids, homes, batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                held.setdefault(home, []).append((i, data))
                sizes[home] = sizes.get(home, 0) + len(data)
                if sizes[home] > _CHUNK:
                    out.append((home, _DOC, _document_block(held.pop(home))))
                    sizes[home] = 0
            yield _blocks([*out, *((home, _DOC, _document_block(docs)) for home, docs in held.items())])

    return rows


def _document_block(docs: list[tuple[int | None, bytes]]) -> bytes:
    """Ids (and whether there is one), lengths and texts, compressed together."""
    head = np.array([[i is not None, i or 0, len(data)] for i, data in docs], "<i8")
    return zstandard.ZstdCompressor(level=3).compress(np.int64(len(docs)).tobytes() + head.tobytes() + b"".join(data for _, data in docs))


def _documents(block: bytes) -> Iterator[tuple[int | None, bytes]]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    at = 8 + 24 * n
    for known, i, size in np.frombuffer(data, "<i8", 3 * n, 8).reshape(n, 3).tolist():
        yield (i if known else None), data[at : at + size]
        at += size


def _document_anchors(batch: pa.RecordBatch, width: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(id, distinct hashes) of each document with an id."""
    for beg in range(0, batch.num_rows, 500):
        known = [(i, t.as_py().encode()) for i, t in zip(batch.column(0)[beg : beg + 500].to_pylist(), batch.column(1)[beg : beg + 500], strict=True) if i is not None and t.is_valid]
        for n, _, h in anchors([t for _, t in known], width, k):
            yield known[n][0], np.unique(h & _LOW48)


def _frequent(least: int, width: int, k: int):
    """(h, n): anchors that `least` documents of a partition have, n of them; (-1, n): all its documents' anchors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = 0, [], 0
        counts: tuple[np.ndarray, np.ndarray] = (np.zeros(0, _U), np.zeros(0, np.int64))

        def folded() -> tuple[np.ndarray, np.ndarray]:
            h, at = np.unique(np.concatenate((counts[0], *held)), return_inverse=True)
            weight = np.concatenate((counts[1], np.ones(size, np.int64)))
            return h, np.bincount(at, weight, len(h)).astype(np.int64)

        for batch in batches:
            for _, h in _document_anchors(batch, width, k):
                held.append(h)
                size += len(h)
                total += len(h)
                if size > 4_000_000:
                    counts, held, size = folded(), [], 0
        h, n = folded()
        h, n = h[n >= least], n[n >= least]
        yield pa.record_batch([pa.array(np.append(h.astype(np.int64), -1)), pa.array(np.append(n, total))], names=["h", "n"])

    return rows


def hot_anchors(texts: DataFrame, width: int, k: int) -> np.ndarray:
    """Sorted hashes of the hot anchors, two million at most.

    An anchor in `most` documents is in its share of them in some partition,
    so only locally frequent ones are counted.
    """
    least = max(2, -(-HOT_DOCUMENTS // max(1, 2 * texts.rdd.getNumPartitions())))
    counted = cut(texts.mapInArrow(_frequent(least, width, k), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")))
    total = counted.where("h = -1").agg(F.max("n").alias("n")).first().n or 0
    most = max(HOT_DOCUMENTS, total // 1_000_000)
    hot = counted.where((F.col("h") >= 0) & (F.col("n") > most // 2)).select("h").collect()  # 2 * total / most at most
    return np.sort(np.array([r.h for r in hot], np.int64).astype(_U))


def _in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values if len(among) else np.zeros(len(values), bool)


def _send_anchors(marks: np.ndarray, width: int, k: int, hot):
    """Step 1: (hash, id) of every document's distinct anchors that aren't hot, to the hash's bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            h, i = np.concatenate(hashes), np.concatenate(ids)
            split = h.view(np.uint8).reshape(-1, 8)[:, :6]  # the low 48 bits
            return _blocks([(b, _ANCHORS, _packed(x.reshape(-1).reshape(-1, 6), y)) for b, (x, y) in _by_bucket(marks[h % _U(len(marks))], split, i)])

        for batch in batches:
            for i, h in _document_anchors(batch, width, k):
                h = h[~_in_sorted(h, hot.value)]
                hashes.append(h)
                ids.append(np.full(len(h), i, "<i8"))
                held += len(h)
                if held > 1_000_000:
                    yield flush()
                    hashes, ids, held = [], [], 0
        if held:
            yield flush()

    return rows


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[int, list[bytes]]]:
    """A task's blocks by bucket and kind, still compressed."""
    found: dict[int, dict[int, list[bytes]]] = {}
    for batch in batches:
        for to, kind, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found.setdefault(to, {}).setdefault(kind, []).append(block)
    return found


def _shared(marks: np.ndarray):
    """Anchors that documents of different ids have, to each of these documents' home."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _gathered(batches).values():
            got = [_unpacked(b, "V6", "<i8") for b in blocks[_ANCHORS]]
            low = np.concatenate([g[0] for g in got]).view(np.uint8).reshape(-1, 6)
            h = np.zeros((len(low), 8), np.uint8)
            h[:, :6] = low
            h, ids = h.view("<u8").ravel(), np.concatenate([g[1] for g in got])
            order = np.argsort(h, kind="stable")
            h, ids = h[order], ids[order]
            begs = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            many = np.minimum.reduceat(ids, begs) != np.maximum.reduceat(ids, begs)
            keep = np.repeat(many, np.diff(np.append(begs, len(h))))
            h, ids = h[keep], ids[keep]
            order = np.argsort(ids, kind="stable")
            yield _blocks([(home, _ANCHORS, _packed(x, y)) for home, (x, y) in _by_bucket(_home(ids[order], marks), h[order], ids[order])])

    return rows


def _context_bytes(padded: bytes, at: np.ndarray, before: np.ndarray, after: np.ndarray, side: int, k: int) -> np.ndarray:
    """Bytes of each anchor's windows, zeros on either side of them. padded begins side bytes before place 0."""
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(padded, np.uint8), 2 * side + k)[at]
    place = np.arange(2 * side + k)
    rows = rows.copy()
    rows[(place < side - before[:, None]) | (place >= side + k + after[:, None])] = 0
    return rows


def _anchor_hash(context: np.ndarray, side: int, k: int) -> np.ndarray:
    """The anchors' hashes from their bytes."""
    return _mixed((_BYTE[context[:, side : side + k]] * _POWERS[:k]).sum(axis=1, dtype=_U)) & _LOW48


def _contexts(marks: np.ndarray, width: int, k: int, hot):
    """Step 2: contexts of shared anchors, and windows of hot ones, to the buckets; ranges that are settled here."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _gathered(batches).values():
            copies = _copies(blocks)
            shared = [_unpacked(b, "<u8", "<i8") for b in blocks.get(_ANCHORS, [])]
            hashes, owners = (np.concatenate([s[c] for s in shared]) if shared else np.zeros(0, np.int64) for c in (0, 1))
            order = np.argsort(owners, kind="stable")
            hashes, owners = hashes[order].astype(_U), owners[order]
            sent: list[list[np.ndarray]] = []
            held = 0
            for b in blocks.get(_DOC, []):
                docs = []
                for i, data in _documents(b):
                    if i is None or len(data) < width or (i, key := _row_key(data)) in copies:
                        continue
                    wanted = hashes[np.searchsorted(owners, i, "left") : np.searchsorted(owners, i, "right")]
                    if len(wanted) or len(hot.value):
                        docs.append((i, key, data, wanted))
                if docs:
                    sent.append(_document_contexts(docs, width, k, hot.value))
                    held += len(sent[-1][0])
                    if held > 300_000:
                        yield _settle(sent, marks, width, k, hot.value)
                        sent, held = [], 0
            if held:
                yield _settle(sent, marks, width, k, hot.value)

    return rows


def _document_contexts(docs: list[tuple[int, int, bytes, np.ndarray]], width: int, k: int, hot: np.ndarray) -> list[np.ndarray]:
    """Hashes, ids, row keys, places, bytes before and after, contexts of the wanted anchors of documents (id, key, text, wanted)."""
    side = width - k
    gap = bytes(2 * width)  # between texts that are laid out in one buffer
    bases = np.cumsum([0, *(len(d[2]) + len(gap) for d in docs)])
    found = sorted(anchors([d[2] for d in docs], width, k), key=lambda f: f[0])
    at = np.concatenate([a + bases[n] for n, a, _ in found])
    h = np.concatenate([x for _, _, x in found])
    owner = np.concatenate([np.full(len(a), n) for n, a, _ in found])
    low48 = h & _LOW48
    wanted = np.concatenate([np.sort(d[3]) for d in docs])
    firsts = np.cumsum([0, *(len(d[3]) for d in docs)])
    cuts = np.searchsorted(owner, np.arange(len(docs) + 1))
    mine = _in_sorted(low48, hot)
    for n in range(len(docs)):
        mine[cuts[n] : cuts[n + 1]] |= _in_sorted(low48[cuts[n] : cuts[n + 1]], wanted[firsts[n] : firsts[n + 1]])
    pick = np.flatnonzero(mine)
    beg, size = bases[owner[pick]], np.array([len(d[2]) for d in docs])[owner[pick]]
    low, high = window_ranges(at, h, pick, beg, beg + size, width, k)
    real = low <= high
    pick, low, high, beg = pick[real], low[real], high[real], beg[real]
    where = at[pick]
    before, after = where - low, high + width - k - where
    context = _context_bytes(bytes(side) + b"".join(d[2] + gap for d in docs), where, before, after, side, k)
    ids, keys = (np.array([d[c] for d in docs], "<i8")[owner[pick]] for c in (0, 1))
    return [low48[pick], ids, keys, (where - beg).astype("<i8"), before.astype(np.uint8), after.astype(np.uint8), context]


def _settle(sent: list[list[np.ndarray]], marks: np.ndarray, width: int, k: int, hot: np.ndarray) -> pa.RecordBatch:
    h, ids, key, at, before, after, context = (np.concatenate([s[c] for s in sent]) for c in range(7))
    covered = _above_smallest(h, ids, before, after, context)
    out = _range_blocks(ids[covered], key[covered], at[covered] - before[covered], at[covered] + k + after[covered], marks, width)
    rest, often = ~covered, _in_sorted(h, hot)
    for b, cols in _by_bucket(marks[h[rest & ~often] % _U(len(marks))], *(c[rest & ~often] for c in (ids, key, at, before, after, context))):
        out.append((b, _CONTEXTS, _packed(*cols)))
    often = np.flatnonzero(rest & often)
    if len(often):
        w, offset, members, label = _equal_windows(often, h, before.astype(np.int64), after.astype(np.int64), context, width, k)
        left = np.ones(len(w), bool)  # of equal windows those of the smallest id go on
        if len(members):
            least = _smallest(ids[w[members]], label)
            above = members[ids[w[members]] > least]
            left[above] = False
            beg = at[w[above]] - (width - k) + offset[above]
            out += _range_blocks(ids[w[above]], key[w[above]], beg, beg + width, marks, width)
        w, offset = w[left], offset[left]
        content = np.lib.stride_tricks.sliding_window_view(context, width, axis=1)[w, offset]
        to = marks[_mixed((_BYTE[content] * _POWERS[:width]).sum(axis=1, dtype=_U)) % _U(len(marks))]
        for b, cols in _by_bucket(to, ids[w], key[w], at[w] - (width - k) + offset, content):
            out.append((b, _WINDOWS, _packed(*cols)))
    return _blocks(out)


def _range_blocks(ids: np.ndarray, key: np.ndarray, beg: np.ndarray, end: np.ndarray, marks: np.ndarray, width: int) -> list[tuple[int, int, bytes]]:
    """Ranges of width or more, merged within a row, as blocks for the rows' homes; `to` is coded as -1 - home."""
    keep = end - beg >= width
    ids, key, beg, end = ids[keep], key[keep], beg[keep].astype(np.int64), end[keep].astype(np.int64)
    if not len(ids):
        return []
    order = np.lexsort((beg, key, ids))
    ids, key, beg, end = ids[order], key[order], beg[order], end[order]
    row = np.cumsum(np.concatenate(([True], (ids[1:] != ids[:-1]) | (key[1:] != key[:-1])))) - 1
    span = int(end.max()) + 1  # rows end to end, so that one running maximum serves all
    reach = np.maximum.accumulate(end + row * span)
    first = np.concatenate(([True], (beg + row * span)[1:] > reach[:-1]))
    begs = np.flatnonzero(first)
    last = np.append(begs[1:], len(ids)) - 1
    merged = (ids[begs], key[begs], beg[begs], reach[last] - row[last] * span)
    return [(-1 - home, _RANGES, _packed(*cols)) for home, cols in _by_bucket(_home(merged[0], marks), *merged)]


def radix_groups(group: np.ndarray, digit, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes: (members, labels) of the groups of equal digits that have several members, in order of label.

    digit(members, pass) gives the members' next 8 bytes as a big-endian
    number. A group whose members agree in a digit needs no sorting by it.
    """
    members = np.argsort(group, kind="stable")
    members, label = _several(members, group[members])
    for d in range(passes):
        if not len(members):
            break
        value = digit(members, d)
        begs = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
        sizes = np.diff(np.append(begs, len(label)))
        mixed = np.repeat(np.logical_or.reduceat(value != np.repeat(value[begs], sizes), begs), sizes)
        if not mixed.any():
            continue
        m, v, g = members[mixed], value[mixed], label[mixed]
        order = np.lexsort((v, g))
        m, v, g = m[order], v[order], g[order]
        m, g = _several(m, np.cumsum(np.concatenate(([True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])))))
        members, label = np.concatenate((members[~mixed], m)), np.concatenate((label[~mixed], g + (int(label[-1]) + 1)))
    return members, label


def _several(members: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members, in order of key, whose key others have too, with dense labels."""
    if not len(members):
        return members, np.zeros(0, np.int64)
    label = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    keep = np.bincount(label)[label] > 1
    return members[keep], label[keep]


def _smallest(values: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each member the smallest value of its label; labels in order."""
    begs = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
    return np.repeat(np.minimum.reduceat(values, begs), np.diff(np.append(begs, len(label))))


def _classes(h: np.ndarray, before: np.ndarray, after: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, w = context.shape
    full = np.zeros((n, -(-(w + 2) // 8) * 8), np.uint8)
    full[:, :w], full[:, w], full[:, w + 1] = context, before, after
    digits = full.view(">u8")
    return radix_groups(h, lambda m, d: digits[m, d], digits.shape[1])


def _above_smallest(h: np.ndarray, ids: np.ndarray, before: np.ndarray, after: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Which have a context that a smaller id has too."""
    members, label = _classes(h, before, after, context)
    out = np.zeros(len(h), bool)
    if len(members):
        out[members] = ids[members] > _smallest(ids[members], label)
    return out


def _repeated(marks: np.ndarray, width: int, k: int):
    """Step 3: ranges of the windows that start in a document with a smaller id."""
    side = width - k
    kinds = ("<i8", "<i8", "<i8", "u1", "u1", f"V{2 * side + k}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, blocks in _gathered(batches).items():
            out = [(to, _RANGES, b) for b in blocks.get(_RANGES, [])]
            got = [_unpacked(b, *kinds) for b in blocks.get(_CONTEXTS, [])]
            if got:
                ids, key, at, before, after, context = (np.concatenate([g[c] for g in got]) for c in range(6))
                context = context.view(np.uint8).reshape(len(ids), -1)
                h = _anchor_hash(context, side, k)
                whole = _above_smallest(h, ids, before, after, context)
                before, after = before.astype(np.int64), after.astype(np.int64)
                out += _range_blocks(ids[whole], key[whole], (at - before)[whole], (at + k + after)[whole], marks, width)
                out += _windows(np.flatnonzero(~whole), h, ids, key, at, before, after, context, marks, width, k)
            got = [_unpacked(b, "<i8", "<i8", "<i8", f"V{width}") for b in blocks.get(_WINDOWS, [])]
            if got:
                ids, key, beg, content = (np.concatenate([g[c] for g in got]) for c in range(4))
                full = np.zeros((len(ids), -(-width // 8) * 8), np.uint8)
                full[:, :width] = content.view(np.uint8).reshape(len(ids), -1)
                digits = full.view(">u8")
                members, label = radix_groups(np.zeros(len(ids), np.int64), lambda m, d, x=digits: x[m, d], digits.shape[1])
                if len(members):
                    above = members[ids[members] > _smallest(ids[members], label)]
                    out += _range_blocks(ids[above], key[above], beg[above], beg[above] + width, marks, width)
            yield _blocks(out)

    return rows


def _windows(rest: np.ndarray, h, ids, key, at, before, after, context, marks: np.ndarray, width: int, k: int) -> list[tuple[int, int, bytes]]:
    """Ranges from single windows, of anchors whose contexts differ."""
    side = width - k
    near = side // 2 // 8 * 8  # an equal window has as many equal bytes at least, on one side of the anchor
    live = np.zeros(len(rest), bool)
    for beg in (side - near, side + k):
        part = context[rest]
        digits = np.ascontiguousarray(part[:, beg : beg + near]).view(">u8")
        members, _ = radix_groups(h[rest], lambda m, d, x=digits: x[m, d], digits.shape[1])
        live[members] = True
    w, offset, members, label = _equal_windows(rest[live], h, before, after, context, width, k)
    if not len(members):
        return []
    owner = ids[w[members]]
    members = members[owner > _smallest(owner, label)]
    w = w[members]
    beg = at[w] - side + offset[members]
    return _range_blocks(ids[w], key[w], beg, beg + width, marks, width)


def _equal_windows(rest: np.ndarray, h, before, after, context, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the contexts `rest` (context, offset in it), and the groups of equal ones by radix passes."""
    low, high = width - k - before[rest], after[rest]  # window offsets within the text
    n = np.maximum(high - low + 1, 0)
    who = np.repeat(rest, n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    group = h[who] * _U(256) + offset.astype(_U)
    padded = np.concatenate((context, np.zeros((len(context), 8), np.uint8)), axis=1)

    def digit(m: np.ndarray, d: int) -> np.ndarray:
        found = padded[who[m][:, None], offset[m][:, None] + np.arange(8 * d, 8 * d + 8)]
        if 8 * d + 8 > width:
            found[:, width - 8 * d :] = 0
        return np.ascontiguousarray(found).view(">u8").ravel()

    return who, offset, *radix_groups(group, digit, -(-width // 8))


def _finish(width: int, with_kept: bool):
    """Step 4: results of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _gathered(batches).values():
            copies = _copies(blocks)
            ranges: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for b in blocks.get(_RANGES, []):
                for i, key, beg, end in zip(*(c.tolist() for c in _unpacked(b, *_RANGE)), strict=True):
                    ranges.setdefault((i, key), []).append((beg, end))
            out = []
            for i, data in (d for b in blocks.get(_DOC, []) for d in _documents(b)):
                row = (i, _row_key(data))
                found = [(0, len(data))] if row in copies and len(data) >= width else sorted(ranges.get(row, ()))
                spans: list[list[int]] = []
                for beg, end in found:
                    if spans and beg <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([beg, end])
                kept, at = [], 0
                for beg, end in spans:
                    kept.append(data[at:beg])
                    at = end
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((i, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), ",".join(f"{x}:{y}" for x, y in spans), rest if with_kept else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            names = ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")
            yield pa.record_batch([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], names=list(names))

    return rows


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = K, with_kept: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256, spans ("beg:end,..." in bytes), kept (the bytes, if asked for)."""
    if not 8 <= k <= width - 16 <= 200:
        raise ValueError("width: from 24 to 216; k: from 8 to width - 16")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    parts = parts_for(size, part_bytes)
    marks = partition_marks(parts)
    texts = spread(texts)
    documents = texts.mapInArrow(_read(marks), _BLOCKS)
    # copies of whole texts: all but those of the smallest id, as blocks for their homes
    digests = texts.where("id is not null and t is not null").select("id", F.unhex(F.sha2("t", 256)).alias("d"))
    # stored, so that the join splits a digest of very many documents
    first = cut(digests.groupBy("d").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("d", "first"))
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(texts, width, k))  # two million numbers at most
    copies = digests.join(first, "d").where("id > first").select("id", "d").mapInArrow(_copy_blocks(marks), _BLOCKS)
    shared = texts.mapInArrow(_send_anchors(marks, width, k, hot), _BLOCKS).repartition(parts, "to").mapInArrow(_shared(marks), _BLOCKS)
    contexts = documents.unionByName(copies).unionByName(shared).repartition(parts, "to").mapInArrow(_contexts(marks, width, k, hot), _BLOCKS)
    ranges = contexts.repartition(parts, "to").mapInArrow(_repeated(marks, width, k), _BLOCKS)
    home = F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).cast("int").alias("to")
    meet = documents.unionByName(copies).unionByName(ranges.select(home, "kind", "block")).repartition(parts, "to")
    done = meet.mapInArrow(_finish(width, with_kept), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans string, kept binary")
    return done.withColumnRenamed("id", id_col)


def _copy_blocks(marks: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            if len(ids):
                keys = np.array([int.from_bytes(d[:8], "little", signed=True) for d in batch.column(1).to_pylist()], "<i8")
                yield _blocks([(home, _COPIES, _packed(x, y)) for home, (x, y) in _by_bucket(_home(ids, marks), ids, keys)])

    return rows


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
