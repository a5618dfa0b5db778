"""Per-text kernels on NumPy arrays, used where order is inherently sequential.

A text is an array of non-negative integer symbols (bytes for strings). Row i
of its prefix order is the i-th of all prefixes, compared from right to left;
row 0 is the empty prefix. The symbol of a row is the one that follows its
prefix; the row of the whole text has none and holds the end marker.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: So many rows that share a key's symbols are compared one by one for a longer copy.
FEW = 16


def prefix_order(symbols: np.ndarray) -> np.ndarray:
    """Prefix length of each row, by doubling the number of symbols compared.

    The first keys hold as many of a prefix's last symbols as fit into 62 bits.
    """
    n = len(symbols)
    if not n:
        return np.zeros(1, np.int64)
    values = np.unique(symbols)
    code = np.searchsorted(values, symbols).astype(np.int64) + 1
    base = len(values) + 1
    step = max(1, int(62 / np.log2(base + 1)))
    key = np.zeros(n + 1, np.int64)
    for back in range(min(step, n)):
        key[back + 1 :] = key[back + 1 :] * base + code[: n - back]
        if back:
            key[1 : back + 1] *= base
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if fresh[-1] == n:
            return order
        rank = np.empty(n + 1, np.int64)
        rank[order] = fresh
        key = rank * (n + 2)
        key[step:] += rank[: n + 1 - step] + 1
        step *= 2


class Intervals:
    """Interval steps on one text's rows: each symbol's rows are kept sorted, so a step is two bisections."""

    def __init__(self, symbols: np.ndarray, order: np.ndarray):
        self.follow = np.append(symbols.astype(np.int64), -1)[order]
        self.below = np.sort(symbols)
        self.rows: dict[int, np.ndarray] = {}

    def find(self, pattern: np.ndarray) -> tuple[int, int, int]:
        """(l, r, matched): rows whose prefix ends with the longest matching start of the pattern, and its length."""
        left, right, matched = 0, len(self.follow), 0
        for c in pattern.tolist():
            if c not in self.rows:
                self.rows[c] = np.flatnonzero(self.follow == c)
            upto_left, upto_right = np.searchsorted(self.rows[c], (left, right)).tolist()
            if upto_left == upto_right:
                break
            first = int(np.searchsorted(self.below, c, "left"))
            left, right, matched = 1 + first + upto_left, 1 + first + upto_right, matched + 1
        return left, right, matched


def invert(follow: np.ndarray, marker_row: int) -> np.ndarray:
    """The text from its transform alone: follow (symbols of the rows, anything at the marker's) by last-to-first steps."""
    n = len(follow) - 1
    rows = np.delete(np.arange(n + 1), marker_row)
    target = np.zeros(n + 1, np.int64)
    target[rows[np.argsort(follow[rows], kind="stable")]] = np.arange(1, n + 1)
    out, row, step, values = np.empty(n, follow.dtype), 0, target.tolist(), follow.tolist()
    for i in range(n):
        out[i] = values[row]
        row = step[row]
    return out


def _common(text: bytes, a: int, b: int) -> int:
    """Length of the longest common start of text[a:] and text[b:], a < b."""
    have, n = 0, len(text)
    size = 8
    while b + have < n and text[a + have : a + have + size] == text[b + have : b + have + size]:
        have += min(size, n - b - have)
        size *= 2
    while size >= 1:
        if b + have + size <= n and text[a + have : a + have + size] == text[b + have : b + have + size]:
            have += size
        size //= 2
    return have


def factorise(text: bytes) -> list[tuple[int, int, int]]:
    """Greedy self-referential factors (beg, len, ch).

    The source of a factor is the one whose prefix comes first in prefix
    order, of all earlier occurrences. If the text ends inside a copied part,
    the last factor is one shorter and ends with the text's last symbol.
    """
    _, beg, length, ch = factor_arrays([text])
    return list(zip(beg.tolist(), length.tolist(), ch.tolist(), strict=True))


def factor_arrays(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The factors of many texts: how many each text has, and beg, len and ch of all.

    The prefixes of all texts stand one after the other, so that short texts
    share the steps. A key holds as many of a prefix's last symbols as fit into
    64 bits. Rows that share their last k symbols are neighbours in prefix
    order, and all but the earliest prefix of them end with a copy of k
    symbols; that is looked at for each k of a key, longer copies are compared.
    """
    if not texts:
        return (np.empty(0, np.int64),) * 4
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate(([0], np.cumsum(sizes + 1)))
    first, last, n = base[:-1], base[1:] - 1, int(base[-1])
    joined = b"".join(x for t in texts for x in (b"\0", t))  # the last symbol of each prefix
    raw = np.frombuffer(joined, np.uint8)
    code = np.cumsum(np.bincount(raw, minlength=256) > 0).astype(np.uint64)[raw]
    code[first] = 0  # only the empty prefixes: no two prefixes of a text have it at the same distance
    bits = int(code.max()).bit_length() or 1
    key, depth = _last_symbols(code, bits)

    origin_of, end_of = np.repeat(first, sizes + 1), np.repeat(last, sizes + 1)
    order = np.empty(n, np.int64)
    for beg, end in zip(base[:-1].tolist(), base[1:].tolist(), strict=True):
        order[beg:end] = key[beg:end].argsort()
    order += origin_of
    gap = key[order]  # where a row's key differs from that of the row before
    gap[1:] ^= gap[:-1].copy()
    gap[first] = ~np.uint64(0)
    row_of = _split_equals(order, gap != 0, depth)

    heads = {}  # for each k the first rows of those that share k last symbols
    earliest, rows, copied = order, np.arange(n), np.empty(n, np.int64)
    for k in range(depth, 0, -1):
        copied[earliest] = k
        fresh = np.flatnonzero(gap >> np.uint64(bits * (depth - k)))
        earliest, gap, rows = np.minimum.reduceat(earliest, fresh), gap[fresh], rows[fresh]
        heads[k] = rows
    copied[earliest] = 0

    places = np.arange(n)
    stop = np.cumsum(np.bincount(places - copied, minlength=n)) - 1  # where the longest copy from each place ends
    follow = np.minimum(stop + 1, end_of)
    follow[last] = last + 1
    follow[stop - places == depth] = -1
    step, starts, s = follow.data, [], 0
    while s < n:
        starts.append(s)
        s = step[s]
        if s < 0:
            at = starts[-1]
            room = int(end_of[at])
            stop[at] = _copy_end(joined, order, row_of, heads[depth], at, at + depth, int(origin_of[at]), room)
            s = min(int(stop[at]) + 1, room)
    start = np.array(starts, np.int64)
    start = start[start != end_of[start]]
    end, origin = stop[start], origin_of[start]
    length = end - start

    source = origin.copy()
    for k in range(1, depth + 1):
        here = np.flatnonzero(np.minimum(length, depth) == k)
        row = row_of[end[here]]
        left = heads[k][np.searchsorted(heads[k], row, "right") - 1]
        for i in np.flatnonzero(length[here] > k).tolist():
            left[i] = _first_equal(joined, order, int(left[i]), int(row[i]), int(start[here[i]]), int(origin[here[i]]))
        source[here] = _first_below(order, left, end[here]) - length[here]
    close = np.minimum(end + 1, end_of[start])
    return np.diff(np.searchsorted(start, base)), source - origin, close - 1 - start, raw[close]


def copied_end(text: bytes, start: int, order: np.ndarray) -> bool:
    """Whether text[start:] also ends before the text does, order being the text's prefix order."""
    rows = Intervals(np.frombuffer(text, np.uint8), order)
    left, right, matched = rows.find(np.frombuffer(text[start:], np.uint8))
    return matched == len(text) - start and right - left > 1


def _last_symbols(code: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """At each place as many codes backwards as fit into 64 bits, the nearest one first, and how many these are."""
    depth, have, key = 64 // bits, 1, code
    while have < depth:
        more = min(have, depth - have)
        longer = key << np.uint64(bits * more)
        if have < len(key):
            longer[have:] |= key[:-have] >> np.uint64(bits * (have - more))
        key, have = longer, have + more
    return key, depth


def _split_equals(order: np.ndarray, fresh: np.ndarray, step: int) -> np.ndarray:
    """The row of each prefix; puts rows that share `step` last symbols in order, those that aren't fresh with the row before."""
    n = len(order)
    rows = np.arange(n)
    row_of = np.empty(n, np.int64)
    row_of[order] = np.maximum.accumulate(np.where(fresh, rows, 0))
    while True:
        rows = rows[~fresh | np.append(~fresh[1:], False)]
        if not len(rows):
            return row_of
        ends = order[rows]
        key = row_of[ends] * (n + 1) + row_of[ends - step]
        by = key.argsort()
        ends, key = ends[by], key[by]
        order[rows] = ends
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        row_of[ends] = np.maximum.accumulate(np.where(fresh, rows, 0))
        step *= 2


def _copy_end(joined: bytes, order: np.ndarray, row_of: np.ndarray, heads: np.ndarray, start: int, end: int, origin: int, last: int) -> int:
    """Where the longest copy from start ends, at `end` or later. Rows from a head up to the next share the last symbols from start to end."""

    def neighbours(at: int) -> tuple[np.ndarray, int]:
        row = int(row_of[at])
        i = int(np.searchsorted(heads, row, "right"))
        near = order[heads[i - 1] : heads[i] if i < len(heads) else len(order)]
        return near, row - int(heads[i - 1])

    near, row = neighbours(end)
    far = end
    if len(near) <= FEW:
        for e in near.tolist():
            if e < end and far < last and joined[e + 1 : e + 2 + far - end] == joined[end + 1 : far + 2]:
                far = min(end + _common(joined, e + 1, end + 1), last)
        return far

    def copied(at: int) -> bool:
        """Whether what is from start to `at` also ends before: then the nearest row on one side that is earlier ends with it."""
        near, row = neighbours(at)
        part = joined[start + 1 : at + 1]
        found = [e for e in (_nearest_below(near[:row][::-1], at), _nearest_below(near[row + 1 :], at)) if e >= 0]
        return any(e - len(part) >= origin and joined[e + 1 - len(part) : e + 1] == part for e in found)

    step, up = 1, True
    while step:
        if far + step <= last and copied(far + step):
            far += step
        else:
            up = False
        step = 2 * step if up else step // 2
    return far


def _nearest_below(entries: np.ndarray, limit: int) -> int:
    """The first of entries that is below a limit, -1 if there is none."""
    beg, width = 0, 64
    while beg < len(entries):
        hits = np.flatnonzero(entries[beg : beg + width] < limit)
        if len(hits):
            return int(entries[beg + hits[0]])
        beg, width = beg + width, 2 * width
    return -1


def _first_below(order: np.ndarray, row: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The first entry of order below its limit, from each row on; there is one."""
    found, todo = order[row], np.arange(len(row))
    for _ in range(32):
        todo = todo[found[todo] >= limit[todo]]
        if not len(todo):
            return found
        row[todo] += 1
        found[todo] = order[row[todo]]
    for i in todo.tolist():
        found[i] = _nearest_below(order[row[i] :], limit[i])
    return found


def _first_equal(joined: bytes, order: np.ndarray, left: int, row: int, start: int, origin: int) -> int:
    """The first row from left on whose last symbols are those from start to the prefix of a row; rows between the two have them as well."""
    end = int(order[row])
    part = joined[start + 1 : end + 1]
    while left < row:
        middle = (left + row) // 2
        e = int(order[middle])
        if e - len(part) >= origin and joined[e + 1 - len(part) : e + 1] == part:
            row = middle
        else:
            left = middle + 1
    return row


def unfactorise(factors: Iterable[tuple[int, int, int]]) -> bytes:
    out = bytearray()
    for beg, length, ch in factors:
        if beg + length <= len(out):
            out += out[beg : beg + length]
            length = 0
        while length > 0:  # a source may run into what it makes: copy what is there, then again
            part = out[beg : beg + min(length, len(out) - beg)]
            out += part
            beg += len(part)
            length -= len(part)
        out.append(ch)
    return bytes(out)
