"""Answers on one text from its runs and its next-position map alone: nothing is kept for each byte."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from runloom.functions import kernels


@dataclass
class RunIndex:
    """A text of n symbols: runs (the end marker's row left out) with the text position of each first row, the next-position map by key, the marker's row and the position in the row after it."""

    n: int
    marker: int
    after_marker: int
    symbol: np.ndarray
    start: np.ndarray
    head: np.ndarray
    key: np.ndarray
    val: np.ndarray

    @staticmethod
    def of(symbols: np.ndarray) -> RunIndex:
        n, order = len(symbols), kernels.prefix_order(symbols)
        marker = int(np.flatnonzero(order == n)[0])
        ends = np.delete(order, marker)
        follow = symbols[ends]
        first = np.flatnonzero(np.concatenate(([True], follow[1:] != follow[:-1]))) if n else np.zeros(0, np.int64)
        whole = np.append(symbols.astype(np.int64), -1)[order]
        last = np.flatnonzero(whole[1:] != whole[:-1])
        by_key = np.argsort(order[last])
        return RunIndex(n, marker, int(order[marker + 1]) if marker < n else -1, follow[first].astype(np.uint8), first, ends[first], order[last][by_key], order[last + 1][by_key])

    def __post_init__(self):
        self.length = np.diff(np.append(self.start, self.n))
        by_symbol = np.argsort(self.symbol, kind="stable")
        sizes = self.length[by_symbol]
        upto = np.cumsum(sizes) - sizes
        self.rows: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}  # runs of a symbol, how many of it before each, how many symbols are smaller
        symbols, firsts = np.unique(self.symbol[by_symbol], return_index=True)
        for c, beg, end in zip(symbols.tolist(), firsts, np.append(firsts, len(by_symbol))[1:], strict=True):
            self.rows[c] = by_symbol[beg:end], upto[beg:end] - upto[beg], int(upto[beg])

    def _count(self, c: int, row: int) -> int:
        """How often the symbol follows the rows before this one."""
        place = row - (row > self.marker)
        runs, before, _ = self.rows[c]
        i = int(np.searchsorted(self.start[runs], place, "right")) - 1
        return 0 if i < 0 else int(before[i] + min(place - self.start[runs[i]], self.length[runs[i]]))

    def find(self, pattern: bytes) -> tuple[int, int, int]:
        """(left, right, text position of the row left): rows whose prefix ends with the pattern."""
        left, right, txt = 0, self.n + 1, 0
        for c in pattern:
            if c not in self.rows:
                return 0, 0, -1
            runs, _, smaller = self.rows[c]
            low, high = self._count(c, left), self._count(c, right)
            if low == high:
                return 0, 0, -1
            # the first row of the interval that the symbol follows: left itself, the one after the marker, or a run's head
            skip = left == self.marker
            place = left - (left > self.marker)
            i = int(np.searchsorted(self.start[runs], place, "right")) - 1
            if i >= 0 and place < self.start[runs[i]] + self.length[runs[i]]:
                at = self.after_marker if skip else txt
            else:
                at = int(self.head[runs[i + 1]])
            left, right, txt = 1 + smaller + low, 1 + smaller + high, at + 1
        return left, right, txt

    def places(self, left: int, right: int, txt: int) -> np.ndarray:
        """Text positions of the rows from left on, each found from the one before."""
        out = np.empty(right - left, np.int64)
        for i in range(right - left):
            out[i] = txt
            if i + 1 < right - left:
                j = int(np.searchsorted(self.key, txt))
                txt = int(self.val[j] - (self.key[j] - txt))
        return out

    def packed(self) -> tuple:
        return self.n, self.marker, self.after_marker, self.symbol.tobytes(), *(x.astype("<i8").tobytes() for x in (self.start, self.head, self.key, self.val))

    @staticmethod
    def unpacked(n: int, marker: int, after_marker: int, symbol: bytes, *numbers: bytes) -> RunIndex:
        return RunIndex(n, marker, after_marker, np.frombuffer(symbol, np.uint8), *(np.frombuffer(x, "<i8") for x in numbers))
