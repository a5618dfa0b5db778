"""A text's transform that grows by symbols at its end, and the factors that become final as it does.

The rows are the text's prefixes in prefix order. Their order never changes
when the text grows: a symbol is written into the end marker's row, and one new
row takes the marker. So a step is a count of the symbol before the marker and
two insertions. Pieces that are long beside the text are sorted in anew.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass, field

import numpy as np

from runloom.functions import kernels

#: A piece of more than this share of the text is sorted in with the whole text.
SHARE = 1 / 16


@dataclass
class Growing:
    text: bytearray = field(default_factory=bytearray)
    follow: bytearray = field(default_factory=lambda: bytearray(1))  # the symbol of each row; any at the marker's
    places: array = field(default_factory=lambda: array("q", [0]))  # prefix length of each row
    marker: int = 0
    # the open factor: where it starts, the rows whose prefix ends with it, how many factors are final
    start: int = 0
    left: int = 0
    right: int = 1
    closed: int = 0

    def _count(self, c: int, upto: int) -> int:
        """How often a symbol follows the rows before `upto`."""
        return self.follow.count(c, 0, upto) - (self.marker < upto and self.follow[self.marker] == c)

    def _smaller(self, c: int) -> int:
        return sum(self.follow.count(x) for x in range(c)) - (self.follow[self.marker] < c)

    def extend(self, piece: bytes) -> list[tuple[int, int, int, int]]:
        """Appends a piece; the factors (number, beg, len, ch) that it makes final."""
        if len(piece) > max(64, len(self.text) * SHARE):
            return self._rebuild(piece)
        out = []
        for c in piece:
            first = 1 + self._smaller(c)
            left, right = first + self._count(c, self.left), first + self._count(c, self.right)
            if left == right:  # the factor ends with this symbol
                out.append(self._factor(len(self.text), c))
                self.start, self.closed = len(self.text) + 1, self.closed + 1
            row = first + self._count(c, self.marker)
            self.follow[self.marker] = c
            self.follow.insert(row, 0)
            self.places.insert(row, len(self.text) + 1)
            self.marker = row
            self.text.append(c)
            # the new row's prefix ends with the open factor as well
            self.left, self.right = (0, len(self.follow)) if left == right else (left, right + 1)
        return out

    def _rebuild(self, piece: bytes) -> list[tuple[int, int, int, int]]:
        before = self.closed
        self.text += piece
        symbols = np.frombuffer(bytes(self.text), np.uint8)
        order = kernels.prefix_order(symbols)
        self.marker = int(np.flatnonzero(order == len(symbols))[0])
        self.follow = bytearray(np.append(symbols, 0)[order].astype(np.uint8).tobytes())
        self.places = array("q", order.astype(np.int64).tobytes())
        factors = kernels.factorise(bytes(self.text))
        # the last one is open, unless it ends with a symbol that began no copy
        ends = np.cumsum([f[1] + 1 for f in factors])
        open_ = len(factors) > 0 and kernels.copied_end(bytes(self.text), int(ends[-1] - factors[-1][1] - 1), order)
        final = factors[:-1] if open_ else factors
        self.closed = len(final)
        self.start = int(ends[len(final) - 1]) if final else 0
        self.left, self.right, _ = kernels.Intervals(symbols, order).find(symbols[self.start :])
        return [(before + i, *f) for i, f in enumerate(final[before:])]

    def _factor(self, end: int, c: int) -> tuple[int, int, int, int]:
        """The open factor, ended by a symbol: its source is the first row but the one at the end itself."""
        length = end - self.start
        return self.closed, self._source(end) - length if length else 0, length, c

    def _source(self, end: int) -> int:
        return self.places[self.left] if self.places[self.left] != end else self.places[self.left + 1]

    def open_factor(self) -> tuple[int, int, int, int] | None:
        """The last factor if the text ended now; None if all are final."""
        length = len(self.text) - self.start
        if not length:
            return None
        return self.closed, self._source(len(self.text)) - length, length - 1, self.text[-1]

    def find(self, pattern: bytes) -> tuple[int, int]:
        """Rows whose prefix ends with the pattern."""
        left, right = 0, len(self.follow)
        for c in pattern:
            first = 1 + self._smaller(c)
            left, right = first + self._count(c, left), first + self._count(c, right)
            if left == right:
                return 0, 0
        return left, right

    def begins(self, pattern: bytes) -> list[int]:
        """Where the pattern begins, in the order of the rows."""
        left, right = self.find(pattern)
        return [p - len(pattern) for p in self.places[left:right]]

    def sizes(self) -> tuple[int, int, int]:
        """(n, r, sigma)."""
        rest = np.delete(np.frombuffer(bytes(self.follow), np.uint8), self.marker)
        return len(rest), int(len(rest) > 0) + int(np.count_nonzero(rest[1:] != rest[:-1])), len(np.unique(rest))

    def packed(self) -> tuple[bytes, bytes, bytes, int, int, int, int, int]:
        return bytes(self.text), bytes(self.follow), self.places.tobytes(), self.marker, self.start, self.left, self.right, self.closed

    @staticmethod
    def unpacked(text, follow, places, *numbers) -> Growing:
        found = array("q")
        found.frombytes(bytes(places))
        return Growing(bytearray(text), bytearray(follow), found, *map(int, numbers))
