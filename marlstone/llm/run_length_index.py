"""A run-length index of short texts: run-compressed Burrows-Wheeler transform with samples at run ends.

The index keeps one sample for each run of the transform: the text position at
the run's start, the position at the end of the run before (its predecessor in
suffix order), and their common length. Within runs, both move along with the
text, so that these samples alone give, for every position of the text in turn, its predecessor
and the length of their match: the stream of matching statistics.
"""

from __future__ import annotations

import numpy as np

#: Symbols in the first sort key (9 bits each); later keys double this.
FIRST = 7


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array, and the ranks by the first h symbols for growing h.

    Symbol 0 ends a text and counts as another symbol each time, in text order.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(FIRST, symbols.dtype)]).astype(np.int64)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(FIRST):
        s = padded[k : k + n]
        key = (key << 9) | np.where(alive, s, 0)
        alive &= s != 0
    order = np.argsort(key, kind="stable")
    ranked, ended = key[order], ~alive[order]
    new = np.ones(n, bool)
    new[1:] = (ranked[1:] != ranked[:-1]) | ended[1:]
    h, levels = FIRST, []
    rank = np.empty(n, np.int64)
    while True:
        starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = starts
        levels.append((h, rank.copy()))
        open_ = ~(new & np.append(new[1:], True))
        if not open_.any():
            return order, levels
        at = np.flatnonzero(open_)
        suffix = order[at]
        key = (rank[suffix] << 32) | rank[suffix + h]
        again = np.argsort(key, kind="stable")
        order[at] = suffix[again]
        key = key[again]
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[at] = fresh
        h *= 2


class RunLengthIndex:
    def __init__(self, texts: list[bytes]):
        joined = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int64) + 1
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        joined[self.starts + lengths] = 0
        self.symbols, self.size = joined, len(joined)
        order, levels = suffix_order(joined)
        before = joined[order - 1]  # the transform
        run = np.ones(self.size, bool)
        run[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        heads = np.flatnonzero(run)
        self.runs = len(heads)
        at = order[heads]
        previous = np.where(heads > 0, order[heads - 1], -1)
        common = np.where(previous >= 0, self._common(at, np.maximum(previous, 0), levels), 0)
        by_text = np.argsort(at, kind="stable")
        self.at, self.previous, self.common = at[by_text], previous[by_text], common[by_text]

    def _common(self, a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Common prefix lengths of the suffixes at ``a`` and ``b``."""
        out = np.zeros(len(a), np.int64)
        last = self.size - 1
        for h, rank in reversed(levels):
            for _ in range(2 if h == levels[-1][0] else 1):
                out += h * (rank[np.minimum(a + out, last)] == rank[np.minimum(b + out, last)])
        going = np.ones(len(a), bool)
        for _ in range(FIRST):
            x, y = self.symbols[np.minimum(a + out, last)], self.symbols[np.minimum(b + out, last)]
            going &= (x == y) & (x != 0)
            out += going
        return out

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the text: its predecessor in suffix order, and the length of their match."""
        flag = np.zeros(self.size, np.int64)
        flag[self.at] = 1
        sample = np.cumsum(flag) - 1
        inside = np.arange(self.size) - self.at[sample]
        return self.previous[sample] + inside, self.common[sample] - inside

    def repeats(self, length: int) -> np.ndarray:
        """Whether the ``length`` bytes from a position on also start at an earlier position of the indexed texts."""
        previous, match = self.matching_statistics()
        linked = match >= length
        first = np.arange(self.size)
        root = np.where(linked, previous, first)
        todo = np.flatnonzero(linked)
        while len(todo):
            further = root[root[todo]]
            moved = further != root[todo]
            root[todo] = further
            todo = todo[moved]
        members = np.flatnonzero(linked)
        earliest = first.copy()
        np.minimum.at(earliest, root[members], members)
        return earliest[root] < first
