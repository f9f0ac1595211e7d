"""Run-length index of a collection of short texts: a run-compressed Burrows-Wheeler transform with sampled run ends.

Every text ends in a terminator of its own, smaller than any byte; terminators order as their texts do.  Rows are the
suffixes in order, and a run is a stretch of rows with the same byte before them.  Where two neighbouring rows have
the same byte before them, the suffixes one byte longer are neighbours as well; so of a position p that heads no run,
the neighbour before it is one behind the neighbour of p - 1, and shares one byte less with it.  It is enough to keep
of each run, in order of text positions: ``head``, the position of its first row; ``end``, the position of the row
before, which is the last of the run before; and ``common``, how many bytes these two share.  Nothing that is kept
grows with a text, but with the number of runs.

Texts are streamed through these samples for their matching statistics: for every position the neighbour before it
and the length of the match.  Positions linked by matches of ``reach`` bytes or more start the same string.
"""

from __future__ import annotations

import numpy as np


class RunIndex:
    def __init__(self, texts: list[bytes]):
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.length + 1) - self.length - 1
        self.size = n = int((self.length + 1).sum())
        data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
        ends = self.start + self.length
        left = (np.repeat(ends, self.length + 1) - np.arange(n)).astype(np.int32)  # bytes up to the terminator
        order, levels = self._sorted(data, left)

        # runs: rows whose byte differs from that of the row before; no two texts begin with the same byte before them
        before = data[order - 1].astype(np.int32)
        before[np.isin(order, self.start)] = -1
        heads = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] < 0)) + 1
        head, end = order[heads], order[heads - 1]
        common = self._common(head, end, data, left, levels)
        # the very first row has none before it: it shares nothing, with itself
        head, end, common = np.append(head, order[0]), np.append(end, order[0]), np.append(common, 0)
        by = np.argsort(head)
        self.head, self.end, self.common = head[by], end[by], common[by]

    @staticmethod
    def _sorted(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffixes in order, ranked by ever longer starts, and the ranks by the length of these starts; behind its terminator a text is empty."""
        n, longest = len(data), int(left.max(initial=0)) + 1
        place = np.arange(n)
        bits = max(1, n.bit_length())
        used = np.flatnonzero(np.bincount(data, minlength=256))
        letter = np.zeros(256, np.int64)
        letter[used] = np.arange(1, len(used) + 1)
        wide = max(1, int(len(used) + 1).bit_length())
        known = max(1, min((63 - bits) // wide, longest))
        code = np.zeros(n, np.int64)
        for k in range(known):
            code <<= wide
            ok = np.flatnonzero(left > k)
            code[ok] += letter[data[ok + k]]
        levels = []
        while True:
            if 3 * bits <= 63 or not levels:  # places ride in the low bits, so one plain sort of numbers does
                packed = (code << bits) | place
                packed.sort()
                order, ordered = packed & ((1 << bits) - 1), packed >> bits
            else:
                order = np.argsort(code, kind="stable")
                ordered = code[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) + 1
            levels.append((known, rank))
            if known >= longest or int(rank[order[-1]]) == n:
                return order, levels
            ok = np.flatnonzero(left >= known)
            code = rank.astype(np.int64) << bits
            code[ok] |= rank[ok + known]
            known *= 2

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray, data: np.ndarray, left: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """How many bytes the suffixes of a and b share, by the longest starts of equal rank first."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for size, rank in [*reversed(levels), *((1, data),) * (levels[0][0] - 1)]:
            x, y = a[live], b[live]
            same = (left[x] >= size) & (left[y] >= size) & (rank[x] == rank[y])
            step = live[same]
            a[step], b[step] = a[step] + size, b[step] + size
            out[step] += size
        return out

    def matching_statistics(self, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of the positions from first up to last the neighbour before each in the order of suffixes, and the length of the match."""
        place = np.arange(first, self.size if last is None else last)
        run = np.searchsorted(self.head, place, "right") - 1
        ahead = place - self.head[np.maximum(run, 0)]
        length = np.where(run >= 0, np.maximum(self.common[np.maximum(run, 0)] - ahead, 0), 0)
        return np.where(length > 0, self.end[np.maximum(run, 0)] + ahead, place), length

    def repeated(self, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of every place whose next ``reach`` bytes start earlier in the collection."""
        link = np.arange(self.size)
        linked = []
        for first in range(0, self.size, 1 << 18):
            source, length = self.matching_statistics(first, min(first + (1 << 18), self.size))
            long = np.flatnonzero(length >= reach)
            link[first + long] = source[long]
            linked.append(first + long)
        linked = np.concatenate(linked) if linked else np.zeros(0, np.int64)
        todo = linked  # follow the links to the first of each string in the order of suffixes
        while len(todo):
            link[todo] = link[link[todo]]
            todo = todo[link[link[todo]] != link[todo]]
        root = link[linked]
        earliest = np.arange(self.size)
        np.minimum.at(earliest, root, linked)
        place = np.union1d(linked, root)
        place = place[place > earliest[link[place]]]
        text = np.searchsorted(self.start, place, "right") - 1
        return text, place - self.start[text]
