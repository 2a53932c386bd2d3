"""Pairs of sets that share keys, for many sets that hold few of few keys.

Sets meet where they share their first key, as in the join of `overlap`. There, sets that are alike count as one, and two are candidates
only if they also share what `least` asks for, up to two keys more: those are sorted, and no other pair is looked at. What two sets
share is read off their bits. A pair comes from its first shared keys, so once. Pairs are sent piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Keys in all, sets that meet as many in a cell, and what is looked at or sent at once, about.
KEYS, SETS, PIECE = 4096, 32_768, 1_000_000
#: Entries of a product of matrices that cost no more than one subset or candidate.
WORTH = 2000


def _pieces(counts: np.ndarray, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) for each of counts[row] places of each row, a piece at a time."""
    ends = np.cumsum(counts)
    for at in range(0, int(ends[-1]) if len(ends) else 0, piece):
        upto = min(at + piece, int(ends[-1]))
        rows = np.arange(np.searchsorted(ends, at, "right"), np.searchsorted(ends, upto - 1, "right") + 1)
        starts = ends[rows] - counts[rows]
        row = np.repeat(rows, np.minimum(ends[rows], upto) - np.maximum(starts, at))
        yield row, np.arange(at, upto) - (ends - counts)[row]


class _Cell:
    """The sets of one first key, or of two parts of them, as distinct rows of bits with their members."""

    def __init__(self, rank: int, keys: int, least: int, items: pa.Array, ends: np.ndarray, ranks: np.ndarray, second: np.ndarray) -> None:
        self.rank, self.least, self.items = rank, least, items
        own = np.repeat(np.arange(len(items)), np.diff(ends))
        held = np.zeros((len(items), -(-(keys + 1) // 64) * 64), bool)
        held[own, ranks] = True
        words = np.packbits(held, axis=1, bitorder="little")
        _, first, of = np.unique(words.view(np.dtype((np.void, words.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.held, self.bits = held[first], words[first].view(np.uint64)
        self.upto = np.packbits(np.tri(held.shape[1], dtype=bool), axis=1, bitorder="little").view(np.uint64)
        sides = [~second, second] if second.any() else [~second]
        self.sides = []
        for side in sides:
            at = np.flatnonzero(side)
            at = at[np.argsort(of[at], kind="stable")]
            self.sides.append((at, np.searchsorted(of[at], np.arange(len(first) + 1))))

    def subsets(self) -> np.ndarray | None:
        """Sorted code * sets + set for up to two keys after the first; None if they are more than worth it."""
        n, more, width = len(self.bits), min(self.least, 3) - 1, self.held.shape[1]
        after = self.held[:, self.rank + 1 :]
        sizes = after.sum(axis=1)
        if (sizes * (sizes - 1) // 2 if more == 2 else sizes).sum() > min(20 * PIECE, n * (n - 1) // 2):
            return None
        found = [np.empty(0, np.int64)]
        for k in np.unique(sizes[sizes >= more]):
            sets = np.flatnonzero(sizes == k)
            own = np.nonzero(after[sets])[1].reshape(len(sets), k) + self.rank + 1
            i, j = np.triu_indices(k, 1) if more == 2 else (np.zeros(k, np.int64), np.arange(k))
            codes = (own[:, i] * width if more == 2 else 0) + own[:, j]
            found.append((codes * n + sets[:, None]).ravel())
        return np.sort(np.concatenate(found))

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(x, y, last, so many): pairs of distinct sets that share so many keys at least, the greatest of them last."""
        n = len(self.bits)
        codes = self.subsets()
        if codes is not None:
            code, sets = codes // n, codes % n
            cuts = np.concatenate([np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)]])
            left = np.repeat(cuts, np.diff(cuts, prepend=0)) - np.arange(len(code)) - 1 if len(code) else np.empty(0, np.int64)
            if left.sum() <= n * (n - 1) // 2:
                for row, place in _pieces(left, PIECE):
                    yield sets[row], sets[row + 1 + place], code[row] % self.held.shape[1], min(self.least, 3)
                return
        for row, place in _pieces(np.arange(n)[::-1], PIECE):
            yield row, row + 1 + place, np.full(len(row), self.rank), 1

    def sent(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, left: int, right: int) -> Iterator[pa.RecordBatch]:
        """Each member of x with each of y; those of one set on one side once."""
        (a, a_ends), (b, b_ends) = self.sides[left], self.sides[right]
        wide = np.diff(b_ends)[y]
        for row, place in _pieces(np.diff(a_ends)[x] * wide, PIECE):
            down = place // wide[row]
            i, j = a[a_ends[x[row]] + down], b[b_ends[y[row]] + place - down * wide[row]]
            w = weight[row]
            if left == right and (same := x[row] == y[row]).any():
                used = ~same | (i < j)
                i, j, w = i[used], j[used], w[used]
            yield pa.record_batch([self.items.take(pa.array(i)), self.items.take(pa.array(j)), pa.array(w)], ["x", "y", "weight"])

    def pairs(self) -> Iterator[pa.RecordBatch]:
        """(x, y, weight) of those whose first shared key is the cell's."""
        size = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        alike = np.flatnonzero((size >= self.least) & (np.bitwise_count(self.bits & self.upto[self.rank]).sum(axis=1) == 1))
        yield from self.sent(alike, alike, size[alike], 0, len(self.sides) - 1)
        for x, y, last, so_many in self.candidates():
            shared = self.bits[x] & self.bits[y]
            once = np.bitwise_count(shared & self.upto[last]).sum(axis=1) == so_many
            weight = np.bitwise_count(shared[once]).sum(axis=1, dtype=np.int64)
            x, y = x[once][weight >= self.least], y[once][weight >= self.least]
            weight = weight[weight >= self.least]
            yield from self.sent(x, y, weight, 0, len(self.sides) - 1)
            if len(self.sides) == 2:
                yield from self.sent(y, x, weight, 0, 1)


def met(batches: Iterator[pa.RecordBatch], keys: int, least: int) -> Iterator[pa.RecordBatch]:
    """(x, y, weight) from rows (rank, low, high, part, item, keys) in the order of rank, low and high: a cell at a time."""
    of, held = None, []

    def pairs() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists, second = rows["keys"].combine_chunks(), rows["part"].to_numpy() == of[2]
        if of[1] == of[2]:
            second[:] = False
        elif second.all() or not second.any():
            return
        yield from _Cell(of[0], keys, least, rows["item"].combine_chunks(), lists.offsets.to_numpy(), lists.values.to_numpy(), second).pairs()

    for batch in batches:
        cell = np.stack([batch.column(c).to_numpy() for c in ("rank", "low", "high")], axis=1)
        cuts = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
            if a < b:
                if of != (now := tuple(map(int, cell[a]))) and held:
                    yield from pairs()
                    held = []
                of = now
                held.append(batch.slice(a, b - a))
    if held:
        yield from pairs()
