"""External induced sorting of the suffixes of a shard.

Suffixes move through queues that are ordered by first symbol and, within a symbol, by arrival, which induction makes the
suffix order; queues write what exceeds a memory bound to a temporary file. Work goes batch by batch: all suffixes of one
symbol that are known at a time induce their left neighbours at once. One induction orders the substrings between
left-most S positions and names them, the names are ranked by doubling, and a second induction from the ranked positions
yields all suffixes. Order is exact up to ``depth`` symbols, which is all that windows of that length need.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

from .textbytes import BASES, U64, mix, powers, prefix

MEMORY = 64 << 20


class SymbolQueue:
    """First-in-first-out lists of positions, one per symbol, of which at most ``memory`` bytes are held."""

    def __init__(self, symbols: int, memory: int = MEMORY) -> None:
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.held, self.memory, self.file = 0, memory, None

    def push(self, symbol: np.ndarray, position: np.ndarray) -> None:
        """Append positions to the lists of their symbols, in the given order."""
        if not len(symbol):
            return
        order = np.argsort(symbol, kind="stable")
        symbol, position = symbol[order], position[order]
        begin = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(symbol)], strict=True):
            self.put(int(symbol[a]), position[a:b])

    def put(self, symbol: int, position: np.ndarray) -> None:
        self.parts[symbol].append(position)
        self.held += position.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for part in self.parts:
            for i, x in enumerate(part):
                if isinstance(x, np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(np.ascontiguousarray(x).tobytes())
                    part[i] = (at, len(x), x.dtype)
        self.held = 0

    def take(self, symbol: int) -> np.ndarray:
        """All of a symbol's list, which is empty then."""
        out = []
        for x in self.parts[symbol]:
            if isinstance(x, np.ndarray):
                self.held -= x.nbytes
            else:
                at, n, kind = x
                self.file.seek(at)
                x = np.frombuffer(self.file.read(n * kind.itemsize), kind)
            out.append(x)
        self.parts[symbol] = []
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def s_type(s: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the next one; the last one is."""
    n = len(s)
    rises = np.ones(n, bool)
    rises[:-1] = s[:-1] < s[1:]
    decides = np.ones(n, bool)
    decides[:-1] = s[:-1] != s[1:]
    at = np.flatnonzero(decides)
    return rises[at[np.searchsorted(at, np.arange(n))]]


def induce(s: np.ndarray, symbols: int, starts: np.ndarray, memory: int = MEMORY) -> Iterator[np.ndarray]:
    """All suffixes, largest first, in batches, induced from the left-most S positions given in their order."""
    given, ahead, kept = SymbolQueue(symbols, memory), SymbolQueue(symbols, memory), SymbolQueue(symbols, memory)
    given.push(s[starts], starts)
    for c in range(symbols):  # left to right: suffixes that are larger than their right neighbour
        batch = ahead.take(c)
        while len(batch):
            kept.put(c, batch)
            before = batch[batch > 0] - 1
            sym = s[before]
            ahead.push(sym[sym > c], before[sym > c])
            batch = before[sym == c]
        batch = given.take(c)
        before = batch[batch > 0] - 1
        ahead.push(s[before], before)
    for c in range(symbols - 1, -1, -1):  # right to left: the others
        batch = ahead.take(c)
        while len(batch):
            yield batch
            before = batch[batch > 0] - 1
            sym = s[before]
            ahead.push(sym[sym < c], before[sym < c])
            batch = before[sym == c]
        batch = kept.take(c)[::-1]
        if len(batch):
            yield batch
            before = batch[batch > 0] - 1
            sym = s[before]
            ahead.push(sym[sym < c], before[sym < c])
    for queue in (given, ahead, kept):
        queue.close()


def suffixes(s: np.ndarray, depth: int, memory: int = MEMORY) -> Iterator[np.ndarray]:
    """The suffixes of s but that of its end, largest first, in batches; s ends with its only 0. Ties beyond depth are free."""
    n, symbols = len(s), int(s.max()) + 1
    kind = s_type(s)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    if not len(lms):  # the sentinel alone, or a falling text
        yield from induce(s, symbols, np.array([n - 1]), memory)
        return
    # Order the substrings from one left-most S position to the next, and name them.
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = np.concatenate([b[is_lms[b]] for b in induce(s, symbols, lms, memory)])[::-1]
    end = np.append(lms[1:], n - 1)
    index = np.zeros(n, np.int64)
    index[lms] = np.arange(len(lms))
    sums = prefix(s.astype(np.uint32) + 1, BASES[0])
    at = index[order]
    high = np.minimum(end[at] + 1, n)
    with np.errstate(over="ignore"):
        text = mix((sums[high] - sums[order]) * powers(BASES[0], n + 1, True)[order] + (high - order).astype(U64))
    differs = np.ones(len(order), bool)
    differs[1:] = (text[1:] != text[:-1]) | ((high - order)[1:] != (high - order)[:-1])
    same = np.flatnonzero(~differs)
    differs[same] = ~_alike(s, order[same - 1], order[same], (high - order)[same])
    rank = np.zeros(len(lms), np.int64)
    rank[at] = np.cumsum(differs)
    # Rank the suffixes of the names by doubling; a name stands for two symbols at least.
    step = 1
    while step < max(2, depth // 2 + 1) and rank.max() < len(rank):
        second = np.zeros(len(rank), np.int64)
        second[:-step] = rank[step:]
        both = rank * (len(rank) + 1) + second
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    yield from induce(s, symbols, lms[np.argsort(rank, kind="stable")], memory)


def _alike(s: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of s at a and at b have the same symbols."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(size)
    low = 0
    while low < len(a):  # about a million symbols at a time
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (1 << 20), "right")))
        n = size[low:high]
        which = np.repeat(np.arange(low, high), n)
        away = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        out[which[s[a[which] + away] != s[b[which] + away]]] = False
        low = high
    return out


def equal_windows(s: np.ndarray, windows: np.ndarray, depth: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(group, place) of the windows of depth symbols that have an equal; windows: whether one starts at each place.

    Equal windows are neighbours in suffix order; neighbours with one hash are compared symbol by symbol.
    """
    sums = prefix(s.astype(np.uint32) + 1, BASES[1])
    inverse = powers(BASES[1], len(s) + 1, True)
    last = np.zeros(0, np.int64)
    groups, places, group = [], [], 0
    for batch in suffixes(s, depth, memory):
        mine = batch[windows[batch]]
        if not len(mine):
            continue
        row = np.concatenate([last, mine])
        with np.errstate(over="ignore"):
            h = (sums[row + depth] - sums[row]) * inverse[row]
        same = np.flatnonzero(h[1:] == h[:-1])
        same = same[_alike(s, row[same], row[same + 1], np.full(len(same), depth))]
        link = np.zeros(len(row), bool)
        link[same + 1] = True
        name = group + np.cumsum(~link)
        again = link.copy()
        again[:-1] |= link[1:]
        groups.append(name[again])
        places.append(row[again])
        group = int(name[-1]) - 1
        last = row[-1:]
    if not groups:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(groups), np.concatenate(places)
