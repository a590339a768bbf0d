"""Induced sorting of the suffixes of a byte string, with common prefixes, through queues on disk.

The order counts up to a horizon of bytes only, and so do common prefixes.  Suffixes are
of type S (smaller than the next one) or L.  The leftmost S suffixes of each row of them
are the samples: the pieces of text between them are named by rank, the reduced string of
names is sorted (three names at a time, groups that are settled or reach the horizon
drop out), and all other suffixes are induced from them: a suffix goes into the queue of
its first byte when the one that follows it is read, first all of type L by ascending
bytes, then all of type S by descending ones.

Queues hold (place, common prefix with the entry before).  Common prefixes come from the
reading order: of two successive entries of a queue, it is one more than the least
common prefix between the suffixes that brought them in.  Beyond MEMORY bytes all waiting
entries go to a file of the task, and come back in blocks.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np

#: Bytes of queue entries in memory, and entries of a block.
MEMORY, BLOCK = 12 << 20, 1 << 17
#: A byte that UTF-8 never has: it ends each part of the string.
END = 0xFE
_CUT = 7
_U = np.uint64
_TOP = np.array([(0xFFFFFFFFFFFFFFFF << (64 - 8 * k)) & 0xFFFFFFFFFFFFFFFF for k in range(9)], _U)
_BYTES = np.array([1 << (8 * k) for k in range(8)], _U)


class _Queues:
    """First-in-first-out queues of (place, common prefix), one a byte value, that share a file."""

    def __init__(self):
        self.waiting: dict[int, list] = defaultdict(list)
        self.read: dict[int, list] = defaultdict(list)
        self.held, self.file = 0, None

    def put(self, byte: int, place: np.ndarray, prefix: np.ndarray) -> None:
        self.waiting[byte].append((place, prefix))
        self.held += 5 * len(place)
        if self.held > MEMORY:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()  # unlinked at once, so that nothing stays behind
        self.file.seek(0, 2)
        for queues in (self.waiting, self.read):
            for blocks in queues.values():
                for i, block in enumerate(blocks):
                    if len(block) == 2:
                        blocks[i] = (self.file.tell(), len(block[0]), None)
                        self.file.write(block[0].tobytes())
                        self.file.write(block[1].tobytes())
        self.held = 0

    def _load(self, block: tuple) -> tuple[np.ndarray, np.ndarray]:
        if len(block) == 2:
            return block
        at, n, _ = block
        self.file.seek(at)
        raw = self.file.read(5 * n)
        return np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.uint8, n, 4 * n)

    def take(self, byte: int, keep: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """The next entries, or None; keep: they can be read once more."""
        blocks, n, k = self.waiting[byte], 0, 0
        while k < len(blocks) and n < BLOCK:
            n += len(blocks[k][0]) if len(blocks[k]) == 2 else blocks[k][1]
            k += 1
        if not k:
            return None
        taken, self.waiting[byte] = blocks[:k], blocks[k:]
        if keep:
            self.read[byte] += taken
        else:
            self.held -= sum(5 * len(b[0]) for b in taken if len(b) == 2)
        loaded = [self._load(b) for b in taken]
        return np.concatenate([p for p, _ in loaded]), np.concatenate([x for _, x in loaded])

    def again(self, byte: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The entries that were kept, last block first."""
        blocks = self.read.pop(byte, [])
        while blocks:
            taken, n = [], 0
            while blocks and n < BLOCK:
                block = blocks.pop()
                self.held -= 5 * len(block[0]) if len(block) == 2 else 0
                taken.append(self._load(block))
                n += len(taken[-1][0])
            taken.reverse()
            yield np.concatenate([p for p, _ in taken]), np.concatenate([x for _, x in taken])


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first : last + 1], for each pair."""
    size = last - first + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    table, width = values, 1
    for k in range(int(level.max(initial=0)) + 1):
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = np.minimum(table[first[here]], table[last[here] - width + 1])
        if 2 * width > len(values):
            break
        table, width = np.minimum(table[:-width], table[width:]), 2 * width
    return out


class _Text:
    """A byte string that ends with END, and what its words tell."""

    def __init__(self, data: np.ndarray, horizon: int):
        self.n, self.horizon = len(data), horizon
        self.data = np.concatenate([data, np.full(horizon + 16, END, np.uint8)])
        self.words = np.ndarray((len(self.data) - 7,), ">u8", self.data, 0, (1,))

    def prefix(self, a: int, b: int) -> int:
        other = np.flatnonzero(self.data[a : a + self.horizon] != self.data[b : b + self.horizon])
        return int(other[0]) if len(other) else self.horizon

    def prefixes(self, a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at a and b, at most the horizon; equal tells where it is known to reach that."""
        out = np.full(len(a), self.horizon, np.uint8)
        left = np.flatnonzero(~equal)
        for at in range(0, self.horizon, 8):
            x = (self.words[a[left] + at] ^ self.words[b[left] + at]).astype(_U)
            other = x != 0
            out[left[other]] = np.minimum(self.horizon, at + 8 - np.searchsorted(_BYTES, x[other], "right"))
            left = left[~other]
            if not len(left):
                break
        return out

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """The sample suffixes in order, and the common prefix of each with the one before."""
        t = self.data[: self.n]
        ends = np.flatnonzero(np.r_[t[1:] != t[:-1], True])
        up = np.r_[t[ends[:-1]] < t[ends[:-1] + 1], False]
        place = ends[:-1][~up[:-1] & up[1:]] + 1  # a row of equal bytes after a fall and before a rise begins with a sample
        if not len(place):
            return place.astype(np.int32), np.zeros(0, np.uint8)
        far = np.r_[place[1:], self.n - 1] - place
        parts = np.maximum(-(-far // _CUT), 1)
        piece = np.repeat(np.arange(len(place)), parts)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = place[piece] + _CUT * step
        ahead = np.minimum(far[piece] - _CUT * step, _CUT)
        word = self.words[at].astype(_U)
        # a piece that meets a sample within seven bytes ends with it and is larger than one that goes on
        mask = _TOP[np.minimum(ahead + 1, _CUT)]
        word = (word & mask) | np.where(ahead < _CUT, ~mask, _U(0))
        rank = self._ranked(word, at)
        order = np.argsort(rank, kind="stable")
        order = order[step[order] == 0]
        found, rank = at[order], rank[order]
        equal = rank[1:] == rank[:-1]
        return found.astype(np.int32), np.r_[np.uint8(0), self.prefixes(found[:-1], found[1:], equal)]

    def _ranked(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the reduced string's suffixes; those that agree up to the horizon share one."""
        m = len(word)
        rank = np.zeros(m + 1, np.int64)  # behind the end stands 0, ranks begin with 1
        active, k = np.arange(m), 0
        many = 3 if m < 1 << 20 else 2
        stops = np.r_[at, self.n]
        while len(active):
            if not k:
                key = word
            else:
                key = rank[active]
                for i in range(1, many):
                    key = key * (m + 2) + rank[np.minimum(active + i * k, m)]
            order = np.argsort(key)
            key, active = key[order], active[order]
            new = np.r_[True, key[1:] != key[:-1]]
            base = rank[active] if k else np.ones(m, np.int64)
            group = np.r_[True, base[1:] != base[:-1]] if k else np.arange(m) == 0
            i = np.arange(len(active))
            begin = np.maximum.accumulate(np.where(group, i, 0))
            rank[active] = base + np.maximum.accumulate(np.where(new, i, 0)) - begin
            k = k * many if k else 1
            tied = ~new | ~np.r_[new[1:], True]
            active = active[tied]
            reach = stops[np.minimum(active + k, m)] - at[active]
            active = active[(reach < self.horizon) & (active + k < m)]
        return rank[:m]


class _Induction:
    """Reads suffixes in order and puts those before them into queues, with their common prefixes."""

    def __init__(self, text: _Text, queues: _Queues):
        self.text, self.queues = text, queues
        self.least = np.zeros(256, np.uint8)  # common prefix of what is read next with what brought in a queue's last entry

    def read(self, place: np.ndarray, prefix: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray]) -> None:
        """place: successive suffixes; prefix: common with the one read before; wanted: whether the byte before gives a suffix of the type."""
        before = self.text.data[place - 1]
        chosen = np.flatnonzero(wanted(before) & (place > 0))
        m, horizon = len(place), self.text.horizon
        if len(chosen):
            byte = before[chosen]
            order = np.argsort(byte, kind="stable")
            chosen, byte = chosen[order], byte[order]
            new = np.r_[True, byte[1:] != byte[:-1]]
            common = _range_min(prefix, np.where(new, 0, np.r_[0, chosen[:-1] + 1]), chosen)
            common[new] = np.minimum(common[new], self.least[byte[new]])
            common = np.minimum(common + np.uint8(1), np.uint8(horizon))
            bounds = np.r_[np.flatnonzero(new), len(byte)]
            back = np.minimum.accumulate(prefix[::-1])[::-1]
            np.minimum(self.least, back[0], out=self.least)
            place = place[chosen] - 1
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                self.queues.put(int(byte[s]), place[s:e], common[s:e])
                last = int(chosen[e - 1]) + 1
                self.least[byte[s]] = back[last] if last < m else horizon
        else:
            np.minimum(self.least, prefix.min(), out=self.least)


def suffixes(data: np.ndarray, horizon: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (place, common prefix with the suffix before) of all suffixes of data, in descending order.

    data is a byte string whose parts each end with END.  Suffixes that agree for
    ``horizon`` bytes (under 255) stand together in any order; of those that meet an END before, only
    the order of what comes before it holds.
    """
    text = _Text(data, horizon)
    found, common = text.samples()
    heads = text.data[found]
    bounds = np.searchsorted(heads, np.arange(257))
    present = np.unique(data).tolist()
    low, high = _Queues(), _Queues()
    ascending = _Induction(text, low)
    low.put(END, np.array([text.n - 1], np.int32), np.zeros(1, np.uint8))
    for c in present:
        last = -1
        while (block := low.take(c, keep=True)) is not None:
            place, prefix = block
            if last < 0:
                prefix = np.r_[np.uint8(0), prefix[1:]]
            last = int(place[-1])
            ascending.read(place, prefix, lambda before: before >= c)  # noqa: B023
        for i in range(int(bounds[c]), int(bounds[c + 1]), BLOCK):
            j = min(i + BLOCK, int(bounds[c + 1]))
            place, prefix = found[i:j], common[i:j]
            if i == bounds[c]:
                prefix = np.r_[np.uint8(text.prefix(last, int(place[0])) if last >= 0 else 0), prefix[1:]]
            ascending.read(place, prefix, lambda before: before > c)  # noqa: B023
    descending = _Induction(text, high)
    for c in reversed(present):
        last = -1
        while (block := high.take(c, keep=False)) is not None:
            place, prefix = block
            if last < 0:
                prefix = np.r_[np.uint8(0), prefix[1:]]
            last = int(place[-1])
            yield place, prefix
            descending.read(place, prefix, lambda before: before <= c)  # noqa: B023
        seam = None
        for place, prefix in low.again(c):
            if seam is None:
                seam = text.prefix(last, int(place[-1])) if last >= 0 else 0
            place, seam, prefix = place[::-1], int(prefix[0]), np.r_[np.uint8(seam), prefix[:0:-1]]
            yield place, prefix
            descending.read(place, prefix, lambda before: before < c)  # noqa: B023
