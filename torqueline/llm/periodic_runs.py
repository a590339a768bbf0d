"""Maximal periodic runs of words, by Main and Lorentz's divide and conquer.

Words of a batch of texts are interned as numbers.  Each text is halved again and again;
a run lies in the part whose middle it is the first to cross, so for every part and every
other place of it, the Z-values from the middle (how far the words from here and from the
middle agree forwards, and how far backwards) give the repetition of that period that
crosses the middle.  All parts of a depth, over all texts of the batch, go through the
arrays at once.  Places whose first three words disagree both ways are dropped, as no run
of the least length can be there; agreements of more than STEPS words are found by
bisection on prefix hashes, and every interval is compared word by word afterwards, with
a plain comparison in place of the hashes where they were wrong.  An interval found with
several periods keeps the smallest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import batch, mix, text_slices

#: Words compared one by one before hashes are used.
STEPS = 16
#: Values that stand around and between texts; each equals nothing else.
_PAD = 32
_U = np.uint64
_RADIX = 0x9FB21C651E98DF25


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many first values of two equally long arrays agree."""
    at, size = 0, 8
    while at < len(x):
        other = np.flatnonzero(x[at : at + size] != y[at : at + size])
        if len(other):
            return at + int(other[0])
        at, size = at + size, size * 4
    return len(x)


class _Words:
    """Interned words of several texts, each text followed by _PAD values of its own."""

    def __init__(self, texts: list[list[bytes]]):
        known: dict[bytes, int] = {}
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = _PAD + np.cumsum(sizes + _PAD) - sizes - _PAD
        self.end = self.begin + sizes
        self.ids = -1 - np.arange(int(sizes.sum()) + _PAD * (len(texts) + 1), dtype=np.int64)
        for s, e, t in zip(self.begin.tolist(), self.end.tolist(), texts, strict=True):
            self.ids[s:e] = [known.setdefault(w, len(known)) for w in t]
        self._sums: np.ndarray | None = None

    def _hashes(self) -> tuple[np.ndarray, np.ndarray]:
        if self._sums is None:
            n = len(self.ids)
            self._powers = np.multiply.accumulate(np.r_[_U(1), np.full(n, _RADIX, _U)])
            self._sums = np.r_[_U(0), np.cumsum(mix(self.ids.view(_U) * _U(0x9E3779B97F4A7C15) + _U(17)) * self._powers[:-1], dtype=_U)]
        return self._sums, self._powers

    def agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words from a and from b (a < b) are equal, forwards (step 1) or backwards (-1); most is a bound."""
        out = np.zeros(len(a), np.int64)
        left = np.arange(len(a))
        for i in range(STEPS):
            left = left[self.ids[a[left] + step * i] == self.ids[b[left] + step * i]]
            if not len(left):
                return out
            out[left] += 1
        sums, powers = self._hashes()
        low, high = np.full(len(left), STEPS), np.maximum(most[left], STEPS)
        x, y = a[left], b[left]
        scale = powers[y - x]
        while (open_ := low < high).any():
            half = np.where(open_, (low + high + 1) // 2, low)
            if step > 0:
                one, two = sums[x + half] - sums[x], sums[y + half] - sums[y]
            else:
                one, two = sums[x + 1] - sums[x + 1 - half], sums[y + 1] - sums[y + 1 - half]
            same = one * scale == two
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        out[left] = low
        return out

    def _plain(self, a: int, b: int, begin: int, end: int) -> tuple[int, int]:
        """The interval around a and b in which words at their distance are equal."""
        w = self.ids
        return a - _common(w[begin:a][::-1], w[begin + b - a : b][::-1]), b + _common(w[a : a + end - b], w[b:end])

    def runs(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, length, period) of all runs, by text, start and period."""
        if least < 9:
            raise ValueError("three equal words both ways are sure only in runs of nine or more")
        w = self.ids
        text = np.flatnonzero(self.end - self.begin >= least)
        lo, hi = self.begin[text], self.end[text]
        found = [np.zeros((4, 0), np.int64)]
        while len(lo):
            mid, size = (lo + hi) // 2, hi - lo
            before = np.cumsum(size) - size
            at = np.arange(int(size.sum())) + np.repeat(lo - before, size)
            near = (w[at] == np.repeat(w[mid], size)) | (w[at - 1] == np.repeat(w[mid - 1], size))
            near[before + mid - lo] = False
            c = np.flatnonzero(near)
            part = np.searchsorted(before, c, "right") - 1
            x, m = at[c], mid[part]
            ahead = (w[x] == w[m]) & (w[x + 1] == w[m + 1]) & (w[x + 2] == w[m + 2])
            behind = (w[x - 1] == w[m - 1]) & (w[x - 2] == w[m - 2]) & (w[x - 3] == w[m - 3])
            keep = ahead | behind
            x, m, owner = x[keep], m[keep], text[part[keep]]
            a, b = np.minimum(x, m), np.maximum(x, m)
            p = b - a
            up = self.agree(a, b, self.end[owner] - b, 1)
            down = self.agree(a - 1, b - 1, a - self.begin[owner], -1)
            ok = (up + down >= p) & (up + down + p >= least)
            found.append(np.stack([owner, a - down, b + up, p])[:, ok])
            lo, hi, text = np.r_[lo, mid], np.r_[mid, hi], np.r_[text, text]
            large = hi - lo >= least
            lo, hi, text = lo[large], hi[large], text[large]
        owner, s, e, p = np.concatenate(found, axis=1)
        order = np.lexsort((p, e, s))
        order = order[np.r_[True, (s[order][1:] != s[order][:-1]) | (e[order][1:] != e[order][:-1])][: len(order)]]
        owner, s, e, p = owner[order], s[order], e[order], p[order]
        wrong = np.array([not np.array_equal(w[i : j - q], w[i + q : j]) for i, j, q in zip(s.tolist(), e.tolist(), p.tolist(), strict=True)], bool)
        if wrong.any():
            return self._compared(least)
        order = np.lexsort((p, s))
        return owner[order], (s - self.begin[owner])[order], (e - s)[order], p[order]

    def _compared(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``runs``, with plain comparisons: for texts made so that the hashes of different words agree."""
        found = set()
        for t in np.flatnonzero(self.end - self.begin >= least).tolist():
            begin, end = int(self.begin[t]), int(self.end[t])
            parts = [(begin, end)]
            while parts:
                lo, hi = parts.pop()
                mid = (lo + hi) // 2
                for x in range(lo, hi):
                    if x != mid and (self.ids[x] == self.ids[mid] or self.ids[x - 1] == self.ids[mid - 1]):
                        a, b = min(x, mid), max(x, mid)
                        s, e = self._plain(a, b, begin, end)
                        if e - s >= max(least, 2 * (b - a)):
                            found.add((t, s - begin, e - s, b - a))
                parts += [(i, j) for i, j in ((lo, mid), (mid, hi)) if j - i >= least]
        best: dict = {}
        for t, s, n, p in found:
            best[t, s, n] = min(p, best.get((t, s, n), p))
        rows = sorted((t, s, p, n) for (t, s, n), p in best.items())
        t, s, p, n = np.array(rows, np.int64).reshape(-1, 4).T
        return t, s, n, p


def made_periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Of one in ten texts, by the CRC of the id, the words from some place on repeat a stretch; others, and null ids, stay."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


Change = Callable[[list[bytes], int | None], list[bytes]]


def _searched(batches: Iterator[pa.RecordBatch], least: int, change: Change | None):
    """Of slices of texts: ids, words, and each text's runs as (start, length, period)."""
    for b in batches:
        for part in text_slices(b):
            ids = part.column(0).to_pylist()
            texts = [t.as_buffer().to_pybytes().split() if t.is_valid else [] for t in part.column(1)]  # bytes.split() has the same white space
            if change:
                texts = [change(t, i) for t, i in zip(texts, ids, strict=True)]
            owner, *rest = _Words(texts).runs(least)
            border = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
            rows = np.stack(rest, axis=1)
            yield part.column(0), texts, [rows[s:e] for s, e in zip(border, border[1:], strict=False)]


def _kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words without those that repeat an earlier period of a run."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return list(compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def periodic_runs(docs: DataFrame, least: int = 12, change: Change | None = None) -> DataFrame:
    """(doc_id, start, length, period): all maximal runs of each text, in words counted from 0.

    A run is a stretch of words with smallest period q, at least ``least`` words and two
    periods long, that no word beside it extends.  Words are ``[^\\x20\\x09-\\x0D]+``.  Null,
    empty and short texts have none; each row is searched by itself, so ids may repeat
    or be null.  least is 9 at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, runs in _searched(batches, least, change):
            n = np.array([len(r) for r in runs], np.int64)
            rows = np.concatenate([np.zeros((0, 3), np.int64), *runs])
            yield batch(["doc_id", "start", "length", "period"], [ids.take(pa.array(np.repeat(np.arange(len(n)), n))), *np.ascontiguousarray(rows.T)])

    return _texts(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapsed_texts(docs: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, text): words joined by one space, without those that repeat an earlier period of a run; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_slices(b):
                for ids, words, runs in _searched([part], least, None):
                    texts = [b" ".join(_kept(w, r)).decode() if t.is_valid else None for w, r, t in zip(words, runs, part.column(1), strict=True)]
                    yield batch(["doc_id", "text"], [ids, pa.array(texts, pa.string())])

    return _texts(docs).mapInArrow(run, "doc_id long, text string")


def run_digests(docs: DataFrame, least: int = 12, change: Change | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_runs; start, length, period, exponent_milli of the longest run; runs_sha256, collapsed_sha256.

    The longest run is the one of most words (then the first, then of the smallest
    period); without a run its four columns are null.  change replaces a text's words
    before the search.  Digests are of each run's ``start,length,period`` and a line feed, by start
    and period, and of the kept words joined by one space.  Empty tables give empty ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, runs in _searched(batches, least, change):
            best, listed, left = [], [], []
            for w, r in zip(words, runs, strict=True):
                rows = r.tolist()
                s, n, p = max(rows, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
                best.append((len(rows), s, n, p, 1000 * n // p if n else None))
                listed.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in rows).encode()).hexdigest())
                left.append(hashlib.sha256(b" ".join(_kept(w, r))).hexdigest())
            columns = [pa.array(c, pa.int64()) for c in zip(*best, strict=True)]
            yield batch(["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"], [ids, *columns, listed, left])

    return _texts(docs).mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
