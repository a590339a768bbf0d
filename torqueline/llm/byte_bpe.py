"""Byte-level BPE encoding and decoding over a rank file.

A text is cut by the tokenizer's pattern.  Pre-tokens are looked up twice: a minimal
perfect hash (hash and displace) over the vocabulary resolves those that are tokens
themselves; the others are merged by a heap of adjacent pairs over linked bytes, least
rank first, leftmost among equals, which is O(n log n) in a pre-token's length.  Work
is per distinct pre-token of a batch; merged ones are remembered up to a bound.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import batch

#: Merged pre-tokens in each of the two generations that a worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 300_000, 64
#: They stay with the worker from task to task, by the vocabulary's digest: (newer, older).
_remembered: dict[str, tuple[dict[bytes, list[int]], dict[bytes, list[int]]]] = {}
#: Code points that the regex module knows as letters or numbers but the
#: tokenizer libraries' older Unicode tables don't know at all, as ranges (first-last).
LATER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d
107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f
12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20
18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96
1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f
2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
#: Bytes of text handled at once.
PIECE = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash from keys to their positions in a list: n slots for n keys."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = n // 2 + 1
        h = self.hashes(keys)
        order = np.argsort(h % np.uint64(self.buckets), kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff((h % np.uint64(self.buckets))[order])) + 1) if n else []
        self.shift, self.key_at = np.zeros(self.buckets, np.int32), np.full(n, -1, np.int32)
        free = np.ones(n, bool)
        for g in sorted((g for g in groups if len(g) > 1), key=len, reverse=True):
            for d in range(1, 1 << 30):
                slots = self._slots(h[g], d)
                if free[slots].all() and len(set(slots.tolist())) == len(g):
                    break
            free[slots] = False
            self.key_at[slots] = g
            self.shift[int(h[g[0]] % np.uint64(self.buckets))] = d
        empty = iter(np.flatnonzero(free))
        for g in groups:
            if len(g) == 1:  # a bucket of one key names its slot
                slot = next(empty)
                self.key_at[slot] = g[0]
                self.shift[int(h[g[0]] % np.uint64(self.buckets))] = -slot - 1

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _slots(self, h: np.ndarray, d) -> np.ndarray:
        x = (h ^ (h >> np.uint64(29))) + np.asarray(d).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(max(self.n, 1))).astype(np.int64)

    def __call__(self, keys: list[bytes]) -> np.ndarray:
        """Position that each key has if it is one of the keys (others get any position)."""
        h = self.hashes(keys)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.key_at[np.where(d < 0, -d - 1, self._slots(h, d))]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: pairs merge by least rank until none is a token."""
    n, rank = len(word), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, s, e = heappop(heap)
        m = after[s]
        if m < 0 or m >= n or after[m] != e:
            continue
        after[s], after[m] = e, -1
        if e < n:
            before[e] = s
            if (r := rank(word[s : after[e]])) is not None:
                heappush(heap, (r, s, after[e]))
        if (p := before[s]) >= 0 and (r := rank(word[p:e])) is not None:
            heappush(heap, (r, p, e))
    out, s = [], 0
    while s < n:
        out.append(ranks[word[s : after[s]]])
        s = after[s]
    return out


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.ids = np.array([ranks[t] for t in self.tokens], np.uint32)
        self.perfect = PerfectHash(self.tokens)
        self.digest = hashlib.sha256(b"".join(self.tokens) + self.ids.tobytes() + pattern.encode()).hexdigest()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("finders", "bytes_at")}

    @functools.cached_property
    def finders(self):
        """Search for code points of LATER, the pattern's findall, and its findall with those as other characters."""
        # \s as the tokenizer libraries have it: Unicode's White_Space
        pattern = self.pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        later = "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in LATER.split())
        other = pattern.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"(?:[{later}]|[^\p{{White_Space}}\p{{L}}\p{{N}}])")
        for kind in (r"\p{L}+", r"\p{N}+"):
            other = other.replace(f" ?{kind}", f" ?(?:(?![{later}]){kind[:-1]})+")
        return regex.compile(f"[{later}]").search, regex.compile(pattern).findall, regex.compile(other).findall

    def find(self, text: str) -> list[str]:
        has_later, usual, with_later = self.finders
        return with_later(text) if not text.isascii() and has_later(text) else usual(text)

    @functools.cached_property
    def bytes_at(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes, and start and length by id."""
        size = int(self.ids.max()) + 1
        length = np.zeros(size, np.int64)
        length[self.ids] = [len(t) for t in self.tokens]
        start = np.zeros(size, np.int64)
        start[self.ids] = np.cumsum(length[self.ids]) - length[self.ids]
        return np.frombuffer(b"".join(self.tokens), np.uint8), start, length

    def pre_token_ids(self, words: list[bytes]) -> list[list[int]]:
        newer, older = _remembered.get(self.digest, ({}, {}))
        out = [newer.get(w) for w in words]
        missing = [i for i, got in enumerate(out) if got is None]
        place = self.perfect([words[i] for i in missing])
        for i, own, t in zip(missing, self.ids[place].tolist(), place.tolist(), strict=True):
            w = words[i]
            if self.tokens[t] == w:
                out[i] = [own]
                continue
            out[i] = older.get(w) or merge(w, self.ranks)
            if len(w) <= LONGEST:
                if len(newer) >= REMEMBERED:
                    newer, older = {}, newer
                newer[w] = out[i]
        _remembered[self.digest] = newer, older
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (n + 1 offsets)."""
        found = [self.find(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        words = pa.array([w for f in found for w in f], pa.large_string()).dictionary_encode()
        codes = words.indices.to_numpy()
        parts = self.pre_token_ids(words.dictionary.cast(pa.large_binary()).to_pylist())
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        pool = np.fromiter((i for p in parts for i in p), np.uint32, int(length.sum()))
        ids = spread(pool, np.cumsum(length) - length, length, codes)
        ends = np.r_[0, np.cumsum(length[codes])]
        return ids, ends[np.r_[0, np.cumsum(sizes)]]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and where each id's begin."""
        data, start, length = self.bytes_at
        return spread(data, start, length, ids), np.r_[0, np.cumsum(length[ids])]


def spread(pool: np.ndarray, start: np.ndarray, length: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Concatenate pool[start[c] : start[c] + length[c]] for all codes."""
    n = length[codes]
    total = int(n.sum())
    at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[codes], n)
    return pool[at]


def groups_by_size(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to about ``most``."""
    at = 0
    while at < len(sizes):
        to, total = at, 0
        while to < len(sizes) and (to == at or total + sizes[to] <= most):
            total += int(sizes[to])
            to += 1
        yield at, to
        at = to


def _digests(codec: Codec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(1)], np.int64)
            for s, e in groups_by_size(sizes, PIECE):
                texts = [x or "" for x in b.column(1).slice(s, e - s).to_pylist()]
                ids, at = codec.encode(texts)
                data, byte_at = codec.decode(ids)
                raw, cut = ids.astype("<u4").tobytes(), byte_at[at]
                yield batch(
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    [
                        b.column(0).slice(s, e - s),
                        np.diff(at),
                        pa.array([hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)], pa.string()),
                        pa.array([hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.string()),
                    ],
                )

    return run


def _encoded(codec: Codec, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(text)], np.int64)
            for s, e in groups_by_size(sizes, PIECE):
                part = b.slice(s, e - s)
                ids, at = codec.encode([x or "" for x in part.column(text).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
                columns = [c for i, c in enumerate(part.columns) if i != text]
                yield batch([f"c{i}" for i in range(len(columns) + 2)], [*columns, np.diff(at), lists])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encoded(docs: DataFrame, codec: Codec) -> DataFrame:
    """docs with n_tokens and ids (array of int) in place of text; a null text is empty.

    Columns of docs that are called n_tokens or ids, in any case, give way to the new ones.
    Rows are independent, whatever their ids; an empty table stays empty.
    """
    names = [c for c in docs.columns if c.lower() not in ("text", "n_tokens", "ids")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").cast("string").alias("text"))
    kinds = [docs.schema[c].dataType.simpleString() for c in names] + ["long", "array<int>"]
    rows = docs.mapInArrow(_encoded(codec, len(names)), ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return rows.toDF(*names, "n_tokens", "ids")


def encoding_digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, encoded and decoded again.

    A null text is an empty one.  Rows are independent: null or repeated ids pass
    through, an empty table gives an empty result.
    """
    return _rows(docs).mapInArrow(_digests(codec), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
