"""Removal of byte strings that occurred before, by suffix arrays of shards.

Every window of ``size`` bytes has an anchor: of its GRAM-byte strings the one with the
smallest hash.  Equal windows have equal anchors, so
- only windows whose anchor string occurs twice or more take part (anchors are counted
  over all documents, in buckets by hash), and
- all windows with one anchor string go to one shard: as segments, the texts of successive
  windows with one anchor.

A shard's segments are cut down to the windows whose hash occurs twice or more in it, and are one byte string, in the
order of documents and places.  External induced sorting (``induced_sort``) gives its suffixes with their common prefixes; suffixes that agree for
``size`` bytes are one class, and all but its first occurrence are covered.  A task reads
its shards one after the other and sorts as many together as SHARD_BYTES hold.

Anchors that HOT or more places have (frequent lines or passages) don't make one group:
their windows are dealt by the anchor and the bytes around it that all windows with the
anchor at about the same place share, which is all of a window but GRAM bytes.  Equal
segments are settled where they meet, in a task before the shuffle and in a shard before
sorting: the first one stays in the race, and the others are covered.

Rows travel as compressed blocks, one for each task and bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .induced_sort import END, suffixes
from .kernels import batch, mix, slide_min, text_buffer, text_slices
from .runtime import bounded_broadcast, working_tables, write_table

GRAM = 16
#: Places from which on an anchor's windows are dealt by what stands around it; doubled until at most HOT_KEYS anchors are.
HOT, HOT_KEYS = 1000, 1 << 17
#: Windows of a segment, of a part of a text, and anchors of a task's block.
LONGEST, PART, ANCHORS = 1024, 1 << 20, 1 << 19
#: Places whose windows are hashed at a time.
SLICE = 1 << 18
#: Bytes of segments that a task gathers before it sends them, and that are sorted together.
GATHERED, SHARD_BYTES = 12 << 20, 4 << 20
#: Buckets for each shuffle partition at most, and bytes of text for each bucket at least.
SPREAD, BUCKET_BYTES = 4, 1 << 20
_U = np.uint64
_PLACE = _U((1 << 24) - 1)
_WORDS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def _pack(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    n = np.array([len(columns[0])], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([n.tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns), tail]))


def _unpack(block: bytes, *kinds) -> list:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return [*out, raw[at:]]


def _dealt(name: str, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row (bucket, block) for each bucket, with its entries of the columns in their order."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
    blocks = [_pack(*(c[order[s:e]] for c in columns)) for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True)]
    return batch([name, "block"], [bucket[order[edge]].astype(np.int32), pa.array(blocks, pa.binary())])


class _Windows:
    """The windows of some texts' parts in a row: text, place, anchor place and anchor hash of each."""

    def __init__(self, data: np.ndarray, parts: list[tuple[int, int, int, int]], size: int):
        """parts: (text, place of its first window, where that stands in data, how many windows)."""
        self.base = parts[0][2]
        end = parts[-1][2] + parts[-1][3] + size - 1
        raw = self.raw = np.concatenate([data[self.base : end], np.zeros(16, np.uint8)])
        word = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
        n = end - self.base - GRAM + 1
        self.grams = mix((word[:n] * _WORDS[0]) ^ ((word[8 : n + 8] + _U(1)) * _WORDS[1]))
        low = slide_min((self.grams & ~_PLACE) | np.arange(n, dtype=_U), size - GRAM + 1)
        count = np.array([p[3] for p in parts])
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        self.at = inside + np.repeat(np.array([p[2] - self.base for p in parts]), count)  # where a window stands
        self.place = inside + np.repeat(np.array([p[1] for p in parts]), count)
        self.part = np.repeat(np.arange(len(parts)), count)
        self.text = np.array([p[0] for p in parts])
        self.anchor = (low[self.at] & _PLACE).astype(np.int64)
        moved = np.flatnonzero((self.anchor[1:] != self.anchor[:-1]) | (self.part[1:] != self.part[:-1])) + 1
        heads = np.r_[0, moved]
        key = self.grams[self.anchor[heads]]
        new = np.r_[True, (key[1:] != key[:-1]) | (self.part[heads][1:] != self.part[heads][:-1])]
        self.first, self.key = heads[new], key[new]  # runs of windows with one anchor string
        self.several = np.add.reduceat(np.ones(len(heads), np.int64), np.flatnonzero(new)) > 1

    def around(self, windows: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the bytes that windows with the anchor at about the same place share: all but GRAM of ``size``."""
        step = GRAM + 1
        begin = self.anchor[windows] - (self.anchor[windows] - self.at[windows]) // step * step
        total = np.zeros(len(windows), _U)
        for i, off in enumerate([*range(0, size - 2 * GRAM, GRAM), size - 2 * GRAM]):
            total += mix(self.grams[begin + off] + _U(i + 1))
        return mix(total)


def _windows(texts: pa.Array, size: int) -> Iterator[_Windows]:
    """The windows of a column of texts, about PART of them at a time."""
    data, off = text_buffer(texts)
    waiting, total = [], 0
    for text in np.flatnonzero(np.diff(off) >= size).tolist():
        begin, n = int(off[text]), int(off[text + 1] - off[text]) - size + 1
        for place in range(0, n, PART):
            now = min(PART, n - place)
            if waiting and total + now > PART:
                yield _Windows(data, waiting, size)
                waiting, total = [], 0
            total += begin + place + now - (waiting[-1][2] + waiting[-1][3] if waiting else begin + place)
            waiting.append((text, place, begin + place, now))
    if waiting:
        yield _Windows(data, waiting, size)


def _anchors(size: int, buckets: int):
    """(bucket, block): key, doc, place of the first window, and how many here have that anchor string (0 after the first of them)."""

    def sent(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, doc, place, several = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        count = np.zeros(len(key), np.int64)
        count[order[new]] = np.maximum(np.diff(np.r_[new, len(key)]), np.maximum.reduceat(several[order], new) * 2)
        # what is known to repeat needs no other bucket's word, so it is dealt by document
        where = np.where(count > 0, key, mix(doc.view(_U)))
        return _dealt("bucket", (where % _U(buckets)).astype(np.int64), key, doc, place, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = [], 0
        for b in batches:
            for part in text_slices(b, 2):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                for w in _windows(part.column(2), size):
                    rows.append([w.key, ids[w.text[w.part[w.first]]], w.place[w.first], w.several.astype(np.int64)])
                    total += len(w.first)
                    if total >= ANCHORS:
                        yield sent(rows)
                        rows, total = [], 0
        if rows:
            yield sent(rows)

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, its blocks) of rows sorted by bucket."""
    now, blocks = None, []
    for b in batches:
        for bucket, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if bucket != now and blocks:
                yield now, blocks
                blocks = []
            now = bucket
            blocks.append(block)
    if blocks:
        yield now, blocks


def _repeated(buckets: int, hot: int):
    """(bucket, block) by document: doc and place of runs whose anchor string occurs again; and (-1, block): anchors of ``hot`` places or more, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _buckets(batches):
            key, doc, place, count = (np.concatenate(c) for c in zip(*(_unpack(b, _U, np.int64, np.int64, np.int64)[:4] for b in blocks), strict=True))
            known = count == 0
            o = np.argsort(key[~known], kind="stable")
            rest = np.flatnonzero(~known)[o]
            again = known.copy()
            if len(rest):
                new = np.flatnonzero(np.r_[True, key[rest][1:] != key[rest][:-1]])
                total = np.add.reduceat(count[rest], new)
                again[rest] = np.repeat(total > 1, np.diff(np.r_[new, len(rest)]))
                often = total >= hot
                if often.any():
                    yield batch(["bucket", "block"], [np.array([-1], np.int32), pa.array([_pack(key[rest[new[often]]], total[often])], pa.binary())])
            if again.any():
                doc, place = doc[again], place[again]
                o = np.lexsort((place, doc))
                yield _dealt("bucket", (mix(doc[o].view(_U)) % _U(buckets)).astype(np.int64), doc[o], place[o])

    return run


def _by_document(names: tuple[str, ...]):
    """One row for each document (or document and tag) of a bucket's blocks, with its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _buckets(batches):
            columns = [np.concatenate(c) for c in zip(*(_unpack(b, *[np.int64] * len(names))[:-1] for b in blocks), strict=True)]
            ids = columns[: len(names) - (2 if len(names) > 2 else 1)]
            order = np.lexsort((columns[len(ids)], *reversed(ids)))
            columns = [c[order] for c in columns]
            ids = columns[: len(ids)]
            new = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in ids], axis=0)])
            spans = zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=True)
            packed = [np.stack([c[s:e] for c in columns[len(ids) :]]).tobytes() for s, e in spans]
            yield batch([*names[: len(ids)], "spans"], [*(x[new] for x in ids), pa.array(packed, pa.binary())])

    return run


def _segments(size: int, shards: int, hot: np.ndarray):
    """(bucket, block): segments by shard (doc, tag, place, windows, bytes), and covered spans with bucket + shards."""

    def sent(found: dict[bytes, tuple], settled: list) -> Iterator[pa.RecordBatch]:
        raws, rows = list(found), list(found.values())
        if rows:
            key = np.array([r[4] for r in rows], np.int64)
            bucket = (mix(key.view(_U)) % _U(shards)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            meta = np.array([r[:4] for r in rows], np.int64)
            edge = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]).tolist()
            blocks = []
            for s, e in zip(edge, [*edge[1:], len(order)], strict=True):
                i = order[s:e]
                blocks.append(_pack(*meta[i].T, tail=b"".join([raws[j] for j in i.tolist()])))
                if len(blocks) == 64:
                    yield batch(["bucket", "block"], [bucket[order[edge[:64]]].astype(np.int32), pa.array(blocks, pa.binary())])
                    edge, blocks = edge[64:], []
            if blocks:
                yield batch(["bucket", "block"], [bucket[order[edge]].astype(np.int32), pa.array(blocks, pa.binary())])
        if settled:
            columns = np.array(settled, np.int64).T
            yield _dealt("bucket", shards + (mix(columns[0].view(_U)) % _U(shards)).astype(np.int64), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, settled, total = {}, [], 0
        for b in batches:
            for part in text_slices(b, 2):
                ids, tags = part.column(0).to_pylist(), part.column(1).to_pylist()
                wanted = [np.frombuffer(x, np.int64) for x in part.column(3).to_pylist()]
                for w in _windows(part.column(2), size):
                    text = w.text[w.part[w.first]]
                    place = w.place[w.first]
                    keep = np.zeros(len(text), bool)
                    edge = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]).tolist()
                    for s, e in zip(edge, [*edge[1:], len(text)], strict=True):
                        keep[s:e] = np.isin(place[s:e], wanted[text[s]])
                    stop = np.r_[w.first[1:], len(w.at)]
                    first, stop, key = w.first[keep], stop[keep], w.key[keep]
                    often = np.isin(key, hot)
                    pieces = [(f, min(f + LONGEST, t), k) for a, z, k in zip(first[~often].tolist(), stop[~often].tolist(), key[~often].view(np.int64).tolist(), strict=True) for f in range(a, z, LONGEST) for t in (z,)]
                    if often.any():
                        n = (stop - first)[often]
                        i = np.repeat(first[often] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                        around = w.around(i, size).view(np.int64)
                        new = np.flatnonzero(np.r_[True, (around[1:] != around[:-1]) | (i[1:] != i[:-1] + 1) | (w.part[i][1:] != w.part[i][:-1])])
                        pieces += [(int(i[s]), int(i[e - 1]) + 1, k) for s, e, k in zip(new.tolist(), [*new[1:].tolist(), len(i)], around[new].tolist(), strict=True)]
                    raw = w.raw.tobytes()
                    for f, t, k in pieces:
                        at = int(w.at[f])
                        piece = raw[at : at + t - f + size - 1]
                        who = int(w.text[w.part[f]])
                        row = (ids[who], tags[who], int(w.place[f]), t - f, k)
                        other = found.get(piece)
                        if other is None:
                            found[piece] = row
                            total += len(piece)
                        elif other[:3] != row[:3]:
                            found[piece] = min(other, row)
                            settled.append(max(other, row)[:4])
                    if total >= GATHERED:
                        yield from sent(found, settled)
                        found, settled, total = {}, [], 0
        yield from sent(found, settled)

    return run


def _digests(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on, SLICE places at a time."""
    out = np.zeros(len(data) - size + 1, _U)
    for at in range(0, len(out), SLICE):
        raw = data[at : at + SLICE + size - 1]
        part, width = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)), 8
        while width < size:  # two halves, which overlap in the last step
            step = min(width, size - width)
            part, width = mix((part[:-step] * _WORDS[0]) ^ ((part[step:] + _U(1)) * _WORDS[1])), width + step
        out[at : at + SLICE] = part
    return out


def _again(rows: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments cut down to runs of windows whose hash occurs twice or more; equal windows have equal hashes, so no repeat is lost."""
    length = rows[:, 3] + size  # with END
    begin = np.cumsum(length) - length
    at = np.arange(int(rows[:, 3].sum())) + np.repeat(begin - np.cumsum(rows[:, 3]) + rows[:, 3], rows[:, 3])
    digest = _digests(data, size)[at]
    found = np.sort(digest)
    found = found[1:][found[1:] == found[:-1]]
    if not len(found):
        return rows[:0], data[:0]
    near = np.searchsorted(found, digest)
    at = at[found[np.minimum(near, len(found) - 1)] == digest]
    owner = np.searchsorted(begin, at, "right") - 1
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])])
    n, head, owner = np.diff(np.r_[new, len(at)]), at[new], owner[new]
    length = n + size
    stop = np.cumsum(length)
    less = data[np.arange(int(stop[-1])) + np.repeat(head - stop + length, length)]
    less[stop - 1] = END
    return np.stack([rows[owner, 0], rows[owner, 1], rows[owner, 2] + head - begin[owner], n], axis=1), less


def _covered(rows: np.ndarray, pieces: list[bytes], size: int) -> np.ndarray:
    """(doc, tag, place, windows) of all windows of different segments that occur before, by one suffix array."""
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    data = np.frombuffer(b"".join([x for i in order.tolist() for x in (pieces[i], bytes([END]))]), np.uint8)
    rows, data = _again(rows[order], data, size)
    if not len(rows):
        return np.zeros((0, 4), np.int64)
    length = rows[:, 3] + size  # with END
    begin = np.cumsum(length) - length
    late = np.zeros(len(data), bool)
    first = -1  # the first place of the class that the last block ended in
    for place, prefix in suffixes(data, size):
        new = prefix < size
        if first >= 0 and not new[0]:
            place, new = np.r_[np.int32(first), place], np.r_[True, new]
            new[1] = False
        else:
            new[0] = True
        heads = np.flatnonzero(new)
        low = np.minimum.reduceat(place, heads)
        late[place] = True
        late[low] = False
        first = int(low[-1])
    inside = np.arange(len(data)) - np.repeat(begin, length)
    late &= inside < np.repeat(rows[:, 3], length)
    at = np.flatnonzero(late)
    if not len(at):
        return np.zeros((0, 4), np.int64)
    owner = np.searchsorted(begin, at, "right") - 1
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])])
    n = np.diff(np.r_[new, len(at)])
    return np.stack([rows[owner[new], 0], rows[owner[new], 1], rows[owner[new], 2] + at[new] - begin[owner[new]], n], axis=1)


def _sorted_shards(size: int, shards: int):
    """(bucket, block) by document: doc, tag, place, windows that occur before."""

    def dealt(rows: np.ndarray) -> pa.RecordBatch:
        return _dealt("bucket", (mix(np.ascontiguousarray(rows[:, 0]).view(_U)) % _U(shards)).astype(np.int64), *rows.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, tuple] = {}
        settled: list[tuple] = []
        total = 0

        def solved() -> Iterator[pa.RecordBatch]:
            if found:
                out = _covered(np.array(list(found.values()), np.int64), list(found), size)
                if len(out):
                    yield dealt(out)
            if settled:
                yield dealt(np.array(settled, np.int64))

        for bucket, blocks in _buckets(batches):
            for block in blocks:
                *meta, raw = _unpack(block, *[np.int64] * 4)
                if bucket >= shards:
                    yield dealt(np.stack(meta, axis=1))
                    continue
                at = 0
                for row in zip(*(m.tolist() for m in meta), strict=True):
                    piece = raw[at : at + row[3] + size - 1]
                    at += len(piece)
                    other = found.get(piece)
                    if other is None:
                        found[piece] = row
                        total += len(piece)
                    elif other[:3] != row[:3]:
                        found[piece] = min(other, row)
                        settled.append(max(other, row))
            if total >= SHARD_BYTES:
                yield from solved()
                found, settled, total = {}, [], 0
        yield from solved()

    return run


def _cut(size: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_slices(b):
                numbers, digests, kept = [], [], []
                for text, spans in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    runs: list[list[int]] = []
                    if spans is not None:
                        place, n = np.frombuffer(spans, np.int64).reshape(2, -1)
                        for s, e in sorted(zip(place.tolist(), (place + n + size - 1).tolist(), strict=True)):
                            if runs and s <= runs[-1][1]:
                                runs[-1][1] = max(runs[-1][1], e)
                            else:
                                runs.append([s, e])
                    left = b"".join([raw[s:e] for s, e in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(raw)], strict=True)])
                    numbers.append((len(raw), len(raw) - len(left), len(runs)))
                    digests.append(hashlib.sha256(left).hexdigest()) if not texts else kept.append(left)
                columns = [pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)]
                yield batch(["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if texts else "kept_sha256"], [part.column(0), *columns, pa.array(kept, pa.binary()) if texts else pa.array(digests, pa.string())])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tag"), F.col("text").cast("string").alias("text"))


def _dealt_out(df: DataFrame) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket")


def _hot_keys(anchors: DataFrame) -> np.ndarray:
    """The anchors of HOT places or more; HOT is doubled until HOT_KEYS hold them."""

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column(1).to_pylist():
                key, n, _ = _unpack(block, np.int64, np.int64)
                yield batch(["key", "level"], [key, np.log2(n // HOT).astype(np.int32)])

    found = write_table(anchors.where("bucket = -1").mapInArrow(levels, "key long, level int"), "hot", 1 << 20)
    counts = dict(found.groupBy("level").count().collect())
    level = 0
    while sum(n for k, n in counts.items() if k >= level) > HOT_KEYS:
        level += 1
    return np.sort(np.array([r.key for r in found.where(F.col("level") >= level).select("key").collect()], np.int64)).view(_U)


def covered_spans(docs: DataFrame, size: int = 100) -> DataFrame:
    """(doc_id, tag, spans): of each text, where windows of ``size`` bytes start that also start earlier.

    Earlier is in a smaller doc_id, or in the same text before.  spans are two rows of long
    values: first windows, and how many follow one another.  tag is a hash of the text:
    rows of one doc_id and one text are one document, and rows that share a doc_id come
    in order of their tags.  Rows without doc_id, and null or shorter texts, take no part.
    size is from 48 to 254.
    """
    if not 3 * GRAM <= size < 255:
        raise ValueError("size must be from 48 to 254")
    spark = docs.sparkSession
    texts = _texts(docs).where("doc_id is not null and text is not null")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(1 + total // BUCKET_BYTES, SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")))
    row = "bucket int, block binary"
    anchors = _dealt_out(texts.mapInArrow(_anchors(size, buckets), row)).mapInArrow(_repeated(buckets, HOT), row)
    anchors = write_table(anchors, "anchors")
    hot = _hot_keys(anchors)
    places = _dealt_out(anchors.where("bucket >= 0")).mapInArrow(_by_document(("doc_id", "place")), "doc_id long, spans binary")
    segments = texts.join(places, "doc_id").select("doc_id", "tag", "text", "spans").mapInArrow(_segments(size, buckets, hot), row)
    late = _dealt_out(segments).mapInArrow(_sorted_shards(size, buckets), row)
    return _dealt_out(late).mapInArrow(_by_document(("doc_id", "tag", "place", "n")), "doc_id long, tag long, spans binary")


def _without(docs: DataFrame, size: int, texts: bool) -> DataFrame:
    with working_tables() as kept:
        spans = write_table(covered_spans(docs, size), "spans")
        kept.append(spans)
    rows, n = _texts(docs), spans.count()
    if 24 * n <= runtime.BROADCAST_BYTES:  # only texts that have spans travel to them
        ids = bounded_broadcast(spans.select("doc_id", "tag"), n, 24)
        apart = rows.join(ids, ["doc_id", "tag"], "left_anti").withColumn("spans", F.lit(None).cast("binary"))
        both = rows.join(ids, ["doc_id", "tag"], "left_semi").join(spans, ["doc_id", "tag"]).select("doc_id", "text", "spans").union(apart.select("doc_id", "text", "spans"))
    else:
        both = rows.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    last = "kept binary" if texts else "kept_sha256 string"
    return both.mapInArrow(_cut(size, texts), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")


def repeat_digests(docs: DataFrame, size: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, without the bytes that earlier windows cover.

    n_spans counts maximal removed runs.  A null text is empty; a row without doc_id loses
    nothing; empty tables give empty ones; see ``covered_spans`` for repeated ids.
    """
    return _without(docs, size, False)


def without_repeated_bytes(docs: DataFrame, size: int = 100) -> DataFrame:
    """As ``repeat_digests``, with the bytes that are left (kept) in place of their digest."""
    return _without(docs, size, True)
