"""Removal of long word passages that an earlier document already has.

Word windows (k-mers) are the edges of a De Bruijn graph over the corpus, between nodes
of one word less.  An edge that several documents have is known by its source
coordinates: the smallest of these documents and its first place there.  Where an
occurrence goes from one repeated edge to the next and their source coordinates do so
too, the node between them doesn't branch for it, and both are one path.

Edges don't travel one by one.  Consecutive windows of a document with the same minimizer
(smallest hash among their inner GRAM-word grams) go as one row, and as equal windows
have equal minimizers, a shuffle by minimizer brings all copies of an edge together.  The
fragments of paths that come out of it are compacted at their common nodes, document by
document.  The nodes where any occurrence enters or leaves a path are the branching ones:
they are counted, each once for its source however many copies there are, and get prefix
digests of the source's words.  Fragments are joined with the digests of their two end
nodes, and a repeated span is removed only if its own words agree with the words at the
source coordinates.

Before the shuffle each piece of a task settles its own repeats: only the smallest
document of a piece stays a contender for a window, so a passage that a third of all
documents share costs one row for each piece.  Minimizers that very many documents
have (HOT or more, counted over all documents: pieces pass on all their counts, rare
ones too) are split further: their paths travel as single windows with keys of their own.
The reducers read sorted rows as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import batch, binary_lists, mix, slide_min, text_slices, window_hashes, word_hashes
from . import runtime
from .runtime import bounded_broadcast, working_tables, write_table

GRAM = 4
#: Documents from which on a minimizer's paths are split into windows.
HOT = 1000
#: Words handled at once in a task.
PIECE_WORDS = 1 << 19
#: Bytes of a window's hash that travel beside the 64 bits of its key.
WIDTH = 6
_U = np.uint64
_ROW = "key long, doc long, pos int, n int, hashes binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, word hashes, first words) of rows with a doc_id, about PIECE_WORDS words at a time."""
    ids, flats, counts, words = [], [], [], 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            flat, first = word_hashes(part.column(1), lower=False)
            ids.append(part.column(0).to_numpy(zero_copy_only=False))
            flats.append(flat)
            counts.append(np.diff(first))
            words += len(flat)
            if words >= PIECE_WORDS:
                yield np.concatenate(ids), np.concatenate(flats), np.r_[0, np.cumsum(np.concatenate(counts))]
                ids, flats, counts, words = [], [], [], 0
    if words:
        yield np.concatenate(ids), np.concatenate(flats), np.r_[0, np.cumsum(np.concatenate(counts))]


def _minimizers(flat: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows that lie in one text: their first words, minimizers and texts."""
    if len(flat) < size:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    low = slide_min(window_hashes(flat, GRAM, 301), size - GRAM + 1)
    n = np.maximum(np.diff(first) - size + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    return at, low[at], owner


def _common(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flat, first in _pieces(batches):
            at, low, owner = _minimizers(flat, first, size)
            new = np.r_[True, (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])][: len(low)]
            low, owner = low[new], owner[new]
            _, once = np.unique(low ^ mix(owner.astype(_U) + _U(1)), return_index=True)
            found, k = np.unique(low[once], return_counts=True)
            yield batch(["key", "k"], [found.view(np.int64), k.astype(np.int64)])

    return run


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs; breaks is true where a run begins."""
    s = np.flatnonzero(breaks)
    return s, np.diff(np.r_[s, len(breaks)])


def _first_of(order: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """Of each entry, the first entry of its group; order sorts by the groups' columns, then by what comes first."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for g in groups:
        x = g[order]
        new[1:] |= x[1:] != x[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


_PLACE = np.dtype([("src", "<i8"), ("spos", "<i4")])


def _paths(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, flat, first in _pieces(batches):
            at, low, owner = _minimizers(flat, first, size)
            if not len(at):
                continue
            h = window_hashes(flat, size, 302)[at]
            doc, pos = ids[owner], at - first[owner]
            first_at = _first_of(np.lexsort((doc, h)), [h])
            covered = doc[first_at] < doc
            onward = (first_at[1:] == first_at[:-1] + 1) & (owner[first_at[1:]] == owner[first_at[:-1]])
            apart = np.r_[True, (owner[1:] != owner[:-1]) | (covered[1:] != covered[:-1]) | np.where(covered[1:], ~onward, low[1:] != low[:-1])]
            s, n = _runs(apart)
            long_run = ~covered[s] & (n > 16)  # a repeated word gives one minimizer to many windows
            if long_run.any():
                for i in np.flatnonzero(long_run):
                    apart[s[i] : s[i] + n[i] : 16] = True
                s, n = _runs(apart)
            done = covered[s]
            key = np.where(done, mix(doc[s].astype(np.int64).view(_U)), low[s])
            # a settled run carries its source coordinates in place of hashes
            place = np.zeros(int(done.sum()), _PLACE)
            place["src"], place["spos"] = doc[first_at[s[done]]], pos[first_at[s[done]]]
            bytes6 = np.ascontiguousarray(h[~covered]).view(np.uint8).reshape(-1, 8)[:, :WIDTH].reshape(-1)
            size_b = np.where(done, _PLACE.itemsize, n * WIDTH)
            raw = np.empty(int(size_b.sum()), np.uint8)
            settled = np.repeat(done, size_b)
            raw[settled], raw[~settled] = place.view(np.uint8), bytes6
            yield batch(
                ["key", "doc", "pos", "n", "hashes"],
                [key.view(np.int64), doc[s], pos[s].astype(np.int32), np.where(done, -n, n).astype(np.int32), binary_lists(raw, np.r_[0, np.cumsum(size_b)])],
            )

    return run


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, doc, pos): out come fragments of paths that a smaller document of their key has, with its coordinates."""
    keys, docs, poss, ns, hs, waiting = [], [], [], [], [], 0
    carry = (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def flush():
        nonlocal carry, keys, docs, poss, ns, hs, waiting
        key, doc, pos, n = np.concatenate(keys), np.concatenate(docs), np.concatenate(poss), np.concatenate(ns)
        done = n < 0
        place = np.frombuffer(b"".join(h for h, d in zip(hs, done, strict=True) if d), _PLACE)
        raw = b"".join(h for h, d in zip(hs, done, strict=True) if not d)
        keys, docs, poss, ns, hs, waiting = [], [], [], [], [], 0
        out = [(doc[done], pos[done], -n[done], place["src"], place["spos"])]
        key, doc, pos, n = key[~done], doc[~done], pos[~done], n[~done]
        if len(n):
            wide = np.zeros((len(raw) // WIDTH, 8), np.uint8)
            wide[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
            h = wide.reshape(-1).view(_U)
            row = np.repeat(np.arange(len(n)), n)
            at = pos[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            k, w, d, p = np.r_[carry[0], key[row]], np.r_[carry[1], h], np.r_[carry[2], doc[row]], np.r_[carry[3], at]
            order = np.lexsort((p, d, w, k))
            first = _first_of(order, [k, w])
            last = order[k[order] == key[-1]]
            keep = last[np.r_[True, w[last][1:] != w[last][:-1]]]
            past = len(carry[0])
            carry = (k[keep], w[keep], d[keep], p[keep])
            i = past + np.flatnonzero(d[first[past:]] < d[past:])
            if len(i):
                src, spos = d[first[i]], p[first[i]]
                new = np.r_[True, (row[i[1:] - past] != row[i[:-1] - past]) | (i[1:] != i[:-1] + 1) | (src[1:] != src[:-1]) | (spos[1:] != spos[:-1] + 1)]
                s, length = _runs(new)
                out.append((d[i[s]], p[i[s]], length, src[s], spos[s]))
        kinds = (np.int64, np.int32, np.int32, np.int64, np.int32)
        return batch(["doc", "pos", "n", "src", "spos"], [np.concatenate([x[j] for x in out]).astype(kind) for j, kind in enumerate(kinds)])

    for b in batches:
        if not b.num_rows:
            continue
        n = b.column(3).to_numpy()
        keys.append(b.column(0).to_numpy()), docs.append(b.column(1).to_numpy()), poss.append(b.column(2).to_numpy()), ns.append(n)
        hs += b.column(4).to_pylist()
        waiting += int(np.abs(n).sum())
        if waiting >= 1 << 19:
            yield flush()
    if waiting:
        yield flush()


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of each document, joined where one ends at the node, and at the source's node, at which another begins."""
    for b in batches:
        owner = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
        x = b.column(1).flatten()
        pos, n, src, spos = (x.field(j).to_numpy().astype(np.int64) for j in range(4))
        order = np.lexsort((pos, spos - pos, src, owner))
        owner, pos, n, src, spos = owner[order], pos[order], n[order], src[order], spos[order]
        line = np.r_[True, (owner[1:] != owner[:-1]) | (src[1:] != src[:-1]) | ((spos - pos)[1:] != (spos - pos)[:-1])][: len(pos)]
        far = (np.cumsum(line) - 1) * (1 << 33)  # lines apart, so that ends can be compared along all of them at once
        reach = np.maximum.accumulate(far + pos + n)
        new = line.copy()
        new[1:] |= (far + pos)[1:] > reach[:-1]
        s = np.flatnonzero(new)
        ends = np.r_[reach[s[1:] - 1], reach[-1:]] - far[s]
        doc = b.column(0).to_numpy()[owner[s]]
        yield batch(["doc", "pos", "n", "src", "spos"], [doc, pos[s].astype(np.int32), (ends - pos[s]).astype(np.int32), src[s], spos[s].astype(np.int32)])


#: Seed of the words' second hashes, and the odd radix of prefix digests.
_SECOND, _RADIX = 12, 0x9FB21C651E98DF25


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[_U(1), np.full(n, _RADIX, _U)])


def _prefix_digests(words: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Digest of the first i words, for all i: those of a span are the difference of two, times a power."""
    return np.r_[_U(0), np.cumsum(words * powers[: len(words)], dtype=_U)]


def _node_digests(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_slices(b):
                flat, first = word_hashes(part.column(1), lower=False, seed=_SECOND)
                powers = _powers(int(np.diff(first).max(initial=0)))
                for i, at in enumerate(part.column(2)):
                    d = _prefix_digests(flat[first[i] : first[i + 1]], powers)
                    at = at.values.to_numpy()
                    at = at[at + size - 1 < len(d)]  # another text of the same doc_id may be shorter
                    yield batch(["src", "at", "here", "there"], [np.full(len(at), part.column(0)[i].as_py(), np.int64), at, d[at].view(np.int64), d[at + size - 1].view(np.int64)])

    return run


def _agreeing(words: np.ndarray, spans: pa.StructScalar, size: int, powers: np.ndarray) -> list[tuple[int, int]]:
    """Merged word ranges of the fragments whose words agree with their source's."""
    pos, n, spos, here, there = (spans.field(j).to_numpy() for j in range(5))
    end = pos.astype(np.int64) + n + size - 1
    d = _prefix_digests(words, powers)
    inside = end < len(d)
    pos, n, spos, here, there, end = (x[inside] for x in (pos, n, spos, here, there, end))
    same = (d[end] - d[pos]) * powers[spos] == (there.view(_U) - here.view(_U)) * powers[pos]
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(pos[same].tolist(), end[same].tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_slices(b):
                flat, first = word_hashes(part.column(1), lower=False, seed=_SECOND)
                found = part.column(2)
                far = max([0, *(int(x.values.field(2).to_numpy().max()) for x in found if x.is_valid)])  # the farthest source place
                powers = _powers(max(int(np.diff(first).max(initial=0)), far))
                total, gone, digest = [], [], []
                for i, text in enumerate(part.column(1)):
                    words = text.as_buffer().to_pybytes().split() if text.is_valid else []  # bytes.split() has the same white space
                    total.append(len(words))
                    for s, e in reversed(_agreeing(flat[first[i] : first[i + 1]], found[i].values, size, powers) if found[i].is_valid else []):
                        del words[s:e]
                    gone.append(total[-1] - len(words))
                    digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield batch(["doc_id", "n_words", "n_removed", "kept_sha256"], [part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def repeated_paths(docs: DataFrame, size: int = 13) -> DataFrame:
    """(doc, pos, n, src, spos): n windows from word pos on of document doc that document src, a smaller one, has from word spos on.

    Every window of ``size`` words that also starts in a document with a smaller doc_id is
    in one row; rows are as long as their source coordinates run on.  Equality is that of
    hashes here: ``verified`` compares words.  Rows without doc_id, and texts that are
    null or shorter than a window, take no part; rows that repeat a doc_id don't count
    as each other's sources.
    """
    texts = _texts(docs).where("doc_id is not null and text is not null")
    common = texts.mapInArrow(_common(size), "key long, k long").groupBy("key").agg(F.sum("k").alias("k")).where(F.col("k") >= HOT).select("key", F.lit(True).alias("hot"))
    common = write_table(common, "common")
    paths = texts.mapInArrow(_paths(size), _ROW).join(bounded_broadcast(common, common.count(), 40), "key", "left")
    split = F.coalesce(F.col("hot"), F.lit(False)) & (F.col("n") > 0)
    parts = paths.select("*", split.alias("s"), F.explode(F.when(split, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(F.lit(0)))).alias("i"))
    one = F.expr(f"substring(hashes, i * {WIDTH} + 1, {WIDTH})")
    rows = parts.select(
        F.when(F.col("s"), F.xxhash64("key", one)).otherwise(F.col("key")).alias("key"),
        "doc",
        (F.col("pos") + F.col("i")).alias("pos"),
        F.when(F.col("s"), F.lit(1)).otherwise(F.col("n")).alias("n"),
        F.when(F.col("s"), one).otherwise(F.col("hashes")).alias("hashes"),
    )
    kind = "doc long, pos int, n int, src long, spos int"
    fragments = rows.repartition("key").sortWithinPartitions("key", "doc", "pos").mapInArrow(_owners, kind)
    return fragments.groupBy("doc").agg(F.collect_list(F.struct("pos", "n", "src", "spos")).alias("x")).mapInArrow(_compacted, kind)


def branching_nodes(paths: DataFrame) -> DataFrame:
    """(src, at, entering, leaving): the nodes of source documents at which occurrences enter or leave a repeated path."""
    ends = paths.select("src", F.explode(F.array(F.struct(F.col("spos").alias("at"), F.lit(1).alias("in"), F.lit(0).alias("out")), F.struct((F.col("spos") + F.col("n")).alias("at"), F.lit(0).alias("in"), F.lit(1).alias("out")))).alias("x"))
    return ends.groupBy("src", F.col("x.at").alias("at")).agg(F.sum("x.in").alias("entering"), F.sum("x.out").alias("leaving"))


def verified(docs: DataFrame, paths: DataFrame, size: int = 13) -> DataFrame:
    """(doc, spans): each document's ``paths``, as array<struct<pos, n, spos, here, there>> with the digests at both end nodes of the source.

    here and there are digests of the source's words before the span and up to its end.
    Of the texts only those of sources meet their nodes.
    """
    nodes = write_table(branching_nodes(paths).groupBy(F.col("src").alias("doc_id")).agg(F.collect_list("at").alias("at")), "nodes")
    sources = _texts(docs).where("text is not null").join(bounded_broadcast(nodes.select("doc_id"), nodes.count(), 16), "doc_id", "left_semi")
    digests = write_table(sources.join(nodes, "doc_id").select("doc_id", "text", "at").mapInArrow(_node_digests(size), "src long, at int, here long, there long").distinct(), "digests")
    begin = digests.select("src", F.col("at").alias("spos"), "here")
    end = digests.select("src", F.col("at").alias("send"), "there")
    both = paths.withColumn("send", F.col("spos") + F.col("n")).join(begin, ["src", "spos"]).join(end, ["src", "send"])
    return both.groupBy("doc").agg(F.collect_list(F.struct("pos", "n", "spos", "here", "there")).alias("spans"))


def without_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row, after removal of the words that ``repeated_paths`` cover.

    Words are ``[^\\x20\\x09-\\x0D]+``; kept words are joined by one space.  A span whose words
    differ from those at its source coordinates stays.  A null text has no words; a row
    without doc_id loses none; rows that repeat a doc_id lose what each has itself; an
    empty table gives an empty result.
    """
    with working_tables() as kept:
        paths = write_table(repeated_paths(docs, size), "paths")
        spans = write_table(verified(docs, paths, size).withColumnRenamed("doc", "doc_id"), "spans")
        kept.append(spans)
    texts, n = _texts(docs), spans.count()
    ids = bounded_broadcast(spans.select("doc_id"), n, 16)
    if 16 * n <= runtime.BROADCAST_BYTES:  # only texts that have spans travel to them
        apart = texts.join(ids, "doc_id", "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
        both = texts.join(ids, "doc_id", "left_semi").join(spans, "doc_id").select("doc_id", "text", "spans").union(apart)
    else:
        both = texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_cut(size), "doc_id long, n_words long, n_removed long, kept_sha256 string")
