"""MinHash near-duplicate components with tensored banding and exact confirmation.

A table key combines one band of a left collection of minhashes with one band of
a right collection, so ``SIDE * SIDE`` tables need only ``2 * SIDE`` bands.  Two
sets of similarity s share a key unless all left bands or all right bands differ;
at s = 0.8 with bands of two values and SIDE = 10 that is 7e-5, and 6e-7 at 0.9.

Links are confirmed on full sets of 64-bit shingle hashes, which are written once for the
documents that share a bucket.  Inside a bucket no
quadratic list of pairs is made: each member is tried against one hub, the member
that shares most keys in all (of edited copies, that is nearly always their source);
links are contracted to components, and rounds with other hubs follow while they link
much.  Documents that still share buckets across components are then joined exactly by
prefix filtering: of their shingles in one order, rarest first, linked sets must share
one within the first fifth, at places that leave room for enough more.  An edited copy
whose own edits come first thus meets only what shares those, however many copies of
its source there are; members outside a shingle's main component meet all others.
Sketches of 384 one-bit minhashes spare the confirmation of hopeless pairs (more than
MOST_BITS differ; at 0.8 they are 38.4 +- 5.9).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import batch, binary_lists, constants, mix, text_slices, window_hashes, word_hashes
from .runtime import bounded_broadcast, components, working_tables, write_table

#: Bands of each collection, values in a band, minhashes in all (the first 2 * SIDE * BAND also make bands).
SIDE, BAND, HASHES = 10, 2, 384
#: Sketch bits in which a linked pair may differ.
MOST_BITS = 71
_U = np.uint64
_CHUNK = 1 << 16
PAIR = "a long, b long"
BITS = [f"b{i}" for i in range(HASHES // 64)]


def shingle_sets(col: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; empty for a text without words."""
    flat, first = word_hashes(col, lower=True)
    wide = window_hashes(flat, words, 101)
    out = []
    for s, e in zip(first[:-1], first[1:], strict=True):
        if e - s >= words:
            out.append(np.unique(wide[s : e - words + 1]))
        elif e > s:
            out.append(mix(np.array([np.sum(flat[s:e] * constants(103, e - s), dtype=_U) + _U(e - s)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def minhashes(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HASHES minima for each run of ``flat`` that begins at ``starts`` (no run is empty)."""
    seed, odd = constants(7, HASHES), constants(9, HASHES)
    out = np.empty((len(starts), HASHES), _U)
    ends = np.r_[starts[1:], len(flat)]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        part, at = flat[starts[i] : ends[j - 1]], starts[i:j] - starts[i]
        for f in range(HASHES):
            out[i:j, f] = np.minimum.reduceat((part ^ seed[f]) * odd[f], at)
        i = j
    return out


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_slices(b):
                sets = shingle_sets(part.column(1), words)
                n = np.array([len(x) for x in sets], np.int64)
                flat = np.concatenate(sets) if n.sum() else np.zeros(0, _U)
                full = np.flatnonzero(n)
                starts = np.r_[0, np.cumsum(n)][:-1][full]
                sig, f1, f2, bits = np.zeros((len(n), 2 * SIDE * BAND), np.uint32), np.zeros(len(n), _U), np.zeros(len(n), _U), np.zeros((len(n), len(BITS)), _U)
                if len(full):
                    low = minhashes(flat, starts)
                    sig[full] = (low[:, : 2 * SIDE * BAND] >> _U(32)).astype(np.uint32)
                    f1[full] = np.add.reduceat(mix(flat ^ _U(0x51)), starts)
                    f2[full] = np.add.reduceat(mix(flat ^ _U(0xA7)), starts)
                    one = mix(low) & _U(1)
                    place = np.arange(64, dtype=_U)
                    bits[full] = (one.reshape(len(full), len(BITS), 64) << place).sum(2, dtype=_U)
                yield batch(
                    ["doc_id", "n", "f1", "f2", *BITS, "sig"],
                    [part.column(0), n, f1.view(np.int64), f2.view(np.int64), *np.ascontiguousarray(bits.T).view(np.int64), binary_lists(sig.ravel(), np.arange(len(n) + 1) * (2 * SIDE * BAND))],
                )

    return run


def _table_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(part.num_rows, 2, SIDE, BAND).astype(_U)
            band = mix((sig * constants(21, BAND)).sum(3, dtype=_U) + np.arange(2 * SIDE, dtype=_U).reshape(2, SIDE) * _U(0x9E3779B97F4A7C15))
            keys = mix(band[:, 0, :, None] + (band[:, 1, None, :] << _U(1)))
            yield batch(["key", "doc"], [keys.reshape(-1).view(np.int64), np.repeat(part.column(0).to_numpy(zero_copy_only=False), SIDE * SIDE)])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_slices(b):
                sets = shingle_sets(part.column(1), words)
                yield batch(["doc", "shingles"], [part.column(0), pa.array([x.tobytes() for x in sets], pa.binary())])

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
        n = np.array([len(x.as_buffer()) // 8 for x in b.column(1)], np.int64)
        yield batch(["h", "doc"], [flat, np.repeat(b.column(0).to_numpy(zero_copy_only=False), n)])


def _confirm(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            left, right = b.column(2), b.column(3)
            for i in range(b.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), _U), np.frombuffer(right[i].as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = len(x) and 100 * both >= share * (len(x) + len(y) - both)
            yield batch(["a", "b"], [b.column(0), b.column(1)]).filter(pa.array(keep))

    return run


def _may_link(share: int) -> str:
    """Of columns n, b0, ... and n2, other_b0, ...: sizes and sketches allow a link."""
    apart = " + ".join(f"bit_count({b} ^ other_{b})" for b in BITS)
    return f"100 * least(n, n2) >= {share} * greatest(n, n2) and {apart} <= {MOST_BITS}"


def _other(facts: DataFrame, name: str) -> DataFrame:
    return facts.select(F.col("doc").alias(name), F.col("n").alias("n2"), *[F.col(b).alias(f"other_{b}") for b in BITS])


def _prefixes(shingles: DataFrame, sets: DataFrame, n_sets: int, share: int) -> DataFrame:
    """(h, doc, i): of the sets (doc, n), the shingles in which a linked one must show, with their places.

    Shingles are ordered by the sets that hold them, then by hash; those that one set
    alone holds come first and are only counted.
    """
    ids = bounded_broadcast(sets.select("doc"), n_sets, 40)
    each = shingles.join(ids, "doc", "left_semi").select("doc", "shingles").mapInArrow(_shingles, "h long, doc long")
    several = write_table(each.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "several")
    one = sets.groupBy("doc").agg(F.max("n").alias("n"), (F.count("*") > 1).alias("mixed"))  # an id with several texts keeps all places
    held = each.join(several, "h").groupBy("doc").agg(F.collect_list(F.struct("k", "h")).alias("r")).join(bounded_broadcast(one, n_sets, 48), "doc")
    alone = F.when(F.col("mixed"), 0).otherwise(F.col("n") - F.size("r"))
    reach = F.when(F.col("mixed"), F.size("r")).otherwise(F.greatest(F.expr(f"n - ({share} * n + 99) div 100 + 1") - alone, F.lit(0)))
    near = held.select("doc", "mixed", alone.alias("alone"), F.slice(F.array_sort("r"), F.lit(1), reach.cast("int")).alias("r"))
    return near.select("doc", "mixed", "alone", F.posexplode("r").alias("at", "x")).select(F.col("x.h").alias("h"), "doc", F.when(F.col("mixed"), 0).otherwise(F.col("alone") + F.col("at")).alias("i"))


def _confirmed(shingles: DataFrame, pairs: DataFrame, share: int) -> DataFrame:
    """Of ``pairs``, those whose full sets are as similar as asked for."""
    n_pairs = pairs.count()
    need = write_table(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "need", 16 * n_pairs)
    sets = shingles.join(bounded_broadcast(need, need.count(), 40), "doc", "left_semi")
    left, right = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))
    both = left.join(bounded_broadcast(pairs, n_pairs, 40), "a").join(right, "b").select("a", "b", "x", "y")
    return write_table(both.mapInArrow(_confirm(share), PAIR).distinct(), "confirmed", 16 * n_pairs)


def near_duplicates(docs: DataFrame, words: int = 5, share: int = 80) -> DataFrame:
    """Near-duplicate components of documents.

    docs has doc_id (long) and text; other columns are not looked at.  Texts are
    lower-cased (A-Z) and split at ASCII white space; a text's set is its distinct
    shingles of ``words`` words, or its whole word sequence if it has fewer.  Texts
    link if 100 * intersection >= share * union.  Returns doc_id, n_shingles,
    component_id (smallest doc_id reachable), kept (doc_id = component_id), one row
    for each input row.

    Null or empty texts have no set and link with nothing.  A row without doc_id
    keeps its size, gets no component and is kept; it isn't compared.  Rows that
    repeat a doc_id are one node with several sets: all get its component.  An
    empty table gives an empty result.
    """
    with working_tables() as kept:
        return _near_duplicates(docs, words, share, kept)


def _near_duplicates(docs: DataFrame, words: int, share: int, kept: list[DataFrame]) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = write_table(docs.mapInArrow(_sketches(words), f"doc_id long, n long, f1 long, f2 long, {', '.join(b + ' long' for b in BITS)}, sig binary"), "sketch")
    full = sketch.where("n > 0 and doc_id is not null")
    reps = write_table(full.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("doc"), *[F.first(b).alias(b) for b in BITS], F.first("sig").alias("sig")), "classes")
    n_reps = reps.count()
    facts = bounded_broadcast(reps.select("doc", "n", *BITS), n_reps, 120)

    keys = reps.select("doc", "sig").mapInArrow(_table_keys, "key long, doc long")
    shared = write_table(keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "keys")
    members = write_table(keys.join(bounded_broadcast(shared, shared.count(), 48), "key"), "members")
    n_members = members.count()
    known_by = write_table(members.groupBy("doc").agg(F.sum("k").alias("keys")), "known", 16 * n_reps)
    members = write_table(members.select("key", "doc").join(bounded_broadcast(known_by, known_by.count(), 40), "doc"), "members")

    ours = docs.select(F.col("doc_id").alias("doc"), "text").join(bounded_broadcast(known_by.select("doc"), n_reps, 40), "doc", "left_semi")
    shingles = write_table(ours.select("doc", "text").mapInArrow(_sets(words), "doc long, shingles binary"), "sets")

    def likely(pairs: DataFrame) -> DataFrame:
        return pairs.join(facts.withColumnRenamed("doc", "a"), "a").join(_other(facts, "b"), "b").where(_may_link(share)).select("a", "b").distinct()

    hubs = members.groupBy("key").agg(F.max_by("doc", F.struct("keys", -F.col("doc"))).alias("a"))
    tried = write_table(likely(members.join(hubs, "key").where("a <> doc").select(F.least("a", "doc").alias("a"), F.greatest("a", "doc").alias("b")).distinct()), "pairs", 16 * n_members)
    links = _confirmed(shingles, tried, share)
    total = links.count()
    turn = 0
    while True:
        turn += 1
        labels = components(links, total)
        n_labels = labels.count()
        known = members.join(bounded_broadcast(labels.withColumnRenamed("node", "doc"), n_labels, 40), "doc", "left").select("key", "doc", F.coalesce("component_id", "doc").alias("c"))
        mixed = known.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
        open_rows = write_table(known.join(mixed, "key", "left_semi"), "open", 24 * n_members)
        if turn <= 6 and (turn == 1 or grown * 20 > total):
            hub = open_rows.groupBy("key").agg(F.min_by(F.struct("doc", "c"), F.xxhash64("doc", F.lit(turn))).alias("hub"))
            n_open = open_rows.count()
            pairs = open_rows.join(hub, "key").where("hub.doc <> doc and hub.c <> c").select(F.least("hub.doc", "doc").alias("a"), F.greatest("hub.doc", "doc").alias("b")).distinct()
            fresh = write_table(likely(pairs).join(tried, ["a", "b"], "left_anti"), "pairs", 16 * n_open)
            tried = tried.union(fresh)
            more = _confirmed(shingles, fresh, share)
            grown = more.count()
            total += grown
            links = links.union(more)
            continue
        groups = write_table(open_rows.groupBy("doc").agg(F.first("c").alias("c")), "groups", 16 * n_reps)
        n_open = groups.count()
        sets = write_table(facts.join(bounded_broadcast(groups, n_open, 48), "doc"), "open-sets")
        rich = write_table(_prefixes(shingles, sets, n_open, share).join(bounded_broadcast(sets, n_open, 120), "doc"), "prefixes")
        main = rich.groupBy("h", "c").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("c", "k").alias("main"), F.count("*").alias("k")).where("k > 1")
        main = write_table(main.select("h", "main"), "main")  # a plain join after it can split hot shingles
        stray = rich.join(main, "h").where("c <> main").select(F.col("h").alias("h2"), F.col("doc").alias("b"), F.col("c").alias("c2"), F.col("i").alias("i2"), F.col("n").alias("n2"), *[F.col(x).alias(f"other_{x}") for x in BITS])
        room = f"{100 + share} * least(n - i, n2 - i2) >= {share} * (n + n2)"
        pairs = rich.join(write_table(stray, "stray"), F.expr(f"h = h2 and c <> c2 and {room} and {_may_link(share)}")).select(F.least("doc", "b").alias("a"), F.greatest("doc", "b").alias("b")).distinct()
        rest = write_table(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        more = _confirmed(shingles, rest, share)
        if n_more := more.count():
            links, total = links.union(more), total + n_more
        break

    own = sketch.select("doc_id", "n", "f1", "f2").join(reps.select("f1", "f2", "n", F.col("doc").alias("rep")), ["f1", "f2", "n"], "left")
    own = write_table(own.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "own")
    again = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a < hi").select("doc_id", "a")
    same_id = own.join(again, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    labels = components(links.union(same_id), total + own.count())
    kept += [own, labels]
    found = own.join(bounded_broadcast(labels.withColumnRenamed("node", "rep"), labels.count(), 40), "rep", "left")
    out = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, words: int = 5, share: int = 80) -> DataFrame:
    """docs with one document of each near-duplicate component, the smallest doc_id; all columns stay.

    Rows that repeat a kept doc_id are one document: one of them stays (the least text,
    then the least of the other columns as JSON).  Rows without doc_id stay.  Other
    columns may have any type; an empty table stays empty.
    """
    with working_tables() as kept:
        found = write_table(near_duplicates(docs, words, share), "near")
        gone = write_table(found.where("not kept").select("doc_id").distinct(), "gone")
        again = write_table(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"), "again")
        kept += [gone, again]
    left = docs.join(bounded_broadcast(gone, gone.count(), 40), "doc_id", "left_anti").select(*docs.columns)
    n_again = again.count()
    if not n_again:
        return left
    again = bounded_broadcast(again, n_again, 40)
    others = F.struct("text", *[f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")])
    several = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(others, F.struct(F.col("text").cast("string"), F.to_json(others))).alias("row"))
    one = several.select(*[F.col("doc_id") if c == "doc_id" else F.col("row")[c].alias(c) for c in docs.columns])
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one)
