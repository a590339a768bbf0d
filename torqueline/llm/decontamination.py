"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

Terms are indexed where a test phrase needs them: of each benchmark window the two terms
that are rarest in the corpus (counted over all documents) have their postings stored,
one list a term, a posting being document, term and position.  The lists of such a pair
are intersected by document and by place, cut into stretches of a window's length so that
no document gives more than a window's worth of partners to a posting.  Two postings at
the window's own offsets propose an exact place, which the whole phrase must confirm in
the document; other places inside one window give proximity.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_broadcast, working_tables, write_table

#: Everything but 0-9, a-z and code points above 127 separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(text: Column) -> Column:
    """Words of the A-Z-lowered text, with an empty one before a leading and after a trailing separator."""
    return F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), SEPARATORS)


def benchmark_windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, win, words): windows of ``size`` words; a shorter item is one window, one without words none."""
    words = items.where("item_id is not null").select("item_id", F.array_remove(split_words(F.col("text")), "").alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    windows = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words")).distinct()
    return windows.select("item_id", F.xxhash64("words").alias("win"), "words")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _split(texts: DataFrame, *keep: str) -> DataFrame:
    """keep..., w, lead, n_words of texts: w are the split words, lead is 1 if they begin with an empty one."""
    w = texts.select(*keep, split_words(F.col("text")).alias("w"))
    lead = F.when(F.element_at("w", 1) == "", 1).otherwise(0)
    trail = F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    return w.select(*keep, "w", lead.alias("lead"), (F.size("w") - lead - trail).alias("n_words"))


def versioned(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text): version tells texts under one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_text()).alias("version"), _text().alias("text"))


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(term, k): occurrences of each of ``terms`` over all documents."""
    tokens = docs.select(F.explode_outer(split_words(F.col("text"))).alias("term"))
    return tokens.join(bounded_broadcast(terms, n_terms, 80), "term", "left_semi").groupBy("term").agg(F.count("*").alias("k"))


def postings(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(doc_id, version, term, pos) of ``terms`` in distinct texts; words are numbered from 0.

    A token's row holds no more than its word, so that a large ``terms``, which makes the
    join shuffle, moves each word of the corpus once.
    """
    each = _split(versioned(docs), "doc_id", "version").select("doc_id", "version", "lead", F.posexplode_outer("w").alias("i", "term"))  # outer: else a filter splits each text once more
    found = each.where("term <> ''").join(bounded_broadcast(terms, n_terms, 80), "term", "left_semi")
    return found.select("doc_id", "version", "term", (F.col("i") - F.col("lead")).alias("pos"))


def _anchors(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(item_id, words, term, at, term2, at2): each window with its two rarest terms and their offsets.

    Rarest first, ties by term, then offset; a window of one word has it twice.  A window
    with a term that no document has can't occur and is left out.
    """
    windows = write_table(benchmark_windows(items, size), "windows")
    terms = write_table(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    counts = write_table(term_counts(docs, terms, terms.count()), "counts")
    placed = windows.select("item_id", "win", "words", F.posexplode("words").alias("at", "term")).join(counts, "term", "left")
    rare = placed.groupBy("item_id", "win", "words").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "term", "at"))).alias("r"))
    rare = rare.where("r[0].k > 0").select("item_id", "words", F.col("r")[0].alias("x"), F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0))).alias("y"))
    return write_table(rare.select("item_id", "words", F.col("x.term").alias("term"), F.col("x.at").alias("at"), F.col("y.term").alias("term2"), F.col("y.at").alias("at2")), "anchors")


def _laid(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(doc_id, version, item_id, words, start, fits, near): windows laid on documents by their two terms.

    fits: the terms stand at the window's offsets, so the phrase may be there.  near: the
    span (s, e) of the rarest term and the closest second one where both lie inside the
    window, else null.
    """
    anchors = _anchors(docs, items, size)
    pairs = write_table(anchors.select("term", "term2").distinct().withColumn("pair", F.monotonically_increasing_id()), "pairs")
    n_pairs = pairs.count()
    terms = write_table(pairs.select(F.explode(F.array("term", "term2")).alias("term")).distinct(), "rare")
    index = write_table(postings(docs, terms, terms.count()), "postings")
    first = index.join(bounded_broadcast(pairs, n_pairs, 100), "term").select("doc_id", "version", "pair", "pos", F.explode(F.expr(f"sequence(pos div {size} - 1, pos div {size} + 1)")).alias("cell"))
    second = index.withColumnRenamed("term", "term2").join(bounded_broadcast(pairs, n_pairs, 100), "term2").select(F.col("doc_id").alias("doc2"), F.col("version").alias("v2"), F.col("pair").alias("p2"), F.col("pos").alias("q"), F.expr(f"pos div {size}").alias("cell2"))
    both = first.join(second, F.expr(f"doc_id <=> doc2 and version = v2 and pair = p2 and cell = cell2 and abs(q - pos) < {size}")).select("doc_id", "version", "pair", "pos", "q")
    laid = both.join(bounded_broadcast(anchors.join(pairs, ["term", "term2"]).select("pair", "item_id", "words", "at", "at2"), anchors.count(), 1500), "pair")
    start, n = F.col("pos") - F.col("at"), F.size("words")
    fits = (F.col("q") - F.col("pos") == F.col("at2") - F.col("at")) & (start >= 0)
    inside = (F.col("q") != F.col("pos")) & (F.col("q") >= start) & (F.col("q") < start + n)
    span = F.struct(F.abs(F.col("q") - F.col("pos")).alias("far"), F.least("pos", "q").alias("s"), (F.greatest("pos", "q") + 1).alias("e"))
    laid = laid.select("doc_id", "version", "item_id", "words", start.alias("start"), fits.alias("fits"), F.when(inside, span).alias("near")).where("fits or near is not null")
    return laid.groupBy("doc_id", "version", "item_id", "words", "start").agg(F.max("fits").alias("fits"), F.min("near").alias("near"))


def _located(docs: DataFrame, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows of docs as doc_id, version, n_words, exact and near (arrays of item_id, start, end) and near_items; and the written ``_laid``.

    Only windows that may be there need the document's words, which are compared with the
    phrase by 128 bits of hash, so that a window takes few bytes on its way; of all other
    windows just the items are kept (near_items).
    """
    with working_tables() as kept:
        laid = write_table(_laid(docs, items, size), "laid")
        kept.append(laid)
    fit = F.when(F.col("fits"), F.struct("item_id", "start", F.size("words").alias("n"), F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"), F.col("near.s").alias("s"), F.col("near.e").alias("e")))
    places = write_table(laid.groupBy("doc_id", "version").agg(F.collect_list(fit).alias("found"), F.collect_set(F.when(~F.col("fits"), F.col("item_id"))).alias("near_items")), "places")
    rows, n_fits, n_near = places.agg(F.count("*"), F.coalesce(F.sum(F.size("found")), F.lit(0)), F.coalesce(F.sum(F.size("near_items")), F.lit(0))).first()
    joined = versioned(docs).alias("d").join(bounded_broadcast(places, 1, 80 * rows + 72 * n_fits + 24 * n_near).alias("p"), F.expr("d.doc_id <=> p.doc_id and d.version = p.version"), "left")
    texts = _split(joined.select("d.doc_id", "d.version", "text", "found", "near_items"), "doc_id", "version", "found", "near_items")
    phrase = "slice(w, x.start + lead + 1, x.n)"
    whole = f"x.start + x.n <= n_words and xxhash64({phrase}) = x.h1 and xxhash64(1, {phrase}) = x.h2"
    tested = texts.select("doc_id", "version", "n_words", "near_items", F.expr(f"transform(coalesce(found, array()), x -> named_struct('x', x, 'exact', {whole}))").alias("t"))
    exact = "transform(filter(t, y -> y.exact), y -> named_struct('item_id', y.x.item_id, 'start', y.x.start, 'end', y.x.start + y.x.n))"
    near = "transform(filter(t, y -> not y.exact and y.x.s is not null), y -> named_struct('item_id', y.x.item_id, 'start', y.x.s, 'end', y.x.e))"
    return tested.select("doc_id", "version", "n_words", "near_items", F.expr(exact).alias("exact"), F.expr(near).alias("near")), laid


def matches(docs: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """(doc_id, version, item_id, start, end, kind): distinct places of items in documents, words numbered from 0, end not included.

    An exact row is an occurrence of a window.  A near row spans the rarest term of a
    window and the closest second rarest one where, with the window laid on the first,
    both lie inside it, but the phrase differs.  A window with a term that no document
    has gives no rows.
    """
    found, laid = _located(docs, items, size)
    rows = [found.select("doc_id", "version", F.explode(kind).alias("x"), F.lit(kind).alias("kind")).select("doc_id", "version", "x.item_id", "x.start", "x.end", "kind") for kind in ("exact", "near")]
    apart = laid.where("not fits").select("doc_id", "version", "item_id", F.col("near.s").alias("start"), F.col("near.e").alias("end"), F.lit("near").alias("kind"))
    return rows[0].union(rows[1]).union(apart).distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """Words of documents inside benchmark windows.

    docs has doc_id and text, items item_id and text; other columns aren't looked at.
    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, version,
    one row for each row of docs: n_hit counts words inside any occurrence of a window,
    contaminated is n_hit > 0 and share * n_hit >= n_words, n_near the items of which
    ``matches`` has a row, exact or near.
    A null text has no words; a null doc_id is a document like others; items without id
    or words have no window.  Empty tables give no rows or no hits.
    """
    found, _ = _located(docs, items, size)
    covered = F.expr("aggregate(array_sort(transform(exact, x -> named_struct('s', x.start, 'e', x.end))), named_struct('k', 0L, 'to', -1), (a, x) -> named_struct('k', a.k + greatest(0, x.e - greatest(a.to, x.s)), 'to', greatest(a.to, x.e)), a -> a.k)")
    ids = "array_sort(array_distinct(transform({}, x -> cast(x.item_id as string))))"
    rows = found.select("doc_id", "version", F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"), F.expr(ids.format("exact")).alias("items"), F.expr(f"size(array_union({ids.format('concat(exact, near)')}, transform(coalesce(near_items, array()), x -> cast(x as string))))").cast("long").alias("n_near"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "n_near", "version",
    )


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """Rows of docs that aren't contaminated; all columns stay, whatever their names.

    Repeated rows stay or go together; rows with null text or doc_id are judged like
    others; an empty table stays empty.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows, at = docs.toDF(*names), {c: F.col(n) for c, n in zip(docs.columns, names, strict=True)}
    bad = contamination(docs.select("doc_id", "text"), items, size, share).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("version").alias("bad_text")).distinct()
    bad = write_table(bad, "contaminated")
    same = at["doc_id"].cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.coalesce(at["text"].cast("string"), F.lit(""))) == F.col("bad_text"))
    return rows.join(bounded_broadcast(bad, bad.count(), 48), same, "left_anti").toDF(*docs.columns)
