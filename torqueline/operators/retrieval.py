"""Three retrieval paths and their fusion, for batches of queries.

The graph's labels are the small side everywhere: they are turned into word, stem and
substring keys once, and queries meet them by equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import retrieval_stem, stem_set, tokens
from ..presets import AGREEMENT, DEFAULTS, GENERIC_SEED_WORDS, RETRIEVAL_STEM, SEED_STOP_WORDS, TYPE_PENALTIES, Settings
from ..runtime import cut
from .graph import bfs

PATHS = ("vector", "graph", "community")


def _r4(x):
    """Four decimals, the floating-point noise beyond the tenth taken off first."""
    return F.round(F.round(x, 10), 4)


def _words(df: DataFrame, text: str, out: str = "w") -> DataFrame:
    return df.withColumn(out, F.expr(f"array_distinct({tokens(text)})"))


def _stems(column: str) -> F.Column:
    return F.expr(stem_set(tokens(column), RETRIEVAL_STEM))


def _literal(words: list[str]):
    return F.array(*map(F.lit, words))


def min_max(scored: DataFrame, keys: list[str], column: str = "raw_score") -> DataFrame:
    """norm_score: the score between the least and largest of its keys, 4 dp; 0 where all are equal."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return scored.withColumn("norm_score", _r4((F.col(column) - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))))


def label_overlap(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, id, overlap): common stems of queries (query_id, stems) and labels (id, stems), where there are any."""
    q, n = queries.select("query_id", F.explode("stems").alias("s")), labels.select("id", F.explode("stems").alias("s"))
    return q.join(n, "s").groupBy("query_id", "id").agg(F.count("*").cast("int").alias("overlap"))


def holders(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(k, lw): the words lw that hold k, each of three letters or more, as a part.

    Postings of trigrams: a word has as many rows as letters.  Each k meets the words of its rarest
    trigram alone, and is then looked for in them.
    """
    grams = lambda c: F.explode(F.array_distinct(F.expr(f"transform(sequence(1, length({c}) - 2), i -> substring({c}, i, 3))"))).alias("gram")
    held = words.select("lw").where("length(lw) > 2").distinct().select("lw", grams("lw"))
    count = held.groupBy("gram").agg(F.count("*").alias("n"))
    own = asked.select("k").where("length(k) > 2").distinct().select("k", grams("k")).join(count, "gram", "left")
    rarest = own.groupBy("k").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(held, "gram").where(F.contains("lw", F.col("k"))).select("k", "lw")


def graph_seeds(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, id): nodes whose label shares a stem with the query or holds one of its telling words.

    A telling word (three letters, neither stop word nor generic) holds if it is part of
    a label word, or if a label word starts with the first four letters of its stem; a
    query that has telling words needs one to hold.  Queries left without seeds fall
    back to shared stems that aren't generic (or any, if they have no other).  queries
    has query_id, text and communities (an empty array is no restriction).
    """
    q = _words(queries, "text").withColumn("stems", F.expr(stem_set(tokens("text"), RETRIEVAL_STEM))).where("size(stems) > 0")
    q = q.withColumn("telling", F.array_except(F.filter("w", lambda x: F.length(x) > 2), _literal(SEED_STOP_WORDS + GENERIC_SEED_WORDS)))
    n = nodes.select("id", F.lower(F.coalesce("label", F.lit(""))).alias("label"), "community").withColumns({"w": F.expr(f"array_distinct({tokens('label')})"), "stems": F.expr(stem_set(tokens("label"), RETRIEVAL_STEM))})
    words = n.select("id", F.explode("w").alias("lw"))
    starts = words.select("id", F.explode(F.expr("transform(sequence(1, least(4, length(lw))), k -> left(lw, k))")).alias("k")).distinct()
    asked = q.select("query_id", F.explode("telling").alias("k"))
    inside = asked.join(holders(asked, words), "k").join(words, "lw").select("query_id", "id")
    ahead = asked.select("query_id", F.expr(f"left({retrieval_stem('k')}, 4)").alias("k")).join(starts, "k").select("query_id", "id")
    by_word = inside.union(ahead).distinct()
    by_stem = label_overlap(q, n).select("query_id", "id")
    plain = q.where("size(telling) = 0").select("query_id")
    in_community = lambda df: df.join(q.select("query_id", "communities"), "query_id").join(n.select("id", "community"), "id").where(F.expr("size(communities) = 0 or array_contains(transform(communities, c -> cast(c as string)), cast(community as string))")).select("query_id", "id")
    first = in_community(by_word.union(by_stem.join(plain, "query_id", "left_semi")).distinct())
    first = cut(first)
    left = q.join(first.select("query_id").distinct(), "query_id", "left_anti")
    specific = F.array_except("stems", _literal(GENERIC_SEED_WORDS))
    back = in_community(label_overlap(left.withColumn("stems", F.when(F.size(specific) > 0, specific).otherwise(F.col("stems"))), n).select("query_id", "id"))
    return first.union(back)


def asked_once(queries: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """(queries that differ in ``by``, each under its least query_id; and (query_id, asked) of all)."""
    once = queries.groupBy(*by).agg(F.min("query_id").alias("asked"))
    same = [queries[c].eqNullSafe(once[c]) for c in by]
    return once.withColumnRenamed("asked", "query_id"), queries.join(once, same).select("query_id", "asked")


def for_all(found: DataFrame, asked: DataFrame) -> DataFrame:
    """What was found for queries asked once, for every query that asks the same."""
    return asked.join(found.withColumnRenamed("query_id", "asked"), "asked").drop("asked")


def first_of_each(nodes: DataFrame, by: list[str], k: int, order: str = "id") -> DataFrame:
    """The first k nodes of each combination of ``by``: ranks that know a node by these alone, then by order, take no other."""
    w = Window.partitionBy(*by).orderBy(order)
    return nodes.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= k).drop("_at")


def spread(edges: DataFrame, seeds: DataFrame, max_hops: int, top_k: int) -> DataFrame:
    """``bfs`` from the seeds of queries with fewer than top_k of them; hops come first in ranks, so the others need none."""
    seeds = cut(seeds.distinct())
    short = seeds.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") < top_k).select("query_id")
    full = seeds.join(short, "query_id", "left_anti").select("query_id", "id", F.lit(0).alias("hop"))
    return full.union(bfs(edges, seeds.join(short, "query_id", "left_semi"), max_hops))


def graph_search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, top_k: int = 30, s: Settings = DEFAULTS) -> DataFrame:
    """(query_id, id, hop, overlap, raw_score, rank): seeds and their out-neighbours; near and similar first.

    Equal queries are answered once, and of nodes with equal label and community the first
    top_k by id are seeds; a query that these leave short of top_k has all of its seeds.
    """
    queries, asked = asked_once(queries, "text", "communities")
    found = spread(edges, graph_seeds(queries, first_of_each(nodes, ["label", "community"], top_k)), s.max_hops, top_k)
    q, n = queries.select("query_id", _stems("text").alias("qs")), nodes.select("id", "label", _stems("label").alias("ls"))
    r = found.join(q, "query_id").join(n, "id").withColumn("overlap", F.coalesce(F.size(F.array_intersect("qs", "ls")), F.lit(0))).drop("qs", "ls")
    share = F.least("overlap", F.lit(3)) / 3.0
    raw = F.when(F.col("hop") == 0, 0.35 * share).otherwise(0.20 * F.pow(F.lit(0.5), "hop") * share)
    w = Window.partitionBy("query_id").orderBy("hop", F.desc("overlap"), "label", "id")
    return for_all(r.withColumns({"raw_score": F.round(raw, 4), "rank": F.row_number().over(w)}).where(F.col("rank") <= top_k).drop("label"), asked)


def community_search(queries: DataFrame, nodes: DataFrame, rollup: DataFrame, top: int = 3) -> DataFrame:
    """(query_id, id, community, raw_score, rank): the best labels of each hinted community.

    A query with stems that aren't generic needs one of them in the label.  Equal queries
    are answered once, and of members with equal label only the first ``top`` are ranked.
    """
    queries, asked = asked_once(queries, "text", "communities")
    q = queries.withColumn("stems", _stems("text")).withColumn("special", F.array_except("stems", _literal(GENERIC_SEED_WORDS)))
    members = rollup.select("community", "is_multi_category", F.posexplode("node_ids").alias("member_ord", "id")).join(nodes.where("coalesce(node_type, 'Unknown') not in ('', 'Unknown')").select("id", "label"), "id")
    members = first_of_each(members, ["community", "label"], top, "member_ord").withColumn("ls", _stems("label"))
    rows = q.select("query_id", "stems", "special", F.explode("communities").alias("community")).join(members, "community")
    rows = rows.withColumns({"so": F.size(F.array_intersect("special", "ls")), "to": F.size(F.array_intersect("stems", "ls"))}).where(F.when(F.size("special") > 0, F.col("so") > 0).otherwise(F.col("to") > 0))
    w = Window.partitionBy("query_id", "community").orderBy(F.desc("so"), F.desc("to"), "member_ord")
    best = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    ranked = best.select("query_id", "id", "community", F.round(F.when(F.col("is_multi_category"), 0.45).otherwise(0.30) + F.col("so") * 0.15 + F.col("to") * 0.05, 4).alias("raw_score"), F.row_number().over(Window.partitionBy("query_id").orderBy("community", "rank")).alias("rank"))
    return for_all(ranked, asked)


def merged(vector: DataFrame, graph: DataFrame, community: DataFrame) -> DataFrame:
    """(query_id, id, v, g, c, found_by, source, ord): a full outer merge of normalised path results (query_id, id, norm_score, rank)."""
    parts = [p.select("query_id", "id", F.lit(i).alias("path"), "norm_score", "rank") for i, p in enumerate((vector, graph, community))]
    all_rows = parts[0].union(parts[1]).union(parts[2])
    score = lambda i: F.max(F.when(F.col("path") == i, F.col("norm_score")))
    m = all_rows.groupBy("query_id", "id").agg(score(0).alias("v"), score(1).alias("g"), score(2).alias("c"), F.array_sort(F.collect_set("path")).alias("p"), F.min(F.struct("path", "rank")).alias("ord"))
    found = F.transform("p", lambda i: F.element_at(_literal(list(PATHS)), i + 1))
    source = F.when(F.size("p") == 3, "all").otherwise(F.array_join(found, "+"))
    return m.select("query_id", "id", "v", "g", "c", found.alias("found_by"), source.alias("source"), "ord")


def fused_score(s: Settings = DEFAULTS):
    """Weighted path scores, 4 dp; what the vector path lacks counts its first path's score in its place."""
    first = F.coalesce("v", "g", "c") if s.graph_only_counts_twice else F.col("v")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return _r4(s.vector_weight * zero(first) + s.graph_weight * zero(F.col("g")) + s.community_weight * zero(F.col("c")))


def fused(merged: DataFrame, nodes: DataFrame, hints: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Merged candidates with score after fusion, path agreement, category hint and node type, 4 dp each.

    nodes has id, label, category, node_type; hints query_id and categories.
    """
    r = merged.join(nodes.select("id", "label", "category", "subcategory", "node_type", "community"), "id").join(hints.select("query_id", "categories"), "query_id", "left")
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    r = r.withColumn("score", fused_score(s)).withColumn("score", _r4(F.col("score") * F.coalesce(table(AGREEMENT)[F.col("source")], F.lit(1.0))))
    hit = F.coalesce(F.array_contains(F.transform("categories", lambda c: F.lower(c)), F.lower(F.coalesce("category", F.lit("")))), F.lit(False))
    r = r.withColumn("score", F.when(hit, _r4(F.col("score") * s.category_boost)).otherwise(F.col("score")))
    return r.withColumn("score", _r4(F.col("score") * F.coalesce(table(TYPE_PENALTIES)[F.col("node_type")], F.lit(1.0)))).drop("categories")


def stem_dedup(scored: DataFrame, top_k: int, label: str = "label", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The best candidate of each set of label stems, then the first top_k of each query (column rank)."""
    r = scored.withColumn("_s", F.expr(stem_set(tokens(label), RETRIEVAL_STEM)))
    one = r.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(F.desc("score"), "ord", "id"))).where("rn = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ord", "id"))).where(F.col("rank") <= top_k).drop("rn", "_s")


def source_breakdown(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("query_id", "source").agg(F.count("*").alias("n"))


def hybrid(queries: DataFrame, vector: DataFrame, nodes: DataFrame, edges: DataFrame, rollup: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Ranked candidates of each query by all three paths.

    queries has query_id, text, communities and categories; vector has query_id, id,
    raw_score and rank (see ``functions.similarity``).
    """
    g = graph_search(queries, nodes, edges, s.top_k * 3, s)
    c = community_search(queries, nodes, rollup)
    one = c.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("rank")))
    paths = [cut(min_max(p, ["query_id"])) for p in (vector, g, one.where("rn = 1").drop("rn"))]
    return stem_dedup(fused(merged(*paths), nodes, queries, s), s.top_k)
