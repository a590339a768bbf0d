"""Query preprocessing: vocabulary, typo correction, entities, expansions and hints, for whole batches of queries.

Queries meet labels through exploded words and stems (equality joins); only the
vocabulary, which is the graph's, is ever compared word by word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import indel_ratios
from ..functions.text import alnum_tokens, error_codes, intent, stem_set
from ..presets import CATEGORY_SENSORS, DEFAULTS, ENTITY_WEIGHTS, QUERY_STEM, RELATIONS, SYNONYMS, Settings
from ..runtime import cut


def document_frequency(labels: DataFrame, column: str = "label") -> DataFrame:
    """(word, df): labels that hold each word of three letters or more."""
    words = labels.select(F.explode(F.array_distinct(F.expr(alnum_tokens(column)))).alias("word")).where("length(word) > 2")
    return words.groupBy("word").agg(F.count("*").alias("df"))


def word_labels(labels: DataFrame, column: str = "label") -> DataFrame:
    """(word, labels): the set of labels with each word."""
    return labels.select(F.col(column).alias("l"), F.explode(F.array_distinct(F.expr(alnum_tokens(column)))).alias("word")).where("length(word) > 2").groupBy("word").agg(F.array_sort(F.collect_set("l")).alias("labels"))


def _bigrams(word: str):
    """A word's different pairs of neighbouring letters, with its ends."""
    return F.array_distinct(F.expr(f"transform(sequence(1, length({word}) + 1), i -> substring(concat('^', {word}, '$'), i, 2))"))


def similar_words(words: DataFrame, vocabulary: DataFrame, threshold: float = DEFAULTS.fuzzy_threshold) -> DataFrame:
    """(word, match, ratio): all words of the vocabulary whose Indel ratio with a word reaches the threshold.

    An index of letter pairs.  Of a word with n letters and a match with m, (3 D + n - m) / 2
    of the word's pairs at most are lost, where D, the insertions and deletions, is bounded by
    the threshold.  One more of the word's different pairs must therefore have one of the match's: each
    word meets the vocabulary by that many of its rarest pairs.  Words with fewer pairs
    (of one or two repeated letters, or under a low threshold) meet those of all lengths
    that can reach it.
    """
    far = 1.0 - threshold / 100.0
    share = threshold / (200.0 - threshold)  # the least ratio of lengths
    n = F.col("n")
    least, most = F.ceil(n * share - 1e-9).cast("int"), F.floor(n / share + 1e-9).cast("int")
    lost = F.floor(((3 * far + 1) * n + (3 * far - 1) * (least if 3 * far < 1 else most)) / 2 + 1e-9).cast("int")
    w = words.select("word").where("word <> ''").distinct().withColumns({"n": F.length("word"), "pairs": _bigrams("word")}).withColumns({"least": least, "most": most, "lost": lost})
    v = vocabulary.select(F.col("word").alias("match")).where("match <> ''").distinct().withColumn("m", F.length("match"))
    held = v.select("match", "m", F.explode(_bigrams("match")).alias("pair"))
    count = held.groupBy("pair").agg(F.count("*").alias("k"))
    own = w.where("size(pairs) > lost").select("word", "n", "least", "most", "lost", F.explode("pairs").alias("pair")).join(count, "pair", "left")
    rare = Window.partitionBy("word").orderBy(F.coalesce("k", F.lit(0)), "pair")  # a row a pair of one word
    first = own.withColumn("rn", F.row_number().over(rare)).where("rn <= lost + 1")
    near = first.join(held, "pair").where("m between least and most").select("word", "match").distinct()
    rest = w.where("size(pairs) <= lost").select("word", F.explode(F.sequence("least", "most")).alias("m")).join(v, "m").select("word", "match")
    return near.union(rest).withColumn("ratio", indel_ratios("word", "match")).where(F.col("ratio") >= threshold)


def fuzzy_matches(words: DataFrame, vocabulary: DataFrame, threshold: float = DEFAULTS.fuzzy_threshold) -> DataFrame:
    """(word, match, ratio): the vocabulary's closest word by Indel ratio, if it reaches the threshold; ties by word."""
    best = Window.partitionBy("word").orderBy(F.desc("ratio"), "match")
    return similar_words(words, vocabulary, threshold).withColumn("rn", F.row_number().over(best)).where("rn = 1").select("word", "match", "ratio")


def corrected(queries: DataFrame, vocabulary: DataFrame, threshold: float = DEFAULTS.fuzzy_threshold) -> DataFrame:
    """queries with ``processed``: unknown words of three letters or more replaced by their closest known one."""
    tokens = queries.select("query_id", F.posexplode(F.filter(F.split("text", "\\s+"), lambda w: w != "")).alias("at", "token")).withColumn("word", F.lower(F.regexp_replace("token", "[^a-zA-Z0-9]", "")))
    unknown = tokens.where("length(word) > 2").join(vocabulary.select("word"), "word", "left_anti")
    fixed = tokens.join(fuzzy_matches(unknown, vocabulary, threshold).select("word", "match").join(unknown.select("word").distinct(), "word", "left_semi"), "word", "left")
    row = F.struct("at", F.coalesce("match", "token").alias("t"))
    joined = fixed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), " ").alias("processed"))
    return queries.join(joined, "query_id", "left").withColumn("processed", F.coalesce("processed", F.lit("")))


def analysed(queries: DataFrame) -> DataFrame:
    """queries with intent and error_codes, from the raw text."""
    return queries.withColumns({"intent": F.expr(intent("text")), "error_codes": F.expr(error_codes("text"))})


def synonyms(spark) -> DataFrame:
    return spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(SYNONYMS.items())], "ord int, phrase string, replacement string")


def synonym_variants(queries: DataFrame, column: str = "processed") -> DataFrame:
    """(query_id, variant): rewritings of the lower-cased query by phrases in it that bring stems it doesn't have yet.

    The table of phrases is fixed, so it is tried as a literal in each row.
    """
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(r).alias("r")) for p, r in SYNONYMS.items()])
    q = queries.select("query_id", F.lower(column).alias("q"))
    rows = q.select("query_id", "q", F.explode(F.filter(table, lambda x: F.contains("q", x["p"]))).alias("x")).select("query_id", "q", "x.p", "x.r")
    stems = lambda c: stem_set(f"split({c}, '\\\\s+')", QUERY_STEM)
    rows = rows.withColumn("variant", F.expr("replace(q, p, r)")).where("variant <> q")
    fresh = F.expr(f"not arrays_overlap(array_except({stems('r')}, {stems('p')}), {stems('q')})")
    return rows.where(fresh).select("query_id", "q", "variant").distinct()


def label_variants(queries: DataFrame, labels: DataFrame, column: str = "processed", most: int = 5) -> DataFrame:
    """(query_id, variant): for each query word, the first labels with it that don't hold the whole query."""
    q = queries.select("query_id", F.lower(column).alias("q"))
    words = q.select("query_id", "q", F.explode(F.array_distinct(F.expr(alnum_tokens("q")))).alias("word"))
    rows = words.join(word_labels(labels), "word").select("query_id", "q", F.explode(F.slice("labels", 1, most)).alias("l")).withColumn("variant", F.lower("l"))
    apart = "size(array_except(split(q, '\\\\s+'), split(variant, '\\\\s+'))) > 0 and not contains(variant, q)"
    return rows.where(apart).select("query_id", "variant").distinct()


def entities(texts: DataFrame, nodes: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(query_id, node_id, ..., match_ratio, weighted_score, confidence): scored label matches of texts (query_id, text).

    The last node of a lower-cased label stands for it.  Overlap of stems and words,
    rarer words counting more, times the weight of the node's type; a query's texts
    share their best score for each node.
    """
    labels = nodes.where("label is not null").groupBy(F.lower("label").alias("low")).agg(F.max_by(F.struct("id", "label", "node_type", "category", "subcategory", "community"), "ord").alias("n"))
    labels = labels.withColumns({"lw": F.array_distinct(F.expr(alnum_tokens("low"))), "ls": F.expr(stem_set(f"array_distinct({alnum_tokens('low')})", QUERY_STEM))}).where("size(lw) > 0")
    t = texts.select("query_id", "text").distinct().withColumns({"qw": F.array_distinct(F.expr(alnum_tokens("text"))), "qs": F.expr(stem_set(f"array_distinct({alnum_tokens('text')})", QUERY_STEM))})
    keyed = lambda df, w, st, *keep: df.select(*keep, F.explode(F.array_distinct(F.concat(F.transform(w, lambda x: F.concat(F.lit("w:"), x)), F.transform(st, lambda x: F.concat(F.lit("s:"), x))))).alias("k"))
    hits = keyed(t, "qw", "qs", "query_id", "text").join(keyed(labels, "lw", "ls", "low"), "k").select("query_id", "text", "low", "k")
    df = document_frequency(nodes)
    words = hits.withColumn("word", F.when(F.col("k").startswith("w:"), F.substring("k", 3, 1000))).join(df, "word", "left")
    agg = words.groupBy("query_id", "text", "low").agg(F.count("word").alias("n_words"), F.count_if(F.col("word").isNull()).alias("n_stems"), F.sum(F.when(F.col("word").isNotNull(), 1.0 / F.coalesce("df", F.lit(1)))).alias("idf"))
    both = agg.join(labels.select("low", "n", F.size("lw").alias("n_label")), "low")
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in ENTITY_WEIGHTS.items() for x in kv])[F.col("n.node_type")], F.lit(1.0))
    overlap = 0.6 * F.col("n_stems") / F.col("n_label") + 0.4 * F.col("n_words") / F.col("n_label")
    raw = (0.45 * F.least(F.coalesce("idf", F.lit(0.0)), F.lit(1.5)) + 0.55 * overlap) * weight
    scored = both.withColumn("raw", raw).where(F.least("raw", F.lit(1.0)) >= s.entity_threshold)
    scored = scored.select("query_id", F.col("n.id").alias("node_id"), "n.label", "n.node_type", "n.category", "n.subcategory", "n.community", F.round(F.col("n_words") / F.col("n_label"), 2).alias("match_ratio"), F.round("raw", 3).alias("weighted_score"), F.round(F.least("raw", F.lit(1.0)), 3).alias("confidence"))
    w = Window.partitionBy("query_id", "node_id").orderBy(F.desc("confidence"), F.desc("weighted_score"), F.desc("match_ratio"))
    return scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def strong_entities(found: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Entities above the floor and near the query's best, in order of confidence (column ord)."""
    best = F.max("confidence").over(Window.partitionBy("query_id"))
    kept = found.withColumn("best", best).where((F.col("confidence") >= s.entity_floor) & (F.col("confidence") >= F.col("best") * s.entity_share)).drop("best")
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), F.desc("weighted_score"), "node_id")))


def neighbour_terms(strong: DataFrame, nodes: DataFrame, links: DataFrame, relations: list[str] = RELATIONS, most: int = 20, least: float = 0.70) -> DataFrame:
    """(query_id, label, score): labels around sure entities along the given relations; links has id, other, relation, weight.

    A neighbour lies in a matched community, or is CONNECTED_TO.
    """
    own = strong.where("community is not null").groupBy("query_id").agg(F.collect_set("community").alias("matched"))
    e = strong.where(F.col("confidence") >= least).select("query_id", F.col("node_id").alias("id"), "confidence").join(own, "query_id", "left").join(links, "id")
    n = nodes.select(F.col("id").alias("other"), F.col("label"), F.col("community").alias("nc"))
    near = e.join(n, "other").where(F.coalesce(F.array_contains("matched", F.col("nc")), F.lit(False)) | (F.col("relation") == "CONNECTED_TO")).where(F.col("relation").isin(*relations) | (F.coalesce("relation", F.lit("")) == "")).where("label <> ''")
    top = near.groupBy("query_id", "label").agg(F.max(F.col("confidence") * F.col("weight") * 0.90).alias("score"))
    return top.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "label"))).where(F.col("rn") <= most).drop("rn")


def sibling_terms(strong: DataFrame, nodes: DataFrame, most: int = 5, least: float = 0.70) -> DataFrame:
    """(query_id, label, score): the first subcategories beside a sure entity's own, but not itself."""
    sub = nodes.where("coalesce(category, '') <> '' and coalesce(subcategory, '') <> ''").select(F.lower("category").alias("cat"), "subcategory").distinct()
    pairs = sub.join(sub.select("cat", F.col("subcategory").alias("sibling")), "cat").where("subcategory <> sibling").select(F.lower("subcategory").alias("sub"), "sibling").distinct()
    e = strong.where(F.col("confidence") >= least).select("query_id", "node_id", F.lower("subcategory").alias("sub"), F.lower("label").alias("own"), "confidence").join(pairs, "sub").where("lower(sibling) <> own")
    first = e.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "node_id").orderBy("sibling"))).where(F.col("rn") <= most)
    return first.groupBy("query_id", F.col("sibling").alias("label")).agg(F.max("confidence").alias("score"))


def hints(strong: DataFrame) -> DataFrame:
    """(query_id, communities, categories, node_types, expected_sensors): sorted distinct values of the entities."""
    s = lambda c: F.array_sort(F.collect_set(F.when(F.col(c).cast("string") != "", F.col(c)))).alias
    table = F.create_map(*[x for k, v in CATEGORY_SENSORS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    agg = strong.groupBy("query_id").agg(s("community")("communities"), s("category")("categories"), s("node_type")("node_types"))
    sensors = F.array_sort(F.array_distinct(F.flatten(F.transform("categories", lambda c: F.coalesce(table[c], F.array().cast("array<string>"))))))
    return agg.withColumn("expected_sensors", sensors)


def distinct_variants(processed: str, expanded: str) -> F.Column:
    """The processed query, then its expansions, each text once in this order."""
    return F.array_distinct(F.concat(F.array(processed), F.col(expanded)))


def united(*parts: DataFrame) -> DataFrame:
    """(query_id, texts): all texts of tables (query_id, text), once each and sorted."""
    rows = parts[0].select("query_id", "text")
    for p in parts[1:]:
        rows = rows.union(p.select("query_id", "text"))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_set("text")).alias("texts"))


def preprocessed(queries: DataFrame, nodes: DataFrame, edges: DataFrame, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """One row a query with all that later stages need, and the strong entities.

    queries has query_id and text; nodes carry ord, community, node_type, category.
    """
    from .graph import neighbours

    vocabulary = document_frequency(nodes).select("word")
    q = cut(analysed(corrected(queries, vocabulary, s.fuzzy_threshold)))
    rewritten = cut(synonym_variants(q))
    fresh = rewritten.where("not (size(split(variant, ' ')) > size(split(q, ' ')) and slice(split(variant, ' '), 1, size(split(q, ' '))) = split(q, ' '))")
    texts = q.select("query_id", F.col("processed").alias("text")).union(fresh.select("query_id", F.col("variant").alias("text")))
    strong = cut(strong_entities(entities(texts, nodes, s), s))
    near = cut(neighbour_terms(strong, nodes, neighbours(edges)))
    as_text = lambda df, c: df.select("query_id", F.col(c).alias("text"))
    terms = united(as_text(near, "label"), as_text(sibling_terms(strong, nodes), "label")).withColumnRenamed("texts", "expansion_terms")
    variants = united(as_text(q, "processed"), as_text(rewritten, "variant"), as_text(label_variants(q, nodes), "variant"), as_text(near, "label")).withColumnRenamed("texts", "expanded_queries")
    rows = strong.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id", "label", "node_type", "category", "subcategory", "community", "match_ratio", "weighted_score", "confidence"))), lambda e: e.dropFields("ord")).alias("entities"))
    out = q
    for part in (rows, terms, variants, hints(strong)):
        out = out.join(part, "query_id", "left")
    empty = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("entities", "expansion_terms", "expanded_queries", "communities", "categories", "node_types", "expected_sensors")}
    return cut(out.withColumns(empty)), strong
