"""Earlier variants of retrieval, calibration and decision that the reference still ships."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..runtime import cut
from .retrieval import asked_once, first_of_each, for_all, holders, merged, spread


def containment_seeds(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, id): labels that hold a query word of three letters or more as a part of a word."""
    q = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "\\s+"), lambda w: F.length(w) > 2))).alias("k"))
    words = nodes.select("id", F.explode(F.array_distinct(F.split(F.lower("label"), "\\s+"))).alias("lw"))
    return q.join(holders(q, words), "k").join(words, "lw").select("query_id", "id").distinct()


def hop_scored_search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int = 2, top_k: int = 30) -> DataFrame:
    """Graph search scored 1 - 0.3 per hop + 0.1 per common word, not below 0.

    Equal texts are searched for once, and of nodes with equal label the first top_k by id are seeds.
    """
    queries, asked = asked_once(queries, "text")
    found = spread(edges, containment_seeds(queries, first_of_each(nodes, ["label"], top_k)), max_hops, top_k)
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "\\s+"), lambda w: w != ""))
    r = found.join(queries.select("query_id", F.filter(words("text"), lambda w: F.length(w) > 2).alias("qw")), "query_id").join(nodes.select("id", "label", words("label").alias("lw")), "id")
    r = r.withColumn("overlap", F.size(F.array_intersect("qw", "lw"))).withColumn("raw_score", F.round(F.greatest(1.0 - F.col("hop") * 0.3 + F.col("overlap") * 0.1, F.lit(0.0)), 4))
    w = Window.partitionBy("query_id").orderBy("hop", F.desc("overlap"), "label", "id")
    return for_all(r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k), asked).select("query_id", "id", "hop", "overlap", "raw_score", "rank")


def voted_community_search(vector: DataFrame, nodes: DataFrame, rollup: DataFrame, top: int = 3, members: int = 10) -> DataFrame:
    """First members of the community that most of a query's first hits lie in (the earliest on ties), 0.6 or 0.4 each."""
    hits = vector.where(F.col("rank") <= top).join(nodes.select("id", "community"), "id").where("community is not null")
    votes = hits.groupBy("query_id", "community").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    best = votes.groupBy("query_id").agg(F.max_by("community", F.struct("n", -F.col("first"))).alias("community"))
    m = rollup.select("community", "is_multi_category", F.posexplode("node_ids").alias("at", "id")).where(F.col("at") < members)
    return best.join(m, "community").select("query_id", "id", "community", F.when(F.col("is_multi_category"), 0.6).otherwise(0.4).alias("raw_score"), (F.col("at") + 1).alias("rank"))


def two_path_fusion(vector: DataFrame, graph: DataFrame, top_k: int = 10) -> DataFrame:
    """Vector score, + 0.5 if the graph found it too, 0.3 if only the graph did."""
    none = graph.limit(0)
    m = merged(*[cut(p.select("query_id", "id", F.col("raw_score").alias("norm_score"), "rank")) for p in (vector, graph, none)])
    source = F.when(F.size("found_by") == 2, "both").otherwise(F.col("source"))
    score = F.when(F.size("found_by") == 2, F.col("v") + 0.5).when(F.col("v").isNotNull(), F.col("v")).otherwise(F.lit(0.3))
    return _ranked(m.withColumns({"score": score, "source": source}), top_k)


def three_path_fusion(vector: DataFrame, graph: DataFrame, community: DataFrame, top_k: int = 10) -> DataFrame:
    """Vector base, + 0.5 for the graph, + 0.3 for the community (0.8 after both, 0.2 after the graph alone)."""
    m = merged(*[cut(p.select("query_id", "id", F.col("raw_score").alias("norm_score"), "rank")) for p in (vector, graph, community)])
    base = F.when(F.col("v").isNotNull(), F.col("v") + F.when(F.col("g").isNotNull(), 0.5).otherwise(0.0)).when(F.col("g").isNotNull(), F.lit(0.3)).otherwise(F.col("c"))
    plus = F.when(F.col("c").isNull(), 0.0).when(F.col("v").isNotNull() & F.col("g").isNotNull(), 0.8).when(F.col("v").isNotNull(), 0.3).when(F.col("g").isNotNull(), 0.2).otherwise(0.0)
    return _ranked(m.withColumn("score", base + plus), top_k)


def _ranked(rows: DataFrame, top_k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord", "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("query_id", "id", "score", "source", "found_by", "rank")


def calibrate(candidates: DataFrame, three_paths: bool = True) -> DataFrame:
    f = S.three_path_calibrated if three_paths else S.two_path_calibrated
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "was")
    return candidates.withColumns({"was": F.col("rank"), "score": F.round(f(F.col("score"), F.col("source")), 4)}).withColumn("rank", F.row_number().over(w)).drop("was")


def expand(candidates: DataFrame, nodes: DataFrame, most: int = 10, score: float = 0.15) -> DataFrame:
    """candidates and up to ``most`` unseen members of each community they touch (by id, else by label).

    Members are ranked once for each community; a query that has n candidates there needs the first most + n of them.
    """
    by_label = nodes.where("community is not null").groupBy(F.lower("label").alias("low")).agg(F.max_by("community", "ord").alias("c2"))
    c = candidates.join(nodes.select("id", "label", "community"), "id", "left").join(by_label, F.lower("label") == F.col("low"), "left").withColumn("community", F.coalesce("community", "c2"))
    touched = cut(c.where("community is not null").groupBy("query_id", "community").agg((F.count("*") + most).alias("n")))
    deepest = touched.agg(F.max("n")).first()[0] or 0
    order = F.row_number().over(Window.partitionBy("community").orderBy(F.col("file_type") != "concept", "label", "id"))
    members = nodes.where("community is not null").select("id", "community", order.alias("at")).where(F.col("at") <= deepest)
    near = touched.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).join(members, ["community", "at"])
    fresh = near.join(candidates.select("query_id", "id"), ["query_id", "id"], "left_anti")
    w = Window.partitionBy("query_id", "community").orderBy("at")
    new = fresh.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("query_id", "id", F.lit(score).alias("score"), F.lit("community").alias("source"))
    both = candidates.select("query_id", "id", "score", "source").union(new)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def expand_ranked(fused: DataFrame, nodes: DataFrame, most: int = 10, score: float = 0.15) -> DataFrame:
    """``expand`` for a graph's nodes, which need not say what kind of file they come from."""
    kind = F.col("file_type") if "file_type" in nodes.columns else F.lit("document")
    return expand(fused, nodes.withColumn("file_type", kind), most, score)


def tagged(candidates: DataFrame, three_paths: bool = True) -> DataFrame:
    """candidates with effective confidence and tag; is_multi_category may be a string or a boolean."""
    multi = F.lower(F.col("is_multi_category").cast("string")) == "true"
    eff = S.effective_confidence(F.col("score"), F.col("source"), multi) if three_paths else F.col("score")
    tag = S.tag(eff, 0.75, 0.55) if three_paths else S.two_path_tag(F.col("score"), F.col("source"))
    return candidates.withColumns({"effective_confidence": eff, "tag": tag})


def overall(tagged: DataFrame, skip: bool = False) -> DataFrame:
    """(query_id, mode, question): the first candidate's tag, and what to ask where it is AMBIGUOUS and not skipped."""
    g = tagged.groupBy("query_id").agg(F.min_by("tag", "rank").alias("mode"), F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("l"))
    ask = F.concat(F.lit("Could you describe the problem further? Is it related to: "), F.array_join(F.transform(F.slice("l", 1, 3), lambda x: x["label"]), ", "), F.lit("?"))
    return g.select("query_id", "mode", F.when((F.col("mode") == "AMBIGUOUS") & (not skip), ask).alias("question"))


def reasoning_paths(queries: DataFrame, tagged: DataFrame, hierarchy: DataFrame, children: DataFrame, most: int = 5) -> DataFrame:
    """Paths of the first tagged candidates: place, matched and unconfirmed symptoms, steps, chain."""
    w = Window.partitionBy("query_id").orderBy("rank")
    top = tagged.where("tag in ('EXTRACTED', 'INFERRED')").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: F.length(x) > 2)
    r = top.join(hierarchy, "id", "left").join(children.withColumnRenamed("id", "subcategory_id"), "subcategory_id", "left").join(queries.select("query_id", words("text").alias("qw")), "query_id")
    match = F.filter("symptoms", lambda x: F.arrays_overlap(F.col("qw"), words(x)))
    return r.select("query_id", "id", "tag", "category", "subcategory", "chain", match.alias("matched_symptoms"), F.array_except("symptoms", match).alias("unconfirmed_symptoms"), "steps", "rn")


def answers(overall: DataFrame, paths: DataFrame, skip: bool = False) -> DataFrame:
    """(query_id, kind, text): a final or intermediate answer, a question, or that nothing matches."""
    first = paths.where("rn = 1")
    r = overall.join(first, "query_id", "left")
    open_ = F.coalesce(F.size("unconfirmed_symptoms"), F.lit(0)) > 0
    kind = F.when(F.col("mode") == "EXTRACTED", "final").when((F.col("mode") == "INFERRED") & open_, "intermediate").when(F.col("mode") == "INFERRED", "final").when(F.lit(skip), "no_match").otherwise("question")
    chain = F.array_join(F.coalesce("chain", F.array().cast("array<string>")), ". ")
    text = F.when(kind == "final", F.concat_ws("\n", chain, F.array_join("steps", "\n"))).when(kind == "intermediate", F.concat(chain, F.lit("\nDo you also notice: "), F.array_join("unconfirmed_symptoms", ", "), F.lit("?"))).when(kind == "no_match", "No fault in the graph matches the description.").otherwise(F.col("question"))
    return r.select("query_id", kind.alias("kind"), text.alias("text"))


def labelled(candidates: DataFrame) -> DataFrame:
    """candidates with a label each: their own, else what follows the colon of their id, else an empty one."""
    return candidates.withColumn("label", F.coalesce("label", F.get(F.split("id", ":"), F.lit(1)), F.lit("")))


def sensor_summary(confidence, critical, warning, normal):
    """One line on a sensor analysis: its confidence and how many sensors there are of each status; a null confidence is none."""
    part = lambda c, name: F.when(F.size(c) > 0, F.concat(F.size(c).cast("string"), F.lit(f" {name}")))
    parts = F.concat_ws(", ", part(critical, "critical"), part(warning, "warning"), part(normal, "normal"))
    shown = F.when(parts == "", "No sensor readings").otherwise(parts)
    return F.when(confidence.isNull(), "No sensor data available").otherwise(F.concat(F.lit("Sensor Analysis ("), F.format_string("%.0f", confidence * 100), F.lit("% confidence): "), shown))


def brief(mode, system, subsystem):
    """One line on a three-mode decision."""
    place = F.concat(F.coalesce(system, F.lit("Unknown")), F.lit(" > "), F.coalesce(subsystem, F.lit("Unknown")))
    return F.when(mode == "AMBIGUOUS", "Need more information — please provide additional symptoms.").when(mode == "INFERRED", F.concat(F.lit("Best guess: "), place, F.lit(" (needs confirmation)"))).otherwise(F.concat(F.lit("Diagnosed: "), place))


def known_systems(candidates: DataFrame) -> DataFrame:
    """candidates with system (category, or Unknown) and subsystem (subcategory, or the label)."""
    text = lambda c: F.when(F.trim(c) != "", F.col(c))
    return candidates.withColumns({"system": F.coalesce(text("category"), F.lit("Unknown")), "subsystem": F.coalesce(text("subcategory"), F.col("label"))})


def adapted_evidence(fused: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, sensor_status, kg_status): confirmed by any sensor confidence above 0.5, by a top score of 0.7."""
    s = results.groupBy("query_id").agg(F.when(F.bool_or(F.col("sensor_confidence") > 0.5), "CONFIRMS").otherwise("CONTRADICTS").alias("sensor_status"))
    k = fused.groupBy("query_id").agg(F.max_by("final_score", -F.col("ord")).alias("t"))
    status = F.when(F.col("t") >= 0.7, "CONFIRMS").when(F.col("t") < 0.3, "CONTRADICTS").otherwise("INCONCLUSIVE")
    return k.join(s, "query_id", "left").select("query_id", F.coalesce("sensor_status", F.lit("NOT AVAILABLE")).alias("sensor_status"), status.alias("kg_status"))


def reasoned(fused: DataFrame, evidence: DataFrame, symptoms: DataFrame) -> DataFrame:
    """(query_id, evidence_quality, mode, confidence, confirmed, contradicted, remaining).

    fused has query_id, ord, final_score and system; symptoms n_matched and n_missing.
    """
    rows = F.array_sort(F.collect_list(F.struct("ord", "final_score", "system")))
    g = fused.groupBy("query_id").agg(rows.alias("r")).join(evidence, "query_id").join(symptoms, "query_id")
    score = F.get("r", F.lit(0))["final_score"]
    strong = F.size(F.filter("r", lambda x: x["final_score"] >= 0.6))
    q = S.evidence_quality(F.size("r"), F.col("n_matched"), F.col("n_missing"), score, strong, F.col("sensor_status"), F.col("kg_status"))
    g = g.withColumn("evidence_quality", q)
    pick = lambda f: F.transform(F.filter("r", f), lambda x: x["system"])
    return g.select("query_id", "evidence_quality", S.evidence_mode(F.size("r"), F.col("evidence_quality"), F.col("sensor_status")).alias("mode"), S.internal_confidence(score, F.col("evidence_quality"), F.col("sensor_status")).alias("confidence"), pick(lambda x: x["final_score"] >= 0.6).alias("confirmed"), pick(lambda x: x["final_score"] < 0.3).alias("contradicted"), pick(lambda x: (x["final_score"] >= 0.3) & (x["final_score"] < 0.6)).alias("remaining"))
