"""From ranked candidates to faults, fused evidence, confidence, mode and explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.text import clean_category, label_match, label_stems, normalized_label
from .. import texts as TX
from ..presets import ANCHORS, CATEGORY_FAULTS, DEFAULTS, Settings

EMPTY = F.array


def anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, a, f) for i, (a, f) in enumerate(ANCHORS)], "anchor_ord int, anchor string, fault string")


def label_faults(labels: DataFrame, table: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(label, anchor, fault, match): the best anchor of each label, the first on ties; labels meet anchors by stems."""
    def prepared(df, c):
        return df.withColumn("norm", F.expr(normalized_label(c))).withColumn("stems", F.expr(f"array_distinct({label_stems('norm')})"))

    key = F.explode(F.array_distinct(F.concat(F.transform("stems", lambda x: F.concat(F.lit("s:"), x)), F.array(F.concat(F.lit("n:"), "norm"))))).alias("k")
    left = prepared(labels.select("label").distinct(), "label").select("label", "norm", "stems", key)
    right = prepared(table, "anchor").select("anchor_ord", "anchor", "fault", F.col("norm").alias("norm2"), F.col("stems").alias("stems2"), key)
    pairs = left.join(right, "k").dropDuplicates(["label", "anchor_ord"])
    m = pairs.withColumn("match", F.expr(label_match("norm", "stems", "norm2", "stems2"))).where(F.col("match") >= s.match_threshold)
    w = Window.partitionBy("label").orderBy(F.desc("match"), "anchor_ord")
    return m.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("label", "anchor", "fault", "match")


def category_faults(categories: DataFrame) -> DataFrame:
    """(category, fault, base): by exact name, name before the dot, or containment either way, first in table order.

    The table is fixed, so it is searched as a literal in each row.
    """
    table = F.array(*[F.struct(F.lit(k).alias("name"), F.array(*[F.struct(F.lit(f).alias("fault"), F.lit(c).alias("base")) for f, c in v]).cast("array<struct<fault: string, base: double>>").alias("faults")) for k, v in CATEGORY_FAULTS.items()])
    c = categories.select("category").distinct().withColumns({"raw": F.trim(F.coalesce("category", F.lit(""))), "t": table}).withColumn("cut", F.expr(clean_category("raw")))
    low = F.lower("cut")
    hit = F.coalesce(F.get(F.filter("t", lambda x: x["name"] == F.col("raw")), F.lit(0)), F.get(F.filter("t", lambda x: x["name"] == F.col("cut")), F.lit(0)), F.get(F.filter("t", lambda x: F.contains(F.lower(x["name"]), low) | F.contains(low, F.lower(x["name"]))), F.lit(0)))
    return c.select("category", F.explode(hit["faults"]).alias("f")).select("category", "f.*")


def map_faults(candidates: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(query_id, ord, kg_category, label, fault_code, kg_score, source, node_type, mapping_type, mapping_confidence).

    candidates has query_id, rank, label, category, score, source, node_type.  A label's
    anchor goes before its category; each (label, fault) of a query once; ord is the
    order by score.
    """
    by_label = label_faults(candidates, anchors(candidates.sparkSession), s).select("label", F.col("fault").alias("lf"))
    by_cat = category_faults(candidates).groupBy("category").agg(F.collect_list(F.struct("fault", "base")).alias("cf"))
    c = candidates.join(by_label, "label", "left").join(by_cat, "category", "left")
    options = F.when(F.col("lf").isNotNull(), F.array(F.struct(F.col("lf").alias("fault"), F.lit(1.0).alias("base")))).otherwise(F.col("cf"))
    rows = c.select("*", F.posexplode(options).alias("at", "o"))
    bonus = F.when(F.col("score") >= 2.0, 0.05).when(F.col("score") >= 1.5, 0.02).otherwise(0.0)
    rows = rows.select("query_id", "rank", "at", F.col("category").alias("kg_category"), "label", F.col("o.fault").alias("fault_code"), F.col("score").alias("kg_score"), "source", "node_type", F.when(F.col("lf").isNotNull(), "label").otherwise("category").alias("mapping_type"), F.round(F.least(F.col("o.base") + bonus, F.lit(1.0)), 3).alias("mapping_confidence"))
    once = rows.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "label", "fault_code").orderBy("rank", "at"))).where("rn = 1")
    return once.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("kg_score"), "rank", "at"))).drop("rn", "rank", "at")


def fuse_evidence(candidates: DataFrame, mapped: DataFrame, results: DataFrame) -> DataFrame:
    """candidates with kg_score, sensor_score, final_score (3 dp), sensors by status, and ord by final score.

    A candidate takes the best positive sensor confidence among its label's faults;
    the mapping's own confidence stays out, as in the reference (0.20 for all).
    """
    r = mapped.select("query_id", "label", F.col("fault_code").alias("fault"), F.col("ord").alias("mo")).join(results.select("query_id", "fault", "sensor_confidence", "critical", "warning", "normal"), ["query_id", "fault"]).where("sensor_confidence > 0")
    best = r.groupBy("query_id", "label").agg(F.max_by(F.struct("sensor_confidence", "critical", "warning", "normal"), F.struct("sensor_confidence", -F.col("mo"))).alias("s"))
    c = candidates.join(best, ["query_id", "label"], "left")
    conf, kg = F.coalesce("s.sensor_confidence", F.lit(0.0)), S.rescaled(F.col("score"))
    none = EMPTY().cast("array<string>")
    lists = {f"{k}_sensors": F.coalesce(F.col(f"s.{k}"), none) for k in ("critical", "warning", "normal")}
    c = c.withColumns({"kg_score": F.round(kg, 3), "sensor_score": F.round(conf, 3), "final_score": F.round(0.45 * kg + 0.20 + 0.35 * conf, 3)} | lists)
    total = F.greatest(F.size("critical_sensors") + F.size("warning_sensors") + F.size("normal_sensors"), F.lit(1))
    c = c.withColumns({"critical_score": F.round(F.size("critical_sensors") / total, 3), "warning_score": F.round(F.size("warning_sensors") / total, 3)})
    return c.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), "rank"))).drop("s")


def decide(queries: DataFrame, fused: DataFrame, mapped: DataFrame, results: DataFrame, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """One row of confidence components and mode a query, and its annotated candidates with display rank.

    queries has query_id, text (as typed) and entities (with label); fused, mapped and
    results come from the functions above.  The top fault is the first mapped to the top
    candidate's label; a candidate's own fault is the last mapped to its label.
    """
    named = fused.where("trim(coalesce(label, '')) <> ''")
    tops = named.groupBy("query_id").agg(F.reverse(F.array_sort(F.collect_list("score"))).alias("scores"), F.min_by("label", "ord").alias("top_label"))
    first = mapped.groupBy("query_id", "label").agg(F.min_by("fault_code", "ord").alias("top_fault"), F.max_by(F.struct("fault_code", "mapping_type"), "ord").alias("last"))
    conf = results.select("query_id", "fault", "sensor_confidence")
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    matched = F.array_distinct(F.flatten(F.transform("entities", lambda e: F.filter(F.split(e["label"], "\\s+"), lambda w: w != ""))))
    q = queries.select("query_id", "text", "entities", words.alias("original"), matched.alias("matched")).join(tops, "query_id", "left")
    q = q.join(first.select("query_id", F.col("label").alias("top_label"), "top_fault"), ["query_id", "top_label"], "left").join(conf.withColumnRenamed("fault", "top_fault").withColumnRenamed("sensor_confidence", "top_conf"), ["query_id", "top_fault"], "left")
    scores = F.coalesce("scores", EMPTY().cast("array<double>"))
    q = q.withColumns({"raw_retrieval_score": F.coalesce(F.get(scores, F.lit(0)), F.lit(0.0)), "separation": S.separation(scores), "coverage": S.coverage(F.col("original"), F.col("matched")), "sensor_boost": S.sensor_boost(F.coalesce("top_conf", F.lit(0.0)), s)})
    q = q.withColumn("calibrated_retrieval", S.calibrated(F.col("raw_retrieval_score"), s))
    q = q.withColumn("confidence", S.confidence(F.col("calibrated_retrieval"), F.col("separation"), F.col("coverage"), F.col("sensor_boost"), s)).withColumn("mode", S.mode(F.col("confidence"), s))
    q = q.drop("scores", "original", "matched", "top_label", "top_conf")
    from .validation import contradiction

    status = contradiction(results).select("query_id", F.col("fault").alias("fault_code"), F.col("sensor_confidence").alias("fc"), "sensor_status", "critical", "warning", "normal")
    own = named.join(first.select("query_id", "label", "last.*"), ["query_id", "label"], "left").join(status, ["query_id", "fault_code"], "left").join(q.select("query_id", "mode", "separation", "coverage"), "query_id")
    own = own.withColumn("confidence", S.confidence(S.calibrated(F.col("score"), s), F.col("separation"), F.col("coverage"), S.sensor_boost(F.coalesce("fc", F.lit(0.0)), s), s))
    own = own.withColumns({"fault_code": F.coalesce("fault_code", F.lit("")), "mapping_type": F.coalesce("mapping_type", F.lit("")), "sensor_status": F.coalesce("sensor_status", F.lit("No Evidence")), "sensor_confidence": F.coalesce("fc", F.lit(0.0))}).drop("fc")
    shown = S.in_band(F.col("confidence"), F.col("mode"), s)
    place = F.row_number().over(Window.partitionBy("query_id", shown).orderBy(F.desc("confidence"), "ord"))
    return q, own.withColumn("display_rank", F.when(shown & (place <= 5), place)).drop("mode", "separation", "coverage")


def sensor_evidence(annotated: DataFrame) -> DataFrame:
    """(query_id, fault, status, critical, warning, normal, sensor_confidence): once for each displayed fault."""
    w = Window.partitionBy("query_id", "fault_code").orderBy("display_rank")
    none = EMPTY().cast("array<string>")
    one = annotated.where("display_rank is not null and fault_code <> ''").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return one.select("query_id", F.col("fault_code").alias("fault"), F.col("sensor_status").alias("status"), *[F.coalesce(c, none).alias(c) for c in ("critical", "warning", "normal")], "sensor_confidence")


def mapping_counts(mapped: DataFrame) -> DataFrame:
    """(query_id, n_mapped, n_label, n_category): mapped faults by what they were mapped from."""
    by = lambda k: F.count_if(F.col("mapping_type") == k)
    return mapped.groupBy("query_id").agg(F.count("*").alias("n_mapped"), by("label").alias("n_label"), by("category").alias("n_category"))


def reasoning_chain(queries: DataFrame, candidates: DataFrame, mapped: DataFrame, decided: DataFrame) -> DataFrame:
    """(query_id, reasoning_chain): array of (step, detail, metrics as JSON); a sixth step where the mode is AMBIGUOUS."""
    c = candidates.groupBy("query_id").agg(F.count("*").alias("n_candidates"), F.min_by(F.struct("label", "score", "source"), "rank").alias("top"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "score", "source", "found_by"))), lambda x: x.dropFields("rank")).alias("provenance"))
    m = mapping_counts(mapped).join(mapped.groupBy("query_id").agg(F.min_by(F.struct("label", "fault_code", "mapping_type"), "ord").alias("topm")), "query_id")
    d = decided.drop("entities", "text")
    r = queries.select("query_id", "text", "intent", "entities", "expansion_terms").join(c, "query_id", "left").join(m, "query_id", "left").join(d, "query_id")
    labels = F.transform(F.slice("entities", 1, 5), lambda e: e["label"])
    f3 = lambda x: F.format_string("%.3f", F.col(x))
    js = lambda **k: F.to_json(F.struct(*[v.alias(n) for n, v in k.items()]))
    step = lambda name, detail, metrics: F.struct(F.lit(name).alias("step"), detail.alias("detail"), metrics.alias("metrics"))
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    count = lambda x: F.coalesce(x, F.lit(0)).cast("string")
    base = F.array(
        step("Query Analysis", cat('User query: "', F.col("text"), '". Detected intent: ', F.col("intent"), ". ", F.when(F.size("entities") > 0, cat("KG entities identified: ", F.array_join(labels, ", "), ".")).otherwise(TX.NO_ENTITIES)), js(original_query=F.col("text"), intent=F.col("intent"), entity_count=F.size("entities"), entity_labels=labels)),
        step("Knowledge Graph Retrieval", cat("Retrieved ", count("n_candidates"), " candidate(s). ", F.when(F.col("n_candidates") > 0, cat('Top: "', F.col("top.label"), '" (score: ', f3("top.score"), ", source: ", F.col("top.source"), ").")).otherwise("No candidates found.")), js(candidate_count=F.coalesce("n_candidates", F.lit(0)), top_candidate=F.col("top.label"), top_score=F.col("top.score"), provenance=F.col("provenance"))),
        step("Fault Mapping", F.when(F.col("n_mapped") > 0, cat("Mapped ", count("n_mapped"), " fault(s): ", count("n_label"), " direct label match(es), ", count("n_category"), ' category fallback(s). Top: "', F.col("topm.label"), '" → ', F.col("topm.fault_code"), " (", F.col("topm.mapping_type"), ").")).otherwise(TX.NO_FAULTS), js(mapped_count=F.coalesce("n_mapped", F.lit(0)), label_mapped=F.coalesce("n_label", F.lit(0)), category_mapped=F.coalesce("n_category", F.lit(0)), top_mapping=F.col("topm"))),
        step("Confidence Calculation", cat("Retrieval calibration: ", f3("calibrated_retrieval"), " (raw: ", f3("raw_retrieval_score"), "). Separation: ", f3("separation"), ". Coverage: ", f3("coverage"), ". ", F.when(F.col("sensor_boost") > 0, cat("Sensor boost: +", f3("sensor_boost"), ". ")).otherwise(""), "Final confidence: ", f3("confidence"), "."), js(raw_retrieval_score=F.col("raw_retrieval_score"), calibrated_retrieval=F.col("calibrated_retrieval"), separation=F.col("separation"), coverage=F.col("coverage"), sensor_boost=F.col("sensor_boost"), final_confidence=F.col("confidence"))),
        step("Mode Determination", cat("Confidence ", f3("confidence"), " ", F.when(F.col("mode") == "EXTRACTED", ">= 0.30").otherwise("< 0.30"), " → mode: ", F.col("mode"), "."), js(mode=F.col("mode"), confidence=F.col("confidence"), threshold_applied=F.when(F.col("mode") == "EXTRACTED", ">= 0.30").otherwise("< 0.30"))),
    )
    gap = step("Symptom Gap Analysis", F.when(F.size("entities") == 0, TX.NO_CONCEPTS).otherwise(cat("Identified ", F.size("entities").cast("string"), " KG concept(s), expanded to ", F.size("expansion_terms").cast("string"), TX.MORE_SYMPTOMS)), js(entity_count=F.size("entities"), expansion_count=F.size("expansion_terms")))
    return r.select("query_id", F.when(F.col("mode") == "AMBIGUOUS", F.concat(base, F.array(gap))).otherwise(base).alias("reasoning_chain"))


def context_chain(category: str, subcategory: str, label: str, steps) -> F.Column:
    """Array from category over subcategory to label and inspection steps; empty if fewer than two of the first three are there."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    parts = F.filter(F.array(text(category), F.when(text(subcategory) != text(category), text(subcategory)).otherwise(""), text(label)), lambda x: x != "")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.concat(parts, F.coalesce(steps, F.array().cast("array<string>"))))


def sensor_badge(status):
    """Short text of a sensor status; empty for an unknown one."""
    return F.when(status == "Supported", TX.BADGE_SUPPORTED).when(status == "Contradicted", TX.BADGE_CONTRADICTED).when(status == "No Evidence", TX.BADGE_NONE).otherwise("")


def brief_summary(mode, label, fault):
    return F.concat(F.when(mode == "EXTRACTED", "Diagnosis").when(mode == "AMBIGUOUS", "Insufficient evidence").otherwise(mode), F.lit(": "), F.coalesce(label, F.lit("Unknown")), F.when(F.coalesce(fault, F.lit("")) != "", F.concat(F.lit(" ("), fault, F.lit(")"))).otherwise(""))


def sensor_detail(evidence: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, fault, detail): flagged sensors with names and descriptions, or that all are normal."""
    from .validation import enriched

    rows = evidence.select("query_id", "fault", F.posexplode(F.concat(F.transform("critical", lambda s: F.struct(F.lit("CRITICAL").alias("l"), s.alias("sensor"))), F.transform("warning", lambda s: F.struct(F.lit("WARNING").alias("l"), s.alias("sensor"))))).alias("at", "x")).select("query_id", "fault", "at", "x.*")
    text = F.concat("display_name", F.lit(" ("), "sensor", F.lit("): "), "l", F.when(F.col("description") != "", F.concat(F.lit(" — "), "description")).otherwise(""))
    flagged = enriched(rows, dictionary).groupBy("query_id", "fault").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("t")))), lambda x: x["t"]), "; ").alias("d"))
    return evidence.select("query_id", "fault").join(flagged, ["query_id", "fault"], "left").select("query_id", "fault", F.coalesce("d", F.lit(TX.ALL_NORMAL)).alias("detail"))


def diagnosis_summary(mode, label, category, subcategory, symptoms, detail):
    """Paragraphs on an extracted diagnosis; empty for other modes or without a label."""
    parts = F.concat_ws(
        "\n\n",
        F.concat(F.lit("**Diagnosis:** "), label),
        F.when((F.coalesce(category, F.lit("")) != "") & (F.coalesce(subcategory, F.lit("")) != ""), F.concat(F.lit(TX.FALLS_UNDER), subcategory, F.lit("** in the **"), category, F.lit("** system."))),
        F.when(F.coalesce(symptoms, F.lit("")) != "", F.concat(F.lit("The reported symptoms ("), symptoms, F.lit(TX.CONSISTENT))),
        F.when(F.coalesce(detail, F.lit("")) != "", F.concat(F.lit("**Sensor status:** "), detail)),
    )
    return F.when((mode == "EXTRACTED") & (F.coalesce(label, F.lit("")) != ""), parts).otherwise("")


DISCLAIMER = TX.DISCLAIMER


def assisted_text(symptoms, candidates):
    """Guidance from the first three candidates (label, source), or from none, always with the disclaimer."""
    lines = F.array_join(F.transform(F.slice(candidates, 1, 3), lambda c: F.concat(F.lit("- **"), c["label"], F.lit("** — found via "), c["source"], F.lit(" retrieval."))), "\n")
    some = F.concat(F.lit(TX.SUGGESTS), lines, F.lit(TX.CLOSEST))
    none = F.lit(TX.SUGGESTS + TX.NOTHING)
    return F.concat(F.lit('Based on the symptoms "'), symptoms, F.lit('", '), F.when(F.size(candidates) > 0, some).otherwise(none), F.lit("\n\n" + DISCLAIMER))


def inspection_steps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(subcategory, inspection_steps): steps of the first node with each subcategory label, in node order."""
    sub = nodes.where("node_type = 'Subcategory'").groupBy(F.col("label").alias("subcategory")).agg(F.min_by("id", "ord").alias("source"))
    e = edges.where("relation = 'HAS_DIAGNOSIS_STEP'").select("source", "target").distinct()
    n = nodes.select(F.col("id").alias("target"), "label", "ord")
    return sub.join(e, "source").join(n, "target").groupBy("subcategory").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]).alias("inspection_steps"))
