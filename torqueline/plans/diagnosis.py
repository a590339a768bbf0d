"""The whole online plan for a batch of queries, and the offline plan for sensors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.similarity import hashed_embedding, multi_query_topk
from ..operators import decision, graph, legacy, preprocess, profiling, retrieval, validation
from ..presets import DEFAULTS, Settings
from ..runtime import cut


@dataclass
class KnowledgeBase:
    """Nodes, edges, community roll-up and node vectors, by one integer id for each node."""

    nodes: DataFrame
    edges: DataFrame
    rollup: DataFrame
    vectors: DataFrame
    encode: Callable[[DataFrame], DataFrame]

    @classmethod
    def from_records(cls, records: DataFrame, communities: DataFrame | None = None, encode: Callable[[DataFrame], DataFrame] | None = None, find: Callable[[DataFrame, DataFrame], DataFrame] = graph.communities) -> KnowledgeBase:
        """Build from fault records; communities (id, community) are detected where none are given.

        find detects them from nodes and edges: by label propagation, or ``modularity.communities``.

        encode adds a column embedding (unit vectors) to a table with a column text;
        without one, texts are hashed.
        """
        encode = encode or hashed
        nodes, edges = graph.build(records)
        nodes, edges = cut(graph.normalized(nodes, records)), cut(edges)
        own = communities if communities is not None else find(nodes, edges)
        nodes = cut(nodes.join(own, "id", "left"))
        return cls(nodes, edges, cut(graph.community_rollup(nodes)), cut(embedded(graph.embedding_text(nodes), encode)), encode)


def hashed(texts: DataFrame) -> DataFrame:
    """texts with embedding: unit vectors of hashed words and letters; a stand-in for an encoder."""
    return texts.withColumn("embedding", F.expr(hashed_embedding("text")))


def embedded(texts: DataFrame, encode: Callable[[DataFrame], DataFrame] = hashed) -> DataFrame:
    """(id, embedding, node_id): unit vectors of texts (node_id, text)."""
    return encode(texts).select(F.xxhash64("node_id").alias("id"), "embedding", "node_id")


def store_vectors(vectors: DataFrame, path: str) -> None:
    """Rebuild a vector store: what was at ``path`` is replaced."""
    vectors.write.mode("overwrite").parquet(path)


def open_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def vector_path(q: DataFrame, kb: KnowledgeBase, k: int) -> DataFrame:
    """(query_id, id, raw_score, rank) over each query's distinct variants."""
    v = q.select("query_id", F.explode(preprocess.distinct_variants("processed", "expanded_queries")).alias("text"))
    v = kb.encode(v).select("query_id", F.xxhash64("query_id", "text").alias("variant_id"), "embedding")
    return multi_query_topk(kb.vectors, v, k).join(kb.vectors.select("id", "node_id"), "id").select("query_id", F.col("node_id").alias("id"), "raw_score", "rank")


def _listed(rows: DataFrame, order: str, *columns: str) -> DataFrame:
    """(query_id, l): each query's rows as an array of structs in order."""
    own = [c for c in columns if c != order]
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *own))), lambda x: x.dropFields("_o")).alias("l"))


def diagnose(queries: DataFrame, kb: KnowledgeBase, mapping: DataFrame | None = None, profiles: DataFrame | None = None, sample: DataFrame | None = None, s: Settings = DEFAULTS, dictionary: DataFrame | None = None, compared: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every stage's table for queries (query_id, text); without a sample there is no sensor evidence.

    sample has speed, sensor and value, and serves all queries.  dictionary (sensor,
    display_name, description, subsystem, units) names sensors in texts; compared holds
    the comparisons whose effect sizes the interpretations quote.  The report has one row
    a query: decision, texts, evidence by displayed fault, context chain and steps.
    """
    spark = queries.sparkSession
    if dictionary is None:
        dictionary = spark.createDataFrame([], "sensor string, display_name string, description string, subsystem string, units string")
    q, strong = preprocess.preprocessed(queries, kb.nodes, kb.edges, s)
    asked = q.select("query_id", F.col("processed").alias("text"), "communities", "categories")
    candidates = cut(retrieval.hybrid(asked, vector_path(q, kb, s.top_k), kb.nodes, kb.edges, kb.rollup, s))
    mapped = cut(decision.map_faults(candidates, s))
    texts = None
    if sample is not None:
        signals = cut(validation.signals(mapping, sample.withColumn("sample_id", F.lit(0)), profiles))
        results = cut(validation.candidate_faults(mapped, validation.fault_results(signals)))
        effects = compared if compared is not None else mapping.select("fault", "speed", "sensor", "effect_size").limit(0)
        texts = validation.interpretations(signals, dictionary, mapping, effects)
    else:
        signals = None
        results = spark.createDataFrame([], "query_id long, fault string, sensor_confidence double, critical array<string>, warning array<string>, normal array<string>")
    fused = cut(decision.fuse_evidence(candidates, mapped, results))
    decided, annotated = map(cut, decision.decide(q, fused, mapped, results, s))
    chain = decision.reasoning_chain(q, candidates, mapped, decided)
    shown = annotated.where("display_rank is not null")
    evidence = decision.sensor_evidence(annotated)
    detail = decision.sensor_detail(evidence, dictionary)
    top = shown.where("display_rank = 1").select("query_id", F.col("label").alias("top_label"), F.col("fault_code").alias("fault"), "category", "subcategory")
    steps = decision.inspection_steps(kb.nodes, kb.edges)
    lists = {
        "display_candidates": _listed(shown, "display_rank", "label", "confidence", "source", "fault_code", "mapping_type", "sensor_status"),
        "sensor_evidence": evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("fault", "status", "critical", "warning", "normal", "sensor_confidence"))).alias("l")),
        "_first": _listed(fused.where("trim(coalesce(label, '')) <> ''"), "ord", "label", "source"),
    }
    report = decided.drop("entities").withColumnRenamed("text", "query_text").join(top, "query_id", "left").join(steps, "subcategory", "left").join(detail, ["query_id", "fault"], "left")
    for name, rows in lists.items():
        report = report.join(rows.withColumnRenamed("l", name), "query_id", "left")
    report = report.join(chain, "query_id", "left")
    words = F.array_join(F.slice(F.filter(F.split("query_text", "\\s+"), lambda w: w != ""), 1, 5), ", ")
    extracted, none = F.col("mode") == "EXTRACTED", F.array().cast("array<string>")
    with_steps = F.coalesce("inspection_steps", none)
    first = F.coalesce(F.col("_first"), F.slice(F.array(F.struct(F.lit("").alias("label"), F.lit("").alias("source"))), 1, 0))
    report = report.withColumns({
        "mode_description": S.mode_text(F.col("mode")),
        "summary": decision.brief_summary(F.col("mode"), F.col("top_label"), F.col("fault")),
        "diagnosis_summary": decision.diagnosis_summary(F.col("mode"), F.col("top_label"), F.col("category"), F.col("subcategory"), words, F.coalesce("detail", F.lit(""))),
        "context_chain": decision.context_chain("category", "subcategory", "top_label", with_steps),
        "inspection_steps": F.when(extracted, with_steps).otherwise(none),
        "assisted_text": F.when(F.col("mode") == "AMBIGUOUS", decision.assisted_text(F.col("query_text"), first)),
    }).drop("_first", "detail")
    return {"preprocessed": q, "entities": strong, "candidates": candidates, "mapped": mapped, "signals": signals, "interpretations": texts, "results": results, "fused": fused, "decided": decided, "annotated": annotated, "report": report}


def three_mode(queries: DataFrame, vector: DataFrame, kb: KnowledgeBase, skip: bool = False) -> dict[str, DataFrame]:
    """The earlier three-mode plan: hop-scored graph search, voted communities, additive fusion, calibration, tags, paths and answers.

    queries has query_id and text, vector query_id, id, raw_score and rank.
    """
    g = cut(legacy.hop_scored_search(queries, kb.nodes, kb.edges))
    c = cut(legacy.voted_community_search(vector, kb.nodes, kb.rollup))
    fused = legacy.calibrate(legacy.expand_ranked(legacy.three_path_fusion(vector, g, c), kb.nodes))
    known = fused.join(kb.nodes.select("id", "label", "community"), "id", "left").join(kb.rollup.select("community", "is_multi_category"), "community", "left")
    tagged = cut(legacy.tagged(legacy.labelled(known)))
    overall = cut(legacy.overall(tagged, skip))
    paths = cut(legacy.reasoning_paths(queries, tagged, graph.hierarchy(kb.nodes, kb.edges), graph.children(kb.nodes, kb.edges)))
    return {"candidates": tagged, "overall": overall, "paths": paths, "answers": legacy.answers(overall, paths, skip)}


def refine(queries: DataFrame, clarification: str) -> DataFrame:
    """The queries with a clarification appended, to be diagnosed again."""
    return queries.withColumn("text", F.concat("text", F.lit(", "), F.lit(clarification)))


def sensor_batch(readings: DataFrame, s: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """Cleaned readings, profiles, comparisons and the fault-to-sensor map from raw readings (speed, condition, row_idx, sensor, value)."""
    keys = ["speed", "condition", "sensor"]
    clean = profiling.cleaned(readings, keys)
    scored = profiling.importance(profiling.comparison(clean))
    return {"clean": clean, "profiles": profiling.profile(clean, keys), "comparisons": scored, "mapping": profiling.select_sensors(scored, s)}


def knowledge_base_from_dump(spark: SparkSession, path: str) -> KnowledgeBase:
    from ..sources.readers import dump_records

    return KnowledgeBase.from_records(dump_records(spark, path))
