"""Writers of tables, JSON artefacts and text reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph

STATS = ["count", "mean", "std", "variance", "min", "max", "median", "q1", "q3", "iqr", "skewness", "kurtosis"]


def parquet(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def csv(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).csv(path, header=True)


def text_file(lines: DataFrame, path: str) -> None:
    """One file at exactly ``path``, in whatever store that is, from a column ``value`` (and ``ord``, by which lines are sorted)."""
    spark = lines.sparkSession
    one = lines.repartition(1)
    if "ord" in lines.columns:
        one = one.sortWithinPartitions("ord")
    part = f"{path}.{uuid.uuid4().hex}"
    one.select(F.col("value").cast("string").alias("value")).write.text(part)
    jvm = spark.sparkContext._jvm
    here, there = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [f.getPath() for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{part}/part-*"))]
    fs.mkdirs(there.getParent())
    fs.delete(there, False)
    if files:
        fs.rename(files[0], there)
    else:
        fs.create(there).close()
    fs.delete(here, True)


def profile_json(profiles: DataFrame) -> DataFrame:
    """(speed, condition, json): a map from sensor to its statistics, 6 dp."""
    cells = F.struct(*[F.col(c) if c == "count" else F.round(c, 6).alias(c) for c in STATS])
    return profiles.groupBy("speed", "condition").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sensor", cells.alias("p")))))).alias("json"))


def mapping_json(mapping: DataFrame, top_k: int = 10, p_value: float = 0.05, effect: float = 0.8) -> DataFrame:
    """(json): fault to speed to its sensors in rank order."""
    sensors = F.transform(F.array_sort(F.collect_list(F.struct("rank", "sensor", "importance_score", "effect_size", "percent_change", "p_value"))), lambda s: s.dropFields("rank"))
    rule = F.struct(F.lit(top_k).alias("top_k_requested"), F.lit(p_value).alias("p_value_threshold"), F.lit(effect).alias("effect_size_threshold"))
    by_speed = mapping.groupBy("fault", "speed").agg(sensors.alias("sensors"))
    entry = F.struct(F.col("speed").cast("string").alias("s"), F.struct("speed", "fault", F.size("sensors").alias("top_k"), rule.alias("selection"), "sensors").alias("e"))
    by_fault = by_speed.groupBy("fault").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    return by_fault.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("fault", "m")))).alias("json"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(json): one node-link document; meant for a curated graph, which is one object by its format."""
    n = nodes.agg(F.collect_list(F.struct(*nodes.columns)).alias("nodes"))
    e = edges.agg(F.collect_list(F.struct(*edges.columns)).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct(F.lit(True).alias("directed"), "nodes", "edges")).alias("json"))


def community_map_json(rollup: DataFrame) -> DataFrame:
    """(json): a map from community to its nodes, categories, flag and size."""
    entry = F.struct(F.col("community").cast("string").alias("k"), F.struct("node_ids", "categories", "is_multi_category", "size").alias("v"))
    return rollup.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))


def analysis_json(nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """(json): the first hubs, edges between communities, and questions on both."""
    label = nodes.select("id", "label")
    hubs = graph.hubs(edges, top).join(label, "id").agg(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("o"), "id", "label", "degree"))).alias("h"))
    far = graph.bridges(nodes, edges).orderBy("source", "target").limit(top).agg(F.array_sort(F.collect_list(F.struct("source", "target", "relation"))).alias("b"))
    asked = graph.questions(nodes, edges, top).agg(F.array_sort(F.collect_list("question")).alias("q"))
    row = hubs.crossJoin(far).crossJoin(asked)  # one row each
    return row.select(F.to_json(F.struct(F.transform("h", lambda x: x.dropFields("o")).alias("god_nodes"), F.col("b").alias("surprising_connections"), F.col("q").alias("suggested_questions"))).alias("json"))


def graph_artefacts(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """extraction.json (nodes and edges as built), graph.json, community_map.json and analysis.json of a curated graph."""
    for name, df in (("extraction", graph_json(nodes.drop("community"), edges)), ("graph", graph_json(nodes, edges)), ("community_map", community_map_json(graph.community_rollup(nodes))), ("analysis", analysis_json(nodes, edges))):
        text_file(df.select(F.col("json").alias("value")), f"{folder}/{name}.json")


def report_text(report: DataFrame) -> DataFrame:
    """Five lines from a dataset report."""
    lines = [("Rows", "n_rows"), ("Columns", "n_columns"), ("Missing Values", "missing"), ("Duplicate Rows", "duplicates"), ("Numeric Columns", "numeric")]
    return report.select(F.concat_ws("\n", *[F.format_string("%-19s: %s", F.lit(k), F.col(c)) for k, c in lines]).alias("value"))


def community_report(communities: DataFrame, top: int = 20) -> DataFrame:
    """Markdown of the largest communities."""
    first = communities.orderBy(F.desc("size"), "community").limit(top)
    line = F.format_string("## Community %s\n- nodes: %s\n- categories: %s", F.col("community"), F.col("size"), F.array_join(F.array_sort("categories"), ", "))
    return first.select("community", line.alias("value"))


def corpus_markdown(records: DataFrame) -> DataFrame:
    """(category, value): one markdown document a category, symptoms once each in order of first mention, numbered steps."""
    bullets = F.transform(F.array_distinct("symptoms"), lambda s: F.concat(F.lit("- "), s))
    links = F.transform(F.array_distinct("symptoms"), lambda s: F.concat(s, F.lit(" is a symptom of "), F.col("subcategory"), F.lit(".")))
    steps = F.transform("diagnosis_steps", lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), d["step"], F.lit(" ("), F.array_join(d["result"], " / "), F.lit(")")))
    part = F.concat(F.lit("## "), F.col("subcategory"), F.lit("\n"), F.array_join(F.concat(bullets, steps, links), "\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("p")))), lambda x: x["p"])
    return records.groupBy("category").agg(F.concat(F.lit("# "), F.first("category"), F.lit("\n\n"), F.array_join(parts, "\n\n")).alias("value"))


def report_json(reports: DataFrame) -> DataFrame:
    """(query_id, json) of a report's public part."""
    keep = [c for c in ("query_text", "mode", "mode_description", "confidence", "summary", "diagnosis_summary", "inspection_steps", "context_chain", "display_candidates", "reasoning_chain", "sensor_evidence", "assisted_text") if c in reports.columns]
    return reports.select("query_id", F.to_json(F.struct(*keep)).alias("json"))


def display_graph(nodes: DataFrame, edges: DataFrame, palette: int = 17) -> tuple[DataFrame, DataFrame]:
    """What a drawing needs: colour slot by community, size by type, a label of 30 letters; edges by relation."""
    size = F.when(F.col("node_type") == "Category", 30).when(F.col("node_type") == "Subcategory", 20).when(F.col("node_type") == "Symptom", 12).otherwise(8)
    return nodes.select("id", F.pmod("community", F.lit(palette)).alias("color"), size.alias("size"), F.substring("label", 1, 30).alias("short_label")), edges.select("source", "target", "relation", "weight")
