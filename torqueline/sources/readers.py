"""Readers of logs, artefacts and text, each as a lazily scanned DataFrame."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "array<struct<category: string, subcategory: string, symptoms: array<string>, diagnosis_steps: array<struct<step: string, result: array<string>>>>>"
NODES = "array<struct<id: string, label: string, norm_label: string, file_type: string, source_file: string, result_a: string, result_b: string, community: int, node_type: string, category: string, subcategory: string>>"
EDGES = "array<struct<source: string, target: string, relation: string, confidence: string, source_file: string, weight: double, label: string>>"
PROFILE = "map<string, struct<count: bigint, mean: double, std: double, variance: double, min: double, max: double, median: double, q1: double, q3: double, iqr: double, skewness: double, kurtosis: double>>"
MAPPING = "map<string, map<string, struct<speed: int, fault: string, top_k: int, sensors: array<struct<sensor: string, importance_score: double, effect_size: double, percent_change: double, p_value: double>>>>>"
COMMUNITIES = "map<string, struct<node_ids: array<string>, categories: array<string>, is_multi_category: boolean, size: int>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One column ``j`` from JSON files read whole (a byte order mark is dropped), with the file's name."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"), F.col("_metadata.file_name").alias("file"))
    return text.select("file", F.from_json("value", schema).alias("j"))


def log_csv(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """One log whose second line holds units: all cells as double (null where they aren't numbers), and the units.

    Of columns that repeat a name the first one counts.  path is one file, as each log
    has units of its own; Spark would rename repeated names, so the header line itself is
    read and columns are taken by place.  A row that is equal to the unit line counts as
    one, so a unit may be a number.
    """
    head = [r.value for r in spark.read.text(path).limit(1).collect()]
    header = next(csv.reader(head), []) if head else []
    raw = spark.read.csv(path, header=True, schema=", ".join(f"c{i} string" for i in range(len(header)))) if header else spark.createDataFrame([], "c0 string")
    at = {c.strip(): i for i, c in reversed(list(enumerate(header)))}
    names = sorted(at, key=at.__getitem__)
    first = raw.first()
    units = {c: first[at[c]] for c in names} if first else {}
    rows = raw.where(~F.struct(*raw.columns).eqNullSafe(F.struct(*[F.lit(x) for x in first]))) if first else raw
    return rows.select(*[F.expr(f"try_cast(c{at[c]} as double)").alias(c) for c in names]), units


def file_name(kind: str, speed: int, condition: str, prefix: str = "") -> str:
    """Name of a condition's artefact: "log", "profile" or "comparison" (against the nominal condition), as the readers parse it."""
    return {"log": f"{prefix}SPEED_{speed}_{condition}.csv", "profile": f"{prefix}SPEED_{speed}_{condition}.json", "comparison": f"{speed}_{condition}_vs_NOMINAL.csv"}[kind]


def table_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV files with a header; types are inferred where no schema is given.  A glob reads many as one table."""
    return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None).withColumn("file", F.col("_metadata.file_name"))


def comparison_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comparison files with the keys of their names, <speed>_<fault>_vs_NOMINAL.csv; another name is an error."""
    rows = table_csv(spark, path)
    key = r"^(\d+)_(.+)_vs_NOMINAL"
    named = F.col("file").rlike(key) | F.raise_error(F.concat(F.lit("not a comparison file: "), F.col("file"))).cast("boolean")
    return rows.where(named).withColumns({"speed": F.regexp_extract("file", key, 1).cast("int"), "fault": F.regexp_extract("file", key, 2)})


def fault_records(spark: SparkSession, path: str) -> DataFrame:
    """Fault records in file order (column ord) from a JSON list."""
    return _json(spark, path, RECORDS).select(F.posexplode("j").alias("ord", "r")).select("ord", "r.*")


def dump_records(spark: SparkSession, path: str) -> DataFrame:
    """Fault records from an indented text dump: ## category, ### subcategory, - SYMPTOM: x, - STEP: x  [a / b].

    A dump is one curated file, read whole: its lines are put in order in one task.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("ord", "line"))
    return spark.sql(r"""
      with l as (
        select ord, trim(line) as line,
          last_value(case when line like '## %' then trim(substring(trim(line), 4)) end) ignore nulls over (order by ord) as category,
          last_value(case when trim(line) like '### %' then ord end) ignore nulls over (order by ord) as head,
          last_value(case when trim(line) like '### %' then trim(substring(trim(line), 5)) end) ignore nulls over (order by ord) as subcategory
        from {lines})
      select head as ord, first(category) as category, first(subcategory) as subcategory,
        transform(array_sort(collect_list(case when line like '- SYMPTOM:%' then struct(ord, trim(substring(line, 11)) as t) end)), x -> x.t) as symptoms,
        transform(array_sort(collect_list(case when line like '- STEP:%' then struct(ord, trim(substring(line, 8)) as t) end)),
          x -> named_struct('step', trim(regexp_replace(x.t, '\\s*\\[[^\\[\\]]*\\]$', '')), 'result', split(regexp_extract(x.t, '\\[([^\\[\\]]*)\\]$', 1), ' / '))) as diagnosis_steps
      from l where head is not null and line like '- %' group by head
    """, lines=lines)


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a node-link JSON file."""
    j = _json(spark, path, f"struct<nodes: {NODES}, edges: {EDGES}>")
    return j.select(F.posexplode("j.nodes").alias("ord", "n")).select("ord", "n.*"), j.select(F.posexplode("j.edges").alias("ord", "e")).select("ord", "e.*")


def communities(spark: SparkSession, path: str) -> DataFrame:
    """(community, node_ids, categories, is_multi_category, size)."""
    return _json(spark, path, COMMUNITIES).select(F.explode("j").alias("community", "c")).select(F.col("community").cast("int").alias("community"), "c.*")


def community_index(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """node to community, community to members, label to community (label and norm_label; the last node wins)."""
    known = nodes.where("community is not null")
    labels = known.select("ord", "community", F.explode(F.array_distinct(F.array(F.lower("label"), F.coalesce("norm_label", F.lower("label"))))).alias("label"))
    return known.select("id", "community"), known.groupBy("community").agg(F.collect_list("id").alias("members")), labels.groupBy("label").agg(F.max_by("community", "ord").alias("community"))


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """(speed, condition, sensor, statistics) from profile files named ...SPEED_<speed>_<condition>.json; no files, no rows."""
    j = _json(spark, path, PROFILE).select("file", F.explode("j").alias("sensor", "p"))
    key = r"SPEED_(\d+)_(.+)\.json$"
    return j.select(F.regexp_extract("file", key, 1).cast("int").alias("speed"), F.regexp_extract("file", key, 2).alias("condition"), "sensor", "p.*")


def sensor_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(fault, speed, rank, sensor, importance_score, effect_size, percent_change, p_value)."""
    j = _json(spark, path, MAPPING).select(F.explode("j").alias("fault", "m")).select("fault", F.explode("m").alias("s", "e"))
    return j.select("fault", F.col("s").cast("int").alias("speed"), F.posexplode("e.sensors").alias("at", "x")).select("fault", "speed", (F.col("at") + 1).alias("rank"), "x.*")


def sensor_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(sensor, display_name, description, quantity, subsystem, units, confidence, note); empty without sensors."""
    entry = "struct<display_name: string, description: string, quantity: string, subsystem: string, units: string, confidence: string, note: string>"
    return _json(spark, path, f"struct<sensors: map<string, {entry}>>").select(F.explode("j.sensors").alias("sensor", "d")).select("sensor", "d.*")


def nominal_sample(profiles: DataFrame, speed: int) -> DataFrame:
    """(sensor, value): the nominal means at a speed."""
    return profiles.where((F.col("speed") == speed) & (F.col("condition") == "NOMINAL")).select("sensor", F.col("mean").alias("value"))


def simulated_sample(readings: DataFrame, seed: int = 0) -> DataFrame:
    """(sensor, value) of one row of readings (row_idx, sensor, value), drawn by a hash of its number."""
    one = readings.select("row_idx").distinct().orderBy(F.xxhash64("row_idx", F.lit(seed))).limit(1)
    return readings.join(one, "row_idx", "left_semi").select("sensor", "value")


def first_sample(rows: DataFrame) -> DataFrame:
    """(sensor, value) of a wide table's first row."""
    names = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]
    return long_form(rows.limit(1), names).select("sensor", "value")


def long_form(rows: DataFrame, sensors: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Wide rows as (keep..., sensor, value): one row for each cell."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in sensors)
    return rows.selectExpr(*keep, f"stack({len(sensors)}, {pairs}) as (sensor, value)")


def queries(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(query_id, text) in order; an empty text is an error."""
    if any(not t or not t.strip() for t in texts):
        raise ValueError("a query has no text")
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
