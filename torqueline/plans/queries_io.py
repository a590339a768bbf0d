"""Round trips: each writes an artefact to the shared folder with a sink and reads it back with its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import vector_topk
from ..operators import graph, profiling
from ..runtime import scratch
from ..sources import readers, sinks
from .queries import _LONG, SENSORS, _part_nodes, _vectors, readings
from .queries_graph import _REC, built, records
from .registry import query, rounded, table


def _lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "ord long, value string")


@query("select n_nationkey::double as k, n_regionkey::double as r, (n_nationkey / 4)::double as q from nation")
def log_reader(spark, d):
    """A log with a unit line, a repeated column name (its first column counts) and a cell that is no number."""
    path = scratch(spark, "log")
    rows = table(spark, d, "nation").select((F.col("n_nationkey") + 10).cast("long").alias("ord"), F.concat_ws(",", "n_nationkey", "n_regionkey", F.lit(-1), F.col("n_nationkey") / 4, F.lit("bad")).alias("value"))
    sinks.text_file(_lines(spark, ["k,r,k,q,note", "1,-,1,V,text"]).union(rows), f"{path}/log.csv")
    log, units = readers.log_csv(spark, f"{path}/log.csv")
    if units != {"k": "1", "r": "-", "q": "V", "note": "text"}:
        raise ValueError(f"units: {units}")
    return log.select("k", "r", "q")


@query("select 1000 + n_regionkey * 200 as speed, 'FAULT_' || n_regionkey as fault, count(*) as n, sum(n_nationkey)::double as total from nation group by 1, 2")
def comparison_files(spark, d):
    """One comparison file a (speed, fault), read as one table with the keys of their names."""
    path = scratch(spark, "comparisons")
    n = table(spark, d, "nation")
    for r in range(5):
        own = n.where(F.col("n_regionkey") == r).select((F.col("n_nationkey") + 1).cast("long").alias("ord"), F.concat_ws(",", F.concat(F.lit("s"), "n_nationkey"), "n_nationkey").alias("value"))
        sinks.text_file(_lines(spark, ["sensor,effect_size"]).union(own), f"{path}/{readers.file_name('comparison', 1000 + r * 200, f'FAULT_{r}')}")
    return readers.comparison_csv(spark, f"{path}/*.csv").groupBy("speed", "fault").agg(F.count("*").alias("n"), F.sum("effect_size").cast("double").alias("total"))


@query(f"with {_REC} select ord, category, subcategory, array_to_string(symptoms, ',') as symptoms, steps[1].step || '/' || steps[1].a || '/' || steps[2].step as steps from rec")
def record_files(spark, d):
    """Fault records as a JSON list with a byte order mark."""
    path = scratch(spark, "records")
    r = records(spark, d).agg(F.array_sort(F.collect_list(F.struct("ord", "category", "subcategory", "symptoms", "diagnosis_steps"))).alias("l"))
    sinks.text_file(r.select(F.concat(F.lit("\ufeff"), F.to_json(F.transform("l", lambda x: x.dropFields("ord")))).alias("value")), f"{path}/records.json")
    got = readers.fault_records(spark, f"{path}/records.json")
    s = F.col("diagnosis_steps")
    return got.select("ord", "category", "subcategory", F.array_join("symptoms", ",").alias("symptoms"), F.concat_ws("/", s[0]["step"], s[0]["result"][0], s[1]["step"]).alias("steps"))


@query("select r_name as category, n_name as subcategory, 'noise ' || n_nationkey as symptoms, 'check ' || n_nationkey || ':yes+no' as steps from nation join region on r_regionkey = n_regionkey")
def dump_reader(spark, d):
    """Records from an indented text dump."""
    path = scratch(spark, "dump")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey").cast("string")
    lines = F.array(F.concat(F.lit("## "), "r_name"), F.concat(F.lit("  ### "), "n_name"), F.concat(F.lit("- SYMPTOM: noise "), k), F.concat(F.lit("- STEP: check "), k, F.lit("  [yes / no]")))
    rows = n.select((F.col("n_regionkey") * 1000 + F.col("n_nationkey")).alias("o"), F.posexplode(lines).alias("at", "value")).select((F.col("o") * 10 + F.col("at")).cast("long").alias("ord"), "value")
    sinks.text_file(rows, f"{path}/dump.txt")
    got = readers.dump_records(spark, f"{path}/dump.txt")
    s = F.col("diagnosis_steps")[0]
    return got.select("category", "subcategory", F.array_join("symptoms", ",").alias("symptoms"), F.concat(s["step"], F.lit(":"), F.array_join(s["result"], "+")).alias("steps"))


@query(f"with {_REC} select id, label, node_type, category, subcategory, community from nn")
def graph_files(spark, d):
    """Nodes of graph.json, one of the four artefacts of a graph."""
    path = scratch(spark, "graph")
    _, n, e = built(spark, d)
    sinks.graph_artefacts(n, e, path)
    return readers.graph(spark, f"{path}/graph.json")[0].select("id", "label", "node_type", "category", "subcategory", "community")


@query(f"with {_REC} select source, target, relation, weight from ge")
def extraction_files(spark, d):
    """Edges of extraction.json."""
    path = scratch(spark, "graph")
    _, n, e = built(spark, d)
    sinks.graph_artefacts(n, e, path)
    return readers.graph(spark, f"{path}/extraction.json")[1].select("source", "target", "relation", "weight")


@query("select p_size % 10 as community, count(*)::int as size, count(distinct p_brand) > 1 as is_multi_category, string_agg(distinct p_brand, ',' order by p_brand) as categories from part group by 1")
def community_map_files(spark, d):
    path = scratch(spark, "communities")
    sinks.text_file(sinks.community_map_json(graph.community_rollup(_part_nodes(spark, d))).select(F.col("json").alias("value")), f"{path}/community_map.json")
    return readers.communities(spark, f"{path}/community_map.json").select("community", "size", "is_multi_category", F.array_join("categories", ",").alias("categories"))


_SPEEDS = _LONG.replace("select l_linestatus as speed", "select case when l_linestatus = 'O' then 1000 else 1200 end as speed")


@query(f"with {_SPEEDS} select speed, condition, sensor, count(value) as count, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std, round(quantile_cont(value, 0.5), 4) as median from r group by all")
def profile_files(spark, d):
    """One JSON profile a (speed, condition)."""
    path = scratch(spark, "profiles")
    r = readings(spark, d).withColumn("speed", F.when(F.col("speed") == "O", 1000).otherwise(1200))
    for p in sinks.profile_json(profiling.profile(r, ["speed", "condition", "sensor"])).collect():  # a file for each condition, of which there are few
        sinks.text_file(_lines(spark, [p.json]), f"{path}/{readers.file_name('profile', p.speed, p.condition)}")
    return rounded(readers.profiles(spark, f"{path}/*.json").select("speed", "condition", "sensor", "count", "mean", "std", "median"))


@query("select 'F' || n_regionkey as fault, 1000 + n_nationkey % 2 * 200 as speed, row_number() over (partition by n_regionkey, n_nationkey % 2 order by n_nationkey)::int as rank, 's' || n_nationkey as sensor, n_nationkey / 8 as effect_size from nation")
def mapping_files(spark, d):
    """The nested sensor mapping as one JSON document."""
    from pyspark.sql import Window

    path = scratch(spark, "mapping")
    k = F.col("n_nationkey")
    m = table(spark, d, "nation").select(F.concat(F.lit("F"), "n_regionkey").alias("fault"), (1000 + k % 2 * 200).alias("speed"), k, F.concat(F.lit("s"), k).alias("sensor"), (k / 2).alias("importance_score"), (k / 8).alias("effect_size"), (k / 4).alias("percent_change"), F.lit(0.01).alias("p_value"))
    m = m.withColumn("rank", F.row_number().over(Window.partitionBy("fault", "speed").orderBy("n_nationkey")))
    sinks.text_file(sinks.mapping_json(m).select(F.col("json").alias("value")), f"{path}/mapping.json")
    return readers.sensor_mapping(spark, f"{path}/mapping.json").select("fault", "speed", "rank", "sensor", "effect_size")


@query("select 's' || n_nationkey as sensor, n_name as display_name, 'unit ' || n_regionkey as units, case when n_nationkey % 3 = 0 then '' else 'measures ' || n_nationkey end as description from nation")
def dictionary_files(spark, d):
    path = scratch(spark, "dictionary")
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    entry = F.struct(F.concat(F.lit("s"), k).alias("k"), F.struct(F.col("n_name").alias("display_name"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("measures "), k)).alias("description"), F.concat(F.lit("unit "), "n_regionkey").alias("units")).alias("v"))
    sinks.text_file(n.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("sensors"))).alias("value")), f"{path}/sensors.json")
    return readers.sensor_dictionary(spark, f"{path}/sensors.json").select("sensor", "display_name", "units", "description")


@query(f"with {_SPEEDS} select sensor, round(avg(value), 4) as value from r where speed = 1200 and condition = 'NOMINAL' group by 1")
def nominal_sample(spark, d):
    r = readings(spark, d).withColumn("speed", F.when(F.col("speed") == "O", 1000).otherwise(1200))
    return rounded(readers.nominal_sample(profiling.profile(r, ["speed", "condition", "sensor"], None), 1200))


@query("select sensor, value from (select l_quantity, l_tax from lineitem where l_orderkey = (select min(l_orderkey) from lineitem) order by l_linenumber, l_partkey limit 1) x, lateral (values ('l_quantity', l_quantity::double), ('l_tax', l_tax::double)) s(sensor, value)")
def first_sample(spark, d):
    """The first row of a table, its columns that are numbers."""
    t = table(spark, d, "lineitem")
    one = t.join(t.agg(F.min("l_orderkey").alias("l_orderkey")), "l_orderkey").orderBy("l_linenumber", "l_partkey")
    return readers.first_sample(one.select("l_quantity", "l_tax", "l_shipdate", "l_returnflag"))


@query("select count(*) = 2 as both, count(distinct sensor) as sensors, bool_and(value in (select n_nationkey::double from nation)) as known from (values ('a', 1.0), ('b', 1.0)) s(sensor, value)")
def simulated_sample(spark, d):
    """A drawn row has each sensor once, with values of the log."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("row_idx"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("sensor"), F.col("n_nationkey").cast("double").alias("value"))
    drawn = readers.simulated_sample(n, 3)
    return drawn.join(n.select(F.col("value").alias("v")).distinct(), F.col("v") == F.col("value"), "left").agg((F.count("*") == 2).alias("both"), F.count_distinct("sensor").alias("sensors"), F.bool_and(F.col("v").isNotNull()).alias("known"))


@query("""select 'Rows               : ' || count(*) || chr(10) || 'Columns            : 3' || chr(10) || 'Missing Values     : 0' || chr(10) || 'Duplicate Rows     : 0' || chr(10) || 'Numeric Columns    : 2' as value from nation""")
def report_lines(spark, d):
    return sinks.report_text(profiling.dataset_report(table(spark, d, "nation")))


@query("""with e as (select o_orderstatus as status, min(o_totalprice) as mn, max(o_totalprice) as mx, avg(o_totalprice) as m, max_by(o_totalprice, o_orderkey) as cur from orders group by 1)
select status, least(floor((o_totalprice - mn) / ((mx - mn) / 40)) + 1, 40)::int as bin, count(*) as n, round(any_value(cur), 4) as current_value, round(any_value(m), 4) as nominal_mean from orders join e on status = o_orderstatus group by 1, 2""")
def histogram_overlay(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"), "o_orderkey")
    now = o.groupBy("status").agg(F.max_by("value", "o_orderkey").alias("value"))
    return rounded(profiling.histogram_overlay(profiling.histogram(o, ["status"]), now, o.groupBy("status").agg(F.avg("value").alias("mean")), ["status"])).select("status", "bin", "n", "current_value", "nominal_mean")


@query("select l_linestatus as speed, l_returnflag as condition, count(*) as n, round(sum(l_quantity), 4) as total from lineitem group by 1, 2")
def cleaned_files(spark, d):
    """Cleaned readings partitioned by speed and condition, as Parquet and as CSV."""
    path = scratch(spark, "clean")
    t = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("speed"), F.col("l_returnflag").alias("condition"), "l_quantity")
    sinks.parquet(t, f"{path}/parquet", "speed", "condition")
    sinks.csv(t, f"{path}/csv", "speed", "condition")
    got = lambda df: df.groupBy("speed", "condition").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("total"))
    return got(spark.read.parquet(f"{path}/parquet")).intersect(got(spark.read.csv(f"{path}/csv", header=True, inferSchema=True)))


@query("""with s as (select q.vec_id as query_id, v.vec_id as id, round(list_dot_product(q.embedding::double[], v.embedding::double[]), 4) as raw_score from embeddings q, embeddings v where q.vec_id % 100 = 0)
select * from (select query_id, id, raw_score, row_number() over (partition by query_id order by raw_score desc, id)::int as rank from s) where rank <= 5""")
def stored_vectors(spark, d):
    """A vector store written twice (the second replaces the first), opened and searched."""
    from .diagnosis import open_vectors, store_vectors

    path = scratch(spark, "vectors")
    v = _vectors(spark, d)
    store_vectors(v.limit(3), path)
    store_vectors(v, path)
    kept = open_vectors(spark, path)
    return vector_topk(kept, kept.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 5)


@query("select p_partkey as query_id, p_name as query_text, case when p_size > 25 then 'EXTRACTED' else 'AMBIGUOUS' end as mode, p_size / 64.0::double as confidence, 'Diagnosis: ' || p_name as summary from part")
def report_documents(spark, d):
    """The public part of reports as JSON, decoded again."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query_text"), F.when(F.col("p_size") > 25, "EXTRACTED").otherwise("AMBIGUOUS").alias("mode"), (F.col("p_size") / 64.0).alias("confidence"), F.concat(F.lit("Diagnosis: "), "p_name").alias("summary"), F.lit("x").alias("private"))
    j = F.from_json("json", "struct<query_text: string, mode: string, confidence: double, summary: string>")
    return sinks.report_json(p).select("query_id", j.alias("j")).select("query_id", "j.*")
