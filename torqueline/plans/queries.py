"""Registered queries: every operator bound to the driver's tables, with the SQL it is checked against.

Bindings: numeric columns are sensors, categories are conditions; region, nation,
supplier and customer are the levels of a knowledge graph; parts are labels with words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions.similarity import multi_query_topk, vector_topk
from ..operators import decision, evaluate, graph, legacy, preprocess, profiling, retrieval, validation
from ..presets import ANCHOR_WORDS, GENERIC_LABEL_WORDS, LABEL_STOP_WORDS, MAPPER_STEM, QUERY_STEM, RETRIEVAL_STEM
from ..runtime import cut
from ..sources.readers import long_form
from ..sources.sinks import STATS
from .registry import QUERIES, SQL, query, rounded, table

SENSORS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def readings(spark, d) -> DataFrame:
    """(speed, condition, sensor, value): N is the nominal condition."""
    rows = table(spark, d, "lineitem").select("*", F.col("l_linestatus").alias("speed"), F.when(F.col("l_returnflag") == "N", "NOMINAL").otherwise(F.col("l_returnflag")).alias("condition"))
    return long_form(rows, SENSORS, ("speed", "condition"))


_LONG = "r as (select l_linestatus as speed, case when l_returnflag = 'N' then 'NOMINAL' else l_returnflag end as condition, s.sensor, s.value from lineitem, lateral (values " + ", ".join(f"('{c}', {c}::double)" for c in SENSORS) + ") s(sensor, value))"


@query(f"""with {_LONG} select condition, sensor, count(value) as count, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std, round(var_samp(value), 4) as variance,
round(min(value), 4) as min, round(max(value), 4) as max, round(quantile_cont(value, 0.5), 4) as median, round(quantile_cont(value, 0.25), 4) as q1, round(quantile_cont(value, 0.75), 4) as q3,
round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) as iqr, round(skewness(value), 4) as skewness, round(kurtosis(value), 4) as kurtosis from r group by all""")
def profile_by_condition(spark, d):
    return rounded(profiling.profile(readings(spark, d), ["condition", "sensor"], None)).select("condition", "sensor", *STATS)


@query(f"""with {_LONG} select condition, sensor, count(value) as count, count(*) - count(value) as missing, count(distinct value) as "unique", round(avg(value), 4) as mean, round(quantile_cont(value, 0.5), 4) as median,
round(stddev_samp(value), 4) as std, round(var_samp(value), 4) as variance, round(min(value), 4) as min, round(quantile_cont(value, 0.25), 4) as p25, round(quantile_cont(value, 0.75), 4) as p75, round(max(value), 4) as max from r group by all""")
def summary_by_condition(spark, d):
    return rounded(profiling.summary(readings(spark, d), ["condition", "sensor"]))


@query("with " + "p(sensor_a, sensor_b, r) as (" + " union all ".join(f"select '{a}', '{b}', corr({a}, {b}) from lineitem" for a in SENSORS for b in SENSORS if a != b) + " union all " + " union all ".join(f"select '{a}', '{a}', 1.0" for a in SENSORS) + ") select sensor_a, sensor_b, round(r, 6) as r from p")
def correlation_matrix(spark, d):
    return rounded(profiling.correlations(table(spark, d, "lineitem"), SENSORS), 6)


@query(f"with {_LONG}, v as (select condition, sensor, var_samp(value) as variance from r group by all) select condition, sensor, round(variance, 4) as variance, row_number() over (partition by condition order by variance desc, sensor)::int as rank from v")
def variance_ranking(spark, d):
    return rounded(profiling.variance_ranking(readings(spark, d), ["condition", "sensor"]))


@query("""select count(*) as n_rows, 6::bigint as n_columns, (count(*) * 6 - count(o_orderkey) - count(o_custkey) - count(o_orderstatus) - count(o_totalprice) - count(o_orderdate) - count(o_orderpriority))::bigint as missing,
count(*) - (select count(*) from (select distinct * from orders)) as duplicates, 3::bigint as numeric from orders""")
def dataset_report(spark, d):
    return profiling.dataset_report(table(spark, d, "orders"))


_GAPS = "e as (select user_id, event_id, case when event_id % 7 = 0 then null else value end as v, row_number() over (partition by user_id order by event_id) as pos from events)"


@query(f"""with {_GAPS}, n as (select *, last_value(v ignore nulls) over b as v0, last_value(case when v is not null then pos end ignore nulls) over b as a0, first_value(v ignore nulls) over a as v1, first_value(case when v is not null then pos end ignore nulls) over a as a1
from e window b as (partition by user_id order by event_id rows between unbounded preceding and current row), a as (partition by user_id order by event_id rows between current row and unbounded following))
select user_id, event_id, round(case when v is not null then v when v1 is null then v0 when v0 is not null then v0 + (v1 - v0) * (pos - a0) / (a1 - a0) end, 6) as value from n""")
def clean_interpolate(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return rounded(profiling.interpolated(e, ["user_id"], "event_id"), 6)


@query("with u as (select user_id, min(value) as lo, max(value) as hi from events group by 1) select event_id, e.user_id from events e join u on u.user_id = e.user_id where lo < hi")
def informative_sensors(spark, d):
    return profiling.informative(table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"]).select("event_id", "user_id")


@query("""with e as (select o_orderstatus as status, min(o_totalprice) as mn, max(o_totalprice) as mx from orders group by 1)
select status, least(floor((o_totalprice - mn) / ((mx - mn) / 40)) + 1, 40)::int as bin, round(any_value(mn) + (least(floor((o_totalprice - mn) / ((mx - mn) / 40)) + 1, 40) - 1) * ((any_value(mx) - any_value(mn)) / 40), 4) as lo,
round(any_value(mn) + least(floor((o_totalprice - mn) / ((mx - mn) / 40)) + 1, 40) * ((any_value(mx) - any_value(mn)) / 40), 4) as hi, count(*) as n
from orders join e on status = o_orderstatus group by status, least(floor((o_totalprice - mn) / ((mx - mn) / 40)) + 1, 40)""")
def histogram_40(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"))
    return rounded(profiling.histogram(o, ["status"]))


@query("""with q as (select o_orderstatus as status, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.5) as median, quantile_cont(o_totalprice, 0.75) as q3 from orders group by 1)
select status, round(any_value(q1), 4) as q1, round(any_value(median), 4) as median, round(any_value(q3), 4) as q3, round(min(o_totalprice) filter (where o_totalprice >= q1 - 1.5 * (q3 - q1) and o_totalprice <= q3 + 1.5 * (q3 - q1)), 4) as whisker_lo,
round(max(o_totalprice) filter (where o_totalprice >= q1 - 1.5 * (q3 - q1) and o_totalprice <= q3 + 1.5 * (q3 - q1)), 4) as whisker_hi, count(*) filter (where o_totalprice < q1 - 1.5 * (q3 - q1) or o_totalprice > q3 + 1.5 * (q3 - q1)) as outliers
from orders join q on status = o_orderstatus group by status""")
def boxplot_stats(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"))
    return rounded(profiling.boxplot(o, ["status"]))


_WELCH = f"""{_LONG}, s as (select speed, condition, sensor, count(value)::double as n, avg(value) as m, var_samp(value) as v from r group by all),
c as (select b.speed, b.condition as fault, sensor, a.m as m1, b.m as m2, a.v as v1, b.v as v2, a.n as n1, b.n as n2 from s a join s b using (sensor) where a.speed = b.speed and a.condition = 'NOMINAL' and b.condition <> 'NOMINAL'),
w as (select *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) as t, (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) as df, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) as effect, case when m1 <> 0 then (m2 - m1) / abs(m1) * 100 end as pct from c)"""


@query(f"with {_WELCH} select speed, fault, sensor, round(m1, 4) as nominal_mean, round(m2, 4) as fault_mean, round(sqrt(v1), 4) as nominal_std, round(sqrt(v2), 4) as fault_std, round(pct, 4) as percent_change, round(t, 4) as t_statistic, round(df, 2) as df, round(effect, 4) as effect_size from w")
def compare_to_nominal(spark, d):
    out = rounded(profiling.comparison(readings(spark, d), with_p=False).withColumn("df", F.round("df", 2)))
    return out


@query(f"with {_WELCH} select speed, fault, sensor, rank from (select *, row_number() over (partition by fault, speed order by abs(effect) desc, sensor)::int as rank from w where abs(effect) >= 0.001) where rank <= 2")
def sensor_mapping_topk(spark, d):
    """Selection with significance left open (p <= 1), as these tables hold no faults."""
    from ..presets import Settings

    c = profiling.comparison(readings(spark, d)).withColumns({"importance_score": F.abs("effect_size")})
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("speed", "fault").orderBy(F.desc("importance_score"), "sensor")))
    return profiling.select_sensors(c, Settings(p_value=1.0, effect_size=0.001, map_top_k=2)).select("speed", "fault", "sensor", "rank")


def _validation(spark, d):
    r = readings(spark, d)
    p = r.where("value is not null").groupBy("speed", "condition", "sensor").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    mapping = p.where("condition <> 'NOMINAL'").select(F.col("condition").alias("fault"), "speed", "sensor", F.dense_rank().over(Window.partitionBy("condition", "speed").orderBy("sensor")).alias("rank"), (F.length("sensor") / 10.0).alias("importance_score"))
    first = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("speed")).agg(*[F.min_by(c, F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias(c) for c in SENSORS])
    sample = long_form(first, SENSORS, ("speed",)).withColumn("sample_id", F.lit(0))
    return validation.signals(mapping, sample, p)


_SIGNALS = f"""{_LONG}, p as (select speed, condition, sensor, avg(value) as m, stddev_samp(value) as s from r group by all),
f as (select l_linestatus as speed, {', '.join(f'min_by({c}, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) as {c}' for c in SENSORS)} from lineitem group by 1),
v as (select speed, s.sensor, s.value from f, lateral (values {', '.join(f"('{c}', {c}::double)" for c in SENSORS)}) s(sensor, value)),
x as (select b.condition as fault, v.speed, v.sensor, v.value, a.m as nm, b.m as fm, case when a.s = 0 then 0 else (v.value - a.m) / a.s end as z, case when a.m = 0 then 0 else (v.value - a.m) / a.m * 100 end as pct,
  round(exp(-abs(v.value - b.m) / (greatest(abs(b.m), abs(a.m), 1e-6) * 0.05)), 3) as sim, length(v.sensor) / 10.0 as w
  from v join p a on a.speed = v.speed and a.sensor = v.sensor and a.condition = 'NOMINAL' join p b on b.speed = v.speed and b.sensor = v.sensor and b.condition <> 'NOMINAL'),
y as (select *, case when sim >= 0.9 and abs(z) >= 5 then 'CRITICAL' when sim >= 0.7 and abs(z) >= 3 then 'WARNING' when abs(pct) >= 10 then 'WARNING' else 'NORMAL' end as status from x)"""


@query(f"with {_SIGNALS} select fault, speed, sensor, round(value, 4) as current_value, round(z, 3) as z_score, round(pct, 3) as percent_change, sim as sensor_confidence, status from y")
def sensor_signals(spark, d):
    return _validation(spark, d).select("fault", "speed", "sensor", F.round("current_value", 4).alias("current_value"), "z_score", "percent_change", "sensor_confidence", "status")


@query(f"with {_SIGNALS} select fault, speed, round(sum(sim * w) / sum(w), 3) as sensor_confidence, count(*) as num_sensors_checked, coalesce(string_agg(sensor, ',' order by sensor) filter (where status = 'CRITICAL'), '') as critical, coalesce(string_agg(sensor, ',' order by sensor) filter (where status = 'WARNING'), '') as warning, coalesce(string_agg(sensor, ',' order by sensor) filter (where status = 'NORMAL'), '') as normal from y group by all")
def sensor_validate(spark, d):
    r = validation.fault_results(_validation(spark, d))
    return r.select("fault", "speed", "sensor_confidence", "num_sensors_checked", *[F.array_join(c, ",").alias(c) for c in ("critical", "warning", "normal")])


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


_DOTS = "s as (select q.vec_id as query_id, v.vec_id as id, round(list_dot_product(q.embedding::double[], v.embedding::double[]), 4) as raw_score from embeddings q, embeddings v where q.vec_id % 100 = 0)"


@query(f"with {_DOTS} select * from (select query_id, id, raw_score, row_number() over (partition by query_id order by raw_score desc, id)::int as rank from s) where rank <= 10")
def vector_search(spark, d):
    """Queries are the vectors whose id is divisible by 100."""
    v = _vectors(spark, d)
    return vector_topk(v, v.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 10)


@query(f"""with {_DOTS}, t as (select * from (select *, row_number() over (partition by query_id order by raw_score desc, id) as rank from s) where rank <= 10), m as (select query_id // 200 as query_id, id, max(raw_score) as raw_score from t group by all)
select * from (select query_id, id, raw_score, row_number() over (partition by query_id order by raw_score desc, id)::int as rank from m) where rank <= 20""")
def vector_multi_maxpool(spark, d):
    """Two neighbouring query vectors are the variants of one query."""
    v = _vectors(spark, d)
    return multi_query_topk(v, v.where("id % 100 = 0").select(F.floor(F.col("id") / 200).alias("query_id"), F.col("id").alias("variant_id"), "embedding"), 10)


@query("with w as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as word from documents) select word, count(*) as df from w where length(word) > 2 group by word")
def token_doc_freq(spark, d):
    return preprocess.document_frequency(table(spark, d, "documents"), "text")


@query("with w as (select regexp_extract_all(lower(text), '[a-z0-9]+') as w, doc_id from documents) select doc_id, len(w)::int as n_words, len(list_distinct(w))::int as n_distinct from w")
def tokenise_alnum(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(T.alnum_tokens("text")).alias("w")).select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))


def _duck_stem(rules, x):
    guard = any(s == "ss" for s, _, _ in rules)
    whens = " ".join(f"when {x} like '%{s}' and length({x}) > {n}" + (f" and not {x} like '%ss'" if s == "s" and guard else "") + f" then left({x}, length({x}) - {c})" for s, n, c in rules)
    return f"case when length({x}) <= 3 then {x} {whens} else {x} end"


@query("select distinct word, " + ", ".join(f"{_duck_stem(r, 'word')} as {n}" for n, r in (("retrieval", RETRIEVAL_STEM), ("query", QUERY_STEM), ("mapper", MAPPER_STEM))) + " from (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from conversations)")
def stemmers(spark, d):
    w = table(spark, d, "conversations").select(F.explode(F.expr(T.alnum_tokens("text"))).alias("word")).distinct()
    return w.select("word", F.expr(T.retrieval_stem("word")).alias("retrieval"), F.expr(T.query_stem("word")).alias("query"), F.expr(T.mapper_stem("word")).alias("mapper"))


@query(f"""with w as (select p_partkey as id, p_size / 50.0 as score, p_brand, list_sort(list_distinct(list_transform(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) > 2), lambda w: {_duck_stem(RETRIEVAL_STEM, 'w')}))) as s from part),
o as (select *, row_number() over (partition by p_brand, s order by score desc, id) as rn from w) select p_brand, id, rank from (select *, row_number() over (partition by p_brand order by score desc, id)::int as rank from o where rn = 1) where rank <= 10""")
def stem_dedup(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_name").alias("label"), (F.col("p_size") / 50.0).alias("score"), F.lit(0).alias("ord"))
    return retrieval.stem_dedup(p, 10, keys=("p_brand",)).select("p_brand", "id", "rank")


def _sql_list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_JACCARD = f"""l as (select distinct p_name as label, lower(p_name) as n from part),
s as (select label, n, list_filter(list_distinct(list_transform(list_filter(string_split(n, ' '), lambda t: length(t) > 1 and not list_contains({_sql_list(LABEL_STOP_WORDS)}, t)), lambda w: {_duck_stem(MAPPER_STEM, 'w')})), lambda x: not list_contains({_sql_list(T._mapper_stems(GENERIC_LABEL_WORDS))}, x)) as st from l),
a as (select row_number() over (order by p_partkey) - 1 as o, p_name as anchor from part where p_partkey % 50 = 7),
m as (select x.label, a.anchor, a.o, case when x.n = y.n then 1.0 else len(list_intersect(x.st, y.st))::double / len(list_distinct(list_concat(x.st, y.st))) end as match from s x, a join s y on y.label = a.anchor where x.n = y.n or len(list_intersect(x.st, y.st)) > 0)"""


@query(f"with {_JACCARD} select label, anchor, round(match, 6) as match from (select *, row_number() over (partition by label order by match desc, o) as rn from m where match >= 0.15) where rn = 1")
def jaccard_map(spark, d):
    """Anchors are the parts whose id leaves 7 modulo 50, a stand-in for a short anchor table."""
    p = table(spark, d, "part")
    a = p.where("p_partkey % 50 = 7").select(F.floor(F.col("p_partkey") / 50).cast("int").alias("anchor_ord"), F.col("p_name").alias("anchor"), F.lit("F").alias("fault"))
    return decision.label_faults(p.select(F.col("p_name").alias("label")), a).select("label", "anchor", F.round("match", 6).alias("match"))


def _kg(spark, d):
    """Nodes and edges of region, nation, supplier and customer."""
    t = lambda n: table(spark, d, n)
    node = lambda df, p, k, label, kind, com: df.select(F.concat(F.lit(p), F.col(k)).alias("id"), F.col(label).alias("label"), F.lit(kind).alias("node_type"), com.cast("int").alias("community"), F.col(k).cast("long").alias("ord"))
    nodes = node(t("region"), "r", "r_regionkey", "r_name", "Category", F.lit(None)).union(node(t("nation"), "n", "n_nationkey", "n_name", "Subcategory", F.col("n_nationkey"))).union(node(t("supplier"), "s", "s_suppkey", "s_name", "Symptom", F.col("s_nationkey"))).union(node(t("customer"), "c", "c_custkey", "c_name", "DiagnosisStep", F.col("c_nationkey")))
    edge = lambda df, a, b, x, y, rel: df.select(F.concat(F.lit(a), F.col(x)).alias("source"), F.concat(F.lit(b), F.col(y)).alias("target"), F.lit(rel).alias("relation"), F.lit(1.0).alias("weight"), F.col(y).cast("long").alias("ord"))
    edges = edge(t("nation"), "r", "n", "n_regionkey", "n_nationkey", "HAS_SUBCATEGORY").union(edge(t("supplier"), "n", "s", "s_nationkey", "s_suppkey", "HAS_SYMPTOM")).union(edge(t("customer"), "n", "c", "c_nationkey", "c_custkey", "HAS_DIAGNOSIS_STEP"))
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("community"), F.col("r_name").alias("category"))
    return nodes.join(place, "community", "left").withColumn("category", F.coalesce("category", F.when(F.col("node_type") == "Category", F.col("label")), F.lit(""))), edges


_KG = """e(source, target, relation) as (select 'r' || n_regionkey, 'n' || n_nationkey, 'HAS_SUBCATEGORY' from nation union all select 'n' || s_nationkey, 's' || s_suppkey, 'HAS_SYMPTOM' from supplier union all select 'n' || c_nationkey, 'c' || c_custkey, 'HAS_DIAGNOSIS_STEP' from customer),
g(id, label, node_type, community, category) as (select 'r' || r_regionkey, r_name, 'Category', null::int, r_name from region union all select 'n' || n_nationkey, n_name, 'Subcategory', n_nationkey::int, r_name from nation join region on r_regionkey = n_regionkey
  union all select 's' || s_suppkey, s_name, 'Symptom', s_nationkey::int, r_name from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey
  union all select 'c' || c_custkey, c_name, 'DiagnosisStep', c_nationkey::int, r_name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey)"""


@query(f"with recursive {_KG}, b(query_id, id, hop) as (select r_regionkey, 'r' || r_regionkey, 0 from region union all select b.query_id, e.target, b.hop + 1 from b join e on e.source = b.id where b.hop < 2) select query_id, id, min(hop)::int as hop from b group by all")
def graph_bfs(spark, d):
    _, e = _kg(spark, d)
    seeds = table(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return graph.bfs(e, seeds, 2)


@query(f"with {_KG} select g.id, coalesce(s.id, case when g.node_type = 'Subcategory' then g.id end) as subcategory_id, c.source as category_id from g left join e x on x.target = g.id and x.relation <> 'HAS_SUBCATEGORY' left join g s on s.id = x.source left join e c on c.target = coalesce(s.id, g.id) and c.relation = 'HAS_SUBCATEGORY'")
def graph_walk_up(spark, d):
    n, e = _kg(spark, d)
    return graph.hierarchy(n, e).select("id", "subcategory_id", "category_id")


@query(f"with {_KG} select id, count(*) as degree from (select source as id from e union all select target from e) group by id")
def graph_degree(spark, d):
    return graph.degrees(_kg(spark, d)[1])


@query(f"with {_KG} select source as id, coalesce(string_agg(label, ',' order by label) filter (where relation = 'HAS_SYMPTOM'), '') as symptoms, count(*) filter (where relation = 'HAS_DIAGNOSIS_STEP')::int as n_steps from e join g on g.id = target where relation <> 'HAS_SUBCATEGORY' group by source")
def graph_children(spark, d):
    n, e = _kg(spark, d)
    return graph.children(n, e).select("id", F.array_join(F.array_sort("symptoms"), ",").alias("symptoms"), F.size("steps").alias("n_steps"))


@query("""with l as (select distinct l_partkey as part, l_suppkey as s, s_nationkey as c from lineitem join supplier on s_suppkey = l_suppkey),
p as (select least('s' || a.s, 's' || b.s) as a, greatest('s' || a.s, 's' || b.s) as b, min(a.part) as first from l a join l b on a.part = b.part and a.c <> b.c and a.s < b.s group by 1, 2) select a, b from p""")
def similarity_edges(spark, d):
    """Suppliers of different nations that share a part."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("category"))
    leaf = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    leaf = leaf.select(F.col("l_suppkey").alias("ord"), F.lit(0).alias("at"), F.lit("sym").alias("kind"), "category", F.concat(F.lit("s"), "l_suppkey").alias("sub_id"), F.lit("f").alias("sub_file"), F.col("l_partkey").cast("string").alias("text"))
    return graph.similarity_edges(leaf).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))


@query(f"with {_KG} select community, count(*)::int as size, count(distinct category) > 1 as is_multi_category, string_agg(distinct category, ',' order by category) as categories from g where community is not null group by community")
def community_rollup(spark, d):
    r = graph.community_rollup(_kg(spark, d)[0])
    return r.select("community", "size", "is_multi_category", F.array_join("categories", ",").alias("categories"))


@query(f"with {_KG}, c as (select community, count(*) as size from g where community is not null group by 1) select count(*) as total, 0::bigint as multi, round(avg(size), 4) as avg_size, max(size)::int as max_size, min(size)::int as min_size, 0::bigint as anonymous from c")
def community_stats(spark, d):
    return rounded(graph.community_stats(graph.community_rollup(_kg(spark, d)[0])))


@query(f"with {_KG} select 'node' as kind, node_type as name, count(*) as n from g group by 2 union all select 'edge', relation, count(*) from e group by 2")
def kg_counts(spark, d):
    return graph.counts(*_kg(spark, d))


@query("""with l as (select s_nationkey as sn, c_nationkey as cn from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey), r as (select a.n_regionkey as x, b.n_regionkey as y from l join nation a on a.n_nationkey = sn join nation b on b.n_nationkey = cn),
k as (select p.r_name as s, q.r_name as t from r join region p on p.r_regionkey = x join region q on q.r_regionkey = y where x <> y) select least(s, t) as a, greatest(s, t) as b, count(*) as n from k group by 1, 2""")
def cross_category(spark, d):
    n, _ = _kg(spark, d)
    e = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("c"), "o_custkey").alias("target"))
    return graph.cross_category(n.select("id", "category"), e)


@query("select lower(trim(p_name)) as label, count(*) as n from part group by 1 having count(*) > 1")
def duplicate_labels(spark, d):
    return graph.duplicate_labels(table(spark, d, "part").withColumnRenamed("p_name", "label"))


@query("select 'ts' as field, round(count(ts) / count(*), 6) as share from events union all select 'props', round(count(props) / count(*), 6) from events union all select 'value', round(count(value) / count(*), 6) from events")
def field_coverage(spark, d):
    return rounded(graph.field_coverage(table(spark, d, "events").select("ts", "props", "value")), 6)


@query("""select conv_id, turn, case when regexp_matches(text, '\\b[pPbBcCuU][0-9]{4}\\b') or regexp_matches(text, '(?i)\\b(error|code|dtc|fault)\\s*[:#]?\\s*([a-z]?[0-9]{2,5})\\b') then 'error_code'
when right(trim(lower(text)), 1) = '?' or regexp_matches(trim(lower(text)), '^(why|how|what|when|is my|should i|can i)') then 'question' else 'symptom_report' end as intent,
array_to_string(list_transform(regexp_extract_all(text, '\\b[pPbBcCuU][0-9]{4}\\b'), lambda c: upper(c)), ',') as codes from conversations where role = 'user'""")
def intent_and_codes(spark, d):
    u = table(spark, d, "conversations").where("role = 'user'").withColumn("query_id", F.lit(0))
    return preprocess.analysed(u).select("conv_id", "turn", "intent", F.array_join("error_codes", ",").alias("codes"))


@query("select p_partkey, trim(regexp_replace(lower(p_name || '/' || p_type), '[^a-z0-9]+', '_', 'g'), '_') as slug, 'sym_' || left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_'), 40) || '_' || left(md5(p_name), 8) as node_id from part")
def slugs_and_ids(spark, d):
    p = table(spark, d, "part").withColumn("x", F.concat_ws("/", "p_name", "p_type"))
    return p.select("p_partkey", F.expr(T.slug("x")).alias("slug"), F.expr(T.node_id("sym", "p_name")).alias("node_id"))


def _part_nodes(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ("Symptom", "Subcategory", "DiagnosisStep", "Category"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("category"), F.col("p_type").alias("subcategory"), kinds.alias("node_type"), F.pmod("p_size", F.lit(10)).alias("community"), F.col("p_partkey").alias("ord"))


def _paths(spark, d):
    """Three scored lists for every hundredth part: vectors, retail price and size of parts with the same name or brand.

    Parts are ranked once for each name and brand; queries meet the first of theirs alone.
    """
    v = _vectors(spark, d)
    q = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("qn"), F.col("p_brand").alias("qb"))
    def ranked(key, asked, score, k):
        first = p.select(key, "id", score.alias("raw_score")).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("raw_score"), "id"))).where(F.col("rank") <= k)
        return first.join(q, F.col(key) == F.col(asked)).select("query_id", "id", "raw_score", "rank")

    vec = vector_topk(v, v.join(q.select(F.col("query_id").alias("id")), "id").withColumnRenamed("id", "query_id"), 20)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_retailprice", "p_size")
    gph = ranked("p_name", "qn", F.col("p_retailprice") / 10000, 30)
    com = ranked("p_brand", "qb", F.col("p_size") / 50, 10)
    return q, vec, gph, com


_PATHS = """q as (select p_partkey as query_id, p_name as qn, p_brand as qb from part where p_partkey % 100 = 0),
vs as (select q.vec_id as query_id, v.vec_id as id, round(list_dot_product(q.embedding::double[], v.embedding::double[]), 4) as raw_score from embeddings q, embeddings v where q.vec_id in (select query_id from q)),
gs as (select query_id, p_partkey as id, p_retailprice / 10000 as raw_score from q join part on p_name = qn), cs as (select query_id, p_partkey as id, p_size / 50 as raw_score from q join part on p_brand = qb),
a as (select 0 as path, *, row_number() over (partition by query_id order by raw_score desc, id) as rank, 20 as k from vs union all select 1, *, row_number() over (partition by query_id order by raw_score desc, id), 30 from gs union all select 2, *, row_number() over (partition by query_id order by raw_score desc, id), 10 from cs),
t as (select * from a where rank <= k),
n as (select *, round(cast((raw_score - min(raw_score) over w) / (case when max(raw_score) over w > min(raw_score) over w then max(raw_score) over w - min(raw_score) over w else 1 end) as decimal(18,10)), 4)::double as norm from t window w as (partition by query_id, path))"""
_FUSED = f"""{_PATHS}, m as (select query_id, id, max(norm) filter (where path = 0) as v, max(norm) filter (where path = 1) as g, max(norm) filter (where path = 2) as c, min(path * 1000 + rank) as ord from n group by all),
x as (select m.*, p_name as label, p_brand as category, ['Symptom', 'Subcategory', 'DiagnosisStep', 'Category'][p_partkey % 4 + 1] as node_type, qb, (v is not null)::int + (g is not null)::int + (c is not null)::int as k from m join part on p_partkey = id join q using (query_id)),
s1 as (select *, round(cast(0.55 * coalesce(v, g, c) + 0.25 * coalesce(g, 0) + 0.20 * coalesce(c, 0) as decimal(18,10)), 4)::double as s from x),
s2 as (select * replace (round(cast(s * case when k = 3 then 1.25 when v is not null and g is not null then 1.15 when v is not null and c is not null then 1.10 when k = 2 then 1.05 else 1.0 end as decimal(18,10)), 4)::double as s) from s1),
s3 as (select * replace (case when category = qb then round(cast(s * 1.08 as decimal(18,10)), 4)::double else s end as s) from s2),
s4 as (select * replace (round(cast(s * case node_type when 'DiagnosisStep' then 0.80 when 'Subcategory' then 0.85 when 'Category' then 0.75 else 1.0 end as decimal(18,10)), 4)::double as s) from s3),
s5 as (select *, row_number() over (partition by query_id, label order by s desc, ord, id) as rn from s4),
h as (select * from (select *, row_number() over (partition by query_id order by s desc, ord, id)::int as rank from s5 where rn = 1) where rank <= 10)"""


def _hybrid(spark, d):
    q, vec, gph, com = _paths(spark, d)
    m = retrieval.merged(*[retrieval.min_max(p, ["query_id"]) for p in (vec, gph, com)])
    return retrieval.stem_dedup(retrieval.fused(m, _part_nodes(spark, d), q.select("query_id", F.array("qb").alias("categories"))), 10)


@query(f"with {_FUSED} select query_id, id, s as score, case when k = 3 then 'all' else array_to_string(list_filter([case when v is not null then 'vector' end, case when g is not null then 'graph' end, case when c is not null then 'community' end], lambda x: x is not null), '+') end as source, rank from h")
def hybrid_fusion(spark, d):
    return _hybrid(spark, d).select("query_id", "id", "score", "source", "rank")


@query(f"with {_FUSED} select query_id, case when k = 3 then 'all' else array_to_string(list_filter([case when v is not null then 'vector' end, case when g is not null then 'graph' end, case when c is not null then 'community' end], lambda x: x is not null), '+') end as source, count(*) as n from h group by all")
def source_breakdown(spark, d):
    return retrieval.source_breakdown(_hybrid(spark, d))


_DECIDED = f"""{_FUSED}, o as (select query_id, max(s) filter (where rank = 1) as top, max(s) filter (where rank = 2) as second, count(*) as n from h group by 1),
z as (select query_id, top, case when top <= 0 then 0 else least(top / 0.55, 1) end as cal, case when top <= 0 then 0 when n = 1 then 1 else least(greatest((top - second) / top, 0), 1) end as sep from o),
dd as (select *, least(0.6 * cal + 0.2 * sep, 1) as conf from z)"""


def _decided(spark, d):
    g = _hybrid(spark, d).groupBy("query_id").agg(F.reverse(F.array_sort(F.collect_list("score"))).alias("s"))
    g = g.select("query_id", F.get("s", F.lit(0)).alias("top"), S.separation(F.col("s")).alias("separation"), S.calibrated(F.get("s", F.lit(0))).alias("calibrated_retrieval"))
    g = g.withColumns({"coverage": F.lit(0.0), "sensor_boost": F.lit(0.0)})
    return g.withColumn("confidence", S.confidence(F.col("calibrated_retrieval"), F.col("separation"), F.col("coverage"), F.col("sensor_boost"))).withColumn("mode", S.mode(F.col("confidence")))


@query(f"with {_DECIDED} select query_id, round(cal, 6) as calibrated_retrieval, round(sep, 6) as separation, round(conf, 6) as confidence, case when conf >= 0.3 then 'EXTRACTED' else 'AMBIGUOUS' end as mode from dd")
def confidence_mode(spark, d):
    return rounded(_decided(spark, d).select("query_id", "calibrated_retrieval", "separation", "confidence", "mode"), 6)


@query(f"with {_DECIDED}, th as (select unnest([0.55, 0.6, 0.62, 0.65, 0.7, 0.8]) as threshold), e as (select threshold, count(*) filter (where (conf >= threshold) = (query_id % 200 = 0)) as correct, count(*) filter (where (conf >= threshold) <> (query_id % 200 = 0)) as wrong from dd, th group by 1) select threshold::double as threshold, correct, wrong, correct - 3 * wrong as score, row_number() over (order by correct - 3 * wrong desc, threshold) = 1 as best from e")
def threshold_sweep(spark, d):
    return evaluate.threshold_sweep(_decided(spark, d).withColumn("expected", F.col("query_id") % 200 == 0), [0.55, 0.6, 0.62, 0.65, 0.7, 0.8])


@query(f"with {_DECIDED}, mo as (select case when conf >= 0.3 then 'EXTRACTED' else 'AMBIGUOUS' end as mode, conf from dd) select mode, count(*) as n, round(min(conf), 6) as lo, round(max(conf), 6) as hi, round(avg(conf), 6) as mean, round(list_sort(list(conf))[count(*) // 2 + 1], 6) as upper_median from mo group by 1")
def mode_stats(spark, d):
    return rounded(evaluate.mode_stats(_decided(spark, d)), 6)


@query(f"with {_DECIDED} select query_id, u.component, round(u.c, 6) as contribution, round(sum(u.c) over (partition by query_id order by u.pos), 6) as running, row_number() over (partition by query_id order by u.c desc, u.pos) = 1 as dominant from dd, lateral (values (0, 'retrieval', cal * 0.6), (1, 'separation', sep * 0.2), (2, 'coverage', 0.0), (3, 'sensor', 0.0)) u(pos, component, c)")
def confidence_components(spark, d):
    return rounded(evaluate.components(_decided(spark, d)).drop("crosses"), 6)


@query(f"with {_FUSED}, g as (select query_id, lag(s) over (partition by query_id order by rank) - s as gap from h) select query_id, round(avg(gap), 6) as avg_gap, round(max(gap), 6) as max_gap from g group by 1")
def score_gaps(spark, d):
    return rounded(evaluate.score_gaps(_hybrid(spark, d)), 6)


@query(f"with {_FUSED}, r as (select query_id, rank, row_number() over (partition by query_id order by coalesce(v, g, c) desc, id) as raw from h) select a.query_id, count(*) filter (where a.rank > b.rank) as n from r a join r b on a.query_id = b.query_id and a.raw < b.raw group by 1")
def rank_inversions(spark, d):
    h = _hybrid(spark, d)
    return evaluate.inversions(h.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("v", "g", "c")), "id")).alias("rank_raw"), F.col("rank").alias("rank_final")))


@query(f"""with {_FUSED}, b as (select query_id, id, rank from n where path = 0 and rank <= 10) select coalesce(b.query_id, h.query_id) as query_id, coalesce(b.id, h.id) as id, b.rank::int as rank_before, h.rank as rank_after,
case when b.id is null then 'new' when h.id is null then 'dropped' when b.rank <> h.rank then 'moved' else 'same' end as movement from b full join h on h.query_id = b.query_id and h.id = b.id""")
def rank_movements(spark, d):
    _, vec, _, _ = _paths(spark, d)
    return evaluate.movements(vec.where("rank <= 10"), _hybrid(spark, d))


@query(f"""with {_PATHS}, m as (select query_id, id, max(raw_score) filter (where path = 0) as v, max(raw_score) filter (where path = 1) as g, max(raw_score) filter (where path = 2) as c, min(path * 1000 + rank) as ord from n group by all),
s as (select *, case when v is not null then v + case when g is not null then 0.5 else 0 end when g is not null then 0.3 else c end + case when c is null then 0 when v is not null and g is not null then 0.8 when v is not null then 0.3 when g is not null then 0.2 else 0 end as s from m)
select * from (select query_id, id, round(s, 9) as score, row_number() over (partition by query_id order by s desc, ord, id)::int as rank from s) where rank <= 10""")
def three_path_fusion(spark, d):
    _, vec, gph, com = _paths(spark, d)
    return rounded(legacy.three_path_fusion(vec, gph, com).select("query_id", "id", "score", "rank"), 9)


@query(f"""with {_PATHS}, m as (select query_id, id, max(raw_score) filter (where path = 0) as v, max(raw_score) filter (where path = 1) as g, min(path * 1000 + rank) as ord from n where path < 2 group by all),
s as (select *, case when v is not null and g is not null then v + 0.5 when v is not null then v else 0.3 end as s from m)
select * from (select query_id, id, round(s, 9) as score, row_number() over (partition by query_id order by s desc, ord, id)::int as rank from s) where rank <= 10""")
def two_path_fusion(spark, d):
    _, vec, gph, _ = _paths(spark, d)
    return rounded(legacy.two_path_fusion(vec, gph).select("query_id", "id", "score", "rank"), 9)


_CAL = "select p_partkey, p_retailprice / 1000 as score, ['vector+graph', 'vector+community', 'all', 'graph', 'community', 'both'][p_partkey % 6 + 1] as source, p_size > 25 as multi from part"


@query(f"""with p as ({_CAL}), v as (select *, greatest(score - case source when 'vector+graph' then 0.5 when 'vector+community' then 0.3 when 'all' then 1.3 else 0 end, 0) as x, greatest(score - 0.5, 0) as y from p)
select p_partkey, round(case source when 'vector+graph' then 1 - (1 - x * (1 + 0.4 * (1 - x))) * 0.7 when 'vector+community' then 1 - (1 - x * (1 + 0.4 * (1 - x))) * 0.6 when 'all' then 1 - (1 - x * (1 + 0.4 * (1 - x))) * 0.42 else greatest(score, 0) end, 9) as three,
round(case when source = 'both' then 1 - (1 - y * (1 + 0.4 * (1 - y))) * 0.7 else greatest(score, 0) end, 9) as two,
round(score * (case source when 'all' then 1.0 when 'vector+graph' then 0.95 when 'vector+community' then 0.85 when 'community' then 0.45 + case when multi then 0.1 else 0 end when 'graph' then 0.35 else 0.3 end), 9) as effective from v""")
def calibrated_scores(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("score"), F.element_at(F.array(*map(F.lit, ("vector+graph", "vector+community", "all", "graph", "community", "both"))), (F.col("p_partkey") % 6 + 1).cast("int")).alias("source"), (F.col("p_size") > 25).alias("multi"))
    s, src = F.col("score"), F.col("source")
    return rounded(p.select("p_partkey", S.three_path_calibrated(s, src).alias("three"), S.two_path_calibrated(s, src).alias("two"), S.effective_confidence(s, src, F.col("multi")).alias("effective")), 9)


@query("with c as (select unnest(range(1, 32)) as combo) select n_nationkey as query_id, combo::int as combo, n_name || ', ' || array_to_string(list_filter(['a', 'b', 'c', 'd', 'e'], lambda x, i: (combo >> (i - 1)::int) & 1 = 1), ', ') as text from nation, c")
def refinements(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("text"))
    return evaluate.refinements(n, ["a", "b", "c", "d", "e"])


@query()
def label_propagation(spark, d):
    n, e = _kg(spark, d)
    return graph.communities(n, e)


from . import queries_decision, queries_graph, queries_io, queries_scale  # noqa: E402, F401  (they add theirs, on these bindings)

__all__ = ["QUERIES", "SQL"]
