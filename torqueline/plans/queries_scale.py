"""Queries of communities by modularity, logs of many files, the stored vector index and statistics under skew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import vector_topk
from ..functions.vector_index import VectorIndex
from ..operators import graph, modularity, profiling
from ..runtime import scratch
from ..sources import logs
from .queries import _DOTS, _KG, _kg, _vectors
from .queries_decision import _ratio
from .registry import query, rounded, table

_LINKS = f"""{_KG}, l as (
  select a, b, sum(w) as w from (
    select source as a, target as b, 1.0::double as w from e where source <> target
    union all select target, source, 1.0 from e where source <> target)
  group by 1, 2),
c as (select id, right(id, 1) as community from g),
k as (select a as id, sum(w) as k from l group by 1)"""


def _links(spark, d):
    nodes, edges = _kg(spark, d)
    labels = nodes.select("id", F.expr("right(id, 1)").alias("community"))
    return modularity.both_ways(edges.drop("weight")), labels


@query(f"""with {_LINKS},
t as (
  select x.community, sum(w) as total, sum(case when x.community = y.community then w else 0 end) as inside
  from l join c x on x.id = l.a join c y on y.id = l.b group by 1)
select round(sum(inside) / sum(total) - sum(total * total) / (sum(total) * sum(total)), 6) as modularity from t""")
def partition_modularity(spark, d):
    """Modularity of a given partition: nodes by the last sign of their id."""
    return rounded(modularity.modularity(*_links(spark, d)), 6)


@query(f"""with {_LINKS},
t as (select community, sum(k) as total from c join k on k.id = c.id group by 1),
m as (select sum(k) as m2 from k),
n as (
  select id, to_, sum(w) as w from (
    select l.a as id, c.community as to_, w from l join c on c.id = l.b
    union all select c.id, community, 0 from c join k on k.id = c.id)
  group by 1, 2),
s as (
  select n.id, c.community, to_, round(w - k * (total - case when to_ = c.community then k else 0 end) / m2, 10) as score, m2
  from n join c on c.id = n.id join k on k.id = n.id join t on t.community = to_, m),
b as (select id, community, m2, max(score) filter (where to_ = community) as here, min({{'s': -score, 't': to_}}) as best from s group by 1, 2, 3)
select id, community, best.t as best, round(2 * (-best.s - here) / m2, 8) as gain from b where -best.s > here""")
def modularity_moves(spark, d):
    """The best move of each node, one round of local moving from a given partition."""
    return rounded(modularity.moves(*_links(spark, d)), 8)


@query(f"with {_KG} select count(*) as nodes, true as at_least_spread from g")
def modularity_communities(spark, d):
    """Communities of the hierarchy: how many nodes have one, and whether their modularity is at least that of label propagation."""
    nodes, edges = _kg(spark, d)
    links, found = modularity.both_ways(edges), modularity.communities(nodes, edges)
    value = modularity.modularity(links, found).select(F.col("modularity").alias("a"))
    spread = modularity.modularity(links, graph.communities(nodes, edges)).select(F.col("modularity").alias("b"))
    return found.agg(F.count("community").alias("nodes")).join(value).join(spread).select("nodes", (F.col("a") >= F.col("b") - 1e-9).alias("at_least_spread"))


_ORDERS = """o as (select *, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as row_idx from orders)
select o_orderpriority as file, row_idx, 'price' as sensor, 'EUR' as unit, o_totalprice::double as value from o
union all select o_orderpriority, row_idx, 'customer', '-', case when o_custkey % 7 = 0 then null else o_custkey::double end from o"""


@query(f"with {_ORDERS}")
def workbook_round_trip(spark, d):
    """A workbook for each priority, stored and read back: names, units, gaps."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").withColumn("row_idx", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")) - 1)
    gap = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("double"))
    price = F.struct(F.lit("price").alias("sensor"), F.lit("EUR").alias("unit"), F.col("o_totalprice").cast("double").alias("value"))
    both = F.explode(F.array(price, F.struct(F.lit("customer").alias("sensor"), F.lit("-").alias("unit"), gap.alias("value")))).alias("s")
    path = scratch(spark, "workbooks")
    logs.workbooks(o.select(F.col("o_orderpriority").alias("file"), "row_idx", both).select("file", "row_idx", "s.*")).write.parquet(path)
    return logs.parsed(spark.read.parquet(path)).drop("sheet")


@query("""with c as (select *, row_number() over (partition by c_mktsegment order by c_custkey) - 1 as row_idx from customer)
select c_mktsegment as file, row_idx, 'balance' as sensor, 'USD' as unit, c_acctbal::double as value from c
union all select c_mktsegment, row_idx, 'nation' || length(c_mktsegment), 'key, ' || length(c_mktsegment), case when c_custkey % 5 = 0 then null else c_nationkey::double end from c""")
def many_logs(spark, d):
    """CSV logs with columns and units of their own (some quoted, a repeated name, cells that are no numbers), read in one scan."""
    c = table(spark, d, "customer").withColumnRenamed("c_mktsegment", "log")
    n = F.length("log")
    names = F.concat(F.lit("balance,nation"), n, F.lit(",balance,"))
    units = F.concat(F.lit('USD,"key, '), n, F.lit('",-,-'))
    heads = c.select("log").distinct().select("log", F.explode(F.array(F.struct(F.lit(-2).alias("ord"), names.alias("value")), F.struct(F.lit(-1).alias("ord"), units.alias("value")))).alias("x")).select("log", "x.*")
    cell = F.when(F.col("c_custkey") % 5 == 0, "bad").otherwise(F.col("c_nationkey").cast("string"))
    lines = c.select("log", F.col("c_custkey").cast("int").alias("ord"), F.concat_ws(",", F.col("c_acctbal").cast("string"), cell, F.lit("0"), F.lit("1")).alias("value"))
    path = scratch(spark, "logs")
    heads.union(lines).repartition("log").sortWithinPartitions("log", "ord").select("log", "value").write.partitionBy("log").text(path)
    return logs.csv_logs(spark, path).withColumn("file", F.regexp_extract("file", "log=([A-Z]+)", 1))


def _index(spark, d):
    """An index built in two batches, the second of which has part of the first again, with a tenth deleted and added back."""
    v = _vectors(spark, d)
    index = VectorIndex.create(v.where("id % 3 <> 0"), scratch(spark, "index"), lists=32)
    index.add(v.where("id % 2 = 0 or id % 3 = 0"))
    index.delete(v.where("id % 10 = 0").select("id"))
    index.add(v.where("id % 10 = 0"))
    return index, v.where("id % 100 = 0").withColumnRenamed("id", "query_id")


@query(f"with {_DOTS} select * from (select query_id, id, raw_score, row_number() over (partition by query_id order by raw_score desc, id)::int as rank from s) where rank <= 10")
def index_search_exact(spark, d):
    """Search of all lists of a stored index: the same rows as ``vector_search``."""
    index, queries = _index(spark, d)
    return index.search(queries, 10, probes=None)


@query(f"with {_DOTS} select true as reached, count(*) as n from (select row_number() over (partition by query_id order by raw_score desc, id) as rank from s) where rank <= 10")
def index_recall(spark, d):
    """Whether a search of as many of 32 lists as ``probes_for`` asks for has a recall at 10 of 0.9 or more."""
    index, queries = _index(spark, d)
    found = index.search(queries, 10, probes=index.probes_for(0.95)).select("query_id", "id", F.lit(1).alias("hit"))
    true = vector_topk(_vectors(spark, d), queries, 10).select("query_id", "id")
    return true.join(found, ["query_id", "id"], "left").agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("reached"), F.count("*").alias("n"))


@query(f"""with recursive n as (select p_partkey as id, case p_partkey % 3 when 0 then p_type else left(p_type, 2) || substring(p_type, 3 + p_partkey % 3) end as label from part),
vo as (select distinct lower(label) as word from n), {_ratio("select word from vo")},
r(word, other) as (select word, word from vo union select r.word, l.match from r join lcs l on l.word = r.other where l.ratio >= 80),
e as (select word, min(other) as entity from r group by 1)
select id, label, entity from n join e on word = lower(label)""")
def similar_entities(spark, d):
    """Types of parts, with no, one or two letters left out, and the entity that each comes to: those that are nearly equal are one."""
    at = F.col("p_partkey") % 3
    label = F.when(at == 0, F.col("p_type")).otherwise(F.concat(F.expr("left(p_type, 2)"), F.expr("substring(p_type, cast(3 + p_partkey % 3 as int))")))
    return modularity.similar_entities(table(spark, d, "part").select(F.col("p_partkey").alias("id"), label.alias("label")), 80.0)


_DIMS = 64


@query(f"""with v as (select vec_id, i, case when (vec_id + i) % 7 = 0 then null else embedding[i]::double end as x from embeddings, range(1, {_DIMS} + 1) r(i)),
p as (select 'd' || a.i as sensor_a, 'd' || b.i as sensor_b, a.x as x, b.x as y from v a join v b using (vec_id))
select sensor_a, sensor_b, count(*) filter (where x is not null and y is not null) as n, round(case when sensor_a = sensor_b then 1 else corr(x, y) end, 6)::double as r from p group by 1, 2""")
def wide_correlations(spark, d):
    """Dimensions as the sensors of a wide log, with a gap in every seventh cell."""
    cell = lambda i: F.when((F.col("vec_id") + i) % 7 != 0, F.col("embedding")[i - 1].cast("double"))
    rows = table(spark, d, "embeddings").select(*[cell(i).alias(f"d{i}") for i in range(1, _DIMS + 1)])
    return profiling.blocked_correlations(rows, rows.columns, block=24).withColumn("r", F.round("r", 6))


#: Start nodes of the sampled betweenness, and levels that its SQL spells out (the graph has fewer).
_SOURCES, _LEVELS = 8, 8


def _levels_sql(sources: int | None) -> str:
    """CTEs of betweenness from so many sources, or all: levels outwards, shares of paths back, flow of each link."""
    some = f" order by md5(v), v limit {sources}" if sources is not None else ""
    out = [f"""ed as (select distinct 's' || l_suppkey as u, 'p' || l_partkey as v from lineitem), li as (select u as v, v as w from ed union all select v, u from ed), ids as (select distinct v from li),
l0 as (select v as s, v, 1.0::double as n from (select v from ids{some})), seen0 as (select s, v from l0)"""]
    for k in range(1, _LEVELS):
        out.append(f"l{k} as (select l.s, li.w as v, sum(n) as n from l{k - 1} l join li using (v) where not exists (select 1 from seen{k - 1} z where z.s = l.s and z.v = li.w) group by 1, 2), seen{k} as (select * from seen{k - 1} union all select s, v from l{k})")
    out.append(f"d{_LEVELS - 1} as (select s, v, n, 0.0::double as share from l{_LEVELS - 1})")
    for k in range(_LEVELS - 2, -1, -1):
        out.append(f"f{k} as (select l.s, l.v, li.w, l.n * (1 + d.share) / d.n as flow from l{k} l join li using (v) join d{k + 1} d on d.s = l.s and d.v = li.w), d{k} as (select l.s, l.v, l.n, coalesce(x.share, 0) as share from l{k} l left join (select s, v, sum(flow) as share from f{k} group by 1, 2) x using (s, v))")
    flows = " union all ".join(f"select v, w, flow from f{k}" for k in range(_LEVELS - 1))
    out.append(f"fl as ({flows} union all select u, v, 0 from ed), bt as (select least(v, w) as a, greatest(v, w) as b, sum(flow) * (select count(*) from ids) / (select count(*) from l0) / 2 as score from fl group by 1, 2)")
    return ",\n".join(out)


def _supplies(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    ids = lambda c, name, p: table(spark, d, name).select(F.concat(F.lit(p), c).alias("id"), (F.col(c) % 5).cast("int").alias("community"))
    return ids("s_suppkey", "supplier", "s").union(ids("p_partkey", "part", "p")), e


@query(f"with {_levels_sql(_SOURCES)} select a, b, round(score, 4) as score from bt")
def edge_betweenness(spark, d):
    """Which supplies the shortest paths between suppliers and parts need, from a few sources."""
    return rounded(graph.betweenness(_supplies(spark, d)[1], _SOURCES), 4)


@query(f"with {_levels_sql(None)}, c as (select 's' || s_suppkey as id, (s_suppkey % 5)::int as community from supplier union all select 'p' || p_partkey, (p_partkey % 5)::int from part) select a as source, b as target, x.community as from_community, y.community as to_community, round(score, 4) as score from bt join c x on x.id = a join c y on y.id = b where x.community <> y.community")
def surprising_connections(spark, d):
    """Supplies between communities, all of them, by the shortest paths of all suppliers and parts."""
    return rounded(graph.surprising(*_supplies(spark, d)), 4)
