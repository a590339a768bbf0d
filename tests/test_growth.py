"""Work that must grow no faster than the tables: rows that the steps of a query make."""

import random

import pytest
from pyspark.sql import functions as F

from torqueline import runtime
from torqueline.functions.similarity import vector_topk
from torqueline.functions.vector_index import VectorIndex
from torqueline.operators import graph, modularity
from torqueline.plans.queries import QUERIES
from torqueline.sources import logs

from .test_scale import betweenness_of

PARTS = 3000


@pytest.fixture(scope="module")
def few_names(spark, tmp_path_factory):
    """Parts of two names, one brand and one community each, and what goes with them."""
    d = str(tmp_path_factory.mktemp("tables"))
    k = F.col("id")
    name = F.when(k % 2 == 0, "cold plate").otherwise("hot plate")
    part = spark.range(PARTS).select(k.alias("p_partkey"), name.alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.when(k % 9 == 0, "PROMO").otherwise("LARGE").alias("p_type"), F.lit(5).alias("p_size"), (k / 10).alias("p_retailprice"))
    part.write.parquet(f"{d}/part.parquet")
    spark.range(20).select((k * 100).alias("vec_id"), F.array((k / 20).cast("float"), F.lit(0.5).cast("float")).alias("embedding")).write.parquet(f"{d}/embeddings.parquet")
    spark.range(PARTS).select(k.alias("l_partkey"), (k % 40).alias("l_suppkey")).write.parquet(f"{d}/lineitem.parquet")
    spark.range(40).select(k.alias("s_suppkey"), F.concat(F.lit("S"), k).alias("s_name"), (k % 3).cast("int").alias("s_nationkey")).write.parquet(f"{d}/supplier.parquet")
    return d


def most_rows(spark, run):
    """The rows of the step that made most of them while ``run`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done, most = store.executionsList(), 0
    for i in range(before, done.size()):
        e = done.apply(i).executionId()
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for j in range(nodes.size()):
            metrics = nodes.apply(j).metrics()
            for m in (metrics.apply(x) for x in range(metrics.size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


@pytest.mark.parametrize("name", ["two_path_fusion", "hybrid_fusion"])
def test_queries_meet_the_first_of_their_name_alone(spark, few_names, name):
    assert PARTS <= most_rows(spark, lambda: QUERIES[name](spark, few_names).collect()) < 3 * PARTS


@pytest.mark.parametrize("name", ["graph_path_search", "hinted_graph_search", "hop_scored", "community_top3", "community_path_search", "community_expansion"])
def test_searches_ask_once_and_rank_first_members_alone(spark, few_names, name):
    assert PARTS <= most_rows(spark, lambda: QUERIES[name](spark, few_names).collect()) <= 4 * PARTS


def test_long_logs_take_several_workbooks(spark, monkeypatch):
    monkeypatch.setattr(logs, "WORKBOOK_ROWS", 4)
    rows = [("x", i, "t", "s", i / 2) for i in range(11) if i not in (4, 5, 6, 7)] + [("x", 9, "only late", "u", 1.0), ("y", 0, "t", None, 3.0)]
    made = logs.workbooks(spark.createDataFrame(rows, "file string, row_idx long, sensor string, unit string, value double"))
    assert sorted((r.file, r.first_row) for r in made.select("file", "first_row").collect()) == [("x", 0), ("x", 4), ("x", 8), ("y", 0)]
    got = {(r.file, r.row_idx, r.sensor): (r.unit, r.value) for r in logs.parsed(made).collect()}
    want = {("x", i, "t"): ("s", None if 4 <= i < 8 else i / 2) for i in range(11)} | {("x", i, "only late"): ("u", 1.0 if i == 9 else None) for i in range(11)}
    assert got == want | {("y", 0, "t"): ("", 3.0)}


def test_parents_of_equal_sets_are_paired_once(spark):
    shared = spark.range(200 * 40).select(F.concat(F.lit("p"), F.col("id") % 200).alias("parent_label"), F.floor(F.col("id") / 200).cast("string").alias("norm_label"))
    more = spark.createDataFrame([("q", "0"), ("q", "x"), ("r", "x"), ("s", "y"), (None, "x"), ("t", None)], shared.schema)
    found = []
    assert most_rows(spark, lambda: found.extend(map(tuple, graph.projected_similarity(shared.union(more)).collect()))) < 100000
    names = [f"p{i}" for i in range(200)]
    want = {(a, b) for a in names for b in names if a < b} | {(a, "q") for a in names} | {("q", "r")}
    assert len(found) == len(want) and set(found) == want


def test_every_leaf_of_large_stars_is_placed(spark):
    """What one leaf gains is below any bound on a round's gain, and there are more of them than levels."""
    edges = spark.range(60000).select(F.concat(F.lit("hub"), F.col("id") % 2).alias("source"), F.concat(F.lit("leaf"), "id").alias("target"))
    nodes = edges.select(F.col("source").alias("id")).distinct().union(edges.select("target"))
    assert modularity.partition(nodes, edges).select("community").distinct().count() == 2


def shuffled_rows(spark, run):
    """All rows that were shuffled while ``run`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done, total = store.executionsList(), 0
    for i in range(before, done.size()):
        e = done.apply(i).executionId()
        values = store.executionMetrics(e)
        ids = {m.accumulatorId() for m in (done.apply(i).metrics().apply(j) for j in range(done.apply(i).metrics().size())) if m.name() == "shuffle records written"}
        total += sum(int(values.apply(k).replace(",", "")) for k in ids if values.contains(k))
    return total


@pytest.fixture
def no_broadcasts(spark):
    """Joins are copied to the tasks only where the library says so."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_sources_shuffle_no_links(spark, no_broadcasts):
    """600 rings of ten nodes, paths from two of them: only the distinct links and nodes are shuffled."""
    k, ring = F.col("id"), F.floor(F.col("id") / 10) * 10
    edges = spark.range(6000).select(F.concat(F.lit("n"), k).alias("source"), F.concat(F.lit("n"), ring + (k + 1) % 10).alias("target"))
    found = []
    assert shuffled_rows(spark, lambda: found.extend(graph.betweenness(edges, 2).collect())) < 6000 * 6
    assert len(found) == 6000 and sum(r.score > 0 for r in found) in (10, 20)
    assert abs(sum(r.score for r in found) - 2 * 25 * 6000 / 2 / 2) < 1e-6


def test_shared_texts_shuffle_no_pairs(spark):
    """60 records that share 50 texts: rows are shuffled for each record and text and for each pair, not for each text of a pair."""
    k, text = F.col("id") % 60, F.floor(F.col("id") / 60).cast("string")
    leaf = spark.range(60 * 50).select(k.alias("ord"), F.lit(0).alias("at"), F.lit("sym").alias("kind"), F.concat(F.lit("c"), k).alias("category"), F.concat(F.lit("s"), k).alias("sub_id"), F.lit("f").alias("sub_file"), text.alias("text"))
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        found = []
        assert shuffled_rows(spark, lambda: found.extend(graph.similarity_edges(leaf).collect())) < 60 * 50 * 9
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert {(r.source, r.target) for r in found} == {(f"s{i}", f"s{j}") for i in range(60) for j in range(i + 1, 60)} and len(found) == 60 * 59 // 2


def test_few_queries_shuffle_no_vectors(spark, no_broadcasts, tmp_path):
    """Blocks of vectors stay where they are read; a search of all lists sends no query to each list by itself."""
    v = spark.range(4000).select("id", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("id") * i)).alias("embedding"))
    q = v.where("id % 4 = 0").withColumnRenamed("id", "query_id")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = vector_topk(v, q, 3)
    assert "SortMergeJoin" not in plan(found)
    index = VectorIndex.create(v, str(tmp_path / "index"), lists=16)
    got = index.search(q, 3, probes=None)
    assert "SortMergeJoin" not in plan(got)
    assert sorted(got.collect()) == sorted(found.collect()) and found.count() == 3000


@pytest.mark.parametrize("bounds", [{}, {"TASK_LINKS": 20}, {"TASK_WORK": 1000, "TASK_SOURCES": 3, "SMALL_LINKS": 5}, {"TASK_CELLS": 1}])
def test_surprising_links_come_from_all_sources(spark, monkeypatch, bounds):
    """More nodes than any sample of sources: scores are those of the paths of all of them, however the search is dealt."""
    rng = random.Random(7)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(110)] + [(f"m{i}", f"m{i + 1}") for i in range(5)] + [("x", "y"), ("y", "z"), ("x", "x")]
    for name, value in bounds.items():
        monkeypatch.setattr(graph, name, value)
    edges = spark.createDataFrame(pairs, "source string, target string")
    names = sorted({v for p in pairs for v in p})
    nodes = spark.createDataFrame([(v, k % 3) for k, v in enumerate(names)], "id string, community int")
    found = graph.surprising(nodes, edges).collect()
    want = {k: v for k, v in betweenness_of(pairs).items() if names.index(k[0]) % 3 != names.index(k[1]) % 3}
    assert len(names) > 64 and len(found) == len(want)
    assert all(abs(r.score - want[r.source, r.target]) < 1e-9 for r in found)


@pytest.mark.parametrize("rows", [1024, 5])
def test_shared_texts_are_sent_once_and_pairs_named_in_place(spark, no_broadcasts, monkeypatch, rows):
    """300 records, more than the few that a join used to copy: rows are shuffled a few times for each record and text, and no pair is; labels are those of the first text."""
    monkeypatch.setattr(graph, "COPIED_BYTES", 0)
    monkeypatch.setattr(runtime, "COPIED_BYTES", 0)
    monkeypatch.setattr(graph, "BLOCK_ROWS", rows)
    k, text = F.col("id") % 300, F.floor(F.col("id") / 300) + F.floor(F.col("id") % 300 / 60) * 100
    leaf = spark.range(300 * 10).select(k.alias("ord"), F.floor(F.col("id") / 300).cast("int").alias("at"), F.lit("sym").alias("kind"), (k % 7).cast("string").alias("category"), F.concat(F.lit("s"), k).alias("sub_id"), F.concat(F.lit("f"), k).alias("sub_file"), text.cast("string").alias("text"))
    found = []
    shuffled = shuffled_rows(spark, lambda: found.extend(graph.similarity_edges(leaf).select("source", "target").collect()))
    want = {(f"s{i}", f"s{j}") for g in range(5) for i in range(60 * g, 60 * g + 60) for j in range(i + 1, 60 * g + 60) if i % 7 != j % 7}
    assert set(map(tuple, found)) == want and len(found) == len(want)
    if rows > 60:
        assert shuffled < 300 * 10 * 5
    whole = graph.similarity_edges(leaf.union(leaf.limit(40))).collect()
    assert {(r.source, r.target) for r in whole} == want and len(whole) == len(want)
    assert {(int(r.source[1:]) // 60, r.source_file, r.label, r.seen.ord, r.seen.at, r.relation) for r in whole} == {(g, f"f{60 * g}", str(100 * g), 60 * g, 0, "SIMILAR_SYMPTOM_TO") for g in range(5)}


@pytest.mark.parametrize("copied", [None, 0])
def test_pairs_of_blocks_are_dealt_by_number(spark, no_broadcasts, monkeypatch, copied):
    """No exchange carries members by what they are, and a class's blocks meet once."""
    if copied is not None:
        monkeypatch.setattr(graph, "NAMES_BYTES", copied)
    kids = spark.range(400).select(F.concat(F.lit("p"), "id").alias("parent_label"), F.lit("all").alias("norm_label")).union(spark.createDataFrame([("q", "all"), ("q", "x"), ("r", "x")], "a string, b string"))
    made = graph.projected_similarity(kids)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any("xs#" in line or "ys#" in line for line in plan.splitlines() if "Exchange hashpartitioning(" in line)
    if copied is None:
        assert "SortMergeJoin" not in plan
    found = [tuple(r) for r in made.collect()]
    names = [f"p{i}" for i in range(400)]
    want = {(a, b) for a in names for b in names if a < b} | {(a, "q") for a in names} | {("q", "r")}
    assert len(found) == len(want) and set(found) == want
    assert graph.projected_similarity(kids.limit(0)).count() == 0
