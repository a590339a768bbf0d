"""Formulas at their bounds, operators on small tables, and the whole plan on a small graph."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from torqueline import cli, presets
from torqueline.functions import scores as S
from torqueline.functions import similarity
from torqueline.functions import text as T
from torqueline.operators import decision, evaluate, graph, legacy, preprocess, profiling, retrieval, validation
from torqueline.plans import diagnosis
from torqueline.sources import readers, sinks
from torqueline.streaming import monitor

DUMP = """## ABS System
  ### Brake Hose
    - SYMPTOM: Soft brake pedal
    - SYMPTOM: Brake fluid leak
    - STEP: Inspect brake hose  [Cracked / Intact]
## Liquid Systems
  ### Brake Fluid
    - SYMPTOM: Soft brake pedal
    - STEP: Check brake fluid level  [Low / Normal]
## Engine Components
  ### Ignition Coil
    - SYMPTOM: Engine misfires
    - STEP: Test ignition coil  [Weak spark / Good spark]
  ### Fuel Injector
    - SYMPTOM: Engine misfires
    - SYMPTOM: Poor fuel economy
    - STEP: Test fuel injector  [Clogged / Clean]
## Fuel System
  ### Fuel Injector
    - SYMPTOM: Poor fuel economy
    - STEP: Test fuel injector  [Clogged / Clean]
"""


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("d") / "dump.txt"
    path.write_text(DUMP)
    return readers.dump_records(spark, str(path)).cache()


@pytest.fixture(scope="module")
def kb(records):
    return diagnosis.KnowledgeBase.from_records(records)


@pytest.mark.parametrize(("raw", "want"), [(0, 0), (-0.1, 0), (0.275, 0.5), (0.55, 1), (0.80, 1), (0.055, 0.1)])
def test_calibrated(spark, raw, want):
    assert value(spark, S.calibrated(F.lit(float(raw)))) == pytest.approx(want)


@pytest.mark.parametrize(("scores", "want"), [([0.5], 1), ([], 0), ([0.5, 0.3], 0.4), ([0.4, 0.4, 0.4], 0), ([0.0, 0.0], 0), ([0.3, -0.1], 1)])
def test_separation(spark, scores, want):
    assert value(spark, S.separation(F.array(*map(F.lit, scores)).cast("array<double>"))) == pytest.approx(want)


@pytest.mark.parametrize(("original", "matched", "want"), [(["a", "b", "c"], ["a", "b", "c"], 1), (["a", "b", "c"], ["b"], 1 / 3), (["a"], [], 0), ([], ["a"], 0), ([" Brake "], ["brake"], 1), (["idle,"], ["idle"], 0)])
def test_coverage(spark, original, matched, want):
    array = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    assert value(spark, S.coverage(array(original), array(matched))) == pytest.approx(want)


@pytest.mark.parametrize(("conf", "want"), [(0.699, 0), (0.70, 0.035), (0.9, 0.045), (1.0, 0.05)])
def test_sensor_boost(spark, conf, want):
    assert value(spark, S.sensor_boost(F.lit(conf))) == pytest.approx(want)


def test_confidence_and_mode(spark):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    assert value(spark, S.confidence(*lit(1, 1, 1, 0.05))) == 1.0 and value(spark, S.confidence(*lit(0, 0, 0, 0))) == 0.0
    assert value(spark, S.confidence(*lit(0.5 / 0.55, 0.6, 1, 0))) >= 0.75
    assert [value(spark, S.mode(F.lit(x))) for x in (0.30, 0.299, -0.1)] == ["EXTRACTED", "AMBIGUOUS", "AMBIGUOUS"]
    band = lambda c, m: value(spark, S.in_band(F.lit(c), F.lit(m)))
    assert band(0.30, "EXTRACTED") and not band(0.30, "AMBIGUOUS") and not band(-0.1, "AMBIGUOUS") and band(1.0, "EXTRACTED")


def test_sensor_formulas(spark):
    lit = F.lit
    assert value(spark, S.z_score(lit(3.0), lit(1.0), lit(0.0))) == 0 and value(spark, S.z_score(lit(3.0), lit(1.0), lit(2.0))) == 1
    assert value(spark, S.signed_change(lit(1.0), lit(-2.0))) == -150 and value(spark, S.absolute_change(lit(1.0), lit(-2.0))) == 150
    assert value(spark, S.signed_change(lit(1.0), lit(0.0))) == 0 and value(spark, S.absolute_change(lit(1.0), lit(0.0))) is None
    assert value(spark, S.similarity(lit(10.0), lit(10.0), lit(9.0))) == 1 and value(spark, S.similarity(lit(10.5), lit(10.0), lit(9.0))) == 0.368
    status = lambda z, p, s: value(spark, S.sensor_status(lit(z), lit(p), lit(s)))
    assert [status(5.0, 0.0, 0.9), status(-3.0, 0.0, 0.7), status(0.0, -10.0, 0.0), status(9.0, 9.9, 0.6)] == ["CRITICAL", "WARNING", "WARNING", "NORMAL"]
    assert [value(spark, S.describe_z(lit(float(z)))) for z in (-4, 3, 2, 1)] == ["far outside", "well outside", "outside", "at the edge of"]


def test_stemmers(spark):
    stem = lambda f, w: value(spark, F.expr(f(f"'{w}'")))
    assert [stem(T.retrieval_stem, w) for w in ("abs", "acceleration", "leaks", "brakes", "glass", "cooling", "sensors")] == ["abs", "acceler", "leak", "brak", "glas", "cool", "sensor"]
    assert [stem(T.query_stem, w) for w in ("acceleration", "starting", "leaks", "fitness", "brakes")] == ["accelerat", "start", "leak", "fitnes", "brak"]
    assert [stem(T.mapper_stem, w) for w in ("consumption", "knocking", "misfires", "ping")] == ["consump", "knock", "misfire", "p"]


def test_text_functions(spark):
    ev = lambda x: value(spark, F.expr(x))
    assert ev(T.normalized_label("'  Engine knocking/pinging, é! '")) == "engine knocking pinging é"
    assert ev(T.slug("'A/C  System!'")) == "a_c_system" and ev(T.node_id("cat", "'ABS System'")).startswith("cat_abs_system_")
    assert [ev(T.intent(f"'{q}'")) for q in ("P0301 found", "Error: 42", "noisy?", "why so", "leaks oil")] == ["error_code", "error_code", "question", "question", "symptom_report"]
    assert ev(T.error_codes("'p0301 and P0301, code 77'")) == ["P0301", "77"]
    assert ev(T.clean_category("'Engine Components.Md'")) == "Engine Components" and ev(T.title("'wheels & tires.md'")) == "Wheels & Tires.Md"


def test_label_matching(spark):
    labels = spark.createDataFrame([("Engine Knocking/Pinging",), ("Coolant leaks under the vehicle",), ("misfire in engine",), ("zzz",)], "label string")
    got = {r.label: (r.anchor, round(r.match, 3)) for r in decision.label_faults(labels, decision.anchors(spark)).collect()}
    assert got == {"Engine Knocking/Pinging": ("engine knocking/pinging", 1.0), "misfire in engine": ("engine misfires", 1.0)}
    cats = spark.createDataFrame([("Fuel System.Md",), ("",), ("Engine",), ("Steering",), (None,)], "category string")
    got = {}
    for r in decision.category_faults(cats).collect():
        got.setdefault(r.category, []).append(r.fault)
    assert got["Fuel System.Md"] == ["FAULT_INJ_PRS", "FAULT_INJ_DUR"] and len(got[""]) == len(got["Engine"]) == 3 and "Steering" not in got


def test_indel_and_fuzzy(spark):
    assert similarity.indel("brke", "brake") == pytest.approx(800 / 9) and similarity.indel("tide", "diet") == 50 and similarity.indel("", "") == 100
    words, vocabulary = spark.createDataFrame([("brke",), ("xyzzy",), ("pedel",)], "word string"), spark.createDataFrame([("brake",), ("pedal",), ("engine",)], "word string")
    assert [tuple(r)[:2] for r in preprocess.fuzzy_matches(words, vocabulary).collect()] == [("brke", "brake")]
    q = spark.createDataFrame([(0, "My brke, is BRAKE ok"), (1, "")], "query_id long, text string")
    assert {r.query_id: r.processed for r in preprocess.corrected(q, vocabulary).collect()} == {0: "My brake is BRAKE ok", 1: ""}


def test_t_tail():
    assert similarity.t_tail(0.0, 5.0) == pytest.approx(1.0) and similarity.t_tail(2.0, 10.0) == pytest.approx(0.07338803, abs=1e-8)
    assert similarity.t_tail(1.0, 1.0) == pytest.approx(0.5) and similarity.t_tail(50.0, 100.0) < 1e-60 and math.isfinite(similarity.t_tail(1e6, 1e4))


def test_vector_topk(spark):
    rows = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    (similarity.QUERY_ROWS, similarity.VECTOR_ROWS), old = (2, 3), (similarity.QUERY_ROWS, similarity.VECTOR_ROWS)
    try:
        got = similarity.vector_topk(v, v.where("id < 5").withColumnRenamed("id", "query_id"), 4).collect()
    finally:
        similarity.QUERY_ROWS, similarity.VECTOR_ROWS = old
    for q in range(5):
        want = sorted(((-sum(a * b for a, b in zip(rows[q][1], x, strict=True)), i) for i, x in rows))[:4]
        assert [(r.rank, r.id, r.raw_score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert similarity.vector_topk(v, v.limit(0).withColumnRenamed("id", "query_id"), 4).count() == 0


def test_vector_topk_near_copies(spark):
    v = spark.createDataFrame([(i, [1.0 + i * 1e-7]) for i in range(30)] + [(50, [0.5])], "id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(0, [1.0])], "query_id long, embedding array<double>")
    assert [(r.rank, r.id, r.raw_score) for r in similarity.vector_topk(v, q, 4).orderBy("rank").collect()] == [(i + 1, i, 1.0) for i in range(4)]
    variants = q.withColumn("variant_id", F.lit(7).cast("long"))
    assert [r.id for r in similarity.multi_query_topk(v, variants, 4).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_rounding_agrees_with_the_engine(spark):
    x = [0.00005, 0.00015, -0.00005, 1.00005, 2.67485, -2.67485, 0.1 + 0.2, 1234.56785, 0.99995, 1e-9, -1e-9, 0.0, 3e17, 123456789.00005]
    want = [r.y for r in spark.createDataFrame([(a,) for a in x], "x double").select(F.round("x", 4).alias("y")).collect()]
    assert similarity.rounded_half_up(np.array(x), 4).tolist() == want


def test_cleaning(spark):
    rows = [("a", i, x) for i, x in enumerate([None, 1.0, None, None, 4.0, float("nan"), None])] + [("b", i, 7.0) for i in range(4)] + [("c", i, None) for i in range(3)]
    r = profiling.cleaned(spark.createDataFrame(rows, "sensor string, row_idx int, value double"), ["sensor"])
    assert [x.value for x in r.orderBy("row_idx").collect()] == [None, 1.0, 2.0, 3.0, 4.0, 4.0, 4.0]


def test_statistics_bounds(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 5.0), ("c", None)], "sensor string, value double")
    p = {r.sensor: r for r in profiling.profile(rows, ["sensor"]).collect()}
    assert p["a"].skewness is None and p["a"].median == 1.5 and p["b"].variance == 0 and "c" not in p
    h = {(r.sensor, r.bin): r.n for r in profiling.histogram(rows, ["sensor"]).collect()}
    assert h == {("a", 1): 1, ("a", 40): 1, ("b", 1): 2}
    report = profiling.dataset_report(spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")).first()
    assert tuple(report) == (3, 2, 2, 1, 1)
    assert sinks.report_text(profiling.dataset_report(rows.limit(0))).first().value.startswith("Rows               : 0")


def test_comparison_and_selection(spark):
    rows = [(1000, c, s, m + d * (i % 5 - 2)) for c, m, d in (("NOMINAL", 10.0, 1.0), ("FAULT", 14.0, 1.0)) for s in ("x", "y", "time") for i in range(50)]
    b = diagnosis.sensor_batch(spark.createDataFrame([(a, c, i, s, v if s != "y" else v * 0 + i % 7) for i, (a, c, s, v) in enumerate(rows)], "speed int, condition string, row_idx int, sensor string, value double"))
    c = {r.sensor: r for r in b["comparisons"].collect()}
    assert c["x"].effect_size < 0 < c["x"].percent_change and c["x"].p_value < 1e-12 and c["x"].importance_score == pytest.approx(c["time"].importance_score)
    m = b["mapping"].collect()
    assert [(r.sensor, r.rank) for r in m] == [("x", 1)]
    assert json.loads(sinks.mapping_json(b["mapping"]).first().json)["FAULT"]["1000"]["sensors"][0]["sensor"] == "x"
    assert "x" in json.loads(sinks.profile_json(b["profiles"].where("condition = 'FAULT'")).first().json)


def test_validation(spark):
    profiles = spark.createDataFrame([(1000, c, s, m, 1.0) for c, m in (("NOMINAL", 100.0), ("F1", 110.0), ("F2", 100.0)) for s in ("x", "y")], "speed int, condition string, sensor string, mean double, std double")
    mapping = spark.createDataFrame([(f, 1000, i + 1, s, 0.9) for f in ("F1", "F2", "F3") for i, s in enumerate("xyz")], "fault string, speed int, rank int, sensor string, importance_score double")
    sample = spark.createDataFrame([(0, 1000, "x", 110.0), (0, 1000, "y", 100.0)], "sample_id int, speed int, sensor string, value double")
    signals = validation.signals(mapping, sample, profiles)
    r = {x.fault: x for x in validation.fault_results(signals).collect()}
    assert r["F1"].critical == ["x"] and r["F1"].normal == ["y"] and r["F1"].num_sensors_checked == 2 and "F3" not in r
    mapped = spark.createDataFrame([(0, 1, "c", "l", "F1", 1.0, "s", "t"), (0, 2, "c", "l", "F2", 1.0, "s", "t"), (0, 3, "c", "l", "F3", 1.0, "s", "t")], "query_id long, ord int, kg_category string, label string, fault_code string, kg_score double, source string, node_type string")
    res = validation.candidate_faults(mapped, validation.fault_results(signals))
    status = {x.fault: (x.sensor_status, x.sensor_confidence) for x in validation.contradiction(res).collect()}
    assert status["F1"][0] == "Supported" and status["F3"] == ("Contradicted", 0.0)
    words = spark.createDataFrame([("x", "Sensor X", "A thing", "s", "u")], "sensor string, display_name string, description string, subsystem string, units string")
    text = validation.interpretations(signals, words, mapping.withColumn("effect_size", F.lit(2.0)), mapping.select("fault", "speed", "sensor", F.lit(2.0).alias("effect_size"))).where("fault = 'F1'").first()
    assert "far outside" in text.abnormality and "primary" in text.relevance and text.contribution.startswith("Strongly confirms") and text.display_name == "Sensor X"


def test_graph_build(records):
    nodes, edges = graph.build(records)
    kinds = {r.relation: r["count"] for r in edges.groupBy("relation").count().collect()}
    assert nodes.count() == 4 + 4 + 4 + 4 and kinds == {"HAS_SUBCATEGORY": 5, "HAS_SYMPTOM": 6, "HAS_DIAGNOSIS_STEP": 4, "SIMILAR_SYMPTOM_TO": 2}
    loop = edges.where("source = target").collect()
    assert len(loop) == 1 and loop[0].label == "Poor fuel economy"
    deg = {r.id: r.degree for r in graph.degrees(edges).collect()}
    assert deg[loop[0].source] == 2 + 3 + 2
    norm = graph.normalized(nodes, records)
    assert {r.node_type for r in norm.collect()} == {"Category", "Subcategory", "Symptom", "DiagnosisStep"}
    assert norm.where("label = 'Soft brake pedal'").first().category == "Liquid Systems"


def test_graph_walks(spark):
    edges = spark.createDataFrame([("a", "b", "R", 1.0, 0), ("b", "c", "R", 1.0, 1), ("c", "a", "R", 1.0, 2), ("x", "c", "R", 1.0, 3)], "source string, target string, relation string, weight double, ord int")
    seeds = spark.createDataFrame([(1, "a"), (2, "c")], "query_id long, id string")
    got = {(r.query_id, r.id): r.hop for r in graph.bfs(edges, seeds, 2).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (2, "c"): 0, (2, "a"): 1, (2, "b"): 2}
    nodes = spark.createDataFrame([(i, i, "k", j) for j, i in enumerate("abcx")], "id string, label string, node_type string, ord int")
    assert graph.communities(nodes, edges, 2).count() == 4
    kept, moved = graph.merged_entities(spark.createDataFrame([("s_1", "A"), ("s_2", "a "), ("s_3", "b")], "id string, label string"), spark.createDataFrame([("s_2", "s_3"), ("s_1", "s_3")], "source string, target string"))
    assert kept.count() == 2 and [tuple(r) for r in moved.collect()] == [("s_1", "s_3")]


def test_communities_settle(spark):
    """A path of 30 nodes is in mid-spread after 8 rounds; a pair and a star of equal weights alternate."""
    path = [(f"p{i:02}", f"p{i + 1:02}") for i in range(29)]
    names = [f"p{i:02}" for i in range(30)] + ["x", "y", "s", "t", "u", "alone"]
    nodes = spark.createDataFrame([(n,) for n in names], "id string")
    edges = spark.createDataFrame([(a, b, "R", 1.0) for a, b in [*path, ("x", "y"), ("s", "t"), ("s", "u")]], "source string, target string, relation string, weight double")
    label, near = {n: n for n in names}, {n: [] for n in names}
    for a, b in [*path, ("x", "y"), ("s", "t"), ("s", "u")]:
        near[a].append(b), near[b].append(a)
    states = [label]
    while states[-1] not in states[:-1]:
        label = {n: max(((sum(states[-1][o] == k for o in near[n]), k) for k in {states[-1][o] for o in near[n]}), default=(0, states[-1][n]))[1] for n in names}
        states.append(label)
    assert len(states) > 10 and states[-1] in states[-3:-1]
    want = {n: min(states[-1][n], states[-2][n]) for n in names}
    got = {r.id: r.community for r in graph.communities(nodes, edges).collect()}
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in names for b in names)


def test_quality(records, kb):
    row = graph.scorecard(records, kb.nodes, kb.edges).first()
    assert row.category_coverage and row.step_coverage and not row.communities and row.verdict in ("good", "acceptable", "needs work")
    assert graph.duplicate_labels(kb.nodes).count() == 0 and graph.field_coverage(kb.nodes).where("field = 'id'").first().share == 1.0


def test_fusion_traps(spark):
    def path(rows):
        return retrieval.min_max(spark.createDataFrame([(1, i, s, k + 1) for k, (i, s) in enumerate(rows)], "query_id long, id string, raw_score double, rank int"), ["query_id"])

    m = {r.id: r for r in retrieval.merged(path([("v", 0.9), ("w", 0.5)]), path([("g", 0.4), ("v", 0.1)]), path([("c", 0.7)])).withColumn("s", retrieval.fused_score()).collect()}
    assert (m["v"].s, m["w"].s, m["g"].s, m["c"].s) == (0.55, 0.0, 0.8, 0.0) and m["v"].source == "vector+graph" and m["c"].found_by == ["community"]


def test_stem_dedup(spark):
    rows = spark.createDataFrame([(1, "a", "leaking pump", 0.5, 1), (1, "b", "pumps leak", 0.7, 2), (1, "c", "ok", 0.9, 3), (1, "d", "no", 0.8, 4)], "query_id long, id string, label string, score double, ord int")
    assert [r.id for r in retrieval.stem_dedup(rows, 10).orderBy("rank").collect()] == ["c", "b"]


def test_entities_and_variants(spark, kb):
    q = spark.createDataFrame([(0, "soft brake pedal abs"), (1, "zzz")], "query_id long, text string")
    pre, strong = preprocess.preprocessed(q, kb.nodes, kb.edges)
    rows = {r.query_id: r for r in pre.collect()}
    assert rows[0].entities[0].label == "Soft brake pedal" and "soft brake pedal abs system" in rows[0].expanded_queries and rows[0].expected_sensors
    assert rows[1].entities == [] and rows[1].communities == [] and strong.where("query_id = 1").count() == 0


def test_diagnose(spark, kb):
    out = diagnosis.diagnose(readers.queries(spark, ["Soft brake pedal", "engine misfires, poor fuel economy", "zzz qqq"]), kb)
    reports = {r.query_id: r for r in out["report"].collect()}
    assert reports[0].mode == "EXTRACTED" and reports[0].top_label == "Soft brake pedal" and reports[0].inspection_steps == ["Check brake fluid level"]
    assert "**Diagnosis:** Soft brake pedal" in reports[0].diagnosis_summary and reports[1].fault == "FAULT_INJ_PRS"
    for r in reports.values():
        steps = [s.step for s in r.reasoning_chain]
        assert len(steps) == (6 if r.mode == "AMBIGUOUS" else 5) and steps[0] == "Query Analysis" and all(json.loads(s.metrics) is not None for s in r.reasoning_chain)
        assert 0 <= r.confidence <= 1 and len(r.display_candidates or []) <= 5
    assert json.loads(sinks.report_json(out["report"]).where("query_id = 0").first().json)["mode"] == "EXTRACTED"
    with pytest.raises(ValueError):
        readers.queries(spark, [" "])
    assert diagnosis.refine(spark.createDataFrame([(0, "a")], "query_id long, text string"), "b").first().text == "a, b"


def test_report_with_sensors(spark, kb):
    """A sample that is abnormal where the mapped fault's sensors are gives evidence, detail and texts; a vague query gets guidance."""
    stats = "mean double, std double"
    profiles = spark.createDataFrame([(1000, "NOMINAL", "rail", 10.0, 1.0), (1000, "FAULT_INJ_PRS", "rail", 20.0, 1.0), (1000, "NOMINAL", "map", 5.0, 1.0), (1000, "FAULT_INJ_PRS", "map", 5.1, 1.0)], f"speed int, condition string, sensor string, {stats}")
    mapping = spark.createDataFrame([("FAULT_INJ_PRS", 1000, 1, "rail", 0.9, 2.0), ("FAULT_INJ_PRS", 1000, 2, "map", 0.3, 1.0)], "fault string, speed int, rank int, sensor string, importance_score double, effect_size double")
    names = spark.createDataFrame([("rail", "Rail pressure", "pressure in the rail", "fuel", "bar")], "sensor string, display_name string, description string, subsystem string, units string")
    sample = spark.createDataFrame([(1000, "rail", 20.0), (1000, "map", 5.0)], "speed int, sensor string, value double")
    out = diagnosis.diagnose(readers.queries(spark, ["engine misfires, poor fuel economy", "?? !!"]), kb, mapping, profiles, sample, dictionary=names, compared=mapping)
    r = {x.query_id: x for x in out["report"].collect()}
    assert r[0].fault == "FAULT_INJ_PRS" and [(e.fault, e.status, e.critical, e.normal) for e in r[0].sensor_evidence if e.fault == "FAULT_INJ_PRS"] == [("FAULT_INJ_PRS", "Supported", ["rail"], ["map"])]
    assert r[0].mode == "EXTRACTED" and "Rail pressure (rail): CRITICAL — pressure in the rail" in r[0].diagnosis_summary and r[0].assisted_text is None
    assert r[0].context_chain[-1 - len(r[0].inspection_steps)] == r[0].top_label and r[0].mode_description.startswith("High-confidence")
    assert r[1].mode == "AMBIGUOUS" and 'Based on the symptoms "?? !!"' in r[1].assisted_text and decision.DISCLAIMER in r[1].assisted_text and r[1].diagnosis_summary == ""
    t = [x for x in out["interpretations"].collect() if x.severity == "CRITICAL"]
    assert [x.sensor for x in t] == ["rail"] and t[0].contribution.startswith("Strongly confirms") and "Effect size 2.00 sigma." in t[0].relevance
    shown = json.loads(sinks.report_json(out["report"]).where("query_id = 0").first().json)["sensor_evidence"]
    assert {e["fault"]: e["critical"] for e in shown}["FAULT_INJ_PRS"] == ["rail"]


def test_record_order(spark, kb):
    """Nodes and edges keep the order of their records: steps of a subcategory come as they were listed."""
    steps = [f"step {c}" for c in "zmaqb"]
    rows = [(0, "Cat", "Sub", ["s2", "s1"], [(x, ["ok", "bad"]) for x in steps]), (1, "Other", "Sub2", ["s1"], [(steps[2], ["ok", "bad"])])]
    own = diagnosis.KnowledgeBase.from_records(spark.createDataFrame(rows, "ord int, category string, subcategory string, symptoms array<string>, diagnosis_steps array<struct<step: string, result: array<string>>>"))
    assert {r.subcategory: r.inspection_steps for r in decision.inspection_steps(own.nodes, own.edges).collect()} == {"Sub": steps, "Sub2": [steps[2]]}
    kids = {r.id: r for r in graph.children(own.nodes, own.edges).collect()}
    sub = own.nodes.where("label = 'Sub'").first().id
    assert kids[sub].symptoms == ["s2", "s1"] and kids[sub].steps == steps
    assert graph.hierarchy(own.nodes, own.edges.where("relation like 'HAS%'")).where("id like 'sym_s1%'").first().subcategory == "Sub"


def test_three_mode_plan(spark, kb):
    q = readers.queries(spark, ["brake pedal", "zzz"])
    vector = diagnosis.vector_path(q.select("query_id", F.col("text").alias("processed"), F.array().cast("array<string>").alias("expanded_queries")), kb, 5)
    out = diagnosis.three_mode(q, vector, kb)
    assert out["overall"].count() == 2 and {r.kind for r in out["answers"].collect()} <= {"final", "intermediate", "question"}
    assert {r.kind for r in diagnosis.three_mode(q, vector, kb, skip=True)["answers"].collect()} <= {"final", "intermediate", "no_match"}


def test_own_encoder(spark, records):
    """An encoder in place of the hashing one serves nodes and queries alike."""
    encode = lambda df: df.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    own = diagnosis.KnowledgeBase.from_records(records, encode=encode)
    assert {tuple(r.embedding) for r in own.vectors.collect()} == {(1.0, 0.0)}
    v = diagnosis.vector_path(spark.createDataFrame([(0, "a", ["b"])], "query_id long, processed string, expanded_queries array<string>"), own, 2)
    assert {r.raw_score for r in v.collect()} == {1.0} and v.count() == min(2, own.vectors.count())


def test_command_line(spark, tmp_path, capsys):
    dump = tmp_path / "dump.txt"
    dump.write_text("## Fuel System\n  ### Poor fuel economy\n- SYMPTOM: engine misfires\n- STEP: Check injectors  [ok / bad]\n## Brakes\n  ### Soft pedal\n- SYMPTOM: soft brake pedal\n- STEP: Check fluid  [ok / low]\n")
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / readers.file_name("log", 1000, "FAULT_INJ_PRS")).write_text("rail,map\nbar,bar\n20,5\n20,5\n")
    (tmp_path / "profiles").mkdir()
    one = lambda m: {"count": 9, "mean": m, "std": 1.0, "variance": 1.0, "min": 0.0, "max": 1.0, "median": m, "q1": m, "q3": m, "iqr": 0.0, "skewness": 0.0, "kurtosis": 0.0}
    for kind, rail in (("NOMINAL", 10.0), ("FAULT_INJ_PRS", 20.0)):
        (tmp_path / "profiles" / readers.file_name("profile", 1000, kind)).write_text(json.dumps({"rail": one(rail), "map": one(5.0)}))
    sensors = [{"sensor": "rail", "importance_score": 0.9, "effect_size": 2.0, "percent_change": 100.0, "p_value": 0.0}]
    (tmp_path / "mapping.json").write_text(json.dumps({"FAULT_INJ_PRS": {"1000": {"speed": 1000, "fault": "FAULT_INJ_PRS", "top_k": 1, "sensors": sensors}}}))
    assert cli.main(["engine misfires", "--dump", str(dump), "--profiles", str(tmp_path / "profiles" / "*.json"), "--mapping", str(tmp_path / "mapping.json"), "--logs", str(tmp_path / "logs"), "--json"]) == 0
    report = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert report["mode"] == "EXTRACTED" and {e["fault"]: e["critical"] for e in report["sensor_evidence"]}["FAULT_INJ_PRS"] == ["rail"]
    assert cli.main(["?? !!", "--dump", str(dump), "--no-sensor", "--use-llm", "http://127.0.0.1:9"]) == 0
    assert decision.DISCLAIMER in capsys.readouterr().out


def test_log_reader_keeps_first_of_repeated_columns(spark, tmp_path):
    (tmp_path / "log.csv").write_text("t,rpm,rpm,p1,p1x\ns,1/min,-,bar,2\n0,1,2,3,4\n1,x,5,6,2\n")
    log, units = readers.log_csv(spark, str(tmp_path / "log.csv"))
    assert log.columns == ["t", "rpm", "p1", "p1x"] and units == {"t": "s", "rpm": "1/min", "p1": "bar", "p1x": "2"}
    assert sorted(map(tuple, log.collect())) == [(0.0, 1.0, 3.0, 4.0), (1.0, None, 6.0, 2.0)]
    (tmp_path / "empty.csv").write_text("")
    assert readers.log_csv(spark, str(tmp_path / "empty.csv"))[0].count() == 0


def test_quantiles_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", float(i % 7)) for i in range(50)] + [("b", 1.0)] + [("c", x) for x in (-inf, 1.0, 2.0, inf, nan)] + [("d", None), ("e", 1e308), ("e", -1e308), ("e", 5.0)]
    got = {r.sensor: r for r in profiling.quantiles(spark.createDataFrame(rows, "sensor string, value double"), ["sensor"]).collect()}
    assert got["a"].q == [1.0, 3.0, 5.0] and got["b"].q == [1.0] * 3 and "d" not in got
    assert got["c"].q == [1.0, 2.0, inf] and got["e"].q[1] == 5.0


def test_entry_without_the_optional_part(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "torqueline.llm", None)
    monkeypatch.delitem(sys.modules, "torqueline.llm.entry", raising=False)
    assert not [k for k in entry.queries() if k.startswith("op")] and "hybrid_fusion" in entry.queries()


def test_mapping_bonus(spark):
    rows = [(1, 1, "engine misfires", "Fuel System", 2.0, "all", "Symptom"), (1, 2, "odd", "Fuel System", 1.5, "all", "Symptom"), (1, 3, "odd", "Fuel System", 0.5, "all", "Symptom"), (1, 4, "odd", "Steering", 0.4, "all", "Symptom")]
    m = decision.map_faults(spark.createDataFrame(rows, "query_id long, rank int, label string, category string, score double, source string, node_type string")).orderBy("ord").collect()
    assert [(r.label, r.fault_code, r.mapping_type, r.mapping_confidence) for r in m] == [("engine misfires", "FAULT_INJ_PRS", "label", 1.0), ("odd", "FAULT_INJ_PRS", "category", 0.92), ("odd", "FAULT_INJ_DUR", "category", 0.72)]


def test_explanations(spark):
    s = value(spark, decision.brief_summary(F.lit("EXTRACTED"), F.lit("L"), F.lit("F")))
    assert s == "Diagnosis: L (F)" and value(spark, decision.brief_summary(F.lit("AMBIGUOUS"), F.lit(None).cast("string"), F.lit(""))) == "Insufficient evidence: Unknown"
    c = F.array(F.struct(F.lit("A").alias("label"), F.lit("vector").alias("source")))
    assert decision.DISCLAIMER in value(spark, decision.assisted_text(F.lit("noise"), c)) and "**A**" in value(spark, decision.assisted_text(F.lit("noise"), c))


def test_legacy(spark, kb):
    q = spark.createDataFrame([(0, "brake pedal")], "query_id long, text string")
    g = legacy.hop_scored_search(q, kb.nodes, kb.edges)
    assert g.where("hop = 0 and overlap = 2").first().raw_score == 1.2
    vec = g.select("query_id", "id", F.lit(0.5).alias("raw_score"), "rank").where("rank = 1")
    com = legacy.voted_community_search(vec, kb.nodes, kb.rollup)
    f = legacy.three_path_fusion(vec, g, com)
    assert f.where("rank = 1").first().score >= 1.0
    t = legacy.tagged(legacy.calibrate(f).withColumn("is_multi_category", F.lit("True")).join(kb.nodes.select("id", "label"), "id"))
    assert {r.tag for r in t.collect()} <= {"EXTRACTED", "INFERRED", "AMBIGUOUS"} and legacy.overall(t).count() == 1
    assert legacy.expand(f, kb.nodes).count() >= f.count()
    paths = legacy.reasoning_paths(q, t.withColumn("tag", F.lit("INFERRED")), graph.hierarchy(kb.nodes, kb.edges), graph.children(kb.nodes, kb.edges))
    assert paths.where("size(matched_symptoms) > 0").count() > 0 and legacy.answers(legacy.overall(t), paths).count() == 1
    fused = spark.createDataFrame([(0, 1, 0.9, "s"), (0, 2, 0.2, "t")], "query_id long, ord int, final_score double, system string")
    ev = spark.createDataFrame([(0, "CONFIRMS", "CONFIRMS")], "query_id long, sensor_status string, kg_status string")
    r = legacy.reasoned(fused, ev, spark.createDataFrame([(0, 3, 0)], "query_id long, n_matched int, n_missing int")).first()
    assert (r.evidence_quality, r.mode, r.confirmed, r.contradicted) == ("strong", "EXTRACTED", ["s"], ["t"]) and r.confidence == 1.0


def test_evaluation(spark):
    d = spark.createDataFrame([(i, c, "EXTRACTED" if c >= 0.3 else "AMBIGUOUS", "x") for i, c in enumerate((0.1, 0.4, 0.6, 0.8))], "query_id long, confidence double, mode string, system string")
    s = {r.mode: r for r in evaluate.mode_stats(d).collect()}
    assert s["EXTRACTED"].upper_median == 0.6 and evaluate.by_system(d).first().EXTRACTED == 3
    sweep = evaluate.threshold_sweep(d.withColumn("expected", F.col("confidence") > 0.5), [0.2, 0.5]).where("best").first()
    assert (sweep.threshold, sweep.correct) == (0.5, 4)
    assert evaluate.refinements(d.select("query_id", F.lit("t").alias("text")), list("abcde")).count() == 4 * 31
    pos = evaluate.expected_position(spark.createDataFrame([(0, "Engine stalls", 2)], "query_id long, label string, rank int"), spark.createDataFrame([(0, "stalls"), (1, "x")], "query_id long, expected_label string"))
    assert {r.query_id: r.position for r in pos.collect()} == {0: 2, 1: None}
    e = evaluate.refinement_effect(d.where("query_id = 0"), d.where("query_id > 0").withColumn("query_id", F.lit(0).cast("long"))).first()
    assert (e.improved, e.worsened, e.mode_changed) == (3, 0, 3)


def test_evaluation_plan(spark, kb):
    from torqueline.plans import evaluation, provider

    q = evaluation.query_set(spark)
    assert q.count() == 39 and q.where("query_type = 'partial'").count() == 2
    out = evaluation.evaluation(q.where("query_id < 4"), kb)
    assert out["decided"].count() == 4 and out["components"].count() == 16
    assert evaluation.spot_checks(spark, kb).count() == 7 and len(evaluation.REFINEMENT_SEEDS) == 4
    assert provider.assisted("s", [], "template") == "template" and not provider.HttpProvider("http://127.0.0.1:9", "m", 0.2).available()
    assert provider.assisted("s", [{"label": "a", "score": 1.0, "source": "x"}], "template", provider.HttpProvider("http://127.0.0.1:9", "m", 0.2, 0.2)) == "template"

    class Fixed:
        def generate(self, prompt, system=""):
            return "check " + prompt.splitlines()[2]

    assert provider.assisted("s", [{"label": "a", "score": 1.0, "source": "x"}], "t", Fixed()).startswith("check - a (score: 1.000")
    row = legacy.known_systems(spark.createDataFrame([("", None, "l")], "category string, subcategory string, label string")).first()
    assert (row.system, row.subsystem) == ("Unknown", "l")


def test_sources_and_sinks(spark, tmp_path, records, kb):
    (tmp_path / "log.csv").write_text("time,x\ns,bar\n0,1.5\n1,oops\n")
    rows, units = readers.log_csv(spark, str(tmp_path / "log.csv"))
    assert units == {"time": "s", "x": "bar"} and [r.x for r in rows.orderBy("time").collect()] == [1.5, None]
    (tmp_path / "1000_F_vs_NOMINAL.csv").write_text("Sensor,Effect\nx,1\n")
    assert [(r.speed, r.fault) for r in readers.comparison_csv(spark, str(tmp_path / "*_NOMINAL.csv")).collect()] == [(1000, "F")]
    (tmp_path / "r.json").write_bytes(b"\xef\xbb\xbf" + json.dumps([{"category": "c", "subcategory": "s", "symptoms": ["a"], "diagnosis_steps": [{"step": "t", "result": ["y", "n"]}]}]).encode())
    assert readers.fault_records(spark, str(tmp_path / "r.json")).first().diagnosis_steps[0].result == ["y", "n"]
    (tmp_path / "g.json").write_text(sinks.graph_json(kb.nodes.select("id", "label", "community"), kb.edges.select("source", "target", "relation")).first().json)
    n, e = readers.graph(spark, str(tmp_path / "g.json"))
    assert n.count() == kb.nodes.count() and e.count() == kb.edges.count() and readers.community_index(n)[2].count() > 0
    assert sinks.corpus_markdown(records).where("category = 'ABS System'").first().value.startswith("# ABS System\n\n## Brake Hose\n- Soft brake pedal")
    assert sinks.community_report(kb.rollup).count() == kb.rollup.count() and sinks.display_graph(kb.nodes, kb.edges)[0].count() == kb.nodes.count()
    sinks.parquet(kb.rollup, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == kb.rollup.count()


def test_stream(spark, tmp_path):
    profiles = spark.createDataFrame([(1, c, "x", m, 1.0) for c, m in (("NOMINAL", 100.0), ("F", 110.0))], "speed int, condition string, sensor string, mean double, std double")
    spark.sql("select timestamp'2024-01-01 00:00:05' as ts, 1 as speed, 'x' as sensor, 110.0D as value").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("ts timestamp, speed int, sensor string, value double").parquet(str(tmp_path / "in"))
    q = monitor.status_counts(monitor.statuses(live, profiles)).writeStream.outputMode("complete").format("memory").queryName("status_counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.fault, r.status, r.n) for r in spark.table("status_counts").collect()] == [("F", "CRITICAL", 1)]


def test_community_path_reads_hints(spark):
    from torqueline.plans import queries, queries_decision

    sf = "/root/testdata/sf0.001"
    n = queries._part_nodes(spark, sf)
    asked = queries_decision._path_queries(spark, sf).select("query_id", "text")
    hinted = {(r.query_id, c) for r in preprocess.hints(preprocess.strong_entities(preprocess.entities(asked, n))).collect() for c in r.communities}
    got = {(r.query_id, r.community) for r in queries_decision.community_path_search(spark, sf).collect()}
    assert got and got <= hinted and {c for _, c in got} - {1, 4, 7}


def test_presets():
    assert len(presets.ANCHORS) == 29 and len(presets.CATEGORY_FAULTS) == len(presets.CATEGORY_SENSORS) == 13 and presets.DEFAULTS.vector_weight + presets.DEFAULTS.graph_weight + presets.DEFAULTS.community_weight == pytest.approx(1)


def test_entry_points():
    import __spark_entry__ as e

    from torqueline.plans import queries

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 130
    assert set(queries.QUERIES) - set(queries.SQL) == {"label_propagation"}
