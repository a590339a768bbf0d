"""Queries from scores and candidates to decisions, texts and evaluation, on the parts as candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import decision, evaluate, graph, legacy, preprocess, profiling, validation
from ..presets import ENTITY_WEIGHTS, GENERIC_SEED_WORDS, QUERY_STEM, RETRIEVAL_STEM, SYNONYMS, Settings
from .queries import _duck_stem, _part_nodes, _sql_list, readings
from .registry import query, rounded, table

_SCALE = "s as (select p_partkey as k, (p_retailprice - 900) / 40 as s, ['Supported', 'Contradicted', 'No Evidence', 'x'][p_partkey % 4 + 1] as status, ['CONFIRMS', 'CONTRADICTS', 'none'][p_partkey % 3 + 1] as sensor, ['CONFIRMS', 'none'][p_partkey % 2 + 1] as kg, p_size as z from part)"


def _scale(spark, d):
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_partkey") % n + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), ((F.col("p_retailprice") - 900) / 40).alias("s"), pick(4, "Supported", "Contradicted", "No Evidence", "x").alias("status"), pick(3, "CONFIRMS", "CONTRADICTS", "none").alias("sensor"), pick(2, "CONFIRMS", "none").alias("kg"), F.col("p_size").alias("z"))


@query(f"""with {_SCALE} select k, round(least(greatest(s, 0), 2) / 2, 6) as rescaled, case when abs(s * 2) >= 4 then 'far outside' when abs(s * 2) >= 3 then 'well outside' when abs(s * 2) >= 2 then 'outside' else 'at the edge of' end as z_text,
case when s >= 0.7 then least(s * 0.05, 0.05) else 0 end::double as boost, case when k % 2 = 0 then s / 2 >= 0.3 and s / 2 < 1.01 else s / 2 >= 0 and s / 2 < 0.3 end as in_band,
case when s / 2 >= 0.75 then 'EXTRACTED' when s / 2 >= 0.55 then 'INFERRED' else 'AMBIGUOUS' end as tag, case when k % 2 = 0 and s / 2 >= 0.8 then 'EXTRACTED' when k % 2 = 0 and s / 2 >= 0.55 then 'INFERRED' else 'AMBIGUOUS' end as tag2,
case status when 'Supported' then '🟢 Sensor Supported' when 'Contradicted' then '🟡 Sensor Contradicted' when 'No Evidence' then '⚪ No Sensor Data' else '' end as badge,
case k % 3 when 0 then 'High-confidence diagnosis supported by strong evidence across retrieval, symptom coverage, and (if available) sensor data.' when 1 then 'Insufficient evidence to identify a clear diagnosis. Please provide more details.' else 'Unknown mode.' end as mode_text from s""")
def scalar_scores(spark, d):
    s, k = F.col("s"), F.col("k")
    return _scale(spark, d).select(
        "k", F.round(S.rescaled(s), 6).alias("rescaled"), S.describe_z(s * 2).alias("z_text"), S.sensor_boost(s).alias("boost"), S.in_band(s / 2, F.when(k % 2 == 0, "EXTRACTED").otherwise("AMBIGUOUS")).alias("in_band"),
        S.tag(s / 2, 0.75, 0.55).alias("tag"), S.two_path_tag(s / 2, F.when(k % 2 == 0, "both").otherwise("vector")).alias("tag2"),
        decision.sensor_badge(F.col("status")).alias("badge"), S.mode_text(F.element_at(F.array(F.lit("EXTRACTED"), F.lit("AMBIGUOUS"), F.lit("OTHER")), (k % 3 + 1).cast("int"))).alias("mode_text"),
    )


@query(f"""with {_SCALE}, q as (select *, (case when z % 7 + z % 5 > 0 then (z % 7) / (z % 7 + z % 5) else 0 end) * 0.4 + s / 2 * 0.3 - greatest(z % 4 - 1, 0) * 0.1 + case sensor when 'CONFIRMS' then 0.15 when 'CONTRADICTS' then -0.1 else 0 end + case kg when 'CONFIRMS' then 0.1 else 0 end as score from s),
e as (select *, case when z % 6 = 0 then 'weak' when score >= 0.65 then 'strong' when score >= 0.4 then 'moderate' else 'weak' end as quality from q)
select k, quality, case when z % 6 = 0 then 'AMBIGUOUS' when quality = 'strong' and sensor <> 'CONTRADICTS' then 'EXTRACTED' when quality in ('strong', 'moderate') then 'INFERRED' else 'AMBIGUOUS' end as mode,
round(greatest(least(s / 2 * case quality when 'strong' then 1.0 when 'moderate' then 0.8 else 0.5 end + case sensor when 'CONFIRMS' then 0.1 when 'CONTRADICTS' then -0.15 else 0 end, 1), 0), 6) as confidence from e""")
def evidence_quality(spark, d):
    s, z = F.col("s"), F.col("z")
    q = S.evidence_quality(z % 6, z % 7, z % 5, s / 2, z % 4, F.col("sensor"), F.col("kg"))
    r = _scale(spark, d).withColumn("quality", q)
    return r.select("k", "quality", S.evidence_mode(z % 6, F.col("quality"), F.col("sensor")).alias("mode"), F.round(S.internal_confidence(s / 2, F.col("quality"), F.col("sensor")), 6).alias("confidence"))


@query("""with w as (select p_partkey as k, list_distinct(list_filter(string_split(lower(p_name || ' Ring ' || p_type), ' '), lambda x: x <> '')) as o, list_distinct(string_split(lower('ring ' || p_type || ' widget'), ' ')) as m from part) select k, len(list_intersect(o, m)) / len(o) as coverage from w""")
def query_coverage(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), S.coverage(F.split(F.concat_ws(" ", "p_name", F.lit("Ring"), "p_type"), " "), F.split(F.concat(F.lit(" RING"), F.lit(" "), "p_type", F.lit(" Widget")), " ")).alias("coverage"))


#: Candidates: labels that are anchors or have no stem of any, categories by exact name, cut name and containment.
_LABELS = ["Engine misfires", "engine knocking/pinging", "brake squeal", "window stuck", "Loss of power", "seat", ""]
_CATEGORIES = ["Fuel System", "Fuel System.Md", "engine components", "Steering", ""]
_CAND = f"""c as (select p_partkey // 50 as query_id, (p_partkey % 50 + 1)::int as rank, p_partkey as id, {_sql_list(_LABELS)}[p_partkey % 7 + 1] as label, {_sql_list(_CATEGORIES)}[p_partkey % 5 + 1] as category, (p_partkey * 13 % 28) * 0.08 as score,
  ['vector', 'graph', 'all'][p_partkey % 3 + 1] as source, ['Symptom', 'Subcategory', 'DiagnosisStep', 'Category'][p_partkey % 4 + 1] as node_type from part),
lm(label, fault) as (values ('Engine misfires', 'FAULT_INJ_PRS'), ('engine knocking/pinging', 'FAULT_SOI'), ('Loss of power', 'FAULT_INJ_PRS')),
cm(category, at_, fault, base) as (values ('Fuel System', 0, 'FAULT_INJ_PRS', 0.90), ('Fuel System', 1, 'FAULT_INJ_DUR', 0.70), ('Fuel System.Md', 0, 'FAULT_INJ_PRS', 0.90), ('Fuel System.Md', 1, 'FAULT_INJ_DUR', 0.70),
  ('engine components', 0, 'FAULT_INJ_DUR', 0.85), ('engine components', 1, 'FAULT_INJ_PRS', 0.75), ('engine components', 2, 'FAULT_SOI', 0.70), ('', 0, 'FAULT_INJ_DUR', 0.85), ('', 1, 'FAULT_INJ_PRS', 0.75), ('', 2, 'FAULT_SOI', 0.70)),
mr as (select c.*, 0 as at_, lm.fault, 1.0 as base, 'label' as mapping_type from c join lm on lm.label = c.label union all select c.*, at_, fault, base, 'category' from c join cm on cm.category = c.category where c.label not in (select label from lm)),
mo as (select * from (select *, row_number() over (partition by query_id, label, fault order by rank, at_) as rn from mr) where rn = 1),
mp as (select query_id, row_number() over (partition by query_id order by score desc, rank, at_)::int as ord, category as kg_category, label, fault as fault_code, score as kg_score, source, node_type, mapping_type, round(least(base + case when score >= 2.0 then 0.05 when score >= 1.5 then 0.02 else 0 end, 1)::decimal(18, 6), 3)::double as mapping_confidence from mo),
rs as (select q.query_id, f.fault, (q.query_id * 7 + length(f.fault) * 3) % 51 * 0.02 as sensor_confidence, case when q.query_id % 3 = 0 then ['a'] else [] end as critical, case when length(f.fault) % 2 = 1 then ['b', 'c'] else [] end as warning, ['d', 'e'] as normal
  from (select distinct query_id from c) q, (values ('FAULT_INJ_DUR'), ('FAULT_INJ_PRS'), ('FAULT_SOI')) f(fault)),
fb as (select * from (select m.query_id, m.label, r.sensor_confidence as conf, critical, warning, normal, row_number() over (partition by m.query_id, m.label order by r.sensor_confidence desc, m.ord) as rn from mp m join rs r on r.query_id = m.query_id and r.fault = m.fault_code where r.sensor_confidence > 0) where rn = 1),
fu as (select c.*, least(greatest(score, 0), 2) / 2 as kg, coalesce(conf, 0) as conf, coalesce(len(critical), 0) as nc, coalesce(len(warning), 0) as nw, coalesce(len(normal), 0) as nn from c left join fb on fb.query_id = c.query_id and fb.label = c.label),
fz as (select *, round(cast(0.45 * kg + 0.20 + 0.35 * conf as decimal(18, 8)), 3)::double as final from fu),
fo as (select *, row_number() over (partition by query_id order by final desc, rank)::int as ord from fz)"""


def _candidates(spark, d):
    k = F.col("p_partkey")
    pick = lambda x: F.element_at(F.array(*map(F.lit, x)), (k % len(x) + 1).cast("int"))
    return table(spark, d, "part").select(
        F.floor(k / 50).alias("query_id"), (k % 50 + 1).cast("int").alias("rank"), k.alias("id"), pick(_LABELS).alias("label"), pick(_CATEGORIES).alias("category"), (k * 13 % 28 * 0.08).alias("score"),
        pick(["vector", "graph", "all"]).alias("source"), pick(["Symptom", "Subcategory", "DiagnosisStep", "Category"]).alias("node_type"), F.array(pick(["vector", "graph", "all"])).alias("found_by"), F.lit("sub").alias("subcategory"),
    )


def _results(spark, d):
    f = F.explode(F.array(*map(F.lit, ("FAULT_INJ_DUR", "FAULT_INJ_PRS", "FAULT_SOI")))).alias("fault")
    none = F.array().cast("array<string>")
    some = lambda cond, *x: F.when(cond, F.array(*map(F.lit, x))).otherwise(none)
    q = _candidates(spark, d).select("query_id").distinct().select("query_id", f)
    return q.select("query_id", "fault", ((F.col("query_id") * 7 + F.length("fault") * 3) % 51 * 0.02).alias("sensor_confidence"), some(F.col("query_id") % 3 == 0, "a").alias("critical"), some(F.length("fault") % 2 == 1, "b", "c").alias("warning"), F.array(F.lit("d"), F.lit("e")).alias("normal"))


@query(f"with {_CAND} select query_id, ord, kg_category, label, fault_code, round(kg_score, 6) as kg_score, source, node_type, mapping_type, mapping_confidence from mp")
def mapped_faults(spark, d):
    return decision.map_faults(_candidates(spark, d)).withColumn("kg_score", F.round("kg_score", 6)).select("query_id", "ord", "kg_category", "label", "fault_code", "kg_score", "source", "node_type", "mapping_type", "mapping_confidence")


@query(f"with {_CAND} select query_id, count(*) as n_mapped, count(*) filter (where mapping_type = 'label') as n_label, count(*) filter (where mapping_type = 'category') as n_category from mp group by 1")
def mapping_counts(spark, d):
    return decision.mapping_counts(decision.map_faults(_candidates(spark, d)))


@query(f"with {_CAND} select query_id, id, ord, round(cast(kg as decimal(18, 8)), 3)::double as kg_score, round(cast(conf as decimal(18, 8)), 3)::double as sensor_score, final as final_score, round(nc / greatest(nc + nw + nn, 1), 3) as critical_score, round(nw / greatest(nc + nw + nn, 1), 3) as warning_score from fo")
def fused_evidence(spark, d):
    c = _candidates(spark, d)
    return decision.fuse_evidence(c, decision.map_faults(c), _results(spark, d)).select("query_id", "id", "ord", "kg_score", "sensor_score", "final_score", "critical_score", "warning_score")


@query(f"""with {_CAND}, l as (select query_id, fault_code as fault, max_by(label, ord) as label, max_by(kg_category, ord) as category from mp group by 1, 2) select query_id, fault, label, category, case when fault = 'FAULT_SOI' then 0 else 0.5 end::double as sensor_confidence, case when fault = 'FAULT_SOI' then 0 else 1 end::int as n_critical from l""")
def candidate_results(spark, d):
    """One sensor result for each mapped fault; FAULT_SOI has no sensors."""
    r = spark.createDataFrame([("FAULT_INJ_DUR", 0.5, ["a"], [], []), ("FAULT_INJ_PRS", 0.5, ["a"], [], [])], "fault string, sensor_confidence double, critical array<string>, warning array<string>, normal array<string>")
    out = validation.candidate_faults(decision.map_faults(_candidates(spark, d)), r)
    return out.select("query_id", "fault", "label", F.col("kg_category").alias("category"), "sensor_confidence", F.size("critical").alias("n_critical"))


@query(f"""with {_CAND}, x as (select query_id, fault, len(critical) + len(warning) as own, sum((len(critical) + len(warning) > 0)::int) over (partition by query_id) - (len(critical) + len(warning) > 0)::int as others from rs)
select query_id, fault, case when own > 0 then 'Supported' when others > 0 then 'Contradicted' else 'No Evidence' end as sensor_status from x""")
def sensor_badges(spark, d):
    return validation.contradiction(_results(spark, d)).select("query_id", "fault", "sensor_status")


_DECIDE = f"""{_CAND}, nm as (select * from fo where trim(label) <> ''), tp as (select query_id, max(score) as top, list_sort(list(score), 'desc') as sc, min_by(label, ord) as top_label from nm group by 1),
fl as (select query_id, label, min_by(fault_code, ord) as first_fault, max_by(fault_code, ord) as last_fault, max_by(mapping_type, ord) as last_type from mp group by 1, 2),
qd as (select t.query_id, top, case when top <= 0 then 0 when len(sc) = 1 then 1 else least(greatest((sc[1] - sc[2]) / sc[1], 0), 1) end as sep, 0.5 as cov, coalesce(r.sensor_confidence, 0) as tc from tp t left join fl f on f.query_id = t.query_id and f.label = t.top_label left join rs r on r.query_id = t.query_id and r.fault = f.first_fault),
qc as (select *, case when top <= 0 then 0 else least(top / 0.55, 1) end as cal, case when tc >= 0.7 then least(tc * 0.05, 0.05) else 0 end as boost from qd),
qm as (select *, least(0.6 * cal + 0.2 * sep + 0.2 * cov + boost, 1) as conf from qc),
an as (select n.query_id, n.id, n.label, n.ord, coalesce(f.last_fault, '') as fault_code, coalesce(f.last_type, '') as mapping_type, least(0.6 * case when n.score <= 0 then 0 else least(n.score / 0.55, 1) end + 0.2 * m.sep + 0.2 * m.cov + case when coalesce(r.sensor_confidence, 0) >= 0.7 then least(r.sensor_confidence * 0.05, 0.05) else 0 end, 1) as conf, m.conf >= 0.3 as extracted
  from nm n join qm m using (query_id) left join fl f on f.query_id = n.query_id and f.label = n.label left join rs r on r.query_id = n.query_id and r.fault = f.last_fault),
ds as (select *, case when extracted then conf >= 0.3 and conf < 1.01 else conf >= 0 and conf < 0.3 end as shown from an),
dr as (select *, row_number() over (partition by query_id, shown order by round(conf, 12) desc, ord) as place from ds)"""


def _decide(spark, d):
    c = _candidates(spark, d)
    m, r = decision.map_faults(c), _results(spark, d)
    q = c.select("query_id").distinct().select("query_id", F.lit("Engine  makes noise ENGINE loud").alias("text"), F.array(F.struct(F.lit("engine Noise").alias("label"))).alias("entities"), F.lit("symptom_report").alias("intent"), F.array(F.lit("x")).alias("expansion_terms"))
    return (c, m, q, *decision.decide(q, decision.fuse_evidence(c, m, r), m, r))


@query(f"with {_DECIDE} select query_id, round(top, 6) as raw_retrieval_score, round(sep, 6) as separation, cov::double as coverage, round(boost, 6) as sensor_boost, round(conf, 6) as confidence, case when conf >= 0.3 then 'EXTRACTED' else 'AMBIGUOUS' end as mode from qm")
def decided_queries(spark, d):
    """Two of the four distinct words of each query are in its entities."""
    return rounded(_decide(spark, d)[3].select("query_id", "raw_retrieval_score", "separation", "coverage", "sensor_boost", "confidence", "mode"), 6)


@query(f"with {_DECIDE} select query_id, id, fault_code, mapping_type, round(conf, 6) as confidence, case when shown and place <= 5 then place else 0 end::int as display_rank from dr")
def display_candidates(spark, d):
    a = _decide(spark, d)[4]
    return a.select("query_id", "id", "fault_code", "mapping_type", F.round("confidence", 6).alias("confidence"), F.coalesce("display_rank", F.lit(0)).alias("display_rank"))


@query(f"with {_DECIDE}, e as (select query_id, fault_code, min(place) as p from dr where shown and place <= 5 and fault_code <> '' group by 1, 2) select e.query_id, fault_code as fault, round(r.sensor_confidence, 6) as sensor_confidence, len(critical)::int as n_critical, len(warning)::int as n_warning from e join rs r on r.query_id = e.query_id and r.fault = fault_code")
def displayed_evidence(spark, d):
    e = decision.sensor_evidence(_decide(spark, d)[4])
    return e.select("query_id", "fault", F.round("sensor_confidence", 6).alias("sensor_confidence"), F.size("critical").alias("n_critical"), F.size("warning").alias("n_warning"))


@query(f"""with {_DECIDE}, s as (select query_id, case when conf >= 0.3 then 5 else 6 end::int as n_steps, 'Confidence ' || printf('%.3f', conf) || case when conf >= 0.3 then ' >= 0.30 → mode: EXTRACTED.' else ' < 0.30 → mode: AMBIGUOUS.' end as mode_step, 'Retrieved ' || n || ' candidate(s). Top: "' || c1.label || '" (score: ' || printf('%.3f', c1.score) || ', source: ' || c1.source || ').' as retrieval_step
  from qm join (select query_id, count(*) as n from c group by 1) using (query_id) join (select * from c where rank = 1) c1 using (query_id)) select query_id, n_steps, mode_step, retrieval_step from s""")
def reasoning_steps(spark, d):
    c, m, q, decided, _ = _decide(spark, d)
    chain = decision.reasoning_chain(q, c, m, decided)
    at = lambda i: F.col("reasoning_chain")[i]["detail"]
    return chain.select("query_id", F.size("reasoning_chain").alias("n_steps"), at(4).alias("mode_step"), at(1).alias("retrieval_step"))


_SIG = "g as (select n_nationkey as k, 's' || (n_nationkey % 4) as sensor, case when n_nationkey % 3 = 0 then 'CRITICAL' when n_nationkey % 3 = 1 then 'WARNING' else 'NORMAL' end as status, 10.0 + n_nationkey / 4 as v, 12.0 as m, n_nationkey / 5 - 2.5 as z, n_nationkey / 10 - 1.5 as pct, (n_nationkey % 11) / 10.0 as sim, n_nationkey / 25.0 as imp from nation)"


def _signal_rows(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.alias("sample_id"), F.lit("F").alias("fault"), k.alias("speed"), F.concat(F.lit("s"), k % 4).alias("sensor"), F.when(k % 3 == 0, "CRITICAL").when(k % 3 == 1, "WARNING").otherwise("NORMAL").alias("status"), (10.0 + k / 4).alias("current_value"), F.lit(12.0).alias("nominal_mean"), (k / 5 - 2.5).alias("z_score"), (k / 10 - 1.5).alias("percent_change"), (k % 11 / 10.0).alias("sensor_confidence"))


@query(f"""with {_SIG}, t as (select *, case when z >= 0 then z else -z end as az from g where status <> 'NORMAL') select k as sample_id, sensor, status as severity,
'Current reading (' || printf('%.2f', v) || ') is ' || case when v > m then 'above' else 'below' end || ' the nominal mean (' || printf('%.2f', m) || ') by ' || printf('%.2f', abs(v - m)) || '. with a z-score of ' || printf('%.1f', z) || ' (' || case when az >= 4 then 'far outside' when az >= 3 then 'well outside' when az >= 2 then 'outside' else 'at the edge of' end || ' the normal band). a ' || printf('%+.1f', pct) || '% shift from nominal.' as abnormality,
case when status = 'CRITICAL' and imp > 0.8 then 'Strongly confirms the diagnosis. The deviation is both severe and directly relevant to the predicted fault mechanism.' when status = 'CRITICAL' then 'Provides supporting evidence. The deviation is severe, though this sensor is not a top-ranked diagnostic indicator for F.' when imp > 0.8 then 'Lends weight to the diagnosis. The sensor is diagnostically important for F but the deviation magnitude is moderate.'
  else 'Offers minor supporting context. The deviation is moderate and the sensor is not a primary indicator for F.' end || ' ' || case when sim > 0.8 then 'The reading closely matches the expected profile for this fault type.' when sim > 0.5 then 'The reading shows partial alignment with the fault profile.' else 'The reading does not closely match the expected fault profile, reducing diagnostic confidence.' end as contribution,
case when k % 4 = 0 then 'd ' else '' end || case when imp > 0.8 then 'It is a primary diagnostic indicator for ' when imp > 0.5 then 'It has moderate diagnostic relevance to ' else 'It has minor diagnostic relevance to ' end || 'F (importance ' || printf('%.2f', imp) || '). Effect size 1.00 sigma.' as relevance from t""")
def sensor_texts(spark, d):
    """Texts on flagged signals."""
    rows = _signal_rows(spark, d)
    k = F.col("n_nationkey")
    m = table(spark, d, "nation").select(F.lit("F").alias("fault"), k.alias("speed"), F.concat(F.lit("s"), k % 4).alias("sensor"), (k / 25.0).alias("importance_score"), F.lit(1.0).alias("effect_size"))
    names = spark.createDataFrame([("s0", "Zero", "d", "u", "x")], "sensor string, display_name string, description string, subsystem string, units string")
    out = validation.interpretations(rows, names, m, m.select("fault", "speed", "sensor", "effect_size"))
    return out.select("sample_id", "sensor", "severity", "abnormality", "contribution", "relevance")


@query("""select n_nationkey as query_id, case when n_nationkey % 3 = 2 then 'All sensor readings are within the normal range.' else case when n_nationkey % 3 = 0 then 'Zero (s0): CRITICAL — first' else 's1 (s1): CRITICAL' end || '; s2 (s2): WARNING' end as detail from nation""")
def sensor_details(spark, d):
    """Flagged sensors by name; those that the dictionary lacks by their own, without a description."""
    k, none = F.col("n_nationkey"), F.array().cast("array<string>")
    e = table(spark, d, "nation").select(k.alias("query_id"), F.lit("F").alias("fault"), F.when(k % 3 == 2, none).otherwise(F.array(F.concat(F.lit("s"), k % 3))).alias("critical"), F.when(k % 3 == 2, none).otherwise(F.array(F.lit("s2"))).alias("warning"))
    names = spark.createDataFrame([("s0", "Zero", "first", "", "")], "sensor string, display_name string, description string, subsystem string, units string")
    return decision.sensor_detail(e, names).select("query_id", "detail")


@query("""select n_nationkey as k, case n_nationkey % 3 when 0 then 'Diagnosis: ' || n_name || ' (F)' when 1 then 'Insufficient evidence: ' || n_name else 'X: Unknown' end as summary,
case n_nationkey % 3 when 0 then '**Diagnosis:** ' || n_name || chr(10) || chr(10) || 'This fault falls under **' || 'sub' || '** in the **' || 'cat' || '** system.' || chr(10) || chr(10) || '**Sensor status:** ok' else '' end as text,
'Based on the symptoms "' || n_name || '", here is what the knowledge graph suggests:' || chr(10) || chr(10) || case when n_nationkey % 2 = 0 then '- **A** — found via vector retrieval.' || chr(10) || '- **' || n_name || '** — found via graph retrieval.' || chr(10) || chr(10) || 'These are the closest matches in the knowledge base, but none had sufficient confidence for a definitive diagnosis. Consider consulting a mechanic for hands-on inspection.' else 'No closely related fault patterns were found in the knowledge base. The described symptoms do not match known patterns. Consider consulting a mechanic for a professional diagnosis.' end
|| chr(10) || chr(10) || '---' || chr(10) || '⚠ AI-ASSISTED ANALYSIS — NOT A DIAGNOSIS' || chr(10) || 'This response is generated by an AI language model and is NOT a knowledge-graph-derived diagnosis. It should be treated as general informational guidance only.' as assisted from nation""")
def explanation_texts(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    mode = F.when(k % 3 == 0, "EXTRACTED").when(k % 3 == 1, "AMBIGUOUS").otherwise("X")
    two = F.array(F.struct(F.lit("A").alias("label"), F.lit("vector").alias("source")), F.struct(F.col("n_name").alias("label"), F.lit("graph").alias("source")))
    helped = decision.assisted_text(F.col("n_name"), F.when(k % 2 == 0, two).otherwise(F.slice(two, 1, 0)))
    return n.select(
        k.alias("k"), decision.brief_summary(mode, F.when(k % 3 < 2, F.col("n_name")), F.when(k % 3 == 0, "F")).alias("summary"),
        decision.diagnosis_summary(mode, F.col("n_name"), F.lit("cat"), F.lit("sub"), F.lit(""), F.lit("ok")).alias("text"),
        helped.alias("assisted"),
    )


# ---- earlier variants

_TAGGED = """t as (select p_partkey // 10 as query_id, (p_partkey % 10 + 1)::int as rank, p_partkey as id, p_name as label, (p_partkey * 13 % 100) / 80.0 as score, ['all', 'vector+graph', 'community'][p_partkey % 3 + 1] as source, p_size > 25 as multi from part),
tf as (select *, score * case source when 'all' then 1.0 when 'vector+graph' then 0.95 else 0.45 + case when multi then 0.1 else 0 end end as eff from t), tg as (select *, case when eff >= 0.75 then 'EXTRACTED' when eff >= 0.55 then 'INFERRED' else 'AMBIGUOUS' end as tag from tf),
ov as (select query_id, min_by(tag, rank) as mode, 'Could you describe the problem further? Is it related to: ' || array_to_string(list(label order by rank)[1:3], ', ') || '?' as ask from tg group by 1)"""


def _tagged(spark, d):
    k = F.col("p_partkey")
    c = table(spark, d, "part").select(F.floor(k / 10).alias("query_id"), (k % 10 + 1).cast("int").alias("rank"), k.alias("id"), F.col("p_name").alias("label"), (k * 13 % 100 / 80.0).alias("score"), F.element_at(F.array(*map(F.lit, ("all", "vector+graph", "community"))), (k % 3 + 1).cast("int")).alias("source"), F.when(F.col("p_size") > 25, "True").otherwise("False").alias("is_multi_category"))
    return legacy.tagged(c)


@query(f"with {_TAGGED} select query_id, id, round(eff, 6) as effective_confidence, tag from tg")
def tagged_candidates(spark, d):
    return _tagged(spark, d).select("query_id", "id", F.round("effective_confidence", 6).alias("effective_confidence"), "tag")


@query(f"with {_TAGGED} select query_id, mode, case when mode = 'AMBIGUOUS' then ask else '' end as question from ov")
def overall_modes(spark, d):
    return legacy.overall(_tagged(spark, d)).withColumn("question", F.coalesce("question", F.lit("")))


_PATHSQL = f"""{_TAGGED}, rp as (select *, row_number() over (partition by query_id order by rank) as rn from tg where tag <> 'AMBIGUOUS'),
sy as (select rp.*, string_split(label, ' ') as lw, ['red noise', 'ring smell', 'stuck ' || (id % 5)] as symptoms, ['check ' || (id % 3), 'replace'] as steps from rp where rn <= 5),
qw as (select p_partkey // 10 as query_id, min_by(p_name, p_partkey) as text from part group by 1),
mt as (select sy.*, list_filter(symptoms, lambda x: len(list_intersect(string_split(x, ' '), string_split(qw.text, ' '))) > 0) as matched from sy join qw using (query_id)),
un as (select *, list_filter(symptoms, lambda x: not list_contains(matched, x)) as unconfirmed from mt)"""


def _paths(spark, d):
    t = _tagged(spark, d)
    h = t.select("id", F.concat(F.lit("sub"), "id").alias("subcategory_id"), F.lit("S").alias("subcategory"), F.lit("c").alias("category_id"), F.lit("C").alias("category"), F.array(F.concat(F.lit("chain "), "id")).alias("chain"))
    kids = t.select(F.concat(F.lit("sub"), "id").alias("id"), F.array(F.lit("red noise"), F.lit("ring smell"), F.concat(F.lit("stuck "), F.col("id") % 5)).alias("symptoms"), F.array(F.concat(F.lit("check "), F.col("id") % 3), F.lit("replace")).alias("steps"))
    q = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 10).alias("query_id")).agg(F.min_by("p_name", "p_partkey").alias("text"))
    return t, legacy.reasoning_paths(q, t, h, kids)


@query(f"with {_PATHSQL} select query_id, id, tag, array_to_string(matched, ',') as matched, array_to_string(unconfirmed, ',') as unconfirmed from un")
def reasoning_paths(spark, d):
    return _paths(spark, d)[1].select("query_id", "id", "tag", F.array_join("matched_symptoms", ",").alias("matched"), F.array_join("unconfirmed_symptoms", ",").alias("unconfirmed"))


@query(f"""with {_PATHSQL}, a as (select ov.query_id, mode, ask, un.id, steps, unconfirmed from ov left join un on un.query_id = ov.query_id and un.rn = 1) select query_id, case when mode = 'EXTRACTED' then 'final' when mode = 'INFERRED' and len(unconfirmed) > 0 then 'intermediate' when mode = 'INFERRED' then 'final' else 'question' end as kind,
case when mode = 'EXTRACTED' or mode = 'INFERRED' and len(unconfirmed) = 0 then 'chain ' || id || chr(10) || array_to_string(steps, chr(10)) when mode = 'INFERRED' then 'chain ' || id || chr(10) || 'Do you also notice: ' || array_to_string(unconfirmed, ', ') || '?' else ask end as text from a""")
def legacy_answers(spark, d):
    t, paths = _paths(spark, d)
    return legacy.answers(legacy.overall(t), paths)


@query(f"""with {_CAND}, r as (select query_id, case when max(sensor_confidence) > 0.5 then 'CONFIRMS' else 'CONTRADICTS' end as sensor_status from rs where query_id % 4 <> 0 group by 1), k as (select query_id, min_by(final, ord) as t from fo group by 1)
select k.query_id, coalesce(sensor_status, 'NOT AVAILABLE') as sensor_status, case when t >= 0.7 then 'CONFIRMS' when t < 0.3 then 'CONTRADICTS' else 'INCONCLUSIVE' end as kg_status from k left join r on r.query_id = k.query_id""")
def adapted_evidence(spark, d):
    c = _candidates(spark, d)
    return legacy.adapted_evidence(decision.fuse_evidence(c, decision.map_faults(c), _results(spark, d)), _results(spark, d).where("query_id % 4 <> 0"))


@query("""select p_partkey as id, case when p_partkey % 3 = 0 then 'Unknown' else p_brand end as system, case when p_partkey % 2 = 0 then p_name else p_type end as subsystem from part""")
def known_systems(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_brand")).alias("category"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_type")).alias("subcategory"), F.col("p_name").alias("label"))
    return legacy.known_systems(p).select("id", "system", "subsystem")


@query("""with f as (select p_partkey // 20 as query_id, (p_partkey % 20 + 1) as ord, (1000 - p_partkey % 20 * 37 - p_partkey // 20) / 1000.0 as fs, p_brand as system from part), g as (select query_id, count(*) as n, min_by(fs, ord) as top, count(*) filter (where fs >= 0.6) as strong,
  string_agg(system, ',' order by ord) filter (where fs >= 0.6) as confirmed, string_agg(system, ',' order by ord) filter (where fs < 0.3) as contradicted, string_agg(system, ',' order by ord) filter (where fs >= 0.3 and fs < 0.6) as remaining from f group by 1),
e as (select *, query_id % 5 as nm, query_id % 3 as ns, ['CONFIRMS', 'CONTRADICTS', 'NOT AVAILABLE'][query_id % 3 + 1] as sensor, ['CONFIRMS', 'INCONCLUSIVE'][query_id % 2 + 1] as kg from g),
s as (select *, case when nm + ns > 0 then nm / (nm + ns) else 0 end * 0.4 + top * 0.3 - greatest(strong - 1, 0) * 0.1 + case sensor when 'CONFIRMS' then 0.15 when 'CONTRADICTS' then -0.1 else 0 end + case kg when 'CONFIRMS' then 0.1 else 0 end as score from e),
q as (select *, case when score >= 0.65 then 'strong' when score >= 0.4 then 'moderate' else 'weak' end as quality from s)
select query_id, quality as evidence_quality, case when quality = 'strong' and sensor <> 'CONTRADICTS' then 'EXTRACTED' when quality in ('strong', 'moderate') then 'INFERRED' else 'AMBIGUOUS' end as mode,
round(greatest(least(top * case quality when 'strong' then 1.0 when 'moderate' then 0.8 else 0.5 end + case sensor when 'CONFIRMS' then 0.1 when 'CONTRADICTS' then -0.15 else 0 end, 1), 0), 6) as confidence, coalesce(confirmed, '') as confirmed, coalesce(contradicted, '') as contradicted, coalesce(remaining, '') as remaining from q""")
def legacy_reasoning(spark, d):
    k = F.col("p_partkey")
    f = table(spark, d, "part").select(F.floor(k / 20).alias("query_id"), (k % 20 + 1).alias("ord"), ((1000 - k % 20 * 37 - F.floor(k / 20)) / 1000.0).alias("final_score"), F.col("p_brand").alias("system"))
    q = f.select("query_id").distinct()
    i = F.col("query_id")
    ev = q.select("query_id", F.element_at(F.array(*map(F.lit, ("CONFIRMS", "CONTRADICTS", "NOT AVAILABLE"))), (i % 3 + 1).cast("int")).alias("sensor_status"), F.when(i % 2 == 0, "CONFIRMS").otherwise("INCONCLUSIVE").alias("kg_status"))
    out = legacy.reasoned(f, ev, q.select("query_id", (i % 5).alias("n_matched"), (i % 3).alias("n_missing")))
    return out.select("query_id", "evidence_quality", "mode", F.round("confidence", 6).alias("confidence"), *[F.array_join(c, ",").alias(c) for c in ("confirmed", "contradicted", "remaining")])


@query("""select n_nationkey as k, case when n_nationkey % 4 = 0 then 'No sensor data available' else 'Sensor Analysis (' || (n_nationkey * 4) || '% confidence): ' || case when n_nationkey % 4 = 1 then '2 critical, 1 normal' when n_nationkey % 4 = 2 then '1 warning' else 'No sensor readings' end end as summary,
case when n_nationkey % 3 = 0 then 'Need more information — please provide additional symptoms.' when n_nationkey % 3 = 1 then 'Best guess: ' || n_name || ' > Unknown (needs confirmation)' else 'Diagnosed: Unknown > ' || n_name end as brief from nation""")
def legacy_summaries(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    lists = [F.when(k % 4 == i, F.array(*[F.lit("s")] * m)).otherwise(F.array().cast("array<string>")) for i, m in ((1, 2), (2, 1), (1, 1))]
    mode = F.element_at(F.array(*map(F.lit, ("AMBIGUOUS", "INFERRED", "EXTRACTED"))), (k % 3 + 1).cast("int"))
    return n.select(k.alias("k"), legacy.sensor_summary(F.when(k % 4 > 0, k * 4 / 100.0), *lists).alias("summary"), legacy.brief(mode, F.when(k % 3 == 1, F.col("n_name")), F.when(k % 3 == 2, F.col("n_name"))).alias("brief"))


# ---- statistics with p-values

# Two-sided tails of Student's t: the continued fraction of the incomplete beta function, 400 steps of two terms each.
_T = """recursive pr as (select *, case when x > (a0 + 1) / (a0 + 2.5) then 1 - x else x end as y, case when x > (a0 + 1) / (a0 + 2.5) then 0.5 else a0 end as a, case when x > (a0 + 1) / (a0 + 2.5) then a0 else 0.5 end as b, x > (a0 + 1) / (a0 + 2.5) as swap from (select *, df / (df + t * t) as x, df / 2 as a0 from w)),
it(speed, fault, sensor, a, b, y, m, c, e, f) as (select speed, fault, sensor, a, b, y, 1, 1.0::double, 1 / (1 - (a + b) * y / (a + 1)), 1 / (1 - (a + b) * y / (a + 1)) from pr
  union all select speed, fault, sensor, a, b, y, m + 1, 1 + n2 / c1, 1 / (1 + n2 * e1), f * c1 * e1 * (1 + n2 / c1) / (1 + n2 * e1) from (select *, 1 + n1 / c as c1, 1 / (1 + n1 * e) as e1
    from (select *, m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m)) as n1, -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1)) as n2 from it where m < 400))),
hv as (select pr.*, case when pr.y <= 0 then 0 else exp(pr.a * ln(pr.y) + pr.b * ln(1 - pr.y) + lgamma(pr.a + pr.b) - lgamma(pr.a) - lgamma(pr.b)) / pr.a * it.f end as h from pr join it using (speed, fault, sensor) where it.m = 400),
pv as (select *, case when swap then 1 - h else h end as p from hv)"""


def _shifted(spark, d):
    """Readings of which condition A has the quantity, and R the tax, shifted; a signal called time is always shifted."""
    r = readings(spark, d)
    t = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("speed"), F.when(F.col("l_returnflag") == "N", "NOMINAL").otherwise(F.col("l_returnflag")).alias("condition"), F.lit("time").alias("sensor"), (F.col("l_quantity") + F.when(F.col("l_returnflag") == "N", 0).otherwise(90)).alias("value"))
    far = F.when((F.col("condition") == "A") & (F.col("sensor") == "l_quantity"), 40.0).when((F.col("condition") == "R") & (F.col("sensor") == "l_tax"), 0.09).otherwise(0.0)
    return r.withColumn("value", F.col("value") + far).select("speed", "condition", "sensor", "value").union(t)


_SENS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SHIFTED = "r as (select l_linestatus as speed, case when l_returnflag = 'N' then 'NOMINAL' else l_returnflag end as condition, s.sensor, s.value + case when l_returnflag = 'A' and s.sensor = 'l_quantity' then 40.0 when l_returnflag = 'R' and s.sensor = 'l_tax' then 0.09 else 0 end as value from lineitem, lateral (values " + ", ".join(f"('{c}', {c}::double)" for c in _SENS) + ", ('time', l_quantity + case when l_returnflag = 'N' then 0 else 90 end)) s(sensor, value))"
_WELCH2 = f"""{_SHIFTED}, s as (select speed, condition, sensor, count(value)::double as n, avg(value) as m, var_samp(value) as v from r group by all),
c0 as (select b.speed, b.condition as fault, sensor, a.m as m1, b.m as m2, a.v as v1, b.v as v2, a.n as n1, b.n as n2 from s a join s b using (sensor) where a.speed = b.speed and a.condition = 'NOMINAL' and b.condition <> 'NOMINAL'),
w as (select speed, fault, sensor, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) as t, (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) as df, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) as effect, (m2 - m1) / abs(m1) * 100 as pct from c0)"""
_RANKED = """im as (select *, -log10(p + 1e-12) as lp from pv), nr as (select *, abs(effect) / max(abs(effect)) over g as en, abs(pct) / max(abs(pct)) over g as pn, lp / max(lp) over g as ln_ from im window g as (partition by speed, fault)),
sc as (select *, en * 0.5 + pn * 0.3 + ln_ * 0.2 as score from nr), rk as (select *, row_number() over (partition by speed, fault order by score desc, sensor)::int as rank from sc)"""


@query(f"with {_T.replace('recursive ', 'recursive ' + _WELCH2 + ', ', 1)}, {_RANKED} select speed, fault, sensor, round(p, 6) as p_value, round(en, 6) as effect_norm, round(pn, 6) as pct_norm, round(ln_, 5) as p_norm, round(score, 5) as importance_score, rank from rk")
def importance_scores(spark, d):
    out = profiling.importance(profiling.comparison(_shifted(spark, d)))
    return out.select("speed", "fault", "sensor", F.round("p_value", 6).alias("p_value"), F.round("effect_norm", 6).alias("effect_norm"), F.round("pct_norm", 6).alias("pct_norm"), F.round("p_norm", 5).alias("p_norm"), F.round("importance_score", 5).alias("importance_score"), "rank")


@query(f"with {_T.replace('recursive ', 'recursive ' + _WELCH2 + ', ', 1)}, {_RANKED} select fault, speed, sensor, row_number() over (partition by fault, speed order by rank)::int as rank, round(effect, 6) as effect_size from rk where p <= 0.05 and abs(effect) >= 0.8 and sensor not in ('time', 'timestamp', 'index')")
def selected_sensors(spark, d):
    """Diagnostic sensors by the thresholds themselves: p <= 0.05 and an effect of 0.8 or more."""
    out = profiling.select_sensors(profiling.importance(profiling.comparison(_shifted(spark, d))), Settings())
    return out.select("fault", "speed", "sensor", "rank", F.round("effect_size", 6).alias("effect_size"))


# ---- evaluation

_EVAL = "v as (select p_partkey as query_id, p_brand as system, (p_partkey * 37 % 100) / 100.0::double as confidence, case when p_partkey * 37 % 100 >= 30 then 'EXTRACTED' else 'AMBIGUOUS' end as mode from part)"


def _evaluated(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("query_id"), F.col("p_brand").alias("system"), (k * 37 % 100 / 100.0).alias("confidence"), F.when(k * 37 % 100 >= 30, "EXTRACTED").otherwise("AMBIGUOUS").alias("mode"))


@query(f'with {_EVAL} select system, count(*) filter (where mode = \'EXTRACTED\') as "EXTRACTED", count(*) filter (where mode = \'AMBIGUOUS\') as "AMBIGUOUS" from v group by 1')
def modes_by_system(spark, d):
    return evaluate.by_system(_evaluated(spark, d))


@query("""with c as (select p_partkey // 40 as query_id, p_partkey % 40 + 1 as rank, p_name as label from part), e as (select distinct query_id, ['Ring', 'red ROD', 'nothing'][query_id % 3 + 1] as x from c) select e.query_id, coalesce(min(rank) filter (where contains(lower(label), lower(x))), 0) as position from e join c using (query_id) group by 1""")
def expected_positions(spark, d):
    k = F.col("p_partkey")
    c = table(spark, d, "part").select(F.floor(k / 40).alias("query_id"), (k % 40 + 1).alias("rank"), F.col("p_name").alias("label"))
    e = c.select("query_id").distinct().withColumn("expected_label", F.element_at(F.array(*map(F.lit, ("Ring", "red ROD", "nothing"))), (F.col("query_id") % 3 + 1).cast("int")))
    return evaluate.expected_position(c, e).withColumn("position", F.coalesce("position", F.lit(0)))


@query("""with b as (select n_nationkey as query_id, n_nationkey / 25.0 as c0, case when n_nationkey > 7 then 'EXTRACTED' else 'AMBIGUOUS' end as m0 from nation), a as (select n_nationkey as query_id, (n_nationkey * i % 25) / 25.0 as c1, case when n_nationkey * i % 25 > 7 then 'EXTRACTED' else 'AMBIGUOUS' end as m1 from nation, range(1, 32) r(i))
select query_id, count(*) filter (where c1 > c0) as improved, count(*) filter (where c1 < c0) as worsened, count(*) filter (where m1 <> m0) as mode_changed from a join b using (query_id) group by 1""")
def refinement_effects(spark, d):
    k = F.col("n_nationkey")
    n = table(spark, d, "nation")
    row = lambda x, q: (x / 25.0, F.when(x > 7, "EXTRACTED").otherwise("AMBIGUOUS"))
    c0, m0 = row(k, k)
    after = n.select(k, F.explode(F.sequence(F.lit(1), F.lit(31))).alias("i")).withColumn("x", k * F.col("i") % 25)
    c1, m1 = row(F.col("x"), k)
    return evaluate.refinement_effect(n.select(k.alias("query_id"), c0.alias("confidence"), m0.alias("mode")), after.select(k.alias("query_id"), c1.alias("confidence"), m1.alias("mode")))


@query("""with p as (select p_partkey as query_id, (p_size - 0.5) / 60.0 as cal, p_partkey % 5 / 4.0 as sep, p_partkey % 3 / 2.0 as cov, p_partkey % 2 * 0.05 as boost from part), x as (select query_id, u.pos, u.component, u.c from p, lateral (values (0, 'retrieval', cal * 0.6), (1, 'separation', sep * 0.2), (2, 'coverage', cov * 0.2), (3, 'sensor', boost)) u(pos, component, c)),
y as (select *, sum(c) over (partition by query_id order by pos) as run from x) select query_id, component, round(run, 6) as running, run >= 0.3 and run - c < 0.3 as crosses from y""")
def component_crossings(spark, d):
    """Where the running confidence first reaches the mode's threshold."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("query_id"), ((F.col("p_size") - 0.5) / 60.0).alias("calibrated_retrieval"), (k % 5 / 4.0).alias("separation"), (k % 3 / 2.0).alias("coverage"), (k % 2 * 0.05).alias("sensor_boost"))
    out = evaluate.components(p)
    return out.select("query_id", "component", F.round("running", 6).alias("running"), "crosses")


# ---- preprocessing

_WORDS = "vo as (select distinct word from (select unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) as word from part) where length(word) > 2)"


def _ratio(typos: str) -> str:
    """CTEs lcs(word, match, ratio): Indel ratios of words in ``typos`` and the vocabulary, by rows of the subsequence table."""
    return f"""pa as (select t.word, v.word as match from ({typos}) t, vo v where t.word <> ''),
lc as (select word, match, 0 as i, list_transform(range(0, length(match) + 1), lambda j: 0) as l from pa
  union all select word, match, i + 1, list_concat([0], list_transform(range(1, length(match) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(l[k + 1], l[k] + (substring(match, k::int, 1) = substring(word, i + 1, 1))::int))))) from lc where i < length(word)),
lcs as (select word, match, 200.0 * l[length(match) + 1] / (length(word) + length(match)) as ratio from lc where i = length(word))"""


@query(f"with recursive {_WORDS}, {_ratio('select distinct left(word, 2) || substring(word, 4) as word from vo')} select word, match, round(ratio, 4) as ratio from (select *, row_number() over (partition by word order by ratio desc, match) as rn from lcs where ratio >= 82) where rn = 1")
def fuzzy_vocab_match(spark, d):
    words = preprocess.document_frequency(table(spark, d, "part"), "p_name").select("word")
    typos = words.select(F.concat(F.substring("word", 1, 2), F.substring("word", 4, 50)).alias("word"))
    return rounded(preprocess.fuzzy_matches(typos, words))


@query(f"""with recursive {_WORDS}, q as (select p_partkey as k, string_split(upper(left(p_name, 1)) || substring(p_name, 2) || ' widgt, of the bolt', ' ') as w from part), t as (select k, unnest(w) as token, unnest(range(len(w))) as i from q), tc as (select *, lower(regexp_replace(token, '[^a-zA-Z0-9]', '', 'g')) as word from t),
{_ratio('select distinct word from tc where length(word) > 2 and word not in (select word from vo)')}, b as (select word, match from (select *, row_number() over (partition by word order by ratio desc, match) as rn from lcs where ratio >= 82) where rn = 1)
select k as query_id, string_agg(coalesce(b.match, token), ' ' order by i) as processed from tc left join b on b.word = tc.word group by 1""")
def corrected_queries(spark, d):
    p = table(spark, d, "part")
    q = p.select(F.col("p_partkey").alias("query_id"), F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 100), F.lit(" widgt, of the bolt")).alias("text"))
    return preprocess.corrected(q, preprocess.document_frequency(p, "p_name").select("word")).select("query_id", "processed")


_SYN = ", ".join("('{}', '{}')".format(p.replace("'", "''"), r.replace("'", "''")) for p, r in SYNONYMS.items())


def _stems(words: str, rules) -> str:
    return f"list_distinct(list_transform(list_filter({words}, lambda x: length(x) >= 3), lambda w: {_duck_stem(rules, 'w')}))"


@query(f"""with s(p, r) as (values {_SYN}), q as (select p_partkey as k, 'my car ' || p || ' ' || lower(p_name) as q from part join (select p, row_number() over (order by p) - 1 as i from s) on i = p_partkey % {len(SYNONYMS)}), x as (select k, q, p, r, replace(q, p, r) as variant from q, s where contains(q, p)),
y as (select *, {_stems("string_split(r, ' ')", QUERY_STEM)} as rs, {_stems("string_split(p, ' ')", QUERY_STEM)} as ps, {_stems("string_split(q, ' ')", QUERY_STEM)} as qs from x where variant <> q)
select distinct k as query_id, variant from y where len(list_filter(rs, lambda x: not list_contains(ps, x) and list_contains(qs, x))) = 0""")
def synonym_variants(spark, d):
    """Each part's name with one of the phrases before it."""
    k = F.col("p_partkey")
    phrase = F.element_at(F.array(*map(F.lit, sorted(SYNONYMS))), (k % len(SYNONYMS) + 1).cast("int"))
    q = table(spark, d, "part").select(k.alias("query_id"), F.concat(F.lit("my car "), phrase, F.lit(" "), F.lower("p_name")).alias("processed"))
    return preprocess.synonym_variants(q).select("query_id", "variant")


_WEIGHT = "case node_type " + " ".join(f"when '{k}' then {v}" for k, v in ENTITY_WEIGHTS.items()) + " else 1.0 end"
_ENT = f"""nd as (select p_partkey as id, p_name as label, p_brand as category, ['Symptom', 'Subcategory', 'DiagnosisStep', 'Category'][p_partkey % 4 + 1] as node_type, (p_size % 10)::int as community from part),
lb as (select lower(label) as low, max_by(id, id) as id, max_by(node_type, id) as node_type, max_by(community, id) as community, max_by(category, id) as category from nd group by 1), lw as (select *, list_distinct(regexp_extract_all(low, '[a-z0-9]+')) as w from lb), ls as (select *, {_stems('w', QUERY_STEM)} as st from lw),
dc as (select word, count(*) as df from (select unnest(list_distinct(regexp_extract_all(lower(label), '[a-z0-9]+'))) as word from nd) where length(word) > 2 group by 1),
tw as (select *, {_stems('w', QUERY_STEM)} as st from (select k, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from tx)),
eh as (select k, id, node_type, community, category, len(l.w) as nl, list_intersect(t.w, l.w) as cw, len(list_intersect(t.st, l.st)) as cs from tw t, ls l where len(list_intersect(t.w, l.w)) + len(list_intersect(t.st, l.st)) > 0),
ei as (select e.k, e.id, sum(1.0 / coalesce(df, 1)) as idf from (select k, id, unnest(cw) as word from eh) e left join dc using (word) group by 1, 2),
er as (select eh.*, len(cw) as cn, (0.45 * least(coalesce(idf, 0), 1.5) + 0.55 * (0.6 * cs / nl + 0.4 * len(cw) / nl)) * {_WEIGHT} as raw from eh left join ei using (k, id)),
en as (select k as query_id, id as node_id, node_type, community, category, round(cn / nl, 2) as match_ratio, round(cast(raw as decimal(18, 10)), 3)::double as weighted_score, round(cast(least(raw, 1) as decimal(18, 10)), 3)::double as confidence from er where least(raw, 1) >= 0.2),
eb as (select *, max(confidence) over (partition by query_id) as best from en), es as (select *, row_number() over (partition by query_id order by confidence desc, weighted_score desc, node_id)::int as ord from eb where confidence >= 0.15 and confidence >= best * 0.7)"""


@query(f"with tx as (select p_partkey as k, p_name || ' ' || lower(p_type) as text from part where p_partkey % 100 = 0), {_ENT} select query_id, node_id, node_type, match_ratio, weighted_score, confidence, ord from es")
def entity_detection(spark, d):
    q = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text"))
    return preprocess.strong_entities(preprocess.entities(q, _part_nodes(spark, d))).select("query_id", "node_id", "node_type", "match_ratio", "weighted_score", "confidence", "ord")


def _path_queries(spark, d):
    return table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"), F.array().cast("array<int>").alias("communities"))


@query(f"""with q as (select p_partkey as query_id, list_distinct(string_split(lower(p_name), ' ')) as w from part where p_partkey % 100 = 0), n as (select p_partkey as id, p_name as label, list_distinct(string_split(lower(p_name), ' ')) as w from part), e as (select distinct l_partkey as s, l_suppkey as t from lineitem),
t as (select query_id, x, left({_duck_stem(RETRIEVAL_STEM, 'x')}, 4) as pre from (select query_id, unnest(w) as x from q) where length(x) > 2), nw as (select id, unnest(w) as lw from n),
sd as (select distinct query_id, id from t join nw on contains(lw, x) or starts_with(lw, pre)), fo as (select query_id, id, 0 as hop from sd union all select * from (select distinct sd.query_id, e.t as id, 1 from sd join e on e.s = sd.id) z where not exists (select 1 from sd y where y.query_id = z.query_id and y.id = z.id)),
ov as (select fo.*, label, len(list_intersect({_stems('q.w', RETRIEVAL_STEM)}, {_stems('n.w', RETRIEVAL_STEM)}))::int as overlap from fo join q using (query_id) join n using (id)),
r as (select query_id, id, hop, overlap, round(cast(case when hop = 0 then 0.35 else 0.1 end * least(overlap, 3) / 3.0 as decimal(18, 10)), 4)::double as raw_score, row_number() over (partition by query_id order by hop, overlap desc, label, id)::int as rank from ov) select * from r where rank <= 30""")
def graph_path_search(spark, d):
    from ..operators import retrieval

    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).distinct()
    return retrieval.graph_search(_path_queries(spark, d), _part_nodes(spark, d), edges).select("query_id", "id", "hop", "overlap", "raw_score", "rank")


@query(f"""with tx as (select p_partkey as k, p_name as text from part where p_partkey % 100 = 0), {_ENT}, qc as (select distinct query_id, community from es), q as (select k as query_id, {_stems("string_split(lower(text), ' ')", RETRIEVAL_STEM)} as st from tx), qs as (select *, list_filter(st, lambda x: not list_contains({_sql_list(GENERIC_SEED_WORDS)}, x)) as sp from q),
m as (select id, community, {_stems("string_split(lower(label), ' ')", RETRIEVAL_STEM)} as st, row_number() over (partition by community order by id) - 1 as mo from nd), k as (select community, count(distinct category) > 1 as multi from nd group by 1),
r as (select qs.query_id, m.id, m.community, mo, len(list_intersect(sp, m.st)) as so, len(list_intersect(qs.st, m.st)) as tt, len(sp) as ns from qs join qc using (query_id) join m on m.community = qc.community), f as (select * from r where case when ns > 0 then so > 0 else tt > 0 end),
t as (select *, row_number() over (partition by query_id, community order by so desc, tt desc, mo) as rn from f), b as (select * from t where rn <= 3)
select query_id, id, b.community, round(cast(case when multi then 0.45 else 0.30 end + so * 0.15 + tt * 0.05 as decimal(18, 10)), 4)::double as raw_score, row_number() over (partition by query_id order by b.community, rn)::int as rank from b join k on k.community = b.community""")
def community_path_search(spark, d):
    """Each query's communities are those of its strong entities."""
    from ..operators import retrieval

    n = _part_nodes(spark, d).withColumn("community", F.col("community").cast("int"))
    asked = _path_queries(spark, d).select("query_id", "text")
    found = preprocess.hints(preprocess.strong_entities(preprocess.entities(asked, n))).select("query_id", "communities")
    return retrieval.community_search(asked.join(found, "query_id"), n, graph.community_rollup(n))


@query(f"""with q as (select p_partkey as query_id, list_distinct(string_split(lower(p_name), ' ')) as w from part where p_partkey % 100 = 0), n as (select p_partkey as id, p_name as label, list_distinct(string_split(lower(p_name), ' ')) as w from part), e as (select distinct l_partkey as s, l_suppkey as t from lineitem),
t as (select query_id, x, left({_duck_stem(RETRIEVAL_STEM, 'x')}, 4) as pre from (select query_id, unnest(w) as x from q) where length(x) > 2), nw as (select id, unnest(w) as lw from n),
sd as (select distinct query_id, t0.id from (select query_id, id from t join nw on contains(lw, x) or starts_with(lw, pre)) t0 join part on p_partkey = t0.id where p_size % 10 = query_id % 3 or p_size % 10 = 5), fo as (select query_id, id, 0 as hop from sd union all select * from (select distinct sd.query_id, e.t as id, 1 from sd join e on e.s = sd.id) z where not exists (select 1 from sd y where y.query_id = z.query_id and y.id = z.id)),
ov as (select fo.*, label, len(list_intersect({_stems('q.w', RETRIEVAL_STEM)}, {_stems('n.w', RETRIEVAL_STEM)}))::int as overlap from fo join q using (query_id) join n using (id)),
r as (select query_id, id, hop, overlap, round(cast(case when hop = 0 then 0.35 else 0.1 end * least(overlap, 3) / 3.0 as decimal(18, 10)), 4)::double as raw_score, row_number() over (partition by query_id order by hop, overlap desc, label, id)::int as rank from ov) select * from r where rank <= 30""")
def hinted_graph_search(spark, d):
    """Seeds lie in two communities that each query is hinted at."""
    from ..operators import retrieval

    q = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"), F.array((F.col("p_partkey") % 3).cast("int"), F.lit(5)).alias("communities"))
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).distinct()
    return retrieval.graph_search(q, _part_nodes(spark, d), edges).select("query_id", "id", "hop", "overlap", "raw_score", "rank")


@query("""select p_partkey as k, array_to_string(case p_partkey % 3 when 0 then [p_name, p_type, p_brand] when 1 then [p_name, p_type] else [p_name, p_brand] end, '|') as variants from part""")
def distinct_variants(spark, d):
    """A query's own text first, then its expansions, repeats dropped."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").withColumn("more", F.when(k % 3 == 0, F.array("p_type", "p_name", "p_type", "p_brand")).when(k % 3 == 1, F.array("p_type", "p_name")).otherwise(F.array("p_name", "p_brand", "p_brand")))
    return p.select(k.alias("k"), F.array_join(preprocess.distinct_variants("p_name", "more"), "|").alias("variants"))


@query("""select p_size as query_id, array_to_string(list_sort(list_distinct(list_concat(list(p_name), list(p_type)))), '|') as texts from part group by 1""")
def united_terms(spark, d):
    p = table(spark, d, "part")
    as_text = lambda c: p.select(F.col("p_size").alias("query_id"), F.col(c).alias("text"))
    return preprocess.united(as_text("p_name"), as_text("p_type")).select("query_id", F.array_join("texts", "|").alias("texts"))
