"""Queries on a graph built from records: regions are categories, nations subcategories, with symptoms and steps they share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import vector_topk
from ..operators import decision, graph, legacy, preprocess, retrieval
from ..presets import CATEGORY_SENSORS
from ..sources import readers, sinks
from .queries import _KG, _kg, _part_nodes, _vectors
from .registry import query, table


def records(spark, d):
    """(ord, category, subcategory, symptoms, diagnosis_steps) of the nations."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    step = lambda text, *results: F.struct(text.alias("step"), F.array(*results).cast("array<string>").alias("result"))
    return n.select(
        k.alias("ord"), F.col("r_name").alias("category"), F.col("n_name").alias("subcategory"), F.array(F.concat(F.lit("Noise "), k % 7), F.concat(F.lit("Smell "), k % 11)).alias("symptoms"),
        F.array(step(F.concat(F.lit("Check "), k % 4), F.concat(F.lit("ok "), k), F.lit("bad")), step(F.concat(F.lit("Replace "), k))).alias("diagnosis_steps"),
    )


def built(spark, d):
    """Normalised nodes (community: the number of their first record modulo 4, as text order has it) and edges."""
    r = records(spark, d)
    nodes, edges = graph.build(r)
    nodes = graph.normalized(nodes, r)
    return r, nodes.withColumn("community", (F.floor(F.col("ord") / 1000000) % 4).cast("int")), edges


def _slug(x):
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"


def _id(p, x):
    return f"'{p}_' || left({_slug(x)}, 40) || '_' || left(md5({x}), 8)"


_REC = f"""rec as (select n_nationkey as ord, r_name as category, n_name as subcategory, ['Noise ' || (n_nationkey % 7), 'Smell ' || (n_nationkey % 11)] as symptoms,
  [{{'step': 'Check ' || (n_nationkey % 4), 'a': 'ok ' || n_nationkey, 'b': 'bad'}}, {{'step': 'Replace ' || n_nationkey, 'a': '', 'b': ''}}] as steps from nation join region on n_regionkey = r_regionkey),
rx as (select *, {_id('cat', 'category')} as cat_id, {_id('subcat', 'subcategory')} as sub_id, 'data/corpus/' || {_slug('category')} || '.md' as cat_file, 'data/corpus/' || {_slug('category')} || '/' || {_slug('subcategory')} || '.md' as sub_file from rec),
lf as (select ord, 1 + i as pos, 'sym' as kind, category, subcategory, sub_id, sub_file, symptoms[i + 1] as txt, null as a, null as b from rx, unnest([0, 1]) u(i)
  union all select ord, 100000 + i, 'step', category, subcategory, sub_id, sub_file, steps[i + 1].step, steps[i + 1].a, steps[i + 1].b from rx, unnest([0, 1]) u(i)),
lx as (select *, case when kind = 'sym' then {_id('sym', 'txt')} else {_id('step', 'txt')} end as id from lf),
mn as (select cat_id as id, category as label, cat_file as source_file, null as a, null as b, ord * 1000000::bigint as o, 'Category' as kind from rx union all select sub_id, subcategory, sub_file, null, null, ord * 1000000::bigint + 1, 'Subcategory' from rx
  union all select id, txt, sub_file, a, b, ord * 1000000::bigint + pos + 1, case when kind = 'sym' then 'Symptom' else 'DiagnosisStep' end from lx),
gn as (select id, min_by(label, o) as label, min_by(source_file, o) as source_file, min_by(a, o) as result_a, min_by(b, o) as result_b, min(o) as ord, any_value(kind) as node_type from mn group by id),
gp as (select p.sub_id as source, q.sub_id as target, p.kind, p.txt, p.ord as o1, p.pos as p1, q.ord as o2, q.pos as p2, min(p.ord * 1000000::bigint + p.pos) over (partition by p.kind, p.txt) as seen
  from lx p join lx q on p.kind = q.kind and p.txt = q.txt and p.category <> q.category and (p.ord, p.pos) < (q.ord, q.pos)),
gs as (select * from (select *, row_number() over (partition by least(source, target), greatest(source, target) order by kind desc, seen, o1, p1, o2, p2) as rn from gp) where rn = 1),
ge as (select distinct cat_id as source, sub_id as target, 'HAS_SUBCATEGORY' as relation, 'EXTRACTED' as confidence, 1.0::double as weight from rx
  union select distinct sub_id, id, case when kind = 'sym' then 'HAS_SYMPTOM' else 'HAS_DIAGNOSIS_STEP' end, 'EXTRACTED', 1.0 from lx
  union all select source, target, case when kind = 'sym' then 'SIMILAR_SYMPTOM_TO' else 'SIMILAR_STEP_TO' end, 'INFERRED', 0.8 from gs),
ow as (select subcategory as label, ord, category, subcategory from rec union all select txt, ord, category, subcategory from lf),
la as (select label, max_by(category, ord) as category, max_by(subcategory, ord) as subcategory from ow group by label),
nn as (select g.*, coalesce(l.category, array_to_string(list_transform(string_split(regexp_extract(g.source_file, '([a-z_]+)[.]md$', 1), '_'), lambda w: upper(w[1]) || w[2:]), ' ') || '.Md') as category, coalesce(l.subcategory, '') as subcategory,
  ((g.ord // 1000000) % 4)::int as community from gn g left join la l on l.label = g.label)"""


@query(f"with {_REC} select id, label, source_file, coalesce(result_a, '-') as result_a, coalesce(result_b, '-') as result_b from gn")
def built_nodes(spark, d):
    n = graph.build(records(spark, d))[0]
    return n.select("id", "label", "source_file", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("result_a", "result_b")])


@query(f"with {_REC} select source, target, relation, confidence, weight from ge")
def built_edges(spark, d):
    return graph.build(records(spark, d))[1].select("source", "target", "relation", "confidence", "weight")


@query(f"with {_REC} select kind, txt as label, count(distinct category)::bigint as n_categories, min_by(sub_file, ord * 1000000::bigint + pos) as source_file from lx group by kind, txt")
def shared_labels(spark, d):
    """Categories of each symptom and step, and the first file that mentions it."""
    r = records(spark, d)
    return graph.label_sources(r).select("kind", "label", F.size("categories").cast("long").alias("n_categories"), "source_file")


@query(f"with {_REC} select id, node_type, category, subcategory from nn")
def normalized_nodes(spark, d):
    return built(spark, d)[1].select("id", "node_type", "category", "subcategory")


@query(f"""with {_REC} select id as node_id, case node_type when 'Subcategory' then category || ' > ' || label when 'Symptom' then category || ' > ' || subcategory || ' | Symptom: ' || label
else category || ' > ' || subcategory || ' | Diagnosis: ' || label || case when result_a <> '' then ' | Results: ' || result_a || ' / ' || result_b else '' end end as text from nn where node_type <> 'Category'""")
def embedding_texts(spark, d):
    return graph.embedding_text(built(spark, d)[1])


@query(f"""with {_REC}, s as (select distinct l.subcategory, g.ord, g.label from lx l join gn g on g.id = l.id where l.kind = 'step') select subcategory, string_agg(label, ' | ' order by ord) as steps from s group by 1""")
def inspection_steps_ordered(spark, d):
    _, n, e = built(spark, d)
    return decision.inspection_steps(n, e).select("subcategory", F.array_join("inspection_steps", " | ").alias("steps"))


@query(f"""with {_REC} select sub_id as id, string_agg(txt, ' | ' order by ord, pos) filter (where kind = 'sym') as symptoms, string_agg(txt, ' | ' order by ord, pos) filter (where kind = 'step') as steps from lx group by 1""")
def children_ordered(spark, d):
    _, n, e = built(spark, d)
    return graph.children(n, e.where("relation in ('HAS_SYMPTOM', 'HAS_DIAGNOSIS_STEP')")).select("id", F.array_join("symptoms", " | ").alias("symptoms"), F.array_join("steps", " | ").alias("steps"))


@query(f"""with {_REC}, p as (select target as id, min_by(source, o) as sub_id from (select l.id as target, l.sub_id as source, l.ord * 1000000::bigint + l.pos as o from lx l) group by 1),
s as (select g.id, g.label, case when g.node_type = 'Subcategory' then g.id else p.sub_id end as sub_id from gn g left join p on p.id = g.id)
select s.id, case when s.sub_id is null then '' else s.label || ' belongs to ' || b.subcategory || '. ' || b.subcategory || ' is part of ' || b.category end as chain from s left join rx b on b.sub_id = s.sub_id""")
def chain_sentences(spark, d):
    _, n, e = built(spark, d)
    own = e.where("relation in ('HAS_SUBCATEGORY', 'HAS_SYMPTOM', 'HAS_DIAGNOSIS_STEP')")
    return graph.hierarchy(n, own).select("id", F.array_join("chain", ". ").alias("chain"))


_CV = """cv as (select k.kind, count(*) as total, count(g.label) as found from (select distinct 'category' as kind, category as label from rec union select distinct 'subcategory', subcategory from rec union select distinct case when kind = 'sym' then 'symptom' else 'step' end, txt from lf) k
  left join (select distinct label from gn) g on g.label = k.label group by 1)"""


@query(f"""with {_REC}, {_CV} select kind, total, found from cv""")
def corpus_coverage(spark, d):
    r, n, _ = built(spark, d)
    return graph.coverage(r, n)


@query(f"""with {_REC}, {_CV}, c as (select community, count(distinct case when category <> '' then category end) as k from nn group by 1), x as (select count(*) as n from ge e join nn a on a.id = e.source join nn b on b.id = e.target where a.category <> b.category),
f as (select (select found = total from cv where kind = 'category') as category_coverage, (select found = total from cv where kind = 'subcategory') as subcategory_coverage,
  (select found / total > 0.8 from cv where kind = 'symptom') as symptom_coverage, (select found / total > 0.8 from cv where kind = 'step') as step_coverage,
  (select count(distinct source) from ge where relation = 'HAS_SUBCATEGORY') = (select count(*) from nn where node_type = 'Category') as categories_have_subcategories,
  (select count(distinct source) from ge where relation = 'HAS_SYMPTOM') = (select count(*) from nn where node_type = 'Subcategory') as subcategories_have_symptoms,
  (select count(distinct source) from ge where relation = 'HAS_DIAGNOSIS_STEP') = (select count(*) from nn where node_type = 'Subcategory') as subcategories_have_steps,
  (select count(*) from c) > 10 as communities, (select count(*) filter (where k > 1) / count(*) from c) > 0.5 as multi_category, (select n from x) > 100 as cross_category,
  (select count(*) from (select node_type, lower(trim(label)) from nn group by 1, 2 having count(*) > 1)) = 0 as no_duplicates)
select *, (category_coverage::int + subcategory_coverage::int + symptom_coverage::int + step_coverage::int + categories_have_subcategories::int + subcategories_have_symptoms::int + subcategories_have_steps::int + communities::int + multi_category::int + cross_category::int + no_duplicates::int) as passed,
  case when passed = 11 then 'production ready' when passed >= 9 then 'good' when passed >= 7 then 'acceptable' else 'needs work' end as verdict from f""")
def kg_scorecard(spark, d):
    return graph.scorecard(*built(spark, d))


@query("""with e as (select l_suppkey % 50 as s, l_partkey % 40 as t, l_returnflag as r from lineitem) select distinct 's' || s as source, 't' || t as target, r as relation from e""")
def multi_edges(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey") % 50).alias("source"), F.concat(F.lit("t"), F.col("l_partkey") % 40).alias("target"), F.col("l_returnflag").alias("relation"))
    return graph.multi_edges(e)


@query("""with c as (select distinct s_name as p, p_name as n from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey) select distinct x.p as a, y.p as b from c x join c y on x.n = y.n and x.p < y.p""")
def projected_similarity(spark, d):
    """Suppliers that share a part's name."""
    c = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return graph.projected_similarity(c.select(F.col("s_name").alias("parent_label"), F.col("p_name").alias("norm_label")))


_MERGE = """n as (select 'sym_' || p_partkey as id, upper(p_name) || ' ' as label from part), m as (select id, min(id) over (partition by lower(trim(label))) as keep from n),
e as (select distinct 'sym_' || l_partkey as source, 'sym_' || (l_partkey * 7 % 500) as target from lineitem)"""


@query(f"with {_MERGE} select distinct a.keep as source, b.keep as target from e join m a on a.id = e.source join m b on b.id = e.target")
def merged_entities(spark, d):
    """Parts of one name become one node; the edges that follow them."""
    n = table(spark, d, "part").select(F.concat(F.lit("sym_"), "p_partkey").alias("id"), F.concat(F.upper("p_name"), F.lit(" ")).alias("label"))
    e = table(spark, d, "lineitem").select(F.concat(F.lit("sym_"), "l_partkey").alias("source"), F.concat(F.lit("sym_"), F.col("l_partkey") * 7 % 500).alias("target")).distinct()
    return graph.merged_entities(n, e)[1]


@query(f"with {_KG}, x as (select source as id from e union all select target from e), k as (select id, count(*) as degree from x group by 1) select * from (select id, degree, row_number() over (order by degree desc, id) as rn from k) where rn <= 10".replace("select * from (select id", "select id, degree from (select id"))
def hub_nodes(spark, d):
    return graph.hubs(_kg(spark, d)[1], 10)


@query("""with n as (select p_partkey as id, p_size % 10 as c from part), e as (select distinct p_partkey as s, (p_partkey * 3 + 1) % 2000 as t from part) select e.s as source, e.t as target, a.c as from_community, b.c as to_community from e join n a on a.id = e.s join n b on b.id = e.t where a.c <> b.c""")
def bridge_edges(spark, d):
    e = table(spark, d, "part").select(F.col("p_partkey").alias("source"), ((F.col("p_partkey") * 3 + 1) % 2000).alias("target"))
    return graph.bridges(_part_nodes(spark, d), e)


@query("""with n as (select p_partkey as id, p_name as label, p_size % 10 as c from part), e as (select distinct p_partkey as s, (p_partkey * 3 + 1) % 2000 as t from part),
k as (select id, count(*) as degree from (select s as id from e union all select t from e) group by 1), h as (select n.label, n.id, degree, row_number() over (order by degree desc, n.id) as rn from k join n on n.id = k.id)
select 'hub' as kind, 'What connects "' || label || '" to its ' || degree || ' neighbours?' as question from h where rn <= 5
union all select 'bridge', question from (select 'Why is "' || a.label || '" related to "' || b.label || '"?' as question, row_number() over (order by e.s, e.t) as rn from e join n a on a.id = e.s join n b on b.id = e.t where a.c <> b.c) where rn <= 5""")
def suggested_questions(spark, d):
    e = table(spark, d, "part").select(F.col("p_partkey").alias("source"), ((F.col("p_partkey") * 3 + 1) % 2000).alias("target"))
    return graph.questions(_part_nodes(spark, d), e, 5)


@query(f"""with recursive {_KG}, w as (select source as id, target as other from e union all select target, source from e), l as (select id, id as label, 0 as r from g), p as (
  select id, label, r from l union all select * from (
    select v.id, coalesce(b.label, v.label) as label, v.r + 1 from p v left join (select id, max_by(label, (n, label)) as label, r from (select w.id, q.label, q.r, count(*) as n from w join p q on q.id = w.other group by 1, 2, 3) group by id, r) b on b.id = v.id and b.r = v.r where v.r < 3))
select id, label from p where r = 3""")
def label_rounds(spark, d):
    """Labels after three rounds of propagation."""
    return graph.labels(*_kg(spark, d), rounds=3).select("id", "label")


@query("select lower(label) as label, max_by(community, ord) as community from (select p_name as label, p_size % 10 as community, p_partkey as ord from part) group by 1")
def community_index(spark, d):
    return readers.community_index(_part_nodes(spark, d).withColumn("norm_label", F.lower("label")))[2]


@query("""with h as (select vec_id as q, id, rank from (select q.vec_id, v.vec_id as id, row_number() over (partition by q.vec_id order by round(list_dot_product(q.embedding::double[], v.embedding::double[]), 4) desc, v.vec_id) as rank from embeddings q, embeddings v where q.vec_id % 100 = 0) where rank <= 3),
c as (select q, p_size % 10 as com, count(*) as n, min(rank) as f from h join part on p_partkey = id group by 1, 2), b as (select q, com from (select *, row_number() over (partition by q order by n desc, f) as rn from c) where rn = 1),
m as (select p_size % 10 as com, p_partkey as id, row_number() over (partition by p_size % 10 order by p_partkey) as rn, count(distinct p_brand) over (partition by p_size % 10) as k from part)
select q as query_id, id, b.com as community, case when k > 1 then 0.6 else 0.4 end::double as raw_score, rn::int as rank from b join m using (com) where rn <= 10""")
def voted_community(spark, d):
    v = _vectors(spark, d)
    n = _part_nodes(spark, d)
    hits = vector_topk(v, v.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 10)
    return legacy.voted_community_search(hits, n, graph.community_rollup(n))


@query("""with q as (select p_partkey as query_id, string_split(lower(p_name), ' ') as w from part where p_partkey % 100 = 0), n as (select p_partkey as id, lower(p_name) as l from part), e as (select distinct p_partkey as s, (p_partkey * 3 + 1) % 2000 as t from part),
s as (select distinct query_id, id from (select query_id, unnest(w) as x from q), n where length(x) > 2 and contains(l, x)), f as (select query_id, id, 0 as hop from s union all select distinct s.query_id, e.t, 1 from s join e on e.s = s.id where not exists (select 1 from s z where z.query_id = s.query_id and z.id = e.t)),
o as (select f.*, l, len(list_intersect(list_filter(w, lambda x: length(x) > 2), string_split(l, ' '))) as overlap from f join q using (query_id) join n using (id)),
r as (select query_id, id, hop, overlap::int as overlap, round(greatest(1.0 - hop * 0.3 + overlap * 0.1, 0), 4)::double as raw_score, row_number() over (partition by query_id order by hop, overlap desc, l, id)::int as rank from o) select * from r where rank <= 30""")
def hop_scored(spark, d):
    q = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    e = table(spark, d, "part").select(F.col("p_partkey").alias("source"), ((F.col("p_partkey") * 3 + 1) % 2000).alias("target"))
    return legacy.hop_scored_search(q, _part_nodes(spark, d), e, max_hops=1)


@query("""with c as (select p_partkey // 100 as query_id, p_partkey as id, p_retailprice / 1000 as score, p_size % 10 as com from part), t as (select distinct query_id, com from c),
f as (select query_id, com, p_partkey as id, row_number() over (partition by query_id, com order by p_type <> 'PROMO', p_name, p_partkey) as rn from t join part on p_size % 10 = com where not exists (select 1 from c where c.query_id = t.query_id and c.id = p_partkey)),
b as (select query_id, id, score, 'graph' as source from c union all select query_id, id, 0.15, 'community' from f where rn <= 3) select query_id, id, round(score, 6) as score, source, row_number() over (partition by query_id order by score desc, id)::int as rank from b""")
def community_expansion(spark, d):
    n = _part_nodes(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_type") == "PROMO", "concept").otherwise("document").alias("file_type")), "id")
    c = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 100).alias("query_id"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 1000).alias("score"), F.lit("graph").alias("source"))
    return legacy.expand(c, n, most=3).withColumn("score", F.round("score", 6))


_STRONG = """st as (select p_partkey // 50 as query_id, p_partkey as node_id, p_name as label, ['Symptom', 'Subcategory', 'DiagnosisStep', 'Category'][p_partkey % 4 + 1] as node_type, p_brand as category, p_type as subcategory, p_size % 10 as community, (p_partkey * 37 % 100) / 100.0::double as confidence from part)"""


def _entities(spark, d):
    return _part_nodes(spark, d).select(F.floor(F.col("id") / 50).alias("query_id"), F.col("id").alias("node_id"), "label", "node_type", "category", "subcategory", "community", (F.col("id") * 37 % 100 / 100.0).alias("confidence"), (F.col("id") % 7 / 10.0).alias("weighted_score"))


@query(f"with {_STRONG}, b as (select *, node_id % 7 / 10.0 as ws, max(confidence) over (partition by query_id) as best from st) select query_id, node_id, confidence, row_number() over (partition by query_id order by confidence desc, ws desc, node_id)::int as ord from b where confidence >= 0.15 and confidence >= best * 0.7")
def strong_entities(spark, d):
    return preprocess.strong_entities(_entities(spark, d)).select("query_id", "node_id", "confidence", "ord")


@query(f"""with {_STRONG} select query_id, array_to_string(list_sort(list(distinct community)), ',') as communities, array_to_string(list_sort(list(distinct category)), ',') as categories, array_to_string(list_sort(list(distinct node_type)), ',') as node_types from st where confidence >= 0.5 group by 1""")
def retrieval_hints(spark, d):
    h = preprocess.hints(_entities(spark, d).where("confidence >= 0.5"))
    return h.select("query_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("communities", "categories", "node_types")])


_SENSOR_ROWS = ", ".join(f"('{k}', '{x}')" for k, v in CATEGORY_SENSORS.items() for x in v)


@query(f"""with t(category, sensor) as (values {_SENSOR_ROWS}), c as (select row_number() over (order by category) - 1 as k, category from (select distinct category from t)), e as (select p_partkey // 2 as query_id, category from part join c on c.k = p_partkey * 7 % 13)
select query_id, string_agg(distinct sensor, ',' order by sensor) as sensors from e join t using (category) group by 1""")
def expected_sensors(spark, d):
    names = sorted(CATEGORY_SENSORS)
    e = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 2).alias("query_id"), F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") * 7 % 13 + 1).cast("int")).alias("category"))
    h = preprocess.hints(e.withColumns({"community": F.lit(1), "node_type": F.lit("Symptom")}))
    return h.select("query_id", F.array_join("expected_sensors", ",").alias("sensors"))


@query(f"""with {_STRONG}, e as (select p_partkey as s, (p_partkey * 3 + 1) % 2000 as t, case when p_partkey % 3 = 0 then 'CAUSES' when p_partkey % 3 = 1 then 'CONNECTED_TO' else 'OTHER' end as relation, 1.0 - p_partkey % 4 / 10.0 as weight from part),
l as (select s as id, t as other, relation, weight from e union all select t, s, relation, weight from e), m as (select distinct query_id, community from st),
x as (select st.query_id, n.p_name as label, confidence * weight * 0.9 as score from st join l on l.id = st.node_id join part n on n.p_partkey = l.other
  where confidence >= 0.7 and relation <> 'OTHER' and (relation = 'CONNECTED_TO' or exists (select 1 from m where m.query_id = st.query_id and m.community = n.p_size % 10))),
y as (select query_id, label, max(score) as score from x group by 1, 2) select query_id, label, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, label) as rn from y) where rn <= 20""")
def neighbour_terms(spark, d):
    kind = F.when(F.col("p_partkey") % 3 == 0, "CAUSES").when(F.col("p_partkey") % 3 == 1, "CONNECTED_TO").otherwise("OTHER")
    e = table(spark, d, "part").select(F.col("p_partkey").alias("source"), ((F.col("p_partkey") * 3 + 1) % 2000).alias("target"), kind.alias("relation"), (1.0 - F.col("p_partkey") % 4 / 10.0).alias("weight"))
    return preprocess.neighbour_terms(_entities(spark, d), _part_nodes(spark, d), graph.neighbours(e)).withColumn("score", F.round("score", 6))


@query(f"""with {_STRONG}, sub as (select distinct lower(p_brand) as cat, p_type as sub from part), p as (select distinct lower(a.sub) as sub, b.sub as sibling from sub a join sub b on a.cat = b.cat and a.sub <> b.sub),
x as (select query_id, node_id, sibling, confidence, row_number() over (partition by query_id, node_id order by sibling) as rn from st join p on p.sub = lower(st.subcategory) where confidence >= 0.7 and lower(sibling) <> lower(label)) select query_id, sibling as label, max(confidence) as score from x where rn <= 5 group by 1, 2""")
def sibling_terms(spark, d):
    return preprocess.sibling_terms(_entities(spark, d), _part_nodes(spark, d))


@query("""with q as (select p_partkey as query_id, p_name || ' brand' as q, regexp_extract_all(lower(p_name || ' brand'), '[a-z0-9]+') as w from part where p_partkey % 100 = 0), l as (select distinct p_name as label from part),
x as (select distinct query_id, q, word from (select query_id, q, unnest(list_distinct(w)) as word from q) where length(word) > 2), y as (select x.*, label, row_number() over (partition by query_id, word order by label) as rn from x join l on list_contains(string_split(label, ' '), x.word))
select distinct query_id, label as variant from y where rn <= 5 and not contains(label, q) and len(list_filter(string_split(q, ' '), lambda t: not list_contains(string_split(label, ' '), t))) > 0""")
def label_variants(spark, d):
    q = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.concat("p_name", F.lit(" brand")).alias("processed"))
    return preprocess.label_variants(q, _part_nodes(spark, d))


@query("""with n as (select p_partkey as id, (p_size % 10 % 17)::int as color, case p_partkey % 4 when 3 then 30 when 1 then 20 when 0 then 12 else 8 end as size, left(p_name, 30) as short_label from part) select * from n""")
def display_nodes(spark, d):
    e = table(spark, d, "part").select(F.col("p_partkey").alias("source"), F.col("p_partkey").alias("target"), F.lit("r").alias("relation"), F.lit(1.0).alias("weight"))
    return sinks.display_graph(_part_nodes(spark, d), e)[0].withColumn("color", F.col("color").cast("int"))


@query("""with c as (select p_size % 10 as community, count(*) as size, string_agg(distinct p_brand, ', ' order by p_brand) as cats from part group by 1), t as (select *, row_number() over (order by size desc, community) as rn from c)
select community::int as community, '## Community ' || community || chr(10) || '- nodes: ' || size || chr(10) || '- categories: ' || cats as value from t where rn <= 5""")
def community_markdown(spark, d):
    return sinks.community_report(graph.community_rollup(_part_nodes(spark, d)), 5).withColumn("community", F.col("community").cast("int"))


@query(f"""with {_REC}, p as (select ord, category, '## ' || subcategory || chr(10) || '- ' || symptoms[1] || chr(10) || '- ' || symptoms[2] || chr(10) || '1. ' || steps[1].step || ' (' || steps[1].a || ' / ' || steps[1].b || ')' || chr(10) || '2. ' || steps[2].step || ' ()' || chr(10)
  || symptoms[1] || ' is a symptom of ' || subcategory || '.' || chr(10) || symptoms[2] || ' is a symptom of ' || subcategory || '.' as part from rec) select category, '# ' || category || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) order by ord) as value from p group by 1""")
def corpus_markdown(spark, d):
    return sinks.corpus_markdown(records(spark, d))


@query("""with l as (select p_partkey % 3 as k, p_partkey as id, p_name from part) select id, case when k = 0 then p_name when k = 1 then 'x' || id else '' end as label from l""")
def derived_labels(spark, d):
    """Labels of nodes; where one is missing, what follows the colon of its id, else nothing."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("label"), F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("sym:x"), "p_partkey")).otherwise(F.lit("plain")).alias("id"))
    return legacy.labelled(p).select(F.col("key").alias("id"), "label")


@query("""select p_partkey as id, case when k < 2 then '' else array_to_string(list_filter([case when c <> '' then c end, case when s <> '' and s <> c then s end, l], lambda x: x is not null), ' → ') end as chain
from (select p_partkey, p_brand as c, case when p_partkey % 3 = 0 then p_brand when p_partkey % 3 = 1 then '' else p_type end as s, p_name as l, 2 as k from part)""")
def context_chains(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("category"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, "").otherwise(F.col("p_type")).alias("subcategory"), F.col("p_name").alias("label"))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(decision.context_chain("category", "subcategory", "label", F.array().cast("array<string>")), " → ").alias("chain"))


@query("""with q as (select p_partkey as query_id, list_distinct(string_split(p_name, ' ')) as w from part where p_partkey % 100 = 0), n as (select p_partkey as id, p_name as label, list_distinct(string_split(p_name, ' ')) as w, p_size % 10 as com, row_number() over (partition by p_size % 10 order by p_partkey) - 1 as mo from part),
k as (select com, count(distinct p_brand) > 1 as multi from (select p_size % 10 as com, p_brand from part) group by 1), r as (select query_id, id, n.com, mo, len(list_intersect(q.w, n.w)) as o from q join n on n.com = q.query_id % 3 or n.com = 5 where len(list_intersect(q.w, n.w)) > 0),
t as (select *, row_number() over (partition by query_id, com order by o desc, mo) as rn from r), b as (select * from t where rn <= 3) select query_id, id, com::int as community, round(case when multi then 0.45 else 0.30 end + o * 0.15 + o * 0.05, 4)::double as raw_score, row_number() over (partition by query_id order by com, rn)::int as rank from b join k using (com)""")
def community_top3(spark, d):
    """Two hinted communities a query; the parts' words are their stems."""
    n = _part_nodes(spark, d)
    q = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"), F.array_distinct(F.array(F.col("p_partkey") % 3, F.lit(5).cast("long"))).alias("communities"))
    return retrieval.community_search(q, n, graph.community_rollup(n)).withColumn("community", F.col("community").cast("int"))
