"""Knowledge graph: build, similarity, traversal, hierarchy, communities and quality.

Graphs are two tables, nodes (id, label, ...) and edges (source, target, relation, ...).
Where the reference depends on record order, rows carry it as ``ord``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import node_id, slug, title
from ..runtime import COPIED_BYTES, copied, cut, stored
from .modularity import components

#: Members of a block of parents that are paired with another block in one row.
PAIR_ROWS = 256
#: Pairs of blocks that a task takes, about.
TASK_BLOCKS = 256
#: Records of a text that are sent in one row at most, about.
BLOCK_ROWS = 1024
#: Bytes of records' names that are copied to the tasks, at most, and rows (pairs, one a text) that a task makes distinct, about.
NAMES_BYTES, TASK_PAIRS = 8 * COPIED_BYTES, 1 << 21
#: Bytes in memory of a node of a search, at most about; and the sources whose values are in one row, as a power of two.
NODE_BYTES, PACK_BITS = 80, 6
#: Links of a component that a task holds at most, those of small components that are searched together, about, and
#: links times sources of a task at least, where there are as many.
TASK_LINKS, SMALL_LINKS, TASK_WORK = 1 << 22, 1 << 10, 1 << 24
#: Sources that are searched at once in a task, at most, and cells of a matrix of nodes (or links) and sources, about.
TASK_SOURCES, TASK_CELLS = 32, 1 << 20

NODE_PREFIX = {"Category": "cat_", "Subcategory": "subcat_", "Symptom": "sym_", "DiagnosisStep": "step_"}


def build(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of fault records (ord, category, subcategory, symptoms, diagnosis_steps), both with their own ord.

    ord is the order of first mention.  The first record that mentions a node names its source file; a later edge with the
    same ends replaces an earlier one, similarity edges coming last.
    """
    spark = records.sparkSession
    sub_file = f"concat('data/corpus/', {slug('category')}, '/', {slug('subcategory')}, '.md')"
    cat_file = f"concat('data/corpus/', {slug('category')}, '.md')"
    r = records.selectExpr("ord", "category", "subcategory", f"{node_id('cat', 'category')} as cat_id", f"{node_id('subcat', 'subcategory')} as sub_id", f"{cat_file} as cat_file", f"{sub_file} as sub_file", "symptoms", "diagnosis_steps")
    leaf = spark.sql(f"""
      select ord, 1 + at as at, 'sym' as kind, category, sub_id, sub_file, s as text, {node_id('sym', 's')} as id, cast(null as array<string>) as result from {{r}} lateral view posexplode(symptoms) as at, s
      union all
      select ord, 100000 + at, 'step', category, sub_id, sub_file, d.step, {node_id('step', 'd.step')}, d.result from {{r}} lateral view posexplode(diagnosis_steps) as at, d
    """, r=r)
    nodes = spark.sql("""
      select id, min_by(label, o) as label, 'document' as file_type, min_by(file, o) as source_file, min_by(a, o) as result_a, min_by(b, o) as result_b, min(o.ord * 1000000L + o.at) as ord from (
        select cat_id as id, category as label, cat_file as file, null as a, null as b, named_struct('ord', ord, 'at', 0) as o from {r}
        union all select sub_id, subcategory, sub_file, null, null, named_struct('ord', ord, 'at', 1) from {r}
        union all select id, text, sub_file, if(kind = 'step', coalesce(get(result, 0), ''), null), if(kind = 'step', coalesce(get(result, 1), ''), null), named_struct('ord', ord, 'at', at + 1) from {leaf})
      group by id
    """, r=r, leaf=leaf)
    edges = spark.sql("""
      select source, target, max_by(struct(relation, confidence, source_file, weight, label), o) as e, min(o.late * 1000000000000000L + o.ord * 1000000L + o.at) as ord from (
        select cat_id as source, sub_id as target, 'HAS_SUBCATEGORY' as relation, 'EXTRACTED' as confidence, cat_file as source_file, 1.0D as weight, cast(null as string) as label, named_struct('late', 0, 'ord', ord, 'at', 0) as o from {r}
        union all select sub_id, id, if(kind = 'sym', 'HAS_SYMPTOM', 'HAS_DIAGNOSIS_STEP'), 'EXTRACTED', sub_file, 1.0D, null, named_struct('late', 0, 'ord', ord, 'at', at) from {leaf}
        union all select source, target, relation, 'INFERRED', source_file, 0.8D, label, named_struct('late', if(relation = 'SIMILAR_SYMPTOM_TO', 1, 2), 'ord', seen.ord, 'at', seen.at) from {similar})
      group by source, target
    """, r=r, leaf=leaf, similar=similarity_edges(leaf)).select("source", "target", "e.*", "ord")
    return nodes, edges


def label_sources(records: DataFrame) -> DataFrame:
    """(kind, label, categories, source_file): each symptom and step with its categories and the file of its first mention."""
    own = lambda kind, labels, base: records.select("ord", "category", "subcategory", F.lit(kind).alias("kind"), F.posexplode(labels).alias("at", "label")).withColumn("at", F.col("at") + base)
    rows = own("sym", F.col("symptoms"), 1).union(own("step", F.transform("diagnosis_steps", lambda s: s["step"]), 100000))
    file = F.expr(f"concat('data/corpus/', {slug('category')}, '/', {slug('subcategory')}, '.md')")
    return rows.groupBy("kind", "label").agg(F.array_sort(F.collect_set("category")).alias("categories"), F.min_by(file, F.struct("ord", "at")).alias("source_file"))


def _dense(df: DataFrame, order: list, name: str, number: str) -> DataFrame:
    """df, stored, with its rows numbered from 0 without gaps in the order given, as integers."""
    rows = stored(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(part).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row a written part
    return rows.withColumn("part", part).join(F.broadcast(base), "part").withColumn(number, (F.col("at") - F.shiftleft("part", 33) + F.col("base")).cast("int")).drop("at", "part", "base")


def similarity_edges(leaf: DataFrame) -> DataFrame:
    """Subcategories of different categories that share a symptom or step, once a pair; symptoms come before steps.

    leaf has ord, at, kind, category, sub_id, sub_file, text; ord is a record's.  Records and texts that several categories
    have are numbered in their order.  A record is sent, for each of its texts, the numbers of the later records that
    have it, in one row a block (blocks of a text that many have meet each other); rows for every pair are made only where all those of a record are, in as many tasks as keep them in
    memory, and leave as one a pair: their records' names are copied there up to NAMES_BYTES, so pairs are not shuffled.
    """
    leaf = stored(leaf.select("ord", "at", "kind", "category", "sub_id", "sub_file", "text"), "leaf")
    records = _dense(leaf.select("ord", "category", "sub_id").distinct(), ["ord", "category", "sub_id"], "records", "r")
    n, subs = records.agg(F.count("*"), F.count_distinct("sub_id")).first()
    groups = _dense(leaf.select("category").distinct(), ["category"], "categories", "c")
    files = _dense(leaf.select("sub_file").distinct(), ["sub_file"], "files", "f")
    names = lambda df: F.broadcast(df) if 2 * NODE_BYTES * n <= NAMES_BYTES else df
    records = stored(records.join(names(groups), "category"), "numbers")
    rows = leaf.join(names(records), ["ord", "category", "sub_id"]).join(names(files), "sub_file")
    rows = rows.select("kind", "text", "r", "c", "f", (F.col("r") * F.lit(1 << 31) + F.col("at")).alias("seen"))
    least = int(leaf.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(least, leaf.count() // TASK_PAIRS + 1), "kind", "text")
    shared = rows.groupBy("kind", "text").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("members"), F.min_by("f", "seen").alias("f"), F.min("seen").alias("seen")).where("low <> high")
    texts = stored(shared.drop("low", "high").orderBy(F.desc("kind"), "seen", "text").withColumn("first", F.monotonically_increasing_id()), "texts")
    own = rows.select("kind", "text", "r").distinct().join(texts.select("kind", "text", "first", "members"), ["kind", "text"])
    block = F.expr("pmod(xxhash64(r), div(members + {0} - 1, {0}))".format(BLOCK_ROWS)).alias("block")
    blocks = stored(own.groupBy("kind", "text", "first", "members", block).agg(F.collect_list("r").alias("others")).select("first", F.col("members") <= BLOCK_ROWS, "others").toDF("first", "whole", "others"), "blocks")
    many = blocks.where("not whole").select("first", "others")
    met = blocks.where("whole").select("first", F.col("others").alias("held"), "others").union(many.withColumnRenamed("others", "held").join(many, "first").select("first", "held", "others"))
    later = met.select("first", "others", F.explode("held").alias("r")).select("first", "r", F.expr("filter(others, x -> x > r)").alias("others")).where("size(others) > 0")
    made = texts.agg(F.sum(F.col("members") * (F.col("members") - 1) / 2)).first()[0] or 0
    pairs = later.repartition(max(least, int(made // TASK_PAIRS) + 1), "r").select("r", "first", F.explode("others").alias("other")).groupBy("r", "other").agg(F.min("first").alias("first"))
    x = records.select("r", F.col("sub_id").alias("source"), F.col("c").alias("c1"))
    y = records.select(F.col("r").alias("other"), F.col("sub_id").alias("target"), F.col("c").alias("c2"))
    if subs < n:  # of several records of a pair the first text's and then the first ones count
        x, y = x.withColumn("o1", F.col("r")), y.withColumn("o2", F.col("other"))
    pairs = pairs.join(names(x), "r").join(names(y), "other").where("c1 <> c2")
    if subs < n:
        w = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target")).orderBy("first", "o1", "o2")
        pairs = pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    about = texts.join(names(files), "f").join(names(records.select(F.shiftleft(F.col("r").cast("long"), 31).alias("from"), "ord")), F.shiftleft(F.shiftright("seen", 31), 31) == F.col("from"))
    about = about.select("first", "kind", "text", F.col("sub_file").alias("source_file"), F.struct("ord", (F.col("seen") - F.col("from")).cast("int").alias("at")).alias("seen"))
    found = pairs.select("source", "target", "first").join(about.dropDuplicates(["first"]), "first", "left")  # left out where only pairs are asked for
    return found.select("source", "target", F.when(F.col("kind") == "sym", "SIMILAR_SYMPTOM_TO").otherwise("SIMILAR_STEP_TO").alias("relation"), "source_file", F.col("text").alias("label"), "seen")


def projected_similarity(children: DataFrame) -> DataFrame:
    """(a, b): labels of parents that share a child's norm_label, each pair once in order; children has parent_label, norm_label.

    Parents with the same set of norm_labels are one class.  Classes meet by norm_label, and
    only pairs of classes are made distinct; their members are then paired in blocks, so
    each pair is made once.  Pairs of blocks are dealt by number, and a task holds the two blocks that it pairs:
    they are copied to the tasks up to NAMES_BYTES.
    """
    own = children.where("parent_label is not null and norm_label is not null").select("parent_label", "norm_label").distinct()
    sets = own.groupBy("parent_label").agg(F.array_sort(F.collect_list("norm_label")).alias("held"))
    parents = stored(sets.select("parent_label", F.sha2(F.to_json("held"), 256).alias("class"), "held"), "parents")
    held = parents.groupBy("class").agg(F.any_value("held").alias("held")).select("class", F.explode("held").alias("norm_label"))
    meet = held.join(held.withColumnRenamed("class", "other"), "norm_label").where("class <= other").select("class", "other").distinct()
    at = F.row_number().over(Window.partitionBy("class", "salt").orderBy("parent_label"))
    dealt = parents.select("class", "parent_label", F.pmod(F.xxhash64("parent_label"), F.lit(64)).alias("salt"))
    blocks = dealt.withColumn("part", F.floor((at - 1) / PAIR_ROWS)).groupBy("class", "salt", "part").agg(F.collect_list("parent_label").alias("members")).select("class", "members")
    blocks = stored(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    n, size = blocks.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("members", F.lit(0), lambda k, m: k + NODE_BYTES + F.octet_length(m))), F.lit(0))).first()
    number = lambda c, k: copied(blocks.select(F.col("class").alias(c), F.col("block").alias(k)), 2 * NODE_BYTES * n)
    met = stored(meet.join(number("class", "x"), "class").join(number("other", "y"), "other").where("class <> other or x <= y").select("x", "y"), "met")
    tasks = max(int(children.sparkSession.conf.get("spark.sql.shuffle.partitions")), met.count() // TASK_BLOCKS + 1)
    xs, ys = (blocks.select(F.col("block").alias(k), F.col("members").alias(f"{k}s")) for k in ("x", "y"))
    if 2 * size <= NAMES_BYTES:
        xs, ys = F.broadcast(xs), F.broadcast(ys)
    both = met.repartition(tasks, "x", "y").join(xs, "x").join(ys, "y")
    pairs = both.select("x", "y", F.explode("xs").alias("p"), "ys").select("x", "y", "p", F.explode("ys").alias("q"))
    return pairs.where("x <> y or p < q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def multi_edges(edges: DataFrame) -> DataFrame:
    """Edges that differ in relation kept apart, repeats dropped."""
    return edges.dropDuplicates(["source", "target", "relation"])


def merged_entities(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of one type whose lower-cased trimmed labels are equal become the one with the least id; edges follow."""
    key = F.lower(F.trim("label"))
    to = nodes.select("id", F.min("id").over(Window.partitionBy(key, F.element_at(F.split("id", "_"), 1))).alias("to"))
    kept = nodes.join(to.where("id = to").select("id"), "id", "left_semi")
    s, t = to.select(F.col("id").alias("source"), F.col("to").alias("s")), to.select(F.col("id").alias("target"), F.col("to").alias("t"))
    moved = edges.join(s, "source").join(t, "target")
    return kept, moved.withColumns({"source": F.col("s"), "target": F.col("t")}).select(*edges.columns).dropDuplicates(["source", "target"])


def normalized(nodes: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """nodes with node_type by id prefix, category and subcategory by record (the last one) or by source path."""
    kind = F.lit("Unknown")
    for k, prefix in NODE_PREFIX.items():
        kind = F.when(F.col("id").startswith(prefix), k).otherwise(kind)
    part = lambda i: F.expr(title(f"replace(regexp_replace(coalesce(get(split(source_file, '/'), {i}), ''), '[.]md$', '.Md'), '_', ' ')"))
    out = nodes.withColumns({"node_type": kind, "_c": part(2), "_s": part(3)})
    if records is None:
        return out.withColumns({"category": F.col("_c"), "subcategory": F.col("_s")}).drop("_c", "_s")
    own = records.select("ord", "category", "subcategory", F.explode(F.concat(F.array("subcategory"), "symptoms", F.transform("diagnosis_steps", lambda d: d["step"]))).alias("label"))
    last = own.groupBy("label").agg(F.max_by(F.struct("category", "subcategory"), "ord").alias("r"))
    return out.join(last, "label", "left").withColumns({"category": F.coalesce("r.category", "_c"), "subcategory": F.coalesce("r.subcategory", "_s")}).drop("_c", "_s", "r")


def bfs(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(query_id, id, hop): nodes within max_hops out-edges of each query's seeds, by least hop.

    seeds has query_id and id.  Each hop joins the frontier alone and drops what was seen.
    """
    out = cut(seeds.select("query_id", "id", F.lit(0).alias("hop")).distinct())
    front = out
    step = edges.select(F.col("source").alias("id"), "target").distinct()
    for hop in range(1, max_hops + 1):
        front = front.join(step, "id").select("query_id", F.col("target").alias("id")).distinct().join(out, ["query_id", "id"], "left_anti").withColumn("hop", F.lit(hop))
        out = out.union(front)
    return out


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, other, relation, weight) of edges both ways."""
    pick = lambda a, b: edges.select(F.col(a).alias("id"), F.col(b).alias("other"), "relation", "weight")
    return pick("source", "target").union(pick("target", "source"))


def hierarchy(nodes: DataFrame, edges: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """(id, subcategory_id, subcategory, category_id, category, chain): first Subcategory parent, then first Category parent.

    edges carry ord; nodes node_type and label.  A subcategory is its own subcategory.
    """
    e = edges if relations is None else edges.where(F.col("relation").isin(*relations))
    n = nodes.select("id", "label", "node_type")

    def parent(kind):
        up = e.join(n.where(F.col("node_type") == kind).select(F.col("id").alias("source"), F.col("label").alias("name")), "source")
        return up.groupBy(F.col("target").alias("id")).agg(F.min_by(F.struct(F.col("source").alias("pid"), F.col("name").alias("plabel")), F.struct("ord", "source")).alias("p"))

    subs, cats = parent("Subcategory"), parent("Category")
    s = n.join(subs, "id", "left").select("id", "label", "node_type", F.when(F.col("node_type") == "Subcategory", F.struct(F.col("id").alias("pid"), F.col("label").alias("plabel"))).otherwise(F.col("p")).alias("s"))
    c = s.join(cats.select(F.col("id").alias("sid"), F.col("p").alias("c")), F.col("s.pid") == F.col("sid"), "left")
    chain = F.concat(F.when(F.col("s").isNotNull(), F.array(F.concat("label", F.lit(" belongs to "), F.col("s.plabel")))).otherwise(F.array().cast("array<string>")), F.when(F.col("c").isNotNull(), F.array(F.concat(F.col("s.plabel"), F.lit(" is part of "), F.col("c.plabel")))).otherwise(F.array().cast("array<string>")))
    return c.select("id", F.col("s.pid").alias("subcategory_id"), F.col("s.plabel").alias("subcategory"), F.col("c.pid").alias("category_id"), F.col("c.plabel").alias("category"), chain.alias("chain"))


def children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, symptoms, steps): labels below each subcategory in edge order."""
    e = edges.select("source", "target", "relation", "ord").join(nodes.select(F.col("id").alias("target"), "label"), "target")
    kids = lambda rel: F.transform(F.array_sort(F.collect_list(F.when(F.col("relation") == rel, F.struct("ord", "label")))), lambda x: x["label"])
    return e.where("relation in ('HAS_SYMPTOM', 'HAS_DIAGNOSIS_STEP')").groupBy(F.col("source").alias("id")).agg(kids("HAS_SYMPTOM").alias("symptoms"), kids("HAS_DIAGNOSIS_STEP").alias("steps"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): ends of edges at each node; a loop counts twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, top: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(top)


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between communities."""
    c = nodes.select("id", "community")
    both = edges.join(c.select(F.col("id").alias("source"), F.col("community").alias("from_community")), "source").join(c.select(F.col("id").alias("target"), F.col("community").alias("to_community")), "target")
    return both.where("from_community <> to_community")


def _added(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds each of values to the row of total that rows, in order, give."""
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    total[rows[first]] += np.add.reduceat(values, first, axis=0)


def _flows(i: np.ndarray, j: np.ndarray, part: int, parts: int) -> np.ndarray:
    """What runs over each link (i, j) on the shortest paths from the nodes of a part, all nodes being numbered from 0.

    Blocks of sources are searched level by level, a level as its nodes and a matrix of their
    numbers of paths from each source; shares of paths come back level by level.
    """
    n, m = int(max(i.max(), j.max())) + 1, len(i)
    ends, other = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.argsort(ends, kind="stable")
    near, to = ends[order], other[order]
    at = np.empty(2 * m, np.int64)
    at[order] = np.arange(2 * m)
    back = at[(order + m) % (2 * m)]  # where the same link is from its other end
    first = np.searchsorted(near, np.arange(n + 1))
    place, flow = np.full(n, -1), np.zeros(2 * m)
    width = max(1, min(TASK_SOURCES, TASK_CELLS // n))
    step = TASK_CELLS // width

    def out(nodes):
        k = first[nodes + 1] - first[nodes]
        return np.arange(k.sum()) + np.repeat(first[nodes] - np.cumsum(k) + k, k), np.repeat(np.arange(len(nodes)), k)

    own = np.array_split(np.arange(n), parts)[part]
    for s in (own[k : k + width] for k in range(0, len(own), width)):
        seen, levels = np.zeros((n, len(s)), bool), [(s, np.eye(len(s)))]
        seen[s, np.arange(len(s))] = True
        while True:
            nodes, paths = levels[-1]
            place[nodes] = np.arange(len(nodes))
            e = np.sort(back[out(nodes)[0]])
            w, v = near[e], place[to[e]]
            reach, at = np.unique(w, return_inverse=True)
            total = np.zeros((len(reach), len(s)))
            for k in range(0, len(e), step):
                _added(total, at[k : k + step], paths[v[k : k + step]])
            total[seen[reach]] = 0
            new = total.any(axis=1)
            if not new.any():
                break
            reach, total = reach[new], total[new]
            seen[reach] |= total > 0
            levels.append((reach, total))
        share = np.zeros_like(levels[-1][1])
        for (nodes, paths), (beyond, far) in zip(levels[-2::-1], levels[:0:-1], strict=True):
            each = np.divide(1 + share, far, out=np.zeros_like(far), where=far > 0)
            place[:] = -1
            place[beyond] = np.arange(len(beyond))
            e, v = out(nodes)
            w = place[to[e]]
            e, v, w = e[w >= 0], v[w >= 0], w[w >= 0]
            share = np.zeros_like(paths)
            for k in range(0, len(e), step):
                cell = slice(k, k + step)
                runs = each[w[cell]] * paths[v[cell]]
                flow[e[cell]] += runs.sum(axis=1)
                _added(share, v[cell], runs)
    return np.bincount(order % m, flow, m)


def _searched(links: pa.Table) -> pa.Table:
    i, j = (links[c].to_numpy().astype(np.int64) for c in ("i", "j"))
    flow = _flows(i, j, links["part"][0].as_py(), links["parts"][0].as_py())
    return pa.table({"bin": links["bin"], "i": links["i"], "j": links["j"], "flow": pa.array(flow)})


def _exact(pairs: DataFrame) -> Iterator[DataFrame]:
    """(a, b, flow) of distinct links, paths starting from every node.

    A component of TASK_LINKS at most is searched by tasks that hold it, each from a part of its nodes; small ones
    share a task.  Larger ones are searched as ``_shares`` does.
    """
    spark = pairs.sparkSession
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    found = components(stored(pairs.union(pairs.select("b", "a")), "links"), ids)
    m = pairs.join(found.withColumnRenamed("id", "a"), "a").groupBy("component").agg(F.count("*").alias("m"))
    sizes = stored(found.groupBy("component").agg(F.count("*").alias("n")).join(m, "component"), "sizes")
    held, alone = F.col("m") <= TASK_LINKS, F.col("m") > SMALL_LINKS
    work, small, rest = sizes.agg(F.sum(F.when(held, F.col("n") * F.col("m"))), F.sum(F.when(~alone, F.col("m"))), F.count_if(~held)).first()
    share = max(TASK_WORK, (work or 0) // (4 * spark.sparkContext.defaultParallelism))
    mixed = F.pmod(F.xxhash64("component"), F.lit((small or 0) // SMALL_LINKS + 1))
    bins = sizes.where(held).select("component", F.when(alone, F.xxhash64("component")).otherwise(mixed).alias("bin"), F.when(alone, F.least("n", F.ceil(F.col("n") * F.col("m") / share))).otherwise(1).cast("int").alias("parts"))
    number = F.row_number().over(Window.partitionBy("bin").orderBy("id")) - 1
    nodes = stored(found.join(bins, "component").select("id", "bin", "parts", number.alias("at")), "nodes")
    links = pairs.join(nodes.select(F.col("id").alias("a"), "bin", "parts", F.col("at").alias("i")), "a").join(nodes.select(F.col("id").alias("b"), F.col("at").alias("j")), "b")
    parts = links.select("bin", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", "i", "j")
    flows = parts.groupBy("bin", "part").applyInArrow(_searched, "bin long, i int, j int, flow double").groupBy("bin", "i", "j").agg(F.sum("flow").alias("flow"))
    a, b = (nodes.select("bin", F.col("at").alias(k), F.col("id").alias(c)) for k, c in (("i", "a"), ("j", "b")))
    yield flows.join(a, ["bin", "i"]).join(b, ["bin", "j"]).select("a", "b", "flow")
    if rest:
        large = found.join(sizes.where(~held), "component", "left_semi").withColumnRenamed("id", "a")
        yield _joined(stored(pairs.join(large, "a", "left_semi"), "links"), None)[0]


def _shares(pairs: DataFrame, sources: int | None) -> tuple[DataFrame, int, float]:
    """(s, v, hop, paths, share) of each node v that a source s reaches over links (a, b), with the number of these rows; all nodes for each source.

    paths counts the shortest ones from s to v, share what of the paths to nodes beyond runs over v.  A level meets the
    links as they are stored; one that is small is copied to the tasks, so that links aren't shuffled.
    """
    links = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("v", "w")
    ids = stored(links.select("v").distinct(), "ids")
    start = ids.orderBy(F.md5("v"), "v").limit(sources) if sources is not None else ids
    first = stored(start.select(F.monotonically_increasing_id().alias("s"), "v", F.lit(0).alias("hop"), F.lit(1.0).alias("paths")), "level")
    levels, sizes = [first], [first.count()]
    while True:  # a node of the next level was neither on this one nor on the one before
        reach = links.join(copied(levels[-1], NODE_BYTES * sizes[-1]), "v").groupBy("s", F.col("w").alias("v")).agg(F.lit(len(levels)).alias("hop"), F.sum("paths").alias("paths"))
        for near, n in zip(levels[-2:], sizes[-2:], strict=True):
            reach = reach.join(copied(near.select("s", "v"), NODE_BYTES * n), ["s", "v"], "left_anti")
        reach = stored(reach, "level")
        n = reach.count()
        if not n:
            break
        levels.append(reach)
        sizes.append(n)
    if NODE_BYTES * sum(sizes) <= COPIED_BYTES:  # the way back needs only links between nodes that were reached
        links = stored(links.join(F.broadcast(reduce(DataFrame.union, levels).select("v").distinct()), "v", "left_semi"), "near")
    found = [levels[-1].withColumn("share", F.lit(0.0))]
    for level, beyond in zip(reversed(levels[:-1]), reversed(sizes[1:]), strict=True):
        far = found[-1].select("s", F.col("v").alias("w"), ((1 + F.col("share")) / F.col("paths")).alias("each"))
        back = links.join(copied(far, NODE_BYTES * beyond), "w").groupBy("s", "v").agg(F.sum("each").alias("each"))
        found.append(stored(level.join(back, ["s", "v"], "left").select("s", "v", "hop", "paths", F.coalesce(F.col("paths") * F.col("each"), F.lit(0.0)).alias("share")), "shares"))
    return reduce(DataFrame.union, found), sum(sizes), ids.count() / max(sizes[0], 1)


def _joined(pairs: DataFrame, sources: int | None) -> tuple[DataFrame, float]:
    """(a, b, flow) of distinct links, and all nodes for each source.

    What runs over a link follows from its two ends, which a source reaches both or
    neither: they meet once, in the end, with the values of PACK sources in one row.
    """
    reached, n, scale = _shares(pairs, sources)
    here = F.struct("s", "hop", "paths", ((1 + F.col("share")) / F.col("paths")).alias("each"))
    held = reached.groupBy("v", F.shiftright("s", PACK_BITS).alias("pack")).agg(F.sort_array(F.collect_list(here)).alias("held"))
    if n * NODE_BYTES * 2 <= COPIED_BYTES:
        held = stored(held, "held")
    x, y = (copied(held.select(F.col("v").alias(c), "pack", F.col("held").alias(h)), n * NODE_BYTES * 2) for c, h in (("a", "x"), ("b", "y")))
    flow = F.expr("aggregate(zip_with(x, y, (p, q) -> case q.hop - p.hop when 1 then p.paths * q.each when -1 then q.paths * p.each else 0D end), 0D, (t, z) -> t + z)")
    total = pairs.join(x, "a", "left").join(y, ["b", "pack"], "left").select("a", "b", F.coalesce(flow, F.lit(0.0)).alias("flow"))
    if sources is None or sources > 1 << PACK_BITS:
        total = total.groupBy("a", "b").agg(F.sum("flow").alias("flow"))
    return total, scale


def betweenness(edges: DataFrame, sources: int | None = None) -> DataFrame:
    """(a, b, score): how many shortest paths from the sources run over each link, each pair of ends counting one in all.

    Links are undirected, unweighted and distinct, loops left out; a < b.  None takes paths from every node,
    which is exact: components are searched in tasks, and work grows with their nodes times their links.
    ``sources`` bounds the nodes that paths start from (those of least md5 of the id), and scores are
    scaled to all nodes.  Then it goes level by level from all
    sources at once: numbers of shortest paths go outwards, then shares of the paths that
    end beyond a node come back.  Each level is a join with the links and a written
    table of nodes, so there are as many rounds as the longest of the shortest paths has links; rows that
    are written are sources times nodes.
    """
    ends = edges.select(F.col("source").cast("string").alias("u"), F.col("target").cast("string").alias("v")).where("u <> v")
    pairs = stored(ends.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "links")
    if sources is None:
        total, scale = reduce(DataFrame.union, _exact(pairs)), 1.0
    else:
        total, scale = _joined(pairs, sources)
    return total.select("a", "b", (F.col("flow") * scale / 2).alias("score"))


def surprising(nodes: DataFrame, edges: DataFrame, top: int | None = None, sources: int | None = None) -> DataFrame:
    """(source, target, from_community, to_community, score): links between communities, those that most shortest paths need first.

    Edges of equal ends are one link; ties go by the ids.  ``top`` keeps the first ones
    (the report's length), None all; ``sources`` is as in ``betweenness``.
    """
    own = stored(nodes.select(F.col("id").cast("string").alias("id"), "community").dropDuplicates(["id"]), "own")
    n = own.count()
    community = lambda c, name: copied(own.select(F.col("id").alias(c), F.col("community").alias(name)), NODE_BYTES * n)
    scored = betweenness(edges, sources).join(community("a", "from_community"), "a").join(community("b", "to_community"), "b")
    found = scored.where("from_community <> to_community").select(F.col("a").alias("source"), F.col("b").alias("target"), "from_community", "to_community", "score")
    if top is None:  # a sort of all reads its rows twice
        found = stored(found, "found")
    first = found.orderBy(F.desc("score"), "source", "target")
    return first.limit(top) if top is not None else first


def questions(nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(kind, question): what to ask about the first hubs, and about the first edges between communities."""
    label = nodes.select("id", "label")
    hub = hubs(edges, most).join(label, "id").select(F.lit("hub").alias("kind"), F.concat(F.lit('What connects "'), "label", F.lit('" to its '), "degree", F.lit(" neighbours?")).alias("question"))
    first = bridges(nodes, edges).orderBy("source", "target").limit(most)
    ends = first.join(label.select(F.col("id").alias("source"), F.col("label").alias("a")), "source").join(label.select(F.col("id").alias("target"), F.col("label").alias("b")), "target")
    return hub.union(ends.select(F.lit("bridge"), F.concat(F.lit('Why is "'), "a", F.lit('" related to "'), "b", F.lit('"?'))))


def labels(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, label): synchronous label propagation; a node takes its neighbours' heaviest label, the greatest on ties.

    Rounds go on until no label changes, or ``rounds`` are done where it is given.  Links
    weigh the same both ways, so labels settle or alternate between two states (as in
    bipartite graphs); a node that alternates then takes the lesser of its two labels.
    """
    links = neighbours(edges.withColumn("relation", F.lit(""))).where("id <> other").groupBy("id", "other").agg(F.sum("weight").alias("weight"))
    own = nodes.select("id", F.col("id").alias("label"), F.col("id").alias("past"))
    done = 0
    while rounds is None or done < rounds:
        votes = links.join(own.select(F.col("id").alias("other"), "label"), "other").groupBy("id", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("id").agg(F.max(F.struct("w", "label")).alias("b"))
        now = F.when(F.col("b").isNotNull(), F.col("b.label")).otherwise(F.col("label"))
        moved = cut(own.join(best, "id", "left").select("id", now.alias("label"), F.col("label").alias("past"), F.col("past").alias("before")))
        own, done = moved.drop("before"), done + 1
        if rounds is not None:
            continue
        changed, apart = moved.agg(F.count_if(F.col("label") != F.col("past")), F.count_if(F.col("label") != F.col("before"))).first()
        if not changed:
            break
        if done > 1 and not apart:
            own = own.withColumn("label", F.least("label", "past"))
            break
    return own.select("id", "label")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, community): communities of equal ``labels``, numbered from the largest, ties by label.

    A stand-in for modularity methods: it finds dense groups, not the same partition.
    Numbers come from the sorted list of community sizes (one row a community).
    """
    found = labels(nodes, edges, rounds)
    size = found.groupBy("label").agg(F.count("*").alias("n"))
    order = size.select("label", (F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1).alias("community"))
    return found.join(order, "label").select("id", "community")


def community_rollup(nodes: DataFrame) -> DataFrame:
    """(community, node_ids, categories, is_multi_category, size)."""
    g = nodes.where("community is not null").groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("node_ids"), F.array_sort(F.collect_set(F.when(F.col("category") != "", F.col("category")))).alias("categories"))
    return g.select("community", "node_ids", "categories", (F.size("categories") > 1).alias("is_multi_category"), F.size("node_ids").alias("size"))


def community_stats(rollup: DataFrame) -> DataFrame:
    return rollup.agg(F.count("*").alias("total"), F.count_if("is_multi_category").alias("multi"), F.avg("size").alias("avg_size"), F.max("size").alias("max_size"), F.min("size").alias("min_size"), F.count_if(F.size("categories") == 0).alias("anonymous"))


def coverage(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, total, found): distinct corpus labels of each kind, and how many are node labels."""
    labels = lambda kind, c: records.select(F.lit(kind).alias("kind"), c.alias("label"))
    own = labels("category", F.col("category")).union(labels("subcategory", F.col("subcategory"))).union(labels("symptom", F.explode("symptoms"))).union(labels("step", F.explode(F.transform("diagnosis_steps", lambda d: d["step"])))).distinct()
    have = nodes.select("label").distinct().withColumn("hit", F.lit(1))
    return own.join(have, "label", "left").groupBy("kind").agg(F.count("*").alias("total"), F.count("hit").alias("found"))


def cross_category(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n): edges between categories, by unordered pair."""
    c = nodes.where("category <> ''").select("id", "category")
    both = edges.join(c.select(F.col("id").alias("source"), F.col("category").alias("s")), "source").join(c.select(F.col("id").alias("target"), F.col("category").alias("t")), "target")
    return both.where("s <> t").groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.count("*").alias("n"))


def duplicate_labels(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.lower(F.trim("label")).alias("label")).agg(F.count("*").alias("n")).where("n > 1")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n) of nodes by type and edges by relation."""
    return nodes.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("name")).agg(F.count("*").alias("n")).union(edges.groupBy(F.lit("edge").alias("kind"), F.col("relation").alias("name")).agg(F.count("*").alias("n")))


def field_coverage(nodes: DataFrame) -> DataFrame:
    """(field, share) of non-null values."""
    agg = nodes.agg(*[(F.count(c) / F.count("*")).alias(c) for c in nodes.columns])
    return agg.selectExpr(f"stack({len(nodes.columns)}, {', '.join(f'{chr(39)}{c}{chr(39)}, `{c}`' for c in nodes.columns)}) as (field, share)")


def scorecard(records: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: eleven checks as booleans, how many passed, and the verdict."""
    cov = coverage(records, nodes).groupBy().pivot("kind", ["category", "subcategory", "symptom", "step"]).agg(F.max(F.col("found") / F.col("total")))
    has = lambda rel: F.count_distinct(F.when(F.col("relation") == rel, F.col("source")))
    ends = edges.agg(has("HAS_SUBCATEGORY").alias("cats"), has("HAS_SYMPTOM").alias("with_sym"), has("HAS_DIAGNOSIS_STEP").alias("with_step"))
    kinds = nodes.agg(F.count_if(F.col("node_type") == "Category").alias("n_cat"), F.count_if(F.col("node_type") == "Subcategory").alias("n_sub"))
    com = community_stats(community_rollup(nodes)).select("total", "multi")
    cross = cross_category(nodes, edges).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("crossing"))
    dup = nodes.groupBy("node_type", F.lower(F.trim("label"))).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("dups"))
    row = cov.crossJoin(ends).crossJoin(kinds).crossJoin(com).crossJoin(cross).crossJoin(dup)  # one row each
    checks = {
        "category_coverage": "category = 1", "subcategory_coverage": "subcategory = 1", "symptom_coverage": "symptom > 0.8", "step_coverage": "step > 0.8", "categories_have_subcategories": "cats = n_cat",
        "subcategories_have_symptoms": "with_sym = n_sub", "subcategories_have_steps": "with_step = n_sub", "communities": "total > 10", "multi_category": "multi / total > 0.5", "cross_category": "crossing > 100", "no_duplicates": "dups = 0",
    }
    flags = row.select(*[F.coalesce(F.expr(v), F.lit(False)).alias(k) for k, v in checks.items()])
    passed = sum((F.col(k).cast("int") for k in checks), F.lit(0))
    verdict = F.when(passed == len(checks), "production ready").when(passed >= 9, "good").when(passed >= 7, "acceptable").otherwise("needs work")
    return flags.withColumns({"passed": passed, "verdict": verdict})


def embedding_text(nodes: DataFrame) -> DataFrame:
    """(node_id, text) of nodes that are embedded: subcategories, symptoms and steps, each with its place."""
    sub = F.concat_ws(" > ", "category", "label")
    place = F.concat_ws(" > ", "category", "subcategory")
    results = F.array_join(F.filter(F.array(F.coalesce("result_a", F.lit("")), F.coalesce("result_b", F.lit(""))), lambda x: x != ""), " / ")
    step = F.concat(place, F.lit(" | Diagnosis: "), F.col("label"), F.when(results != "", F.concat(F.lit(" | Results: "), results)).otherwise(F.lit("")))
    text = F.when(F.col("node_type") == "Subcategory", sub).when(F.col("node_type") == "Symptom", F.concat(place, F.lit(" | Symptom: "), F.col("label"))).otherwise(step)
    return nodes.where(F.col("node_type").isin("Subcategory", "Symptom", "DiagnosisStep")).select(F.col("id").alias("node_id"), text.alias("text"))
