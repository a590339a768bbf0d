"""Communities by modularity, logs of many files, the stored vector index, quantiles and gap filling under skew."""

import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from torqueline.functions.similarity import indel, vector_topk
from torqueline.functions.vector_index import VectorIndex
from torqueline.operators import graph, modularity, preprocess, profiling, retrieval
from torqueline.sources import logs


def quality(edges, labels):
    """Modularity of {node: community} over weighted pairs, by its definition."""
    total, inside, degree = 0.0, 0.0, {}
    for a, b, w in edges:
        if a != b:
            total += w
            inside += w * (labels[a] == labels[b])
            for x in (a, b):
                degree[labels[x]] = degree.get(labels[x], 0.0) + w
    return inside / total - sum((d / (2 * total)) ** 2 for d in degree.values())


@pytest.fixture(scope="module")
def clustered(spark):
    rng = random.Random(1)
    pairs = [(c * 10 + rng.randrange(10), c * 10 + rng.randrange(10), float(rng.randint(1, 3))) for c in range(5) for _ in range(30)]
    pairs += [(rng.randrange(50), rng.randrange(50), 1.0) for _ in range(15)] + [(3, 3, 5.0)]
    return pairs, spark.createDataFrame(pairs, "source long, target long, weight double"), spark.range(52)


def test_modularity_and_moves(spark, clustered):
    pairs, edges, nodes = clustered
    links = modularity.both_ways(edges)
    labels = {i: i % 7 for i in range(52)}
    own = nodes.select("id", (F.col("id") % 7).alias("community"))
    now = quality(pairs, labels)
    assert modularity.modularity(links, own).first()[0] == pytest.approx(now)
    best = {r.id: r for r in modularity.moves(links, own).collect()}
    for i in range(50):
        gains = {c: quality(pairs, labels | {i: c}) - now for c in range(7)}
        top = max(gains.values())
        if top > 1e-9:
            assert best[i].gain == pytest.approx(top, abs=1e-9)
            assert gains[best[i].best] == pytest.approx(top, abs=1e-9)
        else:
            assert i not in best


def test_partition(spark, clustered):
    """At least as good as label propagation and the planted groups; communities are connected; nodes without links stand alone."""
    pairs, edges, nodes = clustered
    found = {r.id: r.community for r in modularity.partition(nodes, edges).collect()}
    assert found[50] == 50
    assert found[51] == 51
    spread = {r.id: r.community for r in graph.communities(nodes, edges.withColumn("relation", F.lit(""))).collect()}
    planted = {i: i // 10 for i in range(52)}
    assert quality(pairs, found) >= max(quality(pairs, spread), quality(pairs, planted)) - 1e-9
    for c in set(found.values()):
        members = {i for i, x in found.items() if x == c}
        assert min(members) == c
        seen, todo = {c}, [c]
        while todo:
            x = todo.pop()
            new = {b if a == x else a for a, b, _ in pairs if x in (a, b)} & members - seen
            seen |= new
            todo += new
        assert seen == members
    assert modularity.partition(nodes.limit(0), edges.limit(0)).count() == 0


def test_csv_logs(spark, tmp_path):
    """Different columns and units a file, quoted cells, repeated and empty names, short rows, and files read in pieces."""
    (tmp_path / "a.csv").write_text('﻿t,"p,1",t,\ns,"ba""r",x,\n' + "".join(f"{i},{i / 2},9,9\n\n" for i in range(500)) + "bad\n")
    (tmp_path / "b.csv").write_text("rpm\n1/min\n5\n")
    (tmp_path / "c.csv").write_text("t\ns\n")
    (tmp_path / "d.csv").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = logs.csv_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found = {(r.file[-5:], r.row_idx, r.sensor, r.unit): r.value for r in rows}
    want = {("a.csv", i, "t", "s"): float(i) for i in range(500)} | {("a.csv", i, "p,1", 'ba"r'): i / 2 for i in range(500)}
    want |= {("a.csv", 500, "t", "s"): None, ("a.csv", 500, "p,1", 'ba"r'): None, ("b.csv", 0, "rpm", "1/min"): 5.0}
    assert found == want
    assert len(rows) == len(want)


def test_workbooks(spark, tmp_path):
    """Written workbooks read back; shared strings, places without names, several sheets; what is no workbook is an error."""
    rows = [("x", 0, "t", "s", 1.5), ("x", 2, "t", "s", -2.0), ("x", 1, "p & q", None, None), ("y", 0, "t", "<s>", 1e-300)]
    readings = spark.createDataFrame(rows, "file string, row_idx long, sensor string, unit string, value double")
    made = logs.workbooks(readings)
    got = {(r.file, r.row_idx, r.sensor): (r.unit, r.value) for r in logs.parsed(made).collect()}
    assert got == {
        ("x", 0, "t"): ("s", 1.5), ("x", 1, "t"): ("s", None), ("x", 2, "t"): ("s", -2.0), ("x", 0, "p & q"): ("", None), ("x", 1, "p & q"): ("", None), ("x", 2, "p & q"): ("", None),
        ("y", 0, "t"): ("<s>", 1e-300),
    }
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="C2" t="s"><v>0</v></c></row><row r="5"><c r="A5"><v>7</v></c><c r="C5" t="s"><v>1</v></c></row>'
    with zipfile.ZipFile(tmp_path / "z.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="one" r:id="a"/><sheet name="two" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>t</t></si><si><r><t>p</t></r><r><t>q</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f"<worksheet><sheetData>{head}</sheetData></worksheet>")
        z.writestr("xl/worksheets/s2.xml", "<worksheet><sheetData/></worksheet>")
    found = [tuple(r)[1:] for r in logs.workbook_logs(spark, str(tmp_path)).collect()]
    assert sorted(found) == [("one", 0, "pq", "t", None), ("one", 0, "t", None, 7.0)]
    with pytest.raises(Exception, match="zip"):
        logs.parsed(spark.createDataFrame([("f", b"no zip")], "file string, content binary")).collect()


def test_vector_index(spark, tmp_path):
    """Batches replace and deletions remove; all lists give what a full search gives; a part of the lists finds most."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.2 * rng.normal(size=16)).tolist()) for i in range(600)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = VectorIndex.create(v.where("id < 400").withColumn("embedding", F.when(F.col("id") < 390, F.col("embedding")).otherwise(F.reverse("embedding"))), str(tmp_path / "index"), lists=12, sample=200)
    index.add(v.where("id >= 390").union(spark.createDataFrame([(None, [0.0] * 16), (5000, None)], v.schema)))
    index.delete(v.where("id % 50 = 0").select("id"))
    index.add(v.where("id = 100"))
    held = v.where("id % 50 <> 0 or id = 100")
    queries = v.where("id % 60 = 7").withColumnRenamed("id", "query_id")
    true = {(r.query_id, r.rank): (r.id, r.raw_score) for r in vector_topk(held, queries, 5).collect()}
    for again in (VectorIndex(spark, str(tmp_path / "index")), index):
        assert {r.id for r in again.vectors().collect()} == {r.id for r in held.select("id").collect()}
        assert {(r.query_id, r.rank): (r.id, r.raw_score) for r in again.search(queries, 5, probes=None).collect()} == true
        index.compact()
    probes = index.probes_for(0.95, 5)
    assert probes <= 12
    near = {(r.query_id, r.id) for r in index.search(queries, 5, probes=probes).collect()}
    assert sum((q, i) in near for (q, _), (i, _) in true.items()) >= 0.9 * len(true)
    with pytest.raises(ValueError, match="vectors"):
        VectorIndex.create(v.limit(0), str(tmp_path / "none"))


def test_quantiles_under_skew(spark):
    """Exact for outliers, ties, constants, exponents and few values; only values near the ranks are kept."""
    rng = np.random.default_rng(1)
    data = {"out": np.r_[rng.normal(size=30000), 1e12], "const": np.full(3000, 3.0), "few": np.array([1.0, 5.0, 2.0]), "ties": rng.integers(0, 3, 9000).astype(float)}
    data |= {"exp": np.exp(rng.normal(size=9000) * 8), "n1024": rng.normal(size=1024), "n1025": rng.normal(size=1025)}
    readings = spark.createDataFrame([(k, float(x)) for k, a in data.items() for x in a], "sensor string, value double").repartition(4)
    shares = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {r.sensor: r for r in profiling.quantiles(readings, ["sensor"], shares).collect()}
    for k, a in data.items():
        assert got[k].n == len(a)
        assert np.allclose(got[k].q, np.quantile(a, shares), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("segment", [1, 4, 1 << 16])
def test_gaps_across_segments(spark, segment):
    """Filled by position as over one sorted column, wherever segments end; gaps in row numbers and null keys too."""
    import pandas as pd

    rng, rows, want = random.Random(4), [], {}
    for key in ("a", "b", None, "none"):
        at = sorted(rng.sample(range(100), 40))
        values = [None if key == "none" or rng.random() < 0.6 else rng.random() for _ in at]
        rows += [(key, i, x) for i, x in zip(at, values, strict=True)]
        filled = pd.Series(values, dtype=float).interpolate(limit_direction="forward")
        want |= {(key, i): x for i, x in zip(at, filled, strict=True)}
    readings = spark.createDataFrame(rows, "sensor string, row_idx long, value double").repartition(3)
    got = {(r.sensor, r.row_idx): r.value for r in profiling.interpolated(readings, ["sensor"], segment=segment).collect()}
    assert set(got) == set(want)
    for k, x in want.items():
        assert got[k] is None if x != x else got[k] == pytest.approx(x)


def test_similar_words(spark):
    """All pairs that reach the threshold, repeated letters and very long words among them."""
    rng = random.Random(7)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["aaaaaa", "aaaaa", "a", "ababab", "é" * 4 + "x"]
    long = "".join(rng.choice("abcdefgh") for _ in range(10000))
    words = [*base, long[:5000] + long[5010:]]
    vocabulary = [*(w[: len(w) // 2] + rng.choice("abz") + w[len(w) // 2 :] for w in base), *base, long]
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    for threshold in (60.0, 82.0, 95.0):
        want = {(a, b) for a in set(base) for b in set(vocabulary[:-1]) if indel(a, b) >= threshold} | {(words[-1], long)}
        got = preprocess.similar_words(frame(words), frame(vocabulary), threshold).collect()
        assert {(r.word, r.match) for r in got} == want
        assert all(r.ratio == pytest.approx(indel(r.word, r.match)) for r in got if len(r.word) < 99)


def test_holders(spark):
    words = ["engine", "gin", "misfire", "fire", "aaaa", "aaa", "ab", "xaaaay", "é€engé"]
    frame = lambda x, c: spark.createDataFrame([(w,) for w in x], f"{c} string")
    got = {tuple(r) for r in retrieval.holders(frame([*words, "zzz"], "k"), frame(words, "lw")).collect()}
    assert got == {(k, w) for k in words for w in words if len(k) > 2 and k in w}


def test_similar_entities(spark):
    labels = ["Engine misfire", "engine  misfires", "engine misfirez", "Brake fade", "brake  fade", None, "", "unrelated words"]
    nodes = spark.createDataFrame(list(enumerate(labels)), "id long, label string")
    got = {r.id: r.entity for r in modularity.similar_entities(nodes, 92.0).collect()}
    assert got == {0: "engine misfire", 1: "engine misfire", 2: "engine misfire", 3: "brake fade", 4: "brake fade", 5: None, 6: "", 7: "unrelated words"}


def test_blocked_correlations(spark):
    """Against pairwise-complete numpy correlations: gaps, far-off means, a constant, an empty and an infinite sensor, odd names; sums kept or handed out."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 7)) + np.array([0, 1e9, 5, 0, 0, 0, 0])
    x[:, 2] += 3 * x[:, 0]
    x[:, 3] = 4.5
    known = rng.random((500, 7)) > 0.3
    known[:, 4] = False
    x[7, 5], known[7, 5] = np.inf, True
    names = ["a.b", "b", "c", "bi", "s", "v", "_part"]
    rows = [[float(v) if k else None for v, k in zip(*r, strict=True)] for r in zip(x, known, strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(5)
    for size in ({}, {"block": 3, "chunk": 64}, {"block": 2, "chunk": 50, "room": 0, "fan": 2}):
        got = {(r.sensor_a, r.sensor_b): (r.n, r.r) for r in profiling.blocked_correlations(df, names, **size).collect()}
        assert len(got) == 49
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                both = known[:, i] & known[:, j]
                n, r = got[a, b]
                assert n == both.sum()
                if 5 in (i, j) and both[7]:
                    assert np.isnan(r)
                elif 4 in (i, j) or 3 in (i, j):
                    assert r is None
                else:
                    assert abs(r - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-7
    assert [(r.n, r.r) for r in profiling.blocked_correlations(df.limit(0), ["b", "c"]).collect()] == [(0, None)] * 4
    assert profiling.blocked_correlations(df, []).count() == 0


def betweenness_of(pairs):
    """Exact edge betweenness by its definition: shares of shortest paths of every pair of nodes, by breadth-first counts."""
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    far, paths = {}, {}
    for s in near:
        far[s], paths[s], level = {s: 0}, {s: 1}, [s]
        while level:
            reach = {}
            for v in level:
                for w in near[v]:
                    if w not in far[s]:
                        reach[w] = reach.get(w, 0) + paths[s][v]
            for w, n in reach.items():
                far[s][w], paths[s][w] = far[s][level[0]] + 1, n
            level = list(reach)
    score = {}
    for a, b in {(min(x), max(x)) for x in pairs if x[0] != x[1]}:
        score[a, b] = 0.0
        for s in near:
            for t in far[s]:
                for v, w in ((a, b), (b, a)):
                    if s < t and v in far[s] and w in far[t] and far[s][v] + 1 + far[t][w] == far[s][t]:
                        score[a, b] += paths[s][v] * paths[t][w] / paths[s][t]
    return score


def test_betweenness(spark):
    """Exact from all nodes: two dense groups and one bridge, a separate pair, loops, repeats and both directions."""
    rng = random.Random(4)
    pairs = [(f"{g}{rng.randrange(8)}", f"{g}{rng.randrange(8)}") for g in "ab" for _ in range(16)] + [("a1", "b2"), ("b2", "a1"), ("a1", "b2"), ("x", "y"), ("z", "z")]
    edges = spark.createDataFrame(pairs, "source string, target string")
    got = {(r.a, r.b): r.score for r in graph.betweenness(edges).collect()}
    want = betweenness_of(pairs)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    nodes = spark.createDataFrame([(x, ord(x[0]) if x[0] in "ab" else 0) for x in sorted({x for p in pairs for x in p})], "id string, community int")
    first = graph.surprising(nodes, edges, top=3).collect()
    assert [(r.source, r.target, r.from_community, r.to_community) for r in first] == [("a1", "b2", ord("a"), ord("b"))]
    assert graph.betweenness(edges.limit(0)).count() == 0
