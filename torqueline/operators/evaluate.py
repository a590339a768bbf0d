"""Evaluation of decided queries: distributions, sweeps, gaps, movements and refinement combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..presets import DEFAULTS


def mode_stats(decided: DataFrame) -> DataFrame:
    """(mode, n, lo, hi, mean, upper_median) of confidence; the median is element n // 2 of the sorted values."""
    g = decided.groupBy("mode").agg(F.count("*").alias("n"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi"), F.avg("confidence").alias("mean"), F.array_sort(F.collect_list("confidence")).alias("c"))
    return g.select("mode", "n", "lo", "hi", "mean", F.element_at("c", (F.floor(F.col("n") / 2) + 1).cast("int")).alias("upper_median"))


def by_system(decided: DataFrame) -> DataFrame:
    return decided.groupBy("system").pivot("mode", ["EXTRACTED", "AMBIGUOUS"]).agg(F.count(F.lit(1))).na.fill(0)


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, correct, wrong, score, best): scored has confidence and expected (boolean); a miss costs three."""
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    g = scored.select("confidence", "expected", t).groupBy("threshold").agg(F.count_if((F.col("confidence") >= F.col("threshold")) == F.col("expected")).alias("correct"), F.count_if((F.col("confidence") >= F.col("threshold")) != F.col("expected")).alias("wrong"))
    g = g.withColumn("score", F.col("correct") - 3 * F.col("wrong"))
    return g.withColumn("best", F.row_number().over(Window.orderBy(F.desc("score"), "threshold")) == 1)


def components(decided: DataFrame) -> DataFrame:
    """(query_id, component, contribution, running, crosses, dominant): shares of the confidence in their order."""
    s = DEFAULTS
    parts = [("retrieval", F.col("calibrated_retrieval") * s.retrieval_share), ("separation", F.col("separation") * s.separation_share), ("coverage", F.col("coverage") * s.coverage_share), ("sensor", F.col("sensor_boost"))]
    rows = decided.select("query_id", F.posexplode(F.array(*[F.struct(F.lit(k).alias("component"), v.cast("double").alias("contribution")) for k, v in parts])).alias("at", "x")).select("query_id", "at", "x.*")
    w = Window.partitionBy("query_id").orderBy("at")
    rows = rows.withColumn("running", F.sum("contribution").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    crosses = (F.col("running") >= s.mode_threshold) & (F.col("running") - F.col("contribution") < s.mode_threshold)
    return rows.withColumns({"crosses": crosses, "dominant": F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("contribution"), "at")) == 1}).drop("at")


def score_gaps(ranked: DataFrame) -> DataFrame:
    """(query_id, avg_gap, max_gap) between consecutive scores."""
    gap = F.lag("score").over(Window.partitionBy("query_id").orderBy("rank")) - F.col("score")
    return ranked.withColumn("gap", gap).groupBy("query_id").agg(F.avg("gap").alias("avg_gap"), F.max("gap").alias("max_gap"))


def inversions(ranked: DataFrame) -> DataFrame:
    """(query_id, n): candidates of a query that raw and final rank order differently; pairs are within its few candidates."""
    r = ranked.select("query_id", "rank_raw", "rank_final")
    a, b = r.alias("a"), r.alias("b")
    return a.join(b, F.expr("a.query_id = b.query_id and a.rank_raw < b.rank_raw")).groupBy("a.query_id").agg(F.count_if(F.expr("a.rank_final > b.rank_final")).alias("n"))


def movements(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, id, rank_before, rank_after, movement): new, dropped, moved or same."""
    j = before.select("query_id", "id", F.col("rank").alias("rank_before")).join(after.select("query_id", "id", F.col("rank").alias("rank_after")), ["query_id", "id"], "full")
    return j.withColumn("movement", F.when(F.col("rank_before").isNull(), "new").when(F.col("rank_after").isNull(), "dropped").when(F.col("rank_before") != F.col("rank_after"), "moved").otherwise("same"))


def expected_position(candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, position): first rank whose label holds the expected text; null if none."""
    hit = candidates.join(expected, "query_id").where("contains(lower(label), lower(expected_label))").groupBy("query_id").agg(F.min("rank").alias("position"))
    return expected.select("query_id").join(hit, "query_id", "left")


def refinements(seeds: DataFrame, options: list[str]) -> DataFrame:
    """(query_id, combo, text): every non-empty subset of the options appended to each seed, comma-joined."""
    picked = F.filter(F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(o).alias("o")) for i, o in enumerate(options)]), lambda x: x["bit"].bitwiseAND(F.col("combo")) > 0)
    rows = seeds.select("query_id", "text", F.explode(F.sequence(F.lit(1), F.lit((1 << len(options)) - 1))).alias("combo"))
    return rows.select("query_id", "combo", F.concat_ws(", ", F.array(F.col("text")), F.transform(picked, lambda x: x["o"])).alias("text"))


def refinement_effect(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, improved, worsened, mode_changed) over a seed's combinations; both have query_id, confidence, mode."""
    b = before.select("query_id", F.col("confidence").alias("c0"), F.col("mode").alias("m0"))
    return after.join(b, "query_id").groupBy("query_id").agg(F.count_if(F.col("confidence") > F.col("c0")).alias("improved"), F.count_if(F.col("confidence") < F.col("c0")).alias("worsened"), F.count_if(F.col("mode") != F.col("m0")).alias("mode_changed"))
