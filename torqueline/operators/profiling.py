"""Sensor statistics over readings (keys..., sensor, value): cleaning, summaries, tests and rankings.

All operators work on the long form, so a table's columns are rows: what only some
logs have is simply absent, and one query serves every condition at once.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import absolute_change
from ..functions.similarity import t_p_value
from ..presets import DEFAULTS, IGNORED_SENSORS, Settings
from ..runtime import stored


#: Row numbers of a segment of a log.
SEGMENT = 1 << 16


def interpolated(readings: DataFrame, keys: list[str], order: str = "row_idx", segment: int = SEGMENT) -> DataFrame:
    """Gaps in value filled by position between their neighbours; a leading gap stays, a trailing one takes the last value.

    order is a row number (nulls come first).  A segmented scan: each segment of row
    numbers counts its rows and gives its first and last known value; over the segments, a few rows a log, go
    the rows before and the known values next to each; then each segment is filled by itself, so a log
    needn't be in one task.
    """
    own = [*keys, "_seg"]
    seg = F.coalesce(F.floor(F.col(order) / segment).cast("long"), F.lit(-(1 << 62)))
    inside = Window.partitionBy(*own).orderBy(order)
    r = readings.withColumn("_seg", seg).withColumn("_at", F.row_number().over(inside))
    known = F.col("value").isNotNull()
    here = F.when(known, F.struct(F.col("_at").cast("long").alias("at"), F.col("value").alias("v")))
    each = r.groupBy(*own).agg(F.count("*").alias("_n"), F.min(here).alias("_first"), F.max(here).alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_seg")
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("_before", before)
    shifted = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(c)["at"] + F.col("_before")).alias("at"), F.col(c)["v"].alias("v")))
    each = each.withColumns({"_first": shifted("_first"), "_last": shifted("_last")})
    each = each.withColumns({"_left": F.last("_last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)), "_right": F.first("_first", True).over(along.rowsBetween(1, Window.unboundedFollowing))})
    side = each.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(own)], "_before", "_left", "_right")
    r = r.join(side, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(own)]).drop(*[f"_key{i}" for i in range(len(own))])
    r = r.withColumn("_at", F.col("_at") + F.col("_before"))
    here = F.when(known, F.struct(F.col("_at").alias("at"), F.col("value").alias("v")))
    back = F.last(here, True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(here, True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    r = r.withColumns({"_0": F.coalesce(back, "_left"), "_1": F.coalesce(ahead, "_right")})
    between = F.col("_0.v") + (F.col("_1.v") - F.col("_0.v")) * (F.col("_at") - F.col("_0.at")) / (F.col("_1.at") - F.col("_0.at"))
    filled = F.when(known, F.col("value")).when(F.col("_1").isNull(), F.col("_0.v")).when(F.col("_0").isNotNull(), between)
    return r.withColumn("value", filled).drop("_seg", "_at", "_before", "_left", "_right", "_0", "_1")


def informative(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Readings of sensors that aren't empty and not constant within their keys."""
    kept = readings.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo < hi").select(*keys)
    return readings.join(kept, keys, "left_semi")


def cleaned(readings: DataFrame, keys: list[str], order: str = "row_idx") -> DataFrame:
    """NaN to null, gaps filled, then empty and constant sensors dropped."""
    known = readings.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return informative(interpolated(known, keys, order), keys)


#: Shares of the values between which a wanted rank is looked for, and parts into which what is left is cut again.
NEAR, PARTS = 1 / 256, 64
#: A sketch is off by one in ACCURACY of the ranks at most; sensors of up to FEW values need none.
ACCURACY, FEW = 1024, 1024


def _asked_bins(rows: DataFrame, keys: list[str], asked: DataFrame) -> DataFrame:
    """(keys..., _bin, _before, _asked): the bins of counted rows (keys..., _bin, _k) in which ranks of asked (keys..., _asked) lie, and how many values stand before."""
    held = rows.groupBy(*keys, "_bin").agg(F.sum("_k").alias("_k"))
    held = held.withColumn("_before", F.sum("_k").over(Window.partitionBy(*keys).orderBy("_bin")) - F.col("_k")).join(asked, keys)  # a row a bin
    inside = F.filter("_asked", lambda a: (a["rank"] >= F.col("_before")) & (a["rank"] < F.col("_before") + F.col("_k")))
    own = F.transform(inside, lambda a: F.struct(a["i"].alias("i"), (a["rank"] - F.col("_before")).alias("rank")))
    return held.select(*keys, "_bin", own.alias("_asked")).where("size(_asked) > 0")


def quantiles(readings: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(keys..., n, q): exact linear quantiles of each sensor's values; NaN is the largest value.

    Distributed selection.  A sketch of each sensor gives bounds just below and above
    each share, exact counts between the bounds tell where the wanted ranks lie, and only
    those few values (NEAR on each side) are shuffled: counted, cut again into PARTS parts of equal number, and then
    sorted.  Bounds follow ranks, so outliers don't fill a bin, and the sketch's error is well
    below NEAR, so the wanted ranks are between them; the last sort has about NEAR / PARTS of a sensor's
    different values.  Two passes over readings; bounds and the few values are written in between.
    """
    v = readings.where("value is not null").select(*keys, "value")
    cuts = [min(max(x, 0.0), 1.0) for s in shares for x in (s - NEAR, s + NEAR)]
    edge = v.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("value", cuts, ACCURACY).alias("_cuts"))
    at = [F.lit(s) * (F.col("n") - 1) for s in shares]
    ranks = F.array(*[F.struct(F.lit(2 * i + up).alias("i"), (F.ceil(x) if up else F.floor(x)).cast("long").alias("rank")) for i, x in enumerate(at) for up in (0, 1)])
    edge = stored(edge.withColumn("_asked", ranks).coalesce(1), "bounds")  # a row a sensor
    low, high = ([F.col("_cuts")[2 * i + j] for i in range(len(shares))] for j in (0, 1))
    place = sum(((F.col("value") >= x).cast("int") for x in low), F.lit(0)) + sum(((F.col("value") > x).cast("int") for x in high), F.lit(0))
    close = reduce(or_, [(F.col("value") >= x) & (F.col("value") <= y) for x, y in zip(low, high, strict=True)], F.col("n") <= FEW)
    bins = v.join(edge.select(*keys, "n", "_cuts"), keys).groupBy(*keys, place.alias("_bin"), F.when(close, F.col("value")).alias("value")).agg(F.count("*").alias("_k"))
    bins = stored(bins, "near")
    first = _asked_bins(bins, keys, edge.select(*keys, "_asked"))
    few = bins.where("value is not null").join(first.select(*keys, "_bin"), [*keys, "_bin"], "left_semi").withColumnRenamed("_bin", "_part")
    inner = [*keys, "_part"]
    parts = few.groupBy(*inner).agg(F.percentile_approx("value", [i / PARTS for i in range(1, PARTS)], ACCURACY).alias("_cuts"))
    again = few.join(parts, inner).withColumn("_bin", F.size(F.filter("_cuts", lambda x: x < F.col("value")))).drop("_cuts")
    wanted = _asked_bins(again, inner, first.withColumnRenamed("_bin", "_part"))
    last = again.join(wanted, [*inner, "_bin"])
    upto = last.withColumn("_upto", F.sum("_k").over(Window.partitionBy(*inner, "_bin").orderBy("value")))
    hit = upto.select(*keys, "value", F.explode(F.filter("_asked", lambda a: (a["rank"] < F.col("_upto")) & (a["rank"] >= F.col("_upto") - F.col("_k")))).alias("_a"))
    ends = hit.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_a.i", "value"))).alias("_v"))
    low, high = (lambda i: F.col("_v")[2 * i]), (lambda i: F.col("_v")[2 * i + 1])
    q = F.array(*[F.when(low(i) == high(i), low(i)).otherwise(low(i) + (high(i) - low(i)) * (x - F.floor(x))) for i, x in enumerate(at)])
    return edge.join(ends, keys).select(*keys, "n", q.alias("q"))


def summary(readings: DataFrame, keys: list[str]) -> DataFrame:
    """count, missing, unique, mean, median, std, variance, min, p25, p75, max of each sensor."""
    moments = readings.groupBy(*keys).agg(
        F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.var_samp("value").alias("variance"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    different = readings.where("value is not null").select(*keys, "value").distinct().groupBy(*keys).agg(F.count("*").alias("unique"))
    agg = moments.join(quantiles(readings, keys).drop("n"), keys, "left").join(different, keys, "left").withColumn("unique", F.coalesce("unique", F.lit(0)))
    return agg.select(*keys, "count", "missing", "unique", "mean", F.col("q")[1].alias("median"), "std", "variance", "min", F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"), "max")


def profile(readings: DataFrame, keys: list[str], dp: int | None = 6) -> DataFrame:
    """Twelve statistics of each sensor: exact linear quartiles, bias-corrected skewness and excess kurtosis."""
    n = F.col("n").cast("double")
    agg = readings.where("value is not null").groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.var_samp("value").alias("variance"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"),
    )
    agg = agg.join(quantiles(readings, keys).drop("n"), keys)
    skew = F.when(F.col("n") > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(F.col("n") > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    cols = {"mean": F.col("mean"), "std": F.col("std"), "variance": F.col("variance"), "min": F.col("min"), "max": F.col("max"), "median": F.col("q")[1], "q1": F.col("q")[0], "q3": F.col("q")[2], "iqr": F.col("q")[2] - F.col("q")[0], "skewness": skew, "kurtosis": kurt}
    return agg.select(*keys, F.col("n").alias("count"), *[(F.round(c, dp) if dp is not None else c).alias(k) for k, c in cols.items()])


def correlations(rows: DataFrame, sensors: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., sensor_a, sensor_b, r) of all pairs of a wide table in one pass, over rows that have both values."""
    pairs = [(a, b) for a, b in combinations(sensors, 2)]
    agg = rows.groupBy(*keys).agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)], *[F.when(F.var_samp(a) > 0, F.lit(1.0)).alias(f"d{i}") for i, a in enumerate(sensors)])
    cells = [f"'{a}', '{b}', r{i}, '{b}', '{a}', r{i}" for i, (a, b) in enumerate(pairs)] + [f"'{a}', '{a}', d{i}" for i, a in enumerate(sensors)]
    return agg.selectExpr(*keys, f"stack({2 * len(pairs) + len(sensors)}, {', '.join(cells)}) as (sensor_a, sensor_b, r)")


#: Sums of a pair of sensors, over rows that have both values; the last counts rows with a value that isn't finite.
_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab", "bad")


def _pair_sums(value: np.ndarray, known: np.ndarray, block: int):
    """(block of a, block of b, the seven matrices of sums) of one chunk, for block pairs a <= b."""
    finite = np.isfinite(value)
    odd = (known & ~finite).astype(float)
    x, m = np.where(known & finite, value, 0.0), known.astype(float)
    cuts = range(0, value.shape[1], block)
    for i in cuts:
        a, ma, oa = x[:, i : i + block].T, m[:, i : i + block].T, odd[:, i : i + block].T
        for j in cuts[i // block :]:
            b, mb, ob = x[:, j : j + block], m[:, j : j + block], odd[:, j : j + block]
            yield i // block, j // block, (ma @ mb, a @ mb, ma @ b, (a * a) @ mb, ma @ (b * b), a @ b, oa @ mb + ma @ ob)


def blocked_correlations(rows: DataFrame, sensors: list[str], block: int = 64, chunk: int = 4096, room: int = 1 << 26, fan: int = 64) -> DataFrame:
    """(sensor_a, sensor_b, n, r) of all ordered pairs of a wide table with many sensors, over rows that have both values.

    A blocked Gram matrix: each chunk of rows gives counts, sums and products of every
    pair of sensor blocks by matrix products.  A task adds up those block pairs that fit
    into room bytes and hands out the others chunk by chunk, so it never holds all pairs;
    what tasks hand out is added in two levels, first over fan partitions each.
    Values are taken from their sensor's mean first, which keeps the sums stable.  r is
    null where a sensor doesn't vary or fewer than two rows have both, NaN where a value
    isn't finite; a null in any column only takes its row out of that column's pairs.
    No sensors give no rows, an empty table gives n = 0.
    """
    spark, count = rows.sparkSession, len(sensors)
    if not count:
        return spark.createDataFrame([], "sensor_a string, sensor_b string, n long, r double")
    value = F.array(*[F.col(f"`{c}`").cast("double") for c in sensors])
    # in several aggregates, as one expression a sensor of a very wide table would make one very large method
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    center = [x for i in range(0, count, 256) for x in rows.agg(*[F.avg(finite(F.col(f"`{c}`").cast("double"))).alias(f"m{i + k}") for k, c in enumerate(sensors[i : i + 256])]).first()]
    center = np.array([0.0 if x is None else x for x in center])

    def sums(batches):
        held, have, total = [], 0, {}
        most = room // (block * block * 8 * len(_SUMS))
        row = lambda i, j, s: pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([s], pa.list_(pa.float64()))], names=["bi", "bj", "s"])

        def flush():
            flat = pa.concat_arrays([h.flatten() for h in held])
            known = np.asarray(flat.is_valid()).reshape(-1, count)
            got = flat.to_numpy(zero_copy_only=False).reshape(-1, count) - center
            for i, j, parts in _pair_sums(got, known, block):
                s = np.concatenate([p.ravel() for p in parts])
                if (i, j) in total:
                    total[i, j] += s
                elif len(total) < most:
                    total[i, j] = s
                else:
                    yield row(i, j, s)

        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.column(0).slice(at, chunk)
                if have and have + len(part) > chunk:
                    yield from flush()
                    held, have = [], 0
                held.append(part)
                have += len(part)
        if have:
            yield from flush()
        for (i, j), s in total.items():
            yield row(i, j, s)

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table.column("s")[0].values))
        for part in table.column("s").chunks:
            for k in range(len(part)):
                total += part[k].values.to_numpy()
        return pa.table([table.column("bi")[:1], table.column("bj")[:1], pa.array([total], pa.list_(pa.float64()))], names=["bi", "bj", "s"])

    shape = "bi int, bj int, s array<double>"
    each = rows.select(value.alias("v")).mapInArrow(sums, shape).withColumn("_part", F.floor(F.spark_partition_id() / fan))
    once = each.groupBy("bi", "bj", "_part").applyInArrow(lambda t: added(t.select(["bi", "bj", "s"])), shape)
    blocks = once.groupBy("bi", "bj").applyInArrow(added, shape)

    # the seven matrices of a block follow one another; a cell of block (bi, bj) is row, column of the block's own width
    wide = F.least(F.lit(block), F.lit(count) - F.col("bj") * block)
    cells = (F.size("s") / len(_SUMS)).cast("int")
    zipped = F.arrays_zip(*[F.slice("s", F.lit(i) * cells + 1, cells).alias(c) for i, c in enumerate(_SUMS)])
    at = blocks.select("bi", "bj", F.posexplode(zipped).alias("k", "z"))
    at = at.select((F.col("bi") * block + F.floor(F.col("k") / wide)).cast("int").alias("a"), (F.col("bj") * block + F.col("k") % wide).cast("int").alias("b"), "z.*").where("a <= b")
    n = F.col("n")
    va, vb, ab = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n, F.col("sab") - F.col("sa") * F.col("sb") / n
    flat = lambda v, s: v <= s * 1e-14
    r = F.when(F.col("bad") > 0, F.lit(float("nan"))).when((n < 2) | flat(va, F.col("saa")) | flat(vb, F.col("sbb")), F.lit(None)).when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(ab / F.sqrt(va) / F.sqrt(vb))
    half = at.select("a", "b", n.cast("long").alias("n"), r.alias("r"))
    both = half.union(half.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "r"))
    pairs = spark.range(count * count).select((F.col("id") / count).cast("int").alias("a"), (F.col("id") % count).cast("int").alias("b"))
    name = lambda c: F.element_at(F.array(*[F.lit(s) for s in sensors]), F.col(c) + 1)
    return pairs.join(both, ["a", "b"], "left").select(name("a").alias("sensor_a"), name("b").alias("sensor_b"), F.coalesce("n", F.lit(0)).alias("n"), "r")


def variance_ranking(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Variance of each sensor and its rank within the other keys."""
    outer = [k for k in keys if k != "sensor"]
    w = Window.partitionBy(*outer).orderBy(F.desc_nulls_last("variance"), "sensor")
    return readings.groupBy(*keys).agg(F.var_samp("value").alias("variance")).withColumn("rank", F.row_number().over(w))


def dataset_report(rows: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, missing cells, duplicate rows, numeric columns."""
    numeric = sum(f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal") for f in rows.schema.fields)
    grouped = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    missing = sum((F.when(F.col(c).isNull(), F.col("_n")).otherwise(F.lit(0)) for c in rows.columns), F.lit(0))
    return grouped.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_rows"), F.lit(len(rows.columns)).cast("long").alias("n_columns"), F.coalesce(F.sum(missing), F.lit(0)).cast("long").alias("missing"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"), F.lit(numeric).cast("long").alias("numeric"),
    )


def histogram(readings: DataFrame, keys: list[str], bins: int = 40) -> DataFrame:
    """(keys..., bin, lo, hi, n): equal bins from least to largest value, the last closed; a constant has one bin."""
    edge = readings.where("value is not null").groupBy(*keys).agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    both = readings.where("value is not null").join(edge, keys)
    width = (F.col("mx") - F.col("mn")) / bins
    b = F.when(F.col("mx") == F.col("mn"), F.lit(1)).otherwise(F.least(F.floor((F.col("value") - F.col("mn")) / width) + 1, F.lit(bins)))
    return both.groupBy(*keys, b.cast("int").alias("bin"), "mn", "mx").agg(F.count("*").alias("n")).select(*keys, "bin", (F.col("mn") + (F.col("bin") - 1) * width).alias("lo"), (F.col("mn") + F.col("bin") * width).alias("hi"), "n")


def histogram_overlay(bins: DataFrame, current: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Histogram bins with the current value and the nominal mean to draw over them."""
    return bins.join(current.select(*keys, F.col("value").alias("current_value")), keys, "left").join(profiles.select(*keys, F.col("mean").alias("nominal_mean")), keys, "left")


def boxplot(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 IQR, and the number of outliers."""
    q = quantiles(readings, keys).drop("n")
    both = readings.where("value is not null").join(q, keys)
    reach = (F.col("q")[2] - F.col("q")[0]) * 1.5
    inside = (F.col("value") >= F.col("q")[0] - reach) & (F.col("value") <= F.col("q")[2] + reach)
    return both.groupBy(*keys, "q").agg(F.min(F.when(inside, F.col("value"))).alias("whisker_lo"), F.max(F.when(inside, F.col("value"))).alias("whisker_hi"), F.count_if(~inside).alias("outliers")).select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "whisker_lo", "whisker_hi", "outliers")


def welch(n1, m1, v1, n2, m2, v2):
    """t and degrees of freedom of Welch's test as columns; null where both variances are 0."""
    a, b = v1 / n1, v2 / n2
    t = F.when(a + b > 0, (m1 - m2) / F.sqrt(a + b))
    df = F.when(a + b > 0, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)))
    return t, df


def cohens_d(n1, m1, v1, n2, m2, v2):
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return F.when(pooled == 0, F.lit(0.0)).otherwise((m1 - m2) / pooled)


def comparison(readings: DataFrame, nominal: str = "NOMINAL", with_p: bool = True) -> DataFrame:
    """Every condition against the nominal one of its speed, sensor by sensor: readings (speed, condition, sensor, value).

    t and effect are nominal less fault, the change is fault less nominal.  One
    aggregation serves all comparisons; the join is on its few rows.
    """
    s = readings.where("value is not null and not isnan(value)").groupBy("speed", "condition", "sensor").agg(F.count("value").cast("double").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    a = s.where(F.col("condition") == nominal).select("speed", "sensor", *[F.col(c).alias(f"{c}1") for c in "nmv"])
    b = s.where(F.col("condition") != nominal).select("speed", F.col("condition").alias("fault"), "sensor", *[F.col(c).alias(f"{c}2") for c in "nmv"])
    args = [F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")]
    t, df = welch(*args)
    out = b.join(a, ["speed", "sensor"]).select("speed", "fault", "sensor", F.col("m1").alias("nominal_mean"), F.col("m2").alias("fault_mean"), F.sqrt("v1").alias("nominal_std"), F.sqrt("v2").alias("fault_std"), absolute_change(F.col("m2"), F.col("m1")).alias("percent_change"), t.alias("t_statistic"), df.alias("df"), cohens_d(*args).alias("effect_size"))
    return out.withColumn("p_value", t_p_value("t_statistic", "df")) if with_p else out


def importance(compared: DataFrame) -> DataFrame:
    """Comparison with normalised effect, change and -log10 p, the composite score and its rank within (speed, fault)."""
    w = Window.partitionBy("speed", "fault")
    size = {"effect_norm": F.abs("effect_size"), "pct_norm": F.abs("percent_change"), "p_norm": -F.log10(F.col("p_value") + 1e-12)}
    share = {k: F.when(F.max(c).over(w) == 0, F.lit(0.0)).otherwise(c / F.max(c).over(w)) for k, c in size.items()}
    out = compared.withColumns({"absolute_effect": F.abs("effect_size")} | share)
    out = out.withColumn("importance_score", F.col("effect_norm") * 0.50 + F.col("pct_norm") * 0.30 + F.col("p_norm") * 0.20)
    return out.withColumn("rank", F.row_number().over(w.orderBy(F.desc_nulls_last("importance_score"), "sensor")))


def select_sensors(scored: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(fault, speed, rank, sensor, ...): significant diagnostic sensors, the first of each (fault, speed) by the rank they have."""
    kept = scored.where(~F.col("sensor").isin(*IGNORED_SENSORS) & (F.col("p_value") <= s.p_value) & (F.abs("effect_size") >= s.effect_size))
    w = Window.partitionBy("fault", "speed").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= s.map_top_k).select("fault", "speed", "rank", "sensor", "importance_score", "effect_size", "percent_change", "p_value")
