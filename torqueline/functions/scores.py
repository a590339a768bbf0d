"""Scalar score formulas as column expressions; every rounding point is explicit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import texts as TX
from ..presets import DEFAULTS, PATH_FACTORS, Settings


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std == 0, F.lit(0.0)).otherwise((value - mean) / std)


def signed_change(value: Column, nominal: Column) -> Column:
    """Percent of the signed nominal; 0 where that is 0."""
    return F.when(nominal == 0, F.lit(0.0)).otherwise((value - nominal) / nominal * 100)


def absolute_change(fault: Column, nominal: Column) -> Column:
    """Percent of the nominal's size; null where that is 0."""
    return F.when(nominal != 0, (fault - nominal) / F.abs(nominal) * 100)


def similarity(value: Column, fault_mean: Column, nominal_mean: Column) -> Column:
    """Closeness to the fault's mean: exp of minus the distance in units of 5 % of the larger mean, 3 dp."""
    scale = F.greatest(F.abs(fault_mean), F.abs(nominal_mean), F.lit(1e-6)) * 0.05
    return F.round(F.exp(-F.abs(value - fault_mean) / scale), 3)


def sensor_status(z: Column, change: Column, sim: Column) -> Column:
    return (
        F.when((sim >= 0.90) & (F.abs(z) >= 5), "CRITICAL")
        .when((sim >= 0.70) & (F.abs(z) >= 3), "WARNING")
        .when(F.abs(change) >= 10, "WARNING")
        .otherwise("NORMAL")
    )


def describe_z(z: Column) -> Column:
    size = F.abs(z)
    return F.when(size >= 4, "far outside").when(size >= 3, "well outside").when(size >= 2, "outside").otherwise("at the edge of")


def rescaled(score: Column, top: float = 2.0) -> Column:
    """Clamped to 0..top, then to 0..1."""
    return F.greatest(F.least(score, F.lit(top)), F.lit(0.0)) / top


def calibrated(score: Column, s: Settings = DEFAULTS) -> Column:
    return F.when(score <= 0, F.lit(0.0)).otherwise(F.least(score / s.practical_max, F.lit(1.0)))


def separation(scores: Column) -> Column:
    """Relative lead of the first of descending scores: 0 if none or not positive, 1 if alone."""
    top, second = F.get(scores, F.lit(0)), F.get(scores, F.lit(1))
    lead = F.least(F.greatest((top - second) / top, F.lit(0.0)), F.lit(1.0))
    return F.when((F.size(scores) == 0) | (top <= 0), F.lit(0.0)).when(F.size(scores) == 1, F.lit(1.0)).otherwise(lead)


def coverage(original: Column, matched: Column) -> Column:
    """Share of the distinct original words among the matched ones (trimmed, lower case)."""
    norm = lambda a: F.array_distinct(F.filter(F.transform(a, lambda w: F.lower(F.trim(w))), lambda w: w != ""))
    return F.when(F.size(norm(original)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(norm(original), norm(matched))) / F.size(norm(original)))


def sensor_boost(conf: Column, s: Settings = DEFAULTS) -> Column:
    return F.when(conf >= s.boost_from, F.least(conf * s.boost_most, F.lit(s.boost_most))).otherwise(F.lit(0.0))


def confidence(cal: Column, sep: Column, cov: Column, boost: Column, s: Settings = DEFAULTS) -> Column:
    return F.least(cal * s.retrieval_share + sep * s.separation_share + cov * s.coverage_share + boost, F.lit(1.0))


def mode(conf: Column, s: Settings = DEFAULTS) -> Column:
    return F.when(conf >= s.mode_threshold, "EXTRACTED").otherwise("AMBIGUOUS")


def mode_text(m: Column) -> Column:
    return F.when(m == "EXTRACTED", TX.MODE_EXTRACTED).when(m == "AMBIGUOUS", TX.MODE_AMBIGUOUS).otherwise(TX.MODE_UNKNOWN)


def in_band(conf: Column, m: Column, s: Settings = DEFAULTS) -> Column:
    return F.when(m == "EXTRACTED", (conf >= s.mode_threshold) & (conf < 1.01)).otherwise((conf >= 0) & (conf < s.mode_threshold))


def noisy_or(vector: Column, baseline: float, alpha: float = 0.4) -> Column:
    """A vector score, saturated, joined with an independent baseline."""
    v = F.greatest(vector, F.lit(0.0))
    return 1 - (1 - v * (1 + alpha * (1 - v))) * (1 - baseline)


def two_path_calibrated(score: Column, source: Column) -> Column:
    """Two-path scores: what both paths found loses its flat boost and becomes a noisy-or; others are clamped."""
    return F.when(source == "both", noisy_or(score - 0.5, 0.3)).otherwise(F.greatest(score, F.lit(0.0)))


def three_path_calibrated(score: Column, source: Column) -> Column:
    """Three-path scores: boosts .5, .3 and 1.3 come off, baselines .3, .4 and both joined go in."""
    both = 1 - (1 - 0.3) * (1 - 0.4)
    return (
        F.when(source == "vector+graph", noisy_or(score - 0.5, 0.3))
        .when(source == "vector+community", noisy_or(score - 0.3, 0.4))
        .when(source == "all", noisy_or(score - 1.3, both))
        .otherwise(F.greatest(score, F.lit(0.0)))
    )


def effective_confidence(score: Column, source: Column, multi: Column) -> Column:
    """Score by the factor of the paths that found it; a community of several categories counts 0.10 more."""
    factor = F.lit(0.30)
    for path, f in PATH_FACTORS.items():
        factor = F.when(source == path, f + F.when(multi, 0.10).otherwise(0.0) if path == "community" else F.lit(f)).otherwise(factor)
    return score * factor


def tag(score: Column, upper: float, lower: float) -> Column:
    return F.when(score >= upper, "EXTRACTED").when(score >= lower, "INFERRED").otherwise("AMBIGUOUS")


def two_path_tag(score: Column, source: Column) -> Column:
    return F.when((source == "both") & (score >= 0.80), "EXTRACTED").when((source == "both") & (score >= 0.55), "INFERRED").otherwise("AMBIGUOUS")


def evidence_quality(n: Column, matched: Column, missing: Column, top: Column, strong: Column, sensor: Column, graph: Column) -> Column:
    """strong, moderate or weak by coverage, top score, rivals and confirmations."""
    ratio = F.when(matched + missing > 0, matched / (matched + missing)).otherwise(F.lit(0.0))
    score = ratio * 0.4 + top * 0.3 - F.greatest(strong - 1, F.lit(0)) * 0.1
    score = score + F.when(sensor == "CONFIRMS", 0.15).when(sensor == "CONTRADICTS", -0.1).otherwise(0.0) + F.when(graph == "CONFIRMS", 0.1).otherwise(0.0)
    return F.when(n == 0, "weak").when(score >= 0.65, "strong").when(score >= 0.4, "moderate").otherwise("weak")


def evidence_mode(n: Column, quality: Column, sensor: Column) -> Column:
    return F.when(n == 0, "AMBIGUOUS").when((quality == "strong") & (sensor != "CONTRADICTS"), "EXTRACTED").when(quality.isin("strong", "moderate"), "INFERRED").otherwise("AMBIGUOUS")


def internal_confidence(top: Column, quality: Column, sensor: Column) -> Column:
    times = F.when(quality == "strong", 1.0).when(quality == "moderate", 0.8).otherwise(0.5)
    plus = F.when(sensor == "CONFIRMS", 0.1).when(sensor == "CONTRADICTS", -0.15).otherwise(0.0)
    return F.greatest(F.least(F.coalesce(top, F.lit(0.0)) * times + plus, F.lit(1.0)), F.lit(0.0))
