"""Validation of a sample against nominal and fault profiles, fault by fault."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import texts as TX
from ..functions.scores import describe_z, sensor_status, signed_change, similarity, z_score


def signals(mapping: DataFrame, sample: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row for each mapped sensor that the sample and both profiles have.

    mapping (fault, speed, rank, sensor, importance_score), sample (sample_id, speed,
    sensor, value), profiles (speed, condition, sensor, mean, std).
    """
    nominal = profiles.where("condition = 'NOMINAL'").select("speed", "sensor", F.col("mean").alias("nominal_mean"), F.col("std").alias("nominal_std"))
    fault = profiles.where("condition <> 'NOMINAL'").select("speed", F.col("condition").alias("fault"), "sensor", F.col("mean").alias("fault_mean"))
    r = mapping.join(fault, ["fault", "speed", "sensor"]).join(nominal, ["speed", "sensor"]).join(sample, ["speed", "sensor"])
    v, z, pct = F.col("value"), z_score(F.col("value"), F.col("nominal_mean"), F.col("nominal_std")), signed_change(F.col("value"), F.col("nominal_mean"))
    r = r.withColumns({"z_score": F.round(z, 3), "percent_change": F.round(pct, 3), "sensor_confidence": similarity(v, F.col("fault_mean"), F.col("nominal_mean")), "_z": z, "_p": pct})
    r = r.withColumn("status", sensor_status(F.col("_z"), F.col("_p"), F.col("sensor_confidence")))
    return r.select("sample_id", "fault", "speed", "rank", "sensor", F.col("value").alias("current_value"), "nominal_mean", "fault_mean", "z_score", "percent_change", "sensor_confidence", "status", F.coalesce("importance_score", F.lit(1.0)).alias("importance"))


def fault_results(signals: DataFrame) -> DataFrame:
    """Per (sample, fault, speed): weighted confidence (3 dp), and sensors by status in mapping order."""
    w = F.sum(F.col("sensor_confidence") * F.col("importance")) / F.sum("importance")
    row = F.struct("rank", "sensor", "status")
    agg = signals.groupBy("sample_id", "fault", "speed").agg(F.round(F.coalesce(w, F.lit(0.0)), 3).alias("sensor_confidence"), F.count("*").alias("num_sensors_checked"), F.array_sort(F.collect_list(row)).alias("r"))
    pick = lambda s: F.transform(F.filter("r", lambda x: x["status"] == s), lambda x: x["sensor"])
    return agg.select("sample_id", "fault", "speed", "sensor_confidence", "num_sensors_checked", pick("CRITICAL").alias("critical"), pick("WARNING").alias("warning"), pick("NORMAL").alias("normal"))


def candidate_faults(mapped: DataFrame, results: DataFrame) -> DataFrame:
    """One result for each mapped fault of a query, with the metadata of the fault's last candidate; no sensors, confidence 0."""
    last = mapped.groupBy("query_id", F.col("fault_code").alias("fault")).agg(F.max_by(F.struct("kg_category", "kg_score", "label", "node_type", "source"), "ord").alias("m"))
    r = last.join(results, "fault", "left").select("query_id", "fault", "m.*", *[c for c in results.columns if c != "fault"])
    empty = F.array().cast("array<string>")
    return r.withColumns({"sensor_confidence": F.coalesce("sensor_confidence", F.lit(0.0))} | {c: F.coalesce(c, empty) for c in ("critical", "warning", "normal")})


def enriched(names: DataFrame, dictionary: DataFrame, column: str = "sensor") -> DataFrame:
    """Display name, description and subsystem of each sensor; its own name where the dictionary lacks it."""
    d = dictionary.select(F.col("sensor").alias(column), "display_name", "description", "subsystem", "units")
    return names.join(d, column, "left").withColumns({"display_name": F.coalesce("display_name", F.col(column)), "description": F.coalesce("description", F.lit("")), "subsystem": F.coalesce("subsystem", F.lit("")), "units": F.coalesce("units", F.lit(""))})


def interpretations(signals: DataFrame, dictionary: DataFrame, mapping: DataFrame, compared: DataFrame) -> DataFrame:
    """Text on each flagged signal: why it is abnormal, why it matters for the fault, what it adds."""
    flagged = enriched(signals.where("status in ('CRITICAL', 'WARNING')"), dictionary)
    keys = ["fault", "speed", "sensor"]
    facts = flagged.join(mapping.select(*keys, F.col("importance_score").alias("imp"), F.col("effect_size").alias("es")), keys, "left").join(compared.select(*keys, F.col("effect_size").alias("cmp_effect")), keys, "left")
    gap = F.col("current_value") - F.col("nominal_mean")
    abnormal = F.format_string(TX.ABNORMAL, F.col("current_value"), F.when(gap > 0, "above").otherwise("below"), F.col("nominal_mean"), F.abs(gap), F.col("z_score"), describe_z(F.col("z_score")), F.col("percent_change"))
    weight = F.when(F.col("imp") > 0.8, TX.PRIMARY).when(F.col("imp") > 0.5, TX.MODERATE).otherwise(TX.MINOR)
    relevance = F.concat_ws(" ", F.when(F.col("description") != "", F.col("description")), F.when(F.col("imp").isNotNull(), F.concat(weight, F.col("fault"), F.format_string(" (importance %.2f).", "imp"))), F.when(F.col("es").isNotNull(), F.format_string("Effect size %.2f sigma.", "es")))
    close = F.when(F.col("sensor_confidence") > 0.8, TX.CLOSE).when(F.col("sensor_confidence") > 0.5, TX.PARTIAL).otherwise(TX.FAR)
    primary, critical = F.coalesce(F.col("imp") > 0.8, F.lit(False)), F.col("status") == "CRITICAL"
    lead = (
        F.when(critical & primary, F.lit(TX.CONFIRMS))
        .when(critical, F.concat(F.lit(TX.SUPPORTS), F.col("fault"), F.lit(".")))
        .when(primary, F.concat(F.lit(TX.LENDS), F.col("fault"), F.lit(TX.LENDS_END)))
        .otherwise(F.concat(F.lit(TX.OFFERS), F.col("fault"), F.lit(".")))
    )
    return facts.select("sample_id", *keys, "display_name", F.col("status").alias("severity"), abnormal.alias("abnormality"), F.when(relevance == "", TX.NO_CONTEXT).otherwise(relevance).alias("relevance"), F.concat_ws(" ", lead, close).alias("contribution"))


def contradiction(results: DataFrame) -> DataFrame:
    """results with sensor_status: Supported by own flags, Contradicted by another fault's alone, else No Evidence."""
    w = Window.partitionBy("query_id")
    own = F.size("critical") + F.size("warning")
    others = F.sum(F.when(own > 0, 1).otherwise(0)).over(w) - F.when(own > 0, 1).otherwise(0)
    return results.withColumn("sensor_status", F.when(own > 0, "Supported").when(others > 0, "Contradicted").otherwise("No Evidence"))
