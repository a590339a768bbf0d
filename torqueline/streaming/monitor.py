"""Sensor status on a stream of readings, joined with static profiles, and status counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import sensor_status, signed_change, similarity, z_score


def statuses(readings: DataFrame, profiles: DataFrame) -> DataFrame:
    """readings (ts, speed, sensor, value) with a status for each fault; stateless, so any trigger will do."""
    n = profiles.where("condition = 'NOMINAL'").select("speed", "sensor", F.col("mean").alias("nominal_mean"), F.col("std").alias("nominal_std"))
    f = profiles.where("condition <> 'NOMINAL'").select("speed", "sensor", F.col("condition").alias("fault"), F.col("mean").alias("fault_mean"))
    r = readings.join(n.join(f, ["speed", "sensor"]), ["speed", "sensor"])
    v = F.col("value")
    sim = similarity(v, F.col("fault_mean"), F.col("nominal_mean"))
    return r.select("ts", "speed", "sensor", "fault", "value", sim.alias("sensor_confidence"), sensor_status(z_score(v, F.col("nominal_mean"), F.col("nominal_std")), signed_change(v, F.col("nominal_mean")), sim).alias("status"))


def status_counts(statuses: DataFrame, window: str = "1 minute", late: str = "30 seconds") -> DataFrame:
    """Counts by window, fault and status; readings later than the watermark are dropped and its state with them."""
    return statuses.withWatermark("ts", late).groupBy(F.window("ts", window), "fault", "status").agg(F.count("*").alias("n"))
