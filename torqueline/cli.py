"""Diagnose texts from the command line.

    python -m torqueline.cli --dump records.txt "engine misfires at idle" [--speed 1000]
        [--profiles DIR --mapping FILE [--dictionary FILE] [--logs DIR] | --no-sensor] [--use-llm URL] [--json] [-v]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.diagnosis import diagnose, knowledge_base_from_dump
from .plans.provider import HttpProvider, assisted
from .sources import readers, sinks


def simulated(spark: SparkSession, logs: str, speed: int, fault: str, seed: int) -> DataFrame:
    """(speed, sensor, value) of one row, drawn by a hash, of the log of a fault at a speed."""
    log, _ = readers.log_csv(spark, f"{logs}/{readers.file_name('log', speed, fault)}")
    rows = log.withColumn("row_idx", F.monotonically_increasing_id())
    return readers.simulated_sample(readers.long_form(rows, log.columns, ("row_idx",)), seed).withColumn("speed", F.lit(speed))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="torqueline", description=__doc__)
    p.add_argument("symptoms", nargs="+")
    p.add_argument("--dump", required=True)
    p.add_argument("--speed", type=int, default=1000)
    p.add_argument("--profiles")
    p.add_argument("--mapping")
    p.add_argument("--dictionary")
    p.add_argument("--logs", help="folder with a log for each speed and fault: the sample is one of its rows, drawn for the first query's first fault")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--no-sensor", "--skip-sensor", action="store_true")
    p.add_argument("--use-llm", metavar="URL", help="a generate endpoint for guidance where no diagnosis is sure")
    p.add_argument("--model", default="")
    p.add_argument("--json", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("torqueline").getOrCreate()
    kb = knowledge_base_from_dump(spark, a.dump)
    queries = readers.queries(spark, a.symptoms)
    mapping = profiles = sample = dictionary = None
    if a.dictionary:
        dictionary = readers.sensor_dictionary(spark, a.dictionary)
    tables = None
    if a.profiles and a.mapping and not a.no_sensor:
        profiles, mapping = readers.profiles(spark, a.profiles), readers.sensor_mapping(spark, a.mapping)
        if a.logs:
            tables = diagnose(queries, kb)
            first = tables["mapped"].orderBy("query_id", "ord").first()
            sample = simulated(spark, a.logs, a.speed, first.fault_code, a.seed) if first else None  # no mapped fault, no sample
        else:
            sample = readers.nominal_sample(profiles, a.speed).withColumn("speed", F.lit(a.speed))
    if tables is None or sample is not None:
        tables = diagnose(queries, kb, mapping, profiles, sample, dictionary=dictionary)
    if a.verbose:
        tables["candidates"].orderBy("query_id", "rank").show(50, truncate=60)
    provider = HttpProvider(a.use_llm, a.model) if a.use_llm else None
    report = tables["report"]
    for r in (sinks.report_json(report).join(report.select("query_id", "mode"), "query_id") if a.json else report).orderBy("query_id").toLocalIterator():
        if a.json:
            print(r.json)
            continue
        print(f"{r.summary}  [{r.mode}, {r.confidence:.2f}]\n{r.mode_description}\n{r.diagnosis_summary}")
        if r.mode == "AMBIGUOUS":
            own = tables["candidates"].where(F.col("query_id") == r.query_id).orderBy("rank").limit(3).collect()
            print(assisted(r.query_text, [c.asDict() for c in own], r.assisted_text, provider))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
