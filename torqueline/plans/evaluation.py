"""Evaluation batches: labelled query sets through the whole plan, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from .diagnosis import KnowledgeBase, diagnose

# Evaluation queries as (system, kind, text), in order.
EVALUATION = [
    ("engine", "multi-symptom", "Engine overheating with coolant loss"),
    ("engine", "multi-symptom", "Check engine light is on, rough idle"),
    ("engine", "exact symptom", "Engine misfires at idle"),
    ("engine", "paraphrase", "Car hesitates on acceleration"),
    ("engine", "exact symptom", "Loss of engine power"),
    ("engine", "paraphrase", "Engine knocking sound under load"),
    ("engine", "paraphrase", "Vehicle sputters at high speeds"),
    ("engine", "multi-symptom", "Engine cranks slowly, won't start"),
    ("engine", "exact symptom", "Engine does not crank at all"),
    ("engine", "conversational", "Engine stalls when I let off the gas"),
    ("brakes", "exact symptom", "Brake pedal feels spongy"),
    ("brakes", "multi-symptom", "ABS warning light on, brake pedal pulsation"),
    ("brakes", "conversational", "Brakes squealing when I stop"),
    ("brakes", "paraphrase", "Steering pulls to the left when braking"),
    ("brakes", "exact symptom", "Brake fluid leak under the car"),
    ("transmission", "paraphrase", "Transmission slips between gears"),
    ("transmission", "conversational", "Car won't shift out of first gear"),
    ("transmission", "exact symptom", "Transmission grinding on upshift"),
    ("transmission", "vague", "Harsh shift from 2nd to 3rd"),
    ("fuel", "multi-symptom", "Poor fuel economy, running rich"),
    ("fuel", "vague", "Fuel smell after parking"),
    ("fuel", "multi-symptom", "Car won't start, no fuel pressure"),
    ("cooling", "vague", "Temperature gauge goes to red"),
    ("cooling", "exact symptom", "Coolant leaking from radiator"),
    ("cooling", "multi-symptom", "Heater blows cold air, engine overheats"),
    ("electrical", "conversational", "Battery keeps dying overnight"),
    ("electrical", "vague", "Dashboard lights flickering"),
    ("electrical", "exact symptom", "Alternator warning light on"),
    ("electrical", "vague", "Car electrical system not working"),
    ("exhaust", "exact symptom", "Black smoke from exhaust"),
    ("exhaust", "multi-symptom", "Check engine light, code P0301"),
    ("suspension", "paraphrase", "Steering wheel vibrates at highway speed"),
    ("suspension", "vague", "Car pulls to one side"),
    ("suspension", "conversational", "Clunking noise over bumps"),
    ("vague", "vague", "Something feels wrong with the car"),
    ("vague", "vague", "My car is making a weird noise"),
    ("vague", "vague", "The engine light came on yesterday"),
    ("vague", "partial", "Brakes feel weird"),
    ("vague", "partial", "Car shakes when I brake"),
]

# Seeds and options whose combinations refine them, and retrieval spot checks (query | expected label).
REFINEMENT_SEEDS = ["Brake pedal goes to floor", "Radiator fan not spinning", "Smoke from tailpipe", "Power windows not working"]
REFINEMENT_OPTIONS = ["Brake noise when stopping", "Vibration during braking", "Vehicle pulls to one side", "Dashboard warning light", "Issue worsens at speed"]
SPOT_CHECKS = [
    ("poor engine performance", "Poor engine performance"),
    ("low engine power", "Loss of engine power"),
    ("engine consumes too much fuel", "Poor fuel economy"),
    ("coolant leak", "Coolant leak"),
    ("engine overheating", "Engine overheating"),
    ("rough idle", "Rough idle"),
    ("engine hesitation", "Engine hesitates on acceleration"),
]


def query_set(spark: SparkSession) -> DataFrame:
    """(query_id, system, query_type, text)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(EVALUATION)], "query_id long, system string, query_type string, text string")


def evaluation(queries: DataFrame, kb: KnowledgeBase) -> dict[str, DataFrame]:
    """Decided queries with their labels, statistics by mode, modes by system, and shares of the confidence."""
    decided = diagnose(queries.select("query_id", "text"), kb)["decided"].join(queries.drop("text"), "query_id")
    return {"decided": decided, "modes": evaluate.mode_stats(decided), "systems": evaluate.by_system(decided), "components": evaluate.components(decided)}


def spot_checks(spark: SparkSession, kb: KnowledgeBase) -> DataFrame:
    """(query_id, position): where each expected label stands among the candidates."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(SPOT_CHECKS)], "query_id long, text string, expected_label string")
    return evaluate.expected_position(diagnose(rows.select("query_id", "text"), kb)["candidates"], rows.select("query_id", "expected_label"))


def refinement_study(spark: SparkSession, kb: KnowledgeBase) -> DataFrame:
    """(query_id, improved, worsened, mode_changed) over every non-empty combination of options for each seed."""
    seeds = spark.createDataFrame(list(enumerate(REFINEMENT_SEEDS)), "query_id long, text string")
    combos = evaluate.refinements(seeds, REFINEMENT_OPTIONS).withColumn("qid", F.col("query_id") * 100 + F.col("combo"))
    before = diagnose(seeds, kb)["decided"]
    after = diagnose(combos.select(F.col("qid").alias("query_id"), "text"), kb)["decided"].withColumn("query_id", F.floor(F.col("query_id") / 100))
    return evaluate.refinement_effect(before, after)
