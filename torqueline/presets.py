"""Fixed values of the diagnostic domain: word lists, tables and weights, stated as they must be."""

from __future__ import annotations

from dataclasses import dataclass

# Stemmer rules (suffix, word longer than, letters cut); the first that applies is used.
RETRIEVAL_SUFFIXES = [
    "ation", "tion", "sion", "ment", "ness", "ible", "able", "ful", "less", "ous", "ive", "ing", "ity", "ent", "ant", "ism", "ist", "ize", "ise",
    "ify", "ate", "ence", "ance", "ics", "ies", "ers",
]
RETRIEVAL_STEM = [(s, len(s) + 2, len(s)) for s in RETRIEVAL_SUFFIXES] + [("es", 4, 2), ("ed", 4, 2), ("ly", 4, 2), ("ss", 4, 1), ("s", 4, 1)]
QUERY_STEM = [("ation", 6, 3), ("ing", 3, 3), ("tion", 6, 3), ("ly", 4, 2), ("ed", 4, 2), ("es", 5, 2), ("s", 3, 1), ("ment", 5, 4), ("ance", 5, 4), ("ence", 5, 4)]
MAPPER_STEM = [("ing", 3, 3), ("tion", 6, 4), ("ly", 4, 2), ("ed", 4, 2), ("s", 3, 1)]

# Words that alone make no graph seed.
SEED_STOP_WORDS = [
    "the", "and", "for", "with", "from", "that", "this", "when", "have", "been", "were", "they", "their", "them", "are", "was", "not", "but", "can",
    "will", "also", "how", "what", "which", "where", "does", "into",
]
GENERIC_SEED_WORDS = [
    "engine", "vehicle", "car", "system", "problem", "issue", "fault", "light", "leak", "noise",
]

# Words left out of label matching, generic words, and words that anchor a label to a subsystem.
LABEL_STOP_WORDS = [
    "a", "an", "the", "is", "in", "on", "of", "and", "or", "when", "it", "my", "to", "for", "not", "at", "by", "with",
]
GENERIC_LABEL_WORDS = [
    "vehicle", "system", "under", "from", "leak", "leaks", "warning", "visible", "noise",
]
ANCHOR_WORDS = [
    "engine", "crank", "cranking", "misfire", "misfires", "knock", "knocking", "power", "performance", "stall", "stalling", "start", "starting",
    "hesitate", "sputter", "fuel", "consumption", "economy", "coolant", "oil", "brake", "battery", "transmission", "exhaust", "smoke", "inject",
    "injection", "timing", "pressure",
]

# Anchor labels with the fault each stands for, in order.
LABEL_FAULTS = {
    "poor engine performance": "FAULT_INJ_DUR",
    "decreased engine performance": "FAULT_INJ_DUR",
    "engine performance issues": "FAULT_INJ_DUR",
    "engine hesitates on acceleration": "FAULT_INJ_DUR",
    "engine stalls": "FAULT_INJ_DUR",
    "engine stalls at high speeds": "FAULT_INJ_DUR",
    "stalling at idle": "FAULT_INJ_DUR",
    "difficulty starting engine": "FAULT_INJ_DUR",
    "engine cranks slowly": "FAULT_INJ_DUR",
    "engine does not crank": "FAULT_INJ_DUR",
    "engine wont start": "FAULT_INJ_DUR",
    "hard starting in cold weather": "FAULT_INJ_DUR",
    "engine sputters at high speeds": "FAULT_INJ_DUR",
    "slow cranking": "FAULT_INJ_DUR",
    "high fuel consumption": "FAULT_INJ_PRS",
    "poor fuel economy": "FAULT_INJ_PRS",
    "engine misfires": "FAULT_INJ_PRS",
    "loss of engine power": "FAULT_INJ_PRS",
    "loss of power": "FAULT_INJ_PRS",
    "engine power loss": "FAULT_INJ_PRS",
    "poor engine power": "FAULT_INJ_PRS",
    "fuel odor from vehicle": "FAULT_INJ_PRS",
    "visible fuel leak under vehicle": "FAULT_INJ_PRS",
    "engine knocking": "FAULT_SOI",
    "engine knocking/pinging": "FAULT_SOI",
    "engine knocking noise": "FAULT_SOI",
    "poor engine timing": "FAULT_SOI",
    "black smoke from exhaust": "FAULT_SOI",
    "blue smoke from exhaust": "FAULT_SOI",
}
ANCHORS = list(LABEL_FAULTS.items())

# Categories in order, with the faults (and confidences) that they fall back to.
CATEGORY_FAULTS = {
    "Engine Components": [("FAULT_INJ_DUR", 0.85), ("FAULT_INJ_PRS", 0.75), ("FAULT_SOI", 0.70)],
    "Engine Compartment": [("FAULT_INJ_DUR", 0.80), ("FAULT_INJ_PRS", 0.70), ("FAULT_SOI", 0.65)],
    "Fuel System": [("FAULT_INJ_PRS", 0.90), ("FAULT_INJ_DUR", 0.70)],
    "Emissions System": [("FAULT_INJ_PRS", 0.85), ("FAULT_SOI", 0.75)],
    "Cooling System": [],
    "Liquid Systems": [],
    "Transmission": [],
    "Drivetrain": [],
    "ABS System": [],
    "Electrical System": [],
    "Steering": [],
    "Wheels & Tires": [],
    "Air Conditioning System": [],
}

# Sensors expected for a category.
CATEGORY_SENSORS = {
    "Cooling System": ["coolant_temp", "engine_temp", "coolant_pressure"],
    "ABS System": ["wheel_speed", "brake_pressure"],
    "Fuel System": ["fuel_pressure", "injector_duration"],
    "Air Conditioning System": ["ac_pressure", "evaporator_temp"],
    "Engine Components": ["rpm", "coolant_temp", "maf", "map", "throttle_position"],
    "Engine Compartment": ["rpm", "oil_pressure", "coolant_temp", "battery_voltage"],
    "Emissions System": ["o2_sensor", "fuel_trim", "catalytic_temp"],
    "Electrical System": ["battery_voltage", "alternator_output"],
    "Liquid Systems": ["coolant_temp", "coolant_pressure"],
    "Transmission": ["transmission_temp", "vehicle_speed"],
    "Drivetrain": ["vehicle_speed", "wheel_speed"],
    "Steering": ["steering_angle", "power_steering_pressure"],
    "Wheels & Tires": ["wheel_speed", "tire_pressure"],
}

# Phrases and what they are rewritten to.
SYNONYMS = {
    "cel": "check engine light",
    "check engine light": "check engine light",
    "check engine light on": "check engine light on",
    "brakes": "braking system",
    "braking": "braking system",
    "ac": "air conditioning",
    "a/c": "air conditioning",
    "trans": "transmission",
    "gearbox": "transmission",
    "abs": "abs system",
    "won't start": "engine wont start",
    "wont start": "engine wont start",
    "won t start": "engine wont start",
    "hard start": "difficulty starting engine",
    "starts hard": "difficulty starting engine",
    "hard starting": "difficulty starting engine",
    "difficulty starting": "difficulty starting engine",
    "overheating": "engine overheating",
    "overheat": "engine overheating",
    "engine hot": "engine overheating",
    "running hot": "engine overheating",
    "hesitation": "engine hesitates on acceleration",
    "hesitates": "engine hesitates on acceleration",
    "hesitating": "engine hesitates on acceleration",
    "bogging down": "engine hesitates on acceleration",
    "rough idle": "rough idle",
    "erratic idle": "erratic idle speed",
    "idle rough": "rough idle",
    "idle fluctuates": "erratic idle speed",
    "low engine power": "loss of engine power",
    "loses power": "loss of engine power",
    "lost power": "loss of engine power",
    "power loss": "loss of engine power",
    "lack of power": "loss of engine power",
    "no power": "loss of engine power",
    "weak acceleration": "loss of engine power",
    "consumes too much fuel": "high fuel consumption",
    "uses too much fuel": "high fuel consumption",
    "burns too much fuel": "high fuel consumption",
    "gas guzzler": "high fuel consumption",
    "poor gas mileage": "poor fuel economy",
    "bad fuel economy": "poor fuel economy",
    "fuel hungry": "high fuel consumption",
    "misfire": "engine misfires",
    "misfires": "engine misfires",
    "misfiring": "engine misfires",
    "engine misfire": "engine misfires",
    "engine misfires": "engine misfires",
    "knocking": "engine knocking",
    "knock": "engine knocking",
    "pinging": "engine knocking/pinging",
    "coolant leak": "coolant leak",
    "coolant leaks": "coolant leaks under the vehicle",
    "coolant loss": "coolant leak",
    "antifreeze leak": "coolant leak",
    "smoke": "black smoke from exhaust",
    "exhaust smoke": "black smoke from exhaust",
    "blue smoke": "blue smoke from exhaust",
    "black smoke": "black smoke from exhaust",
    "stalls": "engine stalls",
    "stalling": "engine stalls",
    "stall": "engine stalls",
    "engine stall": "engine stalls",
    "dies": "engine stalls",
    "shuts off": "engine stalls",
    "cranks slowly": "engine cranks slowly",
    "slow crank": "slow cranking",
    "slow cranking": "slow cranking",
    "weak crank": "engine cranks slowly",
    "clicking no start": "engine does not crank",
    "no crank": "engine does not crank",
    "wont crank": "engine does not crank",
    "sputters": "engine sputters at high speeds",
    "sputtering": "engine sputters at high speeds",
    "tire pressure": "low tire pressure",
    "tyre pressure": "low tire pressure",
    "flat tire": "low tire pressure",
}

# Weights and penalties by node type.
ENTITY_WEIGHTS = {"Category": 1.0, "Subcategory": 1.2, "Symptom": 1.8, "DiagnosisStep": 0.8, "Cause": 1.5}
TYPE_PENALTIES = {"DiagnosisStep": 0.80, "Subcategory": 0.85, "Category": 0.75, "Symptom": 1.00, "Fault": 1.00, "Sensor": 0.95, "Cause": 1.00, "Action": 0.90}
AGREEMENT = {"vector+graph": 1.15, "vector+community": 1.10, "graph+community": 1.05, "all": 1.25}
PATH_FACTORS = {"all": 1.00, "vector+graph": 0.95, "vector+community": 0.85, "graph+community": 0.70, "vector": 0.55, "community": 0.45, "graph": 0.35}
RELATIONS = ["HAS_COMPONENT", "CAUSES", "MEASURED_BY", "CONNECTED_TO", "HAS_SUBSYSTEM"]
QUESTION_STARTS = ["why", "how", "what", "when", "is my", "should i", "can i"]
IGNORED_SENSORS = ["time", "timestamp", "index"]


@dataclass(frozen=True)
class Settings:
    """Thresholds and weights; the defaults are the reference values."""

    top_k: int = 10
    vector_weight: float = 0.55
    graph_weight: float = 0.25
    community_weight: float = 0.20
    category_boost: float = 1.08
    max_hops: int = 1
    p_value: float = 0.05
    effect_size: float = 0.8
    map_top_k: int = 10
    match_threshold: float = 0.15
    entity_threshold: float = 0.20
    entity_floor: float = 0.15
    entity_share: float = 0.70
    fuzzy_threshold: float = 82.0
    practical_max: float = 0.55
    mode_threshold: float = 0.30
    retrieval_share: float = 0.60
    separation_share: float = 0.20
    coverage_share: float = 0.20
    boost_from: float = 0.70
    boost_most: float = 0.05
    graph_only_counts_twice: bool = True


DEFAULTS = Settings()
