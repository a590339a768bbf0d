"""Sentences of reports."""

# The report texts, which must read as they do.
ABNORMAL = "Current reading (%.2f) is %s the nominal mean (%.2f) by %.2f. with a z-score of %.1f (%s the normal band). a %+.1f%% shift from nominal."
PRIMARY = "It is a primary diagnostic indicator for "
MODERATE = "It has moderate diagnostic relevance to "
MINOR = "It has minor diagnostic relevance to "
CLOSE = "The reading closely matches the expected profile for this fault type."
PARTIAL = "The reading shows partial alignment with the fault profile."
FAR = "The reading does not closely match the expected fault profile, reducing diagnostic confidence."
CONFIRMS = "Strongly confirms the diagnosis. The deviation is both severe and directly relevant to the predicted fault mechanism."
SUPPORTS = "Provides supporting evidence. The deviation is severe, though this sensor is not a top-ranked diagnostic indicator for "
LENDS = "Lends weight to the diagnosis. The sensor is diagnostically important for "
LENDS_END = " but the deviation magnitude is moderate."
OFFERS = "Offers minor supporting context. The deviation is moderate and the sensor is not a primary indicator for "
NO_CONTEXT = "No additional diagnostic context is available for this sensor."
ALL_NORMAL = "All sensor readings are within the normal range."
NO_ENTITIES = "No KG entities identified from the query."
NO_FAULTS = "No faults could be mapped from the retrieved candidates."
NO_CONCEPTS = "No direct KG concepts matched the user's description. Providing additional symptoms may help find relevant fault patterns."
MORE_SYMPTOMS = " related terms. Additional symptoms may help narrow the diagnosis."
CONSISTENT = ") are consistent with this type of fault."
FALLS_UNDER = "This fault falls under **"
MODE_EXTRACTED = "High-confidence diagnosis supported by strong evidence across retrieval, symptom coverage, and (if available) sensor data."
MODE_AMBIGUOUS = "Insufficient evidence to identify a clear diagnosis. Please provide more details."
MODE_UNKNOWN = "Unknown mode."
BADGE_SUPPORTED = "🟢 Sensor Supported"
BADGE_CONTRADICTED = "🟡 Sensor Contradicted"
BADGE_NONE = "⚪ No Sensor Data"
DISCLAIMER = "---\n⚠ AI-ASSISTED ANALYSIS — NOT A DIAGNOSIS\nThis response is generated by an AI language model and is NOT a knowledge-graph-derived diagnosis. It should be treated as general informational guidance only."
SUGGESTS = "here is what the knowledge graph suggests:\n\n"
CLOSEST = "\n\nThese are the closest matches in the knowledge base, but none had sufficient confidence for a definitive diagnosis. Consider consulting a mechanic for hands-on inspection."
NOTHING = "No closely related fault patterns were found in the knowledge base. The described symptoms do not match known patterns. Consider consulting a mechanic for a professional diagnosis."
