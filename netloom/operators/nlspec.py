"""Circuit requests in plain words to specifications, by ordered keyword rules and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Topology keywords in order, number patterns, compensation words in order.
TOPOLOGIES = [
    ("two_stage_opamp", ["two-stage", "two stage", "miller", "miller-compensated"]),
    ("folded_cascode", ["folded cascode", "folded-cascode"]),
    ("diff_pair", ["differential pair", "diff pair", "diff-pair"]),
    ("current_mirror", ["current mirror", "current-mirror"]),
    ("common_source_amp", ["common-source", "common source", "cs amp", "cs amplifier"]),
]
PATTERNS = {
    "gain_db": r"(?i)(\d+(?:\.\d+)?)\s*dB\s+(?:of\s+)?gain",
    "gain_db_alt": r"(?i)gain\s+(?:of\s+)?(\d+(?:\.\d+)?)\s*dB",
    "gbw_mhz": r"(?i)(\d+(?:\.\d+)?)\s*MHz\s+(?:gbw|gain[-\s]bandwidth|bandwidth)",
    "gbw_mhz_alt": r"(?i)gbw\s+(?:of\s+)?(\d+(?:\.\d+)?)\s*MHz",
    "gbw_ghz": r"(?i)(\d+(?:\.\d+)?)\s*GHz\s+(?:gbw|gain[-\s]bandwidth|bandwidth)",
    "phase_margin_deg": r"(?i)(\d+(?:\.\d+)?)\s*°?\s*(?:degrees?\s+)?phase\s+margin",
    "slew_rate_v_us": r"(?i)(\d+(?:\.\d+)?)\s*V/?μ?u?s\s+slew",
    "power_mw": r"(?i)(\d+(?:\.\d+)?)\s*mW\s+(?:of\s+)?power",
}
PROCESS, STAGES = r"(?i)(\d+)\s*nm\b", r"(?i)(\d+)[-\s]stage"
COMPENSATION = [("miller", "miller"), ("nested", "nested miller"), ("cascode comp", "cascode")]


def _number(text: str, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def _any(low: Column, words: list[str]) -> Column:
    out = low.contains(words[0])
    for w in words[1:]:
        out = out | low.contains(w)
    return out


def parse(requests: DataFrame, text: str = "text") -> DataFrame:
    """Adds topology, num_stages, compensation, process_node and the target figures; GHz wins over MHz."""
    low = F.lower(text)
    topology = F.lit("two_stage_opamp")
    for name, words in reversed(TOPOLOGIES):
        topology = F.when(_any(low, words), name).otherwise(topology)
    compensation = F.lit("none")
    for word, name in reversed(COMPENSATION):
        compensation = F.when(low.contains(word), name).otherwise(compensation)
    n = {k: _number(text, p) for k, p in PATTERNS.items()}
    out = requests.withColumn("topology", topology)
    stages = F.coalesce(F.regexp_extract(text, STAGES, 1).try_cast("long"), F.when(_any(low, ["two-stage", "two stage"]) | (F.col("topology") == "two_stage_opamp"), F.lit(2)).otherwise(F.lit(1)).cast("long"))
    process = F.regexp_extract(text, PROCESS, 1)
    return out.withColumns({
        "num_stages": stages, "compensation": compensation, "process_node": F.when(process == "", "130nm").otherwise(F.concat(process, F.lit("nm"))),
        "gain_db": F.coalesce(n["gain_db"], n["gain_db_alt"]), "gbw_mhz": F.coalesce(n["gbw_ghz"] * 1000.0, n["gbw_mhz"], n["gbw_mhz_alt"]),
        "phase_margin_deg": n["phase_margin_deg"], "slew_rate_v_us": n["slew_rate_v_us"], "power_mw": n["power_mw"],
    })
