"""What a diagnosis says: summaries of bottlenecks, agents' turns, evidence for recommendations, grounding prompts, and the
typed reading of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.library import sigmoid

#: How many texts, facts and circuits a prompt holds, and how much of a text.
MAX_TEXT, MAX_FACTS, MAX_CIRCUITS, TEXT_CHARS = 4, 10, 3, 300
AGENTS = {"slack": "TimingAgent", "drc": "DRCAgent", "congestion": "DRCAgent"}


def decimals(value: Column, places: int, sign: bool = False) -> Column:
    """A number with that many decimals, halves rounded away from zero; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%{'+' if sign else ''}.{places}f", F.round(value, places)))


def shortened(text: Column, chars: int = TEXT_CHARS) -> Column:
    """The first so many code points."""
    return F.substring(text, 1, chars)


def summaries(p: DataFrame, top: int = 5) -> DataFrame:
    """(circuit_id, task, summary) of predictions: one sentence for each task."""
    s = p.groupBy("circuit_id").agg(F.min("slack").alias("worst"), F.sum((F.col("slack") <= 0).cast("long")).alias("bad"), F.count("*").alias("n"), F.max(F.round(sigmoid(F.col("drc_logit")), 9)).alias("prob"), F.max("congestion").alias("top"))
    text = {
        "slack": F.concat(F.lit("Worst slack "), decimals(F.col("worst"), 3, True), F.format_string(" ns; %d/%d nodes at or below 0.00 ns.", "bad", "n")),
        "drc": F.concat(F.lit("DRC-hotspot probability up to "), decimals(F.col("prob"), 2), F.format_string(" on %d cells.", F.least("n", F.lit(top)))),
        "congestion": F.concat(F.lit("Routing congestion peaks at "), decimals(F.col("top"), 2), F.lit(" (normalized).")),
    }
    return s.select("circuit_id", F.explode(F.array(*(F.struct(F.lit(k).alias("task"), v.alias("summary")) for k, v in text.items()))).alias("t")).select("circuit_id", "t.*")


def turns(circuits: DataFrame, bottlenecks: DataFrame, recs: DataFrame) -> DataFrame:
    """(circuit_id, agent, n_bottlenecks, n_recommendations, summary): one turn of both agents for each circuit, also where
    nothing was flagged."""
    agent = F.create_map(*(F.lit(x) for kv in AGENTS.items() for x in kv))
    found = bottlenecks.withColumn("agent", agent[F.col("task")]).groupBy("circuit_id", "agent").agg(F.count("*").alias("n_b"), F.max(F.struct("severity", "violation", "location")).alias("b"))
    fixes = recs.withColumn("agent", agent[F.col("task")]).groupBy("circuit_id", "agent").agg(F.count("*").alias("n_r"))
    every = circuits.select("circuit_id", F.explode(F.array(*map(F.lit, sorted(set(AGENTS.values()))))).alias("agent"))
    rows = every.join(found, ["circuit_id", "agent"], "left").join(fixes, ["circuit_id", "agent"], "left")
    rows = rows.withColumns({"n_b": F.coalesce("n_b", F.lit(0).cast("long")), "n_r": F.coalesce("n_r", F.lit(0).cast("long"))})
    timing = F.concat(F.lit("Flagged "), "b.violation", F.lit(" ("), decimals(F.col("b.severity"), 2), F.lit(" severity) at "), F.coalesce("b.location", F.lit("None")), F.format_string("; %d candidate fixes.", "n_r"))
    layout = F.format_string("Flagged %d DRC/congestion issue(s); %d fixes.", "n_b", "n_r")
    clean = F.when(F.col("agent") == "TimingAgent", "No timing violations flagged.").otherwise("No DRC/congestion hotspots flagged.")
    text = F.when(F.col("n_b") == 0, clean).when(F.col("agent") == "TimingAgent", timing).otherwise(layout)
    return rows.select("circuit_id", "agent", F.col("n_b").alias("n_bottlenecks"), F.col("n_r").alias("n_recommendations"), text.alias("summary"))


def grounded(recs: DataFrame, actions: DataFrame, texts: DataFrame) -> DataFrame:
    """recs with the action, the rationale and the evidence: two texts of the circuit (circuit_id, rank, text) at most, and the
    design rules that bind the fix."""
    two = texts.where("rank <= 2").groupBy("circuit_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", shortened(F.col("text")).alias("t")))), lambda x: x["t"]).alias("texts"))
    rows = recs.join(F.broadcast(actions), "fix", "left").join(two, "circuit_id", "left")  # a row for each fix of the graph
    rule = F.when(F.size("rules") > 0, F.array(F.concat(F.lit("constrained by design rule(s): "), F.array_join("rules", ", ")))).otherwise(F.array().cast("array<string>"))
    rationale = F.concat(F.lit("Resolves "), "violation", F.lit(" at "), F.coalesce("location", F.lit("the flagged nodes")), F.lit("."))
    return rows.withColumns({"action": F.coalesce("action", "fix"), "rationale": rationale, "evidence": F.concat(F.coalesce("texts", F.array().cast("array<string>")), rule)}).drop("texts")


def grounding_prompt(requests: DataFrame, facts: DataFrame, texts: DataFrame, circuits: DataFrame, max_text: int = MAX_TEXT, max_facts: int = MAX_FACTS, max_circuits: int = MAX_CIRCUITS) -> DataFrame:
    """(request, prompt): what was retrieved for each request as one block of lines under headings.

    facts, texts: (request, rank, line); circuits: (request, rank, name, similarity, size). Each is cut to its first ranks.
    """
    sim = F.coalesce(decimals(F.col("similarity"), 2), F.lit("?"))
    near = circuits.select("request", "rank", F.concat("name", F.lit(" (sim "), sim, F.lit(", "), F.coalesce(F.col("size").cast("string"), F.lit("?")), F.lit(" gates)")).alias("line"))
    parts = [("Knowledge-graph facts:", facts, max_facts), ("Relevant EDA knowledge:", texts.select("request", "rank", shortened(F.col("line")).alias("line")), max_text), ("Similar past circuits:", near, max_circuits)]
    every = None
    for at, (head, rows, most) in enumerate(parts):
        block = rows.where(F.col("rank") <= most).groupBy("request").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: F.concat(F.lit("  - "), x["line"])), "\n").alias("lines"))
        one = block.select("request", F.lit(at).alias("at"), F.concat(F.lit(head + "\n"), "lines").alias("block"))
        every = one if every is None else every.unionByName(one)
    joined = every.groupBy("request").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "block"))), lambda x: x["block"]), "\n").alias("prompt"))
    return requests.select("request").join(joined, "request", "left").select("request", F.coalesce("prompt", F.lit("(no retrieved context)")).alias("prompt"))


def typed_reply(replies: DataFrame, column: str, schema: str) -> DataFrame:
    """replies with `parsed`: the outermost braces of a reply, fences taken off, read as JSON of that schema; null if there is no
    object, it is not JSON, or a value has another type than the schema says (that field alone is null)."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.col(column)), r"^```(?:json)?\s*", ""), r"```\s*$", "")
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    whole = F.json_object_keys(body).isNotNull()
    return replies.withColumn("parsed", F.when((body != "") & whole, F.from_json(body, schema)))
