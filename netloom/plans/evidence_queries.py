"""Summaries, turns, evidence, grounding prompts and replies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import knowledge as kg
from ..functions.library import sql_values
from ..operators import evidence, graph_facts, vectors
from ..sources.tables import checkpointed, table
from . import advice_queries as advice, text_queries as text, training_queries as training
from .netlist_sql import sql

REPLY = "fix string, confidence double, steps array<string>"


def bottleneck_summaries(spark, sf_dir) -> DataFrame:
    return evidence.summaries(advice._predictions(spark, sf_dir))


def agent_turns(spark, sf_dir):
    b, r = advice._recs(spark, sf_dir)
    circuits = advice._predictions(spark, sf_dir).select("circuit_id").distinct()
    return evidence.turns(circuits, b, r)


def _hit_texts(spark, sf_dir) -> DataFrame:
    """(item_id, rank, text): the documents nearest to each benchmark item by shared tokens."""
    hits = checkpointed(text.keyword_topk(spark, sf_dir).select("item_id", "doc_id", "rank"))
    return hits.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("item_id", "rank", "text")


def recommendation_evidence(spark, sf_dir):
    """What each recommendation does and rests on; the texts of a circuit are those of the benchmark item of its number."""
    r = advice._recs(spark, sf_dir)[1]
    texts = _hit_texts(spark, sf_dir).withColumnRenamed("item_id", "circuit_id")
    found = evidence.grounded(r, kg.actions(spark), texts)
    return found.select("circuit_id", "task", "fix", "action", "rationale", F.size("evidence").cast("long").alias("n_evidence"), F.md5(F.array_join("evidence", "\n")).alias("evidence_md5"))


def grounding_prompts(spark, sf_dir):
    """One prompt for each benchmark item: the facts of a violation, documents, and vectors near one of its own."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request"))
    facts = graph_facts.all_facts(*advice._kg(spark), "45nm").join(kg.actions(spark).withColumnRenamed("fix", "object"), "object", "left")
    more = F.when((F.col("relation") == "RESOLVED_BY") & F.col("action").isNotNull(), F.concat(F.lit(": "), "action")).otherwise("")
    facts = facts.select("violation", "rank", F.concat(F.concat_ws(" ", "subject", "relation", "object"), more).alias("line"))
    kinds = sorted({v for _, kind, v, _ in kg.EDGE_ROWS if kind == "RESOLVED_BY"})
    asked = items.withColumn("violation", F.element_at(F.array(*map(F.lit, kinds)), (F.col("request") % len(kinds) + 1).cast("int")))
    e = table(spark, sf_dir, "embeddings")
    own = table(spark, sf_dir, "embeddings").join(items.select((F.col("request") * 20).alias("vec_id")), "vec_id", "left_semi")
    near = vectors.topk(own, e, 4).join(e.select("vec_id", "label"), "vec_id")
    near = near.select((F.col("query_id") / 20).cast("long").alias("request"), "rank", F.format_string("v%d", "vec_id").alias("name"), "similarity", F.col("label").alias("size"))
    texts = _hit_texts(spark, sf_dir).select(F.col("item_id").alias("request"), "rank", F.col("text").alias("line"))
    found = evidence.grounding_prompt(items, asked.join(F.broadcast(facts), "violation").select("request", "rank", "line"), texts, near)  # ten facts at most for each of a dozen violations
    return found.select("request", F.size(F.split("prompt", "\n")).cast("long").alias("n_lines"), F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


def _replies(spark, sf_dir) -> DataFrame:
    """A reply for each event: fenced, bare, inside prose, with a value of another type, broken, or without an object."""
    body = F.concat(F.lit('{"fix": "f'), F.col("event_id").cast("string"), F.lit('", "confidence": 0.'), (F.col("event_id") % 9 + 1).cast("string"), F.lit(', "steps": ["a", "b"]}'))
    forms = [F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("  "), body), F.concat(F.lit("Here it is: "), body, F.lit(" as asked")), F.lit('{"fix": "x", "confidence": "high", "extra": 1}'), F.lit('{"fix": "x", "confidence": '), F.lit("no object at all")]
    return table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int")).alias("reply"))


def reply_parse(spark, sf_dir):
    found = evidence.typed_reply(_replies(spark, sf_dir), "reply", REPLY)
    return found.select("event_id", F.col("parsed").isNotNull().alias("read"), F.col("parsed.fix").alias("fix"), F.col("parsed.confidence").alias("confidence"), F.size("parsed.steps").cast("long").alias("n_steps"))


QUERIES = {f.__name__: f for f in (bottleneck_summaries, agent_turns, recommendation_evidence, grounding_prompts, reply_parse)}

_TURN = """agents AS (SELECT DISTINCT circuit_id, agent FROM preds, (VALUES ('DRCAgent'), ('TimingAgent')) AS a(agent)),
by_agent AS (SELECT *, CASE task WHEN 'slack' THEN 'TimingAgent' ELSE 'DRCAgent' END AS agent FROM necks), counted AS (SELECT circuit_id, agent, count(*) AS b, max(severity) AS severity, any_value(violation) AS violation, any_value(location) AS location FROM by_agent GROUP BY ALL),
fixed AS (SELECT circuit_id, CASE task WHEN 'slack' THEN 'TimingAgent' ELSE 'DRCAgent' END AS agent, count(*) AS r FROM recs GROUP BY ALL)"""
_TEXTS = f"hits AS ({text.ORACLE_SQL['keyword_topk']}), hit_texts AS (SELECT h.item_id, h.rank, d.text FROM hits h JOIN documents d USING (doc_id))"
_ACTIONS = f"actions(fix, action) AS (VALUES {sql_values(kg.ACTIONS)})"
_FIRST = "event_id % 6 < 3"

ORACLE_SQL = {
    "bottleneck_summaries": sql(
        "SELECT circuit_id, 'slack' AS task, 'Worst slack ' || printf('%+.3f', round(min(slack), 3)) || ' ns; ' || count(*) FILTER (slack <= 0) || '/' || count(*) || ' nodes at or below 0.00 ns.' AS summary FROM preds GROUP BY circuit_id UNION ALL SELECT circuit_id, 'drc', 'DRC-hotspot probability up to ' || printf('%.2f', round(max(prob), 2)) || ' on ' || least(count(*), 5) || ' cells.' FROM preds GROUP BY circuit_id UNION ALL SELECT circuit_id, 'congestion', 'Routing congestion peaks at ' || printf('%.2f', round(max(congestion), 2)) || ' (normalized).' FROM preds GROUP BY circuit_id",
        advice._P,
    ),
    "agent_turns": sql(
        "SELECT a.circuit_id, a.agent, coalesce(b, 0) AS n_bottlenecks, coalesce(r, 0) AS n_recommendations, CASE WHEN b IS NULL THEN CASE a.agent WHEN 'TimingAgent' THEN 'No timing violations flagged.' ELSE 'No DRC/congestion hotspots flagged.' END WHEN a.agent = 'TimingAgent' THEN 'Flagged ' || violation || ' (' || printf('%.2f', round(severity, 2)) || ' severity) at ' || coalesce(location, 'None') || '; ' || coalesce(r, 0) || ' candidate fixes.' ELSE 'Flagged ' || b || ' DRC/congestion issue(s); ' || coalesce(r, 0) || ' fixes.' END AS summary FROM agents a LEFT JOIN counted USING (circuit_id, agent) LEFT JOIN fixed USING (circuit_id, agent)",
        f"{advice._RECS}, {_TURN}",
    ),
    "recommendation_evidence": sql(
        "SELECT r.circuit_id, r.task, r.fix, coalesce(a.action, r.fix) AS action, 'Resolves ' || r.violation || ' at ' || coalesce(n.location, 'the flagged nodes') || '.' AS rationale, len(e) AS n_evidence, md5(array_to_string(e, chr(10))) AS evidence_md5 FROM (SELECT r.*, list_concat(coalesce(t.texts, []), CASE WHEN rules <> '' THEN ['constrained by design rule(s): ' || replace(rules, ',', ', ')] ELSE [] END) AS e FROM recs r LEFT JOIN (SELECT item_id, list(left(text, 300) ORDER BY rank) AS texts FROM hit_texts WHERE rank <= 2 GROUP BY item_id) t ON t.item_id = r.circuit_id) r JOIN necks n ON n.circuit_id = r.circuit_id AND n.task = r.task LEFT JOIN actions a ON a.fix = r.fix",
        f"{advice._RECS}, {_TEXTS}, {_ACTIONS}",
    ),
    "grounding_prompts": f"""WITH {training._FACTS}, {_TEXTS}, {_ACTIONS}, kinds AS (SELECT violation, row_number() OVER (ORDER BY violation) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT src AS violation FROM kg_edges WHERE type = 'RESOLVED_BY')), near AS ({text._knn('q.vec_id <> e.vec_id', 4)}),
parts AS (SELECT item_id AS request, 0 AS place, rank, '  - ' || subject || ' ' || relation || ' ' || object || CASE WHEN relation = 'RESOLVED_BY' AND action IS NOT NULL THEN ': ' || action ELSE '' END AS line FROM benchmark JOIN kinds ON k = item_id % n JOIN facts USING (violation) LEFT JOIN actions ON fix = object WHERE rank <= 10
  UNION ALL SELECT item_id, 1, rank, '  - ' || left(text, 300) FROM hit_texts WHERE rank <= 4
  UNION ALL SELECT query_id // 20, 2, rank, '  - v' || vec_id || ' (sim ' || printf('%.2f', round(similarity, 2)) || ', ' || label || ' gates)' FROM near JOIN embeddings USING (vec_id) WHERE rank <= 3 AND query_id // 20 IN (SELECT item_id FROM benchmark)),
blocks AS (SELECT request, place, ['Knowledge-graph facts:', 'Relevant EDA knowledge:', 'Similar past circuits:'][place + 1] || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS block FROM parts GROUP BY request, place),
prompts AS (SELECT item_id AS request, coalesce(p, '(no retrieved context)') AS prompt FROM benchmark LEFT JOIN (SELECT request, string_agg(block, chr(10) ORDER BY place) AS p FROM blocks GROUP BY request) q ON q.request = item_id)
SELECT request, len(string_split(prompt, chr(10))) AS n_lines, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM prompts""",
    "reply_parse": f"SELECT event_id, event_id % 6 < 4 AS read, CASE WHEN {_FIRST} THEN 'f' || event_id WHEN event_id % 6 = 3 THEN 'x' END AS fix, CASE WHEN {_FIRST} THEN ('0.' || (event_id % 9 + 1))::DOUBLE END AS confidence, CASE WHEN {_FIRST} THEN 2 END::BIGINT AS n_steps FROM events",
}
