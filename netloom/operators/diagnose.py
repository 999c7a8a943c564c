"""Bottlenecks, recommendations, conflict reconciliation and reports, for all circuits at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.library import CRITICAL_NS, pseudo_logit, sigmoid
from . import graph_facts


def node_name(idx="idx") -> Column:
    return F.concat(F.lit("n"), F.col(idx))


def predictions(slacks: DataFrame, labels: DataFrame) -> DataFrame:
    """Ground truth in the shape of predictions: slack, congestion and a hotspot pseudo-logit."""
    return slacks.select("circuit_id", "idx", "slack").join(labels.select("circuit_id", "idx", "congestion", pseudo_logit(F.col("drc")).alias("drc_logit")), ["circuit_id", "idx"])


def _top(rows: DataFrame, order: list[Column], k: int = 5) -> DataFrame:
    """(circuit_id, node_ids, location): names of the first k nodes and of the first three."""
    w = Window.partitionBy("circuit_id").orderBy(*order, "idx")
    first = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    names = F.transform(F.sort_array(F.collect_list(F.struct("r", node_name().alias("n")))), lambda x: x["n"])
    return first.groupBy("circuit_id").agg(names.alias("names")).select("circuit_id", F.array_join("names", ", ").alias("node_ids"), F.array_join(F.slice("names", 1, 3), ", ").alias("location"))


def rank_critical(p: DataFrame) -> DataFrame:
    """Worst-slack bottleneck of each circuit."""
    n, worst = F.sum((F.col("slack") <= 0).cast("long")), F.min("slack")
    s = p.groupBy("circuit_id").agg(n.alias("n_viol"), F.count("*").alias("n"), worst.alias("worst_slack"))
    severity = F.least(F.lit(1.0), 0.5 * F.col("n_viol") / F.col("n") + 0.5 * F.least(F.lit(1.0), F.abs(F.least("worst_slack", F.lit(0.0))) / 0.2))
    severity = F.when(F.col("n_viol") > 0, F.greatest(severity, F.lit(0.05))).otherwise(F.lit(0.0))
    return s.join(_top(p, [F.asc("slack")]), "circuit_id").select("circuit_id", "n_viol", "worst_slack", F.round(severity, 9).alias("severity"), "location", "node_ids")


def rank_drc(p: DataFrame, least: float = 0.5) -> DataFrame:
    p = p.withColumn("prob", F.round(sigmoid(F.col("drc_logit")), 9))
    s = p.groupBy("circuit_id").agg(F.max("prob").alias("severity")).where(F.col("severity") >= least)
    return s.join(_top(p, [F.desc("prob")]), "circuit_id").select("circuit_id", "severity", "location", "node_ids")


def rank_congestion(p: DataFrame, least: float = 0.3) -> DataFrame:
    s = p.groupBy("circuit_id").agg(F.max("congestion").alias("m")).where(F.col("m") >= least)
    return s.join(_top(p, [F.desc("congestion")]), "circuit_id").select("circuit_id", F.least(F.lit(1.0), "m").alias("severity"), "location", "node_ids")


def violation_class(p: DataFrame) -> DataFrame:
    """hold_violation where many nodes are slightly late, else setup_violation."""
    neg = F.when(F.col("slack") < 0, F.col("slack"))
    hold = (F.avg(neg) > -0.02) & (F.count(neg) > 0.3 * F.count("*"))
    return p.groupBy("circuit_id").agg(F.when(hold, "hold_violation").otherwise("setup_violation").alias("violation"))


def bottlenecks(p: DataFrame) -> DataFrame:
    """(circuit_id, task, violation, severity, location) of all three rankings."""
    timing = rank_critical(p).join(violation_class(p), "circuit_id").select("circuit_id", F.lit("slack").alias("task"), "violation", "severity", "location")
    drc = rank_drc(p).select("circuit_id", F.lit("drc").alias("task"), F.lit("drc_density").alias("violation"), "severity", "location")
    congestion = rank_congestion(p).select("circuit_id", F.lit("congestion").alias("task"), F.lit("routing_congestion").alias("violation"), "severity", "location")
    return timing.unionByName(drc).unionByName(congestion)


def confidence(severity: Column, effort: Column) -> Column:
    """Higher for a severe problem and a cheap fix, between 0.05 and 0.95."""
    step = F.when(effort == "low", 0.1).when(effort == "high", -0.1).otherwise(0.0)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), 0.4 + 0.4 * severity + step))


def recommendations(b: DataFrame, edges: DataFrame, fixes: DataFrame, process_node: str | None = "45nm") -> DataFrame:
    """Each bottleneck's fixes with outcomes, conflicts, at most two rules, effort and confidence."""

    def joined(rows: DataFrame, value: str, name: str) -> DataFrame:
        return rows.groupBy("fix").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", value))), lambda x: x[value]).alias(name))

    outcomes = joined(graph_facts.related(edges, "PRODUCES", "fix", "o"), "o", "outcomes")
    rules = joined(graph_facts.related(edges, "CONSTRAINED_BY", "fix", "o"), "o", "rules")
    clashes = graph_facts.conflicts(edges).groupBy("fix").agg(F.sort_array(F.collect_set("conflict")).alias("conflicts"))
    f = graph_facts.fixes_for_violation(edges, fixes, process_node)
    for other in (outcomes, rules, clashes):
        f = f.join(other, "fix", "left")
    empty = F.array().cast("array<string>")
    f = f.select("violation", "fix", "seq", "effort", F.coalesce("outcomes", empty).alias("outcomes"), F.coalesce("conflicts", empty).alias("conflicts"), F.slice(F.coalesce("rules", empty), 1, 2).alias("rules"))
    return b.join(F.broadcast(f), "violation").withColumn("confidence", F.round(confidence(F.col("severity"), F.col("effort")), 9))


def reconcile(recs: DataFrame) -> DataFrame:
    """Recommendations with what they clash with among the circuit's own fixes; a clash costs 0.15 of confidence."""
    proposed = recs.groupBy("circuit_id").agg(F.collect_set("fix").alias("proposed"))
    r = recs.join(proposed, "circuit_id").withColumn("clashing", F.array_intersect("conflicts", "proposed"))
    return r.withColumn("adjusted", F.when(F.size("clashing") > 0, F.round(F.greatest(F.lit(0.05), F.col("confidence") - 0.15), 9)).otherwise(F.col("confidence")))


def report(b: DataFrame, reconciled: DataFrame) -> DataFrame:
    """One row for each circuit: bottlenecks by severity, recommendations by confidence, advisories."""
    left = b.groupBy("circuit_id").agg(F.count("*").alias("n_bottlenecks"), F.max("severity").alias("max_severity"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("severity")).alias("s"), "task"))), lambda x: x["task"]), ",").alias("tasks"))
    right = reconciled.groupBy("circuit_id").agg(F.count("*").alias("n_recommendations"), F.sum((F.size("clashing") > 0).cast("long")).alias("n_advisories"), F.min(F.struct((-F.col("adjusted")).alias("c"), "task", "fix")).alias("t"))
    return left.join(right, "circuit_id", "left").select("circuit_id", "n_bottlenecks", "max_severity", "tasks", F.coalesce("n_recommendations", F.lit(0).cast("long")).alias("n_recommendations"), F.coalesce("n_advisories", F.lit(0).cast("long")).alias("n_advisories"), F.col("t.fix").alias("top_fix"))


def report_json(b: DataFrame, reconciled: DataFrame) -> DataFrame:
    """The report of each circuit as one JSON document."""
    left = b.groupBy("circuit_id").agg(F.sort_array(F.collect_list(F.struct("severity", "task", "violation", "location")), asc=False).alias("bottlenecks"))
    right = reconciled.groupBy("circuit_id").agg(F.sort_array(F.collect_list(F.struct(F.col("adjusted").alias("confidence"), "task", "fix", "effort", "outcomes", "conflicts", "rules")), asc=False).alias("recommendations"))
    both = left.join(right, "circuit_id", "left")
    return both.select("circuit_id", F.to_json(F.struct("bottlenecks", "recommendations")).alias("report"))


def advisor_bottlenecks(p: DataFrame, analog: DataFrame) -> DataFrame:
    """The advisor's rules (strict thresholds, severity at most 1), the five most severe of each circuit."""
    parts = [
        p.groupBy("circuit_id").agg(F.max("congestion").alias("m")).where("m > 0.3").select("circuit_id", F.lit("congestion").alias("task"), F.least(F.lit(1.0), "m").alias("severity")),
        p.groupBy("circuit_id").agg(F.round(F.max(sigmoid(F.col("drc_logit"))), 9).alias("m")).where("m > 0.5").select("circuit_id", F.lit("drc").alias("task"), F.col("m").alias("severity")),
        analog.groupBy("circuit_id").agg(F.min("gbw_score").alias("m")).where("m < 0.3").select("circuit_id", F.lit("analog_performance:gbw").alias("task"), F.least(F.lit(1.0), 1.0 - F.greatest("m", F.lit(0.0))).alias("severity")),
        analog.groupBy("circuit_id").agg(F.max("parasitic_impact").alias("m")).where("m > 0.5").select("circuit_id", F.lit("analog_performance:parasitic").alias("task"), F.least(F.lit(1.0), "m").alias("severity")),
    ]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    order = Window.partitionBy("circuit_id").orderBy(F.desc("severity"), "task")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= 5)


def advice(b: DataFrame, tips: DataFrame) -> DataFrame:
    """[task] tip for each bottleneck, and how sure the advisor is."""
    return b.join(F.broadcast(tips), "task").select("circuit_id", "rank", F.format_string("[%s] %s", "task", "tip").alias("advice"), F.round(1.0 - 0.5 * F.col("severity"), 2).alias("confidence"))


def scenarios(b: DataFrame, per_role: int = 40) -> DataFrame:
    """Bottlenecks dealt to roles in the order of an integer hash, `per_role` each."""
    role = F.when(F.col("task") == "slack", "timing").when(F.col("task") == "drc", "drc").otherwise("placement")
    order = Window.partitionBy("role").orderBy(F.expr("(circuit_id * 7919) % 10007"), "circuit_id")
    return b.withColumn("role", role).withColumn("slot", F.row_number().over(order).cast("long")).where(F.col("slot") <= per_role).select("role", "slot", "circuit_id", "violation", "severity")


def rank_critical_probability(p: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Where slacks are not predicted: circuits whose critical-path probability reaches the threshold, worst nodes first."""
    hot = p.select("circuit_id", "idx", F.round(sigmoid(pseudo_logit((F.col("slack") <= CRITICAL_NS).cast("double"))), 9).alias("prob"))
    worst = hot.groupBy("circuit_id").agg(F.max("prob").alias("severity")).where(F.col("severity") >= threshold)
    return worst.join(_top(hot, [F.desc("prob")]), "circuit_id").select("circuit_id", "severity", "location", "node_ids")


def advisories(reconciled: DataFrame) -> DataFrame:
    """One row of advice for each recommendation that clashes with another one of its circuit."""
    text = F.concat("fix", F.lit(" conflicts with "), F.array_join("clashing", ", "))
    return reconciled.where(F.size("clashing") > 0).select("circuit_id", F.lit("ppa").alias("task"), "fix", F.lit(0.5).alias("confidence"), text.alias("advice"))


def confidence_map(recs: DataFrame) -> DataFrame:
    """(circuit_id, task, confidence): of a task's recommendations the last one's, in the order in which the graph gives the fixes."""
    return recs.groupBy("circuit_id", "task").agg(F.max_by("confidence", "seq").alias("confidence"), F.count("*").alias("n"))


def task_summary(p: DataFrame) -> DataFrame:
    """Least, mean and greatest prediction of each circuit and task."""
    tasks = {"slack": F.col("slack"), "congestion": F.col("congestion"), "drc": F.round(sigmoid(F.col("drc_logit")), 9)}
    rows = p.select("circuit_id", F.explode(F.array(*(F.struct(F.lit(k).alias("task"), v.alias("value")) for k, v in tasks.items()))).alias("t")).select("circuit_id", "t.*")
    return rows.groupBy("circuit_id", "task").agg(F.min("value").alias("least"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("greatest"))


def graph_payload(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(circuit_id, n_nodes, n_edges, links): what a viewer draws; links are "driver>sink" in order."""
    links = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("drv", "snk"))), lambda e: F.concat_ws(">", e["drv"].cast("string"), e["snk"].cast("string"))), ",")
    e = edges.groupBy("circuit_id").agg(F.count("*").alias("n_edges"), links.alias("links"))
    return nodes.groupBy("circuit_id").agg(F.count("*").alias("n_nodes")).join(e, "circuit_id").select("circuit_id", "n_nodes", "n_edges", "links")
