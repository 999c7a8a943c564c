"""Property-graph lookups: fixes, outcomes, conflicts, rules, and what they yield for a topology."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def related(edges: DataFrame, kind: str, src: str, dst: str) -> DataFrame:
    return edges.where(F.col("type") == kind).select("seq", F.col("src").alias(src), F.col("dst").alias(dst))


def fixes_for_violation(edges: DataFrame, fixes: DataFrame, process_node: str | None = None) -> DataFrame:
    """(violation, fix, effort, process_nodes, seq), for one process node if it is given."""
    found = related(edges, "RESOLVED_BY", "violation", "fix").join(fixes, "fix", "left")
    if process_node:
        found = found.where(F.col("process_nodes").isNull() | F.array_contains(F.split("process_nodes", ","), process_node))
    return found.select("violation", "fix", "effort", "process_nodes", "seq")


def conflicts(edges: DataFrame) -> DataFrame:
    """(fix, conflict) in both directions."""
    one = related(edges, "CONFLICTS_WITH", "fix", "conflict").select("fix", "conflict")
    return one.unionByName(one.select(F.col("conflict").alias("fix"), F.col("fix").alias("conflict"))).distinct()


def fixes_for_topology(edges: DataFrame, fixes: DataFrame, process_node: str | None = None) -> DataFrame:
    """(topology, fix, violation, rank): each fix once, for the first violation that leads to it."""
    shown = related(edges, "COMMONLY_EXHIBITS", "topology", "violation").withColumnRenamed("seq", "first")
    both = shown.join(fixes_for_violation(edges, fixes, process_node), "violation")
    seen = both.groupBy("topology", "fix").agg(F.min(F.struct("first", "seq", "violation")).alias("m"))
    order = Window.partitionBy("topology").orderBy("m.first", "m.seq")
    return seen.select("topology", "fix", F.col("m.violation").alias("violation"), F.row_number().over(order).cast("long").alias("rank"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of each label, and all relations of each type."""
    a = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("node"))
    b = edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("relation"))
    return a.unionByName(b)


def all_facts(edges: DataFrame, fixes: DataFrame, process_node: str | None = None, most: int = 10) -> DataFrame:
    """(violation, rank, subject, relation, object): for each violation its fixes, then each fix's outcomes and conflicts."""
    f = fixes_for_violation(edges, fixes, process_node)
    rows = f.select("violation", F.lit(0).alias("part"), "seq", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("sub"), F.col("violation").alias("subject"), F.lit("RESOLVED_BY").alias("relation"), F.col("fix").alias("object"))
    others = {"PRODUCES": related(edges, "PRODUCES", "fix", "object").withColumnRenamed("seq", "sub"), "CONFLICTS_WITH": conflicts(edges).select("fix", F.col("conflict").alias("object"), F.lit(0).cast("long").alias("sub"))}
    for part, (kind, other) in enumerate(others.items(), 1):
        rows = rows.unionByName(f.select("violation", "fix", "seq").join(other, "fix").select("violation", F.lit(1).alias("part"), "seq", F.lit(part).alias("turn"), "sub", F.col("fix").alias("subject"), F.lit(kind).alias("relation"), "object"))
    order = Window.partitionBy("violation").orderBy("part", "seq", "turn", "sub", "object")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("violation", "rank", "subject", "relation", "object")


def facts_for(edges: DataFrame, fixes: DataFrame, violation: str, process_node: str | None = None, most: int = 10) -> DataFrame:
    """The facts that ground an answer on one violation."""
    return all_facts(edges, fixes, process_node, most).where(F.col("violation") == violation).drop("violation")


def prompts(facts: DataFrame) -> DataFrame:
    """(violation, n_facts, fixes, prompt): the facts as lines in order, and the names of the different fixes among them."""
    line = F.format_string("- %s %s %s", "subject", "relation", "object")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    names = F.array_join(F.array_sort(F.collect_set(F.when(F.col("relation") == "RESOLVED_BY", F.col("object")))), ", ")
    return facts.groupBy("violation").agg(F.count("*").alias("n_facts"), names.alias("fixes"), F.array_join(lines, "\n").alias("prompt"))
