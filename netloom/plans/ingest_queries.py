"""Netlists from text to timing, generated circuits, and a cyclic netlist, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.library import CELLS_SQL
from ..operators import generate, mapping, timing
from ..operators.netlist import Netlist, placed
from ..sources import netlists
from ..sources.tables import checkpointed, table, tasks_for
from .netlist_queries import netlist
from .netlist_sql import CTES, sql


def _texts(spark, sf_dir) -> DataFrame:
    """Every derived netlist as .bench text."""
    n = netlist(spark, sf_dir)
    return netlists.to_bench(n.nodes, n.edges)


def _parsed(spark, sf_dir) -> Netlist:
    statements = checkpointed(netlists.parse_bench(netlists.lines(_texts(spark, sf_dir))))
    nodes, edges = mapping.wire(statements, tasks_for(statements))
    own = F.col("name").cast("long").alias("circuit_id")
    nodes = checkpointed(placed(nodes.select(own, "idx", "role", "node_type")))
    return Netlist(nodes, checkpointed(edges.select(own, "drv", "snk").distinct()), tasks_for(nodes))


def bench_statements(spark, sf_dir) -> DataFrame:
    """What each text holds."""
    s = netlists.parse_bench(netlists.lines(_texts(spark, sf_dir)))
    count = lambda kind: F.sum((F.col("kind") == kind).cast("long")).alias(f"{kind}s")
    return s.groupBy(F.col("name").cast("long").alias("circuit_id")).agg(count("input"), count("output"), count("gate"), F.sum(F.when(F.col("kind") == "gate", F.size("ins"))).cast("long").alias("pins"))


def bench_nodes(spark, sf_dir):
    return _parsed(spark, sf_dir).nodes.select("circuit_id", "idx", "role", "node_type", "side", "x", "y")


def bench_edges(spark, sf_dir):
    return _parsed(spark, sf_dir).edges


def bench_nets(spark, sf_dir):
    return _parsed(spark, sf_dir).nets.select("circuit_id", "drv", "wire_length_um", "fanout")


def bench_sta(spark, sf_dir):
    """Timing of the parsed, mapped and placed netlists."""
    n = _parsed(spark, sf_dir)
    n.arcs = checkpointed(n.arcs)
    return timing.summary(timing.slack(checkpointed(timing.propagate(n.nodes, n.arcs)), n.nodes, (1.2,))).drop("factor")


def bench_cones(spark, sf_dir):
    """Cut-out circuits of the parsed netlists: nodes and edges of each kept cone."""
    n = _parsed(spark, sf_dir)
    cones = checkpointed(timing.fanin_cones(n.edges, n.nodes.where("role = 'PO'").select("circuit_id", "idx")))
    kept = cones.groupBy("circuit_id", "seed").agg(F.count("*").alias("nodes")).where("nodes >= 8")
    inside = n.edges.join(cones.withColumnRenamed("idx", "drv"), ["circuit_id", "drv"]).join(cones.withColumnRenamed("idx", "snk"), ["circuit_id", "seed", "snk"], "left_semi")
    return kept.join(inside.groupBy("circuit_id", "seed").agg(F.count("*").alias("edges")), ["circuit_id", "seed"])


def generated_edges(spark, sf_dir):
    """Synthetic circuits, one for each nation."""
    return generate.digital(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("seed")))[1]


def cyclic_levels(spark, sf_dir):
    """Derived netlists with the first output fed back to the first gate: what the cycle holds up is not placed."""
    n = netlist(spark, sf_dir)
    back = n.nodes.where("idx = n - 3 AND circuit_id % 2 = 0").select("circuit_id", F.col("idx").alias("drv"), F.lit(4).cast("long").alias("snk"))
    return timing.levels(n.nodes, n.edges.unionByName(back)).groupBy("circuit_id").agg(F.sum((F.col("level") < 0).cast("long")).alias("unplaced"))


def _looped(spark, sf_dir) -> Netlist:
    """Derived netlists of which the even ones have node 10 fed back to the first gate that drives it, if one does."""
    n = netlist(spark, sf_dir)
    back = n.edges.where("snk = 10 AND drv >= 4 AND circuit_id % 2 = 0").groupBy("circuit_id").agg(F.min("drv").alias("snk"))
    return Netlist(n.nodes, n.edges.unionByName(back.select("circuit_id", F.lit(10).cast("long").alias("drv"), "snk")))


def cyclic_sta(spark, sf_dir):
    """Timing of netlists with cycles: what a cycle holds up has arrival 0, the clock as required time, and is not critical."""
    n = _looped(spark, sf_dir)
    arcs = checkpointed(n.arcs)
    s = timing.slack(checkpointed(timing.propagate(n.nodes, arcs)), n.nodes, (1.2,))
    return s.select("circuit_id", "idx", "placed", F.round("at", 13).alias("arrival_time"), "depth", "required", "slack", "is_critical")


def cyclic_summary(spark, sf_dir):
    n = _looped(spark, sf_dir)
    arcs = checkpointed(n.arcs)
    return timing.summary(timing.slack(checkpointed(timing.propagate(n.nodes, arcs)), n.nodes, (0.95,))).drop("factor")


QUERIES = {f.__name__: f for f in (cyclic_sta, cyclic_summary, bench_statements, bench_nodes, bench_edges, bench_nets, bench_sta, bench_cones, generated_edges, cyclic_levels)}


def parsed_sql(select: str, more: str = "") -> str:
    """As sql(), over the netlists that the parser makes of the derived ones: NAND cells by pins, places by index."""
    head, tail = CTES.split("\npins AS", 1)
    head = head.replace("nodes AS (", "nodes0 AS (").replace("FROM nodes, range", "FROM nodes0, range").replace("FROM nodes WHERE", "FROM nodes0 WHERE")
    nodes = f"""fan AS (SELECT circuit_id, snk AS idx, count(*) AS k FROM edges GROUP BY ALL),
nodes AS (SELECT b.circuit_id, b.idx, b.n, b.role, coalesce(c.cell, b.role) AS node_type, b.side,
  CASE b.role WHEN 'PI' THEN 0 WHEN 'PO' THEN b.side - 1 ELSE 1 + ((b.idx * 7919) % ((b.side - 2) * b.side)) // b.side END::BIGINT AS x,
  CASE b.role WHEN 'PI' THEN b.idx * b.side // 4 WHEN 'PO' THEN (b.idx - b.n + 3) * b.side // 3 ELSE ((b.idx * 7919) % ((b.side - 2) * b.side)) % b.side END::BIGINT AS y,
  c.intrinsic_delay, c.input_cap, c.output_res, c.num_inputs FROM nodes0 b LEFT JOIN fan f ON f.circuit_id = b.circuit_id AND f.idx = b.idx
  LEFT JOIN {CELLS_SQL} c ON b.role = 'GATE' AND c.cell = CASE f.k WHEN 1 THEN 'BUF_X1' WHEN 2 THEN 'NAND2_X1' ELSE 'NAND3_X1' END),"""
    return f"WITH RECURSIVE {head}\n{nodes}\npins AS{tail}{', ' + more if more else ''} {select}"


_HELD = "held AS (SELECT circuit_id, drv AS idx FROM back UNION SELECT h.circuit_id, l.snk FROM held h JOIN edges l ON l.circuit_id = h.circuit_id AND l.drv = h.idx)"


def looped_sql(select: str) -> str:
    """As sql(), over the netlists with a fed back output; arcs that touch what the cycle holds up play no part in timing."""
    text = CTES.replace("edges AS (SELECT DISTINCT", "edges0 AS (SELECT DISTINCT").replace("\npins AS", f"\nback AS (SELECT circuit_id, 10::BIGINT AS drv, min(drv) AS snk FROM edges0 WHERE snk = 10 AND drv >= 4 AND circuit_id % 2 = 0 GROUP BY circuit_id),\nedges AS (SELECT circuit_id, drv, snk FROM edges0 UNION SELECT circuit_id, drv, snk FROM back),\n{_HELD},\npins AS", 1)
    free = "FROM (SELECT * FROM arcs a WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.circuit_id = a.circuit_id AND h.idx IN (a.drv, a.snk))) GROUP BY ALL)"
    text = text.replace("'d': fwd}) AS p FROM arcs GROUP BY ALL)", f"'d': fwd}}) AS p {free}").replace("'d': bwd}) AS p FROM arcs GROUP BY ALL)", f"'d': bwd}}) AS p {free}")
    return f"WITH RECURSIVE {text} {select}"


_CONES = "cones AS (SELECT circuit_id, idx AS seed, idx FROM nodes WHERE role = 'PO' UNION SELECT c.circuit_id, c.seed, e.drv FROM cones c JOIN edges e ON e.circuit_id = c.circuit_id AND e.snk = c.idx)"
ORACLE_SQL = {
    "cyclic_sta": looped_sql("SELECT s.circuit_id, s.idx, h.idx IS NULL AS placed, round(arrival, 13) AS arrival_time, depth, required, slack, slack <= 0.05e0 AND h.idx IS NULL AS is_critical FROM slacks s LEFT JOIN held h ON h.circuit_id = s.circuit_id AND h.idx = s.idx WHERE factor = 1.2e0"),
    "cyclic_summary": looped_sql("SELECT s.circuit_id, round(max(clock), 13) AS clock_period_ns, round(max(max_at), 13) AS max_arrival_time_ns, coalesce(min(slack) FILTER (h.idx IS NULL), 0e0) AS min_slack_ns, count(*) FILTER (slack <= 0.05e0 AND h.idx IS NULL) AS num_critical_nodes, count(*) AS num_nodes FROM slacks s LEFT JOIN held h ON h.circuit_id = s.circuit_id AND h.idx = s.idx WHERE factor = 0.95e0 GROUP BY s.circuit_id"),
    "bench_statements": sql("SELECT circuit_id, count(*) FILTER (role = 'PI') AS inputs, count(*) FILTER (role = 'PO') AS outputs, count(*) FILTER (role = 'GATE') AS gates, sum(k) FILTER (role = 'GATE')::BIGINT AS pins FROM nodes LEFT JOIN (SELECT circuit_id, snk AS idx, count(*) AS k FROM edges GROUP BY ALL) USING (circuit_id, idx) GROUP BY circuit_id"),
    "bench_nodes": parsed_sql("SELECT circuit_id, idx, role, node_type, side, x, y FROM nodes"),
    "bench_edges": parsed_sql("SELECT circuit_id, drv, snk FROM edges"),
    "bench_nets": parsed_sql("SELECT circuit_id, drv, wire_length_um, fanout FROM nets"),
    "bench_sta": parsed_sql("SELECT circuit_id, round(max(clock), 13) AS clock_period_ns, round(max(max_at), 13) AS max_arrival_time_ns, min(slack) AS min_slack_ns, count(*) FILTER (slack <= 0.05e0) AS num_critical_nodes, count(*) AS num_nodes FROM slacks WHERE factor = 1.2e0 GROUP BY circuit_id"),
    "bench_cones": parsed_sql("SELECT circuit_id, seed, nodes, edges FROM (SELECT circuit_id, seed, count(*) AS nodes FROM cones GROUP BY ALL HAVING count(*) >= 8) JOIN (SELECT e.circuit_id, a.seed, count(*) AS edges FROM edges e JOIN cones a ON a.circuit_id = e.circuit_id AND a.idx = e.drv JOIN cones b ON b.circuit_id = e.circuit_id AND b.idx = e.snk AND b.seed = a.seed GROUP BY ALL) USING (circuit_id, seed)", _CONES),
    "generated_edges": "WITH g AS (SELECT n_nationkey::BIGINT AS seed, 18 + n_nationkey % 5 AS n FROM nation), r AS (SELECT seed, n, unnest(range(0, n)) AS idx FROM g) SELECT DISTINCT seed AS circuit_id, idx - 1 - (seed * 13 + idx * 5 + p * 3) % least(idx, 6) AS drv, idx AS snk FROM (SELECT *, unnest(range(0, (seed + idx) % 3 + 1)) AS p FROM r WHERE idx >= 4 AND idx < n - 2) UNION SELECT seed, idx - 2 - seed % 2, idx FROM r WHERE idx >= n - 2",
    "cyclic_levels": sql(
        "SELECT n.circuit_id, count(held.idx) AS unplaced FROM nodes n LEFT JOIN held USING (circuit_id, idx) GROUP BY n.circuit_id",
        "looped AS (SELECT circuit_id, drv, snk FROM edges UNION ALL SELECT circuit_id, idx, 4 FROM nodes WHERE idx = n - 3 AND circuit_id % 2 = 0), before AS (SELECT circuit_id, idx FROM nodes WHERE idx = n - 3 AND circuit_id % 2 = 0 UNION SELECT b.circuit_id, e.drv FROM before b JOIN edges e ON e.circuit_id = b.circuit_id AND e.snk = b.idx), held AS (SELECT circuit_id, idx FROM before WHERE idx = 4 UNION SELECT h.circuit_id, l.snk FROM held h JOIN looped l ON l.circuit_id = h.circuit_id AND l.drv = h.idx)",
    ),
}
