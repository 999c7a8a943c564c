"""Netlist, timing and congestion queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import congestion, timing
from ..operators.netlist import Netlist, nodes_from_events
from ..sources.tables import checkpointed, table, tasks_for
from .netlist_sql import sql

FACTORS = (1.2, 0.95)


def netlist(spark: SparkSession, sf_dir: str) -> Netlist:
    """The derived netlist; its nodes are written once, since every other table reads them."""
    nodes = checkpointed(nodes_from_events(table(spark, sf_dir, "events")))
    return Netlist(nodes, tasks=tasks_for(nodes))


def timed(spark, sf_dir):
    n = netlist(spark, sf_dir)
    n.arcs = checkpointed(n.arcs)
    return n, checkpointed(timing.propagate(n.nodes, n.arcs))


def slacks(spark, sf_dir, factors=FACTORS):
    n, t = timed(spark, sf_dir)
    return n, timing.slack(t, n.nodes, factors)


def netlist_nodes(spark, sf_dir) -> DataFrame:
    return netlist(spark, sf_dir).nodes.select("circuit_id", "idx", "role", "node_type", "side", "x", "y")


def netlist_edges(spark, sf_dir):
    return netlist(spark, sf_dir).edges.select("circuit_id", "drv", "snk")


def netlist_nets(spark, sf_dir):
    return netlist(spark, sf_dir).nets.select("circuit_id", "drv", "wire_length_um", "fanout")


def placement_wirelength(spark, sf_dir):
    nets = netlist(spark, sf_dir).nets
    return nets.groupBy("circuit_id").agg(F.count("*").alias("nets"), F.sum("wire_length_um").alias("total_um"), F.max("wire_length_um").alias("longest_um"), F.max("fanout").alias("largest_fanout"))


def load_capacitance(spark, sf_dir):
    return netlist(spark, sf_dir).loads.select("circuit_id", "idx", F.round("load_cap", 13).alias("load_cap"))


def gate_delay(spark, sf_dir):
    return netlist(spark, sf_dir).loads.select("circuit_id", "idx", F.round("gate_delay", 13).alias("gate_delay"))


def wire_delay(spark, sf_dir):
    return netlist(spark, sf_dir).arcs.select("circuit_id", "drv", "snk", F.round("wire_delay", 13).alias("wire_delay"), F.round("fwd", 13).alias("fwd"), F.round("bwd", 13).alias("bwd"))


def sta_arrival(spark, sf_dir):
    return timed(spark, sf_dir)[1].select("circuit_id", "idx", F.round("at", 13).alias("arrival_time"))


def logical_depth(spark, sf_dir):
    return timed(spark, sf_dir)[1].select("circuit_id", "idx", "depth")


def sta_required(spark, sf_dir):
    return slacks(spark, sf_dir, (1.2,))[1].select("circuit_id", "idx", F.col("required").alias("required_time"))


def sta_slack(spark, sf_dir):
    return slacks(spark, sf_dir)[1].select("circuit_id", "factor", "idx", "slack")


def sta_critical(spark, sf_dir):
    return slacks(spark, sf_dir)[1].where("is_critical").select("circuit_id", "factor", "idx", "slack")


def sta_summary(spark, sf_dir):
    return timing.summary(slacks(spark, sf_dir, (1.2,))[1]).drop("factor")


def sta_multi_clock(spark, sf_dir):
    return timing.summary(slacks(spark, sf_dir)[1])


def timing_endpoints_worst(spark, sf_dir):
    n, s = slacks(spark, sf_dir, (0.95,))
    return timing.worst_endpoints(s, n.nodes)


def critical_path_trace(spark, sf_dir):
    n, t = timed(spark, sf_dir)
    return timing.critical_path(t, n.arcs, timing.worst_endpoints(timing.slack(t, n.nodes, (0.95,)), n.nodes))


def _seeds(n: Netlist) -> DataFrame:
    return n.nodes.where("role = 'PO'").select("circuit_id", "idx")


def fanin_cone(spark, sf_dir):
    n = netlist(spark, sf_dir)
    return timing.fanin_cones(n.edges, _seeds(n))


def fanin_cone_sizes(spark, sf_dir):
    n = netlist(spark, sf_dir)
    return timing.cone_windows(n.edges, _seeds(n))


def cone_subnetlist(spark, sf_dir):
    """Edges inside the kept cones: both ends in the cone."""
    n = netlist(spark, sf_dir)
    cones = timing.fanin_cones(n.edges, _seeds(n))
    inside = n.edges.join(cones.withColumnRenamed("idx", "drv"), ["circuit_id", "drv"]).join(cones.withColumnRenamed("idx", "snk"), ["circuit_id", "seed", "snk"], "left_semi")
    return inside.groupBy("circuit_id", "seed").agg(F.count("*").alias("edges"), F.countDistinct("drv").alias("nets"))


def topo_levels(spark, sf_dir):
    n = netlist(spark, sf_dir)
    return timing.levels(n.nodes, n.edges)


def cycle_check(spark, sf_dir):
    n = netlist(spark, sf_dir)
    return timing.levels(n.nodes, n.edges).groupBy("circuit_id").agg(F.sum((F.col("level") < 0).cast("long")).alias("unplaced"), F.max("level").alias("deepest"))


def rudy_grid(spark, sf_dir):
    return congestion.demand_grid(netlist(spark, sf_dir).nets)


def _labels(n):
    return congestion.node_labels(n.nodes, congestion.demand_grid(n.nets))


def rudy_node_congestion(spark, sf_dir):
    return _labels(netlist(spark, sf_dir)).select("circuit_id", "idx", "demand", "congestion")


def drc_hotspots(spark, sf_dir):
    return _labels(netlist(spark, sf_dir)).where("drc = 1").select("circuit_id", "idx", "demand")


def predecessors(spark, sf_dir):
    return netlist(spark, sf_dir).edges.groupBy("circuit_id", F.col("snk").alias("idx")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("drv")), lambda x: x.cast("string")), ",").alias("drivers"))


QUERIES = {f.__name__: f for f in (netlist_nodes, netlist_edges, netlist_nets, placement_wirelength, load_capacitance, gate_delay, wire_delay, sta_arrival, logical_depth, sta_required, sta_slack, sta_critical, sta_summary, sta_multi_clock, timing_endpoints_worst, critical_path_trace, fanin_cone, fanin_cone_sizes, cone_subnetlist, topo_levels, cycle_check, rudy_grid, rudy_node_congestion, drc_hotspots, predecessors)}

_SUMMARY = "round(max(clock), 13) AS clock_period_ns, round(max(max_at), 13) AS max_arrival_time_ns, min(slack) AS min_slack_ns, count(*) FILTER (slack <= 0.05e0) AS num_critical_nodes, count(*) AS num_nodes FROM slacks"
_WORST = "worst AS (SELECT circuit_id, arg_min(idx, (slack, idx)) AS idx, min(slack) AS slack FROM slacks WHERE factor = 0.95e0 AND role = 'PO' GROUP BY circuit_id)"
_CONE = "cones AS (SELECT circuit_id, idx AS seed, idx FROM nodes WHERE role = 'PO' UNION SELECT c.circuit_id, c.seed, e.drv FROM cones c JOIN edges e ON e.circuit_id = c.circuit_id AND e.snk = c.idx)"
ORACLE_SQL = {
    "netlist_nodes": sql("SELECT circuit_id, idx, role, node_type, side, x, y FROM nodes"),
    "netlist_edges": sql("SELECT circuit_id, drv, snk FROM edges"),
    "netlist_nets": sql("SELECT circuit_id, drv, wire_length_um, fanout FROM nets"),
    "placement_wirelength": sql("SELECT circuit_id, count(*) AS nets, sum(wire_length_um) AS total_um, max(wire_length_um) AS longest_um, max(fanout) AS largest_fanout FROM nets GROUP BY circuit_id"),
    "load_capacitance": sql("SELECT circuit_id, idx, round(load_cap, 13) AS load_cap FROM loads"),
    "gate_delay": sql("SELECT circuit_id, idx, round(gate_delay, 13) AS gate_delay FROM loads"),
    "wire_delay": sql("SELECT circuit_id, drv, snk, round(wire_delay, 13) AS wire_delay, round(fwd, 13) AS fwd, round(bwd, 13) AS bwd FROM arcs"),
    "sta_arrival": sql("SELECT circuit_id, idx, round(arrival, 13) AS arrival_time FROM timing"),
    "logical_depth": sql("SELECT circuit_id, idx, depth FROM timing"),
    "sta_required": sql("SELECT circuit_id, idx, required AS required_time FROM slacks WHERE factor = 1.2e0"),
    "sta_slack": sql("SELECT circuit_id, factor, idx, slack FROM slacks"),
    "sta_critical": sql("SELECT circuit_id, factor, idx, slack FROM slacks WHERE slack <= 0.05e0"),
    "sta_summary": sql(f"SELECT circuit_id, {_SUMMARY} WHERE factor = 1.2e0 GROUP BY circuit_id"),
    "sta_multi_clock": sql(f"SELECT circuit_id, factor, {_SUMMARY} GROUP BY circuit_id, factor"),
    "timing_endpoints_worst": sql("SELECT circuit_id, idx, slack FROM worst", _WORST),
    "critical_path_trace": sql(
        "SELECT circuit_id, step, idx FROM path",
        _WORST + ", late AS (SELECT a.circuit_id, a.snk, arg_max(a.drv, (round(t.arrival + a.fwd, 13), -a.drv)) AS drv FROM arcs a JOIN timing t ON t.circuit_id = a.circuit_id AND t.idx = a.drv GROUP BY a.circuit_id, a.snk), path AS (SELECT circuit_id, 0::BIGINT AS step, idx FROM worst UNION ALL SELECT p.circuit_id, p.step + 1, l.drv FROM path p JOIN late l ON l.circuit_id = p.circuit_id AND l.snk = p.idx)",
    ),
    "fanin_cone": sql("SELECT circuit_id, seed, idx FROM cones", _CONE),
    "fanin_cone_sizes": sql("SELECT circuit_id, seed, size, rank FROM (SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY (seed * 7919) % 1009, seed) AS rank FROM (SELECT circuit_id, seed, count(*) AS size FROM cones GROUP BY ALL) WHERE size >= 8) WHERE rank <= 40", _CONE),
    "cone_subnetlist": sql("SELECT e.circuit_id, a.seed, count(*) AS edges, count(DISTINCT e.drv) AS nets FROM edges e JOIN cones a ON a.circuit_id = e.circuit_id AND a.idx = e.drv JOIN cones b ON b.circuit_id = e.circuit_id AND b.idx = e.snk AND b.seed = a.seed GROUP BY e.circuit_id, a.seed", _CONE),
    "topo_levels": sql("SELECT circuit_id, idx, depth AS level FROM timing"),
    "cycle_check": sql("SELECT circuit_id, 0::BIGINT AS unplaced, max(depth) AS deepest FROM timing GROUP BY circuit_id"),
    "rudy_grid": sql("SELECT circuit_id, gx, gy, demand FROM grid"),
    "rudy_node_congestion": sql("SELECT circuit_id, idx, demand, congestion FROM labels_"),
    "drc_hotspots": sql("SELECT circuit_id, idx, demand FROM labels_ WHERE drc = 1"),
    "predecessors": sql("SELECT circuit_id, snk AS idx, string_agg(drv::VARCHAR, ',' ORDER BY drv) AS drivers FROM edges GROUP BY ALL"),
}
