"""Cones as circuits, dense numbers, generated circuits with nets, and stored indexes, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.library import CELLS_SQL, CRITICAL_NS, DEVICES_SQL, sql_values
from ..operators import analog_nets, attention, cones, features, fitting, generate, numbering, timing
from ..operators.index import CELLS, TextStore, VectorIndex
from ..operators.netlist import Netlist, placed
from ..sources.tables import checkpointed, new_folder, table
from . import text_queries as text
from .netlist_queries import _labels, netlist, timed
from .netlist_sql import CTES, sql
from .network_queries import EDGE_FEATURES, FEATURES, TASKS, _dot, _weights, fitted

CLOCK, INPUTS, OUTPUTS = 0.95, 4, 2


def _cones(spark, sf_dir, of: DataFrame | None = None) -> tuple[Netlist, Netlist]:
    """The derived netlists and their cones as circuits, placed anew; with `of` (circuit_id), the cones of these circuits."""
    n = netlist(spark, sf_dir)
    nodes, edges = cones.cone_circuits(*(x if of is None else x.join(of, "circuit_id", "left_semi") for x in (n.nodes, n.edges)))
    cut = Netlist(checkpointed(placed(nodes)), checkpointed(edges))
    cut.members = nodes
    return n, cut


def _cone_slacks(cut: Netlist) -> DataFrame:
    cut.arcs = checkpointed(cut.arcs)
    return timing.slack(checkpointed(timing.propagate(cut.nodes, cut.arcs)), cut.nodes, (CLOCK,))


def cone_nodes(spark, sf_dir) -> DataFrame:
    nodes = cones.cone_circuits(*(lambda n: (n.nodes, n.edges))(netlist(spark, sf_dir)))[0]
    return nodes


def cone_edges(spark, sf_dir):
    return _cones(spark, sf_dir)[1].edges


def cone_sta(spark, sf_dir):
    """Timing of every cone at 0.95 of its own latest arrival."""
    return timing.summary(_cone_slacks(_cones(spark, sf_dir)[1])).drop("factor")


def cone_slacks(spark, sf_dir):
    return _cone_slacks(_cones(spark, sf_dir)[1]).select("circuit_id", "idx", F.round("at", 13).alias("arrival_time"), "required", "slack", "is_critical")


def cone_clocks(spark, sf_dir):
    """Every cone under three sampled clocks: what a training set of cones by clocks is labelled with."""
    cut = _cones(spark, sf_dir)[1]
    cut.arcs = checkpointed(cut.arcs)
    s = timing.sampled_clocks(checkpointed(timing.propagate(cut.nodes, cut.arcs)), cut.nodes)
    return s.groupBy("circuit_id", "clock_no").agg(F.round(F.max("clock"), 13).alias("clock"), F.min("slack").alias("min_slack"), F.sum(F.col("is_critical").cast("long")).alias("n_critical"))


def named_metrics(spark, sf_dir):
    """How well the timing of a node in its whole circuit tells its timing in the cones, pooled for each circuit."""
    n, t = timed(spark, sf_dir)
    whole = timing.slack(t, n.nodes, (CLOCK,)).select(F.col("circuit_id").alias("parent"), F.col("idx").alias("parent_idx"), F.round("at", 13).alias("pred_at"), F.col("slack").alias("pred_slack"))
    cut = _cones(spark, sf_dir)[1]
    rows = _cone_slacks(cut).select("circuit_id", "idx", F.round("at", 13).alias("at"), "slack", "is_critical").join(cut.members.select("circuit_id", "idx", "parent", "parent_idx"), ["circuit_id", "idx"])
    rows = checkpointed(rows.join(whole, ["parent", "parent_idx"]).withColumn("score", F.round(1.0 / (1.0 + F.exp(10.0 * (F.col("pred_slack") - CRITICAL_NS))), 9)))
    return cones.named_metrics(rows, "parent", {"slack": ("pred_slack", "slack"), "arrival_time": ("pred_at", "at")}, {"critical_path": ("score", "is_critical")})


def named_evaluation(spark, sf_dir):
    """The trained network on the cones of held-out circuits, pooled for each circuit."""
    model, _, nodes, _ = fitted(spark, sf_dir, epochs=25)
    held = checkpointed(nodes.where("split = 'test'").select("circuit_id").distinct())
    _, cut = _cones(spark, sf_dir, held)
    s = checkpointed(_cone_slacks(cut))
    rows = features.node_features(cut.nodes, s).join(features.labels(s, _labels(cut)), ["circuit_id", "idx"]).join(s.select("circuit_id", "idx", "clock"), ["circuit_id", "idx"])
    rows = checkpointed(rows)
    graphs = fitting.graphs(rows, features.edge_features(cut.arcs), FEATURES, EDGE_FEATURES, TASKS, most=None)  # cones of any size are judged
    both = checkpointed(model.predict(graphs).join(rows, ["circuit_id", "idx"]).join(cut.members.select("circuit_id", "idx", "parent"), ["circuit_id", "idx"]))
    both = both.withColumn("score", F.round("pred_critical", 9))
    return cones.named_metrics(both, "parent", {t: (f"pred_{t}", t) for t in ("slack", "arrival_time", "required_time")}, {"critical_path": ("score", "critical")})


def event_numbers(spark, sf_dir):
    """Dense numbers of all events in time order, and how many users' numbers lie before each in sum."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return numbering.running(e, ["ts", "event_id"], {"number": "1", "users_before": "user_id"}).select("event_id", "number", "users_before")


def _seeds(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("seed"))


def mixed_dataset(spark, sf_dir):
    """Digital and analog circuits one after another, with graph numbers and node offsets."""
    size = lambda df: df.groupBy("circuit_id").agg(F.count("*").alias("nodes"))
    return numbering.mixed_dataset({"digital": size(netlist(spark, sf_dir).nodes), "analog": size(analog_nets.analog_circuits(_seeds(spark, sf_dir))[0])})


def analog_devices(spark, sf_dir):
    nodes = analog_nets.analog_circuits(_seeds(spark, sf_dir))[0].where("role = 'GATE'")
    return nodes.select("circuit_id", "topology", "idx", "name", "device", F.round(F.col("w") * 1e6, 9).alias("w_um"), "symmetry", "x", "y")


def analog_net_features(spark, sf_dir):
    """Edges of all analog nets with their features; coupling and matching come from the devices at both ends."""
    return analog_nets.analog_edges(*analog_nets.analog_circuits(_seeds(spark, sf_dir)))


def analog_graph_nodes(spark, sf_dir):
    """Node features of analog circuits with nets."""
    nodes = analog_nets.analog_circuits(_seeds(spark, sf_dir))[0]
    return features.analog_node_features(nodes.where("role <> 'none'"), 1.0)


# Two layers of two heads on four node and five edge dimensions, the last of them the matching.
_WIDE, _HEADS = 4, 2
_LAYERS = [{"l": _weights(_WIDE, 4, k), "r": _weights(_WIDE, 4, k + 1), "e": _weights(_WIDE, 5, k + 2), "a": _weights(_HEADS, _WIDE // _HEADS, k + 3), "symmetry": np.array([0.75, -0.5])} for k in (0, 2)]


def analog_attention(spark, sf_dir):
    """Attention over the nets of analog circuits, with a bias for matched devices."""
    nodes = analog_graph_nodes(spark, sf_dir).select("circuit_id", "idx", F.array("wl_f", "region_f", "symmetry_f", "is_pi").alias("v"))
    edges = analog_net_features(spark, sf_dir).select("circuit_id", "drv", "snk", F.array("wire_f", "manhattan_f", "fanout_f", "coupling_f", "matching_f").alias("e"))
    found = attention.attention_stack(checkpointed(nodes), checkpointed(edges), _LAYERS, _HEADS, matching=4)
    return found.select("circuit_id", "idx", *((F.round(F.col("v")[k], 6) + 0.0).alias(f"v{k}") for k in range(_WIDE)))


def _sizes(spark, sf_dir) -> DataFrame:
    return _seeds(spark, sf_dir).select("seed", (4 + F.col("seed") % 5).alias("inputs"), (10 + F.col("seed") % 41).alias("gates"), (2 + F.col("seed") % 3).alias("outputs"))


def generated_summary(spark, sf_dir):
    """A random circuit for each supplier: its parts, what a cycle would hold up, and gates that have one driver twice."""
    nodes, edges = generate.random_digital(_sizes(spark, sf_dir))
    part = lambda r: F.sum((F.col("role") == r).cast("long"))
    parts = nodes.groupBy("circuit_id").agg(part("PI").alias("inputs"), part("GATE").alias("gates"), part("PO").alias("outputs"))
    held = timing.levels(nodes, edges).groupBy("circuit_id").agg(F.sum((F.col("level") < 0).cast("long")).alias("unplaced"))
    twice = edges.groupBy("circuit_id", "snk", "drv").agg(F.count("*").alias("n")).groupBy("circuit_id").agg(F.sum((F.col("n") > 1).cast("long")).alias("repeated"))
    return parts.join(held, "circuit_id").join(twice, "circuit_id")


def generated_sta(spark, sf_dir):
    """Timing of the random circuits."""
    nodes, edges = generate.random_digital(_sizes(spark, sf_dir))
    n = Netlist(checkpointed(placed(nodes)), checkpointed(edges.select("circuit_id", "drv", "snk").distinct()))
    return timing.summary(_cone_slacks(n)).drop("factor")


def _grown(spark, sf_dir) -> tuple[VectorIndex, DataFrame]:
    """An index of three quarters of the vectors, to which the others are added."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return VectorIndex.build(e.where("vec_id % 4 <> 0"), new_folder(spark), "1").add(e.where("vec_id % 4 = 0")), e


def index_exact_search(spark, sf_dir):
    """A grown index searched in all its cells: what a flat index finds."""
    index, e = _grown(spark, sf_dir)
    return index.search(e.where("vec_id % 20 = 0"), 5, CELLS)


def index_search(spark, sf_dir):
    """A grown index, compacted, searched in as many cells as its recall asks for."""
    index, e = _grown(spark, sf_dir)
    return index.compact().search(e.where("vec_id % 20 = 0"), 5)


def index_stats(spark, sf_dir):
    """Rows by segment."""
    return _grown(spark, sf_dir)[0].stats()


def index_replaced(spark, sf_dir):
    """What the index holds after a third of its rows came in again with another vector: greatest and least component."""
    index, e = _grown(spark, sf_dir)
    index = index.add(e.where("vec_id % 3 = 0").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding")))
    return index.rows().select("vec_id", F.round(F.array_max("embedding"), 6).alias("top"), F.round(F.array_min("embedding"), 6).alias("low"), F.col("number").cast("long").alias("segment"))


def _store(spark, sf_dir) -> TextStore:
    """English documents, to which those of the other languages are added."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", "lang")
    return TextStore(spark, new_folder(spark)).add(d.where("lang = 'en'")).add(d.where("lang <> 'en' OR lang IS NULL"))


def text_store_keywords(spark, sf_dir):
    """Shared tokens of each benchmark item with a store that grew."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = _store(spark, sf_dir).search(q, 3, "keyword")
    return found.select(F.col("query_id").alias("item_id"), F.col("key").alias("doc_id"), F.col("score").cast("long").alias("score"), "rank")


def text_store_vectors(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _store(spark, sf_dir).search(q, 3)


QUERIES = {f.__name__: f for f in (cone_nodes, cone_edges, cone_sta, cone_slacks, cone_clocks, named_metrics, named_evaluation, event_numbers, mixed_dataset, analog_devices, analog_net_features, analog_graph_nodes, analog_attention, generated_summary, generated_sta, index_exact_search, index_search, index_stats, index_replaced, text_store_keywords, text_store_vectors)}


def cone_sql(select: str, more: str = "") -> str:
    """As sql(), over the cones as circuits; nodes0, edges0 are those they were cut out of, member says where each node was."""
    head, tail = CTES.split("\npins AS", 1)
    head = head.replace("nodes AS (", "nodes0 AS (").replace("edges AS (", "edges0 AS (").replace("FROM nodes, range", "FROM nodes0, range").replace("FROM nodes WHERE", "FROM nodes0 WHERE")
    cut = f"""cones AS (SELECT circuit_id, idx AS seed, idx FROM nodes0 WHERE role = 'PO' UNION SELECT c.circuit_id, c.seed, e.drv FROM cones c JOIN edges0 e ON e.circuit_id = c.circuit_id AND e.snk = c.idx),
sized AS (SELECT c.circuit_id, c.seed FROM cones c JOIN nodes0 n ON n.circuit_id = c.circuit_id AND n.idx = c.idx GROUP BY ALL HAVING count(*) >= 8 AND count(*) FILTER (n.role = 'PI') > 0),
kept AS (SELECT circuit_id AS parent, seed, row_number() OVER (ORDER BY circuit_id, seed) - 1 AS circuit_id FROM (SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY (seed * 7919) % 1009, seed) AS r FROM sized) WHERE r <= 40),
roled AS (SELECT k.circuit_id, k.parent, k.seed, c.idx AS parent_idx, CASE WHEN c.idx = k.seed THEN 'PO' WHEN n.role = 'PI' THEN 'PI' ELSE 'GATE' END AS role, CASE WHEN c.idx = k.seed THEN 'PO' ELSE n.node_type END AS node_type FROM kept k JOIN cones c ON c.circuit_id = k.parent AND c.seed = k.seed JOIN nodes0 n ON n.circuit_id = c.circuit_id AND n.idx = c.idx),
member AS (SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY CASE role WHEN 'PI' THEN 0 WHEN 'GATE' THEN 1 ELSE 2 END, parent_idx) - 1 AS idx, count(*) OVER w AS n, count(*) FILTER (role = 'PI') OVER w AS n_in, greatest(6, floor(sqrt((count(*) OVER w)::DOUBLE) * 1.6e0))::BIGINT AS side FROM roled WINDOW w AS (PARTITION BY circuit_id)),
nodes AS (SELECT b.circuit_id, b.idx, b.n, b.role, b.node_type, b.side, CASE b.role WHEN 'PI' THEN 0 WHEN 'PO' THEN b.side - 1 ELSE 1 + ((b.idx * 7919) % ((b.side - 2) * b.side)) // b.side END::BIGINT AS x,
  CASE b.role WHEN 'PI' THEN b.idx * b.side // b.n_in WHEN 'PO' THEN (b.idx - b.n + 1) * b.side ELSE ((b.idx * 7919) % ((b.side - 2) * b.side)) % b.side END::BIGINT AS y,
  c.intrinsic_delay, c.input_cap, c.output_res, c.num_inputs FROM member b LEFT JOIN {CELLS_SQL} c ON c.cell = b.node_type),
edges AS (SELECT a.circuit_id, a.idx AS drv, b.idx AS snk FROM edges0 e JOIN member a ON a.parent = e.circuit_id AND a.parent_idx = e.drv JOIN member b ON b.circuit_id = a.circuit_id AND b.parent_idx = e.snk)"""
    return f"WITH RECURSIVE {head}\n{cut},\npins AS{tail}{', ' + more if more else ''} {select}"


# The derived netlists' own timing beside the cones': the same tables under other names.
_WHOLE = sql("SELECT circuit_id AS parent, idx AS parent_idx, round(arrival, 13) AS pred_at, slack AS pred_slack FROM slacks WHERE factor = 0.95e0")
_R2 = "CASE WHEN round(sum({t} * {t}) - sum({t}) * sum({t}) / count(*), 9) > 0 THEN round(1e0 - sum(({p} - {t}) * ({p} - {t})) / (sum({t} * {t}) - sum({t}) * sum({t}) / count(*)), 6) END"
_NUMBER = "SELECT parent, '{name}' AS task, count(*) AS n, " + _R2 + " AS r2, round(avg(abs({p} - {t})), 6) AS mae, NULL::DOUBLE AS auc, NULL::DOUBLE AS f1 FROM judged GROUP BY parent"
_JUDGED = f"""judged AS MATERIALIZED (SELECT m.parent, pred_at, pred_slack, round(s.arrival, 13) AS at_, s.slack, (s.slack <= 0.05e0)::INT AS y, round(1e0 / (1e0 + exp(10e0 * (pred_slack - 0.05e0))), 9) AS score
  FROM slacks s JOIN member m ON m.circuit_id = s.circuit_id AND m.idx = s.idx JOIN ({_WHOLE}) w ON w.parent = m.parent AND w.parent_idx = m.parent_idx WHERE s.factor = 0.95e0),
each AS (SELECT parent, score, sum(y) AS p, sum(1 - y) AS q FROM judged GROUP BY ALL), areas AS (SELECT parent, sum(p * (under + q / 2e0)) AS area, sum(p) AS ps, sum(q) AS qs FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY parent ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM each) GROUP BY parent),
cells AS (SELECT parent, count(*) AS n, count(*) FILTER (score >= 0.5e0 AND y = 1) AS tp, count(*) FILTER (score >= 0.5e0 AND y = 0) AS fp, count(*) FILTER (score < 0.5e0 AND y = 1) AS fn FROM judged GROUP BY parent)"""
_NODES, _PINS = sql_values(analog_nets.node_rows()), sql_values([(t, net, idx, bool(d), k) for t, net, idx, d, k in analog_nets.pin_rows()])
_PICKED = "CASE s_suppkey % 5 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(analog_nets.TOPOLOGIES)) + " END"
_ANALOG = f"""own AS (SELECT s_suppkey::BIGINT AS circuit_id, {_PICKED} AS topology FROM supplier),
anodes AS (SELECT o.circuit_id, o.topology, v.idx::BIGINT AS idx, v.name, v.role, v.device, v.x::BIGINT AS x, v.y::BIGINT AS y, v.w * (1e0 + ((o.circuit_id * 7919 + CASE WHEN v.symmetry > 0 THEN v.symmetry ELSE 10 + v.idx END * 104729) % 2001 / 1000e0 - 1e0) * 0.2e0) AS w, v.l, v.symmetry::BIGINT AS symmetry, d.cgd, d.input_cap, d.region
  FROM own o JOIN (VALUES {_NODES}) AS v(topology, idx, name, role, device, x, y, w, l, symmetry) USING (topology) LEFT JOIN {DEVICES_SQL} d USING (device)),
apins AS (SELECT o.circuit_id, v.net::BIGINT AS net, v.idx::BIGINT AS idx, v.is_driver FROM own o JOIN (VALUES {_PINS}) AS v(topology, net, idx, is_driver, place) USING (topology)),
aedges AS (SELECT a.circuit_id, a.net, a.idx AS drv, b.idx AS snk, count(*) OVER (PARTITION BY a.circuit_id, a.net) AS fanout FROM apins a JOIN apins b ON a.circuit_id = b.circuit_id AND a.net = b.net AND a.is_driver AND NOT b.is_driver)"""
_WIRE = "0.12e0 * 5e0 * (0.00017e0 * 5e0 / 2e0 + coalesce(s.input_cap, 2e-15) * 1e15) * 1e-3"

ORACLE_SQL = {
    "cone_nodes": cone_sql("SELECT circuit_id, idx, role, node_type, parent, seed, parent_idx FROM member"),
    "cone_edges": cone_sql("SELECT circuit_id, drv, snk FROM edges"),
    "cone_sta": cone_sql("SELECT circuit_id, round(max(clock), 13) AS clock_period_ns, round(max(max_at), 13) AS max_arrival_time_ns, min(slack) AS min_slack_ns, count(*) FILTER (slack <= 0.05e0) AS num_critical_nodes, count(*) AS num_nodes FROM slacks WHERE factor = 0.95e0 GROUP BY circuit_id"),
    "cone_slacks": cone_sql("SELECT circuit_id, idx, round(arrival, 13) AS arrival_time, required, slack, slack <= 0.05e0 AS is_critical FROM slacks WHERE factor = 0.95e0"),
    "cone_clocks": cone_sql("SELECT circuit_id, k AS clock_no, round(max(clock), 13) AS clock, min(slack) AS min_slack, count(*) FILTER (slack <= 0.05e0) AS n_critical FROM (SELECT *, round(clock - suffix - arrival, 13) AS slack FROM (SELECT t.*, k, greatest(max_at * (0.7e0 + 0.6e0 * (((t.circuit_id * 7919 + k * 104729) % 601) / 600e0)), 1e-3) AS clock FROM timing t JOIN clocks USING (circuit_id), range(0, 3) AS r(k))) GROUP BY circuit_id, k"),
    "named_metrics": cone_sql(
        _NUMBER.format(name="slack", p="pred_slack", t="slack") + " UNION ALL " + _NUMBER.format(name="arrival_time", p="pred_at", t="at_")
        + " UNION ALL SELECT c.parent, 'critical_path', c.n, NULL::DOUBLE, NULL::DOUBLE, CASE WHEN ps > 0 AND qs > 0 THEN round(area / (ps * qs), 9) END, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END FROM cells c JOIN areas USING (parent)",
        _JUDGED,
    ),
    "event_numbers": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS number, CAST(coalesce(sum(user_id) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS users_before FROM events",
    "mixed_dataset": sql(
        "SELECT row_number() OVER o - 1 AS graph, kind, circuit_id, nodes, CAST(sum(nodes) OVER o - nodes AS BIGINT) AS first_node FROM (SELECT 0 AS at_, 'digital' AS kind, circuit_id, count(*) AS nodes FROM nodes GROUP BY circuit_id UNION ALL SELECT 1, 'analog', circuit_id, count(*) FROM anodes GROUP BY circuit_id) WINDOW o AS (ORDER BY at_, circuit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        _ANALOG,
    ),
    "analog_devices": f"WITH {_ANALOG} SELECT circuit_id, topology, idx, name, device, round(w * 1e6, 9) AS w_um, symmetry, x, y FROM anodes WHERE role = 'GATE'",
    "analog_net_features": f"WITH {_ANALOG} SELECT e.circuit_id, net, drv, snk, round({_WIRE} / 0.1e0, 9) AS wire_f, round((abs(d.x - s.x) + abs(d.y - s.y)) / 30e0, 9) AS manhattan_f, round(fanout / 10e0, 9) AS fanout_f, round(coalesce(d.cgd / 1e-15, 0e0), 9) AS coupling_f, (d.symmetry > 0 AND d.symmetry = s.symmetry)::INT::DOUBLE AS matching_f FROM aedges e JOIN anodes d ON d.circuit_id = e.circuit_id AND d.idx = e.drv JOIN anodes s ON s.circuit_id = e.circuit_id AND s.idx = e.snk",
    "analog_graph_nodes": f"WITH {_ANALOG} SELECT circuit_id, idx, (role = 'PI')::INT::DOUBLE AS is_pi, (role = 'PO')::INT::DOUBLE AS is_po, " + ", ".join(f"coalesce(device = '{d}', false)::INT::DOUBLE AS is_{d.lower()}" for d in ("NMOS", "PMOS", "R", "C", "CURRENT_MIRROR", "DIFF_PAIR")) + ", coalesce(round(CASE WHEN device IS NOT NULL THEN coalesce(w / greatest(l, 1e-12), 0e0) END / coalesce(max(w / greatest(l, 1e-12)) OVER c, 1e0), 9), 0e0) AS wl_f, coalesce(region, 0e0) AS region_f, CASE WHEN device IS NULL THEN 0e0 ELSE round(symmetry / greatest(max(symmetry) OVER c, 1)::DOUBLE, 9) END AS symmetry_f, 0e0 AS is_digital, 1e0 AS is_analog, 0e0 AS delay_f, 0e0 AS cap_f, 0e0 AS res_f, 0.5e0 AS clock_f FROM anodes WINDOW c AS (PARTITION BY circuit_id)",
    "generated_summary": "SELECT s_suppkey::BIGINT AS circuit_id, (4 + s_suppkey % 5)::BIGINT AS inputs, (10 + s_suppkey % 41)::BIGINT AS gates, (2 + s_suppkey % 3)::BIGINT AS outputs, 0::BIGINT AS unplaced, 0::BIGINT AS repeated FROM supplier",
    "index_exact_search": text.ORACLE_SQL["cosine_topk"],
    "index_stats": "SELECT 1::BIGINT AS segment, count(*) AS rows FROM embeddings WHERE vec_id % 4 <> 0 UNION ALL SELECT 2, count(*) FROM embeddings WHERE vec_id % 4 = 0",
    "index_replaced": "SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN -list_min(embedding)::DOUBLE ELSE list_max(embedding)::DOUBLE END, 6) AS top, round(CASE WHEN vec_id % 3 = 0 THEN -list_max(embedding)::DOUBLE ELSE list_min(embedding)::DOUBLE END, 6) AS low, CASE WHEN vec_id % 3 = 0 THEN 3 WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS segment FROM embeddings",
    "text_store_keywords": text.ORACLE_SQL["keyword_topk"],
}


def _attention_layer(k: int, of: str) -> str:
    """Tables that end with n<k>: one layer over the vectors v0.. of `of` and the edges aefs."""
    w, d, src, dst = _LAYERS[k], _WIDE // _HEADS, [f"s.v{j}" for j in range(4)], [f"t.v{j}" for j in range(4)]
    e = ["wire_f", "manhattan_f", "fanout_f", "coupling_f", "matching_f"]
    sent = ", ".join(f"{_dot(w['l'][j], src)} AS l{j}, {_dot(w['r'][j], dst)} + {_dot(w['e'][j], e)} AS r{j}" for j in range(_WIDE))
    leaky = lambda j: f"w_[{j + 1}] * (CASE WHEN l{j} + r{j} > 0 THEN l{j} + r{j} ELSE 0.2e0 * (l{j} + r{j}) END)"
    flat = "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in w["a"].ravel()) + "]"
    scores = ", ".join("(" + " + ".join(leaky(j) for j in range(h * d, (h + 1) * d)) + f") + {float(w['symmetry'][h])!r}::DOUBLE * matching_f AS s{h}" for h in range(_HEADS))
    out = ", ".join(f"sum(exp(s{j // d} - m{j // d}) * l{j}) / sum(exp(s{j // d} - m{j // d})) AS o{j}" for j in range(_WIDE))
    tops = ", ".join(f"max(s{h}) OVER c AS m{h}" for h in range(_HEADS))
    norm = lambda j: f"((coalesce(o{j}, 0e0) - avg(coalesce(o{j}, 0e0)) OVER ()) / sqrt(var_pop(coalesce(o{j}, 0e0)) OVER () + 1e-5))"
    last = ", ".join(f"CASE WHEN z{j} > 0 THEN z{j} ELSE exp(z{j}) - 1e0 END" + (f" + v{j}" if k else "") + f" AS v{j}" for j in range(_WIDE))
    return (
        f"e{k} AS (SELECT a.circuit_id, a.snk AS idx, matching_f, {sent}, {flat} AS w_ FROM aefs a JOIN {of} s ON s.circuit_id = a.circuit_id AND s.idx = a.drv JOIN {of} t ON t.circuit_id = a.circuit_id AND t.idx = a.snk), "
        f"p{k} AS (SELECT *, {tops} FROM (SELECT *, {scores} FROM e{k}) WINDOW c AS (PARTITION BY circuit_id, idx)), o{k} AS (SELECT circuit_id, idx, {out} FROM p{k} GROUP BY circuit_id, idx), "
        f"z{k} AS (SELECT x.circuit_id, x.idx, " + ", ".join(f"x.v{j}, {norm(j)} AS z{j}" for j in range(_WIDE)) + f" FROM {of} x LEFT JOIN o{k} o ON o.circuit_id = x.circuit_id AND o.idx = x.idx), n{k} AS (SELECT circuit_id, idx, {last} FROM z{k})"
    )


ORACLE_SQL["analog_attention"] = (
    f"WITH aefs AS ({ORACLE_SQL['analog_net_features']}), start AS (SELECT circuit_id, idx, wl_f AS v0, region_f AS v1, symmetry_f AS v2, is_pi AS v3 FROM ({ORACLE_SQL['analog_graph_nodes']})), "
    + _attention_layer(0, "start") + ", " + _attention_layer(1, "n0") + " SELECT circuit_id, idx, " + ", ".join(f"round(v{j}, 6) + 0e0 AS v{j}" for j in range(_WIDE)) + " FROM n1"
)
