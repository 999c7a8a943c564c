"""Layers with given weights, analog feature schema, all heads and circuits for requests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import library as lib
from ..operators import analog, features, heads, layers, messages, nlspec
from ..operators.netlist import edges_of, nodes_from_events
from ..sources.tables import checkpointed, table
from .feature_queries import _VECTORS, _vectors
from .netlist_queries import _labels, netlist, slacks
from .netlist_sql import sql

# Weights of the registered layers; fitted ones have the same shape.
EDGE = [[1.0, 0.25, -0.5], [0.5, 0.75, 0.125], [0.25, -0.125, 1.0]]
SEED = [[0.5, 0.25, 0.0], [0.0, 0.5, 0.25], [0.25, 0.0, 0.5]]
RAW = [[0.5, 0.0, 0.25], [0.0, 0.5, 0.0], [0.25, 0.25, 0.5], [0.5, -0.5, 0.0], [0.0, 0.5, -0.5], [-0.5, 0.0, 0.5]]
CONTEXT = [[0.25, 0.0, 0.0], [0.0, 0.25, 0.0], [0.0, 0.0, 0.25], [0.125, 0.0, 0.0], [0.0, 0.125, 0.0], [0.0, 0.0, 0.125]]
SIZE, SWEEPS = 3, 2
PHRASES = ["a two-stage amplifier", "Folded cascode stage", "a diff pair", "Current mirror for bias", "CS amplifier"]
MEANT = ["two_stage_opamp", "folded_cascode", "diff_pair", "current_mirror", "common_source_amp"]


def _edges(n) -> DataFrame:
    return n.wires.select("circuit_id", "drv", "snk", (F.col("wire_delay") / lib.WIRE_REF).alias("e0"), (F.col("manhattan") / lib.MANHATTAN_REF).alias("e1"), (F.col("fanout") / lib.FANOUT_REF).alias("e2"))


_term = messages.matrix_term(EDGE, ["e0", "e1", "e2"])


def _spread(df: DataFrame, size: int) -> DataFrame:
    return df.select("circuit_id", "idx", *(F.round(F.col("v")[k], 6).alias(f"v{k}") for k in range(size)))


def message_pass_weighted(spark, sf_dir) -> DataFrame:
    n = netlist(spark, sf_dir)
    return messages.aggregate_messages(_vectors(n), _edges(n), "max", term=_term)


def message_pass_softmin(spark, sf_dir):
    n = netlist(spark, sf_dir)
    return messages.aggregate_messages(_vectors(n), _edges(n), "softmin", sign=-1.0, beta=4.0, term=_term)


def relaxation_sweeps(spark, sf_dir):
    n = netlist(spark, sf_dir)
    return _spread(messages.relax_sweeps(_vectors(n), checkpointed(_edges(n)), SWEEPS, term=_term), SIZE)


def timing_embedding(spark, sf_dir):
    n = netlist(spark, sf_dir)
    return _spread(layers.timing_backbone(_vectors(n), checkpointed(_edges(n)), _term, SEED, RAW, CONTEXT, SWEEPS, SIZE), 2 * SIZE)


def graph_convolution(spark, sf_dir):
    n = netlist(spark, sf_dir)
    return _spread(layers.graph_convolution(_vectors(n), n.edges, EDGE, SIZE), SIZE)


def edge_sums(spark, sf_dir):
    n = netlist(spark, sf_dir)
    return _spread(layers.edge_sums(_vectors(n), _edges(n), _term, SIZE), SIZE)


def _devices(nodes: DataFrame) -> DataFrame:
    """Gates as devices in turn; transistors are in one of three symmetry groups."""
    rows = nodes.select("circuit_id", "idx", "role", "event_id", F.when(F.col("role") == "GATE", F.col("event_id") % 6).alias("dev_idx"))
    rows = rows.join(F.broadcast(lib.devices(nodes.sparkSession)), "dev_idx", "left")
    return rows.withColumn("symmetry", F.when(F.col("device").isin("NMOS", "PMOS"), 1 + F.floor(F.col("event_id") / 6) % 3).otherwise(0))


def analog_node_features(spark, sf_dir):
    return features.analog_node_features(_devices(netlist(spark, sf_dir).nodes), 1.0)


def analog_edge_features(spark, sf_dir):
    n = netlist(spark, sf_dir)
    return features.analog_edge_features(_devices(n.nodes).withColumn("input_cap", F.coalesce("input_cap", F.lit(2e-15))), n.wires)


def request_circuits(spark, sf_dir):
    asked = F.concat(F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("event_id") % 5 + 1).cast("int")), F.lit(" with "), (F.col("event_id") % 90).cast("string"), F.lit(" dB gain"))
    specs = nlspec.parse(table(spark, sf_dir, "events").select("event_id", asked.alias("text")))
    return analog.for_requests(specs).select("event_id", "topology", "gain_db", "idx", "device", "w")


def train_all_heads(spark, sf_dir):
    n, s = slacks(spark, sf_dir, (0.95,))
    y = features.labels(s, _labels(n)).withColumn("depth_f", F.col("depth").cast("double"))
    rows = features.node_features(n.nodes, s).join(y, ["circuit_id", "idx"])
    out = heads.regression_heads(rows, ["arrival_time", "required_time", "slack", "congestion"]).unionByName(heads.flag_heads(rows, ["critical", "drc"]))
    nodes = nodes_from_events(table(spark, sf_dir, "events"))
    analog_rows = features.analog_node_features(_devices(nodes)).join(analog.small_signal(nodes, edges_of(nodes)).select("circuit_id", "idx", "gbw_score", "parasitic_impact"), ["circuit_id", "idx"])
    return out.unionByName(heads.regression_heads(analog_rows, ["gbw_score", "parasitic_impact"], [*features.ANALOG, "is_pi", "is_po"]))


QUERIES = {f.__name__: f for f in (message_pass_weighted, message_pass_softmin, relaxation_sweeps, timing_embedding, graph_convolution, edge_sums, analog_node_features, analog_edge_features, request_circuits, train_all_heads)}


def _each(form: str, size: int = SIZE) -> str:
    return ", ".join(form.format(k=k) for k in range(size))


def _dot(weights: list[float], names: list[str]) -> str:
    return "(" + " + ".join(f"{w!r}::DOUBLE * {x}" for w, x in zip(weights, names)) + ")"


_TERMS = _VECTORS + ", terms AS (SELECT circuit_id, drv, snk, " + ", ".join(_dot(EDGE[k], ["(wire_delay / 0.1e0)", "(manhattan / 30e0)", "(fanout / 10e0)"]) + f" AS t{k}" for k in range(SIZE)) + " FROM arcs)"


def _sweep(name: str, before: str, reduce: str, sign: str, at: str, to: str) -> str:
    combine = {"max": "greatest", "min": "least"}[reduce]
    sent = f"SELECT a.circuit_id, a.{to} AS idx, " + _each(f"round({reduce}(v.v{{k}} {sign} t{{k}}), 9) AS m{{k}}") + f" FROM terms a JOIN {before} v ON v.circuit_id = a.circuit_id AND v.idx = a.{at} GROUP BY ALL"
    return f"{name} AS (SELECT v.circuit_id, v.idx, " + _each(f"{combine}(v.v{{k}}, m{{k}}) AS v{{k}}") + f" FROM {before} v LEFT JOIN ({sent}) m USING (circuit_id, idx))"


_FORWARD = _TERMS + ", " + _sweep("f1", "vectors", "max", "+", "drv", "snk") + ", " + _sweep("f2", "f1", "max", "+", "drv", "snk")
_BACKBONE = (
    _FORWARD + ", top AS (SELECT circuit_id, " + _each("round(max(v{k}), 9) AS c{k}") + " FROM f2 GROUP BY circuit_id), mean AS (SELECT circuit_id, " + _each("round(avg(v{k}), 9) AS c{k}") + " FROM vectors GROUP BY circuit_id), "
    "b0 AS (SELECT circuit_id, idx, " + ", ".join(f"v{k} + {_dot(SEED[k], ['c0', 'c1', 'c2'])} AS v{k}" for k in range(SIZE)) + " FROM vectors JOIN top USING (circuit_id)), "
    + _sweep("b1", "b0", "min", "-", "snk", "drv") + ", " + _sweep("b2", "b1", "min", "-", "snk", "drv")
)
_HALVES = ["f.v0", "f.v1", "f.v2", "b.v0", "b.v1", "b.v2"]
_DEVICES = f"dev AS (SELECT n.circuit_id, n.idx, n.role, d.device, d.w, d.l, d.cgd, d.region, coalesce(d.input_cap, 2e-15) AS dev_cap, CASE WHEN d.device IN ('NMOS', 'PMOS') THEN 1 + (event_id // 6) % 3 ELSE 0 END AS symmetry FROM nodes n LEFT JOIN {lib.DEVICES_SQL} d ON n.role = 'GATE' AND d.dev_idx = n.event_id % 6)"
_WIRE = "0.12e0 * wire_length_um * (0.00017e0 * wire_length_um / 2e0 + s.dev_cap * 1e15) * 1e-3"
_TEMPLATES = lib.sql_values([(t, i, d) for t, devices in analog.TEMPLATES.items() for i, d in enumerate(devices)])

ORACLE_SQL = {
    "message_pass_weighted": sql("SELECT a.circuit_id, a.snk AS idx, " + _each("round(max(v{k} + t{k}), 9) AS m{k}") + " FROM terms a JOIN vectors v ON v.circuit_id = a.circuit_id AND v.idx = a.drv GROUP BY ALL", _TERMS),
    "message_pass_softmin": sql("SELECT circuit_id, idx, " + _each("round(-(ln(sum(exp(4e0 * (x{k} - m{k})))) / 4e0 - min(m{k})), 9) AS m{k}") + " FROM (SELECT *, " + _each("min(m{k}) OVER w AS x{k}") + " FROM (SELECT a.circuit_id, a.snk AS idx, " + _each("v{k} - t{k} AS m{k}") + " FROM terms a JOIN vectors v ON v.circuit_id = a.circuit_id AND v.idx = a.drv) WINDOW w AS (PARTITION BY circuit_id, idx)) GROUP BY circuit_id, idx", _TERMS),
    "relaxation_sweeps": sql("SELECT circuit_id, idx, " + _each("round(v{k}, 6) AS v{k}") + " FROM f2", _FORWARD),
    "timing_embedding": sql("SELECT f.circuit_id, f.idx, " + ", ".join(f"round({_HALVES[k]} + {_dot(RAW[k], ['x.v0', 'x.v1', 'x.v2'])} + {_dot(CONTEXT[k], ['c0', 'c1', 'c2'])}, 6) AS v{k}" for k in range(2 * SIZE)) + " FROM f2 f JOIN b2 b ON b.circuit_id = f.circuit_id AND b.idx = f.idx JOIN vectors x ON x.circuit_id = f.circuit_id AND x.idx = f.idx JOIN mean m ON m.circuit_id = f.circuit_id", _BACKBONE),
    "graph_convolution": sql(
        "SELECT circuit_id, idx, " + _each("round(v{k} + CASE WHEN z{k} > 0 THEN z{k} ELSE exp(z{k}) - 1e0 END, 6) AS v{k}") + " FROM (SELECT *, " + _each("(o{k} - avg(o{k}) OVER ()) / sqrt(var_pop(o{k}) OVER () + 1e-5) AS z{k}") + " FROM conv)",
        _VECTORS + ", own AS (SELECT v.*, " + ", ".join(_dot(EDGE[k], ["v0", "v1", "v2"]) + f" AS h{k}" for k in range(SIZE)) + ", sqrt(1e0 + coalesce(drivers, 0)) AS root FROM vectors v LEFT JOIN (SELECT circuit_id, snk AS idx, count(*) AS drivers FROM edges GROUP BY ALL) USING (circuit_id, idx)), "
        "got AS (SELECT e.circuit_id, e.snk AS idx, " + _each("sum(h{k} / root) AS g{k}") + " FROM edges e JOIN own o ON o.circuit_id = e.circuit_id AND o.idx = e.drv GROUP BY ALL), "
        "conv AS (SELECT o.*, " + _each("(h{k} / root + coalesce(g{k}, 0e0)) / root AS o{k}") + " FROM own o LEFT JOIN got USING (circuit_id, idx))",
    ),
    "edge_sums": sql("SELECT v.circuit_id, v.idx, " + _each("round(v{k} + coalesce(s{k}, 0e0), 6) AS v{k}") + " FROM vectors v LEFT JOIN (SELECT a.circuit_id, a.snk AS idx, " + _each("sum(greatest(v{k} + t{k}, 0e0)) AS s{k}") + " FROM terms a JOIN vectors v ON v.circuit_id = a.circuit_id AND v.idx = a.drv GROUP BY ALL) s USING (circuit_id, idx)", _TERMS),
    "analog_node_features": sql("SELECT circuit_id, idx, (role = 'PI')::INT::DOUBLE AS is_pi, (role = 'PO')::INT::DOUBLE AS is_po, " + ", ".join(f"coalesce(device = '{d[0]}', false)::INT::DOUBLE AS is_{d[0].lower()}" for d in lib.DEVICES) + ", coalesce(round(coalesce(w / l, 0e0) / coalesce(max(w / l) OVER c, 1e0), 9), 0e0) AS wl_f, coalesce(region, 0e0) AS region_f, round(symmetry / greatest(max(symmetry) OVER c, 1), 9) AS symmetry_f, 0e0 AS is_digital, 1e0 AS is_analog, 0e0 AS delay_f, 0e0 AS cap_f, 0e0 AS res_f, 0.5e0 AS clock_f FROM dev WINDOW c AS (PARTITION BY circuit_id)", _DEVICES),
    "analog_edge_features": sql(f"SELECT a.circuit_id, a.drv, a.snk, round({_WIRE} / 0.1e0, 9) AS wire_f, round(manhattan / 30e0, 9) AS manhattan_f, round(t.fanout / 10e0, 9) AS fanout_f, round(coalesce(d.cgd / 1e-15, 0e0), 9) AS coupling_f, (d.symmetry <> 0 AND d.symmetry = s.symmetry)::INT::DOUBLE AS matching_f FROM arcs a JOIN nets t ON t.circuit_id = a.circuit_id AND t.drv = a.drv JOIN dev d ON d.circuit_id = a.circuit_id AND d.idx = a.drv JOIN dev s ON s.circuit_id = a.circuit_id AND s.idx = a.snk", _DEVICES),
    "request_circuits": f"SELECT event_id, t.topology, (event_id % 90)::DOUBLE AS gain_db, t.idx::BIGINT AS idx, t.device, d.w FROM events JOIN (VALUES {lib.sql_values(list(enumerate(MEANT)))}) AS m(k, topology) ON m.k = event_id % 5 JOIN (VALUES {_TEMPLATES}) AS t(topology, idx, device) ON t.topology = m.topology JOIN {lib.DEVICES_SQL} d ON d.device = t.device",
}
