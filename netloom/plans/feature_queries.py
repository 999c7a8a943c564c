"""Features, labels, analog pass, summaries, splits and message passing with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import library as lib
from ..operators import analog, features, messages, splits
from ..operators.netlist import edges_of, nodes_from_events
from ..sources.tables import table
from .netlist_queries import _labels, netlist, slacks, timed
from .netlist_sql import sql


def node_features(spark, sf_dir) -> DataFrame:
    n, s = slacks(spark, sf_dir, (1.2,))
    return features.node_features(n.nodes, s)


def edge_features(spark, sf_dir):
    return features.edge_features(netlist(spark, sf_dir).wires)


def graph_labels(spark, sf_dir):
    n, s = slacks(spark, sf_dir, (1.2,))
    return features.labels(s, _labels(n))


def analog_sta(spark, sf_dir):
    nodes = nodes_from_events(table(spark, sf_dir, "events"))
    return analog.small_signal(nodes, edges_of(nodes))


def structural_encoding(spark, sf_dir):
    n = netlist(spark, sf_dir)
    return messages.structural_encoding(n.nodes, n.edges)


def _vectors(n):
    return n.nodes.select("circuit_id", "idx", F.array(F.coalesce(F.col("intrinsic_delay") / lib.DELAY_REF, F.lit(0.0)), F.coalesce(F.col("input_cap") / lib.CAP_REF, F.lit(0.0)), F.col("x").cast("double") / F.col("side")).alias("v"))


def message_pass_max(spark, sf_dir):
    n = netlist(spark, sf_dir)
    return messages.aggregate_messages(_vectors(n), n.wires, "max")


def message_pass_min(spark, sf_dir):
    n = netlist(spark, sf_dir)
    return messages.aggregate_messages(_vectors(n), n.wires, "min")


def message_pass_softmax(spark, sf_dir):
    n = netlist(spark, sf_dir)
    return messages.aggregate_messages(_vectors(n), n.wires, "soft", beta=4.0)


def attention_softmax(spark, sf_dir):
    n = netlist(spark, sf_dir)
    return messages.attention(_vectors(n), n.edges)


def graph_pool_embedding(spark, sf_dir):
    return messages.pool(_vectors(netlist(spark, sf_dir)))


def _summary(spark, sf_dir):
    n, s = slacks(spark, sf_dir, (0.95,))
    return splits.circuit_summary(s, _labels(n))


def circuit_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


def dataset_summary(spark, sf_dir):
    return splits.dataset_summary(_summary(spark, sf_dir), F.col("circuit_id") % 23)


def train_stats(spark, sf_dir):
    return splits.target_stats(slacks(spark, sf_dir, (1.2,))[1])


def _circuits(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("circuit_id")).count().where("count >= 12").select("circuit_id", F.concat(F.lit("c"), F.col("circuit_id") % 23, F.lit("_"), "circuit_id").alias("name"))


def split_by_source(spark, sf_dir):
    return splits.split_by_source(_circuits(spark, sf_dir))


def split_random(spark, sf_dir):
    return splits.split_random(_circuits(spark, sf_dir))


def augment_edge_noise(spark, sf_dir):
    return features.augment(netlist(spark, sf_dir).wires)


def metadata_filter(spark, sf_dir):
    return splits.by_metadata(_summary(spark, sf_dir), {"num_gates": {"min": 60, "max": 75}, "max_congestion": {"min": 0.5}}, 20)


QUERIES = {f.__name__: f for f in (node_features, edge_features, graph_labels, analog_sta, structural_encoding, message_pass_max, message_pass_min, message_pass_softmax, attention_softmax, graph_pool_embedding, circuit_summary, dataset_summary, train_stats, split_by_source, split_random, augment_edge_noise, metadata_filter)}

_VECTORS = "vectors AS (SELECT circuit_id, idx, coalesce(intrinsic_delay / 0.1e0, 0e0) AS v0, coalesce(input_cap / 5e0, 0e0) AS v1, x::DOUBLE / side AS v2 FROM nodes)"
_MESSAGES = _VECTORS + ", msg AS (SELECT a.circuit_id, a.snk AS idx, v0 + wire_delay / 0.1e0 AS m0, v1 + wire_delay / 0.1e0 AS m1, v2 + wire_delay / 0.1e0 AS m2 FROM arcs a JOIN vectors v ON v.circuit_id = a.circuit_id AND v.idx = a.drv)"
_SUM = "summaries AS (SELECT s.circuit_id, count(*) AS num_gates, max(congestion) AS max_congestion, count(*) FILTER (slack <= 0.05e0) AS critical_path_length, round(avg(slack), 9) AS avg_slack FROM slacks s JOIN labels_ l USING (circuit_id, idx) WHERE factor = 0.95e0 GROUP BY s.circuit_id)"
_DEV = lib.DEVICES_SQL
_NAMES = "names AS (SELECT user_id AS circuit_id, 'c' || (user_id % 23) || '_' || user_id AS name FROM events GROUP BY user_id HAVING count(*) >= 12)"


def _soft(k):
    return f"round(max(m{k}) + ln(sum(exp(4e0 * (m{k} - x{k})))) / 4e0, 9) AS m{k}"


ORACLE_SQL = {
    "node_features": sql("SELECT n.circuit_id, n.idx, (n.role = 'PI')::INT::DOUBLE AS is_pi, (n.role = 'PO')::INT::DOUBLE AS is_po, 0e0 AS is_nmos, 0e0 AS is_pmos, 0e0 AS is_r, 0e0 AS is_c, 0e0 AS is_current_mirror, 0e0 AS is_diff_pair, 0e0 AS wl_f, 0e0 AS region_f, 0e0 AS symmetry_f, 1e0 AS is_digital, 0e0 AS is_analog, round(coalesce(intrinsic_delay / 0.1e0, 0e0), 9) AS delay_f, round(coalesce(input_cap / 5e0, 0e0), 9) AS cap_f, round(coalesce(output_res / 500e0, 0e0), 9) AS res_f, round(clock / 2e0, 13) AS clock_f FROM nodes n JOIN slacks s ON s.circuit_id = n.circuit_id AND s.idx = n.idx AND s.factor = 1.2e0"),
    "edge_features": sql("SELECT circuit_id, drv, snk, round(wire_delay / 0.1e0, 9) AS wire_f, round(manhattan / 30e0, 9) AS manhattan_f, round(fanout / 10e0, 9) AS fanout_f, 0e0 AS coupling_f, 0e0 AS matching_f FROM arcs"),
    "graph_labels": sql("SELECT s.circuit_id, s.idx, slack, round(arrival, 13) AS arrival_time, required AS required_time, depth, (slack <= 0.05e0)::INT::DOUBLE AS critical, congestion, drc FROM slacks s JOIN labels_ USING (circuit_id, idx) WHERE factor = 1.2e0"),
    "analog_sta": sql(
        "SELECT circuit_id, idx, device, gm, round(gain, 9) AS intrinsic_gain, round(gbw, 9) AS gbw_log10_hz, round(gbw / greatest(max(gbw) OVER w, 1e0), 9) AS gbw_score, round(par / greatest(max(par) OVER w, 1e-18), 9) AS parasitic_impact, (gm > 0e0 AND par / greatest(max(par) OVER w, 1e-18) > 0.5e0 AND gbw / greatest(max(gbw) OVER w, 1e0) < 0.5e0) AS bandwidth_limited FROM signal WINDOW w AS (PARTITION BY circuit_id)",
        f"dev AS (SELECT n.circuit_id, n.idx, d.device, d.cgd, coalesce(d.gm, 0e0) AS gm, coalesce(d.cgs, d.input_cap) AS own, CASE d.device WHEN 'NMOS' THEN sqrt(2e0 * 300e-4 * 6e-3 * (w / l) * 50e-6) / (0.1e0 * 50e-6) WHEN 'PMOS' THEN sqrt(2e0 * 100e-4 * 6e-3 * (w / l) * 50e-6) / (0.15e0 * 50e-6) ELSE 0e0 END AS gain FROM nodes n JOIN {_DEV} d ON d.dev_idx = n.event_id % 6), "
        "around AS (SELECT e.circuit_id, e.drv AS idx, sum(d.own) AS caps, sum(coalesce(d.cgd, 0e0)) AS coupling FROM edges e JOIN dev d ON d.circuit_id = e.circuit_id AND d.idx = e.snk GROUP BY ALL), "
        "signal AS (SELECT d.circuit_id, d.idx, device, gm, gain, CASE WHEN gm > 0 THEN log10(greatest(gm / (own + coalesce(caps, 0e0) + 1e-18) / (2e0 * pi()), 1e0)) ELSE 0e0 END AS gbw, coalesce(coupling, 0e0) + own AS par FROM dev d LEFT JOIN around a USING (circuit_id, idx))",
    ),
    "structural_encoding": sql("SELECT n.circuit_id, n.idx, coalesce(d.deg, 0) AS degree, " + ", ".join(f"round(pow(1e0 / greatest(coalesce(d.deg, 0), 1), {p}), 9) AS pe{p}" for p in range(1, 17)) + " FROM nodes n LEFT JOIN (SELECT circuit_id, idx, count(*) AS deg FROM (SELECT circuit_id, drv AS idx FROM edges UNION ALL SELECT circuit_id, snk FROM edges) GROUP BY ALL) d USING (circuit_id, idx)"),
    "message_pass_max": sql("SELECT circuit_id, idx, round(max(m0), 9) AS m0, round(max(m1), 9) AS m1, round(max(m2), 9) AS m2 FROM msg GROUP BY circuit_id, idx", _MESSAGES),
    "message_pass_min": sql("SELECT circuit_id, idx, round(min(m0), 9) AS m0, round(min(m1), 9) AS m1, round(min(m2), 9) AS m2 FROM msg GROUP BY circuit_id, idx", _MESSAGES),
    "message_pass_softmax": sql(f"SELECT circuit_id, idx, {_soft(0)}, {_soft(1)}, {_soft(2)} FROM (SELECT *, max(m0) OVER w AS x0, max(m1) OVER w AS x1, max(m2) OVER w AS x2 FROM msg WINDOW w AS (PARTITION BY circuit_id, idx)) GROUP BY circuit_id, idx", _MESSAGES),
    "attention_softmax": sql("SELECT circuit_id, drv, snk, round(exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY circuit_id, snk), 9) AS weight FROM (SELECT *, max(s) OVER (PARTITION BY circuit_id, snk) AS m FROM (SELECT e.circuit_id, e.drv, e.snk, greatest(a.v0 + b.v0, 0.2e0 * (a.v0 + b.v0)) + greatest(a.v1 + b.v1, 0.2e0 * (a.v1 + b.v1)) + greatest(a.v2 + b.v2, 0.2e0 * (a.v2 + b.v2)) AS s FROM edges e JOIN vectors a ON a.circuit_id = e.circuit_id AND a.idx = e.drv JOIN vectors b ON b.circuit_id = e.circuit_id AND b.idx = e.snk))", _VECTORS),
    "graph_pool_embedding": sql("SELECT circuit_id, round(avg(v0), 9) AS mean0, round(avg(v1), 9) AS mean1, round(avg(v2), 9) AS mean2, round(max(v0), 9) AS max0, round(max(v1), 9) AS max1, round(max(v2), 9) AS max2 FROM vectors GROUP BY circuit_id", _VECTORS),
    "circuit_summary": sql("SELECT * FROM summaries", _SUM),
    "dataset_summary": sql("SELECT count(*) AS num_graphs, count(DISTINCT circuit_id % 23) AS num_sources, min(num_gates) AS min_nodes, max(num_gates) AS max_nodes, round(avg(num_gates), 9) AS mean_nodes, sum(num_gates)::BIGINT AS total_nodes, round(avg(critical_path_length / num_gates), 9) AS mean_critical_rate FROM summaries", _SUM),
    "train_stats": sql("SELECT round(avg(slack), 9) AS slack_mean, round(greatest(stddev_pop(slack), 1e-3), 9) AS slack_std, round(avg(arrival), 9) AS at_mean, round(greatest(stddev_pop(arrival), 1e-3), 9) AS at_std, round(avg(required), 9) AS rt_mean, round(greatest(stddev_pop(required), 1e-3), 9) AS rt_std, round(avg(clock), 9) AS clock_mean, round(greatest(stddev_pop(clock), 1e-3), 9) AS clock_std FROM slacks WHERE factor = 1.2e0"),
    "split_by_source": f"WITH {_NAMES}, keyed AS (SELECT *, split_part(name, '_', 1) AS source_base FROM names), keys AS (SELECT source_base, row_number() OVER (ORDER BY md5(source_base)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source_base FROM keyed)) SELECT circuit_id, name, source_base, CASE WHEN r <= greatest(1, round_even(n * 0.15e0, 0)) THEN 'test' WHEN r <= 2 * greatest(1, round_even(n * 0.15e0, 0)) THEN 'val' ELSE 'train' END AS split FROM keyed JOIN keys USING (source_base)",
    "split_random": f"WITH {_NAMES} SELECT circuit_id, name, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, ('0x' || substr(md5(name), 1, 8))::BIGINT % 100 AS h FROM names)",
    "augment_edge_noise": sql("SELECT circuit_id, drv, snk, round(wire_delay / 0.1e0 + 0.05e0 * stddev_pop(wire_delay / 0.1e0) OVER (PARTITION BY circuit_id) * (((drv * 7919 + snk * 104729) % 2001) / 1000e0 - 1e0), 9) AS wire_f FROM arcs QUALIFY (drv * 31 + snk * 17 + circuit_id) % 20 <> 0"),
    "metadata_filter": sql("SELECT * FROM summaries WHERE num_gates BETWEEN 60 AND 75 AND max_congestion >= 0.5e0 ORDER BY circuit_id LIMIT 20", _SUM),
}
