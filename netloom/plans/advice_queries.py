"""Knowledge-graph, diagnosis, request-parsing and ingestion queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import knowledge as kg
from ..functions.library import DEVICES_SQL
from ..operators import analog, diagnose, graph_facts, mapping, nlspec
from ..operators.netlist import edges_of, nodes_from_events
from ..sources import dialects, netlists, stores
from ..sources.tables import checkpointed, new_folder, table
from .netlist_queries import _labels, netlist, slacks
from .netlist_sql import sql

def _kg(spark):
    return kg.kg_edges(spark), kg.fixes(spark)


def _library(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a property graph for each supplier, written as JSON documents and read again."""
    owners = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("library"), F.col("s_suppkey").cast("long").alias("place"))
    path = new_folder(spark)
    stores.graph_to_json(*kg.libraries(owners)).select(F.col("json").alias("value")).write.text(path)
    return tuple(checkpointed(x) for x in stores.graph_from_json(spark.read.text(path), "value"))


def _lookup(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _library(spark, sf_dir)
    return edges, kg.fixes_of(nodes)


def kg_fixes(spark, sf_dir) -> DataFrame:
    e, f = _lookup(spark, sf_dir)
    out = [graph_facts.fixes_for_violation(e, f, p).select(F.lit(p or "any").alias("asked"), "violation", "fix", "effort") for p in ("45nm", "130nm", None)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def kg_conflicts(spark, sf_dir):
    return graph_facts.conflicts(_library(spark, sf_dir)[1])


def kg_topology_fixes(spark, sf_dir):
    return graph_facts.fixes_for_topology(*_lookup(spark, sf_dir), "45nm")


def kg_stats(spark, sf_dir):
    return graph_facts.stats(*_library(spark, sf_dir))


def kg_facts(spark, sf_dir):
    facts = graph_facts.all_facts(*_lookup(spark, sf_dir), "45nm")
    return facts.where(F.col("violation").endswith("/routing_congestion")).drop("violation")


def kg_merge(spark, sf_dir):
    """The graphs of all suppliers with new properties for some fixes and a new relation, merged twice."""
    nodes, edges = _library(spark, sf_dir)
    low = nodes.where("label = 'FixStrategy' AND props['effort'] = 'low'")
    new_nodes = low.select("library", "name", "label", F.create_map(F.lit("effort"), F.lit("minimal"), F.lit("tried"), F.lit("yes")).alias("props"))
    new_edges = low.select("library", F.lit(0).cast("long").alias("seq"), F.lit("TRIED_ON").alias("type"), F.col("name").alias("src"), F.concat("library", F.lit("/setup_violation")).alias("dst"), F.create_map(F.lit("by"), F.col("library")).alias("props"))
    for _ in range(2):
        nodes, edges = stores.upsert_graph(nodes, edges, new_nodes, new_edges)
    facts = nodes.where("label = 'FixStrategy'").select("name", F.col("props")["effort"].alias("effort"), F.col("props")["process_nodes"].alias("process_nodes"), F.col("props")["tried"].alias("tried"))
    tried = edges.where("type = 'TRIED_ON'").groupBy(F.col("src").alias("name")).agg(F.count("*").alias("n_tried"))
    return facts.join(tried, "name", "left")


def _predictions(spark, sf_dir):
    n, s = slacks(spark, sf_dir, (0.95,))
    return checkpointed(diagnose.predictions(s, _labels(n)))  # read by every ranking


def rank_critical(spark, sf_dir):
    return diagnose.rank_critical(_predictions(spark, sf_dir))


def rank_drc(spark, sf_dir):
    return diagnose.rank_drc(_predictions(spark, sf_dir))


def rank_congestion(spark, sf_dir):
    return diagnose.rank_congestion(_predictions(spark, sf_dir))


def violation_class(spark, sf_dir):
    return diagnose.violation_class(_predictions(spark, sf_dir))


def _recs(spark, sf_dir):
    b = checkpointed(diagnose.bottlenecks(_predictions(spark, sf_dir)))
    return b, diagnose.recommendations(b, *_kg(spark))


def recommendations(spark, sf_dir):
    return _recs(spark, sf_dir)[1].select("circuit_id", "task", "violation", "fix", "effort", F.array_join("outcomes", ",").alias("outcomes"), F.array_join("conflicts", ",").alias("conflicts"), F.array_join("rules", ",").alias("rules"), "confidence")


def conflict_reconcile(spark, sf_dir):
    return diagnose.reconcile(_recs(spark, sf_dir)[1]).select("circuit_id", "task", "fix", F.array_join("clashing", ",").alias("clashing"), "adjusted")


def design_report(spark, sf_dir):
    b, r = _recs(spark, sf_dir)
    return diagnose.report(b, diagnose.reconcile(r))


def _advisor(spark, sf_dir):
    nodes = nodes_from_events(table(spark, sf_dir, "events"))
    return diagnose.advisor_bottlenecks(_predictions(spark, sf_dir), analog.small_signal(nodes, edges_of(nodes)))


def bottleneck_rules(spark, sf_dir):
    return _advisor(spark, sf_dir).select("circuit_id", "rank", "task", "severity")


def advice_templates(spark, sf_dir):
    return diagnose.advice(_advisor(spark, sf_dir), kg.tips(spark))


def scenario_builder(spark, sf_dir):
    return diagnose.scenarios(_recs(spark, sf_dir)[0])


def _requests(spark, sf_dir) -> DataFrame:
    """A request in plain words for each event, with its figures."""
    x, y = ((F.col("event_id") % k).cast("string") for k in (90, 37))
    texts = [F.concat(*(F.lit(part) if isinstance(part, str) else part for part in row)) for row in (
        ("Design a two-stage Miller op-amp with ", x, " dB gain and ", y, " MHz GBW in 130nm CMOS"), ("folded cascode, gain of ", x, " dB, ", y, " GHz bandwidth, 60 degrees phase margin, 45 nm"), ("a differential pair with ", y, ".5 mW power, uncompensated"),
        ("current mirror number ", x, " please"), (y, "-stage amplifier with nested compensation, ", x, " V/us slew, gbw of ", y, " MHz"), ("common source stage in ", x, " nm"))]
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.element_at(F.array(*texts), (F.col("event_id") % 6 + 1).cast("int")).alias("text"))


def nl_spec_parse(spark, sf_dir):
    return nlspec.parse(_requests(spark, sf_dir)).drop("text")


def _statements(df):
    return df.select("name", "kind", "out", F.coalesce("func", F.lit("")).alias("func"), F.array_join("ins", ",").alias("ins"))


def _written(spark, sf_dir, how) -> DataFrame:
    """Every derived netlist as text in one of the dialects, with comments, other case, flip-flops and lines that mean nothing."""
    n = netlist(spark, sf_dir)
    return how(n.nodes, n.edges)


def bench_parse(spark, sf_dir):
    return _statements(netlists.parse_bench(netlists.lines(_written(spark, sf_dir, dialects.bench))))


def verilog_parse(spark, sf_dir):
    return _statements(netlists.parse_verilog(_written(spark, sf_dir, dialects.verilog)))


def epfl_parse(spark, sf_dir):
    return _statements(netlists.parse_assigns(_written(spark, sf_dir, dialects.assigns)))


def part_gates(spark, sf_dir) -> DataFrame:
    """A gate of one to 64 inputs for each part, as a statement."""
    k = (F.col("p_partkey") % 64 + 1).cast("int")
    func = F.element_at(F.array(*map(F.lit, ("NAND", "AND", "XOR", "NOR"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    pins = F.transform(F.sequence(F.lit(1), k), lambda j: F.concat(F.lit("i"), j.cast("string")))
    return table(spark, sf_dir, "part").select(F.lit("g").alias("name"), F.lit(0).alias("seq"), F.lit("gate").alias("kind"), F.concat(F.lit("o"), "p_partkey").alias("out"), func.alias("func"), pins.alias("ins"))


def gate_decompose(spark, sf_dir):
    """Cells and pins of the gates of all parts."""
    cells = mapping.decompose(part_gates(spark, sf_dir))
    return cells.groupBy("gate").agg(F.count("*").alias("cells"), F.sum(F.size("ins")).cast("long").alias("pins"), F.sum((F.col("cell") == "INV_X1").cast("long")).alias("inverters"))


def netlist_wire(spark, sf_dir):
    """Edges of the .bench texts: flip-flops cut, a port named twice, signals with a second driver."""
    return mapping.wire(checkpointed(netlists.parse_bench(netlists.lines(_written(spark, sf_dir, dialects.bench)))))[1]


QUERIES = {f.__name__: f for f in (kg_fixes, kg_conflicts, kg_topology_fixes, kg_stats, kg_facts, kg_merge, rank_critical, rank_drc, rank_congestion, violation_class, recommendations, conflict_reconcile, design_report, bottleneck_rules, advice_templates, scenario_builder, nl_spec_parse, bench_parse, verilog_parse, epfl_parse, gate_decompose, netlist_wire)}

_KG = kg.KG_SQL
_P = "preds AS MATERIALIZED (SELECT s.circuit_id, s.idx, slack, congestion, round(1e0 / (1e0 + exp(-((drc - 0.5e0) * 10e0))), 9) AS prob FROM slacks s JOIN labels_ l USING (circuit_id, idx) WHERE factor = 0.95e0)"


def _top(order: str, name: str) -> str:
    return f"{name} AS (SELECT circuit_id, string_agg('n' || idx, ', ' ORDER BY r) AS node_ids, string_agg('n' || idx, ', ' ORDER BY r) FILTER (r <= 3) AS location FROM (SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY {order}, idx) AS r FROM preds) WHERE r <= 5 GROUP BY circuit_id)"


_RANKS = ", ".join([
    _P, _top("slack", "top_s"), _top("prob DESC", "top_d"), _top("congestion DESC", "top_c"),
    "crit AS (SELECT circuit_id, n_viol, worst_slack, round(CASE WHEN n_viol > 0 THEN greatest(least(1e0, 0.5e0 * n_viol / n + 0.5e0 * least(1e0, abs(least(worst_slack, 0e0)) / 0.2e0)), 0.05e0) ELSE 0e0 END, 9) AS severity, location, node_ids FROM (SELECT circuit_id, count(*) FILTER (slack <= 0) AS n_viol, count(*) AS n, min(slack) AS worst_slack FROM preds GROUP BY circuit_id) JOIN top_s USING (circuit_id))",
    "drcs AS (SELECT circuit_id, max(prob) AS severity, any_value(location) AS location, any_value(node_ids) AS node_ids FROM preds JOIN top_d USING (circuit_id) GROUP BY circuit_id HAVING max(prob) >= 0.5e0)",
    "congs AS (SELECT circuit_id, least(1e0, max(congestion)) AS severity, any_value(location) AS location, any_value(node_ids) AS node_ids FROM preds JOIN top_c USING (circuit_id) GROUP BY circuit_id HAVING max(congestion) >= 0.3e0)",
    "classes AS (SELECT circuit_id, CASE WHEN avg(slack) FILTER (slack < 0) > -0.02e0 AND count(*) FILTER (slack < 0) > 0.3e0 * count(*) THEN 'hold_violation' ELSE 'setup_violation' END AS violation FROM preds GROUP BY circuit_id)",
    "necks AS MATERIALIZED (SELECT circuit_id, 'slack' AS task, violation, severity, location FROM crit JOIN classes USING (circuit_id) UNION ALL SELECT circuit_id, 'drc', 'drc_density', severity, location FROM drcs UNION ALL SELECT circuit_id, 'congestion', 'routing_congestion', severity, location FROM congs)",
])
_CLASH = "clash AS (SELECT src AS fix, dst AS conflict FROM kg_edges WHERE type = 'CONFLICTS_WITH' UNION SELECT dst, src FROM kg_edges WHERE type = 'CONFLICTS_WITH')"
_RECS = _KG + ", " + _CLASH + ", " + _RANKS + ", recs AS MATERIALIZED (SELECT n.circuit_id, n.task, n.violation, n.severity, e.dst AS fix, f.effort, coalesce((SELECT string_agg(dst, ',' ORDER BY seq) FROM kg_edges WHERE type = 'PRODUCES' AND src = e.dst), '') AS outcomes, coalesce((SELECT string_agg(conflict, ',' ORDER BY conflict) FROM clash WHERE fix = e.dst), '') AS conflicts, coalesce((SELECT string_agg(dst, ',' ORDER BY seq) FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY seq) AS r FROM kg_edges WHERE type = 'CONSTRAINED_BY') WHERE r <= 2 AND src = e.dst), '') AS rules, round(greatest(0.05e0, least(0.95e0, 0.4e0 + 0.4e0 * n.severity + CASE f.effort WHEN 'low' THEN 0.1e0 WHEN 'high' THEN -0.1e0 ELSE 0e0 END)), 9) AS confidence FROM necks n JOIN kg_edges e ON e.type = 'RESOLVED_BY' AND e.src = n.violation JOIN fixes f ON f.fix = e.dst WHERE list_contains(string_split(f.process_nodes, ','), '45nm')), clashing AS (SELECT r.circuit_id, r.task, r.fix, string_agg(DISTINCT c.conflict, ',' ORDER BY c.conflict) AS clashing FROM recs r JOIN clash c ON c.fix = r.fix JOIN recs o ON o.circuit_id = r.circuit_id AND o.fix = c.conflict GROUP BY ALL), recon AS (SELECT r.circuit_id, r.task, r.fix, coalesce(clashing, '') AS clashing, CASE WHEN clashing IS NULL THEN confidence ELSE round(greatest(0.05e0, confidence - 0.15e0), 9) END AS adjusted FROM recs r LEFT JOIN clashing USING (circuit_id, task, fix))"
_ADVISOR = (
    _P + ", " + _KG + ", dev AS (SELECT n.circuit_id, n.idx, d.device, d.cgd, coalesce(d.gm, 0e0) AS gm, coalesce(d.cgs, d.input_cap) AS own FROM nodes n JOIN " + DEVICES_SQL + " d ON d.dev_idx = n.event_id % 6), "
    "around AS (SELECT e.circuit_id, e.drv AS idx, sum(d.own) AS caps, sum(coalesce(d.cgd, 0e0)) AS coupling FROM edges e JOIN dev d ON d.circuit_id = e.circuit_id AND d.idx = e.snk GROUP BY ALL), "
    "sig AS (SELECT d.circuit_id, d.idx, CASE WHEN gm > 0 THEN log10(greatest(gm / (own + coalesce(caps, 0e0) + 1e-18) / (2e0 * pi()), 1e0)) ELSE 0e0 END AS gbw, coalesce(coupling, 0e0) + own AS par FROM dev d LEFT JOIN around a USING (circuit_id, idx)), "
    "score AS (SELECT circuit_id, round(gbw / greatest(max(gbw) OVER w, 1e0), 9) AS gbw_score, round(par / greatest(max(par) OVER w, 1e-18), 9) AS parasitic FROM sig WINDOW w AS (PARTITION BY circuit_id)), "
    "rules AS (SELECT circuit_id, 'congestion' AS task, least(1e0, max(congestion)) AS severity FROM preds GROUP BY 1 HAVING max(congestion) > 0.3e0 UNION ALL SELECT circuit_id, 'drc', max(prob) FROM preds GROUP BY 1 HAVING max(prob) > 0.5e0 UNION ALL SELECT circuit_id, 'analog_performance:gbw', least(1e0, 1e0 - greatest(min(gbw_score), 0e0)) FROM score GROUP BY 1 HAVING min(gbw_score) < 0.3e0 UNION ALL SELECT circuit_id, 'analog_performance:parasitic', least(1e0, max(parasitic)) FROM score GROUP BY 1 HAVING max(parasitic) > 0.5e0), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY severity DESC, task) AS rank FROM rules)"
)
_LIB = kg.LIBRARIES_SQL
# What the texts of dialects.py hold: a gate of every eleventh event is a flip-flop, circuits with an even number end with a second driver of node 4.
_TEXT = "ins AS (SELECT circuit_id, snk AS idx, list('s' || drv ORDER BY drv) AS p FROM edges GROUP BY ALL), rows_ AS (SELECT n.circuit_id, n.idx, n.role, n.event_id % 11 = 0 AS ff, p, row_number() OVER (PARTITION BY n.circuit_id, n.role ORDER BY n.idx) - 1 AS at_ FROM nodes n LEFT JOIN ins USING (circuit_id, idx))"
_TEXT = _TEXT.replace("ins AS (", "pinned AS (").replace("LEFT JOIN ins", "LEFT JOIN pinned")
_BENCH = (
    "SELECT circuit_id, 0 AS late, idx, 'input' AS kind, 's' || idx AS out, '' AS func, []::VARCHAR[] AS ins FROM rows_ WHERE role = 'PI' UNION ALL SELECT circuit_id, 0, idx, 'output', p[1], '', [] FROM rows_ WHERE role = 'PO' "
    "UNION ALL SELECT circuit_id, 0, idx, CASE WHEN ff THEN 'dff' ELSE 'gate' END, 's' || idx, CASE WHEN ff THEN '' ELSE 'NAND' END, CASE WHEN ff THEN p[1:1] ELSE p END FROM rows_ WHERE role = 'GATE' "
    "UNION ALL SELECT circuit_id, 1, 0, 'gate', 's4', 'NOT', ['s0'] FROM rows_ WHERE idx = 0 AND circuit_id % 2 = 0 UNION ALL SELECT circuit_id, 2, 0, 'input', 's0', '', [] FROM rows_ WHERE idx = 0 AND circuit_id % 2 = 0"
)
_WIRED = f"""stated AS (SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY late, idx) AS seq FROM ({_BENCH})),
firsts AS (SELECT circuit_id, out, min(seq) AS seq FROM stated WHERE kind IN ('input', 'dff') GROUP BY ALL),
every_ AS (SELECT circuit_id, 0 AS part, seq, out AS signal, []::VARCHAR[] AS ins FROM firsts UNION ALL SELECT circuit_id, 1, seq, out, ins FROM stated WHERE kind = 'gate' UNION ALL SELECT circuit_id, 2, seq, NULL, CASE kind WHEN 'dff' THEN ins ELSE [out] END FROM stated WHERE kind IN ('output', 'dff')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY part, seq, signal) - 1 AS idx FROM every_),
first_driver AS (SELECT circuit_id, signal, min(idx) AS drv FROM numbered WHERE signal IS NOT NULL GROUP BY ALL),
wires AS (SELECT circuit_id, idx, unnest(ins) AS signal FROM numbered)"""
_ASSIGN = (
    "SELECT circuit_id::VARCHAR AS name, 'input' AS kind, 's_' || idx AS out, '' AS func, '' AS ins FROM rows_ WHERE role = 'PI' UNION ALL SELECT circuit_id::VARCHAR, 'output', 'o_' || idx, '', '' FROM rows_ WHERE role = 'PO' "
    "UNION ALL SELECT circuit_id::VARCHAR, 'gate', 'o_' || idx, 'BUF', 's_' || p[1][2:] FROM rows_ WHERE role = 'PO' "
    "UNION ALL SELECT circuit_id::VARCHAR, 'gate', 's_' || idx, CASE WHEN len(p) = 1 THEN 'NOT' WHEN idx % 2 = 0 THEN 'AND' ELSE 'OR' END, CASE WHEN len(p) = 1 THEN 's_' || p[1][2:] ELSE 's_' || p[1][2:] || ',t_' || at_ || '_3' END FROM rows_ WHERE role = 'GATE' "
    "UNION ALL SELECT circuit_id::VARCHAR, 'gate', 't_' || at_ || '_3', 'NOT', 's_' || p[2][2:] FROM rows_ WHERE role = 'GATE' AND len(p) > 1"
)
_K, _F = "(p_partkey % 64 + 1)", "['NAND', 'AND', 'XOR', 'NOR'][p_partkey % 4 + 1]"
_ONE, _NEG = f"({_K} <= 2 OR ({_K} = 3 AND {_F} IN ('NAND', 'NOR')))", f"({_F} IN ('NAND', 'NOR'))"
_X, _Y, _KIND = "(event_id % 90)", "(event_id % 37)", "event_id % 6"
ORACLE_SQL = {
    "kg_fixes": f"WITH {_LIB} SELECT asked, src AS violation, dst AS fix, effort FROM kg_edges JOIN fixes ON fix = dst, (VALUES ('45nm'), ('130nm'), ('any')) a(asked) WHERE type = 'RESOLVED_BY' AND (asked = 'any' OR list_contains(string_split(process_nodes, ','), asked))",
    "kg_conflicts": f"WITH {_LIB}, {_CLASH} SELECT * FROM clash",
    "kg_topology_fixes": f"WITH {_LIB}, both_ AS (SELECT t.src AS topology, f.dst AS fix, t.dst AS violation, t.seq AS a, f.seq AS b FROM kg_edges t JOIN kg_edges f ON f.src = t.dst AND f.type = 'RESOLVED_BY' JOIN fixes x ON x.fix = f.dst WHERE t.type = 'COMMONLY_EXHIBITS' AND list_contains(string_split(x.process_nodes, ','), '45nm')), seen AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY topology, fix ORDER BY a, b) = 1) SELECT topology, fix, violation, row_number() OVER (PARTITION BY topology ORDER BY a, b) AS rank FROM seen",
    "kg_stats": f"WITH {_LIB} SELECT label AS name, count(*) AS n, 'node' AS kind FROM kg_nodes GROUP BY label UNION ALL SELECT type, count(*), 'relation' FROM kg_edges GROUP BY type",
    "kg_facts": f"WITH {_LIB}, {_CLASH}, f AS (SELECT src AS violation, dst AS fix, seq FROM kg_edges JOIN fixes ON fix = dst WHERE type = 'RESOLVED_BY' AND src LIKE '%/routing_congestion' AND list_contains(string_split(process_nodes, ','), '45nm')), r AS (SELECT violation, 0 AS part, seq, 0::BIGINT AS sub, violation AS subject, 'RESOLVED_BY' AS relation, fix AS object FROM f UNION ALL SELECT violation, 1, f.seq, 1000 + e.seq, f.fix, 'PRODUCES', e.dst FROM f JOIN kg_edges e ON e.type = 'PRODUCES' AND e.src = f.fix UNION ALL SELECT violation, 1, f.seq, 10000000, f.fix, 'CONFLICTS_WITH', conflict FROM f JOIN clash c ON c.fix = f.fix) SELECT rank, subject, relation, object FROM (SELECT *, row_number() OVER (PARTITION BY violation ORDER BY part, seq, CASE relation WHEN 'CONFLICTS_WITH' THEN 1 ELSE 0 END, sub, object) AS rank FROM r) WHERE rank <= 10",
    "kg_merge": f"WITH {_LIB} SELECT fix AS name, CASE effort WHEN 'low' THEN 'minimal' ELSE effort END AS effort, process_nodes, CASE effort WHEN 'low' THEN 'yes' END AS tried, CASE effort WHEN 'low' THEN 1 END::BIGINT AS n_tried FROM fixes",
    "rank_critical": sql("SELECT * FROM crit", _RANKS),
    "rank_drc": sql("SELECT * FROM drcs", _RANKS),
    "rank_congestion": sql("SELECT * FROM congs", _RANKS),
    "violation_class": sql("SELECT * FROM classes", _RANKS),
    "recommendations": sql("SELECT circuit_id, task, violation, fix, effort, outcomes, conflicts, rules, confidence FROM recs", _RECS),
    "conflict_reconcile": sql("SELECT * FROM recon", _RECS),
    "design_report": sql("SELECT n.circuit_id, n.n_bottlenecks, n.max_severity, n.tasks, coalesce(r.n, 0) AS n_recommendations, coalesce(r.a, 0) AS n_advisories, r.top_fix FROM (SELECT circuit_id, count(*) AS n_bottlenecks, max(severity) AS max_severity, string_agg(task, ',' ORDER BY severity DESC, task) AS tasks FROM necks GROUP BY circuit_id) n LEFT JOIN (SELECT circuit_id, count(*) AS n, count(*) FILTER (clashing <> '') AS a, arg_min(fix, (-adjusted, task, fix)) AS top_fix FROM recon GROUP BY circuit_id) r USING (circuit_id)", _RECS),
    "bottleneck_rules": sql("SELECT circuit_id, rank, task, severity FROM ranked WHERE rank <= 5", _ADVISOR),
    "advice_templates": sql("SELECT circuit_id, rank, '[' || task || '] ' || tip AS advice, round(1e0 - 0.5e0 * severity, 2) AS confidence FROM ranked JOIN tips USING (task) WHERE rank <= 5", _ADVISOR),
    "scenario_builder": sql("SELECT role, slot, circuit_id, violation, severity FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY (circuit_id * 7919) % 10007, circuit_id) AS slot FROM (SELECT *, CASE task WHEN 'slack' THEN 'timing' WHEN 'drc' THEN 'drc' ELSE 'placement' END AS role FROM necks)) WHERE slot <= 40", _RECS),
    "nl_spec_parse": f"SELECT event_id AS id, ['two_stage_opamp', 'folded_cascode', 'diff_pair', 'current_mirror', 'two_stage_opamp', 'common_source_amp'][{_KIND} + 1] AS topology, CASE {_KIND} WHEN 0 THEN 2 WHEN 4 THEN {_Y} ELSE 1 END::BIGINT AS num_stages, CASE {_KIND} WHEN 0 THEN 'miller' WHEN 4 THEN 'nested miller' ELSE 'none' END AS compensation, CASE {_KIND} WHEN 1 THEN '45nm' WHEN 5 THEN {_X} || 'nm' ELSE '130nm' END AS process_node, CASE WHEN {_KIND} IN (0, 1) THEN {_X}::DOUBLE END AS gain_db, CASE {_KIND} WHEN 0 THEN {_Y}::DOUBLE WHEN 1 THEN {_Y} * 1000e0 WHEN 4 THEN {_Y}::DOUBLE END AS gbw_mhz, CASE {_KIND} WHEN 1 THEN 60e0 END AS phase_margin_deg, CASE {_KIND} WHEN 4 THEN {_X}::DOUBLE END AS slew_rate_v_us, CASE {_KIND} WHEN 2 THEN {_Y} + 0.5e0 END AS power_mw FROM events",
    "bench_parse": sql(f"SELECT circuit_id::VARCHAR AS name, kind, out, func, array_to_string(ins, ',') AS ins FROM ({_BENCH})", _TEXT),
    "verilog_parse": sql("SELECT circuit_id::VARCHAR AS name, 'input' AS kind, 's' || idx AS out, '' AS func, '' AS ins FROM rows_ WHERE role = 'PI' UNION ALL SELECT circuit_id::VARCHAR, 'output', 'o' || idx, '', '' FROM rows_ WHERE role = 'PO' UNION ALL SELECT circuit_id::VARCHAR, 'gate', 'o' || idx, 'BUF', p[1] FROM rows_ WHERE role = 'PO' UNION ALL SELECT circuit_id::VARCHAR, 'gate', 's' || idx, CASE WHEN len(p) = 1 THEN 'NOT' ELSE ['AND', 'NAND', 'OR', 'NOR', 'XOR', 'XNOR'][idx % 6 + 1] END, array_to_string(p, ',') FROM rows_ WHERE role = 'GATE'", _TEXT),
    "epfl_parse": sql(_ASSIGN, _TEXT),
    "gate_decompose": f"SELECT 'o' || p_partkey AS gate, CASE WHEN {_ONE} THEN 1 ELSE {_K} - 1 + {_NEG}::INT END::BIGINT AS cells, CASE WHEN {_ONE} THEN {_K} ELSE 2 * ({_K} - 1) + {_NEG}::INT END::BIGINT AS pins, CASE WHEN NOT {_ONE} AND {_NEG} THEN 1 ELSE 0 END::BIGINT AS inverters FROM part",
    "netlist_wire": sql("SELECT w.circuit_id::VARCHAR AS name, d.drv, w.idx AS snk FROM wires w JOIN first_driver d ON d.circuit_id = w.circuit_id AND d.signal = w.signal", f"{_TEXT}, {_WIRED}"),
}
