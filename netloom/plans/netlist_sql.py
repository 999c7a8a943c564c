"""The derived netlist and its timing as common table expressions, for the SQL that checks the DataFrame queries."""

from ..functions.library import CELLS_SQL

CTES = f"""
base AS (SELECT user_id AS circuit_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events),
roles AS (SELECT *, CASE WHEN idx < 4 THEN 'PI' WHEN idx >= n - 3 THEN 'PO' ELSE 'GATE' END AS role, greatest(6, floor(sqrt(n::DOUBLE) * 1.6e0))::BIGINT AS side FROM base WHERE n >= 12),
slots AS (SELECT r.*, (event_id * 7919) % ((side - 2) * side) AS slot, c.cell_idx, c.cell, c.intrinsic_delay, c.input_cap, c.output_res, c.num_inputs FROM roles r LEFT JOIN {CELLS_SQL} c ON r.role = 'GATE' AND c.cell_idx = r.event_id % 19),
nodes AS (SELECT circuit_id, idx, event_id, n, role, coalesce(cell, role) AS node_type, side,
  CASE role WHEN 'PI' THEN 0 WHEN 'PO' THEN side - 1 ELSE 1 + slot // side END::BIGINT AS x,
  CASE role WHEN 'PI' THEN idx * side // 4 WHEN 'PO' THEN (idx - n + 3) * side // 3 ELSE slot % side END::BIGINT AS y,
  cell_idx, intrinsic_delay, input_cap, output_res, num_inputs FROM slots),
edges AS (SELECT DISTINCT circuit_id, idx - 1 - (event_id * 7 + 3 * p) % greatest(1, least(idx, 8)) AS drv, idx AS snk FROM nodes, range(0, 3) AS r(p) WHERE role = 'GATE' AND p < num_inputs
  UNION SELECT circuit_id, n - 4 - event_id % 4, idx FROM nodes WHERE role = 'PO'),
pins AS (SELECT e.*, d.x AS dx, d.y AS dy, s.x AS sx, s.y AS sy, CASE WHEN s.role = 'PO' THEN 2e0 ELSE coalesce(s.input_cap, 2e0) END AS pin_cap FROM edges e JOIN nodes d ON d.circuit_id = e.circuit_id AND d.idx = e.drv JOIN nodes s ON s.circuit_id = e.circuit_id AND s.idx = e.snk),
nets AS (SELECT circuit_id, drv, 2e0 + 2e0 * max(abs(dx - sx) + abs(dy - sy)) AS wire_length_um, count(*) AS fanout, sum(pin_cap) AS pin_cap_sum, least(min(dx), min(sx)) AS x0, greatest(max(dx), max(sx)) AS x1, least(min(dy), min(sy)) AS y0, greatest(max(dy), max(sy)) AS y1 FROM pins GROUP BY circuit_id, drv),
loads0 AS (SELECT n.circuit_id, n.idx, n.role, n.node_type, n.intrinsic_delay, n.output_res, coalesce(t.pin_cap_sum, 0e0) + 0.00017e0 * coalesce(t.wire_length_um, CASE WHEN n.role = 'PO' THEN 0e0 ELSE 2e0 END) AS load_cap FROM nodes n LEFT JOIN nets t ON t.circuit_id = n.circuit_id AND t.drv = n.idx),
loads AS (SELECT circuit_id, idx, role, node_type, load_cap, CASE WHEN role = 'GATE' THEN intrinsic_delay + output_res * load_cap * 1e-6 ELSE 0e0 END AS gate_delay FROM loads0),
arcs AS (SELECT p.circuit_id, p.drv, p.snk, 0.12e0 * wire_length_um * (0.00017e0 * wire_length_um / 2e0 + pin_cap) * 1e-3 AS wire_delay, a.gate_delay + 0.12e0 * wire_length_um * (0.00017e0 * wire_length_um / 2e0 + pin_cap) * 1e-3 AS fwd, b.gate_delay + 0.12e0 * wire_length_um * (0.00017e0 * wire_length_um / 2e0 + pin_cap) * 1e-3 AS bwd, abs(dx - sx) + abs(dy - sy) AS manhattan, fanout, pin_cap
  FROM pins p JOIN nets t USING (circuit_id, drv) JOIN loads a ON a.circuit_id = p.circuit_id AND a.idx = p.drv JOIN loads b ON b.circuit_id = p.circuit_id AND b.idx = p.snk),
ins AS (SELECT circuit_id, snk AS idx, list({{'k': drv, 'd': fwd}}) AS p FROM arcs GROUP BY ALL),
outs AS (SELECT circuit_id, drv AS idx, list({{'k': snk, 'd': bwd}}) AS p FROM arcs GROUP BY ALL),
steps AS (SELECT n.circuit_id, n.idx, n.n, ins.p AS i, outs.p AS o FROM nodes n LEFT JOIN ins USING (circuit_id, idx) LEFT JOIN outs USING (circuit_id, idx)),
fwd AS (SELECT DISTINCT circuit_id, 0::BIGINT AS k, []::DOUBLE[] AS ats, []::BIGINT[] AS deps FROM nodes
  UNION ALL SELECT f.circuit_id, f.k + 1, list_append(ats, coalesce(list_max(list_transform(s.i, lambda z: ats[z.k + 1] + z.d)), 0e0)), list_append(deps, coalesce(list_max(list_transform(s.i, lambda z: deps[z.k + 1] + 1)), 0)) FROM fwd f JOIN steps s ON s.circuit_id = f.circuit_id AND s.idx = f.k),
bwd AS (SELECT DISTINCT circuit_id, n AS k, n, []::DOUBLE[] AS sfx FROM nodes
  UNION ALL SELECT b.circuit_id, b.k - 1, b.n, list_append(sfx, coalesce(list_max(list_transform(s.o, lambda z: sfx[b.n - z.k] + z.d)), 0e0)) FROM bwd b JOIN steps s ON s.circuit_id = b.circuit_id AND s.idx = b.k - 1),
timing AS (SELECT n.circuit_id, n.idx, n.role, f.ats[n.idx + 1] AS arrival, f.deps[n.idx + 1] AS depth, b.sfx[n.n - n.idx] AS suffix FROM nodes n JOIN fwd f ON f.circuit_id = n.circuit_id AND f.k = n.n JOIN bwd b ON b.circuit_id = n.circuit_id AND b.k = 0),
clocks AS (SELECT circuit_id, coalesce(max(arrival) FILTER (role = 'PO'), max(arrival)) AS max_at FROM timing GROUP BY circuit_id),
slacks AS (SELECT t.circuit_id, t.idx, t.role, arrival, depth, suffix, max_at, factor, greatest(max_at * factor, 1e-3) AS clock, round(greatest(max_at * factor, 1e-3) - suffix, 13) AS required, round(greatest(max_at * factor, 1e-3) - suffix - arrival, 13) AS slack FROM timing t JOIN clocks USING (circuit_id), (VALUES (1.2e0), (0.95e0)) AS v(factor)),
grid AS (SELECT circuit_id, gx, gy, round(sum(((x1 - x0) + (y1 - y0)) * greatest(fanout, 1) / ((x1 - x0 + 1) * (y1 - y0 + 1))), 9) AS demand FROM (SELECT *, unnest(range(x0, x1 + 1)) AS gx FROM nets WHERE (x1 - x0) + (y1 - y0) > 0) q, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS gy) u GROUP BY circuit_id, gx, gy),
placed AS (SELECT n.circuit_id, n.idx, coalesce(g.demand, 0e0) AS demand FROM nodes n LEFT JOIN grid g ON g.circuit_id = n.circuit_id AND g.gx = n.x AND g.gy = n.y),
labels_ AS (SELECT circuit_id, idx, demand, round(demand / greatest(max(demand) OVER (PARTITION BY circuit_id), 1e-6), 9) AS congestion, (demand > 9e0)::INT::DOUBLE AS drc FROM placed)
"""


def sql(select: str, more: str = "") -> str:
    """A query over the netlist tables; `more` has further table expressions."""
    return f"WITH RECURSIVE {CTES}{', ' + more if more else ''} {select}"
