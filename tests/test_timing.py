"""Invariants of timing, congestion, ingestion and windows on small fixtures."""

import random

import numpy as np
from pyspark.sql import functions as F

from netloom.sources.tables import checkpointed
from netloom.operators import analog, congestion, mapping, messages, timing
from netloom.operators.netlist import Netlist, nodes_from_events
from netloom.sources import netlists
from netloom.sources.tables import table
from netloom.streaming import events as streams


# Small texts of the three dialects.
BENCH = """# small
INPUT(a)
INPUT(b)
INPUT(c)
OUTPUT(y)
n1 = NAND(a, b)
n2 = NOT(c)
n3 = NAND(a, b, c, n1)
q1 = DFF(n3)
y = AND(n2, q1)
junk line
"""
VERILOG = """// two gates
module m (a, b, y);
input a, b; output y;
/* block
comment */ nand NAND2_1 (n1, a,
 b);
not (y, n1);
endmodule
"""
ASSIGNS = """module t ( \\a[0] , \\b , y );
input \\a[0] , \\b ;
output y, z;
assign n1 = ~\\a[0] & \\b ;
assign n2 = n1 | ~\\b ;
assign y = ~n2;
assign z = n1;
endmodule
"""


def _random_graph(spark, seed):
    rng, n = random.Random(seed), 30
    arcs = sorted({(1, rng.randrange(j), j) for j in range(4, n) for _ in range(2)})
    rows = [(c, a, b, rng.random(), rng.random()) for c, a, b in arcs]
    return spark.createDataFrame([(1, i) for i in range(n)], "circuit_id long, idx long"), spark.createDataFrame(rows, "circuit_id long, drv long, snk long, fwd double, bwd double"), rows, n


def test_three_strategies_agree(spark):
    nodes, arcs, rows, n = _random_graph(spark, 3)
    at, suffix, depth = [0.0] * n, [0.0] * n, [0] * n
    for _, a, b, f, _ in sorted(rows, key=lambda r: r[2]):
        at[b], depth[b] = max(at[b], at[a] + f), max(depth[b], depth[a] + 1)
    for _, a, b, _, w in sorted(rows, key=lambda r: -r[1]):
        suffix[a] = max(suffix[a], suffix[b] + w)
    want = [(i, round(at[i], 9), depth[i], round(suffix[i], 9)) for i in range(n)]
    for method in ("fold", "grouped", "peel"):
        got = sorted((r.idx, round(r.at, 9), r.depth, round(r.suffix, 9)) for r in timing.propagate(nodes, arcs, method).collect())
        assert got == want, method


def test_long_and_large_circuits(spark, monkeypatch):
    """A path of 90 nodes comes whole, and a circuit over the fold's size gets the rows that the fold gives."""
    nodes = spark.createDataFrame([(c, i) for c, n in ((1, 90), (2, 5)) for i in range(n)], "circuit_id long, idx long")
    arcs = spark.createDataFrame([(c, i - 1, i, 0.5, 0.25) for c, n in ((1, 90), (2, 5)) for i in range(1, n)], "circuit_id long, drv long, snk long, fwd double, bwd double")
    folded = checkpointed(timing.propagate(nodes, arcs, "fold"))
    ends = spark.createDataFrame([(1, 89), (2, 4)], "circuit_id long, idx long")
    path = sorted(tuple(r) for r in timing.critical_path(folded, arcs, ends).collect())
    assert path == [(c, k, n - 1 - k) for c, n in ((1, 90), (2, 5)) for k in range(n)]
    few, keep = nodes.where("circuit_id = 2 OR idx < 8"), arcs.where("circuit_id = 2 OR snk < 8")
    monkeypatch.setattr(timing, "TASK_NODES", 6)
    assert sorted(timing.propagate(few, keep).collect()) == sorted(timing.propagate(few, keep, "fold").collect())


def test_cycle_members_stay_unplaced(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(4)], "circuit_id long, idx long")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 1), (1, 2, 3)], "circuit_id long, drv long, snk long")
    assert {r.idx: r.level for r in timing.levels(nodes, edges).collect()} == {0: 0, 1: -1, 2: -1, 3: -1}


def _cyclic(spark, seed):
    """Random arcs in any direction, with a cycle and nodes behind it, and a circuit of arcs without nodes."""
    rng, n = random.Random(seed), 40
    rows = sorted({(1, *sorted(rng.sample(range(n), 2)), rng.random(), rng.random()) for _ in range(45)}) + [(1, 20, 5, 0.5, 0.5), (1, 5, 20, 0.25, 0.5), (1, 33, 33, 0.1, 0.1), (1, 2, 99, 0.1, 0.1), (2, 0, 1, 0.1, 0.1)]
    return spark.createDataFrame([(1, i) for i in range(n)] + [(3, 0)], "circuit_id long, idx long"), spark.createDataFrame(rows, "circuit_id long, drv long, snk long, fwd double, bwd double"), rows, n


def test_cycles_end_and_get_defaults(spark, monkeypatch):
    """By brute force, in one task and by joins."""
    nodes, arcs, rows, n = _cyclic(spark, 5)
    into = {b: [r for r in rows if r[0] == 1 and r[2] == b and r[1] < n] for b in range(n)}
    order = []
    while more := [b for b in range(n) if b not in order and all(r[1] in order for r in into[b])]:
        order += more
    assert 5 not in order and 33 not in order and len(order) > 10
    at, depth, suffix = [0.0] * n, [0] * n, [0.0] * n
    for b in order:
        for _, a, _, f, _ in into[b]:
            at[b], depth[b] = max(at[b], at[a] + f), max(depth[b], depth[a] + 1)
    for b in reversed(order):
        for _, a, _, _, w in into[b]:
            suffix[a] = max(suffix[a], suffix[b] + w)
    want = sorted([(1, i, round(at[i], 9), depth[i], round(suffix[i], 9), i in order) for i in range(n)] + [(3, 0, 0.0, 0, 0.0, True)])
    for size in (2, 5000):
        monkeypatch.setattr(timing, "TASK_NODES", size)
        got = sorted((r.circuit_id, r.idx, round(r.at, 9), r.depth, round(r.suffix, 9), r.placed) for r in timing.propagate(nodes, arcs).collect())
        assert got == want, size
        lev = {(r.circuit_id, r.idx): r.level for r in timing.levels(nodes, arcs).collect()}
        assert lev == {(c, i): d if p else -1 for c, i, _, d, _, p in want}
        timed = checkpointed(timing.propagate(nodes, arcs))
        path = timing.critical_path(timed, arcs, nodes.where("circuit_id = 1")).collect()  # ends although the arcs have cycles
        assert {r.idx for r in path} == set(range(n))


def test_queries_over_cycles_by_joins(spark, small, monkeypatch):
    """All circuits by joins give the rows of one task each."""
    from netloom.plans import ingest_queries

    one = sorted(ingest_queries.cyclic_sta(spark, small).collect())
    monkeypatch.setattr(timing, "TASK_NODES", 2)
    assert sorted(ingest_queries.cyclic_sta(spark, small).collect()) == one


def test_a_long_chain_is_quick(spark):
    """Levels and cones look at each edge once, so a chain is not quadratic."""
    n = 100_000
    a = np.arange(n)
    assert (timing.topological_levels(a[:-1], a[1:], n) == a).all()


def test_stored_tables_can_be_removed(spark):
    from netloom.sources import tables

    df, path = tables.stored(spark.range(5))
    assert df.count() == 5 and path in tables._stored
    tables.remove(spark, path)
    assert path not in tables._stored


def test_derived_netlist_checksums(spark):
    n = Netlist(nodes_from_events(table(spark, "/root/testdata/sf0.01", "events")))
    assert (n.nodes.count(), n.edges.count(), n.nets.count()) == (10_000, 18_800, 8_556)
    fwd, bwd = n.arcs.agg(F.sum("fwd"), F.sum("bwd")).first()
    assert (round(fwd, 5), round(bwd, 5)) == (669.63429, 716.68131)
    t = timing.propagate(n.nodes, n.arcs)
    s = timing.slack(t, n.nodes, (0.95,)).agg(F.round(F.max("at"), 6), F.sum(F.col("is_critical").cast("int")), F.sum((F.col("slack") < 0).cast("int"))).first()
    assert tuple(s) == (1.519369, 7188, 4867)
    labels = congestion.node_labels(n.nodes, congestion.demand_grid(n.nets))
    assert labels.where("drc = 1").count() == 6361
    assert labels.agg(F.min("congestion"), F.max("congestion")).first()[1] == 1.0


def test_parsers_and_wiring(spark):
    small = netlists.parse_bench(netlists.lines(spark.createDataFrame([("s", BENCH)], "name string, text string")))
    assert sorted(r[0] for r in small.select("kind").collect()).count("gate") == 4
    nodes, edges = mapping.wire(small)
    assert nodes.where("role = 'PI'").count() == 4 and nodes.where("role = 'PO'").count() == 2
    assert timing.levels(nodes.select(F.lit(1).alias("circuit_id"), "idx"), edges.select(F.lit(1).alias("circuit_id"), "drv", "snk")).where("level < 0").count() == 0
    texts = spark.createDataFrame([("b", "bench", BENCH), ("v", "v", VERILOG), ("e", "v", ASSIGNS)], "name string, kind string, text string")
    assert {r[0] for r in netlists.parse_any(texts).select("name").distinct().collect()} == {"b", "v", "e"}


def test_netlist_files_round_trip(spark, tmp_path):
    (tmp_path / "x.bench").write_text(BENCH)
    found = netlists.files(spark, str(tmp_path), "*.bench")
    assert found.first()["name"] == "x" and netlists.parse_bench(netlists.lines(found)).count() == 9


def test_wide_gate_tree(spark):
    rows = spark.createDataFrame([("g", 0, "gate", "o", "NAND", list("abcdefg"))], "name string, seq int, kind string, out string, func string, ins array<string>")
    cells = mapping.decompose(rows).collect()
    assert sum(c.cell == "AND2_X1" for c in cells) == 6 and sum(c.cell == "INV_X1" for c in cells) == 1
    assert all(len(c.ins) == 2 for c in cells if c.cell == "AND2_X1")


def test_analog_templates(spark):
    seeds = spark.createDataFrame([(1,), (2,)], "seed long")
    made = analog.generate(spark, list(analog.TEMPLATES), seeds)
    assert made.groupBy("topology", "seed").count().count() == 10
    try:
        analog.generate(spark, ["nonsense"], seeds)
    except ValueError:
        pass
    else:
        raise AssertionError


def test_sweeps_reach_fixed_point(spark, small):
    n = Netlist(nodes_from_events(table(spark, small, "events")))
    v = n.nodes.select("circuit_id", "idx", F.array(*[F.col("idx").cast("double")] * 3).alias("v"))
    assert messages.relax_sweeps(v, n.arcs, 2).count() == n.nodes.count()


def test_stream_equals_batch(spark, small, tmp_path):
    batch = table(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    windows = streams.tumbling(streams.read(spark, str(tmp_path / "in"), batch.schema), "6 hours")
    streams.start(windows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("start", "event_type", "n").collect()}
    want = {tuple(r) for r in streams.tumbling(batch, "6 hours").select("start", "event_type", "n").collect()}
    assert got and got <= want  # windows still open at the end are not appended
