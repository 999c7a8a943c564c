"""Gradients, training, stored models, attention in blocks, stored indexes, cones, numbers and generators."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.operators import analog_nets, attention, cones, fitting, generate, layers, messages, network, numbering, timing, vectors
from netloom.operators.index import CELLS, TextStore, VectorIndex, _children
from netloom.operators.netlist import Netlist, placed
from netloom.plans import network_queries as plans

TASKS = ["arrival_time", "required_time", "slack", "critical", "congestion", "drc"]
GRAPH = pa.schema([("circuit_id", pa.int64()), ("n", pa.int32()), ("x", pa.list_(pa.float64())), ("drv", pa.list_(pa.int32())), ("snk", pa.list_(pa.int32())), ("e", pa.list_(pa.float64())), ("y", pa.list_(pa.float64())), ("clock", pa.float64())])


def graph_rows(count, seed=1):
    """Small circuits, one of them without edges."""
    rng, rows = np.random.default_rng(seed), []
    for c in range(count):
        n = int(rng.integers(4, 12))
        edges = [] if c == 1 else [(int(rng.integers(0, k)), k) for k in range(1, n) for _ in range(2)]
        y = rng.random((n, 6))
        y[:, [3, 5]] = y[:, [3, 5]] > 0.5
        rows.append({"circuit_id": c, "n": n, "x": rng.normal(size=n * 5).tolist(), "drv": [a for a, _ in edges], "snk": [b for _, b in edges], "e": rng.random(len(edges) * 2).tolist(), "y": y.ravel().tolist(), "clock": float(rng.random())})
    return rows


def small_model(seed=3):
    rng, params = np.random.default_rng(seed), network.initial(5, 2, 4, TASKS, seed)
    params = {k: v + rng.normal(size=v.shape) * 0.2 for k, v in params.items()}
    scale = {"x_mean": np.full(5, 0.1), "x_std": np.full(5, 1.3), "y_mean": np.array([0.1, 0.2, 0.3]), "y_std": np.array([0.5, 0.7, 0.9]), "clock_mean": 0.3, "clock_std": 0.4, "positive": {"critical": 3.0}}
    return fitting.Model(network.Network(params, TASKS, 3, scale), list("abcde"), list("fg"), 4)


WEIGHTS = {t: 0.5 + 0.3 * k for k, t in enumerate(TASKS)} | {"clock_period": 0.7}


def test_gradients_equal_finite_differences():
    model = small_model()
    net, batch = model.network, network.Batch(pa.RecordBatch.from_pylist(graph_rows(3), GRAPH), 5, 2, 6)
    loss = lambda: sum(WEIGHTS[k] * v for k, v in net.loss(batch, WEIGHTS, 20, 3, 8.0, False)[0].items())
    g = net.loss(batch, WEIGHTS, 20, 3, 8.0)[1]
    for name, values in net.p.items():
        for at in np.ndindex(values.shape):
            own = values[at]
            values[at] = own + 1e-6
            more = loss()
            values[at] = own - 1e-6
            less = loss()
            values[at] = own
            assert abs((more - less) / 2e-6 - g[name][at]) < 1e-5, (name, at)


def test_every_driver_gets_a_gradient():
    """The soft maximum of training sends a gradient to all drivers, the hard one of use is the maximum."""
    way = network.Direction(np.array([1, 2]), np.array([0, 0]))
    u = np.array([[0.0, 0.0], [1.0, 2.0], [2.0, 1.0]])
    out, tape = way.sweep(u, np.zeros((2, 2)), 2.0)
    before, _ = way.back(np.array([[1.0, 1.0], [0.0, 0.0], [0.0, 0.0]]), tape)
    assert (before[1:] > 0).all() and np.allclose(before[1:].sum(0), 1.0)
    assert np.array_equal(way.sweep(u, np.zeros((2, 2)), None)[0][0], [2.0, 2.0]) and (out[0] >= 2.0).all()


def _plain_sweeps(source, target, u, term, beta, sweeps):
    for _ in range(sweeps):
        out = u.copy()
        for v in set(target.tolist()):
            z = u[source[target == v]] + term[target == v]
            top = z.max(0)
            if beta is not None:
                top = top + np.log(np.exp(beta * (z - top)).sum(0)) / beta
            out[v] = np.maximum(u[v], top)
        u = out
    return u


def test_sweeps_look_at_no_settled_node_again():
    """Looking only at nodes that a sweep can change and that matter at the end gives what looking at all in every sweep gives,
    and the same gradients, on chains longer and shorter than the sweeps, hubs, and on, behind and in front of cycles."""
    rng, looked = np.random.default_rng(8), {}
    random_ = [(int(rng.integers(max(0, k - 4), k)), k) for k in range(1, 40) for _ in range(3)]
    shapes = {"chain": [(k, k + 1) for k in range(30)], "short": [(0, 1), (1, 2), (0, 2)], "hub": [(k, 40) for k in range(40)] + [(40, 41)], "cycle": [(0, 1), (1, 2), (2, 3), (3, 1), (3, 4), (5, 4), (4, 6)], "random": random_}
    for name, pairs in shapes.items():
        source, target = np.array(pairs).T
        n = int(target.max()) + 1
        u, term, weight = rng.normal(size=(n, 3)), rng.normal(size=(len(pairs), 3)) * 0.3, rng.normal(size=(n, 3))
        for sweeps in (1, 4, 16):
            way = network.Direction(source, target)

            def run(u, term, beta=4.0):
                tapes = []
                for k in range(1, sweeps + 1):
                    u, tape = way.sweep(u, term, beta, k, sweeps)
                    tapes.append(tape)
                return u, tapes

            for beta in (None, 4.0, 900.0):
                assert np.allclose(run(u, term, beta)[0], _plain_sweeps(source, target, u, term, beta, sweeps), rtol=0, atol=1e-12), (name, sweeps, beta)
            out, tapes = run(u, term)
            looked[name, sweeps], g, g_term = sum(len(node) for tape in tapes for node, *_ in tape), weight, np.zeros_like(term)
            while tapes:
                g, sent = way.back(g, tapes.pop())
                for place, s in sent:
                    g_term[place] += s
            for x, gx in ((u, g), (term, g_term)):
                for at in random.Random(1).sample(list(np.ndindex(x.shape)), 6):
                    own, d = x[at], []
                    for move in (1e-6, -1e-6):
                        x[at] = own + move
                        d.append((_plain_sweeps(source, target, u, term, 4.0, sweeps) * weight).sum())
                    x[at] = own
                    assert abs((d[0] - d[1]) / 2e-6 - gx[at]) < 1e-5, (name, sweeps, at)
    assert looked["short", 16] == 2 and looked["hub", 16] == 2 and looked["chain", 16] <= 30 * 16 / 2


def test_a_model_is_judged_in_the_job_of_the_next_step(spark, monkeypatch):
    nodes, edges = _tables(spark, 8)
    graphs = fitting.graphs(nodes, edges, ["f0", "f1"], ["e0"], ["slack"])
    asked, sums = [], fitting.Model._sums
    monkeypatch.setattr(fitting.Model, "_sums", lambda model, parts, weights: asked.append(len(parts)) or sums(model, parts, weights))
    model, history = fitting.fit(graphs, graphs, nodes, ["f0", "f1"], ["e0"], ["slack"], hidden=2, sweeps=2, epochs=4, rate=0.01)
    assert asked == [1, 2, 2, 2, 1] and [h["epoch"] for h in history] == [1, 2, 3, 4]
    weights = {"slack": 3.0, "clock_period": 0.5}
    losses = model.sums(graphs, weights, nodes.count(), 8, None, gradient=False)[0]
    assert abs(sum(weights[k] * v for k, v in losses.items()) - min(h["validation"] for h in history)) < 1e-9


def _spark_rows(spark, rows, parts):
    return spark.createDataFrame(rows, fitting.GRAPH).repartition(parts, "circuit_id")


def test_spark_sums_what_one_batch_gives(spark):
    rows, model = graph_rows(7), small_model()
    whole = network.Batch(pa.RecordBatch.from_pylist(rows, GRAPH), 5, 2, 6)
    losses, g = model.network.loss(whole, WEIGHTS, 50, 7, 8.0)
    for parts in (1, 3, 20):
        got, flat = model.sums(_spark_rows(spark, rows, parts), WEIGHTS, 50, 7, 8.0)
        assert np.allclose(flat, model.flat(g), atol=1e-6) and all(abs(got[k] - losses[k]) < 1e-6 for k in losses)
    assert model.sums(_spark_rows(spark, rows, 2), WEIGHTS, 50, 7, None, gradient=False)[1] is None
    assert model.sums(_spark_rows(spark, [], 2), WEIGHTS, 1, 1, None, gradient=False)[0]["slack"] == 0.0


def _tables(spark, count=24, seed=5):
    """Circuits whose targets follow from their features and edges; node numbers have gaps."""
    rng, nodes, edges = random.Random(seed), [], []
    for c in range(count):
        n, at = rng.randrange(6, 15), {}
        for k in range(n):
            f = [float(k < 2), rng.random()]
            at[k] = 0.0
            for d in {rng.randrange(k) for _ in range(2)} if k >= 2 else ():
                e = rng.random()
                edges.append((c, 10 * d, 10 * k, e))
                at[k] = max(at[k], at[d] + e)
            nodes.append((c, 10 * k, *f, at[k], 2.0 - at[k], 2.0 - 2 * at[k], float(at[k] > 1.0), 2.0))
    return spark.createDataFrame(nodes, "circuit_id long, idx long, f0 double, f1 double, arrival_time double, required_time double, slack double, critical double, clock double"), spark.createDataFrame(edges, "circuit_id long, drv long, snk long, e0 double")


def test_training_lowers_the_loss_and_comes_back_from_disk(spark, tmp_path):
    nodes, edges = _tables(spark)
    tasks = TASKS[:4]
    graphs = fitting.graphs(nodes, edges, ["f0", "f1"], ["e0"], tasks)
    assert graphs.agg(F.sum("n")).first()[0] == nodes.count() and graphs.agg(F.sum(F.size("drv"))).first()[0] == edges.count()
    train, held = graphs.where("circuit_id % 4 <> 0"), graphs.where("circuit_id % 4 = 0")
    model, history = fitting.fit(train, held, nodes.where("circuit_id % 4 <> 0"), ["f0", "f1"], ["e0"], tasks, hidden=6, sweeps=5, epochs=30, rate=0.03, layer_decay=0.9, path=str(tmp_path / "model"))
    assert history[-1]["train"] < 0.6 * history[0]["train"]
    best = min(history, key=lambda h: h["validation"])
    again = fitting.Model.load(spark, str(tmp_path / "model"))
    one, two = (sorted(map(tuple, m.predict(held).collect())) for m in (model, again))
    assert np.allclose(one, two) and len(one) == held.agg(F.sum("n")).first()[0]
    assert all(r.flag_critical == (r.pred_critical > 0.85) for r in again.flagged(held).collect())
    losses = again.sums(held, {t: 1.0 for t in tasks}, 1, 1, None, gradient=False)[0]
    assert best["validation"] < history[0]["validation"] and all(v >= 0 for v in losses.values())
    both = model.predict(held).join(nodes.withColumn("idx", F.expr("idx div 10")), ["circuit_id", "idx"])
    assert both.count() == len(one) and both.agg(F.corr("pred_arrival_time", "arrival_time")).first()[0] > 0.5


def test_early_stop_batches_and_size_filter(spark):
    nodes, edges = _tables(spark, 10)
    graphs = fitting.graphs(nodes, edges, ["f0", "f1"], ["e0"], ["slack"], least=8, most=12)
    assert {r.n for r in graphs.collect()} <= set(range(8, 13)) and graphs.count() > 0
    _, history = fitting.fit(graphs, graphs, nodes, ["f0", "f1"], ["e0"], ["slack"], hidden=2, sweeps=1, epochs=12, patience=2, rate=5.0, batches=2)
    assert len(history) < 12  # so great a rate does not get better for long
    with pytest.raises(ValueError, match="drc"):
        fitting.graphs(nodes, edges, ["f0"], ["e0"], ["slack", "drc"])
    with pytest.raises(ValueError):
        network.register_head("x", 5, "ns")
    network.register_head("fan", None, "share")
    assert "fan.w1" in network.shapes(2, 1, 3, ["fan"])
    del network.HEADS["fan"]


def test_halves_are_those_of_the_layers(spark):
    """The network's sweeps and the library's message layers give the same arrival half."""
    nodes, edges = _tables(spark, 3)
    model = fitting.Model(network.Network(network.initial(2, 1, 2, ["slack"], 1), ["slack"], 4, {"x_mean": np.zeros(2), "x_std": np.ones(2), "y_mean": np.zeros(3), "y_std": np.ones(3), "clock_mean": 0.0, "clock_std": 1.0, "positive": {}}), ["f0", "f1"], ["e0"], 2)
    p = model.network.p
    p["in.w"], p["in.b"] = np.eye(2), np.zeros(2)
    for k in ("raw.w", "context.w"):
        p[k] = p[k] * 0
    rows = fitting.graphs(nodes, edges, ["f0", "f1"], ["e0"], ["slack"]).toArrow()
    want = {}
    v = nodes.select("circuit_id", "idx", F.array("f0", "f1").alias("v"))
    for r in messages.relax_sweeps(v, edges, 4, 2, term=messages.matrix_term(p["forward.w"].tolist(), ["e0"])).collect():
        want[r.circuit_id, r.idx // 10] = r.v
    for k in range(rows.num_rows):
        batch = network.Batch(rows.slice(k, 1).combine_chunks().to_batches()[0], 2, 1, 1)
        emb = model.network.forward(batch)[2]
        assert np.allclose(emb[:, :2], [want[rows.column("circuit_id")[k].as_py(), i] for i in range(len(emb))], atol=1e-5)


# --- attention ------------------------------------------------------------------------------------------------------


def test_attention_is_the_same_in_blocks_of_any_size(spark):
    rng = np.random.default_rng(2)
    rows = [(c, i, rng.normal(size=8).tolist()) for c, n in ((1, 1), (2, 37), (3, 90)) for i in range(n)]
    df = spark.createDataFrame(rows, attention.VECTORS)
    w = {k: rng.normal(size=(8, 8)) for k in "qkvo"}
    want = {}
    for c in (1, 2, 3):
        x = np.array([r[2] for r in rows if r[0] == c])
        q, k, v = (x @ w[m].T for m in "qkv")
        heads = []
        for h in range(4):
            s = q[:, 2 * h : 2 * h + 2] @ k[:, 2 * h : 2 * h + 2].T / np.sqrt(2)
            e = np.exp(s - s.max(1, keepdims=True))
            heads.append(e / e.sum(1, keepdims=True) @ v[:, 2 * h : 2 * h + 2])
        for i, out in enumerate(np.concatenate(heads, 1) @ w["o"].T):
            want[c, i] = out
    for block in (1, 16, 4096):
        got = {(r.circuit_id, r.idx): r.v for r in attention.global_attention(df, w, 4, block).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want), block
    assert attention.global_attention(df.limit(0), w, 4).count() == 0


def test_edge_attention_by_hand(spark):
    """Two heads, a bias for matched edges, parallel edges weighed apart, and a node without drivers."""
    rng = np.random.default_rng(4)
    v, w = rng.normal(size=(4, 3)), {"l": rng.normal(size=(4, 3)), "r": rng.normal(size=(4, 3)), "e": rng.normal(size=(4, 2)), "a": rng.normal(size=(2, 2)), "symmetry": np.array([1.5, -2.0])}
    edges = [(0, 2, [0.5, 1.0]), (1, 2, [0.25, 0.0]), (1, 2, [0.75, 0.0]), (2, 3, [0.1, 1.0])]
    got = {r.idx: r.v for r in attention.edge_attention(spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(v)], attention.VECTORS), spark.createDataFrame([(1, *e) for e in edges], "circuit_id long, drv long, snk long, e array<double>"), w, 2, matching=1).collect()}
    for node in range(4):
        mine, want = [e for e in edges if e[1] == node], np.zeros(4)
        for h in range(2):
            part, score = slice(2 * h, 2 * h + 2), []
            for a, b, e in mine:
                z = (w["l"] @ v[a] + w["r"] @ v[b] + w["e"] @ np.array(e))[part]
                score.append(float(np.where(z > 0, z, 0.2 * z) @ w["a"][h]) + w["symmetry"][h] * e[1])
            if mine:
                p = np.exp(score) / np.exp(score).sum()
                want[part] = sum(q * (w["l"] @ v[a])[part] for q, (a, _, _) in zip(p, mine))
        assert np.allclose(got[node], want)


def test_fused_embedding_has_the_width_of_the_timing_half(spark, small):
    got = plans.fused_embedding(spark, small)
    assert got.columns == ["circuit_id", "idx", *(f"v{k}" for k in range(6))]
    assert got.where(" OR ".join(f"v{k} IS NULL OR isnan(v{k})" for k in range(6))).count() == 0


# --- stored index ---------------------------------------------------------------------------------------------------


def test_index_grows_is_compacted_and_rebuilt(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    path, q = str(tmp_path / "index"), e.where("vec_id % 20 = 0")
    index = VectorIndex.build(e.where("vec_id % 5 <> 0"), path, "a").add(e.where("vec_id % 5 = 0"))
    assert index.manifest["rows"] == e.count() and len(index.manifest["segments"]) == 2
    exact = {(r.query_id, r.vec_id) for r in vectors.topk(q, e, 5).collect()}
    assert {(r.query_id, r.vec_id) for r in index.search(q, 5, CELLS).collect()} == exact
    found = {(r.query_id, r.vec_id) for r in index.search(q, 5).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    packed = index.compact()
    assert {(r.query_id, r.vec_id) for r in packed.search(q, 5).collect()} == found
    assert VectorIndex.open(spark, path).manifest == packed.manifest
    packed.remove_old()
    assert len([n for n in _children(spark, path) if n.startswith("segment")]) == 1 and VectorIndex.open(spark, path).rows().count() == e.count()
    assert VectorIndex.build(e.limit(3), path, "a").manifest == packed.manifest  # the tag is the same: nothing is built
    assert VectorIndex.build(e.where("vec_id < 50"), path, "b").manifest["rows"] == 50
    assert VectorIndex.build(e.where("vec_id < 60"), path, "b", force=True).manifest["rows"] == 60


def test_only_probed_cells_are_read(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    index = VectorIndex.build(e, str(tmp_path / "index"), "a")
    asked, held = index.candidates(e.where("vec_id = 0"), 2)
    cells = {r.cell for r in asked.select("cell").collect()}
    assert len(cells) == 2 and {f.split("cell=")[1].split("/")[0] for f in held.inputFiles()} >= {str(c) for c in cells}
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.cell for r in held.select("cell").distinct().collect()} == cells


def test_index_replaces_rows_and_takes_odd_ones(spark, tmp_path):
    made = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = VectorIndex.build(made([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0]), (3, None), (4, [0.0, 0.0])]), str(tmp_path / "i"), "a")
    assert {r.vec_id for r in index.rows().collect()} == {1, 2, 4}
    index = index.add(made([(1, [0.0, 2.0]), (1, [0.0, 1.5]), (5, [3.0, 0.1])]))
    assert {r.vec_id: list(r.embedding) for r in index.rows().collect()}[1] == [0.0, 2.0]
    hits = index.search(made([(99, [0.0, 1.0])]), 2, CELLS).collect()
    assert [(r.rank, r.vec_id) for r in hits] == [(1, 1), (2, 2)]
    empty = VectorIndex.build(made([]), str(tmp_path / "e"), "a")
    assert empty.rows().count() == 0 and empty.search(made([(1, [1.0, 0.0])]), 3).count() == 0
    assert VectorIndex.build(made([(7, [1.0, 0.0])]), str(tmp_path / "e"), "a").manifest["rows"] == 1  # an empty one is built anew
    assert VectorIndex.open(spark, str(tmp_path / "none")) is None


def test_text_store_by_vector_and_keyword(spark, tmp_path):
    made = lambda rows: spark.createDataFrame(rows, "key long, text string")
    store = TextStore(spark, str(tmp_path / "t"))
    ask = spark.createDataFrame([(1, "slack violation on critical path")], "query_id long, text string")
    assert store.search(ask, 2).count() == 0
    store.add(made([(1, "critical path slack"), (2, "routing congestion and density"), (None, "x"), (3, None)]))
    store.add(made([(4, "slack violation on the critical path"), (1, "another text under the same key")]))
    assert {r.key: r.text for r in store.texts().collect()} == {1: "critical path slack", 2: "routing congestion and density", 4: "slack violation on the critical path"}
    for method in ("vector", "keyword"):
        assert [r.key for r in store.search(ask, 2, method).orderBy("rank").collect()] == [4, 1], method


# --- cones, numbers and generators ----------------------------------------------------------------------------------


def test_cones_are_circuits(spark):
    nodes, edges = generate.random_digital(spark.createDataFrame([(3, 5, 60, 6), (4, 3, 20, 2)], "seed long, inputs long, gates long, outputs long"))
    cut, inner = cones.cone_circuits(nodes, edges.drop("pin").distinct(), least=4)
    rows, pairs = cut.collect(), {(r.circuit_id, r.drv, r.snk) for r in inner.collect()}
    before = {(r.circuit_id, r.drv, r.snk) for r in edges.collect()}
    ids = sorted({r.circuit_id for r in rows})
    assert ids == list(range(len(ids)))
    for c in ids:
        mine = sorted((r for r in rows if r.circuit_id == c), key=lambda r: r.idx)
        assert [r.idx for r in mine] == list(range(len(mine))) and [r.role for r in mine].count("PO") == 1 and mine[-1].parent_idx == mine[-1].seed
        place = {r.parent_idx: r.idx for r in mine}
        assert {(a, b) for k, a, b in pairs if k == c} == {(place[a], place[b]) for k, a, b in before if k == mine[0].parent and a in place and b in place}
        assert all(any(b == k for _, b in [(a, b) for q, a, b in pairs if q == c]) for k, r in enumerate(mine) if r.role != "PI")
    n = Netlist(placed(cut), inner)
    assert timing.propagate(n.nodes, n.arcs).where("placed").count() == len(rows)
    few = cones.cone_circuits(nodes, edges.drop("pin").distinct(), per_circuit=1, least=4)[0]
    assert few.select("circuit_id").distinct().count() == 2


def test_every_output_has_its_cone(spark):
    """A circuit with more outputs than a chosen 40 has a cone for each."""
    nodes = [(1, k, "PI", "PI") for k in range(4)] + [(1, k, "GATE", "NAND2_X1") for k in range(4, 12)] + [(1, k, "PO", "PO") for k in range(12, 62)]
    edges = [(1, k - d, k) for k in range(4, 12) for d in (1, 2)] + [(1, 8 + k % 4, k) for k in range(12, 62)]
    nodes, edges = spark.createDataFrame(nodes, "circuit_id long, idx long, role string, node_type string"), spark.createDataFrame(edges, "circuit_id long, drv long, snk long")
    cut, inner = cones.cone_circuits(nodes, edges)
    assert sorted(r.seed for r in cut.where("role = 'PO'").collect()) == list(range(12, 62))
    assert sorted(r.circuit_id for r in cut.select("circuit_id").distinct().collect()) == list(range(50)) and inner.select("circuit_id").distinct().count() == 50


@pytest.mark.parametrize("walked", [5000, 50_000])
def test_cones_have_all_their_nodes(spark, monkeypatch, walked):
    """A cone of 12,603 nodes, by joins and in one task, is whole where the first 6,000 end before the inputs, and the network judges it."""
    monkeypatch.setattr(timing, "TASK_NODES", walked)
    wide = 6300
    role = F.when(F.col("idx") < wide, "PI").when(F.col("idx") < 2 * wide + 2, "GATE").otherwise("PO")
    nodes = spark.range(2 * wide + 3).select(F.lit(7).cast("long").alias("circuit_id"), F.col("id").alias("idx")).withColumn("role", role).withColumn("node_type", F.when(role == "GATE", "INV_X1").otherwise(role))
    first = spark.range(wide).select(F.lit(7).cast("long").alias("circuit_id"), F.col("id").alias("drv"), (F.col("id") + wide).alias("snk"))
    gather = spark.range(wide).select(F.lit(7).cast("long").alias("circuit_id"), (F.col("id") + wide).alias("drv"), (2 * wide + F.col("id") % 2).alias("snk"))
    last = spark.range(2).select(F.lit(7).cast("long").alias("circuit_id"), (F.col("id") + 2 * wide).alias("drv"), F.lit(2 * wide + 2).cast("long").alias("snk"))
    cut, inner = cones.cone_circuits(nodes, first.union(gather).union(last))
    assert cut.count() == 2 * wide + 3 and cut.where("role = 'PI'").count() == wide and inner.count() == 2 * wide + 2
    rows = cut.select("circuit_id", "idx", F.lit(1.0).alias("clock"), F.lit(0.5).alias("f0"), F.lit(0.5).alias("slack"))
    assert fitting.graphs(rows, inner.withColumn("e0", F.lit(0.1)), ["f0"], ["e0"], ["slack"], most=None).agg(F.sum("n")).first()[0] == 2 * wide + 3


def test_named_metrics_by_hand(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.5, 0.9, 1), ("a", 2.0, 2.0, 0.2, 0), ("a", 3.0, 2.0, 0.9, 0), ("b", 1.0, 1.0, 0.5, 1)], "name string, p double, t double, s double, y int")
    got = {(r["name"], r.task): r for r in cones.named_metrics(rows, "name", {"x": ("p", "t")}, {"f": ("s", "y")}).collect()}
    mean = (1.5 + 2 + 2) / 3
    assert got["a", "x"].r2 == round(1 - 1.25 / sum((t - mean) ** 2 for t in (1.5, 2, 2)), 6) and got["a", "x"].mae == 0.5
    assert got["a", "f"].auc == 0.75 and got["a", "f"].f1 == round(2 / 3, 6)
    assert got["b", "x"].r2 is None and got["b", "f"].auc is None and got["b", "f"].f1 == 1.0


def test_dense_numbers_over_many_ranges(spark):
    rows = [(i % 7, -i, i % 3) for i in range(500)] + [(None, 5, 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "a long, b long, v long").repartition(9)
    got = {(r.a, r.b): (r.k, r.s) for r in numbering.running(df, ["a", "b"], {"k": "1", "s": "v"}).collect()}
    total = 0
    for k, (a, b, v) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
        assert got[a, b] == (k, total)
        total += v
    assert numbering.numbered(df.limit(0), ["a", "b"]).count() == 0


def test_weights_are_drawn_as_by_brute_force():
    """The tree finds what adding up the weights finds, also while they change."""
    rng = random.Random(6)
    tree, weights = generate.Fenwick(37), [0] * 37
    for _ in range(2000):
        k, w = rng.randrange(37), rng.randrange(5)
        tree.put(k, w)
        weights[k] = w
        assert tree.total == sum(weights)
        if tree.total:
            target = rng.randrange(tree.total)
            total = 0
            for at, v in enumerate(weights):
                total += v
                if total > target:
                    break
            assert tree.find(target) == at


def plain_circuit(seed, inputs, gates, outputs, most, pins):
    """As wire_circuit(), with lists of weights added up at each draw."""
    rng, fan = random.Random(f"{seed} {inputs} {gates} {outputs}"), [0] * (inputs + gates)
    cells, drivers = [], []
    for g in range(inputs, inputs + gates):
        cells.append(rng.randrange(len(pins)))
        left, chosen = list(range(g)), []
        for _ in range(pins[cells[-1]]):
            if g < pins[cells[-1]]:
                chosen.append(rng.randrange(g))
                continue
            w = [max(1, 10 * (most - fan[k])) for k in left]
            target = rng.randrange(sum(w))
            chosen.append(left.pop(next(i for i in range(len(w)) if sum(w[: i + 1]) > target)))
        for k in chosen:
            fan[k] += 1
        drivers.append(chosen)
    late = list(range(inputs + max(0, gates - 3 * outputs), inputs + gates))
    ends = rng.sample(late, min(outputs, len(late)))
    while len(ends) < outputs:
        ends.append(inputs + rng.randrange(gates))
    return cells, drivers + [[k] for k in ends]


@pytest.mark.parametrize("sizes", [(8, 30, 4), (1, 12, 2), (2, 1, 3), (5, 200, 7)])
def test_random_circuits(sizes):
    pins = [1, 2, 2, 3]
    for seed in range(5):
        got = generate.wire_circuit(seed, *sizes, 4, pins)
        assert got == plain_circuit(seed, *sizes, 4, pins)
        drivers = got[1]
        assert all(max(d, default=-1) < sizes[0] + k for k, d in enumerate(drivers))  # only nodes before it: no cycle


def test_fan_out_stays_low(spark):
    """A weighted draw leaves fewer signals without a sink, and lower peaks, than an even one."""
    pins = [2]
    fan = np.bincount([k for d in generate.wire_circuit(1, 10, 3000, 10, 4, pins)[1] for k in d], minlength=3010)
    even = np.bincount([k for d in generate.wire_circuit(1, 10, 3000, 10, 0, pins)[1] for k in d], minlength=3010)  # all weigh least
    assert fan.mean() < 2.1 and fan.max() <= 8 < even.max() and (fan == 0).sum() < (even == 0).sum()
    nodes, edges = generate.random_digital(spark.createDataFrame([(9, 4, 10, 2)] * 1, "seed long, inputs long, gates long, outputs long"), allowed=["INV_X1"])
    assert {r.node_type for r in nodes.where("role = 'GATE'").collect()} == {"INV_X1"} and edges.count() == 12
    with pytest.raises(ValueError):
        generate.random_digital(nodes, allowed=["NO_SUCH"])


@pytest.mark.parametrize("topology", list(analog_nets.TOPOLOGIES))
def test_analog_topologies(spark, topology):
    nodes, pins = analog_nets.analog_circuits(spark.createDataFrame([(0,), (42,)], "seed long"), topology)
    rows = nodes.collect()
    devices = [r for r in rows if r.role == "GATE"]
    assert devices and all(r.device for r in devices) and all(r.device is None for r in rows if r.role != "GATE")
    held = pins.groupBy("circuit_id", "net").agg(F.sum(F.col("is_driver").cast("int")).alias("d"), F.count("*").alias("n")).collect()
    assert held and all(r.d == 1 and r.n >= 2 for r in held)
    by = {}
    for r in devices:
        if r.symmetry:
            by.setdefault((r.circuit_id, r.symmetry), []).append(r.w)
    assert all(len(w) == 2 and w[0] == w[1] for w in by.values()) and (by or topology == "common_source_amp")
    base = {r[2]: r[7] for r in analog_nets.node_rows() if r[0] == topology}
    assert all(abs(r.w / base[r.name] - 1) <= 0.2 + 1e-9 for r in devices if r.w)
    edges = analog_nets.net_edges(pins)
    assert edges.count() == pins.where("NOT is_driver").count() >= analog_nets.net_edges(pins, False).count()
    assert timing.levels(nodes, edges).where("level < 0").count() == 0


def test_analog_errors_and_repeated_nets(spark):
    seeds = spark.createDataFrame([(1,)], "seed long")
    with pytest.raises(ValueError, match="nonsense"):
        analog_nets.analog_circuits(seeds, "nonsense")
    pins = spark.createDataFrame([(1, n, i, i == 0, i) for n in (0, 1) for i in (0, 1)], "circuit_id long, net long, idx long, is_driver boolean, place long")
    assert analog_nets.net_edges(pins).count() == 2 and analog_nets.net_edges(pins, False).count() == 1
