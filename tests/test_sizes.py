"""What grows with the circuits stays out of the driver and is computed once."""

import numpy as np
from pyspark.sql import functions as F

from netloom.operators import attention, heads, index, retrieval, timing
from netloom.plans import circuit_queries, feature_queries, ingest_queries, layer_queries, netlist_queries, network_queries
from netloom.sources import tables
from netloom.sources.tables import checkpointed


def test_stored_rows_are_not_sent_whole(spark, capsys):
    """Some 50 MB of rows that Parquet packs to less than the broadcast threshold."""
    spark.conf.unset("spark.sql.sources.fileCompressionFactor")
    rows = spark.range(0, 1_000_000, 1, 4).select((F.col("id") / 66).cast("long").alias("circuit_id"), (F.col("id") % 66).alias("idx"))
    a, b = checkpointed(rows.withColumn("x", F.col("idx") * 2)), checkpointed(rows.withColumn("y", F.col("idx") * 3))
    a.join(b, ["circuit_id", "idx"]).explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_a_factor_of_the_session_stays(spark):
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "3.0")
    try:
        checkpointed(spark.range(3))
        assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == "3.0"
    finally:
        spark.conf.unset("spark.sql.sources.fileCompressionFactor")


def test_heads_fit_stored_rows(spark):
    rows = spark.createDataFrame([(c, *map(float, range(7)), 1.0) for c in range(20)], ["circuit_id", *heads.FEATURES, "y"])
    assert all(part.inputFiles() for part in heads._split(rows))


def test_small_circuits_share_a_call(spark):
    """Ten circuits of ten nodes, whose numbers overlap, are timed, levelled and walked in a call for each bucket."""
    keys = spark.range(100).select((F.col("id") / 10).cast("long").alias("circuit_id"), (F.col("id") % 10).alias("idx"))
    arcs = keys.where("idx > 0").select("circuit_id", (F.col("idx") - 1).alias("drv"), F.col("idx").alias("snk"), (F.col("circuit_id") + 1.0).alias("fwd"), F.lit(1.0).alias("bwd"))
    grouped = timing.propagate(keys, arcs, "grouped").collect()
    assert sorted((r.circuit_id, r.idx, r.at, r.depth, r.suffix, r.placed) for r in grouped) == [(c, i, i * (c + 1.0), i, 9.0 - i, True) for c in range(10) for i in range(10)]
    assert len({tuple(r) for r in timing.propagate(keys, arcs).collect()} ^ {tuple(r) for r in grouped}) == 0
    levels = timing.levels(keys, arcs)
    assert sorted(map(tuple, levels.collect())) == [(c, i, i) for c in range(10) for i in range(10)]
    walked = timing.fanin_cones(arcs, keys.where("idx IN (4, 9)"))
    assert sorted(map(tuple, walked.collect())) == [(c, s, i) for c in range(10) for s in (4, 9) for i in range(s + 1)]
    for frame in (levels, walked):
        assert "bucket" in frame._jdf.queryExecution().analyzed().toString()


def test_cones_of_some_circuits(spark, small):
    """Cutting the cones of two circuits gives the cones that cutting all gives for them."""
    of = spark.createDataFrame([(3,), (7,)], "circuit_id long")
    members = lambda cut: sorted(map(tuple, cut.members.where("parent IN (3, 7)").select("parent", "seed", "parent_idx", "role").collect()))
    some, every = circuit_queries._cones(spark, small, of)[1], circuit_queries._cones(spark, small)[1]
    assert members(some) == members(every) and some.members.where("parent NOT IN (3, 7)").isEmpty()


def _circuits(spark, sizes, width):
    rng = np.random.default_rng(5)
    nodes = [(c, i, rng.normal(size=width).tolist()) for c, n in sizes.items() for i in range(n)]
    arcs = [(c, i - d, i, rng.normal(size=3).tolist()) for c, n in sizes.items() for i in range(n) for d in (1, 3) if i >= d]
    w = {k: rng.normal(size=(width, width)) for k in ("q", "k", "v", "o", "local1", "local2", "ffn1", "ffn2")} | {"edge": rng.normal(size=(width, 3))}
    return spark.createDataFrame(nodes, attention.VECTORS), spark.createDataFrame(arcs, "circuit_id long, drv long, snk long, e array<double>"), w


def _vectors(rows):
    return {(r.circuit_id, r.idx): r.v for r in rows.collect()}


def _same(a, b):
    return a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


def test_small_circuits_cross_the_shuffle_once(spark, monkeypatch):
    """No node is sent to each block that it meets where a task holds the circuit; blocks and whole circuits give the same."""
    nodes, arcs, w = _circuits(spark, {1: 1, 2: 40, 3: 40, 4: 7}, 4)
    plan = lambda rows: rows._jdf.queryExecution().analyzed().toString()
    whole = attention.global_attention(nodes, w, 2, 8)
    assert "explode" not in plan(whole)
    for most in (0, 10):
        dealt = attention.global_attention(nodes, w, 2, 8, whole=most)
        assert "explode" in plan(dealt) and _same(_vectors(whole), _vectors(dealt))
    monkeypatch.setattr(attention, "WHOLE", 5)  # circuits in strips
    assert _same(_vectors(attention.global_attention(nodes, w, 2, 8, whole=100)), _vectors(whole))
    monkeypatch.undo()
    block = _vectors(attention.gps_block(nodes, arcs, w, 2, 8))
    monkeypatch.setattr(timing, "TASK_NODES", 10)  # some are joined and dealt into blocks
    assert _same(_vectors(attention.gps_block(nodes, arcs, w, 2, 8)), block)


def test_sweeps_and_blocks_read_stored_edges(spark, small, monkeypatch):
    read = []
    sweeps, blocks = layer_queries.messages.relax_sweeps, attention.gps_block
    monkeypatch.setattr(layer_queries.messages, "relax_sweeps", lambda v, arcs, *a, **k: read.append(arcs) or sweeps(v, arcs, *a, **k))
    monkeypatch.setattr(attention, "gps_block", lambda v, arcs, *a, **k: read.append(arcs) or blocks(v, arcs, *a, **k))
    monkeypatch.setattr("netloom.operators.layers.relax_sweeps", layer_queries.messages.relax_sweeps)
    layer_queries.relaxation_sweeps(spark, small), network_queries.fused_embedding(spark, small)
    assert len(read) == 5 and all("Join" not in arcs._jdf.queryExecution().analyzed().toString() for arcs in read)


def test_added_texts_are_tokenised_once(spark, tmp_path, monkeypatch):
    """Vectors come from the stored tokens, in a build and in an add, and equal those of the texts."""
    asked, tokens = [], retrieval.tokens
    monkeypatch.setattr(retrieval, "tokens", lambda *a, **k: asked.append(a) or tokens(*a, **k))
    texts = spark.createDataFrame([(k, f"delay of gate g{k} and gate g{k % 3}") for k in range(40)], "key long, text string")
    store = index.TextStore(spark, str(tmp_path / "t")).add(texts.where("key < 30")).add(texts.where("key >= 30"))
    assert len(asked) == 2
    built = {r.vec_id: list(r.embedding) for r in index.VectorIndex.open(spark, f"{store.path}/vectors").rows().collect()}
    assert built == {r.vec_id: list(r.embedding) for r in index.hashed_vectors(texts, "key").collect()}


def test_cells_are_scored_in_strips(spark, monkeypatch):
    """A task holds a bounded number of scores, however many cells and rows there are."""
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "vec_id long, embedding array<double>").coalesce(1)
    one = index.VectorIndex.__new__(index.VectorIndex)
    one.centres = rng.normal(size=(10, 4))
    held = one._cells(rows, 3)
    monkeypatch.setattr(index, "SCORES", 70)
    strips = one._cells(rows, 3)
    assert sorted(map(tuple, held.select("vec_id", F.concat_ws(" ", "cells")).collect())) == sorted(map(tuple, strips.select("vec_id", F.concat_ws(" ", "cells")).collect()))


def test_wires_cost_one_join(spark, small):
    """Queries that need no delay of nodes join each edge with its driver alone, and tell edges apart without a shuffle."""
    joins = {feature_queries.edge_features: 1, feature_queries.augment_edge_noise: 3, layer_queries.analog_edge_features: 5, layer_queries.edge_sums: 3, layer_queries.message_pass_weighted: 2, feature_queries.message_pass_max: 2, feature_queries.message_pass_min: 2}
    for query, most in joins.items():
        assert query(spark, small)._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= most, query
    assert "Aggregate" not in feature_queries.edge_features(spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_grow_with_the_rows(spark, small, monkeypatch):
    """A large table is dealt over more tasks than the session's shuffles have, with the same rows."""
    queries = feature_queries.edge_features, layer_queries.edge_sums, ingest_queries.bench_nets
    few = [sorted(map(tuple, q(spark, small).collect())) for q in queries]
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    assert netlist_queries.netlist(spark, small).wires.rdd.getNumPartitions() == 20  # of 1,000 nodes; the session has 4
    for query, rows in zip(queries, few):
        many = sorted(map(tuple, query(spark, small).collect()))
        assert [r[:2] for r in many] == [r[:2] for r in rows] and np.allclose(many, rows, atol=2e-6)
