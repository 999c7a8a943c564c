"""Readers, sinks, walks and training helpers beyond what the registered queries compare with SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.config import RunConfig
from netloom.operators import timing, training, vectors
from netloom.sources import netlists, stores


def statements(df):
    return {(r.kind, r.out, r.func, tuple(r.ins)) for r in df.collect()}


def test_files_to_statements(spark, tmp_path):
    """Files of each dialect by their reader; excluded folders, names and the limit are left out."""
    (tmp_path / "sub").mkdir()
    (tmp_path / "ISCAS89").mkdir()
    (tmp_path / "a.bench").write_text("INPUT(x)\nOUTPUT(y)\ny = NOT(x)\n")
    (tmp_path / "sub" / "b.v").write_text("module b (p, q); input p; output q; not N1 (q, p); endmodule")
    (tmp_path / "sub" / "c.v").write_text("module c(\\p[1] , q); input \\p[1] ; output q; assign q = (~\\p[1] ) | (\\p[1] & r); endmodule")
    (tmp_path / "d.bench").write_text("INPUT(no)\n")
    (tmp_path / "ISCAS89" / "e.bench").write_text("INPUT(no)\n")
    found = netlists.files(spark, str(tmp_path), names=("d",))
    assert {(r.name, r.kind) for r in found.collect()} == {("a", "bench"), ("b", "v"), ("c", "v")}
    assert netlists.files(spark, str(tmp_path), limit=2).count() == 2
    rows = netlists.parse_any(found)
    assert statements(rows.where("name = 'a'")) == {("input", "x", None, ()), ("output", "y", None, ()), ("gate", "y", "NOT", ("x",))}
    assert statements(rows.where("name = 'b'")) == {("input", "p", None, ()), ("output", "q", None, ()), ("gate", "q", "NOT", ("p",))}
    assert {r.func for r in rows.where("name = 'c' AND kind = 'gate'").collect()} == {"NOT", "OR"}
    assert rows.where("name = 'c' AND kind = 'input'").first().out == "p_1"


def test_wide_gates_and_ports(spark):
    """No pin and no port is lost, however many there are."""
    pins = ", ".join(f"i{k}" for k in range(12_000))
    text = f"module w ({pins}, y); input {pins}; output y; nand ({'y, ' + pins}); endmodule"
    rows = netlists.parse_verilog(spark.createDataFrame([("w", text)], "name string, text string"))
    assert rows.where("kind = 'gate'").select(F.size("ins")).first()[0] == 12_000
    assert rows.where("kind = 'input'").select("seq").distinct().count() == 12_000


def test_large_circuits_walk_alike(spark, monkeypatch):
    """Cones by joins are those of one task; timing by joins is that of one task."""
    rng = np.random.default_rng(4)
    pairs = sorted({(int(rng.integers(max(0, k - 5), k)), k) for k in range(1, 60) for _ in range(2)})
    edges = spark.createDataFrame([(c, a, b) for c in (1, 2) for a, b in pairs], "circuit_id long, drv long, snk long")
    seeds = spark.createDataFrame([(1, 59), (1, 30), (2, 7)], "circuit_id long, idx long")
    one = {tuple(r) for r in timing.fanin_cones(edges, seeds).collect()}
    monkeypatch.setattr(timing, "TASK_NODES", 10)
    assert {tuple(r) for r in timing.fanin_cones(edges, seeds).collect()} == one and one
    sizes = timing.fanin_cones(edges, seeds, most=5).groupBy("circuit_id", "seed").count().collect()
    assert all(r["count"] >= 5 for r in sizes) and max(r["count"] for r in sizes) < 40


def test_index_recall(spark):
    """At least nine tenths of the exact neighbours, over more rows than the index has cells."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = e.where("vec_id % 20 = 0")
    assert e.count() > 1000
    exact = {(r.query_id, r.vec_id) for r in vectors.topk(q, e, 5).collect()}
    found = {(r.query_id, r.vec_id) for r in vectors.ivf_topk(q, e, 5).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and vectors.ivf_topk(q.limit(0), e.limit(0), 5).count() == 0


def test_stores(spark, tmp_path):
    assert stores.load_dataset(spark, str(tmp_path / "none"), 9) is None
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k long, v string")
    merged = stores.upsert(stores.upsert(old, new, ["k"]), new, ["k"])
    assert {tuple(r) for r in merged.collect()} == {(1, "a"), (2, "c"), (3, None)}
    assert stores.filled("{k}-{v}", new, ["k", "v"]).orderBy("k").first().line == "2-c"


def test_training_helpers(spark):
    rows = spark.createDataFrame([(e, x) for e, x in enumerate((5.0, 4.0, 4.5, 4.2, 4.1, 3.0), 1)], "epoch long, loss double")
    assert tuple(training.best_epoch(rows, 3).first()) == (2, 4.0, 5) and tuple(training.best_epoch(rows, 9).first()) == (6, 3.0, None)
    with pytest.raises(ValueError, match="drc"):
        training.check_targets(rows, ["loss", "drc"])
    with pytest.raises(ValueError):
        RunConfig(tasks=("slack", "drc")).validate()
    with pytest.raises(ValueError):
        RunConfig(node_features=0).validate()
    assert RunConfig(layers=2).validate().depth() == 4 and RunConfig().depth() == 6
    assert training.schedule(spark, 1, 0).first().beta == 1000.0
