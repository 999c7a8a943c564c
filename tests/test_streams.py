"""Stateful streams against the batch, sketches against exact counts, table functions, property graphs, evidence and replies."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import evidence, mapping, retrieval, sketches, training
from netloom.plans import training_queries
from netloom.sources import stores
from netloom.streaming import summaries

REPORT = "circuit_id long, node long, ts timestamp, report_id long, slack double"


def _reports(rng, n, begin, minutes, first=0):
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.uniform(begin, begin + minutes))
    return [(rng.randrange(4), rng.randrange(6), at(), first + k, round(rng.uniform(-1, 1), 6)) for k in range(n)]


def _rows(df):
    return {r.circuit_id: (r.n, r.n_violations, r.worst_slack, r.worst_node) for r in df.collect()}


def test_stream_with_late_rows_and_a_restart_equals_the_batch(spark, tmp_path):
    """Late reports within the delay count, whatever the order; those behind the watermark do not; a restart goes on."""
    rng = random.Random(3)
    folder, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    first, second = _reports(rng, 60, 0, 30), _reports(rng, 40, 25, 30, 100)
    odd = [(1, None, datetime.datetime(2024, 1, 1), 900, 0.5), (None, 1, datetime.datetime(2024, 1, 1), 901, 0.5), (1, 1, None, 902, 0.5), (1, 1, datetime.datetime(2024, 1, 1), 903, None)]
    too_late = [(0, 5, datetime.datetime(2023, 12, 1), 950, -9.0)]
    stream = lambda: summaries.stream_summaries(spark.readStream.schema(REPORT).parquet(folder), "20 minutes")
    put = lambda rows: spark.createDataFrame(rows, REPORT).coalesce(1).write.mode("append").parquet(folder)
    put(first + odd)
    summaries.keep(stream(), sink, state).awaitTermination()
    assert _rows(summaries.latest(spark, sink)) == _rows(summaries.batch_summaries(spark.createDataFrame(first, REPORT)))
    put(second + too_late)
    summaries.keep(stream(), sink, state).awaitTermination()
    want = _rows(summaries.batch_summaries(spark.createDataFrame(first + second, REPORT)))
    assert _rows(summaries.latest(spark, sink)) == want
    summaries.keep(stream(), sink, state).awaitTermination()  # nothing new
    assert _rows(summaries.latest(spark, sink)) == want
    put([(9, 0, datetime.datetime(2024, 1, 2), 999, 0.1)])
    summaries.keep(stream(), sink, state).awaitTermination()
    put([(9, 0, datetime.datetime(2024, 1, 2, 1), 1000, 0.2)])
    summaries.keep(stream(), sink, state).awaitTermination()
    assert {r.circuit_id for r in summaries.latest(spark, sink).where("idle").collect()} == {0, 1, 2, 3}  # silent while the watermark went a day on


def test_sketches_roll_up_within_their_bounds(spark):
    rng = random.Random(5)
    rows = [(k % 5, f"i{rng.randrange(20_000)}", rng.gauss(0, 1)) for k in range(60_000)] + [(0, None, None)]
    df = spark.createDataFrame(rows, "source int, item string, value double")
    stored = sketches.sketches(df, ["source"], "item", "value")
    all_of = sketches.rolled_up(stored.withColumn("all", F.lit(1)), ["all"])
    got = sketches.estimates(all_of, ["all"], (0.1, 0.5, 0.99)).first()
    distinct, values = len({r[1] for r in rows if r[1]}), sorted(r[2] for r in rows if r[2] is not None)
    assert got.n == len(rows) and abs(got.distinct / distinct - 1) < 0.05
    for share, q in ((0.1, got.q10), (0.5, got.q50), (0.99, got.q99)):
        assert abs(sum(v <= q for v in values) / len(values) - share) < 0.03
    each = sketches.estimates(stored, ["source"]).collect()
    assert len(each) == 5 and all(abs(r["distinct"] / len({x[1] for x in rows if x[0] == r.source and x[1]}) - 1) < 0.08 for r in each)


def test_table_function_gives_the_cells_of_the_fold(spark):
    rows = [("g", 0, "gate", f"o{f}{k}", f, [f"i{j}" for j in range(k)]) for f in ("NAND", "AND", "XOR", "NOR", "XNOR", "OR", "NOT", "BUFF", "nand") for k in (1, 2, 3, 4, 5, 8, 13)]
    gates = spark.createDataFrame(rows, "name string, seq int, kind string, out string, func string, ins array<string>")
    flat = lambda df: sorted((r.gate, r.cell_no, r.cell, r.out, tuple(r.ins)) for r in df.collect())
    assert flat(mapping.gate_trees(gates)) == flat(mapping.decompose(gates))
    assert mapping.gate_trees(gates.withColumn("ins", F.array().cast("array<string>"))).count() == 0
    wide = gates.where("out = 'oAND2'").withColumn("ins", F.transform(F.sequence(F.lit(1), F.lit(3_000_000)), lambda k: k.cast("string")))
    sizes = mapping.decompose(wide).select(F.max(F.size("ins")), F.count("*")).first()
    assert tuple(sizes) == (2, 2_999_999)  # as many rounds as the gate needs


def test_property_graph_round_trip_and_merge(spark):
    nodes = spark.createDataFrame([("a", "x", "Fix", {"effort": "low"}), ("a", "y", "Rule", None), ("b", "x", "Fix", {})], "library string, name string, label string, props map<string,string>")
    edges = spark.createDataFrame([("a", 0, "R", "x", "y", {"w": "1"}), ("a", 1, "R", "y", "x", None)], "library string, seq long, type string, src string, dst string, props map<string,string>")
    docs = stores.graph_to_json(nodes, edges)
    broken = spark.createDataFrame([("c", "{no json"), ("d", '{"library": "d", "nodes": [{"label": "L"}, {"name": "n", "unknown": 1}], "relations": [{"type": "R", "src": "n"}]}')], "library string, json string")
    n, e = stores.graph_from_json(docs.unionByName(broken))
    held = lambda df, *c: sorted((*(r[k] for k in c), tuple(sorted((r.props or {}).items()))) for r in df.collect())
    assert held(n, "library", "name") == [("a", "x", (("effort", "low"),)), ("a", "y", ()), ("b", "x", ()), ("d", "n", ())]
    assert held(e, "library", "src", "dst") == [("a", "x", "y", (("w", "1"),)), ("a", "y", "x", ())]
    more = spark.createDataFrame([("a", "x", "Fix", {"effort": "high", "t": "1"}), ("a", "z", "New", None)], nodes.schema)
    rel = spark.createDataFrame([("a", 7, "R", "x", "y", {"v": "2"})], edges.schema)
    once = stores.upsert_graph(nodes, edges, more, rel)
    twice = stores.upsert_graph(*once, more, rel)
    for g in (once, twice):
        assert held(g[0], "library", "name") == [("a", "x", (("effort", "high"), ("t", "1"))), ("a", "y", ()), ("a", "z", ()), ("b", "x", ())]
        assert held(g[1], "src", "dst") == [("x", "y", (("v", "2"), ("w", "1"))), ("y", "x", ())]


def test_replies_are_read_as_typed_objects(spark):
    cases = {
        1: ('```json\n{"fix": "a", "confidence": 0.5}\n```', ("a", 0.5)), 2: ('```\n{"fix": "b"}```', ("b", None)), 3: ('so: {"fix": "c", "confidence": 1, "more": {"x": 1}} done', ("c", 1.0)),
        4: ('{"fix": "d", "confidence": "high"}', ("d", None)), 5: ("{broken", None), 6: ("none", None), 7: ("", None), 8: (None, None), 9: ('{"a": } {"fix": "e"}', None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "id int, reply string")
    got = {r.id: r.parsed and (r.parsed.fix, r.parsed.confidence) for r in evidence.typed_reply(df, "reply", "fix string, confidence double").collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_prompt_without_anything_and_its_limits(spark):
    asked = spark.createDataFrame([(1,), (2,)], "request long")
    lines = spark.createDataFrame([(1, k, "x" * 500) for k in range(1, 9)], "request long, rank long, line string")
    near = spark.createDataFrame([(1, k, f"c{k}", None, None) for k in range(1, 6)], "request long, rank long, name string, similarity double, size long")
    got = {r.request: r.prompt for r in evidence.grounding_prompt(asked, lines.limit(0), lines, near).collect()}
    assert got[2] == "(no retrieved context)"
    parts = got[1].split("\n")
    assert parts[0] == "Relevant EDA knowledge:" and parts[1] == "  - " + "x" * 300 and len(parts) == 1 + 4 + 1 + 3 and parts[-1] == "  - c3 (sim ?, ? gates)"


def test_schedules_and_weights_over_rows(spark):
    runs = spark.createDataFrame([(1, 1), (2, 40), (3, 3)], "run long, epochs long")
    got = training.schedules(runs, 5).collect()
    assert {r.run: sum(1 for x in got if x.run == r.run) for r in got} == {1: 1, 2: 40, 3: 3}
    one = training.schedule(spark, 40, 5).orderBy("epoch").collect()
    assert [(r.lr_factor, r.beta) for r in sorted((r for r in got if r.run == 2), key=lambda r: r.epoch)] == [(r.lr_factor, r.beta) for r in one]
    rows = spark.createDataFrame([(1, "slack", None), (1, "other", None), (2, "slack", 9.0)], "id long, task string, given double")
    assert {(r.id, r.task): r.weight for r in training.weighed(rows, "id").collect()} == {(1, "slack"): 3.0, (1, "other"): 0.5, (2, "slack"): 9.0}
    assert training_queries.TASKS


@pytest.mark.parametrize("value, want", [(0.125, "0.13"), (-0.005, "-0.01"), (2.0, "2.00")])
def test_decimals_round_halves_away(spark, value, want):
    assert spark.range(1).select(evidence.decimals(F.lit(value), 2)).first()[0] == want


@pytest.mark.parametrize("first", [1, 40, 10**6])
def test_keyword_search_is_exact_whatever_it_prunes(spark, first):
    """By brute force, with frequent tokens, ties, and queries that few or no documents answer."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(n))
    docs = [(k, "the " * rng.randrange(5) + words(rng.randrange(0, 30))) for k in range(150)]
    asked = [(k, "the the " + words(rng.randrange(1, 12))) for k in range(12)] + [(50, "nowhere"), (51, "the"), (52, "w59 rare"), (53, None)]
    toks = lambda rows, key: retrieval.tokens(spark.createDataFrame(rows, f"{key} long, text string"), key)
    from collections import Counter

    count = lambda t: Counter((t or "").split())
    want = set()
    for i, t in asked:
        q, scored = count(t), []
        for j, u in docs:
            s = sum(min(n, count(u)[w]) for w, n in q.items())
            if s:
                scored.append((s, j))
        want |= {(i, j, s, r) for r, (s, j) in enumerate(sorted(scored, reverse=True)[:3], 1)}
    got = {tuple(r) for r in retrieval.keyword_topk(toks(asked, "q"), toks(docs, "d"), "q", "d", 3, first).collect()}
    assert got == want
