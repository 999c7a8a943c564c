"""Schedules, losses, filters, merged retrieval, facts and payloads, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import knowledge as kg
from ..functions.library import sql_values
from ..operators import diagnose, graph_facts, metrics, retrieval, training, vectors
from ..operators.features import labels as graph_labels
from ..sources.tables import table
from . import advice_queries as advice, text_queries as text
from .netlist_queries import _labels, netlist, slacks
from .netlist_sql import sql

TASKS = ["slack", "arrival_time", "critical_path", "drc"]


def lr_schedule(spark, sf_dir) -> DataFrame:
    """A schedule for each user, of as many epochs as the user has events."""
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("epochs"))
    return training.schedules(runs, 5).select("user_id", "epoch", "lr_factor", "beta")


def task_weight_table(spark, sf_dir):
    """The weights of each customer's tasks; some customers give a weight for one of them."""
    task = F.explode(F.array(*map(F.lit, TASKS))).alias("task")
    rows = table(spark, sf_dir, "customer").select("c_custkey", task).withColumn("given", F.when((F.col("c_custkey") % 3 == 0) & (F.col("task") == "arrival_time"), F.col("c_custkey") / 8.0))
    return training.weighed(rows, "c_custkey")


def _batches(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("event_id") % 40 + 1).alias("epoch"), F.col("value").alias("loss"))


def epoch_losses(spark, sf_dir):
    return training.epoch_losses(_batches(spark, sf_dir))


def early_stop(spark, sf_dir):
    return training.best_epoch(training.epoch_losses(_batches(spark, sf_dir)), 5)


def _graph_labels(spark, sf_dir):
    n, s = slacks(spark, sf_dir, (1.2,))
    return graph_labels(s, _labels(n))


def composition_drift(spark, sf_dir):
    return training.composition_drift(_graph_labels(spark, sf_dir))


def multitask_loss(spark, sf_dir):
    return training.multitask_losses(training.check_targets(_graph_labels(spark, sf_dir), ["slack", "arrival_time", "critical"]))


def size_filter(spark, sf_dir):
    return netlist(spark, sf_dir).nodes.select("circuit_id", "n").distinct().where("n BETWEEN 40 AND 70")


def gain_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(training.gain_share(F.col("value")), 9).alias("gain"))


def name_topology(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", training.topology_of(F.col("p_name")).alias("topology"))


def user_scale(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(training.max_positive(F.col("value") - 50.0), 9).alias("scale"))


def half_slices(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    total = lambda second: F.round(F.aggregate(training.half("v", second), F.lit(0.0), lambda s, x: s + x), 5) + 0.0
    return e.select("vec_id", total(False).alias("forward"), total(True).alias("backward"))


def two_column_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = metrics.regression(li.select((F.col("l_quantity") * 1500.0).alias("pred"), F.col("l_extendedprice").alias("target"))).withColumn("target", F.lit("price"))
    b = metrics.regression(li.select(F.col("l_quantity").cast("double").alias("pred"), (F.col("l_extendedprice") / 1000.0).alias("target"))).withColumn("target", F.lit("thousands"))
    return a.unionByName(b)


def critical_probability(spark, sf_dir):
    return diagnose.rank_critical_probability(advice._predictions(spark, sf_dir))


def task_summary(spark, sf_dir):
    return diagnose.task_summary(advice._predictions(spark, sf_dir))


def advisories(spark, sf_dir):
    return diagnose.advisories(diagnose.reconcile(advice._recs(spark, sf_dir)[1]))


def confidence_map(spark, sf_dir):
    return diagnose.confidence_map(advice._recs(spark, sf_dir)[1])


def graph_payload(spark, sf_dir):
    n = netlist(spark, sf_dir)
    return diagnose.graph_payload(n.nodes, n.edges)


def hybrid_facts(spark, sf_dir):
    return graph_facts.all_facts(*advice._lookup(spark, sf_dir), "45nm")


def hybrid_prompt(spark, sf_dir):
    return graph_facts.prompts(graph_facts.all_facts(*advice._lookup(spark, sf_dir), "45nm"))


def hybrid_answer(spark, sf_dir):
    """For each benchmark item: documents by keywords, the facts of a violation, vectors near one of its own."""
    items = table(spark, sf_dir, "benchmark")
    facts = graph_facts.all_facts(*advice._kg(spark), "45nm")
    kinds = sorted(r.violation for r in facts.select("violation").distinct().collect())  # a fixed table
    violation = F.element_at(F.array(*map(F.lit, kinds)), (F.col("item_id") % len(kinds) + 1).cast("int"))
    known = items.select(F.col("item_id").alias("request"), violation.alias("violation")).join(F.broadcast(facts), "violation")
    e, asked = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "embeddings")  # read apart, as both sides of a join
    asked = asked.join(items.select((F.col("item_id") * 20).alias("vec_id")), "vec_id", "left_semi")
    return retrieval.fused({
        "text": text.keyword_topk(spark, sf_dir).select(F.col("item_id").alias("request"), "rank", F.col("doc_id").alias("ref")),
        "fact": known.select("request", "rank", F.concat_ws(" ", "subject", "relation", "object").alias("ref")),
        "circuit": vectors.topk(asked, e, 3).select((F.col("query_id") / 20).cast("long").alias("request"), "rank", F.col("vec_id").alias("ref")),
    })


def violations_by_topology(spark, sf_dir):
    """What each topology shows, with the label of both ends."""
    n, e = advice._library(spark, sf_dir)
    n = n.select("name", "label")
    shown = graph_facts.related(e, "COMMONLY_EXHIBITS", "topology", "violation")
    return shown.join(n.withColumnsRenamed({"name": "topology", "label": "topology_label"}), "topology").join(n.withColumnsRenamed({"name": "violation", "label": "violation_label"}), "violation").select("topology", "violation", "topology_label", "violation_label")


def chunk_metadata(spark, sf_dir):
    found = retrieval.chunk_metadata(table(spark, sf_dir, "documents"), "doc_id", ["lang", "source"])
    return found.select("doc_id", "chunk_index", "n_words", "n_chunks", "lang", "source")


def advisor_hits(spark, sf_dir):
    """Three benchmark items are one request's queries; their hits are merged in order."""
    hits = text.keyword_topk(spark, sf_dir).withColumn("request", F.expr("item_id div 3"))
    return retrieval.merged_hits(hits, "request", "item_id", "doc_id")


def entry_paragraphs(spark, sf_dir):
    """Parts as knowledge entries."""
    none = F.array().cast("array<string>")
    odd = F.col("p_size") % 2 == 1
    entries = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("circuit_name"), F.col("p_type").alias("topology_type"), F.col("p_brand").alias("description"),
        F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("typical_specs"),
        F.when(odd, F.array("p_size", F.col("p_size") + 5)).otherwise(F.array().cast("array<int>")).alias("device_count_range"),
        F.when(odd, F.array(F.col("p_type"), F.lit("noise"))).otherwise(none).alias("common_issues"), none.alias("optimization_tips"),
    )
    return retrieval.entry_text(entries).select("circuit_name", "text")


def similar_within_label(spark, sf_dir):
    """The three vectors of the query's own label that are nearest to it."""
    e = table(spark, sf_dir, "embeddings")
    return vectors.topk(e.where("vec_id % 20 = 0"), e, 3, within="label")


def compare_deltas(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.compare_deltas(e, e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b")))


QUERIES = {f.__name__: f for f in (lr_schedule, task_weight_table, epoch_losses, early_stop, composition_drift, multitask_loss, size_filter, gain_filter, name_topology, user_scale, half_slices, two_column_metrics, critical_probability, task_summary, advisories, confidence_map, graph_payload, hybrid_facts, hybrid_prompt, hybrid_answer, violations_by_topology, chunk_metadata, advisor_hits, entry_paragraphs, similar_within_label, compare_deltas)}

_P, _RANKS, _RECS = advice._P, advice._RANKS, advice._RECS
_TOPOLOGY = " ".join(f"WHEN regexp_matches(lower(p_name), '{'|'.join(words)}') THEN '{topology}'" for topology, words in training.NAME_TOPOLOGIES)
_EPOCHS = "epochs AS (SELECT event_id % 40 + 1 AS epoch, count(*) AS n, round(avg(value), 6) AS loss FROM events GROUP BY 1)"
_FACTS = f"{kg.KG_SQL}, {advice._CLASH}, f AS (SELECT src AS violation, dst AS fix, seq FROM kg_edges JOIN fixes ON fix = dst WHERE type = 'RESOLVED_BY' AND list_contains(string_split(process_nodes, ','), '45nm')), rows_ AS (SELECT violation, 0 AS part, seq, 0::BIGINT AS sub, violation AS subject, 'RESOLVED_BY' AS relation, fix AS object FROM f UNION ALL SELECT violation, 1, f.seq, e.seq, f.fix, 'PRODUCES', e.dst FROM f JOIN kg_edges e ON e.type = 'PRODUCES' AND e.src = f.fix UNION ALL SELECT violation, 1, f.seq, 0, f.fix, 'CONFLICTS_WITH', c.conflict FROM f JOIN clash c USING (fix)), facts AS (SELECT * FROM (SELECT violation, row_number() OVER (PARTITION BY violation ORDER BY part, seq, (relation = 'CONFLICTS_WITH')::INT, sub, object) AS rank, subject, relation, object FROM rows_) WHERE rank <= 10)"
_LIB_FACTS = _FACTS.replace(kg.KG_SQL, kg.LIBRARIES_SQL)
_WEIGHTS = [(t, training.TASK_WEIGHTS.get(t, 1 / len(TASKS))) for t in TASKS]
_SUM = "list_sum({v}::DOUBLE[])"
_HITS = text.ORACLE_SQL["keyword_topk"]
_REG2 = "count(*) AS n, round(avg((pred - target) * (pred - target)), 2) AS mse, round(avg(abs(pred - target)), 4) AS mae, round(1e0 - sum((pred - target) * (pred - target)) / (sum(target * target) - sum(target) * sum(target) / count(*)), 6) AS r2, round(corr(pred, target), 6) AS pearson"
ORACLE_SQL = {
    "lr_schedule": "SELECT user_id, e AS epoch, round(CASE WHEN e <= w THEN 0.01e0 + 0.99e0 * (e - 1) / greatest(w, 1) ELSE 0.5e0 * (1e0 + cos(pi() * (e - 1 - w) / greatest(1, n - w))) END, 9) AS lr_factor, round(exp(ln(8e0) + CASE WHEN n > 1 THEN (e - 1)::DOUBLE / greatest(n - 1, 1) ELSE 1e0 END * (ln(1000e0) - ln(8e0))), 6) AS beta FROM (SELECT *, unnest(range(1, n + 1)) AS e FROM (SELECT user_id, count(*) AS n, greatest(0, least(5, count(*) - 1)) AS w FROM events GROUP BY user_id))",
    "task_weight_table": f"SELECT c_custkey, task, CASE WHEN c_custkey % 3 = 0 AND task = 'arrival_time' THEN c_custkey / 8e0 ELSE weight END AS weight FROM customer, (VALUES {sql_values(_WEIGHTS)}) AS t(task, weight)",
    "epoch_losses": f"WITH {_EPOCHS} SELECT * FROM epochs",
    "early_stop": f"WITH {_EPOCHS}, a AS (SELECT *, min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM epochs), b AS (SELECT *, low IS NULL OR loss < low AS better FROM a), c AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS last FROM b), d AS (SELECT min(epoch) FILTER (epoch - last >= 5) AS stop FROM c) SELECT max(epoch) AS best_epoch, min(loss) AS best_loss, any_value(stop) AS stopped_at FROM c, d WHERE better AND (stop IS NULL OR epoch <= stop)",
    "composition_drift": sql("SELECT circuit_id, round(max(abs(slack - (required - round(arrival, 13)))), 9) AS max_drift, round(avg(abs(slack - (required - round(arrival, 13)))), 9) AS mean_drift FROM slacks WHERE factor = 1.2e0 GROUP BY circuit_id"),
    "multitask_loss": sql(
        "SELECT circuit_id, round(a, 9) AS slack, round(b, 9) AS arrival_time, round(c, 9) AS critical_path, round(3e0 * a + 1e0 * b + (1e0 / 3e0) * c, 9) AS loss FROM l",
        "v AS (SELECT circuit_id, slack AS d, round(arrival, 13) AS t, -10e0 * slack AS z, (slack <= 0.05e0)::INT::DOUBLE AS y FROM slacks WHERE factor = 1.2e0), l AS (SELECT circuit_id, avg(CASE WHEN abs(d) < 2e0 THEN d * d / 4e0 ELSE abs(d) - 1e0 END) AS a, avg(t * t) AS b, avg(greatest(z, 0e0) - z * y + ln(1e0 + exp(-abs(z)))) AS c FROM v GROUP BY circuit_id)",
    ),
    "size_filter": sql("SELECT DISTINCT circuit_id, n FROM nodes WHERE n BETWEEN 40 AND 70"),
    "gain_filter": "SELECT event_id, round(CASE WHEN value >= 1 THEN value / 100e0 ELSE value END, 9) AS gain FROM events",
    "name_topology": f"SELECT p_partkey, CASE {_TOPOLOGY} ELSE '{training.OTHER_TOPOLOGY}' END AS topology FROM part",
    "user_scale": "SELECT user_id, round(coalesce(max(CASE WHEN value - 50e0 > 0 THEN value - 50e0 END), 1e0), 9) AS scale FROM events GROUP BY user_id",
    "half_slices": f"SELECT vec_id, round({_SUM.format(v='embedding[1 : len(embedding) // 2]')}, 5) + 0e0 AS forward, round({_SUM.format(v='embedding[len(embedding) // 2 + 1 : 2 * (len(embedding) // 2)]')}, 5) + 0e0 AS backward FROM embeddings",
    "two_column_metrics": f"SELECT 'price' AS target, * FROM (SELECT {_REG2} FROM (SELECT l_quantity * 1500e0 AS pred, l_extendedprice AS target FROM lineitem)) UNION ALL SELECT 'thousands', * FROM (SELECT {_REG2} FROM (SELECT l_quantity::DOUBLE AS pred, l_extendedprice / 1000e0 AS target FROM lineitem))",
    "critical_probability": sql(
        "SELECT circuit_id, severity, location, node_ids FROM (SELECT circuit_id, max(p) AS severity FROM probs GROUP BY circuit_id HAVING max(p) >= 0.5e0) JOIN top_p USING (circuit_id)",
        _P + ", probs AS (SELECT circuit_id, idx, round(1e0 / (1e0 + exp(-(((slack <= 0.05e0)::INT::DOUBLE - 0.5e0) * 10e0))), 9) AS p FROM preds), " + advice._top("p DESC", "top_p").replace("FROM preds", "FROM probs"),
    ),
    "task_summary": sql("SELECT circuit_id, task, min(v) AS least, round(avg(v), 6) AS mean, max(v) AS greatest FROM (SELECT circuit_id, 'slack' AS task, slack AS v FROM preds UNION ALL SELECT circuit_id, 'congestion', congestion FROM preds UNION ALL SELECT circuit_id, 'drc', prob FROM preds) GROUP BY ALL", _P),
    "advisories": sql("SELECT circuit_id, 'ppa' AS task, fix, 0.5e0 AS confidence, fix || ' conflicts with ' || replace(clashing, ',', ', ') AS advice FROM recon WHERE clashing <> ''", _RECS),
    "confidence_map": sql("SELECT circuit_id, task, arg_max(confidence, seq) AS confidence, count(*) AS n FROM recs r JOIN kg_edges e ON e.type = 'RESOLVED_BY' AND e.src = r.violation AND e.dst = r.fix GROUP BY ALL", _RECS),
    "graph_payload": sql("SELECT circuit_id, n_nodes, n_edges, links FROM (SELECT circuit_id, count(*) AS n_nodes FROM nodes GROUP BY 1) JOIN (SELECT circuit_id, count(*) AS n_edges, string_agg(drv || '>' || snk, ',' ORDER BY drv, snk) AS links FROM edges GROUP BY 1) USING (circuit_id)"),
    "hybrid_facts": f"WITH {_LIB_FACTS} SELECT violation, rank, subject, relation, object FROM facts",
    "hybrid_answer": f"WITH {_FACTS}, kinds AS (SELECT violation, row_number() OVER (ORDER BY violation) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT violation FROM facts)), hits AS ({_HITS}), near AS ({text._knn('q.vec_id <> e.vec_id', 3)}), found AS (SELECT item_id AS request, 0 AS part, rank, 'text' AS source, doc_id::VARCHAR AS ref FROM hits UNION ALL SELECT item_id, 1, rank, 'fact', subject || ' ' || relation || ' ' || object FROM benchmark JOIN kinds ON k = item_id % n JOIN facts USING (violation) UNION ALL SELECT item_id, 2, rank, 'circuit', vec_id::VARCHAR FROM benchmark JOIN near ON query_id = item_id * 20) SELECT request, row_number() OVER (PARTITION BY request ORDER BY part, rank, ref) AS position, source, ref FROM found",
    "hybrid_prompt": f"WITH {_LIB_FACTS} SELECT violation, count(*) AS n_facts, coalesce(string_agg(DISTINCT object, ', ' ORDER BY object) FILTER (relation = 'RESOLVED_BY'), '') AS fixes, string_agg('- ' || subject || ' ' || relation || ' ' || object, chr(10) ORDER BY rank) AS prompt FROM facts GROUP BY violation",
    "violations_by_topology": f"WITH {kg.LIBRARIES_SQL} SELECT e.src AS topology, e.dst AS violation, a.label AS topology_label, b.label AS violation_label FROM kg_edges e JOIN kg_nodes a ON a.name = e.src JOIN kg_nodes b ON b.name = e.dst WHERE e.type = 'COMMONLY_EXHIBITS'",
    "chunk_metadata": f"WITH c AS ({text.ORACLE_SQL['chunk_text']}) SELECT doc_id, chunk_index, n_words, count(*) OVER (PARTITION BY doc_id) AS n_chunks, lang, source FROM c JOIN documents USING (doc_id)",
    "advisor_hits": f"WITH h AS ({_HITS}), m AS (SELECT item_id // 3 AS request, doc_id, min((item_id, rank)) AS place FROM h GROUP BY ALL) SELECT request, row_number() OVER (PARTITION BY request ORDER BY place) AS position, doc_id FROM m",
    "entry_paragraphs": "SELECT p_name AS circuit_name, 'Circuit: ' || p_name || ' (' || p_type || '). Description: ' || p_brand || ' Typical specs: brand=' || p_brand || ', size=' || p_size || '.' || CASE WHEN p_size % 2 = 1 THEN ' Typical device count: ' || p_size || '-' || (p_size + 5) || '. Common issues: ' || p_type || '; noise.' ELSE '' END AS text FROM part",
    "similar_within_label": text._knn("q.vec_id <> e.vec_id AND q.label = e.label", 3),
    "compare_deltas": "WITH f AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda z: z * z))) AS norm, list_sum(embedding::DOUBLE[]) / len(embedding) AS mean, list_max(embedding::DOUBLE[]) AS top FROM embeddings) SELECT x.vec_id AS a, y.vec_id AS b, round(list_sum(list_transform(list_zip(x.v, y.v), lambda z: z[1] * z[2])) / (x.norm * y.norm), 6) AS similarity, (y.label - x.label)::BIGINT AS label_delta, round(y.norm - x.norm, 5) + 0e0 AS norm_delta, round(y.mean - x.mean, 5) + 0e0 AS mean_delta, round(y.top - x.top, 5) + 0e0 AS top_delta FROM f x JOIN f y ON y.vec_id = x.vec_id + 1",
}
