"""Text, retrieval, vector and metric queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import metrics, retrieval, vectors
from ..operators.losses import losses
from ..sources.tables import table


def token_counts(spark, sf_dir) -> DataFrame:
    """Occurrences of each token of the benchmark items over all of them."""
    return retrieval.tokens(table(spark, sf_dir, "benchmark"), "item_id").groupBy("token").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("items"))


def keyword_topk(spark, sf_dir):
    """The three documents that share most tokens with each benchmark item."""
    queries, docs = retrieval.tokens(table(spark, sf_dir, "benchmark"), "item_id"), retrieval.tokens(table(spark, sf_dir, "documents"), "doc_id")
    return retrieval.keyword_topk(queries, docs, "item_id", "doc_id", 3)


def chunk_text(spark, sf_dir):
    chunks = retrieval.chunks(table(spark, sf_dir, "documents"), "doc_id")
    return chunks.select("doc_id", "chunk_index", "n_words", F.md5("chunk").alias("chunk_md5"))


def token_estimate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", retrieval.token_estimate("text").alias("tokens"))


def _queries(e):
    return e.where("vec_id % 20 = 0")


def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.topk(_queries(e), e, 5)


def filtered_knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.topk(_queries(e), e.where("label IN (1, 3)"), 3)


def compare_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.compare(e, e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b")))


def ivf_knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.ivf_topk(_queries(e), e, 5)


def _predictions(spark, sf_dir):
    """A linear price model over lineitem, as predictions to evaluate."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linenumber").cast("long").alias("depth"), (F.col("l_quantity") * 1500.0).alias("pred"), F.col("l_extendedprice").alias("target"))


def regression_metrics(spark, sf_dir):
    return metrics.regression(_predictions(spark, sf_dir))


def metrics_by_depth(spark, sf_dir):
    return metrics.regression(_predictions(spark, sf_dir), "depth")


def metrics_rollup(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    return p.rollup("depth").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("pred") - F.col("target"))), 4).alias("mae"))


def _scored(spark, sf_dir):
    """Share of a document's symbols as a score of its low quality."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    score = F.round(F.length(F.regexp_replace("text", "[^!#$%&*|]", "")) / F.greatest(F.length("text"), F.lit(1)), 6)
    return docs.join(labels, "doc_id").select("doc_id", score.alias("score"), (1 - F.col("quality")).cast("long").alias("y"))


def roc_curve(spark, sf_dir):
    return metrics.roc(_scored(spark, sf_dir))


def auc_roc(spark, sf_dir):
    return metrics.auc(_scored(spark, sf_dir))


def youden_threshold(spark, sf_dir):
    return metrics.youden(_scored(spark, sf_dir))


def classification_metrics(spark, sf_dir):
    return metrics.classification(_scored(spark, sf_dir))


def loss_terms(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return losses(s.select((F.col("score") * 8.0 - 1.0).alias("logit"), F.col("y").cast("double").alias("y")))


def json_extract(spark, sf_dir):
    return retrieval.first_json(table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Sure: ```json "), "props", F.lit(" ``` done")).alias("reply")), "reply")


def html_text_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(retrieval.strip_html("html")).alias("text_md5"), F.length(retrieval.strip_html("html")).cast("long").alias("n_chars"))


def sft_messages(spark, sf_dir):
    return retrieval.messages(table(spark, sf_dir, "conversations"), least=3)


QUERIES = {f.__name__: f for f in (token_counts, keyword_topk, chunk_text, token_estimate, cosine_topk, filtered_knn, compare_pairs, ivf_knn, regression_metrics, metrics_by_depth, metrics_rollup, roc_curve, auc_roc, youden_threshold, classification_metrics, loss_terms, json_extract, html_text_strip, sft_messages)}


def _tokens(name, key):
    return f"(SELECT {key}, token, count(*) AS tf FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_]+')) AS token FROM {name}) GROUP BY ALL)"


_DOT = "list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda z: z[1] * z[2]))"
_NORM = "sqrt(list_sum(list_transform({a}::DOUBLE[], lambda z: z * z)))"
_COS = f"{_DOT.format(a='q.embedding', b='e.embedding')} / ({_NORM.format(a='q.embedding')} * {_NORM.format(a='e.embedding')})"
_PRED = "pred AS (SELECT l_linenumber::BIGINT AS depth, l_quantity * 1500e0 AS pred, l_extendedprice AS target FROM lineitem)"
_REG = "count(*) AS n, round(avg((pred - target) * (pred - target)), 2) AS mse, round(avg(abs(pred - target)), 4) AS mae, round(1e0 - sum((pred - target) * (pred - target)) / (sum(target * target) - sum(target) * sum(target) / count(*)), 6) AS r2, round(corr(pred, target), 6) AS pearson FROM pred"
_SCORED = "scored AS (SELECT doc_id, round(length(regexp_replace(text, '[^!#$%&*|]', '', 'g')) / greatest(length(text), 1), 6) AS score, (1 - quality)::BIGINT AS y FROM documents JOIN labels USING (doc_id)), totals AS (SELECT sum(y)::DOUBLE AS p, count(*) - sum(y)::DOUBLE AS n FROM scored), steps AS (SELECT score, sum(sum(y)) OVER w / any_value(p) AS tpr, sum(count(*) - sum(y)) OVER w / any_value(n) AS fpr FROM scored, totals GROUP BY score WINDOW w AS (ORDER BY score DESC)), best AS (SELECT arg_max(score, (round(tpr - fpr, 12), score)) AS threshold, max(round(tpr - fpr, 12)) AS j FROM steps)"


def _knn(where: str, k: int) -> str:
    return f"SELECT query_id, rank, vec_id, similarity FROM (SELECT q.vec_id AS query_id, e.vec_id, round({_COS}, 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 6) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND {where}) WHERE rank <= {k}"


ORACLE_SQL = {
    "token_counts": f"SELECT token, sum(tf)::BIGINT AS occurrences, count(*) AS items FROM {_tokens('benchmark', 'item_id')} GROUP BY token",
    "keyword_topk": f"SELECT item_id, doc_id, score, rank FROM (SELECT item_id, doc_id, sum(least(q.tf, d.tf))::BIGINT AS score, row_number() OVER (PARTITION BY item_id ORDER BY sum(least(q.tf, d.tf)) DESC, doc_id DESC) AS rank FROM {_tokens('benchmark', 'item_id')} q JOIN {_tokens('documents', 'doc_id')} d USING (token) GROUP BY item_id, doc_id) WHERE rank <= 3",
    "chunk_text": "WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 393 THEN 1 ELSE 1 + (len(w) - 393 + 354) // 355 END)) AS k FROM w WHERE len(w) > 0) SELECT doc_id, k AS chunk_index, len(w[k * 355 + 1 : k * 355 + 393])::BIGINT AS n_words, md5(array_to_string(w[k * 355 + 1 : k * 355 + 393], ' ')) AS chunk_md5 FROM s",
    "token_estimate": "SELECT doc_id, greatest(1, floor(len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')) * 1.3e0))::BIGINT AS tokens FROM documents",
    "cosine_topk": _knn("q.vec_id <> e.vec_id", 5),
    "filtered_knn": _knn("q.vec_id <> e.vec_id AND e.label IN (1, 3)", 3),
    "compare_pairs": f"SELECT q.vec_id AS a, e.vec_id AS b, round({_COS}, 6) AS similarity, (e.label - q.label)::BIGINT AS label_delta FROM embeddings q JOIN embeddings e ON e.vec_id = q.vec_id + 1",
    "regression_metrics": f"WITH {_PRED} SELECT {_REG}",
    "metrics_by_depth": f"WITH {_PRED} SELECT depth, {_REG} GROUP BY depth",
    "metrics_rollup": f"WITH {_PRED} SELECT depth, count(*) AS n, round(avg(abs(pred - target)), 4) AS mae FROM pred GROUP BY ROLLUP (depth)",
    "roc_curve": f"WITH {_SCORED} SELECT score, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM steps",
    "auc_roc": f"WITH {_SCORED}, ranks AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM scored) SELECT round((sum(r) FILTER (y = 1) - any_value(p) * (any_value(p) + 1) / 2e0) / (any_value(p) * any_value(n)), 9) AS auc, count(*) AS n FROM ranks, totals",
    "youden_threshold": f"WITH {_SCORED} SELECT threshold, round(j, 9) AS j FROM best",
    "classification_metrics": f"WITH {_SCORED}, c AS (SELECT count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 1) AS fn, count(*) FILTER (score < threshold AND y = 0) AS tn FROM scored, best) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2e0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c",
    "loss_terms": f"WITH {_SCORED}, l AS (SELECT score * 8e0 - 1e0 AS z, y::DOUBLE AS y FROM scored), b AS (SELECT *, greatest(z, 0e0) - z * y + ln(1e0 + exp(-abs(z))) AS bce, 1e0 / (1e0 + exp(-z)) AS p FROM l), w AS (SELECT least(20e0, (count(*) - sum(y)) / greatest(sum(y), 1e0)) AS pw FROM l) SELECT round(avg(bce), 9) AS bce, round(avg(CASE WHEN y = 1 THEN pw * bce ELSE bce END), 9) AS weighted_bce, round(avg((CASE WHEN y = 1 THEN 0.25e0 ELSE 0.75e0 END) * pow(1e0 - CASE WHEN y = 1 THEN p ELSE 1e0 - p END, 2) * bce), 9) AS focal, round(avg((p - y) * (p - y)), 9) AS mse, round(avg(CASE WHEN abs(z - y) < 2e0 THEN (z - y) * (z - y) / 4e0 ELSE abs(z - y) - 1e0 END), 9) AS huber FROM b, w",
    "json_extract": "SELECT event_id, regexp_extract('Sure: ```json ' || props || ' ``` done', '(?s)\\{.*\\}', 0) AS json, len(json_keys(props))::BIGINT AS n_keys FROM events",
    "html_text_strip": "WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?si)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM pages) SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM t",
    "sft_messages": "SELECT conv_id, count(*) AS n_messages, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS messages_md5 FROM conversations GROUP BY conv_id HAVING count(*) >= 3",
}
