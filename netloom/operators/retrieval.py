"""Chunking, keyword retrieval and text extraction."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

#: 512 and 50 tokens at 1.3 tokens a word.
CHUNK_WORDS, STEP_WORDS = 393, 355
#: Token rows of queries that are small enough to send to every task.
BROADCAST = 100_000
_WORD = r"[^ \t\n\x0b\f\r]+"


def words(text) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def tokens(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token, tf): lower-case tokens of a letter and at least one more letter, digit or underscore."""
    each = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_]+"), F.lit(0))).alias("token"))
    return each.groupBy(key, "token").agg(F.count("*").alias("tf"))


def keyword_topk(queries: DataFrame, docs: DataFrame, query: str, doc: str, k: int, first: int = 1 << 18) -> DataFrame:
    """The k documents with the greatest shared token counts, min(tf) summed over tokens; ties go to the larger id. Exact.

    A query's tokens are taken from the rarest on, as long as no more than `first` documents hold them in sum, and at least
    one. What the other tokens can add is at most the sum of their counts in the query: while that could lift a document
    that was not seen yet to the k-th place, eight times as many documents are allowed. Frequent tokens are then looked up
    for those documents alone that can still reach the k-th place, so no row is made for all that share a frequent token.
    """
    from ..sources.tables import checkpointed

    def small(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.limit(BROADCAST + 1).count() <= BROADCAST else rows

    q = checkpointed(queries.select(query, "token", F.col("tf").alias("q_tf")))
    d = docs.join(small(q.select("token").distinct()), "token", "left_semi")  # no other token plays a part
    d = checkpointed(d.select(doc, "token", F.col("tf").alias("d_tf")))
    held = d.groupBy("token").agg(F.count("*").alias("held"))
    rising = Window.partitionBy(query).orderBy("held", "token").rowsBetween(Window.unboundedPreceding, -1)  # the tokens of one query
    ranked = checkpointed(q.join(held, "token").withColumn("before", F.coalesce(F.sum("held").over(rising), F.lit(0))))
    score = F.sum(F.least("q_tf", "d_tf"))
    able, far = [], []
    while True:
        near = (F.col("before") == 0) | (F.col("before") + F.col("held") <= first)
        found = checkpointed(d.join(small(ranked.where(near).select(query, "token", "q_tf")), "token").groupBy(query, doc).agg(score.alias("part")))
        place = Window.partitionBy(query).orderBy(F.desc("part"))
        kth = found.withColumn("r", F.row_number().over(place)).where(F.col("r") == k).select(query, F.col("part").alias("least"))
        sums = ranked.groupBy(query).agg(F.coalesce(F.sum(F.when(~near, F.col("q_tf"))), F.lit(0)).alias("more")).join(kth, query, "left")
        bounds = checkpointed(sums.select(query, "more", F.coalesce("least", F.lit(0)).alias("least")).withColumn("open", (F.col("more") > 0) & (F.col("more") >= F.col("least"))))
        able.append(found.join(bounds.where("NOT open"), query).where(F.col("part") + F.col("more") >= F.col("least")).select(query, doc, "part"))
        far.append(ranked.where(~near).join(bounds.where("NOT open").select(query), query, "left_semi").select(query, "token", "q_tf"))
        if bounds.where("open").isEmpty():
            break
        ranked, first = checkpointed(ranked.join(bounds.where("open").select(query), query, "left_semi")), first * 8
    able, far = (functools.reduce(DataFrame.unionByName, parts) for parts in (able, far))
    late = d.join(able.select(query, doc), doc).join(far, [query, "token"]).groupBy(query, doc).agg(score.alias("late"))
    scores = able.join(late, [query, doc], "left").select(query, doc, (F.col("part") + F.coalesce("late", F.lit(0))).alias("score"))
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.desc(doc))
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select(query, doc, "score", "rank")


def chunks(texts: DataFrame, key: str, text: str = "text", size: int = CHUNK_WORDS, step: int = STEP_WORDS) -> DataFrame:
    """(key, chunk_index, n_words, chunk): overlapping word windows; the last one reaches the end."""
    w = texts.select(key, words(text).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step)).cast("int")
    c = w.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i * step + 1, size))).alias("chunk_index", "c"))
    return c.select(key, F.col("chunk_index").cast("long").alias("chunk_index"), F.size("c").cast("long").alias("n_words"), F.array_join("c", " ").alias("chunk"))


def token_estimate(text) -> Column:
    return F.greatest(F.lit(1), F.floor(F.size(words(text)) * 1.3)).cast("long")


def entry_text(entries: DataFrame) -> DataFrame:
    """One paragraph for each knowledge entry; parts that are empty are left out."""
    specs = F.array_join(F.transform(F.map_entries("typical_specs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")

    def part(head: str, body: Column, present: Column) -> Column:
        return F.when(present, F.concat(F.lit(head), body, F.lit(".")))

    parts = [F.format_string("Circuit: %s (%s).", "circuit_name", "topology_type"), F.concat(F.lit("Description: "), F.col("description")), part("Typical specs: ", specs, F.size("typical_specs") > 0)]
    parts.append(part("Typical device count: ", F.concat_ws("-", F.col("device_count_range")[0].cast("string"), F.col("device_count_range")[1].cast("string")), F.size("device_count_range") == 2))
    parts += [part(head, F.array_join(c, "; "), F.size(c) > 0) for head, c in (("Common issues: ", "common_issues"), ("Optimization tips: ", "optimization_tips"))]
    return entries.select("circuit_name", "topology_type", F.concat_ws(" ", *parts).alias("text"))


def chunk_metadata(texts: DataFrame, key: str, columns: list[str], text: str = "text") -> DataFrame:
    """chunks() with columns of their text and how many chunks it has."""
    of = Window.partitionBy(key)
    return chunks(texts, key, text).withColumn("n_chunks", F.count("*").over(of)).join(texts.select(key, *columns), key)


def merged_hits(hits: DataFrame, group: str, query: str, doc: str) -> DataFrame:
    """(group, position, doc): the hits of a group's queries in order of query and rank, each document at its first place."""
    first = hits.groupBy(group, doc).agg(F.min(F.struct(query, "rank")).alias("at"))
    order = Window.partitionBy(group).orderBy("at")
    return first.select(group, F.row_number().over(order).cast("long").alias("position"), doc)


def first_json(replies: DataFrame, column: str) -> DataFrame:
    """The outermost braces of a noisy reply, and how many keys they hold (null if that is not JSON)."""
    body = F.regexp_extract(column, r"(?s)\{.*\}", 0)
    return replies.select("event_id", body.alias("json"), F.size(F.json_object_keys(body)).cast("long").alias("n_keys"))


def strip_html(column) -> Column:
    text = F.regexp_replace(column, r"(?si)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def fused(sources: dict[str, DataFrame]) -> DataFrame:
    """(request, position, source, ref): what each source (request, rank, ref) found for a request, in the order of the sources."""
    every = None
    for at, (name, rows) in enumerate(sources.items()):
        part = rows.select("request", F.lit(at).alias("at"), F.col("rank").cast("long").alias("rank"), F.lit(name).alias("source"), F.col("ref").cast("string").alias("ref"))
        every = part if every is None else every.unionByName(part)
    order = Window.partitionBy("request").orderBy("at", "rank", "ref")
    return every.select("request", F.row_number().over(order).cast("long").alias("position"), "source", "ref")


def messages(turns: DataFrame, least: int = 8) -> DataFrame:
    """Chat messages of each conversation with at least `least` turns, in order."""
    rows = turns.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m")).where(F.col("n_messages") >= least)
    joined = F.array_join(F.transform("m", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    return rows.select("conv_id", "n_messages", F.md5(joined).alias("messages_md5"))
