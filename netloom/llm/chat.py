"""Preference formatting with DataFrame functions only.

A pair has a chosen and a rejected conversation. The longest prefix of turns with the same role and text in both is
rendered once, as the prompt; the turns after it are the two completions. A completion's mask gives spans of its
characters as start:end:trained, where the turns of the assistant are trained on and others are not.

Turns are in the order of their number, then role and text; a turn repeated in every column counts once. A null role
is "unknown", a null text empty. A pair that lacks a side, or whose sides are equal, has usable = false. A null pair id
is dropped, since nothing tells which turns belong together. An empty table gives an empty result; other columns are
ignored. A pair's turns meet in one row, because that row is the training example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, SEPARATOR, CLOSE = "<|", "|>\n", "<|end|>\n"


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(SEPARATOR), turn["text"], F.lit(CLOSE))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """start:end:trained of each turn of a completion."""
    lengths = F.transform(turns, lambda t: F.struct(F.length(_render(t)).cast("long").alias("n"), (t["role"] == "assistant").cast("int").alias("on")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc, t):
        span = F.concat_ws(":", acc["at"], acc["at"] + t["n"], t["on"])
        return F.struct((acc["at"] + t["n"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(lengths, start, add, lambda acc: F.array_join(acc["spans"], ","))


def preference_pairs(turns: DataFrame, pair: str, chosen: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask, usable. `chosen` names a boolean column."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sides = turns.where(F.col(pair).isNotNull()).groupBy(F.col(pair).alias("pair")).agg(F.sort_array(F.collect_set(F.when(F.col(chosen), row))).alias("c"), F.sort_array(F.collect_set(F.when(~F.col(chosen), row))).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, False)
    n = F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")
    cut = sides.withColumn("n", n).select("pair", "n", F.slice("c", 1, F.col("n")).alias("p"), F.slice("c", F.col("n") + 1, F.greatest(F.size("c"), F.lit(1))).alias("c"), F.slice("r", F.col("n") + 1, F.greatest(F.size("r"), F.lit(1))).alias("r"))
    return cut.select(
        F.col("pair").alias(pair), F.col("n").cast("long").alias("prompt_turns"), _joined(F.col("p")).alias("prompt"),
        _joined(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), _joined(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"),
        ((F.size("c") > 0) & (F.size("r") > 0)).alias("usable"),
    )


ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
c AS (SELECT * FROM numbered WHERE side = 0), r AS (SELECT * FROM numbered WHERE side = 1),
compared AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.i, r.i) AS i, coalesce(c.role = r.role AND c.text = r.text, false) AS same FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.i = r.i),
cut AS (SELECT pair_id, coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS n FROM compared GROUP BY pair_id),
rendered AS (SELECT pair_id, side, i, n, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s FROM numbered JOIN cut USING (pair_id)),
spans AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM rendered WHERE i > n),
prompts AS (SELECT pair_id, string_agg(s, '' ORDER BY i) AS prompt FROM rendered WHERE side = 0 AND i <= n GROUP BY pair_id),
completions AS (SELECT pair_id, side, string_agg(s, '' ORDER BY i) AS s, string_agg(a || ':' || (a + length(s)) || ':' || (role = 'assistant')::INT, ',' ORDER BY i) AS mask FROM spans GROUP BY pair_id, side)
SELECT cut.pair_id, cut.n::BIGINT AS prompt_turns, coalesce(prompt, '') AS prompt, coalesce(x.s, '') AS chosen, coalesce(x.mask, '') AS chosen_mask, coalesce(y.s, '') AS rejected, coalesce(y.mask, '') AS rejected_mask, (x.s IS NOT NULL AND y.s IS NOT NULL) AS usable
FROM cut LEFT JOIN prompts USING (pair_id) LEFT JOIN completions x ON x.pair_id = cut.pair_id AND x.side = 0 LEFT JOIN completions y ON y.pair_id = cut.pair_id AND y.side = 1"""
