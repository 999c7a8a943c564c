"""Fill-in-middle: documents cut at two unit ordinals and rendered as prefix, suffix and middle between sentinels.

A unit is a match of UNIT: white space with the word after it, or white space alone at the end. The cuts of a document
are requests for unit ordinals, fixed by the hash of its key. Units are rows: a text is exploded into pieces that end
where a unit ends, these into matches with their ordinal. Lengths of the units of a block are summed before the shuffle,
but for the two blocks that hold a cut, whose units stay rows. A window gives the running sum of lengths before each
ordinal; the cut requests are joined to it by ordinal, their offsets aggregated for each document and joined to the
text, which is then cut by substring. Texts that stay plain are never shuffled, the others once.

Null or empty text is plain with 0 units and output "". A null key hashes as "". Rows with the same key are cut on their
own, so repeated rows give repeated results. An empty table gives an empty result. Columns are kept, but those named like
a result (RESULT) are replaced; names may not begin with "__". A very long text is one row, but no more than a piece of
some 65,536 code points (or its longest word) is held as matches at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import written

_SPACE = r"\x20\x09-\x0D"
UNIT = f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+"
#: Ends at the end of a unit, whatever follows.
PIECE = rf"(?s).{{1,65536}}[{_SPACE}]*[^{_SPACE}]*"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULT = ["n", "form", "prefix_chars", "middle_chars", "output"]
#: Units whose lengths are one row of the shuffle.
BLOCK = 16


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _hashed(key: Column, seed: int) -> list[Column]:
    """Four unsigned integers from the digest of `seed:key`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cut_offsets(requested: DataFrame, text: str) -> DataFrame:
    """(__row, __a, __b): code points before the units of ordinals __lo and __hi; null for an ordinal past the last unit.

    requested has __row (unique), the text, __sizes (units of each piece) and the two ordinals.
    """
    parts = requested.select("__row", "__lo", "__hi", "__sizes", F.posexplode(_found(F.col(text), PIECE)).alias("__piece", "__part"))
    before = F.aggregate(F.slice("__sizes", F.lit(1), F.col("__piece")), F.lit(0).cast("long"), lambda a, x: a + x)
    matches = parts.select("__row", "__lo", "__hi", before.alias("__before"), F.posexplode(_found(F.col("__part"), UNIT)).alias("__at", "__unit"))
    units = matches.select("__row", "__lo", "__hi", (F.col("__before") + F.col("__at")).alias("__ordinal"), F.length("__unit").cast("long").alias("__chars"))
    block = F.expr(f"__ordinal div {BLOCK}")
    single = (block == F.expr(f"__lo div {BLOCK}")) | (block == F.expr(f"__hi div {BLOCK}"))
    sums = units.groupBy("__row", F.when(single, F.col("__ordinal")).otherwise(block * BLOCK).alias("__ordinal"), single.alias("__single")).agg(F.sum("__chars").alias("__chars"))
    running = Window.partitionBy("__row").orderBy("__ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = sums.withColumn("__offset", F.sum("__chars").over(running) - F.col("__chars")).where("__single").select("__row", "__ordinal", "__offset")
    asked = requested.select("__row", F.array("__lo", "__hi").alias("__asked"))  # by row alone, as the window deals its rows, which so stay where they are
    found = at.join(asked, "__row").where(F.array_contains("__asked", F.col("__ordinal")))
    return found.groupBy("__row").agg(*(F.max(F.when(F.col("__ordinal") == F.col("__asked")[k], F.col("__offset"))).alias(name) for k, name in ((0, "__a"), (1, "__b"))))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs with n units, the form (plain, psm, spm), prefix_chars, middle_chars and the output.

    Of 100 documents about `rate` are cut, and of those `spm` in 100 have the suffix first.
    """
    own = [c for c in docs.columns if c not in RESULT or c in (key, text)]
    h1, h2, h3, h4 = _hashed(F.col(key), seed)
    rows = docs.select(own).withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    sentinel = F.col(text).contains(PREFIX) | F.col(text).contains(SUFFIX) | F.col(text).contains(MIDDLE)
    rows = rows.withColumns({"__plain": (F.col(text) == "") | sentinel | (h3 % 100 >= rate), "__sizes": F.transform(_found(F.col(text), PIECE), lambda p: F.size(_found(p, UNIT)))})
    rows = rows.withColumn("n", F.aggregate("__sizes", F.lit(0).cast("long"), lambda a, x: a + x))
    nothing = F.lit(None).cast("long")
    plain = rows.where("__plain").select(*own, "n", F.lit("plain").alias("form"), nothing.alias("prefix_chars"), nothing.alias("middle_chars"), F.col(text).alias("output"))
    u, v = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cut = rows.where("NOT __plain").withColumns({"__row": F.monotonically_increasing_id(), "__lo": F.least(u, v), "__hi": F.greatest(u, v), "form": F.when(h4 % 100 < spm, "spm").otherwise("psm")})
    cut = written(cut.drop("__plain"), "cut-requests", compression="zstd")
    length = F.length(text).cast("long")
    cut = cut.join(cut_offsets(cut, text), "__row", "left").withColumns({"__a": F.coalesce("__a", length), "__b": F.coalesce("__b", length)})
    prefix, middle, suffix = (F.substring(text, a, n) for a, n in ((F.lit(1), F.col("__a")), (F.col("__a") + 1, F.col("__b") - F.col("__a")), (F.col("__b") + 1, length)))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    return plain.unionByName(cut.select(*own, "n", "form", F.col("__a").alias("prefix_chars"), (F.col("__b") - F.col("__a")).alias("middle_chars"), output.alias("output")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of; no other place of a text can hold a sentinel."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, sha256('42:' || doc_id) h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') u FROM documents),
e AS (SELECT doc_id, t, u, len(u) n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END form FROM d),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') x, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') y, array_to_string(u[greatest(a, b) + 1:n], '') z FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(CASE form WHEN 'plain' THEN t ELSE x || y || z END) AS restored_sha256
FROM p"""
