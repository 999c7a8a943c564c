"""Sharding by extendible hashing: a directory indexed by leading hash bits, in which only oversized buckets split.

A bucket is a prefix of the hash of the key; its size is the bytes of its texts. The directory holds, for each
bucket, the shortest prefix whose bucket fits the byte limit. Sizes are summed by Spark at a depth a little beyond the
expected one, and shorter prefixes are summed from those few cells; only cells that are still too large are read again
and split on further bits. After all bits of the key's hash, rows of one key split on the hash of their row number. A
single text beyond the limit stays alone in its shard, marked over_limit.

Null text has no bytes; a null key hashes like the empty string. Repeated rows share a bucket until it must split
beyond the key's bits. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from .shared import checkpointed

LIMIT = 32 << 20
BITS = 60


def key_hash(key: str) -> F.Column:
    """The first 60 bits of the MD5 of the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def extendible(docs: DataFrame, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, shard (its prefix as bits), shard_depth, shard_bytes, over_limit."""
    n_bytes = F.coalesce(F.octet_length(F.col("text").cast("string")).cast("long"), F.lit(0).cast("long"))
    rows = checkpointed(docs.select(key, n_bytes.alias("n_bytes"), key_hash(key).alias("h"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << BITS)).alias("r")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 6)
    pending, low, h, before, out = rows.withColumn("lead", F.lit("")), 0, "h", 0, []
    while True:
        cells = pending.groupBy("lead", F.shiftright(h, BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(depth)))).withColumn("bucket", F.expr(f"shiftright(cell, {depth} - depth)"))
        fits = levels.groupBy("lead", "depth", "bucket").agg(F.sum("bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
        best = levels.join(fits, ["lead", "depth", "bucket"]).groupBy("lead", "cell").agg(F.min(F.struct("depth", "bucket", "shard_bytes")).alias("x"))
        directory = checkpointed(cells.join(best, ["lead", "cell"], "left").select("lead", "cell", "bytes", "x"))
        keyed = pending.withColumn("cell", F.shiftright(h, BITS - depth)).join(directory, ["lead", "cell"])
        bits = F.expr("right(lpad(bin(x.bucket), 64, '0'), x.depth)")
        out.append(keyed.where("x IS NOT NULL").select(key, "n_bytes", F.concat("lead", bits).alias("shard"), (F.col("x.depth") + before).alias("shard_depth"), F.col("x.shard_bytes").alias("shard_bytes")))
        last = depth == BITS
        if directory.where("x IS NULL").isEmpty():
            break
        pending = keyed.where("x IS NULL").drop("x")
        if last and h == "r":
            whole = F.expr(f"right(lpad(bin(cell), 64, '0'), {BITS})")
            out.append(pending.select(key, "n_bytes", F.concat("lead", whole).alias("shard"), F.lit(2 * BITS).alias("shard_depth"), F.col("bytes").alias("shard_bytes")))
            break
        if last:
            pending = pending.withColumn("lead", F.concat("lead", F.expr(f"right(lpad(bin(cell), 64, '0'), {BITS})")))
            h, low, depth, before = "r", 1, 8, BITS
        else:
            low, depth = depth + 1, min(BITS, depth + 8)
        pending = checkpointed(pending.drop("cell", "bytes"))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result.withColumns({"shard_depth": F.col("shard_depth").cast("int"), "over_limit": F.col("shard_bytes") > limit})


def oracle_sql(limit: int = LIMIT, deepest: int = 40) -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
levels AS (SELECT doc_id, n_bytes, depth::INT AS depth, h >> ({BITS} - depth) AS bucket FROM d, range(0, {deepest}) AS t(depth)),
sized AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, bucket)::BIGINT AS shard_bytes FROM levels),
best AS (SELECT doc_id, n_bytes, min(depth) AS shard_depth, arg_min(bucket, depth) AS bucket, arg_min(shard_bytes, depth) AS shard_bytes FROM sized WHERE shard_bytes <= {limit} GROUP BY doc_id, n_bytes)
SELECT doc_id, n_bytes, right(lpad(bin(bucket), 64, '0'), shard_depth) AS shard, shard_depth, shard_bytes, false AS over_limit FROM best"""
