"""Removal of lines that stand in several documents, all but those of the last document that has them.

A line's key is the line without white space at its ends, A-Z in lower case. Each line long enough sends a 64-bit hash
of its key with its place. A task first joins the hashes of a block of lines: of those that are equal only the first goes
on, marked, so that a very frequent line is one row for each block and not one for each document. Hashes are dealt to
segments of bounded size, whose number grows with the lines. Each segment keeps two Bloom filters, for hashes seen once
and for hashes seen again. A line whose hash was seen before is suspected at once; the first line of each hash waits and
is suspected at the end if the second filter has it. Only suspected lines are shuffled as text: they are grouped by
key, so that documents are counted exactly and the last of them is known. A filter can only suspect too much, which the
exact count then clears.

Texts are stored once, bucketed by row number, and joined with suspected and with dropped places without a shuffle.

Null or empty text is one empty line. Every row is a document: rows with the same key value count each, and lines stay in
all rows that have the greatest one; a null key value is less than any other. Lines are dropped from the input as it is.
A document may lose all its lines; its text is then empty. An empty table gives an empty result. Columns are kept but
for n_lines and n_dropped, which the result's own replace; names may not begin with "__". A very long text is one row.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import new_folder, salted, written
from .spelling import ascii_lower
from .textops import U64, mix64

SPACE = " \t\n\x0b\x0c\r"
BUCKET_BYTES = 32 << 20
#: Buckets at most; Spark allows 100,000.
BUCKETS = 20_000
#: Hashes that a task joins before it sends them.
LOCAL = 1 << 20
#: Hashes of a segment, and bits of each of its filters: 16 for a hash, of which four are set.
SEGMENT = 1 << 18
BITS = 1 << 22
PROBES = 4


class Bloom:
    """A set of 64-bit hashes that may have more members than were added, never fewer."""

    def __init__(self, bits: int = BITS):
        self.bits, self.field = bits, np.zeros(bits // 8, np.uint8)

    def _places(self, h: np.ndarray):
        with np.errstate(over="ignore"):
            step = mix64(h) | U64(1)
            for k in range(PROBES):
                yield ((h + U64(k) * step) >> U64(20)) % U64(self.bits)

    def add(self, h: np.ndarray) -> None:
        for at in self._places(h):
            np.bitwise_or.at(self.field, at >> U64(3), np.left_shift(np.uint8(1), (at & U64(7)).astype(np.uint8)))

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self._places(h):
            found &= (self.field[at >> U64(3)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def _columns(batches: list[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    return [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in names]


def first_of_block(batches):
    """Places with kind 0 where an equal hash stands before them in the block, else 1, or 2 if one stands behind."""

    def joined(held):
        row, pos, h = _columns(held, "__row", "__pos", "h")
        _, first, times = np.unique(h, return_index=True, return_counts=True)
        kind = np.zeros(len(h), np.int32)
        kind[first] = np.where(times > 1, 2, 1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (row, pos, h, kind)], ["__row", "__pos", "h", "kind"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= LOCAL:
            yield joined(held)
            held, n = [], 0
    if n:
        yield joined(held)


class Segment:
    """Hashes of one segment as they come: filters for those seen once and again, and the first places, which wait."""

    def __init__(self):
        self.once, self.again, self.waiting = Bloom(), Bloom(), []

    def take(self, row: np.ndarray, pos: np.ndarray, h: np.ndarray, twice: np.ndarray):
        """Suspected places of these; the others wait."""
        different, which, times = np.unique(h, return_inverse=True, return_counts=True)
        seen = self.once.has(different)
        more = seen | (times > 1) | (np.bincount(which, twice, len(different)) > 0)
        self.again.add(different[more])
        self.once.add(different[~seen])
        now = more[which]
        self.waiting.append((row[~now], pos[~now], h[~now]))
        return row[now], pos[now]

    def rest(self):
        row, pos, h = (np.concatenate(x) for x in zip(*self.waiting))
        late = self.again.has(h)
        return row[late], pos[late]


def seen_again(batches):
    """Suspected places (__row, __pos) of rows sorted by segment."""
    batch_of = lambda places: pa.RecordBatch.from_arrays([pa.array(x) for x in places], ["__row", "__pos"])
    at, segment = None, None
    for batch in batches:
        number, row, pos, h, kind = _columns([batch], "segment", "__row", "__pos", "h", "kind")
        cuts = np.r_[0, np.flatnonzero(np.diff(number)) + 1, len(number)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if segment is None or number[a] != at:
                if segment is not None:
                    yield batch_of(segment.rest())
                at, segment = number[a], Segment()
            yield batch_of(segment.take(row[a:b], pos[a:b], h[a:b].view(U64), kind[a:b] == 2))
    if segment is not None:
        yield batch_of(segment.rest())


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def suspected_places(texts: DataFrame, text: str, least_chars: int) -> DataFrame:
    """(__row, __pos) of all lines whose key may stand at two places; some others may be among them."""
    lines = texts.select("__row", F.posexplode(F.split(text, "\n", -1)).alias("__pos", "__line")).withColumn("__key", line_key(F.col("__line")))
    hashes = lines.where(F.length("__key") >= least_chars).select("__row", "__pos", F.xxhash64("__key").alias("h"))
    local = written(hashes.mapInArrow(first_of_block, "__row long, __pos int, h long, kind int"), "line-hashes")
    sent = local.where("kind > 0")
    segments = sent.count() // SEGMENT + 1
    dealt = sent.withColumn("segment", F.pmod(F.xxhash64("h"), F.lit(segments))).repartition("segment").sortWithinPartitions("segment")
    return local.where("kind = 0").select("__row", "__pos").unionByName(dealt.mapInArrow(seen_again, "__row long, __pos int"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """docs without the lines whose key (of at least `least_chars` code points) stands in at least `least_docs` documents,
    but for those of the greatest `key`; with n_lines before and n_dropped."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets = int(min(total // BUCKET_BYTES + 1, BUCKETS))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped") or c in (key, text)]
    rows = docs.select(own).withColumns({text: F.coalesce(F.col(text).cast("string"), F.lit("")), "__row": F.monotonically_increasing_id()})
    name, folder = f"netloom_{uuid.uuid4().hex}", new_folder(spark, "texts")
    rows.repartition(buckets, "__row").write.bucketBy(buckets, "__row").option("path", folder).option("compression", "zstd").format("parquet").saveAsTable(name)
    texts = spark.table(name)
    texts.schema  # resolved here; the files stay when the catalogue entry goes
    spark.sql(f"DROP TABLE {name}")

    places = suspected_places(texts, text, least_chars).groupBy("__row").agg(F.collect_list("__pos").alias("__at"))
    # explode() of one array keeps the optimiser from splitting the text once for each place
    split = F.explode(F.array(F.split(text, "\n", -1))).alias("__lines")
    found = texts.select("__row", F.col(key).alias("__doc"), text).join(places, "__row").select("__row", "__doc", "__at", split)
    found = found.select("__row", "__doc", F.explode(F.transform("__at", lambda p: F.struct(p.alias("p"), F.get("__lines", p).alias("line")))).alias("x"))
    suspected = found.select("__row", "__doc", F.col("x.p").alias("__pos"), line_key(F.col("x.line")).alias("__key"))
    held = written(suspected.groupBy("__key", "__row").agg(F.first("__doc").alias("__doc"), F.collect_list("__pos").alias("__at")), "suspected-lines")
    repeated = held.groupBy("__key").agg(F.count("*").alias("__docs"), F.max("__doc").alias("__last")).where(F.col("__docs") >= least_docs).drop("__docs")
    gone = salted(held, repeated, "__key", "__row").where(~F.col("__doc").eqNullSafe(F.col("__last")))
    gone = gone.groupBy("__row").agg(F.flatten(F.collect_list("__at")).alias("__gone"))

    cut = texts.join(gone, "__row", "left").select(*own, "__gone", split)
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    left = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda p: F.get("__lines", p)), "\n"))
    counts = {"n_lines": F.size("__lines").cast("long"), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}
    return cut.withColumns(counts | {text: left}).select(*own, *counts)


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, line, i, r.key IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
