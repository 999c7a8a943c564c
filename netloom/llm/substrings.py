"""Removal of repeated passages: level-wise doubling of repeated word windows.

A window of `window` words is repeated if its words begin anywhere else, in the same document or another. The levels
have the lengths window / 4, window / 2 and window, rounded up (9, 18 and 35 words). At each level below the last a full
window stands for its anchor, the one of least hash among the shorter windows of that length inside it, so equal full
windows have equal anchors. Anchors that are found at one place alone end their full windows; those found at two places
are extended to twice the length, and so on until no candidate survives or the full length is reached. Every word that
a repeated full window covers is removed. All levels look at the input as it is.

Documents (a stored table, or one that is computed alike each time) are dealt at random into chunks of about `chunk_bytes`, written once as a table bucketed by chunk in the
shared folder, so that no level shuffles a text. At each level a chunk sends every different hash of its candidates once,
marked if it stands at two places there, and gets back those that are repeated. A passage in many documents is one row of
a chunk, however often it occurs, so no key is hot. Anchors are told apart by 64 bits, full windows by 128.

Null text counts as empty: no words, nothing removed, text "". Texts shorter than a window lose nothing, but their white
space becomes single spaces as in every other text. Repeated rows remove each other's windows. An empty table gives an
empty result. All columns are kept but those named n_words and n_removed, which the result's own replace; columns may
have any names that do not begin with "__". A text longer than a chunk is a chunk with one task.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import new_folder, written
from .textops import U64, Words, covered, per_text

WINDOW = 35
CHUNK_BYTES = 4 << 20
#: Buckets of the chunk table at most; Spark allows 100,000. A bucket may hold any number of chunks.
BUCKETS = 20_000


def levels(window: int) -> list[int]:
    """Lengths that double up to the window: 9, 18, 35."""
    return [-(-window // 4), -(-window // 2), window] if window >= 8 else [window]


def least_of(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    rest = width - have
    return np.minimum(a[:-rest], a[rest:]) if rest else a


class Windows:
    """The full windows of a chunk's texts."""

    def __init__(self, column: pa.Array, window: int):
        self.words, self.window = Words(column), window
        self.first = self.words.windows(window)[1]

    def hashes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each full window its anchor of that length, or itself, and 64 more bits that tell full windows apart."""
        if not len(self.first):
            return np.zeros(0, U64), np.zeros(0, U64)
        if length == self.window:
            return self.words.windows(length)[0], self.words.windows(length, 1)[0]
        some, at = self.words.windows(length)
        every = np.full(len(self.words.start) - length + 1, ~U64(0))
        every[at] = some
        return least_of(every, self.window - length + 1)[self.first], np.zeros(len(self.first), U64)

    def places(self, length: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of that length, wherever a live full window is; those may stand at two places."""
        if length == self.window:
            h, g = self.hashes(length)
            return h[live], g[live]
        h, at = self.words.windows(length)
        near = covered(self.first[live], self.window - length + 1, len(self.words.start))[at]
        return h[near], np.zeros(int(near.sum()), U64)


def different(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different pair of hashes, and how often it occurs."""
    by = np.lexsort((g, h)) if g.any() else np.argsort(h)
    h, g = h[by], g[by]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[first], g[first], np.diff(np.r_[first, len(h)])


def among(h: np.ndarray, g: np.ndarray, answer: pa.Table) -> np.ndarray:
    """Which pairs of hashes are rows of the answer."""
    if not answer.num_rows or not len(h):
        return np.zeros(len(h), bool)
    x, y = (answer.column(c).to_numpy().view(U64) for c in ("h", "g"))
    if not y.any():
        return np.isin(h, x, kind="sort")
    by = np.lexsort((y, x))
    x, y = x[by], y[by]
    lo, hi = np.searchsorted(x, h, "left"), np.searchsorted(x, h, "right")
    out = np.zeros(len(h), bool)
    for step in range(int((hi - lo).max())):
        at = np.minimum(lo + step, len(x) - 1)
        out |= (lo + step < hi) & (y[at] == g)
    return out


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs with the kept words joined by single spaces as text, and n_words and n_removed."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    chunks = total // chunk_bytes + 1
    buckets = int(min(max(1, -(-chunks // 2)), BUCKETS))
    dealt = docs.withColumn(text, F.col(text).cast("string")).withColumn("__chunk", F.floor(F.rand(7) * chunks).cast("long"))
    name = f"netloom_{uuid.uuid4().hex}"
    folder = new_folder(spark, "chunks")
    dealt.repartition(buckets, "__chunk").write.bucketBy(buckets, "__chunk").option("path", folder).option("compression", "zstd").format("parquet").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved here; the files stay when the catalogue entry goes
    spark.sql(f"DROP TABLE {name}")
    none = pa.table({c: pa.array([], pa.int64()) for c in ("chunk", "h", "g")})
    texts, schema = table.select("__chunk", text), "chunk long, h long, g long, many boolean"

    def live(w: Windows, answer: pa.Table, length: int | None) -> np.ndarray:
        return np.ones(len(w.first), bool) if length is None else among(*w.hashes(length), answer)

    def asking(length: int, before: int | None):
        def ask(part: pa.Table, answer: pa.Table) -> pa.Table:
            if not part.num_rows or (before and not answer.num_rows):
                h = g = n = np.zeros(0, U64)
            else:
                w = Windows(part.column(text), window)
                alive = live(w, answer, before)
                h, g = w.hashes(length)
                h, g, n = different(h[alive], g[alive])
                if len(h) and length < window:  # an anchor of many windows may stand at one place: count places, not windows
                    a, b, times = different(*w.places(length, alive))
                    n = times[np.searchsorted(a, h)]
            chunk = part.column("__chunk")[0].as_py() if part.num_rows else 0
            return pa.table({"chunk": pa.array(np.full(len(h), chunk), pa.int64()), "h": pa.array(h.view(np.int64)), "g": pa.array(g.view(np.int64)), "many": pa.array(n > 1)})

        return ask if before else lambda part: ask(part, none)

    answers, before = None, None
    for length in levels(window):
        ask = asking(length, before)
        asked = texts.groupBy("__chunk").applyInArrow(ask, schema) if answers is None else texts.groupBy("__chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask, schema)
        same = Window.partitionBy("h", "g")
        found = asked.select("*", F.count("*").over(same).alias("n"), F.max("many").over(same).alias("twice")).where("n > 1 OR twice")
        answers, before = written(found.select("chunk", "h", "g"), f"repeated-{length}"), length
        if answers.isEmpty():
            break  # no candidate survives, so no full window is repeated

    def cut(part: pa.Table, answer: pa.Table) -> pa.Table:
        w = Windows(part.column(text), window)
        words, n = w.words, len(w.words.start)
        gone = covered(w.first[among(*w.hashes(window), answer)], window, n) if answer.num_rows and n else np.zeros(n, bool)
        data, of = words.data.tobytes(), words.of
        out = []
        removed = per_text(gone, of)
        for d in range(part.num_rows):
            if removed[d]:
                keep = np.flatnonzero(~gone[of[d] : of[d + 1]]) + of[d]
                out.append(b" ".join([data[a:b] for a, b in zip(words.start[keep].tolist(), words.end[keep].tolist())]).decode())
            else:
                out.append(b" ".join(data[words.at[d] : words.at[d + 1]].split()).decode())
        i = part.column_names.index(text)
        part = part.set_column(i, text, pa.array(out, pa.string())).select(kept)
        return part.append_column("n_words", pa.array(words.counts())).append_column("n_removed", pa.array(removed))

    schema = docs.withColumn(text, F.col(text).cast("string")).drop("n_words", "n_removed").schema
    kept = [f.name for f in schema]
    schema = schema.add("n_words", "long").add("n_removed", "long")
    return table.groupBy("__chunk").cogroup(answers.groupBy("chunk")).applyInArrow(cut, schema)
