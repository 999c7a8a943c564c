"""Token counts with overlap resynchronisation of huge texts.

A text of up to `chunk` characters is one chunk. A longer one is cut into chunks that overlap; the chunks become rows
of their own, are dealt over all tasks and encoded with offsets. Two neighbours are spliced at a boundary that both
report in their overlap: a white-space character outside every token, followed by the same number of tokens up to the
same next boundary. The tokenizer drops white space and never looks across it, so such a boundary is stable: tokens
before it come from the left chunk and tokens after it from the right one. Texts with an overlap that has no such
boundary are cut anew with a four times wider overlap, and in the end encoded whole.

Texts of one chunk are encoded word by word, each different word once in a worker (the same stable boundaries).

Null text is empty: no bytes, no tokens. Repeated rows are counted alike; an empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import written
from .textops import Words, per_text, slices

CHUNK = 32_768
OVERLAP = 256
WIDEST = 16_384
#: Different words whose counts a worker remembers; beyond that it starts anew.
REMEMBERED = 3_000_000
_WHITE = frozenset(" \t\n\v\f\r")


class Encoder:
    """The tokenizer of one worker, with the counts of the words that it has seen."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        words = Words(column)
        return per_text(self.per_word(words), words.of)

    def per_word(self, words: Words) -> np.ndarray:
        """Tokens of each word."""
        key, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, key), max(len(self.known) - 1, 0))
        n = self.counts[at].astype(np.int64) if len(self.known) else np.zeros(len(key), np.int64)
        new = np.flatnonzero(self.known[at] != key) if len(self.known) else np.arange(len(key))
        if len(new):
            data = words.data.tobytes()
            texts = [data[a:b].decode() for a, b in zip(words.start[first[new]].tolist(), words.end[first[new]].tolist())]
            n[new] = [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            if len(self.known) + len(new) > REMEMBERED:
                self.known, self.counts = self.known[:0], self.counts[:0]
            to = np.searchsorted(self.known, key[new])
            self.known, self.counts = np.insert(self.known, to, key[new]), np.insert(self.counts, to, n[new])
        return n[inverse]

    def boundaries(self, text: str, start: int, head: int, tail: int):
        """Tokens of the text, and the stable boundaries before `head` and from `tail` on (counted in the whole text).

        A boundary is (where, where the next one is, tokens between them); the tokens before it are a second list.
        """
        ends = np.array([b for _, b in self.tokenizer.encode(text, add_special_tokens=False).offsets], np.int64)
        white = np.array([i for i, c in enumerate(text) if c in _WHITE], np.int64)
        before = np.searchsorted(np.sort(ends), white, "right")
        rows = np.stack([white[:-1] + start, white[1:] + start, np.diff(before)], 1) if len(white) > 1 else np.zeros((0, 3), np.int64)
        out = [len(ends)]
        for part in (rows[:, 0] < head, rows[:, 0] >= tail):
            out += [rows[part].tolist(), before[:-1][part].tolist() if len(white) > 1 else []]
        return out


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


def _chunks(huge: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Rows (id, n_bytes, k, last, start, text) of overlapping chunks, dealt over all tasks."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                starts = list(range(0, max(len(text) - overlap, 1), chunk))
                for k in range(0, len(starts), 64):
                    part = starts[k : k + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(c)[i].as_py()] * len(part), batch.column(c).type) for c in ("row", "key", "n_bytes")] + [pa.array([s // chunk for s in part], pa.int64()), pa.array([s == starts[-1] for s in part]), pa.array(part, pa.int64()), pa.array([text[s : len(text) if s == starts[-1] else s + chunk + overlap] for s in part])],
                        ["row", "key", "n_bytes", "k", "last", "start", "text"],
                    )

    kind = huge.schema["key"].dataType.simpleString()
    n = int(huge.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return huge.mapInArrow(run, f"row long, key {kind}, n_bytes long, k long, last boolean, start long, text string").repartition(n, "row", "k")


def _splice(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(row, key, n_bytes, n_tokens, open): open counts the seams without a common stable boundary."""
    bounds = "array<struct<p:long,q:long,n:long>>"
    kind = huge.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                start, last, text = batch.column("start")[i].as_py(), batch.column("last")[i].as_py(), batch.column("text")[i].as_py()
                n, head, head_n, tail, tail_n = encoder(path).boundaries(text, start, start + overlap if start else 0, start + len(text) + 1 if last else start + chunk)
                rows.append((n, [dict(zip("pqn", x)) for x in head], head_n, [dict(zip("pqn", x)) for x in tail], tail_n))
            s = pa.list_(pa.struct([(c, pa.int64()) for c in "pqn"]))
            kinds = [pa.int64(), s, pa.list_(pa.int64()), s, pa.list_(pa.int64())]
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "key", "n_bytes", "k", "last")] + columns, ["row", "key", "n_bytes", "k", "last", "n", "head", "head_n", "tail", "tail_n"])

    encoded = written(_chunks(huge, chunk, overlap).mapInArrow(run, f"row long, key {kind}, n_bytes long, k long, last boolean, n long, head {bounds}, head_n array<long>, tail {bounds}, tail_n array<long>"), "encoded")
    left = encoded.where("NOT last").select("row", "key", "n_bytes", (F.col("k") + 1).alias("k"), "tail", "tail_n")
    right = encoded.where("k > 0").select("row", "k", "head", "head_n")
    common = F.element_at(F.array_sort(F.array_intersect("tail", "head")), 1)
    seams = left.join(right, ["row", "k"]).withColumn("common", F.when(F.size(F.array_intersect("tail", "head")) > 0, common))

    def before(side):
        return F.element_at(f"{side}_n", F.array_position(side, F.col("common")).cast("int"))

    spliced = seams.select("row", "key", "n_bytes", F.when(F.col("common").isNotNull(), before("tail") - before("head")).alias("n"), F.col("common").isNull().cast("long").alias("open"))
    ends = encoded.where("last").select("row", "key", "n_bytes", "n", F.lit(0).cast("long").alias("open"))
    return spliced.unionByName(ends).groupBy("row", "key", "n_bytes").agg(F.sum("n").alias("n_tokens"), F.sum("open").alias("open"))


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, n_bytes, n_tokens of every text; path is the vocabulary file, readable on every worker."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def short(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n_bytes"), pa.array(encoder(path).count(part.column("text")))], ["key", "n_bytes", "n_tokens"])

    schema = f"key {kind}, n_bytes long, n_tokens long"
    out = [rows.where(F.length("text") <= chunk).select("key", "n_bytes", "text").mapInArrow(short, schema)]
    huge, todo = written(rows.where(F.length("text") > chunk), "huge"), None  # stored, so that row numbers stay
    while overlap <= WIDEST:
        spliced = written(_splice(huge if todo is None else huge.join(todo, "row", "left_semi"), path, chunk, overlap), "spliced")
        out.append(spliced.where("open = 0").select("key", "n_bytes", "n_tokens"))
        todo = spliced.where("open > 0").select("row")
        if todo.isEmpty():
            break
        overlap *= 4
    else:
        whole = huge.join(todo, "row", "left_semi").select("key", "n_bytes", "text")

        def encode(batches):
            for batch in batches:
                n = [len(encoder(path).tokenizer.encode(t, add_special_tokens=False)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["key", "n_bytes", "n_tokens"])

        out.append(whole.mapInArrow(encode, schema))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result.select(F.col("key").alias(key), "n_bytes", "n_tokens")
