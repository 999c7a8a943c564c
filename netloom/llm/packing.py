"""Best-fit packing into bins of several permitted lengths, chosen jointly.

A text's length is its number of tokens (of the given vocabulary, whose tokens never cross white space), or of words
where no vocabulary is given. A text longer than the greatest capacity is cut between words into pieces; a single word
beyond it is cut into halves until each fits. Pieces are spans of bytes that cover the whole text, so nothing is dropped.

Pieces are dealt at random (by a hash of their row) into groups of about `group_tokens`; each group is packed by itself.
Every mix of capacities that holds the group's longest piece is tried: best-fit, longest piece first, each into the open
bin of the mix that it leaves with the least room; if none has room, the capacity of the mix with the least cost a token
is opened, counting only what the pieces still to come can fill; at the end each bin is shortened to the least permitted
length that holds its contents. The mix with the least total cost is kept. A bin costs its tokens, a part that grows with
their square (attention) and a fixed part.

Null and empty texts have one row with no bin. Repeated rows are separate pieces, and pieces of one length are packed in
the order of their rows. An empty table gives an empty result. Extra columns are ignored. A long text is one task's work,
its pieces are not.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import written
from .textops import Words, slices
from .tokens import encoder

CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Cost of a bin besides its tokens: what starting one more sequence costs, and the length at which attention costs as much as all else.
OPENING, ATTENTION = 16, 16_384
GROUP_TOKENS = 4_000_000


def cost(capacity: int) -> float:
    return capacity + OPENING + capacity * capacity / ATTENTION


def pack(lengths: np.ndarray, mix, capacities=CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit with bins of the mix: bin of each length (given in descending order), its offset there, and the final capacity of each bin."""
    mix, capacities = sorted(mix), np.array(sorted(capacities))
    price = {c: cost(c) for c in mix}
    room: dict[int, list[int]] = {}
    mask, fill = 0, []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = int(lengths.sum())
    for i, n in enumerate(lengths.tolist()):
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            r = min((c for c in mix if c >= n), key=lambda c: (price[c] / min(c, left), c))
            b = len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        left -= n
        if r > n:
            room.setdefault(r - n, []).append(b)
            mask |= 1 << (r - n)
    return bins, offsets, capacities[np.searchsorted(capacities, fill)] if fill else np.zeros(0, np.int64)


def pack_jointly(lengths: np.ndarray, capacities=CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pack() with the mix of capacities whose bins cost least in the end."""
    if len(capacities) > 8:
        raise ValueError("all mixes of capacities are tried: give 8 at most")
    prices = {c: cost(c) for c in capacities}
    best = None
    for k in range(1, len(capacities) + 1):
        for mix in itertools.combinations(sorted(capacities), k):
            if len(lengths) and mix[-1] < lengths[0]:
                continue
            found = pack(lengths, mix, capacities)
            total = sum(prices[c] * n for c, n in zip(*(x.tolist() for x in np.unique(found[2], return_counts=True))))
            if best is None or total < best[0]:
                best = total, found
    return best[1]


def _halves(word: str, most: int, count) -> list[tuple[int, int]]:
    """(bytes, tokens) of the runs that a word of more than `most` tokens is cut into."""
    n = count(word)
    if n <= most or len(word) < 2:
        return [(len(word.encode()), n)]
    half = len(word) // 2
    return _halves(word[:half], most, count) + _halves(word[half:], most, count)


def _spans(words: Words, tokens: np.ndarray, text: int, most: int, count) -> list[tuple[int, int]]:
    """(first byte, tokens) of each piece of one text."""
    a, b, begin = words.of[text], words.of[text + 1], words.at[text]
    start, size = [], []
    for w in np.flatnonzero(tokens[a:b] > most):  # rare: words that need cutting themselves
        start.append(int(w))
        size.append(_halves(words.data[words.start[a + w] : words.end[a + w]].tobytes().decode(), most, count))
    at, n, last = [], [], 0
    for w, parts in [*zip(start, size), (b - a, [])]:
        at.append(words.start[a + last : a + w] - begin)
        n.append(tokens[a + last : a + w])
        where = int(words.start[a + w] - begin) if w < b - a else 0
        for width, k in parts:
            at.append(np.array([where]))
            n.append(np.array([k]))
            where += width
        last = w + 1
    at, total = np.concatenate(at), np.concatenate([[0], np.cumsum(np.concatenate(n))])
    out, i = [], 0
    while i < len(at):
        j = max(int(np.searchsorted(total, total[i] + most, "right")) - 1, i + 1)
        out.append((int(at[i]) if i else 0, int(total[j] - total[i])))
        i = j
    return out


def pieces(docs: DataFrame, key: str, most: int, path: str | None = None, texts: bool = False) -> DataFrame:
    """__row, __key, piece, first_byte, n_bytes, n_tokens of each piece of each text, with its text if asked for."""
    names = ["__row", "__key", "piece", "first_byte", "n_bytes", "n_tokens", *(["text"] if texts else [])]

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        count = (lambda w: len(encoder(path).tokenizer.encode(w, add_special_tokens=False))) if path else lambda w: 1
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                tokens = encoder(path).per_word(words) if path else np.ones(len(words.start), np.int64)
                total = np.concatenate([[0], np.cumsum(tokens)])[words.of]
                total = total[1:] - total[:-1]
                of, first, n = [np.flatnonzero(total <= most)], [], [total[total <= most]]
                first.append(np.zeros(len(of[0]), np.int64))
                for t in np.flatnonzero(total > most):
                    cut = np.array(_spans(words, tokens, t, most, count), np.int64).reshape(-1, 2)
                    of.append(np.full(len(cut), t))
                    first.append(cut[:, 0])
                    n.append(cut[:, 1])
                of, first, n = (np.concatenate(x) for x in (of, first, n))
                by = np.argsort(of, kind="stable")
                of, first, n = of[by], first[by], n[by]
                same = np.r_[of[1:] == of[:-1], False] if len(of) else np.zeros(0, bool)
                end = np.where(same, np.roll(first, -1), np.diff(words.at)[of])
                piece = np.arange(len(of)) - np.searchsorted(of, of)
                columns = [pa.array(row + of), part.column("key").take(pa.array(of)), pa.array(piece), pa.array(first), pa.array(end - first), pa.array(n)]
                if texts:
                    data, at = words.data.tobytes(), words.at[of]
                    columns.append(pa.array([data[a:b].decode() for a, b in zip((at + first).tolist(), (at + end).tolist())], pa.string()))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = StructType([StructField("__row", LongType()), StructField("__key", docs.schema[key].dataType), *(StructField(c, LongType()) for c in names[2:6])])
    if texts:
        schema = schema.add("text", "string")
    return docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_fit(docs: DataFrame, key: str = "doc_id", path: str | None = None, capacities=CAPACITIES, group_tokens: int = GROUP_TOKENS, texts: bool = False) -> DataFrame:
    """key, piece, first_byte, n_bytes, n_tokens, bin_id, bin_capacity, bin_offset, and the text of the piece if asked for; bins are null for texts without words."""
    cut = written(pieces(docs, key, max(capacities), path, texts), "pieces")
    total = cut.agg(F.sum("n_tokens")).first()[0] or 0
    full = cut.where("n_tokens > 0").withColumn("__group", F.pmod(F.xxhash64("__row", "piece"), F.lit(int(total // group_tokens + 1))))
    schema = StructType([f for f in cut.schema if f.name not in ("__row", "text")])
    for c in ("bin_id", "bin_capacity", "bin_offset"):
        schema = schema.add(c, "long")
    if texts:
        schema = schema.add("text", "string")

    def run(table: pa.Table) -> pa.Table:
        n, row, piece = (table.column(c).to_numpy() for c in ("n_tokens", "__row", "piece"))
        by = np.lexsort((piece, row, -n))
        bins, offsets, final = pack_jointly(n[by], capacities)
        found = dict(zip(("bin_id", "bin_capacity", "bin_offset"), ((table.column("__group")[0].as_py() << 32) | bins, final[bins], offsets)))
        table = table.take(pa.array(by))
        return pa.table([pa.array(found[f.name], pa.int64()) if f.name in found else table.column(f.name) for f in schema], names=schema.names)

    packed = full.groupBy("__group").applyInArrow(run, schema)
    none = cut.where("n_tokens = 0").withColumns({c: F.lit(None).cast("long") for c in ("bin_id", "bin_capacity", "bin_offset")})
    return packed.unionByName(none.select(schema.names)).withColumnRenamed("__key", key)
