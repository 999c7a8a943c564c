"""Near-duplicate texts by ProbMinHash, banding and exact verification.

A text is the weighted set of its runs of five words (a shorter text is one run); a weight is how often a run occurs,
divided by the number of runs. ProbMinHash: each run sends arrivals of a Poisson process whose rate is its weight, each
arrival to a random register; a register keeps the run that arrives first, and a run stops as soon as its next arrival
would come after every register has been reached. Two texts agree in a register with the probability of their
probability Jaccard similarity.

Equal texts are one class. Classes that share a band of registers are candidates. In each band's bucket every class is
compared with a pivot, the class of least hash there, so a group of near copies has mostly one pivot in all bands; of those comparisons each class first verifies two, one of them the one with the most
equal registers, and connected components follow. Then come the other pivots in other components; then classes that
share a bucket with a large component, compared with all its members block by block inside tasks, again and again with
the members that joined last until none joins; then pairs of different small components in one bucket, likewise by
blocks. Each step verifies exactly and components are taken anew,
so that a large group of near copies is joined without a row for each of its pairs. So a link can only be lost by the bands (a chance of 3e-6 at the
threshold) or by the register estimate (below `estimate`, four standard deviations under the threshold), not by skew.

Texts without words link with nothing. Null text counts as empty. Rows of one doc_id count as one document (that of the
least text hash). Rows with a null key are dropped from the result. A key may be an integer or text; component_id is the
least key of its class. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import numbered, salted, written
from .textops import U64, Words, mix64, slices

RUN = 5
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
THRESHOLD = 0.8
ESTIMATE = 0.62
BLOCK = 512
#: Classes that ask for a large component in one task.
ASKS = 4096
#: Classes from which a component is large: those that share a bucket with it are compared with all of it.
LARGE = 64


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each different run of five words; sorted by text and hash."""
    h, i = words.windows(RUN)
    doc = words.doc()[i]
    n = words.counts()
    few = np.flatnonzero((n > 0) & (n < RUN))
    with np.errstate(over="ignore"):
        hashes = words.hashes()
        short = np.array([mix64(np.bitwise_xor.reduce(mix64(hashes[words.of[d] : words.of[d + 1]] + np.arange(n[d], dtype=U64)))[None])[0] for d in few], U64)
    doc, h = np.concatenate([doc, few]), np.concatenate([h, short])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[first], h[first], np.diff(np.r_[first, len(doc)])


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U64(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def prob_min_hash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """texts x registers hashes of the runs that arrived first; weight sums to 1 in each text. 0 in texts without runs."""
    time, winner = np.full(texts * registers, np.inf), np.zeros(texts * registers, U64)
    at, live, step, arrivals = np.zeros(len(h)), np.arange(len(h)), 0, 1
    with np.errstate(over="ignore"):
        while len(live):
            for _ in range(arrivals):
                seed = mix64(h[live] + U64(step + 1) * U64(0x9E3779B97F4A7C15))
                at[live] -= np.log(_uniform(seed)) / weight[live]
                place = doc[live] * registers + (mix64(seed ^ U64(0x5851F42D4C957F2D)) % U64(registers)).astype(np.int64)
                t = at[live]
                np.minimum.at(time, place, t)
                won = time[place] == t
                winner[place[won]] = h[live[won]]
                step += 1
            latest = time.reshape(texts, registers).max(1)
            live = live[at[live] < latest[doc[live]]]
            arrivals = min(2 * arrivals, 8)
    return winner.reshape(texts, registers)


def sketches(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id, same, sig, bands): hash of the whole text, 16 bits of each register, a hash for each band; only texts with words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                words = Words(part.column("text"))
                doc, h, n = shingles(words)
                total = np.bincount(doc, n, part.num_rows)
                found = prob_min_hash(doc, h, n / total[doc], part.num_rows)
                rows = np.flatnonzero(words.counts() > 0)
                with np.errstate(over="ignore"):
                    band = np.zeros((part.num_rows, BANDS), U64)
                    for k in range(ROWS):
                        band = mix64(band * U64(0x9E3779B97F4A7C15) + found[:, k::ROWS])
                    band = mix64(band + np.arange(BANDS, dtype=U64)[None, :])
                sig, data = (mix64(found) & U64(0xFFFF)).astype(np.uint16), words.data
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array([hashlib.blake2b(data[words.at[r] : words.at[r + 1]], digest_size=16).digest() for r in rows], pa.binary()), pa.array([sig[r].tobytes() for r in rows], pa.binary()), pa.array(list(band[rows].view(np.int64)), pa.list_(pa.int64()))],
                    ["id", "same", "sig", "bands"],
                )

    return docs.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL").mapInArrow(run, "id long, same binary, sig binary, bands array<long>")


def _agreeing(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, agree) of pairs with their registers sa and sb, where at least that part of the registers is equal."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            agree = (a == b).mean(1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(agree)], ["a", "b", "agree"]).filter(pa.array(agree >= least))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, agree double")


def similarities(x: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Probability Jaccard similarity of one weighted set (sorted hashes, counts) with each of the others.

    The weights of each other set are laid out on the elements of x alone: an element outside x adds its own weight,
    scaled, to every denominator. Elements with the same ratio of counts share a denominator.
    """
    h, n = x
    total = np.array([c.sum() for _, c in others], float)
    size = [len(g) for g, _ in others]
    owner, g, c = np.repeat(np.arange(len(others)), size), np.concatenate([g for g, _ in others]), np.concatenate([c for _, c in others])
    at = np.minimum(np.searchsorted(h, g), len(h) - 1)
    hit = h[at] == g
    counts = np.zeros((len(others), len(h)))
    counts[owner[hit], at[hit]] = c[hit]
    a, b = n / n.sum(), counts / total[:, None]
    rest, out = 1 - b.sum(1), np.zeros(len(others))
    ratio = np.where(counts > 0, n[None, :] / np.maximum(counts, 1), 0)
    for q in np.unique(ratio[counts > 0]):
        r = q * total / n.sum()
        denominator = np.maximum(a[None, :], r[:, None] * b).sum(1) + r * rest
        out += ((ratio == q) * a[None, :]).sum(1) / denominator
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    return float(similarities(a, [b])[0])


def _sets(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """(id, h, n): sorted hashes of the runs of those texts, and their counts (empty where all are 1)."""

    def runs(batches):
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                doc, h, n = shingles(Words(part.column("text")))
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                n = n.astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([n[a:b].tobytes() if (n[a:b] != 1).any() else b"" for a, b in zip(cut, cut[1:])], pa.binary())], ["id", "h", "n"])

    texts = docs.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(ids, "id", "left_semi")
    return texts.mapInArrow(runs, "id long, h binary, n binary").groupBy("id").agg(F.min(F.struct("h", "n")).alias("x")).select("id", "x.h", "x.n")


def _weighted(h: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(h, U64)
    return h, np.frombuffer(n, np.int32) if n else np.ones(len(h), np.int32)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    left = pairs.select("a", "b").join(sets.withColumnsRenamed({"id": "a", "h": "ha", "n": "na"}), "a")
    both = left.join(sets.withColumnsRenamed({"id": "b", "h": "hb", "n": "nb"}), "b").select("a", "b", "ha", "na", "hb", "nb")

    def check(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("ha", "na", "hb", "nb")]
            ok = [similarity(_weighted(ha, na), _weighted(hb, nb)) >= THRESHOLD - 1e-12 for ha, na, hb, nb in zip(*cols)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def _joining(placed: DataFrame, sets: DataFrame, sigs: DataFrame) -> DataFrame | None:
    """(a, b): for each class that shares a bucket with a large component without being in it, verified links to it; None if there is no such class.

    placed has (key, id, c). A component's members are cut into blocks, and so are the classes that ask for it; each two
    blocks meet in a task, where shared runs are counted for the whole block at once. A class gets at most one link from each block.
    """
    members = placed.select("id", "c").distinct()
    large = members.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") >= LARGE).select("c", F.ceil(F.col("n") / BLOCK).cast("int").alias("of"))
    large = written(large, "large")
    if large.isEmpty():
        return None
    near = salted(placed, large, "c", "id").select("key", F.col("c").alias("other"), "of").distinct()
    asks = placed.join(near, "key").where("c <> other").join(large.select(F.col("c").alias("l")), F.col("c") == F.col("l"), "left").where("l IS NULL OR other < c")
    asks = written(asks.select("id", F.col("other").alias("c"), "of").distinct(), "asks")
    if asks.isEmpty():
        return None
    parts = written(asks.groupBy("c", "of").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts")), "asked")
    inside = salted(members, parts, "c", "id").select("c", F.pmod(F.xxhash64("id"), F.col("of")).cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("member"), "id")
    asks = salted(asks.select("id", "c"), parts, "c", "id").select("c", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("k"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("member"), "id")
    rows = inside.unionByName(asks).join(sets, "id").join(sigs, "id")

    def meet(table: pa.Table) -> pa.Table:
        member, ids = table.column("member").to_numpy(), table.column("id").to_numpy()
        runs = [_weighted(h, n) for h, n in zip(table.column("h").to_pylist(), table.column("n").to_pylist())]
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        members, out = np.flatnonzero(member), []
        for i in np.flatnonzero(~member) if len(members) else ():
            y = members[(sig[members] == sig[i]).mean(1) >= ESTIMATE]
            for k in range(0, len(y), 64):
                near = y[k : k + 64]
                good = near[similarities(runs[i], [runs[j] for j in near]) >= THRESHOLD - 1e-12]
                if len(good):
                    out.append((ids[i], ids[good[0]]))
                    break
        return pa.table([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.groupBy("c", "k", "part").applyInArrow(meet, "a long, b long")


def _across(buckets: DataFrame) -> DataFrame:
    """(a, b) with enough equal registers, from different components of one bucket: rows (key, band, id, c, sig).

    A bucket is cut into blocks of about BLOCK rows; each two of its blocks are one group of rows in a task. A pair that
    shares several bands is returned in the bucket of the first of them alone.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = buckets.join(sizes, "key").withColumn("of", blocks).withColumn("k", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    rows = rows.select("key", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), "k", "id", "c", "band", "sig")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs(held):
        key, i, j, k, ids, c, band, sig = held
        left, right = np.flatnonzero(k == i[0]), np.flatnonzero(k == j[0])
        out = []
        for x in left:
            y = right if i[0] != j[0] else right[right > x]
            y = y[c[y] != c[x]]
            same = sig[y] == sig[x]
            y = y[(same.mean(1) >= ESTIMATE) & (same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[x])]
            out.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], 1))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("key", "i", "j", "k", "id", "c", "band")] + [np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, REGISTERS)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            cut = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1
            found = [pairs([x[a:b] for x in held]) for a, b in zip([0, *cut[:-1]], cut)]
            held = [x[cut[-1] :] for x in held] if len(cut) else held
            if found:
                p = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])
        if held is not None and len(held[0]):
            p = pairs(held)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, component_id (least key of its class), kept."""
    rows, keys = numbered(docs, key)
    found = _classes(rows.select("__id", F.col("text").cast("string").alias("text")), "__id")
    if keys is not None:
        found = found.join(keys, "__id")
        least = found.groupBy("component_id").agg(F.min("__key").alias("least"))
        found = found.join(least, "component_id").select(F.col("__key").alias("__id"), F.col("least").alias("component_id"))
    return found.select(F.col("__id").cast(docs.schema[key].dataType).alias(key), "component_id", (F.col("__id") == F.col("component_id")).alias("kept"))


def _classes(docs: DataFrame, key: str) -> DataFrame:
    """key, component_id of documents with a long key."""
    rows = written(sketches(docs, key), "sketches")
    one = rows.groupBy("id").agg(F.min(F.struct("same", "sig", "bands")).alias("x")).select("id", "x.*")
    classes = written(one.groupBy("same").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    members = classes.select(F.posexplode("bands").alias("band", "key"), "id")
    members = members.select(F.xxhash64("band", "key").alias("key"), "band", "id")
    pivots = members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id").alias("x"), "id")).alias("p")).where("n > 1").select("key", F.col("p.id").alias("pivot"))
    met = written(members.join(pivots, "key"), "met")
    stars = met.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    sigs = classes.select("id", "sig")
    stars = stars.join(sigs.withColumnsRenamed({"id": "a", "sig": "sa"}), "a").join(sigs.withColumnsRenamed({"id": "b", "sig": "sb"}), "b")
    stars = written(_agreeing(stars, ESTIMATE), "stars")
    sets = written(_sets(docs, key, met.select("id").distinct()), "sets")
    links = written(_verified(stars, sets), "links")
    label = components(links)

    def labelled(df, v, c):
        return df.join(label.withColumnsRenamed({"v": v, "c": c}), v, "left").withColumn(c, F.coalesce(c, v))

    def joined(more):
        """links and labels with further links."""
        if more is None:
            return links, label
        more = written(more, "links")
        if more.isEmpty():
            return links, label
        every = links.unionByName(more)
        return every, components(every)

    while True:  # who joins a large component can bring in others that are near to it alone
        size = links.count()
        links, label = joined(_joining(written(labelled(met.select("key", "id"), "id", "c"), "placed"), sets, sigs))
        if links.count() == size:
            break
    placed = written(labelled(met.select("key", "band", "id"), "id", "c"), "placed")
    large = placed.select("id", "c").distinct().groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") >= LARGE).select("c")
    placed = salted(placed, large, "c", "id", how="left_anti")
    mixed = placed.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key")
    across = _across(placed.join(mixed, "key").join(sigs, "id").select("key", "band", "id", "c", "sig"))
    links, label = joined(_verified(across.join(stars.select("a", "b"), ["a", "b"], "left_anti"), sets))
    classed = classes.select("same", "id").join(label.withColumnRenamed("v", "id"), "id", "left").select("same", F.coalesce("c", "id").alias("component_id"))
    found = one.select("id", "same").join(classed, "same").select("id", "component_id")
    every = docs.select(F.col(key).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    return every.join(found, "id", "left").select(F.col("id").alias(key), F.coalesce("component_id", "id").alias("component_id"))
