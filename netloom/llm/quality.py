"""Quality rules: word statistics and an n-gram perplexity band for each language.

The language model is an interpolated modified Kneser-Ney model over UTF-8 byte n-grams (order 5; any run of
white space is one space, at the end of a text none; a text begins with zero bytes). Spark counts all n-grams of all texts and derives the
continuation counts, discounts and back-off weights with grouping and joins. The model is a table in the shared folder
that keeps every counted n-gram: each file holds the n-grams of one range of hashes in sorted order.

A scoring task looks the HOT most frequent n-grams up in sorted arrays, a broadcast of fixed size. Each other n-gram of a
text is a row (text, n-gram, how often), which Spark joins with the table; n-grams that the table lacks back off order
by order. Neither texts nor the model are shuffled or held whole, and every n-gram is scored from the whole model.

A text is rejected if its log perplexity lies outside its language's band: median -/+ a multiple of the spread
(interquartile range / 1.349) of all texts of the language that pass the base rules. The mean of a short text varies
more, so its band is wider by the factor sqrt(1 + SHORT / n_words). A language with fewer than `least` such texts has
no band.

Texts are dealt into two folds by the hash of their bytes, and each fold is scored by the model of the other one, so that
no text, nor an exact copy of it, has been counted by the model that judges it. Each fold of a language is a language to
the model. With held_out=False there is one model and texts are scored by a model that has counted them too.

Null text counts as empty: no words, base_failed. A null language is a language of its own. Repeated rows are
scored alike. An empty table gives an empty result. Extra columns are ignored by score() and kept by accept(), whatever
their names. A long text is handled by one task, whose memory is some 100 bytes for each byte of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from .shared import written
from .textops import U64, Words, covered, mix64, per_text, slices

ORDER = 5
#: n-grams that every task holds; all others are joined. 16 bytes each.
HOT = 1 << 20
SYMBOLS = "[#*$%&|<>]"
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS[1:-1]]] = True
#: Different n-grams, of all languages together, that a counting task holds before it hands them to Spark.
HELD = 2_000_000
#: Words at which a text's band is sqrt(2) times as wide as that of an endless one.
SHORT = 50


def grams(words: Words, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each byte, and where each text's n-grams begin; white space runs count once."""
    keep = ~words.space
    keep[:-1] |= keep[1:]
    begins = words.at[:-1][words.at[:-1] < words.at[1:]]
    ends = begins[begins > 0] - 1
    keep[ends] = ~words.space[ends]
    if len(words.data):
        keep[-1] = not words.space[-1]
    at = np.concatenate([[0], np.cumsum(keep)])[words.at]
    data = np.where(words.space, 0x20, words.data)[keep].astype(U64)
    since = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    key = data.copy()
    for k in range(1, order):
        before = np.zeros_like(data)
        before[k:] = data[:-k] if k < len(data) else 0
        before[since < k] = 0
        key |= before << U64(8 * k)
    return key, at


def _by_language(langs: np.ndarray):
    """Rows of one language at a time: the language's number and which rows have it."""
    for lang in np.unique(langs):
        yield int(lang), np.flatnonzero(langs == lang)


def fold() -> F.Column:
    """0 or 1 by the text, null and empty alike."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(2)).cast("int")


def language(of: F.Column | None = None) -> F.Column:
    """The number of a row's language, or of that fold of it; null is a language of its own."""
    return F.xxhash64(F.col("lang").cast("string"), *([] if of is None else [of])).alias("lang")


def count_grams(docs: DataFrame, order: int = ORDER, lang: F.Column | None = None) -> DataFrame:
    """(lang, gram, n): how often each byte n-gram occurs in all texts; counted in the task, then by Spark. lang is language() or the given number."""

    def merged(parts):
        key = np.concatenate([k for k, _ in parts])
        n = np.concatenate([c for _, c in parts])
        by = np.argsort(key, kind="stable")
        key, n = key[by], n[by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], np.add.reduceat(n, first)

    def run(batches):
        held: dict = {}

        def out(lang):
            key, n = merged(held.pop(lang))
            for a in range(0, len(key), 100_000):
                k = key[a : a + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), lang)), pa.array(k), pa.array(n[a : a + 100_000])], ["lang", "gram", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                for lang, rows in _by_language(part.column("lang").to_numpy()):
                    key, _ = grams(Words(part.column("text").take(pa.array(rows))), order)
                    if len(key):
                        held.setdefault(lang, []).append(np.unique(key, return_counts=True))
                        if len(held[lang]) >= 8:
                            held[lang] = [merged(held[lang])]
                if sum(len(k) for parts in held.values() for k, _ in parts) > HELD:
                    for lang in list(held):
                        yield from out(lang)
        for lang in list(held):
            yield from out(lang)

    counted = docs.select(language() if lang is None else lang, F.col("text").cast("string").alias("text")).mapInArrow(run, "lang long, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, n, gram, c, p, bow): interpolated modified Kneser-Ney probability of every n-gram of orders 1 to `order`; order 0 has the weight of the uniform distribution.

    c is the count (highest order) or the number of different bytes before it; bow is the back-off weight of the
    n-gram as a context of the next order (null if it is never one).
    """
    tables = {order: written(counts.select("lang", "gram", F.col("n").alias("c")), f"order-{order}")}
    for n in range(order - 1, 0, -1):
        mask = F.lit((1 << (8 * n)) - 1)
        tables[n] = written(tables[n + 1].groupBy("lang", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count("*").alias("c")), f"order-{n}")
    out, lower = [], None
    for n in range(1, order + 1):
        t = tables[n]
        k = [F.sum((F.col("c") == i).cast("long")).cast("double").alias(f"k{i}") for i in (1, 2, 3, 4)]
        y = F.col("k1") / F.greatest(F.col("k1") + 2 * F.col("k2"), F.lit(1.0))

        def discount(i):  # an order without counts of i or i + 1 gets a plain value
            d = i - (i + 1) * y * F.col(f"k{i + 1}") / F.greatest(F.col(f"k{i}"), F.lit(1.0))
            return F.when((F.col(f"k{i}") > 0) & (d > 0) & (d < i), d).otherwise(F.lit(0.25 * i + 0.25)).alias(f"d{i}")

        d = t.groupBy("lang").agg(*k).select(F.col("lang").alias("d_lang"), *(discount(i) for i in (1, 2, 3)))
        context = F.shiftrightunsigned("gram", 8)
        ctx = t.groupBy("lang", context.alias("ctx")).agg(F.sum("c").alias("total"), *(F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2)), F.sum((F.col("c") >= 3).cast("long")).alias("n3"))
        ctx = written(ctx.join(d, F.col("lang") == F.col("d_lang")).select(F.col("lang").alias("x_lang"), "ctx", "total", "d1", "d2", "d3", ((F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")).alias("gamma")), f"contexts-{n}")
        t = t.withColumn("ctx", context).join(ctx.withColumnRenamed("ctx", "x_ctx"), (F.col("lang") == F.col("x_lang")) & (F.col("ctx") == F.col("x_ctx")))
        if lower is None:
            t = t.withColumn("lp", F.lit(1 / 256))
        else:
            low = lower.select(F.col("lang").alias("l_lang"), F.col("gram").alias("l_gram"), F.col("p").alias("lp"))
            t = t.join(low, (F.col("lang") == F.col("l_lang")) & (F.col("gram").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1)) == F.col("l_gram")))
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        p = (F.greatest(F.col("c") - cut, F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("lp")).alias("p")
        lower = written(t.select("lang", "gram", "c", p), f"p-{n}")
        bow = ctx.select(F.lit(n - 1).alias("n"), F.col("x_lang").alias("lang"), F.col("ctx").alias("gram"), F.lit(0).cast("long").alias("c"), F.lit(None).cast("double").alias("p"), F.col("gamma").alias("bow"))
        out += [lower.select(F.lit(n).alias("n"), "lang", "gram", "c", "p", F.lit(None).cast("double").alias("bow")), bow]
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.groupBy("lang", "n", "gram").agg(F.max("c").alias("c"), F.max("p").alias("p"), F.max("bow").alias("bow"))


def looked_up(asked: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """asked (lang, gram, further columns) with lp, the log probability of the n-gram's last byte after those before it."""

    def entry(n: int, value: str):
        return model.where((F.col("n") == n) & F.col(value).isNotNull()).select(F.col("lang").alias("m_lang"), F.col("gram").alias("m_gram"), F.log(value).alias("value"))

    def joined(df: DataFrame, gram, n: int, value: str) -> DataFrame:
        return df.join(entry(n, value), (F.col("lang") == F.col("m_lang")) & (gram == F.col("m_gram")), "left").drop("m_lang", "m_gram")

    def tail(n: int):
        return F.col("gram").bitwiseAND(F.lit((1 << (8 * n)) - 1))

    whole = written(joined(asked, F.col("gram"), order, "p").withColumnRenamed("value", "lp"), "looked-up")
    left = written(whole.where("lp IS NULL").select("lang", "gram").distinct().withColumn("w", F.lit(0.0)), "unseen")
    if left.isEmpty():
        return whole
    done = []
    for n in range(order, 0, -1):
        left = joined(left, F.shiftrightunsigned(tail(n), 8), n - 1, "bow").select("lang", "gram", (F.col("w") + F.coalesce("value", F.lit(0.0))).alias("w"))
        if n > 1:
            left = written(joined(left, tail(n - 1), n - 1, "p"), "unseen")
            done.append(left.where("value IS NOT NULL").select("lang", "gram", (F.col("w") + F.col("value")).alias("late")))
            left = left.where("value IS NULL").select("lang", "gram", "w")
    late = left.select("lang", "gram", (F.col("w") + float(np.log(1 / 256))).alias("late"))
    for x in done:
        late = late.unionByName(x)
    late = late.withColumnsRenamed({"lang": "m_lang", "gram": "m_gram"})
    return whole.join(late, (F.col("lang") == F.col("m_lang")) & (F.col("gram") == F.col("m_gram")), "left").withColumn("lp", F.coalesce("lp", "late")).drop("m_lang", "m_gram", "late")


class HotGrams:
    """The most frequent n-grams as one sorted array for each language, with their log probabilities."""

    def __init__(self, lang: np.ndarray, gram: np.ndarray, lp: np.ndarray):
        self.of = {}
        for k, rows in _by_language(lang):
            rows = rows[np.argsort(gram[rows])]
            self.of[k] = gram[rows], lp[rows]

    def find(self, lang: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each n-gram, 0 where it is not held, and whether it is held."""
        if lang not in self.of:
            return np.zeros(len(key)), np.zeros(len(key), bool)
        gram, lp = self.of[lang]
        at = np.minimum(np.searchsorted(gram, key), len(gram) - 1)
        held = gram[at] == key
        return np.where(held, lp[at], 0.0), held


def word_metrics(words: Words) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, at, n = words.data, words.at, len(words.start)
    doc = np.arange(len(at) - 1)
    chars = per_text(~words.space & ((data & 0xC0) != 0x80), at)
    symbols = per_text(_SYMBOL[data], at)
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate([at[:-1][at[:-1] < at[1:]], breaks + 1]))
    end = np.sort(np.concatenate([at[1:][at[:-1] < at[1:]], breaks]))
    c = np.concatenate([[0], np.cumsum(~words.space)])
    full = c[end] > c[np.minimum(begin, len(data))]
    begin, end = begin[full], end[full]
    of = np.searchsorted(at, begin, "right") - 1
    with np.errstate(over="ignore"):
        line = words.hash_of(begin, end) ^ mix64(of.astype(U64) + U64(1))
        _, kept = np.unique(line, return_index=True)
        lines = np.bincount(of, minlength=len(doc)) - np.bincount(of[kept], minlength=len(doc))
        h, i = words.windows(5)
        h = h ^ mix64(words.doc()[i].astype(U64) + U64(1))
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice):
        hit = i[np.isin(h, twice)]
        repeat = per_text(covered(hit, 5, n), words.of)
    else:
        repeat = np.zeros(len(doc), np.int64)
    return [words.counts(), chars, symbols, lines, repeat]


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


class PerplexityQuality:
    """fit() counts and stores the model; score() gives the figures of each text; bands() the limits; accept() the rows."""

    def __init__(self, order: int = ORDER, width: tuple[float, float] = (8.0, 4.5), floor: float = 0.02, least: int = 50, hot: int = HOT, held_out: bool = True):
        self.order, self.width, self.floor, self.least, self.hot, self.held_out = order, width, floor, least, hot, held_out

    def fit(self, docs: DataFrame) -> "PerplexityQuality":
        model = kneser_ney(count_grams(docs, self.order, language(fold() if self.held_out else None)), self.order)
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.model = written(model.repartition(parts, "gram").sortWithinPartitions("n", "lang", "gram"), "model")
        top = self.model.where((F.col("n") == self.order) & F.col("p").isNotNull()).withColumn("level", F.floor(F.log2(F.col("c").cast("double")) * 8))
        room, least = self.hot, None
        for level, n in top.groupBy("level").count().orderBy(F.desc("level")).collect():  # a row for each eighth of a power of two
            room -= n
            if room < 0:
                break
            least = level
        table = top.where(F.col("level") >= least if least is not None else F.lit(False)).select("lang", "gram", F.log("p").alias("lp")).toArrow()  # `hot` rows at most
        self._hot = docs.sparkSession.sparkContext.broadcast((table.column("lang").to_numpy(), table.column("gram").to_numpy().view(U64), table.column("lp").to_numpy()))
        return self

    def _judge(self) -> F.Column:
        """The number of the model that scores a row."""
        return language(1 - fold() if self.held_out else None)

    def _measured(self, docs: DataFrame, columns: list[str]) -> DataFrame:
        """Those columns of docs, METRICS and log_ppl; docs has lang (the number of the model) and text besides. docs is read once."""
        order, hot, held = self.order, self._hot, []
        metrics = [x.split()[0] for x in METRICS.split(", ")]
        kinds = [StructField(c, docs.schema[c].dataType) for c in columns]  # nullable: the rows of rare n-grams have none of them
        schema = StructType(kinds)
        for name, kind in (("__row", "long"), *((m, "long") for m in metrics), ("__grams", "long"), ("__nll", "double"), ("__lang", "long"), ("__gram", "long"), ("__n", "long")):
            schema = schema.add(name, kind)

        def run(batches):
            from pyspark import TaskContext

            row = np.int64(TaskContext.get().partitionId()) << 40
            if not held:
                held.append(HotGrams(*hot.value))
            for batch in batches:
                for part in slices(batch, "text"):
                    n, ids = part.num_rows, row + np.arange(part.num_rows)
                    row += n
                    nll, size, rare = np.zeros(n), np.zeros(n, np.int64), []
                    for lang, rows in _by_language(part.column("lang").to_numpy()):
                        key, at = grams(Words(part.column("text").take(pa.array(rows))), order)
                        if not len(key):
                            continue
                        lp, known = held[0].find(lang, key)
                        nll[rows], size[rows] = -per_text(lp, at, float), np.diff(at)
                        if not known.all():
                            of, key = ids[rows][np.repeat(np.arange(len(rows)), np.diff(at))][~known], key[~known].view(np.int64)
                            by = np.lexsort((key, of))
                            of, key = of[by], key[by]
                            first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (key[1:] != key[:-1])])
                            rare.append((of[first], np.full(len(first), lang), key[first], np.diff(np.r_[first, len(key)])))
                    values = [ids, *word_metrics(Words(part.column("text"))), size, nll]
                    nulls = [pa.nulls(n, pa.int64())] * 3
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *(pa.array(x) for x in values), *nulls], schema.names)
                    for of, lang, key, times in rare:
                        none = [pa.nulls(len(of), part.schema.field(c).type) for c in columns]
                        zeros = [pa.nulls(len(of), pa.int64()) for _ in range(len(metrics) + 1)]
                        yield pa.RecordBatch.from_arrays([*none, pa.array(of), *zeros, pa.nulls(len(of), pa.float64()), pa.array(lang), pa.array(key), pa.array(times)], schema.names)

        table = written(docs.mapInArrow(run, schema), "measured")
        rare = table.where("__gram IS NOT NULL").select("__row", F.col("__lang").alias("lang"), F.col("__gram").alias("gram"), "__n")
        late = looked_up(rare, self.model, order).groupBy("__row").agg(F.sum(F.col("__n") * F.col("lp")).alias("__late"))
        rows = table.where("__gram IS NULL").join(late, "__row", "left")
        log_ppl = F.round((F.col("__nll") - F.coalesce("__late", F.lit(0.0))) / F.greatest("__grams", F.lit(1)), 6)
        return rows.select(*columns, *metrics, log_ppl.alias("log_ppl"))

    def score(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        """key, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_ppl (nats a byte)."""
        docs = docs.select(F.col(key).alias("__key"), F.col("lang").cast("string").alias("__name"), self._judge(), F.col("text").cast("string").alias("text"))
        return self._measured(docs, ["__key", "__name"]).withColumnsRenamed({"__key": key, "__name": "lang"})

    def bands(self, scored: DataFrame) -> DataFrame:
        """(band_lang, middle, below, above): a row for each language with enough texts."""
        q = F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10000)
        spread = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(self.floor))
        return scored.where(~base_failed()).groupBy(F.col("lang").alias("band_lang")).agg(q.alias("q"), F.count("*").alias("texts")).where(F.col("texts") >= self.least).select("band_lang", F.col("q")[1].alias("middle"), (self.width[0] * spread).alias("below"), (self.width[1] * spread).alias("above"))

    def verdict(self, scored: DataFrame, bands: DataFrame) -> DataFrame:
        """scored with base_failed, low, high and kept. A band is a row for each language, broadcast if there are few."""
        bands = bands if bands.count() > 10_000 else F.broadcast(bands)
        out = scored.withColumn("base_failed", base_failed()).join(bands, F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")
        wider = F.sqrt(1 + SHORT / F.greatest(F.col("n_words"), F.lit(1)))
        out = out.withColumns({"low": F.col("middle") - F.col("below") * wider, "high": F.col("middle") + F.col("above") * wider}).drop("middle", "below", "above")
        inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
        return out.withColumn("kept", ~F.col("base_failed") & inside)

    def accept(self, docs: DataFrame) -> DataFrame:
        """Rows of docs that pass, all columns; each row is judged by its own figures, scored once."""
        own = {c: f"__own_{k}" for k, c in enumerate(docs.columns)}
        renamed = docs.select(*(F.col(f"`{c}`").alias(own[c]) for c in docs.columns), F.col("lang").cast("string").alias("__name"), self._judge(), F.col("text").cast("string").alias("text"))
        scored = self._measured(renamed, [*own.values(), "__name"]).withColumnRenamed("__name", "lang")
        return self.verdict(scored, self.bands(scored)).where("kept").select(*(F.col(own[c]).alias(c) for c in docs.columns))
