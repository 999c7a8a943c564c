"""Grouping of spelling variants: words one edit apart, each pointing to its most frequent near word.

Words are counted with partial sums, so a very frequent word is a few rows of the shuffle. Each word has a mask with the
parity of each letter, cut into three bands. One inserted, deleted or replaced letter flips at most two bits, so two near
words have at least one band in common. Words meet in a join on band number, band value and shorter length; the key
also has the half of the word that an edit in the other half leaves alone, so that a bucket holds words that look alike
and not all words of a parity. A pair is kept at the first band and half that it shares, its masks must differ in at
most two bits, and its edit distance is verified. Forms are followed to the root by pointer doubling, whose rounds end
when no pointer moves: a form has at least twice the count of its word, so there are no rings.

Null text has no words; a null key hashes as "". Repeated rows count as often as they stand. An empty table gives an empty
result. Extra columns, whatever their names, play no part. A very long text is one row of matches.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .shared import written

#: Bits of a band: 9 for every third letter of a-z, 22 for every third one of U+00C0 to U+00FF.
ASCII_BITS = 9


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def variant_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): lower-cased runs of letters after the keyed deletion of one letter in 97 runs, with their counts."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text).cast("string")), F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run")).where(F.length("run") >= least_chars)
    runs = runs.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def parity_bands(word: Column) -> Column:
    """Three integers: bit k of band b is the parity of letter number 3 k + b."""

    def flip(bands: Column, letter: Column) -> Column:
        c = F.ascii(letter)
        number = F.when(c < 128, c - 97).otherwise(c - 0xC0)
        bit = F.call_function("shiftleft", F.lit(1), F.floor(number / 3).cast("int") + F.when(c < 128, 0).otherwise(ASCII_BITS))
        return F.transform(bands, lambda x, b: F.when(number % 3 == b, x.bitwiseXOR(bit)).otherwise(x))

    return F.aggregate(F.split(word, ""), F.array(F.lit(0), F.lit(0), F.lit(0)), flip)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) in both directions for words (word, n) one edit apart."""
    masked = written(words.withColumn("m", parity_bands(F.col("word"))), "masks")

    def keyed(rows: DataFrame, short: Column) -> DataFrame:
        """A row for each band and half; `short` is the length of the shorter word of the pairs that it looks for."""
        half = F.expr("short div 2")
        halves = F.array(F.substring("word", F.lit(1), half), F.substring("word", F.length("word") - F.col("short") + half + 1, F.col("short") - half))
        rows = rows.withColumn("short", short).withColumn("halves", halves)
        rows = rows.select("*", F.posexplode("m").alias("band", "value")).select("*", F.posexplode("halves").alias("side", "half"))
        return rows.withColumn("key", F.xxhash64("band", "value", "short", "side", "half"))

    length = F.length("word")
    left = keyed(masked, length).withColumnsRenamed({c: f"a_{c}" for c in ("word", "n", "m")}).drop("value", "half")
    right = keyed(masked, F.explode(F.array(length, length - 1))).select("key", *(F.col(c).alias(f"b_{c}") for c in ("word", "n", "m", "halves", "value", "half")))
    same = [F.col("a_m")[k] == F.col("b_m")[k] for k in range(3)]
    first_band = F.when(same[0], 0).when(same[1], 1).otherwise(2)
    first_side = F.when(F.col("halves")[0] == F.col("b_halves")[0], 0).otherwise(1)
    flips = sum((F.bit_count(F.col("a_m")[k].bitwiseXOR(F.col("b_m")[k])) for k in range(3)), F.lit(0))
    once = (F.length("b_word") > F.length("a_word")) | (F.col("a_word") < F.col("b_word"))
    pairs = left.join(right, "key").where((F.length("b_word") - F.length("a_word") == F.when(F.length("b_word") == F.col("short"), 0).otherwise(1)) & once & (F.col("band") == first_band) & (F.col("side") == first_side) & (flips <= 2))
    pairs = pairs.where(F.levenshtein("a_word", "b_word", 1) == 1)
    ways = F.array(*(F.struct(F.col(f"{a}_word").alias("word"), F.col(f"{a}_n").alias("n"), F.col(f"{b}_word").alias("near"), F.col(f"{b}_n").alias("near_n")) for a, b in ("ab", "ba")))
    return pairs.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each word that has a form: the last word that following forms leads to."""
    ahead = forms.select("word", F.col("form").alias("root"))
    done = None
    while True:
        beyond = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(ahead.join(beyond, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        ahead = step.select("word", "root")
        if step.where("moved").isEmpty():
            return ahead


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 5, least_count: int = 3, factor: int = 2) -> DataFrame:
    """(word, n, form, form_n, root, n_near) for every word; form is the near word of largest n (ties: first in code-point
    order) if that n is at least `factor` (2 or more) times the word's own, root is where forms lead."""
    if factor < 2:
        raise ValueError("with a factor below 2 forms could point in a ring")
    words = written(variant_words(docs, key, text, least_chars, least_count), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    named = words.join(best, "word", "left")
    high = -F.col("best.minus") >= factor * F.col("n")
    named = written(named.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(high, F.col("best.near")).alias("form"), F.when(high, -F.col("best.minus")).alias("form_n")), "forms")
    return named.join(roots(named.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


#: crc32 by its table, near words by a wildcard or a deletion at each place.
ORACLE_SQL = """
WITH RECURSIVE steps(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) tab FROM steps WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) run FROM documents),
each AS (SELECT doc_id, run, count(*) n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
coded AS (SELECT run, n, list_concat([4294967295], flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))) bytes FROM each),
hashed AS (SELECT run, n, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) h FROM coded, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) i FROM words),
wild AS (SELECT word, n, i, left(word, i - 1) || '*' || substring(word, i + 1) p FROM places),
less AS (SELECT DISTINCT word, n, left(word, i - 1) || substring(word, i + 1) p FROM places),
pairs AS (SELECT a.word, b.word near, b.n near_n FROM wild a JOIN wild b USING (p) WHERE a.word <> b.word UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.p = b.word UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.p = b.word),
best AS (SELECT word, count(*) n_near, min({'minus': -near_n, 'near': near}) best FROM pairs GROUP BY word),
named AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) n_near, CASE WHEN -best.minus >= 2 * n THEN best.near END form, CASE WHEN -best.minus >= 2 * n THEN -best.minus END form_n FROM words LEFT JOIN best USING (word)),
chain(word, node, form) AS (SELECT word, word, form FROM named UNION ALL SELECT c.word, c.form, f.form FROM chain c JOIN named f ON c.form = f.word)
SELECT named.word, named.form, node AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM named JOIN chain ON named.word = chain.word AND chain.form IS NULL"""
