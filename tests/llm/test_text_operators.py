"""Fill-in-middle, spelling variants and repeated lines against brute force and SQL, with their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.llm import lines, middle, queries, spelling
from tests.compare import connect, differences

#: Extra columns are named like results and inner columns of the operators.
DOCS = "doc_id long, text string, n long, form string, word string, n_lines long, output string, h long, pos int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", "y", 9, "z", 3, 4) for i, t in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_middle", "op12_spelling", "op13_lines"])
def test_same_as_sql(spark, small, name):
    assert not differences(spark, small, queries.QUERIES[name], queries.ORACLE_SQL[name], connect(small))


# --- fill-in-middle -------------------------------------------------------------------------------------------------


def plain_middle(key, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h[3] % 100 < spm:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def texts_for_cuts():
    rng = random.Random(3)
    gaps = [" ", "  ", "\n", "\t ", "\x0b", " \r\n"]
    made = []
    for _ in range(120):
        words = ["".join(rng.choice("abé漢🎉<>") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 90))]
        made.append(rng.choice(["", " ", "\n\n"]) + "".join(w + rng.choice(gaps) for w in words) + rng.choice(["", "end"]))
    return made + [None, "", " ", "\n \t", "one", " one", "one ", "has <P> inside", "<M>", "a b c d", "<", "<P <S <M P> S> M>"]


def test_middle_against_brute_force(spark):
    rows = list(enumerate(texts_for_cuts())) + [(None, "null key a b c"), (5, "another text with key five"), (5, "another text with key five")]
    got = middle.fill_in_middle(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "word", "n_lines", "h", "pos", *middle.RESULT]
    have = Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got.collect())
    assert have == Counter((i, t or "", *plain_middle(i, t)) for i, t in rows)
    back = got.select("text", middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r.text == r.back for r in back)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("rate, spm", [(0, 50), (100, 0), (100, 100)])
def test_middle_rates_and_seed(spark, rate, spm):
    rows = [(i, f"w{i} x y  z") for i in range(40)]
    got = middle.fill_in_middle(frame(spark, rows), seed=9, rate=rate, spm=spm).collect()
    assert {(r.doc_id, r.output) for r in got} == {(i, plain_middle(i, t, 9, rate, spm)[4]) for i, t in rows}


def test_middle_of_very_long_texts_and_pieces(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) + "é" * (k % 2) for k in range(60_000))) for i in range(6)]
    rows += [(6, "x" * 300_000), (7, " " * 300_000), (8, ("a" * 65_535 + "  ") * 4), (9, ("a" * 65_536 + " ") * 4), (10, " " * 65_536 + "end" + " " * 70_000)]
    got = middle.fill_in_middle(frame(spark, rows), rate=100).collect()
    assert {(r.doc_id, r.n, r.prefix_chars, r.middle_chars, r.output) for r in got} == {(i, *(w := plain_middle(i, t, rate=100))[:1], *w[2:]) for i, t in rows}


def test_middle_empty_table_and_other_keys(spark):
    assert middle.fill_in_middle(frame(spark, [])).collect() == []
    df = frame(spark, [(k, f"some words for {k}") for k in range(20)]).withColumn("form", F.concat(F.lit("k"), "doc_id"))
    got = middle.fill_in_middle(df.drop("form").withColumn("name", F.concat(F.lit("k"), "doc_id")), key="name", rate=100).collect()
    assert all(r.output == plain_middle(r.name, r.text, rate=100)[4] for r in got) and len(got) == 20


# --- spelling variants ----------------------------------------------------------------------------------------------


def plain_variants(rows, least_chars=5, least_count=3, factor=2):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least_chars:
                count[w] += 1
    words = {w: n for w, n in count.items() if n >= least_count}
    near = defaultdict(set)
    by = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            by[w[:k] + "*" + w[k + 1 :]].add(w)
            if w[:k] + w[k + 1 :] in words:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for group in by.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= factor * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def variants(spark, rows, **options):
    got = spelling.spelling_variants(frame(spark, rows), **options).collect()
    assert len(got) == len({r.word for r in got})
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def test_variants_against_brute_force(spark):
    rng = random.Random(11)
    letters = "abcdeÀéÿ×ñ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(30)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = base[min(rng.randrange(30), rng.randrange(30))]
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            words.append(w if rng.random() < 0.8 else w.upper())
        rows.append((i, rng.choice([" ", "-", "1", "ß", "\n"]).join(words)))
    want = plain_variants(rows)
    assert len(want) > 200 and sum(w[1] is not None for w in want) > 100
    assert variants(spark, rows) == want
    assert variants(spark, rows, least_chars=6, least_count=1, factor=3) == plain_variants(rows, 6, 1, 3)


def test_variants_ties_chains_and_odd_rows(spark):
    rows = [(None, "Abcde"), (1, None), (2, ""), (3, "1234 ... 漢字")]
    # a chain: each word twice as frequent as the one before; a tie of near words with the same count
    for k, w in enumerate(["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]):
        rows += [(1000 + k, " ".join([w] * (3 * 2**k)))]
    rows += [(2000, "zzzzz " * 3 + "zzzzy " * 8 + "zzzzw " * 8 + "zzzzv " * 7)]
    want = plain_variants(rows)
    assert variants(spark, rows) == want
    assert {w[2] for w in want if w[0].startswith("aa")} == {"aabbbb"}
    assert variants(spark, []) == set() and variants(spark, rows[:4]) == set()
    assert variants(spark, rows[4:] * 2) == plain_variants(rows[4:] * 2)
    with pytest.raises(ValueError, match="factor"):
        variants(spark, rows, factor=1)


def test_variants_of_long_words_and_long_texts(spark):
    long = "abc" * 3000
    rows = [(1, " ".join([long] * 3 + [long[:-1]] * 7 + [long[1:]] * 3)), (2, "wordy worde " * 50_000)]
    assert variants(spark, rows) == plain_variants(rows)


def test_parity_bands_share_one_after_any_edit(spark):
    rng = random.Random(2)
    alphabet = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    pairs = []
    for _ in range(300):
        w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 12)))
        k, c = rng.randrange(len(w)), rng.choice(alphabet)
        pairs.append((w, rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", spelling.parity_bands(F.col("a")).alias("x"), spelling.parity_bands(F.col("b")).alias("y")).collect()
    for r in got:
        want = [sum(1 << (k - 0xC0) // 3 + 9 if k > 127 else 1 << (k - 97) // 3 for k, n in Counter(map(ord, r.a)).items() if n % 2 and (k - (0xC0 if k > 127 else 97)) % 3 == b) for b in range(3)]
        assert r.x == want and any(p == q for p, q in zip(r.x, r.y))


# --- repeated lines -------------------------------------------------------------------------------------------------


def plain_lines(rows, least_chars=20, least_docs=3):
    def key(line):
        return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(dict)
    for at, (i, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            held[key(line)][at] = i
    rank = lambda i: (i is not None, i or 0)
    last = {k: max(v.values(), key=rank) for k, v in held.items() if len(k) >= least_chars and len(v) >= least_docs}
    out = Counter()
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if key(x) not in last or last[key(x)] == i]
        out[i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)] += 1
    return out


def dropped(spark, rows, **options):
    got = lines.drop_repeated_lines(frame(spark, rows), **options)
    assert got.columns == ["doc_id", "text", "n", "form", "word", "output", "h", "pos", "n_lines", "n_dropped"]
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect())


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choice(["one", "Two", "três", "漢字", "four"]) for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    rows = []
    for i in range(200):
        some = [pool[min(rng.randrange(60), rng.randrange(60))] for _ in range(rng.randrange(0, 12))] + [f"only in {i} and of some length"] * rng.randrange(3)
        rows.append((i, "\n".join(rng.choice(["", " ", "\t", "\r"]) + rng.choice([x, x.upper(), x]) + rng.choice(["", "\r", "  "]) for x in some)))
    rows += [(None, pool[0]), (None, None), (3, ""), (7, rows[7][1]), (400, "\n\n\n"), (401, "x" * 25), (402, "X" * 25), (403, " " + "x" * 25), (404, "y" * 19), (405, "y" * 19), (406, "y" * 19), (407, " " + "x" * 25)]
    assert dropped(spark, rows) == plain_lines(rows)
    assert dropped(spark, rows, least_chars=5, least_docs=2) == plain_lines(rows, 5, 2)


def test_lines_ties_repeats_and_empty_tables(spark):
    line = "a line that is long enough"
    rows = [(5, line), (5, line), (5, line + "\nmore"), (2, line + "\n" + line)]
    assert dropped(spark, rows) == plain_lines(rows)
    nulls = [(None, line)] * 3
    assert dropped(spark, nulls) == plain_lines(nulls) == Counter({(None, 1, 0, line): 3})
    twice = [(1, f"{line}\n{line}"), (2, line)]
    assert dropped(spark, twice) == plain_lines(twice)  # two documents are not three
    assert dropped(spark, []) == Counter()
    assert dropped(spark, [(1, None)]) == Counter({(1, 1, 0, ""): 1})


def test_lines_of_very_long_texts_and_a_hot_line(spark):
    hot = "the same notice under every text"
    rows = [(i, f"{hot}\nunique line number {i} of the table\n{hot}") for i in range(3000)] + [(9000, "\n".join(f"line {k % 20_000} of a very long text" for k in range(40_000))), (9001, "\n".join(f"line {k} of a very long text" for k in range(20_000))), (9002, "z" * 2_000_000)]
    assert dropped(spark, rows) == plain_lines(rows)


def test_bloom_filters_and_segments():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 200_000, np.uint64)
    b = lines.Bloom()
    b.add(h[:100_000])
    assert b.has(h[:100_000]).all() and b.has(h[100_000:]).mean() < 0.01
    batch = lambda h, kind, at, seg: pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(h), seg), at, np.zeros(len(h), np.int32), h.view(np.int64), np.full(len(h), kind, np.int32))], ["segment", "__row", "__pos", "h", "kind"])
    n = np.arange(50_000)
    made = [batch(h[:50_000], 1, n, 0), batch(h[40_000:50_000], 1, n[:10_000] + 50_000, 0), batch(h[:100], 1, n[:100] + 90_000, 1), batch(h[200:210], 2, n[:10] + 95_000, 2)]
    found = set(np.concatenate([b.column("__row").to_numpy() for b in lines.seen_again(made)]).tolist())
    sure = set(range(40_000, 60_000)) | set(range(95_000, 95_010))
    assert sure <= found and len(found - sure) < 400


def test_first_of_a_block_is_marked():
    h = np.array([5, 7, 5, 5, 9], np.int64)
    b = pa.RecordBatch.from_arrays([pa.array(np.arange(5)), pa.array(np.zeros(5, np.int32)), pa.array(h)], ["__row", "__pos", "h"])
    (out,) = lines.first_of_block([b])
    assert out.column("kind").to_pylist() == [2, 1, 0, 0, 1]
