"""Each operator against brute force, an exact round trip or held-out accuracy, with its edge cases."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.llm import chat, minhash, packing, pieces, quality, sharding, substrings, textops, tokens, toxicity, vectors
from netloom.llm.components import components
from tests.compare import connect, differences

WORD = "word_bpe_49k.json"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, bands string, row long"


def frame(spark, texts, lang="en"):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", 7) for i, t in enumerate(texts)], DOCS)


def split(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(20, 200))) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    for i in (3, 9, 20, 31):
        made[i] = made[i][:200] + " " + passage + " " + made[i][200:]
    w = made[5].split()
    w[10] = "changed"
    made += [made[5], made[5], " ".join(w), None, "", "   \n\t", "one two", "x" * 5000, " ".join(["same"] * 300), "line a\nline a\nline a\n\nline b"]
    return made


def test_words_and_windows(texts):
    w = textops.Words(pa.array(texts))
    assert w.counts().tolist() == [len(split(t)) for t in texts]
    by = {}
    for (a, b), h in zip(zip(w.start, w.end), w.hashes()):
        by.setdefault(int(h), set()).add(w.data[a:b].tobytes())
    assert all(len(v) == 1 for v in by.values())


def test_quality_metrics(spark, texts):
    q = quality.PerplexityQuality(least=5).fit(frame(spark, texts))
    scored = q.score(frame(spark, texts))
    for r in scored.collect():
        t = texts[r.doc_id] or ""
        w = split(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if split(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
        want = (len(w), sum(len(x.decode()) for x in w), sum(t.count(s) for s in "#*$%&|<>"), dup, len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
    kept = {r.doc_id for r in q.verdict(scored, q.bands(scored)).where("kept").collect()}
    assert kept == {r.doc_id for r in q.accept(frame(spark, texts)).collect()} and kept


def test_quality_of_columns_that_are_never_null(spark):
    """An id from range() and literal columns are carried like others, by score() and by accept()."""
    docs = spark.range(120).select("id", F.lit("en").alias("lang"), F.concat(F.lit("some text of words number "), F.col("id").cast("string"), F.lit(" with a few more words behind it, rare ones too: "), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit(3).alias("n"), F.array(F.lit(1)).alias("a"))
    assert not docs.schema["id"].nullable and not docs.schema["n"].nullable
    q = quality.PerplexityQuality(least=5, hot=50).fit(docs)
    scored = q.score(docs, "id").collect()
    assert sorted(r.id for r in scored) == list(range(120)) and all(r.log_ppl > 0 for r in scored)
    kept = q.accept(docs)
    assert kept.columns == docs.columns and {r.id for r in kept.collect()} <= set(range(120)) and all(r.n == 3 and r.a == [1] for r in kept.collect())


class PlainKneserNey:
    """Interpolated modified Kneser-Ney from its definition, over lists of byte strings of one language."""

    def __init__(self, texts, order):
        self.order, self.count = order, {order: Counter(g for t in texts for g in self.grams(t, order))}
        for n in range(order - 1, 0, -1):
            self.count[n] = Counter(g[1:] for g in self.count[n + 1])
        self.d = {n: self.discounts(Counter(c.values())) for n, c in self.count.items()}
        self.followers = {n: {} for n in self.count}
        for n, c in self.count.items():
            for g, k in c.items():
                self.followers[n].setdefault(g[:-1], []).append(k)

    @staticmethod
    def plain(text):
        return re.sub(rb"[ \t-\r]+", b" ", (text or "").encode()).rstrip(b" ")

    def grams(self, text, n):
        data = b"\0" * (n - 1) + self.plain(text)
        return [data[i : i + n] for i in range(len(data) - n + 1)]

    @staticmethod
    def discounts(k):
        y, out = k[1] / max(k[1] + 2 * k[2], 1), {}
        for i in (1, 2, 3):
            d = i - (i + 1) * y * k[i + 1] / max(k[i], 1)
            out[i] = d if k[i] and 0 < d < i else 0.25 * i + 0.25
        return out

    def p(self, gram):
        n = len(gram)
        if not n:
            return 1 / 256
        follow = self.followers[n].get(gram[:-1])
        if not follow:
            return self.p(gram[1:])
        total, d, c = sum(follow), self.d[n], self.count[n][gram]
        gamma = sum(d[min(k, 3)] for k in follow) / total
        return (max(c - d[min(c, 3)], 0) / total if c else 0) + gamma * self.p(gram[1:])

    def log_ppl(self, text):
        g = self.grams(text, self.order)
        return -sum(math.log(self.p(x)) for x in g) / len(g) if g and self.plain(text) else 0.0


@pytest.mark.parametrize("hot, held_out, width", [(0, False, 1.5), (40, True, 0.5), (1 << 20, True, 0.5), (40, False, 1.5), (1 << 20, False, 1.5)])
def test_kneser_ney_and_bands(spark, texts, hot, held_out, width):
    """log_ppl, bands and kept against the definitions; the hot set changes nothing; unseen texts back off; a held-out text is scored by the other fold."""
    langs = {"en": texts, None: texts[:30], "de": texts[10:40]}
    rows = [(100 * k + i, t, lang) for k, (lang, ts) in enumerate(langs.items()) for i, t in enumerate(ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    q = quality.PerplexityQuality(order=4, hot=hot, least=40, width=(width, width), held_out=held_out).fit(docs)
    new = [(1, "an unseen text Zebra 17", None), (2, texts[0] + " Qué!", None), (3, texts[1], "en"), (4, "", "en")]
    folds = {r.text or "": r.f for r in docs.unionByName(spark.createDataFrame(new, docs.schema)).select("text", quality.fold().alias("f")).collect()}
    assert set(folds.values()) == {0, 1}
    models = {(lang, f): PlainKneserNey([t for t in ts if not held_out or folds[t or ""] != f], 4) for lang, ts in langs.items() for f in (0, 1)}

    def log_ppl(text, lang):
        return models[lang, folds[text or ""]].log_ppl(text)

    for r in q.score(spark.createDataFrame(new, docs.schema)).collect():
        assert math.isclose(r.log_ppl, log_ppl(dict((a, b) for a, b, _ in new)[r.doc_id], r.lang), abs_tol=2e-6), r.doc_id
    scored = q.score(docs).collect()
    of = {r[0]: r for r in rows}
    for r in scored:
        assert math.isclose(r.log_ppl, log_ppl(of[r.doc_id][1], r.lang), abs_tol=2e-6), r.doc_id
    failed = {r.doc_id: r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words for r in scored}
    values = sorted(r.log_ppl for r in scored if r.lang == "en" and not failed[r.doc_id])
    at = [values[math.ceil(p * len(values)) - 1] for p in (0.25, 0.5, 0.75)]
    spread = max((at[2] - at[0]) / 1.349, 0.02)
    verdict = q.verdict(spark.createDataFrame(scored), q.bands(spark.createDataFrame(scored)))
    for r in verdict.collect():
        wide = width * spread * math.sqrt(1 + 50 / max(r.n_words, 1))
        inside = r.lang != "en" or at[1] - wide <= r.log_ppl <= at[1] + wide  # the others have too few texts for a band
        assert r.kept == (inside and not failed[r.doc_id]), r.doc_id
    assert any(not r.kept and not failed[r.doc_id] for r in verdict.collect())


def test_quality_keeps_columns(spark, texts):
    """accept() returns all columns, whatever their names, and repeated rows alike."""
    docs = frame(spark, texts).withColumnRenamed("row", "n_words").withColumnRenamed("bands", "__row")
    kept = quality.PerplexityQuality().fit(docs).accept(docs.unionByName(docs))
    assert kept.columns == docs.columns
    n = Counter(r.doc_id for r in kept.collect())
    assert n and set(n.values()) == {2} and all(r.n_words == 7 and r["__row"] == "x" for r in kept.collect())


def test_quality_of_empty_table(spark):
    empty = frame(spark, ["a"]).where("doc_id < 0")
    q = quality.PerplexityQuality().fit(empty)
    assert q.accept(empty).count() == 0 and q.score(empty).count() == 0
    assert q.score(frame(spark, ["some text that no model has seen"])).first().log_ppl == pytest.approx(math.log(256), abs=1e-6)


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(WORD)
    t = Tokenizer.from_file(path)
    texts = [*texts, "<|endoftext|> mixed<|startoftext|>x", "ÀÉ ŝ 12345 don't İstanbul", "a b c"]
    want = [len(t.encode(x or "", add_special_tokens=False)) for x in texts]
    for chunk, overlap in ((32_768, 256), (60, 8), (25, 1)):
        got = {r.doc_id: r for r in tokens.count_tokens(frame(spark, texts), path, chunk=chunk, overlap=overlap).collect()}
        assert [got[i].n_tokens for i in range(len(texts))] == want
        assert [got[i].n_bytes for i in range(len(texts))] == [len((x or "").encode()) for x in texts]


def brute_similarity(a, b):
    na, nb = sum(a.values()), sum(b.values())
    a, b = {k: v / na for k, v in a.items()}, {k: v / nb for k, v in b.items()}
    return sum(1 / sum(max(a.get(e, 0) / a[k], b.get(e, 0) / b[k]) for e in a.keys() | b.keys()) for k in a.keys() & b.keys())


def brute_classes(texts):
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in enumerate(texts) if (w := split(t))}
    label = {i: i for i in range(len(texts))}
    for a, b in itertools.combinations(sets, 2):
        if label[a] != label[b] and sets[a].keys() & sets[b].keys() and brute_similarity(sets[a], sets[b]) >= 0.8:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    return label


def test_near_texts(spark, texts):
    got = minhash.near_texts(frame(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_classes(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    copies = []
    for _ in range(150):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(0, 4)):
            w[k] = f"v{rng.randrange(10**6)}"
        copies.append(" ".join(w))
    monkeypatch.setattr(minhash, "LARGE", 20)
    monkeypatch.setattr(minhash, "BLOCK", 32)
    got = {r.doc_id: r.component_id for r in minhash.near_texts(frame(spark, copies)).collect()}
    assert got == brute_classes(copies)


def test_chain_from_a_large_group(spark, monkeypatch):
    """A group, then texts that drift away from it: each is near to its neighbours alone. The first comparisons find the group only, so the chain is left to the steps after them."""
    base = [f"w{k}" for k in range(400)]
    copies = [" ".join([*base[:-1], f"v{k}"]) for k in range(30)]
    for step in range(1, 6):
        copies.append(" ".join([f"d{k}" for k in range(30 * step)] + base[30 * step :]))
    monkeypatch.setattr(minhash, "LARGE", 20)
    verified, calls = minhash._verified, []

    def group_alone(pairs, sets):
        calls.append(1)
        return verified(pairs.where("b < 30") if len(calls) < 3 else pairs, sets)

    monkeypatch.setattr(minhash, "_verified", group_alone)
    got = {r.doc_id: r.component_id for r in minhash.near_texts(frame(spark, copies)).collect()}
    assert got == brute_classes(copies) and len(set(got.values())) == 1


def test_prob_min_hash_estimates(texts):
    rng = random.Random(1)
    a = Counter({i: rng.randrange(1, 4) for i in range(200)})
    b = Counter({i: rng.randrange(1, 4) for i in range(40, 240)})
    doc = np.array([0] * len(a) + [1] * len(b))
    h = textops.mix64(np.array([*a, *b], np.uint64) + np.uint64(1))
    n = np.array([*a.values(), *b.values()], float)
    n[doc == 0] /= n[doc == 0].sum()
    n[doc == 1] /= n[doc == 1].sum()
    with np.errstate(over="ignore"):
        sig = minhash.prob_min_hash(doc, h, n, 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - brute_similarity(a, b)) < 0.05


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    label = {v: v for e in edges for v in e}
    for a, b in edges * 3:
        low, high = sorted((label[a], label[b]))
        label = {k: low if v == high else v for k, v in label.items()}
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: c for v, c in label.items() if any(v in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding(spark, small, texts):
    for limit in (3000, 100_000):
        rows = sharding.extendible(frame(spark, texts), limit=limit).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
        shards = {}
        for r in rows:
            shards.setdefault(r.shard, []).append(r)
        for prefix, members in shards.items():
            total = sum(r.n_bytes for r in members)
            assert (total <= limit and members[0].shard_bytes == total) or all(r.over_limit for r in members)
            assert not any(p != prefix and p.startswith(prefix) for p in shards if not members[0].over_limit)
    hot = frame(spark, ["z" * 100] * 50).selectExpr("1L AS doc_id", "text")
    assert max(Counter(r.shard for r in sharding.extendible(hot, limit=1000).collect()).values()) <= 10
    assert sharding.extendible(hot.where("doc_id = 2")).count() == 0


def test_nbest(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    s = pieces.segmenter(path)
    for text in ("unbelievable", "the a", "日本x", "naïve  two", ""):
        found = s.nbest(text, 6)
        full = s.normalize(text)
        into = s.edges(full)

        def paths(at):
            if at == 0:
                yield 0.0, ()
                return
            for a, score, ids in into[at]:
                for t, before in paths(a):
                    yield t + score, before + ids

        want = sorted(((round(t, 6), ids) for t, ids in paths(len(full))), reverse=True)
        assert [f[0] for f in found] == [t for t, _ in want[:6]]
        assert {(t, tuple(i)) for t, i in found} <= set(want)
        assert s.decode(found[0][1]) == text
    rows = spark.createDataFrame([(1, None), (2, "hi there"), (2, "hi there")], "k long, text string")
    assert pieces.nbest_segmentations(rows, path, ["k"], 3).count() == 3


def test_preference_pairs(spark, small):
    rows = [(1, True, 0, "user", "q"), (1, False, 0, "user", "q"), (1, True, 1, "assistant", "good"), (1, False, 1, "assistant", "bad"), (1, False, 1, "assistant", "bad"), (2, True, 0, "user", "only"), (3, True, 0, None, None), (3, False, 0, None, None), (None, True, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "p long, good boolean, turn long, role string, text string")
    got = {r.p: r for r in chat.preference_pairs(df, "p", "good").collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].prompt == "<|user|>\nq<|end|>\n" and got[1].chosen == "<|assistant|>\ngood<|end|>\n" and got[1].rejected_mask == f"0:{len(got[1].rejected)}:1"
    assert got[1].usable and not got[2].usable and not got[3].usable and got[3].prompt_turns == 1
    plan = chat.preference_pairs(df, "p", "good")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op4_sharding", "op6_preference"])
def test_same_as_sql(spark, small, name):
    from netloom.llm.queries import ORACLE_SQL, QUERIES

    assert not differences(spark, small, QUERIES[name], ORACLE_SQL[name], connect(small))


def test_toxicity(spark):
    rng = random.Random(7)
    plain = [f"w{i}" + "abc"[i % 3] for i in range(400)]
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randrange(10, 80))]
        toxic = i % 4 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["grobian", "GR0BIAN!", "fieslinge", "fieslinger"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d, la = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.Toxicity().fit(d, la.where(~toxicity.held_out()))
    rows = m.score(d).join(la, "doc_id").where(toxicity.held_out()).collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert m.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).where("predicted = 1").count() == 0
    assert m.accept(d.where("doc_id < 0")).count() == 0
    x = toxicity.Lexicon({"trash": 4.0, "scum*": 5.0, "1d1ot": 3.0})
    total, hits, n = x.weigh(["TRASH day", "a trash can", "scumbag сcum", "id10t 1d10t", "1001 5", None, "trasher"])
    assert total.tolist() == [4.0, 0.0, 5.0, 6.0, 0.0, 0.0, 0.0] and hits.tolist() == [1, 0, 1, 2, 0, 0, 0] and n[5] == 0
    assert toxicity.Toxicity().fit(d, la.where("doc_id < 0")).weights == dict.fromkeys(toxicity.SEEDS, toxicity.SEED_WEIGHT)


def test_toxicity_of_disguised_letters(spark):
    """Letters beyond the first plane, decomposed accents and zero-width characters do not hide a word."""
    bold = "".join(chr(0x1D41A + ord(c) - 97) for c in "idiot")
    capitals = "".join(chr(0x1D538 + ord(c) - 65) for c in "IDIOT")
    texts = [bold, capitals, "i\u0301diot", "id\u200biot", "\ufeffid\u00adi\u2060ot", "i\U000e0061diot", "\U0001d6c2 \u0301", "idio t", None, "an idiot"]
    total, hits, n = toxicity.Lexicon({"idiot": 3.0}).weigh(texts)
    assert hits.tolist() == [1, 1, 1, 1, 1, 1, 0, 0, 0, 1] and n.tolist() == [1, 1, 1, 1, 1, 1, 1, 2, 0, 2]
    rows = toxicity.Toxicity().score(frame(spark, [f"you are an {t} and this is a plain text" for t in texts[:6]])).collect()
    plain = toxicity.Toxicity().score(frame(spark, ["you are an idiot and this is a plain text"])).first()
    assert all(r.score == plain.score for r in rows)


def test_substrings(spark, texts):
    for chunk in (1 << 11, 8 << 20):
        got = {r.doc_id: r for r in substrings.remove_repeats(frame(spark, texts), chunk_bytes=chunk).collect()}
        words = [split(t) for t in texts]
        count = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
        for i, w in enumerate(words):
            gone = {k + j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(35)}
            assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
            assert got[i].text == b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
            assert got[i].source == "s" and got[i].bands == "x"
    assert substrings.remove_repeats(frame(spark, ["a"]).where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("path", [None, public_tokenizers.path(WORD)])
def test_packing(spark, texts, path):
    many = [*texts, " ".join(["w"] * 9000), "ab" * 3000, texts[0], texts[0]]
    rows = packing.best_fit(frame(spark, many).withColumnRenamed("row", "piece"), path=path, capacities=(64, 128, 512), group_tokens=3000, texts=True).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    assert {r.doc_id for r in bins.pop(None)} == {i for i, t in enumerate(many) if not split(t)}
    for members in bins.values():
        capacity, at = members[0].bin_capacity, 0
        for r in sorted(members, key=lambda r: r.bin_offset):
            assert r.bin_offset == at and r.bin_capacity == capacity
            at += r.n_tokens
        assert at <= capacity and not any(c >= at and c < capacity for c in (64, 128, 512))
    counter = tokens.Encoder(path).tokenizer if path else None
    for i, t in enumerate(many):
        mine = sorted((r.piece, r.first_byte, r.n_bytes, r.text, r.n_tokens) for r in rows if r.doc_id == i)
        assert "".join(x[3] for x in mine) == (t or "") and [x[0] for x in mine] == list(range(len(mine)))
        assert [x[1] for x in mine] == [sum(y[2] for y in mine[:k]) for k in range(len(mine))]
        for x in mine:
            assert x[4] == (len(counter.encode(x[3], add_special_tokens=False)) if path else len(split(x[3]))) <= 512
    assert packing.best_fit(frame(spark, ["a"]).where("doc_id < 0")).count() == 0


def test_joint_capacities():
    """The mix beats the greatest capacity alone, and comes near the least cost of all ways to pack a few pieces."""

    def total(found):
        return sum(packing.cost(int(c)) for c in found[2])

    rng = random.Random(3)
    lengths = np.array(sorted((rng.choice([200, 240, 400, 500, 900, 1500]) for _ in range(400)), reverse=True))
    alone = total(packing.pack(lengths, (4096,)))
    assert total(packing.pack_jointly(lengths)) < 0.95 * alone

    def ways(items):  # all partitions
        if not items:
            yield []
            return
        for rest in ways(items[1:]):
            yield [[items[0]], *rest]
            for k in range(len(rest)):
                yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]

    ratios = []
    for _ in range(20):
        items = sorted((rng.randrange(20, 1500) for _ in range(6)), reverse=True)
        fits = (w for w in ways(items) if all(sum(b) <= 4096 for b in w))
        best = min(sum(packing.cost(min(c for c in packing.CAPACITIES if c >= sum(b))) for b in w) for w in fits)
        ratios.append(total(packing.pack_jointly(np.array(items))) / best)
    assert min(ratios) >= 1 - 1e-9 and max(ratios) <= 1.3 and sum(ratios) / len(ratios) <= 1.1
    bins, offsets, final = packing.pack_jointly(np.array([100] * 4))
    assert sorted(zip(bins.tolist(), offsets.tolist())) == sorted(set(zip(bins.tolist(), offsets.tolist()))) and len(packing.pack_jointly(np.zeros(0, np.int64))[0]) == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    v = [*(base[i % 60] + rng.standard_normal(16) * 0.08 for i in range(240)), base[0], base[0], np.zeros(16)]
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)] + [(300, None), (301, []), (302, [float("nan")] * 16), (303, [1.0] * 8), (304, [None] * 16)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), load=20).collect()}
    x = np.array([np.float32(r) for r in v[:-1]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min([label[i], *label[link[i]]]) for i in range(len(x))])
    found = sum(got[i].n_links for i in range(len(x)))
    assert found >= 0.99 * link.sum() and all(got[i].n_links <= link[i].sum() for i in range(len(x)))
    assert [got[i].component_id for i in range(len(x))] == label.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in (len(v) - 1, 300, 301, 302, 303, 304))


def test_vectors_with_text_keys_and_blocks(spark, monkeypatch):
    """Cells cut into blocks, doubles that neither overflow nor vanish, repeated ids, an empty table."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = rng.standard_normal(12)
    near = [base + 0.05 * rng.standard_normal(12) for _ in range(50)]
    far = [rng.standard_normal(12) for _ in range(30)]
    v = [*near, *far, base * 1e200, base * 1e-200, base]
    rows = [(f"k{i:03}", x.tolist()) for i, x in enumerate(v)] + [("k000", near[1].tolist()), (None, base.tolist())]
    got = {r.name: r for r in vectors.near_vectors(spark.createDataFrame(rows, "name string, e array<double>"), "name", "e", load=8).collect()}
    x = np.array([r / np.abs(r).max() for r in v])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    assert len(got) == len(v) and all(got[f"k{i:03}"].n_links == link[i].sum() + 1 for i in range(2, 50))  # k000 stands for two vectors
    assert all(got[f"k{i:03}"].component_id == "k000" for i in [*range(50), 80, 81, 82]) and got["k000"].kept and not got["k001"].kept
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(empty).count() == 0


def test_near_texts_by_text_keys(spark, texts, monkeypatch):
    monkeypatch.setattr(minhash, "LARGE", 4)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "ASKS", 3)
    rng = random.Random(9)
    w = texts[3].split()
    more = [*texts]
    for _ in range(12):
        k = rng.randrange(len(w))
        more.append(" ".join(w[:k] + ["other"] + w[k + 1 :]))
    docs = frame(spark, more).selectExpr("concat('d', lpad(doc_id, 4, '0')) AS doc_id", "text", "doc_id AS id", "lang AS c")
    want = {f"d{i:04}": f"d{c:04}" for i, c in brute_classes(more).items()}
    got = minhash.near_texts(docs.unionByName(docs)).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(more)
    assert minhash.near_texts(docs.where("id < 0")).count() == 0


def thue_morse(n):
    s = [0]
    while len(s) < n:
        s += [1 - x for x in s]
    return "".join("ab"[x] for x in s), "".join("ba"[x] for x in s)


def test_words_that_cancel_out(spark):
    """Two words whose polynomial hashes modulo 2^64 are equal are told apart."""
    a, b = thue_morse(2048)
    w = textops.Words(pa.array([a, b, "x" * 5000, "x" * 4999 + "y"]))
    assert len(set(w.hashes().tolist())) == 4
    rest = [f"w{k}" for k in range(40)]
    docs = frame(spark, [" ".join([*rest[:20], x, *rest[20:]]) for x in (a, b)])
    assert {r.n_removed for r in substrings.remove_repeats(docs).collect()} == {0}
    from tokenizers import Tokenizer

    path = public_tokenizers.path(WORD)
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path).collect()}
    assert got == {i: len(t.encode(" ".join([*rest[:20], x, *rest[20:]]), add_special_tokens=False)) for i, x in enumerate((a, b))}


def test_substring_levels(spark):
    assert substrings.levels(35) == [9, 18, 35]
    docs = frame(spark, [" ".join(f"a{i}x{k}" for k in range(60)) for i in range(5)])
    assert {r.n_removed for r in substrings.remove_repeats(docs).collect()} == {0}  # no candidate survives the first level
    periodic = [" ".join(["p", "q", "r"] * 30), " ".join(["p", "q"] * 9 + ["z"] + ["p", "q"] * 9)]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(frame(spark, periodic)).collect()}
    assert got == {0: 90, 1: 0}


def test_nbest_of_long_words(spark):
    """Work grows in proportion to a word's length, and ties do not multiply."""
    s = pieces.segmenter(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("ab" * 8000, "x" * 20_000):
        found = s.nbest(text, 4)
        assert len(found) == 4 and all(s.decode(ids) == text for _, ids in found)
        assert [f[0] for f in found] == sorted((f[0] for f in found), reverse=True)
    assert pieces.nbest_segmentations(spark.createDataFrame([], "k long, text string"), public_tokenizers.path("piece_bpe_32k.model"), ["k"]).count() == 0


def test_pipeline_stages(spark, small):
    import corpus_pipeline
    from netloom.llm.shared import written

    docs = spark.read.parquet(f"{small}/documents.parquet")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, small), name)
        assert after.columns == columns, name
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, small)
    texts = {}
    for r in packed.collect():
        texts.setdefault(r.doc_id, {})[r.piece] = r.text
    assert {k: "".join(v[p] for p in sorted(v)) for k, v in texts.items()} == {r.doc_id: r.text or "" for r in before.collect()}


def test_near_duplicates_judges_rows(spark, texts):
    """Rows with a null or repeated doc_id stay unless their text is a near copy of a kept one."""
    import corpus_pipeline

    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[4]), (8, texts[5]), (None, texts[5]), (5, texts[6]), (9, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(map(str, kept)) == sorted(str(docs_row) for docs_row in spark.createDataFrame([rows[k] for k in (0, 1, 2, 3, 4, 6)], docs.schema).collect())


def test_kept_digest(spark, small):
    from netloom.llm.queries import op8_substrings

    r = op8_substrings(spark, small).where("n_words = n_removed").first()
    assert r is None or r.kept_sha256 == hashlib.sha256(b"").hexdigest()
