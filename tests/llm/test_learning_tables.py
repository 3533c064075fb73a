"""Hard negatives, fill-in-middle and language-model scores: SQL, brute force and exact round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from veldra.llm import elias_fano, fill_in_middle, hard_negatives, ngram_scores, queries


def same_rows(got, want):
    a, b = got.toPandas(), want.df()
    assert sorted(a.columns) == sorted(b.columns)
    plain = lambda x: None if pd.isna(x) else int(x) if isinstance(x, (float, np.number)) else x
    rows = lambda f: sorted((tuple(plain(x) for x in r) for r in f[sorted(a.columns)].itertuples(index=False, name=None)), key=str)
    assert rows(a) == rows(b)
    return len(a)


@pytest.mark.parametrize("name", ["op11_multi_index_negatives", "op12_counted_quantifiers"])
def test_against_sql(spark, duck, folder, name):
    assert same_rows(queries.QUERIES[name](spark, folder), duck.sql(queries.ORACLES[name])) > 100


# ---- hard negatives


def brute_negatives(rows, positives=5, negatives=10):
    """(anchor_id, positive_rank, rank, positive_id, negative_id, scores) from all products."""
    use = []
    for i, label, e in rows:
        if i is None or label is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        use.append((i, (label + 1) % 10 if i % 7 == 0 else label, np.array([math.floor(256 * x) for x in e], np.int64)))
    out = []
    for a, (i, label, v) in enumerate(use):
        if i % 100:
            continue
        scores = [(-int(v @ w), j, lab == label) for b, (j, lab, w) in enumerate(use) if b != a and len(w) == len(v)]
        scores.sort()
        for p, (ps, pid, _) in enumerate([s for s in scores if s[2]][:positives]):
            near = [(-s, j) for s, j, alike in scores if not alike and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(i, p + 1, r + 1, pid, j, -ps, s) for r, (s, j) in enumerate(near[:negatives])]
    return sorted(out)


def mined(df, **kw):
    cols = ["anchor_id", "positive_rank", "rank", "positive_id", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, **kw).select(*cols).collect())


def vector_rows():
    r = random.Random(5)
    centre = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, i % 4, [c + r.gauss(0, 0.3) for c in centre[i % 4]]) for i in range(0, 900)]
    rows += [(i, r.randrange(3), [r.uniform(0, 1) for _ in range(5)]) for i in range(900, 1300)]  # another dimension
    rows += [(i, 1, [0.5] * 6) for i in range(1300, 1701)] + [(1700, 2, [0.5] * 6)] * 3  # a hot vector, repeated rows
    rows += [(100, None, [1.0] * 6), (200, 1, None), (300, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (400, 1, [float("nan")] * 6), (500, 2, [float("inf")] * 6), (600, 1, []), (None, 1, [1.0] * 6), (2000, 3, [0.7])]
    return rows


@pytest.mark.parametrize("kw", [{}, {"block": 50, "wave": 3, "words": 3, "sample": 60}])
def test_negatives_by_brute_force(spark, kw):
    """Two dimensions, a hot vector, repeated, null and non-finite rows, further columns, several waves and blocks."""
    rows = vector_rows()
    df = spark.createDataFrame([(*x, 0, "q") for x in rows], "vec_id long, label int, embedding array<double>, rank int, Label2 string").repartition(3)
    want = brute_negatives(rows)
    assert len(want) > 500 and mined(df, **kw) == want


def test_negatives_of_nothing(spark):
    shape = "vec_id long, label int, embedding array<float>"
    assert mined(spark.createDataFrame([], shape)) == []
    assert mined(spark.createDataFrame([(100, 1, [1.0, 2.0])], shape)) == []


def test_bounds_of_cells_hold():
    """No product of a cell's vector lies outside the sums of half-scores with radii."""
    r = np.random.default_rng(3)
    x = r.integers(-200, 200, (800, 7))
    book = hard_negatives.Book(list(x[:300]), 5)
    order = np.argsort(book.cells(x), kind="stable")
    block = hard_negatives.Block(np.arange(800), np.arange(800), r.integers(0, 3, 800), book.cells(x)[order], x[order])
    for low, high in ((-(1 << 40), 1 << 40), (1000, 60_000), (-5000, 10)):
        w = hard_negatives.Windows(np.full(20, -1), np.full(20, -1), np.zeros(20, np.int64), x[:20], np.full((20, 1), low), np.full((20, 1), high), False, 4)
        w.search(block, book)
        for a in range(20):
            s = block.vectors @ x[a]
            ok = (block.labels != 0) & (s >= low) & (s <= high)
            want = sorted(zip(-s[ok], block.ids[ok]))[:4]
            got = w.found.get((a, 0), ([], []))
            assert [(-int(k), int(i)) for i, k in zip(*got)] == [(int(k), int(i)) for k, i in want]


# ---- fill-in-middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(doc_id, text):
    text, h = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    u = UNIT.findall(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_middle_by_brute_force(spark):
    r = random.Random(2)
    chars = "ab \t\n\x0b\x0c\r\x1c\x85\xa0é日😀<P>SM$\\1"
    texts = ["", None, " ", "\n\n", "a", "a ", " a", "<P> mark", "x<S", "<", "$1 \\2 $3 {4}", "\x00 nul", "word " * 3000, "y" * 40_000, " " * 40_000]
    texts += ["".join(r.choice(chars) for _ in range(r.randrange(60))) for _ in range(1500)]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)] + [(None, "no id at all", 0, "x"), (7, "a b", 0, "x"), (7, "a b", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, Text2 string")
    out = fill_in_middle.fill_in_middle(df)
    got = out.withColumn("back", fill_in_middle.restored(out.output, out.form)).collect()
    key = lambda x: tuple(map(str, x))
    want = sorted(((i, *brute_middle(i, t), t or "") for i, t, *_ in rows), key=key)
    assert sorted((tuple(g) for g in got), key=key) == want
    assert len({g["form"] for g in got}) == 3
    assert fill_in_middle.fill_in_middle(df.limit(0)).count() == 0


def test_middle_of_a_very_long_text(spark):
    """Several MB of words, and of one word: no deep stack, the same parts."""
    texts = ["lorem ipsum  dolor\n" * 200_000, "é" * 3_000_000, " \t" * 1_500_000]
    rows = [(i, t) for i in range(40, 48) for t in texts]
    got = fill_in_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda x: (x[0], x[1], x[2], len(x[-1]), hashlib.sha256(x[-1].encode()).hexdigest())
    assert sorted(key(g) for g in got) == sorted(key((i, *brute_middle(i, t))) for i, t in rows)


# ---- Elias-Fano and language-model scores


@pytest.mark.parametrize("top", [1, 5, 300, 1 << 20, 1 << 45, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 40_000])
def test_sequences(n, top):
    r = np.random.default_rng(n + 1)
    x = np.sort(r.integers(0, top, n, np.uint64, endpoint=True))
    s = elias_fano.Sequence.build(x)
    assert np.array_equal(s.get(np.arange(n)), x)
    ask = np.r_[x, r.integers(0, top, 500, np.uint64, endpoint=True), np.array([0, top], np.uint64)]
    assert np.array_equal(s.successor(ask), np.searchsorted(x, ask))
    if n == 40_000 and top > 1 << 40:
        assert 8 * (s.upper.nbytes + s.lower.nbytes) <= n * (np.log2(top / n) + 4) + 1000  # near the bound of 2 + log2(u / n) bits


def test_level_by_dictionary():
    r = np.random.default_rng(4)
    grams = sorted({(int(c), int(w)) for c, w in zip(r.integers(0, 1 << 62, 300).repeat(20), r.integers(0, 1 << 40, 6000))})
    context, child = (np.array(x, np.uint64) for x in zip(*grams))
    n = len(grams)
    level = elias_fano.Level.frombuffer(elias_fano.Level.build(context, child, np.arange(n) % 60_000, np.arange(n) % 100, np.arange(n)).tobytes())
    at, hit = level.find(context, child)
    assert hit.all() and np.array_equal(at, np.arange(n)) and np.array_equal(level.count, np.arange(n))
    other = np.r_[context[1:], context[:1]]
    assert [bool(h) for h in level.find(other, child)[1]] == [(int(c), int(w)) in set(grams) for c, w in zip(other, child)]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens_of(text):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def learns(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


class Brute:
    """The same model by dictionaries of counts, not quantised."""

    def __init__(self, rows, order, kappa):
        self.order, self.kappa, self.count, self.context = order, kappa, Counter(), Counter()
        for i, t in rows:
            if learns(i):
                w = ["<s>"] * (order - 1) + tokens_of(t)
                for k in range(order - 1, len(w)):
                    for n in range(order):
                        self.count[tuple(w[k - n : k + 1])] += 1
                        self.context[tuple(w[k - n : k])] += 1
        self.total, self.distinct = self.context[()], len([g for g in self.count if len(g) == 1])

    def p(self, gram):
        if len(gram) == 1:
            return (self.count[gram] + 1) / (self.total + self.distinct + 1)
        kappa = self.kappa[len(gram) - 2] if isinstance(self.kappa, tuple) else self.kappa
        return (self.count[gram] + kappa * self.p(gram[1:])) / (self.context[gram[:-1]] + kappa)

    def score(self, text):
        w = ["<s>"] * (self.order - 1) + tokens_of(text)
        grams = [tuple(w[k - self.order + 1 : k + 1]) for k in range(self.order - 1, len(w))]
        return len(grams), sum(self.count[g[-1:]] > 0 for g in grams), sum(math.log10(self.p(g[-1:])) for g in grams), sum(math.log10(self.p(g)) for g in grams)


def score_rows():
    r = random.Random(8)
    words = ["Ab", "ab", "c", "d", "é", "日本", "word,", "x\x1cy", "zz"]
    rows = [(i, " ".join(r.choice(words[: 2 + i % 8]) for _ in range(r.randrange(30)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "rare unseen words " * 3), (None, "no id c d"), (5, "ab c d"), (5, "ab c d"), (204, "hot " * 5000), (205, "ab c " * 4000)]
    return rows


@pytest.mark.parametrize("order,kw", [(1, {}), (2, {}), (2, {"tokens": 97, "entries": 20}), (3, {"tokens": 500, "entries": 50})])
def test_scores_by_brute_force(spark, order, kw):
    """Whole and cut-up texts, one shard and many, hot words and contexts: counts are equal, scores but for their steps."""
    rows = score_rows()
    df = spark.createDataFrame([(*x, 1, "q") for x in rows], "doc_id long, text string, n_tokens int, Text2 string").repartition(3)
    got = defaultdict(list)
    for x in ngram_scores.ngram_scores(df, order=order, kappa=3.0, **kw).collect():
        got[x["doc_id"]].append(x)
    model = Brute(rows, order, 3.0)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        n, known, base, score = model.score(t)
        x = next(x for x in got[i] if x["n_tokens"] == n)
        assert (x["held_out"], x["n_known"], x["train_tokens"]) == (not learns(i), known, model.total)
        assert math.isclose(x["base_score"], base, rel_tol=1e-9) and abs(x["score"] - score) <= n * order / ngram_scores.STEPS + 1e-6, (i, x, score)


@pytest.mark.parametrize("kw", [{}, {"tokens": 300, "entries": 40}])
def test_scores_look_back_four_words(spark, kw):
    """Without an order given, contexts of four words count: scores and kept levels are those of n-grams of up to five."""
    rows, got, keep = score_rows(), defaultdict(list), []
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for x in ngram_scores.ngram_scores(df, kappa=(3.0, 2.0, 1.0, 0.5), keep=keep, **kw).collect():
        got[x["doc_id"]].append(x)
    model = Brute(rows, 5, (3.0, 2.0, 1.0, 0.5))
    for i, t in rows:
        n, known, base, score = model.score(t)
        x = next(x for x in got[i] if x["n_tokens"] == n)
        assert x["n_known"] == known and math.isclose(x["base_score"], base, rel_tol=1e-9) and math.isclose(x["score"], score, rel_tol=1e-9), (i, x, score)
    for n in range(2, 6):
        levels = [elias_fano.Level.frombuffer(r["payload"]) for r in keep[0].levels.where(f"level = {n}").collect()]
        assert sum(x.children.n for x in levels) == len([g for g in model.count if len(g) == n])
        assert sum(int(x.count.sum()) for x in levels) == model.total


def test_scores_of_nothing(spark):
    shape = "doc_id long, text string"
    assert ngram_scores.ngram_scores(spark.createDataFrame([], shape)).count() == 0
    held = next(i for i in range(100) if not learns(i))
    x = ngram_scores.ngram_scores(spark.createDataFrame([(held, "one two")], shape)).collect()[0]
    assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"], x["score"]) == (True, 3, 0, 0, 0.0, 0.0)


def test_kept_levels_sum_to_one(spark):
    """The levels that are kept hold each bigram learnt from, and a context's probabilities add up to one."""
    rows, keep = score_rows(), []
    ngram_scores.ngram_scores(spark.createDataFrame(rows, "doc_id long, text string"), kappa=3.0, entries=200, keep=keep).count()
    levels = [elias_fano.Level.frombuffer(r["payload"]) for r in keep[0].levels.where("level = 2").collect()]
    brute = Brute(rows, 2, 3.0)
    assert sum(x.children.n for x in levels) == len([g for g in brute.count if len(g) == 2])
    assert sum(int(x.count.sum()) for x in levels) == brute.total == keep[0].total
    for context in ("ab", "c", "<s>", "never"):
        rest = {g[-1] for g in brute.count if len(g) == 1}
        assert math.isclose(sum(brute.p((context, w)) for w in rest) + 3.0 / (brute.context[(context,)] + 3.0) / (brute.total + brute.distinct + 1), 1.0, rel_tol=1e-9)


def test_held_out_texts_score_better_than_words_alone(spark):
    x = queries.QUERIES["op13_elias_fano_scores"](spark, "/root/testdata/sf0.01").where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert x["sum(score)"] > x["sum(base_score)"]


def test_windows_hash_longer_endings_only_where_they_are_dealt_out(monkeypatch):
    """All five words of a few windows alone are hashed (before: of all), and the shards are those of all endings."""
    rng, made = np.random.default_rng(3), []
    flat = np.r_[np.full(4, 1), np.minimum(rng.zipf(1.3, 3000), 60) + 1].astype(np.int64)
    c = ngram_scores.Chunk.__new__(ngram_scores.Chunk)
    c.lead, c.tokens, c.size, c.first = 4, flat, np.array([len(flat)]), np.array([0])
    c.scored = np.arange(len(flat)) >= 4
    c.counted = c.scored & (rng.random(len(flat)) < 0.8)
    ids = np.arange(62, dtype=np.int64)
    full, none = ngram_scores.endings, np.zeros(0, np.uint64)
    plain = ngram_scores.Windows(c, ids, 5, 7, none)
    all_ = plain.endings()
    hot = np.sort(np.concatenate([v[np.argsort(-n)[:3]] for v, n in (np.unique(h, return_counts=True) for h in all_[1:4])]))
    monkeypatch.setattr(ngram_scores, "endings", lambda x: made.append(len(x) * len(x[0])) or full(x))
    got = ngram_scores.Windows(c, ids, 5, 7, hot)
    key, wide = all_[1].copy(), ngram_scores.spread(hot, all_)
    for on, longer in zip(wide, all_[2:]):
        key = np.where(on, longer, key)
    shard = (ngram_scores._mix(key) >> np.uint64(33)).astype(np.int64) % 7
    assert (got.shard == np.sort(shard)).all() and (got.place[got.dealt] == np.arange(len(shard))).all() and (shard[got.dealt] == got.shard).all()
    assert [r.tolist() for r, _ in got.spread] == [np.flatnonzero(x).tolist() for x in wide] and len(got.spread[2][0])
    assert all((h == e[r]).all() for (r, h), e in zip(got.spread, all_[1:]))
    columns, own = got.asked(c)
    assert own.sum() == c.counted[got.at].sum() and all((x == y[got.dealt]).all() for x, y in zip(full(columns), all_))
    assert sum(made) < 5 * len(shard)


def test_messages_are_freed_once_they_are_answered(spark, monkeypatch):
    """After each round, not whenever the driver collects its garbage (before: never asked for)."""
    calls = []
    monkeypatch.setattr(ngram_scores, "free_shuffles", lambda s: calls.append(s))
    docs = spark.createDataFrame([(i, "one two three four five six") for i in range(20)], "doc_id long, text string")
    assert ngram_scores.ngram_scores(docs).count() == 20 and calls == [spark, spark]


def test_windows_are_asked_for_in_rounds(spark, monkeypatch):
    """No round's messages hold all windows (before: one shuffle held them all), and no score is changed by rounds."""
    rng, calls = np.random.default_rng(4), []
    docs = [(i, " ".join(map(str, np.minimum(rng.zipf(1.4, 60), 40)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(ngram_scores, "free_shuffles", lambda s: calls.append(s))
    whole = sorted(ngram_scores.ngram_scores(df, tokens=200, entries=50, rounds=1).collect())
    once = len(calls)
    assert sorted(ngram_scores.ngram_scores(df, tokens=200, entries=50).collect()) == whole and len(calls) == once + 3

    flat = np.r_[np.full(4, 1), np.minimum(rng.zipf(1.3, 3000), 60) + 1].astype(np.int64)
    c = ngram_scores.Chunk.__new__(ngram_scores.Chunk)
    c.lead, c.tokens, c.size, c.first = 4, flat, np.array([len(flat)]), np.array([0])
    c.scored = np.arange(len(flat)) >= 4
    c.counted, c.words = c.scored.copy(), np.arange(62).astype(np.uint64) + np.uint64(5)
    ids = np.arange(62, dtype=np.int64)
    all_ = ngram_scores.Windows(c, ids, 5, 12, np.zeros(0, np.uint64)).endings()
    hot = np.sort(np.concatenate([v[np.argsort(-n)[:3]] for v, n in (np.unique(h, return_counts=True) for h in all_[1:4])]))
    full = ngram_scores.Windows(c, ids, 5, 12, hot, 3)
    parts = [ngram_scores.Windows(c, ids, 5, 12, hot, 3, k) for k in range(3)]
    assert all(0 < len(p.one) < 0.6 * len(full.one) and set(p.shard % 3) == {k} for k, p in enumerate(parts))
    columns, own = full.asked(c)
    for k, p in enumerate(parts):
        mine, some = full.shard % 3 == k, p.asked(c)
        assert (full.shard[mine] == p.shard).all() and (own[mine] == some[1]).all() and all((x[mine] == y).all() for x, y in zip(columns, some[0]))
