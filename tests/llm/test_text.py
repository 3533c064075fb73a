"""Near copies, search, personal data and the learned operators: brute force, held-out figures, odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veldra.llm import language_id, pii, quality, queries, simhash, topk_search, toxicity
from veldra.llm.common import components

ODD = [None, "", "   ", "word", "Word", "one two three", "a " * 3000, "🙂 ünï cödé", "x" * 20000]


def odd_docs(spark):
    rows = [(i, t, "en", i, "f") for i, t in enumerate(ODD)] + [(None, "no id here", None, 0, "f"), (3, "word", "en", 3, "f"), (3, "word", "en", 3, "f")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, component_id int, fingerprint string")


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    r, sets = random.Random(1), Sets()
    edges = [(r.randint(-200, 200), r.randint(-200, 200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    for a, b in edges:
        sets.join(a, b)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: sets.find(x) for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embedding_is_a_lower_bound():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    counts = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * i)) & np.uint64(3)) for i in range(32)]).astype(int)
    assert np.array_equal(np.abs(counts(a) - counts(b)).sum(0), np.bitwise_count(simhash._unary(a) ^ simhash._unary(b)))
    assert (np.bitwise_count(simhash._unary(a) ^ simhash._unary(b)) <= np.bitwise_count(a ^ b)).all()


def brute_components(prints, bits):
    u, sets = sorted(set(prints.values())), Sets()
    arr = np.array(u, np.uint64)
    for i, x in enumerate(arr):
        for j in np.flatnonzero(np.bitwise_count(arr ^ x) <= bits):
            sets.join(i, int(j))
    least = {}
    for k, x in prints.items():
        c = sets.find(u.index(x))
        least[c] = min(least.get(c, k), k)
    return {k: least[sets.find(u.index(x))] for k, x in prints.items()}


@pytest.mark.parametrize("small,wide", [(48, 16384), (4, 40)])
def test_links_lose_nothing(spark, small, wide, monkeypatch):
    """Clusters of random fingerprints, with cells small and large enough to take every path."""
    r = random.Random(2)
    prints, k = {}, 0
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 10, 60])):
            prints[k] = x
            for _ in range(r.randint(0, 2)):
                x ^= 1 << r.randrange(64)
            k += 1
    monkeypatch.setattr(simhash.PrintCells.__init__, "__defaults__", (small, wide))
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in sorted(set(prints.values()))], "fp long").select(F.col("fp").alias("node"), "fp")
    links = simhash.related(nodes, bits=4, wide=wide)
    sets = Sets()
    for e in links.collect():  # a node is its fingerprint here
        assert bin((e["a"] ^ e["b"]) & (1 << 64) - 1).count("1") <= 4
        sets.join(e["a"] & (1 << 64) - 1, e["b"] & (1 << 64) - 1)
    want = brute_components(prints, 4)
    groups = collections.defaultdict(set)
    for k, x in prints.items():
        groups[sets.find(x)].add(k)
    assert {frozenset(g) for g in groups.values()} == {frozenset(k for k in want if want[k] == c) for c in set(want.values())}


def test_op7_against_brute_force(spark, docs, folder):
    rows = docs.select("doc_id", "text").collect()
    prints = {r["doc_id"]: simhash.majority(simhash.hashes(simhash.shingles(simhash.words_of(r["text"]), 4))) & (1 << 64) - 1 for r in rows}
    want = brute_components(prints, 4)
    got = simhash.op7_simhash_segments(spark, folder).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got} == {k: (prints[k], want[k]) for k in want}


def test_simhash_of_odd_rows(spark):
    df = odd_docs(spark)
    got = simhash.simhash_components(df).collect()
    assert len(got) == df.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["fingerprint"] == by[1]["fingerprint"] == "0" * 16 and by[2]["component_id"] == 0
    assert by[3]["component_id"] == by[4]["component_id"] == 3
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_near_copies_stay_once(spark):
    r = random.Random(4)
    base = [["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(200)] for _ in range(12)]
    rows, groups = [], {}
    for g, words in enumerate(base):
        for c in range(1 + 3 * (g % 4)):
            w = list(words)
            if c:
                w[r.randrange(200)] = "changed" + str(c)
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
    rows.append((len(rows), rows[0][1].upper()))
    groups[len(rows) - 1] = 0
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["doc_id"] for r in simhash.deduplicated(df).collect()]
    first = {}
    for k, g in groups.items():
        first.setdefault(g, k)
    assert sorted(kept) == sorted(first.values())


def test_near_copies_lose_none(spark):
    """Every pair at a similarity of 0.8 or more, also after contiguous edits and in short texts, by brute force."""
    r = random.Random(11)
    new = lambda n: ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    rows = []
    for n in [*range(1, 40), *[200] * 400]:
        w = new(n)
        rows += [w, w + new(r.randrange(1, n // 4 + 2))]
    passage = new(60)  # in texts that have little else, and in others
    rows += [passage + new(k) for k in range(0, 40, 2)] + [new(200) + passage for _ in range(40)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    root = {x["doc_id"]: x["root"] for x in simhash.near_copies(df).collect()}
    sets = [set(zip(*(w[i:] for i in range(5)))) if len(w) > 5 else {tuple(w)} for w in rows]
    parent, near = list(range(len(rows))), 0

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                near += 1
                parent[top(i)] = top(j)
    groups = lambda of: sorted(sorted(i for i in range(len(rows)) if of(i) == x) for x in {of(i) for i in range(len(rows))})
    assert near > 300 and groups(root.get) == groups(top)


def test_words_are_cut_alike():
    """Hashes from running sums against words cut one by one, over texts in one piece and in several."""
    import pyarrow as pa

    r, known = random.Random(1), {}
    texts = [None, "", " ", "A b\tC\n", "é É x"] + ["".join(r.choice("aB \n\x0b é") for _ in range(r.randint(0, 60))) for _ in range(500)]
    for piece in (8, 64, 1 << 20):
        for column in (pa.array(texts), pa.array(texts)[3:], pa.array(texts[:0], pa.string())):
            got = list(simhash.cut_words(column, piece))
            assert len(got) == len(column)
            for t, found in zip(column.to_pylist(), got):
                assert len(found) == len(simhash.words_of(t))
                assert all(known.setdefault(w, h) == h for w, h in zip(simhash.words_of(t), found.tolist()))
    assert len(set(known.values())) == len(known)


def similar_groups(texts):
    """Groups of texts by brute force: all pairs of their sets of five-word shingles."""
    sets = []
    for t in texts:
        w = simhash.words_of(t)
        sets.append(set(zip(*(w[i:] for i in range(5)))) if len(w) > 5 else {tuple(w)})
    near = Sets()
    for i, a in enumerate(sets):
        near.find(i)
        for j in range(i):
            n = len(a) + len(sets[j])
            if 9 * min(len(a), len(sets[j])) >= 4 * n and 9 * len(a & sets[j]) >= 4 * n:
                near.join(i, j)
    return [near.find(i) for i in range(len(texts))]


@pytest.mark.parametrize("changed,small,wide", [(1, 4, 16384), (8, 4, 30), (8, 0, 16384), (14, 12, 60)])
def test_large_cells_lose_none(spark, changed, small, wide):
    """Large groups of near copies, of which many are only linked through others, or not at all."""
    r = random.Random(5 + changed)
    rows = []
    for _ in range(2):
        words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
        for i in range(90):
            w = list(words)
            for _ in range(r.randint(0, changed)):
                w[r.randrange(300)] = f"edit{r.random()}"
            rows.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    root = {x["doc_id"]: x["root"] for x in simhash.near_copies(df, small=small, wide=wide).collect()}
    want, got = collections.defaultdict(set), collections.defaultdict(set)
    for i, k in enumerate(similar_groups(rows)):
        want[k].add(i)
        got[root[i]].add(i)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))
    assert changed == 1 or len(want) > 2


def test_near_copies_of_documents(spark, docs):
    rows = docs.orderBy("doc_id").collect()
    want = similar_groups([r["text"] for r in rows])
    first = {}
    for r, k in zip(rows, want):
        first.setdefault(k, r["doc_id"])
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == sorted(first.values())


def test_deduplicated_odd_rows(spark):
    df = odd_docs(spark)
    got = simhash.deduplicated(df).collect()
    assert sorted((r["doc_id"] for r in got), key=lambda k: (k is None, k)) == [0, 3, 5, 6, 7, 8, None]
    assert simhash.deduplicated(df).columns == df.columns and simhash.deduplicated(df.limit(0)).count() == 0
    odd = df.withColumn("of", F.create_map(F.lit("k"), F.col("lang"))).select("*", F.lit("clash").alias("Text"))
    assert simhash.deduplicated(odd).count() == 7 and simhash.deduplicated(odd).columns == odd.columns


def brute_top(vectors, every, k):
    out = {}
    for i, q in vectors:
        if i % every == 0:
            out[i] = sorted(((int(np.dot(q, p)), j) for j, p in vectors if j != i), key=lambda s: (-s[0], s[1]))[:k]
    return out


@pytest.mark.parametrize("kind", ["unit", "long", "ties"])
def test_topk_exact(spark, kind):
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "long":
        x *= np.exp(r.normal(size=400) * 1.5)[:, None]
    if kind == "ties":
        x = np.round(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for row in topk_search.top_k(df, every=10, bucket=32, wave=9).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append((row["score"], row["vec_id"]))
    assert dict(got) == brute_top([(i, np.floor(v * 256)) for i, v in enumerate(x)], 10, 5)


def test_topk_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 1.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0]), (None, [1.0, 1.0]), (7, [3.0, 3.0]), (7, [3.0, 3.0]), (100, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in topk_search.top_k(df).collect())
    assert got == [(0, 1, 7), (0, 2, 7), (0, 3, 50), (50, 1, 7), (50, 2, 7), (50, 3, 0), (100, 1, 6)]  # one row of each query
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_op1_against_sql(spark, duck, folder):
    got = topk_search.op1_topk_search(spark, folder).select("query_id", "query_row", "rank", "vec_id", "score").collect()
    want = duck.sql(queries.ORACLES["op1_topk_search"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_op1_of_repeated_ids_against_sql(spark, tmp_path):
    import duckdb

    r = np.random.default_rng(3)
    rows = [(int(i), r.integers(-9, 9, 4).astype(float).tolist()) for i in [0, 0, 0, 1, 1, 2, 3, 50, 50, 51, 100]]
    rows.append(rows[0])  # the same id and vector
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = topk_search.op1_topk_search(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(queries.ORACLES["op1_topk_search"]).fetchall()) and len(got) == 35


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def same_spans(rows, texts):
    for r in rows:
        b = brute_spans(texts[r["doc_id"]] or "")
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), repr(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == x for x, _, _ in b) for k in pii.KINDS]
        assert set(text.split(",")) <= set(r["spans"].split(",")) or not text


NEVER = [pii.Boosted(0.0, [], float("inf"))] * 4


def test_base_spans_fuzzed(spark):
    r = random.Random(5)
    parts = list("ab1204.@+- ()%é😀\n") + ["a@b.c", "1.2.3.4", "4644348398010899", "+1 (706) 555-3138", "255.1.1.", "4644 3483 9801 0899 "]
    texts = {i: "".join(r.choice(parts) for _ in range(r.randint(0, 25))) for i in range(3000)}
    texts |= {9000: None, 9001: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("spans", F.lit(1))
    same_spans(pii.pii_digests(df, models=NEVER).collect(), texts)


def test_long_runs_are_linear(spark):
    long = ["a" * 200000, "1 " * 100000, "1" * 200000, "a@" * 50000, "a@b" + ".c" * 50000, "+1" + " 2" * 50000, "1.2.3.4 " * 3000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in pii.pii_digests(df, models=NEVER).collect()}
    assert got[4]["n_email"] == 1 and got[6]["n_ip"] == 3000 and got[0]["n_email"] == 0


def test_op10_base_spans(spark, docs, folder):
    same_spans(pii.op10_pii_boosting(spark, folder).collect(), dict(docs.select("doc_id", "text").collect()))


def test_boosting_adds_unsigned_phones(spark):
    r = random.Random(8)
    num = lambda: f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"
    texts = [f"call phone +1 {num()} now" for _ in range(120)] + [f"order 20-{r.randint(100, 999)}-{r.randint(100, 999)} sent" for _ in range(60)]
    texts.append("call phone (415) 555-2671 now")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in pii.pii_digests(df).collect()}
    assert all(got[i]["n_phone"] == 1 for i in range(120))
    assert all(got[i]["spans"] == "" for i in range(120, 180))
    assert got[180]["n_phone"] == 0 and got[180]["spans"] == "phone:11:25"


def test_training_sees_every_kind(spark, monkeypatch):
    """Neither many e-mails in a document nor one candidate in many documents keeps others out of training."""
    seen = []
    monkeypatch.setattr(pii, "fit", lambda x, y: seen.append(x))
    mails = " ".join(f"user{i}@host{i}.com" for i in range(400))
    texts = [f"{mails} card 4111 1111 1111 1111 tel 030 1234 5678" for _ in range(3)] + ["mail me at a@b.com"] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pii.train(df, 400)
    assert len(seen[2]) == 9 and len(seen[3]) >= 3 and len(seen[0]) == 900  # each card also as a near miss, each phone as a card
    seen.clear()
    pii.train(df, 40)
    assert len(seen[0]) <= 200 and all(len(x) <= 200 for x in seen)


def test_every_kind_is_boosted(spark):
    """On whole tables each kind has trees and a threshold of the precision asked for; the spans that they add are
    those that the trees select one by one, and the first of those that overlap."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", text.alias("text"))
    more = ["write to und.34 (at) mail7 (dot) example (dot) com", "host 10[.]20[.]30[.]140 and 1.2.3.400", "call (017) 555-7713 or 4644348398010899 4644348398010899", "3782 822463 10005"]
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], docs.schema)).repartition(4).persist()
    models = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", text.alias("text")).repartition(4))
    for m in models:
        assert len(m.trees) >= 4 and m.threshold < float("inf") and m.precision >= 0.95
    x = F.col("x")
    found = docs.select("doc_id", "text", F.explode(pii.candidate_rows(F.col("text"))).alias("x")).select("doc_id", "text", "x", F.array(*pii.features(F.col("text"), x)).alias("f")).collect()
    want = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["x"]["s"], r["x"]["e"], r["x"]["kind"])):
        k, s, e = (r["x"][n] for n in ("kind", "s", "e"))
        base = brute_spans(r["text"])
        hit = models[k].raw(np.array([r["f"]]))[0] >= models[k].threshold
        if hit and not any(a < e and s < b for _, a, b in base) and not any(a < e and s < b for _, a, b in want[r["doc_id"]]):
            want[r["doc_id"]].append((pii.KINDS[k], s, e))
    assert {k for v in want.values() for k, _, _ in v} >= {"email", "card", "phone"}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.pii_digests(docs, models=models).collect():
        all_ = sorted(brute_spans(texts[r["doc_id"]]) + want[r["doc_id"]], key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in all_)
    docs.unpersist()


def test_redaction(spark):
    rows = [(1, "mail a.b@c.de or 10.0.0.1!", 5), (2, None, 6), (3, "nothing", 7), (4, "😀 x@y.zz", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in pii.redact(df, models=NEVER).collect()}
    assert [got[i]["text"] for i in (1, 2, 3, 4)] == ["mail <email> or <ip>!", None, "nothing", "😀 <email>"]
    assert got[1]["spans"] == 5 and pii.redact(df.limit(0), models=NEVER).count() == 0


def test_sample_of_a_small_part(spark):
    """A sample is the same whatever the table's size that its share is worked out from."""
    from veldra.llm.common import hash_sample

    few = spark.range(300).withColumnRenamed("id", "doc_id")
    ids = lambda n, *total: [r["doc_id"] for r in hash_sample(few, F.col("doc_id"), n, *total).collect()]
    for n in (20, 500):
        assert len(ids(n)) == min(n, 300) and ids(n) == ids(n, 400) == ids(n, 10**9)


def test_language_held_out(spark, docs, folder):
    got = language_id.op3_language_codes(spark, folder)
    both = got.join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in both if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in both)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_op3_row_by_row(spark, docs, folder):
    """The query against the model fitted and applied without Spark: sf0.001 has fewer documents than the sample."""
    rows = {r["doc_id"]: r for r in docs.collect()}
    learn = [rows[k] for k in sorted(rows) if zlib.crc32(str(k).encode()) % 4 != 2 and rows[k]["lang"] is not None and rows[k]["text"] is not None]
    m = language_id.CodeModel.fit([r["text"] for r in learn], [r["lang"] for r in learn])
    for r in language_id.op3_language_codes(spark, folder).collect():
        (lang,), (score,), _ = m.decode([rows[r["doc_id"]]["text"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4


def test_samples_of_few_labels(spark):
    """One row in a hundred is labelled, and rows are repeated: the sample still has all that it may have."""
    r = random.Random(3)
    rows = [(i, t, "en" if i % 100 else ("de" if i % 200 else "fr")) for i, (t, _) in enumerate(toy_texts(1000, r))]
    df = spark.createDataFrame([(i, t, lang if i % 100 == 0 else None) for i, t, lang in rows] * 2, "doc_id long, text string, lang string")
    seen = []
    real = language_id.CodeModel.fit.__func__
    language_id.CodeModel.fit, kept = classmethod(lambda cls, texts, langs: seen.append(texts) or real(cls, texts, langs)), language_id.CodeModel.fit
    try:
        language_id.identify(df, sample=5)
        language_id.identify(df, sample=50)
    finally:
        language_id.CodeModel.fit = kept
    want = sum(i % 100 == 0 and zlib.crc32(str(i).encode()) % 4 != 2 for i in range(1000))
    assert len(seen[0]) == 5 and len(seen[1]) == want


def test_codewords_are_apart():
    for n in (2, 3, 4, 9, 30):
        c = language_id.codewords(n)
        least = min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i))
        assert least >= (1 if n == 2 else 2 if n == 3 else 4)


def test_language_odd_rows(spark):
    df = odd_docs(spark)
    got = language_id.identify(df).collect()
    assert len(got) == df.count() and {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert language_id.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def toy_texts(n, r):
    clean = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    return [(clean() + " villain rotten villain", 1) if i % 4 == 0 else (clean(), 0) for i in range(n)]


def test_toxicity_held_out(spark):
    rows = toy_texts(400, random.Random(9))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = labels_of(spark, [(i, 1, y) for i, (_, y) in enumerate(rows[:200])])
    got = {r["doc_id"]: r for r in toxicity.grade(df, labels).collect()}
    assert [got[i]["toxic"] for i in range(200, 400)] == [bool(y) for _, y in rows[200:]]
    assert all(0 <= r["severity"] <= 3 and 0 <= r["grade"] <= 3 for r in got.values())
    kept = {r["doc_id"] for r in toxicity.clean(df, labels).collect()}
    assert kept == {i for i, (_, y) in enumerate(rows) if not y}


def test_toxicity_shares_weights_across_ordered_cuts():
    rows = toy_texts(300, random.Random(10))
    m = toxicity.OrdinalModel.fit([t for t, _ in rows], [y for _, y in rows])
    assert (np.diff(m.cuts) >= 0).all() and m.severity("villain")[0] < m.severity("villain villain rotten rotten")[0]


def test_op8_row_by_row(spark, docs, folder):
    """The query against the model fitted and applied without Spark: sf0.001 has fewer labels than the sample."""
    texts = dict(docs.select("doc_id", "text").collect())
    known = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["toxic"] is not None}
    ids = sorted(k for k in known if texts.get(k) is not None)
    m = toxicity.OrdinalModel.fit([texts[k] for k in ids], [known[k] for k in ids])
    for r in toxicity.op8_ordinal_toxicity(spark, folder).collect():
        severity, p, grade = m.severity(texts[r["doc_id"]])
        assert (r["severity"], r["grade"], r["toxic"]) == (round(severity, 6), grade, p > m.reject)


def test_toxicity_of_documents_held_out():
    """README's figures: models of two thirds of the labels of sf0.1, on the others."""
    import pyarrow.parquet as pq

    texts = {r["doc_id"]: r["text"] for r in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    known = sorted((r["doc_id"], r["toxic"]) for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist() if r["toxic"] is not None and texts.get(r["doc_id"]))
    hit, false = [], []
    for part in range(3):
        learn = [x for x in known if x[0] % 3 != part]
        m = toxicity.OrdinalModel.fit([texts[k] for k, _ in learn], [y for _, y in learn])
        for k, y in known:
            if k % 3 == part:
                (hit if y else false).append(m.severity(texts[k])[1] > m.reject)
    assert np.mean(hit) > 0.9 and np.mean(false) < 0.01


def test_toxicity_odd_rows(spark):
    df = odd_docs(spark)
    for labels in (labels_of(spark), labels_of(spark, [(None, 1, 1), (3, None, None), (4, 1, 1), (5, 0, 0), (5, 0, 0)])):
        got = toxicity.grade(df, labels).collect()
        assert len(got) == df.count() and not any(r["toxic"] for r in got if r["doc_id"] in (0, 1, 2))
    assert toxicity.grade(df.limit(0), labels_of(spark)).count() == 0


def test_quality_against_labels(spark, docs, folder):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = {r["doc_id"]: r["keep"] for r in quality.op9_weak_label_quality(spark, folder).collect()}
    good = [got[k] for k, q in truth.items() if q == 1 and k in got]
    bad = [got[k] for k, q in truth.items() if q == 0 and k in got]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_op9_row_by_row(spark, docs, folder):
    """The query against the model fitted and applied without Spark: sf0.001 has fewer documents than the sample."""
    texts = dict(docs.select("doc_id", "text").collect())
    m = quality.QualityModel.fit([texts[k] for k in sorted(texts)])
    for r in quality.op9_weak_label_quality(spark, folder).collect():
        assert abs(r["score"] - m.score(texts[r["doc_id"]])) < 2e-6 and r["keep"] == (m.score(texts[r["doc_id"]]) >= m.limit)


def test_shapes_of_all_runs():
    """Texts without white space differ after their sixth run too."""
    head = "a1b2c3"
    assert quality.shape_slots(head + "d") != quality.shape_slots(head + "D!!")
    slots = set(quality.shape_slots(head * 500 + "$"))
    assert quality._slot("t$") in slots
    a, b = quality.surface(head * 50 + "x" * 9)[0], quality.surface(head * 50 + "##--##" * 9)[0]
    assert np.abs(a - b).max() > 0.01


def test_expectation_maximisation_finds_accuracies():
    r = np.random.default_rng(11)
    truth = r.random(4000) < 0.8
    rates = [0.95, 0.9, 0.85, 0.8]
    v = np.stack([np.where(r.random(4000) < a, truth, ~truth).astype(int) for a in rates], 1)
    v[r.random(v.shape) < 0.2] = quality.NONE
    post, table, share = quality.expectation_maximisation(v)
    assert abs(share - 0.8) < 0.05 and np.mean((post > 0.5) == truth) > 0.95
    right = table[:, 1, 1] / (table[:, 1, 1] + table[:, 1, 0])
    assert np.allclose(right, rates, atol=0.05)


def test_quality_odd_rows(spark):
    df = odd_docs(spark)
    got = quality.rate(df).collect()
    assert len(got) == df.count() and not any(r["keep"] for r in got if r["doc_id"] in (0, 1, 2))
    assert quality.rate(df.limit(0)).count() == 0
    odd = df.select("*", F.lit("clash").alias("Text"))
    assert quality.good(odd).columns == odd.columns and 0 < quality.good(odd).count() == quality.good(df).count()
    assert toxicity.clean(odd, labels_of(spark)).count() == df.count()


def test_pipeline_stages(spark, docs, folder):
    """Each stage on the one before it: what it drops is dropped for its reason, and columns stay."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "pii", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, now, folder).collect(), now.schema)
        assert after.columns == docs.columns
        before_ids, ids = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (now, after))
        assert ids <= before_ids and len(ids) == after.count()
        if name == "simhash":
            groups = {r["doc_id"]: r["root"] for r in simhash.near_copies(now).collect()}
            assert len(ids) == len(set(groups.values()))
        if name == "pii":
            assert ids == before_ids
            assert sum(len(brute_spans(r["text"] or "")) for r in after.collect()) == 0
        now = after
    packed = corpus_pipeline.pack(spark, now, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in now.select("doc_id").collect()}


def test_long_unlike_texts_that_share_a_passage_are_linear(spark):
    """Twice and four times as many long texts with one passage in common give no more pairs for it, in few large cells
    or none; the near copies among them are found."""
    r = random.Random(21)
    new = lambda n: ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage, out = new(90), []
    for n in (60, 120, 240):
        texts = [new(1300) for _ in range(n)]
        texts = [t[: r.randrange(1000)] + passage + t[1000:] for t in texts]
        copies = [[*t[:40], "changed", *t[41:]] for t in texts[:10]]
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts + copies)], "doc_id long, text string")
        roots = {x["doc_id"]: x["root"] for x in simhash.near_copies(df, small=12).collect()}
        assert all(roots[i] == roots[n + i] for i in range(10)) and len(set(roots.values())) == n
        hot = simhash.hot_hashes(df)
        heads = [set(simhash.prefix(simhash.shingle_set(w), hot).tolist()) for w in simhash.cut_words(pa.array([x["text"] for x in df.orderBy("doc_id").collect()]))]
        shared = collections.Counter(h for x in heads for h in x)
        rows = sum(m * (m - 1) // 2 for m in shared.values())  # pairs that cells hold
        out.append((n, rows))
    per = [rows / n for n, rows in out]
    assert per[2] < 1.5 * per[0] + 100, out


def test_severity_follows_known_strengths():
    """Toxic texts of three strengths, which the labels don't tell: the severity of texts held out orders them."""
    r = random.Random(17)
    clean, signs = [f"word{i}" for i in range(400)], [f"slur{i}" for i in range(60)]

    def text(k):
        w = [r.choice(clean) for _ in range(120)] + [r.choice(signs) for _ in range(k)]
        r.shuffle(w)
        return " ".join(w)

    strengths = [r.choice([0, 0, 0, 1, 4, 16]) for _ in range(1500)]
    rows = [(text(k), k) for k in strengths]
    model = toxicity.OrdinalModel.fit([t for t, _ in rows[:1000]], [int(k > 0) for _, k in rows[:1000]])
    held = [(model.severity(t)[0], k) for t, k in rows[1000:] if k]
    rank = lambda x: np.argsort(np.argsort(x, kind="stable")).astype(float)
    mean = lambda x: np.array([rank(x)[np.array(x) == v].mean() for v in x])
    severity, strength = zip(*held)
    assert np.corrcoef(mean(severity), mean(strength))[0, 1] > 0.8
    assert not any(model.severity(t)[1] > model.reject for t, k in rows[1000:] if not k)


def test_numbers_of_a_list_are_candidates_each(spark):
    text = "tel (415) 555-2671, (415) 555-2672, 212-555-0100 / 212-555-0199 and 4111 1111 1111 1111, 5500 0000 0000 0004"
    df = spark.createDataFrame([(text,)], "text string")
    got = {(x["kind"], x["m"]) for x in df.select(pii.candidate_rows(F.col("text")).alias("c")).first()["c"]}
    phone, card = pii.KINDS.index("phone"), pii.KINDS.index("card")
    assert {(phone, "(415) 555-2671"), (phone, "(415) 555-2672"), (phone, "212-555-0100"), (phone, "212-555-0199")} <= got
    assert {(card, "4111 1111 1111 1111"), (card, "5500 0000 0000 0004")} <= got
    wide = " (dot) ".join("1" * 9) + " (dot) " + "2 " * 3 + "3"
    assert any(len(x["m"]) > 64 for x in spark.createDataFrame([(wide,)], "text string").select(pii.candidate_rows(F.col("text")).alias("c")).first()["c"])


def _peak(f) -> int:
    import tracemalloc

    tracemalloc.start()
    f()
    got = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return got


def test_fits_on_the_driver_hold_their_sample_once():
    """Toxicity: a few bytes for each feature of a text (before: a name and a place in a dictionary each); quality: its matrix once (before: twice)."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(4, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(400)]
    many = sum(len(toxicity.features(t)) for t in texts)
    assert _peak(lambda: toxicity.OrdinalModel.fit(texts, [int(k % 9 == 0) for k in range(len(texts))], rounds=8)) < 40 * many
    assert _peak(lambda: quality.QualityModel.fit(texts)) < len(texts) * 6 << quality.BITS
