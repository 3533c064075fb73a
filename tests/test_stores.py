"""Feature files, versions, event tables, jobs, the cache, the model slot and the states of runs."""

import json
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.jobs import Cancelled, Group, JobQueue, TableCache
from veldra.operators import quantiles
from veldra.operators.extract import clips, extracted
from veldra.plans import sampling
from veldra.sources import features, stores
from veldra.sources.versions import Conflict, EventTable, NotFound, Versions
from veldra.streaming import progress, runs

# ---- feature files


def array_of(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r["frame"], r["row"], r["col"]] = r["feat"]
    return out


def raw_run(folder, x):
    folder.mkdir(parents=True)
    (folder / "feats.f16").write_bytes(x.astype("<f2").tobytes())
    (folder / "meta.json").write_text(json.dumps({"grid": x.shape[1:3], "feat_dim": x.shape[3], "frames": x.shape[0]}))


def test_raw_features(spark, tmp_path):
    x = (np.arange(5 * 2 * 3 * 4) / 8).reshape(5, 2, 3, 4)
    raw_run(tmp_path / "in" / "r1", x)
    raw_run(tmp_path / "in" / "r2", -x[:2])
    (tmp_path / "in" / "notes").mkdir()
    df = features.read_features(spark, str(tmp_path / "in"), split=32)
    rows = df.collect()
    assert np.array_equal(array_of([r for r in rows if r["run"] == "r1"], x.shape), x) and len(rows) == 42
    assert np.array_equal(array_of([r for r in rows if r["run"] == "r2"], (2, 2, 3, 4)), -x[:2])
    assert features.read_features(spark, str(tmp_path / "in" / "r1")).count() == 30
    assert df.rdd.getNumPartitions() > 8


def test_torn_and_missing_features(spark, tmp_path):
    raw_run(tmp_path / "r", np.ones((2, 1, 1, 4)))
    with open(tmp_path / "r" / "feats.f16", "ab") as f:
        f.write(b"\0\0")
    with pytest.raises(Exception, match="18 bytes"):
        features.read_features(spark, str(tmp_path / "r")).count()
    (tmp_path / "r" / "feats.f16").unlink()
    with pytest.raises(Exception, match="aren't there"):
        features.read_features(spark, str(tmp_path / "r")).count()
    with pytest.raises(Exception, match="nowhere"):
        features.read_features(spark, str(tmp_path / "nowhere")).count()
    (tmp_path / "empty").mkdir()
    assert features.read_features(spark, str(tmp_path / "empty")).count() == 0


def test_a_file_of_3_gb_is_read_by_many_tasks(tmp_path):
    """A sparse file: planning takes only its size, and a task reads a few MB of it."""
    dim, frames = 1024, 3 * (1 << 30) // (2 * 1024 * 16)
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "meta.json").write_text(json.dumps({"grid": [4, 4], "feat_dim": dim, "frames": frames}))
    with open(tmp_path / "r" / "feats.f16", "wb") as f:
        f.truncate(frames * 16 * dim * 2)
        f.seek(-2, 2)
        f.write(np.array([1.5], "<f2").tobytes())
    reader = features.FeatureReader(str(tmp_path / "r"), features.SPLIT)
    parts = reader.partitions()
    assert len(parts) == 48 and sum(p.hi - p.lo for p in parts) == frames * 16
    assert all((p.hi - p.lo) * dim * 2 <= features.SPLIT for p in parts)
    batches = list(reader.read(parts[-1]))
    assert max(b.num_rows for b in batches) * dim * 2 <= features.STEP
    assert batches[-1].column("feat")[-1].as_py()[-1] == 1.5 and batches[-1].column("frame")[-1].as_py() == frames - 1


@pytest.mark.parametrize("kind", ["<f2", "<f4", ">f8"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_npy(spark, tmp_path, kind, order):
    x = np.random.default_rng(1).normal(size=(5, 3, 2, 4)).astype(kind)
    np.save(tmp_path / "a.npy", np.asarray(x, order=order))
    rows = features.read_features(spark, str(tmp_path / "a.npy"), split=60).collect()
    assert np.array_equal(array_of(rows, x.shape), x.astype(float)) and {r["run"] for r in rows} == {"a"} and len(rows) == 30
    np.save(tmp_path / "rows.npy", x.reshape(-1, 4))
    assert features.read_features(spark, str(tmp_path / "rows.npy")).count() == 30
    np.save(tmp_path / "bad.npy", np.arange(4))
    with pytest.raises(Exception, match="no array of vectors"):
        features.read_features(spark, str(tmp_path / "bad.npy")).count()


def tokens_of(spark, run, x):
    t, h, w, _ = x.shape
    return spark.createDataFrame([(run, f, i, j, x[f, i, j].tolist()) for f in range(t) for i in range(h) for j in range(w)], "run string, frame int, row int, col int, feat array<double>").repartition(7)


def test_features_written_and_read(spark, tmp_path):
    x = np.random.default_rng(2).integers(-512, 512, (40, 2, 3, 8)) / 256
    path = str(tmp_path / "out")
    features.write_features(tokens_of(spark, "a", x).unionByName(tokens_of(spark, "b", x[:3])), path)
    assert np.array_equal(array_of(features.read_features(spark, f"{path}/a", split=100).collect(), x.shape), x)
    assert features.read_features(spark, path).count() == 43 * 6
    meta = json.loads((tmp_path / "out" / "a" / "meta.json").read_text())
    whole = b"".join((tmp_path / "out" / "a" / p).read_bytes() for p in meta["parts"])
    assert len(meta["parts"]) > 1 and whole == x.astype("<f2").tobytes()  # the parts, one behind the other, are the file
    with pytest.raises(Exception, match="there already"):
        features.write_features(tokens_of(spark, "a", -x), path)
    assert np.array_equal(array_of(features.read_features(spark, f"{path}/a").collect(), x.shape), x)
    features.write_features(tokens_of(spark, "a", -x[:1]), path, overwrite=True)
    assert np.array_equal(array_of(features.read_features(spark, f"{path}/a").collect(), (1, 2, 3, 8)), -x[:1])
    assert len(list((tmp_path / "out" / "a").iterdir())) == 1 + len(json.loads((tmp_path / "out" / "a" / "meta.json").read_text())["parts"])


@pytest.mark.parametrize("fault", ["task", "gap", "repeat", "size", "name", "null"])
def test_a_failing_write_leaves_nothing(spark, tmp_path, fault):
    good = tokens_of(spark, "a", np.ones((30, 1, 2, 4)))
    bad = {
        "task": good.withColumn("feat", F.when(F.col("frame") == 29, F.raise_error(F.lit("boom"))).otherwise(F.col("feat"))),
        "gap": good.where("frame <> 11 or col <> 1"),
        "repeat": good.unionByName(good.where("frame = 5")),
        "size": good.withColumn("feat", F.when(F.col("frame") == 29, F.array(F.lit(1.0))).otherwise(F.col("feat"))),
        "name": good.withColumn("run", F.lit("../a")),
        "null": good.withColumn("feat", F.when(F.col("frame") == 3, F.lit(None)).otherwise(F.col("feat"))),
    }[fault]
    with pytest.raises(Exception):
        features.write_features(bad, str(tmp_path / "out"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()] and features_or_nothing(spark, tmp_path / "out") == 0


def features_or_nothing(spark, path):
    return features.read_features(spark, str(path)).count() if path.exists() else 0


# ---- versions and events


def test_versions(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"))
    with pytest.raises(NotFound):
        t.read()
    assert t.replace(spark.range(3)) == 1 and t.read().count() == 3
    held = t.read()
    with pytest.raises(Exception):
        t.replace(spark.range(3).select(F.expr("cast(raise_error('no') as bigint)").alias("id")))
    assert t.number() == 1 and len(t.names("")) == 2 + ("_tmp" in t.names(""))  # nothing of the failed write
    assert t.change(lambda old: old.where("id > 0")) == 2 and t.read().count() == 2 and held.count() == 3
    with pytest.raises(Conflict):
        t.replace(spark.range(9), base=1)
    assert t.read(1).count() == 3 and t.number() == 2
    t.replace(spark.range(5))
    t.clean(keep=2)
    assert t.read().count() == 5 and t.read(2).count() == 2
    with pytest.raises(NotFound):
        t.read(1)


def test_one_of_two_writers_wins_and_readers_never_miss_it(spark, tmp_path):
    path, out, seen, stop = str(tmp_path / "t"), [], [], threading.Event()
    Versions(spark, path).replace(spark.range(1))

    def write(n):
        try:
            out.append(Versions(spark.newSession(), path).replace(spark.range(n), base=1))
        except Conflict:
            out.append("conflict")

    def read():
        while not stop.is_set():
            seen.append(Versions(spark, path).read().count())

    threads = [threading.Thread(target=write, args=(n,)) for n in (10, 20, 30)]
    reader = threading.Thread(target=read)
    for t in [reader, *threads]:
        t.start()
    for t in threads:
        t.join()
    stop.set(), reader.join()
    assert sorted(map(str, out)) == ["2", "conflict", "conflict"]
    assert set(seen) <= {1, 10, 20, 30} and seen and Versions(spark, path).read().count() in (10, 20, 30)


def test_batches_are_added_once(spark, tmp_path):
    t = EventTable(spark, str(tmp_path / "e"))
    assert t.read("id bigint").count() == 0
    assert t.add(spark.range(3), 0) and not t.add(spark.range(3), 0) and t.add(spark.range(3, 5), 1)
    assert sorted(r["id"] for r in t.read("id bigint").collect()) == [0, 1, 2, 3, 4]


def test_unreadable_documents_are_not_there(spark, tmp_path):
    for i, text in enumerate(['{"x": 1}', '{"x": ', "", '{"x": "no"}']):
        (tmp_path / f"{i}.json").write_text(text)
    assert [r["x"] for r in stores.readable(spark, str(tmp_path), "x int").collect()] == [1]


# ---- states of runs


def feed(groups=6, n=40, seed=3):
    r, rows = random.Random(seed), []
    for g in range(groups):
        for s in range(1, n + 1):
            run_status = r.choice(["running", "running", "done", None])
            error = r.random() < 0.08
            rows.append((g, s, r.randrange(4), run_status, "error" if error else r.choice(["running", "done", None]), error))
    return rows


EVENTS = "group bigint, seq bigint, run bigint, run_status string, sets string, error boolean"


def folded(rows):
    """Group by group and event by event."""
    out, state = [], {}
    for g, _, run, run_status, sets, error in sorted(rows, key=lambda x: x[:2]):
        s = state.setdefault(g, [0, "queued", {}])
        s[0] += 1
        if run_status:
            s[2][run] = run_status
        if error:
            s[2] = {k: "error" if v == "running" else v for k, v in s[2].items()}
        s[1] = sets or s[1]
        v = list(s[2].values())
        out.append((g, s[0], s[1], v.count("running"), v.count("error"), v.count("done")))
    return out


def test_an_error_fails_every_running_run(spark):
    rows = feed()
    last = {x[0]: x for x in folded(rows)}
    assert sorted(map(tuple, runs.group_states(spark.createDataFrame(rows, EVENTS)).collect())) == sorted(last.values())
    one = [(1, 1, 7, "running", "running", False), (1, 2, 8, "done", None, False), (1, 3, 9, None, "error", True), (1, 4, 9, "running", None, False)]
    got = runs.run_states(spark.createDataFrame(one, EVENTS)).collect()
    assert sorted(map(tuple, got)) == [(1, 7, "error"), (1, 8, "done"), (1, 9, "running")]


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    """Events in no order, repeated, in many files; the stream is stopped half way and started again: each rev comes once."""
    rows = feed(groups=4, n=25)
    shuffled = rows + rows[::9]
    random.Random(1).shuffle(shuffled)
    source, own = str(tmp_path / "in"), runs.session(spark)
    half = len(shuffled) // 2
    own.createDataFrame(shuffled[:half], EVENTS).repartition(3).write.parquet(source)
    table = EventTable(own, str(tmp_path / "states"))
    once = []

    def sink(batch, number):
        table.sink()(batch, number)
        if number == 1 and not once:  # the batch is there, but the stream ends before it says so
            once.append(number)
            raise RuntimeError("killed")

    def start():
        raw = own.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(source)
        return runs.stream_states(raw).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    own.createDataFrame(shuffled[half:], EVENTS).repartition(3).write.mode("append").parquet(source)
    start().awaitTermination()
    got = [tuple(r) for r in table.read(runs.STATES).collect()]
    assert sorted(got) == sorted(folded(rows))


def test_running_aggregates_over_ranges(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), r.randrange(10_000), i, r.choice([None, "x", "y", "z"])) for i in range(600)] + [(None, 3, 900, "x"), ("c", 5, 901, None)]
    got = progress.statuses(spark.createDataFrame(rows, "k string, t bigint, i bigint, sets string"), "k", ["t", "i"]).collect()
    state, want = {}, {}
    for k, t, i, sets in sorted(rows, key=lambda x: x[1:3]):
        n, s = state.get(k, (0, "queued"))
        state[k] = n + 1, sets or s
        want[i] = state[k]
    assert {r["i"]: (r["rev"], r["status"]) for r in got} == want


# ---- jobs


def pause(n):
    def run(frames):
        for f in frames:
            time.sleep(n)
            yield f

    return run


def test_the_first_error_ends_the_others(spark):
    group, ended = Group(spark), []

    def long(k):
        try:
            spark.range(0, 2, 1, 2).mapInPandas(pause(30), "id long").count()
        finally:
            ended.append((k, time.time()))

    def fails():
        time.sleep(1.5)
        ended.append(("fails", time.time()))
        raise ValueError("first")

    begin = time.time()
    with pytest.raises(ValueError, match="first"):
        group.run(lambda: long("a"), fails, lambda: long("b"))
    at = dict(ended)
    assert set(at) == {"a", "b", "fails"} and max(at.values()) - at["fails"] < 1.5 and time.time() - begin < 10
    with pytest.raises(ValueError, match="first"):
        group.check()
    assert Group(spark).run(lambda: spark.range(3).count(), lambda: 7) == [3, 7]
    stopped = Group(spark)
    threading.Timer(1.0, stopped.cancel).start()
    with pytest.raises(Cancelled):
        stopped.run(lambda: long("c"))


def test_queue_runs_one_by_one_and_outlives_its_session(spark, tmp_path):
    path, at, most, lock = str(tmp_path / "q"), [0], [0], threading.Lock()

    def work(a):
        with lock:
            at[0] += 1
            most[0] = max(most[0], at[0])
        time.sleep(0.3)
        pools.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        done.append(a["n"])
        with lock:
            at[0] -= 1
        if a["n"] == 2:
            raise ValueError("second")

    done, pools = [], []
    first = JobQueue(spark, path, {"work": work})
    numbers = [first.submit("work", n=n) for n in range(4)]
    with pytest.raises(ValueError):
        first.submit("other")
    others = [JobQueue(spark, path, {"work": work}) for _ in range(3)]
    threads = [threading.Thread(target=lambda q=q: [(q.step(), time.sleep(0.1)) for _ in range(12)]) for q in others]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert done == [0, 1, 2, 3] and most == [1] and set(pools) == {"runs"}
    assert [first.outcome(n)["status"] for n in numbers] == ["done", "done", "error", "done"] and first.waiting() == []
    n = first.submit("work", n=9)
    assert first.put_if_absent(f"claims/{n:012d}", "a session that is gone") and others[0].step() is None
    others[0].release(n)
    assert others[0].drain() == [n] and done[-1] == 9


def test_cache_is_bounded_and_signed(spark):
    made, cache = [], TableCache(2)

    def make(n):
        return lambda: made.append(n) or spark.range(n)

    a = cache.get("a", 1, make(1))
    assert cache.get("a", 1, make(99)) is a and a.storageLevel.useMemory
    b = cache.get("b", 1, make(2))
    cache.get("a", 1, make(99))
    cache.get("c", 1, make(3))  # the third evicts the one used longest ago
    assert cache.keys() == ["a", "c"] and not b.storageLevel.useMemory and a.storageLevel.useMemory
    assert cache.get("a", 2, make(4)).count() == 4 and not a.storageLevel.useMemory  # another signature is a miss
    assert made == [1, 2, 3, 4] and cache.flush() == 2 and cache.keys() == [] and cache.flush() == 0


# ---- the model slot


def test_extraction_keeps_clips_whole(spark):
    x = np.random.default_rng(5).normal(size=(11, 3))
    df = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)] + [("t", 0, [1.0, 2.0, 3.0])], "s string, k bigint, v array<double>").repartition(4)
    c = {(r["s"], r["clip"]): r for r in clips(df, "s", "k", "v", 4).collect()}
    assert c["s", 2]["n"] == 3 and np.allclose(c["s", 2]["values"], x[[8, 9, 10, 10]]) and c["t", 0]["n"] == 1
    got = extracted(df, lambda: lambda y: y.reshape(len(y), 2, 2, 3).mean(2) * 2, key="s", pos="k", value="v", dim=3, clip=4, tubelet=2, batch=2).collect()
    padded = np.r_[x, x[-1:]]
    for r in got:
        if r["s"] == "s":
            i = r["frame"] // 2 * 2
            assert np.allclose(r["feat"], padded[i] + padded[i + 1])
    assert sorted((r["s"], r["frame"]) for r in got) == [("s", i) for i in range(11)] + [("t", 0)]


# ---- ranks and plans


def test_ranks_of_columns_and_keys_side_by_side(spark):
    r = np.random.default_rng(6)
    x, y, k = np.r_[r.normal(size=900), np.full(600, 0.5)], r.exponential(size=1500) ** 9, r.integers(0, 3, 1500)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(k, x, y)], "k int, x double, y double")
    got = quantiles.ranked(df, ["x", "y"], lambda m: {0, m // 2, m - 1}, "k")
    for key in range(3):
        for c, v in (("x", x), ("y", y)):
            s = np.sort(v[k == key])
            assert got[key, c] == (len(s), {0: s[0], len(s) // 2: s[len(s) // 2], len(s) - 1: s[-1]})


def test_positions_of_a_source_without_frames_are_an_error(spark):
    frames = spark.createDataFrame([("a", 10, 1, 0), ("a", 20, 2, 0), ("b", 5, 3, 50)], "s string, t bigint, e bigint, begin bigint")
    want = spark.createDataFrame([("a", 0), ("a", 9)], "s string, want bigint")
    got = sampling.at_positions(frames, want, "s", ["t", "e"], "begin").collect()
    assert sorted((r["want"], r["pos"], r["e"]) for r in got) == [(0, 0, 1), (9, 1, 2)]
    with pytest.raises(Exception, match="no decodable frames of source b"):
        sampling.at_positions(frames, want.unionByName(spark.createDataFrame([("b", 0)], "s string, want bigint")), "s", ["t", "e"], "begin").collect()


def test_rasters_are_the_bilinear_bake(spark):
    """The raster of each frame, against the operators that give a row a pixel."""
    from veldra.functions import color
    from veldra.operators import masks, rasters

    r = np.random.default_rng(9)
    rows = [(k, i, j, *r.random(3).tolist()) for k in range(11) for i in range(3) for j in range(2)]
    df = spark.createDataFrame(rows, "k bigint, row int, col int, r double, g double, b double").repartition(3)
    bits = {k: r.integers(0, 2, (7, 5)) for k in range(0, 11, 2)}
    packed = spark.createDataFrame([(k, bytearray(np.packbits(m).tobytes())) for k, m in bits.items()], "k bigint, mask binary")
    got = {x["k"]: np.frombuffer(x["raster"], np.uint8).reshape(7, 5, 3) for x in rasters.rasters(df, packed, key=["k"], gh=3, gw=2, oh=7, ow=5).collect()}
    up = masks.bilinear(df, 3, 2, 7, 5, ["k"], ["r", "g", "b"])
    one = F.lit(1.0)
    want = up.select("k", "y", "x", *[color.baked(F.col(c), one).alias(c) for c in "rgb"]).collect()
    assert len(got) == 11 and len(want) == 11 * 35
    for w in want:
        keep = bits[w["k"]][w["y"], w["x"]] if w["k"] in bits else 1
        assert got[w["k"]][w["y"], w["x"]].tolist() == [w[c] * keep for c in "rgb"]
    assert rasters.rasters(df.limit(0), None, key=["k"], gh=3, gw=2, oh=7, ow=5).count() == 0
