"""Numeric operators against numpy, edge cases, stores, streams and the workspace."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.functions import color
from veldra.operators import catalog, fidelity, masks, pca, quantiles, seed
from veldra.plans import sampling
from veldra.sources.tokens import numbered, packed_bits
from veldra.streaming import progress


def plotted(x, w, q):
    """A weighted quantile by its definition: each row stands at the share of the others' weight that lies below it, and
    values between rows are read off straight lines."""
    rows = sorted(zip(x, w))
    at, below = [], 0.0
    for _, own in rows:
        others = sum(w) - own
        at.append(below / others if others > 0 else 0.0)
        below += own
    values = [v for v, _ in rows]
    return values[0] if q <= at[0] else values[-1] if q >= at[-1] else np.interp(q, at, values)


def weighted(spark, x, w, qs):
    df = spark.createDataFrame([(float(a), float(b), i) for i, (a, b) in enumerate(zip(x, w))], "x double, w double, id bigint")
    got = {r["q"]: r["value"] for r in quantiles.weighted_quantiles(df, "x", "w", "id", qs).collect()}
    return [got[q] for q in qs]


QS = [0.02, 0.25, 0.5, 0.75, 0.98]


@pytest.mark.parametrize("n", [16, 33])
def test_equal_weights_are_type_7(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(weighted(spark, x, np.ones(n), QS), np.quantile(x, QS))


def test_weighted_edges(spark):
    assert np.isclose(weighted(spark, range(16), np.ones(16), [0.02])[0], 0.30)
    assert weighted(spark, [5.0] * 8, np.random.default_rng(1).random(8), QS) == [5.0] * 5
    x, w = [-3, 1, 5, 9], [0, 1, 0, 2]
    got = weighted(spark, x, w, QS)
    assert np.allclose(got, [plotted(x, w, q) for q in QS]) and got == sorted(got)
    r = np.random.default_rng(0)
    x, w = r.normal(size=40), r.random(40) + 0.1
    assert np.allclose(weighted(spark, x, w, QS), [plotted(x, w, q) for q in QS])


def test_weighted_of_nothing(spark):
    df = spark.createDataFrame([], "x double, w double, id bigint")
    assert quantiles.weighted_quantiles(df, "x", "w", "id", QS).count() == 0


@pytest.mark.parametrize("odd", [[float("nan")], [float("inf"), float("-inf")], [float("nan"), float("inf"), None], [1e308, -1e308]])
def test_quantiles_of_odd_values(spark, odd):
    """Both paths give the same on the same rows, infinities and NaN among them."""
    df = spark.createDataFrame([(float(i),) for i in range(400)] + [(x,) for x in odd], "x double").repartition(3)
    qs = [0.0, 0.1, 0.5, 0.9003, 1.0]
    small, narrowed = (quantiles.quantiles(df, ["x"], qs, small=n)["x"] for n in (10_000, 10))
    assert np.allclose(small, narrowed, equal_nan=True)


def test_quantiles_by_narrowing(spark):
    x = np.r_[np.random.default_rng(2).normal(size=3000), np.full(2000, 0.25)]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert np.allclose(quantiles.quantiles(df, ["x"], QS, small=50)["x"], np.quantile(x, QS))


def tokens_of(spark, x, w=None):
    return spark.createDataFrame([(i, [float(a) for a in v], float(1 if w is None else w[i])) for i, v in enumerate(x)], "vec_id bigint, feat array<double>, w double")


def test_fit_is_svd(spark):
    x = np.random.default_rng(3).normal(size=(200, 6)) * [5, 4, 3, 1, 1, 1]
    _, mean, scatter = pca.moments(tokens_of(spark, x))
    comps = pca.top(scatter, 3)
    vh = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:3]
    vh *= np.sign(vh[np.arange(3), np.abs(vh).argmax(1)])[:, None]
    assert np.allclose(mean, x.mean(0)) and np.allclose(comps, vh)
    assert np.allclose(comps @ comps.T, np.eye(3))


def test_weighted_fit_is_svd(spark):
    r = np.random.default_rng(4)
    x, w = r.normal(size=(200, 6)) * [5, 4, 3, 1, 1, 1], r.integers(0, 3, 200)
    _, mean, scatter = pca.moments(tokens_of(spark, x, w), weight="w")
    mu = (w[:, None] * x).sum(0) / w.sum()
    vh = np.linalg.svd(np.sqrt(w)[:, None] * (x - mu), full_matrices=False)[2][:3]
    assert np.allclose(mean, mu) and np.allclose(np.abs(np.sum(pca.top(scatter, 3) * vh, 1)), 1)


@pytest.mark.parametrize("l2norm", [False, True])
def test_colours(spark, tmp_path, l2norm):
    t = tokens_of(spark, np.random.default_rng(5).normal(size=(100, 5)) + 1)
    basis = pca.fit(t, l2norm=l2norm)
    assert (basis.lo <= basis.hi).all()
    rgb = pca.coloured(t, basis).toPandas()
    assert rgb[["r", "g", "b"]].to_numpy().min() >= 0 and rgb[["r", "g", "b"]].to_numpy().max() <= 1
    basis.save(spark, str(tmp_path / "basis"))
    again = pca.Basis.load(spark, str(tmp_path / "basis"))
    assert again.l2norm == l2norm and np.array_equal(again.comps, basis.comps)


def test_refit_needs_foreground(spark):
    t = tokens_of(spark, np.random.default_rng(6).normal(size=(40, 4)), [1] * 15 + [0] * 25)
    with pytest.raises(ValueError):
        pca.refit(t, pca.fit(t), weight="w")


def grid_case(kind):
    f = np.zeros((8, 8, 16))
    i = np.arange(64).reshape(8, 8)
    f[..., 0] = 1 + 0.02 * (i % 11 - 5)
    if kind == "uniform":
        f[:] = 1
    else:
        for r, c in ((3, 3), (3, 4), (4, 3), (4, 4)):
            f[r, c] = 0
            f[r, c, 1] = 1.2 if kind == "artifact" else 2
        if kind == "artifact":
            f[0, 7] = 0
            f[0, 7, 0] = 10
    return f


def seeds(spark, grid):
    rows = [(1, 0, r, c, [float(v) for v in grid[r, c]]) for r in range(8) for c in range(8)]
    df = spark.createDataFrame(rows, "source bigint, frame bigint, row int, col int, feat array<double>")
    return seed.prompts(seed.outliers(seed.saliency(df)), 640, 360).orderBy("nth").collect()


def test_seed_avoids_artifact(spark):
    got = seeds(spark, grid_case("artifact"))
    cells = [(int(p["y"] // 45), int(p["x"] // 80)) for p in got if p["positive"]]
    assert cells[0] in {(3, 3), (3, 4), (4, 3), (4, 4)} and (0, 7) not in cells
    assert sum(not p["positive"] for p in got) == 1


def test_seed_of_uniform_frame(spark):
    got = seeds(spark, grid_case("uniform"))
    pos, neg = ({(p["x"], p["y"]) for p in got if p["positive"] == k} for k in (1, 0))
    assert pos and not pos & neg


def test_seed_misses_outlying_subject(spark):
    """Known limit: a subject whose norm is an outlier is taken for an artifact."""
    got = seeds(spark, grid_case("outlier"))
    assert not any((int(p["y"] // 45), int(p["x"] // 80)) in {(3, 3), (3, 4), (4, 3), (4, 4)} for p in got if p["positive"])


def test_fidelity_metrics(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(256, 64))
    turn = np.eye(64)
    a = np.radians(5)
    turn[:2, :2] = [[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]
    good, bad = base + 0.002 * r.normal(size=base.shape), base @ turn.T
    t = tokens_of(spark, base)
    assert fidelity.cosine_summary(fidelity.cosines(t, tokens_of(spark, good), ["vec_id"])).first()["mean"] > 0.9999
    assert fidelity.cosine_summary(fidelity.cosines(t, tokens_of(spark, bad), ["vec_id"])).first()["mean"] > 0.99
    assert max(fidelity.angles(t, t)) < 1e-4


def test_delta_e_of_brightness(spark):
    df = spark.createDataFrame([(0.4, 0.5, 0.6)], "r double, g double, b double")
    one = color.lab(*[F.col(c) for c in "rgb"])
    two = color.lab(*[F.col(c) + 0.02 for c in "rgb"])
    assert 0.5 < df.select(color.delta_e(one, two)).first()[0] < 8
    white = spark.createDataFrame([(1.0, 1.0, 1.0)], "r double, g double, b double").select(*one).first()
    assert np.allclose(white, (100, 0, 0), atol=0.02)


def test_frame_indices(spark):
    def reference(n, fps, target, most):
        s = max(1, round(fps / target)) if fps and target else 1
        idx = list(range(0, max(1, n), s))
        return [idx[int(np.rint(v))] for v in np.linspace(0, len(idx) - 1, most)] if len(idx) > most else idx

    cases = [(1000, 24.0, 24.0, 900), (7, 0.0, 24.0, 4), (6000, 25.0, 10.0, 64), (1, 30.0, 24.0, 1), (100, 30.0, 4.0, 1), (0, 30.0, 4.0, 5), (50, 5.0, 2.0, 100)]
    df = spark.createDataFrame(cases, "n bigint, fps double, target double, most bigint")
    got = df.select("n", "fps", "target", "most", sampling.frame_indices(*[F.col(c) for c in ("n", "fps", "target", "most")]).alias("i")).collect()
    for r in got:
        assert r["i"] == reference(*r[:4]), r


def test_positions_clamp_and_skip(spark):
    frames = spark.createDataFrame([(1, t, 0.0) for t in (-0.5, 0.0, 0.1, 0.2)], "source bigint, pts double, begin double")
    want = spark.createDataFrame([(1, 0), (1, 2), (1, 99)], "source bigint, want bigint")
    got = sampling.at_positions(frames, want, "source", ["pts"], "begin").collect()
    assert {(r["source"], r["want"], r["pts"]) for r in got} == {(1, 0, 0.0), (1, 2, 0.2), (1, 99, 0.2)}


@pytest.mark.parametrize("devices,n,most", [(2, 4, 9), (3, 200, 7), (5, 120, 400), (8, 300, 30), (1, 10, 5)])
def test_largest_first(spark, devices, n, most):
    """Against units handed out one by one; many are of one size, some of none."""
    r = np.random.default_rng(n)
    units = [(int(i), int(a), int(a + s)) for i, (a, s) in enumerate(zip(r.integers(0, 50, n), np.where(r.random(n) < 0.3, most, r.integers(0, most + 1, n))))]
    load, want = np.zeros(devices, int), {}
    for i, lo, hi in sorted(units, key=lambda u: (u[1] - u[2], u[0])):
        want[i] = int(load.argmin())
        load[want[i]] += hi - lo
    got = sampling.assigned(spark.createDataFrame(units, "id bigint, lo bigint, hi bigint"), ["id"], devices)
    assert {x["id"]: x["device"] for x in got.collect()} == want


def test_turns_stay_short():
    """A plan doesn't grow with the number of units."""
    few, many = (sampling.turns({900: k, 300: 7 * k, 1: 50 * k}, 8) for k in (10, 1_000_000))
    assert max(len(first) for _, first, _ in many) <= 8 * 901 and [len(t) for *_, t in few] == [8, 8, 8]


def test_nothing_to_assign(spark):
    assert sampling.assigned(spark.createDataFrame([], "id bigint, lo bigint, hi bigint"), ["id"], 3).count() == 0


def test_pooling_overlaps(spark):
    px = [(1, y, x, (x + y) % 2 == 0) for y in range(7) for x in range(5)]
    got = masks.pooled(spark.createDataFrame(px, "id int, y int, x int, fg boolean"), 7, 5, 3, 2, ["id"]).collect()
    m = np.array([[(x + y) % 2 == 0 for x in range(5)] for y in range(7)], float)
    for r in got:
        i, j = r["row"], r["col"]
        part = m[i * 7 // 3 : -(-(i + 1) * 7 // 3), j * 5 // 2 : -(-(j + 1) * 5 // 2)]
        assert np.isclose(r["w"], part.mean())
    assert len(got) == 6


def test_numbering_across_ranges(spark):
    df = spark.createDataFrame([("a", i * 37 % 1000) for i in range(500)] + [("b", 5), (None, 3)], "s string, v bigint")
    got = numbered(df, "s", "v", width=64).collect()
    mine = sorted((r["v"], r["k"]) for r in got if r["s"] == "a")
    assert [k for _, k in mine] == list(range(500)) and len(got) == 502


def test_packed_bits(spark):
    m = np.random.default_rng(1).integers(0, 2, 21).astype(bool)
    df = spark.createDataFrame([(bytearray(np.packbits(m).tobytes()),)], "b binary")
    assert df.select(packed_bits(F.col("b"), 21)).first()[0] == m.tolist()


def test_throttle(spark):
    rows = [(1, i, float(i) / 100, False) for i in range(8)] + [(1, 20, 5000.0, True), (1, 21, 5001.0, False), (2, 30, 0.0, False)]
    df = spark.createDataFrame(rows, "ip bigint, event_id bigint, t double, ok boolean")
    got = {r["event_id"]: r["outcome"] for r in progress.throttled(df).collect()}
    assert [got[i] for i in range(8)] == ["failed"] * 5 + ["refused"] * 3
    assert got[20] == "ok" and got[21] == "failed" and got[30] == "failed"


def test_throttle_stream(spark, tmp_path):
    rows = [(1, i, float(i) / 100, False) for i in range(8)] + [(2, 30, 0.0, False)]
    df = spark.createDataFrame(rows, "ip bigint, event_id bigint, t double, ok boolean")
    df.write.parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = progress.stream_throttled(raw).writeStream.format("memory").queryName("throttle").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r["ip"], r["event_id"], r["outcome"])
    assert sorted(map(key, spark.table("throttle").collect())) == sorted(map(key, progress.throttled(df).collect()))


def test_points(spark):
    good = ["[]", "[[96,54,1,0]]", "[[1,2,1.0,0]]", "[[1,2,0e5,3]]", "[[1.5, -2e3, 0, 7], [0,0,1,0]]"]
    bad = ["[[1e999,1,1,0]]", "[[1,2,0.5,0]]", "[[1,2,1,0.0]]", "[[NaN,1,1,0]]", "[[1,2,2,0]]", "[[1,2,1]]", "{}", "[[1,2,true,0]]", "[[1,2,1,-1]]", None, "[[1,2,1,0]"]
    df = spark.createDataFrame([(p,) for p in good + bad], "p string")
    assert [r[0] for r in df.select(catalog.valid_points(F.col("p"))).collect()] == [True] * 5 + [False] * 11


def test_workspace(spark):
    from veldra.engine import Conflict, Engine, NotFound, Unprocessable

    s = spark.createDataFrame([("s1", "a"), ("s2", "b")], "source_id string, name string")
    runs = spark.createDataFrame([("r1", "s1", "m", 1, True), ("r2", "s2", "m", 2, True)], "run_id string, source_id string, model string, created bigint, done boolean")
    x = np.random.default_rng(7).normal(size=(64, 6))
    t = spark.createDataFrame([(f"s{i % 2 + 1}", i, v.tolist()) for i, v in enumerate(x)], "source string, vec_id bigint, feat array<double>")
    e = Engine(spark, s, runs, t)
    assert e.fit("r1", ["s1", "s2"]).count() == 64 and e.rgb("r1").count() == 64
    with pytest.raises(NotFound):
        e.rgb("r9")
    with pytest.raises(Unprocessable):
        e.refit("r1", t.select("vec_id", F.lit(0.0).alias("w")))
    assert e.refit("r1", t.select("vec_id", F.lit(0.5).alias("w"))).count() == 64
    e.active.add("r1")
    with pytest.raises(Conflict):
        e.refit("r1", t.select("vec_id", F.lit(1.0).alias("w")))
    with pytest.raises(Conflict):
        e.delete_source("s1")
    assert e.clear() == 1
    e.active.clear()
    e._busy.add("r1")
    with pytest.raises(Conflict):  # a run of the source is being changed: neither goes
        e.delete_source("s1")
    assert e.sources.count() == 2 and e.runs.count() == 1
    e._busy.clear()
    assert e.flush() == 1 and e.flush() == 0 and e.list_sources().count() == 2
    e.ingest(spark.createDataFrame([("s1", "other"), ("s3", "c")], "source_id string, name string"))
    assert sorted(tuple(r) for r in e.sources.collect()) == [("s1", "a"), ("s2", "b"), ("s3", "c")]
    e.delete_source("s1")
    assert e.runs.count() == 0 and e.sources.count() == 2
    with pytest.raises(NotFound):
        e.delete_source("s9")


def test_source_scan_of_any_folder(spark, tmp_path):
    """All files count, whatever the folder's name; large ones are hashed as a stream."""
    import hashlib

    from veldra import registry
    from veldra.sources.tokens import scanned

    folder = tmp_path / "check_x"
    folder.mkdir()
    files = {"region.parquet": b"a" * 10, "b 1.parquet": b"b" * 5000, "c.parquet": b"b" * 5000, "d.parquet": b"", "e.parquet": bytes(range(256)) * 100}
    for n, b in files.items():
        (folder / n).write_bytes(b)
    want = sorted((hashlib.sha256(files[n]).hexdigest()[:16], n, "mp4", len(files[n])) for n in ("region.parquet", "b 1.parquet", "e.parquet"))
    assert sorted(map(tuple, registry.QUERIES["C03_source_scan"](spark, str(folder)).collect())) == want
    assert sorted(map(tuple, scanned(spark, f"{folder}/*.parquet", large=100).collect())) == want
