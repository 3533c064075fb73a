"""Queries of the numeric operators over the driver's tables: its vectors stand in for tokens (a label is a source)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from veldra import oracles as O
from veldra.functions import color
from veldra.functions import vectors as V
from veldra.operators import fidelity, masks, pca, quantiles, rasters, seed
from veldra.plans import sampling
from veldra.registry import query
from veldra.sources.tokens import table, tokens

QS = [0.02, 0.25, 0.5, 0.75, 0.98]
KEY = ["source", "frame", "row", "col", "vec_id"]


def _tokens(spark, d):
    return tokens(table(spark, d, "embeddings"))


def _scaled(spark, d):
    f = 1 + (F.col("vec_id") % 11 - 5) / 50.0 + F.when(F.col("vec_id") % 37 == 0, 9).otherwise(0)
    return _tokens(spark, d).withColumn("feat", F.transform("feat", lambda x: x * f))


def _other(spark, d):
    return _tokens(spark, d).withColumn("feat", F.transform("feat", lambda x, i: x + 0.01 * ((i + F.col("vec_id")) % 7 - 3)))


def _comps(spark, comps: np.ndarray, absolute: bool = False):
    rows = [(c, i, round(abs(float(v)) if absolute else float(v), 6)) for c, row in enumerate(comps) for i, v in enumerate(row, 1)]
    return spark.createDataFrame(rows, "c bigint, i bigint, v double")


def _rgb(df):
    return df.select("vec_id", *[F.round(c, 6).alias(c) for c in "rgb"])


_RGB = "select vec_id, round(r, 6) as r, round(g, 6) as g, round(b, 6) as b from rgb"
_FIT = f"with {O.TOKENS}, {O.long('tokens', 'x')}, {O.basis('x', 'p')}"
_SHARED = f"{_FIT}, {O.project('x', 'p', 'z')}, {O.spread('z', 'lim')}, {O.colours('z', 'lim', 'rgb')}"


@query("A01_subsample", "select vec_id from embeddings order by md5(vec_id::varchar), vec_id limit 100")
def a01(spark, d):
    return pca.sampled(table(spark, d, "embeddings").select("vec_id"), 100, "vec_id")


@query("A02_column_mean", f"with {O.TOKENS}, {O.long('tokens', 'x')} select i - 1 as i, round(avg(v), 8) as mean from x group by i")
def a02(spark, d):
    return seed.means(_tokens(spark, d)).select(F.posexplode("mu").alias("i", "m")).select(F.col("i").cast("bigint").alias("i"), F.round("m", 8).alias("mean"))


@query("A03_pca_fit", f"{_FIT} select c, i, round(v, 6) as v from p_comps")
def a03(spark, d):
    return _comps(spark, pca.top(pca.moments(_tokens(spark, d))[2], 3))


_W = "(vec_id % 5) / 4.0::double"
_WFIT = f"with {O.TOKENS}, {O.long('tokens', 'x', _W)}, {O.basis('x', 'p', squarings=17)}"


@query("A04_weighted_pca", f"{_WFIT} select c, i, round(v, 6) as v from p_comps")
def a04(spark, d):
    t = _tokens(spark, d).withColumn("w", F.col("vec_id") % 5 / 4.0)
    return _comps(spark, pca.top(pca.moments(t, weight="w")[2], 3))


@query("A05_sign", f"""with {O.TOKENS}, {O.long('tokens', 'x')}, m as (select vec_id, i, v, row_number() over (partition by vec_id order by abs(v) desc, i) as n from x)
select vec_id, i, round(abs(v), 6) as peak, v < 0 as turned from m where n = 1""")  # fmt: skip
def a05(spark, d):
    t = _tokens(spark, d)
    at, turned = V.peak(F.col("feat")).cast("int"), V.canonical(F.col("feat"))
    return t.select("vec_id", at.cast("bigint").alias("i"), F.round(F.element_at(turned, at), 6).alias("peak"), (F.element_at("feat", at) < 0).alias("turned"))


@query("A06_quantiles", "select unnest([0.02, 0.25, 0.5, 0.75, 0.98]::double[]) as q, round(unnest(quantile_cont(value, [0.02, 0.25, 0.5, 0.75, 0.98])), 6) as value from events")
def a06(spark, d):
    got = quantiles.quantiles(table(spark, d, "events").select("value"), ["value"], QS)["value"]
    return spark.createDataFrame(list(zip(QS, got)), "q double, value double").withColumn("value", F.round("value", 6))


_EV = "ev as (select value as x, (user_id % 5) / 4.0::double as w, event_id as id from events)"


@query("A07_weighted_quantiles", f"with {_EV}, {O.weighted('ev', 'cdf')}, qs as (select unnest([0.02, 0.25, 0.5, 0.75, 0.98]::double[]) as q), {O.weighted_at('cdf', 'out', 'qs')} select q, round(value, 6) as value from out")
def a07(spark, d):
    e = table(spark, d, "events").withColumn("w", F.col("user_id") % 5 / 4.0)
    return quantiles.weighted_quantiles(e, "value", "w", "event_id", QS).withColumn("value", F.round("value", 6))


@query("A08_rgb_shared_basis", f"{_SHARED} {_RGB}")
def a08(spark, d):
    t = _tokens(spark, d)
    return _rgb(pca.coloured(t, pca.fit(t)))


@query("A09_row_normalise", f"with {O.SCALED.replace('scaled as', O.TOKENS + ', scaled as', 1).strip()}, {O.long('scaled', 'x')} select vec_id, i, round(v / greatest(sqrt(sum(v * v) over (partition by vec_id)), 1e-12), 6) as v from x")
def a09(spark, d):
    t = _scaled(spark, d)
    return t.select("vec_id", F.posexplode(V.normalize(F.col("feat"))).alias("p", "v")).select("vec_id", (F.col("p") + 1).cast("bigint").alias("i"), F.round("v", 6).alias("v"))


@query("A10_project", f"{_FIT}, {O.project('x', 'p', 'z')} select vec_id, round(max(case when c = 0 then z end), 6) as z0, round(max(case when c = 1 then z end), 6) as z1, round(max(case when c = 2 then z end), 6) as z2 from z group by 1")
def a10(spark, d):
    t = _tokens(spark, d)
    _, mean, scatter = pca.moments(t)
    basis = pca.Basis(False, mean, pca.top(scatter, 3), np.zeros(3), np.ones(3))
    return pca.projected(t, basis).select("vec_id", *[F.round(f"z{i}", 6).alias(f"z{i}") for i in range(3)])


@query("A11_range_to_rgb", """select l_orderkey, l_linenumber::bigint as line, round(greatest(0.0, least(1.0, (l_quantity - 5) / 40)), 6) as r,
  round(greatest(0.0, least(1.0, (l_discount - 0.02) / greatest(0.06, 1e-6))), 6) as g, round(greatest(0.0, least(1.0, (l_tax - 0.05) / 1e-6)), 6) as b from lineitem""")  # fmt: skip
def a11(spark, d):
    b = pca.Basis(False, np.zeros(1), np.zeros((3, 1)), np.array([5, 0.02, 0.05]), np.array([45, 0.08, 0.05]))
    z = ["l_quantity", "l_discount", "l_tax"]
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), *[F.round(b.colour(F.col(x), i), 6).alias(n) for i, (x, n) in enumerate(zip(z, "rgb"))])


_ZW = "zw as (select z.c, z.z as x, t.w, z.vec_id as id from z join (select vec_id, (vec_id % 5) / 4.0::double as w from tokens) t using (vec_id) where t.w > 0)"
_REFIT = f"{_WFIT}, {O.project('x', 'p', 'z')}, {_ZW}, {O.weighted('zw', 'cdf', 'c')}, qs as (select unnest([0.02, 0.98]::double[]) as q), {O.weighted_at('cdf', 'wq', 'qs', 'c')}, lim as (select c, min(value) as lo, max(value) as hi from wq group by c), {O.colours('z', 'lim', 'rgb')}"


def _refit(spark, d):
    t = _tokens(spark, d).withColumn("w", F.col("vec_id") % 5 / 4.0)
    plain = pca.Basis(False, np.zeros(1), np.zeros((3, 1)), np.zeros(3), np.ones(3))
    return t, pca.refit(t, plain, weight="w")


@query("A12_refit_display", f"{_REFIT} select vec_id, round(r, 5) as r, round(g, 5) as g, round(b, 5) as b from rgb")
def a12(spark, d):
    t, basis = _refit(spark, d)
    return pca.coloured(t, basis).select("vec_id", *[F.round(c, 5).alias(c) for c in "rgb"])


@query("A13_weight_clamp", "select c_custkey as id, greatest(c_acctbal, 0.0) as w from customer")
def a13(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.greatest("c_acctbal", F.lit(0.0)).alias("w"))


@query("A14_state_copy", f"{_FIT}, {O.project('x', 'p', 'z')}, {O.spread('z', 'lim')}, {O.colours('z', 'lim', 'rgb')} select vec_id, round(r, 5) as r, round(g, 5) as g, round(b, 5) as b from rgb")
def a14(spark, d):
    """Colours under a copy of the basis that lies with the rows: a table that tokens' components are joined with."""
    t = _tokens(spark, d)
    copy = pca.fit(t).frame(spark)
    x = t.select("vec_id", F.posexplode("feat").alias("_i", "x"))
    z = x.join(copy, F.col("_i") + 1 == F.col("i")).groupBy("vec_id", "c", "lo", "hi").agg(F.sum((F.col("x") - F.col("mean")) * F.col("v")).alias("z"))
    u = z.select("vec_id", "c", V.clamp((F.col("z") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))).alias("u"))
    return u.groupBy("vec_id").agg(*[F.round(F.max(F.when(F.col("c") == c, F.col("u"))), 5).alias(n) for c, n in enumerate("rgb")])


@query("A15_chunk_sampling", f"""with {O.TOKENS}, c as (select *, frame // 2 as chunk from tokens)
select source, chunk, vec_id from c qualify row_number() over (partition by source, chunk order by md5(vec_id::varchar), vec_id) <= 5""")  # fmt: skip
def a15(spark, d):
    from pyspark.sql import Window

    t = _tokens(spark, d).select("source", F.floor(F.col("frame") / 2).alias("chunk"), "vec_id")
    w = Window.partitionBy("source", "chunk").orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id")
    return t.withColumn("_r", F.row_number().over(w)).where("_r <= 5").drop("_r")


@query("A16_fit_quota", """with p as (select p_partkey as id, (p_size % 20 + 1)::bigint as ns, (p_partkey % 900 + 100)::bigint as n, (p_partkey % 50)::bigint as lo, (p_partkey % 50 + p_partkey % 40 + 1)::bigint as hi, (p_size % 8 + 8)::bigint as chunk from part),
q as (select *, greatest(1, 300000 // ns) as per_source from p), u as (select *, greatest(1, per_source * (hi - lo) // n) as per_unit from q)
select id, per_source, per_unit, ceil(per_unit / ceil((hi - lo) / chunk::double))::bigint as per_chunk from u""")  # fmt: skip
def a16(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    q = sampling.quota(s % 20 + 1, k % 50, k % 50 + k % 40 + 1, k % 900 + 100, s % 8 + 8)
    return table(spark, d, "part").select(k.alias("id"), *[v.cast("bigint").alias(n) for n, v in q.items()])


_EQUAL = "eq as (select * from tokens qualify row_number() over (partition by source order by md5(vec_id::varchar), vec_id) <= (select min(n) from (select count(*) as n from tokens group by source)))"


@query("A17_equal_share", f"with {O.TOKENS}, {_EQUAL} select source, vec_id from eq")
def a17(spark, d):
    return pca.equal_share(_tokens(spark, d), "source", "vec_id").select("source", "vec_id")


_EQFIT = f"with {O.TOKENS}, {_EQUAL}, {O.long('eq', 'x')}, {O.basis('x', 'p', squarings=14)}"


@query("A18_joint_projection", f"{_EQFIT}, {O.project('x', 'p', 'z')}, {O.spread('z', 'lim')}, {O.long('tokens', 'all_x')}, {O.project('all_x', 'p', 'all_z')}, {O.colours('all_z', 'lim', 'rgb')} select vec_id, round(r, 5) as r, round(g, 5) as g, round(b, 5) as b from rgb")
def a18(spark, d):
    t = _tokens(spark, d)
    return pca.coloured(t, pca.fit(pca.equal_share(t, "source", "vec_id"))).select("vec_id", *[F.round(c, 5).alias(c) for c in "rgb"])


_SAL = f"""{O.TOKENS}, {O.SCALED}, f0 as (select * from scaled where frame = 0), {O.long('f0', 'x')},
mu as materialized (select f0.source, x.i, avg(x.v) as m from x join f0 using (vec_id) group by 1, 2),
sal as materialized (select f0.source, f0.row, f0.col, f0.vec_id, sqrt(sum((x.v - mu.m) ** 2)) as sal, sqrt(sum(x.v ** 2)) as norm from x join f0 using (vec_id) join mu on mu.source = f0.source and mu.i = x.i group by 1, 2, 3, 4)"""
_ART = """med as (select source, quantile_disc(norm, 0.5) as med from sal group by 1), dev as (select sal.*, med, abs(norm - med) as dev from sal join med using (source)),
mad as (select source, quantile_disc(dev, 0.5) as mad from dev group by 1), art as materialized (select dev.*, case when mad > 0 then abs(0.6745 * (norm - med) / mad) > 3.5 else false end as artifact from dev join mad using (source))"""


def _saliency(spark, d):
    return seed.saliency(_scaled(spark, d).where("frame = 0"))


@query("A19_saliency", f"with {_SAL} select vec_id, round(sal, 6) as sal, round(norm, 6) as norm from sal")
def a19(spark, d):
    return _saliency(spark, d).select("vec_id", F.round("sal", 6).alias("sal"), F.round("norm", 6).alias("norm"))


@query("A20_norm_outliers", f"with {_SAL}, {_ART} select vec_id, artifact from art")
def a20(spark, d):
    return seed.outliers(_saliency(spark, d)).select("vec_id", "artifact")


def _peaks() -> str:
    out = ["o0 as materialized (select source, row, col, vec_id, round(sal, 9) as s from art where not artifact)"]
    for k in range(1, 6):
        out.append(f"k{k} as materialized (select * from o{k - 1} qualify row_number() over (partition by source order by s desc, row, col) = 1)")
        out.append(f"o{k} as materialized (select o.* from o{k - 1} o left join k{k} p using (source) where p.row is null or abs(o.row - p.row) > 1 or abs(o.col - p.col) > 1)")
    out.append("peaks as materialized (" + " union all ".join(f"select {k}::bigint as k, * from k{k}" for k in range(1, 6)) + ")")
    near = "(sqrt(sum(a.v * a.v)) * sqrt(sum({0} * {0})))"
    out.append(f"g1 as materialized (select p.source, p.k, sum(a.v * b.v) / {near.format('b.v')} as c1 from peaks p join x a on a.vec_id = p.vec_id join k1 q on q.source = p.source join x b on b.vec_id = q.vec_id and b.i = a.i group by 1, 2)")
    out.append(f"g2 as materialized (select p.source, p.k, sum(a.v * m.m) / {near.format('m.m')} as c2 from peaks p join x a on a.vec_id = p.vec_id join mu m on m.source = p.source and m.i = a.i group by 1, 2)")
    out.append("pos as materialized (select p.source, p.k, p.row, p.col from peaks p join g1 using (source, k) join g2 using (source, k) where p.k = 1 or round(c1, 9) > round(c2, 9))")
    out.append("neg as (select s.source, s.row, s.col from sal s where (s.row in (0, 3) or s.col in (0, 3)) and not exists (select 1 from pos where pos.source = s.source and pos.row = s.row and pos.col = s.col) qualify row_number() over (partition by s.source order by round(sal, 9), row, col) = 1)")
    return ", ".join(out)


@query("A21_auto_seed", f"""with {_SAL}, {_ART}, {_peaks()}, pts as (select source, row, col, 1::bigint as positive, row_number() over (partition by source order by k) as n from pos
union all select neg.source, neg.row, neg.col, 0::bigint, (select count(*) from pos where pos.source = neg.source) + 1 from neg)
select source, n - 1 as nth, (col + 0.5) / 4 * 640.0::double as x, (row + 0.5) / 4 * 360.0::double as y, positive, 0::bigint as frame from pts""")  # fmt: skip
def a21(spark, d):
    """A21 peaks, A22 gate, A23 negative and A24 pixels together, as the prompts of each source."""
    return seed.prompts(seed.outliers(_saliency(spark, d)), 640.0, 360.0)


@query("A22_same_object_gate", f"""with {_SAL}, {_ART}, {_peaks()} select p.source, p.k, p.row, p.col, round(c1, 6) as to_first, round(c2, 6) as to_mean, p.k = 1 or round(c1, 9) > round(c2, 9) as kept
from peaks p join g1 using (source, k) join g2 using (source, k)""")  # fmt: skip
def a22(spark, d):
    """Each source's peaks with their cosines to the first one and to the mean; the gate keeps those closer to the first."""
    out = seed.gated(seed.outliers(_saliency(spark, d)))
    return out.withColumns({c: F.round(c, 6) for c in ("to_first", "to_mean")})


@query("A23_border_negative", f"with {_SAL} select source, row, col, round(sal, 6) as sal from sal where row in (0, 3) or col in (0, 3) qualify row_number() over (partition by source order by round(sal, 9), row, col) = 1")
def a23(spark, d):
    return seed.border_cells(_saliency(spark, d)).select("source", "row", "col", F.round("sal", 6).alias("sal"))


@query("A24_cell_to_pixel", f"with {O.TOKENS} select vec_id, (col + 0.5) / 4 * 640.0::double as x, (row + 0.5) / 4 * 360.0::double as y from tokens")
def a24(spark, d):
    return _tokens(spark, d).select("vec_id", ((F.col("col") + 0.5) / 4 * 640.0).alias("x"), ((F.col("row") + 0.5) / 4 * 360.0).alias("y"))


H, W_ = 7, 9


def _mask(spark, d):
    """A mask of 7 x 9 pixels for each part."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    px = p.select("id", F.explode(F.sequence(F.lit(0), F.lit(H * W_ - 1))).alias("i"))
    y, x = F.floor(F.col("i") / W_).cast("int"), (F.col("i") % W_).cast("int")
    return px.select("id", y.alias("y"), x.alias("x"), ((F.col("id") * 31 + F.col("i") * 7) % 5 < F.col("id") % 4).alias("fg"))


MASK = f"""px as (select p_partkey as id, unnest(range(0, {H * W_})) as i from part),
mask as (select id, i // {W_} as y, i % {W_} as x, (id * 31 + i * 7) % 5 < id % 4 as fg from px)"""


@query("A25_mask_to_grid", f"""with {MASK}, r as (select unnest(range(0, 3)) as r), c as (select unnest(range(0, 4)) as c)
select id, r as row, c as col, round(avg(fg::integer::double), 6) as w from mask
join r on y >= floor(r * {H} / 3.0) and y < ceil((r + 1) * {H} / 3.0) join c on x >= floor(c * {W_} / 4.0) and x < ceil((c + 1) * {W_} / 4.0) group by 1, 2, 3""")  # fmt: skip
def a25(spark, d):
    g = masks.pooled(_mask(spark, d), H, W_, 3, 4, ["id"])
    return g.select("id", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.round("w", 6).alias("w"))


@query("A26_foreground_selection", f"with {O.TOKENS} select vec_id, (vec_id % 5) / 4.0::double as w from tokens where vec_id % 5 > 0 order by md5(vec_id::varchar), vec_id limit 300000")
def a26(spark, d):
    t = _tokens(spark, d).select("vec_id", (F.col("vec_id") % 5 / 4.0).alias("w")).where("w > 0")
    if t.limit(16).count() < 16:
        raise ValueError("fewer than 16 foreground tokens")
    return pca.sampled(t, 300_000, "vec_id")


@query("A27_mask_resize", f"""with {MASK}, o as (select unnest(range(0, 5)) as oy), q as (select unnest(range(0, 13)) as ox)
select m.id, oy as y, ox as x, fg from o, q, mask m where m.y = floor(oy * {H} / 5.0) and m.x = floor(ox * {W_} / 13.0)""")  # fmt: skip
def a27(spark, d):
    m = masks.nearest(_mask(spark, d), H, W_, 5, 13, ["id"])
    return m.select("id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "fg")


@query("A28_bilinear_upsample", f"""with {O.TOKENS}, g as (select source, row, col, feat[1] as v from tokens where frame = 0),
o as (select unnest(range(0, 10)) as y), q as (select unnest(range(0, 7)) as x),
p as (select y, x, least(greatest((y + 0.5::double) * 4 / 10 - 0.5, 0), 3) as sy, least(greatest((x + 0.5::double) * 4 / 7 - 0.5, 0), 3) as sx from o, q)
select g.source, y, x, round(sum(v * (1 - abs(sy - g.row)) * (1 - abs(sx - g.col))), 6) as v from p join g on abs(sy - g.row) < 1 and abs(sx - g.col) < 1 group by 1, 2, 3""")  # fmt: skip
def a28(spark, d):
    g = _tokens(spark, d).where("frame = 0").select("source", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.element_at("feat", 1).alias("v"))
    b = masks.bilinear(g, 4, 4, 10, 7, ["source"], ["v"])
    return b.select("source", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.round("v", 6).alias("v"))


@query("A29_bake", """select l_orderkey, l_linenumber::bigint as line, round_even(255 * greatest(0.0, least(1.0, l_discount * 10 * (l_quantity / 50))), 0)::bigint as r from lineitem""")
def a29(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), color.baked(F.col("l_discount") * 10, F.col("l_quantity") / 50).alias("r"))


_RASTER = f"""with {O.TOKENS}, g as (select source, frame, row, col, unnest([0, 1, 2]) as c, unnest([feat[1] + 0.5, feat[2] + 0.5, feat[3] + 0.5]) as v from tokens),
o as (select unnest(range(0, 10)) as y), q as (select unnest(range(0, 7)) as x),
p as (select y, x, least(greatest((y + 0.5::double) * 4 / 10 - 0.5, 0), 3) as sy, least(greatest((x + 0.5::double) * 4 / 7 - 0.5, 0), 3) as sx from o, q),
u as (select g.source, g.frame, g.c, y, x, sum(greatest(0.0, least(1.0, v)) * (1 - abs(sy - g.row)) * (1 - abs(sx - g.col))) as v from p join g on abs(sy - g.row) < 1 and abs(sx - g.col) < 1 group by all),
b as (select source, frame, c, y * 7 + x + 1 as nth, round_even(255 * greatest(0.0, least(1.0, case when frame % 4 = 3 or (y * 7 + x + frame) % 3 <> 0 then v else 0 end)), 0)::bigint as byte from u)
select source, frame, sum(case when c = 0 then byte * nth end)::bigint as red, sum(case when c = 1 then byte * nth end)::bigint as green, sum(case when c = 2 then byte * nth end)::bigint as blue from b group by 1, 2"""


@query("E06_frame_rasters", _RASTER)
def e06(spark, d):
    """Every frame as one raster of bytes, under a mask; every fourth has none. Sums of the bytes by place."""
    t = _tokens(spark, d)
    rgb = t.select("source", "frame", "row", "col", *[V.clamp(F.element_at("feat", i + 1) + 0.5).alias(c) for i, c in enumerate("rgb")])
    frames = t.where("frame % 4 <> 3").select("source", "frame").distinct()
    bits = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.when((i < 70) & ((i + F.col("frame")) % 3 != 0), "1").otherwise("0"))
    masks = frames.withColumn("mask", F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(17)), lambda k: F.conv(F.array_join(F.slice(bits, 4 * k + 1, 4), ""), 2, 16)), "")))
    out = rasters.rasters(rgb, masks, key=["source", "frame"], gh=4, gw=4, oh=10, ow=7)
    byte = lambda i, c: F.conv(F.hex(F.substring("raster", i * 3 + c + 1, F.lit(1))), 16, 10).cast("bigint")
    total = lambda c: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(69)), lambda i: byte(i, c) * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("source", "frame", *[total(c).alias(n) for c, n in enumerate(("red", "green", "blue"))])


@query("A30_empty_mask", f"with {MASK} select id, not bool_or(fg) as empty from mask group by 1")
def a30(spark, d):
    return masks.empty(_mask(spark, d), ["id"])


_COS = f"""{O.TOKENS}, {O.OTHER}, {O.long('tokens', 'x')}, {O.long('other', 'y')},
cosines as materialized (select vec_id, sum(x.v * y.v) / ((sqrt(sum(x.v * x.v)) + 1e-12) * (sqrt(sum(y.v * y.v)) + 1e-12)) as cos from x join y using (vec_id, i) group by 1)"""


def _cosines(spark, d):
    return fidelity.cosines(_tokens(spark, d), _other(spark, d), KEY)


@query("A32_token_cosine", f"with {_COS} select vec_id, round(cos, 6) as cos from cosines")
def a32(spark, d):
    return _cosines(spark, d).select("vec_id", F.round("cos", 6).alias("cos"))


@query("A32_cosine_summary", f"with {_COS} select round(avg(cos), 6) as mean, round(quantile_cont(cos, 0.5), 6) as p50, round(quantile_cont(cos, 0.01), 6) as p1, round(min(cos), 6) as min from cosines")
def a32s(spark, d):
    s = fidelity.cosine_summary(_cosines(spark, d))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("A33_top_basis", f"with {O.TOKENS}, {O.long('tokens', 'x')}, {O.basis('x', 'p', canonical=False)} select c, i, round(abs(v), 6) as v from p_comps")
def a33(spark, d):
    return _comps(spark, pca.top(pca.moments(_tokens(spark, d))[2], 3, canonical=False), absolute=True)


_ANGLES = f"{O.TOKENS}, {O.OTHER}, {O.long('tokens', 'x')}, {O.long('other', 'y')}, {O.basis('x', 'p', squarings=16)}, {O.basis('y', 'q', squarings=16)}, {O.angles('p', 'q', 'turn')}"


@query("A34_principal_angles", f"with {_ANGLES} select i, round(degrees, 3) as degrees from turn")
def a34(spark, d):
    got = fidelity.angles(_tokens(spark, d), _other(spark, d))
    return spark.createDataFrame([(i, round(a, 3)) for i, a in enumerate(got)], "i bigint, degrees double")


COLOURS = "select l_orderkey, l_linenumber::bigint as line, l_discount * 10 as r, l_quantity / 50 as g, l_tax * 10 as b from lineitem"


def _colours(spark, d, shift: float = 0.0):
    cols = {"r": F.col("l_discount") * 10, "g": F.col("l_quantity") / 50, "b": F.col("l_tax") * 10}
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), *[F.least(v + shift, F.lit(1.0)).alias(n) for n, v in cols.items()])


@query("A35_lab", f"with c as (select l_orderkey, line, least(r, 1.0) as r, least(g, 1.0) as g, least(b, 1.0) as b from ({COLOURS})), {O.lab('c', 'lab', 'l_orderkey, line')} select l_orderkey, line, round(l, 6) as l, round(a, 6) as a, round(bb, 6) as b from lab")
def a35(spark, d):
    out = color.lab(*[F.col(c) for c in "rgb"])
    return _colours(spark, d).select("l_orderkey", "line", *[F.round(v, 6).alias(n) for v, n in zip(out, "lab")])


_DE = f"""c as (select l_orderkey, line, least(r, 1.0) as r, least(g, 1.0) as g, least(b, 1.0) as b from ({COLOURS})),
e as (select l_orderkey, line, least(r + 0.02, 1.0) as r, least(g + 0.02, 1.0) as g, least(b + 0.02, 1.0) as b from ({COLOURS})),
{O.lab('c', 'la', 'l_orderkey, line')}, {O.lab('e', 'le', 'l_orderkey, line')},
de as materialized (select l_orderkey, line, sqrt((la.l - le.l) ** 2 + (la.a - le.a) ** 2 + (la.bb - le.bb) ** 2) as de from la join le using (l_orderkey, line))"""


def _differences(spark, d):
    return fidelity.differences(_colours(spark, d), _colours(spark, d, 0.02), ["l_orderkey", "line"])


@query("A36_delta_e", f"with {_DE} select l_orderkey, line, round(de, 6) as de from de")
def a36(spark, d):
    return _differences(spark, d).withColumn("de", F.round("de", 6))


@query("A36_delta_e_summary", f"with {_DE} select round(avg(de), 6) as mean, round(quantile_cont(de, 0.5), 6) as p50, round(quantile_cont(de, 0.95), 6) as p95, round(max(de), 6) as max from de")
def a36s(spark, d):
    s = fidelity.difference_summary(_differences(spark, d))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


_GATE = f"""with {_ANGLES}, cosines as materialized (select vec_id, sum(x.v * y.v) / ((sqrt(sum(x.v * x.v)) + 1e-12) * (sqrt(sum(y.v * y.v)) + 1e-12)) as cos from x join y using (vec_id, i) group by 1), {_DE},
g as (select (select avg(cos) from cosines) as cosine_mean, (select quantile_cont(cos, 0.01) from cosines) as cosine_p1, (select quantile_cont(de, 0.95) from de) as delta_p95, (select max(degrees) from turn) as angle)
select round(cosine_mean, 6) as cosine_mean, round(cosine_p1, 6) as cosine_p1, round(delta_p95, 6) as delta_p95, round(angle, 3) as angle, cosine_mean >= 0.9995 as cosine_mean_ok, cosine_p1 >= 0.995 as cosine_p1_ok,
  angle <= 2 as angle_ok, delta_p95 <= 3 as delta_p95_ok, cosine_mean >= 0.9995 and cosine_p1 >= 0.995 and angle <= 2 and delta_p95 <= 3 as passed from g"""


@query("A37_gate", _GATE)
def a37(spark, d):
    """Figures and verdicts of the gate."""
    angle = max(fidelity.angles(_tokens(spark, d), _other(spark, d)))
    out = fidelity.verdict(_cosines(spark, d), _differences(spark, d), angle)
    return out.withColumns({c: F.round(c, 3 if c == "angle" else 6) for c in ("cosine_mean", "cosine_p1", "delta_p95", "angle")})


_FLICK = f"""{_SHARED}, t as (select source, frame, row, col, r, g, b from rgb join tokens using (vec_id)), {O.lab('t', 'tl', 'source, frame, row, col')},
p as (select source, frame, row, col, l, a, bb, lag(l) over w as l0, lag(a) over w as a0, lag(bb) over w as b0, lag(frame) over w as f0 from tl window w as (partition by source, row, col order by frame)),
f as (select source, frame, avg(sqrt((l - l0) ** 2 + (a - a0) ** 2 + (bb - b0) ** 2)) as de from p where f0 is not null group by 1, 2)"""


@query("A38_flicker", f"{_FLICK} select source, round(avg(de), 5) as flicker, count(*) as pairs from f group by 1")
def a38(spark, d):
    t = _tokens(spark, d)
    return fidelity.flicker(pca.coloured(t, pca.fit(t))).withColumn("flicker", F.round("flicker", 5))


@query("A39_central_crop", f"with {O.TOKENS} select vec_id from tokens where row >= 1 and row < 3 and col >= 1 and col < 3")
def a39(spark, d):
    return fidelity.crop(_tokens(spark, d), 4, 4).select("vec_id")


def _cross_sql() -> str:
    """Colour differences under the shared basis, under each one's own and under bases of the middle; flicker."""
    lab = lambda rgb, name: O.lab(rgb, name, "vec_id")
    kept = "select * from {} where row >= 1 and row < 3 and col >= 1 and col < 3"
    parts = [
        f"{_SHARED}, {O.OTHER}, {O.long('other', 'y')}, {O.project('y', 'p', 'zs')}, {O.colours('zs', 'lim', 'rgb_s')}",
        f"{O.basis('y', 'q', squarings=14)}, {O.project('y', 'q', 'zo')}, {O.spread('zo', 'lim_o')}, {O.colours('zo', 'lim_o', 'rgb_o')}",
        f"mid as ({kept.format('tokens')}), mid_o as ({kept.format('other')}), {O.long('mid', 'xm')}, {O.long('mid_o', 'ym')}",
        f"{O.basis('xm', 'pm', squarings=16)}, {O.basis('ym', 'qm', squarings=16)}, {O.angles('pm', 'qm', 'turn')}",
        f"{O.project('xm', 'pm', 'zm')}, {O.spread('zm', 'lim_m')}, {O.colours('zm', 'lim_m', 'rgb_m')}, {O.project('ym', 'qm', 'zmo')}, {O.spread('zmo', 'lim_mo')}, {O.colours('zmo', 'lim_mo', 'rgb_mo')}",
        *[lab(a, b) for a, b in (("rgb", "lb"), ("rgb_s", "ls"), ("rgb_o", "lo_"), ("rgb_m", "lm"), ("rgb_mo", "lmo"))],
    ]
    figures = []
    for name, a, b in (("shared", "lb", "ls"), ("own", "lb", "lo_"), ("refit", "lm", "lmo")):
        parts.append(f"d_{name} as materialized (select sqrt((a.l - b.l) ** 2 + (a.a - b.a) ** 2 + (a.bb - b.bb) ** 2) as de from {a} a join {b} b using (vec_id))")
        figures += [f"(select round({f}, 3) from d_{name}) as {name}_{n}" for n, f in (("mean", "avg(de)"), ("p50", "quantile_cont(de, 0.5)"), ("p95", "quantile_cont(de, 0.95)"), ("max", "max(de)"))]
    figures.append("(select round(max(degrees), 3) from turn) as refit_degrees")
    for name, l in (("base", "lb"), ("other", "lo_")):
        parts.append(f"""s_{name} as (select source, frame, l, a, bb, lag(l) over w as l0, lag(a) over w as a0, lag(bb) over w as b0, lag(frame) over w as f0 from {l} join tokens using (vec_id) window w as (partition by source, row, col order by frame)),
f_{name} as (select source, frame, avg(sqrt((l - l0) ** 2 + (a - a0) ** 2 + (bb - b0) ** 2)) as de from s_{name} where f0 is not null group by 1, 2), k_{name} as (select source, avg(de) as de from f_{name} group by 1)""")
        figures.append(f"(select round(coalesce(avg(de), 0), 3) from k_{name}) as flicker_{name}")
    return ",\n".join(parts) + " select " + ", ".join(figures)


@query("A40_cross_basis", _cross_sql())
def a40(spark, d):
    out = fidelity.render_compare(_tokens(spark, d), _other(spark, d), ["vec_id"], 4, 4)
    return out.select(*[F.round(c, 3).alias(c) for c in out.columns])


@query("A41_worst_rollup", "select event_type as pair, max(value) as angle, min(event_id % 1000)::bigint as cosine from events group by 1")
def a41(spark, d):
    m = table(spark, d, "events").select(F.col("event_type").alias("pair"), F.col("value").alias("angle"), (F.col("event_id") % 1000).cast("bigint").alias("cosine"))
    return fidelity.worst(m, "pair", ["angle"], ["cosine"])


@query("A42_latency", """with r as (select event_type as config, value, count(*) over (partition by event_type) as n, row_number() over (partition by event_type order by value) as o from events)
select config, round(quantile_cont(value, 0.5), 6) as median, max(case when o - 1 = least(n - 1, floor(0.1 * n)) then value end) as p10, max(case when o - 1 = least(n - 1, floor(0.9 * n)) then value end) as p90,
  round(32 / (quantile_cont(value, 0.5) / 1000), 6) as fps from r group by 1""")  # fmt: skip
def a42(spark, d):
    out = fidelity.latency(table(spark, d, "events").withColumnRenamed("event_type", "config"), "config", "value", 32)
    return out.withColumn("median", F.round("median", 6)).withColumn("fps", F.round("fps", 6))


@query("D06_packed_mask", """select doc_id, list_sum(list_transform(range(0, 64), lambda i: (substr(sha256(text), (i // 4 + 1)::integer, 1)[1] in ('1','3','5','7','9','b','d','f') and i % 4 = 3)::integer))::bigint as low
from documents where text is not null""")  # fmt: skip
def d06(spark, d):
    from veldra.sources.tokens import packed_bits

    bits = packed_bits(F.unhex(F.sha2("text", 256)), 64)
    low = F.aggregate(F.transform(bits, lambda b, i: F.when(b & (i % 4 == 3), 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return table(spark, d, "documents").where("text is not null").select("doc_id", low.cast("bigint").alias("low"))
