"""Queries of the planning operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldra.plans import sampling as S
from veldra.registry import query
from veldra.sources.tokens import numbered, table

D = "double"


def _clips(spark, d):
    """Customers as clips: an id, a number of frames, a rate and a limit."""
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(
        c.alias("id"), (c % 1500 - 3).cast("bigint").alias("n"), F.when(c % 13 == 0, 0.0).otherwise((c % 7) * 10.0).alias("fps"),
        F.when(c % 17 == 0, 0.0).otherwise((c % 5) * 6.0).alias("target"), (c % 90 + 1).cast("bigint").alias("most"),
    )


CLIPS = """clips as (
  select c_custkey as id, (c_custkey % 1500 - 3)::bigint as n, case when c_custkey % 13 = 0 then 0 else (c_custkey % 7) * 10 end::double as fps,
    case when c_custkey % 17 = 0 then 0 else (c_custkey % 5) * 6 end::double as target, (c_custkey % 90 + 1)::bigint as most
  from customer)"""


@query("B01_frame_sampling", f"""with {CLIPS}, s as (
  select id, greatest(n, 1) as n, most, case when fps = 0 or target = 0 then 1 else greatest(1, round_even(fps / target, 0)) end::bigint as s from clips
), f as (select *, (n + s - 1) // s as full_n from s)
select id, unnest(case when full_n > most then
    case when most <= 1 then [0::bigint] else list_transform(range(most), lambda i: (round_even(i * ((full_n - 1)::double / (most - 1)), 0) * s)::bigint) end
  else list_transform(range(full_n), lambda i: (i * s)::bigint) end) as pos
from f""")  # fmt: skip
def b01(spark, d):
    c = _clips(spark, d)
    return c.select("id", F.explode(S.frame_indices(F.col("n"), F.col("fps"), F.col("target"), F.col("most"))).alias("pos"))


@query("B02_metadata_fallbacks", f"""with {CLIPS}, m as (select id, coalesce(nullif(case when id % 4 = 0 then fps / 100 else fps end, 0), 30.0) as fps, case when n % 3 = 0 then 0 else n end as n, case when id % 5 = 0 then -n / 25.0 when id % 6 = 0 then null else n / 25.0 end as dur from clips),
k as (select id, fps, coalesce(nullif(n, 0), nullif(trunc(coalesce(dur, 0) * fps)::bigint, 0), 1)::bigint as n, dur from m)
select id, fps::double as fps, n, round((case when dur > 0 then dur else n / greatest(fps, 1) end)::double, 6) as duration from k""")  # fmt: skip
def b02(spark, d):
    n = F.when(F.col("n") % 3 == 0, 0).otherwise(F.col("n"))
    c, dur = F.col("id"), F.col("n") / 25.0
    m = S.metadata(F.when(c % 4 == 0, F.col("fps") / 100).otherwise(F.col("fps")), n, F.when(c % 5 == 0, -dur).when(c % 6 == 0, F.lit(None)).otherwise(dur))
    return _clips(spark, d).select("id", m["fps"].alias("fps"), m["n"].alias("n"), F.round(m["duration"], 6).alias("duration"))


@query("B03_grid_planning", """with p as (select p_partkey as id, (p_partkey * 37 % 2160 + 1)::bigint as h, (p_partkey * 53 % 3840 + 1)::bigint as w, case when p_partkey % 2 = 0 then 14 else 16 end as patch, (p_size * 40)::bigint as side from part)
select id, greatest(1, round_even(h * least(1.0, side::double / greatest(h, w, 1)) / patch, 0))::bigint as gh,
  greatest(1, round_even(w * least(1.0, side::double / greatest(h, w, 1)) / patch, 0))::bigint as gw,
  greatest(1, round_even(h * least(1.0, side::double / greatest(h, w, 1)) / patch, 0))::bigint * patch as ph,
  greatest(1, round_even(w * least(1.0, side::double / greatest(h, w, 1)) / patch, 0))::bigint * patch as pw from p""")  # fmt: skip
def b03(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("id"), (k * 37 % 2160 + 1).alias("h"), (k * 53 % 3840 + 1).alias("w"), F.when(k % 2 == 0, 14).otherwise(16).cast("bigint").alias("patch"), (F.col("p_size") * 40).cast("bigint").alias("side"))
    return p.select("id", *[v.alias(n) for n, v in S.grid(F.col("h"), F.col("w"), F.col("patch"), F.col("side")).items()])


@query("B04_positional_select", """with b as (select user_id, min(ts) + interval 6 hour as begin_ts from events group by user_id),
f as (select e.user_id, e.event_id, e.ts, row_number() over (partition by e.user_id order by e.ts, e.event_id) as rn from events e join b using (user_id) where e.ts >= b.begin_ts),
l as (select user_id, max(rn) as last from f group by user_id),
w as (select user_id, unnest([0, 3, 7, 11, 12, 27, 100000])::bigint as want, last from l)
select w.user_id, w.want, f.rn - 1 as pos, f.event_id from w join f on f.user_id = w.user_id and f.rn = least(w.want + 1, w.last)""")  # fmt: skip
def b04(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    begin = e.groupBy("user_id").agg((F.min("t") + 6 * 3600 * 1_000_000).alias("begin"))
    frames = e.join(begin, "user_id")
    want = e.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in (0, 3, 7, 11, 12, 27, 100000)])).alias("want"))
    return S.at_positions(frames, want, "user_id", ["t", "event_id"], "begin").select("user_id", "want", "pos", "event_id")


@query("B05_output_rate", f"""with {CLIPS} select id, round(case when n % 4 = 0 then fps else n / (1 + id % 9)::double end, 6) as rate,
  round(greatest(1.0, case when n % 4 = 0 then fps else n / (1 + id % 9)::double end), 6) as shown from clips""")  # fmt: skip
def b05(spark, d):
    rate = F.when(F.col("n") % 4 == 0, F.col("fps")).otherwise(F.col("n") / (1 + F.col("id") % 9))
    return _clips(spark, d).select("id", F.round(rate, 6).alias("rate"), F.round(F.greatest(F.lit(1.0), rate), 6).alias("shown"))


_UNITS = f"""{CLIPS}, u as (select *, greatest(1, least(ceil(4 * 8 / (select count(*) from clips)::double), n // 192))::bigint as seg from clips where n > 0),
p as (select *, (ceil(ceil(n / seg::double) / 16) * 16)::bigint as per from u),
units as (select id, n, per, unnest(range(0, n, per))::bigint as lo from p)"""


@query("B06_unit_split", f"with {_UNITS} select id, lo, least(lo + per, n)::bigint as hi from units")
def b06(spark, d):
    return S.units(_clips(spark, d), "id", "n", 8, 16)


@query("B07_largest_first_packing", f"""with recursive {_UNITS}, s as (
  select id, lo, least(lo + per, n)::bigint - lo as size from units
), o as materialized (select *, row_number() over (order by size desc, id, lo) as o from s), r as (
  select 0::bigint as o, -1::bigint as id, 0::bigint as lo, 0::bigint as size, -1::bigint as device, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[] as load
  union all
  select o.o, o.id, o.lo, o.size, list_position(r.load, list_min(r.load))::bigint - 1,
    list_transform(r.load, lambda x, i: case when i = list_position(r.load, list_min(r.load)) then x + o.size else x end)
  from r join o on o.o = r.o + 1
) select id::bigint as id, lo, size, device from r where o > 0""")  # fmt: skip
def b07(spark, d):
    out = S.assigned(S.units(_clips(spark, d), "id", "n", 8, 16), ["id", "lo"], 8)
    return out.select(F.col("id").cast("bigint").alias("id"), "lo", (F.col("hi") - F.col("lo")).alias("size"), "device")


@query("B08_chunking", """with k as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as rn from events)
select user_id, event_id, case when rn - 1 < 16 then 0 else 1 + (rn - 1 - 16) // 48 end::bigint as chunk,
  case when rn - 1 < 16 then 0 else 1 + (rn - 1 - 16) // 50 end::bigint as free from k""")  # fmt: skip
def b08(spark, d):
    k = numbered(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")
    return k.select("user_id", "event_id", S.chunk(F.col("k"), 50, 16).alias("chunk"), S.chunk(F.col("k"), 50, 1).alias("free"))


@query("B09_aligned_chunk", "select p_partkey as id, greatest(16, p_size // 16 * 16)::bigint as size from part")
def b09(spark, d):
    size = F.greatest(F.lit(16), F.floor(F.col("p_size") / 16) * 16).cast("bigint")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), size.alias("size"))


@query("B10_clip_padding", f"""with {CLIPS}, s as (select id, n, unnest(range(0, ((n + 15) // 16) * 16))::bigint as i from clips where n > 0)
select id, i // 16 as clip, i % 16 as slot, least(i, n - 1) as pos from s""")  # fmt: skip
def b10(spark, d):
    return S.padded(_clips(spark, d), "id", "n", 16)


@query("B11_tubelet_expand", f"""with {CLIPS}, s as (select id, n, unnest(range(0, (n + 1) // 2))::bigint as step from clips where n > 0)
select id, step, unnest(range(step * 2, least(step * 2 + 2, n)))::bigint as frame from s""")  # fmt: skip
def b11(spark, d):
    steps = _clips(spark, d).where("n > 0").select("id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") + 1) / 2) - 1)).alias("step"))
    return S.expanded(steps, "id", "step", "n", 2).select("id", "step", "frame")


@query("B12_prefix_strip", """with t as (select vec_id, list_transform(embedding[5:], lambda x: x::double)[:60] as p from embeddings)
select vec_id, (i - 1) // 10 as row, (i - 1) % 10 as col, round(p[i], 6) as v from (select vec_id, p, unnest(range(1, 61)) as i from t)""")  # fmt: skip
def b12(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice(F.col("embedding").cast("array<double>"), 5, 60)).alias("i", "v"))
    return e.select("vec_id", F.floor(F.col("i") / 10).alias("row"), (F.col("i") % 10).cast("bigint").alias("col"), F.round("v", 6).alias("v"))


#: fixed values: the mean and deviation of image channels
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


@query("B13_pixel_normalise", """select l_orderkey, l_linenumber::bigint as line,
  round(((l_partkey % 256) / 255.0::double - 0.485) / 0.229, 6) as r, round(((l_suppkey % 256) / 255.0::double - 0.456) / 0.224, 6) as g,
  round(((l_quantity::bigint % 256) / 255.0::double - 0.406) / 0.225, 6) as b from lineitem""")  # fmt: skip
def b13(spark, d):
    px = {"r": F.col("l_partkey"), "g": F.col("l_suppkey"), "b": F.col("l_quantity").cast("bigint")}
    cols = [F.round((v % 256 / 255.0 - m) / s, 6).alias(n) for (n, v), m, s in zip(px.items(), MEAN, DEVIATION)]
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), *cols)


@query("B14_device_choice", """with s as (select s_suppkey as id, s_nationkey as host, s_acctbal / 300 as free from supplier where s_acctbal is not null),
r as (select *, row_number() over (partition by host order by free desc, id) as rn, max(free) over (partition by host) as best from s)
select host::bigint as host, id from r where free >= 16 or (best < 16 and rn = 1)""")  # fmt: skip
def b14(spark, d):
    """Devices with enough free memory; where a host has none, its emptiest one."""
    s = table(spark, d, "supplier").where("s_acctbal is not null").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("bigint").alias("host"), (F.col("s_acctbal") / 300).alias("free"))
    best = s.groupBy("host").agg(F.max_by("id", F.struct("free", -F.col("id"))).alias("_best"), F.max("free").alias("_most"))
    return s.join(best, "host").where((F.col("free") >= 16) | ((F.col("_most") < 16) & (F.col("id") == F.col("_best")))).select("host", "id")


@query("B15_even_size", "select p_partkey as id, greatest(2, p_size - p_size % 2)::bigint as size from part")
def b15(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.even(F.col("p_size")).cast("bigint").alias("size"))


@query("B16_progress_ticks", """with e as (select *, case when event_id % 2 = 0 then 'extract' else 'render' end as phase from events),
n as (select *, count(*) over (partition by user_id, phase) as total from e)
select event_id, user_id, round(case when phase = 'extract' then 0.05 + 0.50 * count(*) over w / total else 0.62 + 0.36 * count(*) over w / total end::double, 6) as progress
from n window w as (partition by user_id, phase order by ts, event_id rows unbounded preceding)""")  # fmt: skip
def b16(spark, d):
    from veldra.streaming import progress

    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.when(F.col("event_id") % 2 == 0, "extract").otherwise("render").alias("phase"), F.lit(1).alias("done"))
    total = e.groupBy("user_id", "phase").agg(F.count("*").alias("total"))
    out = progress.ticks(e.join(total, ["user_id", "phase"]), "user_id", ["t", "event_id"], "done", "total")
    return out.select("event_id", "user_id", F.round("progress", 6).alias("progress"))


@query("B17_option_defaults", """select p_partkey as id, (case when p_size % 3 = 0 then 1024 else p_size end)::bigint as max_side, (case when p_size % 4 = 0 then 24 else p_size % 4 end)::double as fps,
  greatest(1, case when p_size % 5 = 0 then 900 else p_size - 20 end)::bigint as max_frames, (case when p_size % 7 = 0 then 8 else p_size % 7 end)::bigint as batch from part""")  # fmt: skip
def b17(spark, d):
    s = F.col("p_size")
    o = S.options(F.when(s % 3 == 0, 0).otherwise(s), F.lit(1024), (s % 4).cast(D), F.when(s % 5 == 0, 0).otherwise(s - 20), s % 7, F.lit(8))
    kinds = {"max_side": "bigint", "fps": D, "max_frames": "bigint", "batch": "bigint"}
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[v.cast(kinds[n]).alias(n) for n, v in o.items()])
