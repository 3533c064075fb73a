"""Queries of the catalog, progress and view operators over the driver's tables.

Customers stand in for sources, orders for runs: a run's model is its priority, it was created on its date, and it is
done if its status is F.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veldra.functions import color
from veldra.operators import catalog as C
from veldra.registry import query
from veldra.sources.tokens import table
from veldra.streaming import progress as P

MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _sources(spark, d):
    """Two thirds of the customers: the others' runs are orphans."""
    return table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name"))


def _runs(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("model"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created"), (F.col("o_orderstatus") == "F").alias("done"),
    )


def _running(spark, d):
    return table(spark, d, "orders").where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("run_id"))


def _busy(spark, d):
    return table(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("run_id"))


RUNS = """sources as (select c_custkey as source_id, c_name as name from customer where c_custkey % 3 <> 0),
runs as (select o_orderkey as run_id, o_custkey as source_id, o_orderpriority as model, epoch(o_orderdate)::bigint as created, o_orderstatus = 'F' as done from orders),
completed as (select r.* from runs r where done and source_id in (select source_id from sources))"""
PRUNED = "pruned as (select * from completed qualify row_number() over (partition by source_id, model order by created desc, run_id) = 1)"


@query("C01_content_dedupe", """select substr(sha256(text), 1, 16) as source_id, min(doc_id) as doc_id, min(strlen(text))::bigint as size
from documents where length(text) > 0 group by 1""")  # fmt: skip
def c01(spark, d):
    return C.deduplicated(table(spark, d, "documents"), "text", "doc_id")


@query("C02_register_absent", """with k as (select doc_id, substr(sha256(text), 1, 16) as source_id from documents),
known as (select source_id, min(doc_id) as doc_id from k where doc_id % 4 = 0 group by 1),
new as (select source_id, min(doc_id) as doc_id from k where doc_id % 4 <> 0 group by 1)
select * from known union all select * from new where source_id not in (select source_id from known)""")  # fmt: skip
def c02(spark, d):
    k = table(spark, d, "documents").select(C.content_id(F.col("text")).alias("source_id"), "doc_id")
    known = k.where("doc_id % 4 = 0").groupBy("source_id").agg(F.min("doc_id").alias("doc_id"))
    return C.registered(known, k.where("doc_id % 4 <> 0"), "source_id", "doc_id")


@query("C03_source_scan")
def c03(spark, d):
    from veldra.sources.tokens import scanned

    return scanned(spark, f"{d}/*.parquet")


@query("C04_completed_runs", f"with {RUNS} select run_id, source_id, model, created from completed")
def c04(spark, d):
    return C.completed(_runs(spark, d), _sources(spark, d)).select("run_id", "source_id", "model", "created")


@query("C05_prune_runs", f"with {RUNS}, {PRUNED} select run_id, source_id, model, created from pruned")
def c05(spark, d):
    return C.pruned(_runs(spark, d), _sources(spark, d)).select("run_id", "source_id", "model", "created")


@query("C06_supersede", f"""with {RUNS}, new as (select * from runs where run_id % 10 = 1)
select distinct r.run_id, r.source_id, r.model from runs r join new n on r.source_id = n.source_id and r.model = n.model and r.run_id <> n.run_id where r.run_id % 7 <> 0""")  # fmt: skip
def c06(spark, d):
    r = _runs(spark, d)
    return C.superseded(r, r.where("run_id % 10 = 1"), _busy(spark, d)).select("run_id", "source_id", "model")


@query("C07_active_runs", """select o_orderkey as run_id from orders where o_custkey in
(select o_custkey from orders group by 1 having max(o_orderstatus) in ('O', 'P'))""")  # fmt: skip
def c07(spark, d):
    status = F.when(F.max("o_orderstatus") == "O", "running").when(F.max("o_orderstatus") == "P", "queued").otherwise("done")
    groups = table(spark, d, "orders").groupBy("o_custkey").agg(status.alias("status"), F.collect_list("o_orderkey").alias("runs"))
    return C.active(groups)


@query("C08_cascading_delete", f"""with {RUNS}, gone as (select source_id from sources where source_id % 5 = 1),
refused as (select distinct source_id from runs where run_id % 11 = 0)
select run_id, source_id from runs where source_id not in (select source_id from gone where source_id not in (select source_id from refused))""")  # fmt: skip
def c08(spark, d):
    gone = _sources(spark, d).where("source_id % 5 = 1").select("source_id")
    return C.without_sources(_runs(spark, d), gone, _running(spark, d)).select("run_id", "source_id")


@query("C09_clear_runs", f"with {RUNS} select run_id, run_id % 11 <> 0 and run_id % 7 <> 0 as deleted from completed")
def c09(spark, d):
    runs = C.completed(_runs(spark, d), _sources(spark, d))
    return C.cleared(runs, _running(spark, d), _busy(spark, d)).select("run_id", "deleted")


@query("C10_workspace", f"""with {RUNS}, nothing as (select null::bigint as run_id)
select 'source' as kind, source_id, name, null::bigint as run_id, null::varchar as model, null::bigint as created from sources
union all select 'run', source_id, null, run_id, model, created from completed where run_id % 11 <> 0
union all select 'active', source_id, null, run_id, model, null from runs where run_id % 11 = 0""")  # fmt: skip
def c10(spark, d):
    return C.workspace(_sources(spark, d), _runs(spark, d), _running(spark, d))


@query("C11_meta_lifting", "select event_id, event_type, (props::json ->> 'k')::bigint as k from events")
def c11(spark, d):
    e = table(spark, d, "events").withColumn("meta", F.from_json("props", "k bigint"))
    return e.select("event_id", "event_type", "meta.*")


@query("C12_segmentation_default", """select event_id, event_type = 'click' as available, case when event_type = 'click' then value > 50 else false end as empty from events""")
def c12(spark, d):
    e = table(spark, d, "events")
    seg = F.when(F.col("event_type") == "click", F.struct(F.lit(True).alias("available"), (F.col("value") > 50).alias("empty")))
    default = F.struct(F.lit(False).alias("available"), F.lit(False).alias("empty"))
    return e.select("event_id", F.coalesce(seg, default).alias("seg")).select("event_id", "seg.*")


def _events(spark, d):
    sets = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") != "signup", "running")
    return table(spark, d, "events").select("event_id", "user_id", "ts", sets.alias("sets"))


SETS = "ev as (select event_id, user_id, ts, case event_type when 'error' then 'error' when 'purchase' then 'done' when 'signup' then null else 'running' end as sets from events)"


@query("C13_group_state", f"""with {SETS} select event_id, user_id, count(*) over w as rev, coalesce(last_value(sets ignore nulls) over w, 'queued') as status
from ev window w as (partition by user_id order by ts, event_id rows unbounded preceding)""")  # fmt: skip
def c13(spark, d):
    e = _events(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return P.statuses(e, "user_id", ["t", "event_id"]).select("event_id", "user_id", "rev", "status")


@query("C14_changed_since", f"""with {SETS}, n as (select user_id, count(*) as rev, coalesce(arg_max(sets, (ts, event_id)) filter (where sets is not null), 'queued') as status from ev group by 1)
select user_id, rev, status from n where rev > 60 + user_id % 10""")  # fmt: skip
def c14(spark, d):
    e = _events(spark, d)
    seen = e.select("user_id").distinct().withColumn("rev", 60 + F.col("user_id") % 10)
    return P.changed(P.latest(e, "user_id", ["ts", "event_id"]), seen, "user_id")


@query("C15_point_validation", """with p as (select event_id, '[[' || case when event_id % 9 = 0 then 'NaN' when event_id % 13 = 0 then '1e999' else (event_id % 640)::varchar end || ', ' || (event_id % 360)::varchar || '.5, ' ||
  case when event_id % 7 = 0 then '2' when event_id % 8 = 0 then 'true' when event_id % 3 = 0 then '1.0' else (event_id % 2)::varchar end || ', ' || case when event_id % 10 = 0 then '-1' else (event_id % 30)::varchar end ||
  case when event_id % 11 = 0 then '' else ']' end || ']' as payload from events)
select event_id, event_id % 9 <> 0 and event_id % 13 <> 0 and event_id % 7 <> 0 and event_id % 8 <> 0 and event_id % 10 <> 0 and event_id % 11 <> 0 as valid from p""")  # fmt: skip
def c15(spark, d):
    e = F.col("event_id")
    x = F.when(e % 9 == 0, "NaN").when(e % 13 == 0, "1e999").otherwise((e % 640).cast("string"))
    label = F.when(e % 7 == 0, "2").when(e % 8 == 0, "true").when(e % 3 == 0, "1.0").otherwise((e % 2).cast("string"))
    frame = F.when(e % 10 == 0, "-1").otherwise((e % 30).cast("string"))
    payload = F.concat(F.lit("[["), x, F.lit(", "), (e % 360).cast("string"), F.lit(".5, "), label, F.lit(", "), frame, F.when(e % 11 == 0, "").otherwise("]"), F.lit("]"))
    return table(spark, d, "events").select("event_id", C.valid_points(payload).alias("valid"))


@query("C16_point_bounds", """select o_orderkey as run_id, o_orderkey % 700 < 640 and o_orderkey % 400 < 360 and o_orderkey % 33 < 30 and (o_orderkey * 7) % 700 < 640 as inside from orders""")
def c16(spark, d):
    k = F.col("o_orderkey")
    pts = F.array(F.struct((k % 700).alias("x"), (k % 400).alias("y"), (k % 33).alias("frame")), F.struct((k * 7 % 700).alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("frame")))
    return table(spark, d, "orders").select(k.alias("run_id"), C.inside(pts, F.lit(640), F.lit(360), F.lit(30)).alias("inside"))


@query("C17_id_validation", """select doc_id, regexp_full_match(case when doc_id % 3 = 0 then upper(substr(sha256(text), 1, 14)) when doc_id % 5 = 0 then substr(sha256(text), 1, 17) else substr(sha256(text), 1, (10 + doc_id % 7)::integer) end, '[0-9a-f]{12,16}') as valid from documents where text is not null""")
def c17(spark, d):
    k, h = F.col("doc_id"), F.sha2("text", 256)
    ident = F.when(k % 3 == 0, F.upper(F.substring(h, 1, 14))).when(k % 5 == 0, F.substring(h, 1, 17)).otherwise(F.substring(h, F.lit(1), (10 + k % 7).cast("int")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", ident.rlike(C.IDENT).alias("valid"))


def _attempts(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 / 600
    return table(spark, d, "events").where("event_type in ('error', 'signup')").select(F.col("user_id").alias("ip"), "event_id", t.alias("t"), (F.col("event_type") == "signup").alias("ok"))


@query("C18_login_throttle", """with recursive a as (select user_id as ip, event_id, epoch_us(ts) / 1000000 / 600 as t, event_type = 'signup' as good, row_number() over (partition by user_id order by ts, event_id) as o from events where event_type in ('error', 'signup')),
r as (
  select ip, 0::bigint as o, null::bigint as event_id, '' as outcome, 0::bigint as fails, 0::double as until from a where o = 1
  union all
  select r.ip, a.o, a.event_id, case when r.until > a.t then 'refused' when a.good then 'ok' else 'failed' end,
    case when r.until > a.t then r.fails when a.good then 0 else r.fails + 1 end,
    case when r.until > a.t then r.until when a.good then 0 when r.fails + 1 >= 5 then a.t + least(2.0::double ** (r.fails + 1 - 5), 300) else r.until end
  from r join a on a.ip = r.ip and a.o = r.o + 1
) select ip, event_id, outcome, fails, round(until, 6) as locked_until from r where o > 0""")  # fmt: skip
def c18(spark, d):
    return P.throttled(_attempts(spark, d)).withColumn("locked_until", F.round("locked_until", 6))


@query("C20_matrix", f"""with {RUNS}, {PRUNED} select source_id, coalesce(max(case when model = '1-URGENT' then run_id end), -1) as m1, coalesce(max(case when model = '2-HIGH' then run_id end), -1) as m2,
coalesce(max(case when model = '3-MEDIUM' then run_id end), -1) as m3, coalesce(max(case when model = '4-NOT SPECIFIED' then run_id end), -1) as m4, coalesce(max(case when model = '5-LOW' then run_id end), -1) as m5 from pruned group by 1""")  # fmt: skip
def c20(spark, d):
    m = C.matrix(C.pruned(_runs(spark, d), _sources(spark, d)), MODELS)
    return m.select("source_id", *[F.coalesce(F.col(f"`{x}`"), F.lit(-1)).alias(f"m{i}") for i, x in enumerate(MODELS, 1)])


_CLICK = """with c as (select p_partkey as id, (case when p_partkey % 3 = 0 then 800 else p_partkey * 13 % 800 end)::double as x, (case when p_partkey % 4 = 0 then 500 else p_partkey * 7 % 500 end)::double as y, 800.0::double as bw, 500.0::double as bh, (p_size - 1) * 16.0::double as w, (p_partkey % 40) * 9.0::double as h from part),
s as (select *, least(bw / nullif(w, 0), bh / nullif(h, 0)) as k from c), p as (select *, (x - (bw - w * k) / 2) / k as sx, (y - (bh - h * k) / 2) / k as sy from s)
select id, case when w > 0 and h > 0 and sx >= 0 and sx <= w and sy >= 0 and sy <= h then round(sx, 4) end as px, case when w > 0 and h > 0 and sx >= 0 and sx <= w and sy >= 0 and sy <= h then round(sy, 4) end as py from p"""


@query("C21_click_to_pixel", _CLICK)
def c21(spark, d):
    k = F.col("p_partkey")
    x, y = F.when(k % 3 == 0, 800).otherwise(k * 13 % 800).cast("double"), F.when(k % 4 == 0, 500).otherwise(k * 7 % 500).cast("double")
    px, py = C.clicked(x, y, F.lit(800.0), F.lit(500.0), (F.col("p_size") - 1) * 16.0, k % 40 * 9.0)
    return table(spark, d, "part").select(k.alias("id"), F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


@query("C22_click_to_frame", """select p_partkey as id, (case when p_size % 10 = 0 then 0 else greatest(0, least(floor((p_partkey % 130) / 8.0::double / (p_size % 10) * 48), 47)) end)::bigint as frame from part""")
def c22(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), C.clicked_frame(k % 130 / 8.0, (F.col("p_size") % 10).cast("double"), F.lit(48)).alias("frame"))


@query("C23_playback_sync", """with p as (select p_partkey as id, case when p_partkey % 11 = 0 then null when p_partkey % 12 = 0 then 0 when p_partkey % 13 = 0 then 'inf'::double else (p_size % 20 + 1)::double end as dur, (p_partkey % 100) / 10.0::double as master,
  (p_partkey % 77) / 7.0::double as own, case when p_partkey % 5 = 0 then null when p_partkey % 7 = 0 then 0 when p_partkey % 8 = 0 then 'inf'::double else 10::double end as t from part),
r as (select *, case when t > 0 and isfinite(t) and dur > 0 and isfinite(dur) then dur / t else 1 end as ratio from p)
select id, round(least(coalesce(dur, 0), master * ratio), 6) as target, abs(own - least(coalesce(dur, 0), master * ratio)) > 0.25 as jumps from r""")  # fmt: skip
def c23(spark, d):
    k, inf = F.col("p_partkey"), float("inf")
    dur = F.when(k % 11 == 0, F.lit(None)).when(k % 12 == 0, 0.0).when(k % 13 == 0, inf).otherwise((F.col("p_size") % 20 + 1).cast("double"))
    t = F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, 0.0).when(k % 8 == 0, inf).otherwise(10.0)
    target, jumps = C.synced(t, k % 77 / 7.0, dur, k % 100 / 10.0)
    return table(spark, d, "part").select(k.alias("id"), F.round(target, 6).alias("target"), jumps.alias("jumps"))


@query("C24_clock", "with o as (select o_orderkey as id, case when o_orderkey % 5 = 0 then 0 else floor(o_totalprice)::bigint end as s from orders) select id, (s // 60)::varchar || ':' || lpad((s % 60)::varchar, 2, '0') as clock from o")
def c24(spark, d):
    k = F.col("o_orderkey")
    t = F.when(k % 15 == 0, float("nan")).when(k % 10 == 0, float("inf")).when(k % 5 == 0, F.lit(None)).otherwise(F.col("o_totalprice"))
    return table(spark, d, "orders").select(k.alias("id"), C.clock(t).alias("clock"))


#: fixed values: the models that features come from (key, family, patch, longest side, frames of a clip, tubelet, batch)
REGISTRY = [
    ("dinov2-base", "dino", 14, 1024, 16, 1, 128),
    ("dinov2-large", "dino", 14, 1024, 16, 1, 64),
    ("dinov2-giant", "dino", 14, 1024, 16, 1, 32),
    ("dinov3-vitb16", "dino", 16, 1024, 16, 1, 128),
    ("dinov3-vith16plus", "dino", 16, 1024, 16, 1, 64),
    ("vjepa21-vitl", "vjepa", 16, 640, 32, 2, 1),
]


def models(spark):
    return spark.createDataFrame(REGISTRY, "model string, family string, patch bigint, max_side bigint, clip bigint, tubelet bigint, batch bigint")


@query("C25_model_registry", "with m as (select * from (values " + ", ".join("({}, '{}', '{}', {}::bigint, {}::bigint, {}::bigint, {}::bigint, {}::bigint)".format(i, *r) for i, r in enumerate(REGISTRY)) + ") v(i, model, family, patch, max_side, clip, tubelet, batch)) select m.* exclude (i), count(o_orderkey) as runs from m left join orders on o_orderkey % 7 = i and o_orderstatus = 'F' group by all")
def c25(spark, d):
    """Each model with how many completed runs of it there are; runs of a model that isn't listed don't count."""
    names = F.create_map(*[x for i, r in enumerate(REGISTRY) for x in (F.lit(i), F.lit(r[0]))])
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(names[(F.col("o_orderkey") % 7).cast("int")].alias("model")).agg(F.count("*").alias("runs"))
    return models(spark).join(done, "model", "left").fillna(0, ["runs"])


@query("A31_swizzle", "select l_orderkey, l_linenumber::bigint as line, round(l_tax, 6) as r, round(1 - l_discount, 6) as g, round((l_quantity / 50), 6) as b from lineitem")
def a31(spark, d):
    rgb = [F.col("l_discount"), F.col("l_quantity") / 50, F.col("l_tax")]
    out = color.swizzled(rgb, 4, (False, True, False))
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), *[F.round(v, 6).alias(n) for v, n in zip(out, "rgb")])


@query("F03_points_by_frame", """with p as (select o_custkey as run_id, o_orderkey % 30 as frame, o_orderkey % 640 as x, o_orderkey % 2 as label from orders)
select run_id, frame, count(*)::bigint as n, string_agg(x::varchar || ':' || label::varchar, ',' order by x, label) as points from p group by 1, 2""")  # fmt: skip
def f03(spark, d):
    """Prompts of each frame, as they are given to a tracker: frame by frame."""
    k = F.col("o_orderkey")
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), (k % 30).alias("frame"), (k % 640).alias("x"), (k % 2).alias("label"))
    pts = F.array_sort(F.collect_list(F.struct("x", "label")))
    text = F.array_join(F.transform("pts", lambda q: F.concat_ws(":", q["x"].cast("string"), q["label"].cast("string"))), ",")
    return p.groupBy("run_id", "frame").agg(pts.alias("pts")).select("run_id", "frame", F.size("pts").cast("bigint").alias("n"), text.alias("points"))


@query("F04_missing_mask", "select event_id, case when value > 20 then value > 60 else true end as fg, value > 20 as available from events")
def f04(spark, d):
    """Where no mask could be made, all is foreground, and it says so; an empty mask is no such failure."""
    e = table(spark, d, "events").withColumn("mask", F.when(F.col("value") > 20, F.col("value") > 60))
    return e.select("event_id", F.coalesce("mask", F.lit(True)).alias("fg"), F.col("mask").isNotNull().alias("available"))


@query("F06_segmentation_meta", """select event_id, '{"available":' || (value > 20)::varchar || ',"empty":' || (value between 20 and 60 and value > 20)::varchar || ',"seed_frame":0}' as meta from events""")
def f06(spark, d):
    e = table(spark, d, "events")
    meta = F.struct((F.col("value") > 20).alias("available"), ((F.col("value") > 20) & (F.col("value") <= 60)).alias("empty"), F.lit(0).alias("seed_frame"))
    return e.select("event_id", F.to_json(meta).alias("meta"))
