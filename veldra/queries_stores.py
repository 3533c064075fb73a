"""Queries of stores, streams with state and the model slot: each writes what it derives from the given tables to the
shared folder and returns what it reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldra.operators import pca
from veldra.operators.extract import extracted
from veldra.registry import ORACLES, query
from veldra.sources.features import read_features, write_features
from veldra.sources.shared import shared_path
from veldra.sources.tokens import numbered, table
from veldra.sources.versions import Conflict, EventTable, Versions
from veldra.streaming import runs as R


def _steps(spark, d):
    """Vectors in steps of 1 / 256, which half floats hold exactly, as runs of single cells."""
    e = table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("run"), "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256) / 256).alias("feat"))
    return numbered(e, "run", "vec_id", "frame").select("run", "frame", F.lit(0).alias("row"), F.lit(0).alias("col"), "feat")


_STEPS = """e as (select label::varchar as run, row_number() over (partition by label order by vec_id) - 1 as frame, list_transform(embedding, lambda x: floor(x::double * 256) / 256) as feat from embeddings)"""


@query("D04_feature_sink", f"with {_STEPS} select run, count(*) as frames, 1::bigint as rows, 1::bigint as cols, max(len(feat))::bigint as dim, sum(len(feat) * 2)::bigint as bytes from e group by 1")
def d04(spark, d):
    """What the sink's commit has published, and the bytes that lie there."""
    path = shared_path(spark, "features")
    write_features(_steps(spark, d), path)
    meta = spark.read.json(f"{path}/*/meta.json").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"), "frames", F.col("grid")[0].alias("rows"), F.col("grid")[1].alias("cols"), F.col("feat_dim").alias("dim"))
    size = spark.read.format("binaryFile").load(f"{path}/*/*.f16").select(F.element_at(F.split("path", "/"), -2).alias("run"), "length").groupBy("run").agg(F.sum("length").alias("bytes"))
    return meta.join(size, "run")


@query("D05_feature_files", f"with {_STEPS} select run, frame, 0::bigint as row, 0::bigint as col, feat[1] as first, list_sum(list_transform(feat, lambda x, i: x * i)) as total from e")
def d05(spark, d):
    path = shared_path(spark, "features")
    write_features(_steps(spark, d), path)
    total = F.aggregate(F.transform("feat", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return read_features(spark, path, split=1 << 16).select("run", "frame", "row", "col", F.col("feat")[0].alias("first"), total.alias("total"))


@query("D07_basis_store", ORACLES.get("A03_pca_fit"))
def d07(spark, d):
    """A basis that was saved and loaded again, a version later."""
    from veldra.queries_numeric import _comps, _tokens

    path = shared_path(spark, "basis")
    fitted = pca.fit(_tokens(spark, d))
    fitted.save(spark, path)
    fitted.save(spark, path)
    return _comps(spark, pca.Basis.load(spark, path).comps)


@query("D08_versioned_replace", "select o_orderkey as run_id, 2::bigint as version, o_orderstatus || '!' as status from orders")
def d08(spark, d):
    """A table's second version: of two that follow the first, the one that came first."""
    t = Versions(spark, shared_path(spark, "runs"))
    first = t.replace(table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit(1).cast("bigint").alias("version"), F.col("o_orderstatus").alias("status")))
    t.change(lambda old: old.select("run_id", (F.col("version") + 1).alias("version"), F.concat("status", F.lit("!")).alias("status")))
    try:
        t.replace(t.read(first), base=first)
    except Conflict:
        return t.read()
    raise AssertionError("a version was replaced twice")


@query("F05_failed_refine", "select o_orderkey as run_id, o_orderstatus as status from orders")
def f05(spark, d):
    """A refinement that fails leaves the results as they were."""
    t = Versions(spark, shared_path(spark, "results"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    t.replace(rows)
    torn = rows.withColumn("status", F.when(F.col("run_id") % 97 == 0, F.raise_error(F.lit("lost track"))).otherwise(F.col("status")))
    try:
        t.replace(torn)
    except Exception as e:
        if "lost track" not in str(e):
            raise
    return t.read()


# ---- groups and runs

_KIND = """case event_type when 'click' then 'running' when 'purchase' then 'done' end as run_status, case event_type when 'error' then 'error' when 'purchase' then 'done' when 'signup' then null else 'running' end as sets, event_type = 'error' as error"""
_GROUPS = f"""ev as (select user_id as "group", row_number() over (partition by user_id order by ts, event_id) as seq, event_id % 3 as run, {_KIND} from events),
own as (select "group", run, arg_max(run_status, seq) as s, max(seq) as at from ev where run_status is not null group by all),
err as (select "group", max(seq) as at from ev where error group by 1),
states as (select own."group", run, case when s = 'running' and coalesce(err.at, 0) > own.at then 'error' else s end as status from own left join err using ("group"))"""


def _group_events(spark, d):
    """Events as those of a group's runs, numbered in the order in which they came."""
    kind = F.col("event_type")
    run_status = F.when(kind == "click", "running").when(kind == "purchase", "done")
    sets = F.when(kind == "error", "error").when(kind == "purchase", "done").when(kind != "signup", "running")
    e = table(spark, d, "events").select(F.col("user_id").alias("group"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_id") % 3).alias("run"), run_status.alias("run_status"), sets.alias("sets"), (kind == "error").alias("error"))
    return numbered(e, "group", ["t", "event_id"], "seq").withColumn("seq", F.col("seq") + 1).drop("t")


@query("C13_run_states", f'with {_GROUPS} select "group", run, status from states')
def c13r(spark, d):
    return R.run_states(_group_events(spark, d))


_STATES = f"""with {_GROUPS}, g as (select "group", count(*) as rev, coalesce(arg_max(sets, seq) filter (where sets is not null), 'queued') as status from ev group by 1)
select g."group", rev, g.status, count(*) filter (where s.status = 'running') as running, count(*) filter (where s.status = 'error') as failed, count(*) filter (where s.status = 'done') as done
from g left join states s using ("group") group by all"""


@query("C13_group_states", _STATES)
def c13g(spark, d):
    return R.group_states(_group_events(spark, d))


def _fed(spark, d):
    """The feed: events lie in files in no order, a stream with state folds them, and each batch of states is added to
    an event table once."""
    spark = R.session(spark)
    path = shared_path(spark, "feed")
    _group_events(spark, d).repartition(8, F.xxhash64("event_id")).write.parquet(f"{path}/events")
    feed = EventTable(spark, f"{path}/states")
    raw = spark.readStream.schema(spark.read.parquet(f"{path}/events").schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/events")
    q = R.stream_states(raw).writeStream.foreachBatch(feed.sink()).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return feed.read(R.STATES)


@query("D10_event_sink", f'with {_GROUPS} select "group", seq as rev from ev')
def d10(spark, d):
    """Each rev of each group, as it lies in the event table: all of them, once."""
    return _fed(spark, d).select("group", "rev")


@query("E07_progress_stream", _STATES)
def e07(spark, d):
    """Where each group is when the feed has come to its end."""
    return _fed(spark, d).groupBy("group").agg(F.max_by(F.struct("status", "running", "failed", "done"), "rev").alias("s"), F.max("rev").alias("rev")).select("group", "rev", "s.*")


# ---- the model slot

CLIP, TUBELET, WIDTH = 4, 2, 3


def projection():
    """A model with fixed weights: features of a step are the means of its frames' products."""
    import numpy as np

    def run(x):
        j, i = np.meshgrid(np.arange(WIDTH), np.arange(x.shape[2]), indexing="ij")
        w = ((i * 7 + j * 3) % 11 - 5) / 10
        return (x @ w.T).reshape(len(x), CLIP // TUBELET, TUBELET, WIDTH).mean(2)

    return run


@query("E05_extract", f"""with k as (select label::bigint as source, row_number() over (partition by label order by vec_id) - 1 as frame, embedding from embeddings),
n as (select source, max(frame) as last from k group by 1),
p as (select k.source, k.frame, s.i as slot from k, (select unnest(range({TUBELET})) as i) s),
f as (select p.source, p.frame, least(p.frame // {TUBELET} * {TUBELET} + p.slot, n.last) as at from p join n using (source)),
y as (select f.source, f.frame, j.j, avg(list_sum(list_transform(k.embedding, lambda x, i: x::double * (((i - 1) * 7 + j.j * 3) % 11 - 5) / 10))) as v
  from f join k on k.source = f.source and k.frame = f.at, (select unnest(range({WIDTH})) as j) j group by 1, 2, 3)
select source, frame, round(max(case when j = 0 then v end), 6) as f0, round(max(case when j = 1 then v end), 6) as f1, round(max(case when j = 2 then v end), 6) as f2 from y group by 1, 2""")  # fmt: skip
def e05(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("source"), "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    dim = e.agg(F.max(F.size("x"))).first()[0]
    y = extracted(numbered(e, "source", "vec_id", "frame"), projection, key="source", pos="frame", value="x", dim=dim, clip=CLIP, tubelet=TUBELET)
    return y.select("source", "frame", *[F.round(F.col("feat")[j], 6).alias(f"f{j}") for j in range(WIDTH)])

