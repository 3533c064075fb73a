"""The catalog of sources and runs: content addresses, latest runs, pruning, deletion, the workspace.

All of it is semi and anti joins, ranks bounded by a constant, and partial aggregates; nothing is gathered on the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: payload of point prompts: a list of [x, y, label, frame] of finite numbers, a label of 0 or 1, a whole frame
_NUM = r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?"
_POINT = rf"\[\s*{_NUM}\s*,\s*{_NUM}\s*,\s*{_NUM}\s*,\s*-?(0|[1-9][0-9]*)\s*\]"
POINTS = rf"^\s*\[\s*({_POINT}(\s*,\s*{_POINT})*)?\s*\]\s*$"
IDENT = "^[0-9a-f]{12,16}$"


def content_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def deduplicated(df: DataFrame, content: str, order: str) -> DataFrame:
    """One source for each distinct content that isn't empty: (source_id, the first of the order, size)."""
    rows = df.where(F.length(content) > 0).select(content_id(F.col(content)).alias("source_id"), order, F.octet_length(content).cast("bigint").alias("size"))
    return rows.groupBy("source_id").agg(F.min(order).alias(order), F.min("size").alias("size"))


def registered(known: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Known sources and the new ones that aren't known yet; of several new ones of a key, the first of the order."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), order).alias("_r")).select("_r.*")
    return known.unionByName(first.join(known, key, "left_anti"))


def completed(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Runs that are done and whose source is there."""
    return runs.where("done").join(sources.select("source_id"), "source_id", "left_semi")


def pruned(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """The latest completed run of each cell (source and model); of equals, the one of the lowest run_id."""
    w = Window.partitionBy("source_id", "model").orderBy(F.desc("created"), "run_id")
    return completed(runs, sources).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def superseded(runs: DataFrame, new: DataFrame, busy: DataFrame) -> DataFrame:
    """Runs that new runs of the same cell replace, but for those that are being changed."""
    n = new.select("source_id", "model", F.col("run_id").alias("_new"))
    return runs.join(n, ["source_id", "model"]).where("run_id <> _new").select(*runs.columns).distinct().join(busy, "run_id", "left_anti")


def active(groups: DataFrame) -> DataFrame:
    """Ids of runs whose group is queued or running."""
    return groups.where(F.col("status").isin("queued", "running")).select(F.explode("runs").alias("run_id"))


def without_sources(runs: DataFrame, gone: DataFrame, busy: DataFrame) -> DataFrame:
    """Runs left when sources go with their runs. A source with a busy run is refused and keeps all of its runs."""
    refused = runs.join(busy, "run_id", "left_semi").select("source_id").distinct()
    return runs.join(gone.join(refused, "source_id", "left_anti"), "source_id", "left_anti")


def cleared(runs: DataFrame, running: DataFrame, busy: DataFrame) -> DataFrame:
    """Runs with whether clearing deletes them: all but the active and those being changed."""
    keep = running.unionByName(busy).distinct().withColumn("_keep", F.lit(True))
    return runs.join(keep, "run_id", "left").withColumn("deleted", F.col("_keep").isNull()).drop("_keep")


def workspace(sources: DataFrame, runs: DataFrame, running: DataFrame) -> DataFrame:
    """Everything that a client shows, a row each: sources (kind source), their completed runs that aren't active (kind run,
    with created, by which a client orders them), and the runs of groups that are queued or running (kind active)."""
    columns = ["kind", "source_id", "name", "run_id", "model", "created"]
    none = lambda like, c: F.lit(None).cast(dict(like.dtypes)[c]).alias(c)
    there = sources.select(F.lit("source").alias("kind"), "source_id", "name", none(runs, "run_id"), none(runs, "model"), none(runs, "created"))
    shown = completed(runs, sources).join(running, "run_id", "left_anti").select(F.lit("run").alias("kind"), "source_id", none(sources, "name"), "run_id", "model", "created")
    busy = runs.join(running, "run_id", "left_semi").select(F.lit("active").alias("kind"), "source_id", none(sources, "name"), "run_id", "model", none(runs, "created"))
    return there.unionByName(shown).unionByName(busy).select(columns)


def matrix(runs: DataFrame, models: list[str], value: str = "run_id") -> DataFrame:
    """Sources down, models across. The models are given, so nothing is scanned for them and columns are stable."""
    return runs.groupBy("source_id").pivot("model", models).agg(F.max(value))


def valid_points(payload: Column) -> Column:
    """Whether a payload has the form of point prompts, its coordinates are finite as numbers, its labels equal to 0 or 1
    and its frames not negative."""
    number = F.transform(F.regexp_extract_all(payload, F.lit(_NUM), 0), lambda x: x.cast("double"))
    fine = lambda x, i: F.when(i % 4 < 2, F.abs(x) < float("inf")).when(i % 4 == 2, x.isin(0.0, 1.0)).otherwise(x >= 0)
    return F.coalesce(payload.rlike(POINTS) & F.forall(F.transform(number, fine), lambda ok: ok), F.lit(False))


def inside(points: Column, width: Column, height: Column, frames: Column) -> Column:
    """Whether all points lie in a run's picture and frames."""
    return F.forall(points, lambda p: (p["x"] >= 0) & (p["x"] < width) & (p["y"] >= 0) & (p["y"] < height) & (p["frame"] >= 0) & (p["frame"] < frames))


def clicked(x: Column, y: Column, box_w: Column, box_h: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Source pixel of a click on a picture fitted into a box, its edges included; null beside the picture, and while
    the picture has no size."""
    width, height = (F.when(v > 0, v) for v in (width, height))
    scale = F.least(box_w / width, box_h / height)
    sx, sy = (x - (box_w - width * scale) / 2) / scale, (y - (box_h - height * scale) / 2) / scale
    ok = width.isNotNull() & height.isNotNull() & (sx >= 0) & (sx <= width) & (sy >= 0) & (sy <= height)
    return F.when(ok, sx), F.when(ok, sy)


def clicked_frame(t: Column, duration: Column, n: Column) -> Column:
    good = duration.isNotNull() & ~F.isnan(duration) & (duration > 0) & (duration < float("inf"))
    return F.when(good, F.greatest(F.lit(0), F.least(F.floor(t / duration * n), n - 1))).otherwise(F.lit(0)).cast("bigint")


def synced(t: Column, own: Column, duration: Column, master: Column) -> tuple[Column, Column]:
    """Where a picture should be for the master's time, and whether it jumps there. t is the master's length; where
    either length isn't finite and positive, times are taken as they are. Without a master's time there is no target."""
    known = lambda v: v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf"))
    ratio = F.when(known(t) & known(duration), duration / t).otherwise(F.lit(1.0))
    length = F.when(F.isnan(duration), F.lit(0.0)).otherwise(F.coalesce(duration, F.lit(0.0)))
    target = F.when(master.isNotNull() & ~F.isnan(master) & (F.abs(master) < float("inf")), F.least(length, master * ratio))
    return target, F.abs(F.when(F.isnan(own), F.lit(0.0)).otherwise(F.coalesce(own, F.lit(0.0))) - target) > 0.25


def clock(seconds: Column) -> Column:
    """m:ss; a time that isn't finite is 0:00."""
    s = F.floor(F.when(seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < float("inf")), seconds).otherwise(F.lit(0.0))).cast("bigint")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
