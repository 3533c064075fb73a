"""Which frames, grids, units and chunks exist: planning as column arithmetic.

Rounding is half to even throughout (rint), as the plans that must be met round so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.sources.tokens import numbered


def stride(fps: Column, target: Column) -> Column:
    """Source frames for each sampled one; 1 if a rate is missing or zero."""
    known = (F.coalesce(fps, F.lit(0.0)) != 0) & (F.coalesce(target, F.lit(0.0)) != 0)
    return F.when(known, F.greatest(F.rint(fps / target), F.lit(1.0))).otherwise(F.lit(1.0)).cast("bigint")


def frame_indices(n: Column, fps: Column, target: Column, most: Column) -> Column:
    """Sampled positions: every stride-th frame, thinned out evenly to at most `most`."""
    n, s = F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)), stride(fps, target)  # a clip has a frame at least
    full = F.ceil(n / s)  # frames at that stride
    pick = F.when(most <= 1, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(most, F.lit(2)).cast("bigint") - 1), lambda i: (F.rint(i * ((full - 1) / (most - 1))) * s).cast("bigint"))
    )
    every = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(full, F.lit(1)).cast("bigint") - 1), lambda i: i * s)
    return F.when(full > most, pick).otherwise(every)


def metadata(fps: Column, n: Column, duration: Column) -> dict[str, Column]:
    """Rates, counts and durations, with stand-ins for what is missing or zero; a duration that isn't positive is missing, and
    follows from the frames at a rate of one at least."""
    f = F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(30.0))
    d = F.coalesce(duration, F.lit(0.0))
    count = F.coalesce(F.nullif(n, F.lit(0)), F.nullif((d * f).cast("bigint"), F.lit(0)), F.lit(1)).cast("bigint")
    return {"fps": f, "n": count, "duration": F.when(d > 0, d).otherwise(count / F.greatest(f, F.lit(1.0)))}


def grid(height: Column, width: Column, patch: Column, most: Column) -> dict[str, Column]:
    """Cells down and across and the processed size, for a side of at most `most` pixels."""
    scale = F.least(F.lit(1.0), most / F.greatest(height, width, F.lit(1)))
    gh, gw = (F.greatest(F.rint(side * scale / patch), F.lit(1.0)).cast("bigint") for side in (height, width))
    return {"gh": gh, "gw": gw, "ph": gh * patch, "pw": gw * patch}


def at_positions(frames: DataFrame, wanted: DataFrame, key: str, order: list[str], begin: str) -> DataFrame:
    """The frame at each wanted position of a source, in presentation order: frames before the beginning don't
    count, positions past the end give the last. Positions of a source without frames are an error. The first of
    `order` is a whole number; a source's frames are numbered by many tasks."""
    pos = numbered(frames.where(F.col(order[0]) >= F.col(begin) - 1e-6), key, order, "pos")
    last = pos.groupBy(key).agg(F.max("pos").alias("_last"))
    none = F.raise_error(F.concat(F.lit("no decodable frames of source "), F.col(key).cast("string"))).cast("bigint")
    ask = wanted.join(last, key, "left").withColumn("pos", F.when(F.col("_last").isNull(), none).otherwise(F.least("want", "_last"))).where("pos is not null").drop("_last")
    return ask.join(pos, [key, "pos"])


def units(sources: DataFrame, key: str, n: str, devices: int, align: int, least: int = 192) -> DataFrame:
    """Contiguous segments [lo, hi) of each source, a few for each device, in multiples of align."""
    count = F.lit(sources.count())
    seg = F.greatest(F.lit(1), F.least(F.ceil(4 * devices / count), F.floor(F.col(n) / least)))
    per = F.ceil(F.ceil(F.col(n) / seg) / align) * align
    cut = sources.where(F.col(n) > 0).select(key, F.col(n).alias("_n"), per.alias("_per")).select(key, "_n", "_per", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.col("_per"))).alias("lo"))
    return cut.select(key, "lo", F.least(F.col("lo") + F.col("_per"), F.col("_n")).alias("hi"))


def turns(sizes: dict[int, int], devices: int) -> list[tuple[int, list[int], list[int]]]:
    """(size, first, then) for each size of units and how many there are, largest first: the devices that its units go to,
    one by one, until no load is a whole unit above the least; from there on devices take turns.

    Loads differ by at most the largest unit, so `first` has at most devices * (largest / size + 1) entries, however many
    units there are."""
    load, out = [0] * devices, []
    for size in sorted(sizes, reverse=True):
        left, first = sizes[size], []
        while left and max(load) - min(load) >= size > 0:
            d = min(range(devices), key=load.__getitem__)
            load[d] += size
            first.append(d)
            left -= 1
        then = sorted(range(devices), key=load.__getitem__) if size > 0 else [load.index(min(load))]
        for i, d in enumerate(then):
            load[d] += size * (left // len(then) + (i < left % len(then)))
        out.append((size, first, then))
    return out


def assigned(units: DataFrame, order: list[str], devices: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Units with their device: the largest unit first, to the least loaded device, the first of equals; units of one
    size in the given order, whose first is a whole number.

    Units of one size are alike, so the plan is made on the sizes' counts, of which there are no more than frames in the
    longest clip; a unit finds its device by its place among those of its size, which many tasks number."""
    sized = units.withColumn("_size", (F.col(hi) - F.col(lo)).cast("bigint"))
    counts = {r["_size"]: r["count"] for r in sized.where("_size is not null").groupBy("_size").count().collect()}
    plan = units.sparkSession.createDataFrame(turns(counts, devices), "_of bigint, _lead array<int>, _then array<int>")
    placed = numbered(sized, "_size", order, "_place").join(plan, F.col("_size") == F.col("_of"))
    past = F.col("_place") - F.size("_lead")
    device = F.when(past < 0, F.get("_lead", F.col("_place").cast("int"))).otherwise(F.get("_then", (past % F.size("_then")).cast("int")))
    return placed.select(*units.columns, device.cast("bigint").alias("device"))


def chunk(pos: Column, size: int, align: int) -> Column:
    """The chunk of a position: a short first chunk, then whole ones of a multiple of align."""
    first = align if align > 1 else min(16, size)
    rest = max(align, size // align * align)
    return F.when(pos < first, F.lit(0)).otherwise(1 + F.floor((pos - first) / rest)).cast("bigint")


def aligned_chunk(clip: int, size: int) -> int:
    return max(clip, size // clip * clip)


def padded(frames: DataFrame, key: str, n: str, clip: int) -> DataFrame:
    """Positions of whole clips: (key, clip, slot, pos); the tail repeats the last frame."""
    slots = frames.where(F.col(n) > 0).select(key, F.col(n).alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), (F.ceil(F.col(n) / clip) * clip - 1).cast("bigint"))).alias("_i"))
    return slots.select(key, F.floor(F.col("_i") / clip).alias("clip"), (F.col("_i") % clip).alias("slot"), F.least("_i", F.col("_n") - 1).alias("pos"))


def expanded(t: DataFrame, key: str, step: str, n: str, tubelet: int) -> DataFrame:
    """Each temporal step shown for `tubelet` frames, cut to n."""
    each = t.select(key, step, n, F.explode(F.sequence(F.col(step) * tubelet, F.least(F.col(step) * tubelet + tubelet, F.col(n)) - 1)).alias("frame"))
    return each.where(F.col("frame") < F.col(n))


def even(v: Column) -> Column:
    return F.greatest(F.lit(2), v - v % 2)


def quota(n_sources: Column, lo: Column, hi: Column, n: Column, size: Column, total: int = 300_000) -> dict[str, Column]:
    """Rows a source, a unit and a chunk give to the fit sample."""
    per = F.greatest(F.lit(1), F.floor(F.lit(total) / n_sources))
    unit = F.greatest(F.lit(1), F.floor(per * (hi - lo) / n))
    return {"per_source": per, "per_unit": unit, "per_chunk": F.ceil(unit / F.ceil((hi - lo) / size))}


def options(max_side: Column, spec_side: Column, fps: Column, frames: Column, batch: Column, spec_batch: Column) -> dict[str, Column]:
    """A run's options: zero means the model's own; at least one frame; 900 if nothing is said."""
    return {
        "max_side": F.coalesce(F.nullif(max_side, F.lit(0)), spec_side),
        "fps": F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(24.0)),
        "max_frames": F.greatest(F.lit(1), F.coalesce(F.nullif(frames, F.lit(0)), F.lit(900))),
        "batch": F.coalesce(F.nullif(batch, F.lit(0)), spec_batch),
    }
