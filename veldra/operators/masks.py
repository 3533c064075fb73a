"""Masks: pooled onto grids, resized, applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bins_of(pos: Column, size: int, cells: int) -> Column:
    """The cells whose range [floor(i size / cells), ceil((i + 1) size / cells)) holds a position: one or two, from
    arithmetic, so that pooling needs no range join."""
    first = F.greatest(F.floor(pos * cells / size).cast("int") - 1, F.lit(0))
    near = F.sequence(first, F.least(first + 2, F.lit(cells - 1)))
    inside = lambda i: (F.floor(i * size / cells) <= pos) & (F.ceil((i + 1) * size / cells) > pos)
    return F.filter(near, inside)


def pooled(masks: DataFrame, height: int, width: int, gh: int, gw: int, key: list[str]) -> DataFrame:
    """The share of foreground of each grid cell: (key, row, col, w). masks has key, y, x and fg."""
    rows = masks.select(*key, F.explode(bins_of(F.col("y"), height, gh)).alias("row"), "x", "fg")
    cells = rows.select(*key, "row", F.explode(bins_of(F.col("x"), width, gw)).alias("col"), "fg")
    return cells.groupBy(*key, "row", "col").agg(F.avg(F.col("fg").cast("double")).alias("w"))


def nearest(masks: DataFrame, height: int, width: int, oh: int, ow: int, key: list[str]) -> DataFrame:
    """Each target pixel takes the source pixel at floor(target * in / out): every source pixel lists the targets
    that take it, so nothing is joined."""

    def targets(pos: Column, n: int, out: int) -> Column:
        first = F.ceil(pos * out / n).cast("int")
        last = (F.ceil((pos + 1) * out / n) - 1).cast("int")
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    ys = masks.select(*key, F.explode(targets(F.col("y"), height, oh)).alias("y"), F.col("x").alias("_x"), "fg")
    return ys.select(*key, "y", F.explode(targets(F.col("_x"), width, ow)).alias("x"), "fg")


def bilinear(grid: DataFrame, gh: int, gw: int, oh: int, ow: int, key: list[str], values: list[str]) -> DataFrame:
    """Values of a grid on a larger raster, corners not aligned: each cell gives its share to the pixels near it, and
    shares are summed."""

    def shares(pos: Column, n: int, out: int) -> Column:
        lo = F.greatest(F.floor((pos - 1) * out / n).cast("int") - 1, F.lit(0))
        hi = F.least(F.ceil((pos + 2) * out / n).cast("int") + 1, F.lit(out - 1))

        def weight(i: Column) -> Column:
            at = F.least(F.greatest((i + 0.5) * n / out - 0.5, F.lit(0.0)), F.lit(float(n - 1)))
            return F.greatest(1 - F.abs(at - pos), F.lit(0.0))

        return F.filter(F.transform(F.sequence(lo, hi), lambda i: F.struct(i.alias("at"), weight(i).alias("share"))), lambda s: s["share"] > 0)

    ys = grid.select(*key, *values, F.col("col"), F.explode(shares(F.col("row"), gh, oh)).alias("sy"))
    both = ys.select(*key, *values, "sy", F.explode(shares(F.col("col"), gw, ow)).alias("sx"))
    share = F.col("sy.share") * F.col("sx.share")
    return both.groupBy(*key, F.col("sy.at").alias("y"), F.col("sx.at").alias("x")).agg(*[F.sum(F.col(v) * share).alias(v) for v in values])


def empty(masks: DataFrame, key: list[str]) -> DataFrame:
    """Whether a mask has no foreground at all."""
    return masks.groupBy(*key).agg((~F.coalesce(F.bool_or("fg"), F.lit(False))).alias("empty"))
