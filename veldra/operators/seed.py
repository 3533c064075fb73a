"""Point prompts from the saliency of a frame's feature grid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.functions import vectors as V

POINTS = "source bigint, nth bigint, x double, y double, positive bigint, frame bigint"
OUTLIER = 3.5


def means(df: DataFrame, key: str | None = None, feat: str = "feat") -> DataFrame:
    """The mean vector, of each key or of all: positions are averaged by partial aggregates, then put together."""
    keys = [key] if key else []
    at = df.select(*keys, F.posexplode(V.as_double(feat)).alias("i", "v")).groupBy(*keys, "i").agg(F.avg("v").alias("v"))
    return at.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mu"))


def saliency(df: DataFrame, key: str = "source", feat: str = "feat") -> DataFrame:
    """Tokens with mu (their key's mean), sal (distance from it) and norm."""
    mu = means(df, key, feat)
    x = V.as_double(feat)
    return df.join(mu, key).withColumn("sal", V.distance(x, F.col("mu"))).withColumn("norm", V.norm(x))


def outliers(df: DataFrame, key: str = "source", value: str = "norm") -> DataFrame:
    """Tokens with artifact: a modified z-score of the value, from lower medians, beyond 3.5; none without spread."""
    med = df.groupBy(key).agg(F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("med"))
    dev = df.join(med, key).withColumn("dev", F.abs(F.col(value) - F.col("med")))
    mad = dev.groupBy(key).agg(F.expr("percentile_disc(0.5) within group (order by dev)").alias("mad"))
    flag = F.when(F.col("mad") > 0, F.abs(0.6745 * (F.col(value) - F.col("med")) / F.col("mad")) > OUTLIER).otherwise(False)
    return dev.join(mad, key).withColumn("artifact", flag)


def peaks(sal: np.ndarray, artifact: np.ndarray, k: int = 5) -> list[tuple[int, int]]:
    """Up to k cells, the most salient first (the first of equals, by rows), none within another's square; artifacts
    are none."""
    reach = max(1, int(np.rint(min(sal.shape) / 6)))
    open_ = np.where(artifact, -np.inf, sal.round(9))
    found: list[tuple[int, int]] = []
    while len(found) < max(1, k) and np.isfinite(open_.max(initial=-np.inf)):
        r, c = (int(i) for i in np.unravel_index(int(np.argmax(open_)), open_.shape))
        open_[max(0, r - reach) : r + reach + 1, max(0, c - reach) : c + reach + 1] = -np.inf
        found.append((r, c))
    return found


def gate(x: np.ndarray, lead: np.ndarray, mu: np.ndarray) -> bool:
    """Whether a cell's vector is closer to the first peak's than to the mean."""
    near = lambda b: round(float(x @ b / max(np.linalg.norm(x) * np.linalg.norm(b), 1e-8)), 9)
    return near(lead) > near(mu)


def picks(grid: np.ndarray, sal: np.ndarray, artifact: np.ndarray, k: int = 5) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """Cells of up to k positive prompts, those of the peaks that pass the gate, and of the negative one, if there is
    room on the border."""
    gh, gw, _ = grid.shape
    mu = grid.reshape(gh * gw, -1).mean(0)
    tops = peaks(sal, artifact, k)
    found = tops[:1] + [c for c in tops[1:] if gate(grid[c], grid[tops[0]], mu)]
    ring = [(r, c) for r in range(gh) for c in range(gw) if (r in (0, gh - 1) or c in (0, gw - 1)) and (r, c) not in found]
    return found, min(ring, key=lambda rc: (sal.round(9)[rc], rc)) if ring else None


def prompts(frame: DataFrame, width: float, height: float, k: int = 5) -> DataFrame:
    """Prompts of each source's grid: (source, nth, x, y, positive, frame) in pixels. A group is one frame's grid, so
    its size is bounded by the grid's, not by the table's."""

    def run(t):
        import pandas as pd

        t = t.sort_values(["row", "col"])
        gh, gw = int(t["row"].max()) + 1, int(t["col"].max()) + 1
        grid = np.stack(t["feat"].to_numpy()).astype(float).reshape(gh, gw, -1)
        sal = t["sal"].to_numpy(dtype=float).reshape(gh, gw)
        pos, neg = picks(grid, sal, t["artifact"].to_numpy(dtype=bool).reshape(gh, gw), k)
        cells = [(*c, 1) for c in pos] + ([(*neg, 0)] if neg else [])
        rows = [(int(t["source"].iloc[0]), i, (c + 0.5) / gw * width, (r + 0.5) / gh * height, p, int(t["frame"].iloc[0])) for i, (r, c, p) in enumerate(cells)]
        return pd.DataFrame(rows, columns=["source", "nth", "x", "y", "positive", "frame"])

    return frame.groupBy("source").applyInPandas(run, POINTS)


def gated(frame: DataFrame, k: int = 5) -> DataFrame:
    """The peaks of each source's grid, (source, k, row, col, to_first, to_mean, kept): cosines to the first peak and to
    the grid's mean (mu, as saliency() gives it), and whether the gate keeps the peak. The first peak always stays."""

    def run(t):
        import pandas as pd

        gh, gw = int(t["row"].max()) + 1, int(t["col"].max()) + 1
        sal, artifact = np.full((gh, gw), -np.inf), np.ones((gh, gw), bool)
        at = t["row"].to_numpy(), t["col"].to_numpy()
        sal[at], artifact[at] = t["sal"].to_numpy(dtype=float), t["artifact"].to_numpy(dtype=bool)
        found = peaks(sal, artifact, k)
        return pd.DataFrame([(int(t["source"].iloc[0]), i, r, c) for i, (r, c) in enumerate(found, 1)], columns=["source", "k", "row", "col"])

    found = frame.select("source", "row", "col", "sal", "artifact").groupBy("source").applyInPandas(run, "source bigint, k bigint, row bigint, col bigint")
    at = found.join(frame.select("source", "row", "col", V.as_double("feat").alias("_x"), "mu"), ["source", "row", "col"])
    lead = at.where("k = 1").select("source", F.col("_x").alias("_lead"))
    cos = lambda a, b: F.round(V.dot(a, b) / F.greatest(V.norm(a) * V.norm(b), F.lit(1e-8)), 9)
    both = at.join(lead, "source").withColumns({"to_first": cos(F.col("_x"), F.col("_lead")), "to_mean": cos(F.col("_x"), F.col("mu"))})
    return both.select("source", "k", "row", "col", "to_first", "to_mean", ((F.col("k") == 1) | (F.col("to_first") > F.col("to_mean"))).alias("kept"))


def border_cells(frame: DataFrame, key: str = "source") -> DataFrame:
    """The least salient cell of each grid's border ring."""
    ends = frame.groupBy(key).agg(F.max("row").alias("_h"), F.max("col").alias("_w"))
    ring = frame.join(ends, key).where("row in (0, _h) or col in (0, _w)")
    w = Window.partitionBy(key).orderBy(F.round("sal", 9), "row", "col")
    return ring.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_h", "_w")
