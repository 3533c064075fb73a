"""How faithful one set of features or colours is to another, token by token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.functions import color
from veldra.functions import vectors as V
from veldra.operators import pca
from veldra.operators.quantiles import around, between, quantiles, ranked

# Limits of the fidelity gate
GATES = {"cosine_mean": 0.9995, "cosine_p1": 0.995, "angle": 2.0, "delta_p95": 3.0}


def cosines(base: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """key and cos of each token's two vectors."""
    b = other.select(*key, V.as_double("feat").alias("_other"))
    return base.join(b, key).select(*key, V.cosine(V.as_double("feat"), F.col("_other")).alias("cos"))


def summary(df: DataFrame, column: str, **figures: float | str) -> DataFrame:
    """One row of figures of a column: mean, min, max, or a quantile by its number. No task holds the column."""
    kinds = {"mean": F.avg, "min": F.min, "max": F.max}
    plain = df.agg(*[f(column).alias(n) for n, f in kinds.items()]).first()
    qs = [q for q in figures.values() if not isinstance(q, str)]
    at = dict(zip(qs, quantiles(df.select(column), [column], qs)[column])) if qs else {}
    row = [plain[q] if isinstance(q, str) else None if plain["mean"] is None else float(at[q]) for q in figures.values()]
    return df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"{n} double" for n in figures))


def cosine_summary(cos: DataFrame) -> DataFrame:
    return summary(cos, "cos", mean="mean", p50=0.5, p1=0.01, min="min")


def differences(base: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """key and de, the colour difference of each cell."""
    b = other.select(*key, *[F.col(c).alias(f"_{c}") for c in "rgb"])
    both = base.join(b, key)
    return both.select(*key, color.delta_e(color.lab(*[F.col(c) for c in "rgb"]), color.lab(*[F.col(f"_{c}") for c in "rgb"])).alias("de"))


def difference_summary(de: DataFrame) -> DataFrame:
    return summary(de, "de", mean="mean", p50=0.5, p95=0.95, max="max")


def angles(base: DataFrame, other: DataFrame, k: int = 3) -> list[float]:
    """Principal angles in degrees between the leading subspaces of two token tables."""
    a, b = (pca.top(pca.moments(d)[2], k, canonical=False) for d in (base, other))
    return pca.principal_angles(a, b).tolist()


def verdict(cos: DataFrame, de: DataFrame, angle: float) -> DataFrame:
    """All figures of the gate in one row, each with whether it passes."""
    c, d = cosine_summary(cos).first(), difference_summary(de).first()
    row = (c["mean"], c["p1"], d["p95"], float(angle))
    both = cos.sparkSession.createDataFrame([row], "cosine_mean double, cosine_p1 double, delta_p95 double, angle double")
    ok = {f"{k}_ok": (F.col(k) >= v if k.startswith("cosine") else F.col(k) <= v) for k, v in GATES.items()}
    out = both.withColumns(ok)
    passed: Column = F.lit(True)
    for k in ok:
        passed = passed & F.col(k)
    return out.withColumn("passed", passed)


def flicker(rgb: DataFrame, key: str = "source") -> DataFrame:
    """Mean colour difference between consecutive frames, averaged over a key's frame pairs."""
    w = Window.partitionBy(key, "row", "col").orderBy("frame")
    prev = rgb.withColumns({f"_{c}": F.lag(c).over(w) for c in "rgb"}).withColumn("_f", F.lag("frame").over(w)).where("_f is not null")
    de = color.delta_e(color.lab(*[F.col(c) for c in "rgb"]), color.lab(*[F.col(f"_{c}") for c in "rgb"]))
    pairs = prev.groupBy(key, "frame").agg(F.avg(de).alias("de"))
    return pairs.groupBy(key).agg(F.avg("de").alias("flicker"), F.count("*").alias("pairs"))


def worst(metrics: DataFrame, pair: str, high: list[str], low: list[str]) -> DataFrame:
    """Each pair's worst figures: the largest where less is better, the smallest where more is."""
    return metrics.groupBy(pair).agg(*[F.max(c).alias(c) for c in high], *[F.min(c).alias(c) for c in low])


def latency(df: DataFrame, key: str, ms: str, units: int) -> DataFrame:
    """Median, tenth and ninetieth percentile by nearest rank, and units a second, of each of a few keys
    (configurations). Ranks are narrowed down by histograms, so a key's rows are never in one task."""
    nearest = lambda p, m: min(m - 1, int(p * m))
    got = ranked(df, [ms], lambda m: {*around(0.5, m), nearest(0.1, m), nearest(0.9, m)}, key)
    rows = []
    for (k, _), (m, at) in got.items():
        if m:
            median = between((m, at), 0.5)
            rows.append((k, median, at[nearest(0.1, m)], at[nearest(0.9, m)], units / (median / 1000) if median else None))
    return df.sparkSession.createDataFrame(rows, f"{key} {dict(df.dtypes)[key]}, median double, p10 double, p90 double, fps double")


def crop(df: DataFrame, rows: int, cols: int) -> DataFrame:
    """The middle half of the grid, which stands in for the foreground."""
    return df.where((F.col("row") >= rows // 4) & (F.col("row") < rows - rows // 4) & (F.col("col") >= cols // 4) & (F.col("col") < cols - cols // 4))


def render_compare(base: DataFrame, other: DataFrame, key: list[str], rows: int, cols: int) -> DataFrame:
    """What a viewer sees of two token tables, in one row: colour differences under the base's basis (shared), under each
    one's own (own), and under bases refitted on the middle of the grid, there (refit); the largest angle between
    those two; the flicker of each. Tokens without a vector take no part."""
    base, other = (t.where("feat is not null") for t in (base, other))
    shared, own = pca.fit(base), pca.fit(other)
    middle = [crop(t, rows, cols) for t in (base, other)]
    refits = [pca.refit(t, b, weight=None) for t, b in zip(middle, (shared, own))]
    rgb, rgb_own = pca.coloured(base, shared), pca.coloured(other, own)
    pairs = {"shared": (rgb, pca.coloured(other, shared)), "own": (rgb, rgb_own), "refit": tuple(pca.coloured(t, b) for t, b in zip(middle, refits))}
    out = {}
    for name, (a, b) in pairs.items():
        got = difference_summary(differences(a, b, key)).first()
        out |= {f"{name}_{c}": got[c] for c in ("mean", "p50", "p95", "max")}
    out["refit_degrees"] = max(angles(*middle))
    for name, t in (("base", rgb), ("other", rgb_own)):
        out[f"flicker_{name}"] = flicker(t).agg(F.avg("flicker")).first()[0] or 0.0
    return base.sparkSession.createDataFrame([tuple(out.values())], ", ".join(f"{n} double" for n in out))
