"""Principal-component bases of token tables: fitted from exact sums over all rows, shown as colours.

The only data that leave the executors are the sums of a fit (D x D numbers); the eigen-solve is the driver's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldra.functions import vectors as V
from veldra.operators.quantiles import quantiles, weighted_quantiles
from veldra.sources.versions import Versions

SPREAD = (0.02, 0.98)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x = batch.column("feat").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        w = batch.column("w").to_numpy(zero_copy_only=False)
        one = np.c_[np.ones(n), x]
        part = (one * w[:, None]).T @ one
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])


def moments(df: DataFrame, feat: str = "feat", weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of weights, weighted mean, and weighted scatter about the mean, exactly over all rows.

    Each task adds its rows up; tasks' sums are added by row of the matrix, so the driver gets one matrix. Rows whose
    vector is null or whose length differs from the others fail as an error of the input.
    """
    w = F.lit(1.0) if weight is None else F.greatest(F.col(weight).cast("double"), F.lit(0.0))
    rows = df.select(V.as_double(feat).alias("feat"), w.alias("w")).where("feat is not null and w is not null")
    part = rows.mapInArrow(_sums, "i int, row array<double>")
    cells = part.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    got = cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("row")).collect()
    if not got:
        raise ValueError("no rows to fit")
    m = np.array([r["row"] for r in sorted(got, key=lambda r: r["i"])])
    total = max(m[0, 0], V.EPS)
    mean = m[0, 1:] / total
    return m[0, 0], mean, m[1:, 1:] - m[0, 0] * np.outer(mean, mean)


def top(scatter: np.ndarray, k: int, canonical: bool = True) -> np.ndarray:
    """The k leading directions; with `canonical`, the largest entry of each is positive (the first of equals)."""
    _, vec = np.linalg.eigh(scatter)
    comps = vec[:, ::-1][:, :k].T.copy()
    if canonical:
        for c in comps:
            if c[np.argmax(np.abs(c).round(12))] < 0:
                c *= -1
    return comps


@dataclass(frozen=True)
class Basis:
    """A display basis: mean, three directions, and the range that is shown of each."""

    l2norm: bool
    mean: np.ndarray
    comps: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def seen(self, feat: Column) -> Column:
        return V.normalize(feat) if self.l2norm else feat

    def project(self, feat: Column) -> list[Column]:
        """z = (x - mean) . direction, the mean's part taken out beforehand."""
        x = self.seen(feat)
        return [V.dot(x, V.constant(c)) - float(c @ self.mean) for c in self.comps]

    def colour(self, z: Column, c: int) -> Column:
        return V.clamp((z - float(self.lo[c])) / max(float(self.hi[c] - self.lo[c]), 1e-6))

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.l2norm, self.mean.tolist(), self.comps.tolist(), self.lo.tolist(), self.hi.tolist())
        Versions(spark, path).replace(spark.createDataFrame([row], "l2norm boolean, mean array<double>, comps array<array<double>>, lo array<double>, hi array<double>").coalesce(1))

    def frame(self, spark: SparkSession) -> DataFrame:
        """A copy of the basis as a table, (c, i, v, mean, lo, hi) for each direction and component from 1, which rows can be
        joined with; what becomes of it leaves the basis as it is."""
        rows = [(c, i, float(v), float(m), float(self.lo[c]), float(self.hi[c])) for c, d in enumerate(self.comps) for i, (v, m) in enumerate(zip(d, self.mean), 1)]
        return spark.createDataFrame(rows, "c bigint, i bigint, v double, mean double, lo double, hi double")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Basis:
        r = Versions(spark, path).read().first()
        return Basis(r["l2norm"], *[np.array(r[c]) for c in ("mean", "comps", "lo", "hi")])


#: from so many components on, a matrix product over Arrow batches beats column functions (200,000 rows of 64
#: components on two cores: 1.6 s against 3.2 s; the gap grows with the components)
WIDE = 32


def _products(basis: Basis, feat: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(feat)
            good = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
            z = np.full((batch.num_rows, len(basis.comps)), np.nan)
            if len(good):
                flat = col.drop_null().flatten()
                x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(good), -1)
                if flat.null_count:  # a vector that holds null has no projection, as in column functions
                    own = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(x.shape).any(1)
                    good, x = good[own], x[own]
                if basis.l2norm:
                    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), V.EPS)
                z[good] = (x - basis.mean) @ basis.comps.T
            gone = ~np.isin(np.arange(len(z)), good)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, mask=gone) for v in z.T]], [*batch.schema.names, *[f"z{i}" for i in range(z.shape[1])]])

    return run


def projected(df: DataFrame, basis: Basis, feat: str = "feat") -> DataFrame:
    """The table with z0, z1, z2; null where the vector is. One pass, no shuffle."""
    if basis.comps.shape[1] < WIDE:
        return df.withColumns({f"z{i}": z for i, z in enumerate(basis.project(V.as_double(feat)))})
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"z{i}", T.DoubleType()) for i in range(len(basis.comps))]])
    return df.mapInArrow(_products(basis, feat), schema)


def fit(df: DataFrame, *, l2norm: bool = False, spread: tuple[float, float] = SPREAD, feat: str = "feat") -> Basis:
    """A basis of all rows, its ranges from exact quantiles of the projections."""
    x = V.as_double(feat)
    seen = df.select((V.normalize(x) if l2norm else x).alias("feat"))
    _, mean, scatter = moments(seen)
    basis = Basis(False, mean, top(scatter, 3), np.zeros(3), np.ones(3))
    got = quantiles(projected(seen, basis).select("z0", "z1", "z2"), ["z0", "z1", "z2"], list(spread))
    lo, hi = np.array([got[f"z{i}"] for i in range(3)]).T
    return replace(basis, l2norm=l2norm, lo=lo, hi=hi)


def refit(df: DataFrame, basis: Basis, *, weight: str | None, ident: str = "vec_id", spread: tuple[float, float] = SPREAD, feat: str = "feat", least: int = 16) -> Basis:
    """The display basis again over foreground tokens, each with its weight (negative ones count as zero). Fewer
    than `least` tokens of positive weight are an error."""
    if weight is None:
        return fit(df, l2norm=basis.l2norm, spread=spread, feat=feat)
    x = V.as_double(feat)
    seen = df.select(F.col(ident).alias("id"), basis.seen(x).alias("feat"), F.greatest(F.col(weight).cast("double"), F.lit(0.0)).alias("w")).where("w > 0")
    if seen.limit(least).count() < least:
        raise ValueError(f"fewer than {least} foreground tokens")
    _, mean, scatter = moments(seen, weight="w")
    new = Basis(False, mean, top(scatter, 3), np.zeros(3), np.ones(3))
    z = projected(seen, new)
    one = z.select("id", "w", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"z{i}").alias("z")) for i in range(3)])).alias("s")).select("id", "w", "s.*")
    got = {(r["c"], r["q"]): r["value"] for r in weighted_quantiles(one, "z", "w", "id", list(spread), key="c").collect()}
    got = np.array([[got[c, q] for q in spread] for c in range(3)])
    return replace(new, l2norm=basis.l2norm, lo=got[:, 0], hi=got[:, 1])


def coloured(df: DataFrame, basis: Basis, feat: str = "feat") -> DataFrame:
    """The table with r, g, b in [0, 1]: one projection, no shuffle."""
    z = projected(df, basis, feat)
    return z.withColumns({n: basis.colour(F.col(f"z{i}"), i) for i, n in enumerate("rgb")}).drop("z0", "z1", "z2")


def sampled(df: DataFrame, n: int, ident: str) -> DataFrame:
    """At most n rows, those of the smallest digests of their ids: the same rows at every run."""
    return df.withColumn("_d", F.md5(F.col(ident).cast("string"))).orderBy("_d", ident).limit(n).drop("_d")


def equal_share(df: DataFrame, source: str, ident: str) -> DataFrame:
    """As many rows of each source as the smallest has, by their digests; one source alone stays whole.

    The least count grows with the data, so no rank runs over a source: digests are cut into 4096 parts by their first digits, and a
    row's rank is that within its part and the count of the parts before it."""
    from pyspark.sql import Window

    least = df.groupBy(source).count().agg(F.min("count")).first()[0] or 0
    at = df.withColumn("_d", F.md5(F.col(ident).cast("string"))).withColumn("_p", F.substring("_d", 1, 3))
    per = at.groupBy(F.col(source).alias("_s"), F.col("_p").alias("_q")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_s", "_q", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b")).where(F.col("_b") < int(least))
    both = at.join(per, at[source].eqNullSafe(per._s) & (at._p == per._q))
    own = F.row_number().over(Window.partitionBy(source, "_p").orderBy("_d", ident))
    return both.withColumn("_r", own + F.col("_b")).where(F.col("_r") <= int(least)).select(*df.columns)


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles in degrees between two subspaces given by orthonormal rows."""
    return np.degrees(np.arccos(np.clip(np.linalg.svd(a @ b.T, compute_uv=False), -1, 1)))
