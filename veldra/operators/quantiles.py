"""Exact quantiles, plain and weighted, without holding a column in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096
SMALL = 200_000


def quantiles(df: DataFrame, columns: list[str], qs: list[float], small: int = SMALL) -> dict[str, list[float]]:
    """Type-7 quantiles of each column, exactly.

    Up to `small` rows go to percentile(); beyond, the values of the ranks are found by histograms (see ranked), so no task
    ever holds a column. Nulls don't count; infinities are the ends, and values that are no number come behind them,
    on either path.
    """
    n = df.count()
    if not n:
        return {c: [float("nan")] * len(qs) for c in columns}
    if n <= small:
        got = df.agg(*[F.percentile(c, F.array(*[F.lit(q) for q in qs])).alias(c) for c in columns]).first()
        return {c: list(got[c]) if got[c] is not None else [float("nan")] * len(qs) for c in columns}
    found = ranked(df, columns, lambda m: {r for q in qs for r in around(q, m)})
    return {c: [between(found[None, c], q) for q in qs] for c in columns}


def around(q: float, m: int) -> tuple[int, int]:
    """The ranks between which a quantile of m values lies."""
    return int(q * (m - 1)), min(m - 1, int(q * (m - 1)) + 1)


def between(values: tuple[int, dict[int, float]], q: float) -> float:
    """A quantile from the number of values and those of the ranks around it."""
    m, at = values
    if not m:
        return float("nan")
    a, b = (at[r] for r in around(q, m))
    t = q * (m - 1) - int(q * (m - 1))
    return a if a == b or not t else (1 - t) * a + t * b


def ranked(df: DataFrame, columns: list[str], ranks: Callable[[int], set[int]], key: str | None = None) -> dict[tuple, tuple[int, dict[int, float]]]:
    """For each (key, column): the number of its values, and the values of the ranks (from 0) that ranks(number) asks for.

    All ranks of all columns, and of all of a few keys, are narrowed down side by side: each pass is one job, whose rows go
    to the bins of the intervals that are still open, and the next intervals are the bins that hold the ranks. So a few
    passes over the table find everything, however many ranks there are.
    """
    k = F.lit(None).cast("string") if key is None else F.col(key)
    rows = df.select(k.alias("k"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    finite = [~F.isnan(f"x{i}") & (F.abs(f"x{i}") < float("inf")) for i in range(len(columns))]
    each = lambda i: [F.count_if(F.col(f"x{i}") == float("-inf")), F.count_if(finite[i]), F.count(f"x{i}"), F.count_if(F.col(f"x{i}") == float("inf")), F.min(F.when(finite[i], F.col(f"x{i}"))), F.max(F.when(finite[i], F.col(f"x{i}")))]
    ends = rows.groupBy("k").agg(*[F.struct(*each(i)).alias(f"e{i}") for i in range(len(columns))]).collect()
    out, open_ = {}, {}
    for r in ends:
        for i, c in enumerate(columns):
            low, middle, m, high, lo, hi = r[f"e{i}"]
            at = out[r["k"], c] = (m, {})
            for rank in sorted(ranks(m)) if m else ():
                if low <= rank < low + middle:
                    open_[r["k"], i, rank] = (lo, hi, rank - low)
                else:
                    at[1][rank] = float("-inf") if rank < low else float("inf") if rank < low + middle + high else float("nan")
    while open_:
        for (k_, i, rank), (lo, hi, _) in list(open_.items()):
            if lo == hi:
                out[k_, columns[i]][1][rank] = lo
                del open_[k_, i, rank]
        spans = sorted({(k_, i, lo, hi) for (k_, i, _), (lo, hi, _) in open_.items()}, key=str)
        if not spans:
            break
        bins = []
        for n, (k_, i, lo, hi) in enumerate(spans):
            x, part = F.col(f"x{i}"), 1.0 if abs(hi - lo) < float("inf") else 0.5  # the range of finite numbers can be beyond them
            width = max((hi * part - lo * part) / BINS, 5e-324)
            bin_ = F.least(F.floor((x * part - lo * part) / width), F.lit(BINS - 1))
            bins.append(F.when(F.col("k").eqNullSafe(F.lit(k_)) & (x >= lo) & (x <= hi), F.struct(F.lit(n).alias("n"), bin_.alias("b"), x.alias("x"))))
        hits = rows.select(F.explode(F.filter(F.array(*bins), lambda s: s.isNotNull())).alias("s")).select("s.*")
        hist: dict[int, list] = {}
        for r in hits.groupBy("n", "b").agg(F.count("*").alias("many"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():  # BINS rows an interval
            hist.setdefault(r["n"], []).append((r["b"], r["many"], r["lo"], r["hi"]))
        place = {s: n for n, s in enumerate(spans)}
        for (k_, i, rank), (lo, hi, nth) in list(open_.items()):
            for _, many, first, last in sorted(hist[place[k_, i, lo, hi]]):
                if nth < many:
                    open_[k_, i, rank] = (first, last, nth)
                    break
                nth -= many
    return out


def weighted_quantiles(df: DataFrame, x: str, w: str, ident: str, qs: list[float], key: str | None = None) -> DataFrame:
    """(q, value), or (key, q, value) for each of a few keys: quantiles by weights of zero and more, on the plotting
    position below / (below + above). Rows with a null value or weight don't count; without rows there is no result.

    Rows are binned by value; a row's weight below is its bin's, summed from one row for each bin, plus that of the
    rows before it in the bin. The two rows around each q are then found by plain aggregates, so no window spans a
    key and nothing is gathered.
    """
    k = F.lit(0) if key is None else F.col(key)
    rows = df.select(k.alias("k"), F.col(x).cast("double").alias("x"), F.greatest(F.col(w).cast("double"), F.lit(0.0)).alias("w"), F.col(ident).alias("id")).where("x is not null and w is not null")
    ends = rows.groupBy("k").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.sum("w").alias("_all"))  # a row for each key
    place = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("x") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / BINS))).otherwise(0)
    binned = rows.join(ends, "k").withColumn("b", F.least(place, F.lit(BINS - 1))).drop("_lo", "_hi")
    per = binned.groupBy("k", "b").agg(F.sum("w").alias("bw"))
    low = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("k", "b", F.coalesce(F.sum("bw").over(low), F.lit(0.0)).alias("first"))  # at most BINS rows a key
    before = Window.partitionBy("k", "b").orderBy("x", "id").rowsBetween(Window.unboundedPreceding, -1)
    cdf = binned.withColumn("in_bin", F.coalesce(F.sum("w").over(before), F.lit(0.0))).join(first, ["k", "b"])
    cdf = cdf.withColumn("cdf", (F.col("first") + F.col("in_bin")) / F.greatest(F.col("_all") - F.col("w"), F.lit(1e-12)))
    at = F.struct("x", "id", "cdf")
    outer = [F.min(at).alias("least"), F.max(at).alias("most")]
    around = [e for i, q in enumerate(qs) for e in (F.max(F.when(F.col("cdf") < q, at)).alias(f"a{i}"), F.min(F.when(F.col("cdf") >= q, at)).alias(f"b{i}"))]
    got = cdf.groupBy("k").agg(*outer, *around)
    out = []
    for i, q in enumerate(qs):
        a, b = F.coalesce(f"a{i}", f"b{i}"), F.coalesce(f"b{i}", "most")
        t = (q - a["cdf"]) / F.greatest(b["cdf"] - a["cdf"], F.lit(1e-12))
        mid = a["x"] + F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * (b["x"] - a["x"])
        value = F.when(F.col("most.cdf") <= q, F.col("most.x")).when(F.col("least.cdf") >= q, F.col("least.x")).otherwise(mid)
        out.append(F.struct(F.lit(float(q)).alias("q"), value.alias("value")))
    each = got.select("k", F.explode(F.array(*out)).alias("r"))
    return each.select("r.*") if key is None else each.select(F.col("k").alias(key), "r.*")
