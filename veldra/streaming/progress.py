"""Progress events and login attempts: folds over ordered events, in batches and as streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.sources.tokens import span

TRIES, LONGEST = 5, 300.0
DECISIONS = "ip bigint, event_id bigint, outcome string, fails bigint, locked_until double"


def running(events: DataFrame, keys: list[str], order: list[str], **sums: Column) -> DataFrame:
    """Events with running aggregates of their key, each by name: a Column is summed up. The values of the first order, whole numbers,
    are cut into ranges: what is before a range comes from one row for each key and range, the rest from a window
    within it, so a hot key is spread over many tasks."""
    width, low = span(events, order[0])
    at = events.withColumn("_range", F.floor((F.col(order[0]) - low) / width))
    own = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    per = at.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r")).agg(*[F.sum(c).alias(f"_s{n}") for n, c in sums.items()])
    per = per.select(*[f"_k{i}" for i in range(len(keys))], "_r", *[F.coalesce(F.sum(f"_s{n}").over(before), F.lit(0)).alias(f"_b{n}") for n in sums])
    out = at.withColumns({f"_o{n}": F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    same = F.col("_range").eqNullSafe(F.col("_r"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return out.join(per, same).select(*events.columns, *[(F.col(f"_o{n}") + F.col(f"_b{n}")).alias(n) for n in sums])


def statuses(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each event with its group's rev (how many events so far) and status after it. `sets` is the status that an
    event sets, null if none; a group without one yet is queued. The status is that of the last event which sets
    one: its number is counted up, and its row found by that."""
    told = F.col("sets").isNotNull().cast("bigint")
    at = running(events, [key], order, rev=F.lit(1), _nth=told)
    sets = at.where("sets is not null").select(F.col(key).alias("_key"), F.col("_nth").alias("_at"), F.col("sets").alias("_sets"))
    out = at.join(sets, at[key].eqNullSafe(sets._key) & (at._nth == sets._at), "left")
    return out.select(*events.columns, "rev", F.coalesce("_sets", F.lit("queued")).alias("status"))


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each group's rev and status now: partial aggregates, no order needed but the largest."""
    at = F.struct(*order)
    last = F.max_by("sets", F.when(F.col("sets").isNotNull(), at))
    return events.groupBy(key).agg(F.count("*").alias("rev"), F.coalesce(last, F.lit("queued")).alias("status"))


def changed(now: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Groups whose rev is beyond the last one seen (none seen: 0)."""
    s = seen.select(key, F.col("rev").alias("_seen"))
    return now.join(s, key, "left").where("rev > coalesce(_seen, 0)").drop("_seen")


def ticks(events: DataFrame, key: str, order: list[str], done: str, total: str) -> DataFrame:
    """Progress of the two counted phases: 0.05 + 0.50 d / N while extracting, 0.62 + 0.36 d / N while rendering."""
    at = running(events, [key, "phase"], order, _done=F.col(done))
    part = F.col("_done") / F.col(total)
    return at.withColumn("progress", F.when(F.col("phase") == "extract", 0.05 + 0.50 * part).otherwise(0.62 + 0.36 * part)).drop("_done")


class Throttle:
    """One address's failures: from the fifth on, each locks for 2 ** (failures - 5) seconds, 300 at most; attempts
    during a lock are refused and don't count; a success clears all."""

    def __init__(self, fails: int = 0, until: float = 0.0):
        self.fails, self.until = fails, until

    def attempt(self, t: float, ok: bool) -> str:
        if self.until > t:
            return "refused"
        if ok:
            self.fails, self.until = 0, 0.0
            return "ok"
        self.fails += 1
        if self.fails >= TRIES:
            self.until = t + min(2.0 ** min(self.fails - TRIES, 64), LONGEST)
        return "failed"


def throttled(attempts: DataFrame) -> DataFrame:
    """DECISIONS for attempts (ip, event_id, t, ok), by time, then event_id. Attempts of an address come to its task
    in order and in batches, so one address's history need not fit in memory."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        state, at = Throttle(), None
        for b in batches:
            rows = []
            for ip, e, t, ok in b[["ip", "event_id", "t", "ok"]].itertuples(index=False, name=None):
                if ip != at:
                    state, at = Throttle(), ip
                rows.append((ip, e, state.attempt(t, bool(ok)), state.fails, state.until))
            yield pd.DataFrame(rows, columns=["ip", "event_id", "outcome", "fails", "locked_until"])

    dealt = attempts.repartition("ip").sortWithinPartitions("ip", "t", "event_id")
    return dealt.mapInPandas(run, DECISIONS)


def stream_throttled(attempts: DataFrame) -> DataFrame:
    """The same on a stream, with each address's failures kept as state."""

    def run(key, batches, state):
        import pandas as pd

        s = Throttle(*state.get) if state.exists else Throttle()
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        out = []
        for e, t, ok in rows[["event_id", "t", "ok"]].itertuples(index=False, name=None):
            out.append((key[0], e, s.attempt(t, bool(ok)), s.fails, s.until))
        state.update((s.fails, s.until))
        yield pd.DataFrame(out, columns=["ip", "event_id", "outcome", "fails", "locked_until"])

    return attempts.groupBy("ip").applyInPandasWithState(run, DECISIONS, "fails bigint, until double", "append", "NoTimeout")
