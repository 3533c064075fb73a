"""States of runs and of their groups: a fold over a group's numbered events, as a batch and as a stream.

An event may set its run's status, its group's, or tell of an error. An error turns every run of the group that is
running then into one that has failed. A group's events are numbered from 1 on; a stream takes them in any order
and holds back those that come before their turn.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STATES = "group bigint, rev bigint, status string, running bigint, failed bigint, done bigint"


def run_states(events: DataFrame) -> DataFrame:
    """(group, run, status) of events (group, seq, run, run_status, sets, error): partial aggregates and one join on
    the group, whose last error is a row."""
    own = events.where("run_status is not null").groupBy("group", "run").agg(F.max(F.struct("seq", "run_status")).alias("last"))
    errors = events.where("error").groupBy("group").agg(F.max("seq").alias("failed_at"))
    both = own.join(errors, "group", "left")
    fails = (F.col("last.run_status") == "running") & (F.coalesce("failed_at", F.lit(0)) > F.col("last.seq"))
    return both.select("group", "run", F.when(fails, "error").otherwise(F.col("last.run_status")).alias("status"))


def group_states(events: DataFrame) -> DataFrame:
    """STATES now: how many events, the group's status, and its runs by status."""
    groups = events.groupBy("group").agg(F.count("*").alias("rev"), F.coalesce(F.max_by("sets", F.when(F.col("sets").isNotNull(), F.col("seq"))), F.lit("queued")).alias("status"))
    many = [F.count_if(F.col("status") == s).alias(n) for s, n in (("running", "running"), ("error", "failed"), ("done", "done"))]
    runs = run_states(events).groupBy("group").agg(*many)
    return groups.join(runs, "group", "left").fillna(0, ["running", "failed", "done"]).select([c.split()[0] for c in STATES.split(", ")])


class Fold:
    """One group: its rev, its status, its runs and the events that wait for their turn."""

    def __init__(self, text: str | None = None):
        self.rev, self.status, self.runs, self.waiting = json.loads(text) if text else (0, "queued", {}, {})

    def text(self) -> str:
        return json.dumps([self.rev, self.status, self.runs, self.waiting])

    def take(self, seq: int, event: list) -> Iterator[tuple]:
        """Takes an event; gives (rev, status, running, failed, done) for each whose turn has come. Repeats are dropped."""
        if seq > self.rev:
            self.waiting.setdefault(str(seq), event)
        while (event := self.waiting.pop(str(self.rev + 1), None)) is not None:
            run, run_status, sets, error = event
            self.rev += 1
            if run_status is not None:
                self.runs[str(run)] = run_status
            if error:
                self.runs = {r: "error" if s == "running" else s for r, s in self.runs.items()}
            self.status = sets or self.status
            states = list(self.runs.values())
            yield (self.rev, self.status, *map(states.count, ("running", "error", "done")))


class GroupFold(StatefulProcessor):
    """The fold with a group's state in the state store."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("fold", "text string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        fold = Fold(self.state.get()[0] if self.state.exists() else None)
        out = []
        for frame in rows:
            for seq, *event in frame[["seq", "run", "run_status", "sets", "error"]].astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None):
                event = [None if event[0] is None else int(event[0]), event[1], event[2], bool(event[3])]
                out += [(key[0], *s) for s in fold.take(int(seq), event)]
        self.state.update((fold.text(),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])

    def close(self) -> None:
        pass


def stream_states(events: DataFrame) -> DataFrame:
    """STATES after each event of a stream, once and in each group's order. The session's state store must be one
    for states of this kind (RocksDB); see `session`."""
    return events.groupBy("group").transformWithStateInPandas(GroupFold(), STATES, "append", "none")


def session(spark):
    """A session on the same cluster whose streams may hold such states; the caller's own settings stay."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own
