"""The engine's calls over a workspace of tables: sources, runs, tokens and masks."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.jobs import TableCache
from veldra.operators import catalog, pca
from veldra.sources.versions import Conflict, EventTable, NotFound
from veldra.streaming import runs as states

__all__ = ["BadRequest", "Conflict", "Engine", "NotFound", "Unprocessable"]


class BadRequest(ValueError):
    """A payload of the wrong form."""


class Unprocessable(ValueError):
    """Points out of bounds, or too little foreground."""


@dataclass
class Engine:
    """A workspace. Tables are replaced, never changed in place; changes of one run exclude each other."""

    spark: SparkSession
    sources: DataFrame
    runs: DataFrame
    tokens: DataFrame
    bases: dict[str, pca.Basis] = field(default_factory=dict)
    cache: TableCache = field(default_factory=TableCache)
    active: set = field(default_factory=set)
    _busy: set = field(default_factory=set)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def models(self) -> DataFrame:
        from veldra.queries_catalog import models

        return models(self.spark)

    def list_sources(self) -> DataFrame:
        return self.sources

    def events(self, feed: EventTable, seen: dict | None = None) -> DataFrame:
        """The last state of each group of a feed whose rev is beyond the one seen."""
        last = feed.read(states.STATES).groupBy("group").agg(F.max_by(F.struct("status", "running", "failed", "done"), "rev").alias("s"), F.max("rev").alias("rev")).select("group", "rev", "s.*")
        old = self.spark.createDataFrame(list((seen or {}).items()), "group bigint, rev bigint")
        return last.join(old.withColumnRenamed("rev", "_seen"), "group", "left").where("rev > coalesce(_seen, 0)").drop("_seen")

    def flush(self) -> int:
        """Gives what is held in memory back; returns how many tables that were."""
        return self.cache.flush()

    def ingest(self, new: DataFrame) -> DataFrame:
        """Adds sources that aren't known yet (source_id, name)."""
        self.sources = catalog.registered(self.sources, new, "source_id", "name")
        return self.sources

    def workspace(self) -> DataFrame:
        return catalog.workspace(self.sources, self.runs, self._ids(self.active))

    def fit(self, run_id: str, source_ids: list, *, l2norm: bool = False) -> DataFrame:
        """One basis for the sources, each with an equal share; returns their tokens' colours. The tokens stay in the cache
        for the run's refinements."""
        mine = self.cache.get(run_id, tuple(source_ids), lambda: self.tokens.where(F.col("source").isin(source_ids)))
        if mine.isEmpty():
            raise NotFound(f"no features of {source_ids}")
        share = pca.equal_share(mine, "source", "vec_id") if len(source_ids) > 1 else mine
        self.bases[run_id] = pca.fit(share, l2norm=l2norm)
        return pca.coloured(mine, self.bases[run_id])

    def rgb(self, run_id: str) -> DataFrame:
        return pca.coloured(self.tokens, self._basis(run_id))

    def refit(self, run_id: str, weights: DataFrame) -> DataFrame:
        """The run's basis again over its foreground; weights has vec_id and w. An error leaves the old basis."""
        with self._changing(run_id):
            rows = self.tokens.join(weights.select("vec_id", "w"), "vec_id")
            try:
                self.bases[run_id] = pca.refit(rows, self._basis(run_id), weight="w")
            except ValueError as e:
                raise Unprocessable(str(e)) from e
            return pca.coloured(self.tokens, self.bases[run_id])

    def apply_mask(self, run_id: str, weights: DataFrame) -> DataFrame:
        """The run's colours with what is no foreground in black; a token without a mask counts as foreground."""
        rgb = self.rgb(run_id).join(weights.select("vec_id", F.col("w").alias("_w")), "vec_id", "left")
        keep = F.coalesce(F.col("_w"), F.lit(1.0))
        return rgb.withColumns({c: F.col(c) * keep for c in "rgb"}).drop("_w")

    def delete_source(self, source_id) -> None:
        if self.active:
            raise Conflict("a run is active")
        gone = self.sources.where(F.col("source_id") == source_id).select("source_id")
        if gone.isEmpty():
            raise NotFound(f"no source {source_id}")
        if not self.runs.join(gone, "source_id", "left_semi").join(self._ids(self._busy), "run_id", "left_semi").isEmpty():
            raise Conflict(f"a run of source {source_id} is being changed")
        self.runs = catalog.without_sources(self.runs, gone, self._ids(set()))
        self.sources = self.sources.join(gone, "source_id", "left_anti")

    def clear(self) -> int:
        """Deletes all runs but the active and those being changed; returns how many."""
        out = catalog.cleared(self.runs, self._ids(self.active), self._ids(self._busy))
        n = out.where("deleted").count()
        self.runs = out.where("not deleted").drop("deleted")
        return n

    def _ids(self, ids: set) -> DataFrame:
        kind = dict(self.runs.dtypes)["run_id"]
        return self.spark.createDataFrame([(i,) for i in ids], f"run_id {kind}")

    def _basis(self, run_id: str) -> pca.Basis:
        if run_id not in self.bases:
            raise NotFound(f"no run {run_id}")
        return self.bases[run_id]

    def _changing(self, run_id: str):
        engine = self

        class Guard:
            def __enter__(self):
                with engine._lock:
                    engine._basis(run_id)
                    if run_id in engine.active or run_id in engine._busy:
                        raise Conflict(f"run {run_id} is busy")
                    engine._busy.add(run_id)

            def __exit__(self, *_):
                engine._busy.discard(run_id)

        return Guard()
