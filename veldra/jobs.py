"""Concurrent actions of which the first error ends all, a queue of jobs that run one by one, and a bounded cache."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from veldra.sources.versions import Store


class Cancelled(RuntimeError):
    """The group was cancelled from outside."""


class Group:
    """Actions that run side by side. The first that fails cancels the Spark jobs of the others, and its error is the
    one that is raised."""

    def __init__(self, spark: SparkSession):
        self.sc, self.tag = spark.sparkContext, f"veldra-{uuid.uuid4().hex}"
        self.error: BaseException | None = None
        self._lock = threading.Lock()

    def fail(self, error: BaseException) -> None:
        """Notes an error, if it is the first, and stops what is running."""
        with self._lock:
            if self.error is not None:
                return
            self.error = error
        self.sc.cancelJobsWithTag(self.tag)

    def cancel(self) -> None:
        self.fail(Cancelled(self.tag))

    def check(self) -> None:
        """For actions between their jobs: raises if the group has failed."""
        if self.error is not None:
            raise self.error

    def run(self, *actions: Callable[[], object]) -> list:
        """The results of all actions."""
        out: list = [None] * len(actions)

        def one(i: int, action: Callable[[], object]) -> None:
            self.sc.addJobTag(self.tag)
            try:
                self.check()
                out[i] = action()
            except BaseException as e:
                self.fail(e)
            finally:
                self.sc.removeJobTag(self.tag)

        threads = [InheritableThread(target=one, args=(i, a)) for i, a in enumerate(actions)]
        for t in threads:
            t.start()
        for t in threads:
            while t.is_alive():
                t.join(0.2)
                if self.error is not None:  # a job that began between the cancellation and its thread's end
                    self.sc.cancelJobsWithTag(self.tag)
        self.check()
        return out


class JobQueue(Store):
    """Jobs in the order in which they were handed in, one at a time over all sessions. The queue lies in a folder: what
    was handed in stays when a driver ends, and another takes it on.

    A handler gets the job's arguments; its Spark jobs go to the scheduler pool of the queue, so what is interactive
    can have a pool of its own.
    """

    def __init__(self, spark: SparkSession, path: str, handlers: dict[str, Callable[[dict], object]], pool: str = "runs"):
        super().__init__(spark, path)
        self.handlers, self.pool = handlers, pool

    def submit(self, kind: str, **arguments) -> int:
        if kind not in self.handlers:
            raise ValueError(f"no handler for {kind!r}")
        text = json.dumps({"kind": kind, "arguments": arguments})
        number = max((int(n) for n in self.names("jobs")), default=0) + 1
        while not self.put_if_absent(f"jobs/{number:012d}", text):
            number += 1
        return number

    def waiting(self) -> list[int]:
        done = set(self.names("done"))
        return sorted(int(n) for n in self.names("jobs") if n not in done)

    def outcome(self, number: int) -> dict | None:
        return json.loads(self.read_text(f"done/{number:012d}")) if self.exists(f"done/{number:012d}") else None

    def step(self) -> int | None:
        """Runs the first job that isn't done; None if there is none or someone is at it."""
        waiting = self.waiting()
        if not waiting or not self.put_if_absent(f"claims/{waiting[0]:012d}", str(time.time())):
            return None
        name = f"{waiting[0]:012d}"
        if self.exists(f"done/{name}"):  # it ended between the two looks
            return None
        job = json.loads(self.read_text(f"jobs/{name}"))
        sc = self.spark.sparkContext
        before = sc.getLocalProperty("spark.scheduler.pool")
        sc.setLocalProperty("spark.scheduler.pool", self.pool)
        try:
            self.handlers[job["kind"]](job["arguments"])
            said = {"status": "done"}
        except Exception as e:
            said = {"status": "error", "error": f"{type(e).__name__}: {e}"[:2000]}
        finally:
            sc.setLocalProperty("spark.scheduler.pool", before)
        self.put_if_absent(f"done/{name}", json.dumps(said))
        return waiting[0]

    def drain(self) -> list[int]:
        """Runs jobs until none is left or another session has one."""
        out = []
        while (n := self.step()) is not None:
            out.append(n)
        return out

    def release(self, number: int) -> None:
        """Gives a job free whose session has ended before it did."""
        self.delete(f"claims/{number:012d}")


class TableCache:
    """Persisted tables under keys, `most` at most: the one used longest ago gives way. An entry holds for the signature
    that it was made under, and is made anew under another."""

    def __init__(self, most: int = 2):
        self.most, self._held = most, OrderedDict()
        self._lock = threading.Lock()

    def get(self, key: Hashable, signature: Hashable, make: Callable[[], DataFrame]) -> DataFrame:
        with self._lock:
            held = self._held.get(key)
            if held is not None and held[0] == signature:
                self._held.move_to_end(key)
                return held[1]
            if held is not None:
                self._held.pop(key)[1].unpersist()
            table = make().persist()
            self._held[key] = signature, table
            while len(self._held) > self.most:
                self._held.popitem(last=False)[1][1].unpersist()
            return table

    def drop(self, key: Hashable) -> None:
        with self._lock:
            if key in self._held:
                self._held.pop(key)[1].unpersist()

    def flush(self) -> int:
        """Empties the cache; returns how many entries it held."""
        with self._lock:
            n = len(self._held)
            while self._held:
                self._held.popitem()[1][1].unpersist()
            return n

    def keys(self) -> list:
        return list(self._held)
