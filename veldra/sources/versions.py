"""Tables in numbered versions, and tables of events that batches are added to once.

A version is data in a folder of its own and a pointer with its number. Pointers are put where none is: of two writers
that go for the same number one gets it, the other a Conflict, in whatever sessions they run. Readers take the highest
pointer, so they see a whole version at any time; nothing is renamed away from under them.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Someone else has changed it meanwhile, or is at it."""


class NotFound(LookupError):
    """An unknown id, or something that isn't there."""


class Store:
    """A folder of any store that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.local = self.fs.getScheme() == "file"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def names(self, folder: str) -> list[str]:
        at = self.Path(self.at(folder))
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.Path(self.at(name)))

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self.Path(self.at(name)))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.Path(self.at(name)), True)

    def put_if_absent(self, name: str, text: str) -> bool:
        """A small file, written whole under another name first; False if the name is taken."""
        tmp = self.Path(self.at(f"_tmp/{uuid.uuid4().hex}"))
        out = self.fs.create(tmp, False)
        out.write(text.encode())
        out.close()
        to = self.Path(self.at(name))
        self.fs.mkdirs(to.getParent())
        try:
            if self.local:  # a link fails where the name is taken; a local rename wouldn't
                os.link(tmp.toUri().getPath(), to.toUri().getPath())
                return True
            return bool(self.fs.rename(tmp, to))
        except FileExistsError:
            return False
        finally:
            self.fs.delete(tmp, False)


class Versions(Store):
    """A table whose content is replaced, never changed in place."""

    def number(self) -> int:
        """The current version, 0 if there is none."""
        return max((int(n) for n in self.names("_versions") if n.isdigit()), default=0)

    def folder(self, number: int | None = None) -> str:
        number = self.number() if number is None else number
        if not number or not self.exists(f"_versions/{number:012d}"):
            raise NotFound(f"{self.path} has no version {number or ''}".rstrip())
        return self.read_text(f"_versions/{number:012d}")

    def read(self, number: int | None = None, schema: str | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.at(self.folder(number)))

    def replace(self, df: DataFrame, base: int | None = None) -> int:
        """Writes a version that follows `base` (the current one at the call) and returns its number. A write that
        fails, or that comes second, leaves the table as it is and nothing of its own."""
        base = self.number() if base is None else base
        data = f"data-{uuid.uuid4().hex}"
        try:
            df.write.parquet(self.at(data))
            if base != self.number() or not self.put_if_absent(f"_versions/{base + 1:012d}", data):
                raise Conflict(f"{self.path} is beyond version {base}")
        except BaseException:
            self.delete(data)
            raise
        return base + 1

    def change(self, function: Callable[[DataFrame], DataFrame]) -> int:
        """A version made from the current one."""
        base = self.number()
        return self.replace(function(self.read(base)), base)

    def clean(self, keep: int = 2) -> None:
        """Deletes all but the last versions, which readers may still hold."""
        for n in sorted(int(n) for n in self.names("_versions") if n.isdigit())[:-keep]:
            self.delete(self.folder(n))
            self.delete(f"_versions/{n:012d}")


class EventTable(Store):
    """Rows that batches of a stream are added to, each batch once however often it is sent."""

    def add(self, batch: DataFrame, number: int) -> bool:
        """Adds a numbered batch; False if it is there. What an attempt that broke off has left is never read."""
        pointer = f"_batches/{number:012d}"
        if self.exists(pointer):
            return False
        data = f"data-{number:012d}-{uuid.uuid4().hex}"
        batch.write.parquet(self.at(data))
        if self.put_if_absent(pointer, data):
            return True
        self.delete(data)
        return False

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch. A batch that is there already is worked through all the same: states are only kept of batches
        that are."""

        def take(batch: DataFrame, number: int) -> None:
            if not self.add(batch, number):
                batch.write.format("noop").mode("overwrite").save()

        return take

    def read(self, schema: str) -> DataFrame:
        paths = [self.at(self.read_text(f"_batches/{n}")) for n in sorted(self.names("_batches")) if re.fullmatch(r"\d+", n)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
