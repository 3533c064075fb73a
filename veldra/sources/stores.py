"""JSON documents of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def readable(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON documents of a folder, a file each; those that can't be read are not there."""
    text = spark.read.text(path, wholetext=True)
    doc = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return text.select(doc.alias("d")).where("d is not null and d._bad is null").select("d.*").drop("_bad")
