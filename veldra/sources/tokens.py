"""Token tables: one row for each grid cell of each frame of a source, with its feature vector."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra.functions.vectors import as_double

#: parts that the values of an order are cut into, to number the rows of a key
RANGES = 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def numbered(df: DataFrame, key: str, order: str | list[str], name: str = "k", width: int | None = None) -> DataFrame:
    """Each row's place (from 0) within its key by its order, without a window over a whole key.

    The values of the first order, whole numbers, are cut into ranges; a row's place counts the rows in lower ranges, summed from
    one count for each key and range, and those before it in its own. So a key that holds a third of the rows is
    numbered by many tasks. Without a width, ranges are those of RANGES equal parts of all values. Nulls come first.
    """
    order = [order] if isinstance(order, str) else order
    width, low = (width, 0) if width else span(df, order[0])
    at = df.withColumn("_range", F.floor((F.col(order[0]) - low) / width))
    per = at.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    below = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_first"))
    own = at.withColumn("_nth", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)))
    both = own.join(per, own[key].eqNullSafe(per._key) & own._range.eqNullSafe(per._at))
    return both.withColumn(name, (F.col("_first") + F.col("_nth") - 1).cast("bigint")).drop("_range", "_nth", "_key", "_at", "_first")


def span(df: DataFrame, order: str) -> tuple[int, int]:
    """The width of RANGES equal parts of a column's values, and the least value."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    return (1, 0) if low is None else (max(1, -(-(int(high) - int(low) + 1) // RANGES)), int(low))


def tokens(embeddings: DataFrame, side: int = 4) -> DataFrame:
    """Vectors as tokens: source, frame, row, col, vec_id, feat; each source's vectors fill frames of side x side."""
    k = numbered(embeddings.select(F.col("label").alias("source"), "vec_id", as_double("embedding").alias("feat")), "source", "vec_id")
    cell = side * side
    return k.select(
        F.col("source").cast("bigint").alias("source"), F.floor(F.col("k") / cell).alias("frame"), F.floor(F.col("k") % cell / side).alias("row"),
        (F.col("k") % side).alias("col"), "vec_id", "feat",
    )


def packed_bits(content: Column, n: int) -> Column:
    """The first n bits of a binary column, most significant first, as booleans."""
    text = F.hex(content)
    digit = lambda i: F.conv(F.substring(text, (F.floor(i / 4) + 1).cast("int"), F.lit(1)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: digit(i).bitwiseAND(F.pow(F.lit(2), 3 - i % 4).cast("int")) > 0)


def sources_of(files: DataFrame) -> DataFrame:
    """Content-addressed sources of binary files: (source_id, name, ext, size); equal bytes once, empty ones never.
    Unknown endings become mp4."""
    return _sources(files.select("path", "length", F.sha2("content", 256).alias("digest")))


def scanned(spark: SparkSession, path: str, large: int = 64 << 20) -> DataFrame:
    """The sources of all files of a path. Files of more bytes than `large` never become a row's content: a task each
    hashes them as a stream."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= large).select("path", "length", F.sha2("content", 256).alias("digest"))
    names = files.where(F.col("length") > large).select("path", "length").repartition(4 * spark.sparkContext.defaultParallelism, "path")
    return _sources(small.unionByName(names.mapInPandas(_streamed, "path string, length bigint, digest string")))


def _streamed(frames):
    for f in frames:
        f["digest"] = [streamed_digest(p) for p in f["path"]]
        yield f[["path", "length", "digest"]]


def streamed_digest(path: str) -> str:
    from urllib.parse import unquote

    from veldra.sources.features import filesystem

    fs, at = filesystem(path)
    with fs.open_input_stream(unquote(at) if path.startswith("file:") else at) as f:
        digest = hashlib.sha256()
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def _sources(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    known = F.when(ext.isin("mp4", "mov", "webm", "mkv", "avi", "m4v"), ext).otherwise("mp4")
    rows = files.where("length > 0").select(F.substring("digest", 1, 16).alias("source_id"), name.alias("name"), known.alias("ext"), F.col("length").alias("size"))
    return rows.groupBy("source_id").agg(F.min_by(F.struct("name", "ext", "size"), "name").alias("s")).select("source_id", "s.*")
