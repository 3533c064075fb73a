"""Frames as whole rasters: a grid's colours upsampled, masked and baked into bytes by matrix products in a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AT_ONCE = 8  # frames that are floating-point rasters at a time


def shares(n: int, out: int) -> np.ndarray:
    """What each of n cells gives to each of `out` pixels of a bilinear raster, corners not aligned: (out, n)."""
    at = np.clip((np.arange(out) + 0.5) * n / out - 0.5, 0, n - 1)
    return np.maximum(1 - np.abs(at[:, None] - np.arange(n)[None]), 0)


def _baked(keys: list[str], gh: int, gw: int, oh: int, ow: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        down, across = shares(gh, oh), shares(gw, ow)
        for batch in batches:
            out, cells, masks = [], batch.column("cells"), batch.column("mask")
            for i in range(0, batch.num_rows, AT_ONCE):
                part = cells.slice(i, AT_ONCE)
                frame = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
                flat = part.flatten()
                row, col = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("row", "col"))
                grid = np.zeros((len(part), gh, gw, 3))
                grid[frame, row, col] = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "rgb"], 1)
                wide = across @ (down @ grid.reshape(len(part), gh, gw * 3)).reshape(len(part), oh, gw, 3)  # (frames, oh, ow, 3)
                for x, m in zip(wide, masks.slice(i, AT_ONCE).to_pylist()):
                    if m is not None:
                        x = x * np.unpackbits(np.frombuffer(m, np.uint8), count=oh * ow).reshape(oh, ow, 1)
                    out.append(np.rint(255 * np.clip(x, 0, 1)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.binary())], [*keys, "raster"])

    return run


def rasters(colours: DataFrame, masks: DataFrame | None, *, key: list[str], gh: int, gw: int, oh: int, ow: int) -> DataFrame:
    """(key, raster): each frame's oh x ow pixels as bytes of red, green and blue, row by row.

    colours: (key, row, col, r, g, b), a row for each cell of the grid; a cell that is missing is black. masks: (key,
    mask), packed bits of the pixels, most significant first; a frame without one is all foreground. A frame's cells,
    gh x gw at most, come together; no row stands for a pixel.
    """
    cell = F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(c).cast("double").alias(c) for c in "rgb"])
    frames = colours.groupBy(*key).agg(F.collect_list(cell).alias("cells"))
    frames = frames.withColumn("mask", F.lit(None).cast("binary")) if masks is None else frames.join(masks.select(*key, "mask"), key, "left")
    schema = T.StructType([*(frames.schema[k] for k in key), T.StructField("raster", T.BinaryType())])
    return frames.mapInArrow(_baked(key, gh, gw, oh, ow), schema)
