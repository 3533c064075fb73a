"""The slot for a model that turns frames into features: one load for each worker, whole clips, batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clips(frames: DataFrame, key: str, pos: str, value: str, clip: int) -> DataFrame:
    """(key, clip, n, values): each run of `clip` frames of a key as one array of arrays, the last one filled up with its last
    frame; n is how many are its own. At most `clip` rows come together."""
    rows = frames.groupBy(key, F.floor(F.col(pos) / clip).alias("clip")).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("at"), F.col(value).alias("v")))).alias("own"))
    own = F.transform("own", lambda s: s["v"])
    return rows.select(key, "clip", F.size("own").alias("n"), F.concat(own, F.array_repeat(F.element_at(own, -1), clip - F.size("own"))).alias("values"))


def extracted(frames: DataFrame, model: Callable[[], Callable[[np.ndarray], np.ndarray]], *, key: str, pos: str, value: str, dim: int, clip: int, tubelet: int = 1, batch: int = 32) -> DataFrame:
    """(key, frame, feat): the model's features of each frame.

    model() is called once in each worker and returns a function from (clips, clip, dim) to (clips, clip / tubelet,
    features). Each of its steps is shown for `tubelet` frames; what fills up a clip gives no row.
    """

    def loaded():
        run = model()

        def predict(x: np.ndarray) -> np.ndarray:
            out = np.asarray(run(x.reshape(len(x), clip, dim)), np.float64)
            return out.reshape(len(out), -1)

        return predict

    udf = predict_batch_udf(loaded, return_type=T.ArrayType(T.DoubleType()), batch_size=batch, input_tensor_shapes=[[clip * dim]])
    c = clips(frames, key, pos, value, clip).withColumn("flat", F.flatten("values"))
    out = c.select(key, "clip", "n", udf("flat").alias("y")).withColumn("width", (F.size("y") / (clip // tubelet)).cast("int"))
    each = out.select(key, "clip", "n", "width", "y", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
    step = F.floor(F.col("slot") / tubelet).cast("int")
    return each.select(key, (F.col("clip") * clip + F.col("slot")).cast("bigint").alias("frame"), F.slice("y", step * F.col("width") + 1, F.col("width")).alias("feat"))
