"""Packing documents into sequences of at most a given number of tokens, by exact-complement hashing.

Only lengths decide a packing, so it is planned on the histogram of lengths, which has at most as many rows as a
sequence has tokens, however large the corpus. Each step plans one pattern of lengths: the longest length left opens
it; while a single length, a pair or a triple that is still available fills the gap exactly, it closes the pattern,
and otherwise the longest length that fits goes in (best fit). The pattern is used as often as its scarcest length
allows, which uses up a length: so there are at most as many patterns as lengths. Documents then find their places
by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra.llm.common import materialize, pick, table, tidy
from veldra.llm.word_bpe import default_path, encoder

CAPACITY = 4096
BUCKETS = 256
#: words a worker's dictionary holds, and where later stages or tasks get none of it
CACHE_WORDS, LEAN_WORDS = 500_000, 100_000

PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Gaps:
    """Which gaps single lengths, pairs and triples of available lengths fill exactly."""

    def __init__(self, counts: np.ndarray):
        self.left, self.size = counts, len(counts)
        self.sums: np.ndarray | None = None

    def changed(self) -> None:
        self.sums = None

    def pair_sums(self) -> np.ndarray:
        """For each gap, whether two available lengths might make it (a length alone may count twice)."""
        if self.sums is None:
            n = 1 << (2 * self.size - 1).bit_length()
            f = np.fft.rfft((self.left > 0).astype(float), n)
            self.sums = np.fft.irfft(f * f, n)[: self.size] > 0.5
        return self.sums

    def pair(self, gap: int, free: np.ndarray) -> list[int] | None:
        low = np.arange(1, gap // 2 + 1)
        ok = (free[low] > 0) & (free[gap - low] > 0)
        if gap % 2 == 0 and len(low) and free[gap // 2] < 2:
            ok[-1] = False
        at = np.flatnonzero(ok)
        return [gap - int(low[at[0]]), int(low[at[0]])] if len(at) else None

    def fill(self, gap: int, free: np.ndarray) -> list[int] | None:
        """One, two or three lengths that make up the gap, the longest possible first; None if there are none."""
        if free[gap] > 0:
            return [gap]
        sums = self.pair_sums()
        if sums[gap] and (got := self.pair(gap, free)):
            return got
        for a in range(gap - 2, (gap - 1) // 3, -1):
            if free[a] > 0 and sums[gap - a]:
                free[a] -= 1
                got = self.pair(gap - a, free)
                free[a] += 1
                if got:
                    return [a, *got]
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how often, lengths) of each pattern; uses every counted length up. Lengths are 1 to capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        if not 1 <= k <= capacity:
            raise ValueError(f"a length of {k} doesn't fit {capacity}")
        left[k] = v
    gaps, out = Gaps(left), []
    while left.any():
        free = left.copy()
        gap, lengths = capacity, []
        while gap:
            exact = gaps.fill(gap, free) if lengths else None
            if exact:
                for a in exact:
                    free[a] -= 1
                lengths += exact
                break
            fits = np.flatnonzero(free[1 : gap + 1])
            if not len(fits):
                break
            a = int(fits[-1]) + 1
            free[a] -= 1
            lengths.append(a)
            gap -= a
        used = Counter(lengths)
        times = min(int(left[a]) // n for a, n in used.items())
        for a, n in used.items():
            left[a] -= times * n
        gaps.changed()
        out.append((times, lengths))
    return out


def places(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Ranges of ranks within a length and the places they get: sorted by length and first rank.

    At most one range for each pattern and distinct length in it: under 90 for each of at most 4096 patterns.
    """
    rows, given, sequence = [], Counter(), 0
    for times, lengths in patterns:
        offset = 0
        for a, n in sorted(Counter(lengths).items(), reverse=True):
            rows.append((a, given[a], times, sequence, offset))
            given[a] += times * n
            offset += a * n
        sequence += times
    got = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "times", "sequence", "offset"), got.T.copy()))


def _pieces(path: str, end_id: int, capacity: int, hold_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        enc.cache_words = CACHE_WORDS if hold_words else LEAN_WORDS
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            of = iter(keys)
            for some in enc.encoded(texts):
                rows = []
                for ids in some:
                    key, ids = next(of), ids + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((key, k, k * capacity, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])
        if not hold_words:
            enc.forget()

    return run


def _placed(at: dict[str, np.ndarray], step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = at["length"] * step + at["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(first, length * step + rank, side="right") - 1
            nth = rank - at["rank"][i]
            sequence = at["sequence"][i] + nth % at["times"][i]
            offset = at["offset"][i] + nth // at["times"][i] * length
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def token_pieces(docs: DataFrame, path: str | None = None, *, capacity: int = CAPACITY, end_id: int = 1, hold_words: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents' ids, closed by end_id, cut into pieces of at most capacity ids: PIECES_SCHEMA. A task hands its
    dictionary of words on to the worker's next, unless hold_words is off; the dictionary is then a small one, too."""
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(tidy(_pieces(path or default_path(), end_id, capacity, hold_words)), PIECES_SCHEMA)


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """Gives each piece (columns as in PIECES_SCHEMA, lengths from 1 to capacity) a sequence and a place in it.

    A piece's rank within its length counts the pieces of the length in lower buckets and those before it in its own;
    buckets are hashes of document and piece, so a length that a third of all rows share is ranked by many tasks.
    Repeated rows are pieces of their own; null ids are packed like any other; an empty table gives an empty one.
    """
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    dealt = materialize(dealt, "pieces")
    held = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    held = materialize(held, "lengths")  # at most capacity x buckets rows
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    step = max(counts.values(), default=0) + 1
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = held.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(own) - 1).join(first, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placed(places(plan(counts, capacity)), step), PIECES_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Encodes documents (null texts: empty), cuts the long ones and packs all pieces."""
    return pack(token_pieces(docs, path, **kw), capacity=kw.get("capacity", CAPACITY))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
