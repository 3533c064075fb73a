"""Hard-negative mining over an inverted multi-index.

Vectors are split into halves, and each half has a codebook of its own; a pair of codewords is a cell. A query's
score with any vector of a cell is at most the sum of two half-scores, each the codeword's product with the query's
half and the radius of the codeword's members times that half's length; it is at least the same with the radii taken
off. A heap visits the cells of a block by falling sums of bounds (multi-sequence order). It stops once every window
of scores that is asked for is certified: no cell left can hold a score that belongs into it.

Rows are indexed in blocks sorted by cell; hot cells are spread over blocks by the rows' hashes. Anchors come in waves
of a bounded number, each against all blocks, first for their positives, then for the windows that these set.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra.llm.common import drop_path, hash_sample, materialize, new_path, pick, shuffle_width, table

SAMPLE, WORDS, BLOCK, WAVE = 4096, 16, 4096, 4096
ENOUGH = 1024  # rows of cells that are multiplied at once
LEAST, MOST = -(1 << 62), 1 << 62
FOUND = "wave long, anchor long, window int, vec_id long, score long"


def labelled(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int, moved: int, labels: int) -> DataFrame:
    """(vec_id, label, v): floor(scale * component) and the label, moved on by one where the id is divisible by
    `moved`. Rows without an id or a label, and null, empty or not wholly finite vectors are left out."""
    v = pick(vectors, vec_id=id_col, e=vec_col, label=label_col)
    whole = "vec_id is not null and label is not null and e is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('Infinity'))"
    own = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % moved == 0, (own + 1) % labels).otherwise(own)
    return v.where(whole).select(F.col("vec_id").cast("long"), label.alias("label"), F.transform("e", lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"))


def codewords(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """A codebook of at most k words: Lloyd's algorithm from rows far apart."""
    x = x.astype(float)
    words, far = [x[0]], ((x - x[0]) ** 2).sum(1)
    while len(words) < k and far.max() > 0:
        words.append(x[int(far.argmax())])
        far = np.minimum(far, ((x - words[-1]) ** 2).sum(1))
    words = np.array(words)
    for _ in range(rounds):
        own = nearest(x, words)
        n = np.bincount(own, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, own, x)
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words)
    return words


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1)[None] - 2 * (x.astype(float) @ words.T)).argmin(1)


class Book:
    """Codebooks of the halves for each dimension of a sample; any other dimension has one word, zero."""

    def __init__(self, sample: list[np.ndarray], words: int):
        self.of = {}
        for d in {len(v) for v in sample}:
            x = np.array([v for v in sample if len(v) == d])
            self.of[d] = tuple(codewords(h, words) if h.shape[1] else np.zeros((1, 0)) for h in (x[:, : d // 2], x[:, d // 2 :]))

    def halves(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        return self.of.get(d) or (np.zeros((1, d // 2)), np.zeros((1, d - d // 2)))

    def cells(self, x: np.ndarray) -> np.ndarray:
        first, second = self.halves(x.shape[1])
        cut = x.shape[1] // 2
        return nearest(x[:, :cut], first) * len(second) + nearest(x[:, cut:], second)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of rows whose vectors have one dimension, with their matrix."""
    col = batch.column("v")
    dims = np.diff(col.offsets.to_numpy())
    flat, at = col.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(dims)]
    cut = np.flatnonzero(np.r_[True, dims[1:] != dims[:-1], True])
    for a, b in zip(cut, cut[1:]):
        yield int(a), int(b), flat[at[a] : at[b]].reshape(b - a, -1)


def _with_cell(book):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = [book.value.cells(m[i : i + 4096]) for _, _, m in _runs(batch) for i in range(0, len(m), 4096)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(cell) if cell else np.zeros(0, np.int64))], [*batch.schema.names, "cell"])

    return run


BLOCKS = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("cells", pa.binary()), ("vectors", pa.binary())])


def _blocked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24  # a row's key is its block's number and its place in the block
        for batch in batches:
            ids, labels, cells = (batch.column(c).to_numpy(zero_copy_only=False).astype("<i8") for c in ("vec_id", "label", "cell"))
            for a, b, m in _runs(batch):
                for i in range(a, b, size):
                    j = min(b, i + size)
                    payload = (x[i:j].tobytes() for x in (ids, labels, cells))
                    row = dict(zip(BLOCKS.names, (m.shape[1], j - i, block, *payload, m[i - a : j - a].astype("<i8").tobytes())))
                    yield pa.RecordBatch.from_pylist([row], BLOCKS)
                    block += 1

    return run


class Block:
    """Rows of one dimension, sorted by cell: keys, ids, labels, cells, vectors."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, cells: np.ndarray, vectors: np.ndarray):
        self.keys, self.ids, self.labels, self.cells, self.vectors = keys, ids, labels, cells, vectors

    @classmethod
    def read(cls, row: dict) -> Block:
        ids, labels, cells = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "cells"))
        return cls((row["block"] << 16) + np.arange(row["n"]), ids, labels, cells, np.frombuffer(row["vectors"], "<i8").reshape(row["n"], row["dim"]))

    @classmethod
    def of_sample(cls, ids, labels, vectors: np.ndarray, book: Book) -> Block:
        cells = book.cells(vectors)
        order = np.argsort(cells, kind="stable")
        return cls(-1 - np.arange(len(order)), np.asarray(ids)[order], np.asarray(labels)[order], cells[order], vectors[order])


def _anchors(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block.read(row)
                at = np.flatnonzero(b.ids % every == 0)
                yield pa.RecordBatch.from_arrays([pa.array(b.keys[at]), pa.array(b.ids[at]), pa.array(b.labels[at]), pa.array(b.vectors[at].tolist(), pa.list_(pa.int64()))], ["anchor", "anchor_id", "label", "v"])

    return run


class Windows:
    """Anchors of one dimension, with the k best rows in each of their windows of scores among the rows of their own
    label (`same`) or of the others."""

    def __init__(self, keys, ids, labels, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.keys, self.ids, self.labels, self.q = keys, ids, labels, vectors
        self.low, self.high, self.same, self.k = low, high, same, k
        self.need = low.copy()  # no lower score is among the window's best
        self.found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.live = high >= low

    def start_from(self, sample: Block, book: Book) -> None:
        """A bound for each window from a sample of the rows: at least as good as the k-th best of all."""
        self.search(sample, book, by_id=True)
        self.found = {}

    def search(self, b: Block, book: Book, by_id: bool = False) -> None:
        """Searches a block. by_id: an anchor's own row is told by its id, not by its key."""
        if not len(self.keys) or not len(b.ids):
            return
        halves, cut = book.halves(self.q.shape[1]), self.q.shape[1] // 2
        own = np.divmod(b.cells, len(halves[1]))
        most, least, names = [], [], []
        for h, (words, part) in enumerate(zip(halves, (slice(0, cut), slice(cut, None)))):
            seen, at = np.unique(own[h], return_inverse=True)
            radius = np.zeros(len(seen))
            np.maximum.at(radius, at, np.sqrt(((b.vectors[:, part] - words[own[h]]) ** 2).sum(1)))
            q = self.q[:, part].astype(float)
            mid, reach = q @ words[seen].T, np.sqrt((q**2).sum(1))[:, None] * radius[None]
            slack = 1e-9 * (np.abs(mid) + reach) + 1e-6
            most.append(mid + reach + slack)
            least.append(mid - reach - slack)
            names.append(at)
        span = np.zeros((most[0].shape[1], most[1].shape[1], 2), np.int64)
        edge = np.flatnonzero(np.r_[True, b.cells[1:] != b.cells[:-1]])
        span[names[0][edge], names[1][edge]] = np.c_[edge, np.r_[edge[1:], len(b.cells)]]
        top = float(np.abs(self.q).max(initial=0)) * float(np.abs(b.vectors).max(initial=0)) * self.q.shape[1]
        exact = (np.float32 if top < 2**24 else np.float64) if top < 2**53 else np.int64
        vectors, q = b.vectors.astype(exact), self.q.astype(exact)
        ahead = most[0].max(1) + most[1].max(1)
        floor = np.where(self.live, self.need, MOST).min(1)
        for a in np.flatnonzero(self.live.any(1) & (ahead >= floor)):
            self.visit(int(a), b, [x[a] for x in most], [x[a] for x in least], span, vectors, q[a], by_id)

    def visit(self, a: int, b: Block, most, least, span: np.ndarray, vectors: np.ndarray, q: np.ndarray, by_id: bool) -> None:
        order = [np.argsort(-x, kind="stable") for x in most]
        up, down, cells = [x[o].tolist() for x, o in zip(most, order)], [x[o].tolist() for x, o in zip(least, order)], span[order[0]][:, order[1]].tolist()
        live = self.live[a]
        high, floor = self.high[a][live].max(), self.need[a][live].min()
        heap, rows, n = [(-(up[0][0] + up[1][0]), 0, 0)], [], 0
        while heap:
            bound, i, j = heappop(heap)
            if -bound < floor:  # certified: nothing further on reaches a window
                break
            if j + 1 < len(up[1]):
                heappush(heap, (-(up[0][i] + up[1][j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(up[0]):
                heappush(heap, (-(up[0][i + 1] + up[1][0]), i + 1, 0))
            begin, end = cells[i][j]
            if begin == end or down[0][i] + down[1][j] > high:
                continue
            rows.append(np.arange(begin, end))
            n += end - begin
            if n >= ENOUGH:
                self.take(a, b, np.concatenate(rows), vectors, q, by_id)
                rows, n, floor = [], 0, self.need[a][live].min()
        if n:
            self.take(a, b, np.concatenate(rows), vectors, q, by_id)

    def take(self, a: int, b: Block, rows: np.ndarray, vectors: np.ndarray, q: np.ndarray, by_id: bool) -> None:
        """Products with some rows of a block; those that belong into a window stay."""
        s = (vectors[rows] @ q).astype(np.int64)
        ok = (b.labels[rows] == self.labels[a]) == self.same
        ok &= (b.ids[rows] != self.ids[a]) if by_id else (b.keys[rows] != self.keys[a])
        rows, s = rows[ok], s[ok]
        for w in np.flatnonzero(self.live[a]):
            hit = np.flatnonzero((s >= self.need[a, w]) & (s <= self.high[a, w]))
            if not len(hit):
                continue
            ids, score = self.found.get((a, w), (np.zeros(0, np.int64),) * 2)
            ids, score = np.r_[ids, b.ids[rows[hit]]], np.r_[score, s[hit]]
            best = np.lexsort((ids, -score))[: self.k]
            self.found[a, int(w)] = ids[best], score[best]
            if len(best) == self.k:
                self.need[a, w] = max(self.need[a, w], score[best[-1]])

    def rows(self, wave: int) -> pa.RecordBatch:
        many = [len(x[0]) for x in self.found.values()]
        key = np.repeat(self.keys[[a for a, _ in self.found]] if many else np.zeros(0, np.int64), many)
        window = np.repeat(np.array([w for _, w in self.found], np.int32), many)
        ids, score = (np.concatenate([x[k] for x in self.found.values()]) if many else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), wave)), *map(pa.array, (key, window, ids, score))], ["wave", "anchor", "window", "vec_id", "score"])


def _search(sent, wave: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, asked = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] in asked:
                    asked[row["dim"]].search(Block.read(row), book)
        for w in asked.values():
            yield w.rows(wave)
            w.found = {}  # the broadcast's copy may serve another task of this worker

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100, moved: int = 7, labels: int = 10, scale: int = 256, sample: int = SAMPLE, words: int = WORDS, block: int = BLOCK, wave: int = WAVE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor_row and positive_rank.

    Anchors are the rows whose id is divisible by `every`; their positives the `positives` other rows of the same label
    of the highest integer products; for each, the `negatives` highest rows of other labels whose products are from
    low to high hundredths of the positive's. Ties go to the smaller id. Rows of a repeated id are rows each, of
    each other too; anchor_row numbers an anchor id's rows by vector and label. Vectors of another dimension have no
    product. A positive whose window holds no row gives none; an empty table gives none.

    The codebooks and the first bounds come from at most `sample` rows, of the smallest hashes; every row is indexed and
    the result is exact. One wave of anchors, and the positives of one, are on the driver at a time.
    """
    if block > 1 << 16:
        raise ValueError("a block holds 65536 vectors at most")
    spark = vectors.sparkSession
    v = labelled(vectors, id_col, vec_col, label_col, scale, moved, labels)
    some = [(r["vec_id"], r["label"], np.array(r["v"], np.int64)) for r in hash_sample(v, F.xxhash64("vec_id", "v", "label"), sample, v.count()).collect()]
    book = Book([x[2] for x in some], words)
    samples = {d: Block.of_sample(*zip(*[(i, y) for i, y, x in some if len(x) == d]), np.array([x for _, _, x in some if len(x) == d]), book) for d in book.of}
    celled = v.mapInArrow(_with_cell(spark.sparkContext.broadcast(book)), "vec_id long, label long, v array<long>, cell long").withColumn("dim", F.size("v"))
    spread = F.xxhash64("vec_id", "v")
    dealt = celled.repartitionByRange(2 * shuffle_width(spark), "dim", "cell", spread).sortWithinPartitions("dim", "cell", "vec_id")
    blocks = materialize(dealt.select("vec_id", "label", "v", "cell").mapInArrow(_blocked(block), "dim int, n int, block long, ids binary, labels binary, cells binary, vectors binary"), "cells")
    own = Window.partitionBy("anchor_id").orderBy("v", "label", "anchor")
    anchors = materialize(blocks.mapInArrow(_anchors(every), "anchor long, anchor_id long, label long, v array<long>").withColumn("anchor_row", F.row_number().over(own)), "anchors")
    waves = max(1, -(-anchors.count() // wave))

    def windows(mine, lows, highs, same: bool, k: int):
        asked = {}
        for d in {len(r["v"]) for r in mine}:
            at = [i for i, r in enumerate(mine) if len(r["v"]) == d]
            key, ids, label = (np.array([mine[i][c] for i in at], np.int64) for c in ("anchor", "anchor_id", "label"))
            asked[d] = Windows(key, ids, label, np.array([mine[i]["v"] for i in at], np.int64), lows[at], highs[at], same, k)
            if d in samples:
                asked[d].start_from(samples[d], book)
        return spark.sparkContext.broadcast((book, asked))

    path, empty = new_path(spark, "negatives"), spark.createDataFrame([], f"{FOUND}, rank int, positive_id long, positive_score long")
    empty.write.parquet(path)
    for w in range(waves):
        mine = anchors.where(F.pmod(F.xxhash64("anchor"), F.lit(waves)) == w).collect()  # about `wave` rows
        shape = (len(mine), positives)
        sent = windows(mine, np.full((len(mine), 1), LEAST), np.full((len(mine), 1), MOST), True, positives)
        near = _best(blocks.mapInArrow(_search(sent, w), FOUND), positives).orderBy("anchor", "rank").collect()  # positives of a wave
        place = {r["anchor"]: i for i, r in enumerate(mine)}
        lows, highs = np.full(shape, MOST), np.full(shape, LEAST)
        for r in near:
            i, j = place[r["anchor"]], r["rank"] - 1
            lows[i, j], highs[i, j] = -(-low * r["score"] // 100), high * r["score"] // 100
        found = _best(blocks.mapInArrow(_search(windows(mine, lows, highs, False, negatives), w), FOUND), negatives)
        known = spark.createDataFrame([(r["anchor"], r["rank"] - 1, r["vec_id"], r["score"]) for r in near], "anchor long, window int, positive_id long, positive_score long")
        found.join(known, ["anchor", "window"]).select(empty.columns).write.mode("append").parquet(path)
    out = spark.read.schema(empty.schema).parquet(path)
    out = materialize(out.join(anchors.drop("v", "label"), "anchor"), "hard-negatives")
    drop_path(spark, path)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), "anchor_row", (F.col("window") + 1).alias("positive_rank"))


def op11_multi_index_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(x::double * 256)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), k as (
  select *, row_number() over (order by vec_id, v, label) as nth, row_number() over (partition by vec_id order by v, label) as anchor_row from v
), s as (
  select a.nth as anchor, a.vec_id as anchor_id, a.anchor_row, c.vec_id, c.label = a.label as alike, list_inner_product(a.v, c.v)::bigint as score
  from (select * from k where vec_id % 100 = 0) a join k c on c.nth <> a.nth
), p as (
  select *, row_number() over (partition by anchor order by score desc, vec_id) as positive_rank from s where alike qualify positive_rank <= 5
), n as (
  select p.anchor_id, p.anchor_row, p.positive_rank, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor, p.positive_rank order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor = p.anchor and not s.alike and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score, anchor_row::integer as anchor_row, positive_rank::integer as positive_rank
from n where rank <= 10
"""
