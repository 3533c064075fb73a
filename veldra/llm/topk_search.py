"""Exact top-k search by inner product, over buckets of vectors of similar length.

Vectors are sorted by length and cut into buckets. A query with a bound on its k-th best score skips every bucket
whose longest vector can't reach it. In the others the bound gives a local cosine threshold, from which either a
length (only the longest vectors of the bucket can reach the bound) or a coordinate (a vector within the angle has
its value at the query's largest coordinate within a range) is chosen as the pruning that leaves fewer; what is left
is verified by its integer product. Queries come in waves of a bounded number, each against all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra.llm.common import materialize, pick, shuffle_width, table

BUCKET = 4096
WAVE = 4096

BLOCKS = "dim int, n int, longest double, block long, ids binary, vectors binary"
FOUND = "query long, vec_id long, score long"


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * component); vectors that are null, empty or without an id, or hold null or
    non-finite components, are left out."""
    v = pick(vectors, vec_id=id_col, e=vec_col)
    whole = "vec_id is not null and e is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('Infinity'))"
    return v.where(whole).select(F.col("vec_id").cast("long"), F.transform("e", lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"))


def _blocked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24  # a row's key is its block's number and its place in the block
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            col = batch.column("v")
            dims = np.diff(col.offsets.to_numpy())
            flat, at = col.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(dims)]
            cut = np.flatnonzero(np.r_[True, dims[1:] != dims[:-1], True])
            for a, b in zip(cut, cut[1:]):
                for i in range(a, b, size):
                    j = min(b, i + size)
                    m = flat[at[i] : at[j]].reshape(j - i, -1).astype("<i8")
                    norm = np.sqrt((m.astype(float) ** 2).sum(1))
                    order = np.argsort(-norm, kind="stable")
                    yield pa.RecordBatch.from_pylist([{"dim": int(dims[a]), "n": j - i, "longest": float(norm[order[0]]), "block": block, "ids": ids[i:j][order].astype("<i8").tobytes(), "vectors": m[order].tobytes()}], pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("longest", pa.float64()), ("block", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())]))
                    block += 1

    return run


def _queries(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, ids, p = _unpack(row)
                at = np.flatnonzero(ids % every == 0)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(ids[at]), pa.array(p[at].tolist(), pa.list_(pa.int64()))], ["query", "query_id", "v"])

    return run


class TopK:
    """The best of what has been seen for each of a set of queries of one dimension."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, k: int):
        self.keys, self.q, self.k = keys, vectors, k
        self.norm = np.sqrt((vectors.astype(float) ** 2).sum(1))
        self.unit = vectors / np.maximum(self.norm, 1e-300)[:, None]
        self.focus = np.abs(self.unit).argmax(1)
        self.floor = np.full(len(keys), -np.inf)  # no score below it is among the best
        self.who = self.vec = self.score = np.zeros(0, np.int64)

    def add(self, who: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        who, vec, score = np.r_[self.who, who], np.r_[self.vec, vec], np.r_[self.score, score]
        order = np.lexsort((vec, -score, who))
        who, vec, score = who[order], vec[order], score[order]
        first = np.searchsorted(who, who)
        nth = np.arange(len(who)) - first
        keep = nth < self.k
        self.who, self.vec, self.score = who[keep], vec[keep], score[keep]
        full = nth[keep] == self.k - 1
        self.floor[self.who[full]] = np.maximum(self.floor[self.who[full]], self.score[full])

    def product(self, rows: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Integer products; through floating point where every sum is exact in it."""
        top = float(np.abs(self.q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(1, p.shape[1])
        if top < 2**24:
            return (self.q[rows].astype(np.float32) @ p.T.astype(np.float32)).astype(np.int64)
        if top < 2**53:
            return (self.q[rows].astype(float) @ p.T.astype(float)).astype(np.int64)
        return self.q[rows] @ p.T

    def verify(self, rows: np.ndarray, p: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        """Products of some queries with some vectors but their own rows; what reaches a query's bound is kept."""
        for i in range(0, len(rows), 512):
            part = rows[i : i + 512]
            s = self.product(part, p)
            ok = (s >= self.floor[part][:, None]) & (keys[None, :] != self.keys[part][:, None])
            if len(ids) > 4 * self.k:  # no more than k of one bucket can be among the best, but for ties
                low = np.partition(np.where(ok, s, np.iinfo(np.int64).min), -self.k, axis=1)[:, -self.k]
                ok &= s >= low[:, None]
            w, c = np.nonzero(ok)
            if len(w):
                self.add(part[w], ids[c], s[w, c])

    def bucket(self, keys: np.ndarray, ids: np.ndarray, p: np.ndarray) -> None:
        """Searches a bucket, sorted by falling length."""
        length = np.sqrt((p.astype(float) ** 2).sum(1))
        most = length[0]
        slack = 1 - 1e-9
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(np.isfinite(self.floor), self.floor, -np.inf)
            # a bound of zero or less prunes nothing
            prune = need > 0
            live = np.flatnonzero(~prune | (self.norm * most >= need * slack))
            if not len(live):
                return
            cosine = np.where(prune, need / (self.norm * most) * slack, -1.0)[live]
            shortest = np.where(prune, need / self.norm * slack, 0.0)[live]
        by_length = np.searchsorted(-length, -shortest, side="right")
        direction = p / np.maximum(length, 1e-300)[:, None]
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(ids))
        orders: dict[int, np.ndarray] = {}
        for f in np.unique(self.focus[live]):
            mine = np.flatnonzero(self.focus[live] == f)
            order = orders[f] = np.argsort(direction[:, f], kind="stable")
            x = direction[order, f]
            c, t = self.unit[live[mine], f], np.clip(cosine[mine], -1, 1)
            wide = np.sqrt((1 - c * c).clip(0) * (1 - t * t).clip(0))
            # vectors at least at this angle: cos(a + b) to cos(a - b), or to the pole if it is within reach
            low = np.where(t <= -c, -1.0, c * t - wide)
            high = np.where(t <= c, 1.0, c * t + wide)
            ok = t > 0
            lo[mine] = np.where(ok, np.searchsorted(x, low - 1e-9, side="left"), 0)
            hi[mine] = np.where(ok, np.searchsorted(x, high + 1e-9, side="right"), len(ids))
        by_angle = np.maximum(hi - lo, 0)
        few = np.minimum(by_length, by_angle)
        alone = few < len(ids) // 16
        for i in np.flatnonzero(alone & (few > 0)):
            at = np.sort(orders[self.focus[live[i]]][lo[i] : hi[i]]) if by_angle[i] < by_length[i] else slice(0, by_length[i])
            self.verify(live[i : i + 1], p[at], ids[at], keys[at])
        rest = np.flatnonzero(~alone)
        if len(rest):
            n = int(by_length[rest].max())
            self.verify(live[rest], p[:n], ids[:n], keys[:n])


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, ids and vectors of a block's rows."""
    return (row["block"] << 16) + np.arange(row["n"]), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<i8").reshape(row["n"], row["dim"])


def _search(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {}
        for dim, (keys, q, floor) in sent.value.items():
            state[dim] = TopK(keys, q, k)
            state[dim].floor = floor.copy()
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] in state:
                    state[row["dim"]].bucket(*_unpack(row))
        for s in state.values():
            yield pa.RecordBatch.from_arrays([pa.array(s.keys[s.who]), pa.array(s.vec), pa.array(s.score)], ["query", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, bucket: int = BUCKET, wave: int = WAVE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, query_row, rank (from 1), vec_id, score: the k highest integer products of each query with all other
    rows.

    Queries are the rows whose id is divisible by `every`; ties go to the smaller vec_id. Rows of a repeated id are
    queries and candidates each, of each other too; query_row numbers an id's rows in the order of their vectors.
    Vectors of another dimension than the query's have no product with it; those without components take no part.
    Scores beyond 64 bits wrap. An empty table gives an empty result.
    """
    if bucket > 1 << 16:
        raise ValueError("a bucket holds 65536 vectors at most")
    spark = vectors.sparkSession
    v = scaled(vectors, id_col, vec_col, scale)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    dealt = v.withColumn("length", length).withColumn("dim", F.size("v")).repartitionByRange(2 * shuffle_width(spark), "dim", F.desc("length"), "vec_id").sortWithinPartitions("dim", F.desc("length"), "vec_id")
    blocks = materialize(dealt.select("vec_id", "v").mapInArrow(_blocked(bucket), BLOCKS), "buckets")
    own = Window.partitionBy("query_id").orderBy("v", "query")
    queries = blocks.mapInArrow(_queries(every), "query long, query_id long, v array<long>").withColumn("query_row", F.row_number().over(own))
    queries = materialize(queries, "queries")
    waves = max(1, -(-queries.count() // wave))
    seeds: dict[int, list[dict]] = {}
    # the longest bucket of up to eight dimensions: a bounded sample that gives each query a first bound
    for d in [r["dim"] for r in blocks.groupBy("dim").count().orderBy(F.desc("count")).limit(8).collect()]:
        seeds[d] = [r.asDict() for r in blocks.where(F.col("dim") == d).orderBy(F.desc("longest")).limit(1).collect()]
    found = []
    for w in range(waves):
        mine = queries.where(F.pmod(F.xxhash64("query"), F.lit(waves)) == w).collect()  # about `wave` rows
        sent = {}
        for d in {len(r["v"]) for r in mine}:
            rows = [r for r in mine if len(r["v"]) == d]
            t = TopK(np.array([r["query"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.int64), k)
            for s in seeds.get(d, []):
                t.bucket(*_unpack(s))
            sent[d] = (t.keys, t.q, t.floor)
        part = blocks.mapInArrow(_search(spark.sparkContext.broadcast(sent), k), FOUND)
        found.append(part if waves == 1 else materialize(_best(part, k).drop("rank"), "found"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return _best(out, k).join(queries.drop("v"), "query").select("query_id", "query_row", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), k as (
  select vec_id, v, row_number() over (order by vec_id, v) as nth, row_number() over (partition by vec_id order by v) as query_row from v
), s as (
  select q.nth, q.vec_id as query_id, q.query_row, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from (select * from k where vec_id % 50 = 0) q join k c on c.nth <> q.nth
), r as (
  select *, row_number() over (partition by nth order by score desc, vec_id) as rank from s
)
select query_id, query_row::integer as query_row, rank::integer as rank, vec_id, score from r where rank between 1 and 5
"""
