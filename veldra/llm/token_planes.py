"""Token ids in a bit-plane-shuffled binary format, with a chunk index.

Format: ids are cut into blocks of a fixed number of ids (the last of a chunk may be shorter). A block's ids are
transposed into byte planes (or bit planes), each compressed with zstandard on its own: high planes of small ids
are almost all zero and vanish. Byte planes are the default, as they are smaller and much faster for ids of words. A chunk holds whole blocks; its payload is::

    b"BPS1" | mode u8 (1 bit, 8 byte) | planes u8 | 0 u16 | n_ids u32 | n_blocks u32
    then for each block: n u32, the size u32 of each plane, the planes

The chunk index, kept as columns beside the payload, holds for each chunk its shard, its place in the shard, its
ids, the documents that it holds (with the ids of each that lie in it) and the place of each block. Chunks are rows
of a Parquet table in the folder that all executors share, so that any store which Spark can write will do, and a
lost executor's chunks are written again by Spark's commit protocol. Shards are ranges of doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm.common import materialize, pick, shuffle_width, tidy
from veldra.llm.word_bpe import default_path, encoder, forget_all

BLOCK_IDS = 16_384
CHUNK_IDS = 131_072
CACHE_WORDS = 520_000  # the most words that a worker's dictionary holds; it keeps those met again
MAGIC = b"BPS1"

CHUNK_SCHEMA = (
    "shard int, seq long, n_ids long, "
    "docs array<struct<doc_id:bigint,row:bigint,part:int,n:bigint,last:boolean>>, "
    "blocks array<struct<ids:int,at:int,size:int>>, payload binary"
)


def shuffle_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """The planes of a block, lowest first, as many as its largest id needs (one at least)."""
    top = int(ids.max()) if len(ids) else 0
    if mode == "byte":
        width = max(1, (top.bit_length() + 7) // 8)
        return [np.ascontiguousarray(p).tobytes() for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[:width]]
    kind = "<u2" if top < 1 << 16 else "<u4"
    bits = np.unpackbits(ids.astype(kind).view(np.uint8).reshape(len(ids), -1), axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(bits[:, : max(1, top.bit_length())].T, axis=1, bitorder="little")]


def join_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        out = np.zeros((n, 4), np.uint8)
        for i, p in enumerate(planes):
            out[:, i] = np.frombuffer(p, np.uint8)
        return out.view("<u4").reshape(-1)
    bits = np.zeros((16 if len(planes) <= 16 else 32, -(-n // 8) * 8), np.uint8)
    for i, p in enumerate(planes):
        bits[i] = np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits[:, :n].T), axis=1, bitorder="little")
    return packed.view("<u2" if len(planes) <= 16 else "<u4").reshape(-1).astype("<u4")


def write_chunk(ids: np.ndarray, mode: str = "byte", block: int = BLOCK_IDS, level: int = 1) -> tuple[bytes, list[dict]]:
    """A chunk's payload and its blocks' index."""
    pack = zstandard.ZstdCompressor(level=level)
    blocks, out, at = [], [], 16
    for i in range(0, len(ids), block):
        part = ids[i : i + block]
        planes = [pack.compress(p) for p in shuffle_planes(part, mode)]
        head = np.array([len(part), len(planes), *map(len, planes)], "<u4").tobytes()
        data = head + b"".join(planes)
        blocks.append({"ids": len(part), "at": at, "size": len(data)})
        out.append(data)
        at += len(data)
    head = MAGIC + bytes([1 if mode == "bit" else 8, 0, 0, 0]) + np.array([len(ids), len(blocks)], "<u4").tobytes()
    return head + b"".join(out), blocks


def read_chunk(payload: bytes) -> np.ndarray:
    """All ids of a chunk."""
    if payload[:4] != MAGIC:
        raise ValueError("not a chunk of bit planes")
    mode = "bit" if payload[4] == 1 else "byte"
    n, blocks = np.frombuffer(payload, "<u4", 2, 8).tolist()
    out, at, unpack = [], 16, zstandard.ZstdDecompressor()
    for _ in range(blocks):
        count, planes = np.frombuffer(payload, "<u4", 2, at).tolist()
        sizes = np.frombuffer(payload, "<u4", planes, at + 8).tolist()
        at += 8 + 4 * planes
        got = []
        for s in sizes:
            got.append(unpack.decompress(payload[at : at + s]))
            at += s
        out.append(join_planes(got, count, mode))
    ids = np.concatenate(out) if out else np.zeros(0, "<u4")
    if len(ids) != n:
        raise ValueError(f"a chunk of {n} ids holds {len(ids)}")
    return ids


def crc_combine(a: int, b: int, size: int) -> int:
    """The CRC-32 of two strings together, from their own and the second's size."""
    if not size:
        return a
    rows = [0xEDB88320, *(1 << i for i in range(31))]  # the operator of one zero bit

    def times(m, v):
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v, i = v >> 1, i + 1
        return out

    n = size * 8
    while n:
        if n & 1:
            a = times(rows, a)
        rows, n = [times(rows, r) for r in rows], n >> 1
    return a ^ b


def _writer(path: str, end_id: int, mode: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, CACHE_WORDS), np.array([end_id], "<u4").tobytes()
        shard, seq, row, docs, held, size = 0, 0, 0, [], [], 0
        schema = pa.schema([
            ("shard", pa.int32()), ("seq", pa.int64()), ("n_ids", pa.int64()),
            ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("last", pa.bool_())]))),
            ("blocks", pa.list_(pa.struct([("ids", pa.int32()), ("at", pa.int32()), ("size", pa.int32())]))),
            ("payload", pa.binary()),
        ])

        def flush():
            nonlocal seq, docs, held, size
            payload, blocks = write_chunk(np.frombuffer(b"".join(held), "<u4"), mode)
            out = pa.RecordBatch.from_pylist([{"shard": shard, "seq": seq, "n_ids": size, "docs": docs, "blocks": blocks, "payload": payload}], schema)
            seq, docs, held, size = seq + 1, [], [], 0
            return out

        for batch in batches:
            keys, shards, texts = batch.column("doc_id").to_pylist(), batch.column("shard").to_pylist(), batch.column("text")
            of = iter(zip(keys, shards))
            for some in enc.encoded(texts):
                for ids in some:
                    key, at = next(of)
                    if at != shard:
                        if docs:
                            yield flush()
                        shard, seq, row = at, 0, 0
                    ids, part, done = ids + end, 0, 0
                    while done < len(ids):
                        take = ids[done : done + 4 * (chunk - size)]
                        done += len(take)
                        docs.append({"doc_id": key, "row": row, "part": part, "n": len(take) // 4, "last": done == len(ids)})
                        held.append(take)
                        size, part = size + len(take) // 4, part + 1
                        if size >= chunk:
                            yield flush()
                    row += 1
        if docs:
            yield flush()

    return run


def shard_of(docs: DataFrame, shards: int):
    """A column with the shard, from quantiles of the ids alone, so that the texts are read and moved once."""
    cuts = docs.where("doc_id is not null").approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.25 / shards) if shards > 1 else []
    cuts = sorted({int(c) for c in cuts})
    found = F.array(*[F.lit(c) for c in cuts]) if cuts else None
    at = F.lit(0) if found is None else F.coalesce(F.size(F.filter(found, lambda c: c <= F.col("doc_id"))), F.lit(0))
    return at.cast("int"), len(cuts) + 1


def write_tokens(docs: DataFrame, path: str | None = None, *, end_id: int = 1, mode: str = "byte", chunk: int = CHUNK_IDS, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes documents and writes their ids, each document closed by end_id, in ascending order of the ids.

    Null texts count as empty (the end id alone); null ids come first; repeated ids are further documents, in the
    order of their texts; a document longer than a chunk is continued in the next. An empty table gives no chunk.
    Returns the table of chunks in the shared folder (CHUNK_SCHEMA).
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    at, n = shard_of(docs, shards or 4 * shuffle_width(docs.sparkSession))
    dealt = docs.withColumn("shard", at).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    chunks = dealt.mapInArrow(tidy(_writer(path or default_path(), end_id, mode, chunk)), CHUNK_SCHEMA)
    return materialize(chunks, "tokens", compression="uncompressed")


PARTS_SCHEMA = "shard int, seq long, row long, doc_id long, part int, last boolean, n long, inner long, crc long"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_all()  # a worker that has written keeps its dictionary no longer, here and in what comes after
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):  # a chunk at a time: a batch's payloads are never copied together
            c = batch.slice(i, 1).to_pylist()[0]
            data, done = read_chunk(c["payload"]).astype("<u4").tobytes(), 0
            for d in c["docs"]:
                piece = data[4 * done : 4 * (done + d["n"])]
                rows.append((c["shard"], c["seq"], d["row"], d["doc_id"], d["part"], d["last"], d["n"], done, zlib.crc32(piece)))
                done += d["n"]
        cols = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 9, types)]
        yield pa.RecordBatch.from_arrays(cols, ["shard", "seq", "row", "doc_id", "part", "last", "n", "inner", "crc"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for d in batch.to_pylist():
            crc, n = 0, 0
            for p in sorted(d["parts"], key=lambda p: p["part"]):
                crc, n = crc_combine(crc, p["crc"], 4 * p["n"]), n + p["n"]
            rows.append({"doc_id": d["doc_id"], "start": min(p["at"] for p in d["parts"]), "n_tokens": n, "ids_crc32": crc})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))


def chunk_bases(chunks: DataFrame) -> DataFrame:
    """(shard, seq, base): the ids before each chunk. Reads the index columns only; one row a shard is summed alone."""
    from pyspark.sql import Window

    index = chunks.select("shard", "seq", "n_ids")
    per = index.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = {r["shard"]: r["total"] for r in per.collect()}  # a row for each shard, of which the caller sets the number
    starts, total = [], 0
    for s in sorted(before):
        starts.append((s, total))
        total += before[s]
    spark = chunks.sparkSession
    first = spark.createDataFrame(starts, "shard int, first long")
    w = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inner = index.withColumn("inner", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))
    return inner.join(F.broadcast(first), "shard").select("shard", "seq", (F.col("first") + F.col("inner")).alias("base"))


def read_tokens(chunks: DataFrame) -> DataFrame:
    """One row a document, from the chunks' bytes: doc_id, start (the ids of all documents before it), n_tokens and
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    parts = materialize(chunks.select("shard", "seq", "docs", "payload").mapInArrow(tidy(_reader), PARTS_SCHEMA), "parts")
    # only the small rows of the index are joined: payloads stay where they were read
    parts = parts.join(chunk_bases(chunks), ["shard", "seq"]).withColumn("at", F.col("base") + F.col("inner"))
    whole = F.expr("part = 0 and last")
    one = parts.where(whole).select("doc_id", F.col("at").alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    many = parts.where(~whole).groupBy("shard", "row", "doc_id").agg(F.collect_list(F.struct("part", "n", "at", "crc")).alias("parts"))
    return one.unionByName(many.mapInArrow(_joined, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read as it lies: writing deals the texts out by id, so they move once
    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")))
