"""SimHash near-duplicates: a segment-popcount embedding, a grid range-join under Manhattan distance, exact checks.

Each fingerprint is mapped to the bit counts of its 32 segments of two bits. A count of 0, 1 or 2 is written in
unary in the segment's own two bits, so the Manhattan distance of two embeddings is the number of bits in which the
unary codes differ; it never exceeds the number of bits in which the fingerprints differ. The grid is laid over
groups of segments: within a distance of d, at least `groups - d` of the groups have equal counts, so two
fingerprints that close share a cell of one of the grids over `kept` groups whenever `groups - d >= kept`. Within a
cell, pairs are first bounded by their Manhattan distance and then checked exactly.

Rows of equal fingerprints (or texts) are one node before any cell is built. A cell of up to `small` members gives off
the pairs that it is the first to see, a larger one a spanning forest of its pairs, of less rows than members; cells
beyond `wide` members are dealt out as pairs of chunks, so no task holds more than two chunks.

Near copies by five-word shingles (the pipeline's stage) take the links of their fingerprints as candidates, and, as
fingerprints can't promise a similarity, complete them by the prefixes of their shingle sets, which lose none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldra.llm.common import components, discard, free_shuffles, materialize, pick, place_of, shuffle_width, table, tidy

LOW = 0x5555555555555555
SEGMENTS = 32


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.encode().lower().split() if text else []


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """All runs of so many words, repeats included; the whole sequence if it is shorter; none without words."""
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def hashes(parts, seed: int = 42) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed integer of 64 bits."""
    if not len(h):
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536]
        count += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<i8")[0])


def _fingerprints(size: int, distinct: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column("text"), []
            for i in range(0, batch.num_rows, 512):
                for t in texts.slice(i, 512).to_pylist():
                    s = shingles(words_of(t), size)
                    out.append(majority(hashes(set(s) if distinct else s)))
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(out, pa.int64())], [*keep, "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = 4, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of each text's shingles of so many words; 0 for a text without words."""
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(tidy(_fingerprints(size, distinct)), "doc_id long, fp long")


def grid_masks(groups: int, kept: int) -> list[int]:
    """Masks of the grids, as signed integers: the bits of every choice of `kept` groups of segments."""
    parts = [sum(3 << 2 * int(s) for s in g) for g in np.array_split(np.arange(SEGMENTS), groups)]
    masks = [sum(parts[i] for i in c) for c in combinations(range(groups), kept)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def unary(fp):
    """A column with the unary codes of the segments' bit counts."""
    low, up = F.lit(LOW), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(low), 1))


def _unary(x: np.ndarray) -> np.ndarray:
    low, up = np.uint64(LOW), x >> np.uint64(1)
    return (x | up) & low | (x & up & low) << np.uint64(1)


LINKS = "kind int, grid long, cell long, a long, b long"
LINK, OPEN = 0, 1


def _shape(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where the cells begin in sorted columns (grid, cell, ...), and their sizes."""
    grid, cell = cols[:2]
    edge = np.flatnonzero(np.r_[True, (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1])])
    return edge, np.diff(np.r_[edge, len(grid)])


class Cells:
    """Finds pairs in sorted cells (grid, cell, node, ...), batch by batch, and gives off rows of LINKS.

    Of cells beyond `wide` members, the members are given off (OPEN) as soon as they are seen.
    """

    columns = ("grid", "cell", "node", "fp")

    def __init__(self, small: int = 48, wide: int = 16_384):
        self.small, self.wide = small, wide

    def of(self, cols: list[np.ndarray]) -> Iterator[tuple]:
        """Rows (kind, grid, cell, a, b) for whole cells, which lie one behind the other."""
        raise NotImplementedError

    def near(self, cols: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def neighbours(self, cols: list[np.ndarray]) -> Iterator[tuple]:
        """All near pairs of the cells of up to `small` members."""
        edge, size = _shape(cols)
        home = np.repeat(np.arange(len(edge)), size)
        for d in range(1, min(self.small, int(size.max()))):
            i = np.flatnonzero(home[d:] == home[:-d])
            i = i[size[home[i]] <= self.small]
            i = i[self.near(cols, i, i + d)]
            if len(i):
                yield LINK, cols[0][i], cols[1][i], cols[2][i], cols[2][i + d]

    def whole(self, cols: list[np.ndarray], k: int) -> tuple:
        grid, cell, node = (c[:k] for c in cols[:3])
        return OPEN, grid, cell, node, node

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind, *rows):
            types = (np.int64,) * 4
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[0]), kind, np.int32)), *[pa.array(r.astype(t)) for r, t in zip(rows, types)]], ["kind", "grid", "cell", "a", "b"])

        held, over = None, None
        for batch in batches:
            cols = [_numbers(batch.column(n)) for n in self.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            if over is not None:  # the rest of a cell that has overflowed
                ends = np.flatnonzero((cols[0] != over[0]) | (cols[1] != over[1]))
                n = int(ends[0]) if len(ends) else len(cols[0])
                if n:
                    yield out(*self.whole(cols, n))
                cols = [c[n:] for c in cols]
                if not len(cols[0]):
                    held = cols
                    continue
                over = None
            last = (cols[0][-1], cols[1][-1])
            before = np.flatnonzero((cols[0] != last[0]) | (cols[1] != last[1]))
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                for rows in self.of([c[:cut] for c in cols]):
                    yield out(*rows)
            held = [c[cut:] for c in cols]
            if len(held[0]) > self.wide:
                yield out(*self.whole(held, len(held[0])))
                over, held = last, [c[:0] for c in held]
        if held is not None and len(held[0]):
            for rows in self.of(held):
                yield out(*rows)


def _numbers(col: pa.Array) -> np.ndarray:
    """A column as an array; one of wide sketches, or of none, as an array of bytes."""
    if pa.types.is_binary(col.type):
        out = np.empty(len(col), object)
        out[:] = col.to_pylist()
        return out
    return col.to_numpy(zero_copy_only=False)


def _rows_of(col: pa.Array) -> np.ndarray:
    """A column of sketches of one size as rows of words."""
    return np.frombuffer(b"".join(col.to_pylist()), "<u8").reshape(len(col), -1)


def forest(order: np.ndarray, near: Callable, comp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the near pairs of one cell: breadth first over what is not yet reached, in a given order.

    near(x, left) tells which of `left` are near x. Members of equal `comp` count as reached by each other.
    """
    left, a, b = order, [], []
    while len(left):
        if comp is None:
            queue, left = [left[0]], left[1:]
        else:
            mine = comp[left] == comp[left[0]]
            queue, left = left[mine].tolist(), left[~mine]
        while queue and len(left):
            x = queue.pop()
            hit = near(x, left)
            got = left[hit]
            if not len(got):
                continue
            if comp is None:
                left, queue = left[~hit], queue + got.tolist()
            else:
                found, at = np.unique(comp[got], return_index=True)
                got, more = got[at], np.isin(comp[left], found)
                queue, left = queue + left[more].tolist(), left[~more]
            a.append(np.full(len(got), x))
            b.append(got)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


class PrintCells(Cells):
    """Cells of the grids: fp is the fingerprint."""

    def __init__(self, bits: int, masks: list[int], small: int = 48, wide: int = 16_384):
        super().__init__(small, wide)
        self.bits, self.masks = bits, np.array(masks, np.int64).view(np.uint64)

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Manhattan distance of the embeddings first, as a bound, then the fingerprints' own."""
        near = np.bitwise_count(_unary(a) ^ _unary(b)) <= self.bits
        near &= np.bitwise_count(a ^ b) <= self.bits
        return near

    def near(self, cols, i, j):
        """Close pairs that no grid before this one has in a cell."""
        fp = cols[3].view(np.uint64)
        ok = self.close(fp[i], fp[j])
        at = np.flatnonzero(ok)
        differ = _unary(fp[i[at]]) ^ _unary(fp[j[at]])
        for k, m in enumerate(self.masks):
            ok[at] &= (differ & m != 0) | (k >= cols[0][i[at]])
        return ok

    def of(self, cols):
        yield from self.neighbours(cols)
        edge, size = _shape(cols)
        for k in np.flatnonzero(size > self.small):
            s = slice(edge[k], edge[k] + size[k])
            fp, node = cols[3][s].view(np.uint64), cols[2][s]
            a, b = forest(np.arange(len(fp)), lambda x, left: self.close(fp[left], fp[x]))  # noqa: B023
            yield LINK, cols[0][s][a], cols[1][s][a], node[a], node[b]


def _dealt(cells: DataFrame, *by: str) -> DataFrame:
    return cells.repartition(2 * shuffle_width(cells.sparkSession), *(by or ("grid", "cell"))).sortWithinPartitions("grid", "cell", "node")


def chunked(members: DataFrame, wide: int) -> DataFrame:
    """Members (grid, cell, ...) of cells: those of cells beyond `wide` in chunks of half as many, of which every two
    are a cell. A member of a cell of m members is given off about 2 m / wide times."""
    per = members.groupBy("grid", "cell").agg(F.ceil(F.count("*") / F.lit(wide // 2)).alias("chunks")).where("chunks > 2")
    all_ = members.join(per, ["grid", "cell"], "left").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda x: x != F.col("own"))
    two = all_.withColumn("other", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(others)))
    key = F.when(F.col("chunks").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")))
    return two.withColumn("cell", key).drop("chunks", "own", "other")


def related(nodes: DataFrame, *, bits: int = 4, groups: int = 7, kept: int = 3, wide: int = 16_384) -> DataFrame:
    """(a, b): pairs of (node, fp) rows whose fingerprints differ in at most `bits` bits, as a written table: all of
    them for small cells and a spanning forest for large ones.

    `groups - bits >= kept` is asked for: else pairs that share no cell would be lost.
    """
    if groups - bits < kept:
        raise ValueError(f"{groups} groups of which {kept} are equal don't reach {bits} bits")
    masks = grid_masks(groups, kept)
    u = unary(F.col("fp"))
    at = F.posexplode(F.array(*[u.bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "cell")
    cells = nodes.select("node", "fp", at)
    out = materialize(_dealt(cells).mapInArrow(tidy(PrintCells(bits, masks, wide=wide).run), LINKS), "related")
    links = out.where(f"kind = {LINK}").select("a", "b")
    spill = out.where(f"kind = {OPEN}").select("grid", "cell", F.col("a").alias("node"))
    if spill.isEmpty():
        return links
    more = _dealt(chunked(spill.join(nodes, "node"), wide)).mapInArrow(tidy(PrintCells(bits, masks, wide=1 << 62).run), LINKS)
    return materialize(links.unionByName(more.select("a", "b")), "related")


def simhash_components(docs: DataFrame, *, size: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id that links of at most `bits`
    differing bits reach, itself included.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows each get their row. A null id
    never becomes a component_id unless nothing else is in the component. An empty table gives none.
    """
    fps = materialize(fingerprints(docs, size, False, id_col, text_col), "fps")
    least = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = related(least.select(F.col("fp").alias("node"), "fp"), bits=bits)
    roots = materialize(components(links), "roots")
    with_root = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = with_root.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = with_root.join(best, "root").select("fp", "component_id")
    # every row of a fingerprint gets one value: rows of a hot fingerprint are split by their own id
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


# ---- near copies: links of fingerprints and prefixes of shingle sets as candidates, shingles as the check

WORDS = 5
SKETCH = 512
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


#: fixed odd multiplier of the words' polynomial hashes and its inverse, and bytes whose letters A-Z are lower-cased
_P = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, by in (("up", _P), ("down", _INVERSE)):
            x = np.full(n, by)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"]


def _words_in(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a piece of UTF-8, and where they begin. No word crosses a cut."""
    space = _SPACE[buf]
    broken = np.r_[True, space[:-1]]
    broken[cuts[cuts < len(buf)]] = True
    start = np.flatnonzero(~space & broken)
    ended = np.r_[space[1:], True]
    at = cuts[(cuts > 0) & (cuts <= len(buf))] - 1
    ended[at] = True
    end = np.flatnonzero(~space & ended) + 1
    up, down = _powers(len(buf))
    total = np.r_[np.uint64(0), np.cumsum(_BYTES[buf] * up)]
    h = (total[end] - total[start]) * down[start] ^ (end - start).astype(np.uint64)
    h *= _STEPS[0]
    return h ^ h >> np.uint64(32), start


def cut_words(texts: pa.Array, piece: int = 1 << 20) -> Iterator[np.ndarray]:
    """The hashes of each text's words, for many texts or a part of a long one at a time: a polynomial over their
    bytes, from one running sum. Null texts have none."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + piece, side="right")) - 1)
        if j > i + 1 or at[j] - at[i] <= piece:
            cuts = at[i : j + 1] - at[i]
            h, start = _words_in(data[at[i] : at[j]], cuts[:-1]) if at[j] > at[i] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            edge = np.searchsorted(start, cuts)
            yield from (h[a:b] for a, b in zip(edge, edge[1:]))
        else:  # one text in pieces that end at white space
            parts, pos = [], int(at[i])
            while pos < at[j]:
                stop = min(pos + piece, int(at[j]))
                while stop < at[j] and not _SPACE[data[stop - 1]]:
                    ahead = np.flatnonzero(_SPACE[data[stop : min(stop + piece, int(at[j]))]])
                    stop = stop + int(ahead[0]) + 1 if len(ahead) else min(stop + piece, int(at[j]))
                parts.append(_words_in(data[pos:stop], np.zeros(0, np.int64))[0])
                pos = stop
            yield np.concatenate(parts)
        i = j


def node_of(words: np.ndarray) -> int:
    """A digest of a text's words."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(words.tobytes(), 1)).view(np.int64))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct five-word shingles (of the whole sequence, if it is shorter)."""
    size = min(WORDS, len(words))
    if not size:
        return words
    h = np.full(len(words) - size + 1, np.uint64(size))
    for j in range(size):
        h = (h ^ words[j : len(words) - size + 1 + j]) * _STEPS[j]
        h ^= h >> np.uint64(29)
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


def sketch_of(own: np.ndarray) -> bytes:
    """Whether each of 512 slots holds an odd number of the set's hashes: two sketches differ in at most as many bits
    as hashes are in one set alone."""
    return np.packbits(np.bincount((own >> np.uint64(55)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def wide_sketch(own: np.ndarray) -> np.ndarray:
    """The same in twice as many slots as the set has hashes or more (a power of two), so that it isn't full."""
    slots = 1 << max(9, (2 * len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(slots - 1)).astype(np.int64), minlength=slots).astype(np.uint8) & 1, bitorder="little").view("<u8")


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two wide sketches differ, the larger folded to the smaller."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def overlap(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted arrays of distinct hashes have a Jaccard similarity of 0.8 or more; empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def prefix(own: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first of a set's hashes, hot ones last: so many that two sets with a similarity of 0.8 share one of them.

    The two sets share at least 4/5 of either, so the hashes before the first shared one are at most the other fifth.
    """
    if not len(own):
        return own
    common = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own if len(hot) else np.zeros(len(own), bool)
    return np.r_[own[~common], own[common]][: len(own) - (4 * len(own) + 4) // 5 + 1]


def _with_node(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = pa.array([node_of(w) for w in cut_words(batch.column(text))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, node], [*batch.schema.names, "_node"])

    return run


def with_node(docs: DataFrame, text: str) -> DataFrame:
    """All columns and _node, the digest of the text's words."""
    return docs.mapInArrow(tidy(_with_node(text)), T.StructType([*docs.schema.fields, T.StructField("_node", T.LongType())]))


SIGNED = "doc_id long, node long, fp long, size long, sketch binary, wide binary, head binary"


def _signed(hot):
    """A text's words as one digest (node), the SimHash of its set of shingles, the set's size, sketches and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, size, sketch, wide, head = [], [], [], [], [], []
            for w in cut_words(batch.column("text")):
                own = shingle_set(w)
                node.append(node_of(w))
                fp.append(majority(own))
                size.append(len(own))
                sketch.append(sketch_of(own))
                wide.append(wide_sketch(own).tobytes())
                head.append(prefix(own, hot.value).astype("<u8").tobytes())
            numbers = [pa.array(x, pa.int64()) for x in (node, fp, size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, *[pa.array(x, pa.binary()) for x in (sketch, wide, head)]], ["doc_id", "node", "fp", "size", "sketch", "wide", "head"])

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each hash of each prefix, in cells of the hash; fp: the set's size above 32 bits of the hash's place."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            heads = [np.frombuffer(h, "<i8") for h in part.column("head").to_pylist()]
            many = np.array([len(h) for h in heads])
            cell = np.concatenate(heads)
            node, size = (np.repeat(part.column(c).to_numpy(), many) for c in ("node", "size"))
            place = np.arange(len(cell)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.zeros(len(cell), np.int64), cell, node, size << 32 | place)], ["grid", "cell", "node", "fp"])


def _reachable(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether as many hashes can be shared as a similarity of 0.8 needs, if the cell's is the first that is."""
    low = (1 << 32) - 1
    size, rest = fp >> 32, (fp >> 32) - (fp & low)
    return 9 * np.minimum(rest[i], rest[j]) >= 4 * (size[i] + size[j])


class PrefixCells(Cells):
    """Cells of sets that share a hash of their prefixes. Pairs of small cells come out, the members of larger ones."""

    def __init__(self, small: int = 12, wide: int = 16_384):
        super().__init__(small, wide)

    def near(self, cols, i, j):
        return _reachable(cols[3], i, j)

    def of(self, cols):
        yield from self.neighbours(cols)
        edge, size = _shape(cols)
        large = np.repeat(size > self.small, size)
        if large.any():
            yield OPEN, cols[0][large], cols[1][large], cols[2][large], cols[3][large]

    def whole(self, cols, k):
        grid, cell, node, fp = (c[:k] for c in cols)
        return OPEN, grid, cell, node, fp


class Known:
    """What a grid's cells share: its nodes in order, their components and wide sketches.

    Sketches have twice as many slots as their sets have hashes, or more, by powers of two; those of sets that can be
    similar differ by one power at most, and are compared in the smaller one's slots.
    """

    def __init__(self, node: np.ndarray, comp: np.ndarray, sketch: np.ndarray):
        self.node, self.comp, self.sketch = node, comp, sketch
        self.kind = np.array([len(x).bit_length() for x in sketch])
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def rows(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Sketches of a size, and of the next folded to it; and which of them is whose."""
        if kind not in self.folded:
            at = np.flatnonzero((self.kind == kind) | (self.kind == kind + 1))
            whose = np.full(len(self.node), -1)
            whose[at] = np.arange(len(at))
            words = [np.frombuffer(self.sketch[i], "<u8") for i in at]
            least = 1 << kind - 4  # words of eight bytes
            self.folded[kind] = np.array([w if len(w) == least else w[:least] ^ w[least:] for w in words]), whose
        return self.folded[kind]

    def apart(self, x: int, others: np.ndarray) -> np.ndarray:
        """At most so many hashes are in the set of x alone or in another's alone, as the sketches tell."""
        out = np.zeros(len(others), np.int64)
        kinds = np.minimum(self.kind[others], self.kind[x])
        for kind in np.unique(kinds):
            sketch, whose = self.rows(int(kind))
            mine = kinds == kind
            out[mine] = np.bitwise_count(sketch[whose[others[mine]]] ^ sketch[whose[x]]).sum(1, dtype=np.int64)
        return out


class SketchCells(Cells):
    """Large cells: gives off pairs of different components that may be similar, a spanning forest of them (in an order
    that is the same in all cells) or `every` one. A grid's nodes come before its cells, once, in a cell of their own
    (FIRST), with their sketches and the components known so far."""

    columns = ("grid", "cell", "node", "fp", "wide", "comp")

    def __init__(self, seed: int, every: bool, wide: int = 1 << 62):
        super().__init__(0, wide)
        self.seed, self.every = seed, every
        self.home, self.seen = None, np.zeros((0, 2), np.int64)
        self.known: Known | None = None

    def of(self, cols):
        """Pairs that the cells of one grid before have not given off: copies share most of their cells."""
        cut = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1], True])
        for lo, hi in zip(cut, cut[1:]):
            part = [c[lo:hi] for c in cols]
            if self.home != part[0][0] or len(self.seen) > 1_000_000:
                self.home, self.seen = part[0][0], self.seen[:0]
            got = [np.sort(np.c_[x[3], x[4]], axis=1) for x in self.each(part)]
            if not got:
                continue
            both = np.concatenate([self.seen, *got])
            rows, first = np.unique(both, axis=0, return_index=True)
            new = rows[first >= len(self.seen)]
            self.seen = rows
            if len(new):
                same = np.full(len(new), self.home)
                yield LINK, same, same, new[:, 0], new[:, 1]

    def each(self, cols):
        edge, size = _shape(cols)
        for k in range(len(edge)):
            s = slice(edge[k], edge[k] + size[k])
            _, cell, node, fp, wide, comp = (c[s] for c in cols)
            if cell[0] == FIRST and wide[0] is not None:
                self.known = Known(node, comp, wide)
                continue
            known = self.known
            at = np.searchsorted(known.node, node)
            comp, n = known.comp[at], fp >> 32
            if (comp == comp[0]).all():
                continue

            def near(x, left):
                ok = _reachable(fp, left, np.full(len(left), x))  # noqa: B023
                some = np.flatnonzero(ok)
                if len(some):
                    ok[some] = 9 * known.apart(at[x], at[left[some]]) <= n[left[some]] + n[x]  # noqa: B023
                return ok

            if self.every:
                for x in range(len(node) - 1):
                    left = np.arange(x + 1, len(node))
                    left = left[comp[left] != comp[x]]
                    got = left[near(x, left)]
                    if len(got):
                        yield LINK, cols[0][s][got], cols[1][s][got], np.full(len(got), node[x]), node[got]
            else:
                mixed = (node.view(np.uint64) ^ np.uint64(self.seed)) * _STEPS[0]
                a, b = forest(np.argsort(mixed ^ mixed >> np.uint64(32), kind="stable"), near, comp)
                if len(a):
                    yield LINK, cols[0][s][a], cols[1][s][a], node[a], node[b]


FIRST = -(1 << 63)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.uint64)
    for batch in batches:
        heads = [prefix(shingle_set(w), none) for w in cut_words(batch.column("text"))]
        hashes, n = np.unique(np.concatenate(heads) if heads else none, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], ["hash", "n"])


def hot_hashes(docs: DataFrame, least: int = 8, most: int = 200_000) -> np.ndarray:
    """Sorted hashes that the prefixes of many documents have, counted over all of them; of more than `most`, the most
    frequent. They come last in the prefixes' order, so a passage that otherwise unlike texts share makes no cell of
    them; any order finds the same links."""
    often = docs.select("text").mapInArrow(tidy(_prefixes), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "hash").limit(most)
    got = often.select("hash").toArrow().column("hash").to_numpy()
    return np.sort(got.view(np.uint64))


def _wide_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        most = np.array(batch.column("na")) + np.array(batch.column("nb"))
        keep = [9 * apart(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")) <= m for x, y, m in zip(batch.column("wa"), batch.column("wb"), most.tolist())]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [shingle_set(w).astype("<u8").tobytes() for w in cut_words(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], ["node", "set"])


def _may_be_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches and sizes allow for a similarity of 0.8."""
    for batch in batches:
        ka, kb, na, nb = (f(batch.column(c)) for c, f in (("ka", _rows_of), ("kb", _rows_of), ("na", _numbers), ("nb", _numbers)))
        ok = (9 * np.bitwise_count(ka ^ kb).sum(1, dtype=np.int64) <= na + nb) & (9 * np.minimum(na, nb) >= 4 * (na + nb))
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [overlap(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")) for x, y in zip(batch.column("sa"), batch.column("sb"))]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted (node, least): one document of each. Other texts are neither cut up nor moved."""
    ids = wanted.select("least").distinct()
    some = with_node(docs.join(ids, docs.doc_id.eqNullSafe(ids.least), "left_semi").select("doc_id", "text"), "text")
    own = wanted.withColumnRenamed("node", "_own")
    some = some.join(own, (some._node == own._own) & some.doc_id.eqNullSafe(own.least), "left_semi")
    return some.select(F.col("_node").alias("node"), "text").dropDuplicates(["node"])


def similar_links(nodes: DataFrame, docs: DataFrame, *, bits: int = 4, small: int = 12, wide: int = 16_384) -> DataFrame:
    """(node, root) for nodes that a similarity of 0.8 or more links to others.

    nodes: (node, least, fp, size, sketch, wide, head); docs: (doc_id, text). Candidates are the links of the fingerprints, all
    pairs of small prefix cells and, of large ones, a spanning forest; shingles decide. What large cells may still
    link between the components so found is asked for once more as a forest, and in the end pair by pair.
    """
    heads = nodes.select("node", "size", "head").mapInArrow(tidy(_heads), "grid long, cell long, node long, fp long")
    found = materialize(_dealt(heads).mapInArrow(tidy(PrefixCells(small, wide).run), LINKS), "cells")
    members = found.where(f"kind = {OPEN}").select(F.lit(0).alias("grid"), "cell", F.col("a").alias("node"), F.col("b").alias("fp"))
    members = chunked(members, wide)
    # cells of one smallest member are searched in one task, as they have most pairs in common; very large ones alone
    per = members.groupBy("cell").agg(F.min("node").alias("home"), F.count("*").alias("many"))
    grid = F.when(F.col("many") <= wide // 4, F.col("home")).otherwise(F.col("cell")).alias("grid")
    members = materialize(members.drop("grid").join(per.select("cell", grid), "cell").select("grid", "cell", "node", "fp"), "members")
    sketches, wides = nodes.select("node", "sketch", "size"), nodes.select("node", "wide", "size")

    def both(pairs: DataFrame, side: DataFrame, **named: str) -> DataFrame:
        """Pairs with the columns of side for a and for b."""
        of = lambda c: side.select(F.col("node").alias(c), *[F.col(k).alias(v + c) for k, v in named.items()])
        return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", *[v + c for v in named.values() for c in "ab"])

    def wanted(pairs: DataFrame) -> DataFrame:
        of = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        return materialize(nodes.select("node", "least").join(of, "node", "left_semi"), "wanted")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those that are similar: by sketches of one size, by sketches of the sets' sizes, by the sets."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        may = materialize(both(pairs, sketches, sketch="k", size="n").mapInArrow(tidy(_may_be_alike), "a long, b long"), "may")
        near = materialize(both(may, wides, wide="w", size="n").mapInArrow(tidy(_wide_near), "a long, b long"), "near")
        sets = materialize(texts_of(docs, wanted(near)).mapInArrow(tidy(_sets), "node long, set binary"), "sets")
        out = materialize(both(near, sets, set="s").mapInArrow(tidy(_alike), "a long, b long"), "links")
        discard(sets), discard(may), discard(near)
        free_shuffles(docs.sparkSession)  # many jobs follow; what these left shouldn't pile up on disk and in the driver
        return out

    def between(roots: DataFrame | None, seed: int, every: bool) -> DataFrame:
        own = members.select("grid", "node").distinct().join(wides, "node")
        own = own.withColumn("comp", F.col("node")) if roots is None else own.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node"))
        first = own.select("grid", F.lit(FIRST).alias("cell"), "node", F.lit(0).cast("long").alias("fp"), "wide", "comp")
        cells = members.withColumn("wide", F.lit(None).cast("binary")).withColumn("comp", F.lit(0).cast("long"))
        known = first.unionByName(cells)
        return _dealt(known, "grid").mapInArrow(tidy(SketchCells(seed, every).run), LINKS).select("a", "b")

    first = related(nodes.select("node", "fp"), bits=bits).unionByName(found.where(f"kind = {LINK}").select("a", "b"))
    if members.isEmpty():
        return materialize(components(verified(first)), "roots")
    links = verified(first.unionByName(between(None, 1, False)))
    for seed, every in ((2, False), (3, True)):
        roots = materialize(components(links), "roots")
        more = materialize(between(roots, seed, every), "between")
        if more.isEmpty():
            return roots
        links = materialize(links.unionByName(verified(more)), "links")
    return materialize(components(links), "roots")


def near_copies(docs: DataFrame, *, bits: int = 4, small: int = 12, wide: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, root): texts of equal words share a node; nodes whose five-word shingles have a Jaccard
    similarity of 0.8 or more share a root, through others too.

    Texts without words are one node; a text of fewer words than five is one shingle. Null ids are rows like others.
    No pair at the similarity is lost: see similar_links. An empty table gives none.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    hot = docs.sparkSession.sparkContext.broadcast(hot_hashes(docs))
    signed = materialize(docs.mapInArrow(tidy(_signed(hot)), SIGNED), "signed")
    most = [F.max(c).alias(c) for c in ("fp", "size", "sketch", "wide", "head")]  # equal in all rows of a node
    ids = materialize(signed.select("doc_id", "node"), "ids")
    nodes = materialize(signed.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("least"), *most), "nodes")
    discard(signed)
    roots = similar_links(nodes, docs, bits=bits, small=small, wide=wide).withColumnRenamed("node", "_node")
    out = ids.join(roots, ids.node == roots._node, "left")
    return out.select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents, one of each group of near copies: that of the smallest doc_id (nulls last); of rows that repeat
    its id and words, the one that comes first as JSON. All columns stay, of any type."""
    groups = materialize(near_copies(docs, id_col=id_col, text_col=text_col, **kw), "groups")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    best = materialize(groups.groupBy("root").agg(F.min_by("doc_id", first).alias("_win"), F.min_by("node", first).alias("_own")).select("_win", "_own"), "kept")
    names = docs.columns
    cols = [f"_c{i}" for i in range(len(names))]
    flat = with_node(docs.toDF(*cols), f"_c{place_of(docs, text_col)}")
    key = F.col(f"_c{place_of(docs, id_col)}").cast("long")
    kept = flat.join(best, (F.col("_node") == F.col("_own")) & key.eqNullSafe(F.col("_win")))
    if not groups.groupBy("doc_id", "node").count().where("count > 1").isEmpty():
        row = F.struct(*cols)
        kept = kept.groupBy("_own").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return kept.select(*[F.col(c).alias(n) for c, n in zip(cols, names)])
