"""Baseline JPEG in columns: a lossless byte carrier, a parser, a Huffman decoder and DC-only thumbnails.

Stored form: a grey baseline JPEG in which each 8x8 block is flat, with one payload byte as its value. The DC
quantiser is 8, so a block's DC coefficient is its byte less 128, and the DC-only thumbnail, an eighth of the image
in each direction, is the payload itself. A row of blocks is one restart interval. Images of more rows than the
format allows are continued in a further image right behind.

The decoder takes any baseline JPEG of 8-bit samples: it steps through the restart intervals of all images of a
batch that share their tables side by side, one Huffman symbol of each in a step, with numpy.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm.common import pick, table

WIDTH = 192  # blocks in a row: payloads are a multiple of it
MAX_ROWS = 8191

# The luminance DC code of the JPEG standard, table K.3 (codes of each size, then the categories)
DC_SIZES = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_VALUES = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
# The AC code has one symbol, the end of a block, in one bit
AC_SIZES, AC_VALUES = [1] + [0] * 15, [0]


def _codes(sizes: list[int], values: list[int]) -> list[tuple[int, int, int]]:
    """(code, size, value) in canonical order."""
    out, code, at = [], 0, 0
    for n, count in enumerate(sizes, 1):
        for _ in range(count):
            out.append((code, n, values[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(sizes: list[int], values: list[int]) -> np.ndarray:
    """For each 16 bits, the size of the code they begin with and its value, as size * 256 + value; 0 for none."""
    out = np.zeros(1 << 16, np.int32)
    for code, n, v in _codes(sizes, values):
        out[code << 16 - n : code + 1 << 16 - n] = n << 8 | v
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(rows: int, width: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0, 8] + [1] * 63))
        + _segment(0xC0, bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * width).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
        + _segment(0xC4, bytes([0x00, *DC_SIZES, *DC_VALUES]))
        + _segment(0xC4, bytes([0x10, *AC_SIZES, *AC_VALUES]))
        + _segment(0xDD, width.to_bytes(2, "big"))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _dc_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference from -255 to 255, the end of the block included."""
    code = {v: (c, n) for c, n, v in _codes(DC_SIZES, DC_VALUES)}
    bits, size = np.zeros(511, np.int32), np.zeros(511, np.int32)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        c, n = code[s]
        bits[d + 255] = ((c << s) | (d if d >= 0 else d + (1 << s) - 1)) << 1
        size[d + 255] = n + s + 1
    return bits, size


_BITS, _SIZE = _dc_table()


def _entropy(x: np.ndarray, mark: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The coded rows of samples, each with stuffing and closed by its marker, and where each ends."""
    width = x.shape[1]
    diff = np.diff(x.astype(np.int32) - 128, axis=1, prepend=0) + 255
    bits, size = _BITS[diff], _SIZE[diff]
    start = np.cumsum(size, axis=1) - size
    total = start[:, -1] + size[:, -1]
    n_bytes = (total + 7) // 8
    buf = np.zeros((len(x), int(n_bytes.max()) + 5), np.uint8)
    lane = np.arange(len(x))
    for j in range(width):
        word = bits[:, j] << (24 - size[:, j] - (start[:, j] & 7))
        at = start[:, j] >> 3
        buf[lane, at] |= (word >> 16).astype(np.uint8)
        buf[lane, at + 1] |= (word >> 8 & 255).astype(np.uint8)
        buf[lane, at + 2] |= (word & 255).astype(np.uint8)
    spare = (n_bytes * 8 - total).astype(np.int32)
    buf[lane, n_bytes - 1] |= ((1 << spare) - 1).astype(np.uint8)  # filled up with ones
    buf[lane, n_bytes], buf[lane, n_bytes + 1] = 0xFF, mark
    col = np.arange(buf.shape[1])
    flat = buf[col < (n_bytes + 2)[:, None]]
    ends = np.cumsum(n_bytes + 2)
    is_mark = np.zeros(len(flat), bool)
    is_mark[ends - 2] = True
    stuff = np.flatnonzero((flat == 0xFF) & ~is_mark)
    return np.insert(flat, stuff + 1, 0).tobytes(), ends + np.searchsorted(stuff, ends)


#: rows (restart intervals) and stored bytes that are worked on at a time, so that a text of any length takes the memory of its
#: own bytes, those of its stored form and a constant
RUN_ROWS, RUN_BYTES = 4096, 2_000_000


def encode_payloads(payloads: list[bytes], width: int = WIDTH, max_rows: int = MAX_ROWS) -> list[bytes]:
    """The stored form of each payload; their sizes are positive multiples of width. Rows are coded RUN_ROWS at a time."""
    counts = [len(p) // width for p in payloads]
    parts = [[min(max_rows, n - at) for at in range(0, n, max_rows)] for n in counts]
    image_rows = np.array([r for p in parts for r in p], np.int64)
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, width)
    first = np.cumsum(image_rows) - image_rows
    mark = (0xD0 + (np.arange(len(x)) - np.repeat(first, image_rows)) % 8).astype(np.uint8)
    mark[first + image_rows - 1] = 0xD9
    flat, ends = bytearray(), []
    for at in range(0, len(x), RUN_ROWS):
        coded, own = _entropy(x[at : at + RUN_ROWS], mark[at : at + RUN_ROWS])
        ends.append(own + len(flat))
        flat += coded
    ends = np.concatenate(ends)
    view, out, row, at = memoryview(flat), [], 0, 0
    for p in parts:
        images = []
        for rows in p:
            row += rows
            images += [_head(rows, width), view[at : int(ends[row - 1])]]
            at = int(ends[row - 1])
        out.append(b"".join(images))
    return out


@dataclass
class Image:
    """What the markers of a baseline JPEG say, and where its scan's data lie."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantiser
    dc_quant: dict[int, int] = field(default_factory=dict)
    codes: dict[int, bytes] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's place, its DC and AC tables
    interval: int = 0
    begin: int = 0
    end: int = 0


def parse(data: bytes, at: int = 0) -> Image:
    """Reads the markers from a start of image on; `end` is the place after its end."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    out, at = Image(), at + 2
    while True:
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out.dc_quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0:
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if body[0] != 8:
                raise ValueError("only samples of 8 bits")
            out.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline images")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out.codes[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            out.interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            ids = [c[0] for c in out.components]
            out.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if len(out.scan) != len(out.components):
                raise ValueError("only images of one scan")
            out.begin = at
            break
    while True:
        at = data.find(b"\xff", at)
        if at < 0:
            raise ValueError("no end of image")
        if data[at + 1] == 0xD9:
            break
        at += 2
    out.end = at + 2
    return out


def _blocks(im: Image) -> list[tuple[int, int, int]]:
    """(component, across, down) of each block of a unit of the scan."""
    if len(im.scan) == 1:
        return [(im.scan[0][0], 0, 0)]
    return [(c, h, v) for c, _, _ in im.scan for v in range(im.components[c][2]) for h in range(im.components[c][1])]


def _grid(im: Image) -> tuple[int, int]:
    """Units across and down."""
    if len(im.scan) == 1:
        return -(-im.width // 8), -(-im.height // 8)
    h, v = max(c[1] for c in im.components), max(c[2] for c in im.components)
    return -(-im.width // (8 * h)), -(-im.height // (8 * v))


def _steps(data: np.ndarray, begin: np.ndarray, units: np.ndarray, im: Image) -> np.ndarray:
    """DC differences of each interval: [interval, unit, block]. data has no stuffing and 8 spare bytes at its end."""
    blocks = _blocks(im)
    of = {c: (dc, ac) for c, dc, ac in im.scan}
    luts = np.stack([_lookup(list(im.codes[t << 4 | of[c][k]][:16]), list(im.codes[t << 4 | of[c][k]][16:])) for c, _, _ in blocks for k, t in ((0, 0), (1, 1))])
    luts = luts.reshape(-1)
    word = np.zeros(len(data) - 4, np.int64)
    for i in range(5):
        word = word << 8 | data[i : len(data) - 4 + i]
    lanes, nb = len(begin), len(blocks)
    out = np.zeros((lanes, int(units.max()), nb), np.int32)
    pos, live = begin * 8, np.arange(lanes)
    k, block, unit = (np.zeros(lanes, np.int64) for _ in range(3))
    left = units.copy()
    while len(live):
        w = word[pos >> 3] << (pos & 7) & 0xFFFFFFFFFF
        got = luts[((block * 2 + (k > 0)) << 16) | (w >> 24)]
        size, value = got >> 8, got & 255
        if not size.all():
            raise ValueError("no such Huffman code")
        is_dc = k == 0
        s = np.where(is_dc, value, value & 15)
        raw = (w << size & 0xFFFFFFFFFF) >> (40 - s)
        if is_dc.any():
            extra = np.where((s > 0) & (raw < (1 << np.maximum(s - 1, 0))), raw - (1 << s) + 1, raw)
            d = np.flatnonzero(is_dc)
            out[live[d], unit[d], block[d]] = extra[d]
        pos = pos + size + s
        run = value >> 4
        k = np.where(is_dc, 1, np.where(value == 0, 64, k + run + 1))
        over = k >= 64
        if over.any():
            k = np.where(over, 0, k)
            block = block + over
            turn = block == nb
            block = np.where(turn, 0, block)
            unit = unit + turn
            if turn.any() and (stop := unit >= left).any():
                keep = ~stop
                pos, live, k, block, unit, left = pos[keep], live[keep], k[keep], block[keep], unit[keep], left[keep]
    return out


def _thumbs(images: list[Image], datas: list[bytes]) -> list[np.ndarray]:
    """DC-only luminance of images that share tables and layout: an array of rows of uint8 for each."""
    im = images[0]
    raw = np.frombuffer(b"".join(d[i.begin : i.end] for i, d in zip(images, datas)), np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    nxt = raw[ff + 1]
    if ((nxt != 0) & (nxt != 0xD9) & ((nxt < 0xD0) | (nxt > 0xD7))).any():
        raise ValueError("an unexpected marker in a scan")
    keep = np.ones(len(raw), bool)
    keep[ff + 1] = False
    keep[ff[nxt != 0]] = False
    ends = ff[nxt != 0]
    clean_at = np.cumsum(keep) - keep
    begin = np.r_[0, clean_at[ends[:-1]]]
    data = np.r_[raw[keep], np.zeros(16, np.uint8)].astype(np.int64)
    units = []
    for i in images:
        across, down = _grid(i)
        n, step = across * down, i.interval or across * down
        units += [min(step, n - a) for a in range(0, n, step)]
    if len(units) != len(begin):
        raise ValueError("restart markers don't fit the size")
    diff = _steps(data, begin, np.array(units), im)
    blocks = _blocks(im)
    mine = [k for k, b in enumerate(blocks) if b[0] == 0]
    out, lane = [], 0
    quant = im.dc_quant[im.components[0][3]]
    for i in images:
        across, down = _grid(i)
        n = across * down
        lanes = -(-n // (i.interval or n))
        own = diff[lane : lane + lanes][:, :, mine].astype(np.int64)
        lane += lanes
        dc = np.cumsum(own.reshape(lanes, -1), axis=1).reshape(-1, len(mine))[:n] if lanes * diff.shape[1] == n else np.concatenate([np.cumsum(o[:u].reshape(-1)).reshape(-1, len(mine)) for o, u in zip(own, units[lane - lanes : lane])])
        h, v = (1, 1) if len(im.scan) == 1 else im.components[0][1:3]
        grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        wide, high = -(-i.width * h // (8 * max(c[1] for c in im.components))), -(-i.height * v // (8 * max(c[2] for c in im.components)))
        if len(im.scan) == 1:
            wide, high = across, down
        out.append(np.clip((grid[:high, :wide] * quant + 4 >> 3) + 128, 0, 255).astype(np.uint8))
    return out


def decode_thumbnails(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """(width, height, thumbnail) of each image in each item: an item may hold several, one behind the other. Images are
    decoded in runs of about RUN_BYTES, one at least, so that a long item of many images is never spread out whole."""
    groups: dict[tuple, list[tuple[int, int, Image]]] = {}
    counts = []
    for k, data in enumerate(media):
        at, n = 0, 0
        while at < len(data):
            im = parse(data, at)
            shape = (tuple(im.components), tuple(im.scan), tuple(sorted(im.codes.items())), tuple(sorted(im.dc_quant.items())))
            groups.setdefault(shape, []).append((k, n, im))
            at, n = im.end, n + 1
        counts.append(n)
    out: list[list] = [[None] * n for n in counts]
    for found in groups.values():
        for a, b in _sliced([im.end - im.begin for _, _, im in found]):
            run = found[a:b]
            for (k, n, im), thumb in zip(run, _thumbs([f[2] for f in run], [media[f[0]] for f in run])):
                out[k][n] = (im.width, im.height, thumb)
    return out


def thumbnail_hashes(thumb: np.ndarray) -> tuple[str, str]:
    """A difference hash (of 8 rows of 9 samples, each with its right neighbour) and an average hash (8x8), in hex."""
    rows = (np.arange(8) * 2 + 1) * thumb.shape[0] // 16
    a = thumb[np.ix_(rows, (np.arange(9) * 2 + 1) * thumb.shape[1] // 18)].astype(np.int32)
    b = thumb[np.ix_(rows, (np.arange(8) * 2 + 1) * thumb.shape[1] // 16)].astype(np.int32)
    return np.packbits(a[:, 1:] > a[:, :-1]).tobytes().hex(), np.packbits(b * 64 > b.sum()).tobytes().hex()


def _sliced(sizes: list[int], most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of items of about so many bytes together, one item at least."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if sizes:
        yield at, len(sizes)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.column("doc_id"), batch.column("text").cast(pa.large_binary()).to_pylist()
        sizes = [len(t or b"") for t in texts]
        for a, b in _sliced(sizes):
            media = encode_payloads([(t or b"") + b" " * ((-len(t or b"")) % WIDTH or (0 if t else WIDTH)) for t in texts[a:b]])
            texts[a:b] = [None] * (b - a)
            yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(sizes[a:b], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    for batch in batches:
        media = batch.column("media").to_pylist()
        for a, b in _sliced([len(m) for m in media]):
            rows = []
            for m, images in zip(media[a:b], decode_thumbnails(media[a:b])):
                thumb = images[0][2] if len(images) == 1 else np.concatenate([t for _, _, t in images])
                payload, (dhash, ahash) = memoryview(np.ascontiguousarray(thumb)).cast("B"), thumbnail_hashes(thumb)
                wide, high = images[0][0], sum(h for _, h, _ in images)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), f"{wide}x{high}:{dhash}:{ahash}", wide, high))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("n_bytes").slice(a, b - a), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"])


def store_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media column: doc_id, n_bytes (of the text) and media (its stored form). Null texts count as empty; an
    empty text is stored as one row of spaces; null and repeated ids are rows like any other. A text of any length is coded
    in runs of rows: beside its bytes and its stored form it takes a constant amount of memory."""
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads stored media back: FEATURES. Rows of equal media get equal values; null ids stay; an empty table gives none."""
    return media.mapInArrow(_read, FEATURES)


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_media(table(spark, sf_dir, "documents")))
