"""Feature files as a data source: dense arrays of half floats read by byte ranges, written with a commit.

A run's folder holds `feats.f16` (little-endian half floats, frame by frame, row by row) or the parts of it that a
manifest names, and `meta.json` with its grid, dimension and number of frames. `.npy` arrays are read too, in either
order of their axes. A file of many GB is read by as many tasks as its bytes ask for, each holding a few MB.

    spark.dataSource.register(FeatureFiles)
    spark.read.format("veldra_features").load(folder)
    tokens.write.format("veldra_features").mode("append").save(folder)
"""

from __future__ import annotations

import ast
import contextlib
import json
import math
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "run string, frame bigint, row bigint, col bigint, feat array<double>"
ARROW = pa.schema([("run", pa.string()), ("frame", pa.int64()), ("row", pa.int64()), ("col", pa.int64()), ("feat", pa.list_(pa.float64()))])
HALF = np.dtype("<f2")
SPLIT, STEP = 64 << 20, 4 << 20  # bytes of a task, and of one read
NAME = re.compile(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub("^file:", "", path)


def whole_file(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """A small file that is there whole or not at all."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as f:
        f.write(data)
    fs.move(tmp, path)


@dataclass
class Array:
    """A dense array of (frames, rows, cols, dim) numbers in one file, or in parts in the order of frames."""

    run: str
    shape: tuple[int, int, int, int]
    files: list[tuple[str, int]]  # path and bytes
    kind: str = HALF.str
    start: int = 0
    columns: bool = False  # the first axis runs fastest
    cells: int = field(init=False)

    def __post_init__(self):
        self.cells = math.prod(self.shape[:3])
        size, want = sum(n for _, n in self.files), self.start + self.cells * self.shape[3] * np.dtype(self.kind).itemsize
        if size != want:
            raise ValueError(f"{self.files[0][0] if self.files else self.run}: {size} bytes where {self.shape} asks for {want}")


def npy_array(fs: pafs.FileSystem, info: pafs.FileInfo) -> Array:
    """The shape, kind and order that a .npy file states in its header."""
    with fs.open_input_file(info.path) as f:
        first = f.read(12)
        if first[:6] != b"\x93NUMPY":
            raise ValueError(f"{info.path} is no .npy file")
        wide = first[6] >= 2
        n, begin = int.from_bytes(first[8:12] if wide else first[8:10], "little"), 12 if wide else 10
        f.seek(begin)
        head = ast.literal_eval(f.read(n).decode("latin1"))
    shape = tuple(head["shape"])
    if np.dtype(head["descr"]).kind != "f" or not 1 <= len(shape) <= 4:
        raise ValueError(f"{info.path}: {head} is no array of vectors of floats")
    shape = (1,) * (4 - len(shape)) + shape if len(shape) > 1 else (1, 1, 1, *shape)
    return Array(info.base_name.removesuffix(".npy"), shape, [(info.path, info.size)], head["descr"], begin + n, bool(head["fortran_order"]))


def run_array(fs: pafs.FileSystem, folder: str, name: str) -> Array:
    """A run's array by its meta.json: the parts that the manifest names, or feats.f16."""
    with fs.open_input_file(f"{folder}/meta.json") as f:
        meta = json.loads(f.read())
    shape = (int(meta["frames"]), int(meta["grid"][0]), int(meta["grid"][1]), int(meta["feat_dim"]))
    infos = fs.get_file_info([f"{folder}/{p}" for p in meta.get("parts", ["feats.f16"])])
    gone = [i.path for i in infos if i.type != pafs.FileType.File]
    if gone:
        raise FileNotFoundError(f"features that meta.json tells of aren't there: {gone[:3]}")
    return Array(name, shape, [(i.path, i.size) for i in infos])


def arrays(path: str) -> list[Array]:
    """What a path holds: a .npy file, a run's folder, or a folder of such."""
    fs, at = filesystem(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [npy_array(fs, info)]
    has = lambda folder: fs.get_file_info(f"{folder}/meta.json").type == pafs.FileType.File
    if has(at):
        return [run_array(fs, at, info.base_name)]
    out = []
    for i in sorted(fs.get_file_info(pafs.FileSelector(at)), key=lambda i: i.path):
        if i.type == pafs.FileType.File and i.extension == "npy":
            out.append(npy_array(fs, i))
        elif i.type == pafs.FileType.Directory and has(i.path):
            out.append(run_array(fs, i.path, i.base_name))
    return out


class Range(InputPartition):
    """Cells [lo, hi) of a file whose first cell is number `base`; where columns run fastest, of the plane `col`."""

    def __init__(self, array: Array, path: str, base: int, lo: int, hi: int, col: int = -1):
        super().__init__((array, path, base, lo, hi, col))
        self.array, self.path, self.base, self.lo, self.hi, self.col = array, path, base, lo, hi, col


def ranges(array: Array, split: int) -> Iterator[Range]:
    frames, rows, cols, dim = array.shape
    size = np.dtype(array.kind).itemsize
    per = max(1, split // (dim * size))
    if array.columns:  # cells of one column lie side by side, a stretch of them for each component
        for c in range(cols):
            yield from (Range(array, array.files[0][0], 0, lo, min(lo + per, frames * rows), c) for lo in range(0, frames * rows, per))
        return
    base = 0
    for path, n in array.files:
        cells = (n - array.start) // (dim * size)
        if cells * dim * size != n - array.start:
            raise ValueError(f"{path}: {n - array.start} bytes are no whole vectors of {dim}")
        yield from (Range(array, path, base, lo, min(lo + per, cells)) for lo in range(0, cells, per))
        base += cells


class FeatureReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        return [r for a in arrays(self.path) for r in ranges(a, self.split)] or [Range(Array("", (0, 1, 1, 1), []), "", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        a, (frames, rows, cols, dim), kind = part.array, part.array.shape, np.dtype(part.array.kind)
        if part.lo == part.hi:
            return
        step = max(1, STEP // (dim * kind.itemsize))
        fs, _ = filesystem(self.path)
        with fs.open_input_file(part.path) as f:
            for lo in range(part.lo, part.hi, step):
                hi = min(lo + step, part.hi)
                if a.columns:
                    x = np.empty((hi - lo, dim))
                    for d in range(dim):
                        f.seek(a.start + kind.itemsize * (lo + frames * rows * (part.col + cols * d)))
                        x[:, d] = np.frombuffer(f.read((hi - lo) * kind.itemsize), kind)
                    at = np.arange(lo, hi)
                    frame, row, col = at % frames, at // frames, np.full(hi - lo, part.col)
                else:
                    f.seek(a.start + lo * dim * kind.itemsize)
                    raw = f.read((hi - lo) * dim * kind.itemsize)
                    if len(raw) != (hi - lo) * dim * kind.itemsize:
                        raise OSError(f"{part.path} has become shorter")
                    x = np.frombuffer(raw, kind).astype(float).reshape(-1, dim)
                    at = part.base + np.arange(lo, hi)
                    frame, row, col = at // (rows * cols), at // cols % rows, at % cols
                feat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([a.run] * (hi - lo), pa.string()), *map(pa.array, (frame, row, col)), feat], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: run, name, cells, dimension, first and last cell, rows and columns seen."""

    files: list[tuple]


class FeatureWriter(DataSourceArrowWriter):
    """Tasks write parts, each a stretch of cells in order; the commit checks that a run's parts make a whole array
    and publishes its meta.json, which names them. Without it nothing is there for a reader. A file beside the runs says
    that the write goes on; a task whose write has ended, because another failed, finds it gone and leaves nothing."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.mark = f"part-{uuid.uuid4().hex}"  # of all files of this write
        fs, at = filesystem(path)
        fs.create_dir(at)
        fs.open_output_stream(self.going(at)).close()

    def going(self, at: str) -> str:
        return f"{at}/_{self.mark}.going"

    def goes_on(self, fs: pafs.FileSystem, at: str) -> None:
        if fs.get_file_info(self.going(at)).type != pafs.FileType.File:
            raise InterruptedError("the write has ended")

    def clear(self, fs: pafs.FileSystem, files: list[str]) -> None:
        """Deletes parts that are there, and folders that are empty then; others may be at it too."""
        for path in files:
            with contextlib.suppress(FileNotFoundError):
                fs.delete_file(path)
        for folder in {path.rpartition("/")[0] for path in files}:
            with contextlib.suppress(OSError):
                if not fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                    fs.delete_dir(folder)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, at = filesystem(self.path)
        files, out, run, state = [], None, None, None
        try:
            for batch in batches:
                key = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("frame", "row", "col")]
                runs = np.array(batch.column("run").to_pylist(), object)
                cut = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1], True]) if len(runs) else [0]
                for i, j in zip(cut, cut[1:]):
                    if runs[i] != run:
                        if out is not None:
                            out.close()
                        run = runs[i]
                        if not NAME.fullmatch(run or ""):
                            raise ValueError(f"{run!r} is no name of a run")
                        name = f"{self.mark}-{uuid.uuid4().hex}.f16"
                        self.goes_on(fs, at)
                        fs.create_dir(f"{at}/{run}")
                        state = [run, name, 0, -1, None, None, 0, 0]
                        files.append(state)
                        out = fs.open_output_stream(f"{at}/{run}/{name}")
                        self.goes_on(fs, at)
                    feat = batch.column("feat").slice(i, j - i)
                    dims = np.diff(feat.offsets.to_numpy())
                    x = feat.flatten()
                    if feat.null_count or x.null_count or len(set(dims.tolist()) | ({state[3]} - {-1})) != 1:
                        raise ValueError(f"run {run}: vectors are null, hold null or differ in size")
                    cells = np.stack([k[i:j] for k in key], 1)
                    both = cells if state[5] is None else np.r_[[state[5]], cells]
                    up = both[1:] - both[:-1]
                    if not ((up[:, 0] > 0) | (up[:, 0] == 0) & ((up[:, 1] > 0) | (up[:, 1] == 0) & (up[:, 2] > 0))).all():
                        raise ValueError(f"run {run}: cells repeat or aren't in order; use in_order()")
                    out.write(x.to_numpy(zero_copy_only=False).astype(HALF).tobytes())
                    state[2:] = [state[2] + int(j - i), int(dims[0]), state[4] or tuple(map(int, cells[0])), tuple(map(int, cells[-1])), max(state[6], int(cells[:, 1].max()) + 1), max(state[7], int(cells[:, 2].max()) + 1)]
            if out is not None:
                out.close()
            self.goes_on(fs, at)
        except BaseException:
            if out is not None:
                out.close()
            self.clear(fs, [f"{at}/{s[0]}/{s[1]}" for s in files])
            raise
        return Written([tuple(s) for s in files])

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = filesystem(self.path)
        parts: dict[str, list[tuple]] = {}
        for m in messages:
            for f in m.files if m else ():
                parts.setdefault(f[0], []).append(f)
        try:
            metas = {run: self.meta(run, sorted(p, key=lambda f: f[4])) for run, p in parts.items()}
            if not self.overwrite:
                there = [r for r in metas if fs.get_file_info(f"{at}/{r}/meta.json").type == pafs.FileType.File]
                if there:
                    raise FileExistsError(f"runs that are there already: {there[:3]}")
        except BaseException:
            self.abort(messages)
            raise
        for run, meta in metas.items():
            whole_file(fs, f"{at}/{run}/meta.json", json.dumps(meta).encode())
            for i in fs.get_file_info(pafs.FileSelector(f"{at}/{run}")):  # what the run had before
                if i.type == pafs.FileType.File and i.base_name != "meta.json" and i.base_name not in meta["parts"]:
                    fs.delete_file(i.path)
        fs.delete_file(self.going(at))

    @staticmethod
    def meta(run: str, parts: list[tuple]) -> dict:
        rows, cols, dims = max(p[6] for p in parts), max(p[7] for p in parts), {p[3] for p in parts}
        place = lambda cell: (cell[0] * rows + cell[1]) * cols + cell[2]
        begin = 0
        for p in parts:
            if len(dims) > 1 or place(p[4]) != begin or place(p[5]) - begin + 1 != p[2]:
                raise ValueError(f"run {run}: cells are missing, repeat or differ in size about {p[4]}")
            begin += p[2]
        if begin % (rows * cols):
            raise ValueError(f"run {run}: the last frame is torn")
        return {"frames": begin // (rows * cols), "grid": [rows, cols], "feat_dim": dims.pop(), "parts": [p[1] for p in parts]}

    def abort(self, messages: list[Written | None]) -> None:
        """Ends the write and deletes its parts. Tasks that still run delete their own; those that are killed while
        they open a file can't, so it looks until nothing has come for a while."""
        fs, at = filesystem(self.path)
        with contextlib.suppress(FileNotFoundError):
            fs.delete_file(self.going(at))
        quiet = 0
        while quiet < 5:
            mine = [i.path for i in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True, recursive=True)) if i.base_name.startswith(self.mark)]
            quiet = 0 if mine else quiet + 1
            self.clear(fs, mine)
            time.sleep(0.2)


class FeatureFiles(DataSource):
    """options: path; splitBytes, the most bytes that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "veldra_features"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeatureReader:
        return FeatureReader(self.options["path"], int(self.options.get("splitbytes", SPLIT)))

    def writer(self, schema, overwrite: bool) -> FeatureWriter:
        return FeatureWriter(self.options["path"], overwrite)


def in_order(tokens: DataFrame, parts: int) -> DataFrame:
    """Tokens (run, frame, row, col, feat) dealt out and sorted as the sink takes them: a hot run over many tasks."""
    t = tokens.select(F.col("run").cast("string").alias("run"), *[F.col(c).cast("bigint").alias(c) for c in ("frame", "row", "col")], F.col("feat").cast("array<double>").alias("feat"))
    return t.repartitionByRange(parts, "run", "frame", "row", "col").sortWithinPartitions("run", "frame", "row", "col")


def write_features(tokens: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Writes runs' arrays as half floats. A run that is there already is an error unless it may be replaced; a
    write that fails leaves nothing behind and what was there as it was."""
    spark = tokens.sparkSession
    spark.dataSource.register(FeatureFiles)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order(tokens, parts).write.format("veldra_features").mode("overwrite" if overwrite else "append").save(path)


def read_features(spark, path: str, split: int = SPLIT) -> DataFrame:
    """(run, frame, row, col, feat) of a .npy file, a run's folder or a folder of such. Torn files are errors."""
    spark.dataSource.register(FeatureFiles)
    return spark.read.format("veldra_features").option("splitBytes", split).load(path)
