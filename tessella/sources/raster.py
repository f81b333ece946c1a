"""Binary rasters (.g2zbin, version 2) as a Spark data source, and text forms of grids.

A raster file: 8 bytes of magic, version, precision and order, a name, two axes, and values row by row.
Rows that are read are (ix, iy, x, y, z): a file is cut into partitions by rows of the grid. Files lie where
pyarrow can open them; for other stores use `read_files`, which goes through Spark's own reader.
"""

from __future__ import annotations

import glob
import io
import json
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessella.functions.axis import Axis

# Fixed values of the format.
MAGIC = b"G2ZBIN\0\0"
VERSION = 2

SCHEMA = "ix int, iy int, x double, y double, z double"


def _text(s: str) -> bytes:
    data = s.encode()
    return struct.pack("<Q", len(data)) + data


def _axis(a: Axis) -> bytes:
    return _text(a.name) + struct.pack("<iddd", a.nbin, a.min, a.max, a.interval)


def _head(name: str, x: Axis, y: Axis, precision: int) -> bytes:
    return MAGIC + struct.pack("<HBBI", VERSION, precision, 0, 0) + _text(name) + _axis(x) + _axis(y)


def dumps(name: str, x: Axis, y: Axis, z: np.ndarray, precision: int = 8) -> bytes:
    """z[iy, ix] as the bytes of a file."""
    if z.shape != (y.nbin, x.nbin) or precision not in (4, 8):
        raise ValueError("values and axes differ in shape, or precision isn't 4 or 8")
    return _head(name, x, y, precision) + np.ascontiguousarray(z, f"<f{precision}").tobytes()


def header(f: io.BufferedIOBase) -> tuple[str, Axis, Axis, int]:
    """Name, axes and precision; the file then stands at the first value."""
    if f.read(8) != MAGIC:
        raise ValueError("not a raster file")
    version, precision, order, _ = struct.unpack("<HBBI", f.read(8))
    if version != VERSION or precision not in (4, 8) or order:
        raise ValueError(f"version {version}, precision {precision} and order {order} can't be read")
    text = lambda: f.read(struct.unpack("<Q", f.read(8))[0]).decode()
    name = text()

    def axis() -> Axis:
        label = text()
        n, low, high, interval = struct.unpack("<iddd", f.read(28))
        out = Axis(label, n, low, high, interval)
        if abs((high - low) / n - interval) > 1e-4 * abs(interval):
            raise ValueError("an axis whose interval doesn't fit its bounds")
        return out

    return name, axis(), axis(), precision


def loads(data: bytes) -> tuple[str, Axis, Axis, np.ndarray]:
    f = io.BytesIO(data)
    name, x, y, precision = header(f)
    z = np.frombuffer(f.read(), f"<f{precision}")
    if len(z) != x.nbin * y.nbin:
        raise ValueError("a file that is cut off or too long")
    return name, x, y, z.reshape(y.nbin, x.nbin).astype(float)


def _cells(x: Axis, y: Axis, z: np.ndarray, first: int, start: int = 0, columns: tuple[str, ...] = ("ix", "iy", "x", "y", "z")) -> pa.RecordBatch:
    """z[line, column] as rows of SCHEMA; it begins at iy = first and ix = start."""
    j, i = np.divmod(np.arange(z.size, dtype=np.int32), np.int32(max(1, z.shape[1])))
    j, i = j + np.int32(first), i + np.int32(start)
    made = {"ix": lambda: i, "iy": lambda: j, "x": lambda: x.min + (i + 0.5) * x.interval, "y": lambda: y.min + (j + 0.5) * y.interval, "z": z.ravel}
    return pa.RecordBatch.from_arrays([pa.array(made[c]()) for c in columns], names=list(columns))


def store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path and its place there: a plain path, or a URI of what pyarrow opens (file, hdfs, s3, gs, abfs)."""
    if re.match(r"[a-z0-9]+:", path):
        return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path)))
    return pa.fs.LocalFileSystem(), os.path.abspath(path)


class _Part(InputPartition):
    def __init__(self, path: str, first: int, last: int, start: int, end: int):
        self.path, self.first, self.last, self.start, self.end = path, first, last, start, end


#: What a condition on a bin's number or middle lets through.
COMPARED = {"=": np.equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal, "in": np.isin}


def _span(where: list, axis: Axis, index: str, place: str) -> tuple[int, int]:
    """First and last (exclusive) bin of an axis that conditions on its bins' numbers or middles let through."""
    i = np.arange(axis.nbin, dtype=np.int32)
    values, kept = {index: i, place: axis.min + (i + 0.5) * axis.interval}, np.ones(axis.nbin, bool)
    for column, how, value in where:
        if column in values:
            kept &= COMPARED[how](values[column], value)
    found = np.flatnonzero(kept)
    return (int(found[0]), int(found[-1]) + 1) if len(found) else (0, 0)


class _Reader(DataSourceReader):
    def __init__(self, path: str, cells: int, columns: tuple[str, ...], where: list | None = None):
        self.paths, self.cells, self.columns, self.where = sorted(glob.glob(path) if any(c in path for c in "*?[") else [path]), cells, columns, where or []

    def partitions(self) -> list[_Part]:
        """Lines of each file that can hold what is asked for, and of these the stretch of columns."""
        out = []
        for path in self.paths:
            fs, place = store(path)
            with fs.open_input_file(place) as f:
                _, x, y, _ = header(f)
            (start, end), (low, high) = _span(self.where, x, "ix", "x"), _span(self.where, y, "iy", "y")
            lines = max(1, self.cells // max(1, end - start))
            out += [_Part(path, a, min(a + lines, high), start, end) for a in range(low, high, lines) if end > start]
        return out

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is asked for
            return
        fs, place = store(partition.path)
        with fs.open_input_file(place) as f:
            _, x, y, precision = header(f)
            begin, wide = f.tell(), partition.end - partition.start
            n, kind = partition.last - partition.first, f"<f{precision}"
            if wide * 4 >= x.nbin:  # one stretch of whole lines
                data = f.read_at(n * x.nbin * precision, begin + partition.first * x.nbin * precision)
                z = np.frombuffer(data, kind).reshape(n, x.nbin)[:, partition.start : partition.end]
            else:
                z = np.stack([np.frombuffer(f.read_at(wide * precision, begin + (j * x.nbin + partition.start) * precision), kind) for j in range(partition.first, partition.last)])
        yield _cells(x, y, z.astype(float), partition.first, partition.start, self.columns)


class _Wrote(WriterCommitMessage):
    def __init__(self, block: int):
        self.block = block


class _Writer(DataSourceWriter):
    """One file for all partitions. Each writes the lines that are dealt to it to their place in a file beside the target; what isn't given is NaN.

    blocks: into how many parts of even height lines are dealt, each to the partition with its number. Without it, one partition has all. A task that runs
    again writes the same bytes again; one that still runs when a job fails may leave its part, which nothing reads. Needs a file system that writes in place.
    """

    def __init__(self, options: dict):
        o = self.options = options
        self.path = re.sub(r"^file:/+", "/", o["path"])
        if re.match(r"[a-z0-9]+:", self.path):
            raise ValueError(f"a raster is written in place, which {self.path} doesn't allow")
        self.x, self.y = (Axis(k, int(o[f"n{k}"]), float(o[f"{k}min"]), float(o[f"{k}max"])) for k in "xy")
        self.precision, self.blocks = int(o.get("precision", 8)), int(o.get("blocks", 1))
        if self.precision not in (4, 8):
            raise ValueError("the precision isn't 4 or 8")
        self.head = _head(o.get("name", "z"), self.x, self.y, self.precision)
        self.part = f"{self.path}.{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Wrote:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        if block >= self.blocks:
            if next(iter(rows), None) is None:
                return _Wrote(block)
            raise ValueError("a raster is written from as many partitions as it has blocks: use coalesce(1), or save")
        first, last = (-(-k * self.y.nbin // self.blocks) for k in (block, block + 1))
        z = np.full((last - first, self.x.nbin), np.nan)
        for r in rows:
            if not first <= r["iy"] < last or not 0 <= r["ix"] < self.x.nbin:
                raise ValueError(f"a cell outside the block's lines: {r['ix']}, {r['iy']}")
            z[r["iy"] - first, r["ix"]] = r["z"]
        file = os.open(self.part, os.O_WRONLY | os.O_CREAT, 0o644)
        with os.fdopen(file, "wb") as f:
            f.seek(len(self.head) + first * self.x.nbin * self.precision)
            f.write(z.astype(f"<f{self.precision}").tobytes())
        return _Wrote(block)

    def commit(self, messages: list) -> None:
        if {m.block for m in messages if m} < set(range(self.blocks)):
            self.abort(messages)
            raise ValueError("a raster whose blocks aren't all there")
        with open(self.part, "r+b") as f:
            f.write(self.head)
        os.replace(self.part, self.path)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class RasterSource(DataSource):
    """spark.read.format("g2zbin").load(path), and write with nx, xmin, xmax, ny, ymin, ymax; see scan and save.

    A schema with fewer columns reads only these. where: conditions as scan takes them, as JSON.
    """

    @classmethod
    def name(cls) -> str:
        return "g2zbin"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("cells", 1 << 20)), tuple(f.name for f in schema.fields), json.loads(self.options.get("where", "[]")))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def scan(spark: SparkSession, path: str, where: list[tuple[str, str, object]] | None = None, columns: list[str] | None = None, cells: int = 1 << 20) -> DataFrame:
    """Rows of rasters that meet all conditions (a column of ix, iy, x and y, one of COMPARED, and a value or a list of them); only the lines and stretches that hold
    them are read, and only the columns asked for are made.

    Conditions are part of the relation. Filters that Spark pushes into a Python source stay in it when the table is used once more without them
    (4.1.2), so the source takes none.
    """
    spark.dataSource.register(RasterSource)
    where = where or []
    for column, how, _ in where:
        if column not in ("ix", "iy", "x", "y") or how not in COMPARED:
            raise ValueError(f"not a condition that chooses lines: {column} {how}")
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    wanted = columns or list(kinds)
    read = [*wanted, *sorted({column for column, *_ in where} - set(wanted))]
    schema = ", ".join(f"{c} {kinds[c]}" for c in read)
    out = spark.read.format("g2zbin").schema(schema).options(cells=cells, where=json.dumps([[c, h, list(v) if isinstance(v, tuple) else v] for c, h, v in where])).load(path)
    for column, how, value in where:
        c = F.col(column)
        out = out.filter(c.isin(list(value)) if how == "in" else {"=": c == value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[how])
    return out.select(*wanted)


def save(cells: DataFrame, path: str, x: Axis, y: Axis, blocks: int = 1, precision: int = 8, name: str = "z") -> None:
    """Writes cells (ix, iy, z; one row each) as one raster, in so many blocks of lines side by side."""
    cells.sparkSession.dataSource.register(RasterSource)
    blocks = max(1, min(blocks, y.nbin))
    dealt = cells.select("ix", "iy", "z").repartitionById(blocks, F.floor(F.col("iy") * F.lit(blocks) / y.nbin).cast("int"))
    where = {"nx": x.nbin, "xmin": x.min, "xmax": x.max, "ny": y.nbin, "ymin": y.min, "ymax": y.max}
    dealt.write.format("g2zbin").options(**where, blocks=blocks, precision=precision, name=name).mode("append").save(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, ix, iy, x, y, z of rasters in any store that Spark reads; a file is read as a whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                _, x, y, z = loads(bytes(content))
                j, i = np.divmod(np.arange(z.size), x.nbin)
                yield pd.DataFrame({"file": name, "ix": i, "iy": j, "x": x.min + (i + 0.5) * x.interval, "y": y.min + (j + 0.5) * y.interval, "z": z.ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, " + SCHEMA)


def read_columns(spark: SparkSession, path: str, names: list[str], placed: bool = False) -> DataFrame:
    """Columns of numbers in text, split by white space; comments (#) and empty lines are skipped, a line of other arity is an error.

    placed: adds `line`, which orders lines as they stand in their files, these by name.
    """
    text = spark.read.text(path)
    if placed:
        text = text.select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("line"))
    own = ["line"] if placed else []
    lines = text.select(F.trim(F.regexp_replace("value", "#.*", "")).alias("v"), *own).filter("v <> ''")
    cells = lines.select(F.split("v", r"\s+").alias("c"), "v", *own)
    wrong = F.size("c") != len(names)
    return cells.select(*[F.when(wrong, F.raise_error(F.concat(F.lit("wrong number of columns: "), F.col("v"))).cast("double")).otherwise(F.col("c")[i].cast("double")).alias(n) for i, n in enumerate(names)], *own)


def read_rectangles(spark: SparkSession, path: str) -> DataFrame:
    """rect_id (place in the file), excluded, xlow, xup, ylow, yup of lines of four bounds, some marked `exclude`."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "v"))
    lines = lines.select("line", F.trim(F.regexp_replace("v", "#.*", "")).alias("v")).filter("v <> ''")
    parts = lines.select("line", F.col("v").startswith("exclude").alias("excluded"), F.split(F.regexp_replace("v", r"^exclude\s+", ""), r"\s+").alias("c"))
    return parts.select(F.col("line").alias("rect_id"), "excluded", *[F.col("c")[i].cast("double").alias(n) for i, n in enumerate(("xlow", "xup", "ylow", "yup"))])


def synthetic_terrain(spark: SparkSession, kind: str, n: int = 41, height: float = 100.0, radius: float = 200.0, step: float = 10.0) -> DataFrame:
    """ix, iy, x, y, z of a cylinder, square_prism, cone, square_pyramid or gaussian around the middle of n by n cells."""
    cells = spark.range(n).select(F.col("id").cast("int").alias("ix")).crossJoin(spark.range(n).select(F.col("id").cast("int").alias("iy")))
    x, y = ((F.col(i) - (n - 1) / 2) * step for i in ("ix", "iy"))
    r, side = F.sqrt(x * x + y * y), F.greatest(F.abs(x), F.abs(y))
    ramp = lambda d: F.greatest(F.lit(0.0), 1 - d / radius)
    z = {"cylinder": F.when(r <= radius, 1.0).otherwise(0.0), "square_prism": F.when(side <= radius, 1.0).otherwise(0.0), "cone": ramp(r), "square_pyramid": ramp(side), "gaussian": F.exp(-(r * r) / (2 * radius * radius))}[kind]
    return cells.select("ix", "iy", x.alias("x"), y.alias("y"), (z * height).alias("z"))
