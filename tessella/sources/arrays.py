"""Binary panel arrays: panels with their grids, groups and elements, one after the other and of no fixed length.

Where a panel begins is only known once the one before is read, and an element is followed by as many changes as its ray has. So one pass walks each file, a
file in a task, and keeps an index: where each panel's grid stands, and where every BLOCK-th element begins. Rows are then read from these places by as many
tasks as there are blocks, in any order.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.windows import stored
from tessella.sources.raster import store

#: Elements that a task reads in one go.
BLOCK = 16_384
PIECE = 1 << 20

# Fixed values of the format: what stands one after the other.
AXIS = [("name", "text"), ("nbin", "i"), ("min", "d"), ("max", "d"), ("interval", "d")]
GRID = [("grid", "text"), *[(f"x_{n}", k) for n, k in AXIS], *[(f"y_{n}", k) for n, k in AXIS], ("label", "text"), ("cells", "triples"), ("owner", "i"), ("group_avail", "bools"), *[(f"sum_{i}", "doubles") for i in range(5)]]
GRID += [("avail", "lines of bools"), ("signal", "lines of doubles"), ("noise_poi", "lines of doubles"), ("noise_det", "lines of doubles"), ("grouped", "?")]
GROUP_VALUES = ["dens_lower", "dens_center", "dens_upper", "delta_nmuon_lower", "delta_nmuon_center", "delta_nmuon_upper", "volume", "eff_low", "eff_cnt", "eff_upp"]
GRID += [(n, "doubles") for n in GROUP_VALUES]
PANEL = [("detid", "i"), ("name", "text"), *[(n, "d") for n in ("px", "py", "pz", "vx", "vy", "vz", "hori", "vert", "dept", "n_unit", "days")], ("angle_unit", "i"), ("n_element", "i")]
GROUPING = [("name", "text"), *[(f"init_{i}", "d") for i in range(2)], ("avail", "?"), *[(f"least_{i}", "d") for i in range(4)], *[(f"run_{i}", "?") for i in range(3)], *[(f"start_{i}", "i") for i in range(3)], ("trigger", "d")]
GROUPING += [("least_x", "i"), ("least_y", "i"), ("prefer_x", "?"), ("loops", "i"), ("manual", "i"), ("read", "bools"), ("paths", "texts")]
FILE = [("architecture", "text"), ("little", "?"), ("pointer", "H"), ("name", "text"), ("n_all", "i"), ("paths", "texts"), ("n_panels", "Q")]
#: Of an element, before its changes: whole numbers first, then places, and so on.
ELEMENT = [("unique_index", "i"), ("detid", "i"), ("id_in_this", "i"), *[(n, "d") for n in ("px", "py", "pz", "vx", "vy", "vz", "txmin", "txmax", "tymin", "tymax")], ("angle_unit", "i")]
ELEMENT += [(n, "d") for n in ("effective_area", "solid_angle", "exposure", "pl", "dl", "flux", "signal", "noise_det", "noise_poi", "proj_density", "proj_density_lower", "proj_density_upper", "eff_low", "eff_cnt", "eff_upp")]
RECORD = "<" + "".join(k for _, k in ELEMENT)
CHANGE = np.dtype([("tf_in", "u1"), ("dist", "<f8")])


class Walker:
    """Reads what a layout says from a place in a file onwards."""

    def __init__(self, file: Any, at: int = 0):
        self.file, self.at, self.held, self.start = file, at, b"", at

    def raw(self, n: int) -> bytes:
        begin = self.at - self.start
        if begin < 0 or begin + n > len(self.held):
            self.held, self.start, begin = self.file.read_at(max(n, PIECE), self.at), self.at, 0
        out = self.held[begin : begin + n]
        if len(out) != n:
            raise EOFError("a panel array that is cut off")
        self.at += n
        return out

    def one(self, kind: str) -> Any:
        return struct.unpack(f"<{kind}", self.raw(struct.calcsize(f"<{kind}")))[0]

    def read(self, kind: str) -> Any:
        if kind == "text":
            return self.raw(self.one("Q")).decode("utf-8", "replace")
        if kind == "doubles":
            return np.frombuffer(self.raw(8 * self.one("Q")), "<f8")
        if kind == "bools":
            return np.frombuffer(self.raw(self.one("I")), "u1") != 0
        if kind == "triples":
            return np.frombuffer(self.raw(12 * self.one("Q")), "<i4").reshape(-1, 3)
        if kind == "texts":
            return [self.read("text") for _ in range(self.one("Q"))]
        if kind.startswith("lines of "):
            return [self.read(kind.removeprefix("lines of ")) for _ in range(self.one("Q"))]
        return self.one(kind)

    def walk(self, layout: list[tuple[str, str]]) -> dict[str, Any]:
        return {name: self.read(kind) for name, kind in layout}


def axis_end(axis: dict[str, Any], k: str) -> float:
    """The largest value of an axis: older files have that less one bin."""
    low, high, step, n = (axis[f"{k}_{c}"] for c in ("min", "max", "interval", "nbin"))
    for more in (0.0, step):
        if abs(high + more - low - n * step) <= 0.01 * step:
            return high + more
    raise ValueError("an axis whose interval doesn't fit its bounds")


def _indexed(file: Any, block: int) -> Iterator[dict[str, Any]]:
    """Of each panel its own values and the places of its grid and of every block of elements."""
    w = Walker(file)
    head = w.walk(FILE)
    if not head["little"] or head["pointer"] != 8:
        raise ValueError("a panel array of another architecture")
    for number in range(head["n_panels"]):
        grid_at = w.at
        grid = w.walk(GRID)
        own = w.walk(PANEL)
        nx, ny = grid["x_nbin"], grid["y_nbin"]
        blocks = []
        for k in range(nx * ny):
            if k % block == 0:
                blocks.append({"first": k, "n": min(block, nx * ny - k), "at": w.at})
            w.at += struct.calcsize(RECORD)
            changes = w.one("Q")
            w.at += CHANGE.itemsize * changes
        w.walk(GROUPING)
        yield own | {"array": head["name"], "panel": number, "nbinx": nx, "txmin": grid["x_min"], "txmax": axis_end(grid, "x"), "nbiny": ny, "tymin": grid["y_min"], "tymax": axis_end(grid, "y"), "grid_at": grid_at, "blocks": blocks}


KINDS = {"i": "int", "d": "double", "text": "string"}
ARROW = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "long": pa.int64()}
PANELS = [("file", "string"), ("array", "string"), ("panel", "int"), *[(n, KINDS[k]) for n, k in PANEL], ("nbinx", "int"), ("txmin", "double"), ("txmax", "double"), ("nbiny", "int"), ("tymin", "double"), ("tymax", "double"), ("grid_at", "long")]


def _over_files(run: Callable[[Any, dict], Iterator[dict]], schema: pa.Schema) -> Callable:
    """Rows (with file) to the rows that run makes of each, with the file opened."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = store(row["file"])
                with fs.open_input_file(path) as f:
                    held = []
                    for out in run(f, row):
                        held.append({"file": row["file"]} | out)
                        if len(held) == BLOCK:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return of


def index(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """A row for each panel of the arrays of a path (which Spark lists): its values, axes, and where its grid and elements stand. Written as a table."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    places = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("at", pa.int64())]))
    schema = pa.schema([*[(n, ARROW[k]) for n, k in PANELS], ("blocks", places)])
    names = ", ".join([*[f"{n} {k}" for n, k in PANELS], "blocks array<struct<first: int, n: int, at: long>>"])
    return stored(files.mapInArrow(_over_files(lambda f, row: _indexed(f, block), schema), names), "panels")


def elements(panels: DataFrame) -> DataFrame:
    """Every element of the panels of `index`: file, panel, ix, iy, its values, and changes (where its ray enters and leaves). A block is one task's work."""
    spread = panels.select("file", "panel", "nbinx", F.explode("blocks").alias("b")).select("file", "panel", "nbinx", "b.*")
    spread = stored(spread, "blocks")
    fields = [(n, pa.int32() if k == "i" else pa.float64()) for n, k in ELEMENT]
    changes = pa.list_(pa.struct([("tf_in", pa.bool_()), ("dist", pa.float64())]))
    schema = pa.schema([("file", pa.string()), ("panel", pa.int32()), ("ix", pa.int32()), ("iy", pa.int32()), *fields, ("changes", changes)])

    def run(f: Any, row: dict) -> Iterator[dict]:
        w = Walker(f, row["at"])
        for k in range(row["first"], row["first"] + row["n"]):
            values = struct.unpack(RECORD, w.raw(struct.calcsize(RECORD)))
            found = np.frombuffer(w.raw(9 * w.one("Q")), CHANGE)
            yield {"panel": row["panel"], "ix": k % row["nbinx"], "iy": k // row["nbinx"], **dict(zip((n for n, _ in ELEMENT), values, strict=True)), "changes": [{"tf_in": bool(a), "dist": float(b)} for a, b in found.tolist()]}

    names = ", ".join(["file string", "panel int", "ix int", "iy int", *[f"{n} {KINDS[k]}" for n, k in ELEMENT], "changes array<struct<tf_in: boolean, dist: double>>"])
    # as many tasks as blocks, whose rows say nothing about their size
    return spread.repartition(max(1, spread.count())).mapInArrow(_over_files(run, schema), names)


def groups(panels: DataFrame) -> DataFrame:
    """Every group of the panels of `index`: file, panel, detid, igroup, is_avail, and its values (null where the file has none)."""
    schema = pa.schema([("file", pa.string()), ("panel", pa.int32()), ("detid", pa.int32()), ("igroup", pa.int32()), ("is_avail", pa.bool_()), *[(n, pa.float64()) for n in GROUP_VALUES]])

    def run(f: Any, row: dict) -> Iterator[dict]:
        grid = Walker(f, row["grid_at"]).walk(GRID)
        at = lambda values, g: values[g].item() if g < len(values) else None
        for g in np.unique(grid["cells"][:, 0]).tolist():
            yield {"panel": row["panel"], "detid": row["detid"], "igroup": g, "is_avail": at(grid["group_avail"], g), **{n: at(grid[n], g) for n in GROUP_VALUES}}

    names = ", ".join(["file string", "panel int", "detid int", "igroup int", "is_avail boolean", *[f"{n} double" for n in GROUP_VALUES]])
    some = panels.select("file", "panel", "detid", "grid_at")
    return some.mapInArrow(_over_files(run, schema), names)


def bins(panels: DataFrame) -> DataFrame:
    """Every bin of the panels of `index`: file, panel, detid, ix, iy, igroup (null in no group), is_avail, signal, noise_poi and noise_det."""
    schema = pa.schema([("file", pa.string()), *[(n, pa.int32()) for n in ("panel", "detid", "ix", "iy", "igroup")], ("is_avail", pa.bool_()), *[(n, pa.float64()) for n in ("signal", "noise_poi", "noise_det")]])

    def run(f: Any, row: dict) -> Iterator[dict]:
        grid = Walker(f, row["grid_at"]).walk(GRID)
        group = {(x, y): g for g, x, y in grid["cells"].tolist()}
        for iy in range(grid["y_nbin"]):
            for ix in range(grid["x_nbin"]):
                at = lambda lines: lines[iy][ix].item() if iy < len(lines) and ix < len(lines[iy]) else None  # noqa: B023, E731
                yield {"panel": row["panel"], "detid": row["detid"], "ix": ix, "iy": iy, "igroup": group.get((ix, iy)), "is_avail": at(grid["avail"]), **{n: at(grid[n]) for n in ("signal", "noise_poi", "noise_det")}}

    names = "file string, panel int, detid int, ix int, iy int, igroup int, is_avail boolean, signal double, noise_poi double, noise_det double"
    return panels.select("file", "panel", "detid", "grid_at").mapInArrow(_over_files(run, schema), names)
