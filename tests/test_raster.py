"""Rasters through filtered reads and the parallel writer."""

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from tessella.functions.axis import Axis
from tessella.sources import raster

X, Y = Axis("x", 30, -3.0, 12.0), Axis("y", 40, 100.0, 140.0)


def sample():
    z = np.arange(1200, dtype=float).reshape(40, 30) / 7
    z[3, 4] = z[39, 29] = np.nan
    return z


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    return made(tmp_path_factory.mktemp("raster"), 8), 8


def made(folder, precision):
    path = folder / f"a{precision}.g2zbin"
    path.write_bytes(raster.dumps("h", X, Y, sample(), precision))
    return str(path)


def same(a, b):
    return np.array_equal(a, b, equal_nan=True)


@pytest.mark.parametrize("precision", [4, 8])
def test_both_precisions_are_read_to_the_bit(spark, tmp_path, precision):
    path = made(tmp_path, precision)
    got = np.full((40, 30), 0.0)
    for r in raster.scan(spark, path, cells=100).collect():
        got[r.iy, r.ix] = r.z
        assert r.x == -3 + (r.ix + 0.5) * 0.5 and r.y == 100 + (r.iy + 0.5)
    assert same(got, sample().astype(f"f{precision}").astype(float))


WHERE = [
    ([("iy", "=", 7)], "iy = 7", (7, 8, 0, 30)),
    ([("iy", ">=", 10), ("iy", "<", 20), ("ix", ">", 25)], "iy >= 10 AND iy < 20 AND ix > 25", (10, 20, 26, 30)),
    ([("y", ">", 110.5), ("y", "<=", 112.5)], "y > 110.5 AND y <= 112.5", (11, 13, 0, 30)),
    ([("x", "<", -2.0), ("iy", "in", (5, 9))], "x < -2 AND iy IN (5, 9)", (5, 10, 0, 2)),
    ([("x", ">=", 0.25), ("x", "<=", 0.25)], "x = 0.25", (0, 40, 6, 7)),
    ([("iy", ">", 100)], "iy > 100", (0, 0, 0, 0)),
    ([], "z > 100", (0, 40, 0, 30)),
]


@pytest.mark.parametrize("where, condition, span", WHERE, ids=[c for _, c, _ in WHERE])
def test_a_filtered_read_touches_only_its_lines(spark, file, where, condition, span):
    path, precision = file
    whole = raster.scan(spark, path)
    want = {(r.ix, r.iy): r.z for r in whole.filter(condition).collect()}
    df = raster.scan(spark, path, where, cells=60)
    got = {(r.ix, r.iy): r.z for r in df.filter(condition).collect()}
    assert got.keys() == want.keys() and all(same(got[k], want[k]) for k in got)
    # a table is the same whatever is asked of it before
    assert whole.count() == 1200 and (not where or df.count() == len(want))
    first, last, start, end = span
    parts = raster._Reader(path, 60, ("z",), where).partitions()
    assert sorted(j for p in parts for j in range(p.first, p.last)) == list(range(first, last)) and {(p.start, p.end) for p in parts} <= {(start, end)}


def test_conditions_that_choose_no_lines(spark, file):
    for where in ([("z", "=", 1.0)], [("iy", "like", 1)]):
        with pytest.raises(ValueError, match="not a condition"):
            raster.scan(spark, file[0], where)


def test_bytes_that_are_read(file, monkeypatch):
    path, precision = file
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def read_at(self, n, at):
            read.append(n)
            return self.f.read_at(n, at)

    class Store:
        def open_input_file(self, place):
            return Counted(pyarrow.fs.LocalFileSystem().open_input_file(place))

    monkeypatch.setattr(raster, "store", lambda p: (Store(), p))
    for where, cells in (([("iy", "=", 7)], 30), ([("ix", "=", 3)], 40), ([("y", "<", 102.0), ("x", ">", 8.9)], 12), ([], 1200)):
        read.clear()
        reader = raster._Reader(path, 100, ("z",), where)
        rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
        assert rows == cells and sum(read) == cells * precision


def test_only_the_columns_asked_for(spark, file):
    df = raster.scan(spark, file[0], columns=["z", "iy"])
    assert df.columns == ["z", "iy"] and df.filter("iy = 3").count() == 30
    assert df.agg(F.max("iy")).first()[0] == 39
    assert raster.scan(spark, file[0], [("ix", "=", 3)], ["z"]).columns == ["z"]


@pytest.mark.parametrize("blocks, precision", [(1, 8), (16, 4), (99, 8)])
def test_many_partitions_write_one_file(spark, tmp_path_factory, tmp_path, blocks, precision):
    path = made(tmp_path_factory.mktemp("from"), precision)
    cells = raster.scan(spark, path).repartition(7)
    out = str(tmp_path / "out.g2zbin")
    raster.save(cells, out, X, Y, blocks, precision, "h")
    assert open(out, "rb").read() == open(path, "rb").read() and [p.name for p in tmp_path.iterdir()] == ["out.g2zbin"]
    # over a file that is there; missing cells are NaN
    raster.save(cells.filter("iy < 2 AND ix > 0"), f"file://{out}", X, Y, blocks, precision)
    name, x, y, z = raster.loads(open(out, "rb").read())
    want = sample().astype(f"f{precision}").astype(float)
    want[2:], want[:, 0] = np.nan, np.nan
    assert same(z, want) and (x.nbin, y.max) == (30, 140.0)


def test_what_can_not_be_written(spark, tmp_path, file):
    cells = raster.scan(spark, file[0])
    with pytest.raises(Exception, match="outside the block"):
        raster.save(cells.withColumn("ix", F.col("ix") + 1), str(tmp_path / "o"), X, Y, 3)
    with pytest.raises(Exception, match="as many partitions"):
        cells.repartition(3).write.format("g2zbin").options(nx=30, xmin=0, xmax=1, ny=40, ymin=0, ymax=1).mode("append").save(str(tmp_path / "o"))
    with pytest.raises(Exception, match="in place"):
        raster.save(cells, "s3://bucket/o", X, Y, 3)
    assert not (tmp_path / "o").exists()
