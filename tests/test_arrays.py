"""Panel arrays that are written here, read as panels, elements, groups and bins."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tessella.sources import arrays


def packed(kind, value):
    if kind == "text":
        return struct.pack("<Q", len(value.encode())) + value.encode()
    if kind == "doubles":
        return struct.pack(f"<Q{len(value)}d", len(value), *value)
    if kind == "bools":
        return struct.pack(f"<I{len(value)}?", len(value), *value)
    if kind == "triples":
        return struct.pack("<Q", len(value)) + b"".join(struct.pack("<3i", *t) for t in value)
    if kind == "texts":
        return struct.pack("<Q", len(value)) + b"".join(packed("text", t) for t in value)
    if kind.startswith("lines of "):
        return struct.pack("<Q", len(value)) + b"".join(packed(kind.removeprefix("lines of "), v) for v in value)
    return struct.pack(f"<{kind}", value)


EMPTY = {"text": "", "doubles": [], "bools": [], "triples": [], "texts": [], "i": 0, "d": 0.0, "?": False, "Q": 0, "H": 8}


def laid(layout, **values):
    return b"".join(packed(k, values.get(n, EMPTY.get(k, []))) for n, k in layout)


def made(panels, rng, older=False, **head):
    """Bytes of an array, and its rows. panels: (detid, nx, ny)."""
    data = laid(arrays.FILE, **({"architecture": "x", "little": True, "pointer": 8, "name": "array ü", "paths": ["a", "bb"], "n_panels": len(panels)} | head))
    rows, bins, groups = [], [], []
    for number, (detid, nx, ny) in enumerate(panels):
        cells = [(ix // 2 + 10 * (iy // 2), ix, iy) for ix in range(nx) for iy in range(ny) if (ix, iy) != (0, 0)]
        avail, signal = [[(ix + iy) % 2 == 0 for ix in range(nx)] for iy in range(ny)], [[float(ix + 100 * iy) for ix in range(nx)] for iy in range(ny)]
        centre = [g / 8 for g in range(1 + max(g for g, *_ in cells))]
        axis = {f"{k}_{n}": v for k, n_ in (("x", nx), ("y", ny)) for n, v in (("name", k), ("nbin", n_), ("min", -1.0), ("max", -1.0 + 0.5 * (n_ - older)), ("interval", 0.5))}
        data += laid(arrays.GRID, **axis, label="g", cells=cells, owner=detid, group_avail=[g % 3 > 0 for g in range(len(centre))], avail=avail, signal=signal, noise_poi=signal, dens_center=centre)
        data += laid(arrays.PANEL, detid=detid, name=f"panel {detid}", px=1.5, days=120.0, n_element=nx * ny)
        for k in range(nx * ny):
            values = {n: rng.randrange(99) if kind == "i" else rng.random() for n, kind in arrays.ELEMENT}
            changes = [(rng.random() < 0.5, rng.random()) for _ in range(rng.choice([0, 0, 2, 5]))]
            data += laid(arrays.ELEMENT, **values) + struct.pack("<Q", len(changes)) + b"".join(struct.pack("<?d", *c) for c in changes)
            rows.append((number, k % nx, k // nx, *values.values(), changes))
        data += laid(arrays.GROUPING, read=[True, False], paths=["list.txt"])
        bins += [(number, ix, iy, ix // 2 + 10 * (iy // 2) if (ix, iy) != (0, 0) else None, avail[iy][ix], signal[iy][ix], None) for ix in range(nx) for iy in range(ny)]
        groups += [(number, g, g % 3 > 0, centre[g], None) for g in {g for g, *_ in cells}]
    return data, rows, bins, groups


@pytest.mark.parametrize("older, block", [(False, 7), (True, 1000)])
def test_arrays_are_read(spark, tmp_path, older, block):
    rng = random.Random(4)
    one, rows, bins, groups = made([(3, 5, 4), (9, 8, 6)], rng, older)
    other, more, *_ = made([(1, 2, 2)], rng, older)
    (tmp_path / "a.bin").write_bytes(one + b"what follows the panels")
    (tmp_path / "b.bin").write_bytes(other)
    panels = arrays.index(spark, str(tmp_path / "*.bin"), block)
    got = {(r.file[-5:], r.panel): r for r in panels.collect()}
    assert set(got) == {("a.bin", 0), ("a.bin", 1), ("b.bin", 0)}
    r = got["a.bin", 1]
    assert (r.detid, r.name, r.array, r.nbinx, r.nbiny, r.txmin, r.txmax, r.tymax, r.days, r.px) == (9, "panel 9", "array ü", 8, 6, -1.0, 3.0, 2.0, 120.0, 1.5)
    assert [(b.first, b.n) for b in r.blocks] == [(k, min(block, 48 - k)) for k in range(0, 48, block)]
    found = arrays.elements(panels)
    names = ["panel", "ix", "iy", *[n for n, _ in arrays.ELEMENT]]
    told = lambda name: sorted((*[x[n] for n in names], [tuple(c) for c in x.changes]) for x in found.filter(F.col("file").endswith(name)).collect())
    assert told("a.bin") == sorted(rows) and told("b.bin") == sorted(more)
    some = lambda df: df.filter(F.col("file").endswith("a.bin")).collect()
    assert sorted(map(repr, ((x.panel, x.ix, x.iy, x.igroup, x.is_avail, x.signal, x.noise_det) for x in some(arrays.bins(panels))))) == sorted(map(repr, bins))
    assert sorted(map(repr, ((x.panel, x.igroup, x.is_avail, x.dens_center, x.eff_cnt) for x in some(arrays.groups(panels))))) == sorted(map(repr, groups))


def test_arrays_that_can_not_be_read(spark, tmp_path):
    data, *_ = made([(3, 5, 4)], random.Random(1))
    for name, content, said in (("cut", data[:-30], "cut off"), ("big", made([(3, 2, 2)], random.Random(1), little=False)[0], "architecture")):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(Exception, match=said):
            arrays.index(spark, str(tmp_path / name))
    with pytest.raises(ValueError, match="interval"):
        arrays.axis_end({"x_min": 0.0, "x_max": 9.0, "x_interval": 1.0, "x_nbin": 4}, "x")
