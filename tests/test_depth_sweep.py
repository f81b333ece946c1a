"""The depth sweep against a plain loop over panels, sizes, changes and windows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.axis import Axis
from tessella.plans import depth_sweep
from tessella.sources import sinks

HEIGHT = [[max(0.0, 80 - 1.2 * math.hypot(10 * i + 5 - 100, 10 * j + 5 - 100) + (i * 7 + j * 3) % 5) for j in range(20)] for i in range(20)]
PANELS = [dict(detid=k, nbinx=40, txmin=-1.0, txmax=1.0, nbiny=20, tymin=0.0, tymax=0.8, yaw=yaw, roll=0.0, pitch=0.0, px=px, py=py, pz=2.0, hori=0.5, vert=0.5, dept=0.03, n_unit=2, days=60.0) for k, (yaw, px, py) in enumerate([(0.3, 97.0, 3.0), (4.0, 170.0, 64.0)])]


def flux(vz, dl):
    return 1e-2 * (0.2 + vz) * (1 + dl / 1e5) ** -2


def flux_column(vz, dl):
    return F.lit(1e-2) * (F.lit(0.2) + vz) * F.pow(1 + dl / 1e5, F.lit(-2.0))


def path(p, v):
    """Metres of a ray in the pillars."""
    out = 0.0
    for i in range(20):
        for j in range(20):
            lo, hi = np.array([10.0 * i, 10.0 * j, 0.0]), np.array([10.0 * i + 10, 10.0 * j + 10, HEIGHT[i][j]])
            with np.errstate(divide="ignore", invalid="ignore"):
                a, b = (lo - p) / v, (hi - p) / v
            t0, t1 = max(0.0, np.minimum(a, b).max()), np.maximum(a, b).min()
            out += max(0.0, t1 - t0)
    return out


def chord(p, v, center, r, height):
    x, y = p[0] - center[0], p[1] - center[1]
    a, b, c = v[0] ** 2 + v[1] ** 2, x * v[0] + y * v[1], x * x + y * y - r * r
    if b * b - a * c <= 0:
        return 0.0
    s0, s1 = ((-b + s * math.sqrt(b * b - a * c)) / a for s in (-1, 1))
    if v[2]:
        z0, z1 = sorted((0.0, height / v[2]))
        s0, s1 = max(s0, z0), min(s1, z1)
    return max(0.0, s1 - max(s0, 0.0))


def plain(sweep, exposure, rows):
    """rows: (panel, ix, iy) -> place, direction and path."""
    out = []
    cx, cy = sweep.center
    for panel in PANELS:
        d, w, h = math.hypot(cx - panel["px"], cy - panel["py"]), 2.0 / 40, 0.8 / 20
        for n in range(1, 20):
            if math.atan((n - 1) * w) >= math.asin(sweep.most / 2 / d):
                break
            angle = math.atan(n * w)
            r = d * math.sin(angle)
            if 2 * r < sweep.least:
                continue
            near = [HEIGHT[i][j] for i in range(20) for j in range(20) if math.hypot(10 * i + 5 - cx, 10 * j + 5 - cy) <= r]
            top = min(near) if near else HEIGHT[int(cx // 10)][int(cy // 10)]
            surface = HEIGHT[int(cx // 10)][int(cy // 10)]
            height, tymax = top - 2.0, 0.8
            if 2 * r > surface - 2.0:
                continue
            if sweep.mode == "ddl":
                if height <= 0:
                    continue
                tymax = min(0.8, tymax if 2 * r <= height else math.tan(math.asin(height / (2 * r))))
            half = math.tan(angle) * sweep.reach
            x0, x1 = int((-half + 1e-6 * w + 1.0) / w), int((half - 1e-6 * w + 1.0) / w)
            for i in range(max(1, math.floor(((tymax - half) - half) / sweep.step))):
                middle = tymax - half - i * sweep.step
                if height - (middle + half) * d < 0:
                    continue
                y0, y1 = (min(19, max(0, math.floor((t + s * 1e-6 * h) / h))) for t, s in ((middle - half, 1), (middle + half, -1)))
                for delta in sweep.deltas:
                    base = modi = 0.0
                    for ix in range(x0, x1 + 1):
                        for iy in range(y0, y1 + 1):
                            p, v, pl = rows[panel["detid"], ix, iy]
                            more = delta * (2 * r if sweep.mode == "ddl" else chord(p, v, (cx, cy), r, height))
                            sot = exposure[panel["detid"], ix, iy]
                            base += flux(v[2], pl * sweep.base_density) * sot
                            modi += flux(v[2], max(0.0, pl * sweep.base_density + more)) * sot
                    for amp in sweep.amplifiers:
                        z = (modi - base) * amp / math.sqrt(max(1e-12, (base + modi) * amp))
                        pv = math.erfc(abs(z) / math.sqrt(2)) / (1 if sweep.both_sides else 2)
                        for alpha in sweep.alphas:
                            rise = surface - top
                            out.append((panel["detid"], -half, half, middle - half, middle + half, height - (middle + half) * d + rise, height - (middle - half) * d + rise, 2 * r, delta, base * amp, modi * amp, (modi - base) * amp, z, pv, alpha, amp, int(pv < alpha)))
    return out


@pytest.fixture(scope="module")
def mountain(spark):
    panels = spark.createDataFrame([tuple(p.values()) for p in PANELS], list(PANELS[0]))
    pillars = spark.createDataFrame([(i, j, 0.0, HEIGHT[i][j]) for i in range(20) for j in range(20)], "ix int, iy int, zmin double, zmax double")
    return panels, pillars, Axis("x", 20, 0.0, 200.0), Axis("y", 20, 0.0, 200.0)


@pytest.mark.parametrize("mode", ["ddl", "cylinder"])
def test_against_a_plain_loop(spark, mountain, mode, tmp_path):
    panels, pillars, x, y = mountain
    sweep = depth_sweep.Sweep((103.0, 98.0), 2000.0, [-400.0, 300.0], [0.5, 2.0], [0.3, 0.1], least=12.0, most=45.0, step=0.06, reach=1.0, both_sides=mode == "cylinder", mode=mode)
    got = depth_sweep.swept(panels, pillars, x, y, sweep, flux_column)
    assert tuple(got.columns) == sinks.SIGNIFICANCE
    aimed = depth_sweep.through(depth_sweep.turned_to(panels, sweep.center), x, y, pillars).collect()
    rows, exposure = {}, {}
    for r in aimed:
        p, v = np.array([r.px, r.py, r.pz]), np.array([r.vx, r.vy, r.vz])
        # turned to the object: the middle between the bins beside it points there
        panel = PANELS[r.detid]
        ahead = np.array([103.0 - panel["px"], 98.0 - panel["py"], 0.0])
        ahead /= np.linalg.norm(ahead)
        tx, ty = -1 + (r.ix + 0.5) * 0.05, (r.iy + 0.5) * 0.04
        want = ahead + tx * np.array([ahead[1], -ahead[0], 0]) + np.array([0, 0, ty])
        assert np.allclose(v, want / np.linalg.norm(want), atol=1e-9)
        rows[r.detid, r.ix, r.iy] = (p, v, r.pl)
        exposure[r.detid, r.ix, r.iy] = r.sot
    for k in list(rows)[::97]:
        assert rows[k][2] == pytest.approx(path(*rows[k][:2]), abs=1e-6)
    want = sorted(plain(sweep, exposure, rows))
    found = sorted(tuple(r) for r in got.collect())
    assert len(found) == len(want) > 100
    key = lambda r: (r[0], round(r[7], 6), round(r[3], 4), r[8], r[15], r[14])
    for a, b in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert np.allclose(a[1:5], b[1:5], atol=1e-6) and np.allclose(a[5:], b[5:], rtol=1e-6, atol=1e-9)
    assert 0 < sum(r[-1] for r in found) < len(found)
    sinks.write_significance(got, str(tmp_path / "list"))
    assert spark.read.option("header", True).csv(str(tmp_path / "list")).count() == sum(r[5] >= 0 for r in found)


def test_order_and_nothing_to_see(spark, mountain):
    panels, pillars, x, y = mountain
    sweep = depth_sweep.Sweep((103.0, 98.0), 2000.0, [-400.0, 300.0], [1.0], [0.1, 0.3], least=8.0, most=30.0, step=0.1)
    rows = depth_sweep.in_order(depth_sweep.swept(panels.filter("detid = 0"), pillars, x, y, sweep, flux_column)).collect()
    keys = [(-r.alpha, r.signal_amp, -r.ddens, r.obsize, r.depth_anom_top) for r in rows]
    assert keys == sorted(keys) and rows
    sweep.least = 1000.0
    assert depth_sweep.swept(panels, pillars, x, y, sweep, flux_column).count() == 0
