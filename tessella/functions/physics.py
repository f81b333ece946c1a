"""Flux clamps, efficiency models and covariance kernels as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.stats import asymmetric_draw


#: A muon's mass in GeV, square centimetres in a square metre, and the margin within a table's bounds.
MUON_MASS, CM2_TO_M2, MARGIN = 0.105658, 1e4, 1e-8


def clamp_path(dl: Column, floor: float, ceil: float) -> Column:
    """Density length within a table: nothing and less becomes the floor."""
    return F.when((dl <= 0) | (dl < floor), floor).when(dl > ceil, ceil).otherwise(dl)


def clamp_to_table(dl: Column, low: float, high: float) -> Column:
    """Density length a hair within a table's bounds, where a look-up can't fail."""
    return F.greatest(F.lit(low * (1 + MARGIN)), F.least(F.lit(high * (1 - MARGIN)), dl))


def checked_cosine(cosine: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A cosine, or an error outside the table's."""
    return F.when((cosine >= low) & (cosine <= high), cosine).otherwise(F.raise_error(F.lit("cosine outside the table")).cast("double"))


def projected_density(pl: Column, dl: Column, least_pl: float, least_dl: float) -> Column:
    """Mean density along a path; -1 where path or density length is too short."""
    return F.when((pl < least_pl) | (dl < least_dl), -1.0).otherwise(F.try_divide(dl, pl))


def changed_path(dl: Column, change: Column) -> Column:
    """Density length with a change; never below 0."""
    return F.greatest(F.lit(0.0), dl + change)


def depth_below(surface: Column, z: Column, distance: Column, elevation: Column) -> Column:
    """How deep a ray passes below a surface at a horizontal distance. Elevation in radians."""
    return surface - (z + distance * F.tan(elevation))


def kinetic(momentum: Column) -> Column:
    """Kinetic energy of a muon in GeV by its momentum in GeV/c."""
    return F.sqrt(momentum * momentum + MUON_MASS**2) - MUON_MASS


def per_energy(per_momentum: Column, momentum: Column) -> Column:
    """A flux for each GeV of energy and square metre by that for each GeV/c of momentum and square centimetre."""
    return per_momentum * CM2_TO_M2 * F.sqrt(momentum * momentum + MUON_MASS**2) / momentum


def bilinear(fx: Column, fy: Column, z00: Column, z10: Column, z01: Column, z11: Column) -> Column:
    """Nodes lie at lower bin edges; fx and fy are 0 to 1 within the cell. A missing neighbour is replaced by the node itself."""
    z10, z01 = F.coalesce(z10, z00), F.coalesce(z01, z00)
    z11 = F.coalesce(z11, z10 + z01 - z00)
    return z00 * (1 - fx) * (1 - fy) + z10 * fx * (1 - fy) + z01 * (1 - fx) * fy + z11 * fx * fy


def expected(flux: Column, area: Column, solid: Column, seconds: Column) -> Column:
    return flux * area * solid * seconds


def seen(count: Column, low: Column, central: Column, high: Column, by_central: bool = False, by_draw: bool = False, key: tuple[Column, ...] = (), seed: int = 42) -> Column:
    """The count that a bin shows by its efficiency: the central one if that is asked for, else one drawn between low and high for each key, else all of it."""
    if by_central:
        return count * central
    if by_draw:
        below, above = central - low, high - central
        drawn = asymmetric_draw(central, below, above, *key, seed=seed)
        return count * F.when(below + above > 0, drawn).otherwise(central)
    return count


#: Names and defaults of the parameters in the files of efficiency models.
MODEL_PARAMETERS = {"flat": {}, "poly": {"coef": [1.0]}, "gauss": {"mu": 0.0, "sigma": 1.0}, "cos_power": {"n": 1.0, "cutoff_deg": None}, "sigmoid": {"x0": 1.0, "w": 0.1}, "step": {"x0": 1.0, "w": 0.1, "inner": 1.0, "outer": 0.0}}


def efficiency(kind: str, x: Column, given: dict) -> Column:
    """One axis of an efficiency model at a tangent x; parameters by the names that files have them under."""
    if kind not in MODEL_PARAMETERS:
        raise ValueError(f"no such efficiency function: {kind}")
    p = MODEL_PARAMETERS[kind] | given
    if p.get("sigma") == 0 or p.get("w") == 0:
        raise ValueError(f"{kind} needs a width that isn't 0")
    if kind == "poly":
        out = F.lit(0.0)
        for c in reversed(p["coef"]):
            out = out * x + c
        return out
    if kind == "gauss":
        return F.exp(-(x - p["mu"]) * (x - p["mu"]) / (2 * p["sigma"] ** 2))
    if kind == "cos_power":
        theta = F.atan(F.abs(x))
        power = F.pow(F.cos(theta), F.lit(p["n"]))
        return power if p["cutoff_deg"] is None else F.when(theta > math.radians(p["cutoff_deg"]), 0.0).otherwise(power)
    if kind == "flat":
        return F.lit(1.0)
    logistic = 1 / (1 + F.exp((F.abs(x) - p["x0"]) / p["w"]))
    return logistic if kind == "sigmoid" else p["outer"] + (p["inner"] - p["outer"]) * logistic


def efficiency_model(model: dict, tx: Column, ty: Column) -> tuple[Column, Column, Column]:
    """Lower, central and upper efficiency by a model as it stands in its file: base_eff, tx, ty, and sigma with base, tx and ty."""
    if "layers" in model:
        raise ValueError("a model of layers isn't one of axis functions: use k_of_n")
    axis = lambda at, x: efficiency(at.get("fn", "flat"), x, at.get("params", {}))
    sigma = model.get("sigma", {})
    return efficiency_band(model.get("base_eff", 1.0), axis(model.get("tx", {}), tx), axis(model.get("ty", {}), ty), sigma.get("base", 0.0), axis(sigma.get("tx", {}), tx), axis(sigma.get("ty", {}), ty))


def efficiency_band(base: float, ex: Column, ey: Column, sigma: float, hx: Column, hy: Column) -> tuple[Column, Column, Column]:
    """Lower, central and upper efficiency: the product within 0 and 1, and a half width that leaves it there."""
    e = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * ex * ey))
    half = F.least(F.greatest(F.lit(0.0), sigma * (hx + hy) / 2), e, 1 - e)
    return e - half, e, e + half


def k_of_n(p: Column, k: int, n: int) -> Column:
    """The chance of k and more successes of n."""
    return sum((math.comb(n, i) * F.pow(p, F.lit(i)) * F.pow(1 - p, F.lit(n - i)) for i in range(k, n + 1)), F.lit(0.0))


def layered(layers: dict, r: Column, factor: Column | None = None) -> tuple[Column, Column, Column]:
    """Lower, central and upper efficiency of at least k of n layers, each with an efficiency at a tangent r and its uncertainty: n, k, per_layer and per_layer_sigma.

    factor: what all three are multiplied by (stats.shared_factor), within 0 and 1.
    """
    within = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    at, sigma, k, n = layers.get("per_layer") or {}, float(layers.get("per_layer_sigma", 0.0)), int(layers.get("k", 8)), int(layers.get("n", 10))
    p = within(efficiency(at.get("fn", "flat"), r, at.get("params", {})))
    band = [k_of_n(within(p + s * sigma), k, n) for s in (-1, 0, 1)]
    return tuple(band if factor is None else [within(e * factor) for e in band])


def kernel(kind: str, dx: Column, dy: Column, dz: Column, sigma: float, lengths: tuple[float, ...]) -> Column:
    """Covariance of two places: iso, separable (plane and depth) or ellipsoidal."""
    if kind == "iso":
        return sigma**2 * F.exp(-F.sqrt(dx * dx + dy * dy + dz * dz) / lengths[0])
    if kind == "separable":
        return sigma**2 * F.exp(-F.sqrt(dx * dx + dy * dy) / lengths[0]) * F.exp(-F.abs(dz) / lengths[1])
    if kind == "ellipsoidal":
        u, v, w = dx / lengths[0], dy / lengths[0], dz / lengths[1]
        return sigma**2 * F.exp(-F.sqrt(u * u + v * v + w * w))
    raise ValueError(f"no such kernel: {kind}")


def covariance(kind: str, same: Column, dx: Column, dy: Column, dz: Column, sigma: float, lengths: tuple[float, ...], diagonal: float = 0.0) -> Column:
    """kernel, but the variance of a place with itself (same) is its own: diagonal squared, or sigma squared if that isn't positive."""
    return F.when(same, (diagonal if diagonal > 0 else sigma) ** 2).otherwise(kernel(kind, dx, dy, dz, sigma, lengths))
