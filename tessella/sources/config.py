"""Run configurations: JSON with comments, flattened views of it, and sweeps over its lists."""

from __future__ import annotations

import itertools
import json
import re
from typing import Any

_COMMENT = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.DOTALL)
#: Names of the last stage.
STAGES = {"build_geometry": 3, "trace_path_lengths": 4, "compute_prior": 5, "build_observation_matrix": 6, "invert_density": 7, "analyze_errors": 8}


def loads(text: str) -> Any:
    """JSON in which // and /* */ comments stand outside strings."""
    return json.loads(_COMMENT.sub(lambda m: m[0] if m[0].startswith('"') else " ", text))


def flat(value: Any, path: str = "") -> dict[str, Any]:
    """Dotted paths of the leaves."""
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
    if items is None:
        return {path: value}
    return {k: v for key, x in items for k, v in flat(x, f"{path}.{key}" if path else str(key)).items()}


def end_stage(token: str | int) -> int:
    """A stage by its name; a whole number is taken as it is."""
    token = str(token)
    if token.isdigit():
        return int(token)
    if token not in STAGES:
        raise ValueError(f"no such stage: {token}; it is a number from 3 to 8 or one of {', '.join(STAGES)}")
    return STAGES[token]


def sweep_points(sigmas: list[float], lengths: list[float], densities: list, diagonals: list[float] | None = None) -> list[dict]:
    """All combinations: densities outermost, then sigmas, lengths and diagonals; without diagonals a point's is its sigma.

    densities: one for all, or four (prior, upper, lower and lateral shell); without any, -1 stands for the configured ones.
    """
    quads = [list(map(float, d)) if isinstance(d, (list, tuple)) else [float(d)] * 4 for d in densities] or [[-1.0] * 4]
    out = []
    for quad, sigma, length in itertools.product(quads, sigmas, lengths):
        for diagonal in diagonals or [sigma]:
            whole = [int(v) for v in (sigma, length, diagonal, *quad)]
            label = "sr{}_cl{}_srd{}_p{}_u{}_l{}_lat{}".format(*whole)
            out.append({"index": len(out), "density": quad, "sigma_rho": sigma, "corr_length": length, "sigma_rho_diag": diagonal, "label": label})
    return out


def errors_wanted(mode: str, index: int, count: int, selected: list[int] | None = None) -> bool:
    """Whether a point of a sweep has its errors analysed: none, all, last or selected; any other word is none."""
    return {"all": True, "last": index == count - 1, "selected": index in (selected or [])}.get(mode, False)
