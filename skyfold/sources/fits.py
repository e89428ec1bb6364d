"""Axes of image headers, beam grids and beam file names."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions.stokes import TYPE_NAMES

_ALIASES = {"l": ("L", "X", "PX"), "m": ("M", "Y", "PY"), "freq": ("FREQ",)}


@dataclass(frozen=True)
class Axis:
    name: str
    unit: str
    grid: np.ndarray


def axes(header: Mapping[str, object]) -> list[Axis]:
    """Axes of a header: (i - (CRPIX - 1)) CDELT + CRVAL, degrees as radians.

    If every ``G<CTYPE><i>`` of an axis is there, they are its irregular grid.
    """
    out = []
    for k in range(1, int(header["NAXIS"]) + 1):  # type: ignore[call-overload]
        name = str(header[f"CTYPE{k}"]).strip()
        n = int(header[f"NAXIS{k}"])  # type: ignore[call-overload]
        unit = str(header.get(f"CUNIT{k}", "")).strip()
        keys = [f"G{name.lstrip('-')}{i + 1}" for i in range(n)]
        if all(key in header for key in keys):
            grid = np.array([float(header[key]) for key in keys])  # type: ignore[arg-type]
        else:
            step, at, first = (float(header.get(f"{x}{k}", d)) for x, d in (("CDELT", 1.0), ("CRVAL", 0.0), ("CRPIX", 1.0)))  # type: ignore[arg-type]
            grid = (np.arange(n) - (first - 1.0)) * step + at
        if unit.lower() in ("deg", "degree", "degrees"):
            grid, unit = np.radians(grid), "rad"
        out.append(Axis(name, unit, grid))
    return out


def axis_table(spark: SparkSession, header: Mapping[str, object]) -> DataFrame:
    """(axis, idx, coord) of all axes."""
    rows = [(a.name, i, float(x)) for a in axes(header) for i, x in enumerate(a.grid)]
    return spark.createDataFrame(rows, "axis string, idx int, coord double")


def beam_grids(header: Mapping[str, object], l_axis: str | None = None, m_axis: str | None = None) -> dict[str, tuple[int, np.ndarray]]:
    """(axis number, grid) of l, m and frequency; a name given as ``-X`` is reversed."""
    found = axes(header)
    out: dict[str, tuple[int, np.ndarray]] = {}
    for want, given in (("l", l_axis), ("m", m_axis), ("freq", None)):
        sign = -1.0 if given and given.startswith("-") else 1.0
        names = (given.lstrip("-").upper(),) if given else _ALIASES[want]
        for k, a in enumerate(found):
            label = a.name.upper()
            if label.lstrip("-") in names:
                flip = sign * (-1.0 if label.startswith("-") else 1.0)
                out[want] = (k + 1, a.grid * flip if want != "freq" else a.grid)
                break
        else:
            raise ValueError(f"no axis for {want}")
    return out


_TEMPLATE = re.compile(r"\$\((corr|CORR|reim|REIM)\)")


def beam_filenames(schema: str, correlations: Sequence[str | int]) -> dict[str, tuple[str, str]]:
    """(real, imaginary) file names of each correlation from a template.

    ``$(corr)`` and ``$(reim)`` stand in lower case, ``$(CORR)`` and ``$(REIM)`` in upper case.
    """
    if not re.search(r"\$\((corr|CORR)\)", schema) or not re.search(r"\$\((reim|REIM)\)", schema):
        raise ValueError("a template needs a correlation and a real or imaginary part")
    out = {}
    for c in correlations:
        name = TYPE_NAMES[c] if isinstance(c, int) else c

        def put(part: str, name: str = name) -> str:
            return _TEMPLATE.sub(lambda m: {"corr": name.lower(), "CORR": name.upper(), "reim": part, "REIM": part.upper()}[m.group(1)], schema)

        out[name.lower()] = (put("re"), put("im"))
    return out


def synthetic_beam(spark: SparkSession, n: int, n_freq: int, extent: float, freqs: Sequence[float], correlations: int = 4) -> DataFrame:
    """(l_idx, m_idx, nu_idx, corr, re, im): cos(min(65 nu 1e-9 r, 1.0881))^3 on a square grid."""
    i = F.col("id")
    at = spark.range(n * n * n_freq * correlations).select(
        F.floor(i / (n * n_freq * correlations)).cast("int").alias("l_idx"),
        (F.floor(i / (n_freq * correlations)) % n).cast("int").alias("m_idx"),
        (F.floor(i / correlations) % n_freq).cast("int").alias("nu_idx"),
        (i % correlations).cast("int").alias("corr"),
    )
    l, m = ((F.col(c) * 2.0 / (n - 1) - 1.0) * extent for c in ("l_idx", "m_idx"))
    freq = F.get(F.array(*(F.lit(float(f)) for f in freqs[:n_freq])), F.col("nu_idx"))
    across = F.least(freq * 65e-9 * F.sqrt(l * l + m * m), F.lit(1.0881))
    return at.select("*", F.pow(F.cos(across), F.lit(3.0)).alias("re"), F.lit(0.0).alias("im"))
