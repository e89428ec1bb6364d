"""Gridding by fast transforms, with stacked w planes, to a stated accuracy.

A sample is spread over a grid of twice the image's size and over the nearest w
planes with the window exp(b (sqrt(1 - t^2) - 1)), whose width follows from the
accuracy.  Each plane is transformed once, turned by its w term and divided by
the window's transform.  The work is samples x width^3 + planes x pixels log
pixels and not samples x pixels.

A task adds its samples up on its own planes and puts out compressed partial
grids, so that what is shuffled is bounded by tasks x grid, and no plane, however
many samples it has, gathers them in one task.  Planes are held up to
``HELD_BYTES``.  Prediction broadcasts the planes, up to ``MOST_BYTES``; for larger
images ``operators.imaging.model`` sums directly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions import sky
from skyfold.operators.dense import numbers, spectral_window

HELD_BYTES = 256 << 20
MOST_BYTES = 256 << 20
#: Samples that are spread together.
CHUNK = 4096


@dataclass(frozen=True)
class Config:
    """Sizes of a grid: pixels, cell (radians), accuracy, whether w planes are stacked."""

    nx: int
    ny: int
    cell: float
    epsilon: float = 1e-7
    stack: bool = True

    @property
    def width(self) -> int:
        return min(16, max(4, math.ceil(-math.log10(self.epsilon)) + 2))

    @property
    def beta(self) -> float:
        return 2.3 * self.width

    @property
    def grid(self) -> tuple[int, int]:
        return 2 * self.nx, 2 * self.ny

    def n1(self) -> np.ndarray:
        l, m = (np.arange(n) - n // 2 for n in (self.nx, self.ny))
        return np.sqrt(np.maximum(1.0 - (l[:, None] * self.cell) ** 2 - (m[None, :] * self.cell) ** 2, 0.0)) - 1.0

    def planes(self) -> tuple[float, float]:
        """(middle of n - 1 over the image, distance of w planes in wavelengths)."""
        n1 = self.n1()
        low, high = float(n1.min()), float(n1.max())
        span = (high - low) / 2.0
        return (low + high) / 2.0, 0.25 / span if span > 0 else 1.0

    def window(self, t: np.ndarray) -> np.ndarray:
        """The window at a distance of ``t`` cells."""
        inside = 1.0 - (2.0 * t / self.width) ** 2
        return np.where(inside >= 0, np.exp(self.beta * (np.sqrt(np.maximum(inside, 0.0)) - 1.0)), 0.0)

    def transform(self, x: np.ndarray) -> np.ndarray:
        """The window's transform at ``x`` turns a cell, by Gauss-Legendre sums."""
        at, weight = np.polynomial.legendre.leggauss(64)
        t = at * self.width / 2.0
        w = weight * self.width / 2.0 * self.window(t)
        return (np.cos(2.0 * math.pi * np.asarray(x)[..., None] * t) * w).sum(axis=-1)

    def taper(self) -> np.ndarray:
        """What an image has to be divided by."""
        nu, nv = self.grid
        out = self.transform((np.arange(self.nx) - self.nx // 2) / nu)[:, None] * self.transform((np.arange(self.ny) - self.ny // 2) / nv)[None, :]
        if self.stack:
            middle, step = self.planes()
            out = out * self.transform((self.n1() - middle) * step)
        return out

    def screen(self, plane: int) -> np.ndarray:
        """The w term of a plane."""
        middle, step = self.planes()
        return np.exp(-2j * math.pi * plane * step * (self.n1() - middle))


def _spread(config: Config, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells and weights of samples in wavelengths: (plane, its weight, iu, wu, iv, wv), each samples x width."""
    nu, nv = config.grid
    half = np.arange(config.width) - config.width // 2 + 1
    out = []
    if config.stack:
        at = w / config.planes()[1]
        cells = np.floor(at).astype(np.int64)[:, None] + half
        out += [cells, config.window(at[:, None] - cells)]
    else:
        out += [np.zeros((len(u), 1), np.int64), np.ones((len(u), 1))]
    for x, n in ((u, nu), (v, nv)):
        at = x * config.cell * n
        cells = np.floor(at).astype(np.int64)[:, None] + half
        out += [cells % n, config.window(at[:, None] - cells)]
    return tuple(out)


def dirty(cells: DataFrame, config: Config) -> DataFrame:
    """(band, x, y, value): dirty image divided by n, as ``imaging.dirty`` has it.

    ``cells``: band, freq, u, v, w, re, im and, where they exist, weight and flag.
    """
    weight = F.col("weight") if "weight" in cells.columns else F.lit(1.0)
    some = cells.filter(~F.col("flag")) if "flag" in cells.columns else cells
    scale = F.col("freq") / sky.C
    some = some.select(F.col("band").cast("int").alias("band"), *((F.col(c) * scale).alias(c) for c in ("u", "v", "w")), (F.col("re") * weight).alias("re"), (F.col("im") * weight).alias("im"))
    nu, nv = config.grid

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def put_out() -> Iterator[pa.RecordBatch]:
            for (band, plane), grid in held.items():
                at = np.flatnonzero(grid)
                yield pa.RecordBatch.from_arrays([pa.array([band], pa.int32()), pa.array([plane], pa.int64()), pa.array([at.astype("<i8").tobytes()], pa.binary()), pa.array([grid[at].tobytes()], pa.binary())], names=["band", "plane", "cells", "values"])
            held.clear()

        for batch in batches:
            data = {c: numbers(batch.column(c)) for c in batch.schema.names}
            for lo in range(0, batch.num_rows, CHUNK):
                part = {c: x[lo : lo + CHUNK] for c, x in data.items()}
                vis = part["re"] + 1j * part["im"]
                if config.stack:
                    vis = vis * np.exp(-2j * math.pi * part["w"] * config.planes()[0])
                planes, wp, iu, wu, iv, wv = _spread(config, part["u"], part["v"], part["w"])
                for band in np.unique(part["band"]).tolist():
                    mine = part["band"] == band
                    for plane in np.unique(planes[mine]).tolist():
                        row, col = np.nonzero((planes == plane) & mine[:, None])
                        value = (vis[row] * wp[row, col])[:, None, None] * wu[row][:, :, None] * wv[row][:, None, :]
                        place = (iu[row][:, :, None] * nv + iv[row][:, None, :]).ravel()
                        grid = held.setdefault((band, plane), np.zeros(nu * nv, dtype=np.complex128))
                        np.add.at(grid, place, value.ravel())
                        if len(held) * nu * nv * 16 > HELD_BYTES:
                            yield from put_out()
        yield from put_out()

    def image(table: pa.Table) -> pa.Table:
        """A plane's part of the image; the parts of all planes are added."""
        band, plane = table.column("band")[0].as_py(), table.column("plane")[0].as_py()
        grid = np.zeros(nu * nv, dtype=np.complex128)
        for at, values in zip(table.column("cells"), table.column("values"), strict=True):
            grid[np.frombuffer(at.as_buffer(), "<i8")] += np.frombuffer(values.as_buffer(), np.complex128)
        whole = np.fft.ifft2(grid.reshape(nu, nv)) * (nu * nv)
        x, y = (np.arange(n) - n // 2 for n in (config.nx, config.ny))
        part = whole[np.ix_(x % nu, y % nv)]
        part = (part * config.screen(plane)).real if config.stack else part.real
        i, j = np.indices(part.shape)
        return pa.table({"band": pa.array(np.full(part.size, band), pa.int32()), "x": pa.array(i.ravel(), pa.int32()), "y": pa.array(j.ravel(), pa.int32()), "value": part.ravel()})

    partial = some.mapInArrow(scatter, "band int, plane long, cells binary, values binary")
    sums = partial.groupBy("band", "plane").applyInArrow(image, "band int, x int, y int, value double").groupBy("band", "x", "y").agg(F.sum("value").alias("value"))
    divisor = config.taper() * (config.n1() + 1.0)

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = divisor[numbers(batch.column("x")), numbers(batch.column("y"))]
            yield batch.set_column(3, "value", pa.array(numbers(batch.column("value")) / at))

    return sums.mapInArrow(correct, "band int, x int, y int, value double")


def model(samples: DataFrame, image: DataFrame, config: Config) -> DataFrame:
    """(row_id, chan, re, im): visibilities of an image, as ``imaging.model`` has them.

    ``samples``: row_id, chan, band, freq, u, v, w; ``image``: band, x, y, value.
    """
    nu, nv = config.grid
    lit = image.filter("value <> 0").select("band", "x", "y", "value").toArrow()
    top = max(abs(f) for _, f in spectral_window(samples)) / sky.C
    reach = samples.agg(F.max(F.abs("w"))).first()[0] or 0.0
    last = math.ceil(reach * top / config.planes()[1]) + config.width if config.stack else 0
    bands = sorted(set(lit.column("band").to_pylist()))
    if len(bands) * (2 * last + 1) * nu * nv * 16 > MOST_BYTES:
        raise ValueError("the planes of this image are too large to be broadcast; sum directly")
    grids: dict[int, np.ndarray] = {}
    taper = config.taper() * (config.n1() + 1.0)
    for band in bands:
        mine = lit.filter(pa.array(numbers(lit.column("band")) == band))
        whole = np.zeros((config.nx, config.ny))
        np.add.at(whole, (numbers(mine.column("x")), numbers(mine.column("y"))), numbers(mine.column("value")))
        whole /= taper
        x, y = (np.arange(n) - n // 2 for n in (config.nx, config.ny))
        stack = np.zeros((2 * last + 1, nu, nv), dtype=np.complex128)
        for plane in range(-last, last + 1):
            padded = np.zeros((nu, nv), dtype=np.complex128)
            padded[np.ix_(x % nu, y % nv)] = whole * np.conj(config.screen(plane)) if config.stack else whole
            stack[plane + last] = np.fft.fft2(padded)
        grids[band] = stack
    shared = samples.sparkSession.sparkContext.broadcast(grids)
    key = samples.schema["row_id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.complex128)
            scale = numbers(batch.column("freq")) / sky.C
            data = [numbers(batch.column(c)) * scale for c in ("u", "v", "w")]
            band = numbers(batch.column("band"))
            for lo in range(0, batch.num_rows, CHUNK):
                part = slice(lo, lo + CHUNK)
                planes, wp, iu, wu, iv, wv = _spread(config, *(x[part] for x in data))
                for b, stack in shared.value.items():
                    row = np.flatnonzero(band[part] == b)
                    total = np.zeros(len(row), dtype=np.complex128)
                    for k in range(planes.shape[1]):
                        cells = stack[(planes[row, k] + last)[:, None, None], iu[row][:, :, None], iv[row][:, None, :]]
                        total += wp[row, k] * np.einsum("rij,ri,rj->r", cells, wu[row], wv[row])
                    out[lo + row] = total
            if config.stack:
                out *= np.exp(2j * math.pi * data[2] * config.planes()[0])
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("chan").cast(pa.int32()), pa.array(out.real.copy()), pa.array(out.imag.copy())], names=["row_id", "chan", "re", "im"])

    some = samples.select("row_id", "chan", F.col("band").cast("int").alias("band"), *(F.col(c).cast("double").alias(c) for c in ("freq", "u", "v", "w")))
    return some.mapInArrow(gather, f"row_id {key}, chan int, re double, im double")
