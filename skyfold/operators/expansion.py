"""Sums between many rows and many sources by expansion of their phases.

exp(i x s) with s in [-1, 1] is the sum over a of (2 - [a = 0]) i^a J_a(x) T_a(s),
and J_a(x) falls below the rounding of a double soon after a passes x.  So the
sources of a field are worth their moments, the sums of flux T_a(l) T_b(m): the work
is (sources + rows) x orders^2 and no longer sources x rows.  n - 1 is a smooth
function of l and m: moments with its powers follow from the moments themselves.
Nothing is cut off above the rounding: the orders go to 1e-17.

Sources with the same ellipse have one set of moments, and rows are multiplied by
a shape once.  Shapes are smooth, so that few of them make up the others; only these
are evaluated.  A task holds the moments of one ellipse, and puts them out when the
next begins; tasks of the second step hold a block of rows and the moments of one channel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions import sky

#: Orders of an axis, and ellipses, beyond which the sum is made directly.
MOST_ORDERS, MOST_ELLIPSES = 1_500, 64
#: Sources or rows whose polynomials are held at a time.
CHUNK = 4096
#: Rows of which a task holds the Bessel functions.
HELD_ROWS = 16_384
#: Tasks that the rows and channels of the second step are cut into; each is sent the moments of its channel.
ROW_TASKS = 24
#: Degree to which n - 1 is expanded.
DEGREE = 16


def orders(x: float) -> int:
    """Orders after which J_a(y) is below 1e-17 for all y up to ``x``."""
    most, n, bound = int(np.ceil(x + 12.0 * np.cbrt(x) + 14.0)), 0, 1.0
    while n < most and bound > 1e-17:  # J_n(x) is at most (x / 2)^n / n!
        n += 1
        bound *= x / 2.0 / n
    return n + 1


def bessel(x: np.ndarray, n: int) -> np.ndarray:
    """J_0 to J_(n-1) of each ``x``, by recurrence downwards from where they vanish."""
    size = np.maximum(np.abs(x), 1e-18)
    begin = np.ceil(size + 12.0 * np.cbrt(size) + 14.0)
    top = int(np.nanmax(begin, initial=n)) + 1
    out = np.zeros((n, len(x)))
    above, here, total = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for k in range(top, -1, -1):
        # here is J_k, above J_(k+1), but for a factor
        if k < top:
            above, here = here, (2.0 * (k + 1) / size) * here - above
        here = np.where(begin == k, 1e-30, here)
        if k < n:
            out[k] = here
        if k % 2 == 0:
            total += here if k == 0 else 2.0 * here
    out /= total
    out[1::2] *= np.sign(x)
    return np.where(np.isnan(x)[:, None], np.nan, out.T)


def chebyshev(s: np.ndarray, n: int) -> np.ndarray:
    return np.cos(np.arccos(np.clip(s, -1.0, 1.0))[:, None] * np.arange(n))


@dataclass(frozen=True)
class Field:
    """Middle and half-width of l and m, n - 1 in polynomials of both, and orders."""

    middle: tuple[float, float]
    half: tuple[float, float]
    n1: np.ndarray  # coefficients (i, j) of (n - 1 - n1_middle) / n1_half
    n1_middle: float
    n1_half: float
    axes: tuple[int, int]
    turns: int  # orders of the w term

    @property
    def held(self) -> tuple[int, int]:
        """Orders of the moments: powers of n - 1 reach beyond those of the phases."""
        return self.axes[0] + 2 * self.turns + DEGREE, self.axes[1] + 2 * self.turns + DEGREE


def field(box: Sequence[float], reach: Sequence[float], top: float) -> Field | None:
    """Of sources within (l0, l1, m0, m1) and rows up to |u|, |v|, |w|, at frequencies up to ``top``; None where n - 1 is not smooth."""
    middle = ((box[0] + box[1]) / 2.0, (box[2] + box[3]) / 2.0)
    half = (max((box[1] - box[0]) / 2.0, 1e-9), max((box[3] - box[2]) / 2.0, 1e-9))
    if max(abs(box[0]), abs(box[1])) ** 2 + max(abs(box[2]), abs(box[3])) ** 2 >= 0.25:
        return None
    angle = (np.arange(DEGREE) + 0.5) * np.pi / DEGREE
    at = np.cos(angle)
    r2 = (middle[0] + half[0] * at)[:, None] ** 2 + (middle[1] + half[1] * at)[None, :] ** 2
    value = -r2 / (np.sqrt(1.0 - r2) + 1.0)
    to = np.cos(np.arange(DEGREE)[:, None] * angle[None, :]) * (2.0 / DEGREE)
    to[0] /= 2.0
    n1 = to @ value @ to.T
    n1_middle = float(n1[0, 0])
    n1[0, 0] = 0.0
    n1_half = float(np.abs(n1).sum()) or 1.0
    wide = 2.0 * np.pi * top / sky.C
    waves = orders(wide * reach[2] * n1_half)
    kept = np.abs(n1) > 1e-15 * n1_half / max(1.0, wide * reach[2] * n1_half)
    found = Field(middle, half, np.where(kept, n1, 0.0) / n1_half, n1_middle, n1_half, (orders(wide * reach[0] * half[0]), orders(wide * reach[1] * half[1])), min(waves, 64))
    # The last coefficients must have died out, and the powers stay a few.
    died = np.abs(n1[-3:]).max() + np.abs(n1[:, -3:]).max() <= 1e-14 * n1_half
    return found if died and waves <= 64 and max(found.axes) <= MOST_ORDERS else None


def by_n1(f: Field) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrices (A, B) with which moments get a further factor n - 1, as the sum of A M B.

    T_a T_i is half the sum of T_(a+i) and T_|a-i|.
    """

    def factor(n: int, i: int) -> np.ndarray:
        out, at = np.zeros((n, n)), np.arange(n)
        for to in (at + i, np.abs(at - i)):
            np.add.at(out, (at[to < n], to[to < n]), 0.5)
        return out

    return [(factor(f.held[0], i), sum(f.n1[i, j] * factor(f.held[1], j) for j in np.flatnonzero(f.n1[i]).tolist()).T) for i in np.flatnonzero(f.n1.any(axis=1)).tolist()]


def times_n1(moments: np.ndarray, factors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return sum((a @ (moments @ b) for a, b in factors), np.zeros_like(moments))


def source_moments(l: np.ndarray, m: np.ndarray, flux: np.ndarray, f: Field) -> np.ndarray:
    """(columns of flux, orders of l, orders of m)."""
    out = np.zeros((flux.shape[1], *f.held))
    for lo in range(0, len(l), CHUNK):
        part = slice(lo, lo + CHUNK)
        tl, tm = chebyshev((l[part] - f.middle[0]) / f.half[0], f.held[0]), chebyshev((m[part] - f.middle[1]) / f.half[1], f.held[1])
        for c in range(flux.shape[1]):
            if flux[part, c].any():
                out[c] += tl.T @ (tm * flux[part, c, None])
    return out


def at_rows(uvw: np.ndarray, moments: np.ndarray, freq: float, sign: float, f: Field) -> np.ndarray:
    """(rows, sets of moments): the sum over sources at one frequency."""
    k = sign * sky.TWO_PI / sky.C * freq
    factors = by_n1(f)
    out = np.zeros((uvw.shape[1], len(moments)), dtype=np.complex128)

    def signs(n: int) -> np.ndarray:
        """Factors of the orders: 2 beyond the first, and i^a without its i."""
        return np.where(np.arange(n) == 0, 1.0, 2.0) * np.where(np.arange(n) % 4 < 2, 1.0, -1.0)

    for lo in range(0, uvw.shape[1], HELD_ROWS):
        chunks = []
        for at in range(lo, min(lo + HELD_ROWS, uvw.shape[1]), CHUNK):
            u, v, w = uvw[:, at : min(at + CHUNK, lo + HELD_ROWS)]
            ju, jv = bessel(k * u * f.half[0], f.axes[0]) * signs(f.axes[0]), bessel(k * v * f.half[1], f.axes[1]) * signs(f.axes[1])
            jw = bessel(k * w * f.n1_half, f.turns) * signs(f.turns)
            turn = np.exp(1j * k * (u * f.middle[0] + v * f.middle[1] + w * f.n1_middle))
            chunks.append((at, *(np.ascontiguousarray(j[:, p::2]) for j in (ju, jv) for p in (0, 1)), jw, turn))
        for c, one in enumerate(moments):
            if not one.any():
                continue
            last, t = None, one
            for q in range(f.turns):
                if q:
                    last, t = t, times_n1(t, factors) if q == 1 else 2.0 * times_n1(t, factors) - last
                x = [[np.ascontiguousarray(t[p : f.axes[0] : 2, r : f.axes[1] : 2]) for r in (0, 1)] for p in (0, 1)]
                for at, u0, u1, v0, v1, jw, turn in chunks:
                    even = np.einsum("ij,ij->i", u0 @ x[0][0], v0) - np.einsum("ij,ij->i", u1 @ x[1][1], v1)
                    odd = np.einsum("ij,ij->i", u0 @ x[0][1], v1) + np.einsum("ij,ij->i", u1 @ x[1][0], v0)
                    out[at : at + len(turn), c] += jw[:, q] * (even + 1j * odd) * (1j if q % 2 else 1.0) * turn
    return out


def skeleton(uvw: np.ndarray, freqs: np.ndarray, shapes: list[tuple[float, ...]]) -> tuple[list[int], np.ndarray]:
    """Ellipses whose shapes at the rows make up all of them, and with which weights (skeleton, shapes).

    Columns are picked until what is left of any shape, over all rows and frequencies, is rounding.
    """
    triangle = np.zeros((0, len(shapes)))
    for lo in range(0, uvw.shape[1], CHUNK):
        part = np.concatenate([np.stack([shape_of(uvw[:, lo : lo + CHUNK], f, s) for s in shapes], axis=1) for f in freqs])
        triangle = np.linalg.qr(np.concatenate([triangle, np.nan_to_num(part)]), mode="r")
    rest, picked = triangle.copy(), []
    rounding = 5e-16 * float(np.linalg.norm(triangle, axis=0).max(initial=0.0))
    while len(picked) < len(shapes):
        size = np.linalg.norm(rest, axis=0)
        best = int(size.argmax())
        if size[best] < rounding:
            break
        picked.append(best)
        basis, _ = np.linalg.qr(triangle[:, picked])
        rest = triangle - basis @ (basis.T @ triangle)
        rest -= basis @ (basis.T @ rest)
    basis, upper = np.linalg.qr(triangle[:, picked])
    weights = np.linalg.solve(upper, basis.T @ triangle)
    if np.abs(triangle[:, picked] @ weights - triangle).max(initial=0.0) > 20.0 * rounding or np.abs(weights).max(initial=0.0) > 1e3:
        return list(range(len(shapes))), np.eye(len(shapes))
    return picked, weights


def shape_of(uvw: np.ndarray, freq: float, shape: tuple[float, ...]) -> np.ndarray:
    a1, a2, b1, b2 = shape
    narrow = (np.sqrt(2.0) * np.pi / (sky.C * sky.FWHM) * freq) ** 2
    return np.exp(-narrow * ((uvw[0] * a1 + uvw[1] * a2) ** 2 + (uvw[0] * b1 + uvw[1] * b2) ** 2))


def expanded(rows: pa.Table, sources: DataFrame, freqs: Sequence[float], names: Sequence[int], correlations: int, sign: float, f: Field, shapes: list[tuple[float, ...]] | None, tasks: int) -> DataFrame:
    """(_r, chan, re0, im0, ...): sums at the rows, which are numbered.

    ``shapes``: the distinct ellipses, or None where all sources are points.
    """
    ellipse = ["a1", "a2", "b1", "b2"]
    number = {x: k for k, x in enumerate(shapes or [()])}
    few = sources.select("l", "m", "flux", *(ellipse if shapes else []))
    few = few.repartitionByRange(tasks, *(ellipse if shapes else []), "l", "m").sortWithinPartitions(*(ellipse if shapes else ["l"]))
    width = len(freqs) * correlations

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = -1, np.zeros(0)

        def put_out() -> Iterator[pa.RecordBatch]:
            for c in range(len(freqs)):
                yield pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([c], pa.int32()), pa.array([total[c * correlations : (c + 1) * correlations].tobytes()], pa.binary())], names=["ellipse", "c", "moments"])

        for batch in batches:
            flux = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            l, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if shapes:
                e = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3, 7)], axis=1) + 0.0
                edges = np.flatnonzero(np.append(True, (e[1:] != e[:-1]).any(axis=1)))
            else:
                e, edges = np.zeros((len(l), 0)), np.zeros(1, np.int64)
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(l)], strict=True):
                if hi == lo:
                    continue
                mine = number[tuple(e[lo].tolist())]
                if mine != held:
                    if held >= 0:
                        yield from put_out()
                    held, total = mine, np.zeros((width, *f.held))
                total += source_moments(l[lo:hi], m[lo:hi], flux[lo:hi], f)
        if held >= 0:
            yield from put_out()

    uvw = np.stack([rows.column(c).to_numpy() for c in ("u", "v", "w")])
    picked, weights = skeleton(uvw, np.array(freqs), shapes) if shapes else ([0], np.ones((1, 1)))
    shared = sources.sparkSession.sparkContext.broadcast(uvw)
    blocks = max(1, min(-(-uvw.shape[1] // CHUNK), -(-ROW_TASKS // len(freqs))))
    edges = np.linspace(0, uvw.shape[1], blocks + 1).astype(int).tolist()

    def evaluate(table: pa.Table) -> pa.Table:
        c, block = table.column("c")[0].as_py(), table.column("block")[0].as_py()
        uvw, freq = shared.value[:, edges[block] : edges[block + 1]], freqs[c]
        moments = np.zeros((len(picked), correlations, *f.held))
        for mine, blob in zip(table.column("ellipse").to_pylist(), table.column("moments"), strict=True):
            one = np.frombuffer(blob.as_buffer(), np.float64).reshape(moments.shape[1:])
            for k in np.flatnonzero(weights[:, mine]).tolist():
                moments[k] += weights[k, mine] * one
        value = at_rows(uvw, moments.reshape(-1, *f.held), freq, sign, f).reshape(-1, len(picked), correlations)
        if shapes:
            value = value * np.stack([shape_of(uvw, freq, shapes[k]) for k in picked], axis=1)[:, :, None]
        value = value.sum(axis=1)
        columns = {"_r": pa.array(np.arange(edges[block], edges[block + 1])), "chan": pa.array(np.full(len(value), names[c], np.int32))}
        for k in range(correlations):
            columns |= {f"re{k}": pa.array(value[:, k].real.copy()), f"im{k}": pa.array(value[:, k].imag.copy())}
        return pa.table(columns)

    partial = few.mapInArrow(collect, "ellipse int, c int, moments binary").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = "_r long, chan int, " + ", ".join(f"re{k} double, im{k} double" for k in range(correlations))
    return partial.repartition(4 * blocks * len(freqs), "c", "block").groupBy("c", "block").applyInArrow(evaluate, schema)
