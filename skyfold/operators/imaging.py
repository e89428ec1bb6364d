"""Direct Fourier transforms, gridding and degridding, deconvolution, mosaics.

Scatters are ``explode`` and a summing aggregate: partial sums per task bound
what is shuffled to the grid's size for each task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions import cplx, sky, stokes
from skyfold.operators import dense
from skyfold.operators.predict import small

DEG = math.pi / 180.0


# -------------------------------------------------------- direct Fourier transforms
def im_to_vis(pixels: DataFrame, main: DataFrame, channels: DataFrame, convention: str = "fourier") -> DataFrame:
    """(row_id, chan, corr, re, im): sum over pixels of I e^(-i phase) (or the casa sign).

    ``pixels``: l, m, chan, corr, flux.  Zero pixels are left out before the join.
    """
    spw = dense.spectral_window(channels)
    corrs = sorted(r.corr for r in pixels.select("corr").distinct().collect())
    if not corrs:
        corrs = [0]
    # One source for each place, with its fluxes channel by channel.
    at = F.transform(F.array(*(F.struct(F.lit(c).alias("chan"), F.lit(k).alias("corr")) for c, _ in spw for k in corrs)), lambda x: F.coalesce(F.element_at("fluxes", x), F.lit(0.0)))
    lit = pixels.filter("flux <> 0").withColumns({"l": F.col("l").cast("double"), "m": F.col("m").cast("double")})
    lit = lit.groupBy("l", "m", F.col("chan").cast("int").alias("chan"), F.col("corr").cast("int").alias("corr")).agg(F.sum("flux").alias("flux"))
    lit = lit.groupBy("l", "m").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("chan", "corr"), F.col("flux")))).alias("fluxes"))
    out = dense.sum_over_sources(main, lit.select(*dense.place(), at.alias("flux")), spw, len(corrs), {"fourier": -1.0, "casa": 1.0}[convention])
    values = out.select("row_id", "chan", F.posexplode("vis").alias("_k", "_v"))
    return values.select("row_id", "chan", F.get(F.array(*map(F.lit, corrs)), F.col("_k")).alias("corr"), F.col("_v.re").alias("re"), F.col("_v.im").alias("im"))


def vis_to_im(cells: DataFrame, main: DataFrame, pixels: DataFrame, channels: DataFrame, convention: str = "fourier") -> DataFrame:
    """(pixel, chan, corr, flux): real part of the adjoint of :func:`im_to_vis`.

    A (row, chan) with any flagged correlation is left out.  ``pixels``: pixel, l, m.
    """
    other = {"fourier": 1.0, "casa": -1.0}[convention]
    good = cells
    if "flag" in cells.columns:
        bad = cells.filter("flag").select("row_id", "chan").distinct()
        good = cells.join(bad, ["row_id", "chan"], "left_anti")
    samples = good.join(main.select("row_id", "u", "v", "w"), "row_id").join(small(channels.select("chan", "freq")), "chan")
    out = dense.sum_over_samples(samples, pixels.select("pixel", *dense.place()), ["chan", "corr"], other)
    return out.withColumnRenamed("value", "flux")


def band_of(channels: DataFrame, bands: int) -> DataFrame:
    """``channels`` with the imaging band of each: equal slices in order."""
    n = channels.count()
    per = -(-n // bands)
    return channels.withColumn("band", F.floor(F.col("chan") / per).cast("int"))


def image_pixels(spark, nx: int, ny: int, cell: float) -> DataFrame:
    """(x, y, l, m) of an image with its centre at pixel (nx // 2, ny // 2)."""
    x = spark.range(nx).select(F.col("id").cast("int").alias("x"))
    y = spark.range(ny).select(F.col("id").cast("int").alias("y"))
    return x.crossJoin(y).select("x", "y", ((F.col("x") - nx // 2) * cell).alias("l"), ((F.col("y") - ny // 2) * cell).alias("m"))


def _image_place() -> list[Column]:
    """``PLACE`` of a pixel; in images the w term has the other sign."""
    l, m, n1 = dense.place()
    return [l, m, (-sky.n_minus_one(F.col("l"), F.col("m"))).alias("n1")]


def dirty(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    """(band, x, y, value): dirty image by the direct sum, divided by n.

    ``cells``: band, freq, u, v, w, re, im and, where it exists, weight.
    """
    weight = F.col("weight") if "weight" in cells.columns else F.lit(1.0)
    samples = cells.select("band", "u", "v", "w", "freq", (F.col("re") * weight).alias("re"), (F.col("im") * weight).alias("im"))
    places = pixels.select(F.struct("x", "y").alias("at"), "l", "m").withColumn("pixel", (F.col("at.y").cast("long") * F.lit(1 << 31) + F.col("at.x")))
    sums = dense.sum_over_samples(samples, places.select("pixel", *_image_place()), ["band"], 1.0)
    n = sky.n_minus_one(F.col("l"), F.col("m")) + 1.0
    back = sums.join(small(places), "pixel")
    return back.select("band", F.col("at.x").alias("x"), F.col("at.y").alias("y"), F.try_divide(F.col("value"), n).alias("value"))


def model(samples: DataFrame, image: DataFrame) -> DataFrame:
    """(row_id, chan, re, im): visibilities of an image by the direct sum.

    ``samples``: row_id, chan, band, freq, u, v, w; ``image``: band, x, y, l, m, value.
    A place's values in all bands go as its spectrum.
    """
    spw = dense.spectral_window(samples)
    band = {r.chan: r.band for r in samples.select("chan", "band").distinct().collect()}
    n = sky.n_minus_one(F.col("l"), F.col("m")) + 1.0
    lit = image.filter("value <> 0").groupBy("x", "y", "l", "m").agg(F.map_from_entries(F.collect_list(F.struct(F.col("band").cast("int").alias("band"), F.try_divide(F.col("value"), n).alias("v")))).alias("by_band"))
    flux = F.transform(F.array(*(F.lit(int(band[c])) for c, _ in spw)), lambda b: F.coalesce(F.element_at("by_band", b), F.lit(0.0)))
    rows = samples.groupBy("row_id").agg(F.first("u").alias("u"), F.first("v").alias("v"), F.first("w").alias("w"))
    vis = dense.sum_over_sources(rows, lit.select(*_image_place(), flux.alias("flux")), spw, 1, -1.0)
    return samples.select("row_id", "chan").join(vis, ["row_id", "chan"]).select("row_id", "chan", F.col("vis")[0]["re"].alias("re"), F.col("vis")[0]["im"].alias("im"))


def residual(cells: DataFrame, image: DataFrame, pixels: DataFrame) -> DataFrame:
    """Dirty image of the data less the (unweighted) prediction from ``image``."""
    predicted = model(cells.select("row_id", "chan", "band", "freq", "u", "v", "w"), image).withColumnsRenamed({"re": "_re", "im": "_im"})
    left = cells.join(predicted, ["row_id", "chan"], "left")
    for c in ("re", "im"):
        left = left.withColumn(c, F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0.0)))
    return dirty(left.drop("_re", "_im"), pixels)


def hessian(cells: DataFrame, image: DataFrame, pixels: DataFrame) -> DataFrame:
    """Dirty image of the prediction from ``image``."""
    predicted = model(cells.select("row_id", "chan", "band", "freq", "u", "v", "w"), image)
    return dirty(cells.drop("re", "im").join(predicted, ["row_id", "chan"]), pixels)


# ------------------------------------------------------------ gridding, degridding
def taps(width: int, oversample: int) -> np.ndarray:
    """Positions of an oversampled kernel of odd width, with a unit of padding."""
    if width % 2 == 0:
        raise ValueError("a kernel's width is odd")
    return np.arange(oversample * (width + 2)) / float(oversample) - (width + 2) // 2


def sinc_kernel(width: int, oversample: int = 5, a: float = 1.0) -> np.ndarray:
    k = np.sinc(taps(width, oversample) * a)
    return k / k.sum()


def _bessel(order: int, x: np.ndarray) -> np.ndarray:
    """Bessel function of the first kind by its integral."""
    t = (np.arange(4096) + 0.5) * (math.pi / 4096)
    return np.cos(order * t[None, :] - x[:, None] * np.sin(t)[None, :]).mean(axis=1)


def _fit(x: list[float], y: list[float], degree: int, at: float) -> float:
    return float(np.polyval(np.polyfit(x, y, degree), at))


def kaiser_sinc_kernel(width: int, b: float | None = None, oversample: int = 5, order: int = 15) -> np.ndarray:
    # Published widths and shape parameters of the window.
    if b is None:
        b = _fit([1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0], [1.9980, 2.3934, 3.3800, 4.2054, 4.9107, 5.7567, 6.6291, 7.4302], 1, width + 2)
    span = width + 3
    inside = np.sqrt(np.maximum(1.0 - (2.0 * taps(width, oversample) / span) ** 2, 0.0))
    window = _bessel(order, b * inside) / span
    k = sinc_kernel(width, oversample) * window * window.sum()
    return k / k.sum()


def hanning_sinc_kernel(width: int, a: float | None = None, oversample: int = 5) -> np.ndarray:
    # Published widths and shape parameters of the window.
    if a is None:
        a = _fit([1.5, 2.0, 2.5, 3.0, 3.5], [0.7600, 0.7146, 0.6185, 0.5534, 0.5185], 3, width + 2)
    window = a + (1.0 - a) * np.cos(2.0 * math.pi / (width + 3) * taps(width, oversample))
    k = sinc_kernel(width, oversample) * window
    return k / k.sum()


def detaper(kernel: np.ndarray, npix: int, oversample: int) -> np.ndarray:
    """Image-plane taper of a separable kernel: |DFT| on both axes."""
    x = (np.arange(npix) - npix // 2) / npix
    at = (np.arange(len(kernel)) - len(kernel) // 2) / oversample
    one = np.abs(np.exp(2j * math.pi * np.outer(x, at)) @ kernel)
    return np.outer(one, one)



Facet = tuple[float, float, float, float]


def to_stokes(samples: DataFrame, inputs: list[str], output: str) -> DataFrame:
    """``samples`` with ``re`` and ``im`` of one polarisation, from ``vis``, an array of
    complex structs in the order of ``inputs``.
    """
    values = dict(zip(inputs, cplx.entries(F.col("vis"), len(inputs)), strict=True))
    (value,) = stokes.convert(values, [output])
    return samples.withColumns({"re": value.re, "im": value.im})


def to_facet(samples: DataFrame, facet: Facet, baselines: str = "rotate", phase: bool = True, back: bool = False) -> DataFrame:
    """``samples`` as a facet's centre sees them: visibilities turned by its phase,
    baselines rotated, tilted or kept ("rotate", "tilt", "none"); ``back`` turns the
    phase back, as prediction needs it.

    ``facet``: ra, dec of the facet, ra0, dec0 of the phase centre, in radians.
    """
    u, v, w = F.col("u"), F.col("v"), F.col("w")
    changed = {}
    if phase:
        turned = cplx.Complex(F.col("re"), F.col("im")) * facet_phase(u, v, w, F.col("wavelength"), *facet, sign=-1.0 if back else 1.0)
        changed |= {"re": turned.re, "im": turned.im}
    moved = {"rotate": rotate_uvw, "tilt": tilt_uvw, "none": lambda u, v, w, *_: (u, v, w)}[baselines](u, v, w, *facet)
    return samples.withColumns(changed | dict(zip("uvw", moved, strict=True)))


def _placed(samples: DataFrame, npix: int, cell_arcsec: float) -> DataFrame:
    scale = npix * cell_arcsec / 3600.0 * DEG
    s = samples.withColumn("_u", F.col("u") * scale / F.col("wavelength") + npix // 2).withColumn("_v", F.col("v") * scale / F.col("wavelength") + npix // 2)
    return s.withColumn("_du", F.rint(F.col("_u")).cast("int")).withColumn("_dv", F.rint(F.col("_v")).cast("int"))


def _taps(samples: DataFrame, npix: int, cell_arcsec: float, kernel: np.ndarray, width: int, oversample: int) -> DataFrame:
    """``samples`` exploded to the pixels that the kernel covers, with its value."""
    k = F.array(*(F.lit(float(x)) for x in kernel))
    s = _placed(samples, npix, cell_arcsec)
    for a in ("u", "v"):
        frac = ((F.col(f"_d{a}") - F.col(f"_{a}")) * oversample).cast("int")  # towards 0
        at = [F.struct((F.col(f"_d{a}") + t - width // 2).alias({"u": "x", "v": "y"}[a]), F.get(k, F.lit((t + 1) * oversample) + frac).alias(f"_k{a}")) for t in range(width)]
        s = s.select("*", F.inline(F.array(*at)))
    return s.withColumn("kernel", F.col("_ku") * F.col("_kv")).drop("_u", "_v", "_du", "_dv", "_ku", "_kv")


def _inside(npix: int) -> Column:
    return F.col("x").between(0, npix - 1) & F.col("y").between(0, npix - 1)


def grid(samples: DataFrame, npix: int, cell_arcsec: float, kernel: np.ndarray | None = None, width: int = 7, oversample: int = 5, normalize: bool = False, facet: Facet | None = None, baselines: str = "rotate", polarisation: tuple[list[str], str] | None = None) -> DataFrame:
    """(band, y, x, re, im): samples scattered to a grid by a separable kernel.

    ``samples``: band, u, v, wavelength, re, im; with ``polarisation`` (the order of
    ``vis``, and what to grid) they come from ``vis``, and with ``facet`` they are moved
    to it first (w is needed).  Without a kernel the nearest pixel takes the sample.
    Normalised, each band is divided by its kernel weights + 1e-8.
    """
    if polarisation is not None:
        samples = to_stokes(samples, *polarisation)
    if facet is not None:
        samples = to_facet(samples, facet, baselines)
    if kernel is None:
        s = _placed(samples, npix, cell_arcsec).withColumnsRenamed({"_du": "x", "_dv": "y"}).withColumn("kernel", F.lit(1.0))
    else:
        s = _taps(samples, npix, cell_arcsec, kernel, width, oversample)
    out = s.filter(_inside(npix)).groupBy("band", "y", "x").agg(F.sum(F.col("kernel") * F.col("re")).alias("re"), F.sum(F.col("kernel") * F.col("im")).alias("im"))
    if normalize:
        total = s.groupBy("band").agg((F.sum("kernel") + 1e-8).alias("_total"))
        out = out.join(F.broadcast(total), "band").select("band", "y", "x", (F.col("re") / F.col("_total")).alias("re"), (F.col("im") / F.col("_total")).alias("im"))
    return out


#: Numbers of a grid that is broadcast for degridding: 64 MB.
GRID_NUMBERS = 8_000_000


def degrid(samples: DataFrame, plane: DataFrame, npix: int, cell_arcsec: float, kernel: np.ndarray, width: int = 7, oversample: int = 5) -> DataFrame:
    """(row_id, chan, re, im): grid values gathered by the kernel, over its sum + 1e-8.

    ``samples``: row_id, chan, band, u, v, wavelength; ``plane``: band, y, x, re, im.
    A grid of at most ``GRID_NUMBERS`` is broadcast and gathered from where the
    samples are; a larger one is joined to the samples' taps.
    """
    bands = [r.band for r in plane.select("band").distinct().limit(GRID_NUMBERS // (2 * npix * npix) + 1).collect()]
    if len(bands) * 2 * npix * npix <= GRID_NUMBERS:
        return _gathered(samples, plane, sorted(bands), npix, cell_arcsec, kernel, width, oversample)
    s = _taps(samples, npix, cell_arcsec, kernel, width, oversample)
    hit = s.drop("re", "im").join(plane, ["band", "y", "x"], "left")
    total = F.sum("kernel") + 1e-8
    return hit.groupBy("row_id", "chan").agg(*((F.sum(F.col("kernel") * F.coalesce(F.col(c), F.lit(0.0))) / total).alias(c) for c in ("re", "im")))


def _gathered(samples: DataFrame, plane: DataFrame, bands: list[int], npix: int, cell_arcsec: float, kernel: np.ndarray, width: int, oversample: int) -> DataFrame:
    found = plane.select("band", "y", "x", "re", "im").filter(_inside(npix)).toArrow()
    # A rim of zeros takes the taps that lie outside.
    rim = width
    grid = np.zeros((len(bands), npix + 2 * rim, npix + 2 * rim), dtype=np.complex128)
    at = {b: i for i, b in enumerate(bands)}
    y, x = (found.column(c).to_numpy().astype(np.int64) + rim for c in ("y", "x"))
    grid[np.array([at[b] for b in found.column("band").to_pylist()], dtype=np.int64), y, x] = found.column("re").to_numpy() + 1j * found.column("im").to_numpy()
    shared = samples.sparkSession.sparkContext.broadcast((grid, at, np.asarray(kernel, dtype=float)))
    placed = _placed(samples, npix, cell_arcsec)
    some = placed.select("row_id", F.col("chan").cast("int").alias("chan"), F.col("band").cast("int").alias("band"), *(F.col(c).cast("double").alias(c) for c in ("_u", "_v")), "_du", "_dv")
    key = samples.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, at, k = shared.value
        t = np.arange(width)
        for batch in batches:
            n = batch.num_rows
            u, v, du, dv = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_u", "_v", "_du", "_dv"))
            weights, places = [], []
            for exact, near in ((u, du), (v, dv)):
                part = np.trunc((near - exact) * oversample).astype(np.int64)
                weights.append(k[(t + 1)[None, :] * oversample + part[:, None]])
                cells = near.astype(np.int64)[:, None] + t - width // 2
                places.append(np.where((cells >= 0) & (cells < npix), cells + rim, 0))
            band = np.array([at.get(b, -1) for b in batch.column("band").to_pylist()], dtype=np.int64)
            value = np.zeros(n, dtype=np.complex128)
            total = weights[0].sum(axis=1) * weights[1].sum(axis=1) + 1e-8
            for j in range(width):
                for i in range(width):
                    value += weights[0][:, i] * weights[1][:, j] * grid[band, places[1][:, j], places[0][:, i]]
            value = np.where(band >= 0, value, 0.0) / total
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("chan"), pa.array(value.real.copy()), pa.array(value.imag.copy())], names=["row_id", "chan", "re", "im"])

    return some.mapInArrow(run, f"row_id {key}, chan int, re double, im double")


def rotate_uvw(u: Column, v: Column, w: Column, ra: float, dec: float, ra0: float, dec0: float) -> tuple[Column, Column, Column]:
    """Baseline coordinates turned to another phase centre."""
    d = ra - ra0
    c, s, cd, sd, c0, s0 = math.cos(d), math.sin(d), math.cos(dec), math.sin(dec), math.cos(dec0), math.sin(dec0)
    return (
        u * c + v * (s0 * s) - w * (c0 * s),
        u * (-sd * s) + v * (s0 * sd * c + c0 * cd) - w * (c0 * sd * c - s0 * cd),
        u * (cd * s) - v * (s0 * cd * c - c0 * sd) + w * (c0 * cd * c + s0 * sd),
    )


def tilt_uvw(u: Column, v: Column, w: Column, ra: float, dec: float, ra0: float, dec0: float) -> tuple[Column, Column, Column]:
    """Planar approximation of a facet: u and v less w times the facet's slopes."""
    d = ra - ra0
    l0, m0 = math.cos(dec) * math.sin(d), math.sin(dec) * math.cos(dec0) - math.cos(dec) * math.sin(dec0) * math.cos(d)
    n0 = math.sqrt(1.0 - l0 * l0 - m0 * m0)
    return u - w * (l0 / n0), v - w * (m0 / n0), w


def facet_phase(u: Column, v: Column, w: Column, wavelength: Column, ra: float, dec: float, ra0: float, dec0: float, sign: float = 1.0) -> cplx.Complex:
    """Phase that moves a sample to a facet's centre."""
    d = ra - ra0
    l0, m0 = math.cos(dec) * math.sin(d), math.sin(dec) * math.cos(dec0) - math.cos(dec) * math.sin(dec0) * math.cos(d)
    n1 = math.sqrt(1.0 - l0 * l0 - m0 * m0) - 1.0
    return cplx.expi((u * l0 + v * m0 + w * n1) / wavelength * F.lit(sign * sky.TWO_PI))


def estimate_cell_size(main: DataFrame, wavelength: float, factor: float = 3.0, nx: int | None = None, ny: int | None = None) -> DataFrame:
    """(u_cell, v_cell): arc seconds that sample the longest baselines ``factor`` times.

    With ``nx`` or ``ny`` an image smaller than the shortest baseline's fringe is
    an error when the row is computed (u goes with ny, v with nx).
    """
    out = []
    for name, n in (("u", ny), ("v", nx)):
        size = F.abs(F.col(name)) / wavelength
        cell = 1.0 / (2.0 * factor * F.max(size))
        if n is not None:
            small_ = cell * n < F.try_divide(F.lit(1.0), F.min(size))
            cell = F.when(small_, F.raise_error(F.lit(f"{n} cells along {name} are less than the shortest baseline's fringe")).cast("double")).otherwise(cell)
        out.append((F.degrees(cell) * 3600.0).alias(f"{name}_cell"))
    return main.agg(*out)


# ----------------------------------------------------------------- deconvolution
def find_peak(image: DataFrame) -> DataFrame:
    """(max_y, max_x, max_value, min_y, min_x, min_value): signed extremes.

    Of equal values the last position in the order of rows, then columns, counts.
    """
    at = F.struct("y", "x")
    return image.agg(F.max(F.struct(F.col("value"), at.alias("at"))).alias("hi"), F.max(F.struct((-F.col("value")).alias("value"), at.alias("at"))).alias("lo")).select(
        F.col("hi.at.y").alias("max_y"), F.col("hi.at.x").alias("max_x"), F.col("hi.value").alias("max_value"), F.col("lo.at.y").alias("min_y"), F.col("lo.at.x").alias("min_x"), (-F.col("lo.value")).alias("min_value")
    )


def hogbom_clean(images: DataFrame, psf: DataFrame, gamma: float = 0.1, threshold: float | None = None, niter: int | None = None) -> DataFrame:
    """(image_id, y, x, clean, residual) of square images, each in one task.

    ``images``: image_id, y, x, value (absent pixels are 0); ``psf``: y, x, value
    with twice the size.
    The threshold is a share of the first peak (0.2 by default); there are at
    most niter + 1 steps (niter is 3 x the size by default).  An image is one
    plane, so its size bounds a task.
    """
    beam = psf.collect()
    size = max(r.y for r in beam) + 1
    kernel = np.zeros((size, size))
    for r in beam:
        kernel[r.y, r.x] = r.value
    shared = images.sparkSession.sparkContext.broadcast(kernel)

    def run(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        kernel = shared.value
        n = kernel.shape[0] // 2
        if kernel.shape[0] % 2 or max(int(y.max()), int(x.max())) >= n:
            raise ValueError("the psf must have exactly twice the size of a square image")
        left, clean = np.zeros((n, n)), np.zeros((n, n))
        left[y, x] = table.column("value").to_numpy()

        def peak() -> tuple[int, int, float]:
            at = n * n - 1 - int(left.ravel()[::-1].argmax())
            return at // n, at % n, float(left.ravel()[at])

        p, q, top = peak()
        stop = (0.2 if threshold is None else threshold) * abs(top)
        steps = 0
        while abs(top) > stop and steps <= (3 * n if niter is None else niter):
            clean[p, q] += gamma * top
            left -= gamma * top * kernel[n - 1 - p : 2 * n - 1 - p, n - 1 - q : 2 * n - 1 - q]
            p, q, top = peak()
            steps += 1
        yy, xx = np.divmod(np.arange(n * n), n)
        return pa.table({"image_id": pa.array([table.column("image_id")[0].as_py()] * (n * n), pa.int64()), "y": pa.array(yy, pa.int32()), "x": pa.array(xx, pa.int32()), "clean": clean.ravel(), "residual": left.ravel()})

    some = images.select(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("value"))
    return some.groupBy("image_id").applyInArrow(run, "image_id long, y int, x int, clean double, residual double")


def gaussian_2d(shape: tuple[int, int], centre: tuple[float, float], sigma: tuple[float, float], angle: float, amplitude: float = 1.0) -> np.ndarray:
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    dx, dy = xx - centre[1], yy - centre[0]
    a = dx * math.cos(angle) + dy * math.sin(angle)
    b = -dx * math.sin(angle) + dy * math.cos(angle)
    return amplitude * np.exp(-0.5 * ((a / sigma[0]) ** 2 + (b / sigma[1]) ** 2))


def convolve(images: DataFrame, ny: int, nx: int, sigma: tuple[float, float], angle: float) -> DataFrame:
    """(image_id, y, x, value): images (absent pixels are 0) convolved with a Gaussian of
    height 1, by padded transforms.  An image is one plane, so its size bounds a task.
    """
    lobe = np.fft.ifftshift(gaussian_2d((2 * ny, 2 * nx), (ny, nx), sigma, angle))
    turned = np.fft.rfft2(lobe)

    def run(table: pa.Table) -> pa.Table:
        whole = np.zeros((2 * ny, 2 * nx))
        whole[table.column("y").to_numpy(), table.column("x").to_numpy()] = table.column("value").to_numpy()
        out = np.fft.irfft2(np.fft.rfft2(whole) * turned, s=whole.shape)[:ny, :nx]
        y, x = np.indices(out.shape)
        return pa.table({"image_id": pa.array([table.column("image_id")[0].as_py()] * out.size, pa.int64()), "y": pa.array(y.ravel(), pa.int32()), "x": pa.array(x.ravel(), pa.int32()), "value": out.ravel()})

    some = images.select(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("value"))
    return some.groupBy("image_id").applyInArrow(run, "image_id long, y int, x int, value double")


def above_threshold(images: DataFrame, times_rms: float | None = None, dynamic_range: float | None = None, residual_: DataFrame | None = None) -> DataFrame:
    """Pixels (image_id, y, x, value) whose least value over the images is above a bound.

    The bound is ``times_rms`` times the standard deviation of ``residual_`` (of the
    images themselves without one), else the largest value over ``dynamic_range``.
    """
    if (times_rms is None) == (dynamic_range is None):
        raise ValueError("either a multiple of the rms or a dynamic range is given")
    if times_rms is not None:
        bound = (images if residual_ is None else residual_).agg((F.stddev_pop("value") * times_rms).alias("_bound"))
    else:
        bound = images.agg((F.max("value") / dynamic_range).alias("_bound"))
    lit = images.groupBy("y", "x").agg(F.min("value").alias("_least")).crossJoin(F.broadcast(bound)).filter("_least > _bound").select("y", "x")
    return images.join(lit, ["y", "x"]).select("image_id", "y", "x", "value")


def fit_psf(psf: np.ndarray) -> tuple[tuple[float, float], float]:
    """(sigmas, angle) of the main lobe, from second moments above half its height."""
    cy, cx = np.unravel_index(int(psf.argmax()), psf.shape)
    n = max(2, min(psf.shape) // 4)
    cut = psf[max(0, cy - n) : cy + n + 1, max(0, cx - n) : cx + n + 1]
    weight = np.where(cut >= 0.5 * psf.max(), np.log(np.maximum(cut, 1e-12) / psf.max()), np.nan)
    yy, xx = np.mgrid[: cut.shape[0], : cut.shape[1]]
    dy, dx = yy - min(cy, n), xx - min(cx, n)
    use = np.isfinite(weight)
    # log of a Gaussian is a quadratic form: least squares for its three numbers
    m = np.stack([dx[use] ** 2, 2 * dx[use] * dy[use], dy[use] ** 2], axis=1).astype(float)
    a, b, c = np.linalg.lstsq(m, -2.0 * weight[use], rcond=None)[0]
    values, vectors = np.linalg.eigh(np.array([[a, b], [b, c]]))
    values = np.maximum(values, 1e-9)
    return (1.0 / math.sqrt(values[0]), 1.0 / math.sqrt(values[1])), math.atan2(vectors[1, 0], vectors[0, 0])


def restore(clean: np.ndarray, psf: np.ndarray, residual_: np.ndarray) -> np.ndarray:
    """Components convolved with the main lobe's Gaussian, plus the residual."""
    sigma, angle = fit_psf(psf)
    n, m = clean.shape
    lobe = gaussian_2d((2 * n, 2 * m), (n, m), sigma, angle)
    full = np.fft.irfft2(np.fft.rfft2(np.pad(clean, ((0, n), (0, m)))) * np.fft.rfft2(np.fft.ifftshift(lobe)), s=(2 * n, 2 * m))
    return full[:n, :m] + residual_


# ----------------------------------------------------------------------- mosaics
def mosaic(tiles: DataFrame) -> DataFrame:
    """(y, x, value): tiles (tile, y0, x0, y, x, value) summed on one canvas, NaN as 0."""
    value = F.coalesce(F.nanvl(F.col("value"), F.lit(0.0)), F.lit(0.0))
    return tiles.groupBy((F.col("y0") + F.col("y")).alias("y"), (F.col("x0") + F.col("x")).alias("x")).agg(F.sum(value).alias("value"))


def mask_weights(masks: DataFrame, only_overlaps: bool = False) -> DataFrame:
    """``masks`` (mask, y, x) with weight 1 / number of masks that cover the pixel."""
    counts = masks.groupBy("y", "x").agg(F.count("*").alias("covered"))
    out = masks.join(counts, ["y", "x"])
    if only_overlaps:
        out = out.filter("covered > 1")
    return out.withColumn("weight", 1.0 / F.col("covered"))
