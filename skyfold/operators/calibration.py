"""Gain corruption, correction, residuals and phase-only calibration.

``vis`` and ``model``: row_id, chan and a ``vis`` array of complex structs; if they
bring time_idx, antenna1 and antenna2 too, they are not joined with ``main``.
``jones``: time_idx, ant, chan, dir, g (array of 1, 2 or 4);
``model`` has dir.  A (row, chan) with any flagged correlation
is left out of solutions and set to 0 where it is corrected.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions import cplx, sky
from skyfold.functions.cplx import Complex
from skyfold.operators.lineage import cut, kept
from skyfold.operators.predict import PLACED, _sum, apply_jones, as_array, gains, placed, small

DIAG_DIAG, DIAG, FULL = "DIAG_DIAG", "DIAG", "FULL"


def check_type(n_jones: int, n_vis: int) -> str:
    """Calibration mode from the numbers of entries of a gain and a visibility."""
    mode = {(1, 1): DIAG_DIAG, (2, 2): DIAG_DIAG, (2, 4): DIAG, (4, 4): FULL}.get((n_jones, n_vis))
    if mode is None:
        raise ValueError(f"gains of {n_jones} and visibilities of {n_vis} numbers do not go together")
    return mode


def chunkify_rows(main: DataFrame, times_per_chunk: int) -> DataFrame:
    """(time_idx, chunk, bin_start, n_rows): rows of each time and where they begin."""
    from pyspark.sql.window import Window

    counts = main.groupBy("time_idx").agg(F.count("*").alias("n_rows"))
    w = Window.orderBy("time_idx")  # one row for each time
    return counts.withColumn("bin_start", F.sum("n_rows").over(w) - F.col("n_rows")).withColumn("chunk", F.floor((F.row_number().over(w) - 1) / times_per_chunk).cast("int"))


def _both(cells: DataFrame, jones: DataFrame, keys: list[str]) -> DataFrame:
    jones = gains(jones)
    p = jones.select(*keys, F.col("ant").alias("antenna1"), F.col("g").alias("gp"))
    q = jones.select(*keys, F.col("ant").alias("antenna2"), F.col("g").alias("gq"))
    return cells.join(p, [*keys, "antenna1"]).join(q, [*keys, "antenna2"])


def corrupt_vis(main: DataFrame, jones: DataFrame, model: DataFrame, n: int, n_jones: int | None = None) -> DataFrame:
    """(row_id, chan, vis): sum over directions of G_p M G_q^H."""
    check_type(n_jones or n, n)
    cells = _both(placed(model.withColumnRenamed("vis", "m"), main), jones, ["time_idx", "chan", "dir"])
    value = apply_jones(cplx.entries(F.col("m"), n), F.col("gp"), F.col("gq"), n_jones or n)
    return cells.groupBy("row_id", "chan").agg(*_sum(value)).select("row_id", "chan", _packed(n).alias("vis"))


def _packed(n: int) -> Column:
    return F.array(*(F.struct(F.col(f"_re{i}").alias("re"), F.col(f"_im{i}").alias("im")) for i in range(n)))


def _zero_if(flag: Column, values: list[Complex]) -> list[Complex]:
    return [Complex(F.when(flag, F.lit(0.0)).otherwise(v.re), F.when(flag, F.lit(0.0)).otherwise(v.im)) for v in values]


def correct_vis(main: DataFrame, jones: DataFrame, vis: DataFrame, n: int, n_jones: int | None = None) -> DataFrame:
    """(row_id, chan, vis): G_p^-1 V G_q^-H for one direction; 0 where flagged.

    Gains of several directions cannot be taken off a sum over them: an error.
    """
    k = n_jones or n
    check_type(k, n)
    if "dir" in jones.columns and jones.select("dir").distinct().limit(2).count() > 1:
        raise ValueError("visibilities are corrected for one direction only")
    # Each gain is inverted once, before the joins.
    inverted = jones.select("time_idx", "ant", "chan", as_array(cplx.inverse(cplx.entries(F.col("g"), k))).alias("g"))
    cells = _both(placed(vis, main), inverted, ["time_idx", "chan"])
    value = apply_jones(cplx.entries(F.col("vis"), n), F.col("gp"), F.col("gq"), k)
    flag = F.col("flag") if "flag" in vis.columns else F.lit(False)
    return cells.select("row_id", "chan", as_array(_zero_if(flag, value)).alias("vis"))


def residual_vis(main: DataFrame, jones: DataFrame, vis: DataFrame, model: DataFrame, n: int, n_jones: int | None = None) -> DataFrame:
    """(row_id, chan, vis): V - sum over directions of G_p M G_q^H; 0 where flagged."""
    corrupted = corrupt_vis(main, jones, model, n, n_jones).withColumnRenamed("vis", "c")
    both = vis.join(corrupted.hint("merge"), ["row_id", "chan"], "left")
    value = [a - Complex(F.coalesce(b.re, F.lit(0.0)), F.coalesce(b.im, F.lit(0.0))) for a, b in zip(cplx.entries(F.col("vis"), n), cplx.entries(F.col("c"), n), strict=True)]
    flag = F.col("flag") if "flag" in vis.columns else F.lit(False)
    return both.select("row_id", "chan", as_array(_zero_if(flag, value)).alias("vis"))


def compute_and_corrupt_vis(main: DataFrame, jones: DataFrame, model: DataFrame, positions: DataFrame, freqs: DataFrame, n: int) -> DataFrame:
    """(row_id, chan, vis): the model's phase is computed here and divided by n.

    ``model``: time_idx, chan, dir, vis and ``positions``: time_idx, dir, l, m vary
    with the time index, not the row.
    """
    rows = main.select("row_id", "time_idx", "antenna1", "antenna2", "u", "v", "w")
    cells = rows.join(gains(model.withColumnRenamed("vis", "x")), "time_idx").join(gains(positions), ["time_idx", "dir"]).join(small(freqs.select("chan", "freq")), "chan")
    cells = _both(cells, jones, ["time_idx", "chan", "dir"])
    l, m = F.col("l"), F.col("m")
    n1 = sky.n_minus_one(l, m, clamp=False)
    kernel = cplx.expi(sky.phase(sky.delay(l, m, F.col("u"), F.col("v"), F.col("w"), clamp=False), F.col("freq"))).scale(1.0 / (n1 + 1.0))
    value = apply_jones([x * kernel for x in cplx.entries(F.col("x"), n)], F.col("gp"), F.col("gq"), n)
    return cells.groupBy("row_id", "chan").agg(*_sum(value)).select("row_id", "chan", _packed(n).alias("vis"))


# --------------------------------------------------------------- phase-only solver
def normal_equations(main: DataFrame, jones: DataFrame, residual: DataFrame | None, model: DataFrame, flags: DataFrame | None, n: int) -> DataFrame:
    """(time_idx, ant, chan, dir, corr, jhj, jhr_re, jhr_im) of diagonal gains.

    Every baseline counts for antenna p with derivative i and for q with -i.
    Without ``residual`` only jhj is computed.
    """
    check_type(n, n)
    if n > 2:
        raise NotImplementedError("only diagonal gains and visibilities are solved for")
    cells = placed(model.withColumnRenamed("vis", "m"), main)
    if residual is not None:
        cells = cells.join(residual.select("row_id", "chan", F.col("vis").alias("r")).hint("merge"), ["row_id", "chan"])
    if flags is not None:
        cells = cells.join(flags.filter("flag").select("row_id", "chan").hint("merge"), ["row_id", "chan"], "left_anti")
    cells = _both(cells, jones, ["time_idx", "chan", "dir"])
    product = apply_jones(cplx.entries(F.col("m"), n), F.col("gp"), F.col("gq"), n)
    # The products are materialised as plain numbers before both antennas take their part.
    named = [c.alias(f"{p}{k}") for k, j in enumerate(product) for p, c in (("jr", j.re), ("ji", j.im))]
    left = [F.get("r", F.lit(k))[p].alias(f"r{p}{k}") for k in range(n) for p in ("re", "im")] if residual is not None else []
    flat = cells.select("time_idx", "antenna1", "antenna2", "chan", "dir", *named, *left)
    values = []
    for k in range(n):
        j = Complex(F.col(f"jr{k}"), F.col(f"ji{k}"))
        values.append(j.abs2().alias(f"jj{k}"))
        if residual is not None:  # conj(i j) r; antenna q has the other sign
            back = Complex(-j.im, j.re).conj() * Complex(F.col(f"rre{k}"), F.col(f"rim{k}"))
            values += [back.re.alias(f"br{k}"), back.im.alias(f"bi{k}")]
    flat = flat.select("time_idx", "antenna1", "antenna2", "chan", "dir", *values)
    ends = F.array(F.struct(F.col("antenna1").alias("ant"), F.lit(1.0).alias("sign")), F.struct(F.col("antenna2").alias("ant"), F.lit(-1.0).alias("sign")))
    both = flat.select("time_idx", "chan", "dir", *(c for c in flat.columns if c[:2] in ("jj", "br", "bi")), F.inline(ends))
    key = ["time_idx", "ant", "chan", "dir"]
    sums = [F.sum(f"jj{k}").alias(f"jj{k}") for k in range(n)]
    if residual is not None:
        sums += [F.sum(F.col(f"{p}{k}") * F.col("sign")).alias(f"{p}{k}") for k in range(n) for p in ("br", "bi")]
    out = both.groupBy(*key).agg(*sums)
    zero = F.lit(0.0)
    per = [F.struct(F.lit(k).alias("corr"), F.col(f"jj{k}").alias("jhj"), (F.col(f"br{k}") if residual is not None else zero).alias("jhr_re"), (F.col(f"bi{k}") if residual is not None else zero).alias("jhr_im")) for k in range(n)]
    return out.select(*key, F.inline(F.array(*per)))


def gauss_newton(main: DataFrame, jones: DataFrame, vis: DataFrame, model: DataFrame, weight: DataFrame | None = None, n: int = 1, tol: float = 1e-4, maxiter: int = 100) -> tuple[DataFrame, int]:
    """(jones, iterations): phases of diagonal gains by Gauss-Newton.

    Data are whitened once by the root of ``weight`` (row_id, chan, weight); jhj
    does not depend on the phases and is computed once; each step adds half the
    real part of jhr / jhj, until no phase moves by more than ``tol``.  A gain
    without unflagged data keeps its phase.  Only the largest step comes to the
    driver; the gains are checkpointed after every iteration.
    """
    if weight is not None:

        def white(df: DataFrame) -> DataFrame:
            both = df.join(weight.select("row_id", "chan", F.sqrt("weight").alias("_w")), ["row_id", "chan"])
            return both.withColumn("vis", as_array([x.scale(F.col("_w")) for x in cplx.entries(F.col("vis"), n)])).drop("_w")

        vis, model = white(vis), white(model)
    check_type(n, n)
    if n > 2:
        raise NotImplementedError("only diagonal gains and visibilities are solved for")
    key = ["time_idx", "ant", "chan", "dir"]
    data = vis.filter("not flag") if "flag" in vis.columns else vis
    one_direction = jones.select("dir").distinct().limit(2).count() == 1
    # What no step changes is joined once, and kept as plain numbers in a compressed table.
    cells = placed(model.withColumnRenamed("vis", "m").join(data.select("row_id", "chan", F.col("vis").alias("r")).hint("merge"), ["row_id", "chan"]), main)
    numbers = [c.alias(f"{s}{p}{i}") for s in "mr" for i, x in enumerate(cplx.entries(F.col(s), n)) for p, c in (("re", x.re), ("im", x.im))]
    cells, forget = kept(cells.select(*([] if one_direction else ["row_id"]), *PLACED, "chan", "dir", *numbers))
    jones = cut(jones.select(*key, "g"))
    jhj = cut(_jacobian_sums(cells, jones, n, one_direction, False))
    eps, k = 1.0, 0
    while eps > tol and k < maxiter:
        step = _jacobian_sums(cells, jones, n, one_direction, True).join(jhj, key)
        ratio = [0.5 * F.coalesce(F.try_divide(F.col(f"jr{c}"), F.col(f"jj{c}")), F.lit(0.0)) for c in range(n)]
        steps = step.select(*key, *(r.alias(f"step{c}") for c, r in enumerate(ratio)))
        moved = jones.join(steps, key, "left")
        by = [F.coalesce(f"step{c}", F.lit(0.0)) for c in range(n)]
        phases = [F.atan2(x.im, x.re) + b for x, b in zip(cplx.entries(F.col("g"), n), by, strict=True)]
        moved = cut(moved.select(*key, as_array([cplx.expi(p) for p in phases]).alias("g"), F.greatest(*map(F.abs, by), F.lit(0.0)).alias("most") if n > 1 else F.abs(by[0]).alias("most")))
        k += 1
        eps = moved.agg(F.max("most")).first()[0] or 0.0
        jones = moved.drop("most")
    forget()
    return jones, k


def _jacobian_sums(cells: DataFrame, jones: DataFrame, n: int, one_direction: bool, with_residual: bool) -> DataFrame:
    """(time_idx, ant, chan, dir, jr0, ...) real parts of jhr, or (..., jj0, ...) of jhj."""
    both = _both(cells, jones, ["time_idx", "chan", "dir"])

    def named(s: str) -> list[Complex]:
        return [Complex(F.col(f"{s}re{i}"), F.col(f"{s}im{i}")) for i in range(n)]

    product = apply_jones(named("m"), F.col("gp"), F.col("gq"), n)
    both = both.withColumns({f"j{p}{i}": c for i, x in enumerate(product) for p, c in (("re", x.re), ("im", x.im))})
    j = named("j")
    if not with_residual:
        values = [x.abs2() for x in j]
        signs, name = (1.0, 1.0), "jj"
    else:
        if one_direction:
            total = j
        else:
            summed = both.groupBy("row_id", "chan").agg(*(F.sum(f"j{p}{i}").alias(f"t{p}{i}") for i in range(n) for p in ("re", "im")))
            both = both.join(summed.hint("merge"), ["row_id", "chan"])
            total = named("t")
        left = [r - t for r, t in zip(named("r"), total, strict=True)]
        values = [(Complex(-x.im, x.re).conj() * e).re for x, e in zip(j, left, strict=True)]
        signs, name = (1.0, -1.0), "jr"
    ends = [F.struct(F.col(a).alias("ant"), *((x * s).alias(f"x{c}") for c, x in enumerate(values))) for a, s in zip(("antenna1", "antenna2"), signs, strict=True)]
    long = both.select("time_idx", "chan", "dir", F.inline(F.array(*ends)))
    return long.groupBy("time_idx", "ant", "chan", "dir").agg(*(F.sum(f"x{c}").alias(f"{name}{c}") for c in range(n)))


def fit_spi(components: DataFrame, freq0: float, tol: float = 1e-4, maxiter: int = 100, mindet: float = 1e-12, alpha0: float = -0.7) -> DataFrame:
    """(comp, alpha, alpha_var, i0, i0_var): power law through each component's fluxes.

    ``components``: comp, freq, flux, weight and, if there is one, beam.  Each
    component is a two-parameter Gauss-Newton fit of its own.
    """
    import numpy as np
    import pyarrow as pa

    beam = F.col("beam") if "beam" in components.columns else F.lit(1.0)
    some = components.select(F.col("comp").cast("long").alias("comp"), "freq", "flux", "weight", beam.cast("double").alias("beam"))
    # One row for each component: its samples in order of frequency.
    packed = some.groupBy("comp").agg(F.sort_array(F.collect_list(F.struct("freq", "flux", "weight", "beam"))).alias("s"))
    lists = packed.select("comp", *(F.col(f"s.{c}").alias(c) for c in ("freq", "flux", "weight", "beam")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            comp = batch.column(0)
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            out = np.zeros((4, len(comp)))
            cols = [c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]]
            first = np.cumsum(sizes) - sizes
            for n in np.unique(sizes):  # components with equally many samples are fitted together
                at = np.flatnonzero(sizes == n)
                place = first[at][:, None] + np.arange(n)
                out[:, at] = fit_power_laws(*(c[place] for c in cols), freq0, tol, maxiter, mindet, alpha0)
            yield pa.RecordBatch.from_arrays([comp, *(pa.array(x) for x in out)], names=["comp", "alpha", "alpha_var", "i0", "i0_var"])

    return lists.mapInArrow(run, "comp long, alpha double, alpha_var double, i0 double, i0_var double")


def fit_power_laws(freq, flux, weight, beam, freq0: float, tol: float, maxiter: int, mindet: float, alpha0: float):
    """(alpha, its variance, i0, its variance) of components x samples, by Gauss-Newton steps."""
    import numpy as np

    n, samples = flux.shape
    ratio = freq / freq0
    log_ratio = np.log(ratio)
    rows = np.arange(n)
    near = np.abs(ratio - 1.0).argmin(axis=1)
    gain = beam[rows, near]
    alpha = np.full(n, alpha0)
    i0 = np.divide(flux[rows, near], gain, out=flux[rows, near].copy(), where=gain != 0)
    var_a, var_i, chi2 = np.ones(n), np.ones(n), np.zeros(n)
    left = rows
    for _ in range(maxiter):
        if not len(left):
            break
        w, g = weight[left], beam[left] * ratio[left] ** alpha[left, None]
        slope = i0[left, None] * g * log_ratio[left]
        rest = flux[left] - i0[left, None] * g
        aa, ai, ii = (slope * slope * w).sum(axis=1), (slope * g * w).sum(axis=1), (g * g * w).sum(axis=1)
        det = np.maximum(aa * ii - ai * ai, mindet)
        ra, ri = (slope * rest * w).sum(axis=1), (g * rest * w).sum(axis=1)
        step_a, step_i = (ii * ra - ai * ri) / det, (aa * ri - ai * ra) / det
        var_a[left], var_i[left], chi2[left] = ii / det, aa / det, (rest * rest * w).sum(axis=1)
        alpha[left] += step_a
        i0[left] += step_i
        left = left[np.maximum(np.abs(step_a), np.abs(step_i)) > tol]
    scale = chi2 / max(samples - 2, 1)
    return alpha, var_a * scale, i0, var_i * scale
