"""Operators against independent re-statements in NumPy and Python."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skyfold.functions import cplx, sky, stokes
from skyfold.operators import averaging, calibration, imaging, linalg, predict
from skyfold.plans import rime
from skyfold.sources import fits, wsclean

RNG = np.random.default_rng(11)


def main_rows(spark, n=400, baselines=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        b = i % baselines
        rows.append((i, float(i // baselines * 10 + b), float(rng.choice([4.0, 9.0, 31.0])), b, b + 4, bool(rng.random() < 0.3), *map(float, rng.standard_normal(3) * 100), 1.0 + float(rng.random()), 0.5 + float(rng.random())))
    return spark.createDataFrame(rows, "row_id long, time double, interval double, antenna1 int, antenna2 int, flag_row boolean, u double, v double, w double, weight double, sigma double")


def by_baseline(df):
    out = {}
    for r in df.orderBy("time").collect():
        out.setdefault((r.antenna1, r.antenna2), []).append(r)
    return out


@pytest.mark.parametrize("secs", [1.0, 35.0, 60.0])
def test_time_bins_follow_the_loop(spark, secs):
    m = main_rows(spark)
    got = {r.row_id: r.bin for r in averaging.time_bins(m, secs).collect()}
    for rows in by_baseline(m).values():
        number, low = -1, None
        for r in rows:
            if low is None or r.time + r.interval / 2 - low > secs:
                number, low = number + 1, r.time - r.interval / 2
            assert got[r.row_id] == number


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_row_average_does_not_depend_on_partitions(spark, parts):
    m = main_rows(spark).repartition(parts)
    bins = averaging.time_bins(m, 60.0)
    got = {(r.antenna1, r.antenna2, r.bin): r for r in averaging.row_average(m, bins.select("row_id", "bin")).collect()}
    of = {r.row_id: r.bin for r in bins.collect()}
    groups = {}
    for r in m.collect():
        groups.setdefault((r.antenna1, r.antenna2, of[r.row_id]), []).append(r)
    assert groups.keys() == got.keys()
    for k, rows in groups.items():
        flag = all(r.flag_row for r in rows)
        use = [r for r in rows if r.flag_row == flag]
        w = np.array([r.weight for r in use])
        assert got[k].flag_row == flag and got[k].interval == pytest.approx(sum(r.interval for r in rows))
        assert got[k].time == pytest.approx(np.mean([r.time for r in rows]))
        assert got[k].u == pytest.approx(np.mean([r.u for r in use]))
        assert got[k].sigma == pytest.approx(math.sqrt(sum((r.sigma * x) ** 2 for r, x in zip(use, w, strict=True)) / w.sum() ** 2))


def test_duplicate_sample_is_an_error(spark):
    m = main_rows(spark, 6)
    with pytest.raises(PySparkException, match="two rows at one time"):
        averaging.time_bins(m.unionByName(m.limit(1)), 1.0).collect()


def test_flags_must_agree(spark):
    cells = spark.createDataFrame([(0, True), (0, True), (1, False)], "row_id long, flag boolean")
    rows = spark.createDataFrame([(0, True), (1, False)], "row_id long, flag_row boolean")
    assert {(r.row_id, r.flag_row) for r in averaging.merge_flags(rows, cells).collect()} == {(0, True), (1, False)}
    wrong = rows.withColumn("flag_row", F.lit(True))
    assert [r.row_id for r in averaging.flag_mismatches(wrong, cells).collect()] == [1]
    with pytest.raises(PySparkException, match="differs"):
        averaging.merge_flags(wrong, cells).collect()


def test_zero_weights_leave_the_sum(spark):
    cells = spark.createDataFrame([(0, 0, 0, 2.0, 1.0, False, 0.0), (1, 0, 0, 3.0, 1.0, False, 0.0)], "row_id long, chan int, corr int, re double, im double, flag boolean, weight double")
    got = averaging.row_chan_average(cells, ["chan", "corr"]).first()
    assert (got.re, got.im, got.weight) == (0.0, 0.0, 0.0)


def test_bda_follows_the_loop(spark):
    m = main_rows(spark, 300)
    freqs, widths = [0.9e9 + 1e7 * i for i in range(12)], [1e7] * 12
    got = {r.row_id: r for r in averaging.bda_bins(m, freqs, widths, time_bin_secs=100.0, decorrelation=0.9).collect()}
    dphi = math.acos(0.9) * math.sqrt(3) / math.pi
    lm = math.radians(3.0)
    n_max = abs(math.sqrt(1 - lm * lm) - 1)
    for rows in by_baseline(m).values():
        bins, current = [], []
        for r in rows:
            if current:
                a = current[0]
                half = math.dist((r.u, r.v, r.w), (a.u, a.v, a.w)) * max(freqs) * math.sin(lm) * math.pi / sky.C + 1e-8
                late = r.time + r.interval / 2 - (a.time - a.interval / 2) > 100.0
                if late or math.sin(half) / half < math.sin(math.pi * dphi) / (math.pi * dphi):
                    bins.append(current)
                    current = []
            current.append(r)
        bins.append(current)
        for number, rows_ in enumerate(bins):
            a, b = rows_[0], rows_[-1]
            if len(rows_) == 1:
                nchan = 12
            else:
                u, v, w = ((x + y) / 2 for x, y in zip((a.u, a.v, a.w), (b.u, b.v, b.w), strict=True))
                d = math.sqrt(math.hypot(u, v) * lm + abs(w) * n_max)
                need = math.ceil(12 / max(sky.C / (2 * math.pi) * dphi / d / 1e7, 1))
                nchan = min(x for x in averaging.factors(12) if x >= need)
            for r in rows_:
                assert (got[r.row_id].bin, got[r.row_id].nchan) == (number, nchan)


# ------------------------------------------------------------- columns and Stokes
def test_coordinates_round_trip(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in RNG.uniform(-0.3, 0.3, (50, 2))], "ra double, dec double")
    l, m = sky.radec_to_lm(F.col("ra"), F.col("dec"), 0.1, 0.2)
    df = df.withColumn("l", l).withColumn("m", m)
    ra, dec = sky.lm_to_radec(F.col("l"), F.col("m"), 0.1, 0.2)
    for r in df.select("ra", "dec", ra.alias("x"), dec.alias("y")).collect():
        assert (r.x, r.y) == pytest.approx((r.ra, r.dec), abs=1e-12)


@pytest.mark.parametrize("kind", ["linear", "circular"])
def test_stokes_round_trip(spark, kind):
    names = {"linear": rime.LINEAR, "circular": rime.CIRCULAR}[kind]
    values = dict(zip("IQUV", (cplx.real(float(x)) for x in (3, 1, -2, 0.5)), strict=True))
    corr = dict(zip(names, stokes.convert(values, names), strict=True))
    back = stokes.convert(corr, ["I", "Q", "U", "V"])
    other = stokes.convert(corr, [n for n in (*rime.LINEAR, *rime.CIRCULAR) if n not in names])
    direct = stokes.convert(values, [n for n in (*rime.LINEAR, *rime.CIRCULAR) if n not in names])
    row = spark.range(1).select(*(c for i, x in enumerate([*back, *other, *direct]) for c in (x.re.alias(f"r{i}"), x.im.alias(f"i{i}")))).first()
    assert [row[f"r{i}"] for i in range(4)] == pytest.approx([3, 1, -2, 0.5]) and not any(row[f"i{i}"] for i in range(4))
    for i in range(4):
        assert (row[f"r{4 + i}"], row[f"i{4 + i}"]) == pytest.approx((row[f"r{8 + i}"], row[f"i{8 + i}"]))
    with pytest.raises(stokes.MissingInput):
        stokes.convert({"I": values["I"]}, ["XX"])
    assert len(stokes.convert({"I": values["I"]}, [9, [10, "YX"], 12], implicit_stokes=True)) == 4


def test_matrices_follow_numpy(spark):
    mats = {n: RNG.standard_normal((n,)) + 1j * RNG.standard_normal((n,)) for n in (1, 2, 4)}
    full = {1: lambda a: a[0] * np.eye(2), 2: np.diag, 4: lambda a: a.reshape(2, 2)}
    as_col = lambda a: [cplx.Complex(F.lit(float(x.real)), F.lit(float(x.imag))) for x in a]
    for n, a in mats.items():
        for k, b in mats.items():
            out = cplx.matmul(as_col(a), cplx.hermitian(as_col(b)))
            row = spark.range(1).select(*(c for i, x in enumerate(out) for c in (x.re.alias(f"r{i}"), x.im.alias(f"i{i}")))).first()
            got = np.array([row[f"r{i}"] + 1j * row[f"i{i}"] for i in range(len(out))])
            assert full[len(out)](got) == pytest.approx(full[n](a) @ full[k](b).conj().T)
    inv = cplx.matmul(cplx.inverse(as_col(mats[4])), as_col(mats[4]))
    row = spark.range(1).select(*(x.re.alias(f"r{i}") for i, x in enumerate(inv))).first()
    assert list(row) == pytest.approx([1, 0, 0, 1], abs=1e-12)


def test_zernike_radial_values(spark):
    row = spark.range(1).select(*(sky.zernike(j, F.lit(0.5), F.lit(0.3)).alias(f"z{j}") for j in range(11)), sky.zernike(4, F.lit(1.1), F.lit(0.0)).alias("out")).first()
    assert [sky.noll(j) for j in range(6)] == [(0, 0), (1, 1), (1, -1), (2, 0), (2, -2), (2, 2)]
    assert row.z0 == 1 and row.z1 == pytest.approx(0.5 * math.cos(0.3)) and row.z3 == pytest.approx(-0.5) and row.out == 0
    assert row.z10 == pytest.approx(6 * 0.5**4 - 6 * 0.5**2 + 1)


# --------------------------------------------------------------------- calibration
def gains_case(spark, n, dirs=1):
    rows, ants = [], 6
    for t in range(2):
        for p in range(ants):
            for q in range(p + 1, ants):
                rows.append((len(rows), t, p, q))
    main = spark.createDataFrame(rows, "row_id long, time_idx int, antenna1 int, antenna2 int")
    phases = 0.4 * np.random.default_rng(3).standard_normal((2, ants, dirs, n))
    g = [(t, a, c, s, [(float(math.cos(x)), float(math.sin(x))) for x in phases[t, a, s]]) for t in range(2) for a in range(ants) for c in range(2) for s in range(dirs)]
    schema = "time_idx int, ant int, chan int, dir int, g array<struct<re: double, im: double>>"
    jones = spark.createDataFrame(g, schema)
    rng = np.random.default_rng(4)
    model = spark.createDataFrame([(r[0], c, s, [(1.0 + float(rng.random()), float(rng.random())) for _ in range(n)]) for r in rows for c in range(2) for s in range(dirs)], "row_id long, chan int, dir int, vis array<struct<re: double, im: double>>")
    return main, jones, model, phases


@pytest.mark.parametrize(("n", "dirs"), [(1, 1), (2, 1)])
def test_solver_recovers_phase_differences(spark, n, dirs):
    main, jones, model, phases = gains_case(spark, n, dirs)
    vis = calibration.corrupt_vis(main, jones, model, n)
    if dirs == 1:
        back = calibration.correct_vis(main, jones, vis, n).join(model.drop("dir").withColumnRenamed("vis", "m"), ["row_id", "chan"])
        for r in back.collect():
            assert [x for z in r.vis for x in z] == pytest.approx([x for z in r.m for x in z], abs=1e-9)
    left = calibration.residual_vis(main, jones, vis, model, n)
    assert all(abs(x) < 1e-9 for r in left.collect() for z in r.vis for x in z)
    start = jones.withColumn("g", F.transform("g", lambda z: F.struct(F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))))
    weight = vis.select("row_id", "chan", F.lit(2.0).alias("weight"))
    solved, k = calibration.gauss_newton(main, start, vis, model, weight, n, tol=2e-3, maxiter=8)
    assert 1 < k <= 8
    got = np.zeros_like(phases)
    for r in solved.filter("chan = 0").collect():
        got[r.time_idx, r.ant, r.dir] = [math.atan2(z.im, z.re) for z in r.g]
    # the derivatives know phases up to one per time and direction
    dx, dy = got - got[:, :1], phases - phases[:, :1]
    assert np.abs(np.angle(np.exp(1j * (dx - dy)))).max() < 2e-2


def test_a_step_with_two_directions(spark):
    """One step is half of jhr / jhj, each direction for itself, and lowers the residual."""
    main, jones, model, _ = gains_case(spark, 1, 2)
    vis = calibration.corrupt_vis(main, jones, model, 1)
    start = jones.withColumn("g", F.array(F.struct(F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))))
    left = calibration.residual_vis(main, start, vis, model, 1)
    normal = calibration.normal_equations(main, start, left, model, None, 1).collect()
    solved, _ = calibration.gauss_newton(main, start, vis, model, maxiter=1)
    got = {(r.time_idx, r.ant, r.chan, r.dir): math.atan2(r.g[0].im, r.g[0].re) for r in solved.collect()}
    for r in normal:
        assert got[r.time_idx, r.ant, r.chan, r.dir] == pytest.approx(0.5 * r.jhr_re / r.jhj)
    size = lambda v: sum(x * x for r in v.collect() for z in r.vis for x in z)
    assert size(calibration.residual_vis(main, solved, vis, model, 1)) < size(left)


def test_a_gain_without_data_keeps_its_phase(spark):
    main, jones, model, _ = gains_case(spark, 1)
    vis = calibration.corrupt_vis(main, jones, model, 1).join(main.select("row_id", "antenna1", "antenna2"), "row_id")
    vis = vis.withColumn("flag", (F.col("antenna1") == 2) | (F.col("antenna2") == 2))
    start = jones.withColumn("g", F.array(F.struct(F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))))
    solved, _ = calibration.gauss_newton(main, start, vis, model, maxiter=3)
    assert {round(r.g[0].im, 12) for r in solved.filter("ant = 2").collect()} == {0.0}


def test_only_known_modes():
    assert calibration.check_type(2, 4) == calibration.DIAG
    with pytest.raises(ValueError, match="do not go together"):
        calibration.check_type(4, 1)


def test_spectral_fit(spark):
    rng = np.random.default_rng(5)
    truth = {c: (-0.7 + 0.3 * rng.standard_normal(), 1 + rng.random()) for c in range(12)}
    rows = [(c, f, i0 * (f / 1e9) ** a, 1.0) for c, (a, i0) in truth.items() for f in np.linspace(0.8e9, 1.6e9, 20).tolist()]
    got = calibration.fit_spi(spark.createDataFrame(rows, "comp long, freq double, flux double, weight double"), 1e9).collect()
    for r in got:
        assert (r.alpha, r.i0) == pytest.approx(truth[r.comp], abs=1e-5) and r.alpha_var < 1e-9


def test_predict_full_matrices(spark):
    main, _, _, _ = gains_case(spark, 1)
    rng = np.random.default_rng(6)
    z = lambda: [(float(a), float(b)) for a, b in rng.standard_normal((4, 2))]
    m2 = lambda v: np.array([a + 1j * b for a, b in v]).reshape(2, 2)
    st = "array<struct<re: double, im: double>>"
    dde = [(t, a, 0, s, z()) for t in range(2) for a in range(6) for s in range(3)]
    die = [(t, a, 0, z()) for t in range(2) for a in range(6)]
    rows = main.collect()
    coh = [(r.row_id, 0, s, z()) for r in rows for s in range(3)]
    base = [(r.row_id, 0, z()) for r in rows]
    d = spark.createDataFrame(dde, f"time_idx int, ant int, chan int, source_id long, g {st}")
    e = spark.createDataFrame(die, f"time_idx int, ant int, chan int, g {st}")
    x = spark.createDataFrame(coh, f"row_id long, chan int, source_id long, vis {st}")
    b = spark.createDataFrame(base, f"row_id long, chan int, vis {st}")
    D, E = {(t, a, s): m2(g) for t, a, _, s, g in dde}, {(t, a): m2(g) for t, a, _, g in die}
    X, B = {(r, s): m2(g) for r, _, s, g in coh}, {r: m2(g) for r, _, g in base}
    got = {r.row_id: m2([(q.re, q.im) for q in r.vis]) for r in predict.predict_vis(main, d, x, d, e, b, e).collect()}
    plain = {r.row_id: m2([(q.re, q.im) for q in r.vis]) for r in predict.predict_vis(main, d, None, d).collect()}
    for r in rows:
        t, p, q = r.time_idx, r.antenna1, r.antenna2
        s = sum(D[t, p, s] @ X[r.row_id, s] @ D[t, q, s].conj().T for s in range(3))
        assert got[r.row_id] == pytest.approx(E[t, p] @ (B[r.row_id] + s) @ E[t, q].conj().T)
        assert plain[r.row_id] == pytest.approx(sum(D[t, p, s] @ D[t, q, s].conj().T for s in range(3)))
    with pytest.raises(ValueError, match="both antennas"):
        predict.predict_vis(main, dde1=d, coherencies=x)


# ------------------------------------------------------------------ beams, imaging
def test_beam_lookup_follows_numpy(spark):
    rng = np.random.default_rng(7)
    cube = rng.standard_normal((5, 4, 3)) + 1j * rng.standard_normal((5, 4, 3))
    freqs = [1e9, 1.2e9, 1.5e9]
    beam = spark.createDataFrame([(i, j, k, 0, float(cube[i, j, k].real), float(cube[i, j, k].imag)) for i in range(5) for j in range(4) for k in range(3)], "l_idx int, m_idx int, nu_idx int, corr int, re double, im double")
    rows = [(i, float(rng.uniform(-1.3, 1.3)), float(rng.uniform(-1.3, 1.3)), float(f), float(rng.uniform(0, 6))) for i, f in enumerate([0.7e9, 1e9, 1.1e9, 1.2e9, 1.33e9, 1.5e9, 1.9e9] * 6)]
    got = {r.i: complex(r.re, r.im) for r in predict.beam_cube_dde(spark.createDataFrame(rows, "i long, l double, m double, freq double, pa double"), beam, ((-1.0, 1.0), (-1.0, 1.0)), (5, 4), freqs, ["i"]).collect()}
    for i, l, m, f, pa in rows:
        scale, w, k = (f / 1e9, 1.0, 0) if f < 1e9 else (f / 1.5e9, 0.0, 1) if f >= 1.5e9 else (1.0, None, int(np.searchsorted(freqs, f, "right")) - 1)
        w = (freqs[k + 1] - f) / (freqs[k + 1] - freqs[k]) if w is None else w
        x = np.clip(((l * scale) * math.cos(pa) - (m * scale) * math.sin(pa) + 1) * 2.0, 0, 4)
        y = np.clip(((l * scale) * math.sin(pa) + (m * scale) * math.cos(pa) + 1) * 1.5, 0, 3)
        a, b = int(x), int(y)
        total, size = 0j, 0.0
        for da, wa in ((0, 1 - (x - a)), (1, x - a)):
            for db, wb in ((0, 1 - (y - b)), (1, y - b)):
                for dk, wk in ((0, w), (1, 1 - w)):
                    v = cube[min(a + da, 4), min(b + db, 3), k + dk]
                    total += wa * wb * wk * v
                    size += wa * wb * wk * abs(v)
        assert got[i] == pytest.approx(total / abs(total) * size if total else 0)


def test_transforms_are_adjoint(spark):
    m = main_rows(spark, 30)
    chans = spark.createDataFrame([(0, 1e9), (1, 1.1e9)], "chan int, freq double")
    rng = np.random.default_rng(9)
    px = [(i, *map(float, rng.uniform(-0.02, 0.02, 2)), c, 0, float(rng.standard_normal())) for i in range(8) for c in range(2)]
    px = [(i, *[p for p in px if p[0] == i][0][1:3], c, z, f) for i, _, _, c, z, f in px]
    pixels = spark.createDataFrame(px, "pixel long, l double, m double, chan int, corr int, flux double")
    cells = [(r, c, 0, float(a), float(b)) for r in range(30) for c, (a, b) in enumerate(rng.standard_normal((2, 2)))]
    vis = spark.createDataFrame(cells, "row_id long, chan int, corr int, re double, im double")
    forward = {(r.row_id, r.chan): complex(r.re, r.im) for r in imaging.im_to_vis(pixels, m, chans).collect()}
    back = {(r.pixel, r.chan): r.flux for r in imaging.vis_to_im(vis, m, pixels.select("pixel", "l", "m").distinct(), chans).collect()}
    left = sum((forward[r, c].conjugate() * complex(a, b)).real for r, c, _, a, b in cells)
    assert left == pytest.approx(sum(f * back[i, c] for i, _, _, c, _, f in px))


def test_gridding_and_degridding_are_adjoint(spark):
    rng = np.random.default_rng(10)
    k = imaging.kaiser_sinc_kernel(5, oversample=9)
    assert k.sum() == pytest.approx(1) and imaging.sinc_kernel(7).argmax() == 20
    rows = [(i, 0, 0, *map(float, rng.uniform(-2000, 2000, 2)), 0.0, 0.21, *map(float, rng.standard_normal(2))) for i in range(60)]
    s = spark.createDataFrame(rows, "row_id long, chan int, band int, u double, v double, w double, wavelength double, re double, im double")
    grid = {(r.y, r.x): complex(r.re, r.im) for r in imaging.grid(s, 32, 8.0, k, 5, 9).collect()}
    plane = {key: complex(*rng.standard_normal(2)) for key in grid}
    p = spark.createDataFrame([(0, y, x, float(z.real), float(z.imag)) for (y, x), z in plane.items()], "band int, y int, x int, re double, im double")
    total = {r.row_id: r.t for r in imaging._taps(s, 32, 8.0, k, 5, 9).groupBy("row_id").agg(F.sum("kernel").alias("t")).collect()}
    vis = {r.row_id: complex(r.re, r.im) * (total[r.row_id] + 1e-8) for r in imaging.degrid(s, p, 32, 8.0, k, 5, 9).collect()}
    assert sum(grid[key].conjugate() * plane[key] for key in grid) == pytest.approx(sum(complex(r[7], r[8]).conjugate() * vis[r[0]] for r in rows))
    assert imaging.detaper(k, 16, 9).shape == (16, 16)


def test_clean_finds_the_components(spark):
    n = 16
    yy, xx = np.mgrid[: 2 * n, : 2 * n]
    psf = np.exp(-((yy - n + 1) ** 2 + (xx - n + 1) ** 2) / 4.0)
    truth = np.zeros((n, n))
    truth[4, 5], truth[11, 9] = 3.0, 1.0
    dirty = sum(v * psf[n - 1 - y : 2 * n - 1 - y, n - 1 - x : 2 * n - 1 - x] for (y, x), v in np.ndenumerate(truth) if v)
    table = lambda a: [(int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(a)]
    images = spark.createDataFrame([(7, *r) for r in table(dirty)], "image_id long, y int, x int, value double")
    out = imaging.hogbom_clean(images, spark.createDataFrame(table(psf), "y int, x int, value double"), threshold=0.01, niter=500).collect()
    clean, left = np.zeros((n, n)), np.zeros((n, n))
    for r in out:
        clean[r.y, r.x], left[r.y, r.x] = r.clean, r.residual
    assert clean[4, 5] == pytest.approx(3, abs=0.1) and np.abs(left).max() < 0.05
    assert imaging.restore(clean, psf, left).max() == pytest.approx(3, abs=0.3)


def test_image_too_small_for_the_shortest_baseline(spark):
    m = spark.createDataFrame([(10.0, 30.0), (100.0, -90.0)], "u double, v double")
    assert imaging.estimate_cell_size(m, 0.2, nx=4096, ny=4096).first().u_cell > 0
    with pytest.raises(PySparkException, match="fringe"):
        imaging.estimate_cell_size(m, 0.2, nx=4, ny=4).collect()


# ------------------------------------------------------------------ linear algebra
def test_kronecker(spark):
    mats = [RNG.standard_normal((2, 3)), RNG.standard_normal((3, 2)), RNG.standard_normal((2, 2))]
    frames = [spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(a)], "i int, j int, value double") for a in mats]
    whole = np.kron(np.kron(mats[0], mats[1]), mats[2])
    b = RNG.standard_normal((12, 3))
    vec = spark.createDataFrame([(i, float(x)) for i, x in enumerate(b[:, 0])], "i long, value double")
    got = {r.i: r.value for r in linalg.kron_matvec(frames, vec).collect()}
    assert [got[i] for i in range(12)] == pytest.approx(list(whole @ b[:, 0]))
    mat = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(b)], "i long, j int, value double")
    many = {(r.i, r.j): r.value for r in linalg.kron_matmat(frames, mat).collect()}
    assert [many[i, j] for i in range(12) for j in range(3)] == pytest.approx(list((whole @ b).ravel()))
    formed = {(r.i, r.j): r.value for r in linalg.kron(frames).collect()}
    assert [formed[i, j] for i in range(12) for j in range(12)] == pytest.approx(list(whole.ravel()))
    spd = [a @ a.T + np.eye(len(a)) for a in mats]
    low = linalg.kron_cholesky(spd)
    assert np.kron(low[0], low[1]) @ np.kron(low[0], low[1]).T == pytest.approx(np.kron(spd[0], spd[1]))
    assert np.isfinite(linalg.cholesky(np.zeros((2, 2)) + 0.0, jitter=1e-13)).all()


@pytest.mark.parametrize("ends", [1, 2])
def test_spline(spark, ends):
    x = np.linspace(-2, 2, 16)
    y = -0.5 * x**2 - 0.3 * x + 5
    value = {1: (1.7, -2.3), 2: (-1.0, -1.0)}[ends]
    s = linalg.fit_cubic_spline(x, y, ends, ends, *value)
    at = spark.createDataFrame([(float(t),) for t in np.linspace(-2, 2, 37)], "t double")
    for r in at.select("t", *(linalg.spline_column(F.col("t"), s, k).alias(f"d{k}") for k in range(3))).collect():
        assert (r.d0, r.d1, r.d2) == pytest.approx((-0.5 * r.t**2 - 0.3 * r.t + 5, -r.t - 0.3, -1.0), abs=1e-9)


def test_regions():
    hull = linalg.convex_hull([(0, 0), (4, 0), (4, 3), (0, 3), (2, 1), (0, 0)])
    assert len(hull) == 4 and linalg.area(hull) == 12 and linalg.circumference(hull) == 14
    assert linalg.overlaps(hull, linalg.convex_hull([(3, 2), (6, 2), (6, 6)]))
    assert not linalg.overlaps(hull, linalg.convex_hull([(8, 8), (9, 8), (9, 9)]))
    boxes = linalg.split_box((0, 9, 0, 6), 3, 2)
    assert sum((b[1] - b[0] + 1) * (b[3] - b[2] + 1) for b in boxes) == 70 and linalg.pad_box((0, 1, 2, 3), 1) == (-1, 2, 1, 4)


# ---------------------------------------------------------------- language, sources
def test_parse_rime():
    spec = rime.parse("(Lp, Kpq, Bpq, Lq): [I, Q] -> [RR, LL]")
    assert spec.terms == (("L", "p"), ("K", "pq"), ("B", "pq"), ("L", "q")) and spec.feed_type == "circular"
    for bad in ("(Kpq)", "(K): [I] -> [XX]", "(Kpq): [Z] -> [XX]", "(Kpq): [I] -> [XX, RR]", "(): [I] -> [XX]", "(1): [I] -> [XX]"):
        with pytest.raises(rime.RimeError):
            rime.parse(bad)


def test_custom_term_and_missing_inputs(spark):
    class Twice(rime.Term):
        needs = ("freq",)

        def columns(self, spec, antenna):
            return [cplx.real(2.0)]

    main = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "row_id long, u double, v double, w double")
    src = spark.createDataFrame([(0.01, 0.02, [1.0], [0.0], 1e9)], "ra double, dec double, stokes array<double>, spi array<double>, ref_freq double")
    chans = spark.createDataFrame([(0, 1e9)], "chan int, freq double")
    one = rime.rime("(Kpq, Bpq): [I] -> [XX, YY]", main, src, chans).first().vis
    two = rime.rime("(Kpq, Tpq, Bpq): [I] -> [XX, YY]", main, src, chans, terms={"T": Twice()}).first().vis
    assert two[0].re == pytest.approx(2 * one[0].re) and len(one) == 2
    with pytest.raises(rime.RimeError, match="missing"):
        rime.rime("(Lp, Bpq): [I] -> [XX, XY, YX, YY]", main, src, chans)
    with pytest.raises(rime.RimeError, match="no term"):
        rime.rime("(Zpq): [I] -> [XX]", main, src, chans)


def test_component_list(spark):
    lines = [
        "Format = Name, Type, Ra, Dec, I, SpectralIndex, LogarithmicSI, ReferenceFrequency='125584411.6', MajorAxis, MinorAxis, Orientation",
        "# a comment", "",
        "s0,POINT,08:28:05.152,39.35.08.511,0.000748,[-0.00695379313004673,-0.0849693907803257],false,,,,",
        "s1,GAUSSIAN,-07:58:09,-50.00.01.5,nan,[1.0,2.0],true,1e9,83.6,64.3,-1.5",
        "s2,POINT,0:0:1,0.0.1,inf,[1.0],false,1e9,,,",
    ]
    got = {r.name: r for r in wsclean.load(spark, lines).collect()}
    assert got["s0"].referencefrequency == 125584411.6 and len(got["s0"].spectralindex) == 2
    assert got["s0"].ra == pytest.approx(2 * math.pi * (8 / 24 + 28 / 1440 + 5.152 / 86400))
    assert got["s1"].dec == pytest.approx(-2 * math.pi * (50 / 360 + 1.5 / 1296000)) and got["s1"].majoraxis == pytest.approx(math.radians(83.6 / 3600))
    assert (got["s1"].i, got["s1"].spectralindex) == (1.0, [0.0, 0.0]) and got["s2"].i == 0.0
    with pytest.raises(wsclean.SkyModelError):
        wsclean.parse_header("Format = Name, Colour")
    with pytest.raises(wsclean.SkyModelError):
        wsclean.load(spark, ["s0,POINT"])
    with pytest.raises(PySparkException, match="fields"):
        wsclean.load(spark, [lines[0], "s0,POINT"]).collect()


def test_header_axes(spark):
    header = {"NAXIS": 3, "CTYPE1": "X", "NAXIS1": 3, "CRPIX1": 2, "CDELT1": 1.0, "CRVAL1": 0.0, "CUNIT1": "deg", "CTYPE2": "Y", "NAXIS2": 2, "CRPIX2": 1, "CDELT2": 0.5, "CTYPE3": "FREQ", "NAXIS3": 2, "GFREQ1": 1e9, "GFREQ2": 1.7e9}
    grids = fits.beam_grids(header, m_axis="-Y")
    assert grids["l"][1] == pytest.approx(np.radians([-1, 0, 1])) and grids["m"][1].tolist() == [0.0, -0.5] and grids["freq"] [1].tolist() == [1e9, 1.7e9]
    assert fits.axis_table(spark, header).count() == 7
    assert fits.beam_filenames("b_$(corr)_$(REIM).fits", ["XX", 12]) == {"xx": ("b_xx_RE.fits", "b_xx_IM.fits"), "yy": ("b_yy_RE.fits", "b_yy_IM.fits")}


# -------------------------------------------------------------------------- streams
def test_stream_bins_equal_batch_bins(spark, tmp_path):
    from skyfold.streaming.averaging import stream_time_bins

    m = main_rows(spark, 90).withColumn("ts", F.timestamp_seconds(F.col("time") + 1e6).cast("timestamp"))
    for part in range(3):
        m.filter(f"time >= {part * 100} and time < {(part + 1) * 100}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    want = {(r.antenna1, r.antenna2, r.bin): r for r in averaging.row_average(m, averaging.time_bins(m, 60.0).select("row_id", "bin")).collect()}
    src = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = stream_time_bins(src, 60.0).writeStream.format("memory").queryName("bins").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("bins").collect()
    assert len(got) >= len(want) - 2 * 3
    for r in got:
        w = want[r.antenna1, r.antenna2, r.bin]
        assert (r.time, r.interval, r.u, r.flag_row) == (pytest.approx(w.time), pytest.approx(w.interval), pytest.approx(w.u), w.flag_row)
