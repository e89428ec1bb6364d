"""Queries over whole test tables, one for each operator, with their SQL."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions import cplx, sky, stokes
from skyfold.operators import averaging, calibration, imaging, linalg, predict, wstack
from skyfold.operators.lineage import checkpoint_folder
from skyfold.plans import rime as language
from skyfold.plans import views as v
from skyfold.plans.views import with_views
from skyfold.sources import fits, measurement, skymodel, wsclean

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)).alias(name)


def vis1(df: DataFrame, *keys: str) -> DataFrame:
    g = cplx.entries(F.col("vis"), 1)[0]
    return df.select(*keys, r6(g.re, "re"), r6(g.im, "im"))


N1 = "(sqrt(greatest(1e0 - l * l - m * m, 0)) - 1e0)"
TAU = repr(2 * math.pi)
C = "299792458e0"
PATH = f"(l * u + m * v + {N1} * w)"
GAUSS = f"""exp(-(pow((u * (emaj * cos(pa)) - v * (emaj * sin(pa))) * (emin / CASE WHEN emaj = 0 THEN 1e0 ELSE emaj END) * freq * {math.sqrt(2) * math.pi / (sky.C * sky.FWHM)!r}, 2)
    + pow((u * (emaj * sin(pa)) + v * (emaj * cos(pa))) * freq * {math.sqrt(2) * math.pi / (sky.C * sky.FWHM)!r}, 2)))"""


def _sum_sql(flux: str, sign: str = "-", rows: str = "main", field: str = "sources") -> str:
    return with_views(f"{rows} {field} channels", f""", t AS (SELECT row_id, chan, {flux} AS f, {sign}{TAU} / {C} * {PATH} * freq AS p FROM {rows}, {field}, channels)
SELECT row_id, chan, round(sum(f * cos(p)), 6) + 0e0 AS re, round(sum(f * sin(p)), 6) + 0e0 AS im FROM t GROUP BY row_id, chan""")  # fmt: skip


def over_sky(sql: str) -> Callable[[Query], Query]:
    """A further query ``{name}_sky``: every part as a source, the snapshot's rows."""

    def add(f: Query) -> Query:
        def run(s, d):
            return f(s, d, v.sky, v.snapshot)

        run.__name__ = f"{f.__name__}_sky"
        query(sql)(run)
        return f

    return add


def _re_im(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, r6("re", "re"), r6("im", "im"))


# ------------------------------------------------------------------ prediction
_POWER = "stokes_i * pow(freq / ref_freq, alpha)"


@over_sky(_sum_sql(_POWER, "-", "snapshot", "sky"))
@query(_sum_sql(_POWER))
def predict_point(s, d, sources=v.sources, rows=v.main):
    return _re_im(predict.point_predict(rows(s, d), sources(s, d), v.channels(s)), "row_id", "chan")


_SHAPED = f"{_POWER} * CASE WHEN type = 'GAUSSIAN' THEN {GAUSS} ELSE 1e0 END"


@over_sky(_sum_sql(_SHAPED, "-", "snapshot", "sky"))
@query(_sum_sql(_SHAPED))
def predict_gaussian(s, d, sources=v.sources, rows=v.main):
    return _re_im(predict.point_predict(rows(s, d), sources(s, d), v.channels(s), shape=True), "row_id", "chan")


_WSC = "CASE WHEN source_id % 2 = 0 THEN stokes_i * exp(alpha * ln(freq / ref_freq) + c2 * pow(ln(freq / ref_freq), 2)) ELSE stokes_i + alpha * (freq / ref_freq - 1e0) + c2 * pow(freq / ref_freq - 1e0, 2) END"


def _wsclean(s, d, sources=v.sources):
    return sources(s, d).select("*", F.col("stokes_i").alias("flux"), F.array("alpha", "c2").alias("coeffs"), (F.col("source_id") % 2 == 0).alias("log_poly"))


@query(with_views("sky channels", f"SELECT source_id, chan, round({_WSC}, 10) + 0e0 AS flux FROM sky, channels"))
def wsclean_spectra(s, d, sources=v.sky):
    both = _wsclean(s, d, sources).crossJoin(F.broadcast(v.channels(s)))
    return both.select("source_id", "chan", r6(sky.wsclean_spectrum(F.col("flux"), F.col("coeffs"), F.col("log_poly"), F.col("ref_freq"), F.col("freq")), "flux", 10))


_WSC_SHAPED = f"{_WSC} * CASE WHEN type = 'POINT' THEN 1e0 ELSE {GAUSS} END"


@over_sky(_sum_sql(_WSC_SHAPED, "", "snapshot", "sky"))
@query(_sum_sql(_WSC_SHAPED, ""))
def wsclean_predict(s, d, sources=v.sources, rows=v.main):
    return _re_im(predict.wsclean_predict(rows(s, d), _wsclean(s, d, sources), v.channels(s)), "row_id", "chan")


#: A cell of an operator over sources, rows and channels: every one of them.
_CELL = ("row_id", "source_id", "chan")
_CELLS = "row_id, source_id, chan"
_ALL = "FROM snapshot, sources, channels"


def _crossed(s, d):
    rows = v.snapshot(s, d)
    # The rows may be one small file and one task, their cells many.
    rows = rows.repartition(max(1, -(-rows.count() // 5_000)))
    return rows.crossJoin(predict.small(v.sources(s, d))).crossJoin(predict.small(v.channels(s)))


def _phase(s, d, convention):
    p = sky.phase_delay(*(F.col(c) for c in ("l", "m", "u", "v", "w", "freq")), convention)
    return _crossed(s, d).select(*_CELL, r6(p.re, "re"), r6(p.im, "im"))


@query(with_views("snapshot sources channels", f"SELECT {_CELLS}, round(cos(-{TAU} / {C} * {PATH} * freq), 6) + 0e0 AS re, round(sin(-{TAU} / {C} * {PATH} * freq), 6) + 0e0 AS im {_ALL}"))
def phase_delay_fourier(s, d):
    return _phase(s, d, "fourier")


@query(with_views("snapshot sources channels", f"SELECT {_CELLS}, round(cos({TAU} / {C} * {PATH} * freq), 6) + 0e0 AS re, round(sin({TAU} / {C} * {PATH} * freq), 6) + 0e0 AS im {_ALL}"))
def phase_delay_casa(s, d):
    return _phase(s, d, "casa")


@query(with_views("snapshot sources channels", f"SELECT {_CELLS}, round({GAUSS}, 6) + 0e0 AS shape {_ALL}"))
def gaussian_shape(s, d):
    return _crossed(s, d).select(*_CELL, r6(sky.gaussian(*(F.col(c) for c in ("u", "v", "freq", "emaj", "emin", "pa"))), "shape"))


# ------------------------------------------------- coordinates, spectra, rotations
def _radec(s, d):
    k = F.col("p_partkey")
    return v.table(s, d, "part").select(k, (0.3 + 0.2 * F.cos(k.cast("double"))).alias("ra"), (-0.4 + 0.1 * F.sin(1.7 * k)).alias("dec"))


_RADEC = "q AS (SELECT p_partkey, 3e-1 + 2e-1 * cos(p_partkey) AS ra, -4e-1 + 1e-1 * sin(17e-1 * p_partkey) AS dec FROM part), lm AS (SELECT *, cos(dec) * sin(ra - 25e-2) AS l, sin(dec) * cos(-35e-2) - cos(dec) * sin(-35e-2) * cos(ra - 25e-2) AS m FROM q)"


@query(f"WITH {_RADEC} SELECT p_partkey, round(l, 9) + 0e0 AS l, round(m, 9) + 0e0 AS m, round(sqrt(1e0 - l * l - m * m), 9) AS n FROM lm")
def radec_to_lm(s, d):
    l, m, n = sky.radec_to_lmn(F.col("ra"), F.col("dec"), 0.25, -0.35)
    return _radec(s, d).select("p_partkey", r6(l, "l", 9), r6(m, "m", 9), r6(n, "n", 9))


@query(f"WITH {_RADEC} SELECT p_partkey, round(25e-2 + atan(l / (sqrt(1e0 - l * l - m * m) * cos(-35e-2) - m * sin(-35e-2))), 9) + 0e0 AS ra, round(asin(m * cos(-35e-2) + sqrt(1e0 - l * l - m * m) * sin(-35e-2)), 9) + 0e0 AS dec FROM lm")
def lm_to_radec(s, d):
    l, m = sky.radec_to_lm(F.col("ra"), F.col("dec"), 0.25, -0.35)
    ra, dec = sky.lm_to_radec(F.col("l"), F.col("m"), 0.25, -0.35)
    return _radec(s, d).select("p_partkey", l.alias("l"), m.alias("m")).select("p_partkey", r6(ra, "ra", 9), r6(dec, "dec", 9))


def _spectral(base: str, expr: str):
    def run(s, d):
        p = v.table(s, d, "part").crossJoin(F.broadcast(v.channels(s)))
        spi = F.array(-0.7 + F.col("p_size") / 100.0, F.col("p_size") / 500.0)
        return p.select("p_partkey", "chan", r6(sky.spectral_model(F.col("p_retailprice") / 1000.0, spi, F.lit(1e9), F.col("freq"), base), "flux"))

    run.__name__ = f"spectral_{base}"
    query(with_views("channels", f"SELECT p_partkey, chan, round(p_retailprice / 1e3 * {expr}, 6) + 0e0 AS flux FROM part, channels"))(run)


_A, _B, _R = "(-7e-1 + p_size / 1e2)", "(p_size / 5e2)", "(freq / 1e9)"
_spectral("std", f"pow({_R}, {_A}) * pow({_R}, {_B})")
_spectral("log", f"exp({_A} * ln({_R}) + {_B} * pow(ln({_R}), 2))")
_spectral("log10", f"pow(1e1, {_A} * log10({_R}) + {_B} * pow(log10({_R}), 2))")


def _quad(s, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return v.table(s, d, "embeddings").select("vec_id", e.alias("e"))


def _converted(s, d, inputs, outputs, real_):
    e = lambda i: F.get("e", F.lit(i))
    values = {n: cplx.real(e(i)) if real_ else cplx.Complex(e(2 * i), e(2 * i + 1)) for i, n in enumerate(inputs)}
    out = stokes.convert(values, outputs)
    return _quad(s, d).select("vec_id", *(c for n, x in zip(outputs, out, strict=True) for c in (r6(x.re, f"{n.lower()}_re"), r6(x.im, f"{n.lower()}_im"))))


def _convert_sql(rows: list[tuple[str, str, str]]) -> str:
    e = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings"
    return f"WITH q AS ({e}) SELECT vec_id, " + ", ".join(f"round({re}, 6) + 0e0 AS {n}_re, round({im}, 6) + 0e0 AS {n}_im" for n, re, im in rows) + " FROM q"


@query(_convert_sql([("xx", "e[1] + e[2]", "0e0"), ("xy", "e[3]", "e[4]"), ("yx", "e[3]", "-e[4]"), ("yy", "e[1] - e[2]", "0e0")]))
def convert_stokes_to_linear(s, d):
    return _converted(s, d, "IQUV", ["XX", "XY", "YX", "YY"], True)


@query(_convert_sql([("rr", "e[1] + e[4]", "0e0"), ("rl", "e[2]", "e[3]"), ("lr", "e[2]", "-e[3]"), ("ll", "e[1] - e[4]", "0e0")]))
def convert_stokes_to_circular(s, d):
    return _converted(s, d, "IQUV", ["RR", "RL", "LR", "LL"], True)


@query(_convert_sql([("i", "(e[1] + e[7]) / 2", "(e[2] + e[8]) / 2"), ("q", "(e[1] - e[7]) / 2", "(e[2] - e[8]) / 2"), ("u", "(e[3] + e[5]) / 2", "(e[4] + e[6]) / 2"), ("v", "(e[4] - e[6]) / 2", "(e[5] - e[3]) / 2")]))
def convert_linear_to_stokes(s, d):
    return _converted(s, d, ["XX", "XY", "YX", "YY"], ["I", "Q", "U", "V"], False)


def _rotation(s, d, kind):
    m = sky.feed_rotation(F.col("time") * 1e-6, kind)
    return v.main(s, d).select("row_id", *(c for i, x in enumerate(m) for c in (r6(x.re, f"re{i}"), r6(x.im, f"im{i}"))))


def _matrix_sql(parts: list[tuple[str, str]]) -> str:
    return with_views("main", "SELECT row_id, " + ", ".join(f"round({a}, 6) + 0e0 AS re{i}, round({b}, 6) + 0e0 AS im{i}" for i, (a, b) in enumerate(parts)) + " FROM main")


@query(_matrix_sql([("cos(time * 1e-6)", "0e0"), ("sin(time * 1e-6)", "0e0"), ("-sin(time * 1e-6)", "0e0"), ("cos(time * 1e-6)", "0e0")]))
def feed_rotation_linear(s, d):
    return _rotation(s, d, "linear")


@query(_matrix_sql([("cos(time * 1e-6)", "-sin(time * 1e-6)"), ("0e0", "0e0"), ("0e0", "0e0"), ("cos(time * 1e-6)", "sin(time * 1e-6)")]))
def feed_rotation_circular(s, d):
    return _rotation(s, d, "circular")


@query(with_views("main", "SELECT row_id, round(time * 1e-6 * (u + v + w), 6) + 0e0 AS angle FROM main"))
def parallactic_test(s, d):
    return v.main(s, d).select("row_id", r6(sky.parallactic_angle_test(F.col("time") * 1e-6, F.col("u"), F.col("v"), F.col("w")), "angle"))


_ANGLE = "(time * 1e-6)"


@query(with_views("snapshot sources channels", f", t AS (SELECT {_CELLS}, {_ANGLE} AS pa_, m, l * cos({_ANGLE}) - m * sin({_ANGLE}) AS rl {_ALL}) SELECT {_CELLS}, round((rl + 1e-3) * 11e-1, 9) + 0e0 AS l, round((rl * sin(pa_) + m * cos(pa_) - 2e-3) * 9e-1, 9) + 0e0 AS m FROM t"))
def transform_sources(s, d):
    l, m = sky.transform_source(F.col("l"), F.col("m"), F.col("time") * 1e-6, F.lit(1e-3), F.lit(-2e-3), F.lit(1.1), F.lit(0.9))
    return _crossed(s, d).select(*_CELL, r6(l, "l", 9), r6(m, "m", 9))


@query(with_views("snapshot sources channels", f""", t AS (SELECT {_CELLS}, {TAU} / {C} * freq * u AS fu, {TAU} / {C} * freq * v AS fv, 1e-4 AS b {_ALL}),
x AS (SELECT {_CELLS}, sqrt({TAU}) / sqrt(sqrt(pi()) / b) * exp(-pow({TAU} * fu * b, 2) / 2) AS u0, sqrt({TAU}) / sqrt(sqrt(pi()) / b) * exp(-pow({TAU} * fv * b, 2) / 2) AS v0, sqrt(2e0) * {TAU} * fv * b AS h1 FROM t)
SELECT {_CELLS}, round(1e3 * u0 * v0, 6) + 0e0 AS re, round(5e2 * u0 * v0 * h1, 6) + 0e0 AS im FROM x"""))
def shapelet(s, d):
    x = sky.shapelet(F.col("u"), F.col("v"), F.col("freq"), [[1000.0, 500.0]], (1e-4, 1e-4))
    return _crossed(s, d).select(*_CELL, r6(x.re, "re"), r6(x.im, "im"))


@query(with_views("sky", ", t AS (SELECT source_id, sqrt(l * l + m * m) * 4e1 AS rho, atan2(l, m) AS phi FROM sky) SELECT source_id, " + ", ".join(f"round(CASE WHEN rho > 1 THEN 0e0 ELSE {z} END, 6) + 0e0 AS z{j}" for j, z in enumerate(["1e0", "rho * cos(phi)", "rho * sin(phi)", "2 * rho * rho - 1", "rho * rho * sin(2 * phi)", "rho * rho * cos(2 * phi)"])) + " FROM t"))
def zernike(s, d, sources=v.sky):
    src = sources(s, d).withColumn("rho", F.sqrt(F.col("l") * F.col("l") + F.col("m") * F.col("m")) * 40.0).withColumn("phi", F.atan2("l", "m"))
    return src.select("source_id", *(r6(sky.zernike(j, F.col("rho"), F.col("phi")), f"z{j}") for j in range(6)))


# ------------------------------------------------------------------- averaging
@query(with_views("main", "SELECT round(time, 3) AS time, count(*) AS n_rows, min(row_id) AS first_row, CAST(dense_rank() OVER (ORDER BY time) - 1 AS INTEGER) AS time_idx FROM main GROUP BY time"))
def unique_time(s, d):
    return averaging.unique_time(v.main(s, d)).select(r6("time", "time", 3), "n_rows", "first_row", "time_idx")


@query(with_views("main", "SELECT antenna1, antenna2, count(*) AS n_rows, min(row_id) AS first_row, CAST(dense_rank() OVER (ORDER BY antenna2, antenna1) - 1 AS INTEGER) AS baseline FROM main GROUP BY antenna1, antenna2"))
def unique_baselines(s, d):
    return averaging.unique_baselines(v.main(s, d))


BIN_SECS = 43_200.0
_BINS = f""", o AS (SELECT *, row_number() OVER (PARTITION BY antenna1, antenna2 ORDER BY time) AS n FROM main),
b AS (SELECT antenna1, antenna2, n, 0 AS bin, time - span / 2 AS low FROM o WHERE n = 1
      UNION ALL SELECT o.antenna1, o.antenna2, o.n, CASE WHEN o.time + o.span / 2 - b.low > {BIN_SECS}e0 THEN b.bin + 1 ELSE b.bin END, CASE WHEN o.time + o.span / 2 - b.low > {BIN_SECS}e0 THEN o.time - o.span / 2 ELSE b.low END
      FROM b JOIN o ON o.antenna1 = b.antenna1 AND o.antenna2 = b.antenna2 AND o.n = b.n + 1),
binned AS (SELECT o.*, b.bin FROM o JOIN b USING (antenna1, antenna2, n)),
flags AS (SELECT antenna1, antenna2, bin, bool_and(flag_row) AS bin_flag FROM binned GROUP BY ALL)"""


@query(with_views("main", _BINS + " SELECT antenna1, antenna2, CAST(bin AS INTEGER) AS bin, round(avg(time), 3) AS time, sum(span) AS \"interval\", bool_and(flag_row) AS flag_row, count(*) AS n_rows, CAST(row_number() OVER (ORDER BY avg(time), antenna2, antenna1, bin) - 1 AS INTEGER) AS out_row FROM binned GROUP BY antenna1, antenna2, bin", True))
def row_mapper(s, d):
    return averaging.row_mapper(v.main(s, d), BIN_SECS).withColumn("time", F.round("time", 3))


_ROW_AVG = """ SELECT antenna1, antenna2, CAST(bin AS INTEGER) AS bin, round(avg(time), 3) AS time, sum(span) AS "interval", bin_flag AS flag_row,
round(avg(u) FILTER (flag_row = bin_flag), 6) + 0e0 AS u, round(avg(v) FILTER (flag_row = bin_flag), 6) + 0e0 AS v, round(avg(w) FILTER (flag_row = bin_flag), 6) + 0e0 AS w, round(avg(time) FILTER (flag_row = bin_flag), 3) AS time_centroid,
sum(span) FILTER (flag_row = bin_flag) AS exposure, round(sum(weight) FILTER (flag_row = bin_flag), 6) AS weight,
round(sqrt(sum(sigma * sigma * weight * weight) FILTER (flag_row = bin_flag) / pow(sum(weight) FILTER (flag_row = bin_flag), 2)), 6) AS sigma
FROM binned JOIN flags USING (antenna1, antenna2, bin) GROUP BY antenna1, antenna2, bin, bin_flag"""


def _rounded_rows(df):
    return df.select("antenna1", "antenna2", "bin", F.round("time", 3).alias("time"), "interval", "flag_row", *(r6(c, c) for c in ("u", "v", "w")), F.round("time_centroid", 3).alias("time_centroid"), "exposure", r6("weight", "weight"), r6("sigma", "sigma"))


@query(with_views("main", _BINS + _ROW_AVG, True))
def row_average(s, d):
    m = v.main(s, d)
    return _rounded_rows(averaging.row_average(m, averaging.time_bins(m, BIN_SECS).select("row_id", "bin")))


_CELL_AVG = """, k AS (SELECT *, CAST(chan // 3 AS INTEGER) AS chan_bin, 1e0 + row_id % 5 AS wt FROM cells),
f AS (SELECT label, chan_bin, corr, bool_and(flag) AS bf FROM k GROUP BY ALL)
SELECT label, chan_bin, corr, bf AS flag, round(sum(re * wt) FILTER (flag = bf) / sum(wt) FILTER (flag = bf), 6) + 0e0 AS re, round(sum(im * wt) FILTER (flag = bf) / sum(wt) FILTER (flag = bf), 6) + 0e0 AS im,
sum(wt) FILTER (flag = bf) AS weight FROM k JOIN f USING (label, chan_bin, corr) GROUP BY label, chan_bin, corr, bf"""


@query(with_views("cells", _CELL_AVG))
def row_chan_average(s, d):
    cells = averaging.channel_mapper(v.cells(s, d), 3).withColumn("weight", 1.0 + F.col("row_id") % 5)
    out = averaging.row_chan_average(cells, ["label", "chan_bin", "corr"])
    return out.select("label", "chan_bin", "corr", "flag", r6("re", "re"), r6("im", "im"), "weight")


@query(with_views("channels", "SELECT CAST(chan // 3 AS INTEGER) AS chan_bin, avg(freq) AS freq, sum(width) AS width FROM channels GROUP BY chan // 3"))
def chan_average(s, d):
    return averaging.chan_average(v.channels(s), 3)


@query(with_views("main data_vis", _BINS + """, c AS (SELECT antenna1, antenna2, bin, CAST(chan // 3 AS INTEGER) AS chan_bin, dr, di, flag, weight FROM data_vis JOIN binned USING (row_id)),
f AS (SELECT antenna1, antenna2, bin, chan_bin, bool_and(flag) AS bf FROM c GROUP BY ALL)
SELECT antenna1, antenna2, CAST(bin AS INTEGER) AS bin, chan_bin, 0 AS corr, bf AS flag, round(sum(dr * weight) FILTER (flag = bf) / sum(weight) FILTER (flag = bf), 6) + 0e0 AS re, round(sum(di * weight) FILTER (flag = bf) / sum(weight) FILTER (flag = bf), 6) + 0e0 AS im
FROM c JOIN f USING (antenna1, antenna2, bin, chan_bin) GROUP BY antenna1, antenna2, bin, chan_bin, bf""", True))
def time_and_channel(s, d):
    cells = v.data_vis(s, d).select("row_id", "chan", F.lit(0).alias("corr"), F.col("vis")[0]["re"].alias("re"), F.col("vis")[0]["im"].alias("im"), "flag")
    _, out, _ = averaging.time_and_channel(v.main(s, d), cells, v.channels(s), BIN_SECS, 3)
    return out.select("antenna1", "antenna2", "bin", "chan_bin", "corr", "flag", r6("re", "re"), r6("im", "im"))


@query(with_views("cells", "SELECT row_id, bool_and(flag) AS flag_row FROM cells GROUP BY row_id"))
def merge_flags(s, d):
    rows = v.table(s, d, "embeddings").select(F.col("vec_id").alias("row_id"))
    return averaging.merge_flags(rows, v.cells(s, d))


_LM = repr(math.radians(3.0))
_DPHI = "(acos(98e-2) * sqrt(3e0) / pi())"
_BDA = f""", o AS (SELECT *, row_number() OVER (PARTITION BY antenna1, antenna2 ORDER BY time) AS n, time - span / 2 AS t0, time + span / 2 AS t1 FROM main),
b AS (SELECT antenna1, antenna2, n, 0 AS bin, t0 AS low, u AS fu, v AS fv, w AS fw FROM o WHERE n = 1
      UNION ALL SELECT antenna1, antenna2, n, CASE WHEN new THEN bin + 1 ELSE bin END, CASE WHEN new THEN t0 ELSE low END, CASE WHEN new THEN u ELSE fu END, CASE WHEN new THEN v ELSE fv END, CASE WHEN new THEN w ELSE fw END
      FROM (SELECT *, t1 - low > 864e2 OR sin(half) / half < sin(pi() * {_DPHI}) / (pi() * {_DPHI}) AS new
            FROM (SELECT o.*, b.bin, b.low, b.fu, b.fv, b.fw, sqrt(pow(o.u - b.fu, 2) + pow(o.v - b.fv, 2) + pow(o.w - b.fw, 2)) * 1605e6 * sin({_LM}) * pi() / {C} + 1e-8 AS half
                  FROM b JOIN o ON o.antenna1 = b.antenna1 AND o.antenna2 = b.antenna2 AND o.n = b.n + 1))),
e AS (SELECT antenna1, antenna2, bin, count(*) AS rows_, arg_min(t0, n) AS first, arg_max(t1, n) AS last, any_value(o.time) AS one, any_value(o.span) AS span1,
      (arg_min(u, n) + arg_max(u, n)) / 2 AS mu, (arg_min(v, n) + arg_max(v, n)) / 2 AS mv, (arg_min(w, n) + arg_max(w, n)) / 2 AS mw FROM o JOIN b USING (antenna1, antenna2, n) GROUP BY ALL),
f AS (SELECT *, ceil(8 / greatest({C} / (2 * pi()) * {_DPHI} / sqrt(sqrt(mu * mu + mv * mv) * {_LM} + abs(mw) * abs(sqrt(1e0 - {_LM} * {_LM}) - 1)) / 107e6, 1e0)) AS need FROM e),
g AS (SELECT *, CAST(CASE WHEN rows_ = 1 OR need > 4 THEN 8 WHEN need > 2 THEN 4 WHEN need > 1 THEN 2 ELSE 1 END AS INTEGER) AS nchan FROM f),
place AS (SELECT o.row_id, g.* FROM o JOIN b USING (antenna1, antenna2, n) JOIN g USING (antenna1, antenna2, bin))"""


@query(with_views("main", _BDA + " SELECT row_id, antenna1, antenna2, CAST(bin AS INTEGER) AS bin, nchan, round(CASE WHEN rows_ = 1 THEN one ELSE (first + last) / 2 END, 3) AS bin_time, round(CASE WHEN rows_ = 1 THEN span1 ELSE last - first END, 3) AS bin_interval FROM place", True))
def bda_bins(s, d):
    chans = [(0.856e9 + 0.107e9 * i, 0.107e9) for i in range(8)]
    out = averaging.bda_bins(v.main(s, d), [c[0] for c in chans], [c[1] for c in chans], max_fov=3.0, decorrelation=0.98, time_bin_secs=86_400.0)
    return out.withColumns({c: F.round(c, 3) for c in ("bin_time", "bin_interval")})


@query(with_views("main data_vis", _BDA + """, c AS (SELECT antenna1, antenna2, bin, CAST(chan // greatest(8 // nchan, 1) AS INTEGER) AS chan_bin, dr, di, flag FROM data_vis JOIN place USING (row_id)),
k AS (SELECT antenna1, antenna2, bin, chan_bin, bool_and(flag) AS bf FROM c GROUP BY ALL)
SELECT antenna1, antenna2, CAST(bin AS INTEGER) AS bin, chan_bin, 0 AS corr, bf AS flag, round(avg(dr) FILTER (flag = bf), 6) + 0e0 AS re, round(avg(di) FILTER (flag = bf), 6) + 0e0 AS im FROM c JOIN k USING (antenna1, antenna2, bin, chan_bin) GROUP BY antenna1, antenna2, bin, chan_bin, bf""", True))
def bda(s, d):
    cells = v.data_vis(s, d).select("row_id", "chan", F.lit(0).alias("corr"), F.col("vis")[0]["re"].alias("re"), F.col("vis")[0]["im"].alias("im"), "flag")
    return averaging.bda(v.main(s, d), cells, v.channels(s), time_bin_secs=86_400.0)[1].select("antenna1", "antenna2", "bin", "chan_bin", "corr", "flag", r6("re", "re"), r6("im", "im"))


# ----------------------------------------------------------------- calibration
_GAINS = """, g AS (SELECT m.row_id, m.time_idx, m.antenna1, m.antenna2, p.chan, p.gr AS pr, p.gi AS pi_, q.gr AS qr, q.gi AS qi
    FROM main m JOIN jones p ON p.time_idx = m.time_idx AND p.ant = m.antenna1 JOIN jones q ON q.time_idx = m.time_idx AND q.ant = m.antenna2 AND q.chan = p.chan),
h AS (SELECT *, pr * qr + pi_ * qi AS kr, pi_ * qr - pr * qi AS ki FROM g)"""  # k = p conj(q)


@query(with_views("main jones model_vis", _GAINS + " SELECT row_id, chan, round(mr * kr - mi * ki, 6) + 0e0 AS re, round(mr * ki + mi * kr, 6) + 0e0 AS im FROM model_vis JOIN h USING (row_id, chan)"))
def corrupt_vis(s, d):
    return vis1(calibration.corrupt_vis(v.main(s, d), v.jones(s, d), v.model_vis(s, d), 1), "row_id", "chan")


@query(with_views("main jones data_vis", _GAINS + " SELECT row_id, chan, round(CASE WHEN flag THEN 0e0 ELSE (dr * kr + di * ki) / (kr * kr + ki * ki) END, 6) + 0e0 AS re, round(CASE WHEN flag THEN 0e0 ELSE (di * kr - dr * ki) / (kr * kr + ki * ki) END, 6) + 0e0 AS im FROM data_vis JOIN h USING (row_id, chan)"))
def correct_vis(s, d):
    return vis1(calibration.correct_vis(v.main(s, d), v.jones(s, d), v.data_vis(s, d), 1), "row_id", "chan")


@query(with_views("main jones model_vis data_vis", _GAINS + " SELECT row_id, chan, round(CASE WHEN flag THEN 0e0 ELSE dr - (mr * kr - mi * ki) END, 6) + 0e0 AS re, round(CASE WHEN flag THEN 0e0 ELSE di - (mr * ki + mi * kr) END, 6) + 0e0 AS im FROM data_vis JOIN model_vis USING (row_id, chan) JOIN h USING (row_id, chan)"))
def residual_vis(s, d):
    return vis1(calibration.residual_vis(v.main(s, d), v.jones(s, d), v.data_vis(s, d), v.model_vis(s, d), 1), "row_id", "chan")


@query(with_views("main jones data_vis", _GAINS + " SELECT row_id, chan, round(dr * kr - di * ki, 6) + 0e0 AS re, round(dr * ki + di * kr, 6) + 0e0 AS im FROM data_vis JOIN h USING (row_id, chan)"))
def apply_gains(s, d):
    g = v.jones(s, d)
    return vis1(predict.apply_gains(v.main(s, d), v.data_vis(s, d), g, g, 1), "row_id", "chan")


def _time_model(s, d):
    t = s.range(30).select(F.col("id").cast("int").alias("time_idx")).crossJoin(F.broadcast(s.range(2).select(F.col("id").cast("int").alias("dir"))))
    pos = t.select("time_idx", "dir", (0.01 * (F.col("dir") + 1) + 1e-4 * F.col("time_idx")).alias("l"), (-0.005 * (F.col("dir") + 1)).alias("m"))
    vis = F.array(F.struct((1.0 + 0.5 * F.col("dir")).alias("re"), (0.02 * F.col("time_idx")).alias("im")))
    model = t.crossJoin(F.broadcast(s.range(8).select(F.col("id").cast("int").alias("chan")))).select("time_idx", "chan", "dir", vis.alias("vis"))
    g = v.jones(s, d).drop("dir").crossJoin(F.broadcast(s.range(2).select(F.col("id").cast("int").alias("dir"))))
    return pos, model, g


@query(with_views("main jones channels", _GAINS + f""", q AS (SELECT CAST(t AS INTEGER) AS time_idx, CAST(x AS INTEGER) AS dir, 1e-2 * (x + 1) + 1e-4 * t AS l, -5e-3 * (x + 1) AS m, 1e0 + 5e-1 * x AS mr, 2e-2 * t AS mi FROM range(30) a(t), range(2) b(x)),
z AS (SELECT h.row_id, h.chan, kr, ki, mr, mi, -{TAU} / {C} * {PATH} * freq AS ph, {N1} + 1e0 AS n FROM h JOIN main USING (row_id) JOIN q ON q.time_idx = h.time_idx JOIN channels c ON c.chan = h.chan),
y AS (SELECT *, (mr * cos(ph) - mi * sin(ph)) / n AS ar, (mr * sin(ph) + mi * cos(ph)) / n AS ai FROM z)
SELECT row_id, chan, round(sum(ar * kr - ai * ki), 6) + 0e0 AS re, round(sum(ar * ki + ai * kr), 6) + 0e0 AS im FROM y GROUP BY row_id, chan"""))
def compute_and_corrupt_vis(s, d):
    pos, model, g = _time_model(s, d)
    return vis1(calibration.compute_and_corrupt_vis(v.main(s, d), g, model, pos, v.channels(s), 1), "row_id", "chan")


@query(with_views("main jones", _GAINS + " SELECT row_id, chan, round(sum(xr * kr - xi * ki), 6) + 0e0 AS re, round(sum(xr * ki + xi * kr), 6) + 0e0 AS im FROM (SELECT *, 1e0 + 1e-1 * x AS xr, 1e-2 * (row_id % 7) * x AS xi FROM h, range(3) r(x)) GROUP BY row_id, chan"))
def predict_vis_dde(s, d):
    g = v.jones(s, d).drop("dir").crossJoin(F.broadcast(s.range(3).select(F.col("id").cast("int").alias("source_id"))))
    coh = v.main(s, d).select("row_id", *v.PLACED, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("chan")).select("row_id", *v.PLACED, "chan", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("source_id"))
    coh = coh.withColumn("vis", F.array(F.struct((1.0 + 0.1 * F.col("source_id")).alias("re"), (0.01 * (F.col("row_id") % 7) * F.col("source_id")).alias("im"))))
    return vis1(predict.predict_vis(v.main(s, d), g, coh, g, n=1), "row_id", "chan")


_NORMAL = _GAINS + """, e AS (SELECT h.*, mr * kr - mi * ki AS jr, mr * ki + mi * kr AS ji, dr, di FROM h JOIN model_vis USING (row_id, chan) JOIN data_vis USING (row_id, chan) WHERE NOT flag),
r AS (SELECT *, dr - jr AS rr, di - ji AS ri FROM e),
a AS (SELECT time_idx, antenna1 AS ant, chan, jr, ji, rr, ri, 1e0 AS sg FROM r UNION ALL SELECT time_idx, antenna2, chan, jr, ji, rr, ri, -1e0 FROM r)"""


def _normal(s, d):
    res = calibration.residual_vis(v.main(s, d), v.jones(s, d), v.data_vis(s, d), v.model_vis(s, d), 1)
    return calibration.normal_equations(v.main(s, d), v.jones(s, d), res, v.model_vis(s, d), v.data_vis(s, d).select("row_id", "chan", "flag"), 1)


@query(with_views("main jones model_vis data_vis", _NORMAL + " SELECT time_idx, ant, chan, 0 AS dir, 0 AS corr, round(sum(jr * jr + ji * ji), 6) AS jhj FROM a GROUP BY time_idx, ant, chan"))
def jhj(s, d):
    return _normal(s, d).select("time_idx", "ant", "chan", "dir", "corr", r6("jhj", "jhj"))


@query(with_views("main jones model_vis data_vis", _NORMAL + " SELECT time_idx, ant, chan, 0 AS dir, 0 AS corr, round(sum(sg * (jr * ri - ji * rr)), 6) + 0e0 AS jhr_re, round(-sum(sg * (jr * rr + ji * ri)), 6) + 0e0 AS jhr_im FROM a GROUP BY time_idx, ant, chan"))
def jhr(s, d):
    return _normal(s, d).select("time_idx", "ant", "chan", "dir", "corr", r6("jhr_re", "jhr_re"), r6("jhr_im", "jhr_im"))


@query(with_views("main", ", c AS (SELECT time_idx, count(*) AS n_rows FROM main GROUP BY time_idx) SELECT time_idx, n_rows, CAST(sum(n_rows) OVER (ORDER BY time_idx) - n_rows AS BIGINT) AS bin_start, CAST((row_number() OVER (ORDER BY time_idx) - 1) // 4 AS INTEGER) AS chunk FROM c"))
def chunkify_rows(s, d):
    return calibration.chunkify_rows(v.main(s, d), 4)


_PHASES = """, c AS (SELECT row_id, time_idx, antenna1, antenna2, chan, mr, mi, mr * cos(f) - mi * sin(f) AS dr, mr * sin(f) + mi * cos(f) AS di
    FROM (SELECT row_id, time_idx, antenna1, antenna2, chan, mr, mi, 2e-1 * (sin(time_idx * antenna1) - sin(time_idx * antenna2)) AS f FROM main JOIN model_vis USING (row_id))),
n AS (SELECT time_idx, ant, chan, sum(mr * mr + mi * mi) AS jj FROM (SELECT time_idx, antenna1 AS ant, chan, mr, mi FROM c UNION ALL SELECT time_idx, antenna2, chan, mr, mi FROM c) GROUP BY ALL),
r AS (SELECT 0 AS k, time_idx, ant, chan, 0e0 AS phase, 1e0 AS moved FROM jones
      UNION ALL
      SELECT r.k + 1, r.time_idx, r.ant, r.chan, r.phase + coalesce(s.step, 0), coalesce(s.step, 0) FROM r
      LEFT JOIN (SELECT time_idx, ant, chan, 5e-1 * sum(x) / any_value(jj) AS step FROM (
            SELECT e.time_idx, CASE WHEN side = 0 THEN antenna1 ELSE antenna2 END AS ant, e.chan, (1 - 2 * side) * (jr * (di - ji) - ji * (dr - jr)) AS x
            FROM (SELECT c.*, mr * cos(p.phase - q.phase) - mi * sin(p.phase - q.phase) AS jr, mr * sin(p.phase - q.phase) + mi * cos(p.phase - q.phase) AS ji
                  FROM c JOIN r p ON p.time_idx = c.time_idx AND p.chan = c.chan AND p.ant = c.antenna1 JOIN r q ON q.time_idx = c.time_idx AND q.chan = c.chan AND q.ant = c.antenna2) e, range(2) t(side))
            JOIN n USING (time_idx, ant, chan) GROUP BY time_idx, ant, chan) s ON s.time_idx = r.time_idx AND s.ant = r.ant AND s.chan = r.chan
      WHERE r.k < 10 AND (SELECT max(abs(moved)) FROM r) > 1e-3)
SELECT time_idx, ant, chan, 0 AS dir, round(atan2(sin(phase), cos(phase)), 6) + 0e0 AS phase FROM r WHERE k = (SELECT max(k) FROM r)"""


@query(with_views("main jones model_vis", _PHASES, True))
def gauss_newton(s, d):
    start = v.jones(s, d).withColumn("g", F.array(F.struct(F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))))
    phases = v.jones(s, d).withColumn("g", F.array(cplx.expi(0.2 * F.sin((F.col("time_idx") * F.col("ant")).cast("double"))).struct()))
    vis = calibration.corrupt_vis(v.main(s, d), phases, v.model_vis(s, d), 1)
    out, _ = calibration.gauss_newton(v.main(s, d), start, vis, v.model_vis(s, d), n=1, tol=1e-3, maxiter=10)
    g = cplx.entries(F.col("g"), 1)[0]
    return out.select("time_idx", "ant", "chan", "dir", r6(F.atan2(g.im, g.re), "phase"))


_SPI_STEP = """list_transform(range(8), lambda i: {'u': pow(x[i + 1], a), 'g': ln(x[i + 1]), 'y': y[i + 1], 'w': 1e0 + i % 3})"""


@query(with_views("channels", f"""{'X'}, d AS (SELECT p_partkey AS comp, list(freq / 1e9 ORDER BY chan) AS x, list(p_retailprice / 1e3 * pow(freq / 1e9, -7e-1 + p_size / 1e2) * (1 + 2e-2 * sin(p_partkey * chan)) ORDER BY chan) AS y FROM part, channels GROUP BY p_partkey),
r AS (SELECT comp, x, y, 0 AS k, -7e-1 AS a, y[2] AS i0, 1e0 AS moved, 0e0 AS va, 0e0 AS vi, 0e0 AS chi FROM d
      UNION ALL
      SELECT comp, x, y, k + 1, a + sa, i0 + si, greatest(abs(sa), abs(si)), ii / det, aa / det, chi FROM (
        SELECT *, (ii * ra - ai * ri) / det AS sa, (aa * ri - ai * ra) / det AS si FROM (
          SELECT *, greatest(aa * ii - ai * ai, 1e-12) AS det FROM (
            SELECT comp, x, y, k, a, i0, list_sum(list_transform(s, lambda e: e.w * pow(i0 * e.u * e.g, 2))) AS aa, list_sum(list_transform(s, lambda e: e.w * i0 * e.u * e.g * e.u)) AS ai, list_sum(list_transform(s, lambda e: e.w * e.u * e.u)) AS ii,
              list_sum(list_transform(s, lambda e: e.w * i0 * e.u * e.g * (e.y - i0 * e.u))) AS ra, list_sum(list_transform(s, lambda e: e.w * e.u * (e.y - i0 * e.u))) AS ri, list_sum(list_transform(s, lambda e: e.w * pow(e.y - i0 * e.u, 2))) AS chi
            FROM (SELECT *, {_SPI_STEP} AS s FROM r WHERE moved > 1e-4 AND k < 100))))),
z AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY k DESC) AS last FROM r)
SELECT comp, round(a, 6) AS alpha, round(va * chi / 6, 9) AS alpha_var, round(i0, 6) AS i0, round(vi * chi / 6, 9) AS i0_var FROM z WHERE last = 1""".replace("X, d", ", d"), True))
def spi_fit(s, d):
    p = v.table(s, d, "part").crossJoin(F.broadcast(v.channels(s)))
    flux = sky.spectral_model(F.col("p_retailprice") / 1000.0, F.array(-0.7 + F.col("p_size") / 100.0), F.lit(1e9), F.col("freq")) * (1.0 + 0.02 * F.sin((F.col("p_partkey") * F.col("chan")).cast("double")))
    out = calibration.fit_spi(p.select(F.col("p_partkey").alias("comp"), "freq", flux.alias("flux"), (1.0 + F.col("chan") % 3).alias("weight")), 1e9)
    return out.select("comp", r6("alpha", "alpha"), r6("alpha_var", "alpha_var", 9), r6("i0", "i0"), r6("i0_var", "i0_var", 9))


# --------------------------------------------------------------------- imaging
def _im_to_vis_sql(rows: str, field: str) -> str:
    return with_views(f"{rows} {field} channels", f", t AS (SELECT row_id, chan, stokes_i * (1 + chan) AS f, -{TAU} / {C} * {PATH} * freq AS p FROM {rows}, {field}, channels) SELECT row_id, chan, 0 AS corr, round(sum(f * cos(p)), 5) + 0e0 AS re, round(sum(f * sin(p)), 5) + 0e0 AS im FROM t GROUP BY row_id, chan")


@over_sky(_im_to_vis_sql("snapshot", "sky"))
@query(_im_to_vis_sql("main", "sources"))
def im_to_vis(s, d, sources=v.sources, rows=v.main):
    px = sources(s, d).crossJoin(F.broadcast(v.channels(s))).select("l", "m", "chan", F.lit(0).alias("corr"), (F.col("stokes_i") * (1 + F.col("chan"))).alias("flux"))
    return imaging.im_to_vis(px, rows(s, d), v.channels(s)).select("row_id", "chan", "corr", r6("re", "re", 5), r6("im", "im", 5))


@query(with_views("main sources channels samples", f", t AS (SELECT source_id AS pixel, s.chan, s.re, s.im, {TAU} / {C} * {PATH} * freq AS p FROM samples s, sources WHERE NOT flag) SELECT pixel, chan, 0 AS corr, round(sum(re * cos(p) - im * sin(p)), 4) + 0e0 AS flux FROM t GROUP BY pixel, chan"))
def vis_to_im(s, d):
    cells = v.samples(s, d).select("row_id", "chan", F.lit(0).alias("corr"), "re", "im", "flag")
    out = imaging.vis_to_im(cells, v.main(s, d), v.sources(s, d).withColumnRenamed("source_id", "pixel"), v.channels(s))
    return out.select("pixel", "chan", "corr", r6("flux", "flux", 4))


NPIX, CELL, WIDTH, OVER = 64, 30.0, 5, 7
KERNEL = imaging.hanning_sinc_kernel(WIDTH, oversample=OVER)
_SCALE = repr(NPIX * CELL / 3600.0 * math.pi / 180.0)
_PLACED = f""", o AS (SELECT *, u * {_SCALE} / wavelength + {NPIX // 2} AS ou, v * {_SCALE} / wavelength + {NPIX // 2} AS ov FROM samples),
p AS (SELECT *, CAST(round_even(ou, 0) AS INTEGER) AS du, CAST(round_even(ov, 0) AS INTEGER) AS dv FROM o)"""
#: The cubic through the published points, by least squares in exact fractions, at 7.
_ALPHA = "(88463e0 / 17500e0)"
_TAPS = _PLACED + f""", tap AS (SELECT i, i / {OVER}e0 - 3 AS t FROM range({OVER * (WIDTH + 2)}) r(i)),
raw AS (SELECT i, CASE WHEN t = 0 THEN 1e0 ELSE sin(pi() * t) / (pi() * t) END * ({_ALPHA} + (1 - {_ALPHA}) * cos(2 * pi() / 8 * t)) AS k FROM tap),
kern AS (SELECT list(k / total ORDER BY i) AS k FROM raw, (SELECT sum(k) AS total FROM raw)),
s2 AS (SELECT row_id, chan, band, re, im, CAST(du + a - {WIDTH // 2} AS INTEGER) AS x, CAST(dv + b - {WIDTH // 2} AS INTEGER) AS y,
  k[(a + 1) * {OVER} + CAST(trunc((du - ou) * {OVER}) AS INTEGER) + 1] * k[(b + 1) * {OVER} + CAST(trunc((dv - ov) * {OVER}) AS INTEGER) + 1] AS kv FROM p, kern, range({WIDTH}) r(a), range({WIDTH}) q(b))"""


@query(with_views("samples", _PLACED + f" SELECT band, dv AS y, du AS x, round(sum(re), 6) + 0e0 AS re, round(sum(im), 6) + 0e0 AS im FROM p WHERE du BETWEEN 0 AND {NPIX - 1} AND dv BETWEEN 0 AND {NPIX - 1} GROUP BY band, dv, du"))
def grid_nearest(s, d):
    return _re_im(imaging.grid(v.samples(s, d), NPIX, CELL), "band", "y", "x")


@query(with_views("samples", _TAPS + f", n AS (SELECT band, sum(kv) + 1e-8 AS total FROM s2 GROUP BY band) SELECT band, y, x, round(1e6 * sum(kv * re) / any_value(total), 6) + 0e0 AS re, round(1e6 * sum(kv * im) / any_value(total), 6) + 0e0 AS im FROM s2 JOIN n USING (band) WHERE x BETWEEN 0 AND {NPIX - 1} AND y BETWEEN 0 AND {NPIX - 1} GROUP BY band, y, x"))
def grid_conv(s, d):
    out = imaging.grid(v.samples(s, d), NPIX, CELL, KERNEL, WIDTH, OVER, normalize=True)
    return out.select("band", "y", "x", r6(F.col("re") * 1e6, "re"), r6(F.col("im") * 1e6, "im"))


@query(with_views("samples plane", _TAPS + " SELECT row_id, chan, round(sum(kv * coalesce(value, 0)) / (sum(kv) + 1e-8), 6) + 0e0 AS re, round(sum(kv * coalesce(value * 5e-1, 0)) / (sum(kv) + 1e-8), 6) + 0e0 AS im FROM s2 LEFT JOIN plane USING (y, x) GROUP BY row_id, chan"))
def degrid_conv(s, d):
    plane = v.plane(s, d).select("y", "x", F.col("value").alias("re"), (F.col("value") * 0.5).alias("im")).crossJoin(F.broadcast(s.range(2).select(F.col("id").cast("int").alias("band"))))
    return _re_im(imaging.degrid(v.samples(s, d), plane, NPIX, CELL, KERNEL, WIDTH, OVER), "row_id", "chan")


_PIX = "px AS (SELECT CAST(i AS INTEGER) AS x, CAST(j AS INTEGER) AS y, (i - 4) * 2e-3 AS l, (j - 4) * 2e-3 AS m FROM range(8) r(i), range(8) q(j))"
_KP = f"{TAU} / {C} * (l * u + m * v - {N1} * w) * freq"


def _pixels(s):
    return imaging.image_pixels(s, 8, 8, 2e-3)


def _image(s):
    return _pixels(s).crossJoin(F.broadcast(s.range(2).select(F.col("id").cast("int").alias("band")))).withColumn("value", 1.0 + F.col("x") * F.col("y") + 0.5 * F.col("band"))


@query(with_views("samples", f", {_PIX}, t AS (SELECT band, x, y, re, im, {_KP} AS p, {N1} + 1e0 AS n FROM samples, px) SELECT band, x, y, round(sum((re * cos(p) - im * sin(p)) / n), 4) + 0e0 AS value FROM t GROUP BY band, x, y"))
def dirty_direct(s, d):
    return imaging.dirty(v.samples(s, d), _pixels(s)).select("band", "x", "y", r6("value", "value", 4))


_MODEL = f", {_PIX}, mv AS (SELECT row_id, chan, sum((1e0 + x * y + 5e-1 * band) / ({N1} + 1e0) * cos(-({_KP}))) AS pr, sum((1e0 + x * y + 5e-1 * band) / ({N1} + 1e0) * sin(-({_KP}))) AS pi_ FROM samples, px GROUP BY row_id, chan)"


@query(with_views("samples", _MODEL + " SELECT row_id, chan, round(pr, 6) + 0e0 AS re, round(pi_, 6) + 0e0 AS im FROM mv"))
def model_direct(s, d):
    return _re_im(imaging.model(v.samples(s, d), _image(s)), "row_id", "chan")


def _back(a: str, b: str) -> str:
    return _MODEL + f", t AS (SELECT band, x, y, {a} AS ar, {b} AS ai, {_KP} AS p, {N1} + 1e0 AS n FROM samples JOIN mv USING (row_id, chan), px) SELECT band, x, y, round(sum((ar * cos(p) - ai * sin(p)) / n), 3) + 0e0 AS value FROM t GROUP BY band, x, y"


@query(with_views("samples", _back("re - pr", "im - pi_")))
def residual_direct(s, d):
    return imaging.residual(v.samples(s, d), _image(s), _pixels(s)).select("band", "x", "y", r6("value", "value", 3))


@query(with_views("samples", _back("pr", "pi_")))
def hessian_direct(s, d):
    return imaging.hessian(v.samples(s, d), _image(s), _pixels(s)).select("band", "x", "y", r6("value", "value", 3))


@query(with_views("main", "SELECT round(degrees(1 / (2 * 3e0 * max(abs(u)) / 2e-1)) * 3600, 6) AS u_cell, round(degrees(1 / (2 * 3e0 * max(abs(v)) / 2e-1)) * 3600, 6) AS v_cell FROM main"))
def cell_size(s, d):
    return imaging.estimate_cell_size(v.main(s, d), 0.2).select(r6("u_cell", "u_cell"), r6("v_cell", "v_cell"))


@query(with_views("plane", ", r AS (SELECT y, x, round(value, 4) AS value FROM plane), a AS (SELECT * FROM r ORDER BY value DESC, y DESC, x DESC LIMIT 1), b AS (SELECT * FROM r ORDER BY value, y DESC, x DESC LIMIT 1) SELECT a.y AS max_y, a.x AS max_x, a.value AS max_value, b.y AS min_y, b.x AS min_x, b.value AS min_value FROM a, b"))
def find_peak(s, d):
    return imaging.find_peak(v.plane(s, d).withColumn("value", F.round("value", 4)))


_CLEAN = """, img AS (SELECT list(coalesce(value, 0e0) ORDER BY a, b) AS v FROM (SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM range(64) p(a), range(64) q(b)) LEFT JOIN plane ON y = a AND x = b),
r AS (SELECT 0 AS k, v AS res, list_transform(v, lambda e: 0e0) AS clean, 2e-1 * abs(list_max(v)) AS stop, list_max(v) AS top, 4096 - list_position(list_reverse(v), list_max(v)) AS pk FROM img
      UNION ALL
      SELECT k + 1, res, clean, stop, list_max(res), 4096 - list_position(list_reverse(res), list_max(res)) FROM (
        SELECT k, stop, list_transform(range(4096), lambda i: res[i + 1] - 1e-1 * top * exp(-(pow(i // 64 - pk // 64, 2) + pow(i % 64 - pk % 64, 2)) / 8e0)) AS res,
               list_transform(range(4096), lambda i: clean[i + 1] + CASE WHEN i = pk THEN 1e-1 * top ELSE 0e0 END) AS clean
        FROM r WHERE abs(top) > stop AND k <= 192)),
f AS (SELECT * FROM r ORDER BY k DESC LIMIT 1)
SELECT CAST(0 AS BIGINT) AS image_id, CAST(i // 64 AS INTEGER) AS y, CAST(i % 64 AS INTEGER) AS x, round(clean[i + 1], 4) + 0e0 AS clean, round(res[i + 1], 4) + 0e0 AS residual FROM f, range(4096) t(i)"""


@query(with_views("plane", _CLEAN, True))
def hogbom_clean(s, d):
    images = v.plane(s, d).select(F.lit(0).alias("image_id"), "y", "x", "value")
    yy, xx = F.col("id") / 128, F.col("id") % 128
    y = F.floor(yy) - 63
    psf = s.range(128 * 128).select(F.floor(yy).cast("int").alias("y"), xx.cast("int").alias("x"), F.exp(-(y * y + (xx - 63) * (xx - 63)) / 8.0).alias("value"))
    out = imaging.hogbom_clean(images, psf)
    return out.select("image_id", "y", "x", r6("clean", "clean", 4), r6("residual", "residual", 4))


@query(with_views("plane", ", t AS (SELECT y + 10 * t AS y, x + 20 * t AS x, CASE WHEN (y + x) % 5 = 0 THEN 0e0 ELSE value END AS value FROM plane, range(2) r(t)) SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(sum(value), 6) + 0e0 AS value FROM t GROUP BY y, x"))
def mosaic(s, d):
    t = F.col("tile")
    tiles = v.plane(s, d).crossJoin(F.broadcast(s.range(2).select(F.col("id").cast("int").alias("tile")))).withColumns({"y0": t * 10, "x0": t * 20})
    tiles = tiles.withColumn("value", F.when((F.col("y") + F.col("x")) % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return imaging.mosaic(tiles).select("y", "x", r6("value", "value"))


@query(with_views("plane", ", t AS (SELECT CAST(l AS INTEGER) AS mask, y, x FROM plane, range(3) r(l) WHERE (x + y) % (l + 1) = 0), c AS (SELECT y, x, count(*) AS covered FROM t GROUP BY y, x) SELECT mask, y, x, covered, round(1e0 / covered, 6) AS weight FROM t JOIN c USING (y, x)"))
def mask_weights(s, d):
    masks = v.plane(s, d).select("y", "x", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("mask")).filter((F.col("x") + F.col("y")) % (F.col("mask") + 1) == 0)
    return imaging.mask_weights(masks.select("mask", "y", "x")).select("mask", "y", "x", "covered", r6("weight", "weight"))


_TRI = [(10.0, 5.0), (50.0, 20.0), (20.0, 60.0)]


# Inside: left of each side of the triangle, or at most half a pixel off.
_TRI_SQL = """SELECT y, x, x BETWEEN 10 AND 50 AND y BETWEEN 5 AND 60 AS in_box,
    (4e1 * (y - 5) - 15e0 * (x - 10)) / sqrt(4e1 * 4e1 + 15e0 * 15e0) > -5e-1 AND (-3e1 * (y - 20) - 4e1 * (x - 50)) / 5e1 > -5e-1 AND (-1e1 * (y - 60) + 55e0 * (x - 20)) / sqrt(1e2 + 55e0 * 55e0) > -5e-1 AS in_hull FROM plane"""


@query(with_views("plane", _TRI_SQL))
def region_contains(s, d):
    x, y = F.col("x"), F.col("y")
    return v.plane(s, d).select("y", "x", linalg.in_box(x, y, linalg.bounding_box(_TRI)).alias("in_box"), linalg.in_hull(x, y, linalg.convex_hull(_TRI)).alias("in_hull"))


# --------------------------------------------------------------- linear algebra
def _points(s, d):
    k = F.col("p_partkey")
    return v.table(s, d, "part").select(k.alias("i"), F.array((k % 13).cast("double"), F.col("p_size") / 10.0).alias("x"))


def _anchors(s, d):
    """Points of every supplier."""
    k = F.col("s_suppkey")
    return v.table(s, d, "supplier").select(k.alias("i"), F.array((k % 11).cast("double"), F.col("s_nationkey") / 5.0).alias("x"))


_POINTS = "pt AS (SELECT p_partkey AS i, CAST(p_partkey % 13 AS DOUBLE) AS a, p_size / 1e1 AS b FROM part), an AS (SELECT s_suppkey AS i, CAST(s_suppkey % 11 AS DOUBLE) AS a, s_nationkey / 5e0 AS b FROM supplier), dd AS (SELECT p.i, q.i AS j, sqrt(pow(p.a - q.a, 2) + pow(p.b - q.b, 2)) AS dist FROM pt p, an q)"


@query(f"WITH {_POINTS} SELECT i, j, round(dist, 6) AS distance FROM dd")
def abs_diff(s, d):
    return linalg.covariance(_points(s, d), _anchors(s, d), 1.5, 2.0).select("i", "j", r6("distance", "distance"))


@query(f"WITH {_POINTS} SELECT i, j, round(225e-2 * exp(-dist * dist / 8e0), 6) AS value FROM dd")
def exp_squared(s, d):
    return linalg.covariance(_points(s, d), _anchors(s, d), 1.5, 2.0).select("i", "j", r6("value", "value"))


def _factor(s, n, k):
    return s.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j")).withColumn("value", F.cos((F.col("i") + 2 * F.col("j") + k).cast("double")))


@query("""WITH b AS (SELECT l_partkey % 60 AS i, sum(l_quantity) AS value FROM lineitem GROUP BY l_partkey % 60)
SELECT CAST(r AS BIGINT) AS i, round(sum(cos(r // 20 + 2 * (i // 20)) * cos((r // 5) % 4 + 2 * ((i // 5) % 4) + 1) * cos(r % 5 + 2 * (i % 5) + 2) * value), 3) + 0e0 AS value FROM b, range(60) q(r) GROUP BY r""")
def kron_matvec(s, d):
    b = v.table(s, d, "lineitem").groupBy((F.col("l_partkey") % 60).alias("i")).agg(F.sum("l_quantity").alias("value"))
    return linalg.kron_matvec([_factor(s, 3, 0), _factor(s, 4, 1), _factor(s, 5, 2)], b).select("i", r6("value", "value", 3))


_SPLINE = linalg.fit_cubic_spline([0.0, 100.0, 200.0, 350.0, 500.0], [0.0, 3.0, -1.0, 2.0, 5.0])
# The second derivatives m1, m2, m3 at the inner knots solve, with 0 at both ends,
#   200/3 m1 + 100/6 m2 = -7/100,  100/6 m1 + 250/3 m2 + 25 m3 = 6/100,  25 m2 + 100 m3 = 0.
_SPLINE_SQL = """, q AS (SELECT (6e-2 - 1e2 / 6 * (-7e-2) / (2e2 / 3)) / (25e1 / 3 - 25e0 / 4 - pow(1e2 / 6, 2) / (2e2 / 3)) AS m2),
m AS (SELECT [0e0, (-7e-2 - 1e2 / 6 * m2) / (2e2 / 3), m2, -m2 / 4, 0e0] AS m, [0e0, 1e2, 2e2, 35e1, 5e2] AS x, [0e0, 3e0, -1e0, 2e0, 5e0] AS y FROM q),
k AS (SELECT row_id, value, m, x, y, CASE WHEN value >= 35e1 THEN 4 WHEN value >= 2e2 THEN 3 WHEN value >= 1e2 THEN 2 ELSE 1 END AS j FROM main, m),
z AS (SELECT *, x[j + 1] - x[j] AS h, value - x[j] AS t, x[j + 1] - value AS s FROM k)
SELECT row_id, round((m[j] * pow(s, 3) + m[j + 1] * pow(t, 3)) / (6 * h) + (y[j] / h - m[j] * h / 6) * s + (y[j + 1] / h - m[j + 1] * h / 6) * t, 6) + 0e0 AS value FROM z"""


@query(with_views("main", _SPLINE_SQL))
def spline(s, d):
    return v.main(s, d).select("row_id", r6(linalg.spline_column(F.col("value"), _SPLINE), "value"))


# ------------------------------------------------------------------------ beams
_BEAM_FREQS = [0.9e9, 1.1e9, 1.3e9, 1.5e9]


@query(with_views("channels", """, b AS (SELECT [9e8, 11e8, 13e8, 15e8] AS g), t AS (SELECT chan, freq, g, CAST(len(list_filter(g, lambda x: x <= freq)) AS INTEGER) - 1 AS lo FROM channels, b)
SELECT chan, round(CASE WHEN lo < 0 THEN freq / 9e8 WHEN lo >= 3 AND freq <> 15e8 THEN freq / 15e8 ELSE 1e0 END, 9) AS freq_scale, round(CASE WHEN lo < 0 THEN 1e0 WHEN lo >= 3 THEN 0e0 ELSE (g[lo + 2] - freq) / (g[lo + 2] - g[lo + 1]) END, 9) AS lower_weight,
CAST(CASE WHEN lo < 0 THEN 0 WHEN lo >= 3 THEN 2 ELSE lo END AS INTEGER) AS lower FROM t"""))
def beam_freq_interp(s, d):
    return predict.frequency_bracket(v.channels(s), _BEAM_FREQS).select("chan", r6("freq_scale", "freq_scale", 9), r6("lower_weight", "lower_weight", 9), "lower")


_BEAM = """, g AS (SELECT [9e8, 11e8, 13e8, 15e8] AS g), f AS (SELECT row_id, source_id, chan, l, m, time * 1e-6 AS pa, freq, g, CAST(len(list_filter(g, lambda x: x <= freq)) AS INTEGER) - 1 AS lo FROM snapshot, sources, channels, g),
s AS (SELECT *, CASE WHEN lo < 0 THEN freq / 9e8 WHEN lo >= 3 AND freq <> 15e8 THEN freq / 15e8 ELSE 1e0 END AS sc, CASE WHEN lo < 0 THEN 1e0 WHEN lo >= 3 THEN 0e0 ELSE (g[lo + 2] - freq) / (g[lo + 2] - g[lo + 1]) END AS wl, CASE WHEN lo < 0 THEN 0 WHEN lo >= 3 THEN 2 ELSE lo END AS nu FROM f),
t AS (SELECT *, least(greatest((l * sc * cos(pa) - m * sc * sin(pa) + 3e-2) / 75e-4, 0e0), 8e0) AS x, least(greatest((l * sc * sin(pa) + m * sc * cos(pa) + 3e-2) / 75e-4, 0e0), 8e0) AS y FROM s),
c AS (SELECT row_id, source_id, chan, least(floor(x) + i, 8) AS li, least(floor(y) + j, 8) AS mi, nu + k AS ni, CASE WHEN i = 0 THEN 1 - x + floor(x) ELSE x - floor(x) END * CASE WHEN j = 0 THEN 1 - y + floor(y) ELSE y - floor(y) END * CASE WHEN k = 0 THEN wl ELSE 1 - wl END AS wt FROM t, range(2) a(i), range(2) b(j), range(2) e(k)),
v AS (SELECT c.*, corr, (1 + 5e-1 * corr) * pow(cos(least(65e-9 * (9e8 + 2e8 * ni) * sqrt(pow(li * 75e-4 - 3e-2, 2) + pow(mi * 75e-4 - 3e-2, 2)), 10881e-4)), 3) AS re, 1e-1 * li - 5e-2 * ni AS im FROM c, range(2) q(corr)),
z AS (SELECT row_id, source_id, chan, CAST(corr AS INTEGER) AS corr, sum(wt * re) AS re, sum(wt * im) AS im, sum(wt * sqrt(re * re + im * im)) AS size FROM v GROUP BY ALL)
SELECT row_id, source_id, chan, corr, round(re * size / sqrt(re * re + im * im), 6) + 0e0 AS re, round(im * size / sqrt(re * re + im * im), 6) + 0e0 AS im FROM z"""


@query(with_views("snapshot sources channels", _BEAM))
def beam_cube_dde(s, d):
    beam = fits.synthetic_beam(s, 9, 4, 0.03, _BEAM_FREQS, 2).withColumns({"re": F.col("re") * (1.0 + 0.5 * F.col("corr")), "im": 0.1 * F.col("l_idx") - 0.05 * F.col("nu_idx")})
    rows = _crossed(s, d).select(*_CELL, "l", "m", "freq", (F.col("time") * 1e-6).alias("pa"))
    out = predict.beam_cube_dde(rows, beam, ((-0.03, 0.03), (-0.03, 0.03)), (9, 9), _BEAM_FREQS, [*_CELL])
    return _re_im(out, *_CELL, "corr")


_ZERNIKE = ["1e0", "rho * cos(phi)", "rho * sin(phi)", "2 * rho * rho - 1", "rho * rho * sin(2 * phi)", "rho * rho * cos(2 * phi)"]


@query(with_views("snapshot sources channels", """, t AS (SELECT row_id, source_id, chan, antenna1 AS ant, 3e1 * l * (cos(time * 1e-6) - sin(time * 1e-6)) AS a, 3e1 * m * (sin(time * 1e-6) + cos(time * 1e-6)) AS b FROM snapshot, sources, channels),
p AS (SELECT *, sqrt(a * a + b * b) AS rho, atan2(a, b) AS phi FROM t)
SELECT row_id, source_id, chan, CAST(corr AS INTEGER) AS corr, round(CASE WHEN rho > 1 THEN 0e0 ELSE """ + " + ".join(f"cos(ant + 8 * chan + 64 * corr + {128 * j}) * ({z})" for j, z in enumerate(_ZERNIKE)) + " END, 6) + 0e0 AS value FROM p, range(2) c(corr)"))
def zernike_dde(s, d):
    rows = _crossed(s, d).select("row_id", "source_id", F.col("antenna1").alias("ant"), "chan", (F.col("l") * 30.0).alias("l"), (F.col("m") * 30.0).alias("m"), F.lit(1.0).alias("freq_scale"), (F.col("time") * 1e-6).alias("pa"), F.lit(0.0).alias("pe_l"), F.lit(0.0).alias("pe_m"), F.lit(1.0).alias("scale_l"), F.lit(1.0).alias("scale_m"))
    coeffs = s.range(8 * 8 * 2 * 6).select((F.col("id") % 8).cast("int").alias("ant"), (F.floor(F.col("id") / 8) % 8).cast("int").alias("chan"), (F.floor(F.col("id") / 64) % 2).cast("int").alias("corr"), F.floor(F.col("id") / 128).cast("int").alias("noll"), F.cos(F.col("id").cast("double")).alias("coeff"))
    return predict.zernike_dde(rows, coeffs, [*_CELL], 6).select(*_CELL, "corr", r6("value", "value"))


# ------------------------------------------------------ equation language, sources
def _spec_kb_sql(rows: str, field: str) -> str:
    return with_views(f"{rows} {field} channels", f""", t AS (SELECT row_id, chan, stokes_i * pow(freq / 1e9, -7e-1) AS i, stokes_i * 1e-1 * pow(freq / 1e9, -7e-1) AS q, -{TAU} / {C} * {PATH} * freq AS p FROM {rows}, {field}, channels)
SELECT row_id, chan, round(sum((i + q) * cos(p)), 6) + 0e0 AS xx_re, round(sum((i + q) * sin(p)), 6) + 0e0 AS xx_im, round(sum((i - q) * cos(p)), 6) + 0e0 AS yy_re, round(sum((i - q) * sin(p)), 6) + 0e0 AS yy_im FROM t GROUP BY row_id, chan""")


@over_sky(_spec_kb_sql("snapshot", "sky"))
@query(_spec_kb_sql("main", "sources"))
def rime_spec_kb(s, d, sources=v.sources, rows=v.main):
    src = sources(s, d).select("l", "m", F.array("stokes_i", F.col("stokes_i") * 0.1).alias("stokes"), F.array(F.lit(-0.7)).alias("spi"), "ref_freq")
    out = language.rime("(Kpq, Bpq): [I,Q] -> [XX,YY]", rows(s, d).select("row_id", "u", "v", "w"), src, v.channels(s).select("chan", "freq"))
    a, b = cplx.entries(F.col("vis"), 2)
    return out.select("row_id", "chan", r6(a.re, "xx_re"), r6(a.im, "xx_im"), r6(b.re, "yy_re"), r6(b.im, "yy_im"))


@query("""SELECT 's' || p_partkey AS name, round(2e0 * pi() * (CASE WHEN p_partkey % 2 = 1 THEN -1 ELSE 1 END) * ((p_partkey % 24) / 24e0 + 30 / 144e1 + 15e-1 / 864e2), 9) + 0e0 AS ra,
round(2e0 * pi() * ((p_size % 90) / 36e1 + 20 / 216e2 + 25e-1 / 1296e3), 9) + 0e0 AS dec, p_retailprice AS i, round(-7e-1 + p_size / 1e2, 6) + 0e0 AS alpha, 1e9 AS referencefrequency FROM part""")
def wsclean_source(s, d):
    k = F.col("p_partkey")
    line = F.concat(F.lit("s"), k, F.lit(","), F.when(k % 2 == 1, F.lit("-")).otherwise(F.lit("")), k % 24, F.lit(":30:1.5,"), F.col("p_size") % 90, F.lit(".20.2.5,"), F.col("p_retailprice"), F.lit(",["), F.round(-0.7 + F.col("p_size") / 100.0, 6), F.lit("],true,,"))
    lines = v.table(s, d, "part").select(line.alias("value"))
    out = wsclean.from_lines(lines, "Format = Name, Ra, Dec, I, SpectralIndex, LogarithmicSI, ReferenceFrequency='1e9', MajorAxis")
    return out.select("name", r6("ra", "ra", 9), r6("dec", "dec", 9), "i", r6(F.col("spectralindex")[0], "alpha"), "referencefrequency")


@query(with_views("main", "SELECT row_id, CAST(dense_rank() OVER (ORDER BY time) - 1 AS INTEGER) AS time_idx, CAST(dense_rank() OVER (ORDER BY antenna2, antenna1) - 1 AS INTEGER) AS baseline FROM main"))
def row_indices(s, d):
    return averaging.row_indices(v.main(s, d))


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 4 AS x FROM embeddings) SELECT vec_id, round(1e0, 6) AS h0, round(2 * x, 6) + 0e0 AS h1, round(4 * x * x - 2, 6) + 0e0 AS h2, round(8 * pow(x, 3) - 12 * x, 6) + 0e0 AS h3,
round(16 * pow(x, 4) - 48 * x * x + 12, 6) + 0e0 AS h4, round(32 * pow(x, 5) - 160 * pow(x, 3) + 120 * x, 6) + 0e0 AS h5 FROM e""")
def hermite(s, d):
    x = F.col("embedding")[0].cast("double") * 4
    return v.table(s, d, "embeddings").select("vec_id", *(r6(sky.hermite(n, x), f"h{n}") for n in range(6)))


@query("""WITH r AS (SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 40 AS DOUBLE) AS x, CAST(s_suppkey * 91 % 40 AS DOUBLE) AS y, 2e0 + s_nationkey AS w, 2e0 + s_suppkey % 7 AS h FROM supplier)
SELECT p.id AS a, q.id AS b FROM r p JOIN r q ON p.id < q.id AND p.x + p.w + 5e-1 >= q.x AND q.x + q.w + 5e-1 >= p.x AND p.y + p.h + 5e-1 >= q.y AND q.y + q.h + 5e-1 >= p.y""")
def region_overlaps(s, d):
    k = F.col("s_suppkey")
    x, y, w, h = (k * 37 % 40).cast("double"), (k * 91 % 40).cast("double"), 2.0 + F.col("s_nationkey"), 2.0 + k % 7
    corners = F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))))
    return linalg.overlap_pairs(v.table(s, d, "supplier").select(k.alias("region"), corners.alias("hull")))


# ------------------------------------------------- two by two, rotations, facets
Expr = tuple[str, str]  # real and imaginary part in SQL


def _mul(a: Expr, b: Expr) -> Expr:
    return f"({a[0]} * {b[0]} - {a[1]} * {b[1]})", f"({a[0]} * {b[1]} + {a[1]} * {b[0]})"


def _matrix(a: list[Expr], b: list[Expr]) -> list[Expr]:
    """Product of 2 x 2 matrices of SQL expressions."""
    add = lambda x, y: (f"({x[0]} + {y[0]})", f"({x[1]} + {y[1]})")
    return [add(_mul(a[2 * i], b[j]), _mul(a[2 * i + 1], b[2 + j])) for i in (0, 1) for j in (0, 1)]


def _turned(a: list[Expr]) -> list[Expr]:
    """Conjugate transpose."""
    return [(a[i][0], f"(-{a[i][1]})") for i in (0, 2, 1, 3)]


def _named(stem: str) -> list[Expr]:
    return [(f"{stem}r{i}", f"{stem}i{i}") for i in range(4)]


def _columns(values: list[Expr], stem: str, wrap: str = "{}") -> str:
    return ", ".join(f"{wrap.format(e)} AS {stem}{p}{i}" for i, x in enumerate(values) for p, e in zip("ri", x, strict=True))


def _gain4(stem: str, t: str, ant: str, chan: str) -> list[Expr]:
    """Entries of the test gains: close to one on the diagonal, small beside it."""
    return [(f"(1e0 + 1e-1 * cos({t} + {ant}))", f"(1e-1 * sin({t} * {ant}))"), (f"(1e-2 * {chan})", "2e-2"), ("-3e-2", f"(1e-2 * cos({ant}))"), (f"(9e-1 + 1e-1 * sin({t}))", f"(5e-2 * cos({chan}))")]


def _jones4(s, d):
    t, a, c = (F.col(x).cast("double") for x in ("time_idx", "ant", "chan"))
    g = [(1.0 + 0.1 * F.cos(t + a), 0.1 * F.sin(t * a)), (0.01 * c, F.lit(0.02)), (F.lit(-0.03), 0.01 * F.cos(a)), (0.9 + 0.1 * F.sin(t), 0.05 * F.cos(c))]
    return v.jones(s, d).select("time_idx", "ant", "chan", "dir", F.array(*(F.struct(re.alias("re"), im.alias("im")) for re, im in g)).alias("g"))


def _model4(rows, *extra):
    """2 x 2 visibilities of each row and channel, scaled by 1 + ``extra``."""
    k = 1.0 + sum((F.col(e) for e in extra), F.lit(0.0))
    r, c = (F.col(x).cast("double") for x in ("row_id", "chan"))
    x = [(1.0 + 0.01 * (r % 10), 0.1 * c), (0.2 + 0.0 * c, -0.1 * c), (0.1 * (r % 3), F.lit(0.3)), (F.lit(0.8), 0.05 * (r % 4))]
    return rows.withColumn("vis", F.array(*(F.struct((re * k).alias("re"), (im * k).alias("im")) for re, im in x)))


_CELLS4 = ", base AS (SELECT row_id, CAST(c AS INTEGER) AS chan, time_idx, antenna1, antenna2 FROM main, range(8) q(c))"


def _vis4(k: str = "1e0") -> list[Expr]:
    return [(f"({k} * (1e0 + 1e-2 * (row_id % 10)))", f"({k} * 1e-1 * chan)"), (f"({k} * 2e-1)", f"({k} * -1e-1 * chan)"), (f"({k} * 1e-1 * (row_id % 3))", f"({k} * 3e-1)"), (f"({k} * 8e-1)", f"({k} * 5e-2 * (row_id % 4))")]


def _out4(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(c for i, x in enumerate(cplx.entries(F.col("vis"), 4)) for c in (r6(x.re, f"re{i}"), r6(x.im, f"im{i}"))))


def _select4(stem: str, keys: str = "row_id, chan") -> str:
    return f"SELECT {keys}, " + ", ".join(f"round({stem}{p}{i}, 6) + 0e0 AS {q}{i}" for i in range(4) for p, q in (("r", "re"), ("i", "im")))


def _rows4(s, d):
    return v.main(s, d).select("row_id", *v.PLACED, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("chan"))


_CORRUPT4 = _CELLS4 + f", l AS (SELECT *, {_columns(_matrix(_gain4('p', 'time_idx', 'antenna1', 'chan'), _vis4()), 'a')} FROM base), z AS (SELECT *, {_columns(_matrix(_named('a'), _turned(_gain4('q', 'time_idx', 'antenna2', 'chan'))), 'b')} FROM l) "


@query(with_views("main", _CORRUPT4 + _select4("b") + " FROM z"))
def corrupt_vis_full(s, d):
    return _out4(calibration.corrupt_vis(v.main(s, d), _jones4(s, d), _model4(_rows4(s, d).withColumn("dir", F.lit(0))), 4), "row_id", "chan")


_INVERSE = [_named("g")[3], tuple(f"(-{x})" for x in _named("g")[1]), tuple(f"(-{x})" for x in _named("g")[2]), _named("g")[0]]


def _inverse_sql(name: str, source: str, ant: str) -> str:
    """Rows of ``source`` with the inverse gain of one antenna as ``{name}..``."""
    det = [f"({_mul(_named('g')[0], _named('g')[3])[k]} - {_mul(_named('g')[1], _named('g')[2])[k]})" for k in (0, 1)]
    over = [_mul(x, ("(dr / (dr * dr + di * di))", "(-di / (dr * dr + di * di))")) for x in _INVERSE]
    return f"(SELECT * EXCLUDE (gr0, gi0, gr1, gi1, gr2, gi2, gr3, gi3, dr, di), {_columns(over, name)} FROM (SELECT *, {det[0]} AS dr, {det[1]} AS di FROM (SELECT *, {_columns(_gain4('g', 'time_idx', ant, 'chan'), 'g')} FROM {source})))"


@query(with_views("main", _CELLS4 + f", p AS {_inverse_sql('p', 'base', 'antenna1')}, q AS {_inverse_sql('q', 'p', 'antenna2')}, l AS (SELECT *, {_columns(_matrix(_named('p'), _vis4()), 'a')} FROM q), z AS (SELECT *, {_columns(_matrix(_named('a'), _turned(_named('q'))), 'b')} FROM l) " + _select4("b") + " FROM z"))
def correct_vis_full(s, d):
    return _out4(calibration.correct_vis(v.main(s, d), _jones4(s, d), _model4(_rows4(s, d)), 4), "row_id", "chan")


@query(with_views("main", _CELLS4 + f""", e AS (SELECT base.*, x FROM base, range(3) t(x)), l AS (SELECT *, {_columns(_matrix(_gain4('p', 'time_idx', 'antenna1', 'chan'), _vis4('(1e0 + x)')), 'a')} FROM e),
k AS (SELECT *, {_columns(_matrix(_named('a'), _turned(_gain4('q', 'time_idx', 'antenna2', 'chan'))), 'b')} FROM l), n AS (SELECT row_id, chan, time_idx, antenna1, antenna2, {_columns(_named('b'), 'n', 'sum({})')} FROM k GROUP BY ALL),
m AS (SELECT * EXCLUDE ({', '.join(f'n{p}{i}' for i in range(4) for p in 'ri')}), {_columns([(f'(nr{i} + {a})', f'(ni{i} + {b})') for i, (a, b) in enumerate(_vis4())], 'm')} FROM n),
f AS (SELECT *, {_columns(_matrix(_gain4('p', 'time_idx', 'antenna1', 'chan'), _named('m')), 'f')} FROM m), z AS (SELECT *, {_columns(_matrix(_named('f'), _turned(_gain4('q', 'time_idx', 'antenna2', 'chan'))), 'z')} FROM f) """ + _select4("z") + " FROM z"))
def predict_vis_full(s, d):
    """Direction-dependent and -independent 2 x 2 terms on both sides, and base visibilities."""
    g = _jones4(s, d)
    dde = g.drop("dir").crossJoin(F.broadcast(s.range(3).select(F.col("id").cast("int").alias("source_id"))))
    coh = _model4(_rows4(s, d).select("row_id", *v.PLACED, "chan", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("source_id")), "source_id")
    out = predict.predict_vis(v.main(s, d), dde, coh, dde, g.drop("dir"), _model4(_rows4(s, d)), g.drop("dir"), n=4)
    return _out4(out, "row_id", "chan")


_FEED = [("cos({})", "0e0"), ("sin({})", "0e0"), ("(-sin({}))", "0e0"), ("cos({})", "0e0")]


def _feed(angle: str) -> list[Expr]:
    return [(a.format(angle), b) for a, b in _FEED]


_RIME = f""", c AS (SELECT row_id, chan, time, {GAUSS} AS g, -{TAU} / {C} * {PATH} * freq AS ph, stokes_i * pow(freq / 1e9, -7e-1) AS si, stokes_i * 1e-1 * pow(freq / 1e9, -7e-1) AS sq, stokes_i * 5e-2 * pow(freq / 1e9, -7e-1) AS su, stokes_i * 2e-2 * pow(freq / 1e9, -7e-1) AS sv FROM snapshot, sources, channels),
b AS (SELECT *, {_columns([('(si + sq)', '0e0'), ('su', 'sv'), ('su', '(-sv)'), ('(si - sq)', '0e0')], 'x')} FROM c),
l AS (SELECT *, {_columns(_matrix(_feed('(time * 1e-6)'), _named('x')), 'a')} FROM b), q AS (SELECT *, {_columns(_matrix(_named('a'), _turned(_feed('(time * 2e-6)'))), 'y')} FROM l),
z AS (SELECT row_id, chan, {_columns([_mul((f'yr{i}', f'yi{i}'), ('(g * cos(ph))', '(g * sin(ph))')) for i in range(4)], 'z', 'sum({})')} FROM q GROUP BY row_id, chan) """


@query(with_views("snapshot sources channels", _RIME + _select4("z") + " FROM z"))
def rime_full(s, d):
    """Feed rotations of both antennas, Gaussian shapes, phases and a 2 x 2 brightness."""
    src = v.sources(s, d).select("l", "m", F.array(*(F.col("stokes_i") * k for k in (1.0, 0.1, 0.05, 0.02))).alias("stokes"), F.array(F.lit(-0.7)).alias("spi"), "ref_freq", "emaj", "emin", "pa")
    rows = v.snapshot(s, d).select("row_id", "u", "v", "w", (F.col("time") * 1e-6).alias("feed_angle_p"), (F.col("time") * 2e-6).alias("feed_angle_q"))
    return _out4(language.rime("(Lp, Gpq, Kpq, Bpq, Lq): [I,Q,U,V] -> [XX,XY,YX,YY]", rows, src, v.channels(s).select("chan", "freq")), "row_id", "chan")


@query(with_views("snapshot channels", f"SELECT row_id, chan, round(cos(-{TAU} / {C} * freq * (1e-2 * u - 2e-2 * v + (sqrt(1e0 - 1e-4 - 4e-4) - 1) * w)), 6) + 0e0 AS re, round(sin(-{TAU} / {C} * freq * (1e-2 * u - 2e-2 * v + (sqrt(1e0 - 1e-4 - 4e-4) - 1) * w)), 6) + 0e0 AS im FROM snapshot, channels"))
def phase_steer(s, d):
    x = sky.phase_steer(F.col("u"), F.col("v"), F.col("w"), 0.01, -0.02, F.col("freq"))
    return v.snapshot(s, d).crossJoin(predict.small(v.channels(s))).select("row_id", "chan", r6(x.re, "re"), r6(x.im, "im"))


_SHAPE_W = f""", t AS (SELECT row_id, chan, {TAU} / {C} * freq * u AS fu, {TAU} / {C} * freq * v AS fv, 1e-4 AS b, -{TAU} / {C} * freq * (1e-2 * u - 2e-2 * v + (sqrt(1e0 - 1e-4 - 4e-4) - 1) * w) AS ph FROM snapshot, channels),
x AS (SELECT row_id, chan, ph, sqrt({TAU}) / sqrt(sqrt(pi()) / b) * exp(-pow({TAU} * fu * b, 2) / 2) * sqrt({TAU}) / sqrt(sqrt(pi()) / b) * exp(-pow({TAU} * fv * b, 2) / 2) AS u0, sqrt(2e0) * {TAU} * fv * b AS h1 FROM t)
SELECT row_id, chan, round(1e3 * u0 * cos(ph) - 5e2 * u0 * h1 * sin(ph), 6) + 0e0 AS re, round(1e3 * u0 * sin(ph) + 5e2 * u0 * h1 * cos(ph), 6) + 0e0 AS im FROM x"""


@query(with_views("snapshot channels", _SHAPE_W))
def shapelet_with_w(s, d):
    x = sky.shapelet_with_w(F.col("u"), F.col("v"), F.col("w"), F.col("freq"), [[1000.0, 500.0]], (1e-4, 1e-4), 0.01, -0.02)
    return v.snapshot(s, d).crossJoin(predict.small(v.channels(s))).select("row_id", "chan", r6(x.re, "re"), r6(x.im, "im"))


# A facet at (ra, dec) = (1.03, 0.52) of a field at (1.0, 0.5): rows of the direction cosines' frames.
_FACET = """, f AS (SELECT *, 3e-2 AS d, cos(52e-2) AS c, sin(52e-2) AS s, cos(5e-1) AS c0, sin(5e-1) AS s0 FROM snapshot),
g AS (SELECT *, c * sin(d) AS l0, s * c0 - c * s0 * cos(d) AS m0, s * s0 + c * c0 * cos(d) AS n0 FROM f)"""


@query(with_views("snapshot", _FACET + " SELECT row_id, round(cos(d) * u + sin(d) * (s0 * v - c0 * w), 6) + 0e0 AS u, round(c * (c0 * v + s0 * w) - s * (sin(d) * u - cos(d) * (s0 * v - c0 * w)), 6) + 0e0 AS v, round(l0 * u + m0 * v + n0 * w, 6) + 0e0 AS w FROM g"))
def facet_rotation(s, d):
    out = imaging.rotate_uvw(F.col("u"), F.col("v"), F.col("w"), 1.03, 0.52, 1.0, 0.5)
    return v.snapshot(s, d).select("row_id", *(r6(x, n) for n, x in zip("uvw", out, strict=True)))


@query(with_views("snapshot", _FACET + " SELECT row_id, round(u - w * l0 / n0, 6) + 0e0 AS u, round(v - w * m0 / n0, 6) + 0e0 AS v, round(w, 6) + 0e0 AS w FROM g"))
def facet_tilt(s, d):
    out = imaging.tilt_uvw(F.col("u"), F.col("v"), F.col("w"), 1.03, 0.52, 1.0, 0.5)
    return v.snapshot(s, d).select("row_id", *(r6(x, n) for n, x in zip("uvw", out, strict=True)))


@query(with_views("snapshot", _FACET + f" SELECT row_id, round(cos({TAU} / 21e-2 * (u * l0 + v * m0 + w * (n0 - 1))), 6) + 0e0 AS re, round(sin({TAU} / 21e-2 * (u * l0 + v * m0 + w * (n0 - 1))), 6) + 0e0 AS im FROM g"))
def facet_phase(s, d):
    x = imaging.facet_phase(F.col("u"), F.col("v"), F.col("w"), F.lit(0.21), 1.03, 0.52, 1.0, 0.5)
    return v.snapshot(s, d).select("row_id", r6(x.re, "re"), r6(x.im, "im"))


@query(with_views("samples", f""", f AS (SELECT band, wavelength, 75e-2 * re AS re, im, u, v, w, 3e-2 AS d, cos(52e-2) AS c, sin(52e-2) AS s, cos(5e-1) AS c0, sin(5e-1) AS s0 FROM samples),
g AS (SELECT *, c * sin(d) AS l0, s * c0 - c * s0 * cos(d) AS m0, s * s0 + c * c0 * cos(d) AS n0 FROM f),
h AS (SELECT band, re, im, {TAU} / wavelength * (u * l0 + v * m0 + w * (n0 - 1)) AS p, CAST(round_even((cos(d) * u + sin(d) * (s0 * v - c0 * w)) * {_SCALE} / wavelength + {NPIX // 2}, 0) AS INTEGER) AS x,
  CAST(round_even((c * (c0 * v + s0 * w) - s * (sin(d) * u - cos(d) * (s0 * v - c0 * w))) * {_SCALE} / wavelength + {NPIX // 2}, 0) AS INTEGER) AS y FROM g)
SELECT band, y, x, round(sum(re * cos(p) - im * sin(p)), 6) + 0e0 AS re, round(sum(re * sin(p) + im * cos(p)), 6) + 0e0 AS im FROM h WHERE x BETWEEN 0 AND {NPIX - 1} AND y BETWEEN 0 AND {NPIX - 1} GROUP BY band, y, x"""))
def grid_facet(s, d):
    """Stokes I of four correlations, moved to a facet and gridded."""
    pair = lambda a, b: F.struct(a.alias("re"), b.alias("im"))
    re, im, zero = F.col("re"), F.col("im"), F.lit(0.0)
    samples = v.samples(s, d).withColumn("vis", F.array(pair(re, im), pair(re * 0.1, zero), pair(re * 0.1, zero), pair(re * 0.5, im)))
    out = imaging.grid(samples, NPIX, CELL, facet=(1.03, 0.52, 1.0, 0.5), polarisation=(["XX", "XY", "YX", "YY"], "I"))
    return _re_im(out, "band", "y", "x")


# ------------------------------------------------------------ fast gridding, kernels
_STACK_PIX = "px AS (SELECT CAST(i AS INTEGER) AS x, CAST(j AS INTEGER) AS y, (i - 8) * 2e-3 AS l, (j - 6) * 2e-3 AS m FROM range(16) r(i), range(12) q(j))"


def _stack() -> wstack.Config:
    return wstack.Config(16, 12, 2e-3, 1e-12)


@query(with_views("samples", f", {_STACK_PIX}, t AS (SELECT band, x, y, re, im, {_KP} AS p, {N1} + 1e0 AS n FROM samples, px WHERE NOT flag) SELECT band, x, y, round(sum((re * cos(p) - im * sin(p)) / n), 2) + 0e0 AS value FROM t GROUP BY band, x, y"))
def dirty_stacked(s, d):
    return wstack.dirty(v.samples(s, d), _stack()).select("band", "x", "y", r6("value", "value", 2))


@query(with_views("samples", f", {_STACK_PIX}, mv AS (SELECT row_id, chan, sum((1e0 + x * y + 5e-1 * band) / ({N1} + 1e0) * cos(-({_KP}))) AS pr, sum((1e0 + x * y + 5e-1 * band) / ({N1} + 1e0) * sin(-({_KP}))) AS pi_ FROM samples, px GROUP BY row_id, chan) SELECT row_id, chan, round(pr, 2) + 0e0 AS re, round(pi_, 2) + 0e0 AS im FROM mv"))
def model_stacked(s, d):
    x, y = (s.range(n).select(F.col("id").cast("int").alias(c)) for n, c in ((16, "x"), (12, "y")))
    image = x.crossJoin(y).crossJoin(F.broadcast(s.range(2).select(F.col("id").cast("int").alias("band")))).withColumn("value", 1.0 + F.col("x") * F.col("y") + 0.5 * F.col("band"))
    return wstack.model(v.samples(s, d), image, _stack()).select("row_id", "chan", r6("re", "re", 2), r6("im", "im", 2))


_SINC = "CASE WHEN t = 0 THEN 1e0 ELSE sin(pi() * t) / (pi() * t) END"


@query(f"""WITH tap AS (SELECT i, i / 5e0 - 4 AS t FROM range(45) r(i)), s AS (SELECT i, {_SINC} AS k FROM tap),
w AS (SELECT i, t, sqrt(greatest(1 - pow(t / 5e0, 2), 0)) * 9e0 AS b FROM tap),
kb AS (SELECT i, any_value(t) AS t, avg(cos(15 * (j + 5e-1) * pi() / 4096 - b * sin((j + 5e-1) * pi() / 4096))) AS k FROM w, range(4096) q(j) GROUP BY i),
kbs AS (SELECT i, {_SINC} * k AS k FROM kb)
SELECT 'sinc' AS kind, CAST(i AS INTEGER) AS i, round(k / (SELECT sum(k) FROM s), 9) + 0e0 AS value FROM s UNION ALL SELECT 'kaiser', CAST(i AS INTEGER), round(k / (SELECT sum(k) FROM kbs), 9) + 0e0 FROM kbs""")
def kernels(s, d):
    found = [("sinc", imaging.sinc_kernel(7, 5)), ("kaiser", imaging.kaiser_sinc_kernel(7, 9.0, 5))]
    return s.createDataFrame([(kind, i, float(x)) for kind, k in found for i, x in enumerate(k)], "kind string, i int, value double").select("kind", "i", r6("value", "value", 9))


@query(f"""WITH tap AS (SELECT i, i / 5e0 - 4 AS t FROM range(45) r(i)), s AS (SELECT i, {_SINC} AS k FROM tap), n AS (SELECT sum(k) AS total FROM s),
one AS (SELECT x, sqrt(pow(sum(k / total * cos(2 * pi() * (x - 8) / 16e0 * (i - 22) / 5e0)), 2) + pow(sum(k / total * sin(2 * pi() * (x - 8) / 16e0 * (i - 22) / 5e0)), 2)) AS a FROM s, n, range(16) r(x) GROUP BY x)
SELECT CAST(p.x AS INTEGER) AS y, CAST(q.x AS INTEGER) AS x, round(p.a * q.a, 9) + 0e0 AS value FROM one p, one q""")
def detaper(s, d):
    out = imaging.detaper(imaging.sinc_kernel(7, 5), 16, 5)
    return s.createDataFrame([(y, x, float(out[y, x])) for y in range(16) for x in range(16)], "y int, x int, value double").select("y", "x", r6("value", "value", 9))


# ------------------------------------------- further averages, algebra and regions
@query(with_views("main", _BINS + """, k AS (SELECT * FROM binned JOIN flags USING (antenna1, antenna2, bin) WHERE flag_row = bin_flag)
SELECT antenna1, antenna2, CAST(bin AS INTEGER) AS bin, bin_flag AS flag_row, round(sum(weight), 6) + 0e0 AS w0, round(sum(2 * weight), 6) + 0e0 AS w1, round(sqrt(sum(pow(sigma * weight, 2)) / pow(sum(weight), 2)), 6) + 0e0 AS s0, round(sqrt(sum(pow((sigma + 1) * 2 * weight, 2)) / pow(sum(2 * weight), 2)), 6) + 0e0 AS s1 FROM k GROUP BY antenna1, antenna2, bin, bin_flag""", True))
def row_average_corr(s, d):
    """Weights and sigmas with a number for each correlation."""
    m = v.main(s, d)
    wide = m.withColumn("weight", F.array("weight", F.col("weight") * 2)).withColumn("sigma", F.array("sigma", F.col("sigma") + 1))
    out = averaging.row_average(wide, averaging.time_bins(m, BIN_SECS).select("row_id", "bin"))
    return out.select("antenna1", "antenna2", "bin", "flag_row", r6(F.col("weight")[0], "w0"), r6(F.col("weight")[1], "w1"), r6(F.col("sigma")[0], "s0"), r6(F.col("sigma")[1], "s1"))


def _block(s, n, m, k):
    return s.range(n * m).select(F.floor(F.col("id") / m).cast("int").alias("i"), (F.col("id") % m).cast("int").alias("j")).withColumn("value", F.cos((F.col("i") + 2 * F.col("j") + k).cast("double")))


@query("SELECT CAST(a * 4 + c AS BIGINT) AS i, CAST(b * 2 + e AS BIGINT) AS j, round(cos(a + 2 * b) * cos(c + 2 * e + 1), 9) + 0e0 AS value FROM range(3) p(a), range(5) q(b), range(4) r(c), range(2) t(e)")
def kron(s, d):
    return linalg.kron([_block(s, 3, 5, 0), _block(s, 4, 2, 1)]).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6("value", "value", 9))


@query("""WITH b AS (SELECT l_partkey % 10 AS k, l_suppkey % 3 AS j, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)
SELECT CAST(r AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(sum(cos(r // 4 + 2 * (k // 2)) * cos(r % 4 + 2 * (k % 2) + 1) * value), 3) + 0e0 AS value FROM b, range(12) q(r) GROUP BY r, j""")
def kron_tensormat(s, d):
    b = v.table(s, d, "lineitem").groupBy((F.col("l_partkey") % 10).alias("i"), (F.col("l_suppkey") % 3).alias("j")).agg(F.sum("l_quantity").alias("value"))
    return linalg.kron_tensormat([_block(s, 3, 5, 0), _block(s, 4, 2, 1)], b).select("i", F.col("j").cast("long").alias("j"), r6("value", "value", 3))


@query(with_views("plane", """, s AS (SELECT x AS y, y AS x, value FROM plane), t AS (SELECT *, (4e1 * (y - 5) - 15e0 * (x - 10)) / sqrt(4e1 * 4e1 + 15e0 * 15e0) > -5e-1 AND (-3e1 * (y - 20) - 4e1 * (x - 50)) / 5e1 > -5e-1 AND (-1e1 * (y - 60) + 55e0 * (x - 20)) / sqrt(1e2 + 55e0 * 55e0) > -5e-1 AS inside FROM s)
SELECT y, x, round(CASE WHEN inside THEN value ELSE 0e0 END, 6) + 0e0 AS value FROM t WHERE x BETWEEN 10 AND 50 AND y BETWEEN 5 AND 60"""))
def region_cut_out(s, d):
    return linalg.cut_out(v.plane(s, d).select(F.col("x").alias("y"), F.col("y").alias("x"), "value"), linalg.convex_hull(_TRI)).select("y", "x", r6("value", "value"))


# --------------------------------------------------- headers, measurement tables
_HEADER = {"NAXIS": 3, "CTYPE1": "RA---SIN", "NAXIS1": 5, "CRPIX1": 3.0, "CDELT1": -0.01, "CRVAL1": 10.0, "CUNIT1": "deg", "CTYPE2": "-Y", "NAXIS2": 4, "CRPIX2": 1.0, "CDELT2": 0.5, "CRVAL2": -1.0, "CTYPE3": "FREQ", "NAXIS3": 3, "GFREQ1": 1.0e9, "GFREQ2": 1.1e9, "GFREQ3": 1.3e9}


@query("""SELECT 'RA---SIN' AS axis, CAST(i AS INTEGER) AS idx, round(radians((i - 2) * -1e-2 + 1e1), 12) AS coord FROM range(5) r(i) UNION ALL SELECT '-Y', CAST(i AS INTEGER), i * 5e-1 - 1 FROM range(4) r(i)
UNION ALL SELECT 'FREQ', CAST(i AS INTEGER), [1e9, 11e8, 13e8][i + 1] FROM range(3) r(i)""")
def header_axes(s, d):
    return fits.axis_table(s, _HEADER).select("axis", "idx", r6("coord", "coord", 12))


@query("SELECT c AS corr, 'b_' || c || '_re.fits' AS re, 'b_' || c || '_im.fits' AS im FROM (SELECT unnest(['xx', 'xy', 'yx', 'yy']) AS c)")
def beam_files(s, d):
    found = fits.beam_filenames("b_$(corr)_$(reim).fits", [9, 10, "YX", 12])
    return s.createDataFrame([(c, *names) for c, names in found.items()], "corr string, re string, im string")


@query("SELECT event_id AS row_id, CAST(event_id % 3 AS INTEGER) AS field_id, CAST(event_id % 2 AS INTEGER) AS data_desc_id, value, value * 2 AS corrected, round(1e9 + 1e8 * (event_id % 2), 3) AS freq0 FROM events WHERE event_id % 3 = 1")
def measurement_scan(s, d):
    """A measurement is written, a column added, and one field's groups scanned with their spectral windows."""
    path = f"{checkpoint_folder(s).rstrip('/')}/measurement-{uuid.uuid4().hex}"
    rows = v.table(s, d, "events").select(F.col("event_id").alias("row_id"), "value", (F.col("event_id") % 3).cast("int").alias("field_id"), (F.col("event_id") % 2).cast("int").alias("data_desc_id"))
    described = s.range(2).select(F.col("id").cast("int").alias("data_desc_id"), F.col("id").cast("int").alias("spectral_window_id"))
    windows = s.range(2).select(F.col("id").cast("int").alias("spectral_window_id"), (1e9 + 1e8 * F.col("id")).alias("freq0"))
    measurement.write(path, rows, {"DATA_DESCRIPTION": described, "SPECTRAL_WINDOW": windows})
    measurement.write_column(path, rows.select("row_id", (F.col("value") * 2).alias("corrected")), "corrected")
    found = measurement.scan(s, path, ["value"], field_id=1, written=["corrected"])
    return found.join(measurement.spectral_windows(s, path), ["field_id", "data_desc_id"]).select("row_id", "field_id", "data_desc_id", "value", "corrected", r6("freq0", "freq0", 3))


@query("""SELECT p_partkey::VARCHAR AS name, CASE WHEN p_size % 2 = 0 THEN 'GAUSSIAN' ELSE 'POINT' END AS type, round(radians((p_partkey % 360)::DOUBLE), 9) AS ra, round(radians((p_size - 25)::DOUBLE), 9) AS dec, p_retailprice AS i, round(CASE WHEN p_size % 2 = 0 THEN radians(p_size / 36e2) ELSE 0e0 END, 12) AS emaj, 1e9 AS ref_freq FROM part""")
def catalogue(s, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    line = F.concat_ws(" ", k, k % 360, size - 25, F.col("p_retailprice"), F.when(size % 2 == 0, size).otherwise(0), F.lit("0"))
    lines = v.table(s, d, "part").select(line.alias("value"))
    return skymodel.catalogue(lines, "#format: name ra_d dec_d i emaj_s emin_s", 1e9).select("name", "type", r6("ra", "ra", 9), r6("dec", "dec", 9), F.col("stokes")[0].alias("i"), r6("emaj", "emaj", 12), "ref_freq")


@query(with_views("plane", """, b AS (SELECT y, x, CAST(b AS INTEGER) AS band, CASE WHEN (x + y) % 7 = 0 THEN 0e0 ELSE value * (1 - b * ((x + y) % 2)) END AS value FROM plane, range(2) r(b))
SELECT round(radians(-1e-2) * ((63 - x) + 1 - 33), 12) + 0e0 AS l, round(radians(1e-2) * (y + 1 - 33), 12) + 0e0 AS m, band, round(value, 6) + 0e0 AS flux FROM b WHERE (x + y) % 7 <> 0"""))
def cube_components(s, d):
    header = {"CUNIT1": "deg", "CUNIT2": "deg", "NAXIS1": 64, "NAXIS2": 64, "CRPIX1": 33.0, "CRPIX2": 33.0, "CDELT1": -0.01, "CDELT2": 0.01, "CTYPE3": "FREQ"}
    x, y, b = F.col("x"), F.col("y"), F.col("band")
    cube = v.plane(s, d).crossJoin(F.broadcast(s.range(2).select(F.col("id").cast("int").alias("band")))).withColumn("corr", F.lit(0))
    cube = cube.withColumn("value", F.when((x + y) % 7 == 0, F.lit(0.0)).otherwise(F.col("value") * (1 - b * ((x + y) % 2))))
    return skymodel.cube_components(cube, header).select(r6("l", "l", 12), r6("m", "m", 12), "band", r6("flux", "flux"))


@query(with_views("plane", f""", g AS (SELECT CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS x FROM range(64) p(a), range(64) q(b)), s AS (SELECT p.y, p.x, sum(coalesce(value, 0) * exp(-(pow(g.y - p.y, 2) + pow(g.x - p.x, 2)) / 2e0)) AS v FROM g p, g LEFT JOIN plane ON plane.y = g.y AND plane.x = g.x WHERE abs(g.y - p.y) <= 8 AND abs(g.x - p.x) <= 8 GROUP BY p.y, p.x),
t AS (SELECT stddev_pop(v) * 15e-1 AS cut FROM s) SELECT s.y, s.x, round(v, 4) + 0e0 AS value FROM s, t WHERE v > cut"""))
def smoothed_threshold(s, d):
    """A map convolved with a Gaussian, and its pixels above a multiple of its rms."""
    images = v.plane(s, d).select(F.lit(0).alias("image_id"), "y", "x", "value")
    smooth = imaging.convolve(images, 64, 64, (1.0, 1.0), 0.0)
    return imaging.above_threshold(smooth, 1.5).select("y", "x", r6("value", "value", 4))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


