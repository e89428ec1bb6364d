"""Direct sums over whole tables: both plans (sky broadcast, sky in blocks) against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfold.operators import calibration, dense, imaging, predict
from skyfold.plans import views as v

C = 2.99792458e8
DATA = "/root/testdata/sf0.001"
FREQS = [(c, 0.856e9 + 0.107e9 * c) for c in range(8)]


@pytest.fixture(scope="module")
def rows(spark):
    return v.snapshot(spark, DATA)


def numpy_sum(rows, sources):
    """(row, chan) -> sum over sources of flux (chan + 1) e^(i phase)."""
    out = {}
    for r in rows.collect():
        for c, f in FREQS:
            out[r.row_id, c] = sum(p.stokes_i * (c + 1) * np.exp(2j * np.pi / C * f * (p.l * r.u + p.m * r.v + (np.sqrt(1 - p.l**2 - p.m**2) - 1) * r.w)) for p in sources)
    return out


@pytest.mark.parametrize("blocks", [{}, {"most_numbers": 0, "block_numbers": 600, "block_rows": 4}])
def test_sum_over_sources(spark, rows, blocks):
    sky = v.sky(spark, DATA)
    lit = sky.select(*dense.place(), F.array(*(F.col("stokes_i") * (c + 1) for c, _ in FREQS)).alias("flux"))
    got = {(r.row_id, r.chan): complex(r.vis[0].re, r.vis[0].im) for r in dense.sum_over_sources(rows, lit, FREQS, 1, 1.0, **blocks).collect()}
    want = numpy_sum(rows, sky.collect())
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want)


@pytest.mark.parametrize("blocks", [{}, {"most_numbers": 0, "block_numbers": 40, "block_rows": 16}])
def test_sum_over_samples(spark, rows, blocks):
    samples = rows.crossJoin(v.channels(spark)).select("chan", "u", "v", "w", "freq", F.cos("row_id").alias("re"), F.sin("row_id").alias("im"))
    pixels = v.sources(spark, DATA).withColumnRenamed("source_id", "pixel").select("pixel", *dense.place())
    got = {(r.chan, r.pixel): r.value for r in dense.sum_over_samples(samples, pixels, ["chan"], -1.0, **blocks).collect()}
    data, places = samples.collect(), pixels.collect()
    assert len(got) == len(places) * 8
    for (chan, pixel), value in got.items():
        p = next(x for x in places if x.pixel == pixel)
        want = sum((complex(s.re, s.im) * np.exp(-2j * np.pi * s.freq / C * (p.l * s.u + p.m * s.v + p.n1 * s.w))).real for s in data if s.chan == chan)
        assert value == pytest.approx(want, abs=1e-7)


def test_turned_phases_stay_exact():
    path = np.linspace(-2e-5, 2e-5, 50)
    freqs = 0.856e9 + 1e5 * np.arange(1000)
    for f, value in zip(freqs, dense.turns(path, freqs), strict=True):
        assert np.abs(value - np.exp(1j * path * f)).max() < 1e-11


def test_empty_sides(spark, rows):
    none = v.sky(spark, DATA).filter("false").select(*dense.place(), F.array(*(F.lit(0.0) for _ in FREQS)).alias("flux"))
    got = dense.sum_over_sources(rows, none, FREQS, 1, 1.0).collect()
    assert len(got) == 80 and not any(r.vis[0].re or r.vis[0].im for r in got)
    assert not dense.sum_over_sources(rows.filter("false"), none, FREQS, 1, 1.0).collect()


def test_small_looks_at_bytes(spark):
    wide = spark.range(100).select("id", F.array_repeat(F.lit(1.0), 1000).alias("x"))
    assert predict.is_small(wide) and not predict.is_small(wide, most_bytes=500_000) and not predict.is_small(wide, most=99)


def test_correction_is_for_one_direction(spark):
    jones = v.jones(spark, DATA)
    two = jones.unionByName(jones.withColumn("dir", F.lit(1)))
    with pytest.raises(ValueError, match="one direction"):
        calibration.correct_vis(v.main(spark, DATA), two, v.data_vis(spark, DATA), 1)


def test_every_source_and_cell_is_there(spark):
    from skyfold.plans import registry

    q = registry.queries()
    assert q["zernike"](spark, DATA).count() == spark.read.parquet(f"{DATA}/part.parquet").count()
    assert q["beam_cube_dde"](spark, DATA).count() == 10 * 25 * 8 * 2
    assert q["abs_diff"](spark, DATA).count() == 200 * 10


def test_image_model_and_dirty_are_adjoint(spark, rows):
    """<dirty(vis), image> equals <vis, model(image)> with the same 1/n."""
    samples = rows.crossJoin(v.channels(spark)).select("row_id", "chan", "u", "v", "w", "freq", F.floor(F.col("chan") / 4).cast("int").alias("band"), F.cos("row_id").alias("re"), F.sin("row_id").alias("im"))
    pixels = imaging.image_pixels(spark, 6, 5, 3e-3)
    image = pixels.crossJoin(spark.range(2).select(F.col("id").cast("int").alias("band"))).withColumn("value", 1.0 + F.col("x") - 0.5 * F.col("y") + F.col("band"))
    d = {(r.band, r.x, r.y): r.value for r in imaging.dirty(samples, pixels).collect()}
    m = {(r.row_id, r.chan): complex(r.re, r.im) for r in imaging.model(samples, image).collect()}
    a = sum(d[r.band, r.x, r.y] * r.value for r in image.collect())
    b = sum((complex(r.re, r.im) * m[r.row_id, r.chan].conjugate()).real for r in samples.collect())
    assert a == pytest.approx(b, rel=1e-9)
