"""Measurement tables, sky models, gain files, fast gridding and helpers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfold.functions import support
from skyfold.operators import averaging, imaging, linalg, wstack
from skyfold.plans import views as v
from skyfold.sources import fits, measurement, skymodel

DATA = "/root/testdata/sf0.001"


def test_measurement_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    rows = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("field_id"), (F.col("id") % 4).cast("int").alias("data_desc_id"), F.cos("id").alias("data"))
    measurement.write(path, rows, {"ANTENNA": spark.range(3)})
    assert measurement.subtable(spark, path, "ANTENNA").count() == 3
    some = measurement.scan(spark, path, ["data"], field_id=1, data_desc_id=3)
    assert some.count() == 10 and "PartitionFilters: [isnotnull(field_id" in some._jdf.queryExecution().toString()
    measurement.write_column(path, rows.select("row_id", (F.col("data") + 1).alias("data")), "data")
    got = {r.row_id: r.data for r in measurement.scan(spark, path, written=["data"]).collect()}
    assert got == {r.row_id: pytest.approx(r.data + 1) for r in rows.collect()}
    assert measurement.groups(spark, path).count() == 4
    with pytest.raises(ValueError):
        measurement.write(path, rows, {"SOMETHING": rows})


def test_catalogue(spark):
    lines = spark.createDataFrame([("a 10 -20 1.5 0.1 0 0 -0.7 1.4e9 0 0 0",), ("# no",), ("",), ("b 1 2 3 0 0 0 0 1e9 30 20 45",)], "value string")
    got = skymodel.catalogue(lines, "#format: name ra_d dec_d i q u v spi freq0 emaj_s emin_s pa_d").orderBy("name").collect()
    assert [(r.name, r.type, r.stokes[0], r.spi, r.ref_freq) for r in got] == [("a", "POINT", 1.5, [-0.7], 1.4e9), ("b", "GAUSSIAN", 3.0, [0.0], 1e9)]
    assert got[1].emaj == pytest.approx(np.radians(30 / 3600)) and got[1].pa == pytest.approx(np.radians(45))
    with pytest.raises(Exception, match="too few columns"):
        skymodel.catalogue(lines.filter("value like 'a%'"), "#format: name ra_d dec_d i q u v spi freq0 emaj_s emin_s pa_d more").collect()


def test_gain_files(spark, tmp_path):
    g = np.random.default_rng(1).standard_normal((3, 4, 2, 1, 2)) + 1j
    np.save(tmp_path / "g.npy", g)
    got = skymodel.gain_files(spark, f"file://{tmp_path}").collect()
    assert len(got) == 24
    for r in got:
        assert [complex(x.re, x.im) for x in r.g] == pytest.approx(list(g[r.time_idx, r.ant, r.chan, r.dir]))


def test_cube_components_need_degrees(spark):
    cube = spark.createDataFrame([(0, 0, 0, 0, 1.0)], "x int, y int, band int, corr int, value double")
    with pytest.raises(ValueError, match="degrees"):
        skymodel.cube_components(cube, {"CUNIT1": "rad"})


@pytest.mark.parametrize("epsilon", [1e-4, 1e-8])
def test_stacked_gridding_is_as_exact_as_asked(spark, epsilon):
    samples = v.samples(spark, DATA).filter("not flag and row_id < 300").withColumn("w", F.col("w") * 20)
    config = wstack.Config(12, 10, 3e-3, epsilon)
    pixels = imaging.image_pixels(spark, 12, 10, 3e-3)
    want = {(r.band, r.x, r.y): r.value for r in imaging.dirty(samples, pixels).collect()}
    got = {(r.band, r.x, r.y): r.value for r in wstack.dirty(samples, config).collect()}
    size = np.sqrt(np.mean(np.square(list(want.values()))))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 20 * epsilon * size
    image = pixels.crossJoin(spark.range(2).select(F.col("id").cast("int").alias("band"))).withColumn("value", 1.0 + F.col("x") * F.col("y"))
    want = {(r.row_id, r.chan): complex(r.re, r.im) for r in imaging.model(samples, image).collect()}
    got = {(r.row_id, r.chan): complex(r.re, r.im) for r in wstack.model(samples, image.drop("l", "m"), config).collect()}
    size = np.sqrt(np.mean(np.abs(list(want.values())) ** 2))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 20 * epsilon * size


def test_degridding_by_either_plan(spark, monkeypatch):
    samples = v.samples(spark, DATA).filter("row_id < 100")
    plane = spark.range(64 * 64).select((F.col("id") % 2).cast("int").alias("band"), F.floor(F.col("id") / 64).cast("int").alias("y"), (F.col("id") % 64).cast("int").alias("x"), F.cos("id").alias("re"), F.sin("id").alias("im"))
    kernel = imaging.hanning_sinc_kernel(5, oversample=7)
    found = []
    for most in (8_000_000, 0):
        monkeypatch.setattr(imaging, "GRID_NUMBERS", most)
        found.append({(r.row_id, r.chan): complex(r.re, r.im) for r in imaging.degrid(samples, plane, 64, 30.0, kernel, 5, 7).collect()})
    assert found[0].keys() == found[1].keys() and all(abs(found[0][k] - found[1][k]) < 1e-12 for k in found[0])


def test_synthetic_beam(spark):
    beam = {(r.l_idx, r.m_idx, r.nu_idx): r.re for r in fits.synthetic_beam(spark, 5, 2, 0.05, [1e9, 1.5e9], 1).collect()}
    at = np.linspace(-0.05, 0.05, 5)
    for (i, j, k), value in beam.items():
        assert value == pytest.approx(np.cos(min(65 * [1e9, 1.5e9][k] * 1e-9 * np.hypot(at[i], at[j]), 1.0881)) ** 3)


def test_regions_and_thresholds(spark):
    assert linalg.overlaps([(0, 0), (4, 0), (4, 4), (0, 4)], [(4.3, 1), (6, 1), (6, 3), (4.3, 3)]) and not linalg.overlaps([(0, 0), (4, 0), (4, 4)], [(9, 9), (12, 9), (12, 12)])
    maps = spark.createDataFrame([(b, 0, x, float(x * (b + 1))) for b in (0, 1) for x in range(5)], "image_id int, y int, x int, value double")
    assert {r.x for r in imaging.above_threshold(maps, dynamic_range=4.0).collect()} == {3, 4}
    with pytest.raises(ValueError):
        imaging.above_threshold(maps)


def test_row_numbers_follow_time(spark):
    got = averaging.row_mapper(v.main(spark, DATA), 43_200.0).orderBy("out_row").collect()
    assert [r.out_row for r in got] == list(range(len(got))) and all(a.time <= b.time for a, b in zip(got, got[1:], strict=False))


def test_helpers():
    assert [support.correlation_shape(n, "matrix") for n in (1, 2, 4)] == [(1,), (2,), (2, 2)] and support.correlation_shape(3, "flat") == (3,)
    assert support.parse_assignments("beta=5.6; l=[2,3]; s='hello, world'; t=tuple([1])") == {"beta": 5.6, "l": [2, 3], "s": "hello, world", "t": (1,)} and support.parse_assignments(None) == {}
    for bad in ("a=open('x')", "b", "a.b=1"):
        with pytest.raises(ValueError):
            support.parse_assignments(bad)

    @support.requires("numpy", "no_such_package")
    def f():
        return 1

    with pytest.raises(support.MissingPackage, match="no_such_package"):
        f()
    assert support.requires("numpy")(lambda: 2)() == 2
