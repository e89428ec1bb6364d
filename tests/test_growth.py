"""What must not grow with the tables: broadcasts, shuffles, task memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfold.operators import calibration, dense, expansion, linalg, predict
from skyfold.plans import registry
from skyfold.plans import views as v

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name, joins, exchanges", [("predict_vis_dde", 2, 1), ("predict_vis_full", 4, 1), ("correct_vis_full", 2, 0)])
def test_cells_meet_small_gains_alone(spark, name, joins, exchanges):
    """no cells are broadcast, and only sums over sources are shuffled."""
    df = registry.queries()[name](spark, DATA)
    assert plan(df).count("BroadcastHashJoin") == joins and "SortMergeJoin" not in plan(df)
    shuffled = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert len(shuffled) == exchanges


def test_cells_without_a_place_are_never_broadcast(spark):
    """exploded cells look as small as their rows."""
    main = v.main(spark, DATA)
    cells = v.model_vis(spark, DATA).drop(*predict.PLACED)
    found = predict.placed(cells, main)
    assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
    g = v.jones(spark, DATA)
    for some in (v.data_vis(spark, DATA), v.data_vis(spark, DATA).drop(*predict.PLACED)):
        got = predict.apply_gains(main, some, g, g, 1)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, predict.apply_gains(main, v.data_vis(spark, DATA), g, g, 1).collect()))


def test_base_alone_and_missing_cells(spark):
    main = v.main(spark, DATA).limit(3)
    base = main.select("row_id", F.lit(0).alias("chan"), F.array(F.struct(F.lit(1.0).alias("re"), F.lit(None).cast("double").alias("im"))).alias("vis"))
    coh = main.limit(2).select("row_id", F.lit(0).alias("chan"), F.lit(0).alias("source_id"), F.array(F.struct(F.lit(2.0).alias("re"), F.lit(3.0).alias("im"))).alias("vis"))
    got = sorted((r.vis[0].re, r.vis[0].im) for r in predict.predict_vis(main, coherencies=coh, base=base, n=1).collect())
    assert got == [(1.0, 0.0), (3.0, 3.0), (3.0, 3.0)]


def test_solver_checkpoints_gains_alone(spark, monkeypatch):
    """cells are kept as a compressed table, which goes when the solver ends."""
    held, tables = [], []
    real, table = calibration.cut, calibration.kept
    monkeypatch.setattr(calibration, "cut", lambda df: (held.append(df.columns), real(df))[1])
    monkeypatch.setattr(calibration, "kept", lambda df: (tables.append(table(df)), tables[-1])[1])
    assert registry.queries()["gauss_newton"](spark, DATA).count()
    assert held and not any(c.startswith("r") for columns in held for c in columns)
    with pytest.raises(Exception, match="does not exist|not exist"):
        tables[0][0].count()


@pytest.mark.parametrize("name", ["beam_cube_dde", "zernike_dde"])
def test_samples_of_a_beam_are_not_shuffled(spark, name):
    """what is summed for a sample is summed where it is read."""
    lines = registry.queries()[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert lines.count("Aggregate") <= 2  # of the coefficients alone
    assert "SortMergeJoin" not in lines


def test_beam_of_many_planes_is_joined(spark, monkeypatch):
    """A beam too large to be held gives the same values by the join."""
    want = registry.queries()["beam_cube_dde"](spark, DATA).collect()
    monkeypatch.setattr(predict.dense, "_fetch", lambda df, most: None)
    assert sorted(registry.queries()["beam_cube_dde"](spark, DATA).collect()) == sorted(want)


@pytest.mark.parametrize("most", [500_000, 3])
def test_overlaps_without_shuffled_pairs(spark, monkeypatch, most):
    """every pair of hulls whose boxes are near is tested, and none is shuffled."""
    monkeypatch.setattr(linalg, "MOST_REGIONS", most)
    monkeypatch.setattr(linalg, "BLOCK_REGIONS", 20)
    monkeypatch.setattr(linalg, "HELD_PAIRS", 50)
    rng = np.random.default_rng(3)
    hulls = [(rng.random((int(rng.integers(3, 7)), 2)) * 6 + rng.random(2) * 30).tolist() for _ in range(60)]
    hulls += [[[x, y], [x + 4, y], [x + 4, y + 2], [x, y + 2]] for x, y in rng.integers(0, 30, (20, 2)).astype(float).tolist()]
    df = spark.createDataFrame([(k, [tuple(p) for p in h]) for k, h in enumerate(hulls)], "region long, hull array<struct<x: double, y: double>>")
    found = linalg.overlap_pairs(df)
    boxes, convex = [linalg.bounding_box(h) for h in hulls], [linalg.convex_hull([tuple(p) for p in h]) for h in hulls]
    near = lambda a, b: a[1] + 0.5 >= b[0] and b[1] + 0.5 >= a[0] and a[3] + 0.5 >= b[2] and b[3] + 0.5 >= a[2]
    want = [(a, b) for a in range(80) for b in range(a + 1, 80) if near(boxes[a], boxes[b]) and linalg.overlaps(convex[a], convex[b])]
    got = sorted((r.a, r.b) for r in found.collect())
    assert got == want and len(want) > 50
    assert "Aggregate" not in plan(found)


def test_pairs_of_points_are_compiled(spark):
    """A distance is one expression of numbers, and a task has a bounded number of pairs."""
    found = registry.queries()["abs_diff"](spark, DATA)
    assert "lambdafunction" not in plan(found) and "RepartitionByExpression" not in plan(found)
    points = spark.createDataFrame([(1, [0.0, 3.0]), (2, [1.0])], "i long, x array<double>")
    got = {(r.i, r.j): r.distance for r in linalg.covariance(points, points, 1.0, 1.0).collect()}
    assert got == {(1, 1): 0.0, (2, 2): 0.0, (1, 2): None, (2, 1): None}


@pytest.mark.parametrize("name", ["im_to_vis_sky", "predict_point_sky", "predict_gaussian_sky", "wsclean_predict_sky", "rime_spec_kb_sky"])
def test_sums_by_expansion(spark, monkeypatch, name):
    """the expansion gives the direct sum's values, and is used."""
    want = {(r[0], r[1]): r[-2:] for r in registry.queries()[name](spark, DATA).collect()}
    used = []
    real = dense.expansion.expanded
    monkeypatch.setattr(dense, "DIRECT_PAIRS", 0)
    monkeypatch.setattr(dense.expansion, "expanded", lambda *a: (used.append(1), real(*a))[1])
    monkeypatch.setattr(dense, "MOST_WORK", 1e-9)
    got = {(r[0], r[1]): r[-2:] for r in registry.queries()[name](spark, DATA).collect()}
    assert used and got.keys() == want.keys()
    assert all(abs(x - y) <= 1.1e-5 for k in want for x, y in zip(got[k], want[k], strict=True))


def test_expansion_is_exact():
    """As near to the sum in long doubles as the direct sum."""
    rng = np.random.default_rng(1)
    l, m, flux = 0.02 * np.cos(rng.random(300) * 9), 0.02 * np.sin(rng.random(300) * 9), rng.random((300, 1))
    uvw = rng.uniform(-1, 1, (3, 40)) * np.array([[500.0], [500.0], [50.0]])
    uvw[:, 0] = 0.0
    f = expansion.field((l.min(), l.max(), m.min(), m.max()), (500.0, 500.0, 50.0), 1.6e9)
    got = expansion.at_rows(uvw, expansion.source_moments(l, m, flux, f), 1.6e9, -1.0, f)[:, 0]
    block = dense.Sky(np.stack([l, m, np.sqrt(1 - l * l - m * m) - 1]), flux[:, None, :])
    want = dense.visibilities(uvw, block, np.array([1.6e9]), -1.0)[:, 0, 0]
    assert np.abs(got - want).max() < 1e-10
    assert expansion.field((-0.6, 0.6, -0.6, 0.6), (1.0, 1.0, 1.0), 1e9) is None


def test_equation_with_one_phase_is_summed_in_arrays(spark):
    """no pair of a row and a source becomes a row of Spark."""
    lines = plan(registry.queries()["rime_spec_kb_sky"](spark, DATA))
    assert "MapInArrow" in lines and "NestedLoop" not in lines and "CartesianProduct" not in lines
