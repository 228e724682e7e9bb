"""The window scan: profiles are prepared once for all windows, and stacks of systems are solved in one pass."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import smooth, sweep


def test_the_grid_is_made_once_for_all_windows(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 10).alias("k"), F.floor(F.col("id") / 10).cast("double").alias("depth_m"),
                                   (100.0 + F.col("id") * F.col("id") % 37).alias("sec_us_cm"))
    rows.write.parquet(str(tmp_path / "grid"))
    grid = spark.read.parquet(str(tmp_path / "grid"))
    out = smooth.window_profiles(grid, ["k"], (7, 11, 15))
    assert "Relation [" not in out._jdf.queryExecution().optimizedPlan().toString()
    for window in (7, 11, 15):
        alone = smooth.savgol(grid, ["k"], "depth_m", "sec_us_cm", window)
        mine = out.where(F.col("window") == window).select("k", "depth_m", "sec_us_cm")
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, alone.select("k", "depth_m", "sec_us_cm").collect()))


def test_singular_systems_do_not_cost_a_second_pass(monkeypatch):
    rng = np.random.default_rng(2)
    gram, right = rng.normal(size=(200, 6, 6)), rng.normal(size=(200, 6))
    gram[::7, :, 3] = 0.0
    monkeypatch.setattr(sweep, "_SOLVE", None)
    want = sweep.solve_each(gram, right)
    monkeypatch.undo()
    monkeypatch.setattr(np.linalg, "slogdet", lambda *a: 1 / 0)
    got = sweep.solve_each(gram, right)
    assert np.isnan(got[::7]).all() and np.array_equal(got, want, equal_nan=True)
    assert np.isfinite(np.delete(got, np.s_[::7], axis=0)).all()
