"""Fits that share their passes: sums on a line, packed blocks, what tasks send to the driver."""

import numpy as np
from pyspark.sql import functions as F

from regimecast.operators import batched


def test_sums_on_a_line_are_those_of_all_distances():
    rng = np.random.default_rng(1)
    for _ in range(200):
        values = np.sort(rng.integers(0, 12, rng.integers(1, 50)) / 8.0)
        centres = [rng.integers(0, 14, rng.integers(1, 6)) / 8.0 for _ in range(4)]
        for listed, got in zip(centres, batched._line_sums(values, centres, True)):
            far = (values[:, None] - listed) ** 2
            at = far.argmin(axis=1)
            want = [far.min(axis=1).sum()]
            for j in range(len(listed)):
                want += [(at == j).sum(), values[at == j].sum()]
            assert np.allclose(want, got)


def test_a_pass_over_many_rows_uses_many_tasks(spark):
    """A single task held up to two million values of a line before."""
    rows = batched.Rows(spark.range(1_200_000).select(F.array(F.rand(3)).alias("x")), "x")
    assert rows.tasks == 3 and rows.frame.rdd.getNumPartitions() == 3
    fits = batched.fit_hard_many(rows, [2, 3], starts=2, max_iter=3)
    assert all(np.isfinite(f.cost) and f.passes <= 3 for k in fits for f in fits[k])


def test_sums_of_many_tasks_are_added_up_before_the_driver(spark, monkeypatch):
    rows = batched.Rows(spark.range(2_000_000).select(F.array(F.rand(3)).alias("x")), "x")
    assert rows.tasks > 2
    monkeypatch.setattr(batched, "_DIRECT_NUMBERS", 4)
    seen = []
    plain = batched.Rows.over
    monkeypatch.setattr(batched.Rows, "over", lambda self, *a: seen.append(plain(self, *a)) or seen[-1])
    summed = rows.summed(lambda values, totals: totals.update({0: totals.get(0, 0) + np.array([len(values), values.sum()])}), 2)
    assert summed[0, 0] == 2_000_000
    assert seen[0].count() > 2  # what the tasks give; two numbers reach the driver


def test_grids_do_not_fit_a_model_for_their_rows(spark, monkeypatch):
    """Ablation and sensitivity need the split rows only; a whole forest was fitted for them before."""
    from regimecast.catalog import models
    from regimecast.plans import experiments
    from regimecast.plans.forecasting import RegimeForecaster
    from regimecast.sources.views import Views
    from tests.conftest import SMALL

    def never(*args, **kwargs):
        raise AssertionError("a model was fitted")

    monkeypatch.setattr(models, "_FITTED", type(models._FITTED)())
    monkeypatch.setattr(RegimeForecaster, "fit", never)
    for name in ("ablation", "sensitivity_predictions"):
        monkeypatch.setattr(experiments, name, lambda rows, settings: rows)
    v = Views(spark, SMALL)
    assert models._ablated(v).count() == models._varied(v).count() == v.hourly_type.count()
