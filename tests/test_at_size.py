"""What larger tables showed, on small ones."""

from __future__ import annotations

from leadweave.operators import ml, stats
from leadweave.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_logistic_gradient_is_flat_where_the_loss_hardly_changes(spark):
    rows = stats.chrono_split(catalog.training_of(spark, DATA)).where("split = 'train'").cache()
    preparation, model = ml.fit("logistic_regression", rows)
    assert max(abs(r.gradient) for r in ml.penalised_gradient(preparation, model, rows).collect()) < 1e-11
    rows.unpersist()


def test_importance_shuffles_rows_once(spark):
    plan = catalog.importance_of(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    keys = [line.split("hashpartitioning(")[1] for line in exchanges]
    assert sum("bucket" in k for k in keys) == 1
    assert not any("bucket" in k and "scenario" in k or "feature" in k and "repeat" in k for k in keys)


def test_certificate_of_coefficients_as_small_as_many_rows_make_them(spark, monkeypatch):
    fit = ml.fit
    for share, nonzero in ((0.01, True), (0.0, False)):

        def small(name, rows, share=share):
            preparation, model = fit(name, rows)
            return preparation, ml.Logistic(model.coefficients * share, model.intercept)

        monkeypatch.setattr(ml, "fit", small)
        assert {r.nonzero for r in catalog.logistic_certificate(spark, DATA).collect()} == {nonzero}
