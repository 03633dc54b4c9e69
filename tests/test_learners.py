"""Grouped Newton fits, counts as weights, and models on disk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.codes import BASIC5
from tidegauge.operators import calibrate, learners
from tidegauge.operators.cells import WEIGHT
from tidegauge.plans.grid import wave_cells
from tidegauge.session import cut_lineage, new_folder


@pytest.fixture(scope="module")
def cells(spark, data):
    return wave_cells(data.clean, BASIC5)


def test_grouped_newton_equals_single_fits(spark):
    rng, waves, rows = np.random.default_rng(2), [1996, 1999], []
    for wave in waves:
        for _ in range(400):
            x = [float(v) if rng.random() > 0.05 else None for v in rng.integers(0, 4, 5)]
            p = 1 / (1 + np.exp(2 - 0.5 * (x[0] or 1) + 0.3 * (x[1] or 1) - (wave - 1996) * 0.2 * (x[4] or 1)))
            rows.append((wave, *x, float(rng.random() < p), int(rng.integers(1, 5))))
    schema = "wave int, " + ", ".join(f"{f} double" for f in BASIC5) + ", y double, w long"
    cells = cut_lineage(spark.createDataFrame(rows, schema))
    model = learners.fit_logistic_by(cells, BASIC5, "wave", waves)
    for wave in waves:
        one = learners.fit_logistic(cells.filter(F.col("wave") == wave), BASIC5)
        want = [b for _, b in learners.coefficients(one)]
        assert np.allclose(model.params[wave][1], want, atol=1e-4)
        both = one.score(cells, "a").withColumn("b", model.score(F.lit(wave)))
        assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-4


def test_models_load_from_disk_alone(spark, cells):
    part = cells.filter("wave = 1997")
    fitted = learners.fit_logistic(part, BASIC5)
    loaded = learners.Fitted.load(fitted.save(new_folder(spark, "model")))
    assert loaded.features == fitted.features and loaded.scaler.params == fitted.scaler.params
    both = loaded.score(fitted.score(part.drop("age"), "a"), "b")  # also without a training feature
    assert both.filter("abs(a - b) > 1e-12").count() == 0
    folded = cut_lineage(part.withColumn("fold", (F.xxhash64(*BASIC5) % 2 + 2) % 2))
    curves = calibrate.fit_calibrated(folded, BASIC5, learners.fit_logistic, k=2)
    again = calibrate.Calibrated.load(curves.save(new_folder(spark, "calibrated")))
    both = again.score(curves.score(part, "a"), "b")
    assert both.filter("abs(a - b) > 1e-12").count() == 0 and both.agg(F.sum(WEIGHT)).first()[0] > 0
