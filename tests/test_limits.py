"""Values and problems at which a result must not change without a word."""

import math

import numpy as np
import pandas as pd
import pytest

from hearthline.functions.numbers import fixed
from hearthline.operators import lasso
from hearthline.operators.scoring import score_markets


@pytest.mark.parametrize("digits", [4, 6, 8])
def test_report_rounding_leaves_large_numbers_and_nan(spark, digits):
    values = [1e13, -1e13, 1e11, 1e300, float("inf"), float("nan"), None, 0.5]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(fixed("x", digits))
    found = [r[0] for r in df.collect()]
    assert all(a == b or (a is not None and math.isnan(a) and math.isnan(b)) for a, b in zip(found, values, strict=True))


@pytest.mark.parametrize("rho", [0.9, 1 - 1e-5, 1 - 1e-6])
@pytest.mark.parametrize(("weights", "penalty"), [([1.0, 0.2], 0.002), ([1.0, -1.0], 1e-12)])
def test_nearly_equal_features_are_solved(rho, weights, penalty):
    corr = np.array([[1.0, rho], [rho, 1.0]])
    xy = corr @ weights + penalty * np.sign(weights)
    found = lasso.lasso(corr[None], xy[None], np.full((1, 2), penalty))[0]
    assert np.allclose(found, weights, atol=1e-4)


def test_active_sets_meet_the_optimality_conditions():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = rng.normal(size=(60, 12))
        x[:, 1] = x[:, 0] + 1e-5 * rng.normal(size=60)
        x = (x - x.mean(0)) / x.std(0)
        y = x[:, 0] + rng.normal(size=60)
        corr, xy = x.T @ x / 60, x.T @ y / 60
        penalty = np.where(np.arange(12) > 9, np.inf, 0.05)
        w = lasso.active_set(corr, xy, penalty, np.zeros(12))
        slope = xy - corr @ w
        assert (np.abs(slope[w == 0]) <= penalty[w == 0] + 1e-7).all()
        assert np.allclose(slope[w != 0], penalty[w != 0] * np.sign(w[w != 0]), atol=1e-7)


def test_a_market_with_too_few_rows_has_no_score(spark):
    terms = ["one", "target", "x", *lasso.harmonic_names(1)]
    rng = np.random.default_rng(1)
    rows = []
    for code, folds in ((1, 5), (2, 3)):
        for fold in range(folds):
            z = rng.normal(size=(8, len(terms)))
            z[:, 0] = 1
            gram = z.T @ z
            rows += [(code, fold, t, *map(float, gram[k]), 0.0, 1.0) for k, t in enumerate(terms)]
    frame = pd.DataFrame(rows, columns=["code", "fold", "term", *terms, "mean", "scale"])
    found = lasso.fit_candidates(spark.createDataFrame(frame), ["x"], ["code"], max_harmonics=1).collect()
    assert all((r["r2"] is None) == (r["code"] == 2) for r in found) and {r["code"] for r in found} == {1, 2}


def test_several_models_of_a_market_are_refused(spark):
    from hearthline.functions.seasonal import MAX_HARMONICS, harmonic_names

    features = spark.sql("SELECT DATE'2001-01-31' AS month_end, 1D AS x")
    terms = ["x", *harmonic_names(MAX_HARMONICS)]
    coefs = ", ".join(f"0D AS coef_{t}" for t in terms)
    one = spark.sql(f"SELECT 1 AS urban_code, 1 AS rooms, 5D AS intercept, {coefs}")
    assert [r["y_hat"] for r in score_markets(features, one, ["x"]).collect()] == [5.0]
    with pytest.raises(Exception, match="several models of one market"):
        score_markets(features, one.unionAll(one), ["x"]).collect()
