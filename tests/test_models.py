import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from hearthline.functions.seasonal import harmonic_names, with_harmonics
from hearthline.operators import gram, lasso
from hearthline.plans.models import MARKET, PRICE, RENT, MarketModel, score_table, with_actuals
from helpers import month_ends

MONTHS = month_ends("2000-01-31", 84)


def macro_frame():
    rng = np.random.default_rng(11)
    return pd.DataFrame(
        {
            "month_end": MONTHS,
            "apr": 0.05 + rng.normal(size=84).cumsum() * 1e-3,
            "hpi_sa": 200 + np.arange(84) + rng.normal(size=84) * 3,
            "fmr": 900 + 4.0 * np.arange(84) + rng.normal(size=84) * 5,
        }
    )


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame(macro_frame(), "month_end date, apr double, hpi_sa double, fmr double")


@pytest.fixture(scope="module")
def targets(spark):
    rng = np.random.default_rng(12)
    macro = macro_frame()
    season = np.array([d.month for d in MONTHS]) * 2 * np.pi / 12
    rows = []
    for code in (1, 2, 4):
        for rooms in (1, 2):
            y = 50 * code + 1.5 * rooms * macro.hpi_sa + 20 * np.sin(season) + 6 * np.cos(2 * season)
            y = y + rng.normal(size=84) * 4
            rows += [(d, code, rooms, float(v)) for d, v in zip(MONTHS, y)]
    return spark.createDataFrame(rows, "month_end date, urban_code int, rooms int, target double")


@pytest.fixture(scope="module")
def model(features, targets):
    return MarketModel(PRICE, features, targets)


@pytest.fixture(scope="module")
def folds(model):
    return model.folds.toPandas()


@pytest.fixture(scope="module")
def candidates(model):
    return model.candidates().toPandas()


def direct_lasso(x, y, alpha):
    """Plain coordinate descent on the rows themselves, for one problem."""
    mean, sd = x.mean(0), x.std(0)
    z, n = (x - mean) / sd, len(y)
    w, r = np.zeros(z.shape[1]), y - y.mean()
    for _ in range(5000):
        before = w.copy()
        for j in range(len(w)):
            r = r + z[:, j] * w[j]
            c = z[:, j] @ r / n
            w[j] = np.sign(c) * max(abs(c) - alpha, 0)
            r = r - z[:, j] * w[j]
        if np.abs(w - before).max() < 1e-12:
            break
    coef = w / sd
    return y.mean() - coef @ mean, coef


def r2(y, fitted):
    return 1 - ((y - fitted) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_codes_without_a_density_train_but_get_no_model(model, folds, candidates):
    assert model.training_set.filter("urban_code = 4 AND density IS NULL").count() == 168
    assert set(folds.urban_code) == {1, 2} == set(candidates.urban_code)


def test_training_rows_carry_the_macro_series_of_their_month(model):
    assert set(model.training_set.columns) == {"month_end", "urban_code", "rooms", "target", "density", *PRICE.columns}
    assert model.market_rows(1, 2).count() == 84


def test_folds_are_near_equal_repeatable_and_shuffled(model, folds):
    sizes = folds.groupby([*MARKET, "fold"]).size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 4 * 5
    again = model.folds.repartition(3).toPandas()
    key = [*MARKET, "month_end"]
    assert folds.set_index(key).fold.sort_index().equals(again.set_index(key).fold.sort_index())
    one = folds[(folds.urban_code == 1) & (folds.rooms == 1)].sort_values("month_end").fold.tolist()
    assert one != sorted(one) and one[:5] != [0, 1, 2, 3, 4]


def test_eleven_seasonal_columns_without_the_noise_one(spark, features):
    assert len(harmonic_names(6)) == 11 and "sin6_month" not in harmonic_names(6)
    x = with_harmonics(features, 6).select(*harmonic_names(6)).toPandas().to_numpy()
    assert np.linalg.matrix_rank(x - x.mean(0)) == 11
    assert harmonic_names(0) == []


def test_cross_products_equal_numpy(model, folds):
    terms = ["target", *PRICE.terms]
    products = model.products.toPandas()
    for (code, rooms), rows in folds.groupby(MARKET):
        x = rows[terms].to_numpy()
        z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
        for fold in range(5):
            part = z[rows.fold.to_numpy() == fold]
            got = products[(products.urban_code == code) & (products.rooms == rooms) & (products.fold == fold)]
            got = got.set_index("term").loc[["one", *terms], ["one", *terms]].to_numpy()
            assert np.allclose(got, part.T @ part, atol=1e-9)


def test_a_constant_column_is_standardised_to_zero(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (1, 5.0, 2.0)], "k int, c double, v double")
    out = gram.standardise(df, ["c", "v"], ["k"]).collect()
    assert [r.c for r in out] == [0.0, 0.0] and sorted(r.v for r in out) == [-1.0, 1.0]


def test_grid_has_every_candidate_once(candidates):
    assert (candidates.groupby(MARKET).size() == 21).all()
    assert sorted(set(candidates.alpha)) == [0.1, 10.0, 1000.0] and sorted(set(candidates.harmonics)) == list(range(7))


def test_scores_equal_cross_validation_on_the_rows(folds, candidates):
    for (code, rooms), rows in folds.groupby(MARKET):
        for alpha, harmonics in ((0.1, 0), (0.1, 6), (10.0, 2), (1000.0, 3)):
            columns = [*PRICE.columns, *harmonic_names(harmonics)]
            scores = []
            for fold in range(5):
                train, held = rows[rows.fold != fold], rows[rows.fold == fold]
                b, w = direct_lasso(train[columns].to_numpy(), train.target.to_numpy(), alpha)
                scores.append(r2(held.target.to_numpy(), b + held[columns].to_numpy() @ w))
            ours = candidates[
                (candidates.urban_code == code) & (candidates.rooms == rooms)
                & (candidates.alpha == alpha) & (candidates.harmonics == harmonics)
            ].iloc[0]
            assert list(ours.fold_r2) == pytest.approx(scores, abs=1e-7)
            assert ours.r2 == pytest.approx(np.mean(scores), abs=1e-7)


def test_refit_uses_all_rows_and_leaves_other_seasons_out(folds, candidates):
    rows = folds[(folds.urban_code == 2) & (folds.rooms == 1)]
    ours = candidates[(candidates.urban_code == 2) & (candidates.rooms == 1) & (candidates.alpha == 0.1)]
    for harmonics in (0, 2, 6):
        fit = ours[ours.harmonics == harmonics].iloc[0]
        columns = [*PRICE.columns, *harmonic_names(harmonics)]
        b, w = direct_lasso(rows[columns].to_numpy(), rows.target.to_numpy(), 0.1)
        assert fit.intercept == pytest.approx(b, rel=1e-6)
        assert [fit[f"coef_{c}"] for c in columns] == pytest.approx(list(w), rel=1e-5, abs=1e-7)
        assert all(fit[f"coef_{c}"] == 0 for c in PRICE.terms if c not in columns)


def test_agrees_with_the_library_solver(spark, model, candidates):
    """One market, no seasons: Spark's own elastic net on population-scaled features."""
    rows = model.folds.filter("urban_code = 1 AND rooms = 1").toPandas()
    x = rows[PRICE.columns].to_numpy()
    z = pd.DataFrame((x - x.mean(0)) / x.std(0), columns=PRICE.columns).assign(target=rows.target)
    data = VectorAssembler(inputCols=PRICE.columns, outputCol="z").transform(spark.createDataFrame(z))
    fit = LinearRegression(
        featuresCol="z", labelCol="target", solver="normal", elasticNetParam=1.0, regParam=10.0,
        standardization=False, tol=1e-12, maxIter=10000,
    ).fit(data)
    ours = candidates.query("urban_code == 1 and rooms == 1 and alpha == 10 and harmonics == 0").iloc[0]
    scaled = [ours[f"coef_{c}"] * s for c, s in zip(PRICE.columns, x.std(0))]
    assert scaled == pytest.approx(list(fit.coefficients), abs=1e-6)


def test_solution_meets_its_optimality_conditions():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(4, 60, 9))
    z = (z - z.mean(1, keepdims=True)) / z.std(1, keepdims=True)
    y = rng.normal(size=(4, 60))
    corr, xy = np.einsum("bni,bnj->bij", z, z) / 60, np.einsum("bni,bn->bi", z, y) / 60
    penalty = np.full((4, 9), 0.05)
    penalty[:, 8] = np.inf
    w = lasso.lasso(corr, xy, penalty)
    slope = xy - np.einsum("bij,bj->bi", corr, w)
    active = w != 0
    assert active.any() and (~active[:, :8]).any() and not active[:, 8].any()
    assert np.allclose(slope[active], 0.05 * np.sign(w[active]), atol=1e-9)
    assert (np.abs(slope[:, :8][~active[:, :8]]) <= 0.05 + 1e-9).all()


def test_ties_go_to_the_first_in_grid_order(spark):
    rows = [(1, 1, 10.0, 0, 0.5), (1, 1, 10.0, 1, 0.5 + 1e-14), (1, 1, 0.1, 3, 0.4), (1, 1, 1000.0, 0, 0.5),
            (2, 1, 0.1, 0, None), (2, 1, 10.0, 0, -3.0)]
    df = spark.createDataFrame(rows, "urban_code int, rooms int, alpha double, harmonics int, r2 double")
    best = {r.urban_code: (r.alpha, r.harmonics) for r in lasso.best_candidates(df, MARKET).collect()}
    assert best == {1: (10.0, 0), 2: (10.0, 0)}


def test_targets_without_spread_have_no_score(spark, features):
    flat = spark.createDataFrame([(d, 1, 1, 7.0) for d in MONTHS], "month_end date, urban_code int, rooms int, target double")
    (r,) = MarketModel(RENT, features, flat).fit_all().collect()
    assert r.r2 is None and r.intercept == pytest.approx(7.0) and r.coef_fmr == 0.0


@pytest.fixture(scope="module")
def fitted(model):
    return model.fit_all().cache()


def test_fit_finds_the_season_and_predicts_well(fitted):
    models = {(r.urban_code, r.rooms): r for r in fitted.collect()}
    assert set(models) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert {r.density for r in models.values()} == {"urban", "suburb"}
    assert all(r.r2 > 0.9 and r.harmonics >= 2 for r in models.values())


def test_prediction_is_the_fitted_line_of_every_market(model, features, folds, fitted):
    scores = model.predict(features, fitted)
    assert set(scores.columns) == {"month_end", "y_hat", "urban_code", "rooms", "density"}
    got = scores.toPandas()
    assert len(got) == 4 * 84
    for r in fitted.collect():
        rows = folds[(folds.urban_code == r.urban_code) & (folds.rooms == r.rooms)].sort_values("month_end")
        mine = got[(got.urban_code == r.urban_code) & (got.rooms == r.rooms)].sort_values("month_end")
        expected = r.intercept + rows[PRICE.terms].to_numpy() @ np.array([r[f"coef_{t}"] for t in PRICE.terms])
        assert np.allclose(mine.y_hat, expected, rtol=1e-9)


def test_scores_meet_actuals_and_keep_future_months_on_request(model, features, targets, fitted):
    scores = model.predict(features, fitted)
    some = targets.filter("month_end < DATE'2001-01-01'")
    assert with_actuals(scores, some).count() == 4 * 12
    left = with_actuals(scores, some, how="left")
    assert left.count() == 4 * 84 and left.filter("target IS NULL").count() == 4 * 72


def test_score_table_flags_weak_price_fits(spark):
    schema = "urban_code int, rooms int, density string, r2 double"
    price = spark.createDataFrame([(1, 1, "urban", 0.87654), (3, 1, "rural", 0.4)], schema)
    rent = spark.createDataFrame([(1, 1, "urban", 0.3), (3, 1, "rural", 0.2)], schema)
    alone = spark.createDataFrame([(2, 1, "suburb", 0.9)], schema)
    fitted = price.union(alone).selectExpr("'price' AS kind", "*").union(rent.selectExpr("'rent' AS kind", "*"))
    got = {r.urban_code: r for r in score_table(fitted).collect()}
    assert set(got) == {1, 3}
    assert got[1].r2_price_label == "0.88" and got[1].r2_rent_label == "0.30" and not got[1].weak_price_fit and got[1].r2_rent == 0.3
    assert got[3].weak_price_fit


def test_appending_a_future_changes_the_end_of_history(spark, features):
    """Smoothing runs over the whole frame it is given."""
    full = PRICE.preprocess(features).filter("month_end = DATE'2005-12-31'").first()
    cut = PRICE.preprocess(features.filter("month_end <= DATE'2005-12-31'")).filter("month_end = DATE'2005-12-31'").first()
    assert full.apr_savgol != pytest.approx(cut.apr_savgol, rel=1e-6)


def test_model_inputs_follow_the_definitions():
    assert PRICE.columns == ["apr_savgol", "hpi_sa_savgol", "apr_savgol_div_1", "apr_savgol_div_2"]
    assert RENT.columns == ["fmr", "apr_savgol", "apr_savgol_div_1"]
