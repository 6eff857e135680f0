"""Sparse linear models from cross-products, one group of small matrices per market."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seasonal import harmonic_names
from .gram import ONE
from .path import lasso_path, weights_at

# The candidate grid.
ALPHAS = (0.1, 10.0, 1000.0)
HARMONICS = (0, 1, 2, 3, 4, 5, 6)

#: Tasks over which markets are dealt: some for each of two kinds of twelve markets.
SPREAD = 48

_TOLERANCE, _MAX_SWEEPS, _SWEEPS_PER_CHECK, _MAX_STEPS = 1e-13, 4_000, 5, 500

# Workers get this module's functions with the task and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lasso(corr: np.ndarray, xy: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Minimise w'Rw/2 - r'w + sum(penalty * |w|) for a batch of problems at once.

    ``corr`` is (batch, p, p) with unit diagonal where the feature varies and zeros where
    it does not; ``xy`` and ``penalty`` are (batch, p). An infinite penalty shuts a
    feature out. Cyclic coordinate descent; a problem leaves the batch once its weights rest. Problems
    that don't rest, as with features that are almost the same, are solved by their active sets.
    """
    weights = np.zeros_like(xy)
    todo = np.arange(len(xy))
    for _ in range(_MAX_SWEEPS):
        r, c, limit, w = xy[todo], corr[todo], penalty[todo], weights[todo]
        for _ in range(_SWEEPS_PER_CHECK):
            before = w.copy()
            for j in range(w.shape[1]):
                pull = r[:, j] - np.einsum("bk,bk->b", c[:, j], w) + c[:, j, j] * w[:, j]
                w[:, j] = pull - np.clip(pull, -limit[:, j], limit[:, j])
        weights[todo] = w
        moved = np.abs(w - before).max(axis=1)
        todo = todo[moved > _TOLERANCE * (1.0 + np.abs(w).max(axis=1))]
        if not len(todo):
            break
    for b in todo:
        weights[b] = active_set(corr[b], xy[b], penalty[b], weights[b])
    return weights


def active_set(corr: np.ndarray, xy: np.ndarray, penalty: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The exact minimum of one problem, by its active set and signs; NaN if none of the steps reaches it.

    With signs fixed, the active weights solve a linear system. A step towards its solution ends where it
    makes the objective least among itself and the places where a weight changes its sign, so each step
    lowers the objective and no active set comes twice.
    """

    def objective(w: np.ndarray) -> float:
        return w @ corr @ w / 2 - xy @ w + np.abs(w) @ np.where(np.isinf(penalty), 0.0, penalty)

    w = np.where(np.isinf(penalty), 0.0, start)
    scale = 1e-9 * (1.0 + np.abs(xy).max(initial=0.0))
    for _ in range(_MAX_STEPS):
        slope = xy - corr @ w
        resting = w == 0
        excess = np.where(resting, np.abs(slope) - penalty, 0.0)
        off = np.where(resting, 0.0, np.abs(slope - np.sign(w) * np.where(resting, 0.0, penalty)))
        if off.max(initial=0.0) <= scale:
            if excess.max(initial=0.0) <= scale:
                return w
            joins = int(excess.argmax())
        else:
            joins = -1
        signs = np.sign(w)
        if joins >= 0:
            signs[joins] = np.sign(slope[joins])
        active = np.flatnonzero(signs)
        goal = np.zeros_like(w)
        goal[active] = np.linalg.lstsq(corr[np.ix_(active, active)], xy[active] - penalty[active] * signs[active], rcond=1e-14)[0]
        turns = [k for k in active if signs[k] * goal[k] < 0 and w[k] != 0]
        places = [goal]
        for k in turns:
            place = w + w[k] / (w[k] - goal[k]) * (goal - w)
            place[k] = 0.0
            places.append(place)
        best = min(places, key=objective)
        if np.array_equal(best, w):
            break
        w = best
    return np.full_like(w, np.nan)


def _training_moments(gram: np.ndarray):
    """Means, deviations, correlations and covariances with the target of a batch of sums.

    Terms are ordered one, target, features.
    """
    n = gram[:, 0, 0][:, None]
    mean = gram[:, 0, :] / n
    cov = gram / n[:, :, None] - mean[:, :, None] * mean[:, None, :]
    var = np.einsum("bii->bi", cov)[:, 2:]
    varies = var > 1e-14
    sd = np.sqrt(np.where(varies, var, 1.0))
    both = varies[:, :, None] & varies[:, None, :]
    corr = np.where(both, cov[:, 2:, 2:] / (sd[:, :, None] * sd[:, None, :]), 0.0)
    xy = np.where(varies, cov[:, 1, 2:] / sd, 0.0)
    return mean, sd, corr, xy


def _path_weights(corr, xy, usable, penalties) -> np.ndarray:
    """Weights of every candidate (penalty, harmonics) and training set, from one path per harmonics and training set."""
    out = np.empty((len(penalties) * len(usable), len(corr), corr.shape[1]))
    for h, shut in enumerate(usable):
        for f in range(len(corr)):
            path = lasso_path(corr[f], xy[f], shut)
            for i, penalty in enumerate(penalties):
                out[i * len(usable) + h, f] = weights_at(*path, penalty)
    return out


def grid_search(gram, means, scales, usable, alphas, by_path=False) -> list[dict]:
    """Cross-validated score and full refit of every candidate of one market.

    ``gram`` is (folds, terms, terms) of standardised terms. Each fold's model is trained
    on the total less that fold; the last problem of each candidate is the refit.
    """
    folds = len(gram)
    total = gram.sum(axis=0)
    train = np.concatenate([total - gram, total[None]])
    mean, sd, corr, xy = _training_moments(train)
    y_mean, y_scale = means[0], scales[0] if scales[0] > 0 else 1.0
    x_mean, x_scale = means[1:], np.where(scales[1:] > 0, scales[1:], 1.0)

    candidates = [(a, h) for a in alphas for h in range(len(usable))]
    penalty = np.array([np.where(usable[h], a / y_scale, np.inf) for a, h in candidates])
    if by_path:
        w = _path_weights(corr, xy, usable, [a / y_scale for a in alphas])
    else:
        tile = lambda m: np.tile(m, (len(candidates),) + (1,) * (m.ndim - 1))
        w = lasso(tile(corr), tile(xy), np.repeat(penalty, folds + 1, axis=0))
    w = w.reshape(len(candidates), folds + 1, -1) / sd
    base = mean[:, 1] - np.einsum("cfp,fp->cf", w, mean[:, 2:])

    # Residual as weights on (one, target, features): its square is a quadratic form.
    residual = np.concatenate(
        [base[:, :folds, None], np.full((len(candidates), folds, 1), -1.0), w[:, :folds]], axis=2
    )
    sse = np.einsum("cfi,fij,cfj->cf", residual, gram, residual)
    with np.errstate(divide="ignore", invalid="ignore"):
        sst = gram[:, 1, 1] - gram[:, 0, 1] ** 2 / gram[:, 0, 0]
        r2 = np.where(sst > 1e-12, 1.0 - sse / sst, np.nan)

    coefs = y_scale * w[:, folds] / x_scale
    intercepts = y_mean + y_scale * base[:, folds] - coefs @ x_mean
    return [
        {
            "alpha": a,
            "harmonics": h,
            "fold_r2": [float(v) for v in r2[i]],
            "r2": float(np.mean(r2[i])),
            "intercept": float(intercepts[i]),
            "coefs": coefs[i],
        }
        for i, (a, h) in enumerate(candidates)
    ]


def coef_name(feature: str) -> str:
    return f"coef_{feature}"


def fit_candidates(
    products: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    *,
    alphas: Sequence[float] = ALPHAS,
    max_harmonics: int = HARMONICS[-1],
    folds: int = 5,
    by_path: bool = False,
) -> DataFrame:
    """Every (alpha, harmonics) candidate of every market: score, intercept, coefficients.

    ``by_path`` reads all alphas off one exact path per market, fold and harmonics, so their number costs nothing.

    ``products`` comes from ``cross_products`` over (target, features, seasonal terms).
    Tasks see one small matrix per fold, never training rows. ``r2`` is the unweighted mean
    over folds, NULL if a fold has no spread to explain, if a market has too few rows for all ``folds``, or
    if a solution could not be found.
    """
    keys = list(keys)
    terms = [ONE, "target", *features, *harmonic_names(max_harmonics)]
    usable = [
        [t in {*features, *harmonic_names(h)} for t in terms[2:]] for h in range(max_harmonics + 1)
    ]
    coef_columns = [coef_name(t) for t in terms[2:]]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = np.stack(
            [part.set_index("term").loc[terms, terms].to_numpy(float) for _, part in pdf.groupby("fold")]
        )
        by_term = pdf.drop_duplicates("term").set_index("term").loc[terms[1:]]
        means, scales = by_term["mean"].to_numpy(float), by_term["scale"].to_numpy(float)
        out = pd.DataFrame(grid_search(gram, means, scales, np.array(usable), alphas, by_path))
        if len(gram) < folds:
            out["r2"] = np.nan
        coefs = pd.DataFrame(np.stack(out.pop("coefs")), columns=coef_columns)
        key_values = pd.DataFrame({k: [pdf[k].iloc[0]] * len(out) for k in keys})
        return pd.concat([key_values, out, coefs], axis=1)

    key_types = ", ".join(f"{k} {products.schema[k].dataType.simpleString()}" for k in keys)
    schema = (
        f"{key_types}, alpha double, harmonics int, fold_r2 array<double>, r2 double, "
        f"intercept double, " + ", ".join(f"{c} double" for c in coef_columns)
    )
    # The solver's work is not in its bytes: spread the markets by number, not by size.
    fitted = products.repartition(SPREAD, *keys).groupBy(*keys).applyInPandas(fit, schema)
    return fitted.withColumn("r2", F.when(~F.isnan("r2"), F.col("r2")))


def best_candidates(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest score per market; ties go to the first in grid order (alpha, then harmonics)."""
    order = [F.round("r2", 12).desc_nulls_last(), F.col("alpha"), F.col("harmonics")]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return candidates.withColumn("__place", place).filter("__place = 1").drop("__place")


def path_breakpoints(products: DataFrame, features: Sequence[str], keys: Sequence[str], *, max_harmonics: int = HARMONICS[-1]) -> DataFrame:
    """The whole path of every market and number of harmonics on all its rows, as plain rows.

    One row per breakpoint, ``step`` counting from 0 at the alpha from which on all weights are zero; intercept and
    coefficients are linear in alpha in between. The last row's alpha is 0.
    """
    keys = list(keys)
    terms = [ONE, "target", *features, *harmonic_names(max_harmonics)]
    usable = [[t in {*features, *harmonic_names(h)} for t in terms[2:]] for h in range(max_harmonics + 1)]
    coef_columns = [coef_name(t) for t in terms[2:]]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = np.stack([part.set_index("term").loc[terms, terms].to_numpy(float) for _, part in pdf.groupby("fold")])
        by_term = pdf.drop_duplicates("term").set_index("term").loc[terms[1:]]
        means, scales = by_term["mean"].to_numpy(float), by_term["scale"].to_numpy(float)
        y_scale = scales[0] if scales[0] > 0 else 1.0
        mean, sd, corr, xy = _training_moments(gram.sum(axis=0)[None])
        parts = []
        for h, shut in enumerate(usable):
            knots, weights = lasso_path(corr[0], xy[0], np.array(shut))
            w = weights / sd
            coefs = y_scale * w / np.where(scales[1:] > 0, scales[1:], 1.0)
            out = pd.DataFrame(coefs, columns=coef_columns)
            out.insert(0, "intercept", means[0] + y_scale * (mean[0, 1] - w @ mean[0, 2:]) - coefs @ means[1:])
            out.insert(0, "alpha", knots * y_scale)
            out.insert(0, "step", np.arange(len(knots)))
            out.insert(0, "harmonics", h)
            parts.append(out)
        found = pd.concat(parts, ignore_index=True)
        return pd.concat([pd.DataFrame({k: [pdf[k].iloc[0]] * len(found) for k in keys}), found], axis=1)

    key_types = ", ".join(f"{k} {products.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{key_types}, harmonics int, step int, alpha double, intercept double, " + ", ".join(f"{c} double" for c in coef_columns)
    return products.repartition(SPREAD, *keys).groupBy(*keys).applyInPandas(fit, schema)
