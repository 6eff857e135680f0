"""The whole lasso path of a linear model from its cross-products."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# Workers get this module's functions with the task and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lasso_path(corr: np.ndarray, xy: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers of w'Rw/2 - r'w + penalty * sum(|w|) for every penalty: the breakpoints, falling from the first
    at which a weight joins to 0, and the weights there. In between weights are linear, above the first zero.

    ``corr`` has a unit diagonal where a feature varies and zeros where it doesn't; ``usable`` shuts features out.
    As the penalty falls, active weights move along a fixed direction until the next feature's pull reaches
    the penalty and it joins, or a weight reaches zero and leaves. At each breakpoint the weights are solved for
    anew, so errors don't add up. Features that depend on the active ones to the last digits can't join while these
    are active: their pull is the active ones' own. The result ends early, at the penalty reached, only if events of one
    penalty don't come to an end; weights below it are NaN.
    """
    p = len(xy)
    usable = usable & (np.diag(corr) > 0.5)
    pull = np.where(usable, xy, 0.0)
    penalty = float(np.abs(pull).max(initial=0.0))
    if penalty == 0.0:
        return np.zeros(1), np.zeros((1, p))
    tiny = 1e-12 * penalty
    active: list[int] = []
    sign = np.zeros(p)
    knots, weights = [penalty], [np.zeros(p)]
    joins, leaves, still = int(np.argmax(np.abs(pull))), -1, 0
    while True:
        if joins >= 0:
            sign[joins] = np.sign(pull[joins])
            active.append(joins)
        if leaves >= 0:
            active.remove(leaves)
            sign[leaves] = 0.0
        way = np.zeros(p)
        if active:
            a = np.array(active)
            way[a] = np.linalg.solve(corr[np.ix_(a, a)], sign[a])
        turn = corr @ way
        w = weights[-1]
        steps = []  # (length, feature, joins?)
        for j in np.flatnonzero(usable):
            if sign[j]:
                # A feature that has just joined moves with its sign; rounding apart, it can't leave at once.
                if j != joins and way[j] * sign[j] < 0:
                    steps.append((max(0.0, -w[j] / way[j]), j, False))
                continue
            for s in (1.0, -1.0):
                closing = 1.0 - s * turn[j]
                gap = penalty - s * pull[j]
                if j == leaves and gap <= 1e3 * tiny:  # it leaves this bound now; it may meet the other one
                    continue
                if closing > 1e-11 and _independent(corr, active, j):
                    steps.append((max(0.0, gap / closing), j, True))
        step, feature, in_ = min(steps, default=(penalty, -1, False))
        last = step >= penalty - tiny
        penalty = 0.0 if last else penalty - step
        w = np.zeros(p)
        if active:
            w[a] = np.linalg.solve(corr[np.ix_(a, a)], xy[a] - penalty * sign[a])
        if not last and not in_:
            w[feature] = 0.0
        pull = np.where(usable, xy - corr @ w, 0.0)
        still = still + 1 if step <= tiny else 0
        if step <= tiny:
            knots[-1], weights[-1] = penalty, w
        else:
            knots.append(penalty)
            weights.append(w)
        if last:
            return np.array(knots), np.array(weights)
        if still > 4 * p:
            return np.array([*knots, 0.0]), np.array([*weights, np.full(p, np.nan)])
        joins, leaves = (feature, -1) if in_ else (-1, feature)


def _independent(corr: np.ndarray, active: list[int], j: int) -> bool:
    """Whether feature j has anything of its own beside the active ones."""
    if not active:
        return True
    a = np.array(active)
    return corr[j, j] - corr[j, a] @ np.linalg.solve(corr[np.ix_(a, a)], corr[a, j]) > 1e-11


def weights_at(knots: np.ndarray, weights: np.ndarray, penalty: float) -> np.ndarray:
    """The path's weights at any penalty."""
    if penalty >= knots[0]:
        return np.zeros(weights.shape[1])
    k = int(np.searchsorted(-knots, -penalty, "left"))  # knots[k] <= penalty < knots[k - 1]
    share = (knots[k - 1] - penalty) / (knots[k - 1] - knots[k])
    return weights[k] if share == 1.0 else weights[k - 1] + share * (weights[k] - weights[k - 1])
