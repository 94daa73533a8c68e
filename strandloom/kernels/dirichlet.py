"""Dirichlet-multinomial fits and likelihood-ratio tests of isoform usage (one gene at a time)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .special import chi_square_tail, digamma, log_gamma, trigamma

FLOOR, ROUNDS, GRADIENT, ARMIJO = 1e-4, 40, 1e-5, 1e-4


@dataclass(frozen=True)
class UsageSettings:
    """Thresholds: ``rare`` share below which isoforms are gathered, least cells and total of a group."""

    epsilon: float = 0.01
    rare: float = 0.05
    min_cells: int = 20
    min_total: float = 20.0


def _value(alpha: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> float:
    whole = alpha.sum()
    return -float(np.sum(log_gamma(whole) - log_gamma(whole + totals)) + np.sum(log_gamma(alpha + counts) - log_gamma(alpha)))


def _slopes(alpha: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = alpha.sum()
    gradient = -(np.sum(digamma(whole) - digamma(whole + totals)) + np.sum(digamma(alpha + counts) - digamma(alpha), axis=0))
    hessian = np.full((len(alpha), len(alpha)), -np.sum(trigamma(whole) - trigamma(whole + totals)))
    hessian[np.diag_indices(len(alpha))] -= np.sum(trigamma(alpha + counts) - trigamma(alpha), axis=0)
    return gradient, hessian


def _descend(alpha: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Newton steps with halving; steepest descent where the Newton step does not descend or has none."""
    totals = counts.sum(axis=1)
    alpha = np.maximum(alpha, FLOOR)
    value = _value(alpha, counts, totals)
    for _ in range(ROUNDS):
        gradient, hessian = _slopes(alpha, counts, totals)
        if np.sqrt(gradient @ gradient) < GRADIENT:
            break
        try:
            step = np.linalg.solve(hessian, -gradient)
        except np.linalg.LinAlgError:
            step = -gradient
        if not np.isfinite(step).all() or gradient @ step >= 0:
            step = -gradient
        slope, scale = float(gradient @ step), 1.0
        while scale >= 1e-8:
            trial = np.maximum(alpha + scale * step, FLOOR)
            new = _value(trial, counts, totals)
            if new <= value + ARMIJO * scale * slope:
                alpha, value = trial, new
                break
            scale /= 2
        else:
            break
    return value, alpha


def fit(counts: np.ndarray) -> tuple[float, np.ndarray]:
    """(negative log likelihood, alpha): the better of a flat start and a start at the pooled shares."""
    shares = counts.sum(axis=0) / max(counts.sum(), 1e-300)
    fits = [_descend(start, counts) for start in (np.ones(counts.shape[1]), np.maximum(shares, FLOOR))]
    return min(fits, key=lambda f: f[0])


def ratio_test(left: np.ndarray, right: np.ndarray, df: int) -> tuple[float, tuple, tuple]:
    """p of one fit for both groups against a fit for each, and the two fits."""
    apart = fit(left), fit(right)
    stat = 2 * (fit(np.concatenate((left, right)))[0] - apart[0][0] - apart[1][0])
    return chi_square_tail(max(stat, 0.0) if np.isfinite(stat) else 0.0, df), *apart


def aligned(names: tuple[list[str], list[str]], counts: tuple[np.ndarray, np.ndarray], rare: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Both groups over the isoforms either uses at ``rare`` or more, the rest gathered as ``other``; all where none is."""
    every = list(dict.fromkeys(names[0] + names[1]))
    wide = []
    for own, x in zip(names, counts, strict=True):
        at = {n: k for k, n in enumerate(own)}
        wide.append(np.stack([x[:, at[n]] if n in at else np.zeros(len(x)) for n in every], axis=1) if every else np.zeros((len(x), 0)))
    share = [x.sum(axis=0) / x.sum() if x.sum() else np.zeros(len(every)) for x in wide]
    keep = np.maximum(*share) >= rare
    if not keep.any():
        return every, *wide
    rest = [x[:, ~keep].sum(axis=1, keepdims=True) for x in wide]
    kept = [n for n, k in zip(every, keep, strict=True) if k]
    if any(r.any() for r in rest):
        return [*kept, "other"], *(np.concatenate((x[:, keep], r), axis=1) for x, r in zip(wide, rest, strict=True))
    return kept, *(x[:, keep] for x in wide)


def switched(names: list[str], first: np.ndarray, second: np.ndarray) -> tuple[bool, float]:
    """Whether the groups' most used isoforms differ (``other`` aside), and the size of the change."""
    real = np.array([n != "other" for n in names])
    if not real.any():
        return False, 0.0
    top = np.flatnonzero(real & ((first == first[real].max()) | (second == second[real].max())))
    change = first - second
    if len(top) == 1:
        return False, abs(float(change[top[0]]))
    return True, abs(float(change[top[0]] - change[top[1]]))


def usage_test(names: tuple[list[str], list[str]], counts: tuple[np.ndarray, np.ndarray], cells: tuple[int, int], settings: UsageSettings) -> list[dict] | None:
    """The rows of one gene (one an isoform), or none where the groups are too small to test.

    The degrees of freedom are the number of columns, for the gene and for each isoform against
    the rest alike; with two columns or fewer an isoform has the gene's p.
    """
    if min(cells) < settings.min_cells:
        return None
    isoforms, left, right = aligned(names, counts, settings.rare)
    if not isoforms or min(left.sum(), right.sum()) < settings.min_total or not left.sum() or not right.sum():
        return None
    left, right = (x[x.sum(axis=1) > 0] for x in (left, right))
    k = len(isoforms)
    p_gene, (_, a), (_, b) = ratio_test(left, right, k)
    against_rest = lambda x, c: np.stack((x[:, c], x.sum(axis=1) - x[:, c]), axis=1)
    p = [ratio_test(against_rest(left, c), against_rest(right, c), k)[0] for c in range(k)] if k > 2 else [p_gene] * k
    use_a, use_b = a / a.sum(), b / b.sum()
    switch, effect = switched(isoforms, use_a, use_b)
    return [
        {
            "isoform": name, "alpha1": a[i], "alpha2": b[i], "TU1": use_a[i], "TU2": use_b[i], "TU_diff": abs(use_a[i] - use_b[i]),
            "TU_var1": use_a[i] * (1 - use_a[i]) / (1 + a.sum()), "TU_var2": use_b[i] * (1 - use_b[i]) / (1 + b.sum()),
            "dispersion1": 1 / (1 + a.sum()), "dispersion2": 1 / (1 + b.sum()),
            "isoform_switch": switch, "isoform_switch_ES": effect, "p_DTU_gene": p_gene, "p_transcript": p[i],
        }
        for i, name in enumerate(isoforms)
    ]
