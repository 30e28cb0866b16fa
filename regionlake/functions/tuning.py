"""Driver loops of the tuners: searches over a few settings that call a measurement; no data passes here."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def coordinate_descent(measure: Callable[[tuple[int, ...]], float], start: tuple[int, ...], bounds: list[tuple[int, int]], rounds: int = 50) -> tuple[tuple[int, ...], float]:
    """The setting with the highest score that single steps along one setting after another reach.

    bounds: least and largest value of each setting. Ends when no step of any setting is better.
    """
    best, top = tuple(start), measure(tuple(start))
    for _ in range(rounds):
        before = best
        for k, (lo, hi) in enumerate(bounds):
            for step in (1, -1):
                while lo <= best[k] + step <= hi:
                    trial = (*best[:k], best[k] + step, *best[k + 1 :])
                    score = measure(trial)
                    if score <= top:
                        break
                    best, top = trial, score
        if best == before:
            break
    return best, top


def simplex(cost: Callable[[np.ndarray], float], points: np.ndarray, lo: np.ndarray, hi: np.ndarray, steps: int = 200, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Nelder-Mead on a box: reflect, expand, contract, shrink; points are clipped to lo and hi."""
    x = np.clip(np.asarray(points, float), lo, hi)
    y = np.array([cost(p) for p in x])
    for _ in range(steps):
        order = np.argsort(y, kind="stable")
        x, y = x[order], y[order]
        if y[-1] - y[0] <= tolerance and np.abs(x - x[0]).max() <= tolerance:
            break
        middle = x[:-1].mean(0)
        at = lambda t: np.clip(middle + t * (x[-1] - middle), lo, hi)  # noqa: B023, E731
        mirrored = at(-1.0)
        value = cost(mirrored)
        if value < y[0]:
            farther = at(-2.0)
            beyond = cost(farther)
            x[-1], y[-1] = (farther, beyond) if beyond < value else (mirrored, value)
        elif value < y[-2]:
            x[-1], y[-1] = mirrored, value
        else:
            nearer = at(-0.5) if value < y[-1] else at(0.5)
            inside = cost(nearer)
            if inside < min(value, y[-1]):
                x[-1], y[-1] = nearer, inside
            else:
                x[1:] = x[0] + 0.5 * (x[1:] - x[0])
                y[1:] = [cost(p) for p in x[1:]]
    k = int(np.argmin(y))
    return x[k], float(y[k])
