"""The cube method of balanced sampling: the flight through the constraints' null-space, and a landing for the few units left."""

from __future__ import annotations

import random
from bisect import bisect_left
from itertools import product

EPS = 1e-9


def flight(sizes: list[float], chances: list[float], rng: random.Random) -> list[float]:
    """Chances after the flight, all 0 or 1 but at most two of them.

    At every step three undecided units move along the vector that changes neither the expected number of units nor their expected total
    size, one way or the other at random so that no chance changes in expectation, until one of them is decided.
    """
    p = list(chances)
    waiting = [i for i in range(len(p) - 1, -1, -1) if EPS < p[i] < 1 - EPS]
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) == 3:
            i, j, k = active
            u = [sizes[k] - sizes[j], sizes[i] - sizes[k], sizes[j] - sizes[i]]
            if not any(u):
                u = [1.0, -1.0, 0.0]
        elif len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
            u = [1.0, -1.0]
        else:
            break
        forth = min((1 - p[a]) / x if x > 0 else p[a] / -x for a, x in zip(active, u, strict=True) if x)
        back = min(p[a] / x if x > 0 else (1 - p[a]) / -x for a, x in zip(active, u, strict=True) if x)
        step = forth if rng.random() * (forth + back) < back else -back
        for a, x in zip(active, u, strict=True):
            p[a] += step * x
            if p[a] <= EPS or p[a] >= 1 - EPS:
                p[a] = float(p[a] > 0.5)
        active = [a for a in active if 0 < p[a] < 1]
    return p


def landing(sizes: list[float], before: list[float], chances: list[float]) -> list[float]:
    """Decides the units that the flight left, a handful, and then swaps one chosen unit for another where that brings the total size closer
    to the expected one, which is that of the chances `before` the flight. The number of units keeps within one of the expected."""
    open_ = [i for i, x in enumerate(chances) if EPS < x < 1 - EPS]
    out = [float(x > 0.5) for x in chances]
    want = sum(s * x for s, x in zip(sizes, before, strict=True))
    count = sum(before)

    def off(choice: tuple[float, ...]) -> tuple[float, float]:
        for i, s in zip(open_, choice, strict=True):
            out[i] = s
        return abs(sum(s * x for s, x in zip(sizes, out, strict=True)) - want), abs(sum(out) - count)

    choices = list(product((0.0, 1.0), repeat=len(open_)))
    near = [c for c in choices if off(c)[1] < 1 + EPS] or choices
    off(min(near, key=lambda c: (off(c), c)))
    missing = want - sum(s * x for s, x in zip(sizes, out, strict=True))
    inside = sorted((sizes[i], i) for i, x in enumerate(out) if x)
    best, pair = abs(missing), None
    for j in (j for j, x in enumerate(out) if not x):
        at = bisect_left(inside, (sizes[j] - missing, -1))
        for size, i in inside[max(0, at - 1) : at + 1]:
            if abs(missing - (sizes[j] - size)) < best - EPS:
                best, pair = abs(missing - (sizes[j] - size)), (i, j)
    if pair:
        out[pair[0]], out[pair[1]] = 0.0, 1.0
    return out
