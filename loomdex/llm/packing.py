"""A grouping genetic algorithm for packing items into bins of one capacity."""

from __future__ import annotations

import random
from bisect import bisect_left, insort

#: Individuals of an island, and generations between two migrations.
INDIVIDUALS, GENERATIONS = 4, 6

Bins = list[list[int]]


def fitness(bins: Bins, sizes: list[int], capacity: int) -> float:
    """Mean square of the bins' fill: fewer and fuller bins score higher."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / len(bins) if bins else 0.0


def best_fit(bins: Bins, loads: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Puts each item where it leaves the least space, in the order given; opens a bin where none has room."""
    room = sorted((capacity - load, k) for k, load in enumerate(loads))
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
            loads[k] += sizes[i]
            if left > sizes[i]:
                insort(room, (left - sizes[i], k))
        else:
            bins.append([i])
            loads.append(sizes[i])
            if sizes[i] < capacity:
                insort(room, (capacity - sizes[i], len(bins) - 1))


def _new(order: list[int], sizes: list[int], capacity: int) -> Bins:
    bins: Bins = []
    best_fit(bins, [], order, sizes, capacity)
    return bins


def cross(a: Bins, b: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Injects well-filled bins of `b` whole into `a`, drops the bins of `a` that share an item with them and best-fits their other items."""
    full = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    injected = [list(x) for x in full[: max(1, len(full) // 2)] if rng.random() < 0.5]
    inside = {i for x in injected for i in x}
    kept = [list(x) for x in a if inside.isdisjoint(x)]
    displaced = sorted((i for x in a if not inside.isdisjoint(x) for i in x if i not in inside), key=lambda i: -sizes[i])
    child = injected + kept
    best_fit(child, [sum(sizes[i] for i in x) for x in child], displaced, sizes, capacity)
    return child


def mutate(a: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Breaks up the emptiest bin and a few others and best-fits their items."""
    order = sorted(range(len(a)), key=lambda k: sum(sizes[i] for i in a[k]))
    broken = {order[0], *rng.sample(order, min(len(order), 1 + len(order) // 20))}
    child = [list(x) for k, x in enumerate(a) if k not in broken]
    freed = [i for k in broken for i in a[k]]
    rng.shuffle(freed)
    freed.sort(key=lambda i: -sizes[i] * rng.uniform(0.8, 1.2))
    best_fit(child, [sum(sizes[i] for i in x) for x in child], freed, sizes, capacity)
    return child


def first_packing(sizes: list[int], capacity: int) -> Bins:
    """Best fit, falling by size: bins of item numbers. No item may exceed the capacity."""
    return _new(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, capacity)


def rank(bins: Bins, sizes: list[int], capacity: int) -> tuple[int, float]:
    """What evolution lowers: the number of bins, then the emptiness of the fullest."""
    return len(bins), -fitness(bins, sizes, capacity)


def best_possible(bins: Bins, sizes: list[int], capacity: int) -> bool:
    """Whether no packing ranks higher: all bins but one are full to the last unit."""
    return sum(sum(sizes[i] for i in b) < capacity for b in bins) < 2


def evolve(people: list[Bins], sizes: list[int], capacity: int, seed: int, generations: int = GENERATIONS) -> Bins:
    """One island's best packing after some generations, from the packings it has, own or immigrant, and random ones. Never ranks lower than those.

    Ends early only where no packing ranks higher.
    """
    rng = random.Random(seed)
    falling = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    people = [[list(b) for b in p] for p in people]
    while len(people) < INDIVIDUALS:
        people.append(_new(sorted(falling, key=lambda i: -sizes[i] * rng.uniform(0.7, 1.3)), sizes, capacity))
    island = sorted(((rank(p, sizes, capacity), k, p) for k, p in enumerate(people)), key=lambda x: x[:2])[:INDIVIDUALS]
    for g in range(generations):
        if best_possible(island[0][2], sizes, capacity):
            break
        a, b = rng.sample(island[: max(2, INDIVIDUALS // 2 + 1)], 2)
        for child in (cross(a[2], b[2], sizes, capacity, rng), mutate(a[2], sizes, capacity, rng)):
            island.append((rank(child, sizes, capacity), INDIVIDUALS + g, child))
        island.sort(key=lambda x: x[:2])
        del island[INDIVIDUALS:]
    return island[0][2]
