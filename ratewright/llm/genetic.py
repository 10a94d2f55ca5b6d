"""A grouping genetic algorithm for one-dimensional bin packing.

An individual is a list of bins, a bin a list of item numbers. Crossover injects whole well-filled bins of one parent into
the other, removes the bins that would hold an item twice, and best-fits the displaced items; mutation dissolves the
emptiest bins and best-fits their items. Fitness is the mean squared fill, which prefers full bins beside empty ones.
"""

from __future__ import annotations

import random


class BestFit:
    """Open bins by the room they have left; the fullest bin that takes an item is found in a bit set of rooms."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms = 0
        self.bins: dict[int, list[list[int]]] = {}

    def open(self, items: list[int], room: int) -> None:
        self.bins.setdefault(room, []).append(items)
        self.rooms |= 1 << room

    def put(self, item: int, size: int) -> None:
        fitting = self.rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = self.bins[room]
            items = stack.pop()
            if not stack:
                self.rooms ^= 1 << room
            items.append(item)
        else:
            items, room = [item], self.capacity
        self.open(items, room - size)

    def all(self) -> list[list[int]]:
        return [items for stack in self.bins.values() for items in stack]


Packing = list[list[int]]


def best_fit(sizes: list[int], capacity: int, items: list[int], kept: Packing = ()) -> Packing:
    """`kept` bins, copied, with `items` added in the given order."""
    fit = BestFit(capacity)
    for bin_ in kept:
        fit.open(list(bin_), capacity - sum(sizes[i] for i in bin_))
    for item in items:
        fit.put(item, sizes[item])
    return fit.all()


def fill(bin_: list[int], sizes: list[int]) -> int:
    return sum(sizes[i] for i in bin_)


def fitness(packing: Packing, sizes: list[int], capacity: int) -> float:
    return sum((fill(b, sizes) / capacity) ** 2 for b in packing) / max(1, len(packing))


def crossover(
    into: Packing, other: Packing, sizes: list[int], capacity: int, chance: random.Random, full: float = 0.995
) -> Packing:
    wanted = [b for b in other if fill(b, sizes) >= full * capacity and chance.random() < 0.5]
    injected = {i for b in wanted for i in b}
    kept, displaced = list(wanted), []
    for b in into:
        if injected.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in injected]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(sizes, capacity, displaced, kept)


def mutate(packing: Packing, sizes: list[int], capacity: int, chance: random.Random, share: float = 0.05) -> Packing:
    """Dissolves the emptiest bins and as many others, and best-fits their items."""
    order = sorted(packing, key=lambda b: fill(b, sizes))
    n = max(1, int(len(order) * share))
    emptiest, rest = order[:n], order[n:]
    chosen = set(chance.sample(range(len(rest)), min(n, len(rest))))
    loose = [i for b in emptiest for i in b] + [i for k in chosen for i in rest[k]]
    chance.shuffle(loose)
    loose.sort(key=lambda i: -sizes[i])
    return best_fit(sizes, capacity, loose, [b for k, b in enumerate(rest) if k not in chosen])


def first_packings(sizes: list[int], capacity: int, n: int, chance: random.Random) -> list[Packing]:
    """Best-fit decreasing, and best-fit in slightly disturbed decreasing orders."""
    items = range(len(sizes))
    orders = [sorted(items, key=lambda i: -sizes[i])]
    orders += [sorted(items, key=lambda i: -sizes[i] * chance.uniform(0.8, 1.2)) for _ in range(n - 1)]
    return [best_fit(sizes, capacity, order) for order in orders]


def least_bins(sizes: list[int], capacity: int) -> int:
    return -(-sum(sizes) // capacity)


def evolve(
    population: list[Packing], sizes: list[int], capacity: int, generations: int, chance: random.Random
) -> list[Packing]:
    """The population after so many generations, best first. Stops early when no packing can have fewer bins."""
    rated = sorted(((len(p), -fitness(p, sizes, capacity), k, p) for k, p in enumerate(population)))
    least, count = least_bins(sizes, capacity), len(population)
    for _ in range(generations):
        if rated[0][0] <= least:
            break
        a, b = chance.sample(rated, 2) if len(rated) > 1 else (rated[0], rated[0])
        a, b = min(a, b), max(a, b)
        child = crossover(b[3], a[3], sizes, capacity, chance)
        if chance.random() < 0.5:
            child = mutate(child, sizes, capacity, chance)
        count += 1
        rated = sorted([*rated, (len(child), -fitness(child, sizes, capacity), count, child)])[: len(population)]
    return [p for *_, p in rated]
