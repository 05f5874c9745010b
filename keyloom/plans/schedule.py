"""Packing of partitions into resident batches: a driver-side task over a handful of partition sizes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

CAPACITY = 5


@dataclass(frozen=True)
class Item:
    id: int
    weight: int
    gain: float


def knapsack(items: Sequence[Item], capacity: int = CAPACITY) -> list[Item]:
    """The subset of largest gain within the capacity; ties go to fewer, then earlier items. Items that never fit stay out."""
    best: list[tuple[float, int, tuple[int, ...]]] = [(0.0, 0, ())] * (capacity + 1)
    for i, it in enumerate(items):
        if it.weight < 1:
            raise ValueError("weights are positive")
        for c in range(capacity, it.weight - 1, -1):
            gain, n, chosen = best[c - it.weight]
            cand = (gain + it.gain, n - 1, (*chosen, i))
            if (cand[0], cand[1]) > (best[c][0] + 1e-9, -(10**9)) or (abs(cand[0] - best[c][0]) <= 1e-9 and cand[1] > best[c][1]):
                best[c] = cand
    return [items[i] for i in best[capacity][2]]


def pack_optimal(items: Sequence[Item], capacity: int = CAPACITY) -> list[list[Item]]:
    """Batches by repeated knapsacks, heaviest item first within a batch. An item above the capacity gets a batch of its own."""
    rest, out = [i for i in items if i.weight <= capacity], [[i] for i in items if i.weight > capacity]
    while rest:
        chosen = knapsack(rest, capacity)
        if not chosen:  # only items without gain are left
            chosen = [rest[0]]
        out.append(sorted(chosen, key=lambda i: (-i.weight, i.id)))
        gone = {i.id for i in chosen}
        rest = [i for i in rest if i.id not in gone]
    return out


def pack_pairs(items: Sequence[Item], capacity: int = CAPACITY) -> list[list[Item]]:
    """One knapsack batch, then each item of weight 2 with as many of weight 1 as fit, then the rest of weight 1 together."""
    if any(i.weight not in (1, 2) for i in items):
        raise ValueError("weights are 1 or 2")
    first = knapsack(items, capacity)
    out = [sorted(first, key=lambda i: (-i.weight, i.id))] if first else []
    gone = {i.id for i in first}
    heavy = [i for i in items if i.weight == 2 and i.id not in gone]
    light = [i for i in items if i.weight == 1 and i.id not in gone]
    for h in heavy:
        take, light = light[: capacity - 2], light[capacity - 2 :]
        out.append([h, *take])
    out += [light[k : k + capacity] for k in range(0, len(light), capacity)]
    return out


def batches_for(counts: dict[int, int], unit: int, capacity: int = CAPACITY) -> list[list[Item]]:
    """Partition row counts as items: weight 1 up to `unit` rows, 2 beyond; the gain is the share of rows."""
    total = sum(counts.values()) or 1
    return pack_pairs([Item(p, 1 if n <= unit else 2, n / total) for p, n in sorted(counts.items())], capacity)
