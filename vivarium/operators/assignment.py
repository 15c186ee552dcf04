"""Matching of two small sets at the least summed cost."""

from __future__ import annotations

import math

import numpy as np


def least_cost(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`matched` of an array, as arrays."""
    rows, columns = matched(np.asarray(cost, float).tolist())
    return np.array(rows, int), np.array(columns, int)


def matched(cost: list[list[float]]) -> tuple[list[int], list[int]]:
    """(rows, columns), rows in order, of the matching of all of the smaller side with the least summed cost.

    Rows are matched one after the other, each along the shortest alternating path by reduced costs, so the work is at most
    rows squared times columns. Costs must be finite. Plain numbers: for a few rows, calls on arrays take most of the time.
    """
    n, m = len(cost), len(cost[0]) if cost else 0
    if n > m:
        columns, rows = matched([list(c) for c in zip(*cost)])
        pairs = sorted(zip(rows, columns))
        return [r for r, _ in pairs], [c for _, c in pairs]
    row_price, column_price = [0.0] * n, [0.0] * m
    owner = [-1] * m  # the row of each column
    for start in range(n):
        distance, before = [math.inf] * m, [-1] * m
        closed: list[int] = []
        left = list(range(m))
        row, length, last = start, 0.0, -1
        reached = [(start, 0.0)]
        while True:
            costs, price = cost[row], row_price[row]
            for c in left:
                step = length + costs[c] - price - column_price[c]
                if step < distance[c]:
                    distance[c], before[c] = step, last
            last = min(left, key=distance.__getitem__)
            length = distance[last]
            left.remove(last)
            closed.append(last)
            if owner[last] < 0:
                break
            row = owner[last]
            reached.append((row, length))
        for row, at in reached:
            row_price[row] += length - at
        for c in closed:
            column_price[c] -= length - distance[c]
        while last >= 0:  # turn the path
            came = before[last]
            owner[last] = owner[came] if came >= 0 else start
            last = came
    pairs = sorted((r, c) for c, r in enumerate(owner) if r >= 0)
    return [r for r, _ in pairs], [c for _, c in pairs]
