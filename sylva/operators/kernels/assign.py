"""Largest total of a one-to-one matching of rows and columns."""

from __future__ import annotations

import numpy as np


def best_matching(gain: np.ndarray) -> float:
    """The sum over the best matching, by shortest augmenting paths with potentials."""
    cost = -np.asarray(gain, float)
    if cost.shape[0] > cost.shape[1]:
        cost = cost.T
    rows, columns = cost.shape
    row_price, column_price = np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1)
    for start in range(rows):
        reach = np.full(columns, np.inf)
        came_from = np.full(columns, -1)
        closed = np.zeros(columns, bool)
        row, column = start, -1
        while True:
            slack = cost[row] - row_price[row] - column_price + (0 if column < 0 else reach[column])
            better = ~closed & (slack < reach)
            reach[better], came_from[better] = slack[better], column
            column = int(np.argmin(np.where(closed, np.inf, reach)))
            closed[column] = True
            if owner[column] < 0:
                break
            row = owner[column]
        final = reach[column]
        done = closed & (reach < final)
        row_price[start] += final
        for j in np.flatnonzero(done):
            row_price[owner[j]] += final - reach[j]
            column_price[j] -= final - reach[j]
        while column >= 0:
            before = came_from[column]
            owner[column] = start if before < 0 else owner[before]
            column = before
    used = np.flatnonzero(owner >= 0)
    return float(-cost[owner[used], used].sum())
