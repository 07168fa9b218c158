"""Tabular exploration of the four rooms with count and community bonuses."""

from __future__ import annotations

import numpy as np

from ...sources.generators import free_cells, room_step
from . import partition as P


def explore(bonus: str, episodes: int = 60, seed: int = 0, beta: float = 0.05, recluster: int = 500, steps: int = 200, cluster: str = "entropy") -> tuple[int, int, int]:
    """(first episode solved or -1, episodes solved, cells seen) of Q-learning.

    ``bonus``: none; count, beta over the root of the cell's visits; se, that and the same for the visits of its
    community in the graph of steps so far, found anew every ``recluster`` steps. Counts carry over.
    """
    rng, cells = np.random.default_rng(seed), free_cells()
    number = {c: i for i, c in enumerate(cells)}
    value = np.zeros((len(cells), 4))
    visits, labels = np.zeros(len(cells)), np.arange(len(cells))
    seen: dict[tuple[int, int], float] = {}
    first, solved, total = -1, 0, 0
    for episode in range(episodes):
        state = (0, 0)
        for _ in range(steps):
            s = number[state]
            action = int(rng.integers(4)) if rng.random() < 0.1 else int(rng.choice(np.flatnonzero(value[s] == value[s].max())))
            state, reward, done = room_step(state, action)
            t = number[state]
            visits[t] += 1
            total += 1
            if s != t:
                seen[min(s, t), max(s, t)] = seen.get((min(s, t), max(s, t)), 0.0) + 1.0
            if bonus == "se" and total % recluster == 0:
                labels = np.array(P.multilevel(P.Net(len(cells), ((u, v, w) for (u, v), w in seen.items())), cluster, seed))
            extra = 0.0 if bonus == "none" else beta / np.sqrt(visits[t])
            if bonus == "se":
                extra += beta / np.sqrt(visits[labels == labels[t]].sum())
            value[s, action] += 0.5 * (reward + extra + (0.0 if done else 0.95 * value[t].max()) - value[s, action])
            if done:
                solved += 1
                first = episode if first < 0 else first
                break
    return first, solved, int((visits > 0).sum())
