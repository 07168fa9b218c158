"""Partition search under a node distribution, on one graph held in memory."""

from __future__ import annotations

import numpy as np

from .partition import Net, plogp, renumbered
from .soft import dense

TINY = 1e-12


def walk(net: Net) -> np.ndarray:
    a = dense(net)
    total = a.sum(axis=1, keepdims=True)
    return a / np.where(total > 0, total, 1.0)


def degree_pi(net: Net) -> np.ndarray:
    return np.array(net.degree) / (net.m2 or 1.0)


def ppr(net: Net, query: int, alpha: float = 0.15, iters: int = 200, tol: float = 1e-12) -> np.ndarray:
    p, start = walk(net), np.eye(net.n)[query]
    pi = start
    for _ in range(iters):
        new = alpha * start + (1 - alpha) * pi @ p
        if np.abs(new - pi).sum() < tol:
            return new
        pi = new
    return pi


def ppr_transition(net: Net, query: int, alpha: float = 0.15) -> np.ndarray:
    return (1 - alpha) * walk(net) + alpha * np.eye(net.n)[query][None, :]


def entropy(labels, pi: np.ndarray, p: np.ndarray) -> float:
    """H_pi: modules without volume don't count."""
    labels = np.array(renumbered(list(labels)))
    k = labels.max() + 1
    flow = pi[:, None] * p
    vol = np.bincount(labels, pi, k)
    out = np.bincount(labels, np.where(labels[:, None] != labels[None, :], flow, 0.0).sum(axis=1), k)
    s = np.bincount(labels, [plogp(x) for x in pi], k)
    ok = vol > 0
    return float(-(out[ok] * np.log2(vol[ok]) + s[ok] - vol[ok] * np.log2(vol[ok])).sum())


def search(net: Net, pi: np.ndarray, p: np.ndarray, k: int | None = None, starts: int = 6, passes: int = 30, seed: int = 0) -> list[int]:
    """Moves to neighbours' modules from random labels; the best of the starts.

    A move changes the volume and outflow of two modules, which are kept up to date.
    """
    n, flow = net.n, pi[:, None] * p
    flow = flow - np.diag(np.diag(flow))
    part = lambda v, f: plogp(v) - (f * np.log2(v) if v > 0 else 0.0)
    best: tuple[float, list[int]] = (np.inf, [])
    for start in range(starts):
        rng = np.random.default_rng(seed * 1000 + start)
        groups = max(2, k or int(n**0.5))
        labels = rng.integers(0, groups, n) if start % 2 == 0 else rng.permutation(np.arange(n) % groups)
        vol = np.bincount(labels, pi, groups)
        out = np.bincount(labels, np.where(labels[:, None] != labels[None, :], flow, 0.0).sum(axis=1), groups)
        for _ in range(passes):
            moved = False
            for u in rng.permutation(n).tolist():
                a = labels[u]
                to, back = np.bincount(labels, flow[u], groups), np.bincount(labels, flow[:, u], groups)
                leave = to.sum()
                va, fa = vol[a] - pi[u], out[a] - (leave - to[a]) + back[a]
                found = (-TINY, a, 0.0, 0.0)
                for b in sorted({int(labels[v]) for v in net.near[u]} - {int(a)}):
                    vb, fb = vol[b] + pi[u], out[b] + (leave - to[b]) - back[b]
                    change = part(va, fa) + part(vb, fb) - part(vol[a], out[a]) - part(vol[b], out[b])
                    found = min(found, (change, b, vb, fb))
                if found[1] != a:
                    vol[a], out[a] = max(va, 0.0), max(fa, 0.0)
                    _, b, vol[found[1]], out[found[1]] = found
                    labels[u] = b
                    moved = True
            if not moved:
                break
        value = entropy(labels, pi, p)
        if value < best[0] - TINY:
            best = (value, renumbered(labels.tolist()))
    return best[1]
