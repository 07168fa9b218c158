"""Sequential partition search on one graph held in memory.

A partition's objective is a sum over modules of a function of their volume and
cut, plus a function of the total cut, so that one search serves structural entropy, modularity
and the map equation. All are minimised.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from math import log2

import numpy as np

TINY = 1e-12


class Net:
    """Vertices 0..n-1, neighbours as dicts without self-loops, loop weights and degrees."""

    def __init__(self, n: int, edges):
        self.n = n
        self.near: list[dict[int, float]] = [{} for _ in range(n)]
        self.loop = [0.0] * n
        for u, v, w in edges:
            if u == v:
                self.loop[u] += w
            else:
                self.near[u][v] = self.near[u].get(v, 0.0) + w
                self.near[v][u] = self.near[v].get(u, 0.0) + w
        self.degree = [sum(a.values()) + 2 * s for a, s in zip(self.near, self.loop)]
        self.m2 = sum(self.degree)

    def edges(self):
        for u, a in enumerate(self.near):
            if self.loop[u]:
                yield u, u, self.loop[u]
            for v, w in a.items():
                if u < v:
                    yield u, v, w

    def contracted(self, labels: list[int]) -> Net:
        return Net(max(labels, default=-1) + 1, ((labels[u], labels[v], w) for u, v, w in self.edges()))

    def induced(self, members: list[int]) -> Net:
        at = {v: i for i, v in enumerate(members)}
        return Net(len(members), ((at[u], at[v], w) for u in members for v, w in [*self.near[u].items(), (u, self.loop[u])] if v in at and (u < v or u == v and w)))


def plogp(x: float) -> float:
    return x * log2(x) if x > 0 else 0.0


def entropy_part(v: float, g: float, m2: float) -> float:
    return (plogp(v) - (g * log2(v / m2) if g > 0 and v > 0 else 0.0)) / m2


def modularity_part(v: float, g: float, m2: float) -> float:
    return (v / m2) ** 2 - (v - g) / m2


def map_part(v: float, g: float, m2: float) -> float:
    return plogp((g + v) / m2) - 2 * plogp(g / m2)


def entropy_of(m2: float):
    """``entropy_part`` for one graph, with one logarithm."""
    if not m2:
        return lambda v, g: 0.0
    base, over = log2(m2), 1.0 / m2

    def part(v: float, g: float) -> float:
        if v <= 0:
            return 0.0
        x = log2(v)
        return (v * x - g * (x - base)) * over

    return part


#: name: (a module's part, what the total cut adds)
OBJECTIVES = {
    "entropy": (entropy_part, None),
    "modularity": (modularity_part, None),
    "map": (map_part, lambda q, m2: plogp(q / m2)),
}


class Partition:
    """Labels with the volume, cut and size of each module, kept up to date by moves."""

    def __init__(self, net: Net, labels: list[int], objective: str = "entropy"):
        self.net, self.labels = net, list(labels)
        whole, self.overall = OBJECTIVES[objective]
        self.part = entropy_of(net.m2) if objective == "entropy" else lambda v, g: whole(v, g, net.m2)
        self.volume: dict[int, float] = {}
        self.cut: dict[int, float] = {}
        self.size: dict[int, int] = {}
        for u, c in enumerate(self.labels):
            self.volume[c] = self.volume.get(c, 0.0) + net.degree[u]
            self.size[c] = self.size.get(c, 0) + 1
            self.cut[c] = self.cut.get(c, 0.0) + sum(w for v, w in net.near[u].items() if self.labels[v] != c)
        self.outside = sum(self.cut.values())
        self.parts = {c: self.part(v, self.cut[c]) for c, v in self.volume.items()} if net.m2 else dict.fromkeys(self.volume, 0.0)
        self.next = max(self.labels, default=-1) + 1

    def value(self) -> float:
        m2 = self.net.m2
        if not m2:
            return 0.0
        total = sum(self.part(v, self.cut[c]) for c, v in self.volume.items())
        return total + (self.overall(self.outside, m2) if self.overall else 0.0)

    def toward(self, u: int) -> dict[int, float]:
        out: dict[int, float] = {}
        for v, w in self.net.near[u].items():
            c = self.labels[v]
            out[c] = out.get(c, 0.0) + w
        return out

    def changes(self, u: int, targets, weights: dict[int, float]):
        """(change, module) of moving u to each target."""
        net, part, parts, volume, cut, overall = self.net, self.part, self.parts, self.volume, self.cut, self.overall
        a, d = self.labels[u], net.degree[u]
        leaves = d - 2 * net.loop[u]
        ga2 = cut[a] - leaves + 2 * weights.get(a, 0.0)
        base = part(volume[a] - d, ga2 if ga2 > 0 else 0.0) - parts[a]
        more = self.outside + ga2 - cut[a]
        was = overall(self.outside, net.m2) if overall else 0.0
        for b in targets:
            if b == a:
                continue
            gb = cut.get(b, 0.0)
            gb2 = gb + leaves - 2 * weights.get(b, 0.0)
            change = base + part(volume.get(b, 0.0) + d, gb2 if gb2 > 0 else 0.0) - parts.get(b, 0.0)
            if overall:
                change += overall(more + gb2 - gb, net.m2) - was
            yield change, b

    def move(self, u: int, b: int, weights: dict[int, float]) -> None:
        a, d = self.labels[u], self.net.degree[u]
        leaves = d - 2 * self.net.loop[u]
        lost, gained = 2 * weights.get(a, 0.0) - leaves, leaves - 2 * weights.get(b, 0.0)
        self.volume[a] -= d
        self.cut[a] += lost
        self.size[a] -= 1
        self.volume[b] = self.volume.get(b, 0.0) + d
        self.cut[b] = self.cut.get(b, 0.0) + gained
        self.size[b] = self.size.get(b, 0) + 1
        self.outside += lost + gained
        self.parts[a], self.parts[b] = self.part(self.volume[a], max(self.cut[a], 0.0)), self.part(self.volume[b], max(self.cut[b], 0.0))
        if not self.size[a]:
            del self.volume[a], self.cut[a], self.size[a], self.parts[a]
        self.labels[u] = b
        self.next = max(self.next, b + 1)


def renumbered(labels) -> list[int]:
    """Labels from 0 in order of first appearance."""
    seen: dict = {}
    return [seen.setdefault(c, len(seen)) for c in labels]


def local_moves(state: Partition, rng: np.random.Generator, passes: int = 30, fixed_k: bool = False) -> bool:
    """Move vertices one by one in shuffled order while any move improves; whether one did.

    Candidates are the modules next to a vertex and a fresh one or, with
    ``fixed_k``, all modules, none of which is emptied.
    """
    moved = False
    for _ in range(passes):
        any_move = False
        for u in rng.permutation(state.net.n).tolist():
            if not state.net.degree[u] or fixed_k and state.size[state.labels[u]] == 1:
                continue
            weights = state.toward(u)
            targets = list(state.volume) if fixed_k else [*weights, *([state.next] if state.size[state.labels[u]] > 1 else [])]
            change, b = min(state.changes(u, targets, weights), default=(0.0, -1))
            if change < -TINY:
                state.move(u, b, weights)
                any_move = True
        if not any_move:
            break
        moved = True
    return moved


def multilevel(net: Net, objective: str = "entropy", seed: int = 0, levels: int = 20, start: list[int] | None = None) -> list[int]:
    """Local moves from singletons, contraction, and again, until nothing coarsens."""
    rng = np.random.default_rng(seed)
    labels = renumbered(start) if start else list(range(net.n))
    if not net.m2:
        return [0] * net.n
    state = Partition(net, labels, objective)
    local_moves(state, rng)
    labels = renumbered(state.labels)
    for _ in range(levels):
        upper = net.contracted(labels)
        state = Partition(upper, list(range(upper.n)), objective)
        local_moves(state, rng)
        above = renumbered(state.labels)
        if max(above) + 1 == upper.n:
            break
        labels = renumbered([above[c] for c in labels])
    return labels


def polished(net: Net, labels: list[int], objective: str = "entropy", seed: int = 0, rounds: int = 5) -> list[int]:
    """Multilevel search from ``labels``, vertices first, again while it improves."""
    value = Partition(net, labels, objective).value()
    for r in range(rounds):
        again = multilevel(net, objective, seed + r, start=labels)
        now = Partition(net, again, objective).value()
        if now >= value - TINY:
            break
        labels, value = again, now
    return labels


def connected_parts(net: Net, labels: list[int]) -> list[int]:
    """Labels with each module split into its connected components."""
    out, fresh = [-1] * net.n, 0
    for s in range(net.n):
        if out[s] >= 0:
            continue
        out[s], stack = fresh, [s]
        while stack:
            u = stack.pop()
            for v in net.near[u]:
                if out[v] < 0 and labels[v] == labels[s]:
                    out[v] = fresh
                    stack.append(v)
        fresh += 1
    return out


def iterated(net: Net, objective: str, seed: int, rounds: int = 10) -> list[int]:
    """Multilevel search repeated from its own result, modules split where they aren't connected."""
    labels = multilevel(net, objective, seed)
    value = Partition(net, labels, objective).value()
    for r in range(1, rounds):
        again = multilevel(net, objective, seed + r, start=connected_parts(net, labels))
        now = Partition(net, again, objective).value()
        if now >= value - TINY:
            break
        labels, value = again, now
    return renumbered(connected_parts(net, labels))


def entropy(net: Net, labels: list[int]) -> float:
    """H2 of a partition: the modules' parts and the constant."""
    if not net.m2:
        return 0.0
    return Partition(net, labels).value() - sum(plogp(d) for d in net.degree) / net.m2


def merged_down(net: Net, labels: list[int], k: int) -> list[int]:
    """Merge the adjacent pair of modules of least change until k are left or none adjoin."""
    labels = renumbered(labels)
    upper = net.contracted(labels)
    near = [dict(a) for a in upper.near]
    volume, cut = list(upper.degree), [sum(a.values()) for a in upper.near]
    alive, into = set(range(upper.n)), list(range(upper.n))
    part = lambda v, g: entropy_part(v, g, net.m2)
    change = lambda a, b: part(volume[a] + volume[b], cut[a] + cut[b] - 2 * near[a][b]) - part(volume[a], cut[a]) - part(volume[b], cut[b])
    age = [0] * upper.n
    heap = [(change(a, b), a, b, 0, 0) for a in alive for b in near[a] if a < b]
    heapq.heapify(heap)
    while len(alive) > k and heap:
        _, a, b, ta, tb = heapq.heappop(heap)
        if a not in alive or b not in alive or (ta, tb) != (age[a], age[b]):
            continue
        cut[a] += cut[b] - 2 * near[a].pop(b)
        volume[a] += volume[b]
        alive.discard(b)
        into[b] = a
        age[a] += 1
        for c, w in near[b].items():
            if c != a:
                near[a][c] = near[a].get(c, 0.0) + w
                near[c][a] = near[a][c]
                del near[c][b]
        for c in near[a]:
            x, y = min(a, c), max(a, c)
            heapq.heappush(heap, (change(x, y), x, y, age[x], age[y]))

    def final(c: int) -> int:
        while into[c] != c:
            c = into[c]
        return c

    return renumbered([final(c) for c in labels])


def optimised(net: Net, k: int | None = None, seed: int = 0, starts: int = 8) -> list[int]:
    """The best of several multilevel searches, merged down if more than k modules are left."""
    tries = [polished(net, multilevel(net, "entropy", seed * 1000 + s), seed=seed * 1000 + s) for s in range(starts)]
    best = min(tries, key=lambda x: round(Partition(net, x).value(), 12))
    return merged_down(net, best, k) if k and len(set(best)) > k else best


#: Vertices up to which eigenvectors are found from the whole matrix, which has the square of their number of entries.
DENSE = 3000


def _dense_vectors(net: Net, k: int) -> np.ndarray:
    a = np.zeros((net.n, net.n))
    for u, v, w in net.edges():
        a[u, v] += w
        a[v, u] += w * (u != v)
    d = a.sum(axis=1)
    scale = 1 / np.sqrt(d + max(0.5 * d.mean(), TINY))
    return np.linalg.eigh(np.eye(net.n) - scale[:, None] * a * scale)[1][:, :k]


def _leading_vectors(net: Net, k: int) -> np.ndarray:
    """The same space by Lanczos steps on the edges; what is left is searched until it has no larger eigenvalue, so that equal ones aren't missed."""
    ends = np.array([*net.edges()], dtype=float).reshape(-1, 3)
    u, v, w = ends[:, 0].astype(int), ends[:, 1].astype(int), ends[:, 2]
    two = u != v
    rows, cols, w = np.concatenate((u, v[two])), np.concatenate((v, u[two])), np.concatenate((w, w[two]))
    d = np.bincount(rows, w, net.n)
    scale = 1 / np.sqrt(d + max(0.5 * d.mean(), TINY))
    w = w * scale[rows] * scale[cols]
    rng, times = np.random.default_rng(0), lambda x: np.bincount(rows, w * x[cols], net.n)
    values, found = _lanczos(times, np.zeros((net.n, 0)), k, rng)
    while found.shape[1] < net.n:
        more, x = _lanczos(times, found, 1, rng)
        if more[0] <= values[-1] + 1e-9:
            break
        values, found = np.append(values[:-1], more), np.column_stack((found[:, :-1], x))
        order = np.argsort(-values, kind="stable")
        values, found = values[order], found[:, order]
    return found


def _lanczos(times: Callable[[np.ndarray], np.ndarray], known: np.ndarray, k: int, rng: np.random.Generator, most: int = 160, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric operator, and their vectors, orthogonal to ``known``; restarted with the best ones found."""
    n = known.shape[0]
    most = min(max(most, 3 * k), n - known.shape[1])
    keep = min(k + 30, most - 1)
    basis, h, start = np.zeros((n, most)), np.zeros((most, most)), 0

    def fresh(x: np.ndarray, j: int) -> tuple[np.ndarray, float]:
        for _ in range(2):
            x = x - known @ (known.T @ x)
            x = x - basis[:, :j] @ (basis[:, :j].T @ x)
        return x, float(np.linalg.norm(x))

    x, size = fresh(rng.standard_normal(n), 0)
    while True:
        for j in range(start, most):
            basis[:, j] = x / size
            x = times(basis[:, j])
            h[: j + 1, j] = h[j, : j + 1] = basis[:, : j + 1].T @ x
            x, size = fresh(x, j + 1)
            left = size if size > 1e-12 else 0.0
            if not left and j + 1 < most:  # an invariant space: go on from anywhere else
                x, size = fresh(rng.standard_normal(n), j + 1)
        values, y = np.linalg.eigh(h)
        values, y = values[::-1], y[:, ::-1]
        if most + known.shape[1] == n or (left * np.abs(y[-1, :k])).max() <= tolerance:
            return values[:k], basis @ y[:, :k]
        basis[:, :keep] = basis @ y[:, :keep]
        h[:] = 0
        h[range(keep), range(keep)] = values[:keep]
        start = keep


def spectral(net: Net, k: int, seed: int = 0, rounds: int = 25) -> list[int]:
    """k-means on the rows of the first k eigenvectors of the regularised Laplacian; no cluster is empty."""
    rng, n = np.random.default_rng(seed), net.n
    x = _dense_vectors(net, k) if n <= DENSE else _leading_vectors(net, k)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), TINY)
    centres = x[rng.choice(n, 1)]
    while len(centres) < k:  # far points are likelier to become centres
        far = ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1) + TINY
        centres = np.vstack((centres, x[rng.choice(n, p=far / far.sum())]))
    for _ in range(rounds):
        labels = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(k):
            if not (labels == c).any():
                counts = np.bincount(labels, minlength=k)
                labels[rng.choice(np.flatnonzero(counts[labels] > 1))] = c
        centres = np.stack([x[labels == c].mean(axis=0) for c in range(k)])
    return labels.tolist()


def fixed_k(net: Net, k: int, starts: int = 8, passes: int = 20, seed: int = 0, use_spectral: bool = True) -> list[int]:
    """The best partition into exactly k modules from spectral and balanced random starts."""
    if not 1 <= k <= net.n:
        raise ValueError(f"k must be between 1 and {net.n}, not {k}")
    tries = []
    for s in range(starts):
        rng = np.random.default_rng(seed * 1000 + s)
        if use_spectral and not s and 2 <= k:
            labels = spectral(net, k, seed)
        else:
            labels = rng.permutation(np.arange(net.n) % k).tolist()
        state = Partition(net, labels)
        local_moves(state, rng, passes, fixed_k=True)
        tries.append(state.labels)
    return renumbered(min(tries, key=lambda x: round(Partition(net, x).value(), 12)))


def exhaustive(net: Net) -> tuple[float, list[int]]:
    """The least H2 over all set partitions, for a handful of vertices."""
    best = (float("inf"), [])

    def extend(labels: list[int], used: int) -> None:
        nonlocal best
        if len(labels) == net.n:
            best = min(best, (entropy(net, labels), list(labels)))
            return
        for c in range(used + 1):
            extend([*labels, c], max(used, c + 1))

    extend([], 0)
    return best


def agglomerated(net: Net) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size), new clusters numbered from n: always the adjacent pair of least change.

    Where nothing adjoins, the two clusters of smallest number merge.
    """
    n = net.n
    near = {i: dict(a) for i, a in enumerate(net.near)}
    volume = dict(enumerate(net.degree))
    cut = {i: sum(a.values()) for i, a in enumerate(net.near)}
    size = dict.fromkeys(range(n), 1)
    m2 = net.m2 or 1.0
    part = lambda v, g: entropy_part(v, g, m2)
    change = lambda a, b: part(volume[a] + volume[b], max(0.0, cut[a] + cut[b] - 2 * near[a].get(b, 0.0))) - part(volume[a], cut[a]) - part(volume[b], cut[b])
    heap = [(change(a, b), a, b) for a in near for b in near[a] if a < b]
    heapq.heapify(heap)
    out = []
    for step in range(n - 1):
        while heap and not (heap[0][1] in near and heap[0][2] in near):
            heapq.heappop(heap)
        if heap:
            delta, a, b = heapq.heappop(heap)
        else:
            a, b = sorted(near)[:2]
            delta = change(a, b)
        new = n + step
        size[new] = size[a] + size[b]
        out.append((a, b, max(delta, 0.0) + 1e-9 * step, size[new]))
        volume[new] = volume[a] + volume[b]
        cut[new] = max(0.0, cut[a] + cut[b] - 2 * near[a].get(b, 0.0))
        links: dict[int, float] = {}
        for old in (a, b):
            for c, w in near.pop(old).items():
                if c not in (a, b):
                    links[c] = links.get(c, 0.0) + w
                    near[c].pop(old)
        near[new] = links
        for c, w in links.items():
            near[c][new] = w
            heapq.heappush(heap, (change(c, new), c, new))
    return out


def cut_merges(merges, n: int, k: int | None) -> list[int]:
    """Labels of k clusters: the first n - k merges in order of height; k is 2 if not given."""
    k = 2 if k is None or k < 1 else k
    parent = list(range(n + len(merges)))
    for step in sorted(range(len(merges)), key=lambda i: (merges[i][2], i))[: max(0, n - k)]:
        parent[merges[step][0]] = parent[merges[step][1]] = n + step

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    return renumbered([top(i) for i in range(n)])


def hops(net: Net) -> np.ndarray:
    """Numbers of steps between all vertices; one more than the largest where there is no way."""
    out = np.full((net.n, net.n), -1)
    for s in range(net.n):
        out[s, s], front = 0, [s]
        while front:
            front = [v for u in front for v in net.near[u] if out[s, v] < 0 and not out[s].__setitem__(v, out[s, u] + 1)]
    return np.where(out < 0, out.max() + 1, out)


def linkage(distance: np.ndarray, kind: str) -> list[tuple[int, int, float, int]]:
    """Average, complete or Ward merges of a distance matrix, nearest pair first."""
    n = len(distance)
    d = distance.astype(float) ** (2 if kind == "ward" else 1)
    d = np.pad(d, ((0, n - 1), (0, n - 1)), constant_values=np.inf)
    np.fill_diagonal(d, np.inf)
    size, alive, out = np.ones(2 * n - 1), np.zeros(2 * n - 1, bool), []
    alive[:n] = True
    for step in range(n - 1):
        live = np.flatnonzero(alive)
        sub = d[np.ix_(live, live)]
        i, j = np.unravel_index(np.argmin(sub), sub.shape)
        a, b, new = sorted((int(live[i]), int(live[j]))) + [n + step]
        rest = live[(live != a) & (live != b)]
        if kind == "average":
            row = (size[a] * d[a, rest] + size[b] * d[b, rest]) / (size[a] + size[b])
        elif kind == "complete":
            row = np.maximum(d[a, rest], d[b, rest])
        else:
            s = size[rest]
            row = ((size[a] + s) * d[a, rest] + (size[b] + s) * d[b, rest] - s * d[a, b]) / (size[a] + size[b] + s)
        height = d[a, b] ** 0.5 if kind == "ward" else d[a, b]
        d[new, rest] = d[rest, new] = row
        alive[[a, b]], alive[new] = False, True
        size[new] = size[a] + size[b]
        out.append((a, b, float(height), int(size[new])))
    return out


def paris(net: Net) -> list[tuple[int, int, float, int]]:
    """Merges by the pair sampling ratio, along chains of nearest neighbours."""
    n, m2 = net.n, net.m2 or 1.0
    near = {i: dict(a) for i, a in enumerate(net.near)}
    weight, size = dict(enumerate(net.degree)), dict.fromkeys(range(n), 1)
    out, chain, loose, new = [], [], [], n
    while near:
        if not chain:
            chain = [min(near)]
        a = chain[-1]
        if not near[a]:
            loose.append(chain.pop())
            del near[a]
            continue
        distance, b = min((weight[a] * weight[c] / (w * m2), c) for c, w in near[a].items())
        if len(chain) > 1 and weight[a] * weight[chain[-2]] / (near[a].get(chain[-2], 0.0) * m2 or TINY) <= distance:
            b = chain[-2]
            chain = chain[:-2]
            links: dict[int, float] = {}
            for old in (a, b):
                for c, w in near.pop(old).items():
                    if c not in (a, b):
                        links[c] = links.get(c, 0.0) + w
                        near[c].pop(old)
            near[new] = links
            for c, w in links.items():
                near[c][new] = w
            weight[new], size[new] = weight[a] + weight[b], size[a] + size[b]
            out.append((a, b, distance, size[new]))
            new += 1
        else:
            chain.append(b)
    while len(loose) > 1:
        a, b = loose.pop(), loose.pop()
        size[new] = size[a] + size[b]
        out.append((a, b, float("inf"), size[new]))
        loose.append(new)
        new += 1
    return out
