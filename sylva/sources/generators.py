"""Generated graphs as (edges, vertices) with a ``truth`` column where there is one.

Closed forms are sequences and arithmetic in Spark. Random graphs draw from seeded
generators: small ones in numpy on the driver, large block models as
Poisson numbers of edges for each pair of blocks, expanded in Spark.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import GID, canonical

EDGES = f"{GID} string, src long, dst long, w double"
VERTICES = f"{GID} string, id long, ord long, truth long"


def from_lists(spark: SparkSession, name: str, n: int, edges, truth=None) -> tuple[DataFrame, DataFrame]:
    """A graph on 0..n-1 from (u, v) or (u, v, w) tuples."""
    rows = [(name, min(e[0], e[1]), max(e[0], e[1]), float(e[2]) if len(e) > 2 else 1.0) for e in edges]
    nodes = [(name, i, i, None if truth is None else int(truth[i])) for i in range(n)]
    return canonical(spark.createDataFrame(rows, EDGES), "w"), spark.createDataFrame(nodes, VERTICES)


def _vertices(spark: SparkSession, name: str, n: int, truth) -> DataFrame:
    return spark.range(n).select(F.lit(name).alias(GID), "id", F.col("id").alias("ord"), truth.cast("long").alias("truth"))


def ring_of_cliques(spark: SparkSession, r: int, c: int) -> tuple[DataFrame, DataFrame]:
    """``r`` cliques of ``c`` vertices, each linked to the next by one edge; truth is the clique."""
    name = f"ring-{r}-{c}"
    i, j = F.col("i"), F.col("j")
    within = spark.range(r).select(F.col("id").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(c - 1))).alias("i"))
    within = within.select("q", "i", F.explode(F.sequence(F.lit(0), F.lit(c - 1))).alias("j")).where(i < j).select((F.col("q") * c + i).alias("src"), (F.col("q") * c + j).alias("dst"))
    bridges = spark.range(r if r > 2 else r - 1).select((F.col("id") * c).alias("src"), (((F.col("id") + 1) % r) * c + (1 if c > 1 else 0)).alias("dst"))
    return canonical(within.union(bridges), graph_id=name), _vertices(spark, name, r * c, F.floor(F.col("id") / c))


def triangle_fractal(spark: SparkSession, level: int) -> tuple[DataFrame, DataFrame]:
    """Three copies of the level below, their first vertices linked pairwise; level 1 is a triangle.

    At scale 3**k the vertices that are multiples of 3**k form triangles by their base-3 digit k.
    """
    name, n = f"fractal-{level}", 3**level
    scales = spark.range(level).select(F.pow(F.lit(3), F.col("id")).cast("long").alias("s"))
    bases = scales.select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.lit(n) / (3 * F.col("s"))) - 1)).alias("b"))
    pairs = bases.select("s", (F.col("b") * 3 * F.col("s")).alias("o"), F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, 2), (1, 2))])).alias("p"))
    edges = pairs.select((F.col("o") + F.col("p.a") * F.col("s")).alias("src"), (F.col("o") + F.col("p.b") * F.col("s")).alias("dst"))
    return canonical(edges, graph_id=name), _vertices(spark, name, n, F.floor(F.col("id") / (n // 3)))


def grid(spark: SparkSession, rows: int, columns: int) -> tuple[DataFrame, DataFrame]:
    name, n = f"grid-{rows}x{columns}", rows * columns
    here = spark.range(n).select("id", (F.col("id") % columns).alias("x"))
    right = here.where(F.col("x") < columns - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = here.where(F.col("id") + columns < n).select(F.col("id").alias("src"), (F.col("id") + columns).alias("dst"))
    return canonical(right.union(down), graph_id=name), _vertices(spark, name, n, F.floor(F.col("id") / columns))


def balanced_tree(spark: SparkSession, r: int, h: int) -> tuple[DataFrame, DataFrame]:
    name, n = f"tree-{r}-{h}", sum(r**k for k in range(h + 1))
    edges = spark.range(1, n).select(F.floor((F.col("id") - 1) / r).alias("src"), F.col("id").alias("dst"))
    return canonical(edges, graph_id=name), _vertices(spark, name, n, F.lit(0))


def caveman(spark: SparkSession, r: int, c: int) -> tuple[DataFrame, DataFrame]:
    """``r`` cliques of ``c``; in each the edge of its first two vertices goes to the clique before instead."""
    edges = []
    for q in range(r):
        at = q * c
        edges += [(at + i, at + j) for i in range(c) for j in range(i + 1, c) if (i, j) != (0, 1)]
        edges.append((at, (at - 1) % (r * c)))
    return from_lists(spark, f"caveman-{r}-{c}", r * c, edges, [i // c for i in range(r * c)])


def petersen(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    edges = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(i + 5, (i + 2) % 5 + 5) for i in range(5)]
    return from_lists(spark, "petersen", 10, edges)


def four_rooms(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The free cells of a square of 11 x 11 with two walls and a door in each of their four arms."""
    return from_lists(spark, "rooms", len(free_cells()), *room_edges())


def free_cells(n: int = 11) -> list[tuple[int, int]]:
    mid, doors = n // 2, {(n // 2, 2), (n // 2, n - 3), (2, n // 2), (n - 3, n // 2)}
    return [(i, j) for i in range(n) for j in range(n) if (i != mid and j != mid) or (i, j) in doors]


def room_edges(n: int = 11) -> tuple[list[tuple[int, int]], list[int]]:
    cells = {cell: k for k, cell in enumerate(free_cells(n))}
    edges = [(k, cells[to]) for (i, j), k in cells.items() for to in ((i + 1, j), (i, j + 1)) if to in cells]
    return edges, [2 * (i > n // 2) + (j > n // 2) for i, j in cells]


def room_step(state: tuple[int, int], action: int, n: int = 11) -> tuple[tuple[int, int], float, bool]:
    """(next cell, reward, done) for up, down, left, right; the far corner is the goal, walls stop a step."""
    di, dj = ((-1, 0), (1, 0), (0, -1), (0, 1))[action]
    to = (state[0] + di, state[1] + dj)
    to = to if to in set(free_cells(n)) else state
    done = to == (n - 1, n - 1)
    return to, float(done), done


# Small public graphs.
KARATE = (
    "0-1:4 0-2:5 0-3:3 0-4:3 0-5:3 0-6:3 0-7:2 0-8:2 0-10:2 0-11:3 0-12:1 0-13:3 0-17:2 0-19:2 0-21:2 0-31:2 "
    "1-2:6 1-3:3 1-7:4 1-13:5 1-17:1 1-19:2 1-21:2 1-30:2 2-3:3 2-7:4 2-8:5 2-9:1 2-13:3 2-27:2 2-28:2 2-32:2 "
    "3-7:3 3-12:3 3-13:3 4-6:2 4-10:3 5-6:5 5-10:3 5-16:3 6-16:3 8-30:3 8-32:3 8-33:4 9-33:2 13-33:3 14-32:3 "
    "14-33:2 15-32:3 15-33:4 18-32:1 18-33:2 19-33:1 20-32:3 20-33:1 22-32:2 22-33:3 23-25:5 23-27:4 23-29:3 "
    "23-32:5 23-33:4 24-25:2 24-27:3 24-31:2 25-31:7 26-29:4 26-33:2 27-33:4 28-31:2 28-33:2 29-32:4 29-33:2 "
    "30-32:3 30-33:3 31-32:4 31-33:4 32-33:5"
)
KARATE_OFFICER = "8 9 14 15 18 20 22 23 24 25 26 27 28 29 30 31 32 33"
FLORENTINE = (
    "Acciaiuoli-Medici Castellani-Peruzzi Castellani-Strozzi Castellani-Barbadori Medici-Barbadori Medici-Ridolfi "
    "Medici-Tornabuoni Medici-Albizzi Medici-Salviati Salviati-Pazzi Peruzzi-Strozzi Peruzzi-Bischeri Strozzi-Ridolfi "
    "Strozzi-Bischeri Ridolfi-Tornabuoni Tornabuoni-Guadagni Albizzi-Ginori Albizzi-Guadagni Bischeri-Guadagni Guadagni-Lamberteschi"
)
TUTORIAL = {
    "k2": ("0-1", "0 0"),
    "four-edges": ("0-1 2-3 4-5 6-7", "0 0 1 1 2 2 3 3"),
    "c4": ("0-1 1-2 2-3 3-0", "0 0 1 1"),
    "two-triangles": ("0-1 1-2 0-2 3-4 4-5 3-5 2-3", "0 0 0 1 1 1"),
}


def karate(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The weighted karate club; truth 0 is the instructor's side."""
    edges = [(*map(int, e.split(":")[0].split("-")), float(e.split(":")[1])) for e in KARATE.split()]
    officer = set(map(int, KARATE_OFFICER.split()))
    return from_lists(spark, "Karate", 34, edges, [int(i in officer) for i in range(34)])


def florentine(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    pairs = [e.split("-") for e in FLORENTINE.split()]
    names = sorted({x for p in pairs for x in p})
    return from_lists(spark, "florentine", len(names), [(names.index(a), names.index(b)) for a, b in pairs])


def tutorial(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    edges, labels = TUTORIAL[name]
    truth = list(map(int, labels.split()))
    return from_lists(spark, name, len(truth), [tuple(map(int, e.split("-"))) for e in edges.split()], truth)


def sbm_lists(sizes: list[int], p_in: float, p_out: float, seed: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges and blocks of a stochastic block model."""
    block = np.repeat(np.arange(len(sizes)), sizes)
    u, v = np.triu_indices(len(block), 1)
    p = np.where(block[u] == block[v], p_in, p_out)
    on = np.random.default_rng(seed).random(len(u)) < p
    return list(zip(u[on].tolist(), v[on].tolist())), block.tolist()


def sbm(spark: SparkSession, n: int = 150, k: int = 3, p_in: float = 0.3, p_out: float = 0.05, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Blocks of n // k vertices, the last with the remainder."""
    sizes = [n // k] * (k - 1) + [n - (k - 1) * (n // k)]
    edges, block = sbm_lists(sizes, p_in, p_out, seed)
    return from_lists(spark, f"sbm-{n}-{k}-{seed}", n, edges, block)


def sbm_scalable(spark: SparkSession, n: int = 1000, k: int = 10, intra_deg: float = 15, inter_deg: float = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A block model given by mean degrees, for any n: each vertex draws its own numbers of partners.

    Equal to drawing each pair by itself up to the few pairs that are drawn twice, which count once.
    """
    name, b = f"sbm-{n}-{k}-{seed}", max(1, n // k)
    p_in, p_out = min(1.0, intra_deg / max(1, b - 1)), min(1.0, inter_deg / max(1, n - b))
    truth = F.least(F.floor(F.col("id") / b), F.lit(k - 1))
    vertices = _vertices(spark, name, n, truth)
    draw = lambda salt, *on: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *on), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    whole = lambda x, *on: (F.floor(x) + F.when(draw("more", *on) < x - F.floor(x), 1).otherwise(0)).cast("int")
    own = vertices.select("id", "truth", (F.col("truth") * b).alias("low"), F.when(F.col("truth") == k - 1, n).otherwise((F.col("truth") + 1) * b).alias("high"))
    near = own.withColumn("m", whole(p_in * (F.col("high") - F.col("low") - 1) / 2.0, F.col("id"))).where("m > 0").select("id", "low", "high", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("t"))
    near = near.select(F.col("id").alias("src"), (F.col("low") + F.floor(draw("in", F.col("id"), F.col("t")) * (F.col("high") - F.col("low")))).alias("dst"))
    far = own.withColumn("m", whole(p_out * (n - (F.col("high") - F.col("low"))) / 2.0, F.col("id") + n)).where("m > 0").select("id", "low", "high", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("t"))
    at = F.floor(draw("out", F.col("id"), F.col("t")) * (n - (F.col("high") - F.col("low"))))
    far = far.select(F.col("id").alias("src"), F.when(at >= F.col("low"), at + F.col("high") - F.col("low")).otherwise(at).alias("dst"))
    pairs = near.union(far).where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return canonical(pairs, graph_id=name), vertices


def _power_law(rng, low: float, high: float, exponent: float, size: int) -> np.ndarray:
    u, a = rng.random(size), 1 - exponent
    return (low**a + u * (high**a - low**a)) ** (1 / a)


def lfr_lists(n: int, mu: float, seed: int, avg_deg: float, max_deg: int, tau1: float, tau2: float, min_comm: int, max_comm: int) -> tuple[list[tuple[int, int]], list[int]]:
    """A benchmark graph with power-law degrees and community sizes; a share mu of each degree leaves the community."""
    rng = np.random.default_rng(seed)
    low, high = 1.0, float(max_deg)
    for _ in range(50):  # the least degree that gives the mean
        mid = (low + high) / 2
        low, high = (mid, high) if _power_law(np.random.default_rng(seed), mid, max_deg, tau1, 4000).mean() < avg_deg else (low, mid)
    degree = np.maximum(1, np.round(_power_law(rng, low, max_deg, tau1, n))).astype(int)
    sizes: list[int] = []
    while sum(sizes) < n:
        sizes.append(int(round(_power_law(rng, min_comm, max_comm, tau2, 1)[0])))
    sizes[-1] -= sum(sizes) - n
    if sizes[-1] < min_comm and len(sizes) > 1:
        last = sizes.pop()
        for i in range(last):
            sizes[i % len(sizes)] += 1
    inner = np.round((1 - mu) * degree).astype(int)
    room, truth = np.array(sizes), np.full(n, -1)
    for v in np.argsort(-inner, kind="stable"):
        fits = np.flatnonzero((room > 0) & (np.array(sizes) > inner[v]))
        fits = fits if len(fits) else np.flatnonzero(room > 0)
        truth[v] = rng.choice(fits, p=room[fits] / room[fits].sum())
        room[truth[v]] -= 1

    edges: set[tuple[int, int]] = set()

    def wire(stubs: np.ndarray, ok) -> None:
        for _ in range(60):
            rng.shuffle(stubs)
            left = []
            for a, b in zip(stubs[::2].tolist(), stubs[1::2].tolist()):
                e = (min(a, b), max(a, b))
                if a != b and e not in edges and ok(a, b):
                    edges.add(e)
                else:
                    left += [a, b]
            if not left:
                break
            stubs = np.array(left)

    for c in range(len(sizes)):
        members = np.flatnonzero(truth == c)
        wire(np.repeat(members, np.minimum(inner[members], len(members) - 1)), lambda a, b: True)
    wire(np.repeat(np.arange(n), degree - inner), lambda a, b: truth[a] != truth[b])
    return sorted(edges), truth.tolist()


def lfr(spark: SparkSession, n: int = 1000, mu: float = 0.3, seed: int = 0, avg_deg: float = 20, max_deg: int = 50, tau1: float = 2.5, tau2: float = 1.5, min_comm: int = 20, max_comm: int = 100) -> tuple[DataFrame, DataFrame]:
    edges, truth = lfr_lists(n, mu, seed, avg_deg, max_deg, tau1, tau2, min_comm, max_comm)
    return from_lists(spark, f"lfr-{n}-{mu}-{seed}", n, edges, truth)


def gnp(spark: SparkSession, n: int, p: float, seed: int, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    edges, _ = sbm_lists([n], p, p, seed)
    if weighted:
        edges = [(u, v, 0.5 + (7 * u + v) % 5) for u, v in edges]
    return from_lists(spark, f"gnp-{n}-{seed}", n, edges)


#: Named data sets for the benchmark: name -> function of the session.
REGISTRY = {
    "Karate": karate,
    "SBM-Clean": lambda spark: sbm(spark, 150, 3, 0.30, 0.05),
    "SBM-Noisy": lambda spark: sbm(spark, 150, 3, 0.15, 0.08),
    "Florentine": florentine,
    "LFR-mu0.3": lambda spark: lfr(spark, 150, 0.3, 0, 15, 30, 2.5, 1.5, 20, 50),
}
