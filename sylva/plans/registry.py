"""Methods by name, all callable in one way: labels of the vertices of each graph.

A method is a function of (net, k, seed), run in one task for each graph; the independent runs of one that takes the best of several
are tasks of their own where it names ``spread``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import search
from ..operators.graph import GID
from ..operators.kernels import partition as P
from ..operators.kernels import soft
from ..operators.kernels import trees as K


class ExternalNotConfigured(RuntimeError):
    """A method needs a program that isn't set up here."""


@dataclass(frozen=True)
class Method:
    name: str
    fn: Callable
    family: str = "community_detection"
    is_se: bool = False
    native: bool = True
    paper: str = ""
    repo: str = ""
    note: str = ""
    deterministic: bool = False
    #: The same labels from (edges, vertices, k, seed), each run a task.
    spread: Callable | None = None

    def fit_predict(self, edges: DataFrame, vertices: DataFrame | None = None, k: int | None = None, seed: int = 0) -> DataFrame:
        """(graph_id, id, c) for each graph."""
        if not self.native:
            self.fn(None, k, seed)
        if self.spread:
            return self.spread(edges, vertices, k, seed)
        return search.per_graph(edges, lambda net, s: self.fn(net, k, s), vertices, seed)


_METHODS: dict[str, Method] = {}


def register(method: Method) -> Method:
    """Add a method; the last one of a name counts."""
    _METHODS[method.name] = method
    return method


def method(name: str, **facts):
    def add(fn):
        register(Method(name, fn, **facts))
        return fn

    return add


def get(name: str) -> Method:
    if name not in _METHODS:
        raise KeyError(f"no method {name!r}; there are {', '.join(sorted(_METHODS))}")
    return _METHODS[name]


def methods(family: str | None = None, se_only: bool = False, native_only: bool = False) -> list[Method]:
    found = (m for m in _METHODS.values() if (family is None or m.family == family) and (m.is_se or not se_only) and (m.native or not native_only))
    return sorted(found, key=lambda m: m.name)


def list_methods(**filters) -> list[str]:
    return [m.name for m in methods(**filters)]


def info(name: str) -> dict:
    m = get(name)
    return {f: getattr(m, f) for f in ("name", "family", "is_se", "native", "paper", "repo", "note")}


def as_table(spark: SparkSession) -> DataFrame:
    rows = [(m.name, m.family, m.is_se, m.native) for m in methods()]
    return spark.createDataFrame(rows, "name string, family string, is_se boolean, native boolean")


@method("louvain", note="modularity; k isn't used")
def louvain(net, k=None, seed=0):
    return P.multilevel(net, "modularity", seed)


@method("leiden", note="modularity with connected modules, without weights; k isn't used")
def leiden(net, k=None, seed=0):
    return P.iterated(_unweighted(net), "modularity", seed)


def _best(one: Callable, edges: DataFrame, vertices: DataFrame | None, seed: int, starts: int) -> DataFrame:
    return search.multistart(edges, one, vertices, seed, starts).select(GID, "id", "c")


def _map_run(net, s):
    plain = _unweighted(net)
    labels = P.multilevel(plain, "map", s)
    return labels, P.Partition(plain, labels, "map").value()


@method("infomap", note="two-level map equation, best of ten, without weights; k isn't used", spread=lambda edges, vertices, k, seed: _best(_map_run, edges, vertices, seed + 1, 10))
def infomap(net, k=None, seed=0):
    return min((_map_run(net, (seed + 1) * 1000 + s) for s in range(10)), key=lambda x: round(x[1], 12))[0]


@method("spectral", note="regularised Laplacian, k-means; k is 2 if not given")
def spectral(net, k=None, seed=0):
    return P.spectral(net, k or 2, seed)


@method("se_agglomerative", is_se=True, deterministic=True)
def se_agglomerative(net, k=None, seed=0):
    return P.cut_merges(P.agglomerated(net), net.n, k)


@method("se_louvain", is_se=True, spread=lambda edges, vertices, k, seed: search.se_louvain(edges, vertices, k, seed))
def se_louvain(net, k=None, seed=0):
    return P.optimised(net, k, seed)


@method("se_gnn", is_se=True, note="graph convolution, soft assignment", spread=lambda edges, vertices, k, seed: _best(lambda net, s: soft.fit(net, None, k or 8, s), edges, vertices, seed, 3))
def se_gnn(net, k=None, seed=0):
    return soft.best_fit(net, None, k, seed)


def _tree_run(net, s):
    tree = K.encoding_try(net, s % 1000, s // 1000)
    return (tree.labels(), tree.entropy()) if tree else ([0] * net.n, float("inf"))


@method("se_hier", is_se=True, note="labels are the root's children of the encoding tree", spread=lambda edges, vertices, k, seed: _best(_tree_run, edges, vertices, seed, K.TRIES))
def se_hier(net, k=None, seed=0):
    return K.encoding_tree(net, seed).labels()


@method("dedoc", is_se=True, native=False, note="an external program")
def dedoc(net, k=None, seed=0):
    raise ExternalNotConfigured("dedoc: name its program in SYLVA_DEDOC")


@method("codeseg", is_se=True, native=False, note="an external program")
def codeseg(net, k=None, seed=0):
    raise ExternalNotConfigured("codeseg: name its program in SYLVA_CODESEG")


def _unweighted(net: P.Net) -> P.Net:
    return P.Net(net.n, ((u, v, 1.0) for u, v, _ in net.edges()))


def clusters(name: str, edges: DataFrame, vertices: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Labels by a short name: se, se_k<N>, louvain, leiden, infomap, random_matched."""
    if name == "se":
        return get("se_louvain").fit_predict(edges, vertices, seed=seed)
    if name.startswith("se_k") and name[4:].isdigit():
        return search.se_fixed_k(edges, int(name[4:]), vertices, seed)
    if name in ("louvain", "leiden", "infomap"):
        return get(name).fit_predict(edges, vertices, seed=seed)
    if name == "random_matched":
        return shuffled(get("se_louvain").fit_predict(edges, vertices, seed=seed), seed)
    raise ValueError(f"no clusters by {name!r}")


def shuffled(labels: DataFrame, seed: int = 0) -> DataFrame:
    """The same community sizes dealt out at random: labels in id order meet ids in the order of a seeded hash."""
    from pyspark.sql import functions as F

    from ..operators.graph import GID
    from ..operators.ranking import numbered

    given = numbered(labels.select(GID, "id", "c"), [GID], [F.col("id")]).select(GID, "c", "n")
    taken = numbered(labels.select(GID, "id", F.xxhash64(F.lit(seed), "id").alias("h")), [GID], [F.col("h"), F.col("id")]).select(GID, "id", "n")
    return taken.join(given, [GID, "n"]).select(GID, "id", "c")
