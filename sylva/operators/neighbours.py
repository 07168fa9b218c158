"""Exact nearest neighbours by cosine, in blocks that the triangle inequality rules out.

Vectors are scaled to length one, where cosine and distance order alike. Each goes to the nearest of a few pivots, its cell, and a
cell is cut by distance from its pivot into rings of at most ``block`` vectors, so that no cell, however many vectors
it holds, is one task's. A ring is searched by itself first; the k-th best found there bounds each of its vectors' search: another ring can hold
nothing nearer if its distances from its pivot differ from the vector's by more than that. Rings are dealt out in runs, the groups. A group's
task holds its own vectors with the best k of each so far, and the rings that remain for any of its rings stream past them in the order of a sort.

A ring is sent once to each group that may need it, so what is shuffled is at most the vectors times the number of groups, not a copy for each pair of
rings. There are twice as many groups as cores; more only if a group would hold over ``HELD`` numbers, fewer if it would hold under
four rings. Products are made in single precision, and only pairs that may be among the best by its error are computed in double.

With ``within``, neighbours are sought among the vectors of the same value of that column, and cells belong to one value.

The result is exact for any pivots; they only decide how much is ruled out. Vectors in clusters need a small part of all
pairs. Vectors without any structure in many dimensions need nearly all, as for every exact method.

Bounds: pivots come from a sample of ``SAMPLE`` vectors; rings grow with the number of vectors so that there are at most ``MOST_RINGS``
and one for each cell, whose distances are broadcast.

Defined results: null vectors and those of length zero have no direction and no neighbours, nor have those that are null in ``within``. Of equal
cosines, to nine places, the smaller id comes first. A vector isn't its own neighbour; rows of one id count as one vector each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import norm
from .checkpoints import stored
from .ranking import numbered

SAMPLE = 2_048
PIVOTS = 64
BLOCK = 512
MOST_RINGS = 1 << 20
#: Most numbers of vectors that a group holds.
HELD = 1 << 22
#: A group's rows in order: the rings that it holds, those again to be searched, and those of other groups.
OWN, NEAR, FAR = range(3)
#: More than what cosines of nine places may change in a distance.
MARGIN = 1e-4
CELL, TARGET = ["cell", "ring"], ["to_cell", "to_ring"]


def distances(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def chosen_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots that are far from each other: always the vector farthest from those chosen before."""
    picked = sample[:1]
    near = distances(sample @ picked[0])
    while len(picked) < min(most, len(sample)) and near.max() > 0:
        picked = np.vstack((picked, sample[near.argmax()]))
        near = np.minimum(near, distances(sample @ picked[-1]))
    return picked


def best_of(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For vectors x the best k of y, which are in order of id: (place in x, place in y, cosine)."""
    cosine = np.round(x @ y.T, 9)
    cosine[ids[:, None] == others[None, :]] = -9.0
    least = np.partition(cosine, len(others) - k, axis=1)[:, [len(others) - k]] if len(others) > k else np.full((len(ids), 1), -8.0)
    row, column = np.nonzero((cosine >= least) & (cosine > -8.0))
    order = np.lexsort((column, -cosine[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    ok = np.arange(len(row)) - first < k
    return row[ok], column[ok], cosine[row[ok], column[ok]]


def rings(vectors: DataFrame, vec_id: str, embedding: str, pivots: int = PIVOTS, block: int = BLOCK, within: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """(cell, ring, low, high, ids, xs), a row for each ring with its vectors, not yet scaled, in order of id, and the pivots.

    With p pivots, cells p * i to p * i + p - 1 are those of the i-th value of ``within``.
    """
    ok = F.col(vec_id).isNotNull() & (norm(F.col(embedding)) > 0)
    rows = vectors.where(ok if within is None else ok & F.col(within).isNotNull())
    rows = stored(rows.select(F.col(vec_id).alias("id"), F.col(embedding).alias("x"), (F.lit(0) if within is None else F.col(within)).alias("part")))
    block = max(block, -(-rows.count() // MOST_RINGS))
    sample = [r["x"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").collect()]
    centres = chosen_pivots(scaled(np.array(sample, float)), pivots) if sample else np.zeros((1, 1))

    def place(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            if len(chunk):
                away = distances(scaled(np.stack(chunk["x"].to_list())) @ centres.T)
                cell = away.argmin(axis=1)
                yield chunk.assign(cell=chunk["part"] * len(centres) + cell, away=away[np.arange(len(chunk)), cell])[["id", "x", "cell", "away"]]

    kind, vector = rows.schema["id"].dataType.simpleString(), rows.schema["x"].dataType.simpleString()
    if within is not None:
        parts = numbered(rows.select("part").distinct(), [], [F.col("part")])
        rows = rows.join(parts, "part").select("id", "x", F.col("n").alias("part"))
    placed = rows.mapInPandas(place, f"id {kind}, x {vector}, cell long, away double")
    placed = numbered(placed, ["cell"], [F.col("away"), F.col("id")]).withColumn("ring", F.floor(F.col("n") / block))
    members = F.sort_array(F.collect_list(F.struct("id", "x"))).alias("m")  # at most ``block``
    packed = placed.groupBy(*CELL).agg(F.min("away").alias("low"), F.max("away").alias("high"), members)
    return stored(packed.select(*CELL, "low", "high", F.transform("m", lambda m: m["id"]).alias("ids"), F.flatten(F.transform("m", lambda m: m["x"])).alias("xs"))), centres


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` at length one, in double precision."""
    x = np.asarray(x, float)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(ids: np.ndarray, xs: np.ndarray) -> np.ndarray:
    return scaled(np.asarray(xs, float).reshape(len(ids), -1))


def ring_pairs(packed: DataFrame, centres: np.ndarray, k: int) -> DataFrame:
    """Rows of two kinds: (u, v, sim) found within rings, and (cell, ring, to_cell, to_ring), where else to search."""
    bounds = packed.select(*CELL, "low", "high", F.size("ids").alias("n")).toPandas().sort_values(CELL)  # at most MOST_RINGS and one for each cell
    shared = packed.sparkSession.sparkContext.broadcast({int(c): (g["ring"].to_numpy(), g["low"].to_numpy(), g["high"].to_numpy()) for c, g in bounds.groupby("cell")})
    inner = bounds.groupby("cell").first().reset_index()  # each cell's vectors nearest to its pivot
    inner = {int(part): (g["cell"].to_numpy() % len(centres), g["high"].to_numpy(), g["n"].to_numpy()) for part, g in inner.groupby(inner["cell"] // len(centres))}
    names = ["u", "v", "sim", *CELL, *TARGET]

    def search(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            for cell, ring, ids, xs in chunk[[*CELL, "ids", "xs"]].itertuples(index=False):
                ids, x, part = np.asarray(ids), _matrix(ids, xs), int(cell) // len(centres)
                inner_cells, inner_high, inner_n = inner[part]
                row, column, cosine = best_of(ids, x, ids, x, k)
                yield pd.DataFrame({"u": ids[row], "v": ids[column], "sim": cosine}).reindex(columns=names)
                reach = np.full(len(ids), 2.0)
                full = np.bincount(row, minlength=len(ids)) == k
                last = np.searchsorted(row, np.arange(len(ids)), side="right") - 1
                reach[full] = distances(cosine[last[full]])
                away = distances(x @ centres.T)
                # Nor is the k-th best farther than the far side of the nearest rings that together have more than k vectors.
                far = away[:, inner_cells] + inner_high
                order = np.argsort(far, axis=1)
                enough = np.cumsum(inner_n[order], axis=1) > k
                at = order[np.arange(len(ids)), enough.argmax(axis=1)]
                reach = np.where(enough[:, -1], np.minimum(reach, far[np.arange(len(ids)), at]), reach)
                out = []
                for to in range(part * len(centres), (part + 1) * len(centres)):
                    if to not in shared.value:
                        continue
                    number, low, high = shared.value[to]
                    # Rings follow each other by distance: those that reach into a vector's interval are a run of them.
                    begin = np.searchsorted(high, away[:, to % len(centres)] - reach - MARGIN)
                    end = np.searchsorted(low, away[:, to % len(centres)] + reach + MARGIN, side="right")
                    steps = np.zeros(len(number) + 1, np.int64)
                    some = begin < end
                    np.add.at(steps, begin[some], 1)
                    np.add.at(steps, end[some], -1)
                    out += [(to, int(r)) for r in number[np.cumsum(steps)[:-1] > 0] if (to, r) != (cell, ring)]
                yield pd.DataFrame(out, columns=TARGET).assign(cell=cell, ring=ring, u=None, v=None).reindex(columns=names)

    kind = packed.schema["ids"].dataType.elementType.simpleString()
    return stored(packed.mapInPandas(search, f"u {kind}, v {kind}, sim double, cell long, ring long, to_cell long, to_ring long"))


class Best:
    """The best k found so far for each of a group's vectors."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray]], k: int):
        self.ends = np.cumsum([0, *(len(ids) for ids, _ in blocks)])
        self.ids, self.x, self.k = np.concatenate([ids for ids, _ in blocks]), np.vstack([x for _, x in blocks]), k
        self.single = self.x.astype(np.float32)
        #: More than what a product in single precision may be off.
        self.off = (self.x.shape[1] + 16) * 2.0**-23
        self.least = np.full(len(self.ids), -2.0, np.float32)
        self.found = np.zeros((len(self.ids), k), self.ids.dtype), np.full((len(self.ids), k), -9.0)

    def search(self, block: int, others: np.ndarray, y: np.ndarray, single: np.ndarray) -> None:
        """Search the vectors y, in order of id, for the vectors of a block."""
        a, b = self.ends[block], self.ends[block + 1]
        row, column = np.divmod(np.flatnonzero(self.single[a:b] @ single.T >= self.least[a:b, None]), len(others))
        if len(row) > 2 * self.k * (b - a):  # copies, or nothing found yet
            some = np.unique(row)
            at, column, cosine = best_of(self.ids[a:b][some], self.x[a:b][some], others, y, self.k)
            row = some[at]
        else:
            ok = self.ids[a:b][row] != others[column]
            row, column = row[ok], column[ok]
            cosine = np.round(np.einsum("ij,ij->i", self.x[a:b][row], y[column]), 9)
        if len(row):
            self.take(a + row, others[column], cosine)

    def take(self, row: np.ndarray, ids: np.ndarray, cosine: np.ndarray) -> None:
        names, best = self.found
        some = np.unique(row)
        old, at = np.nonzero(best[some] > -8.0)
        row = np.concatenate((some[old], row))
        ids, cosine = np.concatenate((names[some[old], at], ids)), np.concatenate((best[some[old], at], cosine))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -cosine, row))
        row, ids, cosine = row[order], ids[order], cosine[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        ok = place < self.k
        names[row[ok], place[ok]], best[row[ok], place[ok]] = ids[ok], cosine[ok]
        self.least[some] = np.maximum(best[some, -1] - self.off, -2.0)

    def rows(self) -> pd.DataFrame:
        names, best = self.found
        row, at = np.nonzero(best > -8.0)
        return pd.DataFrame({"u": self.ids[row], "v": names[row, at], "sim": best[row, at]})


def grouped(packed: DataFrame, dimensions: int) -> tuple[DataFrame, int]:
    """(cell, ring, g, place), each ring's group and its place there, and the number of groups."""
    spark = packed.sparkSession
    sizes = packed.select(*CELL, F.size("ids").alias("n")).toPandas().sort_values(CELL)  # at most MOST_RINGS and one for each cell
    total = int(sizes["n"].sum())
    groups = max(1, min(2 * spark.sparkContext.defaultParallelism, len(sizes) // 4), -(-total * dimensions // HELD))
    sizes["g"] = (sizes["n"].cumsum() - sizes["n"]) * groups // max(total, 1)
    sizes["place"] = sizes.groupby("g").cumcount()
    return spark.createDataFrame(sizes[[*CELL, "g", "place"]], "cell long, ring long, g long, place long"), groups


def dealt(packed: DataFrame, centres: np.ndarray, k: int) -> tuple[DataFrame, int]:
    """(g, kind, place, blocks, ids, xs): what each group holds and, once for each group, what any of its rings, ``blocks``, are to search; and the number of groups."""
    at, groups = grouped(packed, centres.shape[1])
    pairs = ring_pairs(packed, centres, k).where("to_cell IS NOT NULL").select(*CELL, *TARGET)
    itself = at.select(*CELL, *[F.col(c).alias(t) for c, t in zip(CELL, TARGET)])
    home = at.select(*[F.col(c).alias(t) for c, t in zip(CELL, TARGET)], F.col("g").alias("home"))
    needs = pairs.union(itself).join(at, CELL).groupBy("g", *TARGET).agg(F.sort_array(F.collect_set("place")).alias("blocks"))  # at most a group's rings
    needs = needs.join(home, TARGET).select("g", F.when(F.col("g") == F.col("home"), NEAR).otherwise(FAR).alias("kind"), F.lit(0).cast("long").alias("place"), "blocks", *[F.col(t).alias(c) for c, t in zip(CELL, TARGET)])
    held = at.select("g", F.lit(OWN).alias("kind"), "place", F.lit(None).cast("array<long>").alias("blocks"), *CELL)
    rows = held.union(needs).join(packed.select(*CELL, "ids", "xs"), CELL)
    return rows.select("g", "kind", "place", "blocks", "ids", "xs"), groups

def nearest(vectors: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, within: str | None = None) -> DataFrame:
    """(u, v, sim, place): the ``k`` vectors of largest cosine for each vector, exactly, place from 1."""
    packed, centres = rings(vectors, vec_id, embedding, pivots, block, within)
    sent, groups = dealt(packed, centres, k)

    def compare(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, blocks, best = None, [], None
        for chunk in chunks:
            for g, kind, wanted, ids, xs in chunk[["g", "kind", "blocks", "ids", "xs"]].itertuples(index=False):
                if g != group:
                    if best is not None:
                        yield best.rows()
                    group, blocks, best = g, [], None
                ids, y = np.asarray(ids), _matrix(ids, xs)
                if kind == OWN:
                    blocks.append((ids, y))
                    continue
                best = best or Best(blocks, k)
                single = y.astype(np.float32)
                for b in wanted:
                    best.search(int(b), ids, y, single)
        if best is not None:
            yield best.rows()

    kind = packed.schema["ids"].dataType.elementType.simpleString()
    streamed = sent.repartitionById(groups, F.col("g").cast("int")).sortWithinPartitions("g", "kind", "place")
    found = streamed.select("g", "kind", "blocks", "ids", "xs").mapInPandas(compare, f"u {kind}, v {kind}, sim double")
    order = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")  # rows that share an id
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
