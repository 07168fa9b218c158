"""SimHash near-dedup over a Gray-order hierarchical index.

A fingerprint has 64 bits: bit b is set if it is set in over half of the
XXH64 hashes of a text's word 3-shingles. Fingerprints link at 3 or fewer
differing bits; a group is a connected component of links.

Index. The upper nodes are masked bit patterns that fingerprints share: a
pattern (mask, value) holds every fingerprint with ``fp & mask == value``. The
64 bits are cut into five blocks and each pattern fixes two of them, so two
fingerprints at distance 3 or less meet under at least one of the ten masks. A
node of more than ``NODE_MAX`` fingerprints gets children: its free bits are
cut into four, each child fixes one part more, and again two fingerprints at
distance 3 or less meet in at least one child. Hence no node is too large for
a task and no pair is lost. Inside a node the fingerprints are sorted by Gray
rank, runs of neighbours become leaves, and each inner node carries the bits on
which all below it agree. The self-join descends pairs of nodes and drops a
pair as soon as the agreed bits accumulate more than 3 differences.

Scale. Only distinct fingerprints enter the index (ten 24-byte rows for each);
copies of a text never meet. A node passes on a spanning forest of its
links, never all pairs. Components come from star rounds on ids.

Defined results: a null text has no words; a text without words has fingerprint
zero, linked like any other; a text of one or two words is one shingle; rows
that repeat a doc_id are rows of their own; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import cut, staying, table, text_hash, tidied

SHINGLE = 3
SEED = 42
BITS = 64
MAX_DISTANCE = 3
BLOCKS = 5
SHARED = 2
NODE_MAX = 1024
LEAF = 16
FANOUT = 4


def fingerprint(text: bytes | None) -> bytes:
    """The 8 bytes of a text's fingerprint, most significant bit first."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return bytes(8)
    if len(words) < SHINGLE:
        digests = xxhash.xxh64_digest(b" ".join(words), SEED)
    else:
        line = b" ".join(words)
        after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], after[: -SHINGLE])).tolist()
        ends = (after[SHINGLE - 1 :] - 1).tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends)])
    votes = np.zeros(BITS, np.int64)
    each = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    for at in range(0, len(each), 65_280):
        part = np.unpackbits(each[at : at + 65_280], axis=1)
        whole = len(part) // 255 * 255
        votes += np.add.reduce(part[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        votes += part[whole:].sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(each)).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = b"".join(fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column(2).cast(pa.binary()))
        values = np.frombuffer(marks, ">u8").astype(np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(tidied(_fingerprints), "doc_id long, text_hash long, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each 64-bit value in Gray-code order."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index of distinct fingerprints that are sorted by Gray rank.

    ``levels[0]`` are the leaves; a node's pattern is the bits on which all
    fingerprints below it agree.
    """

    def __init__(self, sorted_fps: np.ndarray):
        self.fps = sorted_fps
        agree = np.bitwise_and.reduceat(sorted_fps, np.arange(0, len(sorted_fps), LEAF))
        any_ = np.bitwise_or.reduceat(sorted_fps, np.arange(0, len(sorted_fps), LEAF))
        self.levels = []
        while True:
            self.levels.append((~(agree ^ any_), agree))
            if len(agree) <= FANOUT:
                break
            at = np.arange(0, len(agree), FANOUT)
            agree, any_ = np.bitwise_and.reduceat(agree, at), np.bitwise_or.reduceat(any_, at)

    def links(self, most: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of places (i < j) at a distance of at most ``most``."""
        a, b = np.triu_indices(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            mask, value = self.levels[depth]
            near = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b]) <= most
            a, b = a[near], b[near]
            fan = FANOUT if depth else LEAF
            below = len(self.levels[depth - 1][0]) if depth else len(self.fps)
            i, j = np.divmod(np.arange(fan * fan), fan)
            a = (a[:, None] * fan + i).ravel()
            b = (b[:, None] * fan + j).ravel()
            ok = (a < below) & (b < below) & (a <= b)
            a, b = a[ok], b[ok]
        near = (a < b) & (np.bitwise_count(self.fps[a] ^ self.fps[b]) <= most)
        return a[near], b[near]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for members of components of the graph on 0..n-1 that aren't roots."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            jump = root[root]
            if np.array_equal(jump, root):
                break
            root = jump
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
        if np.array_equal(before, root):
            break
    members = np.flatnonzero(root != np.arange(n))
    return members, root[members]


def _join_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, value, fp), whole nodes together; links as (u, v), a spanning forest of each node."""
    parts = [np.stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns]) for b in batches if b.num_rows]
    if not parts:
        return
    mask, value, fps = np.concatenate(parts, axis=1)
    del parts
    order = np.lexsort((gray_rank(fps), value, mask))
    mask, value, fps = mask[order], value[order], fps[order]
    starts = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))))
    sizes = np.diff(np.append(starts, len(fps)))
    node = np.repeat(np.arange(len(starts)), sizes)
    u, v = [], []
    small = sizes <= LEAF
    for step in range(1, int(sizes[small].max(initial=0))):  # nodes of one leaf: neighbours at each offset, all nodes at once
        at = np.arange(len(fps) - step)
        at = at[(node[at] == node[at + step]) & small[node[at]]]
        at = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= MAX_DISTANCE]
        u.append(fps[at])
        v.append(fps[at + step])
    for k in np.flatnonzero(~small):
        own = fps[starts[k] : starts[k] + sizes[k]]
        member, root = spanning(len(own), *GrayIndex(own).links())
        u.append(own[member])
        v.append(own[root])
    u, v = np.concatenate(u or [fps[:0]]), np.concatenate(v or [fps[:0]])
    if len(u):  # one forest for the task
        names, where = np.unique(np.concatenate((u, v)), return_inverse=True)
        member, root = spanning(len(names), where[: len(u)], where[len(u) :])
        u, v = names[member], names[root]
    for at in range(0, len(u), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(u[at : at + 65_536].view(np.int64)), pa.array(v[at : at + 65_536].view(np.int64))], names=["u", "v"])


def _parts(mask: int, n: int) -> list[int]:
    """The set bits of ``mask`` cut into ``n`` masks of about the same number of bits, in order."""
    bits = [i for i in range(BITS) if mask >> i & 1]
    cuts = [round(k * len(bits) / n) for k in range(n + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def top_masks() -> list[int]:
    blocks = _parts((1 << BITS) - 1, BLOCKS)
    return [sum(c) for c in combinations(blocks, SHARED)]


def _child_masks(mask: int) -> list[int]:
    free = ((1 << BITS) - 1) & ~mask
    return [mask | part for part in _parts(free, MAX_DISTANCE + 1)]


def _under(fps: DataFrame, masks: DataFrame | None) -> DataFrame:
    """Rows (mask, value, fp); without ``masks`` the top nodes, else children of the rows' nodes."""
    if masks is None:
        fps = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in top_masks()])).alias("mask"))
    else:  # a few thousand rows at most: the masks of a level don't depend on the data
        fps = fps.join(F.broadcast(masks), "mask").select("fp", F.col("child").alias("mask"))
    return fps.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fps(fp)`` that join all components."""
    spark = fps.sparkSession
    rows, masks, found = _under(fps, None), top_masks(), []
    while True:
        sizes = rows.groupBy("mask", "value").count()
        large = cut(sizes.where(F.col("count") > NODE_MAX).select("mask", "value"))
        split = not large.isEmpty()
        shared = rows.join(large, ["mask", "value"], "left_anti") if split else rows
        found.append(shared.repartition("mask", "value").mapInArrow(tidied(_join_nodes), "u long, v long"))
        if not split:
            break
        deeper = spark.createDataFrame([(_signed(m), _signed(c)) for m in masks for c in _child_masks(m)], "mask long, child long")
        rows = cut(_under(rows.join(large, ["mask", "value"], "left_semi"), deeper).distinct())
        masks = sorted({c for m in masks for c in _child_masks(m)})
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, text_hash, fp, component_id (smallest doc_id of the component), kept."""
    marked = cut(fingerprints(docs, text, doc_id))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    firsts = cut(marked.groupBy("fp").agg(F.min(row).alias("first")))
    roots = connected_components(links(firsts.select("fp")))
    known = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = known.groupBy("root").agg(F.min("first").alias("lowest"))
    by_fp = known.join(lowest, "root").select("fp", "lowest")
    return marked.join(by_fp, "fp").select("doc_id", "text_hash", "fp", F.col("lowest.doc_id").alias("component_id"), (row == F.col("lowest")).alias("kept"))


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each group one with the smallest doc_id."""
    return staying(docs, near_groups(docs, text, doc_id).where("kept"), text, doc_id)


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    rows = near_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
