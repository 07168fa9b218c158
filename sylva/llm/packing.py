"""Best-fit packing of tokenised documents: distributed ranking and placing, sizes matched on the driver.

A document is its token ids and a closing id 0. One longer than ``CAPACITY``
is cut into pieces of ``CAPACITY`` tokens, the first of which may be shorter.
Pieces are packed, largest first, each into the sequence with the smallest gap
that holds it.

Pieces are range-sorted by length. Sizes are whole numbers up to ``CAPACITY``,
so equal pieces and equal gaps form runs, and one loop on the driver matches runs,
not rows: it sweeps from the largest size down, takes the successor gap, the
smallest that fits, gives the run's pieces by rank to the gap's sequences by
rank, and moves those sequences to their new gap; the next size starts from
the updated gaps. Piece ranks come from the sorted partitions: counts by
partition and size, running sums over partitions, and the place within the
partition.

Scale. The documents are read once. What reaches the driver is one count for
each size (``CAPACITY`` rows at most) and what goes back is the list of matched
runs, whose length is bounded by the pairs of sizes and gaps, not by the rows.
A size that a third of all pieces have is split by the sort over many
partitions.

Defined results: a null or empty text is the closing id alone; rows that repeat
are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, table, tidied
from .tokens import token_ids

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter than ``capacity``."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, ranks: str | None = RANKS, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ids if asked for."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc, ids = [], array("i"), array("q"), array("q"), array("q"), []
            for i, t in enumerate(batch.column(1)):
                found = token_ids(t.as_py(), vocabulary, ranks)
                found.append(END_ID)
                data = memoryview(found.tobytes())
                for k, (a, n) in enumerate(cuts(len(found), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(data[4 * a : 4 * (a + n)]))
                    if with_ids:
                        ids.append(np.frombuffer(data[4 * a : 4 * (a + n)], np.uint32).astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(np.asarray(x)) for x in (piece, start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(tidied(encode), schema + (", ids array<int>" if with_ids else ""))


def match_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit over runs of equal sizes: (size, first rank, pieces, first sequence, offset).

    The pieces with ranks first..first+pieces-1 of a size go to as many
    consecutive sequences, at ``offset`` in each.
    """
    out: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # in order
    runs: dict[int, deque[tuple[int, int]]] = {}  # gap: runs of sequences (first, how many)
    opened = 0

    def give(gap: int, first: int, n: int) -> None:
        if not gap or not n:
            return
        if gap not in runs:
            insort(gaps, gap)
            runs[gap] = deque()
        if runs[gap] and sum(runs[gap][-1]) == first:
            start, before = runs[gap].pop()
            first, n = start, before + n
        runs[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(gaps, size)
            if at == len(gaps):  # no gap holds it: new sequences
                each = capacity // size
                give(capacity, opened, n := -(-left // each))
                opened += n
                continue
            gap = gaps[at]
            first, n = runs[gap].popleft()
            if not runs[gap]:
                del runs[gap], gaps[at]
            each = min(gap // size, left)
            full = min(n, left // each)
            for level in range(each):
                out.append((size, rank, full, first, capacity - gap + level * size))
                rank += full
            left -= each * full
            give(gap - each * size, first, full)
            give(gap, first + full, n - full)
    return out


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    at_length = found.columns.index("length")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            sizes = batch.column(at_length).to_numpy()
            order = np.argsort(sizes, kind="stable")
            ordered = sizes[order]
            starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
            n = np.diff(np.append(starts, len(ordered)))
            place = np.empty(len(ordered), np.int64)
            place[order] = np.arange(len(ordered)) - np.repeat(starts, n) + seen[ordered]
            seen[ordered[starts]] += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ordered), here, np.int32)), pa.array(place)], names=[*batch.schema.names, "part", "place"])

    found = cut(found)  # the sort's sampling pass would encode the texts once more
    by_size = found.repartitionByRange(F.col("length").desc(), "doc_id", "piece", "ids_crc32").sortWithinPartitions(F.col("length").desc(), "doc_id", "piece", "ids_crc32")
    rows = cut(by_size.mapInArrow(tidied(ranked), f"{schema}, part int, place long"))
    counts = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    totals = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each size
    matched = np.array(sorted(match_runs(totals, capacity)), np.int64).reshape(-1, 5)
    shared = found.sparkSession.sparkContext.broadcast(matched)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matched = shared.value
        wide = np.int64(1) << np.int64(48)
        keys = matched[:, 0] * wide + matched[:, 1]
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy()
            k = np.searchsorted(keys, batch.column(at_length).to_numpy() * wide + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(matched[k, 3] + rank - matched[k, 1]), pa.array(matched[k, 4])],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    with_rank = rows.join(offsets, ["length", "part"]).select(*found.columns, (F.col("earlier") + F.col("place")).alias("rank"))
    return with_rank.mapInArrow(tidied(placed), f"{schema}, sequence_id long, offset long")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents", "doc_id", "text")))
