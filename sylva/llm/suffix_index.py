"""Suffix-array dedup by a run-length index, over bytes.

A byte is removed if it lies in a string of ``SIZE`` bytes that also starts earlier: in
a document with a smaller doc_id, or earlier in its own.

Index. A shard's texts, each with an end of its own, are sorted by suffix and give their
Burrows-Wheeler transform, which is kept as runs: each run's symbol and length and, sampled at the run's head,
the suffix there, the suffix before it in order, and the length that the two
have in common. The suffix array itself isn't kept. The texts are streamed through the transform
from their ends, all of a shard side by side: a run's symbol and the number of that symbol in earlier runs
take a place's row to the row of the place before it. Walking the text from one sampled place to the next,
each step lowers the sampled length by one and moves both places on; these are the
matching statistics, the longest match of each place with its neighbour in
suffix order, and the neighbour. Rows in a row whose statistics reach ``SIZE`` have one string;
all its places but the first in text order are marked.

Shards. Which strings can be equal is settled by winnowed anchors, of which each
string has one that its bytes fix: equal strings meet under one anchor. The
corpus is repetitive, so equal blocks of an anchor (equal in anchor and XXH64) are run-compressed first: of
a class only its first member is indexed. The others are chained with it where they adjoin, and what
the first's document has there is compared with the member's bytes: nothing is removed by a hash. Should blocks of one
class differ, only stretches of ``SIZE`` bytes that equal the first's are removed of them.
Shards are ranges of anchors of about ``SHARD_BYTES``. An anchor with more than
``SHARD_BLOCKS`` distinct blocks is divided further: its strings get anchors again, by the next larger gram, under which blocks are
classed, by their bytes, and indexed in the same way. The largest gram is the string itself, so this ends.

Scale. First shuffled is a small row for each anchor that occurs twice or
more (those that don't are filtered by a bitmap of bounded size), then the
blocks of anchors with several classes, then the bytes that members are compared with, each stretch once for each document that
repeats it. Of the texts only those are shuffled that have bytes to lend or to remove. A task holds a shard at a time, and a shard
at most one anchor of ``SHARD_BLOCKS`` blocks more than ``SHARD_BYTES``.

Defined results: a null text is empty; a null doc_id comes after all others; rows that
share a doc_id are ordered by a hash of their texts, and rows that are equal
in both don't remove from each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Bytes, winnow
from .repeats import PLACE, bitmap, chosen, classes, classes_of, completed, in_bitmap, numbered, sliced, texts_of
from .rolling import digests, mixed
from .runtime import split_join, stored, table
from .substring_dedup import chains, merged

SIZE = 100
GRAM = 24
SHARD_BYTES = 1 << 17  # so that an index's arrays stay in a core's cache
SHARD_BLOCKS = 4096
PACK = 16  # symbols that are sorted by at first, at most
WORD = 8  # bytes that are compared at once


class RunIndex:
    """Run-length index of the concatenation of ``texts``, each of which ends with its own separator."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes + 1) - 1  # places of separators
        self.starts = self.ends - sizes
        data = np.frombuffer(b"\0".join(texts) + b"\0" * WORD, np.uint8)
        n = self.length = int(self.ends[-1]) + 1 if len(texts) else 0
        symbols = data[:n].astype(np.uint16) + np.uint16(1)
        symbols[self.ends] = 0
        left = np.repeat(self.ends, sizes + 1) - np.arange(n)  # how many symbols there are up to the separator
        suffixes = self._sort(symbols, left)
        self._sample(suffixes, np.concatenate((symbols[n - 1 :], symbols[: max(n - 1, 0)]))[suffixes], data, left)

    def _sort(self, symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The suffix array, by doubling; separators count as different, in order."""
        n = self.length
        used = np.bincount(symbols, minlength=257) > 0
        codes = (np.cumsum(used) - used[0]).astype(np.int64)  # from 1, in order; 0 for separators
        codes[0] = 0
        base, room = int(codes[-1]) + 1, (1 << 63 - n.bit_length()) - 1
        here, key, reach, most = codes[symbols], np.zeros(n, np.int64), 0, 1
        while most * base <= room and reach < PACK:  # nothing counts beyond a separator
            key *= base
            key[: n - reach] += np.where(left[: n - reach] >= reach, here[reach:], 0)
            reach, most = reach + 1, most * base
        while True:
            order, ordered = _ordered(key)
            new = np.cumsum(ordered[1:] != ordered[:-1])
            if reach > left.max(initial=0) or n and (new[-1] if n > 1 else 0) == n - 1:
                return order
            rank = np.zeros(n, np.int64)
            rank[order[1:]] = new
            key = rank * (n + 1)
            key[: n - reach] += np.where(left[: n - reach] >= reach, rank[reach:] + 1, 0)
            reach *= 2

    def _sample(self, suffixes: np.ndarray, transform: np.ndarray, data: np.ndarray, left: np.ndarray) -> None:
        """Keep the transform's runs, and what is known at the head of each, in text order."""
        head = np.flatnonzero(np.concatenate(([True], (transform[1:] != transform[:-1]) | (transform[1:] == 0)))) if len(transform) else transform
        self.symbols, self.sizes = transform[head], np.diff(np.append(head, len(transform)))
        place = suffixes[head]
        neighbour = np.where(head > 0, suffixes[head - 1], -1) if len(head) else place
        common = np.zeros(len(head), np.int64)
        some = np.flatnonzero(neighbour >= 0)
        common[some] = _common(data, place[some], neighbour[some], np.minimum(left[place[some]], left[neighbour[some]]))
        order, self.places = _ordered(place)
        self.neighbours, self.common = neighbour[order], common[order]

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the text the place before it in suffix order, and the length the two have in common."""
        steps = np.diff(np.append(self.places, self.length))
        walked = np.arange(self.length) - np.repeat(self.places, steps)
        return np.repeat(self.neighbours, steps) + walked, np.maximum(0, np.repeat(self.common, steps) - walked)

    def rows(self) -> np.ndarray:
        """The row of each place in suffix order, by steps over the runs from each text's end backwards."""
        order = np.argsort(self.symbols, kind="stable")
        earlier = np.empty(len(order), np.int64)  # of all symbols that sort before a run's, and of its own in earlier runs
        earlier[order] = np.cumsum(self.sizes[order]) - self.sizes[order]
        step = np.repeat(earlier - (np.cumsum(self.sizes) - self.sizes), self.sizes)
        row = np.empty(self.length, np.int64)
        place, here = self.ends.copy(), np.arange(len(self.ends))  # ends sort first, in order
        left = place - self.starts
        while True:
            row[place] = here
            on = np.flatnonzero(left > 0)
            if not len(on):
                return row
            here, place, left = here[on], place[on] - 1, left[on] - 1
            here += step[here]

    def repeated(self, size: int) -> np.ndarray:
        """The places, in order, whose string of ``size`` symbols also starts at a smaller place."""
        common = self.matching_statistics()[1]
        if not np.any(common >= size):
            return np.zeros(0, np.int64)
        place = np.empty(self.length, np.int64)
        place[self.rows()] = np.arange(self.length)
        head = np.flatnonzero(common[place] < size)
        first = np.repeat(np.minimum.reduceat(place, head), np.diff(np.append(head, self.length)))
        return np.sort(place[place != first])


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of values from 0 in order of value, then place, and the values in that order."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)) >> 63 - bits:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = key << bits | np.arange(len(key))  # values sort several times as fast as places by value
    both.sort()
    return both & (1 << bits) - 1, both >> bits


def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes are equal from ``a`` and ``b`` on, up to ``most``; ``WORD`` bytes follow the last."""
    words = np.lib.stride_tricks.as_strided(data[:WORD].view("<u8"), (len(data) - WORD + 1,), (1,))
    out = np.zeros(len(a), np.int64)
    active = np.flatnonzero(most > 0)
    while len(active):
        differ = words[a[active] + out[active]] ^ words[b[active] + out[active]]
        out[active] += np.bitwise_count((differ & -differ) - np.uint64(1)) >> 3  # bytes below the lowest bit that differs
        active = active[(differ == 0) & (out[active] < most[active])]
    return np.minimum(out, most)


def _block_keys(anchor: np.ndarray, did: np.ndarray, th: np.ndarray, place: np.ndarray) -> np.ndarray:
    out = anchor.view(np.uint64)
    for column in (did, th, place):
        out = mixed(out + column.view(np.uint64))
    return out


def _blocks(rows: DataFrame, places: DataFrame, size: int, gram: int) -> DataFrame:
    """(anchor, did, th, place, data): the blocks of ``places``, and by a bitmap's collisions a few others that equal some of them.

    They are read where the texts lie: a bitmap of bounded size says which of a text's blocks are asked for.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_block_keys(*(c.to_numpy() for c in batch.columns)).view(np.int64))], names=["key"])

    keys = places.select("anchor", "did", "th", "place").mapInArrow(hashed, "key long")
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(keys, "key"))
    names = ["anchor", "did", "th", "place", "data"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in sliced(texts):
                parts = Bytes(texts[a:b])
                found = winnow(parts, size, gram)
                text, start = found["text"], found["begin"] - parts.start[found["text"]]
                columns = [found["anchor"].view(np.int64), did[text + a], th[text + a], start * PLACE + found["windows"]]
                ok = np.flatnonzero(in_bitmap(shared.value, _block_keys(*columns)))
                end = start + found["windows"] - 1 + size
                data = [texts[a + t][i:j] for t, i, j in zip(text[ok].tolist(), start[ok].tolist(), end[ok].tolist())]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[ok]) for c in columns), pa.array(data, pa.binary())], names=names)

    return rows.select("did", "th", "text").mapInArrow(read, "anchor long, did long, th long, place long, data binary")


def _marked(did: np.ndarray, th: np.ndarray, place: np.ndarray, data: list[bytes], size: int) -> pa.RecordBatch:
    """Runs of repeated strings of one shard's blocks, as (did, th, place)."""
    order = np.lexsort((place, th, did))
    did, th, place = did[order], th[order], place[order]
    index = RunIndex([data[i] for i in order])
    at = index.repeated(size)
    block = np.searchsorted(index.ends, at)
    start = place[block] // PLACE + at - index.starts[block]
    head = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else at
    runs = np.diff(np.append(head, len(at)))
    columns = (did[block[head]], th[block[head]], start[head] * PLACE + runs)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["did", "th", "place"])


def _index_shards(blocks: DataFrame, size: int) -> DataFrame:
    """(did, th, place) of repeated strings within ``blocks``, by run-length indexes over whole anchors."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total = 0
        for batch in batches:
            anchor = batch.column(0).to_numpy()
            edge = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]))
            for a, b in zip(edge, edge[1:]):
                part = batch.slice(a, b - a)
                if held and total >= SHARD_BYTES and held[-1].column(0)[-1] != part.column(0)[0]:
                    yield shard(held)
                    held, total = [], 0
                held.append(part)
                total += part.column(4).nbytes
        if held:
            yield shard(held)

    def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        return _marked(*(rows.column(k).to_numpy() for k in (1, 2, 3)), rows.column(4).to_pylist(), size)

    by_anchor = blocks.repartition("anchor").sortWithinPartitions("anchor")
    return by_anchor.mapInArrow(index, "did long, th long, place long")


def _divided(blocks: DataFrame, size: int, gram: int) -> DataFrame:
    """(anchor, did, th, place, data): the strings of ``blocks`` by their anchors of ``gram`` bytes, within each anchor of before."""
    names = ["anchor", "did", "th", "place", "data"]

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = texts_of(batch.column(4))
            parts = Bytes(data)
            found = winnow(parts, size, gram)
            text, begin, windows = found["text"], found["begin"], found["windows"]
            end = begin + windows - 1 + size
            before, did, th, place = (batch.column(k).to_numpy()[text] for k in range(4))
            anchor = digests(found["anchor"].view(np.uint8), np.arange(len(text)) * 8, np.arange(len(text)) * 8 + 8, before.view(np.uint64))
            low, high = begin - parts.start[text], end - parts.start[text]
            columns = [anchor.view(np.int64), did, th, (place // PLACE + low) * PLACE + windows]
            pieces = [data[t][a:b] for t, a, b in zip(text.tolist(), low.tolist(), high.tolist())]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(pieces, pa.binary())], names=names)

    return blocks.mapInArrow(divide, "anchor long, did long, th long, place long, data binary")


def _lent(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(partner_did, partner_th, begin, end, data): the bytes of each of ``spans``, of other documents."""
    listed = spans.groupBy(F.col("partner_did").alias("did"), F.col("partner_th").alias("th")).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    names = ["partner_did", "partner_th", "begin", "end", "data"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, t in enumerate(texts_of(batch.column(2))):
                spans = batch.column(3)[i].as_py()
                for at in range(0, len(spans), 1000):
                    some = spans[at : at + 1000]
                    columns = [[did[i]] * len(some), [th[i]] * len(some), [s["begin"] for s in some], [s["end"] for s in some]]
                    pieces = [t[s["begin"] : s["end"]] for s in some]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(pieces, pa.binary())], names=names)

    joined = chosen(rows, listed).join(listed, ["did", "th"]).select("did", "th", "text", "spans")
    return joined.mapInArrow(read, "partner_did long, partner_th long, begin long, end long, data binary")


def _compared(rows: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(did, th, match): what the members' documents are to be compared with; ``match.data`` is null if it is in the document itself.

    ``match.at`` lists the places whose bytes should equal those of the first members from ``match.begin`` to ``match.end``.
    """
    wide = lambda place: F.shiftleft(F.shiftright(place, 8), 16) + place % PLACE
    partner = F.struct("first.did", "first.th", wide(F.col("first.place")).alias("place")).alias("partner")
    found = chains(members.select("did", "th", wide(F.col("place")).alias("place"), partner), size)
    span = ["partner_did", "partner_th", "begin", "end"]
    found = stored(found.groupBy("did", "th", *span).agg(F.collect_list("at").alias("at")))
    own = (F.col("did") == F.col("partner_did")) & (F.col("th") == F.col("partner_th"))
    others = found.where(~own)
    lent = split_join(others, _lent(rows, others.select(*span).distinct()), span)
    matches = lent.unionByName(found.where(own).withColumn("data", F.lit(None).cast("binary")))
    return matches.select("did", "th", F.struct("at", "begin", "end", "data").alias("match"))


def repeated_strings(rows: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(did, th, place, match): strings of ``numbered`` rows that also start earlier, as runs of places or as matches to be compared (:func:`_compared`)."""
    members, firsts = classes(rows, Bytes, size, gram)
    firsts = stored(firsts)
    if not rows.where("th not in (0, 1)").isEmpty():  # rows equal in both have one block of each place; th is 0 or 1 where no ids are repeated
        rows = rows.dropDuplicates(["did", "th"])
    matches = _compared(rows, members, size)
    found = _index_shards(_blocks(rows, firsts.where(F.col("classes") <= SHARD_BLOCKS), size, gram), size)
    hot = firsts.where(F.col("classes") > SHARD_BLOCKS)
    blocks = None if hot.isEmpty() else stored(_blocks(rows, hot, size, gram))
    while blocks is not None:
        gram = min(size, 2 * gram)
        members, firsts = classes_of(stored(_divided(blocks, size, gram)), "data")
        firsts = stored(firsts)
        found = found.union(members.select("did", "th", "place"))
        shard = ["anchor", "did", "th", "place", "data"]
        small = F.lit(gram == size) | (F.col("classes") <= SHARD_BLOCKS)
        found = found.union(_index_shards(firsts.where(small).select(*shard), size))
        hot = firsts.where(~small).select(*shard)
        blocks = None if hot.isEmpty() else stored(hot)
    return found.unionByName(matches, allowMissingColumns=True)


def _equal(text: np.ndarray, match: dict, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of ``size`` bytes or more of ``text`` that equal those of a match."""
    begin, end, data = match["begin"], match["end"], match["data"]
    other = text[begin:end] if data is None else np.frombuffer(data, np.uint8)
    for at in match["at"]:
        here = text[at : at + len(other)]
        if np.array_equal(here, other):
            yield at, at + len(here)
            continue
        same = here == other[: len(here)]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        yield from ((at + a, at + b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= size)


def suffix_dedup(docs: DataFrame, size: int = SIZE, text: str = "text", doc_id: str = "doc_id", gram: int = GRAM, data: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (removed bytes: start, end), kept_sha256, and the kept bytes if asked for."""
    rows = numbered(docs, text, doc_id)
    runs = F.struct(F.collect_list("place").alias("places"), F.collect_list("match").alias("matches"))
    found = repeated_strings(rows, size, gram).groupBy("did", "th").agg(runs.alias("runs"))
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", *(["kept"] if data else [])]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, runs in zip(texts_of(batch.column(1)), batch.column(2)):
                spans: list[tuple[int, int]] = []
                if runs.is_valid:
                    start, n = np.divmod(runs["places"].values.to_numpy(), PLACE)
                    stretches = list(zip(start.tolist(), (start + n - 1 + size).tolist()))
                    here = np.frombuffer(t, np.uint8)
                    stretches += [s for m in runs["matches"] for s in _equal(here, m.as_py(), size)]
                    spans = merged(stretches)
                edges = [0, *(x for s in spans for x in s), len(t)]
                kept = b"".join([t[a:b] for a, b in zip(edges[::2], edges[1::2])])
                row = (len(t), len(t) - len(kept), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if data else row)
            columns = list(zip(*out)) or [()] * (len(names) - 1)
            kinds = [pa.int64(), pa.int64(), span, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string"
    return completed(rows, stored(found), remove, schema + (", kept binary" if data else ""))


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    done = suffix_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), data=False)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS head FROM r),
q AS (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM g),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM q GROUP BY doc_id, q),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS stop, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, 2 * stop + 1), h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
