"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items go into one automaton of word
sequences; no sequence runs from one item into the next. Each document's words
stream through it while the longest match that ends at each word is tracked: a
match of ``WINDOW`` words or more hits the last ``WINDOW`` of them, and an item
of fewer words is hit where it occurs whole. A document is contaminated if its
hits cover at least 1 / ``COVERAGE`` of its words.

Scale. Documents are read once and never shuffled. The items are cut into shards of
at most ``SHARD_WORDS`` words (an item that is longer has a shard of its
own), one automaton each, which bounds what a worker holds; each shard is
broadcast by itself, and a task's documents pass through one after the other.

Defined results: null texts and null item texts have no words; items without an
``item_id`` are ignored; items that share an id count as one; rows that repeat a
doc_id are rows of their own; with no items nothing is hit; an empty table gives
an empty result.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import latest, table, tidied

WINDOW = 13
COVERAGE = 20
SHARD_WORDS = 500_000

#: A-Z become a-z; ASCII characters other than letters and digits separate words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


WORD = re.compile(rb"[^ \t-\r]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton over word sequences.

    ``full[v]`` is the state of the last ``WINDOW`` words of state v's strings
    (-1 if those are shorter), ``items_at`` the items that have that window;
    ``ends[v]`` holds (length, item) of the whole short items that end at v, and
    ``next_end[v]`` the nearest state up the suffix links that has any.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.go: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.full = [-1] * len(order)
        for v in order[1:]:
            up = self.link[v]
            if self.length[v] >= window:
                self.full[v] = self.full[up] if self.length[up] >= window else v
        self.items_at: dict[int, set[str]] = {}
        self.ends: dict[int, set[tuple[int, str]]] = {}
        for item, words in items:
            v = 0
            if len(words) < window:
                for w in words:
                    v = self.go[v][w]
                if words:
                    self.ends.setdefault(v, set()).add((len(words), item))
                continue
            for end, v, n in self.stream(words):
                if n >= window:
                    self.items_at.setdefault(self.full[v], set()).add(item)
        self.next_end = [-1] * len(order)
        for v in order:
            self.next_end[v] = v if v in self.ends else self.next_end[self.link[v]] if v else -1
        self.short = bool(self.ends)

    def _extend(self, last: int, w: bytes) -> int:
        go, link, length = self.go, self.link, self.length
        if w in go[last]:
            q = go[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(length)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in go[p]:
            go[p][w] = new
            p = link[p]
        if p != -1:
            q = go[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: bytes, q: int) -> int:
        go, link, length = self.go, self.link, self.length
        copy = len(length)
        go.append(dict(go[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and go[p].get(w) == q:
            go[p][w] = copy
            p = link[p]
        return copy

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, longest matching length) at each word where some sequence matches."""
        go, link, length = self.go, self.link, self.length
        root = go[0]
        v = n = 0
        for at, w in enumerate(words):
            if v == 0:
                v = root.get(w, 0)
                if v == 0:
                    continue
                n = 1
            else:
                to = go[v].get(w)
                while to is None and v:
                    v = link[v]
                    n = length[v]
                    to = go[v].get(w)
                if to is None:
                    continue
                v = to
                n += 1
            yield at, v, n

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (start, end) of ``words`` that are hit, merged and in order, and the items that hit them."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        window, full, next_end, ends, link = self.window, self.full, self.next_end, self.ends, self.link
        for at, v, n in self.stream(words):
            most = 0
            if n >= window:
                most = window
                items |= self.items_at[full[v]]
            if self.short:
                e = next_end[v]
                while e > 0:
                    for size, item in ends[e]:
                        if size <= n:
                            items.add(item)
                            most = max(most, size)
                    e = next_end[link[e]]
            if most:
                start = at + 1 - most
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at + 1))
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _shards(items: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    shard: list[tuple[str, list[bytes]]] = []
    n = 0
    for row in items.toLocalIterator():
        words = words_of(row.text.encode() if row.text is not None else None)
        if row.item_id is None or not words:
            continue
        if shard and n + len(words) > SHARD_WORDS:
            yield shard
            shard, n = [], 0
        shard.append((row.item_id, words))
        n += len(words)
    if shard:
        yield shard


def _finder(docs: DataFrame, benchmark: DataFrame):
    """A function for executors: for batches and the place of their text column it gives each batch with (n_words, spans, items) of its rows."""
    context = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    shards = [context.broadcast(pickle.dumps(s)) for s in _shards(items)]
    call = uuid.uuid4().hex

    def find(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list, list]]]]:
        # With several shards a task's batches, which the size of an input split bounds, wait for all of them.
        for group in ([b] for b in batches) if len(shards) <= 1 else [list(batches)]:
            words = [[words_of(t.as_buffer().to_pybytes() if t.is_valid else None) for t in b.column(at).cast(pa.binary())] for b in group]
            found: list[list[tuple[list, set]]] = [[([], set()) for _ in ws] for ws in words]
            for k, shard in enumerate(shards):
                automaton = latest("automaton", (call, k), lambda shard=shard: Automaton(pickle.loads(shard.value)))
                for rows, ws in zip(found, words):
                    for i, w in enumerate(ws):
                        spans, hit = automaton.hits(w)
                        if spans:
                            rows[i] = (merged(rows[i][0] + spans) if k else spans, rows[i][1] | hit)
            for batch, rows, ws in zip(group, found, words):
                yield batch, [(len(w), spans, sorted(hit)) for w, (spans, hit) in zip(ws, rows)]

    return find


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, spans (hit words: start, end), items (ids, sorted as strings)."""
    find = _finder(docs, benchmark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch, found in find(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in found], span),
                    pa.array([h for _, _, h in found], pa.list_(pa.string())),
                ],
                names=["doc_id", "n_words", "spans", "items"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidied(scan), f"doc_id {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each span of words."""
    at = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    edges = [0, *(x for a, b in spans for x in (at[a][0], at[b - 1][1])), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents") -> DataFrame:
    """``docs`` with all columns, without contaminated rows, or with ``remove="spans"`` without the words that are hit in these.

    Rows that aren't contaminated stay unchanged.
    """
    find, at = _finder(docs, benchmark), docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in find(batches, at):
            hit = [(sum(b - a for a, b in spans), n) for n, spans, _ in found]
            gone = [h > 0 and COVERAGE * h >= n for h, n in hit]
            if remove == "documents":
                yield batch.filter(pa.array([not g for g in gone], pa.bool_()))
                continue
            texts = [_without(t.encode(), spans).decode() if g else t for g, t, (_, spans, _) in zip(gone, batch.column(at).to_pylist(), found)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(tidied(clean), docs.schema)


def judged(found: DataFrame) -> DataFrame:
    """``contamination``'s rows with n_hit and contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (COVERAGE * F.col("n_hit") >= F.col("n_words")))


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = judged(contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (k, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
