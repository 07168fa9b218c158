"""Substring dedup by seed and extend, over words.

Seeds are winnowed anchors: k-grams of ``GRAM`` words, one at least in each window
of ``SIZE`` words. Documents are joined on them: a block (an anchor and all windows
that it stands for) is seeded with the first block that is equal to it; of blocks of one
anchor that differ, each window is seeded with the block of the smallest doc_id that has it.
Adjoining seeds with the same partner at the same distance are chained into one. A seed is
then extended from its anchors both ways, comparing words, over all that its partner's
chain holds; a stretch of ``SIZE`` equal words or more is a maximal repeat, and its words are removed.

Hashes only find partners: nothing is removed whose words weren't compared with those of
a smaller doc_id.

Scale. What is shuffled first is one small row for each anchor that occurs twice or more (about one in 19
words); windows are expanded only around anchors that different blocks share. All
groups are reduced to their smallest doc_id with partial aggregation, so that no
group is gathered anywhere, and each block or window has one partner; joins on anchors and partners may be split where
keys are hot. A partner's words are read once for each distinct chain, then travel with each match, so that what is
shuffled grows with what is removed. Of the texts only those are shuffled that have windows to expand, words to lend or words to remove.

Defined results: a null text has no words; a null doc_id comes after all others,
and such rows don't remove from each other, nor do rows that share a doc_id; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anchors import Words
from .repeats import PLACE, chosen, classes, completed, numbered, sliced, texts_of
from .rolling import digests
from .runtime import split_join, stored, table

SIZE = 50
GRAM = 14


def begin(place: Column) -> Column:
    return F.shiftright(place, 16)  # a place is (start * PLACE + lead) * PLACE + windows


def lead(place: Column) -> Column:
    return F.shiftright(place, 8) % PLACE


def window_hashes(rows: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """(anchor, window, did, th, place): an XXH64 of each window of each of ``blocks``."""
    listed = blocks.groupBy("did", "th").agg(F.collect_list(F.struct("anchor", "place")).alias("blocks"))
    joined = chosen(rows, blocks).join(listed, ["did", "th"]).select("did", "th", "text", "blocks")
    names = ["anchor", "window", "did", "th", "place"]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bounds = batch.column(3).offsets.to_numpy()
            entries = [c.to_numpy() for c in batch.column(3).values.flatten()]
            for a, b in sliced(texts):
                words = Words(texts[a:b])
                anchor, place = (c[bounds[a] : bounds[b]] for c in entries)
                text = np.repeat(np.arange(a, b), np.diff(bounds[a : b + 1]))
                n = place % PLACE
                each = np.repeat(np.arange(len(n)), n)
                here = words.start[text - a][each] + (place // PLACE**2)[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                hashes = digests(words.units, here, here + size, np.zeros(len(here), np.int64)).view(np.int64)
                columns = [anchor[each], hashes, did[text[each]], th[text[each]], place[each]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return joined.mapInArrow(expand, ", ".join(f"{n} long" for n in names))


def seeds(rows: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(did, th, place, partner): blocks of documents of ``numbered`` rows, and blocks of a smaller did that share a window with them."""
    members, firsts = classes(rows, Words, size, gram, leads=True)
    own = ["did", "th", "place"]
    whole = members.where("did > first.did").withColumnRenamed("first", "partner").select(*own, "partner")
    # Further members within the first's own document are compared like the first.
    partly = stored(firsts.select("anchor", *own).union(members.where("did = first.did").select("anchor", *own)))
    windows = window_hashes(rows, partly, size)
    lowest = windows.groupBy("anchor", "window").agg(F.min(F.struct(*own)).alias("partner"), F.max("did").alias("last")).where("partner.did < last").drop("last")
    single = split_join(windows, lowest, ["anchor", "window"]).where("did > partner.did").select(*own, "partner")
    return whole.union(single.distinct())


def chains(found: DataFrame, size: int) -> DataFrame:
    """(did, th, at, partner_did, partner_th, begin, end): runs of ``seeds`` with one partner and distance.

    The partner's words from begin to end are compared with the document's from ``at`` on.
    """
    partner = [F.col(f"partner.{c}").alias(f"partner_{c}") for c in ("did", "th")]
    first = begin(F.col("partner.place"))
    shift = begin(F.col("place")) + lead(F.col("place")) - first - lead(F.col("partner.place"))
    spans = found.select("did", "th", shift.alias("shift"), *partner, first.alias("begin"), (first + F.col("partner.place") % PLACE - 1 + size).alias("end"))
    key = ["did", "th", "partner_did", "partner_th", "shift"]
    along = Window.partitionBy(*key).orderBy("begin", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    cuts = spans.withColumn("new", F.when(F.col("begin") <= reach, 0).otherwise(1)).withColumn("chain", F.sum("new").over(along))
    merged = cuts.groupBy(*key, "chain").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return merged.select("did", "th", (F.col("begin") + F.col("shift")).alias("at"), "partner_did", "partner_th", "begin", "end")


def partners(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(partner_did, partner_th, begin, end, words): the words that chains refer to, joined by one space, once for each span."""
    spans = found.select(F.col("partner_did").alias("did"), F.col("partner_th").alias("th"), "begin", "end").distinct()
    listed = spans.groupBy("did", "th").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    names = ["partner_did", "partner_th", "begin", "end", "words"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, th, t, spans in zip(*(c.to_pylist() for c in batch.columns[:2]), texts_of(batch.column(2)), batch.column(3).to_pylist()):
                words = t.split()
                for at in range(0, len(spans), 1000):
                    some = spans[at : at + 1000]
                    columns = [[did] * len(some), [th] * len(some), [s["begin"] for s in some], [s["end"] for s in some]]
                    texts = [b" ".join(words[s["begin"] : s["end"]]) for s in some]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(texts, pa.binary())], names=names)

    joined = chosen(rows, spans).join(listed, ["did", "th"]).select("did", "th", "text", "spans")
    read_once = joined.mapInArrow(read, "partner_did long, partner_th long, begin long, end long, words binary")
    return read_once.dropDuplicates(names[:4]) if not rows.where("th not in (0, 1)").isEmpty() else read_once


def matches(rows: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(did, th, matches): per document the chains' places and their partners' words."""
    found = stored(chains(seeds(rows, size, gram), size))
    joined = split_join(found, partners(rows, found), ["partner_did", "partner_th", "begin", "end"])
    return joined.groupBy("did", "th").agg(F.collect_list(F.struct("at", "words")).alias("matches"))


def repeats(words: list[bytes], at: int, partner: list[bytes], size: int) -> list[tuple[int, int]]:
    """Stretches of ``size`` words or more that equal the partner's, whose first word stands beside ``words[at]``."""
    if at >= 0 and words[at : at + len(partner)] == partner:
        return [(at, at + len(partner))] if len(partner) >= size else []
    out, begin = [], None
    for i in range(max(at, 0), min(at + len(partner), len(words)) + 1):
        same = i < min(at + len(partner), len(words)) and words[i] == partner[i - at]
        if same and begin is None:
            begin = i
        elif not same and begin is not None:
            if i - begin >= size:
                out.append((begin, i))
            begin = None
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans put together where they meet, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def substring_dedup(docs: DataFrame, size: int = SIZE, text: str = "text", doc_id: str = "doc_id", gram: int = GRAM, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (removed words: start, end), kept_sha256, and the kept text if asked for.

    The kept text has its words joined by one space.
    """
    rows = numbered(docs, text, doc_id)
    found = matches(rows, size, gram)
    names = ["doc_id", "n_words", "n_removed", "spans", "kept_sha256", *(["kept"] if texts else [])]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, own in zip(texts_of(batch.column(1)), batch.column(2)):
                words = t.split()
                spans = merged([s for m in own.as_py() or () for s in repeats(words, m["at"], m["words"].split(), size)])
                edges = [0, *(x for s in spans for x in s), len(words)]
                kept = b" ".join([w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]])
                row = (len(words), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode()) if texts else row)
            columns = list(zip(*out)) or [()] * (len(names) - 1)
            kinds = [pa.int64(), pa.int64(), span, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string"
    return completed(rows, stored(found), remove, schema + (", kept string" if texts else ""))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), texts=False)
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = """
WITH d AS (
  SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50
), h AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM s
), m AS (
  SELECT k, min(doc_id) AS low FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)
), r AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM h JOIN m USING (k) WHERE doc_id > low GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [x for x, i in w if NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
