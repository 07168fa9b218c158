"""Finding the repeated windows of a corpus by shared anchors.

Both repeat operators take the same way. Each text's windows are grouped into
blocks by their winnowed anchors (:mod:`.anchors`). Anchors that occur once have
no repeated window. Blocks that agree in anchor and XXH64 form classes: each member but
the first is repeated whole. What is left is the first members of anchors with several
classes, whose windows may equal each other in part; the operators compare
these by their own methods. The anchors that remain are stored once and read by both steps.

Anchors that occur once are kept out early by a bitmap of ``FILTER_BITS`` bits, which
is all that is broadcast; what passes it wrongly falls out later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import anchors
from .rolling import digests
from .runtime import split_join, stored

FILTER_BITS = 1 << 27
SLICE_BYTES = 1 << 18  # so that a slice's arrays stay in a core's cache
LAST_ID = (1 << 63) - 1
PLACE = 256  # a place is start * PLACE + windows, of at most PLACE - 1 windows


def numbered(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(did, th, text): the id to order by, a number that tells rows of one id apart, and the text.

    Null ids come last, as the largest long; they have an odd ``th``, others an even one, which is
    the rest of a hash of the text where rows share an id.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("own"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    did, none = F.coalesce("own", F.lit(LAST_ID)), F.col("own").isNull().cast("long")
    unique = rows.groupBy(did.alias("did")).count().where("count > 1").isEmpty()
    rest = F.lit(0).cast("long") if unique else F.shiftleft(F.xxhash64("text"), 1)
    return rows.select(did.alias("did"), (rest + none).alias("th"), "text")


def own_id() -> Column:
    """The doc_id of a row of ``numbered``."""
    return F.when((F.col("did") != LAST_ID) | (F.col("th") % 2 == 0), F.col("did")).alias("doc_id")


def texts_of(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() for t in column.cast(pa.binary())]


def sliced(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts that are worked on together, of about ``SLICE_BYTES``."""
    return iter(anchors.slices(np.fromiter(map(len, texts), np.int64, len(texts)), SLICE_BYTES))


def anchor_keys(rows: DataFrame, unit: type, size: int, gram: int) -> DataFrame:
    """(anchor) of all anchors of ``numbered`` rows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in sliced(texts):
                yield pa.RecordBatch.from_arrays([pa.array(anchors.winnow(unit(texts[a:b]), size, gram)["anchor"].view(np.int64))], names=["anchor"])

    return rows.select("text").mapInArrow(find, "anchor long")


def find_anchors(rows: DataFrame, unit: type, size: int, gram: int, passing: np.ndarray, leads: bool) -> DataFrame:
    """(anchor, block, did, th, place) of the anchors of ``numbered`` rows that the bitmap passes.

    ``block`` is an XXH64 of the block under its anchor's place in it. With ``leads`` a place has that place
    too: (start * PLACE + lead) * PLACE + windows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(passing)
    names = ["anchor", "block", "did", "th", "place"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in sliced(texts):
                sequences = unit(texts[a:b])
                found = anchors.winnow(sequences, size, gram)
                ok = in_bitmap(shared.value, found["anchor"])
                anchor, text, begin, windows, lead = (found[k][ok] for k in ("anchor", "text", "begin", "windows", "offset"))
                block = digests(sequences.units, begin, begin + windows - 1 + size, lead)
                start = begin - sequences.start[text]
                place = (start * PLACE + lead if leads else start) * PLACE + windows
                columns = [anchor.view(np.int64), block.view(np.int64), did[text + a], th[text + a], place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return rows.select("did", "th", "text").mapInArrow(find, ", ".join(f"{n} long" for n in names))


def chosen(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """The ``numbered`` rows whose (did, th) is among ``documents``, and by the bitmap's collisions a few more.

    This keeps the texts of other documents out of a shuffle.
    """
    key = F.xxhash64("did", "th").alias("key")
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(documents.select(key), "key"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = in_bitmap(shared.value, batch.column(3).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(ok)).select(["did", "th", "text"])

    return rows.select("did", "th", "text", key).mapInArrow(choose, "did long, th long, text string")


def completed(rows: DataFrame, found: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """``finish`` of batches of (doc_id, text, and the column of ``found``, null if a document isn't in it).

    ``found`` has one row for each (did, th) that it lists and must be stored. Only those documents are shuffled;
    the others are finished where they are read.
    """
    (more,) = (f for f in found.schema.fields if f.name not in ("did", "th"))
    key = F.xxhash64("did", "th").alias("key")
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(found.select(key), "key"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def others() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = ~in_bitmap(shared.value, batch.column(3).to_numpy().view(np.uint64))
                yield batch.filter(pa.array(ok)).select([0, 1, 2])

        return finish(others())

    joined = chosen(rows, found).join(found, ["did", "th"], "left").select(own_id(), "text", more.name).mapInArrow(finish, schema)
    none = F.lit(None).cast(more.dataType).alias(more.name)
    return joined.union(rows.select(own_id(), "text", none, key).mapInArrow(rest, schema))


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of a long column, by its 27 highest bits, as 64-bit words."""
    word = F.shiftrightunsigned(column, 43)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, 37) & 63 as int))")
    words = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word = bits[(keys >> np.uint64(43)).astype(np.int64)]
    return word >> (keys >> np.uint64(37) & np.uint64(63)) & np.uint64(1) == 1


def classes(rows: DataFrame, unit: type, size: int, gram: int, leads: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two tables of anchors of ``numbered`` rows, with the columns of ``find_anchors``.

    members: all but the first of each class, with ``first``, that one's (did, th, place);
    firsts: the first members of anchors with several classes, with ``classes``, how many these are.
    """
    passing = bitmap(anchor_keys(rows, unit, size, gram).groupBy("anchor").count().where("count > 1"), "anchor")
    return classes_of(stored(find_anchors(rows, unit, size, gram, passing, leads)))


def classes_of(found: DataFrame, same: str = "block") -> tuple[DataFrame, DataFrame]:
    """``classes`` of the rows of a stored table; members of a class agree in anchor and in the column ``same``."""
    more = [c for c in found.columns if c not in ("anchor", same)]
    known = stored(found.groupBy("anchor", same).agg(F.min(F.struct(*more)).alias("first"), F.count(F.lit(1)).alias("n")))
    several = known.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    firsts = split_join(known.select("anchor", same, "first.*"), several, ["anchor"])
    members = split_join(found, known.where("n > 1").select("anchor", same, "first"), ["anchor", same])
    return members.where("did <> first.did or th <> first.th or place <> first.place"), firsts
