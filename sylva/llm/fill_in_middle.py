"""Fill-in-the-middle transformation by an index of distinct texts.

Documents are grouped by text: they are dealt out by a hash of the text and sorted by hash and text, so that
identical texts are neighbours, and each row is compared in full with the entry before it. A text's entry is its
list of line boundaries in Elias-Fano form; it is made once, where a group begins, and every document
of the group is joined to it there and reads its own two seeded boundaries from it by select.

A line is ``[^\\n]*\\n|[^\\n]+``. The prefix ends after the smaller and the middle after the larger of two line numbers that
a SHA-256 of seed and doc_id draws; a further draw picks the order of the parts. ``restored`` rebuilds the text.

Hot groups. A text with more rows than an even partition is dealt out by a salt as well; there are fewer such
hashes than partitions, and only they are broadcast. Each part of such a group makes the entry anew.

Scale. Texts are hashed in one scan and shuffled once, in a second. A task holds one entry and one batch of rows, never a group.

Defined results: a null text counts as empty, and an empty one is plain, with no lines; a null doc_id draws as an
empty one; rows that repeat are cut alike, each; ties of the two draws leave the middle empty; texts that hold a marker
stay plain; an empty table gives an empty result; further columns are kept, but one named like the result's is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import sha256_text, table, width

#: The markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED = 7
ROWS_AT_ONCE = 256
BLOCK = 512


class EliasFano:
    """A rising list of whole numbers: low bits packed, high parts in unary, one count kept for each block of ``BLOCK`` bits."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.int64)
        self.size = len(values)
        self.width = max(0, int(values[-1] // self.size).bit_length() - 1) if self.size else 0
        low = (values[:, None] >> np.arange(self.width)) & 1
        self.low = np.packbits(low.astype(np.uint8).ravel(), bitorder="little")
        bits = np.zeros(-(-((int(values[-1]) >> self.width) + self.size if self.size else 1) // BLOCK) * BLOCK, np.uint8)
        bits[(values >> self.width) + np.arange(self.size)] = 1
        self.before = np.concatenate([[0], np.cumsum(bits.reshape(-1, BLOCK).sum(1, dtype=np.int64))])
        self.high = np.packbits(bits, bitorder="little")

    def __len__(self) -> int:
        return self.size

    def select(self, i: int) -> int:
        """The i-th number, from 0."""
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        bits = np.unpackbits(self.high[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        one = block * BLOCK + int(np.flatnonzero(bits)[i - int(self.before[block])])
        at, low = i * self.width, 0
        for k in range(self.width):
            low |= (int(self.low[(at + k) >> 3]) >> ((at + k) & 7) & 1) << k
        return (one - i) << self.width | low

    def bytes_used(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.before.nbytes


def boundaries(text: str) -> np.ndarray:
    """Ends of the lines of ``text`` in code points, after a first 0."""
    lengths = np.fromiter(map(len, text.split("\n")), np.int64)
    lengths[:-1] += 1  # the line feeds
    return np.concatenate([[0], np.cumsum(lengths if lengths[-1] else lengths[:-1])])


def ordered(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``docs`` as (seeded, text, row), dealt out by text and sorted so that identical texts are neighbours."""
    wide = width(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    counts = docs.select(F.xxhash64(body).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    total = docs.count()
    # Fewer than ``wide`` hashes can each have more than the wide-th part of all rows.
    hot = F.broadcast(counts.where(F.col("n") * wide > total).select(F.col("h").alias("hot_h"), F.ceil(F.col("n") * wide / max(total, 1)).alias("parts")))
    own = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    others = [F.col(c) for c in docs.columns if c != text]
    rows = docs.select(own.alias("own"), body.alias("body"), F.xxhash64(body).alias("h"), F.struct(*others).alias("row"))
    salt = F.coalesce(F.pmod(F.xxhash64("own"), F.col("parts")), F.lit(0))
    dealt = rows.join(hot, F.col("h") == F.col("hot_h"), "left").select("own", "body", "h", salt.alias("salt"), "row")
    return dealt.repartition("h", "salt").sortWithinPartitions("h", "body").select("own", "body", "row")


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, rate: int = 100, spm: int = 50, name: str = "fim") -> DataFrame:
    """``docs`` with transformed texts and a struct ``fim``: n (lines), form, prefix_chars, middle_chars.

    ``rate`` percent of the texts are transformed, ``spm`` percent of those with the suffix first.
    """
    rows = ordered(docs, text, doc_id)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("own")), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    p, s, m = MARKERS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entry, marked = None, None, False
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                out, lines, forms, prefixes, middles = [], [], [], [], []
                for body, h1, h2, h3, h4 in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    if body != held:  # compared in full: a new text begins
                        held, entry, marked = body, EliasFano(boundaries(body)), any(x in body for x in MARKERS)
                    n = len(entry) - 1
                    lines.append(n)
                    if not body or marked or h3 % 100 >= rate:
                        out.append(body)
                        forms.append("plain")
                        prefixes.append(None)
                        middles.append(None)
                        continue
                    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, b = entry.select(a), entry.select(b)
                    first = h4 % 100 < spm
                    out.append(f"{s}{body[b:]}{p}{body[:a]}{m}{body[a:b]}" if first else f"{p}{body[:a]}{s}{body[b:]}{m}{body[a:b]}")
                    forms.append("spm" if first else "psm")
                    prefixes.append(a)
                    middles.append(b - a)
                fields = [pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(5), *fields], names=["row", "body", "n", "form", "prefix_chars", "middle_chars"])

    kind = rows.schema["row"].dataType.simpleString()
    done = rows.select("body", *draws, "row").mapInArrow(cut, f"row {kind}, body string, n long, form string, prefix_chars long, middle_chars long")
    columns = [F.col("body").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c != name]
    return done.select(*columns, F.struct("n", "form", "prefix_chars", "middle_chars").alias(name))


def text_index(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per distinct text: text_sha256, copies, n (lines), chars, index_bytes, the size of its Elias-Fano list."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(b := boundaries(t), EliasFano(b)) for t in batch.column(0).to_pylist()]
            fields = [pa.array(x, pa.int64()) for x in ([len(b) - 1 for b, _ in made], [int(b[-1]) for b, _ in made], [e.bytes_used() for _, e in made])]
            yield pa.RecordBatch.from_arrays([batch.column(1), *fields, batch.column(2)], names=["text_sha256", "n", "chars", "index_bytes", "copies"])

    distinct = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body")).groupBy("body").agg(F.count(F.lit(1)).alias("copies"))
    return distinct.select("body", sha256_text(F.col("body")), "copies").mapInArrow(entries, "text_sha256 string, n long, chars long, index_bytes long, copies long")


def restored(text: Column, form: Column) -> Column:
    """The text that an output of the given form was made from. No marker occurs in it, nor where its parts meet markers."""
    p, s, m = MARKERS
    between = lambda a, b: F.substring_index(F.substring_index(text, b, 1), a, -1)
    last = F.substring_index(text, m, -1)
    psm = F.concat(between(p, s), last, between(s, m))
    spm = F.concat(between(p, m), last, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), l AS (
  SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') END AS lines,
         CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l
), p AS (
  SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"))
    text, form = F.col("text"), F.col("fim.form")
    return done.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        sha256_text(text).alias("output_sha256"), sha256_text(restored(text, form)).alias("restored_sha256"),
    )
