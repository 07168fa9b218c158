"""Line dedup by a deletion-neighbourhood join.

Lines are compared as sequences of words joined by one space. A line is removed if an earlier one
(smaller doc_id, or earlier in the same document) is equal, or lies within the edit bound, one edit
that leaves a similarity of ``SIMILARITY``:

* both lines of ``LEAST_WORDS`` words or more: one word inserted, deleted or replaced;
* both shorter, where a word is more than a fifth of a line: one character (code point) inserted, deleted
  or replaced, the shorter line having ``LEAST_CHARACTERS`` or more;
* of any length from ``LEAST_CHARACTERS`` on: one space put in or left out between two words.

Two edits, such as letters changed in two words, are beyond the bound.

Each line emits its variants within the bound, itself and all that lack one word, character or space,
as hashed keys, and lines with equal variants are joined: two lines that lack a unit at the same
place may differ by one replacement, and one that equals another's variant by one insertion. The earliest line of each
key is the others' candidate, the edit distance of each such pair is verified on the lines themselves,
and a line that has a verified candidate goes.

Only the first of equal lines needs a search, as the others go for being equal. Only
lines that can have a partner emit variants: of two lines within one edit of a word or space the
first half or the second is the same in both, so each line first emits 64-bit hashes of its halves; halves
that two different lines share go into a bitmap of bounded size, which lines look up. Shorter lines all emit
variants; these are few as each different line counts once. A second
bitmap, of variants that two lines have, leaves only those that meet. What decides is
128-bit XXH3 hashes of lines (equality), two hashes (variants) and the words themselves (edits).

Scale. Texts are read twice where they lie. The first scan stores a row of hashes for each line, of which four 16-byte rows are
shuffled; the second takes out the candidates, whose words are stored once, and all that
follows works on these. Then the texts are shuffled once, for the join with their own removed lines. Groups
are reduced to their earliest line with partial aggregation, and joins on hot
keys may be split.

Defined results: a null text has no lines; lines without words stay; a null doc_id comes after all others; rows equal in doc_id and text
don't remove from each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Words
from .repeats import bitmap, in_bitmap, numbered, own_id, sliced, texts_of
from .rolling import PRIME_BASES, lacking, mixed
from .runtime import cut, split_join, stored, table

SIMILARITY = 0.8
LEAST_WORDS = round(1 / (1 - SIMILARITY))
LEAST_CHARACTERS = LEAST_WORDS
#: What a variant lacks, where that isn't the place of a word or character.
NOTHING, SPACE = -1, -2
#: Words', characters' and spaces' variants are kept apart.
KINDS = (np.uint64(0), np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


def wide_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit XXH3 hashes as two columns of longs."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Lines:
    """The lines that have words: ``start`` and ``end`` in words, ``text``, and ``line`` (number in the text)."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.words = texts, Words(texts)
        words = self.words
        feeds = np.flatnonzero(words.data == 10)
        line = np.searchsorted(feeds, words.first)
        text = np.repeat(np.arange(len(texts)), words.end - words.start)
        head = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])))) if len(line) else line
        self.start, self.end = head, np.append(head[1:], len(line))[: len(head)]
        self.text = text[head]
        self.line = line[head] - np.searchsorted(feeds, words.at[:-1])[self.text]

    def take(self, which: np.ndarray) -> None:
        for name in ("start", "end", "text", "line"):
            setattr(self, name, getattr(self, name)[which])

    def joined(self) -> list[bytes]:
        """Each line's words, joined by one space."""
        words = self.words
        low, high = words.span(self.start, self.end, self.text)
        # A line whose bytes are its words' and one more between each two, all of them spaces, is that already.
        filled = np.concatenate(([0], np.cumsum(words.last - words.first)))
        odd = np.concatenate(([0], np.cumsum((words.data < 32) & (words.data >= 9) & (words.data != 10))))
        first, last = words.first[self.start], words.last[self.end - 1]
        plain = (last - first == filled[self.end] - filled[self.start] + self.end - self.start - 1) & (odd[first] == odd[last])
        rows = zip(self.text.tolist(), low.tolist(), high.tolist(), plain.tolist())
        return [self.texts[t][a:b] if ok else b" ".join(self.texts[t][a:b].split()) for t, a, b, ok in rows]

    def halves(self) -> list[np.ndarray]:
        """Four keys of each line: first and second half, if the shorter of two lines has its words or one fewer."""
        out, sums = [], self.words.sums
        for fewer in (0, 1):
            n = self.end - self.start - fewer
            code = n.astype(np.uint64) * np.uint64(2)
            out.append(mixed(sums.parts(self.start, self.start + n // 2) + code))
            out.append(mixed(sums.parts(self.end - (n - n // 2), self.end) + code + np.uint64(1)))
        return out


def _scan(rows: DataFrame, schema: str, make) -> DataFrame:
    """Rows that ``make`` gives for the lines of slices of ``numbered`` rows, called with (lines, did, th)."""
    names = [part.split()[0] for part in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in sliced(texts):
                columns = make(Lines(texts[a:b]), did[a:b], th[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if isinstance(c, np.ndarray) else c) for c in columns], names=names)

    return rows.select("did", "th", "text").mapInArrow(scan, schema)


def _keys(rows: DataFrame) -> DataFrame:
    """(h1, h2, k0..k3, did, th, line): each line's hash, with its halves' hashes, 0 for a line that is too short."""

    def make(lines, did, th):
        long = (lines.end - lines.start >= LEAST_WORDS - 1).astype(np.uint64)  # a space makes five words of four
        return [*wide_hashes(lines.joined()), *(key * long for key in lines.halves()), did[lines.text], th[lines.text], lines.line]

    return _scan(rows, "h1 long, h2 long, k0 long, k1 long, k2 long, k3 long, did long, th long, line long", make)


OWN = ("did", "th", "line")


def _repeated(keyed: DataFrame) -> DataFrame:
    """(did, th, line) of all but the first of equal lines.

    The smallest did comes first from a hash aggregation; only rows of that very document are compared further.
    """
    key, own = ["h1", "h2"], F.struct("th", "line")
    rows = keyed.select(*key, *OWN)
    low = rows.groupBy(*key).agg(F.min("did").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, "low")
    shared = split_join(rows, low, key)
    first = shared.where("did = low").groupBy(*key).agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, "first")
    within = split_join(shared.where("did = low"), first, key).where(own > F.col("first"))
    return shared.where("did > low").select(*OWN).union(within.select(*OWN))


def _candidates(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """(did, th, line, words): the first of equal lines, of those that are short or share a half with a different one."""
    halves = keyed.where("k0 <> 0").select("h1", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key"))
    shared = halves.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high")
    partners = rows.sparkSession.sparkContext.broadcast(bitmap(shared, "key"))

    def make(lines, did, th):
        short = lines.end - lines.start < LEAST_WORDS
        lines.take(np.logical_or.reduce([short, *(in_bitmap(partners.value, key) for key in lines.halves())]))
        words = lines.joined()
        long = np.fromiter((len(x) >= LEAST_CHARACTERS and (len(x) >= 4 * LEAST_CHARACTERS or len(characters(x)) >= LEAST_CHARACTERS) for x in words), bool, len(words))
        lines.take(long)
        words = [x for x, ok in zip(words, long.tolist()) if ok]
        return [*wide_hashes(words), did[lines.text], th[lines.text], lines.line, pa.array(words, pa.binary())]

    found = _scan(rows, "h1 long, h2 long, did long, th long, line long, words binary", make)
    return stored(found.groupBy("h1", "h2").agg(F.min(F.struct(*OWN, "words")).alias("first")).select("first.*"))


def characters(line: bytes) -> str:
    return line.decode("utf-8", "surrogateescape")


def _without_space(lines: list[bytes], words: Words, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``variants`` of lines that lack one space: a hash of all letters, and the sum of one for each place of a space among them."""
    letters = wide_hashes([x.replace(b" ", b"") for x in lines])[PRIME_BASES.index(base)].view(np.uint64)
    spaces = words.end - words.start - 1
    each = np.repeat(np.arange(len(lines)), spaces)
    word = np.arange(len(each)) - np.repeat(np.cumsum(spaces) - spaces, spaces) + words.start[each]
    filled = np.concatenate(([0], np.cumsum(words.last - words.first)))
    at = mixed((filled[word + 1] - filled[words.start[each]]).astype(np.uint64) * np.uint64(2) + np.uint64(1) ^ np.uint64(base))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(at)))
    ends = np.cumsum(spaces)
    whole = letters + sums[ends] - sums[ends - spaces]
    lacks = np.concatenate((np.full(len(lines), NOTHING), np.full(len(each), SPACE)))
    return np.concatenate((np.arange(len(lines)), each)), lacks, mixed(np.concatenate((whole, whole[each] - at)))


def variants(lines: list[bytes], base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The variants of lines of ``_candidates``: (number of the line, place of the unit that is left out, or NOTHING or SPACE, hash)."""
    words = Words(lines)
    long = words.end - words.start >= LEAST_WORDS
    few, many = np.flatnonzero(~long), np.flatnonzero(long)
    texts = [characters(lines[i]) for i in few.tolist()]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = np.concatenate((np.zeros(1, np.int64), ends))[: len(ends)]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = [
        (many, lacking(words.units, words.start[many], words.end[many], base)),
        (few, lacking(codes, starts, ends, base)),
        (np.arange(len(lines)), _without_space(lines, words, base)),
    ]
    parts = [(own[line], lacks, hashes ^ kind) for (own, (line, lacks, hashes)), kind in zip(found, KINDS)]
    return tuple(np.concatenate(c) for c in zip(*parts))


def _one(short, long) -> bool:
    """Whether two sequences, the shorter first, are within one inserted, deleted or replaced unit."""
    if len(long) - len(short) > 1:
        return False
    i = 0
    while i < len(short) and short[i] == long[i]:
        i += 1
    return short[i + (len(short) == len(long)) :] == long[i + 1 :]


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two lines are within the edit bound."""
    short, long = sorted((a.split(b" "), b.split(b" ")), key=len)
    if len(short) >= LEAST_WORDS and _one(short, long):
        return True
    less, more = sorted((characters(a), characters(b)), key=len)
    if len(less) < LEAST_CHARACTERS or not _one(less, more):
        return False
    return len(long) < LEAST_WORDS or (len(less) < len(more) and less.replace(" ", "") == more.replace(" ", ""))


def _near(lines: DataFrame) -> DataFrame:
    """(did, th, line) of ``_candidates`` within one edit of an earlier one."""

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = texts_of(batch.column(0))
            for a, b in sliced(words):
                line, _, hashes = variants(words[a:b], PRIME_BASES[0])
                # A line that lacks either of two equal neighbours gives one variant.
                pairs = np.unique(np.stack((hashes, line.astype(np.uint64)), axis=1), axis=0)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64))], names=["variant"])

    met = lines.select("words").mapInArrow(emitted, "variant long").groupBy("variant").count().where("count > 1")
    meeting = lines.sparkSession.sparkContext.broadcast(bitmap(met, "variant"))
    names = ["v1", "v2", "lacks", *OWN]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [c.to_numpy() for c in batch.columns[:3]]
            words = texts_of(batch.column(3))
            for a, b in sliced(words):
                line, lacks, hashes = variants(words[a:b], PRIME_BASES[0])
                ok = in_bitmap(meeting.value, hashes)
                second = variants(words[a:b], PRIME_BASES[1])[2]
                columns = [hashes[ok].view(np.int64), second[ok].view(np.int64), lacks[ok], *(c[a:b][line[ok]] for c in own)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    found = cut(lines.select(*OWN, "words").mapInArrow(keyed, ", ".join(f"{n} long" for n in names)))
    own, whole = F.struct(*OWN), F.col("lacks") == NOTHING
    replaced = found.where("lacks >= 0").groupBy("v1", "v2", "lacks").agg(F.min(own).alias("other"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = split_join(found, replaced, ["v1", "v2", "lacks"]).where(own > F.col("other")).select(*OWN, "other")
    inserted = found.groupBy("v1", "v2").agg(F.min(F.when(whole, own)).alias("short"), F.min(F.when(~whole, own)).alias("long")).where("short is not null and long is not null")
    longer = split_join(found, inserted, ["v1", "v2"]).select(*OWN, F.when(whole, F.col("long")).otherwise(F.col("short")).alias("other"))
    pairs = pairs.union(longer.where(own > F.col("other"))).distinct()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [one_edit(a, b) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield batch.filter(pa.array(ok, pa.bool_())).select(list(OWN))

    other = lines.select(*(F.col(c).alias(f"other_{c}") for c in OWN), F.col("words").alias("other_words"))
    pairs = split_join(pairs.select(*OWN, *(F.col(f"other.{c}").alias(f"other_{c}") for c in OWN)), other, [f"other_{c}" for c in OWN])
    both = split_join(pairs, lines, list(OWN)).select(*OWN, "words", "other_words")
    return both.mapInArrow(verified, "did long, th long, line long")


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_lines (with words), n_removed, removed (line numbers from 0), kept_sha256, and the kept text if asked for.

    A kept text is the lines that stay, unchanged, joined by line feeds.
    """
    rows = numbered(docs, text, doc_id)
    keyed = stored(_keys(rows))
    gone = _repeated(keyed).union(_near(_candidates(rows, keyed))).groupBy("did", "th").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    joined = rows.join(gone, ["did", "th"], "left").select(own_id(), "text", F.coalesce("removed", F.array().cast("array<long>")).alias("removed"))
    names = ["doc_id", "n_lines", "n_removed", "removed", "kept_sha256", *(["kept"] if texts else [])]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, removed in zip(texts_of(batch.column(1)), batch.column(2).to_pylist()):
                drop, lines = set(removed), t.split(b"\n")
                kept = b"\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else t
                row = (sum(1 for x in lines if x and not x.isspace()), len(drop), removed, hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode()) if texts else row)
            columns = list(zip(*out)) or [()] * (len(names) - 1)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    schema = "doc_id long, n_lines long, n_removed long, removed array<long>, kept_sha256 string"
    return joined.mapInArrow(remove, schema + (", kept string" if texts else ""))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), texts=False)
    return done.select("doc_id", "n_lines", "n_removed", "kept_sha256")


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
o AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS t FROM d),
l AS (SELECT doc_id, line, w, array_to_string(w, ' ') AS k FROM (SELECT doc_id, line, [x for x in regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') if x <> ''] AS w FROM o) WHERE len(w) > 0),
f AS (SELECT k, any_value(w) AS w, min((doc_id, line)) AS first FROM l GROUP BY k),
c AS (SELECT k, w, first FROM f WHERE len(w) < 5 AND length(k) >= 5),
cv AS (SELECT k, first, i, left(k, CAST(i AS BIGINT) - 1) || substring(k, i + 1) AS v FROM (SELECT k, first, unnest(range(1, length(k) + 1)) AS i FROM c)),
sv AS (SELECT k, first, array_to_string(w[1:i], ' ') || array_to_string(w[i + 1:], ' ') AS v FROM (SELECT k, first, w, unnest(range(1, len(w))) AS i FROM f)),
v AS (SELECT k, first, i, array_to_string(w[1:i - 1] || w[i + 1:], ' ') AS v FROM (SELECT k, first, w, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= 5)),
near AS (
  SELECT k FROM (SELECT k, first, min(first) OVER (PARTITION BY v, i) AS low FROM v) WHERE first > low
  UNION SELECT f.k FROM f JOIN v ON v.v = f.k WHERE len(f.w) >= 5 AND v.first < f.first
  UNION SELECT v.k FROM f JOIN v ON v.v = f.k WHERE len(f.w) >= 5 AND f.first < v.first
  UNION SELECT k FROM (SELECT k, first, min(first) OVER (PARTITION BY v, i) AS low FROM cv) WHERE first > low
  UNION SELECT c.k FROM c JOIN cv ON cv.v = c.k WHERE cv.first < c.first
  UNION SELECT cv.k FROM c JOIN cv ON cv.v = c.k WHERE c.first < cv.first
  UNION SELECT f.k FROM f JOIN sv ON sv.v = f.k WHERE length(f.k) >= 5 AND sv.first < f.first
  UNION SELECT sv.k FROM f JOIN sv ON sv.v = f.k WHERE length(f.k) >= 5 AND f.first < sv.first),
gone AS (SELECT doc_id, line FROM l JOIN f USING (k) WHERE (doc_id, line) > first OR k IN (SELECT k FROM near)),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS g FROM gone GROUP BY doc_id),
kept AS (SELECT o.doc_id, string_agg(t, chr(10) ORDER BY o.line) AS kept FROM o LEFT JOIN gone ON gone.doc_id = o.doc_id AND gone.line = o.line WHERE gone.line IS NULL GROUP BY o.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_lines, coalesce(g, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
