"""Alignment of two tokenizers' tokens, and how often their ids are linked over a corpus.

Both tokenizers encode a space and the text. Running sums of token lengths give the byte offsets where tokens end;
those where tokens of both end cut them into groups, and within a group every token of one is linked to every
token of the other. An id pair's count is the number of documents that hold it linked.

In the tasks this is array work: cumulative sums, the intersection of two sorted arrays, a binary search
for group labels, and ``repeat`` for the links. Documents are taken in blocks of at most ``BLOCK_BYTES`` of text (or one document). A block
keeps each pair once, with the number of its documents that hold it, and its documents keep places in that list.

Counting. The blocks' lists are summed by pair in two stages, first with a salt, so that pairs which every block
has are spread. The counts go back to the blocks that asked, by pair and then by block, where the documents' sums are taken.
A pair that a third of all documents hold is one row of each block, not one of each document.

Scale. Texts are encoded once, where they lie, and not shuffled; two shuffles move a block's distinct pairs, which
are few beside its links, and one brings the documents' places to them. A task holds one block; its pairs and links are
bounded by its bytes but for groups whose tokens don't meet for long, whose ids are counted before they are paired.

Defined results: a text that is null, empty, or that one of the tokenizers doesn't give back byte for byte has no tokens;
rows that repeat are a document each; ties for the most frequent partner all count as best; a null doc_id is kept;
an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import latest, split_join, stored, table
from .tokens import DOUBTFUL, place, rank_encoder

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
BLOCK_BYTES = 4 << 20
LINKS_AT_ONCE = 1 << 22
PAIRS_A_ROW = 1 << 14
SALTS = 16
#: Fixed value: the mark for a space in the second vocabulary.
SPACE = "▁"


def byte_decoder() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as characters from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of all ids of one tokenizer."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))


def byte_level(vocabulary: str = VOCABULARY, ranks: str | None = RANKS):
    """(encode, Vocabulary) of a tokenizer file; special tokens' strings are plain text."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(place(vocabulary))
        plain.encode_special_tokens = True
        back, names = byte_decoder(), plain.get_vocab()
        tokens = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            tokens[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()

        def encode(text: str) -> list[int]:
            if ranks and not DOUBTFUL.search(text):
                return rank_encoder(ranks).encode_ordinary(text)
            return plain.encode(text, add_special_tokens=False).ids

        return encode, Vocabulary(tokens)

    return latest(f"plain-{vocabulary}", (vocabulary, ranks), make)


def piece_level(model: str = PIECES):
    """(encode, Vocabulary) of a sentence piece model, which puts a space before the text itself."""

    def make():
        from sentencepiece import SentencePieceProcessor

        with open(place(model), "rb") as file:
            pieces = SentencePieceProcessor(model_proto=file.read())
        names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
        tokens = [bytes([int(x[3:5], 16)]) if pieces.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        return (lambda text: pieces.encode(text, num_threads=1)), Vocabulary(tokens)

    return latest(f"pieces-{model}", model, make)


def aligned(text: str | None, one, other) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(a, b, group of each a, group of each b, groups); empty unless both tokenizers give the text back."""
    none = np.zeros(0, np.int64)
    if not text:
        return none, none, none, none, 0
    spaced = " " + text
    (encode_a, va), (encode_b, vb) = one, other
    a, b, whole = encode_a(spaced), encode_b(text), spaced.encode()
    if b"".join(map(va.tokens.__getitem__, a)) != whole or b"".join(map(vb.tokens.__getitem__, b)) != whole:
        return none, none, none, none, 0
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    ends_a, ends_b = np.cumsum(va.lengths[a]), np.cumsum(vb.lengths[b])  # they rise, as no token is empty
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return a, b, np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), len(common)


def groups_writer(va: Vocabulary, vb: Vocabulary):
    """A function of what ``aligned`` gives that writes ``a1,a2|b1;a3|b2,b3``: ids by group."""
    sizes = len(va.tokens), len(vb.tokens)
    words = [f"{i}{mark}" for size, marks in zip(sizes, (",|", ",;")) for mark in marks for i in range(size)]

    def write(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, groups: int) -> str:
        in_a, in_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
        stop_a, stop_b = np.cumsum(in_a), np.cumsum(in_b)
        at = np.empty(len(a) + len(b), np.int64)
        at[np.arange(len(a)) + (stop_b - in_b)[ga]] = a
        at[np.arange(len(b)) + stop_a[gb]] = b + 2 * sizes[0]
        at[stop_a + stop_b - in_b - 1] += sizes[0]
        at[stop_a + stop_b - 1] += sizes[1]
        return "".join(map(words.__getitem__, at.tolist()))[:-1]

    return write


def summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sum of weights of each."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[starts], np.add.reduceat(weights[order], starts) if len(starts) else weights[:0]


def linked(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, groups: int, most: int = LINKS_AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs, a << 32 | b in order, and how often each is linked.

    With over ``most`` links, equal ids of a group are counted first, so that a group's pairs are those of its distinct ids,
    and pairs are made in slices of ``most``.
    """
    in_a, in_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    if int(in_a @ in_b) <= most:  # all at once, every token by itself
        partners = in_b[ga]
        skipped = np.cumsum(in_b)[ga] - np.cumsum(partners)
        codes = np.repeat(a << 32, partners) | b[np.arange(int(partners.sum())) + np.repeat(skipped, partners)]
        codes.sort()
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        return codes[starts], np.diff(starts, append=len(codes))
    a, wa = summed(ga << 32 | a, np.ones(len(a), np.int64))
    b, wb = summed(gb << 32 | b, np.ones(len(b), np.int64))
    from_a, from_b = np.searchsorted(a >> 32, np.arange(groups + 1)), np.searchsorted(b >> 32, np.arange(groups + 1))
    partners = np.diff(from_b)[a >> 32]  # of each a
    before, first_b = np.cumsum(partners) - partners, from_b[:-1][a >> 32]
    low, pairs, counts = 0xFFFFFFFF, [], []
    total, start = int(partners.sum()), 0
    while start < total:
        stop = min(start + most, total)
        i = np.searchsorted(before, start, side="right") - 1
        j = np.searchsorted(before, stop, side="left")
        n = partners[i:j].copy()
        skip = start - int(before[i])
        n[0] -= skip
        n[-1] -= int(before[j - 1] + partners[j - 1]) - stop
        at = np.repeat(np.arange(i, j), n)
        run = np.arange(stop - start) - np.repeat(np.cumsum(n) - n, n)
        run[: n[0]] += skip
        to = first_b[at] + run
        codes, times = summed((a[at] & low) << 32 | (b[to] & low), wa[at] * wb[to])
        pairs.append(codes)
        counts.append(times)
        start = stop
    if len(pairs) < 2:
        return (pairs[0], counts[0]) if pairs else (a[:0], wa[:0])
    return summed(np.concatenate(pairs), np.concatenate(counts))


def blocks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, ranks: str | None = RANKS, pieces: str = PIECES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Two kinds of rows, by block: documents, with ``places`` in the block's list of pairs and ``times`` linked, and parts of that list.

    block; doc_id, n_a, n_b, n_groups, n_links, groups_sha256, places, times; first (place of the part's first pair), pairs, held (documents that hold each).
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    own = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times"]
    names = ["block", "doc_id", *own, "first", "pairs", "held"]
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())

    def finished(ids: list[pa.Array], found: list[tuple]) -> Iterator[pa.RecordBatch]:
        block = uuid.uuid4().hex
        sizes = [len(x[5]) for x in found]
        pairs, at, held = np.unique(np.concatenate([x[5] for x in found]), return_inverse=True, return_counts=True)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        times = np.concatenate([x[6] for x in found])
        n = len(found)
        columns = [pa.array([block] * n), pa.concat_arrays(ids)]
        columns += [pa.array([x[k] for x in found], pa.string() if k == 4 else pa.int64()) for k in range(5)]
        columns += [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (at.astype(np.int32), times.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, longs), pa.nulls(n, ints)], names=names)
        starts = range(0, len(pairs), PAIRS_A_ROW)
        n = len(starts)
        if n:
            none = [pa.nulls(n, columns[k].type) for k in range(1, 9)]
            lists = [pa.array([x[i : i + PAIRS_A_ROW] for i in starts], t) for x, t in ((pairs, longs), (held.astype(np.int32), ints))]
            yield pa.RecordBatch.from_arrays([pa.array([block] * n), *none, pa.array(list(starts), pa.int64()), *lists], names=names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = byte_level(vocabulary, ranks), piece_level(pieces)
        written = groups_writer(one[1], other[1])
        ids, found, size = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                t = batch.column(1)[i].as_py()
                a, b, ga, gb, groups = aligned(t, one, other)
                digest = hashlib.sha256(written(a, b, ga, gb, groups).encode()).hexdigest() if groups else ""
                pairs, times = linked(a, b, ga, gb, groups)
                ids.append(batch.column(0).slice(i, 1))
                found.append((len(a), len(b), groups, int(times.sum()), digest, pairs, times))
                size += len(t or "") + 256
                if size >= block_bytes:
                    yield from finished(ids, found)
                    ids, found, size = [], [], 0
        if found:
            yield from finished(ids, found)

    schema = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, times array<int>, first long, pairs array<long>, held array<int>"
    return rows.mapInArrow(encode, f"block string, doc_id {kind.simpleString()}, {schema}")


def asked(made: DataFrame) -> DataFrame:
    """(block, place, pair, held): the lists of all blocks, a row for each pair."""
    parts = made.where("pairs is not null").select("block", "first", F.posexplode(F.arrays_zip("pairs", "held")).alias("k", "x"))
    return parts.select("block", (F.col("first") + F.col("k")).alias("place"), F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, a, b, count, best): documents that hold each pair linked, and whether no other pair of its a has more."""
    rows = asked(made).select("pair", "held", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt"))
    first = rows.groupBy("pair", "salt").agg(F.sum("held").alias("held"))
    counts = stored(first.groupBy("pair").agg(F.sum("held").alias("count")))
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    rows = counts.select("pair", a.alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "count").join(most, "a")
    return rows.select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, ranks: str | None = RANKS, pieces: str = PIECES, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and ``pair_counts``."""
    made = stored(blocks(docs, text, doc_id, vocabulary, ranks, pieces, block_bytes))
    pairs = stored(pair_counts(made))
    answers = split_join(asked(made).select("block", "place", "pair"), pairs.select("pair", "count", "best"), ["pair"]).select(F.col("block").alias("of"), "place", "count", "best")
    own = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times"]
    rows = made.where("pairs is null").select(*own)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sums(rows: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers["place"].to_numpy())
        count, best = answers["count"].to_numpy()[order], answers["best"].to_numpy()[order]
        n_best, count_sum = [], []
        for chunk in rows.to_batches():
            at, times = chunk.column(7), chunk.column(8)
            ends, start = at.offsets.to_numpy(), at.offsets[0].as_py()
            place, n = at.values.to_numpy()[start : ends[-1]], times.values.to_numpy()[start : ends[-1]].astype(np.int64)
            for x, into in ((n * best[place], n_best), (n * count[place], count_sum)):
                total = np.concatenate([[0], np.cumsum(x)])
                into.append(total[ends[1:] - start] - total[ends[:-1] - start])
        fields = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (n_best, count_sum)]
        return pa.table([*(rows[c] for c in own[1:6]), *fields, rows["groups_sha256"]], names=[*own[1:6], "n_best", "count_sum", "groups_sha256"])

    found = rows.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(sums, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return found, pairs


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents", "doc_id", "text"))[0]
