"""Language ID by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features; the chain has
learned transitions between languages, so that words of code-switched text are
labelled one by one. Forward-backward gives each word's posterior; a document's
language is the one with the largest mean posterior, which is its score.

A word is a run of letters (bytes a-z after lowering, or any non-ASCII
character); a chain is up to ``CHAIN`` consecutive words, and all chains of a text
count. The model is fitted on the driver on a bounded sample: at most
``SAMPLE_DOCS`` documents of each language, and ``SAMPLE_WORDS`` words from the
middle of each. Pieces of sampled documents are spliced into chains, so
that the transitions see switches.

Scale. Fitting takes one scan of ids and labels and one of the sampled texts.
Prediction reads each text once, without a shuffle; what is broadcast is the
model, whose size depends on ``BUCKETS`` and the number of languages only.

Defined results: ``und`` with score 0 if a text is null or has no letter, or if no
labelled document can be learned from; of equal shares the first language in
order; a row without doc_id isn't learned from and isn't held out; rows that
repeat are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import Sums, byte_values, mixed
from .runtime import table, tidied

SAMPLE_DOCS = 120
SAMPLE_WORDS = 240
SAMPLE_CHARS = 1 << 14  # of those words together
CHAIN = 64
BUCKETS = 1 << 16
ROUNDS = 40
UNKNOWN = "und"
LEAST_SCORE = 0.3
SLICE_BYTES = 2 << 20

#: What a byte of lowered UTF-8 counts as: letters stay, the rest separates words.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


class Words:
    """The words of some texts, and their feature buckets.

    ``grams`` has a bucket for each letter byte, that of the trigram around it,
    word by word from ``first``; ``others`` has a column for each affix length
    at either end and one for the lexicon.
    """

    def __init__(self, texts: list[str]):
        coded = [t.lower().encode().translate(LETTERS) for t in texts]
        at = np.cumsum([0, *(len(c) + 1 for c in coded)])
        data = np.frombuffer(b" " + b" ".join(coded) + b"     ", np.uint8)
        letter = data != 32
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        self.counts = np.diff(np.searchsorted(start, at + 1))
        self.first = np.concatenate(([0], np.cumsum(end - start)[:-1])) if len(start) else start
        wide = data.astype(np.uint64)
        inside = np.flatnonzero(letter)
        self.grams = self._bucket(wide[inside - 1] << np.uint64(16) | wide[inside] << np.uint64(8) | wide[inside + 1], 0)
        sums, columns = Sums(byte_values()[data]), []
        for k, size in enumerate((2, 3, 4)):
            n = np.minimum(size, end - start)
            columns.append(self._bucket(sums.parts(start, start + n), 2 * k + 1))
            columns.append(self._bucket(sums.parts(end - n, end), 2 * k + 2))
        columns.append(self._bucket(sums.parts(start, end), 7))
        self.others = np.stack(columns, axis=1)

    @staticmethod
    def _bucket(values: np.ndarray, kind: int) -> np.ndarray:
        return (mixed(values + np.uint64(kind + 1 << 56)) >> np.uint64(48)).astype(np.int64) % BUCKETS + kind * BUCKETS

    def __len__(self) -> int:
        return len(self.first)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(weights[self.grams], self.first, axis=0) if len(self) else np.zeros((0, weights.shape[1]), weights.dtype)
        for column in self.others.T:
            out += weights[column]
        return out


KINDS = 8


def posteriors(scores: np.ndarray, mask: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains side by side.

    scores: chains x places x labels, mask: chains x places (a chain's words come
    first). Returns each word's label probabilities and the expected transitions.
    """
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(transitions)
    n, t, k = emit.shape
    forward = np.empty_like(emit)
    forward[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        a = (forward[:, i - 1] @ step) * emit[:, i]
        forward[:, i] = a / a.sum(axis=1, keepdims=True)
    out = np.empty_like(emit)
    backward = np.ones((n, k), emit.dtype)
    pairs = np.zeros((k, k))
    for i in range(t - 1, -1, -1):
        both = forward[:, i] * backward
        out[:, i] = both / both.sum(axis=1, keepdims=True)
        if i:
            ahead = emit[:, i] * backward
            new = ahead @ step.T
            here = mask[:, i, None]
            norm = (forward[:, i - 1] * new).sum(axis=1, keepdims=True)
            pairs += (forward[:, i - 1] / norm * here).T @ ahead * step
            backward = np.where(here, new / new.sum(axis=1, keepdims=True), 1.0).astype(emit.dtype)
    return out, pairs


def _chains(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of ``counts`` words: word numbers by chain and place, which of these exist, and each chain's text."""
    n = -(-counts // CHAIN)
    text = np.repeat(np.arange(len(counts)), n)
    within = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = (np.cumsum(counts) - counts)[text] + within * CHAIN
    size = np.minimum(CHAIN, counts[text] - within * CHAIN)
    mask = np.arange(CHAIN) < size[:, None]
    return np.where(mask, begin[:, None] + np.arange(CHAIN), 0), mask, text


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.langs, self.weights, self.transitions = langs, weights, transitions

    @staticmethod
    def shared(spark, model: Model | None):
        """The model's parts, broadcast; ``Model.received`` puts them together on an executor."""
        return spark.sparkContext.broadcast((model.langs, model.weights, model.transitions) if model else None)

    @staticmethod
    def received(shared) -> Model | None:
        return Model(*shared.value) if shared.value else None

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(posteriors of all words in order, number of words of each text)."""
        words = Words(texts)
        scores = words.emissions(self.weights)
        at, mask, _ = _chains(words.counts)
        out = np.zeros_like(scores)
        if len(at):
            found, _ = posteriors(scores[at], mask, self.transitions)
            out[at[mask]] = found[mask]
        return out, words.counts

    def shares(self, texts: list[str]) -> np.ndarray:
        """Mean posterior of each language over each text's words; zeros if it has none."""
        found, counts = self.words(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        has = np.flatnonzero(counts)
        if len(has):
            sums[has] = np.add.reduceat(found.astype(np.float64), (np.cumsum(counts) - counts)[has], axis=0) / counts[has, None]
        return sums


def fit(sample: list[tuple[str, str]], seed: int = 0) -> Model | None:
    """A model from (text, language) rows: AdaGrad on the chains' log-likelihood."""
    langs = sorted({lang for _, lang in sample})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sample))
    texts, labels = [], []
    for i in order:  # pieces of 8 to 40 words, to be spliced in a random order
        words = sample[i][0].split()
        middle = max(0, (len(words) - SAMPLE_WORDS) // 2)
        words = words[middle : middle + SAMPLE_WORDS]
        while words:
            n = int(rng.integers(8, 41))
            texts.append(" ".join(words[:n]))
            labels.append(langs.index(sample[i][1]))
            words = words[n:]
    order = rng.permutation(len(texts))
    words = Words([texts[i] for i in order])
    gold = np.repeat(np.array(labels)[order], words.counts)
    k, n = len(langs), len(words)
    if k == 1 or not n:
        return Model(langs, np.zeros((KINDS * BUCKETS, k), np.float32), np.zeros((k, k), np.float32))
    at, mask, _ = _chains(np.array([n]))
    truth = np.eye(k)[gold]
    switches = np.zeros((k, k))
    follow = np.flatnonzero((np.arange(1, n) % CHAIN) != 0)
    np.add.at(switches, (gold[follow], gold[follow + 1]), 1)
    used, where = np.unique(np.concatenate((words.grams, words.others.ravel())), return_inverse=True)
    grams, others = where[: len(words.grams)], where[len(words.grams) :].reshape(words.others.shape)
    word_of_gram = np.repeat(np.arange(n), np.diff(np.append(words.first, len(grams))))
    small = np.zeros((len(used), k))
    transitions = np.zeros((k, k))
    g_small, g_trans = np.full_like(small, 1e-2), np.full((k, k), 1e-2)
    for _ in range(ROUNDS):
        scores = np.add.reduceat(small[grams], words.first, axis=0) + sum(small[c] for c in others.T)
        found, pairs = posteriors(scores[at], mask, transitions)
        error = truth.copy()
        error[at[mask]] -= found[mask]
        slope = np.stack([np.bincount(grams, error[word_of_gram, j], len(used)) + sum(np.bincount(c, error[:, j], len(used)) for c in others.T) for j in range(k)], axis=1) - 0.05 * small
        g_small += slope**2
        small += 0.3 * slope / np.sqrt(g_small)
        slope = switches - pairs - 0.05 * transitions
        g_trans += slope**2
        transitions += 0.3 * slope / np.sqrt(g_trans)
    weights = np.zeros((KINDS * BUCKETS, k), np.float32)
    weights[used] = small
    return Model(langs, weights, transitions.astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model | None:
    """A model from documents with a language that aren't held out."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = rows.where(F.col("text").isNotNull()).select("id", "lang").distinct()
    chosen = ids.select("id", "lang", F.row_number().over(by_hash).alias("n")).where(F.col("n") <= SAMPLE_DOCS)
    # At most SAMPLE_DOCS ids of each language are broadcast, and of each at most SAMPLE_WORDS words collected; of rows
    # that share an id the least text counts.
    texts = rows.join(F.broadcast(chosen), ["id", "lang"]).groupBy("lang", "n").agg(F.min("text").alias("text"))
    words = F.split(F.trim("text"), r"\s+")
    middle = F.slice(words, F.greatest(F.lit(0), F.floor((F.size(words) - SAMPLE_WORDS) / 2)).cast("int") + 1, SAMPLE_WORDS)
    short = texts.select("lang", "n", F.substring(F.array_join(middle, " "), 1, SAMPLE_CHARS).alias("text"))
    sample = sorted((r.lang, r.n, r.text) for r in short.collect())
    return fit([(t, lang) for lang, _, t in sample if any(c.isalpha() for c in t)])


def _judged(model: Model | None, column: pa.Array) -> list[tuple[str, float]]:
    texts = column.to_pylist()
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    has = [i for i, t in enumerate(texts) if model and t and any(c.isalpha() for c in t)]
    while has:
        size, n = 0, 0
        while n < len(has) and (not n or size + len(texts[has[n]]) <= SLICE_BYTES):
            size += len(texts[has[n]])
            n += 1
        now, has = has[:n], has[n:]
        shares = model.shares([texts[i] for i in now])
        best = shares.argmax(axis=1)
        for i, b, s in zip(now, best, shares):
            out[i] = (model.langs[b], float(min(1.0, s[b])))
    return out


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced."""
    kept = docs.drop("lang_pred", "score")
    shared, at = Model.shared(docs.sparkSession, model), kept.columns.index(text)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.received(shared)
        for batch in batches:
            found = _judged(model, batch.column(at))
            columns = [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(tidied(label), f"{schema}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``LEAST_SCORE``, unchanged."""
    shared, at = Model.shared(docs.sparkSession, model), docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.received(shared)
        for batch in batches:
            found = _judged(model, batch.column(at))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= LEAST_SCORE for lang, score in found], pa.bool_()))

    return docs.mapInArrow(tidied(clean), docs.schema)


def label_words(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, runs): runs of words with one language, as (start, end, lang) in word numbers."""
    shared = Model.shared(docs.sparkSession, model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.received(shared)
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                best = model.words([t or ""])[0].argmax(axis=1)
                edge = np.concatenate(([0], np.flatnonzero(best[1:] != best[:-1]) + 1, [len(best)])) if len(best) else np.zeros(1, np.int64)
                out.append([{"start": int(a), "end": int(b), "lang": model.langs[best[a]]} for a, b in zip(edge, edge[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "runs"])

    return rows.mapInArrow(tidied(label), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, runs array<struct<start:long,end:long,lang:string>>")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
