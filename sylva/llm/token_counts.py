"""Token counts kept up to date by signed deltas.

Totals by source, language and tokenizer version are sums of deltas: an insert adds a
document and its tokens, a delete takes them away, a revision takes the old counts away and adds
the new. A batch of changes is rolled up and committed under its id; committing an id
again changes nothing. Totals are the sum over committed batches.

A store is a folder on a file system that Spark writes. A batch is written to a staging
folder and then renamed to ``batch=<id>``, and a rename to a name that exists fails, so of two attempts
one counts; this needs a file system whose rename is atomic, as HDFS has and most object stores have not, where
one committer at a time must be seen to. ``compact`` folds batches into one that lists their ids; reading
ignores batches that a compacted one covers.

Scale. Texts are read once, where they lie; each task sums its own deltas
before the shuffle, so a source with a third of all rows is a few rows from each
task. A batch's size is the number of its groups.

Defined results: a null text has no tokens but counts as a document; null source and
language are groups of their own; a group whose documents and tokens are both zero isn't
listed; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, shared_folder, table
from .tokens import rank_encoder

TOKENIZERS = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}
ROWS_A_FILE = 100_000
GROUP = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def counted(docs: DataFrame, tokenizers: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens): one row per document and tokenizer version.

    ``tokenizers`` maps a version to its rank file, a path or a name among the installed ones.
    """
    files = dict(tokenizers or TOKENIZERS)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for version, name in files.items():
                encode = rank_encoder(name).encode_ordinary
                n = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([version] * len(texts), pa.string()), n], names=["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, source string, lang string, tokenizer string, n_tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that replace the counts ``old`` by ``new``."""
    return deletes(old).union(inserts(new))


def rolled_up(deltas: DataFrame) -> DataFrame:
    """Sums of signed deltas by group; groups that come to nothing are left out."""
    sums = deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs <> 0 or n_tokens <> 0")


class TotalsStore:
    """Committed batches of deltas in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self.path(self.folder))

    @staticmethod
    def _checked(batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError(f"batch ids are letters, digits, '.', '_' and '-': {batch!r}")
        return batch

    def _names(self, prefix: str) -> list[str]:
        found = (s.getPath().getName() for s in self.files.listStatus(self.path(self.folder)))
        return sorted(n.removeprefix(prefix) for n in found if n.startswith(prefix))

    def _covered(self) -> dict[str, list[str]]:
        """The ids that each compacted batch stands for."""
        out = {}
        for name in self._names("compact="):
            out[name] = [r.value for r in self.spark.read.text(f"{self.folder}/compact={name}/ids").collect()]
        return out

    def committed(self) -> set[str]:
        return set(self._names("batch=")) | {b for ids in self._covered().values() for b in ids}

    def _publish(self, staged: str, name: str) -> bool:
        target = self.path(f"{self.folder}/{name}")
        if not self.files.exists(target) and self.files.rename(self.path(staged), target):
            nested = self.path(f"{self.folder}/{name}/{staged.rpartition('/')[2]}")
            if not self.files.exists(nested):  # else another attempt was first and the rename went into its folder
                return True
            self.files.delete(nested, True)
            return False
        self.files.delete(self.path(staged), True)
        return False

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of signed deltas; False, and no change, if its id was committed before."""
        if self._checked(batch) in self.committed():
            return False
        staged = f"{self.folder}/_staged-{uuid.uuid4().hex}"
        self._write(rolled_up(deltas), staged)
        return self._publish(staged, f"batch={batch}")

    @staticmethod
    def _write(sums: DataFrame, path: str) -> None:
        """In as many files as the rows need, not as many as there were shuffle partitions."""
        sums = cut(sums)
        sums.coalesce(-(-sums.count() // ROWS_A_FILE) or 1).write.parquet(path)

    def totals(self) -> DataFrame:
        """Current totals: source, lang, tokenizer, n_docs, n_tokens."""
        compacted = self._covered()
        latest = max(compacted, key=lambda k: len(compacted[k]), default=None)
        parts = [f"{self.folder}/compact={latest}/sums"] if latest else []
        parts += [f"{self.folder}/batch={b}" for b in self._names("batch=") if b not in (compacted[latest] if latest else ())]
        if not parts:
            return self.spark.createDataFrame([], TOTALS)
        return rolled_up(self.spark.read.schema(TOTALS).parquet(*parts))

    def compact(self) -> None:
        """Fold all committed batches into one; their own folders go."""
        ids = sorted(self.committed())
        staged = f"{self.folder}/_staged-{uuid.uuid4().hex}"
        self._write(self.totals(), f"{staged}/sums")
        self.spark.createDataFrame([(b,) for b in ids], "value string").coalesce(1).write.text(f"{staged}/ids")
        if self._publish(staged, f"compact={uuid.uuid4().hex}"):
            for b in self._names("batch="):
                if b in ids:
                    self.files.delete(self.path(f"{self.folder}/batch={b}"), True)


def provisional(docs: DataFrame, tokenizers: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """``counted``'s rows with counts by rule of thumb, a token for every four bytes, before any tokenizer has run."""
    n = F.floor(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")
    version = F.explode(F.array(*map(F.lit, sorted(tokenizers or TOKENIZERS))))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), version.alias("tokenizer"), n.alias("n_tokens"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals over all documents.

    A batch for each tokenizer version inserts provisional counts; another revises every count to the tokenizer's, and a draft
    version of all documents is inserted and deleted again. Each batch is delivered twice.
    """
    store = TotalsStore(spark, f"{shared_folder(spark)}/token-totals-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    early, counts = cut(provisional(docs)), cut(counted(docs))
    draft = early.withColumn("tokenizer", F.lit("draft"))
    batches = {f"load-{v}": inserts(early.where(F.col("tokenizer") == v)) for v in TOKENIZERS}
    batches |= {"draft": inserts(draft), "recount": revisions(early, counts), "no-draft": deletes(draft)}
    for _ in range(2):
        for batch, deltas in batches.items():
            store.commit(batch, deltas)
    return store.totals()
