import corpus_pipeline
import pytest

from sylva.llm import decontaminate, exact_dedup, language_id, simhash

from . import test_decontaminate, test_exact_dedup, test_simhash
from .fixtures import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "xx" if i % 2 else None, "s", len(t or "")) for i, t in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    _, items = test_decontaminate.cases()
    spark.createDataFrame(items[7:], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert after.columns == docs.columns
        ids = sorted(r.doc_id for r in after.collect())
        if name == "language_id":
            assert ids == sorted(i for i, t in before if t and any(c.isalpha() for c in t))
        elif name == "exact_dedup":
            assert len(ids) == test_exact_dedup.brute(before)[1]
        elif name == "near_dedup":
            assert set(ids) == {c for _, _, c in test_simhash.brute(before)} and len(ids) == len(set(ids))
        else:
            assert ids == [i for i, _, _, _, bad in test_decontaminate.brute(before, items) if not bad]
        docs = after
    left = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == left and left


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert all((exact_dedup, simhash, decontaminate, language_id))


def test_workers_drop_what_another_stage_made(spark):
    """A tokenizer's tables, kept by worker processes, would stay beside the next stages' memory."""
    import sys

    import pyarrow as pa

    from sylva.llm.runtime import latest, tidied

    def make(batches):
        latest("table", 1, lambda: [0] * 100)
        yield from batches

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(sys.__dict__.get("_sylva_latest", {}))] * batch.num_rows, pa.int64())], names=["id"])

    rows = spark.range(64, numPartitions=8)
    assert rows.mapInArrow(make, "id long").count() == 64
    assert {r.id for r in rows.mapInArrow(tidied(held), "id long").collect()} == {0}
