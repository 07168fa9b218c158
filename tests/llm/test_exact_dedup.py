import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import sylva.llm.exact_dedup as module
from sylva.llm.exact_dedup import exact_dedup, exact_groups

from .fixtures import corpus, frame


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    best = {k: (min(v), len(v)) for k, v in groups.items()}
    out = []
    for i, t in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        (n, keep), size = best[k]
        out.append((i, keep, size, hashlib.sha256(k.encode()).hexdigest()))
    return sorted(out), len(groups)


def test_against_brute_force(spark):
    rows = corpus()
    got = exact_groups(frame(spark, rows)).collect()
    want, groups = brute(rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)


def test_rows_that_stay_have_all_columns(spark):
    rows = corpus()
    docs = frame(spark, rows)
    stay = exact_dedup(docs)
    assert stay.columns == docs.columns
    assert stay.count() == brute(rows)[1]


def test_hot_group_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "same  text") for i in range(500)] + [(None, "same text"), (None, "lone")], "doc_id long, text string")
    got = exact_groups(docs).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(0, 501), (None, 1)}
    assert sum(r.kept for r in got) == 2
    assert exact_groups(docs.limit(0)).count() == 0
    assert exact_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("wide", [1, 4, 50])
def test_neighbours_settle_all_groups(spark, monkeypatch, wide):
    """With one hash for all texts and no prefix only full comparisons tell groups apart; from ``wide`` on keys are salted."""
    monkeypatch.setattr(module, "key_hash", lambda norm: F.lit(7).cast("long"))
    monkeypatch.setattr(module, "PREFIX_BYTES", 0)
    monkeypatch.setattr(module, "width", lambda spark: wide)
    rows = corpus() + [(1000 + i, "one group of many") for i in range(200)]
    got = exact_groups(frame(spark, rows)).collect()
    want, groups = brute(rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == groups


def test_only_hot_keys_are_salted(spark):
    rows = [(i, "the same") for i in range(900)] + [(1000 + i, f"text {i // 2}") for i in range(200)]
    sorted_rows = module.content_sorted(frame(spark, rows)).collect()
    assert {r.salt > 0 for r in sorted_rows if r.doc_id < 900} == {True}
    others = [r for r in sorted_rows if r.doc_id >= 1000]
    assert {r.salt for r in others} == {0} and {r.members for r in others} == {2}


def test_very_long_texts(spark):
    long = "word " * 300_000
    docs = spark.createDataFrame([(1, long + "a"), (2, long + "b"), (3, " " + long + "a")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact_groups(docs).collect()) == [(1, 3, False), (2, 2, True), (3, 3, True)]
