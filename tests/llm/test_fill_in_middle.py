import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import sylva.llm.fill_in_middle as module
from sylva.llm.fill_in_middle import EliasFano, boundaries, fill_in_middle, restored, text_index

from .fixtures import corpus, frame


def brute(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(lines), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(4)
    rows = corpus()
    rows += [(100 + i, "".join(rng.choice("ab é\n\r<PSM> 😀") for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(400 + i, "same\ntext\n\nfor many rows") for i in range(300)]
    return rows + [(700, "\n\n\n"), (701, "no <P> here\nx"), (702, "line\r\nline\r\n"), (None, "a\nb\nc"), (703, "<\n<S\nM>")]


def key(row):
    return tuple((x is not None, x) for x in row)


def result(done):
    return sorted(((r.doc_id, r.fim.n, r.fim.form, r.fim.prefix_chars, r.fim.middle_chars, r.text) for r in done.collect()), key=key)


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (60, 100)])
def test_against_brute_force(spark, rate, spm):
    rows = texts()
    got = result(fill_in_middle(frame(spark, rows), rate=rate, spm=spm))
    assert got == sorted(((i, *brute(i, t, rate=rate, spm=spm)) for i, t in rows), key=key)


def test_round_trip_and_columns(spark):
    rows = texts()
    docs = frame(spark, rows).withColumn("fim", F.lit(1)).withColumn("body", F.lit("own"))
    done = fill_in_middle(docs)
    assert done.columns == docs.columns[:-2] + ["body", "fim"]
    back = done.select("doc_id", restored(F.col("text"), F.col("fim.form")).alias("text"), "body").collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert {r.body for r in back} == {"own"}


@pytest.mark.parametrize("wide", [1, 60])
def test_equal_hashes_are_told_apart(spark, monkeypatch, wide):
    """All texts under one hash, with or without salts: entries begin where full comparison says so."""
    real = F.xxhash64
    monkeypatch.setattr(module.F, "xxhash64", lambda *c: F.lit(7).cast("long") if c and not isinstance(c[0], str) else real(*c))
    monkeypatch.setattr(module, "width", lambda spark: wide)
    rows = texts()
    done = fill_in_middle(frame(spark, rows))
    monkeypatch.undo()
    assert result(done) == sorted(((i, *brute(i, t)) for i, t in rows), key=key)


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, most in ((1, 0), (1, 10), (5, 5), (700, 50), (700, 10**6), (4000, 10**9)):
        values = np.sort(rng.integers(0, most + 1, n))
        index = EliasFano(values)
        assert [index.select(i) for i in range(n)] == values.tolist()
    dense = np.arange(0, 80_000, 40)
    assert EliasFano(dense).bytes_used() < dense.nbytes / 6


def test_boundaries():
    assert boundaries("").tolist() == [0]
    assert boundaries("a").tolist() == [0, 1]
    assert boundaries("a\n").tolist() == [0, 2]
    assert boundaries("\n\nb c").tolist() == [0, 1, 2, 5]


def test_index_long_texts_and_empty_tables(spark):
    long = "a line of text\n" * 400_000
    docs = spark.createDataFrame([(1, long), (2, long), (3, long + "x"), (4, None)], "doc_id long, text string")
    assert result(fill_in_middle(docs)) == sorted(((i, *brute(i, t)) for i, t in ((1, long), (2, long), (3, long + "x"), (4, ""))), key=key)
    found = {r.n: (r.copies, r.chars) for r in text_index(docs).collect()}
    assert found == {0: (1, 0), 400_000: (2, len(long)), 400_001: (1, len(long) + 1)}
    assert fill_in_middle(docs.limit(0)).count() == 0 and text_index(docs.limit(0)).count() == 0


def test_string_ids(spark):
    docs = spark.createDataFrame([("x", "a\nb\nc\n"), ("y-1", "a\nb\nc\n")], "doc_id string, text string")
    assert result(fill_in_middle(docs)) == sorted((i, *brute(i, "a\nb\nc\n")) for i in ("x", "y-1"))
