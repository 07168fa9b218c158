"""Every corpus query on the smallest tables: against its SQL, or by what its contract fixes."""

import os
import zlib

import duckdb
import pytest

from sylva.llm import queries

from ..test_queries import FOLDER, TABLES, ordered

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = ordered(queries.QUERIES[name](spark, FOLDER).toPandas()), ordered(duck.execute(queries.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    plain = lambda df: df.astype(object).where(df.notna(), None).map(lambda x: int(x) if isinstance(x, float) and x.is_integer() else x).values.tolist()  # noqa: E731  nulls make floats of whole numbers
    assert plain(got) == plain(want)


def test_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.QUERIES["op8_language_id"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    judged = [docs[r.doc_id].lang == r.lang_pred for r in got if r.held_out and docs[r.doc_id].lang is not None and r.lang_pred != "und"]
    assert sum(judged) >= 0.95 * len(judged) > 0


@pytest.mark.parametrize("name", ["op9_best_fit_packing", "pipeline"])
def test_packing_queries(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER).collect()
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for parts in sequences.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    for parts in pieces.values():
        assert [k for k, _, _ in sorted(parts)] == list(range(len(parts)))
        assert [a for _, a, _ in sorted(parts)] == [0, *(a + n for _, a, n in sorted(parts)[:-1])]
    # Best-fit decreasing stays within a few sequences of the bound on data like these.
    assert len(sequences) <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1
