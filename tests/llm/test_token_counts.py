import base64
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sylva.llm.token_counts import TOKENIZERS, TotalsStore, counted, deletes, inserts, op3_token_counts, revisions, rolled_up

from .fixtures import corpus, frame


def encoders():
    for version, name in TOKENIZERS.items():
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
        yield version, tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute(rows):
    docs, tokens = Counter(), Counter()
    for version, encoder in encoders():
        for i, t in rows:
            key = ("src0", "en" if i and i % 2 else None, version)
            docs[key] += 1
            tokens[key] += len(encoder.encode_ordinary(t or ""))
    return {k: (docs[k], tokens[k]) for k in docs}


def as_dict(df):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in df.collect()}


def test_life_of_a_store(spark, tmp_path):
    rows = corpus()
    old, new = rows[:40], [(i, (t or "") + " more words") for i, t in rows[:20]]
    counts = {name: counted(frame(spark, r)) for name, r in (("old", old), ("late", rows[40:]), ("before", old[:20]), ("after", new))}
    store = TotalsStore(spark, str(tmp_path / "store"))
    assert store.totals().count() == 0
    assert store.commit("a", inserts(counts["old"])) and not store.commit("a", inserts(counts["old"]))
    assert as_dict(store.totals()) == brute(old)
    assert store.commit("b", revisions(counts["before"], counts["after"]))
    assert as_dict(store.totals()) == brute(new + old[20:])
    store.compact()
    assert store.committed() == {"a", "b"} and not store.commit("b", inserts(counts["late"]))
    assert store.commit("c", inserts(counts["late"]))
    assert as_dict(store.totals()) == brute(new + rows[20:])
    store.compact()
    assert store.commit("d", deletes(counts["after"])) and store.commit("e", deletes(counted(frame(spark, rows[20:]))))
    assert store.totals().count() == 0
    with pytest.raises(ValueError):
        store.commit("../x", inserts(counts["late"]))


def test_empty(spark):
    assert rolled_up(inserts(counted(frame(spark, corpus()).limit(0)))).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, t, ("en", None, "de")[k % 3], ("a", "b")[k % 2], 0) for k, (i, t) in enumerate(corpus())] + [(None, "no id", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for version, encoder in encoders():
        encode = encoder.encode_ordinary
        for _, t, lang, source, _ in rows:
            want[source, lang, version, "docs"] += 1
            want[source, lang, version, "tokens"] += len(encode(t or ""))
    got = {}
    for r in op3_token_counts(spark, str(tmp_path)).collect():
        got[r.source, r.lang, r.tokenizer, "docs"], got[r.source, r.lang, r.tokenizer, "tokens"] = r.n_docs, r.n_tokens
    assert got == dict(want)


def test_failed_commit_leaves_nothing(spark, tmp_path):
    store = TotalsStore(spark, str(tmp_path))
    broken = spark.range(1).selectExpr("'s' source", "'l' lang", "'t' tokenizer", "1L n_docs", "cast(raise_error('lost') as long) n_tokens")
    with pytest.raises(Exception):
        store.commit("one", broken)
    assert store.committed() == set() and store.totals().count() == 0
    assert store.commit("one", broken.withColumn("n_tokens", F.lit(5).cast("long")))
    assert [tuple(r) for r in store.totals().collect()] == [("s", "l", "t", 1, 5)]
