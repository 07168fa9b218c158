import random
import re

import sylva.llm.decontaminate as module
from sylva.llm.decontaminate import contamination, decontaminate, judged

from .fixtures import corpus, frame, prose


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        for k in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if x := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    ids |= x
        out.append((i, len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def cases():
    rng = random.Random(4)
    rows = corpus()
    texts = [t for _, t in rows if t]
    items = [(1, None), (2, ""), (3, "one two"), (4, "alpha beta gamma"), (None, "mu nu xi"), (5, "alpha"), (5, "12345")]
    for k in range(20):
        w = words(rng.choice(texts))
        at = rng.randrange(max(1, len(w) - 20))
        items.append((10 + k, prose(rng, 4) + " " + ", ".join(w[at : at + rng.randint(10, 40)]).upper() + "! " + prose(rng, 3)))
    return rows, items


def test_against_brute_force(spark):
    rows, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for shard_words in (500_000, 30):
        module.SHARD_WORDS = shard_words
        got = judged(contamination(frame(spark, rows), bench)).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got) == brute(rows, items)
    module.SHARD_WORDS = 500_000


def test_clean_documents_stay(spark):
    rows, items = cases()
    items = [x for x in items if x[0] not in (4, 5)]
    docs = frame(spark, rows)
    stay = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == [i for i, _, _, _, bad in brute(rows, items) if not bad]


def test_empty_tables(spark):
    docs = frame(spark, corpus())
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).count() == docs.count()
    assert contamination(docs.limit(0), none).count() == 0


def test_spans_are_removed(spark):
    item = " ".join(f"Word{k}" for k in range(15))
    docs = spark.createDataFrame([(1, f"Before, {item}; after é."), (2, "clean text"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item.lower())], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate(docs, items, remove="spans").collect()}
    assert got == {1: "Before, ; after é.", 2: "clean text", 3: None}
