import random
import zlib

import numpy as np

from sylva.llm.language_id import _chains, identify, label_words, learn, op8_language_id, posteriors

from .fixtures import corpus, frame

STEMS = {"aa": "ba be bi bo bu da de".split(), "bb": "kra kre stri stro zlu gra".split(), "cc": "ñi ño lla lle rra éa".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def labelled(n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(STEMS))
        rows.append((i, text(rng, lang, rng.randint(3, 200)), lang if i % 9 else None))
    return rows


def test_posteriors_against_enumeration():
    rng = np.random.default_rng(0)
    scores, trans = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    mask = np.array([[True, True, True, False]])
    found, pairs = posteriors(scores, mask, trans)
    marginals, want = np.zeros((3, 3)), np.zeros((3, 3))
    total = 0.0
    for a in range(3):
        for b in range(3):
            for c in range(3):
                p = np.exp(scores[0, 0, a] + scores[0, 1, b] + scores[0, 2, c] + trans[a, b] + trans[b, c])
                total += p
                for i, x in enumerate((a, b, c)):
                    marginals[i, x] += p
                want[a, b] += p
                want[b, c] += p
    assert np.allclose(found[0, :3], marginals / total) and np.allclose(pairs, want / total)


def test_chains():
    at, mask, of = _chains(np.array([0, 65, 3]))
    assert mask.sum(axis=1).tolist() == [64, 1, 3] and of.tolist() == [1, 1, 2] and at[1, 0] == 64 and at[2, 2] == 67


def test_held_out_accuracy_and_defined_results(spark):
    rows = labelled() + [(900, None, "aa"), (901, "", "bb"), (902, "12 -- !", None), (None, "kra stri", "bb")]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = identify(docs, learn(docs)).collect()
    truth = {i: lang for i, _, lang in rows}
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 900 and truth[r.doc_id] and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(right) > 20 and sum(right) >= 0.97 * len(right)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)


def test_switched_text_is_labelled_by_word(spark):
    docs = spark.createDataFrame(labelled(), "doc_id long, text string, lang string")
    rng = random.Random(9)
    mixed = text(rng, "aa", 30) + " " + text(rng, "bb", 30)
    runs = label_words(spark.createDataFrame([(1, mixed), (2, None)], "doc_id long, text string"), learn(docs)).collect()
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in runs}
    assert found[2] == [] and found[1][0][2] == "aa" and found[1][-1][2] == "bb" and abs(found[1][0][1] - 30) <= 2


def test_nothing_to_learn_from(spark):
    docs = frame(spark, corpus()).drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert learn(docs) is None
    assert {r.lang_pred for r in identify(docs, None).collect()} == {"und"}
    assert identify(docs.limit(0), None).count() == 0
