import hashlib
import random
import re

import numpy as np
import pytest

import sylva.llm.repeats as repeats_module
from sylva.llm import anchors
from sylva.llm.anchors import Bytes, Words, winnow
from sylva.llm.substring_dedup import substring_dedup

from .fixtures import corpus, frame, prose


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, size):
    order = lambda i: 2**63 if i is None else i
    low = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            low[key] = min(order(i), low.get(key, order(i)))
    out = []
    for i, t in rows:
        w, gone = split(t), set()
        for k in range(len(w) - size + 1):
            if low[tuple(w[k : k + size])] < order(i):
                gone |= set(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((order(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize("size,gram", [(50, 14), (8, 3)])
def test_against_brute_force(spark, size, gram):
    rng = random.Random(3)
    rows = corpus() + [(300 + i, "x " * (60 + i)) for i in range(4)] + [(None, prose(rng, 80)), (None, prose(rng, 80))]
    rows.append((400, rows[-1][1] + " tail"))
    docs = frame(spark, rows)
    got = substring_dedup(docs, size, gram=gram).collect()
    assert sorted((2**63 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == brute(rows, size)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert substring_dedup(docs.limit(0), size, gram=gram).count() == 0


@pytest.mark.parametrize("unit", [Bytes, Words])
def test_every_window_has_one_anchor_that_its_content_fixes(unit):
    rng = random.Random(5)
    texts = [prose(rng, n).encode() for n in (0, 3, 40, 200, 90)] + [b"", b"aaaa " * 60]
    texts.append(b"other start " + texts[3])
    size, gram = 20, 6
    seq = unit(texts)
    got = winnow(seq, size, gram)
    seen, by_content = set(), {}
    units = seq.units.tolist()
    for anchor, text, begin, n, offset in zip(*(got[k].tolist() for k in ("anchor", "text", "begin", "windows", "offset"))):
        start = begin - int(seq.start[text])
        for s in range(start, start + n):
            assert (text, s) not in seen
            seen.add((text, s))
            assert s <= start + offset <= s + size - gram
            place = int(seq.start[text]) + s
            assert by_content.setdefault(tuple(units[place : place + size]), (anchor, start + offset - s)) == (anchor, start + offset - s)
    assert seen == {(t, s) for t in range(len(texts)) for s in range(int(seq.end[t] - seq.start[t]) - size + 1)}
    assert np.all(got["windows"] > 0)


@pytest.mark.parametrize("unit", [Bytes, Words])
def test_anchors_do_not_depend_on_what_is_worked_on_together(unit, monkeypatch):
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"ab c") for _ in range(rng.choice((0, 5, 30, 200, 3000)))) for _ in range(40)]

    def found(most):
        out, base = [], 0
        for a, b in anchors.slices(np.array([len(t) for t in texts]), most):
            seq = unit(texts[a:b])
            got = winnow(seq, 20, 6)
            out += [(a + t, begin - int(seq.start[t]), *rest) for t, begin, *rest in zip(*(got[k].tolist() for k in ("text", "begin", "windows", "offset", "anchor")))]
        return out

    whole = found(1 << 20)
    assert len(whole) > 100 and found(1) == found(4000) == whole
    monkeypatch.setattr(anchors, "CHUNK", 128)
    assert found(1 << 20) == whole


def thue_morse(n, a, b):
    """Two strings of n characters that hash alike by any polynomial of odd base modulo 2**64."""
    one = "".join((a, b)[bin(i).count("1") % 2] for i in range(n))
    return one, "".join((b, a)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomials_confuse(spark):
    one, two = thue_morse(2048, "a", "b")
    rest = prose(random.Random(1), 49)
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{two} {rest}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup(docs).collect()) == [(1, 0), (2, 0), (3, 50)]


def test_only_compared_words_are_removed(spark, monkeypatch):
    """Blocks and windows that all hash alike find false partners, none of which is believed."""
    monkeypatch.setattr(repeats_module, "digests", lambda units, start, end, seed: np.zeros(len(start), np.uint64))
    rng = random.Random(2)
    shared = prose(rng, 20)
    rows = [(k, f"{prose(rng, 30)} {shared} {prose(rng, 30)}") for k in range(6)]
    assert [r.n_removed for r in substring_dedup(frame(spark, rows)).collect()] == [0] * 6


def test_very_long_text(spark):
    rng = random.Random(4)
    long, passage = prose(rng, 150_000), " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"{long} {passage}"), (2, f"head {passage} tail"), (3, f"other {long}")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup(docs, texts=False).collect()}
    assert got[2].n_removed == 60 and [(s.start, s.end) for s in got[2].spans] == [(1, 61)]
    assert got[3].n_removed == 150_000 and got[1].n_removed == 0


def test_the_largest_id_and_null_ids(spark):
    text = prose(random.Random(3), 80)
    docs = spark.createDataFrame([(1, text), (2**63 - 1, text), (None, text + " more")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()} == {1: 0, 2**63 - 1: 80, None: 80}
