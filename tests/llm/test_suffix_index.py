import hashlib
import random

import numpy as np
import pytest

import sylva.llm.repeats as repeats
import sylva.llm.suffix_index as module
from sylva.llm.suffix_index import RunIndex, suffix_dedup

from .fixtures import corpus, frame, prose


def brute(rows, size):
    """Rows of (doc_id, text) with distinct ids."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - size + 1):
            s = data[k : k + size]
            if s in seen:
                gone[k : k + size] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cases():
    rng = random.Random(8)
    rows = list({i: (i, t) for i, t in corpus()}.values())
    rows += [(300, "ab" * 400), (301, "x" * 500), (302, "x" * 300 + "y" + "ab" * 90), (303, "\0" * 250 + "é" * 120)]
    shared = prose(rng, 40)
    return rows + [(310 + k, prose(rng, 3) + shared[k % 5 :] + prose(rng, 3)) for k in range(30)] + [(None, shared)]


@pytest.mark.parametrize("size,gram,most", [(100, 24, 512), (100, 24, 3), (100, 24, 1), (12, 4, 512), (12, 4, 2)])
def test_against_brute_force(spark, monkeypatch, size, gram, most):
    monkeypatch.setattr(module, "SHARD_BLOCKS", most)
    monkeypatch.setattr(module, "SHARD_BYTES", 3000)
    docs = frame(spark, cases())
    got = suffix_dedup(docs, size, gram=gram).collect()
    key = lambda r: (r[0] is None, r[0])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got), key=key) == brute(cases(), size)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeated_rows_and_empty_table(spark):
    text = prose(random.Random(1), 60)
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup(docs).collect())
    assert got == [(1, 0), (1, 0), (2, len(text.encode())), (3, 0)]
    assert suffix_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [512, 1])
def test_repeated_rows_beside_a_partly_equal_text(spark, monkeypatch, most):
    monkeypatch.setattr(module, "SHARD_BLOCKS", most)
    rng = random.Random(4)
    shared = prose(rng, 60)
    text, other = prose(rng, 20) + shared + prose(rng, 20), prose(rng, 20) + shared + prose(rng, 20)
    docs = frame(spark, [(1, text), (1, text), (2, other)])
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup(docs).collect())
    first, second = brute([(1, text), (2, other)], 100)
    assert first[2] == 0 < second[2]
    assert got == [first, first, second]


@pytest.mark.parametrize("most", [512, 1])
def test_clashing_block_hashes_remove_nothing_wrong(spark, monkeypatch, most):
    monkeypatch.setattr(module, "SHARD_BLOCKS", most)
    monkeypatch.setattr(repeats, "digests", lambda values, start, end, seed: np.zeros(len(start), np.uint64))
    rng = random.Random(6)
    shared, long = prose(rng, 40).encode()[:98].decode(errors="ignore"), prose(rng, 60)
    shared = {k: chr(64 + k) + shared + chr(64 + k) for k in range(1, 9)}  # no longer common string than 98 bytes
    rows = [(k, prose(rng, 30) + shared[k] + prose(rng, 30)) for k in range(1, 9)] + [(9, long), (10, prose(rng, 9) + long)]
    got = {r.doc_id: r for r in suffix_dedup(frame(spark, rows)).collect()}
    want = {i: n for i, _, n, _, _ in brute(rows, 100)}
    assert all(got[i].n_removed <= want[i] for i in want)
    assert all(want[i] == 0 for i in range(1, 10))
    spans = [(s.start, s.end) for s in got[10].spans]  # with every block of an anchor in one class some repeats are missed
    text = rows[9][1].encode()
    assert spans and all(b - a >= 100 and text[a:b] in long.encode() for a, b in spans)


def test_one_byte_throughout_and_copies_of_long_texts(spark):
    rng = random.Random(7)
    long = prose(rng, 30_000)
    rows = [(1, "x" * 30_000), (2, long), (3, "y" + long), (4, long[:90_000] + "z" + long[90_000:]), (5, "x" * 5_000)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup(frame(spark, rows), data=False).collect())
    assert got == brute(rows, 100)


def test_index():
    rng = random.Random(2)
    for _ in range(40):
        texts = ["".join(rng.choice("ab\0\xff") for _ in range(rng.randint(0, 60))).encode("latin-1") for _ in range(rng.randint(1, 9))]
        texts += [texts[0], texts[-1][3:]]
        index = RunIndex(texts)
        joined = [s for k, t in enumerate(texts) for s in (*(b + 1 for b in t), -len(texts) + k)]
        order = sorted(range(len(joined)), key=lambda i: joined[i:])
        neighbour, statistics = index.matching_statistics()
        follows = dict(zip(order[1:], order))
        assert index.rows().tolist() == np.argsort(order).tolist()
        assert {i: n for i, n in enumerate(neighbour.tolist()) if i != order[0]} == follows
        transform = [joined[i - 1] for i in order]
        assert np.repeat(index.symbols, index.sizes).tolist() == [max(s, 0) for s in transform]
        common = [0] * len(order)
        for a, b in zip(order, order[1:]):
            while a + common[b] < len(joined) and b + common[b] < len(joined) and joined[a + common[b]] == joined[b + common[b]]:
                common[b] += 1
        assert statistics.tolist() == common
        for size in (1, 3, 7):
            seen, want = set(), []
            for i in range(len(joined)):
                s = tuple(joined[i : i + size])
                if len(s) == size and min(s) > 0:
                    if s in seen:
                        want.append(i)
                    seen.add(s)
            assert index.repeated(size).tolist() == want


def test_places_by_value_packed_and_not():
    rng = np.random.default_rng(4)
    for key in (rng.integers(0, 50, 1000), rng.integers(0, 1 << 62, 1000), rng.integers(0, 3, 1000) << 61, np.zeros(0, np.int64)):
        order, ordered = module._ordered(key)
        want = sorted(range(len(key)), key=lambda i: (key[i], i))
        assert order.tolist() == want and ordered.tolist() == key[want].tolist()


def test_an_index_fits_a_cache():
    """Arrays of eight bytes a place stay within some 2 MB."""
    assert module.SHARD_BYTES * 8 <= 2 << 20
