import re

import numpy as np
import xxhash
from sylva.llm import simhash
from sylva.llm.simhash import GrayIndex, fingerprint, gray_rank, links, near_dedup, near_groups

from .fixtures import corpus, frame


def mark(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    marks = [(i, mark(t)) for i, t in rows]
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(marks)):
        for b in range(a):
            if (marks[a][1] ^ marks[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(marks):
        low[find(k)] = min(i, low.get(find(k), i))
    return sorted((i, m, low[find(k)]) for k, (i, m) in enumerate(marks))


def test_fingerprint():
    for text in (None, "", "A", "a B", "The Été c d e f", "x " * 1000 + "y z"):
        assert int.from_bytes(fingerprint(None if text is None else text.encode()), "big") == mark(text)


def test_groups_against_brute_force(spark):
    rows = corpus()
    docs = frame(spark, rows)
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in near_groups(docs).collect())
    assert got == brute(rows)
    stay = near_dedup(docs)
    assert stay.columns == docs.columns
    assert {r.doc_id for r in stay.collect()} == {c for _, _, c in got}
    assert near_groups(docs.limit(0)).count() == 0


def crowd(n, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n // 8 + 1, dtype=np.uint64)
    out = [base]
    for _ in range(7):
        x = base.copy()
        for _ in range(rng.integers(1, 6)):
            x ^= np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)
        out.append(x)
    return np.unique(np.concatenate(out))


def test_gray_index_finds_every_pair():
    for n in (1, 5, 17, 300, 2000):
        fps = crowd(n)
        fps = fps[np.argsort(gray_rank(fps))]
        a, b = GrayIndex(fps).links()
        i, j = np.where(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
        assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(i.tolist(), j.tolist()))


def test_split_nodes_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_MAX", 8)
    rng = np.random.default_rng(5)
    centre = np.uint64(0x0123456789ABCDEF)
    dense = np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 5), replace=False))) for _ in range(150)], np.uint64)
    fps = np.unique(np.concatenate((dense, crowd(100))))
    found = links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()

    def parts(pairs):
        root = {int(x): int(x) for x in fps}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for u, v in pairs:
            root[find(u)] = find(v)
        groups = {}
        for x in root:
            groups.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, groups.values()))

    i, j = np.where(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    assert all(bin((r.u ^ r.v) % 2**64).count("1") <= 3 * len(fps) for r in found)
    assert parts([(r.u % 2**64, r.v % 2**64) for r in found]) == parts([(int(fps[a]), int(fps[b])) for a, b in zip(i, j)])
