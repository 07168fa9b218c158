import hashlib
import random

import numpy as np

import sylva.llm.line_dedup as module
from sylva.llm.line_dedup import LEAST_WORDS, line_dedup

from .fixtures import corpus, frame, prose


def one(a, b):
    """Whether two sequences are within one edit."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near(a, b):
    """Whether two word lists are within the edit bound."""
    x, y = (b" ".join(w).decode() for w in (a, b))
    if min(len(a), len(b)) >= LEAST_WORDS and one(a, b):
        return True
    if min(len(x), len(y)) < 5:
        return False
    if max(len(a), len(b)) < LEAST_WORDS and one(x, y):
        return True
    short, long = sorted((x, y), key=len)
    return any(long[i] == " " and long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    lines = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n") if t else []):
            if w := line.encode().split():
                lines.append(((i is None, i), k, w, id(t)))
    lines.sort(key=lambda x: x[:2])
    gone = {}
    for n, (i, k, w, _) in enumerate(lines):
        if any((a == w or near(a, w)) and (j, m) < (i, k) for j, m, a, _ in lines[:n]):
            gone.setdefault(i[1], set()).add(k)
    out = []
    for i, t in rows:
        drop, parts = gone.get(i, set()), (t or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(parts) if k not in drop)
        out.append((i, sum(1 for x in parts if x.encode().split()), len(drop), sorted(drop), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def cases():
    rng = random.Random(6)
    base = [prose(rng, rng.randint(1, 14)) for _ in range(25)]

    def changed(line):
        w = line.split()
        for _ in range(rng.choice((0, 1, 1, 2))):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (kind > 0)] = [] if kind == 1 and len(w) > 1 else [rng.choice("new x y".split())]
        return rng.choice(("", " ", "\t")) + "  ".join(w) + rng.choice(("", " \r"))

    rows = list({i: (i, t) for i, t in corpus()}.values())
    rows += [(100 + i, "\n".join(rng.choice((changed(rng.choice(base)), prose(rng, 6), "", "a a b a a", "a a a a b b a")) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    shorts = ["Table of contents", "Tableof contents", "Table of content", "Tablé of contents", "Table oX contents", "Table  of contents", "abcd", "abcde", "abcdf", "abc de", "ab cde", "a b c d e f", "ab c d e f", "a bc d e f", "one two three four", "one two three fourX", "one two three fo ur", "onetwo three fo ur", "one two thr ee fo ur", "日本語テキ", "日本語テキス", "日本誤テキス"]
    rows += [(200 + i, "\n".join(rng.choice(shorts) for _ in range(rng.randint(1, 4)))) for i in range(30)]
    return rows + [(None, base[0] + "\n" + prose(rng, 9))]


def test_against_brute_force(spark):
    rows = cases()
    docs = frame(spark, rows)
    key = lambda r: (r[0] is None, r[0])
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.removed, r.kept_sha256, r.kept) for r in line_dedup(docs).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    assert line_dedup(docs.limit(0)).count() == 0


def test_repeated_rows(spark):
    line = "one two three four five six"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line + " seven"), (2, "other")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in line_dedup(docs).collect()) == [(1, 0), (1, 0), (2, 0), (2, 1)]


def thue_morse(n, a, b):
    one = [(a, b)[bin(i).count("1") % 2] for i in range(n)]
    return one, [(b, a)[bin(i).count("1") % 2] for i in range(n)]


def test_lines_that_polynomials_confuse(spark):
    one, two = (" ".join(w) for w in thue_morse(1024, "left", "right"))
    docs = spark.createDataFrame([(1, one), (2, two), (3, two + " more"), (4, one)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in line_dedup(docs).collect()) == [(1, 0), (2, 0), (3, 1), (4, 1)]


def removed(spark, *lines):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return sorted(r.doc_id for r in line_dedup(docs, texts=False).collect() if r.n_removed)


def test_short_lines_and_spaces(spark):
    """One character in a short line, one space in any line; two letters in two words are beyond the bound."""
    long = "the quick brown fox jumps over the lazy dog"
    lines = ["All rights reserved", "All rights reserve", "All rightsreserved", "All Rights Reserved", "Menu", "Menus", long, long.replace("jumps", "jum ps"), long.replace("quick", "quack").replace("lazy", "lacy")]
    assert removed(spark, *lines) == [1, 2, 7]
    # A space that makes five words of four, and a chain in which only neighbours are near.
    assert removed(spark, "one two three four", "one two three fo ur", "one two th ree fo ur", "one two th ree four") == [1, 2, 3]
    assert removed(spark, "abcd", "abcdx", "bcdx", "") == []


def test_one_long_word(spark):
    word = "".join(random.Random(2).choice("abcdefgh") for _ in range(300_000))
    assert removed(spark, word, word[:1000] + "X" + word[1001:], word[:7] + word[8:], word[:7] + word[9:]) == [1, 2, 3]


def test_edit_distance_is_verified(spark, monkeypatch):
    """Where all lines' variants hash alike, only true neighbours of the earliest line go."""
    real = module.lacking

    def confused(units, start, end, base):
        line, at, hashes = real(units, start, end, base)
        return line, at, np.zeros_like(hashes)

    monkeypatch.setattr(module, "lacking", confused)
    lines = [f"{c}1 {c}2 {c}3 {c}4 {c}5 {c}6" for c in "abcdef"]
    docs = spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "doc_id long, text string")
    keyed = docs.selectExpr("doc_id did", "0L th", "0L line", "cast(text as binary) words")
    assert module._near(keyed).count() == 0
    more = docs.selectExpr("doc_id + 10 did", "0L th", "0L line", "cast(replace(text, 'a3', 'zz') as binary) words").where("did = 10")
    assert [r.did for r in module._near(keyed.union(more)).collect()] == [10]


def test_very_long_lines_and_texts(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(9999)}" for _ in range(6000)]
    changed = words[:3000] + ["other"] + words[3001:]
    many = "\n".join(f"line number {k} of a long text" for k in range(4000))
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:50] + changed[52:])), (4, many), (5, "line number 77 of a long text")]
    got = {r.doc_id: r.n_removed for r in line_dedup(frame(spark, rows), texts=False).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 3999, 5: 1}


def test_variants_are_hashes_of_what_is_left():
    rng = random.Random(1)
    lines = [" ".join(rng.choice(("a", "b", "c", "ab", "ca")) for _ in range(rng.randint(1, 9))).encode() for _ in range(200)]
    for base in module.PRIME_BASES:
        by_left, by_hash = {}, {}
        for line, at, h in zip(*(c.tolist() for c in module.variants(lines, base))):
            if at == module.SPACE:
                continue
            w = lines[line].split() if len(lines[line].split()) >= LEAST_WORDS else lines[line].decode()
            left = ("whole", lines[line]) if at < 0 else (type(w), tuple(w[:at]) + tuple(w[at + 1 :]))
            if at >= 0:
                assert by_left.setdefault(left, h) == h and by_hash.setdefault(h, left) == left
        spaced = {}
        for line, at, h in zip(*(c.tolist() for c in module._without_space(lines, module.Words(lines), base))):
            spaced.setdefault(h, set()).add((line, at))
        wholes = {next(iter(v for v, a in found if a == module.NOTHING)): h for h, found in spaced.items() if any(a == module.NOTHING for _, a in found)}
        for line, text in enumerate(lines):
            gaps = [i for i, c in enumerate(text) if c == 32]
            for other in [text[:i] + text[i + 1 :] for i in gaps]:
                if other in lines and (at := lines.index(other)) in wholes:
                    assert (line, module.SPACE) in spaced[wholes[at]]
