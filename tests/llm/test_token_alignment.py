import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import sylva.llm.token_alignment as module
from sylva.llm.token_alignment import alignment, byte_decoder

from .fixtures import corpus, frame


@pytest.fixture(scope="module")
def encoders():
    one = Tokenizer.from_file(public_tokenizers.path(module.VOCABULARY))
    one.encode_special_tokens = True
    return one, SentencePieceProcessor(model_file=public_tokenizers.path(module.PIECES))


def groups_of(text, encoders):
    """[(a ids, b ids)] of one text, byte by byte."""
    one, other = encoders
    if not text:
        return []
    back, whole = byte_decoder(), (" " + text).encode()
    a, b = one.encode(" " + text, add_special_tokens=False).ids, other.encode(text)
    bytes_a = [bytes(back[c] for c in one.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(other.id_to_piece(i)[3:5], 16)]) if other.is_byte(i) else other.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    ends_a, ends_b = list(accumulate(map(len, bytes_a))), list(accumulate(map(len, bytes_b)))
    out, start = [], 0
    for stop in sorted(set(ends_a) & set(ends_b)):
        out.append(([i for i, e in zip(a, ends_a) if start < e <= stop], [i for i, e in zip(b, ends_b) if start < e <= stop]))
        start = stop
    return out


def brute(rows, encoders):
    each = [(i, groups_of(t, encoders)) for i, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for _, g in each]
    counts = Counter(p for x in links for p in set(x))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for (i, g), x in zip(each, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(x), sum(counts[p] == most[p[0]] for p in x), sum(counts[p] for p in x), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out, counts


def texts():
    rng = random.Random(6)
    alphabet = "aé ñ\n\t'sß12<|endoftext|><s>\x85\xa0　中文字😀​.\x1f\x00"
    rows = [r for r in corpus() if len(r[1] or "") < 3000]
    rows += [(100 + i, "".join(rng.choice(alphabet) for _ in range(60))) for i in range(60)]
    return rows + [(200, "has ▁ inside"), (201, "<|endoftext|> is text"), (202, "  two spaces"), (203, "文" * 40 + "x" * 50), (None, "one two")]


def result(found):
    return sorted(map(str, map(tuple, found.collect())))


@pytest.mark.parametrize("block_bytes", [500, 3000, 1 << 22])
def test_against_brute_force(spark, encoders, block_bytes):
    rows = texts()
    found, pairs = alignment(frame(spark, rows), block_bytes=block_bytes)
    want, counts = brute(rows, encoders)
    assert result(found) == sorted(map(str, want))
    if block_bytes == 3000:
        assert {(r.a, r.b): r["count"] for r in pairs.collect()} == counts


def test_links_in_slices(encoders):
    one, other = module.byte_level(), module.piece_level()
    for _, text in texts():
        found = module.aligned(text, one, other)
        want = Counter((x, y) for a, b in groups_of(text, encoders) for x in a for y in b)
        for most in (1, 3, 7, 1 << 22):
            pairs, times = module.linked(*found, most=most)
            assert {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in zip(pairs, times)} == want
            assert (pairs[1:] > pairs[:-1]).all()


def test_long_text_hot_pairs_and_empty_table(spark, encoders):
    long = "the same words again, " * 20_000
    rows = [(0, long)] + [(i, "the same words again") for i in range(1, 400)]
    got = {r.doc_id: r for r in alignment(frame(spark, rows))[0].collect()}
    short = brute([(1, "the same words again")], encoders)[0][0]
    assert got[1].groups_sha256 == short[7] and got[1].n_best == got[1].n_links == short[4]
    assert got[1].count_sum == 400 * got[1].n_links and got[0].n_links >= 80_000
    found, pairs = alignment(frame(spark, rows).limit(0))
    assert found.count() == 0 and pairs.count() == 0
    assert {tuple(r)[1:] for r in alignment(frame(spark, [(1, None), (2, "")]))[0].collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_query_on_the_smallest_tables(spark, encoders):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert result(module.op13_token_alignment(spark, folder)) == sorted(map(str, brute(rows, encoders)[0]))
