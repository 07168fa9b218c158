import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sylva.llm.packing import cuts, match_runs, pack, pieces
from sylva.llm.tokens import token_ids

from .fixtures import corpus, frame

NAMES = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


def test_ids_equal_the_tokenizer_file():
    rng = random.Random(2)
    plain = Tokenizer.from_file(public_tokenizers.path(NAMES[0]))
    alphabet = "aé ñ\n\t'sß12<|endoftext|>\x85\xa0　中😀​.\x1f"
    texts = ["", "it's <|endoftext|> x"] + ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(200)]
    texts += ["".join(chr(rng.randrange(1, 0x250)) for _ in range(80)) for _ in range(200)]
    for t in texts:
        assert list(token_ids(t, *NAMES)) == plain.encode(t, add_special_tokens=False).ids


def test_cuts():
    assert cuts(1) == [(0, 1)] and cuts(2048) == [(0, 2048)] and cuts(2049) == [(0, 1), (1, 2048)]
    assert cuts(5000) == [(0, 904), (904, 2048), (2952, 2048)]


def test_runs_match_best_fit_decreasing():
    rng = random.Random(7)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 64) for _ in range(rng.randint(1, 400))), reverse=True)
        gaps: list[int] = []
        for s in sizes:  # one at a time
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps[gaps.index(min(fit))] -= s
            else:
                gaps.append(64 - s)
        runs = match_runs({s: sizes.count(s) for s in set(sizes)}, 64)
        assert len({q + i for _, _, n, q, _ in runs for i in range(n)}) == len(gaps)


def test_round_trip(spark):
    rows = corpus()
    got = pack(pieces(frame(spark, rows), with_ids=True)).collect()
    encoded = sorted((i, tuple(token_ids(t, *NAMES)) + (0,)) for i, t in rows)
    by_row = {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r.ids_crc32 and len(r["ids"]) == r.length
        by_row.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        if sum(j == i for j, _ in rows) == 1:
            whole = sorted(by_row[i], key=lambda r: r.start)
            assert tuple(x for r in whole for x in r["ids"]) == dict(encoded)[i]
            assert [r.piece for r in whole] == list(range(len(whole)))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(r.length for r in got) == sum(len(x) for _, x in encoded)
    assert len(sequences) <= 1.1 * sum(r.length for r in got) / 2048 + 2


def test_empty(spark):
    assert pack(pieces(frame(spark, corpus()).limit(0))).count() == 0
