"""Small corpora with nulls, empty and long texts, ties, repeated rows and copies."""

import random

WORDS = "alpha beta gamma delta Eta theta iota kappa Lambda mu nu xi omicron été straße niño pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text) rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(6)]
    shared = prose(rng, 70)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two"), (5, "12345 --- !!"), (6, prose(rng, 5000))]
    for i in range(7, n):
        kind = i % 6
        text = rng.choice(base)
        if kind == 1:
            words = text.split()
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = " ".join(words)
        elif kind == 2:
            text = prose(rng, rng.randint(0, 40)) + " " + shared + "\n" + prose(rng, rng.randint(0, 40))
        elif kind == 3:
            text = text.replace(" ", "  \n", 3)
        elif kind == 4:
            text = prose(rng, rng.randint(1, 120))
        rows.append((i, text))
    rows.append(rows[10])  # a row that repeats
    rows.append((rows[11][0], "another text under the same id " + shared))
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, norm string, kept string"


def frame(spark, rows):
    """``documents`` with further columns, some of whose names operators use too."""
    full = [(i, t, "en" if i and i % 2 else None, "src0", None if t is None else len(t), 1, "x", None) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)
