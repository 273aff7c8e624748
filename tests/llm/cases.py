"""Rows with nulls, empty and long texts, ties, repeats and columns whose names clash with the operators' own."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, word string, pos int, key string, score double, keep boolean, "
    "topic string, text_hash long, row long, tokens long, spans string, units int"
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n=9):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", "é"]) for _ in range(n)).capitalize() + "."


def texts(seed=1, n=24):
    rng = random.Random(seed)
    made = [" ".join(sentence(rng) for _ in range(rng.randint(3, 9))) for _ in range(n)]
    shared = " ".join(sentence(rng) for _ in range(8))
    near = made[0].split()
    near[5] = "changed"
    long = " ".join(sentence(rng) for _ in range(900))
    return [
        *made, None, "", "   \n", "x", "É", made[1], made[1], made[2] + " " + shared, shared + "\n" + made[3], " ".join(near), long,
        made[4] + " " + long[1000:2500], "mail a.b@ex-ample.org and 10.0.0.300 or 10.0.0.1, +1 (555) 010-9999 x 4111 1111 1111 1111",
    ]


def rows(seed=1):
    found = [(i, t) for i, t in enumerate(texts(seed))]
    found += [found[1], found[1], (None, "no number here at all."), (7, "another text of number seven.")]
    return [(i, t, None if k % 7 == 3 else ["en", "de"][k % 2], None if k % 11 == 5 else f"src{k % 3}", len(t or ""), "w", 1, "k", 0.5, True, "t", 5, 6, 7, "s", 8) for k, (i, t) in enumerate(found)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def plain(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, text string")


def key(r):
    return tuple((x is None, str(x)) for x in r)


def same(got, want):
    assert sorted(got, key=key) == sorted(want, key=key)
