import random

import pytest

WORDS = "river stone quiet lamp orchard bridge copper winter letter meadow signal harbor velvet engine paper market".split()

#: Rows with everything that may go wrong: nulls, blanks, repeats, ties and columns that clash with inner names.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, "same text of several plain words here"),
    (7, "same text of several plain words here"), (7, "same text of several plain words here"), (8, "Ünïcödé 😀   text here"),
    (9, "x" * 30_000), (10, "word " * 20_000), (None, "a row without an id and with some words"),
]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefg") for _ in range(n))


@pytest.fixture
def odd(spark):
    rows = [(i, t, "node", "component", 1, "part", 2.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, component string, rank int, part string, score double")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
