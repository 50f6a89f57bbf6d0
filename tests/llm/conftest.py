"""Documents with every awkward case, under columns that clash with names the operators use."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, fp long, score double, kept boolean, _row string"


def words(seed, n, of=40):
    draw = random.Random(seed)
    return " ".join(draw.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(draw.randrange(of)) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None, 7, "k", 1, 0.5, False, "r")


def awkward():
    long = words(1, 30_000)
    return [
        row(1, "the cat sat on the mat\nand the dog ran"), row(2, "the  cat sat\ton the mat and the dog ran", "en", "b"), row(3, None), row(4, ""),
        row(5, " \t\n"), row(6, long, "de", "c"), row(7, long, "de", "c"), row(7, long, "de", "c"), row(None, "no id at all", None, None),
        row(None, "no id at all", None, None), row(8, "Ünïcødé 你好 \U0001f600 text", "fr", "b"), row(9, "x", "fr", None), row(10, "THE CAT SAT ON THE MAT and the dog ran", "en", "a"),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
