import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, label string, epoch long, place string"


def make(spark, rows):
    """A table like `documents`, with extra columns whose names the operators use inside."""
    full = [(i, t, lang, source, None if t is None else len(t), 7, "x", 1, None) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 7))) for _ in range(n))


def edited(text, seed, n):
    pick, words = random.Random(seed), text.split(" ")
    for at in pick.sample(range(len(words)), n):
        words[at] = f"new{seed}x{at}"
    return " ".join(words)


@pytest.fixture(scope="session")
def docs(spark):
    base = prose(1, 120)
    rows = [
        (1, base, "en", "src0"),
        (2, base, "en", "src0"),
        (3, edited(base, 3, 2), "en", "src1"),
        (4, base.upper(), None, "src1"),
        (5, None, "en", None),
        (6, "", "de", "src2"),
        (7, " \t\n ", "de", "src2"),
        (8, "one two three", "fr", "src3"),
        (9, "One  two\nthree", "fr", "src3"),
        (10, prose(2, 5), "es", "odd"),
        (11, prose(11, 40000), "en", "src0"),
        (11, prose(11, 40000), "en", "src0"),
        (None, prose(12, 90), "en", "src5"),
        (None, edited(prose(12, 90), 5, 1), "en", "src5"),
        (13, prose(13, 60) + " " + prose(14, 60), "en", "src6"),
        (14, prose(13, 60) + " " + prose(15, 60), "en", "src6"),
        (15, "mail a.b@example.com or 10.0.0.1, card 4111 1111 1111 1111, call +1 (555) 555-0100 é", "en", "src7"),
        (16, "  nbsp <|endoftext|> 日本語 \x01", "en", "src7"),
    ]
    rows += [(100 + i, edited(base, 100 + i, 1 + i % 5), "en", "src0") for i in range(40)]
    return make(spark, rows).repartition(5, F.xxhash64("text")).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return make(spark, []).cache()


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0), "extra") for i in range(100, 140)] + [(None, 1, 1, None), (1, None, None, None), (1, 1, 0, "twice"), (1, 1, 0, "twice")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")
