import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, ties, repeats."""
    long = prose(1, 12_000)
    texts = [
        (1, prose(2, 80)), (2, None), (3, ""), (4, long), (5, long), (5, long), (6, prose(2, 80) + " tail"), (None, prose(2, 80)), (None, None),
        (7, " \t\n "), (8, "one"), (9, "two words"), (10, "é" * 40 + prose(3, 60)), (11, "é" * 40 + prose(4, 60)), (12, "a" * 3000), (13, "a" * 2000),
        (14, "x"), (14, prose(5, 70)), (-3, prose(5, 70)), (15, "line\nline\nline\n\n" + prose(6, 60)), (16, "\x00\u2028 <|endoftext|> \U0001f600"),
    ]
    sources = ["hot", "hot", None, "cold", ""]
    return [(i, t, None if k % 3 else "en", sources[k % 5], None if k % 4 == 0 else len(t or "")) for k, (i, t) in enumerate(texts)]


@pytest.fixture
def documents(spark, awkward):
    return spark.createDataFrame(awkward, "doc_id long, text string, lang string, source string, n_chars long")


CLASHES = "_bucket bucket key keys n label class node root digest docs place rank total local ahead trusted_id own_id learnt_id slot shard size fraction stratum form".split()


@pytest.fixture
def crowded(documents):
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    return documents.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 0), (6, 1, 0), (12, 0, 0), (13, 0, None), (None, 1, 0), (4, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture
def benchmark_items(spark):
    rows = [(1, prose(2, 80)), (2, None), (3, ""), (4, "one"), (5, prose(3, 20)), (5, prose(3, 20)), (None, prose(6, 30)), (6, "two words")]
    return spark.createDataFrame(rows, "item_id long, text string")


def bag(df):
    from collections import Counter

    return Counter(map(tuple, df.collect()))
