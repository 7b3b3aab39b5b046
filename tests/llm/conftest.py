import random

import pytest

WORDS = [a + b + c for a in ("ba", "ke", "lo", "mi", "nu", "ra", "si") for b in ("dor", "len", "mar", "tis", "vun") for c in ("", "a", "en", "ot")]


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, columns with clashing names."""
    rows = [
        (1, prose(1, 120), "en", 5, "x"),
        (2, None, None, None, None),
        (3, "", "en", 0, "x"),
        (4, " \n\t ", "fr", 4, "y"),
        (5, prose(1, 120), "en", 1, "x"),
        (5, prose(1, 120), "en", 1, "x"),
        (6, prose(2, 60_000), "en", 1, "x"),
        (7, prose(1, 60) + " " + prose(3, 70), None, 1, None),
        (None, prose(1, 120), "de", 1, "z"),
        (8, "Ünï  çödé 👍 it's <|endoftext|> a@b.com 1.2.3.4", "de", 1, "z"),
        (9, "x" * 200_000, "de", 1, "z"),
        (10, "7" * 100_000 + "." * 1000 + "@" * 1000, "de", 1, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, digest int, bands string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
