import random

import pytest

WORDS = "alpha beta gamma delta river stone cloud paper light green house water table chair north south quick brown silver window garden music".split()


@pytest.fixture(scope="session")
def prose():
    """prose(rng, n): n random words with some punctuation and line ends."""

    def make(rng: random.Random, n: int) -> str:
        out = []
        for _ in range(n):
            w = rng.choice(WORDS) + rng.choice(["", "", "", "s", "ing", "é"])
            out.append(w.capitalize() if rng.random() < 0.1 else w)
            out.append(rng.choice([" "] * 9 + [".\n"]))
        return "".join(out)

    return make


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, _row long"


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in every column, empty and long texts, repeated rows, columns whose names clash."""
    rng = random.Random(9)
    long = prose(rng, 6000)
    rows = [
        (1, None, None, None, None, 1.0, "a", 1), (2, "", "en", "s", 0, None, None, None), (3, "  \n\t ", "en", "s", 5, 0.0, "x", 2), (4, "one", "en", "s", 3, 0.0, "x", 2),
        (5, long, "en", "s", len(long), 0.0, "x", 2), (5, long, "en", "s", len(long), 0.0, "x", 2), (6, long + " tail", "en", "s", 1, 0.0, "x", 2),
        (None, "no id here", "en", "s", 1, 0.0, "x", 2), (7, "日本語 テキスト 😀 <s> </s>", "en", "s", 1, 0.0, "x", 2), (8, "a\x00b", "en", "s", 3, 0.0, "x", 2),
    ]
    return spark.createDataFrame([r for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
