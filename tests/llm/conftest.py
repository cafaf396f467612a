import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, row string, scan int"
LETTERS = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx"}


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empties, repeats, a long text, and extra columns whose names operators use."""
    rng = random.Random(3)
    out = []
    for i in range(90):
        lang = rng.choice(list(LETTERS))
        out.append((i, prose(rng, LETTERS[lang], rng.randint(1, 80)), lang, f"s{i % 4}" if i % 4 else "hot"))
    out += [(90, None, "aa", "s1"), (91, "", None, None), (None, "abc def gh", "aa", "s2"), (93, "12 34 !!", "aa", None), (5, out[5][1], out[5][2], out[5][3])]
    out += [(100 + i, out[7][1], "bb", "hot") for i in range(20)] + [(130, prose(rng, LETTERS["aa"], 60_000), "aa", "s3"), (131, "h" * 5000, "aa", "s3")]
    return [(i, t, lang, s, len(t) if t is not None else None, "r", 1) for i, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KIND)
