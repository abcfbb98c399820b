import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    letters = "abcdefghijklmnopqrstuvwxyzéß"
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, exact and near copies, repeated rows, equal ids."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    base = prose(rng, 200)
    near = base.rsplit(" ", 1)[0] + " changed"
    rows = [
        (1, "The cat sat on the mat.", "en", "a", 23), (2, None, "en", "a", None), (3, "", "en", None, 0),
        (4, " \t\n\x0b ", None, "b", 5), (5, long, "en", "b", len(long)), (6, base, "en", "c", 1), (7, near, "en", "c", 1),
        (8, base, "de", "c", 1), (8, base, "de", "c", 1), (8, "other text of the same id", "de", "c", 1),
        (None, base, "en", "a", 1), (None, None, None, None, None), (None, None, None, None, None),
        (9, "one", "en", "a", 3), (10, "ONE", "en", "a", 3), (11, "日本 語 ＡＢＣ 😀 á", "ja", "é", 1),
        (12, "a" * 3000, "en", "a", 3000), (-5, "x y", "en", "", 3),
    ]
    for i in range(20, 80):
        rows.append((i, prose(rng, rng.randint(1, 120)), rng.choice(["en", "de", None]), rng.choice("abcd"), i))
    rows += [(200 + i, "copied line of many", "en", "hot", 1) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3, "n_chars").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
