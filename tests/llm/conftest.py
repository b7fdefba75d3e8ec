import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties and special strings."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, 0), (3, "", "en", "a", 0), (4, long, "en", "a", len(long)), (5, long[:-1] + "!", "en", "a", len(long)), (6, long, "de", "b", len(long)),
        (7, "one two", "en", "b", 7), (7, "one two", "en", "b", 7), (7, "another text of this id", "en", "b", 23), (None, "one two", "en", "b", None), (None, None, None, None, None),
        (8, "<|endoftext|> a<|endoftext|>b </s>[INST] ok\n\n  x'll\tÜber 漢字 😀 é 3.14", "fr", "c", 40), (9, "x" * 5000, "en", "c", 5000), (10, " \t\n ", "es", "c", 4), (11, "A", "es", "c", 1),
    ]
    for i in range(12, 60):
        text = words(rng, rng.randint(1, 120))
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice("abc"), len(text)))
        if i % 7 == 0:
            rows.append((100 + i, text, "en", "a", len(text)))
        if i % 5 == 0:
            rows.append((200 + i, text + " z", "en", "a", len(text) + 2))
    return rows


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, rows):
    """Extra columns named like the results' and the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    names = "kept keep_id group_size text_sha256 rid pos name level key fp component_id score predicted held_out ids start copy n_copies mix_key range at own fingerprint n_tokens n_bytes n conv_id __x"
    return df.withColumns({x: F.lit("clash") for x in names.split()})
