import numpy as np
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "un", "ves", "ry", "po") for b in ("n", "sta", "de", "ring", "ul", "x")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, copies, near copies, shared lines."""
    rng = np.random.default_rng(4)
    base = prose(rng, 80)
    shared = prose(rng, 60)
    rows = [(i, prose(rng, int(rng.integers(1, 120))), "en", f"s{i % 4}", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "", 0), (102, " \t\n ", "en", None, 3), (None, "null id text here", "de", "s1", 1)]
    rows += [(103, base, "en", "s1", 1), (104, base.upper(), "en", "s2", 1), (105, base, None, None, 1), (106, base + " tail", "de", "s1", 1), (107, base + " tail end", "de", "s1", 1)]
    rows += [(108, "x " + shared + " y", "fr", "s9", 1), (109, "other start " + shared + " and end", "fr", "s9", 1), (110, shared + " " + shared, "fr", "s9", 1)]
    rows += [(111, prose(rng, 6000), "en", "s0", 1), (112, "é" * 300 + " ß ü", "de", "s1", 1), (113, "12 34 !!", "en", "s1", 1), (114, "one two", "en", "s1", 1), (115, "ONE two", "en", "s1", 1)]
    rows += [(116, "same row", "en", "s1", 1), (116, "same row", "en", "s1", 1), (117, "repeated id", "en", "s2", 1), (117, "repeated id but other text", "en", "s2", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names clash with what operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    for c in ("score", "size", "node", "digest", "cell", "label", "sequence_id", "kept", "word", "bucket", "id", "times", "copy", "c0", "rows", "key", "own_key", "place", "epoch", "region", "values", "tie", "part", "n"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 2)) for i in range(60)] + [(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
