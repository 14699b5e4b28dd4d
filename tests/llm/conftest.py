from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, in several partitions and with columns named as the operators' own."""

    def make(rows, source=lambda i: f"s{i % 3}"):
        full = [(i, t, "en", source(n), None if t is None else len(t)) for n, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, COLUMNS).repartition(3)
        for name in ("id", "content", "row", "key", "size", "spans", "fingerprint", "start", "h", "words", "n", "score"):
            df = df.selectExpr("*", f"'clash' AS {name}")
        return df

    return make


VOCABULARY = [a + b for a in ("an", "be", "co", "du", "el", "fi", "go", "hu") for b in ("ra", "se", "ti", "lo", "nu", "my")]


@pytest.fixture(scope="session")
def prose():
    """Invented texts of n words, the same in every run."""

    def make(seed: int, n: int) -> str:
        return " ".join(random.Random(seed).choices(VOCABULARY, k=n))

    return make


ODD = [(None, "a text without an id"), (7, None), (7, ""), (8, " \n\t "), (9, "one"), (9, "one"), (10, "é ü x" * 3), (11, "lang " * 30_000)]


@pytest.fixture(scope="session")
def odd():
    """NULL and repeated ids, NULL, empty, blank, repeated and very long texts."""
    return list(ODD)
