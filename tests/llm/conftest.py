import os
from pathlib import Path

import pytest

# tasks import the package under test
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[2]}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long_text = " ".join(f"w{i % 977} ünï{i % 13}" for i in range(20_000))
    rows = [
        (1, "Some words stand here.", "en", "a", 22),
        (1, "Some words stand here.", "en", "a", 22),
        (1, "Other words of the same id.", "en", "a", None),
        (2, "", None, None, 0),
        (3, None, None, "b", None),
        (None, "a row without an id", "en", None, 5),
        (None, None, None, None, None),
        (4, long_text, "en", "c", len(long_text)),
        (5, long_text, "en", "c", len(long_text)),
        (6, "x" * 30_000, "xx", "c", 30_000),
        (7, " \t\n   ", "xx", "c", 6),
        (8, "one two", "en", "c", 7),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ("node", "ids", "length", "kept", "digest", "_range", "row", "label", "component", "start")
    df = spark.createDataFrame(rows, names)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in extra])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
