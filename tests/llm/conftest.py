import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
# Python workers import the package by themselves
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_rows import DOCUMENTS, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCUMENTS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def store(spark, tmp_path_factory):
    """Save tables the way the queries read them; returns the folder."""
    def save(**tables):
        folder = str(tmp_path_factory.mktemp("tables"))
        for name, frame in tables.items():
            frame.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return save


@pytest.fixture(scope="session")
def with_clashes():
    """The same rows with extra columns whose names operators like to use."""
    from pyspark.sql import functions as F

    names = ["size", "kept", "row", "best", "times", "rank", "score", "u", "doc", "found", "key", "shard",
             "target", "copies", "fp", "block", "word", "counts", "__counts", "__raw", "__mix", "__row",
             "lang_pred", "a.b"]

    def add(frame):
        return frame.select("*", *[F.lit(f"own {n}").alias(n) for n in names])

    return add
