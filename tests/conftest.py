import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def vocab(spark):
    """Characters, continued characters and a few words; no piece for 'z'."""
    letters = [c for c in "abcdefghijklmnopqrstuvwxy0123456789.,!$"]
    pieces = ["[UNK]", "[PAD]", *letters, *["##" + c for c in letters], "hello", "world", "##ing", "walk"]
    return spark.createDataFrame([(p, i) for i, p in enumerate(pieces)], "piece string, id int").cache()


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")
