import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with null and repeated ids, the odd texts, and columns whose names an operator may use itself."""
    rows = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (6, "other text, id of another row")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    names = ["id", "_row", "row", "n", "label", "part", "ids", "keep_id", "_doc", "size", "node", "block", "word", "_id", "_text"]
    return df.select("doc_id", "text", *[F.lit(None).cast("string").alias(x) for x in names])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
