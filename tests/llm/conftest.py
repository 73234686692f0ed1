import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
ROOT = "/root/testdata/sf0.001"
#: Extra columns that clash with ours by case or by the names that operators use inside.
SCHEMA = T.StructType([
    T.StructField("TEXT", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("lang", T.StringType()),
    T.StructField("fp", T.LongType()), T.StructField("size", T.StringType()), T.StructField("n_lines", T.StringType()),
    T.StructField("c0", T.LongType())])


@pytest.fixture
def edges(spark):
    from llm_edges import edge_rows

    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet")
