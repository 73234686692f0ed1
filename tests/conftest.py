import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from testdata import DATA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    session = local_session(cores=4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def oracle():
    from compare import open_oracle

    return open_oracle(DATA)


@pytest.fixture
def large_paths(spark, monkeypatch):
    """Treat every input as large: keys cut at few values, no broadcast, split any skewed join."""
    from tidemark.operators import ranking

    monkeypatch.setattr(ranking, "PIECE_VALUES", 3)
    monkeypatch.setattr(ranking, "PIECES", 8)
    forced = {"spark.sql.autoBroadcastJoinThreshold": "-1",
              "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
              "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    for k, v in forced.items():
        spark.conf.set(k, v)
    yield
    for k in forced:
        spark.conf.unset(k)
