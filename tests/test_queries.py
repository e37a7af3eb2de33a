"""Every registered query against its check SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import oracle_check  # noqa: E402
from palaver.oracles import ORACLES  # noqa: E402
from palaver.registry import QUERIES  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle_check.connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert oracle_check.compare(spark, duck, QUERIES[name], ORACLES.get(name), SF_DIR) == ""


def test_only_models_lack_check_sql():
    assert set(QUERIES) - set(ORACLES) == {"choose_k", "segments", "anomaly_scores", "full_analysis"}
    assert set(ORACLES) <= set(QUERIES)
