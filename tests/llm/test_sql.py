"""Queries of the training-data operators against their SQL on the smallest tables."""

import os

import pytest

from tests.test_sql import DATA, same_as_sql


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["p2_found", "p2_report", "p4_found", "p4_balance", "p5_found", "p6_found", "p6_cover", "p8_found", "p8_tokens", "p9_found", "p9_items"])
def test_same_as_sql(spark, name):
    same_as_sql(spark, name)
