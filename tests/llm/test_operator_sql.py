"""Queries of the training-data operators that SQL can express, against DuckDB."""

import os
import sys

import pytest

from assetloom.llm.queries import ORACLE, QUERIES

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from sql_check import connect, same  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_dir, name):
    same(connect(sf_dir), QUERIES[name](spark, sf_dir), ORACLE[name])
