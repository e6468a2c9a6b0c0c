"""Every curation query that SQL can express, against DuckDB."""

import pytest

from assetloom.plans.queries import ORACLE, QUERIES
from sql_check import connect, same


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, db, sf_dir, name):
    same(db, QUERIES[name](spark, sf_dir), ORACLE[name])
