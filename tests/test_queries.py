"""Every registered query at the smallest scale, next to its SQL twin."""

import pytest
from oracle import connect, difference

from __spark_entry__ import entry, oracle_sql, queries
from clueweave.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry(spark):
    assert entry(spark).columns == ["word", "score"] and entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"dt_accuracy", "ppca_embeddings"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    mine = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        assert difference(mine, con.execute(ORACLES[name]).df()) is None
    assert len(mine) > 0
