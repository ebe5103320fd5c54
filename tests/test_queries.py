"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest
from compare import duck, same

from sessionloom.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, con, name):
    same(spark, con, SF, Q.queries()[name], Q.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())
