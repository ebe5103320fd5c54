"""How often the rows of a query are dealt, and into how many tasks."""

from __future__ import annotations

import os

import pytest

from sessionloom.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan(spark, name):
    return Q.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_cosines_deal_the_prompts_once(spark):
    assert plan(spark, "a30_cosine").count("Exchange ") == 1


@pytest.mark.parametrize("name", ["w6_topic_shift", "w7_z_normalised", "w8_boundary_score"])
def test_sessions_are_dealt_into_a_number_of_tasks_that_is_kept(spark, name):
    assert "REPARTITION_BY_NUM" in plan(spark, name)


def test_drift_reads_members_that_were_found_once(spark):
    assert "events.parquet" not in plan(spark, "j14_drift")
