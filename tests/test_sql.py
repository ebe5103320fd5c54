"""The SQL of a query says the same at any size: ties and shared prefixes that only large tables hold."""

from __future__ import annotations

import pytest
from compare import rows

from sessionloom.plans import queries as Q

duckdb = pytest.importorskip("duckdb")


def found(tmp_path, name, events):
    """Rows of the query's SQL over events (event_id, user_id, day, event_type, k)."""
    con = duckdb.connect()
    con.execute(f"create table events as select event_id, timestamp '2024-01-01' + to_days(day::int) + to_microseconds(event_id) as ts, user_id, event_type, 0.5 as value, '{{\"k\": ' || k || '}}' as props from ({events})")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    out = con.sql(Q.oracle_sql()[name])
    return rows(out.fetchall(), out.columns)


def test_equal_ranges_of_one_session_are_one_island(spark, tmp_path):
    # in every session the ranges of turns 0 and 1 are 0 to 1 once they are cut; the last turn gives none
    events = "select 3 * u + t as event_id, u as user_id, 0 as day, case t when 1 then 'error' else 'view' end as event_type, 2 as k from (select u * 4 + 1 as u, unnest([0, 1, 2]) as t from range(100000) r(u))"
    own = found(tmp_path, "f25_clamp_ranges", events.replace("3 * u + t", "3 * u + [1, 3, 5][t + 1]"))
    assert len(own) == len({r.split("|")[1] for r in own}) == 100000
    q = Q.queries()["f25_clamp_ranges"](spark, str(tmp_path))
    assert rows([tuple(r) for r in q.collect()], q.columns) == own


def test_an_id_that_two_sessions_share_does_not_collide_with_itself(spark, tmp_path):
    # the first nine digits of u61316-w4 and u62718-w1 are equal
    own = found(tmp_path, "w14_short_ids", "select unnest([0, 1, 2]) as event_id, unnest([61316, 62718, 5]) as user_id, unnest([28, 7, 0]) as day, 'view' as event_type, 2 as k")
    assert [r for r in own if "30e94f507" in r] == ["30e94f507|30e94f50"]
    q = Q.queries()["w14_short_ids"](spark, str(tmp_path))
    assert rows([tuple(r) for r in q.collect()], q.columns) == own
