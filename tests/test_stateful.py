"""Stateful streams against their batch versions; batches that run twice."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from sessionloom.operators import evidence, sessions
from sessionloom.streaming import stateful

START = datetime(2026, 1, 1, tzinfo=UTC)


def prompts(spark, rows):
    """rows: session, minute, keys, noise."""
    made = [(s, START + timedelta(minutes=m), k, n, f"p{len(s) % 2}") for s, m, k, n in rows]
    return spark.createDataFrame(made, "session_id string, ts timestamp, keys array<string>, noise boolean, project string")


def some(r, n, upto=3000):
    return [(f"s{r.randrange(40):0{r.choice((2, 3))}d}", r.randrange(upto) // 5 * 5, r.sample(["K-1", "K-2", "K-3"], r.randrange(3)), r.random() < 0.1) for _ in range(n)]


def test_near_pairs_of_a_stream_equal_the_batch(spark, tmp_path):
    r = random.Random(2)
    rows = sorted(some(r, 300), key=lambda x: x[1] // 60)  # out of order within an hour
    points = prompts(spark, rows)
    member = points.select("session_id", F.concat(F.lit("session:"), "session_id").alias("unit")).distinct()
    chunks, n = tmp_path / "in", 60
    for i in range(0, len(rows), n):
        prompts(spark, rows[i : i + n]).coalesce(1).write.parquet(f"{chunks}/{i:04d}")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{chunks}/*")
    job = stateful.nearest_pairs(stream.select("project", F.concat(F.lit("session:"), "session_id").alias("unit"), "ts"), late="3 hours")
    sink = lambda df, b: df.write.mode("overwrite").parquet(f"{tmp_path}/out/b={b}")
    job.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/keep").trigger(availableNow=True).start().awaitTermination()
    pairs = spark.read.parquet(f"{tmp_path}/out")
    row = lambda x: (x.unit, x.other, x.gap_s, x.rank)
    assert sorted(map(row, stateful.two_nearest(pairs).collect())) == sorted(map(row, sessions.related(points, member).collect()))
    assert pairs.count() < 12 * len(rows)  # not one for every point around


def test_related_equals_all_pairs(spark):
    r = random.Random(7)
    rows = some(r, 250, 12_000) + [(f"s{i:02d}", 600, [], False) for i in range(30)]  # many at one time
    points = prompts(spark, rows)
    member = points.select("session_id", F.concat(F.lit("session:"), "session_id").alias("unit")).distinct()
    gaps = {}
    for a, m, _, _ in rows:
        for b, k, _, _ in rows:
            if a != b and len(a) % 2 == len(b) % 2 and abs(m - k) <= 120:
                gaps.setdefault(f"session:{a}", {}).setdefault(f"session:{b}", []).append(abs(m - k) * 60.0)
    want = [(u, o, g, i + 1) for u, others in gaps.items() for i, (g, o) in enumerate(sorted((min(x), o) for o, x in others.items())[:2])]
    assert sorted((x.unit, x.other, x.gap_s, x["rank"]) for x in sessions.related(points, member).collect()) == sorted(want)


def test_outdated_counts_equal_the_batch_after_each_batch(spark, tmp_path):
    r = random.Random(3)
    rows, every = some(r, 200), []
    member = spark.createDataFrame([(f"s{i:02d}", u, m) for i in range(40) for u, m in ((f"K-{i % 3 + 1}", "main"), (f"K-{(i + 1) % 3 + 1}", "mention"))], "session_id string, unit string, mode string")
    now = {}
    records = lambda: spark.createDataFrame([(u, START + timedelta(minutes=m)) for u, m in now.items()], "unit string, since timestamp")
    sink = stateful.outdated_sink(str(tmp_path), "r", records, lambda: member)
    for batch, written in enumerate(({"K-1": 500, "K-2": 900}, {"K-1": 1800}, {"K-3": 1000}, {})):
        now |= written
        part = rows[batch * 50 : batch * 50 + 50]
        every += part
        for _ in range(2 if batch in (0, 2) else 1):  # some run twice
            sink(prompts(spark, part), batch)
        found = stateful.outdated_counts(spark, str(tmp_path), "r", batch)
        want = sessions.staleness(prompts(spark, every), member, records())
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_usage_of_a_repeated_batch_counts_once(spark, tmp_path):
    call = lambda i: ("write", "K-1", "2026", i, i, None if i % 2 else 0.5)
    sink = stateful.usage_sink(str(tmp_path / "u"), "r1")
    assert stateful.usage(spark, str(tmp_path / "u")).count() == 0
    for batch in (0, 1, 1, 0):
        sink(spark.createDataFrame([call(10 * batch + i) for i in range(4)], stateful.USAGE), batch)
    stateful.usage_sink(str(tmp_path / "u"), "r2")(spark.createDataFrame([call(1)], stateful.USAGE), 0)
    totals = evidence.usage_totals(stateful.usage(spark, str(tmp_path / "u")), ["action"]).first()
    assert (totals.calls, totals.cost_usd) == (9, 2.0)


def test_proposals_over_batches_and_a_batch_that_runs_twice(spark, tmp_path):
    def rows(*items):
        return spark.createDataFrame([(i, "group", s, list(on), f"t{i}", "high") for i, s, on in items], stateful.PROPOSALS)

    looked = lambda new: new.select(F.explode("sessions").alias("session_id")).distinct()
    revive = lambda batch: spark.createDataFrame([("no",)] if batch == 2 else [], "id string")
    begin = rows(("old", "pending", "ab"), ("yes", "accepted", "cd"), ("no", "rejected", "ef"))
    sink = stateful.proposals_sink(str(tmp_path), "r", looked, revive, begin)
    state = lambda: sorted((r.id, r.status) for r in stateful.proposals(spark, str(tmp_path), "r").collect())
    for _ in range(2):
        sink(rows(("new", "pending", "ax"), ("no", "pending", "ef")), 0)
        assert state() == [("new", "pending"), ("no", "rejected"), ("yes", "accepted")]
    for _ in range(2):
        sink(rows(("next", "pending", "xq")), 1)
        assert state() == [("next", "pending"), ("no", "rejected"), ("yes", "accepted")]
    sink(rows(("no", "pending", "ef"), ("yes", "pending", "cd")), 2)
    assert state() == [("next", "pending"), ("no", "pending"), ("yes", "accepted")]
