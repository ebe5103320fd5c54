"""Turn ranges and time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns before a range that lead up to it.
LEAD = 4
OPEN_END = "9999"


def merge_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Inclusive ranges merged, also when adjacent (gaps and islands)."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def lead_ranges(ranges: DataFrame, by: list[str], lead: int = LEAD) -> DataFrame:
    """Up to `lead` turns before each range, without those of the range before."""
    order = Window.partitionBy(*by).orderBy("start")
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    rows = ranges.withColumn("lo", F.greatest(F.col("start") - lead, before + 1)).where("lo < start")
    return rows.select(*by, F.col("lo").alias("start"), (F.col("start") - 1).alias("end"))


def clamp(ranges: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """Ranges cut to [0, n - 1]; empty and inverted ones go; then merged. sizes: session_id, n."""
    start, end = F.greatest(F.lit(0), F.expr("try_cast(start as int)")), F.least(F.col("n") - 1, F.expr("try_cast(end as int)"))
    cut = ranges.join(sizes, "session_id").where(F.expr("try_cast(start as int) is not null and try_cast(end as int) is not null")).select(*by, start.cast("int").alias("start"), end.cast("int").alias("end"))
    return merge_ranges(cut.where("start <= end"), by)


def windows(ranges: DataFrame, turns: DataFrame, by: list[str]) -> DataFrame:
    """(by, start_ts, end_ts): from the range's first turn to the turn after it, half open; the last one is open."""
    at = turns.select("session_id", "turn", "ts")
    first = at.select("session_id", F.col("turn").alias("start"), F.col("ts").alias("start_ts"))
    after = at.select("session_id", (F.col("turn") - 1).alias("end"), F.col("ts").alias("end_ts"))
    return ranges.join(first, ["session_id", "start"]).join(after, ["session_id", "end"], "left").where("start_ts is not null").select(*by, "start_ts", F.coalesce("end_ts", F.lit(OPEN_END)).alias("end_ts"))


def pieces(cuts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Accepted parts of a session, and the gaps before, between and after them."""
    rows = cuts.join(sizes, "session_id")
    order = Window.partitionBy("session_id").orderBy("start")
    at = F.coalesce(F.lag("end").over(order) + 1, F.lit(0))
    marked = rows.withColumn("at", at).withColumn("last", F.lead("start").over(order).isNull())
    own = marked.select("session_id", "start", F.least("end", F.col("n") - 1).alias("end"), "label")
    gaps = marked.where("at < start").select("session_id", F.col("at").alias("start"), (F.col("start") - 1).alias("end"), F.lit("").alias("label"))
    tail = marked.where(F.col("last") & (F.col("end") + 1 < F.col("n"))).select("session_id", (F.col("end") + 1).alias("start"), (F.col("n") - 1).alias("end"), F.lit("").alias("label"))
    return own.unionByName(gaps).unionByName(tail).where("end >= start")


def plan_size(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Turns that the ranges cover."""
    return ranges.groupBy(*by).agg(F.sum(F.col("end") - F.col("start") + 1).alias("turns"), F.count("*").alias("ranges"))


def feed_ranges(items: DataFrame, cites: DataFrame, known: DataFrame, votes: DataFrame, heuristic: DataFrame, sizes: DataFrame) -> DataFrame:
    """(unit, session_id, start, end, mode): the turns of a session that a unit's record is written from.

    Known ranges come first. A session that only shares the unit and cites its key has the union
    of the voted ranges, or without a vote those of its own segments; any other counts as a whole.
    items: unit, session_id, keyed; cites: unit, session_id; the ranges: unit, session_id, start,
    end; sizes: session_id, n.
    """
    by = ["unit", "session_id"]
    has = lambda df, name: df.select(*by).distinct().withColumn(name, F.lit(True))
    rows = items.select(*by, "keyed").join(has(known, "_known"), by, "left").join(has(votes, "_voted"), by, "left").join(has(cites, "_cites"), by, "left")
    mixed = F.col("keyed") & F.coalesce("_cites", F.lit(False))
    mode = F.when(F.col("_known"), "known-ranges").when(mixed & F.coalesce("_voted", F.lit(False)), "voted").when(mixed, "heuristic").otherwise("whole-session")
    planned = rows.select(*by, mode.alias("mode"))
    given = clamp(known, sizes, by).withColumn("mode", F.lit("known-ranges"))
    given = given.unionByName(merge_ranges(votes.select(*by, "start", "end"), by).withColumn("mode", F.lit("voted")))
    given = given.unionByName(merge_ranges(heuristic.select(*by, "start", "end"), by).withColumn("mode", F.lit("heuristic")))
    whole = planned.where("mode = 'whole-session'").join(sizes, "session_id").where("n > 0").select(*by, F.lit(0).alias("start"), (F.col("n") - 1).cast("int").alias("end"), "mode")
    return planned.join(given, [*by, "mode"]).select(*by, "start", "end", "mode").unionByName(whole)
