"""Layout of the activity timeline: lanes, marks, ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed values of the layout.
DEFAULT_LANES, COLOURS, LEAST_DAYS, MARK_LEAST, MARK_MOST, MAX_TICKS = 12, 3, 14, 8, 16, 8
STEPS = (1, 2, 7, 14, 30, 60, 90, 180, 365)


def filter_cells(cells: DataFrame, repo: str | None = None, first: str | None = None, last: str | None = None, units: list[str] | None = None) -> DataFrame:
    """Cells of one repo, between two days and of exact units; a reversed range is swapped, a malformed day ignored."""
    lo, hi = X.valid_day(F.lit(first)), X.valid_day(F.lit(last))
    both = lo.isNotNull() & hi.isNotNull()
    start, end = F.when(both, F.least(lo, hi)).otherwise(lo), F.when(both, F.greatest(lo, hi)).otherwise(hi)
    keep = (start.isNull() | (F.col("day") >= start)) & (end.isNull() | (F.col("day") <= end))
    out = cells.where(keep)
    if repo:
        out = out.where(F.col("project") == repo)
    return out.where(F.col("unit").isin(units)) if units is not None else out


def lanes(cells: DataFrame) -> DataFrame:
    """Per unit: prompts, active days, first and last day, repos, main repo (most prompts, ties alphabetical), largest cell."""
    per_repo = cells.groupBy("unit", "project").agg(F.sum("n").alias("pn"))
    main = per_repo.withColumn("r", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("pn"), "project"))).where("r = 1").select("unit", F.col("project").alias("main_project"))
    sums = cells.groupBy("unit").agg(F.sum("n").alias("prompts"), F.countDistinct("day").alias("active_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.array_sort(F.collect_set("project")).alias("projects"), F.max("n").alias("max_cell"))
    return sums.join(main, "unit")


def newest(lane: DataFrame, limit: int | None = DEFAULT_LANES) -> DataFrame:
    """Lanes by last day, newest first, ties by unit."""
    ordered = lane.orderBy(F.desc("last_day"), "unit")
    return ordered if limit is None else ordered.limit(limit)


def colour_slots(cells: DataFrame) -> DataFrame:
    """(project, slot): place among all repos in alphabetical order, -1 after the first three."""
    repos = cells.select("project").distinct()
    place = F.row_number().over(Window.orderBy("project")) - 1
    return repos.select("project", F.when(place < COLOURS, place).otherwise(-1).alias("slot"))


def span(cells: DataFrame) -> DataFrame:
    """One row: first and last day shown; at least a fortnight."""
    edge = cells.agg(F.min("day").alias("first_day"), F.max("day").alias("end_day"), F.max("n").alias("max_n"))
    return edge.select("first_day", F.greatest("end_day", F.date_add("first_day", LEAST_DAYS - 1)).alias("last_day"), F.greatest("max_n", F.lit(1)).alias("max_n"))


def position(day, first, last) -> Column:
    """Middle of a day in percent of the width."""
    width = F.datediff(last, first) + 1
    return F.round((F.datediff(day, first) + 0.5) / width * 100, 2)


def mark_size(n, most) -> Column:
    n, most = X.col(n), X.col(most)
    grown = F.floor(MARK_LEAST + (MARK_MOST - MARK_LEAST) * F.sqrt((n - 1) / F.nullif(most - 1, F.lit(0))) + 0.5)
    return F.when((most <= 1) | (n <= 1), F.lit(MARK_LEAST)).otherwise(grown).cast("int")


def marks(cells: DataFrame) -> DataFrame:
    """(unit, day, project, n, x, size) of all cells; the span is a single row, so its broadcast is bounded."""
    edge = span(cells)
    return cells.crossJoin(F.broadcast(edge)).select("unit", "day", "project", "n", position("day", "first_day", "last_day").alias("x"), mark_size("n", "max_n").alias("size"))


def ticks(edge: DataFrame) -> DataFrame:
    """(day, x): the smallest step that gives at most eight ticks."""
    width = F.datediff("last_day", "first_day") + 1
    fits = F.filter(F.array(*map(F.lit, STEPS)), lambda s: F.ceil(width / s) <= MAX_TICKS)
    step = F.coalesce(F.get(fits, F.lit(0)), F.lit(STEPS[-1]))
    rows = edge.select("first_day", "last_day", F.explode(F.sequence(F.lit(0), width - 1, step)).alias("d"))
    day = F.date_add("first_day", F.col("d"))
    return rows.select(day.alias("day"), position(day, "first_day", "last_day").alias("x"))


def coverage(units: DataFrame) -> DataFrame:
    """One row: units that have a record, all that can, and outdated ones. units: generatable, has_capsule, outdated, noise."""
    can = F.col("generatable") & ~F.col("noise")
    return units.agg(F.count_if(can & F.col("has_capsule")).alias("ready"), F.count_if(can).alias("total"), F.count_if(can & F.col("has_capsule") & F.col("outdated")).alias("outdated"), F.count_if("noise").alias("empty"))
