"""Sessions from prompts: keys, summaries, activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Prompts that must cite a key before it counts for a session of another key.
KEY_MIN_MENTIONS = 2
UNASSIGNED = "unassigned"


def turn_numbers(messages: DataFrame) -> DataFrame:
    """0-based prompt number of every message; assistant text belongs to the prompt before it, -1 if there is none."""
    order = Window.partitionBy("session_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("turn", F.sum(F.col("is_prompt").cast("int")).over(order) - 1)


def attach_assistant(messages: DataFrame) -> DataFrame:
    """One row per prompt: its text and the assistant texts that follow it, in order."""
    owned = turn_numbers(messages).where("turn >= 0")
    told = F.filter(F.array_sort(F.collect_list(F.struct("line_no", "is_prompt", "text"))), lambda m: ~m["is_prompt"])
    return owned.groupBy("session_id", "turn").agg(F.max(F.when(F.col("is_prompt"), F.col("text"))).alias("text"), F.transform(told, lambda m: m["text"]).alias("assistant"))


def session_keys(prompts: DataFrame) -> DataFrame:
    """Prompts that cite each key; a prompt counts once per key."""
    return prompts.select("session_id", F.explode(F.array_distinct("all_keys")).alias("key")).groupBy("session_id", "key").agg(F.count("*").alias("mentions"))


def most_common(rows: DataFrame, by: list[str], item: str, place: str) -> DataFrame:
    """Counts per group, ranked by falling count, ties by first appearance."""
    counted = rows.groupBy(*by, item).agg(F.count("*").alias("n"), F.min(place).alias("first_place"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first_place")))


def detect_keys(prompts: DataFrame, commits: DataFrame | None = None, generic=X.GENERIC_BRANCHES, pattern: str = X.KEY_PATTERN) -> DataFrame:
    """(session_id, key, method): key in the commonest branch that has one, else the commonest key of
    prompts and commit commands, else the commonest branch with a meaning, else unassigned.
    prompts: session_id, turn, text, branch; commits: session_id, line_no, cmd."""
    branches = most_common(prompts.where(X.nn("branch") != ""), ["session_id"], "branch", "turn")
    named = branches.withColumn("key", F.get(X.find_keys("branch", pattern), F.lit(0)))
    first = lambda cond, value: F.min_by(value, F.when(cond, F.col("rank")))
    by_branch = named.groupBy("session_id").agg(
        first(F.col("key").isNotNull(), F.col("key")).alias("branch_key"),
        first(~F.col("branch").isin(*generic) & ~F.startswith("branch", F.lit("worktree-agent-")), F.col("branch")).alias("branch_name"),
    )
    cited = prompts.select("session_id", F.lit(0).alias("part"), F.col("turn").cast("long").alias("at"), F.posexplode(X.find_keys("text", pattern)).alias("i", "key"))
    if commits is not None:
        cited = cited.unionByName(commits.select("session_id", F.lit(1).alias("part"), F.col("line_no").cast("long").alias("at"), F.posexplode(X.find_keys("cmd", pattern)).alias("i", "key")))
    top = most_common(cited.withColumn("place", F.struct("part", "at", "i")), ["session_id"], "key", "place").where("rank = 1").select("session_id", F.col("key").alias("text_key"))
    every = prompts.select("session_id").distinct()
    found = every.join(by_branch, "session_id", "left").join(top, "session_id", "left")
    method = F.when(F.col("branch_key").isNotNull(), "branch-regex").when(F.col("text_key").isNotNull(), "prompt-or-commit-regex").when(F.col("branch_name").isNotNull(), "branch-name").otherwise("none")
    return found.select("session_id", F.coalesce("branch_key", "text_key", "branch_name", F.lit(UNASSIGNED)).alias("key"), method.alias("method"))


def summaries(records: DataFrame) -> DataFrame:
    """First and last time, first working folder, last title and prompt count of each session of `records`."""
    prompt = (F.col("type") == "user") & ~F.col("sidechain") & ~F.col("meta") & (F.col("text") != "")
    return records.groupBy("session_id", "project").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("cwd", F.when(X.nn("cwd") != "", F.col("line_no"))).alias("cwd"),
        F.max_by("title", F.when(F.col("type") == "custom-title", F.col("line_no"))).alias("title"), F.count_if(prompt).alias("n_prompts"),
    )


def days(prompts: DataFrame, tz: str = "UTC", keep: tuple[str, ...] = ()) -> DataFrame:
    """(session_id, key, day, n): prompts per day; key is null for all prompts, else those that cite it. `keep`: columns of the session."""
    every = F.array(F.lit(None).cast("string"))
    dated = prompts.select("session_id", *keep, X.local_day("ts", tz).alias("day"), F.explode(F.concat(every, F.array_distinct("all_keys"))).alias("key")).where("day is not null")
    return dated.groupBy("session_id", "key", "day").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in keep])


def members(keys: DataFrame, mentions: DataFrame) -> DataFrame:
    """(session_id, unit, mode): the main unit of each session, and each key that it cites often enough."""
    main = keys.select("session_id", F.when(F.col("key") == UNASSIGNED, F.concat(F.lit("session:"), "session_id")).otherwise(F.col("key")).alias("unit"), F.lit(0).alias("m"))
    assigned = keys.where(F.col("key") != UNASSIGNED).select("session_id")
    cited = mentions.where(F.col("mentions") >= KEY_MIN_MENTIONS).join(assigned, "session_id", "left_semi").select("session_id", F.col("key").alias("unit"), F.lit(1).alias("m"))
    return main.unionByName(cited).groupBy("session_id", "unit").agg(F.min("m").alias("m")).select("session_id", "unit", F.when(F.col("m") == 0, "main").otherwise("mention").alias("mode"))


def activity(prompts: DataFrame, member: DataFrame, tz: str = "UTC") -> DataFrame:
    """(unit, day, project, n): a main session counts with all its prompts, another with those that cite the unit."""
    per_day = days(prompts, tz, ("project",)).withColumnsRenamed({"session_id": "_session", "key": "_key"})
    counted = F.when(F.col("mode") == "mention", F.col("unit"))
    cells = member.join(per_day, (F.col("session_id") == F.col("_session")) & counted.eqNullSafe(F.col("_key")))
    return cells.groupBy("unit", "day", "project").agg(F.sum("n").alias("n"))


def unit_rollup(prompts: DataFrame, member: DataFrame) -> DataFrame:
    """Sessions, repos, times, prompts and first prompt of each unit."""
    per = prompts.groupBy("session_id").agg(F.first("project").alias("project"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_prompts"), F.min_by("text", "turn").alias("snippet"))
    rows = member.join(per, "session_id")
    return rows.groupBy("unit").agg(
        F.count("*").alias("sessions"), F.array_sort(F.collect_set("project")).alias("projects"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.sum("n_prompts").alias("prompts"), F.array_sort(F.collect_list("session_id")).alias("session_ids"), F.min_by("snippet", F.struct("first_ts", "session_id")).alias("snippet"),
    )


def session_list(prompts: DataFrame, member: DataFrame) -> DataFrame:
    """(unit, place, session_id, first_ts): the sessions of a unit by their first time, then by id; without a time last."""
    first = prompts.groupBy("session_id").agg(F.min("ts").alias("first_ts"))
    order = Window.partitionBy("unit").orderBy(F.asc_nulls_last("first_ts"), "session_id")
    return member.join(first, "session_id").select("unit", F.row_number().over(order).alias("place"), "session_id", "first_ts")


def activity_order(cells: DataFrame) -> DataFrame:
    """The activity of a unit with `place`: by day, then by repo."""
    return cells.withColumn("place", F.row_number().over(Window.partitionBy("unit").orderBy("day", "project")))


def nearest_others(points: DataFrame, wide: int) -> DataFrame:
    """(unit, other, gap): for each of `points` (project, unit, us) up to six other units around it, the nearest ones.

    A project's points are swept in the order of time, forwards and backwards. Each carries the unit of the run of points before
    its own run, and the unit before the stretch in which those two take turns: the two nearest other units. Units
    that share a time come in the order of their names, so that the first name is the nearest. Of one time
    the first three names are enough. A project is cut into stretches of twelve times `wide`, which also read the
    points within `wide` of their ends; so no project has to fit into one task."""
    stretch = 12 * wide
    at = F.floor(F.col("us") / stretch)
    place = F.col("us") - at * stretch
    near = F.array_compact(F.array(at, F.when(place < wide, at - 1), F.when(place >= stretch - wide, at + 1)))
    rows = points.withColumn("_own", at).withColumn("_stretch", F.explode(near))
    here = Window.partitionBy("project", "_stretch")
    mark = F.struct("unit", "us")

    out = rows
    for way, time in (("f", F.asc("us")), ("b", F.desc("us"))):
        by = here.orderBy(time, F.desc("unit"))
        before = F.lag(mark).over(by)
        out = out.withColumn(f"_{way}0", F.when(before["unit"] != F.col("unit"), before)).withColumn(f"_{way}1", F.last(f"_{way}0", ignorenulls=True).over(by))
        last = F.lag(f"_{way}1").over(by)  # of the run before: the unit before it
        out = out.withColumn(f"_{way}2", F.when(F.col(f"_{way}0").isNotNull() & (last["unit"] != F.col("unit")), last))
        out = out.withColumn(f"_{way}2", F.last(f"_{way}2", ignorenulls=True).over(by))
    same = Window.partitionBy("project", "_stretch", "us").orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = [F.struct(F.nth_value("unit", k).over(same).alias("unit"), F.col("us")) for k in (1, 2, 3)]
    found = out.withColumn("_s", F.array(*names)).where(F.col("_own") == F.col("_stretch"))
    every = F.array_compact(F.concat(F.array("_f1", "_f2", "_b1", "_b2"), F.col("_s")))
    pairs = found.select("unit", "us", F.explode(every).alias("x")).where("x.unit IS NOT NULL AND x.unit <> unit")
    return pairs.select("unit", F.col("x.unit").alias("other"), F.abs(F.col("us") - F.col("x.us")).alias("gap")).where(F.col("gap") <= wide)


def related(prompts: DataFrame, member: DataFrame, hours: int = 2) -> DataFrame:
    """Session units of one repo whose nearest messages are at most `hours` apart: (unit, other, gap_s), the two nearest per unit."""
    own = member.where(F.startswith("unit", F.lit("session:"))).select("session_id", "unit")
    points = prompts.join(own, "session_id").select("project", "unit", F.unix_micros("ts").alias("us")).where("us IS NOT NULL")
    near = nearest_others(points, hours * 3_600_000_000).groupBy("unit", "other").agg(F.min("gap").alias("gap"))
    order = Window.partitionBy("unit").orderBy("gap", "other")
    return near.withColumn("rank", F.row_number().over(order)).where("rank <= 2").select("unit", "other", (F.col("gap") / 1e6).alias("gap_s"), "rank")


def short_ids(sessions: DataFrame) -> DataFrame:
    """Shortest unique prefix: 8 characters, 4 more for those that collide, together."""
    out = sessions.select("session_id").distinct()
    lengths = range(8, 41, 4)
    for n in lengths:
        alone = F.count("*").over(Window.partitionBy(F.substring("session_id", 1, n))) == 1
        out = out.withColumn(f"ok{n}", alone | (F.length("session_id") <= n))
    short = F.coalesce(*[F.when(F.col(f"ok{n}"), F.substring("session_id", 1, n)) for n in lengths], F.col("session_id"))
    return out.select("session_id", short.alias("short_id"))


def staleness(prompts: DataFrame, member: DataFrame, capsules: DataFrame) -> DataFrame:
    """Messages of a unit after its record was written: (unit, new_messages, new_sessions). Noise doesn't count;
    sessions that only cite the unit count with the citing prompts. capsules: unit, since."""
    real = prompts.where(~F.col("noise")).select("session_id", "ts", "keys")
    counted = (F.col("mode") != "mention") | F.array_contains("keys", F.col("unit"))
    rows = member.join(real, "session_id").where(counted).select("unit", "session_id", "ts").join(capsules, "unit")
    per = rows.groupBy("unit", "session_id").agg(F.count_if(F.col("ts") > F.col("since")).alias("new"), F.count("*").alias("total"))
    return per.groupBy("unit").agg(F.sum("new").alias("new_messages"), F.count_if((F.col("new") == F.col("total")) & (F.col("new") > 0)).alias("new_sessions"))
