"""Citations: resolve them to turns, check them against ranges, and clean written records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .ranges import LEAD

CONTEXT, MAX_CONTEXT, TEXT_CHARS, MAX_COMMANDS = 2, 5, 4000, 8


def resolve_sessions(asked: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, session_id, status): the session whose id starts with the cited prefix. Status ok, not_found, ambiguous or bad_request.

    Ids meet on their first four characters, then the whole prefix is compared."""
    want = asked.select("session").distinct().withColumn("w", F.lower(F.trim(X.nn("session"))))
    good = F.col("w").rlike("^[0-9a-z][0-9a-z-]{3,}$")
    ids = sessions.select("session_id").distinct().withColumn("i", F.lower("session_id")).withColumn("i4", F.substring("i", 1, 4))
    hits = want.where(good).join(ids, (F.substring("w", 1, 4) == F.col("i4")) & F.startswith(F.col("i"), F.col("w"))).groupBy("session").agg(F.count("*").alias("n"), F.min("session_id").alias("session_id"))
    status = F.when(~good, "bad_request").when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return want.join(hits, "session", "left").select("session", F.when(F.col("n") == 1, F.col("session_id")).alias("session_id"), status.alias("status"))


def cite_turn(turn):
    """Turn number of a citation: digits only, up to nine of them."""
    return F.when(X.col(turn).cast("string").rlike("^[0-9]{1,9}$"), F.expr("try_cast(turn as int)"))


def resolve_cites(cites: DataFrame, turns: DataFrame, context: int = CONTEXT) -> DataFrame:
    """One row per shown turn: the cited one and those around it. cites: cite_id, session, turn."""
    ctx = min(MAX_CONTEXT, max(0, context))
    found = cites.join(resolve_sessions(cites, turns), "session").where("status = 'ok'").withColumn("n", cite_turn("turn")).drop("turn")
    near = found.select("cite_id", "session_id", "n", F.explode(F.sequence(F.col("n") - ctx, F.col("n") + ctx)).alias("turn"))
    held = near.join(turns, ["session_id", "turn"])
    here = F.max((F.col("turn") == F.col("n")).cast("int")).over(Window.partitionBy("cite_id")) == 1
    return held.withColumn("here", here).where("here").select("cite_id", "session_id", "turn", (F.col("turn") == F.col("n")).alias("cited"), F.substring(F.when(F.col("noise"), F.lit("")).otherwise(X.redact("text")), 1, TEXT_CHARS).alias("user"))


def confidence(cites: DataFrame, ranges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cite_id, confidence): verified inside a range or its lead-up, unverified elsewhere, turn_missing beyond the session."""
    r = ranges.select(F.col("session_id").alias("rs"), "start", "end")
    top = ranges.groupBy("session_id").agg(F.max("end").alias("max_end"))
    rows = cites.withColumn("n", cite_turn("turn")).join(sizes, "session_id").join(top, "session_id", "left")
    inside = rows.join(r, (F.col("session_id") == F.col("rs")) & (F.col("n") >= F.col("start") - LEAD) & (F.col("n") <= F.col("end")), "left_semi").select("cite_id").distinct().withColumn("in", F.lit(True))
    missing = F.col("n").isNull() | (F.col("n") >= F.col("size")) | (F.coalesce("max_end", F.lit(-1)) >= F.col("size"))
    verdict = F.when(missing, "turn_missing").when(F.col("max_end").isNull() | F.col("in"), "verified").otherwise("unverified")
    return rows.join(inside, "cite_id", "left").select("cite_id", verdict.alias("confidence"))


def row_times(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """(row_id, ts): time of the first citation, in listed order, that resolves to a turn with a time. rows: row_id, cites array<struct<session, turn>>."""
    cites = rows.select("row_id", F.posexplode("cites").alias("pos", "c")).select("row_id", "pos", F.col("c.session").alias("session"), F.col("c.turn").alias("turn"))
    found = cites.join(resolve_sessions(cites, turns), "session").where("status = 'ok'").withColumn("n", cite_turn("turn")).drop("turn")
    at = turns.select("session_id", F.col("turn").alias("n"), "ts")
    timed = found.join(at, ["session_id", "n"]).groupBy("row_id").agg(F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("pos"))).alias("ts"))
    return rows.select("row_id").join(timed, "row_id", "left")


def parse_sources(sources: DataFrame) -> DataFrame:
    """(row_id, session, start, end) of texts like "`id` (turns 1-5, 9-9)"."""
    rx = r"`([^`]+)`\s*\(turns ([\d,\s-]+)\)"
    rows = sources.where(F.col("source").rlike(rx)).select("row_id", F.lower(F.regexp_extract("source", rx, 1)).alias("session"), F.explode(F.split(F.regexp_extract("source", rx, 2), ",")).alias("r"))
    parts = F.split(F.trim("r"), "-")
    return rows.where((F.size(parts) == 2) & F.trim("r").rlike(r"^\d+-\d+$")).select("row_id", "session", F.get(parts, F.lit(0)).cast("int").alias("start"), F.get(parts, F.lit(1)).cast("int").alias("end"))


def valid_cites(cites: DataFrame, ranges: DataFrame) -> DataFrame:
    """Citations that lie inside a selected range. cites: any columns with session_id and turn."""
    r = ranges.select(F.col("session_id").alias("rs"), "start", "end")
    n = cite_turn("turn")
    return cites.join(r, (F.col("session_id") == F.col("rs")) & (n >= F.col("start")) & (n <= F.col("end")), "left_semi")


def validate(items: DataFrame, ranges: DataFrame) -> DataFrame:
    """Items with their valid citations; decisions, dead ends and left-out items without one are dropped.

    items: capsule, field, pos, body, cites array<struct<session_id, turn>>; result adds `kept`."""
    cites = items.select("capsule", "field", "pos", F.posexplode("cites").alias("i", "c")).select("capsule", "field", "pos", "i", "c.session_id", "c.turn")
    good = valid_cites(cites, ranges).groupBy("capsule", "field", "pos").agg(F.array_sort(F.collect_list(F.struct("i", "session_id", "turn"))).alias("good"))
    joined = items.drop("cites").join(good, ["capsule", "field", "pos"], "left")
    shown = F.coalesce(F.transform("good", lambda c: F.struct(c["session_id"].alias("session_id"), c["turn"].alias("turn"))), F.array().cast("array<struct<session_id:string,turn:string>>"))
    needs = F.col("field").isin("decisions", "dead_ends", "left_out")
    return joined.select("capsule", "field", "pos", "body", shown.alias("cites"), (~needs | F.col("good").isNotNull()).alias("kept"))


def drift(basis: DataFrame, now: DataFrame, fresh: DataFrame) -> DataFrame:
    """(unit, added, removed): sources that a record was written from against those of today; sessions with new messages are not added."""
    # one pass over both sides, so that no row needs a key without nulls
    cols = ["unit", "session_id", "start", "end"]
    sides = basis.select(*cols).withColumn("side", F.lit(1)).unionByName(now.select(*cols).withColumn("side", F.lit(2)))
    both = sides.groupBy(*cols).agg(F.max(F.when(F.col("side") == 1, True)).alias("was"), F.max(F.when(F.col("side") == 2, True)).alias("now"))
    held = both.join(fresh.select("unit", "session_id").distinct().withColumn("fresh", F.lit(True)), ["unit", "session_id"], "left")
    added = F.count_if(F.col("was").isNull() & F.col("fresh").isNull())
    units = held.groupBy("unit").agg(added.alias("added"), F.count_if(F.col("now").isNull()).alias("removed"), F.max("was").alias("_was")).where("unit IS NOT NULL AND _was")
    return units.drop("_was").withColumn("changed", F.col("added") + F.col("removed") > 0)


def reusable(basis: DataFrame, units: DataFrame, most: int = 5) -> DataFrame:
    """(unit, previous, overlap): records of units that are gone but share sources with a unit of today, the most overlap first."""
    gone = basis.join(units.select("unit").distinct(), "unit", "left_anti").select(F.col("unit").alias("previous"), "session_id", F.col("start").alias("bs"), F.col("end").alias("be"))
    meet = (F.col("bs").isNull() | F.col("start").isNull()) | ((F.col("bs") <= F.col("end")) & (F.col("start") <= F.col("be")))
    shared = units.join(gone, "session_id").where(meet).groupBy("unit", "previous").agg(F.count("*").alias("overlap"))
    order = Window.partitionBy("unit").orderBy(F.desc("overlap"), "previous")
    return shared.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def embedded_json(text, ddl: str):
    """The JSON object in a model's answer: fences and words around it are skipped."""
    return F.from_json(F.regexp_extract(X.nn(text), r"(?s)(\{.*\})", 1), ddl)


def model_usage(text):
    """struct(input_tokens, output_tokens, cost_usd) of a call's output."""
    r = F.from_json(X.col(text), "total_cost_usd double, usage struct<input_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint, output_tokens bigint>")
    n = lambda c: F.coalesce(r["usage"][c], F.lit(0))
    return F.struct((n("input_tokens") + n("cache_creation_input_tokens") + n("cache_read_input_tokens")).alias("input_tokens"), n("output_tokens").alias("output_tokens"), r["total_cost_usd"].alias("cost_usd"))


def usage_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    s = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), s("input_tokens").alias("input_tokens"), s("output_tokens").alias("output_tokens"), F.round(s("cost_usd"), 4).alias("cost_usd"))


def cost_estimate(chars, calls=1, output_tokens=3000):
    """Dollars of a record: four characters to a token, 4000 tokens around each call, 3 and 15 dollars a million."""
    tokens = F.floor(X.col(chars) / 4) + 4000 * calls
    return tokens * 3 / 1e6 + output_tokens * 15 / 1e6
