"""Messages of a session: pages, transcripts, digests of ranges, public views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Page size, prompt and reply lengths of a transcript at three levels; lengths and number of shown commands.
COMMAND, SHOWN_COMMANDS, SHOWN_COMMAND = 200, 8, 300
PAGE, PAGE_MOST, PROMPT, REPLY, MOST_CHARS = 40, 100, 700, 500, 150_000
LEVELS, MARKER_ROOM = ((700, 500), (350, 250), (180, 120)), 120
MARKER = " lines from the middle of this session were left out to keep the evidence small ...]"


def scoped(turns: DataFrame, key: Column, since: Column, main: Column, scope: str = "all") -> DataFrame:
    """Messages with `mine` (cites the key) and `new` (after the record; of a shared session only citing ones), noise left out."""
    mine = F.array_contains("keys", key)
    fresh = F.coalesce(F.col("ts") > since, F.lit(False)) & (main | mine)
    rows = turns.where(~F.col("noise")).withColumn("mine", F.coalesce(mine, F.lit(False))).withColumn("new", fresh)
    return rows.where("mine") if scope == "mine" else rows.where("new") if scope == "new" else rows


def within(turns: DataFrame, parts: DataFrame) -> DataFrame:
    """Turns of units that are part of a session: those inside of start..end. parts: session_id, start, end; sessions without a row stay whole."""
    p = parts.select(F.col("session_id").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    rows = turns.join(p, F.col("session_id") == F.col("_s"), "left")
    return rows.where(F.col("_s").isNull() | F.col("turn").between(F.col("_a"), F.col("_b"))).drop("_s", "_a", "_b")


def hidden_noise(turns: DataFrame) -> DataFrame:
    """(session_id, shown, hidden_noise): messages that a page shows, and automatic ones that it leaves out."""
    return turns.groupBy("session_id").agg(F.count_if(~F.col("noise")).alias("shown"), F.count_if("noise").alias("hidden_noise"))


def git_commands(turns: DataFrame, pattern: str) -> Column:
    """The commands of a turn that match; none if the table has no commands."""
    return F.filter("commands", lambda c: c.rlike(pattern)) if "commands" in turns.columns else F.array().cast("array<string>")


def page(rows: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """One page of each session's messages, with the total."""
    by = Window.partitionBy("session_id")
    limit = min(PAGE_MOST, max(1, limit))
    numbered = rows.withColumn("at", F.row_number().over(by.orderBy("turn"))).withColumn("total", F.count("*").over(by))
    return numbered.where(F.col("at").between(offset + 1, offset + limit))


def usable(turns: DataFrame) -> Column:
    """Not noise, and edited files, ran git, or said something."""
    worked = (F.size("files") > 0) | (F.size(git_commands(turns, X.GIT_WORK)) > 0)
    return ~F.col("noise") & (worked | (~F.col("compaction") & (X.meaningful("text") != "")))


def contents(turns: DataFrame, scan: int = 12) -> DataFrame:
    """(session_id, has_content, title): a meaningful message among the first ones, and the first within thirty as a title."""
    said = turns.withColumn("said", X.meaningful("text"))
    return said.groupBy("session_id").agg(F.coalesce(F.bool_or((F.col("said") != "") & (F.col("turn") < scan)), F.lit(False)).alias("has_content"), F.min_by(X.cut_title(X.redact("said")), F.when((F.col("said") != "") & (F.col("turn") < 30), F.col("turn"))).alias("title"))


def range_summaries(turns: DataFrame, ranges: DataFrame) -> DataFrame:
    """Summary of the messages of each range of a session; ranges without a meaningful message are left out."""
    r = ranges.select(F.col("session_id").alias("rs"), "start", "end")
    rows = turns.where(~F.col("noise")).join(r, (F.col("session_id") == F.col("rs")) & F.col("turn").between(F.col("start"), F.col("end"))).withColumn("said", X.meaningful("text"))
    out = rows.groupBy("session_id", "start", "end").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_prompts"), F.countDistinct(X.local_day("ts")).alias("days"), F.min_by(X.cut_title(X.redact("said")), F.when(F.col("said") != "", F.col("turn"))).alias("title"))
    return out.where("title is not null")


def skeleton(turns: DataFrame, bounds: DataFrame) -> DataFrame:
    """One text per session: a redacted line per turn with its keys and folder; candidate boundaries are marked."""
    marked = turns.join(bounds.withColumn("cand", F.lit(" <cand>")), ["session_id", "turn"], "left")
    line = F.concat(F.lit("t"), F.col("turn").cast("string"), F.lit(" "), F.date_format("ts", "MM-dd'T'HH:mm"), F.lit(" keys=["), F.array_join(F.array_sort("keys"), ","), F.lit("] cwd="), X.basename("cwd"), X.nn("cand"), F.lit(" | "), F.substring(F.regexp_replace(X.redact("text"), "\n", " "), 1, 160))
    return marked.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("skeleton"))


def transcript(turns: DataFrame, spans: DataFrame, prompt: int = PROMPT, reply: int = REPLY) -> DataFrame:
    """(session_id, text): tagged lines of the selected turns: prompt, last reply, edits, git commands. spans: session_id, start, end, lead."""
    s = spans.select(F.col("session_id").alias("ss"), "start", "end", "lead")
    rows = turns.join(s, (F.col("session_id") == F.col("ss")) & F.col("turn").between(F.col("start"), F.col("end")))
    tag = F.concat(F.lit("[s:"), "session_id", F.lit(" t:"), F.col("turn").cast("string"), F.lit(" "), F.date_format("ts", "MM-dd'T'HH:mm"), F.lit("]"), F.when(F.col("lead"), " (lead-up context)").otherwise(""))
    said = F.when(~F.col("noise"), F.concat(tag, F.lit(" USER: "), F.substring(X.redact("text"), 1, prompt)))
    answer = F.when(F.size("assistant") > 0, F.concat(tag, F.lit(" REPLY: "), F.substring(X.redact(F.element_at("assistant", -1)), 1, reply))) if "assistant" in turns.columns else F.lit(None).cast("string")
    edits = F.transform(F.array_sort(F.array_distinct("files")), lambda f: F.concat(tag, F.lit("   > edit "), X.short_path(f, F.col("cwd"))))
    ran = F.transform(git_commands(turns, X.GIT_WORK), lambda c: F.concat(tag, F.lit("   > bash "), F.substring(X.redact(c), 1, COMMAND)))
    lines = F.filter(F.concat(F.array(said, answer), edits, ran), lambda x: x.isNotNull())
    body = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "turn", lines.alias("ls")))), lambda x: x["ls"])), "\n")
    return rows.groupBy("session_id").agg(body.alias("text"))


def bounded_transcript(turns: DataFrame, spans: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """The longest of three transcripts that fits; if none does, lines from both ends of the shortest in turn while they fit, around a marker."""
    levels = [transcript(turns, spans, p, r).withColumnRenamed("text", f"t{k}") for k, (p, r) in enumerate(LEVELS)]
    rows = levels[0].join(levels[1], "session_id").join(levels[2], "session_id")
    rows = rows.withColumn("_ls", F.when(F.length("t2") > most, F.split("t2", "\n"))).withColumn("_n", F.size("_ls"))
    # the j-th line to be taken: first, last, second, last but one ...
    at = lambda j: F.when(j % 2 == 0, j / 2).otherwise(F.col("_n") - 1 - (j - 1) / 2).cast("int")
    taken = F.struct(F.lit(0).alias("used"), F.lit(0).alias("m"))

    def take(state, j):
        used = state["used"] + F.length(F.get(F.col("_ls"), at(j))) + 1  # a line that doesn't fit ends it: what follows only adds to `used`
        return F.struct(used.alias("used"), (state["m"] + (used <= max(1, most - MARKER_ROOM)).cast("int")).alias("m"))

    rows = rows.withColumn("_m", F.aggregate(F.sequence(F.lit(0), F.col("_n") - 1), taken, take, lambda x: x["m"]))
    first, last = F.ceil(F.col("_m") / 2).cast("int"), F.floor(F.col("_m") / 2).cast("int")
    marker = F.concat(F.lit("[... "), (F.col("_n") - F.col("_m")).cast("string"), F.lit(MARKER))
    ends = F.concat(F.slice("_ls", F.lit(1), first), F.array(marker), F.slice("_ls", F.col("_n") - last + 1, last))
    fits = [F.when(F.length(f"t{k}") <= most, F.col(f"t{k}")) for k in range(3)]
    return rows.select("session_id", F.coalesce(*fits, F.array_join(ends, "\n")).alias("text"))


def public_view(turns: DataFrame, most: int = 4000) -> DataFrame:
    """Redacted text and last reply of each turn, its files and commits or pushes, and whether a text was cut."""
    clean = F.when(F.col("noise"), F.lit("")).otherwise(X.redact("text"))
    reply = X.redact(F.element_at("assistant", -1)) if "assistant" in turns.columns else F.lit("")
    ran = F.slice(git_commands(turns, r"\bgit\s+(commit|push)\b"), 1, SHOWN_COMMANDS)
    return turns.select(
        "session_id", "turn", F.substring(clean, 1, most).alias("user"), F.substring(reply, 1, most).alias("reply"), (F.length(clean) > most).alias("cut"),
        (F.length(reply) > most).alias("reply_cut"), F.array_sort(F.array_distinct("files")).alias("files"),
        F.transform(ran, lambda c: F.substring(X.redact(c), 1, SHOWN_COMMAND)).alias("commands"),
    )


def path_mentions(texts: DataFrame, files: DataFrame, unit: str = "unit") -> DataFrame:
    """(unit, mention, short): paths in a text that name a file of the unit, exactly or as the only one that ends so. Joined on the last part of the path."""
    rx = r"(?<![\w./-])(?:[\w@.-]+/)*[\w@-]+\.[A-Za-z]\w{0,9}(?![\w/])"
    said = texts.select(unit, F.explode(F.array_distinct(F.regexp_extract_all(X.nn("text"), F.lit(rx), F.lit(0)))).alias("mention")).distinct()
    last = lambda c: X.basename(c)
    pairs = said.withColumn("b", last("mention")).join(files.select(unit, "short").withColumn("b", last("short")), [unit, "b"])
    ends = F.endswith(F.col("short"), F.concat(F.lit("/"), F.col("mention"))) | F.endswith(F.col("mention"), F.concat(F.lit("/"), F.col("short")))
    hit = pairs.where((F.col("mention") == F.col("short")) | ends).withColumn("exact", F.col("mention") == F.col("short"))
    best = hit.groupBy(unit, "mention").agg(F.count("*").alias("n"), F.bool_or("exact").alias("any_exact"), F.max(F.when(F.col("exact"), F.col("short"))).alias("e"), F.min("short").alias("only"))
    return best.where("any_exact or n = 1").select(unit, "mention", F.coalesce("e", "only").alias("short"))
