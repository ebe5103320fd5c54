"""Corrections: an append-only log of operations, folded in order, and the units that follow from it.

The fold is joins and aggregates on (workspace, subject): the newest operation counts, and a
split ends what came before it. No workspace has to fit in a task, and every operation counts.
Operations of one `seq` follow the order of their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import written

MAX_LABEL, MAX_PARTS = 120, 40
TYPES = ("rename", "merge", "split", "move", "cut", "hide")

OPS = """workspace string, seq long, id string, batch string, ts string, type string, unit string, session string, `to` string,
         label string, hidden boolean, members array<string>, parts array<struct<start:int,end:int,label:string>>, source string, undone boolean"""
STATE = "workspace string, kind string, subject string, target string, ord long, start int, end int, ai boolean"


def _text(c: str):
    return F.coalesce(F.length(c).between(1, 399), F.lit(False))


def _stripped(c):
    """Without blanks at the ends, as Python's strip."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _parts(parts):
    """2 to 40 ascending ranges without overlap, sorted by start, else null."""
    own = F.array_sort(parts, lambda x, y: F.signum(F.coalesce(x["start"], F.lit(-1)).cast("long") - F.coalesce(y["start"], F.lit(-1))).cast("int"))
    fits = lambda x, i: x["start"].isNotNull() & x["end"].isNotNull() & (x["start"] >= 0) & (x["end"] >= x["start"]) & ((i == 0) | (x["start"] > F.coalesce(F.get(own, i - 1)["end"], F.lit(-1))))
    ok = F.size(parts).between(2, MAX_PARTS) & (F.size(F.filter(own, fits)) == F.size(parts))
    label = lambda x: F.substring(_stripped(F.regexp_replace(F.coalesce(x["label"], F.lit("")), r"(?U)[\s\x1c-\x1f]+", " ")), 1, MAX_LABEL)
    return F.when(ok, F.transform(own, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), label(x).alias("label"))))


def fold(ops: DataFrame) -> DataFrame:
    """State of each workspace as rows: label, merge member, move, cut part, hidden unit, hidden session.

    `ord` puts rows in order: the members of a group, the parts of a cut, the moves (`moves_in_order`).
    Operations that were undone, or lack an id or a subject, count for nothing; an empty log has no rows.
    The log is read once, when this is called, and written by type."""
    live = ops.where(~F.coalesce("undone", F.lit(False)) & _text("id"))
    live = live.withColumn("label", F.substring(_stripped(F.coalesce("label", F.lit(""))), 1, MAX_LABEL)).withColumn("ai", F.coalesce(F.col("source") == "ai", F.lit(False)))
    own = live.where(F.col("type").isin(*TYPES)).select("workspace", "seq", "id", "type", "unit", "session", "to", "label", "hidden", "members", "parts", "ai")
    log = written(own, "corrections-log", by="type")  # read some ten times, a type or two each
    of = lambda kind: log.where(F.col("type") == kind)
    null = lambda t: F.lit(None).cast(t)
    at = F.struct("seq", "id")

    def rows(df, kind, subject, target=null("string"), order=F.lit(0), start=null("int"), end=null("int"), ai=F.lit(False)):
        return df.select("workspace", F.lit(kind).alias("kind"), F.col(subject).alias("subject"), target.alias("target"), order.cast("long").alias("ord"), start.alias("start"), end.alias("end"), ai.alias("ai"))

    splits = of("split").where(_text("unit")).groupBy("workspace", F.col("unit").alias("_unit")).agg(F.max("seq").alias("_split"))

    def after_split(df, on):
        joined = df.withColumnRenamed("workspace", "_w").join(splits, F.col("_w").eqNullSafe(F.col("workspace")) & (F.col(on) == F.col("_unit")), "left")
        return joined.where(F.col("_split").isNull() | (F.col("seq") > F.col("_split"))).drop("workspace", "_unit", "_split").withColumnRenamed("_w", "workspace")

    def newest(df, by, *values):
        return df.groupBy("workspace", by).agg(F.max_by(F.struct(*values), at).alias("v")).select("workspace", by, "v.*")

    labels = newest(after_split(of("rename").where(_text("unit")), "unit"), "unit", "label", "ai").where("label <> ''")
    merges = after_split(of("merge").where(_text("unit") & F.col("members").isNotNull()), "unit")
    groups = merges.groupBy("workspace", "unit").agg(F.max_by("label", F.when(F.col("label") != "", at)).alias("label"), F.max("ai").alias("ai"))
    members = merges.select("workspace", "unit", "seq", "id", F.posexplode("members").alias("pos", "m")).where(_text("m") & (F.col("m") != F.col("unit")))
    members = members.groupBy("workspace", "unit", "m").agg(F.min(F.struct("seq", "id", "pos")).alias("first"))
    members = members.join(groups.select("workspace", "unit", "ai").withColumnsRenamed({"workspace": "_w", "unit": "_u"}), F.col("workspace").eqNullSafe(F.col("_w")) & (F.col("unit") == F.col("_u")))
    within = F.row_number().over(Window.partitionBy("workspace", "unit").orderBy("first")) - 1
    moves = moves_in_order(of("move").where(_text("session") & _text("to")), of("split").where(_text("unit")))
    cuts = newest(of("cut").where(_text("session")).withColumn("parts", _parts(F.col("parts"))).where("parts is not null"), "session", "parts")
    cuts = cuts.select("workspace", "session", F.posexplode("parts").alias("pos", "x"))
    hidden = lambda df, by: newest(df.withColumn("hidden", F.coalesce("hidden", F.lit(True))), by, "hidden").where("hidden")
    hides = of("hide")
    units = hidden(after_split(hides.where(_text("unit")), "unit"), "unit")
    sessions = hidden(hides.where(~_text("unit") & _text("session")), "session")
    out = rows(labels, "label", "unit", F.col("label"), ai=F.col("ai"))
    out = out.unionByName(rows(members, "merge", "unit", F.col("m"), within, ai=F.col("ai"))).unionByName(rows(groups, "group", "unit", F.col("label"), ai=F.col("ai")))
    out = out.unionByName(rows(moves, "move", "session", F.col("to"), F.col("ord")))
    out = out.unionByName(rows(cuts, "cut", "session", F.col("x.label"), F.col("pos"), F.col("x.start"), F.col("x.end"), F.col("x.label") != ""))
    return out.unionByName(rows(units, "hidden_unit", "unit")).unionByName(rows(sessions, "hidden_session", "session"))


def moves_in_order(moves: DataFrame, splits: DataFrame) -> DataFrame:
    """(workspace, session, to, ord): where each session was moved last, and its place among the moves.

    A session that is moved again keeps its place. Splitting a unit forgets the moves into it, and with them their places."""
    both = moves.select("workspace", "to", "seq", "id", "session").unionByName(splits.select("workspace", F.col("unit").alias("to"), "seq", "id", F.lit(None).cast("string").alias("session")))
    # read backwards: a frame that grows is added to, one that shrinks is summed up anew for every row
    later = Window.partitionBy("workspace", "to").orderBy(F.desc("seq"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    ended = both.withColumn("split", F.min(F.when(F.col("session").isNull(), F.col("seq"))).over(later)).where("session IS NOT NULL")
    own = Window.partitionBy("workspace", "session").orderBy("seq", "id")
    after = F.lead("seq").over(own)
    told = ended.withColumn("next", after).withColumn("gone", F.coalesce(F.col("split") <= F.coalesce("next", "split"), F.lit(False)))
    run = F.sum(F.col("gone").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    first = F.min("seq").over(Window.partitionBy("workspace", "session", "run"))
    return told.withColumn("run", F.coalesce(run, F.lit(0))).withColumn("ord", first).where("next IS NULL AND NOT gone").select("workspace", "session", "to", "ord")


def undo(ops: DataFrame) -> DataFrame:
    """The log with its newest batch that is not undone marked as undone."""
    live = ops.where(~F.coalesce("undone", F.lit(False)))
    last = live.groupBy("workspace").agg(F.max_by(F.coalesce("batch", "id"), "seq").alias("_last"))
    gone = F.coalesce("undone", F.lit(False)) | (F.coalesce("batch", "id") == F.col("_last"))
    return ops.join(last, "workspace", "left").withColumn("undone", F.coalesce(gone, F.lit(False))).drop("_last")


def validate(ops: DataFrame, units: DataFrame) -> DataFrame:
    """(id, ok, reason) of asked-for operations. units: unit, source."""
    known = units.select(F.col("unit").alias("_u"), F.col("source").alias("_s"))
    n_known = ops.select("id", F.explode("members").alias("m")).distinct().join(known, F.col("m") == F.col("_u")).groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("_s") == "user").alias("groups"))
    rows = ops.join(known, F.col("unit") == F.col("_u"), "left").join(n_known, "id", "left")
    reason = (
        F.when(F.col("type").isin("rename", "hide", "split") & F.col("unit").isNotNull() & F.col("_u").isNull(), "unknown unit")
        .when((F.col("type") == "merge") & (F.coalesce("n", F.lit(0)) < 2), "fewer than two units")
        .when((F.col("type") == "merge") & (F.coalesce("groups", F.lit(0)) > 1), "two groups")
        .when((F.col("type") == "split") & (F.col("_s") != "user"), "only groups can be split")
        .when(F.length("label") > MAX_LABEL, "label too long")
        .when(~F.col("type").isin(*TYPES), "unknown operation")
    )
    return rows.select("id", reason.isNull().alias("ok"), reason.alias("reason"))


def settle(moves: DataFrame, auto: DataFrame, there: DataFrame) -> DataFrame:
    """(workspace, session_id, target, ord, back): which moves find their unit, in log order; the others go back.

    A session that goes back makes its own units again, and a later move can find those. So a unit is there from the smallest
    `ord` of a session that goes back to it, and which sessions go back depends on that: the rounds below begin with all
    going back and end when nothing changes, after as many rounds as the longest chain of moves that depend on each other
    has links. A round is an aggregate per unit and two joins; no pair of moves is formed.
    moves: workspace, session_id, target, ord; auto: workspace, session_id, unit; there: units (workspace, unit) that exist anyway."""
    found = moves.join(there.select("workspace", F.col("unit").alias("target"), F.lit(True).alias("there")).distinct(), ["workspace", "target"], "left")
    found = written(found.select("workspace", "session_id", "target", "ord", F.coalesce("there", F.lit(False)).alias("there")), "moves")
    made = written(found.where("NOT there").select("workspace", "session_id", "ord").join(auto.select("workspace", "session_id", "unit"), ["workspace", "session_id"]), "moves-made")
    now = found.where("NOT there").select("workspace", "session_id", "target", "ord", F.lit(True).alias("back"))
    while True:
        born = made.join(now.where("back").select("workspace", "session_id"), ["workspace", "session_id"], "left_semi")
        born = born.groupBy("workspace", F.col("unit").alias("target")).agg(F.min("ord").alias("born"))
        back = ~F.coalesce(F.col("born") < F.col("ord"), F.lit(False))
        after = written(now.withColumnRenamed("back", "was").join(born, ["workspace", "target"], "left").withColumn("back", back), "moves-round")
        now = after.select("workspace", "session_id", "target", "ord", "back")
        if after.where("back <> was").isEmpty():
            return found.where("there").select("workspace", "session_id", "target", "ord", F.lit(False).alias("back")).unionByName(now)


def apply(member: DataFrame, state: DataFrame, sessions: DataFrame) -> DataFrame:
    """(workspace, session_id, unit, mode, start, end, label, hidden) after the corrections of each workspace.

    Order: hidden sessions leave; cut sessions without a unit are parts; a moved session goes, in log order,
    into a group, else into a unit that exists by then, else where it was; merged units lose their own.
    member: workspace, session_id, unit, mode; sessions: workspace, session_id, n_prompts.
    """
    from .ranges import pieces

    who, where = ["workspace", "session_id"], ["workspace", "unit"]
    state = written(state, "corrections", by="kind")
    of = lambda kind, **names: state.where(F.col("kind") == kind).select("workspace", *(F.col(c).alias(n) for n, c in names.items()))
    shown = member.join(of("hidden_session", session_id="subject"), who, "left_anti").select(*who, "unit", "mode", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    both = F.concat_ws("\u0001", "workspace", "session_id")  # one key for the ranges of a session in a workspace
    cuts = state.where("kind = 'cut'").withColumn("session_id", F.col("subject")).select(both.alias("session_id"), "start", "end", F.col("target").alias("label"))
    parts = pieces(cuts, sessions.select(both.alias("session_id"), F.col("n_prompts").alias("n"))).groupBy(F.col("session_id").alias("_key")).agg(F.collect_list(F.struct("start", "end")).alias("_parts"))
    loose = F.startswith("unit", F.lit("session:")) & (F.col("mode") == "main")
    cut = shown.withColumn("_key", F.when(loose, both)).join(parts, "_key", "left").withColumn("_part", F.explode_outer("_parts"))
    named = F.when(F.col("_part").isNull(), F.col("unit")).otherwise(F.concat("unit", F.lit("#"), F.col("_part.start"), F.lit("-"), F.col("_part.end")))
    auto = written(cut.select(*who, named.alias("unit"), "mode", F.col("_part.start").alias("start"), F.col("_part.end").alias("end")), "auto-placed")
    moves, groups = of("move", session_id="subject", target="target", ord="ord"), of("group", unit="subject", group_label="target")
    placed = auto.join(moves, who, "left_anti")
    moves = moves.join(auto.select(*who).distinct(), who, "left_semi")
    settled = settle(moves, auto, placed.select(*where).unionByName(groups.select(*where)))
    forced = settled.where("NOT back").select(*who, F.col("target").alias("unit"), F.lit("forced").alias("mode"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    returned = auto.join(settled.where("back"), who, "left_semi")
    rows = placed.unionByName(forced).unionByName(returned)
    merged = of("merge", g="subject", unit="target")
    mode = F.when(F.col("g").isNotNull(), "forced").otherwise(F.col("mode"))
    joined = rows.join(merged, where, "left").select(*who, F.coalesce("g", "unit").alias("unit"), mode.alias("mode"), "start", "end")
    # two parts of one session in one group give the session back as a whole
    alone = lambda c: F.when(F.count("*") == 1, F.max(c)).alias(c)
    whole = joined.groupBy(*who, "unit").agg(F.min("mode").alias("mode"), alone("start"), alone("end"))
    labels, hidden = of("label", unit="subject", label="target"), of("hidden_unit", unit="subject").withColumn("hidden", F.lit(True))
    out = whole.join(labels, where, "left").join(groups, where, "left").join(hidden, where, "left")
    return out.select(*who, "unit", "mode", "start", "end", F.coalesce("label", "group_label").alias("label"), F.coalesce("hidden", F.lit(False)).alias("hidden"))
