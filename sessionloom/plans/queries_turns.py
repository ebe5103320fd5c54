"""Queries of turns, ranges, session files, proposals and corrections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corrections, files, messages, organize, ranges
from ..sources import stages
from . import adapters as A
from .queries import _KEYED, _member, query
from .queries_records import _OPS, _ops


def _quarter(c):
    return F.conv(F.substring(F.md5(c), 1, 2), 16, 10).cast("int") % 4


@query(f"""WITH {A.SQL_PROMPTS}, pt AS (SELECT session_id, 2 AS a, 9 AS b FROM p GROUP BY 1 HAVING count(*) % 2 = 0)
SELECT session_id, count(*) FILTER (NOT noise) AS shown, count(*) FILTER (noise) AS hidden_noise FROM p LEFT JOIN pt USING (session_id) WHERE a IS NULL OR turn BETWEEN a AND b GROUP BY 1""")
def p10_hidden_noise(spark, sf):
    p = A.prompts(spark, sf)
    parts = p.groupBy("session_id").agg(F.count("*").alias("n")).where("n % 2 = 0").select("session_id", F.lit(2).alias("start"), F.lit(9).alias("end"))
    return messages.hidden_noise(messages.within(p, parts))


@query(f"""WITH {A.SQL_PROMPTS}, s AS (SELECT session_id, any_value(project) AS workspace, min(ts) AS first_ts, bool_and(noise) AS noise, count(*) % 7 = 0 AS hidden, count(*) % 5 = 0 AS cut FROM p GROUP BY 1)
SELECT workspace, session_id FROM s WHERE NOT noise AND NOT hidden AND NOT cut QUALIFY row_number() OVER (PARTITION BY workspace ORDER BY first_ts DESC, session_id) <= 160""")
def p15_eligible_sessions(spark, sf):
    own = A.prompts(spark, sf).groupBy("session_id", F.col("project").alias("workspace")).agg(F.min("ts").alias("first_ts"), F.bool_and("noise").alias("noise"), F.count("*").alias("n"))
    return organize.run_sessions(own.selectExpr("*", "true as alone", "n % 7 = 0 as hidden", "n % 5 = 0 as cut")).select("workspace", "session_id")


_FEED = _KEYED + """, it AS (SELECT unit, session_id, mode = 'mention' AS keyed, ('0x' || substr(md5(session_id), 1, 2))::INT % 4 AS q FROM mem),
sz AS (SELECT session_id, count(*) AS n FROM p GROUP BY 1),
ci AS (SELECT DISTINCT unit, it.session_id FROM it JOIN p ON p.session_id = it.session_id AND list_contains(p.keys, unit)),
md AS (SELECT it.unit, it.session_id, it.n_known, CASE WHEN it.n_known > 0 THEN 'known-ranges' WHEN keyed AND ci.unit IS NOT NULL AND n_voted > 0 THEN 'voted' WHEN keyed AND ci.unit IS NOT NULL THEN 'heuristic' ELSE 'whole-session' END AS mode
  FROM (SELECT it.*, CASE WHEN q = 0 THEN (SELECT count(*) FROM p WHERE p.session_id = it.session_id AND turn % 5 = 1) ELSE 0 END AS n_known,
               CASE WHEN q = 1 THEN (SELECT count(*) FROM p WHERE p.session_id = it.session_id AND turn % 3 = 0) ELSE 0 END AS n_voted FROM it) it LEFT JOIN ci USING (unit, session_id)),
tn AS (SELECT md.unit, md.session_id, md.mode, unnest(range(greatest(0, turn - 3), least(n, turn + 2))) AS t FROM md JOIN p USING (session_id) JOIN sz USING (session_id) WHERE md.mode = 'known-ranges' AND turn % 5 = 1
  UNION SELECT md.unit, md.session_id, md.mode, unnest(range(turn, turn + CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END)) FROM md JOIN p USING (session_id) WHERE md.mode = 'voted' AND turn % 3 = 0
  UNION SELECT md.unit, md.session_id, md.mode, turn FROM md JOIN p USING (session_id) WHERE md.mode = 'heuristic' AND list_contains(p.keys, md.unit)
  UNION SELECT md.unit, md.session_id, md.mode, turn FROM md JOIN p USING (session_id) WHERE md.mode = 'whole-session'),
il AS (SELECT *, t - row_number() OVER (PARTITION BY unit, session_id, mode ORDER BY t) AS i FROM tn)"""


@query(f"""WITH {_FEED} SELECT unit, session_id, min(t)::INT AS start, max(t)::INT AS "end", mode FROM il GROUP BY unit, session_id, mode, i""")
def p17_feed_ranges(spark, sf):
    p = A.prompts(spark, sf)
    items = _member(p).select("unit", "session_id", (F.col("mode") == "mention").alias("keyed"))
    q = items.withColumn("q", _quarter("session_id"))
    turns = p.select("session_id", "turn", "keys")
    cites = items.join(turns, "session_id").where(F.array_contains("keys", F.col("unit")))
    known = q.where("q = 0").join(turns.where("turn % 5 = 1"), "session_id").select("unit", "session_id", (F.col("turn") - 3).alias("start"), (F.col("turn") + 1).alias("end"))
    one = q.where("q = 1").join(turns.where("turn % 3 = 0"), "session_id").select("unit", "session_id", F.col("turn").alias("start"), F.col("turn").alias("end"))
    two = one.where("start % 2 = 0").withColumn("end", F.col("start") + 1)  # a second vote says more of some
    heuristic = cites.select("unit", "session_id", F.col("turn").alias("start"), F.col("turn").alias("end"))
    sizes = p.groupBy("session_id").agg(F.count("*").alias("n"))
    return ranges.feed_ranges(items, cites, known, one.unionByName(two), heuristic, sizes)


@query(f"""WITH {A.SQL_PROMPTS}, f AS (SELECT session_id, turn, event_id, unnest(files) AS path FROM p), g AS (SELECT session_id, path, bool_or(event_id % 4 = 0) AS created FROM f WHERE path NOT LIKE '/tmp/%' GROUP BY 1, 2)
SELECT session_id, path, substr(path, 11) AS short, CASE WHEN created THEN 'created' ELSE 'edited' END AS kind, row_number() OVER (PARTITION BY session_id ORDER BY created DESC, substr(path, 11), path)::INT AS place FROM g QUALIFY place <= 60""")
def o9_session_files(spark, sf):
    written = F.when(F.col("event_id") % 4 == 0, F.col("files")).otherwise(F.array().cast("array<string>"))
    return files.session_files(A.prompts(spark, sf).withColumn("written", written))


_PROPOSALS = _KEYED + """, ev AS (SELECT 'pr' || event_id AS id, ['group', 'split', 'title'][event_id % 3 + 1] AS type, ['accepted', 'pending', 'rejected'][event_id // 8 % 3 + 1] AS status, 'b' || (event_id // 3) AS batch,
  ['high', 'medium', 'low', 'sure'][event_id % 4 + 1] AS confidence, [session_id, 'u' || (user_id // 2) || '-w1'] AS sessions, 'session:' || session_id AS unit, k FROM e WHERE event_id % 8 = 0),
lb AS (SELECT DISTINCT 'b' || (event_id // 3) AS batch FROM e WHERE event_id % 13 <> 0),
st AS (SELECT ev.* EXCLUDE (status), CASE WHEN status = 'accepted' AND lb.batch IS NULL THEN 'pending' ELSE status END AS status FROM ev LEFT JOIN lb USING (batch)),
ow AS (SELECT DISTINCT session_id FROM mem WHERE unit LIKE 'session:%' AND ('0x' || substr(md5(unit), 1, 2))::INT % 4 <> 0)"""


def _proposals(spark, sf):
    return A.event_rows(spark, sf).where("event_id % 8 = 0").selectExpr(
        "concat('pr', event_id) as id", "element_at(array('group', 'split', 'title'), cast(event_id % 3 + 1 as int)) as type",
        "element_at(array('accepted', 'pending', 'rejected'), cast(floor(event_id / 8) % 3 + 1 as int)) as status", "concat('b', floor(event_id / 3)) as batch",
        "element_at(array('high', 'medium', 'low', 'sure'), cast(event_id % 4 + 1 as int)) as confidence",
        "array(session_id, concat('u', cast(floor(user_id / 2) as int), '-w1')) as sessions", "concat('session:', session_id) as unit", "concat('title ', k) as title",
    )


@query(f"""WITH {_PROPOSALS}, x AS (SELECT id, status, unnest(sessions) AS session_id FROM st)
SELECT id, any_value(status) AS status, bool_and(ow.session_id IS NOT NULL) AS applies FROM x LEFT JOIN ow USING (session_id) GROUP BY 1""")
def v5_proposals_that_apply(spark, sf):
    units = _member(A.prompts(spark, sf)).select("unit", "session_id", (_quarter("unit") == 0).alias("hidden"))
    now = organize.status_of(_proposals(spark, sf), _ops(spark, sf).select("batch", "undone"))
    return now.select("id", "status").join(organize.applies(now, units), "id")


@query(f"""WITH {_PROPOSALS} SELECT 'all-' || id AS id, 'all' AS batch, CASE type WHEN 'group' THEN 'merge' WHEN 'split' THEN 'cut' ELSE 'rename' END AS type, unit, 'title ' || k AS label, 'ai' AS source, id AS proposal
FROM st WHERE confidence IN ('high', 'medium') AND ('0x' || substr(md5(unit), 1, 2))::INT % 4 <> 1""")
def v6_accept_all(spark, sf):
    p = _proposals(spark, sf)
    renamed = p.where(_quarter("unit") == 1).select("unit").distinct()
    return organize.accept(p, "all", renamed, "medium")


#: Moves one after another: each finds a group or a unit that is there by then, or its session goes back and makes its units.
#: A move's place is that of the session's first move since the unit that it was moved into was last split.
_MOVED = f"""{_OPS}, al AS (SELECT workspace, session_id, seq, t, lead(seq) OVER (PARTITION BY workspace, session_id ORDER BY seq) AS nxt FROM ops WHERE type = 'move'),
gn AS (SELECT al.workspace, al.session_id, max(al.seq) AS gone FROM al JOIN ops s ON s.type = 'split' AND s.workspace = al.workspace AND s.g = al.t AND s.seq > al.seq AND (nxt IS NULL OR s.seq < nxt) GROUP BY 1, 2),
pl AS (SELECT al.workspace, al.session_id, min(al.seq) AS place FROM al LEFT JOIN gn USING (workspace, session_id) WHERE gone IS NULL OR al.seq > gone GROUP BY 1, 2),
mer AS (SELECT DISTINCT workspace, g, u AS unit FROM ops m WHERE type = 'merge' AND NOT EXISTS (SELECT 1 FROM ops s WHERE s.workspace = m.workspace AND s.type = 'split' AND s.g = m.g AND s.seq > m.seq)),
sho AS (SELECT project AS workspace, session_id, unit, mode FROM mem JOIN pr USING (session_id)),
own AS (SELECT workspace, session_id, list(unit) AS units FROM sho GROUP BY 1, 2),
mo AS (SELECT workspace, session_id, target, units, row_number() OVER (PARTITION BY workspace ORDER BY place) AS i FROM mv JOIN pl USING (workspace, session_id) JOIN own USING (workspace, session_id)),
st AS (SELECT workspace, list(DISTINCT unit) AS there FROM (SELECT workspace, unit FROM sho ANTI JOIN mv USING (workspace, session_id) UNION SELECT workspace, g FROM mer) GROUP BY 1),
walk AS (SELECT workspace, 0::BIGINT AS i, NULL::VARCHAR AS session_id, NULL::VARCHAR AS target, false AS found, there FROM st
  UNION ALL SELECT walk.workspace, mo.i, mo.session_id, mo.target, list_contains(there, mo.target), CASE WHEN list_contains(there, mo.target) THEN there ELSE list_concat(there, mo.units) END
  FROM walk JOIN mo ON mo.workspace = walk.workspace AND mo.i = walk.i + 1)"""


@query(f"""WITH RECURSIVE {_KEYED}, {_MOVED.partition(A.SQL_EVENTS)[2].lstrip(', ')},
lab AS (SELECT workspace, u AS unit, arg_max(label, seq) AS label FROM ops WHERE type = 'rename' GROUP BY 1, 2),
hid AS (SELECT workspace, u AS unit FROM ops WHERE type = 'hide' GROUP BY 1, 2 HAVING arg_max(hidden, seq)),
rws AS (SELECT * FROM sho ANTI JOIN mv USING (workspace, session_id) UNION ALL SELECT workspace, session_id, target, 'forced' FROM walk WHERE found
  UNION ALL SELECT sho.* FROM sho JOIN walk USING (workspace, session_id) WHERE NOT found),
joi AS (SELECT workspace, session_id, coalesce(g, unit) AS unit, min(CASE WHEN g IS NULL THEN mode ELSE 'forced' END) AS mode FROM rws LEFT JOIN mer USING (workspace, unit) GROUP BY 1, 2, 3)
SELECT joi.workspace, session_id, joi.unit, mode, NULL::INT AS start, NULL::INT AS "end", label, hid.unit IS NOT NULL AS hidden
FROM joi LEFT JOIN lab USING (workspace, unit) LEFT JOIN hid ON hid.workspace = joi.workspace AND hid.unit = joi.unit""")
def j20_apply_corrections(spark, sf):
    p = stages.written(A.prompts(spark, sf).select("session_id", "project", "turn", "text", "branch", "all_keys"), "prompts")
    sizes = p.groupBy("session_id", F.col("project").alias("workspace")).agg(F.count("*").cast("int").alias("n_prompts"))
    return corrections.apply(_member(p).join(sizes.drop("n_prompts"), "session_id"), corrections.fold(_ops(spark, sf)), sizes)
