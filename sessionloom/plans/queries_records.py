"""Queries of messages, citations, records, usage and proposals over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corrections, evidence, files, messages, organize, ranges, segments, sessions
from ..sources import stages
from ..streaming import jobs
from . import adapters as A
from .queries import RE_ASSIGN, RE_SECRET, _boundaries, _capsules, _COMMITS, _day, _FRESH, _KEYED, _LINKS, _member, _MERGED, _ranges, _TAKEN, _TOK, _ts, query

_HAS = "('0x' || substr(md5(unit), 1, 4))::INT % 3 = 0"


def _has(c="unit"):
    return F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int") % 3 == 0


# -- predicates


@query(f"WITH {A.SQL_MESSAGES} SELECT session_id, line_no FROM m WHERE is_prompt AND trim(text) <> ''")
def p1_real_prompts(spark, sf):
    return A.messages(spark, sf).where(F.col("is_prompt") & (F.trim("text") != "")).select("session_id", "line_no")


@query(f"WITH {A.SQL_PROMPTS} SELECT event_id FROM p WHERE event_id % 4 NOT IN (0, 1)")
def p2_injected(spark, sf):
    shown = F.concat(F.when(F.col("event_id") % 4 == 0, "<command-name>x").when(F.col("event_id") % 4 == 1, "Caveat: ").otherwise(""), "text")
    return A.prompts(spark, sf).where(~X.starts_with_any(shown, X.INJECTED)).select("event_id")


@query(f"WITH {A.SQL_PROMPTS} SELECT event_id, noise, compaction FROM p")
def p3_noise(spark, sf):
    return A.prompts(spark, sf).select("event_id", "noise", "compaction")


@query(f"WITH {A.SQL_MESSAGES} SELECT session_id, count(*) FILTER (is_prompt) AS n_prompts FROM m GROUP BY 1 HAVING n_prompts > 0")
def p4_sessions_with_prompts(spark, sf):
    return A.messages(spark, sf).groupBy("session_id").agg(F.count_if("is_prompt").alias("n_prompts")).where("n_prompts > 0")


_GIT = "regexp_matches(c, '\\bgit\\s+(commit|push|checkout|switch|merge|rebase|cherry-pick)\\b')"


@query(f"WITH {A.SQL_PROMPTS} SELECT event_id, NOT noise AND (len(files) > 0 OR len(list_filter(commands, lambda c: {_GIT})) > 0 OR (NOT compaction AND text <> 'hello there')) AS usable FROM p")
def p6_usable_turns(spark, sf):
    p = A.prompts(spark, sf)
    return p.select("event_id", messages.usable(p).alias("usable"))


@query(f"WITH {A.SQL_PROMPTS} SELECT session_id, bool_or(NOT noise AND text <> 'hello there' AND turn < 12) AS has_content FROM p GROUP BY 1")
def p7_has_content(spark, sf):
    return messages.contents(A.prompts(spark, sf)).select("session_id", "has_content")


@query(f"WITH {A.SQL_PROMPTS} SELECT session_id, arg_min(text, turn) FILTER (NOT noise AND text <> 'hello there' AND turn < 30) AS title FROM p GROUP BY 1")
def w18_titles(spark, sf):
    return messages.contents(A.prompts(spark, sf)).select("session_id", "title")


@query(f"WITH {A.SQL_MESSAGES}, n AS (SELECT *, sum(is_prompt::INT) OVER (PARTITION BY session_id ORDER BY line_no) AS t FROM m) SELECT session_id, line_no FROM n WHERE t > 0 AND trim(text) <> ''")
def p8_owned_messages(spark, sf):
    return sessions.turn_numbers(A.messages(spark, sf)).where((F.col("turn") >= 0) & (F.trim("text") != "")).select("session_id", "line_no")


@query(f"WITH {_KEYED} SELECT p.session_id, turn, count(*) OVER (PARTITION BY p.session_id) AS total FROM p JOIN k USING (session_id) WHERE NOT noise AND list_contains(keys, k.key) QUALIFY row_number() OVER (PARTITION BY p.session_id ORDER BY turn) <= 5")
def p10_own_messages(spark, sf):
    p = A.prompts(spark, sf)
    keyed = p.join(sessions.detect_keys(p), "session_id")
    rows = messages.scoped(keyed, F.col("key"), F.lit(None).cast("timestamp"), F.lit(True), "mine")
    return messages.page(rows, 0, 5).select("session_id", "turn", "total")


@query(f"WITH {A.SQL_PROMPTS} SELECT session_id, turn, total FROM (SELECT session_id, turn, count(*) OVER (PARTITION BY session_id) AS total, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS r FROM p WHERE NOT noise) WHERE r BETWEEN 4 AND 8")
def o8_message_page(spark, sf):
    rows = messages.scoped(A.prompts(spark, sf), F.lit(""), F.lit(None).cast("timestamp"), F.lit(True))
    return messages.page(rows, 3, 5).select("session_id", "turn", "total")


@query(f"WITH {_KEYED} SELECT DISTINCT unit, regexp_full_match(unit, '[A-Z][A-Z0-9]{{1,9}}-[0-9]{{1,6}}') AS keyed FROM mem")
def p16_key_units(spark, sf):
    return _member(A.prompts(spark, sf)).select("unit", F.col("unit").rlike(f"^(?:{X.KEY_PATTERN})$").alias("keyed")).distinct()


@query(f"WITH {_KEYED}, n AS (SELECT session_id, count(*) AS n FROM sk GROUP BY 1) SELECT mem.session_id, unit, mode = 'main' AS main, coalesce(n.n, 0) > 1 AS mixed FROM mem LEFT JOIN n USING (session_id)")
def p18_session_flags(spark, sf):
    p = A.prompts(spark, sf)
    n = sessions.session_keys(p).groupBy("session_id").agg(F.count("*").alias("n"))
    return _member(p).join(n, "session_id", "left").select("session_id", "unit", (F.col("mode") == "main").alias("main"), (F.coalesce("n", F.lit(0)) > 1).alias("mixed"))


# -- citations

_IDS = A.SQL_PROMPTS + ", q AS (SELECT md5(session_id) AS session_id, turn, ts, text, noise, event_id FROM p), c AS (SELECT event_id AS cite_id, substr(session_id, 1, (4 + event_id % 5)::INT) AS session, ((event_id % 40))::VARCHAR AS turn FROM q WHERE event_id % 3 = 0)"


def _cited(spark, sf):
    p = A.prompts(spark, sf).withColumn("session_id", F.md5("session_id"))
    cites = p.where("event_id % 3 = 0").selectExpr("event_id as cite_id", "substr(session_id, 1, cast(4 + event_id % 5 as int)) as session", "cast(event_id % 40 as string) as turn")
    return p, cites


_RESOLVED = _IDS + """, s AS (SELECT DISTINCT session_id FROM q), cs AS (SELECT DISTINCT session FROM c), rs AS (SELECT cs.session, count(s.session_id) AS n, min(s.session_id) AS session_id FROM cs LEFT JOIN s ON starts_with(s.session_id, cs.session) GROUP BY 1)"""


@query(f"WITH {_RESOLVED} SELECT session, CASE WHEN n = 1 THEN session_id END AS session_id, CASE WHEN n = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM rs")
def p14_session_prefix(spark, sf):
    p, cites = _cited(spark, sf)
    return evidence.resolve_sessions(cites, p)


@query(f"""WITH {_RESOLVED}, f AS (SELECT cite_id, session_id, c.turn::INT AS n FROM c JOIN rs USING (session) WHERE rs.n = 1), h AS (SELECT f.* FROM f JOIN q ON q.session_id = f.session_id AND q.turn = f.n)
SELECT cite_id, h.session_id, q.turn, q.turn = h.n AS cited, CASE WHEN noise THEN '' ELSE text END AS user FROM h JOIN q ON q.session_id = h.session_id AND q.turn BETWEEN h.n - 2 AND h.n + 2""")
def j8_cited_turns(spark, sf):
    p, cites = _cited(spark, sf)
    return evidence.resolve_cites(cites, p)


@query(f"""WITH {_RESOLVED}, f AS (SELECT cite_id // 9 AS row_id, cite_id, session_id, c.turn::INT AS n FROM c JOIN rs USING (session) WHERE rs.n = 1), t AS (SELECT row_id, cite_id, q.ts FROM f JOIN q ON q.session_id = f.session_id AND q.turn = f.n)
SELECT r.row_id, strftime(arg_min(ts, t.cite_id), '%Y-%m-%d %H:%M:%S.%f') AS ts FROM (SELECT DISTINCT cite_id // 9 AS row_id FROM c) r LEFT JOIN t USING (row_id) GROUP BY 1""")
def j11_row_times(spark, sf):
    p, cites = _cited(spark, sf)
    rows = cites.groupBy(F.floor(F.col("cite_id") / 9).alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("cite_id", "session", "turn"))), lambda c: F.struct(c["session"].alias("session"), c["turn"].alias("turn"))).alias("cites"))
    return evidence.row_times(rows, p).withColumn("ts", _ts("ts"))


_CITES = _MERGED + ", c AS (SELECT event_id AS cite_id, session_id, event_id % 30 AS turn FROM p WHERE event_id % 5 = 0), sz AS (SELECT session_id, count(*) AS size FROM p GROUP BY 1)"


def _own_cites(spark, sf):
    p = A.prompts(spark, sf)
    return p, p.where("event_id % 5 = 0").selectExpr("event_id as cite_id", "session_id", "cast(event_id % 30 as string) as turn"), ranges.merge_ranges(_ranges(spark, sf), ["session_id"])


@query(f'WITH {_CITES} SELECT cite_id, session_id, turn::VARCHAR AS turn FROM c WHERE EXISTS (SELECT 1 FROM mr WHERE mr.session_id = c.session_id AND c.turn BETWEEN mr.start AND mr."end")')
def j9_valid_cites(spark, sf):
    _, cites, r = _own_cites(spark, sf)
    return evidence.valid_cites(cites, r)


@query(f"""WITH {_CITES}, mx AS (SELECT session_id, max("end") AS e FROM mr GROUP BY 1)
SELECT cite_id, CASE WHEN c.turn >= size OR coalesce(e, -1) >= size THEN 'turn_missing' WHEN e IS NULL OR EXISTS (SELECT 1 FROM mr WHERE mr.session_id = c.session_id AND c.turn BETWEEN mr.start - 4 AND mr."end") THEN 'verified' ELSE 'unverified' END AS confidence
FROM c JOIN sz USING (session_id) LEFT JOIN mx USING (session_id)""")
def j10_cite_confidence(spark, sf):
    p, cites, r = _own_cites(spark, sf)
    return evidence.confidence(cites, r, p.groupBy("session_id").agg(F.count("*").alias("size")))


@query(f"""WITH {_CITES}, ok AS (SELECT * FROM c WHERE EXISTS (SELECT 1 FROM mr WHERE mr.session_id = c.session_id AND c.turn BETWEEN mr.start AND mr."end"))
SELECT c.session_id AS capsule, CASE c.cite_id % 2 WHEN 0 THEN 'decisions' ELSE 'timeline' END AS field, c.cite_id AS pos, (ok.cite_id IS NOT NULL)::INT AS n_cites, c.cite_id % 2 = 1 OR ok.cite_id IS NOT NULL AS kept FROM c LEFT JOIN ok USING (cite_id)""")
def v4_validate_record(spark, sf):
    _, cites, r = _own_cites(spark, sf)
    items = cites.select(F.col("session_id").alias("capsule"), F.when(F.col("cite_id") % 2 == 0, "decisions").otherwise("timeline").alias("field"), F.col("cite_id").alias("pos"), F.lit("x").alias("body"), F.array(F.struct("session_id", "turn")).alias("cites"))
    return evidence.validate(items, r).select("capsule", "field", "pos", F.size("cites").alias("n_cites"), "kept")


@query(f"""WITH {_MERGED} SELECT session_id AS row_id, session_id AS session, start, "end" FROM mr""")
def f23_parse_sources(spark, sf):
    r = ranges.merge_ranges(_ranges(spark, sf), ["session_id"])
    said = r.groupBy("session_id").agg(F.concat(F.lit("`"), F.first("session_id"), F.lit("` (turns "), F.array_join(F.collect_list(F.concat("start", F.lit("-"), "end")), ", "), F.lit(")")).alias("source"))
    return evidence.parse_sources(said.select(F.col("session_id").alias("row_id"), "source"))


@query("""SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events""")
def f24_embedded_json(spark, sf):
    rows = A.table(spark, sf, "events").select("event_id", F.concat(F.lit("Sure, here it is:\n```json\n"), "props", F.lit("\n```\nbye")).alias("t"))
    return rows.select("event_id", evidence.embedded_json("t", "k int").alias("j")).select("event_id", "j.k")


# -- records and units


@query(f"WITH {_KEYED}, {_FRESH}, u AS (SELECT unit, sum(new) > 0 AS stale FROM per GROUP BY 1) SELECT unit, {_HAS} AS has_capsule, {_HAS} AND stale AS outdated FROM u")
def j16_units_with_records(spark, sf):
    p = stages.written(A.prompts(spark, sf), "prompts")
    m = _member(p)
    stale = sessions.staleness(p, m, _capsules(p, m))
    written = m.select("unit").distinct().where(_has()).withColumn("capsule", F.lit(True))
    rows = stale.join(written, "unit", "left").withColumn("has_capsule", F.coalesce("capsule", F.lit(False)))
    return rows.select("unit", "has_capsule", (F.col("has_capsule") & (F.col("new_messages") > 0)).alias("outdated"))


@query(f"WITH {_KEYED}, {_FRESH} SELECT unit, session_id, new, total FROM per")
def a20_session_staleness(spark, sf):
    p = stages.written(A.prompts(spark, sf), "prompts")
    m = _member(p)
    caps = _capsules(p, m)
    real = p.where(~F.col("noise"))
    main = m.where("mode = 'main'").join(real, "session_id").select("unit", "session_id", "ts")
    cited = m.where("mode = 'mention'").join(real, "session_id").where(F.array_contains("keys", F.col("unit"))).select("unit", "session_id", "ts")
    return main.unionByName(cited).join(caps, "unit").groupBy("unit", "session_id").agg(F.count_if(F.col("ts") > F.col("since")).alias("new"), F.count("*").alias("total"))


_BASIS = _KEYED + ", was AS (SELECT unit, session_id FROM mem WHERE ('0x' || substr(md5(unit || session_id), 1, 4))::INT % 4 <> 0 UNION ALL SELECT unit, session_id || '-gone' FROM mem WHERE ('0x' || substr(md5(unit || session_id), 1, 4))::INT % 7 = 0)"


def _basis(m):
    h = F.conv(F.substring(F.md5(F.concat("unit", "session_id")), 1, 4), 16, 10).cast("int")
    none = F.lit(None).cast("int")
    now = m.select("unit", "session_id", none.alias("start"), none.alias("end"))
    return now, now.where(h % 4 != 0).unionByName(now.where(h % 7 == 0).withColumn("session_id", F.concat("session_id", F.lit("-gone"))))


@query(f"""WITH {_BASIS}, b AS (SELECT coalesce(w.unit, n.unit) AS unit, w.unit IS NOT NULL AS w, n.unit IS NOT NULL AS n FROM was w FULL JOIN mem n ON w.unit = n.unit AND w.session_id = n.session_id)
SELECT unit, count(*) FILTER (NOT w) AS added, count(*) FILTER (NOT n) AS removed, count(*) FILTER (NOT w OR NOT n) > 0 AS changed FROM b WHERE unit IN (SELECT unit FROM was) GROUP BY 1""")
def j14_drift(spark, sf):
    now, was = _basis(stages.written(_member(A.prompts(spark, sf)), "members"))
    return evidence.drift(was, now, now.limit(0))


@query(f"""WITH {_KEYED}, old AS (SELECT 'old:' || unit AS previous, session_id FROM mem WHERE {_HAS}), o AS (SELECT unit, previous, count(*) AS overlap FROM mem JOIN old USING (session_id) GROUP BY 1, 2)
SELECT unit, previous, overlap, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY overlap DESC, previous) AS rank FROM o) WHERE rank <= 5""")
def j15_previous_records(spark, sf):
    now, _ = _basis(stages.written(_member(A.prompts(spark, sf)), "members"))
    return evidence.reusable(now.where(_has()).withColumn("unit", F.concat(F.lit("old:"), "unit")), now)


@query(f"WITH {_KEYED} SELECT session_id, min(unit) AS owner FROM mem WHERE mode = 'main' GROUP BY 1")
def j19_owner(spark, sf):
    order = Window.partitionBy("session_id").orderBy((F.col("mode") != "main").cast("int"), "unit")
    return _member(A.prompts(spark, sf)).withColumn("r", F.row_number().over(order)).where("r = 1").select("session_id", F.col("unit").alias("owner"))


@query(f"WITH {_KEYED}, a AS (SELECT event_id AS pos, upper(event_type) || '-' || (k % 9) AS key FROM e) SELECT key, min(pos) AS pos FROM a WHERE key IN (SELECT unit FROM mem) GROUP BY 1")
def j21_answer_keys(spark, sf):
    said = A.event_rows(spark, sf).select(F.col("event_id").alias("pos"), F.concat(F.upper("event_type"), F.lit("-"), F.col("k") % 9).alias("key"))
    known = _member(A.prompts(spark, sf)).select(F.col("unit").alias("key")).distinct()
    return said.join(known, "key", "left_semi").groupBy("key").agg(F.min("pos").alias("pos"))


@query(f"""WITH {_LINKS}, f AS (SELECT DISTINCT unit, short FROM lk), s AS (SELECT DISTINCT unit, regexp_extract(short, '[^/]+/[^/]+$') AS mention FROM f)
SELECT s.unit, mention, min(short) AS short FROM s JOIN f ON s.unit = f.unit AND ends_with(short, '/' || mention) GROUP BY 1, 2 HAVING count(*) = 1""")
def j22_path_mentions(spark, sf):
    p = A.prompts(spark, sf)
    own = files.session_links(p, _member(p)).select("unit", "short").distinct()
    said = own.select("unit", F.concat(F.lit("see "), F.regexp_extract("short", "[^/]+/[^/]+$", 0), F.lit(", please")).alias("text"))
    return messages.path_mentions(said, own)


@query(f"WITH {_LINKS} SELECT short, unit, row_number() OVER (PARTITION BY short ORDER BY last DESC, unit)::INT AS place FROM lk")
def o7_units_of_file(spark, sf):
    p = A.prompts(spark, sf)
    order = Window.partitionBy("short").orderBy(F.desc("last"), "unit")
    return files.session_links(p, _member(p)).select("short", "unit", F.row_number().over(order).alias("place"))


@query(f"WITH {_KEYED} SELECT unit, row_number() OVER (ORDER BY max(last_ts) DESC, unit)::INT AS place FROM mem JOIN pr USING (session_id) GROUP BY 1 QUALIFY place <= 50")
def o1_newest_units(spark, sf):
    p = A.prompts(spark, sf)
    top = sessions.unit_rollup(p, _member(p)).orderBy(F.desc_nulls_last("last_ts"), "unit").limit(50)  # a report of fifty
    return top.select("unit", F.row_number().over(Window.orderBy(F.desc_nulls_last("last_ts"), "unit")).alias("place"))


@query(f'WITH {_MERGED}, x AS (SELECT mr.*, p.ts, p.text, p.turn FROM mr JOIN p ON p.session_id = mr.session_id AND p.turn BETWEEN mr.start AND mr."end" WHERE NOT noise) SELECT session_id, start, "end", count(*) AS n_prompts, count(DISTINCT ts::DATE) AS days, arg_min(text, turn) FILTER (text <> \'hello there\') AS title FROM x GROUP BY 1, 2, 3 HAVING title IS NOT NULL')
def a27_range_summaries(spark, sf):
    p = A.prompts(spark, sf)
    return messages.range_summaries(p, ranges.merge_ranges(_ranges(spark, sf), ["session_id"])).select("session_id", "start", "end", "n_prompts", "days", "title")


@query(f"WITH {_KEYED} SELECT unit, md5(array_to_string(list_sort(list(session_id)), ',')) AS basis FROM mem GROUP BY 1")
def a28_basis(spark, sf):
    return _member(A.prompts(spark, sf)).groupBy("unit").agg(F.md5(F.array_join(F.array_sort(F.collect_list("session_id")), ",")).alias("basis"))


@query("SELECT event_type AS action, count(*) AS calls, sum(json_extract(props, '$.k')::INT * 10)::BIGINT AS input_tokens, sum(json_extract(props, '$.k')::INT)::BIGINT AS output_tokens, round(sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE value / 1000 END), 4) AS cost_usd FROM events GROUP BY 1")
def a19_usage_totals(spark, sf):
    calls = A.event_rows(spark, sf).selectExpr("event_type as action", "k * 10 as input_tokens", "k as output_tokens", "case when event_id % 7 <> 0 then value / 1000 end as cost_usd")
    return evidence.usage_totals(calls, ["action"])


@query(f"""SELECT source, sum(n)::BIGINT AS masked, sum(length(coalesce(text, '')))::BIGINT AS chars, (floor(sum(length(coalesce(text, ''))) / 4) + 4000) * 3 / 1e6 + 3000 * 15 / 1e6 AS usd
FROM (SELECT source, text, len(regexp_extract_all(regexp_replace(coalesce(text, ''), '{RE_SECRET}', '[REDACTED]', 'g'), '{RE_ASSIGN}')) + len(regexp_extract_all(coalesce(text, ''), '{RE_SECRET}')) AS n FROM documents) GROUP BY 1""")
def a21_masked_and_cost(spark, sf):
    rows = A.table(spark, sf, "documents").groupBy("source").agg(F.sum(X.count_redactions("text")).alias("masked"), F.sum(F.length(X.nn("text"))).alias("chars"))
    return rows.withColumn("usd", evidence.cost_estimate("chars"))


@query(f"""WITH {_TOK}, a AS (SELECT session_id, turn, sum(weight * weight) AS s FROM tw GROUP BY 1, 2), d AS (SELECT x.session_id, x.turn, sum(x.weight * y.weight) AS d FROM tw x JOIN tw y ON x.session_id = y.session_id AND y.turn = x.turn + 1 AND x.term = y.term GROUP BY 1, 2)
SELECT x.session_id, x.turn, CASE WHEN x.s > 0 AND y.s > 0 THEN round(coalesce(d, 0) / sqrt(x.s * y.s), 7) END AS cosine FROM a x JOIN a y ON x.session_id = y.session_id AND y.turn = x.turn + 1 LEFT JOIN d ON d.session_id = x.session_id AND d.turn = x.turn""")
def a30_cosine(spark, sf):
    return segments.next_cosine(segments.tfidf(segments.turn_tokens(A.prompts(spark, sf)))).withColumn("cosine", F.round("cosine", 7))


@query(f"WITH {_COMMITS} SELECT hash, arg_min(session_id, (ts, session_id)) AS session_id, min(ts) AS ts FROM cm GROUP BY 1")
def u5_distinct_commits(spark, sf):
    return files.commits(A.tool_events(spark, sf)).groupBy("hash").agg(F.min_by("session_id", F.struct("ts", "session_id")).alias("session_id"), F.min("ts").alias("ts"))


@query(f"WITH {A.SQL_PROMPTS} SELECT event_id, array_to_string(list_sort(list_distinct(all_keys)), ',') AS keys FROM p")
def u3_distinct_keys(spark, sf):
    return A.prompts(spark, sf).select("event_id", F.array_join(F.array_sort(F.array_distinct("all_keys")), ",").alias("keys"))


@query(f"""WITH {A.SQL_PROMPTS}, n AS (SELECT session_id, count(*) AS size FROM p WHERE session_id NOT LIKE '%w1' GROUP BY 1), o AS (SELECT session_id, count(*) FILTER (event_id % 11 <> 0) AS size FROM p WHERE session_id NOT LIKE '%w2' GROUP BY 1)
SELECT session_id, CASE WHEN o.size IS NULL THEN 'new' WHEN n.size IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM n FULL JOIN o USING (session_id) WHERE n.size IS DISTINCT FROM o.size""")
def u6_changed_sessions(spark, sf):
    p = A.prompts(spark, sf)
    now = p.where("session_id not like '%w1'").groupBy("session_id").agg(F.count("*").alias("size"), F.lit(0).alias("mtime"))
    was = p.where("session_id not like '%w2'").groupBy("session_id").agg(F.count_if(F.col("event_id") % 11 != 0).alias("size"), F.lit(0).alias("mtime"))
    return jobs.changed_sessions(now, was)


@query(f"WITH {A.SQL_PROMPTS}, s AS (SELECT project AS workspace, session_id, count(*) AS turns, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts FROM p GROUP BY 1, 2) SELECT workspace, sha1('1|' || array_to_string(list_sort(list(session_id || ':' || turns || ':' || last_ts)), ',')) AS signature FROM s GROUP BY 1")
def u8_run_signature(spark, sf):
    rows = A.prompts(spark, sf).groupBy(F.col("project").alias("workspace"), "session_id").agg(F.count("*").alias("turns"), _ts(F.max("ts")).alias("last_ts"))
    return organize.signature(rows)


# -- organize

_REAL = A.SQL_PROMPTS + """, rl AS (SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY session_id) AS n FROM p WHERE NOT noise AND text <> 'hello there')"""


@query(f"""WITH {_REAL} SELECT session_id, turn, n >= 14 AS long, n AS real FROM rl WHERE k < 3 OR k = n - 1 OR (n >= 14 AND list_contains(list_transform(range(0, least(40, n)), lambda j: floor(j * (n - 1) / greatest(1, least(40, n) - 1))::BIGINT), k))""")
def w15_sample(spark, sf):
    return organize.sample(A.prompts(spark, sf)).select("session_id", "turn", "long", "real")


_DIGEST = _REAL + """, sh AS (SELECT rl.session_id, rl.turn, p.ts, p.text, n >= 14 AS long, n AS real FROM rl JOIN p USING (session_id, turn)
  WHERE k < 3 OR k = n - 1 OR (n >= 14 AND list_contains(list_transform(range(0, least(40, n)), lambda j: floor(j * (n - 1) / greatest(1, least(40, n) - 1))::BIGINT), k))),
ln AS (SELECT session_id, any_value(long) AS long, any_value(real) AS real,
  string_agg('t' || turn || ' ' || strftime(ts, '%H:%M') || ' | ' || substr(text, 1, CASE WHEN long THEN 110 ELSE 170 END), chr(10) ORDER BY turn) AS body FROM sh GROUP BY 1),
fl AS (SELECT session_id, substr(path, 11) AS short, min(turn) AS f FROM (SELECT session_id, turn, unnest(files) AS path FROM p) GROUP BY 1, 2),
fs AS (SELECT session_id, array_to_string(list(short ORDER BY f)[1:6], ', ') AS files FROM fl GROUP BY 1),
hd AS (SELECT session_id, any_value(project) AS project, arg_min(branch, turn) AS branch, min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY 1),
dg AS (SELECT session_id, project AS workspace, first_ts, real, long, 'SESSION ' || substr(session_id, 1, 8) || ' | repo=' || project || ' | branch=' || branch || ' | ' || strftime(first_ts, '%Y-%m-%d %H:%M') || '-' || strftime(last_ts, '%H:%M')
  || ' | messages=' || real || CASE WHEN long THEN ' (long)' ELSE '' END || coalesce(chr(10) || 'files: ' || files, '') || chr(10) || body AS text FROM ln JOIN hd USING (session_id) LEFT JOIN fs USING (session_id))"""


@query(f"WITH {_DIGEST} SELECT session_id, real, long, text FROM dg")
def f34_digests(spark, sf):
    return organize.digests(A.prompts(spark, sf)).select("session_id", "real", "long", "text")


@query(f"""WITH RECURSIVE {_DIGEST}, ch AS (SELECT project AS workspace, session_id FROM p GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY project ORDER BY min(ts) DESC, session_id) <= 160),
od AS (SELECT dg.workspace, session_id, length(text) AS size, row_number() OVER (PARTITION BY dg.workspace ORDER BY first_ts, session_id) AS r FROM dg JOIN ch USING (workspace, session_id)),
fi AS (SELECT workspace, session_id, r, 0 AS batch, 1 AS held, size + 2 AS used FROM od WHERE r = 1 UNION ALL
  SELECT od.workspace, od.session_id, od.r, batch + over, CASE WHEN over = 1 THEN 1 ELSE held + 1 END, CASE WHEN over = 1 THEN 0 ELSE used END + size + 2
  FROM fi JOIN od ON od.workspace = fi.workspace AND od.r = fi.r + 1, LATERAL (SELECT CASE WHEN used + size + 2 > 36000 OR held >= 40 THEN 1 ELSE 0 END AS over))
SELECT workspace, session_id, batch FROM fi""")
def w16_batches(spark, sf):
    p = A.prompts(spark, sf)
    own = p.groupBy("session_id", F.col("project").alias("workspace")).agg(_ts(F.min("ts")).alias("first_ts"))
    chosen = organize.run_sessions(own.selectExpr("*", "true as alone", "false as noise", "false as hidden", "false as cut"))
    return organize.batches(organize.digests(p.join(chosen.select("session_id"), "session_id", "left_semi")).join(chosen.select("session_id", "workspace"), "session_id"))


@query(f"""WITH {A.SQL_PROMPTS}, sz AS (SELECT session_id, count(*) AS n FROM p GROUP BY 1), c AS (SELECT session_id, 1 AS start, 2 AS "end", 'one' AS label FROM sz WHERE n > 3 UNION ALL SELECT session_id, 5, 9, 'two' FROM sz WHERE n > 6)
SELECT session_id, start, least("end", n - 1)::INT AS "end", label FROM c JOIN sz USING (session_id) UNION ALL SELECT session_id, 0, 0, '' FROM sz WHERE n > 3 UNION ALL SELECT session_id, 3, 4, '' FROM sz WHERE n > 6
UNION ALL SELECT session_id, 3, (n - 1)::INT, '' FROM sz WHERE n BETWEEN 4 AND 6 UNION ALL SELECT session_id, 10, (n - 1)::INT, '' FROM sz WHERE n > 10""")
def w17_cut_pieces(spark, sf):
    sizes = A.prompts(spark, sf).groupBy("session_id").agg(F.count("*").cast("int").alias("n"))
    part = lambda least, a, b, label: sizes.where(F.col("n") > least).select("session_id", F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(label).alias("label"))
    return ranges.pieces(part(3, 1, 2, "one").unionByName(part(6, 5, 9, "two")), sizes)


@query(f"""WITH {_KEYED} SELECT substr(sha1('group|' || array_to_string(list_sort(list(session_id)), ',') || '|'), 1, 12) AS id, unit FROM mem GROUP BY unit""")
def f26_proposal_ids(spark, sf):
    per = _member(A.prompts(spark, sf)).groupBy("unit").agg(F.collect_list("session_id").alias("s")).withColumn("kind", F.lit("group"))
    return per.select(organize.proposal_id("kind", "s").alias("id"), "unit")


@query(f"""{_TAKEN}, kl AS (SELECT p.*, bd.turn IS NOT NULL AS cand FROM p LEFT JOIN bd ON bd.session_id = p.session_id AND bd.turn = p.turn)
SELECT session_id, string_agg('t' || turn || ' ' || strftime(ts, '%m-%dT%H:%M') || ' keys=[' || array_to_string(list_sort(keys), ',') || '] cwd=' || substr(cwd, 11) || CASE WHEN cand THEN ' <cand>' ELSE '' END || ' | ' || substr(text, 1, 160), chr(10) ORDER BY turn) AS skeleton
FROM kl GROUP BY 1""")
def f33_skeleton(spark, sf):
    p = A.prompts(spark, sf)
    return messages.skeleton(p, _boundaries(p))


_LINES = f"""{_MERGED}, x AS (SELECT DISTINCT p.session_id, p.turn, p.ts, p.text, p.noise, p.files, p.cwd, p.commands FROM p JOIN mr ON p.session_id = mr.session_id AND p.turn BETWEEN mr.start AND mr."end"),
l AS (SELECT session_id, turn, list_concat(list_filter([CASE WHEN NOT noise THEN '[s:' || session_id || ' t:' || turn || ' ' || strftime(ts, '%m-%dT%H:%M') || '] USER: ' || text END,
  CASE WHEN len(files) > 0 THEN '[s:' || session_id || ' t:' || turn || ' ' || strftime(ts, '%m-%dT%H:%M') || ']   > edit ' || substr(files[1], 11) END], lambda y: y IS NOT NULL),
  list_transform(list_filter(commands, lambda c: {_GIT}), lambda c: '[s:' || session_id || ' t:' || turn || ' ' || strftime(ts, '%m-%dT%H:%M') || ']   > bash ' || substr(c, 1, 200))) AS ls FROM x),
tr AS (SELECT session_id, array_to_string(flatten(list(ls ORDER BY turn)), chr(10)) AS t FROM l GROUP BY 1)"""


@query(f"WITH {_LINES} SELECT session_id, md5(t) AS text_md5 FROM tr")
def f28_transcript(spark, sf):
    spans = ranges.merge_ranges(_ranges(spark, sf), ["session_id"]).withColumn("lead", F.lit(False))
    return messages.transcript(A.prompts(spark, sf), spans).select("session_id", F.md5("text").alias("text_md5"))


@query(f"""WITH {_LINES}, ht AS (SELECT session_id, t, string_split(t, chr(10)) AS ls FROM tr), od AS (SELECT session_id, ls, unnest(range(len(ls))) AS j FROM ht WHERE length(t) > 900),
cu AS (SELECT session_id, sum(length(ls[CASE WHEN j % 2 = 0 THEN j // 2 + 1 ELSE len(ls) - j // 2 END]) + 1) OVER (PARTITION BY session_id ORDER BY j) AS used FROM od),
tk AS (SELECT session_id, count(*) FILTER (used <= 780) AS m FROM cu GROUP BY 1)
SELECT session_id, CASE WHEN m IS NULL THEN t ELSE array_to_string(ls[1:(m + 1) // 2] || ['[... ' || (len(ls) - m) || ' lines from the middle of this session were left out to keep the evidence small ...]'] || ls[len(ls) - m // 2 + 1:], chr(10)) END AS text
FROM ht LEFT JOIN tk USING (session_id)""")
def f29_bounded_transcript(spark, sf):
    spans = ranges.merge_ranges(_ranges(spark, sf), ["session_id"]).withColumn("lead", F.lit(False))
    return messages.bounded_transcript(A.prompts(spark, sf), spans, 900)


@query(f"""WITH {A.SQL_PROMPTS} SELECT session_id, turn, CASE WHEN noise THEN '' ELSE substr(text, 1, 30) END AS user, NOT noise AND length(text) > 30 AS cut, len(files)::INT AS n_files,
  array_to_string(list_filter(commands, lambda c: regexp_matches(c, '\\bgit\\s+(commit|push)\\b')), ';') AS commands FROM p""")
def f35_public_view(spark, sf):
    shown = messages.public_view(A.prompts(spark, sf), 30)
    return shown.select("session_id", "turn", "user", "cut", F.size("files").alias("n_files"), F.array_join("commands", ";").alias("commands"))


@query(f"WITH {_KEYED}, a AS (SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN 'key:' ELSE '' END || upper(event_type) || '-' || (k % 9) AS ref FROM e) SELECT ref, (SELECT min(unit) FROM mem WHERE unit = ref OR 'key:' || unit = ref) AS unit FROM a")
def f36_unit_reference(spark, sf):
    refs = A.event_rows(spark, sf).select(F.concat(F.when(F.col("event_id") % 3 == 0, "key:").otherwise(""), F.upper("event_type"), F.lit("-"), F.col("k") % 9).alias("ref")).distinct()
    known = _member(A.prompts(spark, sf)).select("unit").distinct()
    bare = refs.withColumn("bare", F.regexp_replace("ref", "^(?:key|branch):", ""))
    return bare.join(known, bare["bare"] == known["unit"], "left").select("ref", "unit")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT * 3 AS input_tokens, json_extract(props, '$.k')::BIGINT AS output_tokens, value AS cost_usd FROM events")
def f37_model_usage(spark, sf):
    said = F.to_json(F.struct(F.col("value").alias("total_cost_usd"), F.struct(F.col("k").alias("input_tokens"), (F.col("k") * 2).alias("cache_read_input_tokens"), F.col("k").alias("output_tokens")).alias("usage")))
    return A.event_rows(spark, sf).select("event_id", evidence.model_usage(said).alias("u")).select("event_id", "u.*")


@query(f"WITH {_TOK} SELECT session_id, turn, array_to_string(toks, ' ') AS toks FROM tk")
def f38_turn_tokens(spark, sf):
    return segments.turn_tokens(A.prompts(spark, sf)).withColumn("toks", F.array_join("toks", " "))


@query(r"""SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x0B]+', ' ', 'g'), ' ') AS line FROM documents""")
def f27_one_line(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.one_line("text").alias("line"))


# -- corrections: a log derived from the events


def _ops(spark, sf):
    rows = A.event_rows(spark, sf)
    unit = F.concat(F.upper("event_type"), F.lit("-"), F.col("k") % 5 + 1)
    kind = F.element_at(F.array(*map(F.lit, ("rename", "merge", "move", "hide", "split"))), (F.col("event_id") % 5 + 1).cast("int"))
    group = F.concat(F.lit("user:"), F.col("k") % 3)
    other = F.concat(F.lit("session:u"), F.col("user_id") + 28 * (F.col("k") % 3 - 1), F.regexp_extract("session_id", "-w.*", 0))
    target = F.when(F.col("k") % 5 == 0, group).when(F.col("k") % 5 < 3, other).otherwise(unit)
    null = lambda t: F.lit(None).cast(t)
    return rows.select(
        F.col("project").alias("workspace"), F.col("event_id").alias("seq"), F.concat(F.lit("op"), "event_id").alias("id"), F.concat(F.lit("b"), F.floor(F.col("event_id") / 3)).alias("batch"), _ts("ts").alias("ts"), kind.alias("type"),
        F.when(kind.isin("merge", "split"), group).when(kind.isin("rename", "hide"), unit).alias("unit"), F.when(kind == "move", F.col("session_id")).alias("session"), F.when(kind == "move", target).alias("to"),
        F.when(kind == "rename", F.concat(F.lit("name "), F.col("k") % 4)).alias("label"), F.when(kind == "hide", F.col("k") % 2 == 0).alias("hidden"), F.when(kind == "merge", F.array(unit)).alias("members"),
        null("array<struct<start:int,end:int,label:string>>").alias("parts"), null("string").alias("source"), (F.col("event_id") % 13 == 0).alias("undone"),
    )


_OPS = A.SQL_EVENTS + """, ops AS (SELECT project AS workspace, event_id AS seq, ['rename', 'merge', 'move', 'hide', 'split'][event_id % 5 + 1] AS type, upper(event_type) || '-' || (k % 5 + 1) AS u, 'user:' || (k % 3) AS g, session_id, 'name ' || (k % 4) AS label, k % 2 = 0 AS hidden,
  CASE WHEN k % 5 = 0 THEN 'user:' || (k % 3) WHEN k % 5 < 3 THEN 'session:u' || (user_id + 28 * (k % 3 - 1)) || regexp_extract(session_id, '-w.*') ELSE upper(event_type) || '-' || (k % 5 + 1) END AS t FROM e WHERE event_id % 13 <> 0),
ls AS (SELECT workspace, g, max(seq) AS split FROM ops WHERE type = 'split' GROUP BY 1, 2),
mv AS (SELECT workspace, session_id, t AS target, seq FROM ops m WHERE type = 'move' QUALIFY row_number() OVER (PARTITION BY workspace, session_id ORDER BY seq DESC) = 1
  AND NOT EXISTS (SELECT 1 FROM ls WHERE ls.workspace = m.workspace AND ls.g = m.t AND ls.split > m.seq))"""


@query(f"""WITH {_OPS} SELECT workspace, 'label' AS kind, u AS subject, arg_max(label, seq) AS target FROM ops WHERE type = 'rename' GROUP BY ALL
UNION ALL SELECT workspace, 'hidden_unit', u, NULL FROM ops WHERE type = 'hide' GROUP BY ALL HAVING arg_max(hidden, seq)
UNION ALL SELECT DISTINCT m.workspace, 'merge', g, u FROM ops m WHERE type = 'merge' AND NOT EXISTS (SELECT 1 FROM ops s WHERE s.workspace = m.workspace AND s.type = 'split' AND s.g = m.g AND s.seq > m.seq)
UNION ALL SELECT workspace, 'move', session_id, target FROM mv""")
def t9_fold(spark, sf):
    return corrections.fold(_ops(spark, sf)).where("kind in ('label', 'hidden_unit', 'merge', 'move')").select("workspace", "kind", "subject", "target")


@query(f"WITH {_KEYED} SELECT DISTINCT unit FROM mem WHERE unit NOT IN (SELECT upper(event_type) || '-' || (k % 5 + 1) AS u FROM e WHERE event_id % 13 <> 0 AND event_id % 5 = 3 GROUP BY 1 HAVING arg_max(k % 2 = 0, event_id))")
def p13_visible_units(spark, sf):
    ops = _ops(spark, sf).withColumn("workspace", F.lit("all"))
    last = ops.where("type = 'hide' and not undone").groupBy("unit").agg(F.max_by("hidden", "seq").alias("h")).where("h")
    return _member(A.prompts(spark, sf)).select("unit").distinct().join(last, "unit", "left_anti")


# -- streams, read once


@query(f"WITH {A.SQL_EVENTS} SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, project, count(*) AS n FROM e GROUP BY 1, 2")
def t5_stream_days(spark, sf):
    return _streamed(spark, sf, lambda rows: jobs.daily_prompts(rows), ["day", "project"]).withColumn("day", _day("day"))


@query("SELECT event_type AS action, count(*) AS calls, round(sum(value), 6) AS cost_usd FROM events GROUP BY 1")
def t7_stream_usage(spark, sf):
    return _streamed(spark, sf, lambda rows: jobs.running_usage(rows.selectExpr("event_type as action", "value as cost_usd")), ["action"]).withColumn("cost_usd", F.round("cost_usd", 6))


def _streamed(spark, sf, job, keys):
    """Run a stream over the events until it has read them all; each batch is a folder, the newest row of a key counts."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-stream-")
    out = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = A.table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/events.parquet*")
    rows = source.selectExpr("*", "concat('repo', user_id % 7) as project").withColumn("ts", F.col("ts").cast("timestamp"))
    sink = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/b{n}")
    run = job(rows).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    run.awaitTermination()
    done = spark.read.parquet(f"{out}/rows/*")
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return done.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r", "batch")
