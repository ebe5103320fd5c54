"""Queries of the session operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import files, ranges, search, segments, sessions, timeline
from ..sources import stages, textindex
from . import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


_TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
RE_SECRET = r"(eyJ[A-Za-z0-9_-]{15,}\.[A-Za-z0-9_-]{10,}|sk-[A-Za-z0-9_-]{16,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{12,}|xox[bap]-[A-Za-z0-9-]{10,})"
RE_ASSIGN = r"(?i)(?:password|passwd|secret|token|apikey|api_key)\s*[=:]\s*\S+"


def _redact(c: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({c}, ''), '{RE_SECRET}', '[REDACTED]', 'g'), '{RE_ASSIGN}', '[REDACTED]', 'g')"


# -- scalar functions over documents


@query(f"SELECT doc_id, md5({_redact('text')}) AS redacted_md5 FROM documents")
def f1_redact(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.md5(X.redact("text")).alias("redacted_md5"))


@query(f"""SELECT doc_id, (len(regexp_extract_all(coalesce(text, ''), '{RE_SECRET}')) +
  len(regexp_extract_all(regexp_replace(coalesce(text, ''), '{RE_SECRET}', '[REDACTED]', 'g'), '{RE_ASSIGN}')))::INT AS n FROM documents""")
def f2_count_redactions(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.count_redactions("text").alias("n"))


@query(f"WITH {A.SQL_PROMPTS} SELECT event_id, array_to_string(all_keys, ',') AS keys FROM p")
def f3_find_keys(spark, sf):
    return A.prompts(spark, sf).select("event_id", F.array_join("all_keys", ",").alias("keys"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '(?i)</?[a-z][\w:-]*(?:\s[^<>]*)?/?>', ' ', 'g'), '[\s\x0B]+', ' ', 'g'), ' ')) AS text_md5 FROM pages""")
def f4_strip_tags(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", F.md5(X.strip_tags("html")).alias("text_md5"))


@query(r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}][\p{L}\p{N}''’_-]*'), lambda w: regexp_matches(w, '\p{L}')))::INT AS n FROM documents""")
def f5_word_count(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.word_count("text").alias("n"))


@query(f"""WITH {A.SQL_PROMPTS} SELECT event_id, CASE WHEN noise OR text = 'hello there' THEN '' ELSE text END AS said FROM p""")
def f6_meaningful(spark, sf):
    return A.prompts(spark, sf).select("event_id", X.meaningful("text").alias("said"))


_LINE = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ')"


@query(rf"""WITH d AS (SELECT doc_id, {_LINE} AS t FROM documents), h AS (SELECT *, substr(t, 1, 79) AS head FROM d),
  s AS (SELECT *, length(head) - strpos(reverse(head), ' ') AS space FROM h)
SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE regexp_replace(CASE WHEN strpos(head, ' ') > 0 AND space >= 40 THEN substr(head, 1, space) ELSE head END, '[\s,;:.\-–—]+$', '') || '…' END AS title FROM s""")
def f7_cut_title(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.cut_title("text").alias("title"))


@query("SELECT doc_id, md5(lower(strip_accents(coalesce(text, '')))) AS folded_md5 FROM documents")
def f8_fold(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.md5(X.fold("text")).alias("folded_md5"))


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{L}\p{N}]+') AS w FROM documents)
SELECT doc_id, len(w)::INT AS n_words, len(list_distinct(w))::INT AS n_distinct, md5(array_to_string(w, ' ')) AS words_md5 FROM d""")
def f9_words(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.words("text").alias("w")).select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("words_md5"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(rf"""WITH d AS (SELECT doc_id, regexp_replace(lower(strip_accents(coalesce(text, ''))), 'https?://\S+|\b[0-9a-f]{{7,40}}\b|<[^>]{{0,80}}>', ' ', 'g') AS t FROM documents),
 w AS (SELECT doc_id, list_filter(regexp_extract_all(t, '[a-z][a-z0-9]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS w FROM d)
SELECT doc_id, len(w)::INT AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM w""")
def f10_tokens(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.tokens("text").alias("w")).select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


@query(f"""WITH {A.SQL_TOOLS} SELECT seq, CASE WHEN path LIKE '/tmp/%' THEN 'scratch,txt' ELSE 'dev,' || CASE WHEN cwd = '/home/dev/other' THEN 'other' ELSE 'repo' END || ',part,file' END AS toks FROM t WHERE kind = 'edit' AND path NOT LIKE '/tmp/%'""")
def f11_path_tokens(spark, sf):
    rows = A.tool_events(spark, sf).where("kind = 'edit' and path not like '/tmp/%'")
    return rows.select("seq", F.array_join(X.path_tokens("path"), ",").alias("toks"))


@query(f"WITH {A.SQL_TOOLS} SELECT seq, regexp_extract(path, '[^/]+$') AS base, substr(session_id, 1, 8) AS sid8 FROM t WHERE kind = 'edit'")
def f12_basename(spark, sf):
    return A.tool_events(spark, sf).where("kind = 'edit'").select("seq", X.basename("path").alias("base"), F.substring("session_id", 1, 8).alias("sid8"))


@query(f"""WITH {A.SQL_TOOLS} SELECT seq, CASE WHEN path LIKE '/tmp/%' THEN path ELSE substr(path, 11) END AS short FROM t WHERE kind = 'edit'""")
def f13_short_path(spark, sf):
    return A.tool_events(spark, sf).where("kind = 'edit'").select("seq", X.short_path("path", "cwd").alias("short"))


@query(r"""WITH d AS (SELECT doc_id, text, lower(strip_accents(coalesce(text, ''))) AS f FROM documents), a AS (SELECT *, strpos(f, 'ment') AS i FROM d)
SELECT doc_id, CASE WHEN i = 0 THEN '' ELSE regexp_replace(substr(text, (greatest(0, i - 51) + 1)::INT, (least(length(text), i - 1 + 110) - greatest(0, i - 51))::INT), '\s', ' ', 'g') END AS excerpt,
  i > 51 AS cut_before, i > 0 AND i - 1 + 110 < length(text) AS cut_after FROM a""")
def f14_snippet(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.snippet("text", F.array(F.lit("ment"))).alias("s")).select("doc_id", "s.*")


@query(f"""WITH {A.SQL_PROMPTS}, h AS (SELECT event_id, list_filter(range(0, length(text)), lambda i: substr(lower(text), (i + 1)::INT, 4) = 'area') AS hits FROM p)
SELECT event_id, array_to_string(list_transform(hits, lambda i: i || '-' || (i + 4)), ',') AS ranges FROM h""")
def f15_highlight(spark, sf):
    # "area" and "rea" overlap: one range
    rows = A.prompts(spark, sf).select("event_id", X.highlight_ranges(X.fold("text"), F.array(F.lit("area"), F.lit("rea"))).alias("r"))
    return rows.select("event_id", F.array_join(F.transform("r", lambda x: F.concat(x["s"], F.lit("-"), x["e"])), ",").alias("ranges"))


@query(f"""WITH {A.SQL_TOOLS} SELECT session_id, CASE kind WHEN 'commit' THEN 'commit' ELSE 'push' END AS kind, hash, count(*) AS n FROM t WHERE kind IN ('commit', 'push') GROUP BY ALL""")
def f16_commit_output(spark, sf):
    rows = A.tool_events(spark, sf).where("kind in ('commit', 'push')")
    said = F.when(F.col("kind") == "commit", F.concat(F.lit("ok\n["), "branch", F.lit(" "), "hash", F.lit("] "), "msg")).otherwise(F.concat(F.lit("to origin\r\n   0000000.."), "hash", F.lit("  main -> main")))
    return files.commit_output(rows.select("session_id", "source", "seq", "ts", said.alias("text"))).groupBy("session_id", "kind", "hash").agg(F.count("*").alias("n"))


@query(f"""WITH {A.SQL_TOOLS} SELECT seq, true AS revert, cmd LIKE 'git reset%' AS reset, cmd = 'git reset --hard' AS bulk FROM t WHERE kind = 'revert'""")
def f17_command_class(spark, sf):
    rows = A.tool_events(spark, sf).where("kind = 'revert'")
    return rows.select("seq", F.col("cmd").rlike(X.GIT_REVERT).alias("revert"), F.col("cmd").rlike(X.GIT_RESET).alias("reset"), F.col("cmd").rlike(X.GIT_REVERT_ALL).alias("bulk"))


@query(f"WITH {A.SQL_PROMPTS} SELECT event_id, NOT noise AND (text LIKE 'Now let''s%' OR text LIKE '(new task)%' OR text LIKE 'Ahora%') AS cue FROM p")
def f32_cue(spark, sf):
    rows = A.prompts(spark, sf)
    return segments.cue_scores(rows).join(rows.select("session_id", "turn", "event_id"), ["session_id", "turn"]).select("event_id", (F.col("cue") == 1).alias("cue"))


# -- sessions, keys, activity

_KEYED = A.SQL_PROMPTS + """,
bm AS (SELECT session_id, branch, count(*) AS n, min(turn) AS f FROM p WHERE branch <> '' GROUP BY ALL),
bk AS (SELECT session_id, arg_min(regexp_extract(branch, '\\b[A-Z][A-Z0-9]{1,9}-[0-9]{1,6}\\b'), (-n, f)) FILTER (regexp_matches(branch, '\\b[A-Z][A-Z0-9]{1,9}-[0-9]{1,6}\\b')) AS branch_key,
       arg_min(branch, (-n, f)) FILTER (branch NOT IN ('main', 'master', 'HEAD', 'develop', 'dev', '')) AS branch_name FROM bm GROUP BY 1),
ck AS (SELECT session_id, key, count(*) AS n, min(turn) AS f FROM (SELECT session_id, turn, unnest(all_keys) AS key FROM p) GROUP BY ALL),
tk AS (SELECT session_id, arg_min(key, (-n, f)) AS text_key FROM ck GROUP BY 1),
k AS (SELECT session_id, coalesce(branch_key, text_key, branch_name, 'unassigned') AS key,
      CASE WHEN branch_key IS NOT NULL THEN 'branch-regex' WHEN text_key IS NOT NULL THEN 'prompt-or-commit-regex' WHEN branch_name IS NOT NULL THEN 'branch-name' ELSE 'none' END AS method
      FROM (SELECT DISTINCT session_id FROM p) LEFT JOIN bk USING (session_id) LEFT JOIN tk USING (session_id)),
sk AS (SELECT session_id, key, count(*) AS mentions FROM (SELECT session_id, unnest(list_distinct(all_keys)) AS key FROM p) GROUP BY ALL),
mem AS (SELECT session_id, unit, CASE WHEN min(m) = 0 THEN 'main' ELSE 'mention' END AS mode FROM (
      SELECT session_id, CASE WHEN key = 'unassigned' THEN 'session:' || session_id ELSE key END AS unit, 0 AS m FROM k
      UNION ALL SELECT sk.session_id, sk.key, 1 FROM sk JOIN k USING (session_id) WHERE mentions >= 2 AND k.key <> 'unassigned') GROUP BY 1, 2),
sd AS (SELECT session_id, NULL::VARCHAR AS key, ts::DATE AS day, count(*) AS n FROM p GROUP BY ALL
      UNION ALL SELECT session_id, key, day, count(*) FROM (SELECT session_id, ts::DATE AS day, unnest(list_distinct(all_keys)) AS key FROM p) GROUP BY ALL),
pr AS (SELECT session_id, any_value(project) AS project, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_prompts, arg_min(text, turn) AS snippet FROM p GROUP BY 1),
act AS (SELECT unit, day, project, sum(n)::BIGINT AS n FROM (
      SELECT unit, day, project, n FROM mem JOIN sd USING (session_id) JOIN pr USING (session_id) WHERE mode = 'main' AND key IS NULL
      UNION ALL SELECT unit, day, project, n FROM mem JOIN sd USING (session_id) JOIN pr USING (session_id) WHERE mode = 'mention' AND key = unit) GROUP BY 1, 2, 3)"""


def _member(p: DataFrame) -> DataFrame:
    return sessions.members(sessions.detect_keys(p), sessions.session_keys(p))


def _activity(spark, sf) -> DataFrame:
    p = A.prompts(spark, sf)
    return sessions.activity(p, _member(p))


@query(f"WITH {_KEYED} SELECT session_id, branch, n, f AS first_place, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, f)::INT AS rank FROM bm")
def a1_most_common(spark, sf):
    return sessions.most_common(A.prompts(spark, sf).where("branch <> ''"), ["session_id"], "branch", "turn")


@query(f"WITH {_KEYED} SELECT session_id, key, method FROM k")
def a2_detect_key(spark, sf):
    return sessions.detect_keys(A.prompts(spark, sf))


@query(f"WITH {_KEYED} SELECT session_id, key, mentions FROM sk")
def a3_key_mentions(spark, sf):
    return sessions.session_keys(A.prompts(spark, sf))


@query(f"WITH {_KEYED} SELECT session_id, {_TS.format('first_ts')} AS first_ts, {_TS.format('last_ts')} AS last_ts, n_prompts, (SELECT arg_min(cwd, turn) FROM p WHERE p.session_id = pr.session_id) AS cwd FROM pr")
def a4_session_summary(spark, sf):
    p = A.prompts(spark, sf)
    return p.groupBy("session_id").agg(_ts(F.min("ts")).alias("first_ts"), _ts(F.max("ts")).alias("last_ts"), F.count("*").alias("n_prompts"), F.min_by("cwd", "turn").alias("cwd"))


@query(f"WITH {_KEYED} SELECT session_id, key, strftime(day, '%Y-%m-%d') AS day, n FROM sd")
def a5_prompt_days(spark, sf):
    return sessions.days(A.prompts(spark, sf)).withColumn("day", _day("day"))


@query(f"WITH {_KEYED} SELECT unit, strftime(day, '%Y-%m-%d') AS day, project, n FROM act")
def a6_activity(spark, sf):
    return _activity(spark, sf).withColumn("day", _day("day"))


@query(f"""WITH {_KEYED} SELECT unit, count(*) AS sessions, array_to_string(list_sort(list_distinct(list(project))), ',') AS projects, {_TS.format('min(first_ts)')} AS first_ts,
 {_TS.format('max(last_ts)')} AS last_ts, sum(n_prompts)::BIGINT AS prompts, md5(array_to_string(list_sort(list(session_id)), ',')) AS ids_md5, arg_min(snippet, (first_ts, session_id)) AS snippet FROM mem JOIN pr USING (session_id) GROUP BY 1""")
def a7_unit_rollup(spark, sf):
    p = A.prompts(spark, sf)
    r = sessions.unit_rollup(p, _member(p))
    return r.select("unit", "sessions", F.array_join("projects", ",").alias("projects"), _ts("first_ts").alias("first_ts"), _ts("last_ts").alias("last_ts"), "prompts", F.md5(F.array_join("session_ids", ",")).alias("ids_md5"), "snippet")


@query(f"WITH {_KEYED} SELECT session_id, unit, mode FROM mem")
def j3_members(spark, sf):
    return _member(A.prompts(spark, sf))


@query(f"WITH {_KEYED} SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY first_ts, session_id)::INT AS place, session_id, {_TS.format('first_ts')} AS first_ts FROM mem JOIN pr USING (session_id)")
def o10_session_lists(spark, sf):
    p = A.prompts(spark, sf)
    return sessions.session_list(p, _member(p)).withColumn("first_ts", _ts("first_ts"))


@query(f"WITH {_KEYED} SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY day, project)::INT AS place, strftime(day, '%Y-%m-%d') AS day, project, n FROM act")
def o10_activity_order(spark, sf):
    return sessions.activity_order(_activity(spark, sf)).withColumn("day", _day("day"))


@query(f"""WITH {_KEYED}, own AS (SELECT session_id, unit FROM mem WHERE unit LIKE 'session:%'), pt AS (SELECT DISTINCT p.project, unit, epoch_us(ts) AS us FROM p JOIN own USING (session_id)),
 pairs AS (SELECT a.unit, b.unit AS other, min(abs(a.us - b.us)) AS gap FROM pt a JOIN pt b ON a.project = b.project AND a.unit <> b.unit AND abs(a.us - b.us) <= 7200000000 GROUP BY 1, 2)
 SELECT unit, other, gap / 1e6 AS gap_s, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY gap, other) AS r FROM pairs) WHERE r <= 2""")
def j12_related(spark, sf):
    p = A.prompts(spark, sf)
    return sessions.related(p, _member(p))


_CAPS = "caps AS (SELECT unit, min(first_ts) + (max(last_ts) - min(first_ts)) / 2 AS since FROM mem JOIN pr USING (session_id) GROUP BY 1)"


def _capsules(p, member):
    per = p.groupBy("session_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    span = member.join(per, "session_id").groupBy("unit").agg(F.unix_micros(F.min("first_ts")).alias("a"), F.unix_micros(F.max("last_ts")).alias("b"))
    return span.select("unit", F.timestamp_micros(F.col("a") + F.floor((F.col("b") - F.col("a")) / 2)).alias("since"))


_FRESH = """rows AS (SELECT unit, session_id, ts FROM mem JOIN p USING (session_id) WHERE mode = 'main' AND NOT noise
 UNION ALL SELECT unit, session_id, ts FROM mem JOIN p USING (session_id) WHERE mode = 'mention' AND NOT noise AND list_contains(keys, unit)),
 caps AS (SELECT unit, make_timestamp(epoch_us(min(first_ts)) + (epoch_us(max(last_ts)) - epoch_us(min(first_ts))) // 2) AS since FROM mem JOIN pr USING (session_id) GROUP BY 1),
 per AS (SELECT unit, session_id, count(*) FILTER (ts > since) AS new, count(*) AS total FROM rows JOIN caps USING (unit) GROUP BY ALL)"""


@query(f"WITH {_KEYED}, {_FRESH} SELECT unit, sum(new)::BIGINT AS new_messages, count(*) FILTER (new = total AND new > 0) AS new_sessions FROM per GROUP BY 1")
def j13_staleness(spark, sf):
    p = stages.written(A.prompts(spark, sf), "prompts")
    m = _member(p)
    return sessions.staleness(p, m, _capsules(p, m))


@query(f"""WITH {_KEYED}, a AS (SELECT DISTINCT substr(md5(session_id), 1, 9) AS sid FROM pr), n AS (SELECT sid, count(*) OVER (PARTITION BY substr(sid, 1, 8)) AS c FROM a)
SELECT sid AS session_id, CASE WHEN c = 1 THEN substr(sid, 1, 8) ELSE sid END AS short_id FROM n""")
def w14_short_ids(spark, sf):
    p = A.prompts(spark, sf).select(F.substring(F.md5("session_id"), 1, 9).alias("session_id"))
    return sessions.short_ids(p)


@query(f"WITH {A.SQL_MESSAGES}, n AS (SELECT *, sum(is_prompt::INT) OVER (PARTITION BY session_id ORDER BY line_no) - 1 AS turn FROM m) SELECT session_id, line_no, role, turn::BIGINT AS turn FROM n")
def w1_turn_numbers(spark, sf):
    return sessions.turn_numbers(A.messages(spark, sf)).select("session_id", "line_no", "role", "turn")


@query(f"""WITH {A.SQL_MESSAGES}, n AS (SELECT *, sum(is_prompt::INT) OVER (PARTITION BY session_id ORDER BY line_no) - 1 AS turn FROM m)
SELECT session_id, turn::BIGINT AS turn, max(text) FILTER (is_prompt) AS text, coalesce(md5(string_agg(text, '|' ORDER BY line_no) FILTER (NOT is_prompt)), md5('')) AS replies_md5 FROM n WHERE turn >= 0 GROUP BY 1, 2""")
def j1_attach_assistant(spark, sf):
    return sessions.attach_assistant(A.messages(spark, sf)).select("session_id", "turn", "text", F.md5(F.array_join("assistant", "|")).alias("replies_md5"))


# -- timeline

_LANES = _KEYED + """, rp AS (SELECT unit, project, sum(n) AS pn FROM act GROUP BY 1, 2), mp AS (SELECT unit, arg_min(project, (-pn, project)) AS main_project FROM rp GROUP BY 1),
lane AS (SELECT unit, sum(n)::BIGINT AS prompts, count(DISTINCT day) AS active_days, min(day) AS first_day, max(day) AS last_day, array_to_string(list_sort(list_distinct(list(project))), ',') AS projects, max(n) AS max_cell, any_value(main_project) AS main_project FROM act JOIN mp USING (unit) GROUP BY 1)"""
_LANE_COLS = "unit, prompts, active_days, strftime(first_day, '%Y-%m-%d') AS first_day, strftime(last_day, '%Y-%m-%d') AS last_day, projects, max_cell, main_project"


def _lane_view(lane: DataFrame) -> DataFrame:
    return lane.select("unit", "prompts", "active_days", _day("first_day").alias("first_day"), _day("last_day").alias("last_day"), F.array_join("projects", ",").alias("projects"), "max_cell", "main_project")


@query(f"WITH {_LANES} SELECT {_LANE_COLS} FROM lane")
def a25_lanes(spark, sf):
    return _lane_view(timeline.lanes(_activity(spark, sf)))


@query(f"WITH {_LANES} SELECT unit, main_project FROM lane")
def a18_main_repo(spark, sf):
    return timeline.lanes(_activity(spark, sf)).select("unit", "main_project")


@query(f"WITH {_LANES} SELECT {_LANE_COLS} FROM (SELECT * FROM lane ORDER BY last_day DESC, unit LIMIT 12)")
def o2_timeline(spark, sf):
    return _lane_view(timeline.newest(timeline.lanes(_activity(spark, sf))))


@query(f"WITH {_KEYED} SELECT unit, strftime(day, '%Y-%m-%d') AS day, project, n FROM act WHERE project = 'repo3' AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def p11_filter_cells(spark, sf):
    return timeline.filter_cells(_activity(spark, sf), "repo3", "2024-01-20", "2024-01-05").withColumn("day", _day("day"))


@query(f"WITH {_KEYED}, r AS (SELECT DISTINCT project FROM act) SELECT project, CASE WHEN row_number() OVER (ORDER BY project) <= 3 THEN row_number() OVER (ORDER BY project) - 1 ELSE -1 END::INT AS slot FROM r")
def f21_colour_slots(spark, sf):
    return timeline.colour_slots(_activity(spark, sf)).withColumn("slot", F.col("slot").cast("int"))


_SPAN = "sp AS (SELECT min(day) AS a, greatest(max(day), min(day) + 13) AS b, greatest(max(n), 1) AS mx FROM act)"


@query(f"""WITH {_KEYED}, {_SPAN} SELECT unit, strftime(day, '%Y-%m-%d') AS day, project, n, round((date_diff('day', a, day) + 0.5) / (date_diff('day', a, b) + 1) * 100, 2) AS x,
 (CASE WHEN mx <= 1 OR n <= 1 THEN 8 ELSE floor(8 + 8 * sqrt((n - 1) / (mx - 1)) + 0.5) END)::INT AS size FROM act, sp""")
def f20_marks(spark, sf):
    return timeline.marks(_activity(spark, sf)).withColumn("day", _day("day"))


@query(f"""WITH {_KEYED}, {_SPAN}, w AS (SELECT a, b, date_diff('day', a, b) + 1 AS w FROM sp), st AS (SELECT *, coalesce(list_filter([1, 2, 7, 14, 30, 60, 90, 180, 365], lambda s: ceil(w / s) <= 8)[1], 365) AS step FROM w)
SELECT strftime(a + d::INT, '%Y-%m-%d') AS day, round((d + 0.5) / w * 100, 2) AS x FROM (SELECT a, w, unnest(range(0, w, step)) AS d FROM st)""")
def f19_ticks(spark, sf):
    return timeline.ticks(timeline.span(_activity(spark, sf))).withColumn("day", _day("day"))


@query("""WITH d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m') || '-31' WHEN 2 THEN '2024-1-5' ELSE '2024-02-30' END AS s FROM events)
SELECT event_id, strftime(try_cast(CASE WHEN regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN s END AS DATE), '%Y-%m-%d') AS day FROM d""")
def f18_valid_day(spark, sf):
    text = F.when(F.col("event_id") % 4 == 0, _day("ts")).when(F.col("event_id") % 4 == 1, F.concat(F.date_format("ts", "yyyy-MM"), F.lit("-31"))).when(F.col("event_id") % 4 == 2, "2024-1-5").otherwise("2024-02-30")
    return A.table(spark, sf, "events").select("event_id", text.alias("s")).select("event_id", _day(X.valid_day("s")).alias("day"))


@query(f"""WITH {_KEYED}, {_FRESH}, u AS (SELECT unit, sum(new) > 0 AS stale FROM per GROUP BY 1), h AS (SELECT unit, ('0x' || substr(md5(unit), 1, 4))::INT % 3 = 0 AS has FROM u)
SELECT count(*) FILTER (has) AS ready, count(*) AS total, count(*) FILTER (has AND stale) AS outdated, 0::BIGINT AS empty FROM u JOIN h USING (unit)""")
def a17_coverage(spark, sf):
    p = A.prompts(spark, sf)
    m = _member(p)
    stale = sessions.staleness(p, m, _capsules(p, m))
    has = F.conv(F.substring(F.md5("unit"), 1, 4), 16, 10).cast("int") % 3 == 0
    return timeline.coverage(stale.select(F.lit(True).alias("generatable"), F.lit(False).alias("noise"), has.alias("has_capsule"), (F.col("new_messages") > 0).alias("outdated")))


# -- message search

_POST = A.SQL_MESSAGES + rf""",
w AS (SELECT session_id, line_no, list_filter(regexp_extract_all(lower(strip_accents({_redact('text')})), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) <= 40) AS w FROM m),
post AS (SELECT session_id, line_no, len, term, count(*) AS tf FROM (SELECT session_id, line_no, len(w) AS len, unnest(w) AS term FROM w) GROUP BY ALL),
docs AS (SELECT DISTINCT session_id, line_no, len FROM post), st AS (SELECT count(*) AS n, avg(len) AS a FROM docs)"""
_KEYS = ["session_id", "line_no"]


def _postings(spark, sf):
    return search.postings(A.messages(spark, sf), _KEYS)


#: All roles, and texts that are noise where the turn is a multiple of three.
_SAID = """all_m AS (SELECT conv_id AS session_id, turn AS line_no, role, CASE WHEN turn % 9 = 3 THEN '[Request interrupted by user] ' || coalesce(text, '') WHEN turn % 9 = 6 THEN '<bash-input>' || coalesce(text, '') ELSE text END AS text FROM conversations)"""


@query(f"""WITH {_SAID} SELECT session_id, line_no FROM all_m WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> '' AND NOT (role = 'user' AND (starts_with(text, '[Request interrupted') OR starts_with(text, '<bash-')))""")
def p9_searchable(spark, sf):
    c = A.table(spark, sf, "conversations")
    text = F.when(F.col("turn") % 9 == 3, F.concat(F.lit("[Request interrupted by user] "), X.nn("text"))).when(F.col("turn") % 9 == 6, F.concat(F.lit("<bash-input>"), X.nn("text"))).otherwise(F.col("text"))
    return search.searchable(c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line_no"), "role", text.alias("text"))).select("session_id", "line_no")


@query(f"WITH {_POST} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM post GROUP BY 1")
def a11_vocabulary(spark, sf):
    return _postings(spark, sf).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"WITH {_POST} SELECT n AS n_docs, a AS avg_len FROM st")
def a29_index_statistics(spark, sf):
    return search.statistics(A.messages(spark, sf))


def _bm25_sql(words: list[str]) -> str:
    hits = " UNION ALL ".join(f"SELECT session_id, line_no, len, {i} AS word, sum(tf) AS tf FROM post WHERE contains(term, '{w}') GROUP BY 1, 2, 3" for i, w in enumerate(words))
    return f"""hit AS ({hits}), dfs AS (SELECT word, count(*) AS df FROM hit GROUP BY 1),
 sc AS (SELECT session_id, line_no, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM hit JOIN dfs USING (word), st GROUP BY 1, 2 HAVING count(*) = {len(words)})"""


@query(f"WITH {_POST}, {_bm25_sql(['ing', 'the'])} SELECT session_id, line_no, round(score, 6) AS score FROM sc")
def a12_bm25(spark, sf):
    m = A.messages(spark, sf)
    return search.bm25(search.postings(m, _KEYS), _KEYS, ["the", "ing"], search.statistics(m)).withColumn("score", F.round("score", 6))


def _manifest(m: DataFrame) -> DataFrame:
    return m.groupBy("session_id").agg(F.sum(F.length("text")).alias("size"), F.lit(0).alias("mtime"))


def _found(m: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with the ids of the table."""
    kinds = dict(m.dtypes)
    return hits.select(*[F.col(c).cast(kinds[c]).alias(c) for c in _KEYS], F.round("score", 6).alias("score"))


@query(f"WITH {_POST}, {_bm25_sql(['ing', 'the'])} SELECT session_id, line_no, round(score, 6) AS score FROM sc")
def s9_stored_search(spark, sf):
    """The search of a12 over a stored index."""
    m, at = A.messages(spark, sf), stages.folder(spark, "text-index")
    textindex.create(m, _manifest(m), at)
    return _found(m, textindex.bm25(spark, at, ["the", "ing"]))


@query(f"WITH {_POST}, {_bm25_sql(['ing', 'the'])} SELECT session_id, line_no, round(score, 6) AS score FROM sc")
def u6_index_upkeep(spark, sf):
    """The same, after an index of an earlier state (sessions missing, shorter, other, gone since) was brought up to date and compacted."""
    own = A.messages(spark, sf)
    m, at, to = own.withColumn("session_id", F.col("session_id").cast("string")), stages.folder(spark, "text-index"), stages.folder(spark, "text-index")
    kind = F.pmod(F.xxhash64("session_id"), F.lit(5))
    gone = m.where(kind == 1).withColumn("session_id", F.concat("session_id", F.lit("-gone")))
    was = m.where((kind != 2) & ~((kind == 3) & (F.col("line_no") > 2))).withColumn("text", F.when(kind == 4, F.concat("text", F.lit(" nothing the king"))).otherwise(F.col("text"))).unionByName(gone)
    textindex.create(was, _manifest(was), at)
    textindex.update(m, _manifest(m), at)
    textindex.compact(spark, at, to)
    return _found(own, textindex.bm25(spark, to, ["the", "ing"]))


@query(f"WITH {_POST}, {_bm25_sql(['ing'])}, r AS (SELECT session_id, line_no, row_number() OVER (ORDER BY round(score, 9) DESC, session_id, line_no) AS rank FROM sc) SELECT session_id, line_no, rank::INT AS rank FROM r WHERE rank <= 100")
def o3_top_hits(spark, sf):
    return _top(spark, sf)


def _top(spark, sf):
    from pyspark.sql import Window

    m = A.messages(spark, sf)
    scored = search.bm25(search.postings(m, _KEYS), _KEYS, ["ing"], search.statistics(m)).withColumn("s", F.round("score", 9))
    best = search.ranked(scored, [F.desc("s"), "session_id", "line_no"], search.POOL)  # a report of at most 100 hits
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "session_id", "line_no"))).select("session_id", "line_no", "rank")


@query(f"""WITH {_POST}, {_bm25_sql(['ing'])}, r AS (SELECT session_id, line_no, row_number() OVER (ORDER BY round(score, 9) DESC, session_id, line_no) AS rank FROM sc QUALIFY rank <= 100),
 i AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank) <= 3 AS fits FROM r), g AS (SELECT *, fits AND sum(fits::INT) OVER (ORDER BY rank) <= 20 AS vis FROM i),
 x AS (SELECT *, max(CASE WHEN vis THEN rank END) OVER (PARTITION BY session_id) AS last, count(*) FILTER (NOT vis) OVER (PARTITION BY session_id) AS left_out FROM g)
 SELECT session_id, line_no, rank::INT AS rank, CASE WHEN rank = last THEN left_out ELSE 0 END AS more FROM x WHERE vis""")
def w12_cap_hits(spark, sf):
    return search.cap_hits(_top(spark, sf))


@query(f"WITH {A.SQL_MESSAGES} SELECT session_id, line_no FROM m WHERE contains(lower(strip_accents(text)), 'ment') AND contains(lower(strip_accents(text)), 'que')")
def p12_literal_search(spark, sf):
    return A.messages(spark, sf).where(search.contains_all("text", ["ment", "que"])).select("session_id", "line_no")


@query("""WITH d AS (SELECT doc_id, lower(strip_accents(coalesce(source, ''))) AS head, lower(strip_accents(coalesce(text, ''))) AS body, greatest(1, length(coalesce(source, '')) + length(coalesce(text, ''))) AS len FROM documents),
 s AS (SELECT count(*) AS n, avg(len) AS a, count(*) FILTER (contains(head, 'src') OR contains(body, 'src')) AS d0, count(*) FILTER (contains(head, 'ment') OR contains(body, 'ment')) AS d1 FROM d),
 t AS (SELECT *, 3 * ((length(head) - length(replace(head, 'src', ''))) // 3) + 3.0 * ((length(body) - length(replace(body, 'src', ''))) // 3) AS t0,
   3 * ((length(head) - length(replace(head, 'ment', ''))) // 4) + 3.0 * ((length(body) - length(replace(body, 'ment', ''))) // 4) AS t1 FROM d, s WHERE (contains(head, 'src') OR contains(body, 'src')) AND (contains(head, 'ment') OR contains(body, 'ment')))
 SELECT doc_id AS doc, round(ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * len / a)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * len / a)), 3) AS score FROM t""")
def a13_field_bm25(spark, sf):
    section = F.array(F.struct(F.lit("objective").alias("id"), F.lit(3.0).alias("weight"), X.nn("text").alias("text")))
    docs = A.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), X.nn("source").alias("head"), section.alias("sections"))
    return search.field_bm25(docs, ["src", "ment"]).select("doc", "score")


_CUTS = (("objective", 3.0, 1, 300), ("decisions", 2.0, 301, 500), ("pending", 1.5, 801, 400), ("briefing", 0.5, 1201, 1_000_000_000))
_SECTIONS = "struct_pack(" + "), struct_pack(".join(f"id := '{i}', weight := {w}, t := lower(strip_accents(substr(coalesce(text, ''), {a}, {n})))" for i, w, a, n in _CUTS) + ")"
_TF = lambda i, w: f"(3 * ((length(head) - length(replace(head, '{w}', ''))) // {len(w)}) + list_sum(list_transform(secs, lambda s: s.weight * ((length(s.t) - length(replace(s.t, '{w}', ''))) // {len(w)}))))::DOUBLE AS t{i}"
_HAS = lambda w: f"(contains(head, '{w}') OR len(list_filter(secs, lambda s: contains(s.t, '{w}'))) > 0)"


@query(f"""WITH d AS (SELECT doc_id, lower(strip_accents(coalesce(source, ''))) AS head, [{_SECTIONS}] AS secs, greatest(1, length(coalesce(source, '')) + length(coalesce(text, ''))) AS len FROM documents),
 s AS (SELECT count(*) AS n, avg(len) AS a, count(*) FILTER ({_HAS('src1')}) AS d0, count(*) FILTER ({_HAS('en')}) AS d1 FROM d),
 t AS (SELECT *, {_TF(0, 'src1')}, {_TF(1, 'en')} FROM d, s WHERE {_HAS('src1')} AND {_HAS('en')}),
 r AS (SELECT doc_id AS doc, round(ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * len / a)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * len / a)), 3) AS score,
   list_transform(list_sort(list_transform(list_filter(secs, lambda s: contains(s.t, 'src1') OR contains(s.t, 'en')), lambda s: struct_pack(f := -(contains(s.t, 'src1')::INT + contains(s.t, 'en')::INT), w := -s.weight, id := s.id)))[1:3], lambda s: s.id) AS ss FROM t)
 SELECT doc, score, coalesce(ss[1], '') AS best, array_to_string(ss, ',') AS sections, row_number() OVER (ORDER BY score DESC, doc)::INT AS place FROM r QUALIFY place <= 100""")
def a14_best_sections(spark, sf):
    """Hits of written records in order, with the sections that hold most of the query words."""
    parts = [F.struct(F.lit(i).alias("id"), F.lit(w).alias("weight"), F.substring(X.nn("text"), a, n).alias("text")) for i, w, a, n in _CUTS]
    docs = A.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), X.nn("source").alias("head"), F.array(*parts).alias("sections"))
    hits = search.record_hits(search.field_bm25(docs, ["src1", "en"]), search.POOL)
    return hits.select("doc", "score", F.coalesce(F.get("sections", F.lit(0)), F.lit("")).alias("best"), F.array_join("sections", ",").alias("sections"), "place")


# -- topic boundaries


@query(f"""WITH {A.SQL_PROMPTS}, g AS (SELECT session_id, turn, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY turn))) / 3.6e9 AS g FROM p)
SELECT session_id, turn, round(CASE WHEN g > 0 THEN least(1.0, log2(1 + g) / log2(49)) ELSE 0.0 END, 9) AS time FROM g""")
def w3_time_gap(spark, sf):
    return segments.time_scores(A.prompts(spark, sf)).withColumn("time", F.round("time", 9))


@query(f"""WITH {A.SQL_PROMPTS}, g AS (SELECT *, lag(cwd) OVER w AS pc, lag(branch) OVER w AS pb FROM p WINDOW w AS (PARTITION BY session_id ORDER BY turn))
SELECT session_id, turn, CASE WHEN pc <> cwd THEN 1.0::DOUBLE WHEN pb <> branch AND pb <> 'HEAD' AND branch <> 'HEAD' THEN 0.5 ELSE 0.0 END AS ctx FROM g""")
def w4_context(spark, sf):
    return segments.context_scores(A.prompts(spark, sf))


@query(f"""WITH {A.SQL_PROMPTS}, kd AS (SELECT session_id, turn, keys, flatten(list(keys) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) AS seen FROM p WHERE NOT compaction AND len(keys) > 0)
SELECT p.session_id, p.turn, CASE WHEN kd.turn IS NULL THEN 0.0 WHEN coalesce(len(seen), 0) = 0 THEN 0.6 WHEN list_has_any(kd.keys, seen) THEN 0.0 ELSE 1.0 END::DOUBLE AS key FROM p LEFT JOIN kd ON p.session_id = kd.session_id AND p.turn = kd.turn""")
def w5_new_key(spark, sf):
    return segments.key_scores(A.prompts(spark, sf))


_TOK = A.SQL_PROMPTS + rf""",
tk AS (SELECT session_id, turn, CASE WHEN noise THEN [] ELSE list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,}}'), lambda x: x NOT IN ({_STOP})) END ||
   CASE WHEN len(files) = 0 THEN []::VARCHAR[] ELSE ['dev', CASE WHEN cwd LIKE '%other' THEN 'other' ELSE 'repo' END, 'part', 'file'] END AS toks FROM p),
nn AS (SELECT session_id, count(*) AS n FROM tk GROUP BY 1), tf AS (SELECT session_id, turn, term, count(*) AS tf FROM (SELECT session_id, turn, unnest(toks) AS term FROM tk) GROUP BY ALL),
df AS (SELECT session_id, term, count(*) AS df FROM tf GROUP BY ALL),
tw AS (SELECT session_id, turn, term, (1 + ln(tf)) * ln((1 + n) / (1 + df)) AS weight FROM tf JOIN df USING (session_id, term) JOIN nn USING (session_id))"""


@query(f"WITH {_TOK} SELECT session_id, turn, term, round(weight, 9) AS weight FROM tw")
def a15_tfidf(spark, sf):
    return segments.tfidf(segments.turn_tokens(A.prompts(spark, sf))).withColumn("weight", F.round("weight", 9))


_SHIFT = _TOK + """, b AS (SELECT session_id, i::INT AS turn FROM (SELECT session_id, n, unnest(range(2, n - 1)) AS i FROM nn)),
va AS (SELECT b.session_id, b.turn, term, sum(weight) AS w FROM b JOIN tw ON tw.session_id = b.session_id AND tw.turn BETWEEN b.turn - 5 AND b.turn - 1 GROUP BY ALL),
vb AS (SELECT b.session_id, b.turn, term, sum(weight) AS w FROM b JOIN tw ON tw.session_id = b.session_id AND tw.turn BETWEEN b.turn AND b.turn + 4 GROUP BY ALL),
na AS (SELECT session_id, turn, sum(w * w) AS s FROM va GROUP BY ALL), nb AS (SELECT session_id, turn, sum(w * w) AS s FROM vb GROUP BY ALL),
dt AS (SELECT va.session_id, va.turn, sum(va.w * vb.w) AS d FROM va JOIN vb USING (session_id, turn, term) GROUP BY ALL),
raw AS (SELECT na.session_id, na.turn, 1 - coalesce(d, 0) / sqrt(na.s * nb.s) AS raw FROM na JOIN nb USING (session_id, turn) LEFT JOIN dt USING (session_id, turn) WHERE na.s > 0 AND nb.s > 0)"""


@query(f"WITH {_SHIFT} SELECT session_id, turn, round(raw, 7) + 0.0 AS raw FROM raw")
def w6_topic_shift(spark, sf):
    return segments.raw_shift(A.prompts(spark, sf)).withColumn("raw", F.round("raw", 7) + F.lit(0.0))


@query(f"""WITH {_SHIFT}, z AS (SELECT session_id, turn, CASE WHEN count(raw) OVER w < 3 THEN 0.0 ELSE greatest(0.0, least(1.0, (raw - avg(raw) OVER w) / (2 * CASE WHEN stddev_pop(raw) OVER w = 0 THEN 1.0 ELSE stddev_pop(raw) OVER w END))) END AS s FROM (SELECT session_id, turn, round(raw, 9) AS raw FROM raw) WINDOW w AS (PARTITION BY session_id))
SELECT p.session_id, p.turn, round(coalesce(s, 0.0), 5) AS shift FROM p LEFT JOIN z USING (session_id, turn)""")
def w7_z_normalised(spark, sf):
    return segments.shift_scores(A.prompts(spark, sf)).withColumn("shift", F.round("shift", 5))


_SCORE = _SHIFT + """, gp AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS g, lag(cwd) OVER w AS pc, lag(branch) OVER w AS pb FROM p WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
kd AS (SELECT session_id, turn, keys, flatten(list(keys) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) AS seen FROM p WHERE NOT compaction AND len(keys) > 0),
zs AS (SELECT session_id, turn, CASE WHEN count(raw) OVER w < 3 THEN 0.0 ELSE greatest(0.0, least(1.0, (raw - avg(raw) OVER w) / (2 * CASE WHEN stddev_pop(raw) OVER w = 0 THEN 1.0 ELSE stddev_pop(raw) OVER w END))) END AS s FROM (SELECT session_id, turn, round(raw, 9) AS raw FROM raw) WINDOW w AS (PARTITION BY session_id)),
bs AS (SELECT gp.session_id, gp.turn, CASE WHEN g > 0 THEN least(1.0, log2(1 + g) / log2(49)) ELSE 0.0 END AS time,
  CASE WHEN kd.turn IS NULL THEN 0.0 WHEN coalesce(len(seen), 0) = 0 THEN 0.6 WHEN list_has_any(kd.keys, seen) THEN 0.0 ELSE 1.0 END::DOUBLE AS key, coalesce(s, 0.0) AS shift,
  CASE WHEN pc <> cwd THEN 1.0 WHEN pb <> branch AND pb <> 'HEAD' AND branch <> 'HEAD' THEN 0.5 ELSE 0.0 END::DOUBLE AS ctx, CASE WHEN NOT noise AND (text LIKE 'Now let''s%' OR text LIKE '(new task)%' OR text LIKE 'Ahora%') THEN 1.0 ELSE 0.0 END::DOUBLE AS cue
  FROM gp LEFT JOIN kd ON kd.session_id = gp.session_id AND kd.turn = gp.turn LEFT JOIN zs ON zs.session_id = gp.session_id AND zs.turn = gp.turn),
sc AS (SELECT *, 0.15 * time + 0.9 * key + 0.9 * shift + 0.25 * ctx + 0.3 * cue AS score FROM bs)"""


@query(f"WITH {_SCORE} SELECT session_id, turn, round(time, 5) AS time, key, round(shift, 5) AS shift, ctx, cue, round(score, 5) AS score FROM sc")
def w8_boundary_score(spark, sf):
    scores = segments.boundary_scores(A.prompts(spark, sf))
    return scores.withColumns({c: F.round(c, 5) for c in ("time", "shift", "score")})


#: Turns in the order of their scores; each joins those taken before it if none of them is nearer than four turns.
_TAKEN = "WITH RECURSIVE " + _SCORE + """, cd AS (SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, turn) AS r FROM sc WHERE turn >= 1 AND round(score, 9) >= 0.3),
gr AS (SELECT session_id, 0::BIGINT AS r, []::INT[] AS taken FROM cd WHERE r = 1 UNION ALL SELECT gr.session_id, cd.r, CASE WHEN len(list_filter(taken, lambda x: abs(x - cd.turn) < 4)) = 0 THEN list_append(taken, cd.turn) ELSE taken END
  FROM gr JOIN cd ON cd.session_id = gr.session_id AND cd.r = gr.r + 1),
bd AS (SELECT session_id, unnest(arg_max(taken, r)) AS turn FROM gr GROUP BY 1)"""


def _boundaries(prompts):
    """Boundaries of scores rounded to nine digits, so that sums in another order choose alike."""
    return segments.pick(segments.boundary_scores(prompts).withColumn("score", F.round("score", 9)), 0.3)


@query(f"{_TAKEN} SELECT session_id, turn FROM bd")
def w9_boundaries(spark, sf):
    return _boundaries(A.prompts(spark, sf))


_LABELS = _TAKEN + """, sg AS (SELECT p.*, count(bd.turn) OVER (PARTITION BY p.session_id ORDER BY p.turn)::INT AS segment FROM p LEFT JOIN bd ON bd.session_id = p.session_id AND bd.turn = p.turn),
ks AS (SELECT session_id, segment, key, count(*) AS n, min(turn) AS f FROM (SELECT session_id, segment, turn, unnest(keys) AS key FROM sg WHERE NOT compaction) GROUP BY ALL),
kl AS (SELECT session_id, segment, list(key ORDER BY n DESC, f) AS keys FROM ks GROUP BY ALL),
ws AS (SELECT session_id, segment, term, round(sum(weight), 9) AS w FROM tw JOIN sg USING (session_id, turn) GROUP BY ALL), wl AS (SELECT session_id, segment, list(term ORDER BY w DESC, term) AS terms FROM ws GROUP BY ALL),
sb AS (SELECT session_id, segment, min(turn) AS start, max(turn) AS "end", min(ts) AS first_ts, arg_min(substr(text, 1, 90), turn) AS snippet FROM sg GROUP BY ALL)"""


@query(f"""{_LABELS} SELECT session_id, segment, start, "end", keys[1] AS key, coalesce(array_to_string(keys[1:3], ','), '') AS keys, coalesce(array_to_string(terms[1:4], ','), '') AS terms, strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS first_ts, snippet
FROM sb LEFT JOIN kl USING (session_id, segment) LEFT JOIN wl USING (session_id, segment)""")
def a16_segment_labels(spark, sf):
    p = A.prompts(spark, sf)
    out = segments.labels(p, _boundaries(p))
    return out.withColumns({"keys": F.array_join("keys", ","), "terms": F.array_join("terms", ","), "first_ts": F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss")})


# -- ranges and windows

_RANGES = A.SQL_PROMPTS + ", rg AS (SELECT session_id, turn AS start, turn + event_id % 3 AS \"end\" FROM p WHERE turn % 4 = 0 OR len(keys) > 0)"


def _ranges(spark, sf):
    rows = A.prompts(spark, sf).where((F.col("turn") % 4 == 0) | (F.size("keys") > 0))
    return rows.select("session_id", F.col("turn").alias("start"), (F.col("turn") + F.col("event_id") % 3).cast("int").alias("end"))


_MERGED = _RANGES + """, mk AS (SELECT *, max("end") OVER (PARTITION BY session_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM rg),
il AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM mk),
mr AS (SELECT session_id, min(start)::INT AS start, max("end")::INT AS "end" FROM il GROUP BY session_id, i)"""


@query(f'WITH {_MERGED} SELECT session_id, start, "end" FROM mr')
def w10_merge_ranges(spark, sf):
    return ranges.merge_ranges(_ranges(spark, sf), ["session_id"])


@query(f"""WITH {_MERGED}, l AS (SELECT *, coalesce(max("end") OVER (PARTITION BY session_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS b FROM mr)
SELECT session_id, greatest(start - 4, b + 1)::INT AS start, (start - 1)::INT AS "end" FROM l WHERE greatest(start - 4, b + 1) < start""")
def w11_lead_ranges(spark, sf):
    return ranges.lead_ranges(ranges.merge_ranges(_ranges(spark, sf), ["session_id"]), ["session_id"])


@query(f"""WITH {_RANGES}, sz AS (SELECT session_id, max(turn) AS n FROM p GROUP BY 1), cl AS (SELECT session_id, greatest(0, start - 1) AS start, least(n - 1, "end") AS "end" FROM rg JOIN sz USING (session_id)), ok AS (SELECT * FROM cl WHERE start <= "end"),
mk AS (SELECT *, max("end") OVER (PARTITION BY session_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ok),
il AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start, "end" RANGE UNBOUNDED PRECEDING) AS i FROM mk)
SELECT session_id, min(start)::INT AS start, max("end")::INT AS "end" FROM il GROUP BY session_id, i""")
def f25_clamp_ranges(spark, sf):
    p = A.prompts(spark, sf)
    sizes = p.groupBy("session_id").agg(F.max("turn").alias("n"))
    return ranges.clamp(_ranges(spark, sf).withColumn("start", (F.col("start") - 1).cast("string")), sizes, ["session_id"])


@query(f'WITH {_MERGED} SELECT session_id, sum("end" - start + 1)::BIGINT AS turns, count(*) AS ranges FROM mr GROUP BY 1')
def a31_plan_size(spark, sf):
    return ranges.plan_size(ranges.merge_ranges(_ranges(spark, sf), ["session_id"]), ["session_id"])


_WIN = _MERGED + """, tt AS (SELECT session_id, turn, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS s FROM p),
win AS (SELECT mr.session_id, a.s AS start_ts, coalesce(b.s, '9999') AS end_ts FROM mr JOIN tt a ON a.session_id = mr.session_id AND a.turn = mr.start LEFT JOIN tt b ON b.session_id = mr.session_id AND b.turn = mr."end" + 1)"""


def _windows(spark, sf):
    p = A.prompts(spark, sf).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return ranges.windows(ranges.merge_ranges(_ranges(spark, sf), ["session_id"]), p, ["session_id"])


@query(f"WITH {_WIN} SELECT session_id, start_ts, end_ts FROM win")
def w2_windows(spark, sf):
    return _windows(spark, sf)




@query(f"WITH {_WIN}, t AS ({A.SQL_TOOLS.split('t AS (', 1)[1]} SELECT seq FROM t WHERE EXISTS (SELECT 1 FROM win WHERE win.session_id = t.session_id AND start_ts <= t.ts AND t.ts < end_ts)")
def j4_in_windows(spark, sf):
    return files.in_windows(A.tool_events(spark, sf), _windows(spark, sf)).select("seq")


# -- files and commits

_EDITS = A.SQL_TOOLS + ", ed AS (SELECT session_id, path, count(*) AS edits, max(ts) AS last, arg_max(source, (ts, seq)) AS source, arg_min(cwd, (ts, seq)) AS cwd FROM t WHERE kind = 'edit' AND path NOT LIKE '/tmp/%' GROUP BY 1, 2)"
_STATUS = _EDITS + """, hit AS (SELECT ed.session_id, ed.path, max(r.ts) AS revert_ts FROM ed JOIN t r ON r.session_id = ed.session_id AND r.kind = 'revert' AND r.ts > ed.last
  WHERE (r.cmd LIKE 'git checkout%' AND ends_with(ed.path, '/' || substr(r.cmd, 17))) OR (r.cmd = 'git reset --hard' AND r.source = ed.source) GROUP BY 1, 2),
fs AS (SELECT ed.session_id, ed.path, substr(ed.path, 11) AS short, edits, CASE WHEN revert_ts IS NULL THEN 'final' ELSE 'reverted' END AS status, last, revert_ts FROM ed LEFT JOIN hit USING (session_id, path))"""


@query(f"WITH {A.SQL_TOOLS} SELECT seq, path NOT LIKE '/tmp/%' AS work FROM t WHERE kind = 'edit'")
def p5_work_files(spark, sf):
    return A.tool_events(spark, sf).where("kind = 'edit'").select("seq", X.is_work_file("path").alias("work"))


@query(f"WITH {_EDITS} SELECT session_id, path, edits, last, source, cwd FROM ed")
def a8_session_edits(spark, sf):
    return files.edits(A.tool_events(spark, sf)).select("session_id", "path", "edits", "last", "source", "cwd")


@query(f"WITH {_STATUS} SELECT session_id, path, short, edits, status, last, revert_ts FROM fs")
def j5_reverted_files(spark, sf):
    return files.file_status(A.tool_events(spark, sf))


@query(f"WITH {_STATUS} SELECT short, sum(edits)::BIGINT AS edits, arg_max(status, (last, session_id, path)) AS status, max(last) AS last FROM fs GROUP BY 1")
def a9_merge_files(spark, sf):
    return files.merge_files(files.file_status(A.tool_events(spark, sf)), [])


@query(f"WITH {_STATUS} SELECT session_id, status, short, row_number() OVER (PARTITION BY session_id ORDER BY (status <> 'final')::INT, short)::INT AS place FROM fs")
def o5_file_order(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("session_id").orderBy((F.col("status") != "final").cast("int"), "short")
    return files.file_status(A.tool_events(spark, sf)).select("session_id", "status", "short", F.row_number().over(order).alias("place"))


_COMMITS = A.SQL_TOOLS + """, fc AS (SELECT * FROM t WHERE kind = 'commit' QUALIFY row_number() OVER (PARTITION BY session_id, hash ORDER BY ts, seq) = 1),
cm AS (SELECT session_id, hash, branch, msg, source, ts, EXISTS (SELECT 1 FROM t q WHERE q.session_id = fc.session_id AND q.kind = 'push' AND starts_with(q.hash, fc.hash)) AS pushed,
  EXISTS (SELECT 1 FROM t r WHERE r.session_id = fc.session_id AND r.kind = 'revert' AND r.ts > fc.ts AND r.cmd LIKE 'git reset%' AND ((r.source = fc.source AND fc.source <> 'main') OR contains(r.cmd, fc.hash))) AS undone,
  contains(lower(msg || ' ' || branch), 'purchase-2') AS confirmed FROM fc)"""


@query(f"WITH {_COMMITS} SELECT session_id, hash, branch, msg, source, ts, pushed, undone, confirmed FROM cm")
def a26_commits(spark, sf):
    return files.commits(A.tool_events(spark, sf), key=F.lit("PURCHASE-2"))


@query(f"WITH {_COMMITS} SELECT session_id, hash FROM cm WHERE pushed")
def j7_pushed(spark, sf):
    return files.commits(A.tool_events(spark, sf)).where("pushed").select("session_id", "hash")


@query(f"WITH {_COMMITS} SELECT session_id, hash FROM cm WHERE undone")
def j6_undone(spark, sf):
    return files.commits(A.tool_events(spark, sf)).where("undone").select("session_id", "hash")


_LINKS = _KEYED + """, cit AS (SELECT session_id, unit, min(turn) AS from_turn FROM (SELECT session_id, turn, unnest(keys) AS unit FROM p) GROUP BY ALL),
fl AS (SELECT session_id, turn, ts, unnest(files) AS path FROM p WHERE len(files) > 0),
lk AS (SELECT substr(path, 11) AS short, unit, count(*) AS edits, max(ts) AS last, CASE WHEN bool_or(mode = 'main') THEN 'session' ELSE 'mention' END AS basis
  FROM fl JOIN mem USING (session_id) LEFT JOIN cit USING (session_id, unit) WHERE mode = 'main' OR turn >= from_turn GROUP BY 1, 2)"""


@query(f"WITH {_LINKS} SELECT short, unit, edits, {_TS.format('last')} AS last, basis FROM lk")
def a10_file_links(spark, sf):
    p = A.prompts(spark, sf)
    return files.session_links(p, _member(p)).withColumn("last", _ts("last"))


@query(f"WITH {_LINKS} SELECT short, count(DISTINCT unit) AS units FROM lk GROUP BY 1 ORDER BY units DESC, short LIMIT 40")
def o6_shared_files(spark, sf):
    p = A.prompts(spark, sf)
    return files.shared_files(files.session_links(p, _member(p)))


@query(f"""WITH {_LINKS}, cap AS (SELECT short, unit, edits, basis FROM lk WHERE ('0x' || substr(md5(unit), 1, 4))::INT % 3 = 0)
SELECT short, unit, edits, basis, false AS approximate FROM cap UNION ALL SELECT short, unit, edits, basis, true FROM lk WHERE unit NOT IN (SELECT unit FROM cap)""")
def j17_capsule_files(spark, sf):
    p = A.prompts(spark, sf)
    links = files.session_links(p, _member(p)).drop("last")
    has = F.conv(F.substring(F.md5("unit"), 1, 4), 16, 10).cast("int") % 3 == 0
    return files.file_links(links.where(has), links)


def queries() -> dict[str, Query]:
    from . import queries_checks, queries_records, queries_turns  # noqa: F401  they add their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)
