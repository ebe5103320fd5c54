"""Queries of checked answers, proposals, command and path forms and written records over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import organize
from ..sources import records
from . import adapters as A
from .queries import _redact, query
from .queries_turns import _PROPOSALS, _proposals, _quarter

# -- forms of commands and paths

_FORMS = (
    "git checkout -- src/a.js", "git reset --hard", "git reset abc1234", "git stash", "git stash pop", "git stash list", "git stash  drop", "git stash save x", "git clean -fd",
    "git restore .", "git restore --staged .", "git restore --staged a.js", "git checkout .", "git checkout -- .", "git checkout main", "rm -rf build", "ls;rm x", "echo rmdir",
    "npm run rm-cache", "git log --oneline", "git  push origin main", "git -C /x commit -m y", "git commit --amend", "git merge dev", "git rm a.txt", "digit reset", "git switch dev", "git cherry-pick a1", "git-lfs push", "git\tcommit -m t",
)
_ENDS = ("", " && echo done", "; ls")
_CMD = f"element_at(array({', '.join(repr(x) for x in _FORMS)}), cast(event_id % {len(_FORMS)} + 1 as int)) || element_at(array({', '.join(repr(x) for x in _ENDS)}), cast(k % 3 + 1 as int))"
_SQL_CMD = A.SQL_EVENTS + ", c AS (SELECT event_id, [" + ", ".join("'" + x.replace("\t", "' || chr(9) || '") + "'" for x in _FORMS) + f"][event_id % {len(_FORMS)} + 1] || [" + ", ".join(f"'{x}'" for x in _ENDS) + "][k % 3 + 1] AS cmd FROM e)"


@query(rf"""WITH {_SQL_CMD}, w AS (SELECT event_id, cmd, string_split_regex(cmd, '[ \t]+') AS ws FROM c)
SELECT event_id, ws[1] = 'git' AND ws[2] IN ('commit', 'push', 'checkout', 'switch', 'merge', 'rebase', 'cherry-pick') AS work,
  ws[1] = 'git' AND (ws[2] IN ('commit', 'push') OR ws[2] = '-C' AND ws[4] IN ('commit', 'push')) AS publish,
  ws[1] = 'git' AND rtrim(ws[2], ';') IN ('checkout', 'restore', 'reset', 'stash', 'clean', 'rm') OR starts_with(cmd, 'rm ') OR contains(cmd, ';rm ') AS revert,
  ws[1] = 'git' AND ws[2] = 'reset' AS reset,
  ws[1] = 'git' AND (ws[2] = 'checkout' AND (ws[3] = '.' OR ws[3] = '--' AND ws[4] = '.') OR ws[2] = 'restore' AND (ws[3] = '.' OR ws[3] = '--staged' AND ws[4] = '.') OR ws[2] = 'reset' AND starts_with(ws[3], '--hard')
    OR ws[2] = 'clean' OR rtrim(ws[2], ';') = 'stash' AND coalesce(rtrim(ws[3], ';'), '') NOT IN ('pop', 'apply', 'list', 'show', 'drop')) AS bulk FROM w""")
def f17_command_forms(spark, sf):
    rows = A.event_rows(spark, sf).select("event_id", F.expr(_CMD).alias("cmd"))
    is_a = lambda p: F.col("cmd").rlike(p)
    return rows.select("event_id", is_a(X.GIT_WORK).alias("work"), is_a(X.GIT_PUBLISH).alias("publish"), is_a(X.GIT_REVERT).alias("revert"), is_a(X.GIT_RESET).alias("reset"), is_a(X.GIT_REVERT_ALL).alias("bulk"))


_PATHS = ("/home/dev/ShopFront/lib/HTTPServer2Handler.test.js", "C:/Work/myProject/FooBar_baz-qux.py", "/srv/api/OAuthTOKENStore/getURLFor.tsx", "docs/ADR-012_useCache.md", "/a/bb/ccc/dddEEEFff", "x.y.z", "/var/Data/JSONtoCSV99converter.rb", "/opt/Café/naïveBayes.go", "README", "/src/index.js")
_WORDS = ", ".join(f"'{w}'" for w in X.PATH_WORDS)


@query(rf"""WITH {A.SQL_EVENTS}, c AS (SELECT event_id, [{', '.join(f"'{x}'" for x in _PATHS)}][event_id % {len(_PATHS)} + 1] || '/' || event_type || 'Part' || k AS path FROM e),
s AS (SELECT event_id, list_transform(regexp_split_to_array(path, '[/\\._-]'), lambda p: regexp_replace(p, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')) AS parts FROM c),
w AS (SELECT event_id, list_transform(flatten(list_transform(parts, lambda p: regexp_extract_all(p, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'))), lambda x: lower(x)) AS ws FROM s)
SELECT event_id, array_to_string(list_filter(ws, lambda x: length(x) > 2 AND x NOT IN ({_WORDS})), ',') AS toks FROM w""")
def f11_path_forms(spark, sf):
    form = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("event_id") % len(_PATHS) + 1).cast("int"))
    path = F.concat(form, F.lit("/"), "event_type", F.lit("Part"), "k")
    return A.event_rows(spark, sf).select("event_id", F.array_join(X.path_tokens(path), ",").alias("toks"))


# -- checked answers


_GROUPS = A.SQL_PROMPTS + """, gr AS (SELECT 'b' || (event_id // 240) AS batch, event_id AS pos, CASE WHEN k % 7 = 0 THEN ' ab ' ELSE 'group ' || k END AS title,
  list_transform([0, 7, 14, 0], lambda d: 'u' || (user_id + d) || regexp_extract(session_id, '-w.*')) AS members, k % 4 AS turn FROM e WHERE event_id % 6 = 0),
sh AS (SELECT session_id, turn FROM p WHERE NOT noise),
bk AS (SELECT batch, pos, list(DISTINCT m) AS own FROM (SELECT batch, pos, turn, unnest(members) AS m FROM gr WHERE length(trim(title)) >= 3) x JOIN sh ON sh.session_id = x.m AND sh.turn = x.turn GROUP BY 1, 2),
nm AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY pos) AS i FROM bk),
go AS (SELECT batch, 0::BIGINT AS i, NULL::BIGINT AS pos, []::VARCHAR[] AS free, []::VARCHAR[] AS taken FROM nm GROUP BY 1
  UNION ALL SELECT go.batch, nm.i, nm.pos, list_filter(nm.own, lambda x: NOT list_contains(go.taken, x)),
    CASE WHEN len(list_filter(nm.own, lambda x: NOT list_contains(go.taken, x))) >= 2 THEN list_concat(go.taken, nm.own) ELSE go.taken END FROM go JOIN nm ON nm.batch = go.batch AND nm.i = go.i + 1)"""


@query(f"""WITH RECURSIVE {_GROUPS} SELECT batch, pos, array_to_string(list_sort(free), ',') AS members FROM go WHERE len(free) >= 2""")
def v1_checked_groups(spark, sf):
    e = A.event_rows(spark, sf).where("event_id % 6 = 0")
    week = F.regexp_extract("session_id", "-w.*", 0)
    who = F.array(*[F.concat(F.lit("u"), F.col("user_id") + d, week) for d in (0, 7, 14, 0)])
    title = F.when(F.col("k") % 7 == 0, " ab ").otherwise(F.concat(F.lit("group "), "k"))
    said = e.select(F.concat(F.lit("b"), F.floor(F.col("event_id") / 240)).alias("batch"), F.col("event_id").cast("int").alias("pos"), title.alias("title"), who.alias("members"), F.transform(who, lambda m: F.struct(m.alias("session_id"), (F.col("k") % 4).alias("turn"))).alias("evidence"))
    found = organize.check_groups(said, A.prompts(spark, sf).where("not noise"))
    return found.select("batch", F.col("pos").cast("long").alias("pos"), F.array_join(F.array_sort("members"), ",").alias("members"))


@query(f"""WITH {A.SQL_PROMPTS}, sz AS (SELECT session_id, count(*) AS n FROM p GROUP BY 1), pt AS (SELECT session_id, turn AS a, turn + k % 3 AS b, CASE WHEN k % 5 = 0 THEN 'no' ELSE 'part ' || k END AS title, turn + k % 4 AS ev FROM p JOIN e USING (session_id, event_id) WHERE event_id % 3 = 0),
ok AS (SELECT DISTINCT pt.session_id, a, b FROM pt JOIN sz USING (session_id) JOIN p ON p.session_id = pt.session_id AND p.turn = pt.ev WHERE n >= 8 AND b < n AND length(title) >= 3 AND ev BETWEEN a AND b AND NOT noise),
cl AS (SELECT session_id, a <= lag(b) OVER (PARTITION BY session_id ORDER BY a, b) AS clash FROM ok), per AS (SELECT session_id, count(*) AS parts, bool_or(coalesce(clash, false)) AS clash FROM cl GROUP BY 1)
SELECT s.session_id, coalesce(parts >= 2 AND NOT clash, false) AS ok, coalesce(parts, 0) AS parts FROM (SELECT DISTINCT session_id FROM pt) s LEFT JOIN per USING (session_id)""")
def v2_checked_splits(spark, sf):
    p = A.prompts(spark, sf)
    k = A.event_rows(spark, sf).select("event_id", "k")
    title = F.when(F.col("k") % 5 == 0, "no").otherwise(F.concat(F.lit("part "), "k"))
    parts = p.where("event_id % 3 = 0").join(k, "event_id").select("session_id", F.col("turn").alias("start"), (F.col("turn") + F.col("k") % 3).alias("end"), title.alias("title"), F.array(F.col("turn") + F.col("k") % 4).alias("evidence"))
    sizes = p.groupBy("session_id").agg(F.count("*").alias("n")).withColumn("long", F.col("n") >= 8)
    return organize.check_splits(parts, p.where("not noise"), sizes)


@query(f"""WITH {A.SQL_PROMPTS}, cu AS (SELECT session_id, arg_min(text, turn) AS current FROM p GROUP BY 1), t AS (SELECT session_id, event_id AS pos, CASE k % 3 WHEN 0 THEN 'ok' WHEN 1 THEN upper(text) || '!' ELSE 'Look at area ' || k END AS title FROM p JOIN e USING (session_id, event_id)),
g AS (SELECT t.* FROM t JOIN cu USING (session_id) WHERE ('0x' || substr(md5(session_id), 1, 2))::INT % 4 <> 0 AND length(trim(title)) >= 3
  AND trim(lower(regexp_replace(title, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) <> trim(lower(regexp_replace(current, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))))
SELECT session_id, arg_min(title, pos) AS title FROM g GROUP BY 1 HAVING length(arg_min(title, pos)) <= 80""")
def v3_checked_titles(spark, sf):
    p = A.prompts(spark, sf)
    current = p.groupBy("session_id").agg(F.min_by("text", "turn").alias("current"))
    title = F.when(F.col("k") % 3 == 0, "ok").when(F.col("k") % 3 == 1, F.concat(F.upper("text"), F.lit("!"))).otherwise(F.concat(F.lit("Look at area "), "k"))
    said = p.join(A.event_rows(spark, sf).select("event_id", "k"), "event_id").select("session_id", F.col("event_id").alias("pos"), title.alias("title"))
    found = organize.check_titles(said, current, current.where(_quarter("session_id") == 0))
    return found.where(F.length("title") <= 80)


# -- proposals


@query(f"""WITH {_PROPOSALS} SELECT id, batch, row_number() OVER (PARTITION BY batch ORDER BY CASE type WHEN 'group' THEN 0 WHEN 'split' THEN 1 ELSE 2 END, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, id)::INT AS place FROM ev""")
def o11_proposal_order(spark, sf):
    return organize.placed(_proposals(spark, sf), ["batch"]).select("id", "batch", "place")


@query(f"""WITH {_PROPOSALS}, o AS (SELECT id, status, sessions FROM ev), nw AS (SELECT CASE WHEN k % 2 = 0 THEN id ELSE id || '-new' END AS id, sessions FROM ev WHERE k % 3 = 0), an AS (SELECT DISTINCT unnest(sessions) AS session_id FROM nw),
ab AS (SELECT DISTINCT id FROM (SELECT id, unnest(sessions) AS session_id FROM o WHERE status = 'pending') JOIN an USING (session_id)),
kp AS (SELECT * FROM o WHERE id NOT IN (SELECT id FROM ab) AND NOT (status = 'rejected' AND id IN (SELECT id FROM nw WHERE ('0x' || substr(md5(id), 1, 2))::INT % 4 = 0)))
SELECT id, status FROM kp UNION ALL SELECT DISTINCT id, 'pending' FROM nw WHERE id NOT IN (SELECT id FROM kp)""")
def t8_proposal_life(spark, sf):
    old = _proposals(spark, sf).join(A.event_rows(spark, sf).select(F.concat(F.lit("pr"), "event_id").alias("id"), "k"), "id")
    new = old.where("k % 3 = 0").withColumn("id", F.when(F.col("k") % 2 == 0, F.col("id")).otherwise(F.concat("id", F.lit("-new"))))
    analysed = new.select(F.explode("sessions").alias("session_id")).distinct()
    cols = ["id", "status", "sessions"]
    return organize.upsert(old.select(cols), new.select(cols), analysed, new.where(_quarter("id") == 0).select("id")).select("id", "status")


# -- written records


_MADE = """r AS (SELECT doc_id, 'DOC-' || doc_id AS key, substr(coalesce(text, ''), 1, 60) AS objective, substr(coalesce(text, ''), 61, 40) AS d1, CASE WHEN doc_id % 2 = 0 THEN '' ELSE substr(coalesce(text, ''), 101, 30) END AS why, substr(coalesce(text, ''), 131, 25) AS pending,
  'src/' || coalesce(source, 'x') || '.py' AS short, substr(md5(doc_id::VARCHAR), 1, 7) AS hash, doc_id % 3 AS q FROM documents)"""


def _records(spark, sf):
    t = X.nn("text")
    cite = F.array(F.struct(F.lit("s1").alias("session"), F.col("doc_id").cast("string").alias("turn")))
    made = F.struct(F.substring(t, 61, 40).alias("decision"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.substring(t, 101, 30)).alias("why"), F.lit(False).alias("uncertain"), cite.alias("cites"))
    q = F.col("doc_id") % 3
    item = F.struct(F.substring(t, 131, 25).alias("text"), cite.alias("cites"))
    commit = F.struct(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 7).alias("hash"), F.lit("main").alias("branch"), F.lit("do it").alias("msg"), F.lit("main").alias("source"), F.lit("2026").alias("ts"), (q == 1).alias("pushed"), (q == 2).alias("undone"))
    none = F.array().cast("array<struct<text:string,cites:array<struct<session:string,turn:string>>>>")
    capsule = F.struct(F.substring(t, 1, 60).alias("objective"), F.lit("one\ntwo").alias("briefing"), F.array(F.struct(F.lit("2026-01-02").alias("date"), F.lit("repo").alias("repo"), F.lit("done").alias("result"), cite.alias("cites"))).alias("timeline"), F.when(q == 0, F.array(made, made)).otherwise(F.array(made)).alias("decisions"), none.alias("dead_ends"), none.alias("left_out"), F.array(item).alias("pending"))
    file = F.struct(F.concat(F.lit("src/"), F.coalesce("source", F.lit("x")), F.lit(".py")).alias("short"), q.cast("long").alias("edits"), F.lit("final").alias("status"), F.lit("2026").alias("last"))
    rows = A.table(spark, sf, "documents").select(F.concat(F.lit("DOC-"), "doc_id").alias("key"), F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), F.col("doc_id").cast("int")), "yyyy-MM-dd").alias("generated_at"), capsule.alias("capsule"), F.array(file).alias("files"), F.struct(F.array(commit).alias("confirmed"), F.array(commit).alias("possible")).alias("commits"))
    kinds = spark.createDataFrame([], records.RECORD).schema
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields])


@query(f"""WITH {_MADE}, d AS (SELECT *, d1 || CASE WHEN why <> '' THEN ' — ' || why ELSE '' END AS line, short || ' (final)' AS file, hash || ' main do it' AS c FROM r),
s AS (SELECT key, unnest([struct_pack(id := 'objective', text := objective), struct_pack(id := 'briefing', text := 'one' || chr(10) || 'two'), struct_pack(id := 'decisions', text := CASE WHEN line = '' THEN '' WHEN q = 0 THEN line || chr(10) || line ELSE line END), struct_pack(id := 'files', text := file),
  struct_pack(id := 'commits', text := c || chr(10) || c), struct_pack(id := 'pending', text := pending), struct_pack(id := 'timeline', text := '2026-01-02 repo done')]) AS s FROM d)
SELECT key, s.id AS id, md5(s.text) AS text_md5 FROM s WHERE trim(s.text, ' ') <> ''""")
def f22_record_sections(spark, sf):
    return records.sections(_records(spark, sf)).select("key", F.explode("sections").alias("s")).select("key", "s.id", F.md5("s.text").alias("text_md5"))


@query(rf"""WITH {_MADE}, l AS (SELECT key, doc_id, key || ' | ' || objective || ' | ' || CASE WHEN q = 0 THEN d1 || '; ' || d1 ELSE d1 END AS line FROM r ORDER BY doc_id DESC, key LIMIT 300)
SELECT key, substr(trim(regexp_replace({_redact('line')}, '[\s\x0B]+', ' ', 'g'), ' '), 1, 420) AS line FROM l""")
def a24_catalog(spark, sf):
    return records.catalog(_records(spark, sf))


@query(f"""WITH {_MADE}, n AS (SELECT chr(10) AS n), d AS (SELECT r.*, n, '`s1:' || doc_id || '`' AS cite, CASE WHEN why = '' THEN 'no reason given' ELSE why END AS y, '- `' || hash || '` do it' || CASE q WHEN 1 THEN ' (pushed)' WHEN 2 THEN ' (possibly undone)' ELSE '' END AS c FROM r, n),
m AS (SELECT key, '# Record of ' || key || n || n || '## Objective' || n || CASE WHEN objective = '' THEN '_(none)_' ELSE objective END || n || n || '## Timeline' || n || '| 2026-01-02 | repo | done | ' || cite || ' |'
  || n || n || '## Decisions' || n || '- **' || d1 || '** — ' || y || ' ' || cite || CASE WHEN q = 0 THEN n || '- **' || d1 || '** — ' || y || ' ' || cite ELSE '' END || n || n || '## Files' || n || '- `' || short || '` (' || q || 'x, final)'
  || n || n || '## Commits' || n || c || n || n || '## Dead ends' || n || '_(none)_' || n || n || '## Left out' || n || '_(none)_' || n || n || '## Pending' || n || '- ' || pending || ' ' || cite || n || n || '## Briefing' || n || '> one' || n || '> two' AS text FROM d)
SELECT key, md5(text) AS text_md5 FROM m""")
def f30_markdown(spark, sf):
    return records.markdown(_records(spark, sf)).select("key", F.md5("markdown").alias("text_md5"))


@query(f"WITH {_MADE} SELECT key, objective FROM r")
def s11_exported(spark, sf):
    """Written as JSON and read back."""
    from ..sources.stages import folder

    at = folder(spark, "export")
    records.export_units(_records(spark, sf).select("key", F.col("capsule.objective").alias("objective")), at)
    return spark.read.schema("key string, objective string").json(at)

