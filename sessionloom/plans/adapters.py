"""The driver's tables as transcript tables.

`events` become prompts and tool events: a session is a user's week, a project the user's
repo, and the number in `props` picks the text, keys, files and hashes. `conversations`
become messages. Everything is derived from the rows, so it grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.stages import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_K = "cast(get_json_object(props, '$.k') as int)"


_EVENT = (
    "event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value", f"{_K} as k",
    "concat('u', user_id, '-w', cast(floor(datediff(cast(ts as date), date'2024-01-01') / 7) as int)) as session_id",
)
_PLACE = (
    "concat('repo', user_id % 7) as project",
    "case user_id % 4 when 0 then concat('feature/area-', user_id % 10) when 1 then concat('fix/TASK-', user_id % 10, '-x') else 'main' end as branch",
    "concat('/home/dev/', case when k % 19 = 0 then 'other' else concat('repo', user_id % 7) end) as cwd",
)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, project, branch, cwd, k and the fields of each event."""
    return table(spark, sf_dir, "events").selectExpr(*_EVENT).selectExpr("*", *_PLACE)


_TEXT = """case when k % 41 = 0 then '[Request interrupted by user]'
     when k % 29 = 0 then concat('This session is being continued from TASK-', k % 5)
     when k % 23 = 0 then 'hello there'
     when k % 17 = 0 then concat(element_at(array("Now let's look at", 'Now let us look at', '(new task) report', 'Ahora mira', 'Back to'), k % 5 + 1), ' the totals of area ', k)
     when event_type in ('error', 'purchase') and user_id % 4 <> 3 then concat(upper(event_type), '-', k % 5 + 1, ' please look into value ', k)
     else concat('Review the ', event_type, ' numbers of area ', k % 9, ' and report back') end"""


_COMMANDS = """case event_type when 'purchase' then case when k % 2 = 0 then array(concat('git commit -m "area ', k, '"'), 'npm test', concat('git push origin ', branch))
     else array('npm test', 'ls -la') end
     when 'signup' then array(concat('git checkout ', branch), case when k % 3 = 0 then 'git push origin HEAD' else 'git status' end)
     when 'error' then array('git reset --hard') else array() end"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, project, turn, ts, text, branch, cwd, noise, compaction, keys, files, commands, key list without noise."""
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    rows = dealt(event_rows(spark, sf_dir).withColumn("text", F.expr(_TEXT)), "session_id")
    keys = X.find_keys("text")
    edited = F.when((F.col("event_type") == "click") & (F.col("k") % 10 != 0), F.array(F.concat("cwd", F.lit("/src/part"), F.col("k") % 6, F.lit("/file"), F.col("k") % 12, F.lit(".js"))))
    return rows.select(
        "session_id", "project", (F.row_number().over(order) - 1).alias("turn"), "ts", "event_id", "text", "branch", "cwd", "value",
        X.is_noise("text").alias("noise"), X.is_compaction("text").alias("compaction"), keys.alias("all_keys"),
        F.when(X.is_noise("text"), F.array().cast("array<string>")).otherwise(F.array_distinct(keys)).alias("keys"),
        F.coalesce(edited, F.array().cast("array<string>")).alias("files"), F.expr(_COMMANDS).cast("array<string>").alias("commands"),
    )


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits, reverts, commits and pushes: session_id, source, seq, ts (ISO string), kind, path, cwd, cmd, hash, branch, msg."""
    return event_rows(spark, sf_dir).where("event_type <> 'view'").selectExpr(
        "session_id", "project", "case when user_id % 5 = 0 then concat('agent-', k % 2) else 'main' end as source", "event_id as seq",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") as ts",
        "case event_type when 'click' then 'edit' when 'error' then 'revert' when 'purchase' then 'commit' else 'push' end as kind",
        "case when event_type = 'click' then case when k % 10 = 0 then concat('/tmp/scratch', k, '.txt') else concat(cwd, '/src/part', k % 6, '/file', k % 12, '.js') end end as path",
        "cwd",
        """case when event_type = 'error' then case k % 3 when 0 then concat('git checkout -- src/part', k % 6, '/file', k % 12, '.js')
             when 1 then 'git reset --hard' else concat('git reset ', substr(md5(concat(session_id, '-', k % 8)), 1, 7)) end end as cmd""",
        "case event_type when 'purchase' then substr(md5(concat(session_id, '-', k % 8)), 1, 7) when 'signup' then substr(md5(concat(session_id, '-', k % 8)), 1, 9) end as hash",
        "branch", "case when event_type = 'purchase' then case when k % 2 = 0 then concat('PURCHASE-', k % 5 + 1, ': do it') else 'tidy up' end end as msg",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, line_no, role, text, is_prompt of the conversations' users and assistants."""
    return table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line_no"), "role", X.nn("text").alias("text"), (F.col("role") == "user").alias("is_prompt"))


#: The same tables in DuckDB SQL, to be put before the SQL of a query.
SQL_EVENTS = """
e AS (SELECT event_id, ts, user_id, event_type, value, json_extract(props, '$.k')::INT AS k,
        'u' || user_id || '-w' || (date_diff('day', DATE '2024-01-01', ts::DATE) // 7) AS session_id, 'repo' || (user_id % 7) AS project,
        CASE user_id % 4 WHEN 0 THEN 'feature/area-' || (user_id % 10) WHEN 1 THEN 'fix/TASK-' || (user_id % 10) || '-x' ELSE 'main' END AS branch,
        '/home/dev/' || CASE WHEN json_extract(props, '$.k')::INT % 19 = 0 THEN 'other' ELSE 'repo' || (user_id % 7) END AS cwd
      FROM events)"""
SQL_PROMPTS = SQL_EVENTS + """,
p0 AS (SELECT *, CASE WHEN k % 41 = 0 THEN '[Request interrupted by user]'
       WHEN k % 29 = 0 THEN 'This session is being continued from TASK-' || (k % 5)
       WHEN k % 23 = 0 THEN 'hello there'
       WHEN k % 17 = 0 THEN ['Now let''s look at', 'Now let us look at', '(new task) report', 'Ahora mira', 'Back to'][k % 5 + 1] || ' the totals of area ' || k
       WHEN event_type IN ('error', 'purchase') AND user_id % 4 <> 3 THEN upper(event_type) || '-' || (k % 5 + 1) || ' please look into value ' || k
       ELSE 'Review the ' || event_type || ' numbers of area ' || (k % 9) || ' and report back' END AS text FROM e),
p AS (SELECT session_id, project, (row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1)::INT AS turn, ts, event_id, text, branch, cwd, value,
        (text LIKE '[Request interrupted%' OR text LIKE 'This session is being continued%') AS noise, text LIKE 'This session is being continued%' AS compaction,
        regexp_extract_all(text, '\\b[A-Z][A-Z0-9]{1,9}-[0-9]{1,6}\\b') AS all_keys,
        CASE WHEN text LIKE '[Request interrupted%' OR text LIKE 'This session is being continued%' THEN [] ELSE list_distinct(regexp_extract_all(text, '\\b[A-Z][A-Z0-9]{1,9}-[0-9]{1,6}\\b')) END AS keys,
        CASE WHEN event_type = 'click' AND k % 10 <> 0 THEN [cwd || '/src/part' || (k % 6) || '/file' || (k % 12) || '.js'] ELSE []::VARCHAR[] END AS files,
        CASE event_type WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN ['git commit -m "area ' || k || '"', 'npm test', 'git push origin ' || branch] ELSE ['npm test', 'ls -la'] END
          WHEN 'signup' THEN ['git checkout ' || branch, CASE WHEN k % 3 = 0 THEN 'git push origin HEAD' ELSE 'git status' END]
          WHEN 'error' THEN ['git reset --hard'] ELSE []::VARCHAR[] END AS commands
      FROM p0)"""
SQL_TOOLS = SQL_EVENTS + """,
t AS (SELECT session_id, project, CASE WHEN user_id % 5 = 0 THEN 'agent-' || (k % 2) ELSE 'main' END AS source, event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts,
        CASE event_type WHEN 'click' THEN 'edit' WHEN 'error' THEN 'revert' WHEN 'purchase' THEN 'commit' ELSE 'push' END AS kind,
        CASE WHEN event_type = 'click' THEN CASE WHEN k % 10 = 0 THEN '/tmp/scratch' || k || '.txt' ELSE cwd || '/src/part' || (k % 6) || '/file' || (k % 12) || '.js' END END AS path, cwd,
        CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 'git checkout -- src/part' || (k % 6) || '/file' || (k % 12) || '.js' WHEN 1 THEN 'git reset --hard'
             ELSE 'git reset ' || substr(md5(session_id || '-' || (k % 8)), 1, 7) END END AS cmd,
        CASE event_type WHEN 'purchase' THEN substr(md5(session_id || '-' || (k % 8)), 1, 7) WHEN 'signup' THEN substr(md5(session_id || '-' || (k % 8)), 1, 9) END AS hash,
        branch, CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'PURCHASE-' || (k % 5 + 1) || ': do it' ELSE 'tidy up' END END AS msg
      FROM e WHERE event_type <> 'view')"""
SQL_MESSAGES = """
m AS (SELECT conv_id AS session_id, turn AS line_no, role, coalesce(text, '') AS text, role = 'user' AS is_prompt FROM conversations WHERE role IN ('user', 'assistant'))"""
