"""Reading transcripts, tool events and corrections from small files of our own."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import text as X
from sessionloom.operators import corrections, evidence, files, messages, organize, ranges, search, segments, sessions
from sessionloom.sources import transcripts
from sessionloom.streaming import jobs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def line(kind, ts, content=None, **more):
    return json.dumps({"type": kind, "timestamp": f"2026-07-01T10:{ts:02d}:00Z", "gitBranch": more.pop("branch", "main"), "cwd": "/w/shop", "message": {"content": content}, **more})


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("projects")
    (root / "shop").mkdir()
    use = lambda id, name, **i: {"type": "tool_use", "id": id, "name": name, "input": i}
    rows = [
        line("assistant", 0, [{"type": "text", "text": "before any prompt"}]),
        line("user", 1, "<system-reminder>not a prompt</system-reminder>"),
        line("user", 2, [{"type": "text", "text": "KK-1 please add"}, {"type": "text", "text": "the search box"}], branch="feat/KK-1"),
        line("assistant", 3, [{"type": "text", "text": " done "}, use("t1", "Edit", file_path="/w/shop/src/a.js"), use("t2", "Write", file_path="/tmp/x"), use("t3", "Bash", command="git commit -m x")]),
        line("user", 4, [{"type": "tool_result", "tool_use_id": "t3", "content": [{"type": "text", "text": "[feat/KK-1 abc1234] KK-1: do it\n   1234567..abc1234  main -> main"}]}]),
        "not json", "[1, 2]", "", '{"broken": ',
        line("user", 5, "a side question", isSidechain=True),
        line("user", 6, "[Request interrupted by user]"),
        line("assistant", 7, [use("t4", "Edit", file_path="/w/shop/src/b.js"), use("t5", "Bash", command="git checkout -- src/b.js")]),
        line("user", 8, "thanks", isMeta=True),
        json.dumps({"type": "custom-title", "customTitle": "My title"}),
    ]
    (root / "shop" / "aaaa1111-1.jsonl").write_text("\n".join(rows) + "\n")
    (root / "shop" / "bbbb2222-2.jsonl").write_text(line("user", 9, "hello") + "\n")
    sub = root / "shop" / "aaaa1111-1" / "subagents"
    sub.mkdir(parents=True)
    (sub / "agent-0123456789abcdef.jsonl").write_text(line("assistant", 20, [use("s1", "Edit", file_path="/w/shop/src/c.js")]) + "\n")
    return str(root)


def test_records_and_prompts(spark, root):
    rows = transcripts.records(spark, root)
    prompts = rows.where(transcripts.is_prompt()).orderBy("session_id", "line_no").collect()
    assert [(r["session_id"], r["text"]) for r in prompts] == [("aaaa1111-1", "KK-1 please add\nthe search box"), ("aaaa1111-1", "[Request interrupted by user]"), ("bbbb2222-2", "hello")]
    assert {r["project"] for r in prompts} == {"shop"}
    s = {r["session_id"]: r for r in sessions.summaries(rows).collect()}["aaaa1111-1"]
    assert (s["title"], s["n_prompts"], s["cwd"]) == ("My title", 2, "/w/shop")
    assert transcripts.records(spark, root + "/nothing").count() == 0


def test_tool_events(spark, root):
    both = transcripts.records(spark, root).unionByName(transcripts.subagent_records(spark, root))
    got = sorted((r["kind"], r["source"], r["path"] or r["cmd"] or r["hash"]) for r in files.tool_events(both).collect())
    assert got == [("commit", "main", "abc1234"), ("edit", "agent-01234567", "/w/shop/src/c.js"), ("edit", "main", "/tmp/x"), ("edit", "main", "/w/shop/src/a.js"), ("edit", "main", "/w/shop/src/b.js"), ("push", "main", "abc1234"), ("revert", "main", "git checkout -- src/b.js")]


def test_text_functions(spark):
    assert value(spark, X.find_keys(F.lit("éKK-1 xKK-2 KK-3é _KK-4 9KK-5 KK-6_ (KK-7) UTF-8 KK-8x SHA-256"))) == ["KK-1", "KK-3", "KK-7"]
    assert value(spark, X.fold(F.lit("Decisión Ñandú"))) == "decision nandu"
    for s in ("Straße", "İstanbul", "ÀÉÎÕÜ ✨ 日本", "éx"):
        assert len(value(spark, X.fold(F.lit(s)))) == len(s)
    assert value(spark, X.words(F.lit("Decisión: SHOP-101, ñandú!"))) == ["decision", "shop", "101", "nandu"]
    assert value(spark, X.tokens(F.lit("Please fix the Código at https://x.io abcdef123456 now"))) == ["fix", "codigo"]
    secret = "key sk-" + "a" * 20 + " and password = hunter2"
    assert value(spark, X.redact(F.lit(secret))) == "key [REDACTED] and [REDACTED]" and value(spark, X.count_redactions(F.lit(secret))) == 2
    for s in ("hola", "/code-review high", "<ide_opened_file>a b c d e</ide_opened_file>", "three words only", None, "ok then go"):
        assert value(spark, X.meaningful(F.lit(s))) == ""
    assert value(spark, X.meaningful(F.lit("/home/me is not a command here"))) != ""
    assert value(spark, X.short_path(F.lit("/w/shop/.claude/worktrees/x1/src/a.js"), F.lit("/other"))) == "shop/src/a.js"
    assert value(spark, X.short_path(F.lit("/w/shop/src/a.js"), F.lit("/w/shop/"))) == "shop/src/a.js"
    assert value(spark, X.cut_title(F.lit("word " * 40))).endswith("word…")
    with pytest.raises(ValueError, match="bad key pattern"):
        X.key_pattern(["("])
    assert value(spark, X.find_keys(F.lit("abc-1 xabc-2"), X.key_pattern([r"\babc-\d"]))) == ["abc-1"]


def turns(spark, rows):
    base = dict(ts="2026-07-01 10:00:00", text="t", keys=[], cwd="/a", branch="main", files=[], noise=False, compaction=False)
    full = [{"session_id": "s", "turn": i, **base, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "session_id string, turn int, ts string, text string, keys array<string>, cwd string, branch string, files array<string>, noise boolean, compaction boolean").withColumn("ts", F.col("ts").cast("timestamp"))


def test_segment_scores(spark):
    t = turns(spark, [{"keys": ["A-1"]}, {"keys": ["A-1"], "cwd": "/b"}, {"keys": ["B-2"], "cwd": "/b", "branch": "x"}, {"text": "Ahora otra cosa", "cwd": "/b", "branch": "x"}])
    get = lambda df, c: [r[c] for r in df.orderBy("turn").collect()]
    assert get(segments.key_scores(t), "key") == [0.6, 0.0, 1.0, 0.0]
    assert get(segments.context_scores(t), "ctx") == [0.0, 1.0, 0.5, 0.0]
    assert get(segments.cue_scores(t), "cue") == [0.0, 0.0, 0.0, 1.0]
    scores = spark.createDataFrame([("s", i, v) for i, v in enumerate([0.0, 0.9, 0.95, 0.0, 0.0, 0.0, 0.85])], "session_id string, turn int, score double")
    assert sorted(r["turn"] for r in segments.pick(scores).collect()) == [2, 6]


def test_boundary_between_two_topics(spark):
    t = turns(spark, [{"keys": ["A-1"], "text": "work on the search index"}] * 6 + [{"keys": ["B-2"], "text": "payment form colours broken"}] * 6)
    picked = segments.pick(segments.boundary_scores(t))
    assert [r["turn"] for r in picked.collect()] == [6]
    own = {r["segment"]: r for r in segments.labels(t, picked).collect()}
    assert (own[0]["start"], own[0]["end"], own[0]["key"], own[1]["key"]) == (0, 5, "A-1", "B-2")


def test_ranges(spark):
    r = spark.createDataFrame([("s", 5, 7), ("s", 0, 2), ("s", 3, 3), ("s", 20, 21)], "session_id string, start int, end int")
    merged = ranges.merge_ranges(r, ["session_id"])
    assert sorted((x["start"], x["end"]) for x in merged.collect()) == [(0, 3), (5, 7), (20, 21)]
    assert sorted((x["start"], x["end"]) for x in ranges.lead_ranges(merged, ["session_id"]).collect()) == [(4, 4), (16, 19)]


def op(seq, kind, **more):
    base = dict(workspace="w", seq=seq, id=f"o{seq}", batch=None, ts=None, type=kind, unit=None, session=None, to=None, label=None, hidden=None, members=None, parts=None, source=None, undone=None)
    return {**base, **more}


def test_fold_of_a_long_log(spark):
    log = [op(1, "move", session="old", to="user:g"), op(2, "merge", unit="user:g", members=["A-1"]), op(3, "move", session="gone", to="B-1"), op(4, "move", session="gone", to="user:h"), op(5, "split", unit="user:h")]
    log += [op(k, "rename", unit="A-1", label=f"n{k}") for k in range(6, 5100)]
    state = corrections.fold(spark.createDataFrame(log, corrections.OPS))
    assert sorted((r["kind"], r["subject"], r["target"] or "") for r in state.collect()) == [("group", "user:g", ""), ("label", "A-1", "n5099"), ("merge", "user:g", "A-1"), ("move", "old", "user:g")]


def folded_in_order(log):
    """The state after reading a workspace's log operation by operation."""
    labels, groups, moves, hidden = {}, {}, {}, set()
    for o in sorted(log, key=lambda o: (o["seq"], o["id"])):
        kind, unit = o["type"], o["unit"]
        if o["undone"]:
            continue
        if kind == "rename":
            labels[unit] = (o["label"] or "").strip()
        elif kind == "merge":
            members, name, ai = groups.get(unit, ([], None, False))
            groups[unit] = (members + [m for m in o["members"] if m != unit and m not in members], o["label"] or name, ai or o["source"] == "ai")
        elif kind == "split":
            groups.pop(unit, None), labels.pop(unit, None), hidden.discard(unit)
            moves = {s: m for s, m in moves.items() if m[0] != unit}
        elif kind == "move":
            moves[o["session"]] = (o["to"], moves.get(o["session"], (None, o["seq"]))[1])  # a map keeps the place of a key
        elif kind == "hide":
            hidden.discard(unit or o["session"]) if o["hidden"] is False else hidden.add(unit or o["session"])
    out = [("label", u, t, 0, None) for u, t in labels.items() if t] + [("hidden", u, None, 0, False) for u in hidden]
    out += [("move", s, t, n, False) for s, (t, n) in moves.items()] + [("group", u, g[1], 0, g[2]) for u, g in groups.items()]
    return out + [("merge", u, m, i, g[2]) for u, g in groups.items() for i, m in enumerate(g[0])]


def test_fold_equals_reading_the_log_in_order(spark):
    import random

    rng, log = random.Random(5), []
    for n in range(900):
        units, sessions = ["A-1", "B-2", "user:g", "user:h"], ["s1", "s2", "s3"]
        kind, unit = rng.choice(["rename", "merge", "merge", "split", "move", "hide"]), rng.choice(units)
        more = {
            "rename": dict(unit=unit, label=rng.choice(["x", " y ", "", None])), "split": dict(unit=unit), "move": dict(session=rng.choice(sessions), to=unit),
            "merge": dict(unit=unit, members=rng.sample(units, 2), label=rng.choice([None, "G", "H"]), source=rng.choice([None, None, "ai"])),
            "hide": dict(unit=unit, hidden=rng.choice([None, True, False])) if n % 2 else dict(session=rng.choice(sessions), hidden=rng.choice([True, False])),
        }[kind]
        log.append({**op(n, kind, **more), "workspace": f"w{rng.randrange(60)}", "undone": rng.random() < 0.1})
    want = sorted(str((w, *r)) for w in {o["workspace"] for o in log} for r in folded_in_order([o for o in log if o["workspace"] == w]))
    state = corrections.fold(spark.createDataFrame(log, corrections.OPS)).collect()
    own = [(r["workspace"], r["kind"].split("_")[0], r["subject"], r["target"], r["ord"], None if r["kind"] == "label" else r["ai"]) for r in state]
    assert sorted(map(str, own)) == want
    assert corrections.fold(spark.createDataFrame([], corrections.OPS)).count() == 0


def test_corrections(spark):
    log = [
        op(1, "rename", unit="KK-1", label="First"), op(2, "rename", unit="KK-1", label=""), op(3, "rename", unit="KK-2", label="Second"),
        op(4, "merge", unit="user:g", members=["KK-1", "session:c"], label="Group"), op(5, "move", session="d", to="user:g"), op(6, "move", session="e", to="gone"),
        op(7, "cut", session="f", parts=[(0, 1, "a"), (4, 5, "b")]), op(8, "cut", session="x", parts=[(0, 3, "a"), (2, 5, "b")]), op(9, "hide", session="h", hidden=True), op(10, "rename", unit="KK-9", label="no", undone=True),
    ]
    ops = spark.createDataFrame(log, corrections.OPS)
    state = corrections.fold(ops)
    kinds = sorted((r["kind"], r["subject"], r["target"]) for r in state.collect())
    assert ("label", "KK-2", "Second") in kinds and not any(k[0] == "label" and k[1] in ("KK-1", "KK-9") for k in kinds) and not any(k[1] == "x" for k in kinds)
    member = spark.createDataFrame([("a", "KK-1", "main"), ("b", "KK-2", "main"), ("c", "session:c", "main"), ("d", "KK-2", "main"), ("e", "KK-2", "main"), ("f", "session:f", "main"), ("h", "KK-2", "main")], "session_id string, unit string, mode string")
    sizes = spark.createDataFrame([("w", s, 8) for s in "abcdefh"], "workspace string, session_id string, n_prompts int")
    member = member.withColumn("workspace", F.lit("w"))
    state = state.withColumn("workspace", F.lit("w"))
    got = sorted((r["session_id"], r["unit"], r["label"]) for r in corrections.apply(member, state, sizes).collect())
    assert got == [("a", "user:g", "Group"), ("b", "KK-2", "Second"), ("c", "user:g", "Group"), ("d", "user:g", "Group"), ("e", "KK-2", "Second"), ("f", "session:f#0-1", None), ("f", "session:f#2-3", None), ("f", "session:f#4-5", None), ("f", "session:f#6-7", None)]
    undone = corrections.undo(ops.withColumn("batch", F.when(F.col("seq") >= 8, "last")))
    assert sorted(r["seq"] for r in undone.where("undone").collect()) == [8, 9, 10]
    asked = spark.createDataFrame([op(1, "rename", unit="KK-1", label="x"), op(2, "rename", unit="nope"), op(3, "merge", unit="user:z", members=["KK-1"]), op(4, "split", unit="KK-1")], corrections.OPS)
    known = spark.createDataFrame([("KK-1", "key"), ("KK-2", "key")], "unit string, source string")
    assert {r["id"]: r["reason"] for r in corrections.validate(asked, known).collect()} == {"o1": None, "o2": "unknown unit", "o3": "fewer than two units", "o4": "only groups can be split"}


def test_answers(spark):
    shown = spark.createDataFrame([("a", 0), ("a", 5), ("b", 1), ("c", 2)], "session_id string, turn int")
    groups = spark.createDataFrame([("x", 0, "Title", ["a", "b"], [("a", 0), ("b", 1)]), ("x", 1, "Later", ["a", "c"], [("a", 5), ("c", 2)]), ("x", 2, "No", ["b", "c"], [("b", 9)])], "batch string, pos int, title string, members array<string>, evidence array<struct<session_id:string,turn:int>>")
    assert [(r["pos"], sorted(r["members"])) for r in organize.check_groups(groups, shown).collect()] == [(0, ["a", "b"])]
    parts = spark.createDataFrame([("a", 0, 3, "One", [0]), ("a", 4, 9, "Two", [5]), ("b", 0, 3, "One", [1]), ("b", 3, 4, "Two", [1])], "session_id string, start int, end int, title string, evidence array<int>")
    sizes = spark.createDataFrame([("a", 20, True), ("b", 20, True)], "session_id string, n int, long boolean")
    assert {r["session_id"]: r["ok"] for r in organize.check_splits(parts, shown, sizes).collect()} == {"a": True, "b": False}
    old = spark.createDataFrame([("1", "pending", ["a"], "x"), ("2", "rejected", ["a"], "x"), ("3", "pending", ["z"], "x")], "id string, status string, sessions array<string>, body string")
    new = spark.createDataFrame([("2", "", ["a"], "y"), ("4", "", ["a"], "y")], "id string, status string, sessions array<string>, body string")
    kept = organize.upsert(old, new, spark.createDataFrame([("a",)], "session_id string"), spark.createDataFrame([], "id string"))
    assert sorted((r["id"], r["status"]) for r in kept.collect()) == [("2", "rejected"), ("3", "pending"), ("4", "pending")]


def test_search_ranks_frequent_words_higher(spark):
    rows = [("s", i, t) for i, t in enumerate(["cache of things", "cache cache cache", "autenticación rota", "password = zebra99"])]
    post = search.postings(spark.createDataFrame(rows, "session_id string, line_no long, text string"), ["session_id", "line_no"])
    hits = search.bm25(post, ["session_id", "line_no"], ["cache"]).orderBy(F.desc("score")).collect()
    assert [r["line_no"] for r in hits] == [1, 0]
    assert [r["line_no"] for r in search.bm25(post, ["session_id", "line_no"], ["autentica"]).collect()] == [2]
    assert search.bm25(post, ["session_id", "line_no"], ["zebra99"]).count() == 0 and search.bm25(post, ["session_id", "line_no"], []).count() == 0


def test_evidence(spark):
    t = spark.createDataFrame([("abcd1234-x", i, f"text {i}", False) for i in range(5)] + [("dupe0001-a", 0, "x", False), ("dupe0001-b", 0, "y", False)], "session_id string, turn int, text string, noise boolean")
    asked = spark.createDataFrame([("ABCD1234",), ("dupe0001",), ("none0000",), ("x",)], "session string")
    assert {r["session"]: r["status"] for r in evidence.resolve_sessions(asked, t).collect()} == {"ABCD1234": "ok", "dupe0001": "ambiguous", "none0000": "not_found", "x": "bad_request"}
    cites = spark.createDataFrame([(1, "abcd1234", "2"), (2, "abcd1234", "99"), (3, "abcd1234", "x")], "cite_id long, session string, turn string")
    got = evidence.resolve_cites(cites, t, 1).collect()
    assert sorted((r["cite_id"], r["turn"], r["cited"]) for r in got) == [(1, 1, False), (1, 2, True), (1, 3, False)]


def test_bounded_transcript(spark):
    t = turns(spark, [{"text": "long text " * 100}] * 12)
    spans = spark.createDataFrame([("s", 0, 11, False)], "session_id string, start int, end int, lead boolean")
    for most in (100_000, 5_000, 600):
        text = messages.bounded_transcript(t, spans, most).first()["text"]
        assert len(text) <= most and text.startswith("[s:s t:0 ")
    lines = text.split("\n")
    assert [x.split(" ")[1] for x in lines] == ["t:0", "10", "t:11"] and "left out to keep the evidence small" in lines[1]


def test_streaming_turns_continue_over_batches(spark, tmp_path):
    src, schema = tmp_path / "in", "session_id string, line_no long, is_prompt boolean, text string"
    src.mkdir()
    out = str(tmp_path / "out")

    def land(k, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(src / f"b{k}"))

    def drain():
        q = jobs.numbered_turns(spark.readStream.schema(schema).json(str(src / "*"))).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(jobs.replace_sessions(out)).start()
        q.awaitTermination()

    land(0, [("a", 0, False, "early"), ("a", 1, True, "one"), ("b", 0, True, "x")])
    drain()
    land(1, [("a", 2, False, "reply"), ("a", 3, True, "two")])
    drain()
    rows = spark.read.parquet(out)
    assert sorted((r["line_no"], r["turn"]) for r in rows.where("session_id = 'a'").collect()) == [(0, -1), (1, 0), (2, 0), (3, 1)]
    assert {r["line_no"] for r in jobs.latest(rows).where("session_id = 'a'").collect()} == {2, 3}


def test_streaming_pairs_equal_batch(spark, tmp_path):
    schema = "project string, session_id string, ts timestamp"
    import datetime as dt

    at = lambda m: dt.datetime(2026, 7, 1, 10) + dt.timedelta(minutes=m)
    rows = [("p", "a", at(0)), ("p", "b", at(90)), ("p", "c", at(400)), ("q", "d", at(10))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    found = []
    q = jobs.related_pairs(read(), read()).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, n: found.extend((r["unit"], r["other"]) for r in df.collect())).start()
    q.awaitTermination()
    assert found == [("a", "b")]
