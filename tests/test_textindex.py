"""The stored index against a fresh one, after sessions were appended to, cut short, changed and deleted."""

from __future__ import annotations

import re

from sessionloom.operators import search
from sessionloom.sources import textindex

KIND = "session_id string, line_no long, role string, text string"
WORDS = [["alp"], ["ha", "bet"], ["alpha", "nowhere"], []]


def messages(spark, rows):
    return spark.createDataFrame(rows, KIND)


def manifest(spark, sizes):
    return spark.createDataFrame([(s, n, 0) for s, n in sizes.items()], "session_id string, size long, mtime long")


def state(spark, sessions):
    """sessions: id -> texts."""
    rows = [(s, i, "user" if i % 2 == 0 else "assistant", t) for s, texts in sessions.items() for i, t in enumerate(texts)]
    return messages(spark, rows), manifest(spark, {s: sum(map(len, t)) for s, t in sessions.items()})


def hits(df):
    return sorted((r.session_id, r.line_no, round(r.score, 9)) for r in df.collect())


def same_as_fresh(spark, folder, now):
    fresh = search.postings(now, textindex.KEYS)
    for words in WORDS:
        assert hits(textindex.bm25(spark, folder, words)) == hits(search.bm25(fresh, textindex.KEYS, words)), words


FIRST = {"a": ["alpha beta", "gamma alphabet"], "b": ["beta betamax", "alpha"], "c": ["only here cafe", ""], "d": ["[Request interrupted by user] alpha", "halibut"]}


def test_updates_equal_a_fresh_index(spark, tmp_path):
    at, to = f"{tmp_path}/index", f"{tmp_path}/compact"
    textindex.create(*state(spark, FIRST), at)
    same_as_fresh(spark, at, state(spark, FIRST)[0])
    now = FIRST | {"a": FIRST["a"] + ["more alpha", "and gamma"], "e": ["new alphabet of halibut"]}  # appended and new
    assert textindex.update(*state(spark, now), at) == 1
    same_as_fresh(spark, at, state(spark, now)[0])
    now = {"a": ["short"], "b": ["another word alpha"], "e": now["e"], "c": now["c"]}  # cut short, changed, deleted
    assert textindex.update(*state(spark, now), at) == 2
    assert textindex.update(*state(spark, now), at) == 2  # nothing has changed
    same_as_fresh(spark, at, state(spark, now)[0])
    now |= {"d": FIRST["d"]}  # back again
    assert textindex.update(*state(spark, now), at) == 3
    same_as_fresh(spark, at, state(spark, now)[0])
    textindex.compact(spark, at, to)
    same_as_fresh(spark, to, state(spark, now)[0])
    assert textindex.update(*state(spark, now), to) == 0


def test_an_update_that_runs_again_writes_its_generation_once(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/index"
    textindex.create(*state(spark, FIRST), at)
    now = FIRST | {"e": ["alpha once"]}
    known = textindex.manifest(spark, at).collect()
    before = spark.createDataFrame(known, textindex.manifest(spark, at).schema)
    textindex.update(*state(spark, now), at)
    monkeypatch.setattr(textindex, "manifest", lambda spark, folder: before)
    assert textindex.update(*state(spark, now), at) == 1
    monkeypatch.undo()
    same_as_fresh(spark, at, state(spark, now)[0])


def test_a_search_reads_only_the_buckets_of_its_terms(spark, tmp_path):
    at = f"{tmp_path}/index"
    texts = {f"s{i}": [f"word{i} term{i} alphabet"] for i in range(80)}
    textindex.create(*state(spark, texts), at)
    found = textindex.matching(spark, at, ["word7"])
    buckets = {r[0] for r in textindex.terms_with(spark, at, "word7").select("bucket").collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("tf#" in line and re.search(r"PartitionFilters: \[[^]]*bucket", line) for line in plan.split("\n") if "FileScan" in line)
    assert {r[0] for r in found.select("bucket").distinct().collect()} == buckets
    grams = textindex.terms_with(spark, at, "word7")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*part", grams)
    assert sorted(r.term for r in textindex.terms_with(spark, at, "word7").collect()) == ["word7", *[f"word7{i}" for i in range(10)]]


def test_words_are_found_once(spark):
    # a filter on the words, also one that Spark adds, stands below the join and finds them a second time
    now, kept = state(spark, FIRST | {"e": ["...", "one"]})
    post = search.postings(now.join(kept, "session_id", "left_semi"), textindex.KEYS)
    for df in (post, search.statistics(now)):
        assert df._jdf.queryExecution().executedPlan().toString().count(r"[\p{L}\p{N}]+") == 1
    assert {(r.term, r.tf, r.len) for r in post.where("session_id = 'e'").collect()} == {("one", 1, 1)}
    assert search.statistics(now).first() == search.corpus(post, textindex.KEYS).first()


def test_matches_are_found_once(spark):
    hits = search.bm25(search.postings(state(spark, FIRST)[0], textindex.KEYS), textindex.KEYS, ["alp", "ha"])
    hits.collect()
    assert "ReusedExchange" in hits._jdf.queryExecution().executedPlan().toString()
