"""Written records: read, append, reuse, search text, report."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sessionloom.operators import search
from sessionloom.sources import records as R


def test_records(spark, tmp_path):
    folder = tmp_path / "records"
    folder.mkdir()
    one = {"key": "KK-1", "generated_at": "2026-07-01T10:00:00Z", "capsule": {"objective": "Faster autenticación", "decisions": [{"decision": "Use a cache", "why": "it is slow", "cites": [{"session": "abcd1234", "turn": 3}]}], "briefing": "a\nb"}, "files": [{"short": "shop/a.js", "edits": 2, "status": "final"}], "unit": {"label": "L"}}
    (folder / "a.json").write_text(json.dumps(one, indent=1))
    (folder / "b.json").write_text(json.dumps({**one, "generated_at": "2026-06-01T10:00:00Z", "capsule": {"objective": "old"}}))
    (folder / "c.json").write_text(json.dumps({"generated_at": "2026-06-01T10:00:00Z"}))
    (folder / "d.json").write_text("{ broken")
    rows = R.read_records(spark, str(folder))
    assert [(r["key"], r["capsule"]["objective"]) for r in rows.collect()] == [("KK-1", "Faster autenticación")]
    parts = {s["id"]: s["text"] for s in R.sections(rows).first()["sections"]}
    assert parts == {"objective": "Faster autenticación", "decisions": "Use a cache — it is slow", "files": "shop/a.js (final)", "briefing": "a\nb"}
    docs = R.sections(rows).select(F.col("key").alias("doc"), F.col("key").alias("head"), "sections")
    assert [r["sections"] for r in search.field_bm25(docs, ["autenticacion"]).collect()] == [["objective"]]
    assert search.field_bm25(docs, ["autenticacion", "zebra"]).count() == 0
    text = R.markdown(rows).first()["markdown"]
    assert "- **Use a cache** — it is slow `abcd1234:3`" in text and "> a\n> b" in text and "_(none)_" in text
    assert R.catalog(rows).first()["line"] == "KK-1 | Faster autenticación | Use a cache"
    previous = spark.createDataFrame([("KK-7", "KK-1", 1), ("KK-8", "KK-1", 2)], "unit string, previous string, rank int")
    again = R.reuse(previous, rows).first()
    assert (again["key"], again["generated_at"], again["reused_from"]["key"], again["reused_from"]["label"]) == ("KK-7", "2026-07-01T10:00:00Z", "KK-1", "L")
    R.append_records(rows.withColumn("generated_at", F.lit(None).cast("string")).withColumn("key", F.lit("KK-2")), str(tmp_path / "out"), "2026-08-01T00:00:00Z")
    assert [(r["key"], r["generated_at"]) for r in R.read_records(spark, str(tmp_path / "out")).collect()] == [("KK-2", "2026-08-01T00:00:00Z")]
    assert R.read_records(spark, str(tmp_path / "none")).count() == 0 and R.read_corrections(spark, str(tmp_path / "none")).count() == 0


def test_indexes(spark, tmp_path):
    post = search.postings(spark.createDataFrame([("s", 1, "alpha beta alpha")], "session_id string, line_no long, text string"), ["session_id", "line_no"])
    R.write_index(post, str(tmp_path / "index"))
    assert {(r["term"], r["tf"]) for r in R.read_index(spark, str(tmp_path / "index")).collect()} == {("alpha", 2), ("beta", 1)}
    links = spark.createDataFrame([("a.js", "KK-1")], "short string, unit string")
    R.write_file_index(links, str(tmp_path / "files"), "KK")
    assert R.read_file_index(spark, str(tmp_path / "files"), "KK").count() == 1
    assert R.read_file_index(spark, str(tmp_path / "files"), "XX") is None and R.read_file_index(spark, str(tmp_path / "no"), "KK") is None
