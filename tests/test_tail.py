"""The tailing source: half lines, restarts of the stream, files written anew, long files in ranges."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sessionloom.sources import tail
from sessionloom.sources.transcripts import is_prompt
from sessionloom.streaming import jobs


def line(text, kind="user"):
    return json.dumps({"type": kind, "timestamp": "2026-01-01T10:00:00Z", "message": {"content": text}}, ensure_ascii=False) + "\n"


class Run:
    """A stream that is started anew for each batch, as after a crash."""

    def __init__(self, spark, tmp_path, block=tail.BLOCK, job=None):
        self.spark, self.root, self.out, self.block, self.job = spark, tmp_path / "root", tmp_path / "out", block, job
        self.keep = f"{tmp_path}/checkpoint"
        (self.root / "p 1").mkdir(parents=True)

    def add(self, name, text, mode="a"):
        with open(self.root / "p 1" / f"{name}.jsonl", mode, encoding="utf-8") as f:
            f.write(text)

    def step(self):
        rows = tail.tail(self.spark, str(self.root), self.block)
        if self.job:
            rows = self.job(rows)
        before = len(self.rows())
        sink = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{self.out}/b={n}")
        rows.writeStream.foreachBatch(sink).option("checkpointLocation", self.keep).trigger(availableNow=True).start().awaitTermination()
        return self.rows()[before:]

    def rows(self):
        return [] if not self.out.exists() else self.spark.read.parquet(str(self.out)).orderBy("b", "session_id", "at").collect()


def test_a_half_line_waits_for_its_rest(spark, tmp_path):
    run = Run(spark, tmp_path)
    whole, half = line("first prompt"), line("zwölf Männer")
    run.add("s1", whole + half[:70])
    assert [(r.session_id, r.project, r.text, r.at) for r in run.step()] == [("s1", "p 1", "first prompt", 0)]
    assert run.step() == []
    run.add("s1", half[70:-1])
    assert run.step() == []  # the line feed is missing
    run.add("s1", "\n" + "no json\n\n[1]\n" + line("third"))
    run.add("s2", line("other session"))
    assert [(r.session_id, r.text) for r in run.step()] == [("s1", "zwölf Männer"), ("s1", "third"), ("s2", "other session")]
    assert run.step() == []


def test_subagents_and_other_files_are_not_followed(spark, tmp_path):
    run = Run(spark, tmp_path)
    (run.root / "p 1" / "s1" / "subagents").mkdir(parents=True)
    (run.root / "p 1" / "s1" / "subagents" / "a.jsonl").write_text(line("x"))
    (run.root / "top.jsonl").write_text(line("y"))
    (run.root / "p 1" / "notes.txt").write_text(line("z"))
    assert run.step() == []


def test_turns_go_on_over_batches_and_begin_again_in_a_file_written_anew(spark, tmp_path):
    run = Run(spark, tmp_path, job=lambda rows: jobs.numbered_turns(rows.select("session_id", "at", "text", "restart", is_prompt().alias("is_prompt")), "at"))
    run.add("s1", line("one") + line("two"))
    assert [(r.turn, r.text, r.restart) for r in run.step()] == [(0, "one", False), (1, "two", False)]
    run.add("s1", line("answer", "assistant") + line("three"))
    assert [(r.turn, r.text, r.restart) for r in run.step()] == [(1, "answer", False), (2, "three", False)]
    run.add("s1", line("new"), "w")
    assert [(r.turn, r.text, r.restart) for r in run.step()] == [(0, "new", True)]
    run.add("s1", line("more"))
    assert [(r.turn, r.text, r.restart) for r in run.step()] == [(1, "more", False)]


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_each_line_of_a_range_comes_once(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(tail, "STEP", 16)
    (tmp_path / "p").mkdir()
    texts = [f"line {i} " + "é" * (i % 40) for i in range(60)]
    data = "".join(t + "\n" for t in texts)
    (tmp_path / "p" / "s.jsonl").write_text(data + "rest without an end")
    reader = tail.TailReader({"path": str(tmp_path), "blockbytes": block})
    end = reader.latestOffset()
    assert end == {"p/s.jsonl": len(data.encode())}
    got = [x for p in reader.partitions({}, end) for b in reader.read(p) for x in zip(b.column("at").to_pylist(), b.column("line").to_pylist())]
    assert [x[1] for x in got] == texts and len({x[0] for x in got}) == len(texts)
    assert all(data.encode()[at:].decode("utf-8").startswith(t) for at, t in got)
