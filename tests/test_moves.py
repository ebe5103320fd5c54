"""Moves in log order against a plain walk through the log."""

from __future__ import annotations

import random

from sessionloom.operators import corrections

MEMBER = "workspace string, session_id string, unit string, mode string"


def op(seq, kind, **fields):
    row = {"workspace": "w", "seq": seq, "id": f"o{seq}", "type": kind} | fields
    return tuple(row.get(c.split()[0].strip("`")) for c in corrections.OPS.replace("array<struct<start:int,end:int,label:string>>", "parts").replace("\n", " ").split(", "))


def state_of(spark, ops):
    return corrections.fold(spark.createDataFrame(ops, corrections.OPS))


def applied(spark, member, ops, prompts=9):
    members = spark.createDataFrame([("w", s, u, m) for s, u, m in member], MEMBER)
    sessions = members.selectExpr("workspace", "session_id", f"{prompts} AS n_prompts").distinct()
    return {(r.session_id, r.unit, r["mode"]) for r in corrections.apply(members, state_of(spark, ops), sessions).collect()}


def test_a_session_that_goes_back_makes_its_unit_for_later_moves(spark):
    member = [("a", "session:a", "main"), ("b", "session:b", "main")]
    moves = [op(1, "move", session="a", to="gone"), op(2, "move", session="b", to="session:a")]
    assert applied(spark, member, moves) == {("a", "session:a", "main"), ("b", "session:a", "forced")}
    late = [op(1, "move", session="b", to="session:a"), op(2, "move", session="a", to="gone")]
    assert applied(spark, member, late) == {("a", "session:a", "main"), ("b", "session:b", "main")}


def test_a_session_moved_again_keeps_its_place_until_its_unit_is_split(spark):
    member = [("a", "session:a", "main"), ("b", "session:b", "main")]
    again = [op(1, "move", session="a", to="x"), op(2, "move", session="b", to="session:a"), op(3, "move", session="a", to="gone")]
    assert applied(spark, member, again) == {("a", "session:a", "main"), ("b", "session:a", "forced")}
    split = [op(1, "move", session="a", to="x"), op(2, "move", session="b", to="session:a"), op(3, "split", unit="x"), op(4, "move", session="a", to="gone")]
    assert applied(spark, member, split) == {("a", "session:a", "main"), ("b", "session:b", "main")}


def test_moves_into_parts_of_a_cut_session(spark):
    member = [("a", "session:a", "main"), ("b", "session:b", "main"), ("c", "session:c", "main")]
    cut = op(1, "cut", session="a", parts=[(0, 3, "x"), (4, 8, "y")])
    ops = [cut, op(2, "move", session="b", to="session:a#4-8"), op(3, "move", session="c", to="session:a")]
    assert applied(spark, member, ops) == {("a", "session:a#0-3", "main"), ("a", "session:a#4-8", "main"), ("b", "session:a#4-8", "forced"), ("c", "session:c", "main")}


def walk(member, ops):
    """Moves one by one, as maps."""
    moves = {}
    for o in ops:
        r = dict(zip([c.split()[0].strip("`") for c in corrections.OPS.replace("array<struct<start:int,end:int,label:string>>", "parts").replace("\n", " ").split(", ")], o))
        if r["type"] == "move":
            moves[r["session"]] = r["to"]
        elif r["type"] == "split":
            moves = {s: t for s, t in moves.items() if t != r["unit"]}
    base, back = {u for s, u, _ in member if s not in moves}, {}
    for s, to in moves.items():
        own = [(u, m) for t, u, m in member if t == s]
        if own:
            back[s] = to not in base
            base |= {u for u, _ in own} if back[s] else set()
    return {(s, u, m) for s, u, m in member if back.get(s, True)} | {(s, moves[s], "forced") for s, b in back.items() if not b}


def test_long_chains_equal_a_walk_through_the_log(spark):
    r = random.Random(4)
    member = [(f"s{i}", f"session:s{i}", "main") for i in range(60)] + [(f"k{i}", f"K-{i % 5}", "main") for i in range(10)] + [(f"k{i}", f"K-{i % 5 + 1}", "mention") for i in range(10)]
    names = sorted({s for s, _, _ in member}) + ["unknown"]
    targets = sorted({u for _, u, _ in member}) + ["gone"]
    ops = [op(k, "split", unit=r.choice(targets)) if k % 17 == 0 else op(k, "move", session=r.choice(names), to=r.choice(targets)) for k in range(150)]
    chain = [op(200 + i, "move", session=f"s{i}", to=f"session:s{i - 1}") for i in range(1, 12)]  # each depends on the one before
    assert applied(spark, member, ops + chain) == walk(member, ops + chain)


def test_no_frame_of_the_fold_shrinks(spark):
    # Spark sums a frame up to the end anew for every row, which is quadratic in the moves to one unit
    state = state_of(spark, [op(1, "move", session="a", to="x"), op(2, "split", unit="x"), op(3, "move", session="a", to="x")])
    plan = state._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan.replace("unboundedpreceding$(), unboundedfollowing", "whole")
    assert [(r.subject, r.target, r.ord) for r in state.where("kind = 'move'").collect()] == [("a", "x", 3)]


def test_the_fold_reads_its_log_once(spark):
    ops = [op(1, "rename", unit="x", label="new"), op(2, "hide", unit="x"), op(3, "odd", unit="x"), op(4, None, unit="x"), op(5, "move", session="a", to="x")]
    state = state_of(spark, ops)
    assert "ExistingRDD" not in state._jdf.queryExecution().executedPlan().toString()
    assert {(r.kind, r.subject, r.target) for r in state.collect()} == {("label", "x", "new"), ("hidden_unit", "x", None), ("move", "a", "x")}
    assert state_of(spark, ops[2:4]).isEmpty()
