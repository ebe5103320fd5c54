"""The corpus pipeline on the smallest tables, each stage against a brute-force version on its own input."""

from __future__ import annotations

import os

import numpy as np
import pytest
from test_operators import brute_counts

import corpus_pipeline
from sessionloom.llm import bpe, neardup

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append((docs.columns, {r["doc_id"]: r for r in docs.collect()}))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        rows = docs.collect()
        out.append((docs.columns, {r["doc_id"]: r for r in rows} if name != "packing" else rows))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "suffix_dedup", "packing"]
    assert all(columns == stages[0][0] for columns, _ in stages[1:5])


def test_language_keeps_texts_with_letters(stages):
    before, after = stages[0][1], stages[1][1]
    assert all(not any(c.isalpha() for c in before[i]["text"] or "") for i in set(before) - set(after))
    assert all(after[i] == before[i] for i in after)


def test_quality_follows_the_base_rule(stages):
    before, after = stages[1][1], stages[2][1]
    for i, r in before.items():
        n, _, _, _, repeats = brute_counts(r["text"])
        if n < 20 or 100 * repeats > 30 * n:
            assert i not in after
    assert len(after) > 0.8 * len(before)
    assert all(set(r["text"].split("\n")) <= set(before[i]["text"].split("\n")) and r["n_chars"] == len(r["text"]) for i, r in after.items())


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_near_duplicates_leave_one_of_each_group(stages):
    before, after = stages[2][1], stages[3][1]
    sets, ids = {i: shingles(r["text"]) for i, r in before.items()}, sorted(before)
    group = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                lo, hi = sorted((group[a], group[b]))
                group = {k: lo if g == hi else g for k, g in group.items()}
    assert set(after) >= {i for i in ids if group[i] == i}  # no document goes without a partner
    assert len(after) <= 1.02 * len(set(group.values())) + 1  # and nearly every partner goes


def test_no_passage_starts_twice(stages):
    before, after = stages[3][1], stages[4][1]
    seen, cut = set(), {}
    for i in sorted(before):
        data = (before[i]["text"] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        cut[i] = bytes(b for b, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")
    assert {i: len(r["text"]) for i, r in after.items()} == {i: len(t) for i, t in cut.items()}


def test_packing_holds_all_ids(stages):
    before, pieces = stages[4][1], stages[5][1]
    enc = bpe.encoder(bpe.vocabulary("byte_bpe_50k.json"))
    for i, r in before.items():
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in own) == b"".join(k.to_bytes(4, "little") for k in [*enc.whole(r["text"] or ""), 1])
    assert max(p["sequence_tokens"] for p in pieces) <= 2048


#: Extra columns that carry names the stages use inside.
EXTRA = "_stage_lang string, _stage_score double, kept boolean, ids binary, start long, host string, h long, sequence_id long, _text string"


def hostile(spark):
    """Clean documents, a long one, rows with nulls in every column, texts without letters, repeated rows and equal texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.orderBy("doc_id").limit(40).collect()]
    own, text = rows[0], rows[1][1]
    odd = [(None, None, None, None, None), (None, text + " and an end of its own that no other text has", None, None, None), (900, None, "de", "src0", 0), (901, "", "de", "src0", 0), (902, " \n\t ", None, None, 4), (903, "12 34 -- 56", "de", None, 11)]
    odd += [own, own, (905, text, None, None, None), (906, "\n".join(f"{r[1]} {k}" for k, r in enumerate(rows[2:] * 6)), rows[2][2], None, None)]
    return spark.createDataFrame([(*r, *(None,) * 9) for r in rows + odd], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema) + ", " + EXTRA)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_takes_any_table(spark, tmp_path, name, stage):
    docs = hostile(spark)
    docs.write.parquet(f"{tmp_path}/docs")
    given = spark.read.parquet(f"{tmp_path}/docs")
    rows, out = given.collect(), stage(spark, given, SF)
    found, ids = out.collect(), {r["doc_id"] for r in rows}
    assert {r["doc_id"] for r in found} <= ids
    if name == "packing":
        ends = {(r["doc_id"], r["start"] + r["length"]) for r in found}
        assert {r["doc_id"] for r in found} == ids and {(i, 1) for i in (900, 901)} <= ends  # a text without words has its end id only
    else:
        assert out.columns == given.columns
        texts = {r["doc_id"]: r["text"] for r in found}
        if name in ("language_id", "quality_rules"):
            assert not {900, 901, 902, 903} & set(texts)  # no letter, no words
        if name == "language_id":
            assert len(found) == len([r for r in rows if any(c.isalpha() for c in r["text"] or "")])
        if name == "near_dedup":
            assert sum(r["doc_id"] == rows[0]["doc_id"] for r in found) <= 1 and sum(r["text"] == rows[1]["text"] for r in found) == 1
            assert len({r["text"] for r in rows if r["text"]}) - len({r["text"] for r in found if r["text"]}) <= 2
        if name == "suffix_dedup":
            assert len(found) == len(rows) and not texts[905] and sum(bool(r["text"]) for r in found if r["doc_id"] == 0) == 1
    assert stage(spark, given.limit(0), SF).count() == 0


def test_tiny_texts_lose_no_link(spark):
    """Pairs of nine and eight words (five and four shingles, four in common), which a sketch keeps apart worst."""
    rng = np.random.default_rng(8)
    far = []
    for _ in range(10_000):
        own = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
        a, b = neardup.sketch(own).view(np.uint64), neardup.sketch(own[:4]).view(np.uint64)
        far.append(int(np.bitwise_count(a ^ b).sum()))
    assert max(far) <= neardup.TINY_RADIUS and sum(f > neardup.RADIUS for f in far) > 0
    words = [[f"w{rng.integers(0, 1 << 40)}" for _ in range(9)] for _ in range(1500)]
    rows = [(2 * k, " ".join(w)) for k, w in enumerate(words)] + [(2 * k + 1, " ".join(w[:8])) for k, w in enumerate(words)]
    kept = {r.doc_id for r in neardup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * k for k in range(1500)}


def test_the_pipeline_leaves_only_its_result(spark, tmp_path, monkeypatch):
    import os

    from sessionloom.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}/shared")
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(k, f"{text} {k}", "en", "s", 400) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = os.listdir(f"{tmp_path}/shared")
    assert len(left) == 1 and os.listdir(f"{tmp_path}/shared/{left[0]}") == ["4-packing"]
