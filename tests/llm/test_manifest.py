"""Merkle manifest and sharding against plain versions on small tables."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import pytest
from compare import duck, same

from sessionloom.llm import merkle, queries, sharding

SF = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: dict) -> str:
    return sha(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """Root, and for each leaf the digests left and right of its path."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            start = i - i % 3
            paths[k].append((level[start:i], level[i + 1 : start + 3]))
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], paths


def plain(rows: list[dict]) -> list[tuple]:
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found = {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        found[s] = (own, *tree([leaf_of(r) for r in own]))
    root, above = tree([found[s][1] for s in names])
    out = []
    for s, top in zip(names, above):
        own, subroot, paths = found[s]
        for r, path in zip(own, paths):
            path = path + top
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                changed["text"] = r["text"].replace("\n", "")
            now = leaf_of(changed)
            for left, right in path:
                now = sha(*left, now, *right)
            out.append((r["doc_id"], leaf_of(r), subroot, root, sha(*(x for left, right in path for x in left + right)), now, now == root))
    return out


def rows_of(n: int, sources, **fixed) -> list[dict]:
    return [{"doc_id": i, "text": f"line {i}\nü {i % 7}", "lang": "en", "source": sources(i), "n_chars": i % 5} | {k: v(i) for k, v in fixed.items()} for i in range(n)]


def merkle_rows(spark, tmp_path, rows: list[dict], kind: str = KIND):
    spark.createDataFrame([tuple(r.get(c.split()[0]) for c in kind.split(", ")) for r in rows], kind).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in queries.op12_merkle(spark, str(tmp_path)).collect()]


ODD = [
    {"doc_id": 5, "text": None, "lang": None, "source": None, "n_chars": None}, {"doc_id": None, "text": "a\nb", "lang": "en", "source": None, "n_chars": 3},
    {"doc_id": 7, "text": "", "lang": "", "source": "", "n_chars": 0}, *[{"doc_id": 8, "text": "x\n\ny", "lang": "de", "source": "é", "n_chars": 4}] * 4,
    {"doc_id": 8, "text": "other", "lang": "de", "source": "é", "n_chars": 4}, {"doc_id": -3, "text": "long\n" * 50_000, "lang": "fr", "source": "z", "n_chars": 250_000},
]


@pytest.mark.parametrize("rows", [rows_of(1, lambda i: "a"), rows_of(30, lambda i: f"s{i}"), rows_of(900, lambda i: "hot" if i % 3 else None), rows_of(2300, lambda i: f"s{i % 2 * (i % 11)}"), ODD], ids=["one", "many sources", "hot source", "two rounds of levels", "odd rows"])
def test_merkle_equals_plain(spark, tmp_path, rows):
    assert sorted(merkle_rows(spark, tmp_path, rows), key=str) == sorted(plain(rows), key=str)


def test_merkle_of_nothing_and_of_clashing_columns(spark, tmp_path):
    assert merkle_rows(spark, tmp_path / "none", []) == []
    rows = [r | {"leaf": "x", "_id": 1, "digest": "d", "tree": 2, "level": 3} for r in rows_of(40, lambda i: f"s{i % 3}")]
    found = merkle_rows(spark, tmp_path / "clash", rows, KIND + ", leaf string, _id int, digest string, tree int, level int")
    assert sorted(found, key=str) == sorted(plain(rows), key=str)


def test_shuffled_jumps_equal_broadcast_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST", 0)
    rows = rows_of(300, lambda i: f"s{i % 3}")
    assert sorted(merkle_rows(spark, tmp_path, rows), key=str) == sorted(plain(rows), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_merkle_equals_sql(spark):
    same(spark, duck(SF), SF, queries.op12_merkle, queries.oracle_sql()["op12_merkle"])


# -- sharding


def ring_walk(keys: list[int], places: list[int], owner: list[int], most: list[int]) -> list[int]:
    """The shard of each key, given in ring order: in turn k, arc by arc, the rest goes to the k-th shard clockwise."""
    arcs = [next((a for a, p in enumerate(places) if p >= k), len(places)) for k in keys]
    shard, room = [None] * len(keys), list(most)
    for turn in range(len(most)):
        for i, a in enumerate(arcs):
            if shard[i] is None:
                seen = []
                for j in range(len(owner)):
                    if (s := owner[(a + j) % len(owner)]) not in seen:
                        seen.append(s)
                if room[seen[turn]]:
                    shard[i], room[seen[turn]] = seen[turn], room[seen[turn]] - 1
    return shard


@pytest.mark.parametrize("ids", [range(500), [7] * 200 + list(range(300)), [None] * 20 + [1, 2, 3]], ids=["distinct", "hot key", "null keys"])
def test_placed_equals_ring_walk(spark, ids):
    rows = [(k, None if i % 10 == 0 else f"tëxt {i % 3}" * (i % 4), "c") for i, k in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    found = sharding.placed(docs, 5, points=8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _ in rows)
    hashed = {r[0]: r[1] for r in docs.selectExpr("doc_id", "xxhash64(cast(doc_id as string))").distinct().collect()}
    ordered = sorted(found, key=lambda r: (hashed[r.doc_id], r.text_crc32, r.size))
    places, owner = sharding.ring(5, 8)
    walked = ring_walk([hashed[r.doc_id] for r in ordered], places.tolist(), owner.tolist(), sharding.bounds(len(rows), 5))
    row = lambda r, s: (r.doc_id, r.size, r.text_crc32, s)
    assert Counter(row(r, r.shard) for r in found) == Counter(row(r, s) for r, s in zip(ordered, walked))
    counts = Counter(r.shard for r in found)
    assert max(counts.values()) - min(counts.values() if len(counts) == 5 else [0]) <= 1
    for s in counts:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(counts[s]))


def test_sharding_of_nothing_of_few_and_of_odd_rows(spark):
    empty = spark.createDataFrame([], KIND)
    assert sharding.placed(empty, 16).collect() == []
    few = sharding.placed(spark.createDataFrame([(1, "a"), (2, "b\0" * 1_000_000)], "doc_id long, text string"), 16).collect()
    assert len({r.shard for r in few}) == 2 and {r.slot for r in few} == {0} and {r["size"] for r in few} == {2, 2_000_001}


def test_one_more_shard_moves_little(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    moved, n = sharding.moved(docs, 16).first()
    assert n == 20_000 and n / 17 <= moved <= 2 * n / 17
    moved, _ = sharding.moved(docs, 16, slack=0.25).first()
    assert n / 20 <= moved <= 1.1 * n / 17


def test_written_shards_hold_every_row_once(spark):
    docs = spark.createDataFrame([(i, f"t{i}", i % 3, "x") for i in range(1000)], "doc_id long, text string, size int, slot string")
    folder = sharding.write(docs, 4, each=100)
    back = spark.read.parquet(folder)
    assert sorted((r.doc_id, r.text, r.size_, r.slot_) for r in back.collect()) == sorted(tuple(r) for r in docs.collect())
    assert [r[1] for r in back.groupBy("shard").count().orderBy("shard").collect()] == [250] * 4
