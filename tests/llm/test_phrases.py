"""Phrases against plain counting, the index against string search."""

from __future__ import annotations

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import duck, same

from sessionloom.llm import fmindex, phrases, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, share=80, top=None):
    """rows: (lang, text)."""
    counts, out = {}, []
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            for k in range(1, 5):
                counts.setdefault(lang or "und", Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        n, found = sum(c for p, c in f.items() if len(p) == 1), []
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], n, score))
        out += [(lang, i + 1, x[2].decode(), *x[3:]) for i, x in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(spark, rows, **kinds):
    docs = spark.createDataFrame([(i % 7 or None, t, lang, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, hi string, shard int").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(docs, **kinds).collect())


def test_index_extends_like_string_search():
    r = np.random.default_rng(1)
    text = np.append(np.append(0, r.integers(0, 5, 400)), 0).astype(np.int32)
    index = fmindex.Index.of(text)
    count = lambda p: sum(tuple(text[i : i + len(p)]) == p for i in range(len(text)))
    now = [((int(w),), index.single[np.array([i])]) for i, w in enumerate(index.ids)]
    for side in ("left", "right", "left"):
        longer = []
        for p, at in now:
            assert at.size[0] == count(p)
            _, words, found = getattr(index, side)(at)
            assert len(words) == sum(count((w, *p) if side == "left" else (*p, w)) > 0 for w in range(1, 5))
            longer += [((int(w), *p) if side == "left" else (*p, int(w)), found[np.array([i])]) for i, w in enumerate(words)]
        now = longer
    assert all(at.size[0] == count(p) and len(p) == 4 for p, at in now)


def test_phrases_equal_plain_counts(spark):
    r = random.Random(3)
    words = ["the", "a", "New", "york", "CITY", "é x", "of", "\x00", "naïve", "x-y"]
    weights = [30, 20, 9, 9, 9, 4, 20, 2, 3, 1]
    texts = [" ".join(w + r.choice(["", "", "", ",", ".", "\t", "\n", " \r\v ", "?"]) for w in r.choices(words, weights, k=r.randint(0, 60))) for _ in range(150)]
    rows = [(r.choice(["en", "en", "en", None, "und", "de"]), t) for t in texts] + [("en", texts[0])] * 40 + [("en", None), (None, ""), ("fr", " ,;. "), ("es", "uno dos")]
    for kinds in ({"least": 5}, {"least": 2, "shard": 64}, {"least": 30, "top": 3}):
        assert mined(spark, rows, **kinds) == plain(rows, kinds["least"], top=kinds.get("top"))


def test_long_pieces_go_on_in_further_shards(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 40)
    monkeypatch.setattr(phrases, "RANGE", 50)
    r = random.Random(5)
    rows = [("en", " ".join(r.choices("a b c d".split(), k=2000))), ("en", "a b c d " * 300), ("de", "x" * 5000 + " y z")]
    assert mined(spark, rows, least=3, shard=50) == plain(rows, 3)


def test_phrases_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", "one two")]) == [] and mined(spark, [("en", "...")] * 40) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_phrases_equal_sql(spark):
    same(spark, duck(SF), SF, queries.op11_phrases, queries.oracle_sql()["op11_phrases"])
