"""Each training-data operator against a brute-force version, and on nulls, empty and repeated rows, ties and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import bpe, html, language, neardup, neighbours, packing, quality, simhash, suffixes, tokenfile, warc
from sessionloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, id long, g string, spans string, _text string, _i string, _h string, over string, fp string"


def docs(spark, rows, parts=3):
    """documents with extra columns whose names clash with internal ones."""
    full = [(i, t, "en", s, 7, "x", "y", "z", "i", "h", "o", "f") for i, t, s in ((*r, "src")[:3] for r in rows)]
    return spark.createDataFrame(full, DOCS).repartition(parts)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(30, 160))) + "." for _ in range(15)]
    rows = []
    for i in range(90):
        b = rnd.choice(base).split(" ")
        for _ in range(rnd.randint(0, 5)):
            b[rnd.randrange(len(b))] = rnd.choice(words)
        rows.append((i, " ".join(b)))
    odd = [None, "", " ", "a", "ab " * 300, "x" * 5000, base[0], base[0], "one line\n" * 40, "<|endoftext|> it's 12 §§ 漢字"]
    return rows + [(100 + k, t) for k, t in enumerate(odd)] + [(None, base[1]), (100, "again"), (3, rows[3][1])]


# -- 1 neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:90] = x[50]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(400, None), (420, [0.0] * 16), (440, [float("nan")] * 16), (460, [None] * 16), (480, [1.0, 2.0]), (None, [1.0] * 16), rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=5, query_block=7, candidate_block=64).collect()
    d = x.astype(np.float64)
    for q in range(0, 300, 20):
        s = np.zeros(300)  # summed from the first component to the last
        for k in range(16):
            s += d[q, k] * d[:, k]
        want = sorted((-s[i], i) for i in range(300) if i != q)[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(v, -w) for _, v, w in mine] == [(i, w) for w, i in want]
    assert {r["query_id"] for r in got} == set(range(0, 300, 20))
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(20, 33)) * 10, rng.normal(size=(50, 33))
    found = neighbours.tile(np.arange(20), q, np.arange(50) + 100, c, 50)
    assert sum(len(i) for _, i, _ in found) == 1000
    top = neighbours.tile(np.arange(20), q, np.arange(50) + 100, c, 3)
    for (r, ids, s), (_, _, every) in zip(top, found, strict=True):
        assert len(ids) == 3 and np.array_equal(s, every[:3]), r


# -- 2 packing


def test_best_fit_decreasing_is_tightest():
    rnd = random.Random(1)
    for cap in (5, 64, 2048):
        lengths = [rnd.randint(1, cap) for _ in range(500)]
        window, offset, fill = packing.best_fit_decreasing(lengths, cap)
        left: list[int] = []
        for i in sorted(range(500), key=lambda i: -lengths[i]):
            fits = [w for w in range(len(left)) if left[w] >= lengths[i]]
            tight = min((left[w] for w in fits), default=None)
            if tight is None:
                left.append(cap)
                assert window[i] == len(left) - 1
            else:
                assert left[window[i]] == tight
            assert offset[i] == cap - left[window[i]]
            left[window[i]] -= lengths[i]
        assert fill == [cap - x for x in left]


def test_packing_holds_every_id_once(spark, corpus):
    path = bpe.vocabulary("byte_bpe_50k.json")
    got = packing.pack(docs(spark, corpus), path, capacity=64, group_tokens=3000).collect()
    enc = bpe.encoder(path)
    whole: dict = {}
    for r in got:
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    want = [(i, np.array([*enc.whole(t or ""), 1], "<u4").tobytes()) for i, t in corpus]
    for i, ids in want:
        own = sorted(whole[(i, len(ids) // 4)], key=lambda r: r["start"])
        assert any(ids == b"".join(bytes(r["ids"]) for r in rows) for rows in ([own] if len({r["start"] for r in own}) == len(own) else [own[k::2] for k in range(2)])) or i in (3, 100)
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append(r)
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == rows[0]["sequence_tokens"] <= 64
        assert rows[0]["sequence_length"] in (64, at)
    assert sum(r["length"] for r in got) == sum(len(ids) // 4 for _, ids in want)
    assert packing.pack(docs(spark, []), path).count() == 0


@pytest.mark.parametrize(("parts", "most"), [(1, 0.005), (8, 0.03)])
def test_packing_has_little_padding(spark, parts, most):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(("alpha", "beta", "gamma", "delta")) for _ in range(int(2 ** rnd.uniform(2, 11))))) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(parts)
    got = packing.pack(df, bpe.vocabulary("byte_bpe_50k.json")).select("sequence_id", "sequence_tokens", "sequence_length").distinct().collect()
    assert sum(r["sequence_length"] - r["sequence_tokens"] for r in got) <= most * sum(r["sequence_length"] for r in got)


# -- 3 WARC


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 1200
    rows = [(1, "u1", big), (2, "u2", big), (5, "u\n5", big), (3, "u3", None), (4, None, ""), (6, "u6", "short\r\n\r\nWARC/1.1\r\n"), (7, "u7", "short\r\n\r\nWARC/1.1\r\n"), (None, "n", big), (5, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive(pages).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    digest = hashlib.sha1(big.encode()).hexdigest()
    for i in (1, 2, None):
        (r,) = by[i]
        assert (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) == ("revisit", 5, len(big.encode()), digest)
    assert sorted((r["record_type"], r["refers_to"]) for r in by[5]) == [("response", None), ("revisit", 5)]
    for i, t in ((3, ""), (4, ""), (6, rows[5][2]), (7, rows[5][2])):
        (r,) = by[i]
        assert (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) == ("response", None, len(t.encode()), hashlib.sha1(t.encode()).hexdigest())
    assert warc.archive(pages.limit(0)).count() == 0


def other_reader(data: bytes) -> list[tuple[dict, bytes]]:
    """Records of an archive, member by member, with the header parser of mail."""
    import email
    import zlib as z

    out = []
    while data:
        one = z.decompressobj(31)
        whole = one.decompress(data) + one.flush()
        data = one.unused_data
        version, _, rest = whole.partition(b"\r\n")
        head, _, body = rest.partition(b"\r\n\r\n")
        assert version == b"WARC/1.1"
        fields = dict(email.message_from_bytes(head + b"\r\n\r\n").items())
        assert body[int(fields["Content-Length"]) :] == b"\r\n\r\n"
        out.append((fields, body[:-4]))
    return out


def test_archives_are_valid_for_another_reader(spark, tmp_path, monkeypatch):
    import base64
    import email
    import glob

    monkeypatch.setattr(warc, "new_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    huge = "<p>" + "long page \r\n\r\n" * 400_000
    rows = [(k, f"http://x/{k}", t, "d", "p", 3, "o") for k, t in enumerate(["<p>é" + "y" * 1500] * 3 + ["short", None, huge, huge])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, path string, at int, original string").repartition(2)
    got = {r.page_id: r for r in warc.archive(pages).collect()}
    assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {0: 2, 1: 2, 5: 6}
    for kind, most in (("raw", len(rows)), ("archive", len(rows))):
        read = [r for f in glob.glob(f"{tmp_path}/warc/{kind}/*.warc.gz") for r in other_reader(open(f, "rb").read())]
        assert len(read) == most and len({f["WARC-Record-ID"] for f, _ in read}) == most
        ids = {f["WARC-Record-ID"]: f for f, _ in read}
        for f, block in read:
            assert {"WARC-Type", "WARC-Date", "WARC-Target-URI", "Content-Type"} <= set(f) and f["Content-Type"] == "application/http;msgtype=response"
            status, _, rest = block.partition(b"\r\n")
            head, _, body = rest.partition(b"\r\n\r\n")
            assert status == b"HTTP/1.1 200 OK"
            size = int(email.message_from_bytes(head)["Content-Length"])
            if f["WARC-Type"] == "response":
                assert size == len(body) and base64.b32encode(hashlib.sha1(body).digest()).decode() == f["WARC-Payload-Digest"].removeprefix("sha1:")
                assert rows[int(f["WARC-Target-URI"].rpartition("/")[2])][2] in (body.decode(), None)
            else:
                first = ids[f["WARC-Refers-To"]]
                assert body == b"" and first["WARC-Type"] == "response" and first["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and first["WARC-Target-URI"] == f["WARC-Refers-To-Target-URI"]


def test_neighbours_and_pages_with_clashing_columns(spark):
    rows = [(k, [float(k), 1.0], k, "s", 0.5, 9) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, qb string, score double, rank int")
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 2), (20, 1, 29), (20, 2, 28)]


# -- 4 quality


def brute_counts(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark, corpus):
    got = quality.judge(docs(spark, corpus)).collect()
    mine = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got)
    want = sorted((i is None, i or 0, *brute_counts(t)) for i, t in corpus)
    assert mine == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(docs(spark, [])).count() == 0


def test_quality_line_frequency(spark):
    own = [" ".join(chr(97 + i // 10) + chr(97 + i % 10) + chr(97 + k) for k in range(25)) for i in range(60)]
    rows = [(i, f"Accept  our COOKIES {i % 10} please\n{own[i]}", "a") for i in range(60)]  # one boilerplate line
    rows += [(100 + i, f"accept our cookies 1 please\nfoo{chr(97 + i)} bar", "a") for i in range(5)]  # nothing else
    rows += [(200 + i, "copied text " + own[0] + "\nsecond line of it " + own[1], "a") for i in range(60)]  # equal texts count once
    rows += [(300, None, None), (301, f"accept our cookies 3 please\n{own[2]}", "b")]
    df = docs(spark, rows)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df, line_docs=20, line_share=0.0).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(5)) and all(kept[200 + i] for i in range(60)) and not kept[300] and kept[301]
    clean = {r["doc_id"]: r["text"] for r in quality.clean(df, line_docs=20, line_share=0.0).collect()}
    assert clean[7] == own[7] and clean[301].startswith("accept") and len(clean) == 121


def test_quality_counts_every_shared_line(spark):
    body = [" ".join(chr(97 + i // 10) + chr(97 + i % 10) + chr(97 + k) for k in range(25)) for i in range(60)]
    rows = []
    for n in (2, 4, 6):
        shared = [f"line {chr(97 + k)} of the menu" for k in range(n)]
        rows += [(100 * n + i, "\n".join([*shared, body[i], shared[0]]), f"host{n}") for i in range(60)]
        rows += [(100 * n + 60 + i, rows[-1][1], f"host{n}") for i in range(30)]  # copies of one of them
    df = docs(spark, rows)
    found = quality.frequent_lines(quality.profile(df), 20, 0.0).collect()
    assert sorted((r["_host"], r["n_docs"]) for r in found) == sorted(("hhost" + str(n), 60) for n in (2, 4, 6) for _ in range(n))
    assert {r["text"] for r in quality.clean(df, line_share=0.0).collect()} == set(body)


# -- 5 language


def test_language(spark):
    rnd = random.Random(4)
    sound = {"en": ["the", "th", "ing", "and", "er"], "fr": ["le", "eau", "é", "que", "ou"], "de": ["sch", "ung", "ei", "der", "ü"]}
    rows = [(i, " ".join("".join(rnd.choice(sound[k]) for _ in range(3)) for _ in range(40)), k) for i, k in enumerate(itertools.islice(itertools.cycle(sound), 240))]
    rows += [(900, None, "en"), (901, "12 34 !!", "fr"), (902, "", None), (903, "the and ing", None), (None, rows[0][1], "en")]
    df = spark.createDataFrame([(i, t, k, "s") for i, t, k in rows], "doc_id long, text string, lang string, score string")
    train = "doc_id % 5 <> 0"
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in language.identify(df, train=F.expr(train)).collect()}
    held = [i for i in range(240) if i % 5 == 0]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    none = language.identify(df.where("lang is null")).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language.identify(df.limit(0)).count() == 0


def brute_vector(text):
    """Bundled vector of a text, letter by letter."""
    codes, out = [32], np.zeros(language.DIM)
    for c in (text or "").lower():
        code = ord(c) if c.isalpha() else 32
        if code != 32 or codes[-1] != 32:
            codes.append(code)
    if codes == [32]:
        return None
    codes += [32] * (codes[-1] != 32)
    for k in range(len(codes) - 2):
        bound = np.ones(language.DIM)
        for place, code in enumerate(codes[k : k + 3]):
            bound *= np.roll(np.random.default_rng(code).integers(0, 2, language.DIM, dtype=np.int8) * 2.0 - 1, 2 - place)
        out += bound
    return out


def test_language_equals_brute_force(spark):
    rnd = random.Random(8)
    sound = {"en": ["the", "th", "ing", "and"], "fr": ["le", "eau", "é", "que"], "de": ["sch", "ung", "ei", "ü"]}
    rows = [(i, " ".join("".join(rnd.choice(sound[k] + ["a", "o"]) for _ in range(3)) for _ in range(rnd.randint(1, 12))), k) for i, k in enumerate(list(sound) * 15)]
    rows += [(90, None, None), (91, "", "en"), (92, "1 2", None), (93, "a", None), (94, rows[0][1], "fr"), (95, "the " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    total = {}
    for i, t, k in rows:
        if k and i % 3 and (v := brute_vector(t)) is not None:
            total[k] = total.get(k, 0) + v / np.linalg.norm(v)
    for r in language.identify(df, train=__import__("pyspark.sql.functions", fromlist=["expr"]).expr("doc_id % 3 <> 0")).collect():
        v = brute_vector(r["text"]) if r["doc_id"] != 95 else brute_vector("the " * 20_000)
        if v is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cos = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in sorted(total.items())}
        best = max(cos, key=cos.get)
        assert abs(r["score"] - max(0.0, min(1.0, cos[best]))) < 1e-5
        assert r["lang_pred"] == best or cos[best] - cos[r["lang_pred"]] < 1e-5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_language_of_held_out_documents(spark):
    from sessionloom.llm import queries

    found = queries.op5_language(spark, "/root/testdata/sf0.01").where("held_out and lang_pred <> 'und'")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").select("doc_id", "lang")
    right = [r["lang"] == r["lang_pred"] for r in found.join(truth, "doc_id").collect()]
    assert len(right) > 100 and np.mean(right) >= 0.98


# -- 6 suffixes


def brute_repeats(rows, least):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen, out = set(), {}
    for k in order:
        data = (rows[k][1] or "").encode()
        cut, fresh = np.zeros(len(data), bool), []
        for p in range(len(data) - least + 1):
            w = data[p : p + least]
            if w in seen:
                cut[p : p + least] = True
            seen.add(w)
        left = bytes(np.frombuffer(data, np.uint8)[~cut]) if len(data) else b""
        runs = int((np.diff(np.concatenate(([0], cut.astype(int)))) == 1).sum())
        out.setdefault(rows[k][0], []).append((len(data), int(cut.sum()), runs, hashlib.sha256(left).hexdigest()))
        del fresh
    return out


@pytest.mark.parametrize(("least", "gram"), [(100, 32), (25, 7)])
def test_suffixes(spark, corpus, least, gram):
    rows = [r for r in corpus if r[0] != 100] + [(500, "ab" * 400), (501, "é" * 200)]
    got: dict = {}
    for r in suffixes.remove_repeats(docs(spark, rows), least, gram).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    want = brute_repeats(rows, least)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert suffixes.remove_repeats(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("least", "gram"), [(100, 32), (25, 7)])
def test_suffixes_of_hot_anchors(spark, corpus, monkeypatch, least, gram):
    monkeypatch.setattr(suffixes, "HOT", 0)
    monkeypatch.setattr(suffixes, "BUCKET", 50)
    test_suffixes(spark, corpus, least, gram)


def test_a_string_with_many_surroundings_fills_no_bucket(spark, monkeypatch):
    rng = np.random.default_rng(3)
    noise = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    seed = noise(400_000)
    g, _, _, _, anchor = suffixes.segments(seed.encode(), 100, 32)
    common = seed[int(anchor[g.argmin()]) :][:32]  # the anchor of nearly all windows that hold it
    passage = noise(40) + common + noise(60)
    rows = [(k, noise(100) + (passage if k % 500 == 0 else common) + noise(100)) for k in range(6000)]
    seen = []
    whole = suffixes.suffix_runs

    def watched(*args):
        seen.append(whole(*args))
        return seen[-1]

    monkeypatch.setattr(suffixes, "suffix_runs", watched)
    monkeypatch.setattr(suffixes, "BUCKET", 1000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs(spark, rows)).collect()}
    assert got == {k: v[0] for k, v in brute_repeats(rows, 100).items()}
    assert sum(x[1] for x in got.values()) >= 11 * 132
    held = seen[0].groupBy("bucket").agg(F.sum(F.octet_length("rows") / 40).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert held[1] >= 6000 and held[0] <= 3000


def test_suffix_cut_keeps_columns(spark):
    passage = " ".join(f"pas{k}" for k in range(40))
    df = docs(spark, [(1, "alpha " + passage), (2, passage + " omega"), (3, None)])
    got = {r["doc_id"]: r for r in suffixes.cut_repeats(df).collect()}
    assert got[1]["text"] == "alpha " + passage and got[2]["text"].strip() == "omega" and got[3]["text"] is None
    assert got[2]["spans"] == "y" and got[2]["id"] == 7


def test_loser_tree_merges_and_counts_prefixes():
    rnd = random.Random(9)
    for _ in range(100):
        runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(1, 7))]
        got = [*suffixes.merge([suffixes.front_coded(r) for r in runs])]
        assert [s for _, s, _ in got] == sorted(sum(runs, []))
        assert all(n == suffixes.shared(a, b) for (_, a, _), (_, b, n) in itertools.pairwise(got))


# -- 7 token files


def test_token_files(spark, corpus):
    path = bpe.vocabulary("word_bpe_49k.json")
    enc = bpe.encoder(path)
    manifest = tokenfile.write(docs(spark, corpus), path)
    got = tokenfile.read(manifest).orderBy("start").collect()
    at, ids = 0, [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    want = sorted(np.array([*enc.whole(t or ""), 1], "<u4").tobytes() for _, t in corpus)
    assert sorted(bytes(r["ids"]) for r in got) == want
    few = {r["doc_id"]: bytes(r["ids"]) for r in tokenfile.lookup(manifest, spark.createDataFrame([(5,), (105,), (77777,)], "doc_id long")).collect()}
    assert few == {i: np.array([*enc.whole(dict(corpus)[i]), 1], "<u4").tobytes() for i in (5, 105)}
    assert tokenfile.read(tokenfile.write(docs(spark, []), path)).count() == 0


def test_token_frames_are_independent_and_checked(tmp_path):
    uri = f"file://{tmp_path}/a.tok.zst"
    w = tokenfile.ShardWriter(uri)
    many = {i: np.arange(i * 1000, dtype="<u4").tobytes() for i in range(200)}
    for i, ids in many.items():
        w.add(i, ids)
    w.close()
    r = tokenfile.ShardReader(uri)
    assert {k: v for k, _, v in r.documents({3, 150})} == {3: many[3], 150: many[150]}
    assert r.read_frames < 6 < len(r.checks)
    import zstandard

    with open(f"{tmp_path}/a.tok.zst", "rb") as f:  # any zstandard reader can read all frames
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(many.values())
    data = bytearray(open(f"{tmp_path}/a.tok.zst", "rb").read())
    data[-9 - 1] ^= 1  # a checksum
    open(f"{tmp_path}/a.tok.zst", "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        list(tokenfile.ShardReader(uri).documents())


# -- 8 HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></ul></nav>
<div class="ad">Buy this, now.</div><article><h1>Head &amp; more {i}</h1><p><b>First paragraph, quite long and full of words {i}.</b><br>
 Second   line of it. And it goes on, as texts do, for a while.<p>Another one: a &lt; b, and that is that. Words and words.</p><aside class="promo">Read also this</aside></article>
<footer>&copy; me {i}</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"u{i}", PAGE.format(i=i)) for i in range(40)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "just text"), (103, "u", "<article><p>Cut off, but still the main text here"), (None, "u", PAGE.format(i=1))]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(40):
        assert got[i]["text"] == f"Head & more {i} First paragraph, quite long and full of words {i}. Second line of it. And it goes on, as texts do, for a while. Another one: a < b, and that is that. Words and words."
        assert got[i]["n_chars"] == len(got[i]["text"]) and got[i]["url"] == f"u{i}"
    assert all(got[i]["text"] == "" for i in (100, 101)) and got[102]["text"] == "just text" and "Cut off" in got[103]["text"] and got[None]["text"] == got[1]["text"]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_decoding_has_no_contradictions():
    rnd = random.Random(6)
    for _ in range(300):
        n = rnd.randint(1, 9)
        parent = [-1] + [rnd.randrange(k) for k in range(1, n)]
        odds, own = [rnd.uniform(-3, 3) for _ in range(n)], [float(rnd.randint(0, 50)) for _ in range(n)]
        w = [o * (0.25 + np.log1p(t)) for o, t in zip(odds, own, strict=True)]
        best = -1e9
        for s in itertools.product(range(3), repeat=n):
            ok = s[0] < 2 and all(s[k] >= s[parent[k]] and not (s[parent[k]] == 0 and s[k] == 2) for k in range(1, n))
            if ok:
                v = sum(x if s[k] == 1 else -x for k, x in enumerate(w))
                v -= html.ENTER * ((s[0] == 1) + sum(s[k] == 1 and s[parent[k]] == 0 for k in range(1, n))) + html.CUT * sum(s[k] == 2 and s[parent[k]] == 1 for k in range(1, n))
                best = max(best, v)
        keep = html.decode(parent, odds, own)
        state = [0] * n
        for k in range(n):
            up = state[parent[k]] if k else 0
            state[k] = 1 if keep[k] else (2 if up else 0)
        v = sum(x if state[k] == 1 else -x for k, x in enumerate(w))
        v -= html.ENTER * ((state[0] == 1) + sum(state[k] == 1 and state[parent[k]] == 0 for k in range(1, n))) + html.CUT * sum(state[k] == 2 and state[parent[k]] == 1 for k in range(1, n))
        assert abs(v - best) < 1e-9


def paged(k, shape):
    """A page of host k % 3 whose parts are named by `shape`: (menu, body, foot) tags."""
    rnd = random.Random(k)
    said = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(25)) + "." for _ in range(5)]
    menu = "".join(f"<li><a href='/{x}'>{x} page</a></li>" for x in ("home", "news", "about", "contact"))
    a, b, c = shape
    return f"<html><body><{a}><ul>{menu}</ul></{a}><{b}>" + "".join(f"<p>{x}</p>" for x in said) + f"</{b}><{c}><p>All words on this page belong to the owners of host {k % 3}.</p></{c}></body></html>", " ".join(said)


def test_html_without_sectioning_elements():
    pages = [paged(k, ("div", "div", "div")) for k in range(60)]
    model = html.Extractor([h for h, _ in pages])
    assert np.mean([t == want for t, (_, want) in zip(model.texts([h for h, _ in pages]), pages, strict=True)]) >= 0.9
    assert model.texts(["just text", "a <b>bold</b> word", "", None, "5 < 6"]) == ["just text", "a bold word", "", "", "5 < 6"]
    named = [paged(k, ("nav", "article", "footer")) for k in range(60)]
    model = html.Extractor([h for h, _ in named])
    assert model.texts([h for h, _ in named]) == [want for _, want in named]
    assert np.mean([t == want for t, (_, want) in zip(model.texts([h for h, _ in pages]), pages, strict=True)]) >= 0.9


@pytest.mark.parametrize("bad", ["<a ", '<a "', "<a '\">", "<![CDATA[x>", "<!--", "<", "<b>", "</x>", "&#"])
def test_html_reader_is_linear(bad):
    import time

    started = time.time()
    html.Page(bad * (1_000_000 // len(bad)))
    html.Page("<p><div>" + "<b>" * 100_000 + bad * 100_000 + "<hr></x>" * 50_000)
    assert time.time() - started < 20


def test_html_broken_quotes_and_clashing_columns(spark):
    page = "<article><p class=\"x>first words</p><p>second words here</p></article><p title='never closed>tail"
    assert "second words here" in html.Page(page).text([True] * 10)
    rows = [(1, page, "t", "n", 5), (1, page, "t", "n", 5), (2, None, None, None, None), (None, "", "t", "n", 1), (3, "<p>long</p>" * 50_000, "t", "n", 1)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, _html string, n_chars long").withColumn("url", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("u"))
    got = html.extract(df).collect()
    assert len(got) == 5 and sorted({r["page_id"] for r in got}, key=str) == [1, 2, 3, None] and all(r["n_chars"] == len(r["text"]) for r in got)


# -- 9 SimHash


def brute_fingerprint(text, width):
    import xxhash

    words = __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash(spark, corpus):
    got = simhash.classes(docs(spark, corpus)).collect()
    rows = [(i, brute_fingerprint(t, 4)) for i, t in corpus]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 4 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    want = sorted((str(i), f"{f:016x}", str(least[group[k]])) for k, (i, f) in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    assert simhash.classes(docs(spark, [])).count() == 0


def test_bit_sliced_distances():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 2**63, 150, dtype=np.uint64)
    b = np.concatenate([a[:70] ^ (np.uint64(1) << rng.integers(0, 63, 70).astype(np.uint64)), rng.integers(0, 2**63, 67, dtype=np.uint64)])
    d = np.bitwise_count(a[:, None] ^ b[None, :])
    for radius in (0, 4, 12, 15):
        q, c = simhash.within(a, b, radius)
        assert sorted(zip(q.tolist(), c.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(d <= radius)), strict=True))


@pytest.mark.parametrize("block", [4, 2048])
def test_links_of_large_buckets(spark, block):
    rng = np.random.default_rng(1)
    fps = {int(x) for x in np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64))}
    fps |= {int(x) for x in rng.integers(0, 2**62, 30)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = [(r["a"], r["b"]) for r in simhash.links(df, 4, block=block).collect()]

    def classes(pairs):
        root = {f: f for f in fps}
        for a, b in pairs:
            ra, rb = root[a], root[b]
            root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
        return root

    assert classes(found) == classes([(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4])


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 103), (103, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100} or got == {k: 0 for k in range(1, 41)} | {101: 100, 103: 100}


def test_near_dedup(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    rows, want = [], set()
    for k in range(25):
        base = rnd.sample(words, 200)
        rows.append((10 * k, " ".join(base)))
        want.add(10 * k)
        near = base[:]
        near[rnd.randrange(5, 195)] = "changed"  # one word of 200: similarity about 0.95
        rows.append((10 * k + 1, " ".join(near)))
        far = base[:100] + rnd.sample(words, 100)
        rows.append((10 * k + 2, " ".join(far)))
        want.add(10 * k + 2)
    rows += [(900, None), (901, ""), (902, "Two words"), (903, "two WORDS"), (10, rows[3][1])]
    got = [r["doc_id"] for r in neardup.near_dedup(docs(spark, rows)).collect()]
    assert sorted(got) == sorted(want | {900, 902}), set(got) ^ (want | {900, 902})
    assert neardup.near_dedup(docs(spark, [])).count() == 0


def test_near_dedup_of_texts_with_a_template(spark):
    rnd = random.Random(5)
    made = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(n)]
    template, rows = made(140), []
    for k in range(120):
        base = template + made(60)  # similarity about 0.54 among each other
        near = base[:]
        for p in (150, 160, 170, 180):  # up to 20 of 196 shingles change: about 0.82
            near[p] = "changed" + near[p]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in rows]
    alike = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert alike == {(2 * k, 2 * k + 1) for k in range(120)}
    assert sorted(r["doc_id"] for r in neardup.near_dedup(docs(spark, rows)).collect()) == [2 * k for k in range(120)]


def groups_of(texts):
    """Group of each text by brute force: the smallest row that is linked at a Jaccard similarity of 0.8."""
    sets, group = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
            lo, hi = sorted((group[a], group[b]))
            group = [lo if g == hi else g for g in group]
    return group


@pytest.mark.parametrize("block", [16, 2048])
def test_near_dedup_of_families(spark, block):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]

    def varied(base, most):
        out = base[:]
        for p in rnd.sample(range(len(base)), rnd.randint(0, most)):
            out[p] = rnd.choice(words)
        return " ".join(out)

    texts = [varied(base, 8) for base in [[rnd.choice(words) for _ in range(200)] for _ in range(30)] for _ in range(6)]
    one = [rnd.choice(words) for _ in range(120)]
    texts += [varied(one, 8) for _ in range(150)]  # a large family, of which few are alike
    order = rnd.sample(range(len(texts)), len(texts))
    texts = [texts[k] for k in order]
    group = groups_of(texts)
    got = neardup.near_dedup(docs(spark, list(enumerate(texts))), block=block).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(group))
    assert {r["over"] for r in got} == {"o"}


# -- 10 BPE


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    enc = bpe.Encoder(bpe.vocabulary(name))
    rnd = random.Random(3)
    parts = ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "  ", "\n\n", " \n", "the", "Größe", "naïve", "…", "²³", "...", ",.", "\x85", "\x1c", "ſ", "İ", "ﬁ", "Σς", "é", "漢字", "😀", "0123", "don't", "a_b", " "]
    for _ in range(1500):
        s = "".join(rnd.choice(parts) if rnd.random() < 0.4 else rnd.choice("abcdETAO  .,!?'-\n\t1é") for _ in range(rnd.randint(0, 50)))
        assert enc.encode(s) == np.array(enc.whole(s), "<u4").tobytes(), s


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tree_concatenation(name):
    enc, rnd = bpe.Encoder(bpe.vocabulary(name)), random.Random(5)
    for alphabet in ("abcdefgh", "ab!'s1é漢", "'s", "a", "!'s ", "ab \n"):
        s = "".join(rnd.choice(alphabet) for _ in range(6000))
        whole = np.array(enc.whole(s), "<u4").tobytes()
        assert np.array(bpe.tree_piece(enc, s), "<u4").tobytes() == whole
        for size in (37, 1000) if len(s) < 7000 else (1000,):
            leaves = [s[k : k + size] for k in range(0, len(s), size)]
            assert bpe.tree(enc, [(x, enc.encode(x)) for x in leaves]) == whole


def test_encode_decode(spark, corpus):
    path = bpe.vocabulary("word_bpe_49k.json")
    enc = bpe.encoder(path)
    rows = [*corpus, (600, "word " * 30_000), (601, "longunbroken" * 9_000)]
    got = sorted((str(r["doc_id"]), bytes(r["ids"]), r["decoded"]) for r in bpe.encode_decode(docs(spark, rows), path).collect())
    want = []
    for i, t in rows:
        ids = enc.whole(t or "")
        want.append((str(i), np.array(ids, "<u4").tobytes(), enc.tokenizer.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert zlib.crc32(got[0][1]) >= 0
    assert bpe.encode_decode(docs(spark, []), path).count() == 0
