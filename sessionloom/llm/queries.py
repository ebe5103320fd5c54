"""Queries over the driver's tables, one per operator, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, language, merkle, neighbours, packing, phrases, quality, sharding, simhash, suffixes, tokenfile, warc
from .common import table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), bpe.vocabulary(BYTE_BPE)))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = language.identify(docs, train=~held_out, keep=["doc_id", "text"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op7_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write(table(spark, sf_dir, "documents"), bpe.vocabulary(WORD_BPE))
    return tokenfile.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"), width=4, radius=4)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), bpe.vocabulary(WORD_BPE)))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, share=80, top=2000)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    without = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claim = merkle.leaf_hash([*map(F.col, fields[:-1]), without])
    proofs = merkle.manifest(table(spark, sf_dir, "documents"), fields, keep={"claim": F.unhex(claim)})
    folded = proofs.withColumn("folded_root", merkle.fold(merkle.hexed(F.col("claim")), F.col("turns"), F.col("siblings")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.hexed(F.col("siblings")).cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.placed(table(spark, sf_dir, "documents"), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_neighbours, op2_packing, op3_warc, op4_quality, op5_language, op6_suffixes, op7_tokenfile, op8_html, op9_simhash, op10_bpe, op11_phrases, op12_merkle, op13_sharding, pipeline)}


_OP1 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP3 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
t AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM d LEFT JOIN t USING (payload_digest)
"""

# The limits of quality.judge: 20 documents, 0.5 % of the host's, 20 words and 30 % left.
_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, p, list_aggregate(ws[p:p+7], 'string_agg', ' ') AS win
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS p FROM w WHERE len(ws) >= 8)),
dup AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - p, 8)))::BIGINT AS n
        FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM dup) GROUP BY r),
base AS (SELECT w.r, doc_id, host, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
l AS (SELECT r, host, ('0x' || substr(md5(trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ')), 1, 15))::BIGINT AS h,
        len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
      FROM (SELECT r, host, unnest(ls) AS line FROM w)),
c AS (SELECT l.host, h, count(DISTINCT d.t) AS n_docs FROM l JOIN d USING (r) GROUP BY 1, 2),
hosts AS (SELECT host, count(DISTINCT t) AS host_docs FROM d GROUP BY 1),
f AS (SELECT host, h FROM c JOIN hosts USING (host) WHERE n_docs > 20 AND n_docs > host_docs * 0.005),
gone AS (SELECT r, sum(n) AS gone FROM l JOIN f USING (host, h) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (gone IS NOT NULL AND (n_words - gone < 20 OR n_words - gone < 0.3 * n_words)) AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base) LEFT JOIN gone USING (r)
"""


_OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, (2 * i + 1)::INT, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM d WHERE length(x) >= 200)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN b IS NULL OR i > b + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM r)),
s AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY doc_id, k),
e AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS cut FROM s),
p AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, (2 * cut + 1)::INT, (2 * (lo - cut))::INT), '' ORDER BY lo) || substr(any_value(x), (2 * max(hi) + 1)::INT) AS kept
      FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id)
"""


_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws
      FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
w AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 30),
cut AS (SELECT lang, phrase, a, ws, unnest(range(1, k)) AS j, k FROM c),
s AS (SELECT cut.*, l.a AS l, r.a AS r, (2000000::HUGEINT * cut.a // (l.a + r.a))::BIGINT AS score
      FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(ws[1:j], ' ') AND l.k = j JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(ws[j + 1:cut.k], ' ') AND r.k = cut.k - j),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
x AS (SELECT DISTINCT c.lang, c.phrase FROM (SELECT lang, k, a, ws, unnest([2, 3]) AS size FROM c) q, unnest(range(1, q.k - q.size + 2)) AS o(i)
      JOIN c ON c.lang = q.lang AND c.k = q.size AND c.phrase = array_to_string(q.ws[i:i + q.size - 1], ' ') WHERE q.k > q.size AND 100::HUGEINT * q.a >= 80::HUGEINT * c.a),
k AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, encode(m.phrase)) AS rank FROM m ANTI JOIN x ON m.lang = x.lang AND m.phrase = x.phrase)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang) WHERE rank <= 2000
"""

# CRC-32 of the decimal id, bit by bit; runs of three, level by level; then the climb of every leaf.
_OP12 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, *, CASE WHEN doc_id IS NULL THEN NULL ELSE list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)) END AS bytes FROM documents),
crc AS (SELECT r, bytes, 0::BIGINT AS step, 4294967295::BIGINT AS c FROM d WHERE bytes IS NOT NULL
        UNION ALL
        SELECT r, bytes, step + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
        FROM (SELECT r, bytes, step, CASE WHEN step % 8 = 0 THEN xor(c, bytes[(step // 8 + 1)::INT]::BIGINT) ELSE c END AS x FROM crc WHERE step < 8 * len(bytes))),
t AS (SELECT r, xor(c, 4294967295) % 2 = 0 AS tampered FROM crc WHERE step = 8 * len(bytes)),
h AS (SELECT d.r, doc_id, source,
        CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
        || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
        text, CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS changed FROM d LEFT JOIN t USING (r)),
l AS (SELECT r, doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
        sha256(head || CASE WHEN changed IS NULL THEN '-' ELSE strlen(changed) || ':' || changed END) AS claim FROM h),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS tree FROM (SELECT DISTINCT source FROM l)),
p AS (SELECT r, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf, claim FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source),
n AS (SELECT tree, 0 AS level, i, leaf AS x, count(*) OVER (PARTITION BY tree) AS m FROM p
      UNION ALL
      SELECT tree, level + 1, i // 3, sha256(string_agg(x, '' ORDER BY i)), any_value((m + 2) // 3) FROM n WHERE m > 1 GROUP BY tree, level, i // 3),
u AS (SELECT 0 AS level, tree - 1 AS i, x, count(*) OVER () AS m FROM n WHERE m = 1
      UNION ALL
      SELECT level + 1, i // 3, sha256(string_agg(x, '' ORDER BY i)), any_value((m + 2) // 3) FROM u WHERE m > 1 GROUP BY level, i // 3),
nodes AS (SELECT tree, level, i, x, m FROM n UNION ALL SELECT 0, level, i, x, m FROM u),
runs AS (SELECT a.tree, a.level, a.i, a.m, coalesce(string_agg(b.x, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lo, coalesce(string_agg(b.x, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS hi
         FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.i // 3 = b.i // 3 GROUP BY ALL),
climb AS (SELECT r, tree, tree AS own, 0 AS level, i, claim AS x, '' AS proof FROM p
          UNION ALL
          SELECT c.r, CASE WHEN g.m = 1 THEN 0 ELSE c.tree END, c.own, CASE WHEN g.m = 1 THEN 0 ELSE c.level + 1 END, CASE WHEN g.m = 1 THEN c.own - 1 ELSE c.i // 3 END,
                 CASE WHEN g.m = 1 THEN c.x ELSE sha256(g.lo || c.x || g.hi) END, CASE WHEN g.m = 1 THEN c.proof ELSE c.proof || g.lo || g.hi END
          FROM climb c JOIN runs g USING (tree, level, i) WHERE NOT (g.tree = 0 AND g.m = 1)),
e AS (SELECT c.r, c.x, c.proof FROM climb c JOIN u ON c.tree = 0 AND c.level = u.level AND c.i = u.i AND u.m = 1)
SELECT l.doc_id, l.leaf, n.x AS subroot, (SELECT x FROM u WHERE m = 1) AS root, sha256(e.proof) AS proof_sha256, e.x AS folded_root, e.x = (SELECT x FROM u WHERE m = 1) AS verified
FROM l JOIN p USING (r) JOIN e USING (r) JOIN n ON n.tree = p.tree AND n.m = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_neighbours": _OP1, "op3_warc": _OP3, "op4_quality": _OP4, "op6_suffixes": _OP6, "op11_phrases": _OP11, "op12_merkle": _OP12}
