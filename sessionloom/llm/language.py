"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram vector
binds its letters: each is rotated by its place, then all are multiplied. A document vector
bundles (adds) the vectors of its n-grams; a language prototype bundles those of its
training documents, each scaled to length one. The language whose prototype has the largest
cosine wins.

Training reads at most `per_lang` documents of each language, those with the smallest hash
of their id; prediction reads every whole text.

Defined cases: a null text or one without a letter is `und` with score 0; ties go to the
alphabetically first language; without any training document every text is `und`.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

DIM = 1024
GRAM = 3


@functools.lru_cache(maxsize=70_000)
def letter(code: int) -> np.ndarray:
    return np.random.default_rng(code).integers(0, 2, DIM, dtype=np.int8) * 2 - 1


class Grams:
    """n-gram vectors, made when first seen; the table is dropped when it is full."""

    def __init__(self, most: int = 30_000) -> None:
        self.most, self.at, self.table = most, {}, np.empty((1024, DIM), np.int8)

    def rows(self, grams: list[int]) -> np.ndarray:
        if len(self.at) + len(grams) > self.most:
            self.at.clear()
        at = self.at
        for g in grams:
            if g not in at:
                n = len(at)
                if n >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                v = np.ones(DIM, np.int8)
                for k in range(GRAM):
                    v = v * np.roll(letter((g >> 21 * (GRAM - 1 - k)) & 0x1FFFFF), GRAM - 1 - k)
                self.table[n], at[g] = v, n
        return self.table[[at[g] for g in grams]]


_GRAMS = Grams()
_KINDS: dict[int, bool] = {}


def letters(text: str) -> np.ndarray:
    """Code points of the lower-case text; each run of other characters is one space (32)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    kinds = np.unique(codes)
    for c in kinds.tolist():
        if c not in _KINDS:
            _KINDS[c] = chr(c).isalpha()
    ok = np.array([_KINDS[c] for c in kinds.tolist()], bool)
    is_letter = ok[np.searchsorted(kinds, codes)]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    codes = np.where(is_letter, codes, 32)
    codes = np.concatenate(([32], codes, [32]))
    same = (codes[1:] == 32) & (codes[:-1] == 32)
    return codes[np.concatenate(([True], ~same))]


def vector(text: str | None) -> np.ndarray | None:
    """Bundled n-gram vector of a whole text, None if it has no letter."""
    c = letters(text or "").astype(np.int64)
    if len(c) < GRAM:
        return None
    g = c[: len(c) - GRAM + 1].copy()
    for k in range(1, GRAM):
        g = (g << 21) | c[k : len(c) - GRAM + 1 + k]
    out, (grams, counts) = np.zeros(DIM, np.float32), np.unique(g, return_counts=True)
    for k in range(0, len(grams), 8192):
        out += counts[k : k + 8192].astype(np.float32) @ _GRAMS.rows(grams[k : k + 8192].tolist()).astype(np.float32)
    return out


#: Parts that a language's documents are drawn from evenly, so that a large language is no single task.
DRAWS = 64
#: Training ids up to this number (8 MB) are broadcast; more languages than that hold are joined by a shuffle.
MOST_IDS = 1_000_000


def training_rows(docs: DataFrame, per_lang: int, id_col: str, text_col: str, lang_col: str, train) -> DataFrame:
    """(lang, text) of at most about `per_lang` documents of each language, from each of DRAWS parts those with the
    smallest hash of their id. The ids are chosen by a shuffle of ids; texts are filtered where they are read."""
    rows = docs.where(F.coalesce(train, F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    part = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(DRAWS))
    ids = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(lang_col).alias("_lang")).withColumn("_part", part)
    order = Window.partitionBy("_lang", "_part").orderBy(F.xxhash64("_id"), "_id")
    chosen = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= -(-per_lang // DRAWS)).select("_id").distinct()
    chosen = staged(chosen, "training-ids")
    if chosen.count() <= MOST_IDS:
        chosen = F.broadcast(chosen)
    return rows.withColumn("_id", F.col(id_col).cast("long")).join(chosen, "_id", "left_semi").select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def fit(rows: DataFrame) -> dict[str, np.ndarray]:
    """Prototype of each language. A task sends one vector per language."""

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (v := vector(text)) is not None:
                    total[lang] = total.get(lang, 0) + v / max(1e-9, float(np.linalg.norm(v)))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.astype(np.float64).tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = rows.mapInArrow(sums, "lang string, v array<double>")
    found = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).select("lang", F.col("v.x").alias("v")).collect()
    return {r["lang"]: np.array(r["v"]) for r in sorted(found)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Input columns plus the prediction and its score (cosine, cut to 0..1); input columns of their names are replaced."""
    docs = docs.drop(*out)
    langs = list(prototypes)
    matrix = np.array([prototypes[x] / max(1e-9, float(np.linalg.norm(prototypes[x]))) for x in langs], np.float64).reshape(len(langs), DIM)
    schema = docs.select("*", F.lit("").alias(out[0]), F.lit(0.0).alias(out[1])).schema

    def label(batches):
        for b in batches:
            who, score = [], []
            for text in b.column(text_col).to_pylist():
                v = vector(text) if langs else None
                if v is None:
                    who.append("und")
                    score.append(0.0)
                    continue
                cos = matrix @ v.astype(np.float64) / max(1e-9, float(np.linalg.norm(v)))
                k = int(cos.argmax())
                who.append(langs[k])
                score.append(float(min(1.0, max(0.0, cos[k]))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(who, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, *out])

    return docs.mapInArrow(label, schema)


def identify(docs: DataFrame, per_lang: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train=None, keep: list[str] | None = None, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Fit on the labelled rows that `train` allows (all, if None), then predict every row."""
    model = fit(training_rows(docs, per_lang, id_col, text_col, lang_col, F.lit(True) if train is None else train))
    return predict(docs.select(*(keep or docs.columns)), model, text_col, out)
