"""Language identification by string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of
distinct character n-grams of 1 to 4 characters (hashed to ``SPACE`` places)
that both contain, divided by the root of the product of their numbers. With
``landmarks`` of the training texts as landmarks (Nyström), texts become rows
of kernel values; one-versus-rest kernel ridge regression is solved in that
space and texts are scored by batched products
``presence @ landmarks.T`` and ``kernel @ weights``.

Learned from a bounded sample: ``PER_LANG`` texts for each language (fewer from
the 201st language on, so that all are ``TEXTS`` at most, but one at least), the
first by a hash of the id, of rows whose crc32(id) mod 4 is not 2 and whose
language is known. No language is left out. Scoring covers whole texts of all
rows and sees the text alone.

Defined results: ``und`` and score 0 for a null text or one without a letter.
The score is a softmax of the ridge outputs. Without any labelled row every
text is ``und``. Rows that repeat an id each get their row; for training the
least text of an id and language is used. A table without rows gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import bounded_sample, table

SPACE = 1 << 14
LENGTHS = (1, 2, 3, 4)
PER_LANG = 300
#: Texts that are learned from, and landmarks, of all languages together.
TEXTS = 60_000
ALL_LANDMARKS = 4_000
LANDMARKS = 40
RIDGE = 1e-2
SHARPNESS = 8.0
BATCH = 256
_CHUNK = 1 << 20


def _folded(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)


def presence(text: str, space: int = SPACE) -> np.ndarray:
    """Places of the n-grams that occur in the whole text."""
    codes = _folded(" " + text + " ").astype(np.uint32)
    seen = np.zeros(space, dtype=bool)
    shift = np.uint32(32 - int(space).bit_length() + 1)
    for at in range(0, len(codes), _CHUNK):
        part = codes[at : at + _CHUNK + max(LENGTHS) - 1]
        hashed = np.zeros(len(part), dtype=np.uint32)
        for n in LENGTHS:
            if len(part) < n:
                break
            hashed = (hashed[: len(part) - n + 1] * np.uint32(0x01000193)) ^ (part[n - 1 :] + np.uint32(n))
            seen[(hashed * np.uint32(0x9E3779B1)) >> shift] = True
    return np.flatnonzero(seen)


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text)))


def presence_rows(texts: list[str], space: int = SPACE) -> np.ndarray:
    """Presence rows scaled to length one, so that their products are kernel values."""
    rows = np.zeros((len(texts), space), dtype=np.float32)
    for i, text in enumerate(texts):
        at = presence(text, space)
        rows[i, at] = 1 / np.sqrt(len(at))
    return rows


class KernelModel:
    """Nyström landmarks and one-versus-rest ridge weights."""

    def __init__(self, texts: list[str], langs: list[str], per_lang: int = LANDMARKS, ridge: float = RIDGE):
        self.names = sorted(set(langs))
        rows = presence_rows(texts)
        y = np.array([self.names.index(x) for x in langs])
        per_lang = max(1, min(per_lang, ALL_LANDMARKS // len(self.names)))
        chosen = np.concatenate([np.flatnonzero(y == k)[:per_lang] for k in range(len(self.names))])
        self.landmarks = np.ascontiguousarray(rows[chosen])
        k_mm = (self.landmarks @ self.landmarks.T).astype(np.float64)
        k_nm = (rows @ self.landmarks.T).astype(np.float64)
        target = np.where(y[:, None] == np.arange(len(self.names)), 1.0, -1.0)
        # Rows of a rarer language weigh more, so that no language is crowded out.
        weight = (len(y) / (len(self.names) * np.bincount(y, minlength=len(self.names))))[y]
        left = k_nm.T @ (k_nm * weight[:, None]) + ridge * len(y) * k_mm / len(self.names) + 1e-8 * np.eye(len(chosen))
        self.weights = np.linalg.solve(left, k_nm.T @ (target * weight[:, None])).astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), len(self.names)))
        for at in range(0, len(texts), BATCH):
            kernel = presence_rows(texts[at : at + BATCH]) @ self.landmarks.T
            out[at : at + BATCH] = kernel @ self.weights
        raised = np.exp(SHARPNESS * (out - out.max(axis=1, keepdims=True)))
        return raised / raised.sum(axis=1, keepdims=True)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, fold: int = 2, folds: int = 4) -> KernelModel | None:
    """Learn from at most ``per_lang`` texts of each language, fewer where there are more than ``TEXTS / per_lang`` languages."""
    known = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("id").cast("string").cast("binary")) % folds != fold))
    keys = known.select("id", "lang").distinct()
    langs = keys.select("lang").distinct().count()
    # At most TEXTS ids, or one for each language, each with one text: small by construction.
    ids = bounded_sample(keys, "id", "lang", max(1, min(per_lang, TEXTS // max(1, langs))))
    rows = known.join(F.broadcast(ids), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).collect()
    rows = sorted((zlib.crc32(str(r["id"]).encode()), str(r["id"]), r["lang"], r["text"]) for r in rows if has_letter(r["text"]))
    if not rows:
        return None
    return KernelModel([r[3] for r in rows], [r[2] for r in rows])


def predict(df: DataFrame, model: KernelModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[id_col]
    # The model's size is bound by ALL_LANDMARKS (or the number of languages) and SPACE.
    held = spark.sparkContext.broadcast(model)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for batch in batches:
            texts = batch["text"].tolist()
            lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            if at:
                scores = model.scores([texts[i] for i in at])
                best = scores.argmax(axis=1)
                lang[at] = np.array(model.names, dtype=object)[best]
                score[at] = scores[np.arange(len(at)), best]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": lang, "score": score})

    rows = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(each, "doc_id string, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast(kind))


def op10(spark, sf_dir) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = predict(documents, fit(documents))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
