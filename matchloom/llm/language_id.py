"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is the average, over its words, of the average embedding of each word's
hashed character n-grams; a linear softmax on top gives the language.  Embeddings
and softmax are trained together by stochastic gradient descent in numpy on a
bounded sample of labelled texts.  A part of the sample is set aside to fit a
temperature (calibrated probabilities) and a rejection threshold.

As softmax is linear, prediction uses the product of embeddings and softmax
weights, one row of language scores per n-gram bucket.  Each distinct word of a
slice is scored once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import map_rows, segment_sums

BUCKET_BITS = 16
DIMENSION = 16
GRAMS = (1, 2, 3, 4)
#: Labelled texts per language and n-gram kinds per text that the model is fitted
#: on at most; the bound on what reaches the driver.
SAMPLE_PER_LANGUAGE = 600
SAMPLE_TEXT_BYTES = 64 << 10
EPOCHS = 12
RATE = 0.5
#: Of the calibration texts that are not rejected, the share to be right.
PRECISION = 0.995
UNDETERMINED = "und"

_LETTER = r"\p{L}"


def gram_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams of all words in turn, n-grams per word).

    N-grams run over the bytes of ``<word>``; shorter words have fewer kinds.
    """
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), dtype=np.uint8)
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(data))
    h = np.zeros(len(data), dtype=np.uint64)
    buckets, owners = [], []
    owner = np.repeat(np.arange(len(words)), lengths)
    for n in range(1, max(GRAMS) + 1):
        ok = at + n <= ends
        h = h * np.uint64(0x100000001B3) + np.concatenate([data[n - 1 :], np.zeros(min(n - 1, len(data)), np.uint8)])[: len(data)].astype(np.uint64) + np.uint64(n)
        if n in GRAMS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed[ok] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
            owners.append(owner[ok])
    who = np.concatenate(owners) if owners else np.empty(0, np.int64)
    order = np.argsort(who, kind="stable")
    return np.concatenate(buckets)[order], np.bincount(who, minlength=len(words)).astype(np.int64)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str | None]) -> np.ndarray:
        words = [split_words(t) for t in texts]
        counts = np.array([len(w) for w in words], dtype=np.int64)
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for ws in words for w in ws], dtype=np.int64)
        kinds = np.empty((len(seen), len(self.languages)))
        distinct = list(seen)
        for k in range(0, len(distinct), 20_000):
            buckets, n = gram_hashes(distinct[k : k + 20_000])
            kinds[k : k + 20_000] = segment_sums(self.scores[buckets], n) / np.maximum(n, 1)[:, None]
        total = np.zeros((len(texts), len(self.languages)))
        for j in range(len(self.languages)):
            total[:, j] = np.bincount(np.repeat(np.arange(len(texts)), counts), weights=kinds[ids, j] if len(ids) else None, minlength=len(texts))
        return total / np.maximum(counts, 1)[:, None] + self.bias

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        z = self.logits(texts) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 7, epochs: int = EPOCHS) -> LanguageModel | None:
    """``samples``: (buckets, weights that sum to 1, language) per text."""
    languages = sorted({y for *_, y in samples})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    aside = set(order[: len(samples) // 5].tolist()) if len(samples) >= 10 * len(languages) else set()
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSION)).astype(np.float32)
    soft = np.zeros((DIMENSION, len(languages)), dtype=np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    index = {y: k for k, y in enumerate(languages)}
    own = [k for k in range(len(samples)) if k not in aside]
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for k in rng.permutation(own):
            buckets, weights, y = samples[k]
            hidden = weights @ emb[buckets]
            z = hidden @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[index[y]] -= 1
            back = soft @ p
            soft -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            emb[buckets] -= (20 * rate) * np.outer(weights, back)
    model = LanguageModel(languages, (emb @ soft).astype(np.float64), bias.astype(np.float64))
    if aside:
        z = np.array([samples[k][1] @ model.scores[samples[k][0]] + model.bias for k in sorted(aside)])
        y = np.array([index[samples[k][2]] for k in sorted(aside)])

        def loss(t):
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean())

        model.temperature = min((float(t) for t in np.geomspace(0.05, 20, 121)), key=loss)
        s = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
        p = s / s.sum(axis=1, keepdims=True)
        top, right = p.max(axis=1), p.argmax(axis=1) == y
        down = np.argsort(-top)
        precise = np.flatnonzero(np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= PRECISION)
        model.threshold = float(top[down[precise[-1]]]) if len(precise) else 1.0
    return model


def text_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, weights) of one text: the average over words of n-gram averages."""
    words = split_words(text)
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    buckets, n = gram_hashes(words)
    w = np.repeat(1.0 / (n * len(words)), n)
    kinds, where = np.unique(buckets, return_inverse=True)
    return kinds, np.bincount(where, weights=w, minlength=len(kinds))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, text_bytes: int = SAMPLE_TEXT_BYTES) -> LanguageModel | None:
    """Fit on at most ``per_language`` labelled texts of each language, those of lowest id
    hash among texts of up to ``text_bytes``.  Only their n-gram weights are collected."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).alias("h"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    # Twice the wanted share by hash, then the exact number by rank, over ids only.
    near = F.lit(False)
    for lang, n in sizes.items():
        near = near | ((F.col("lang") == lang) & (F.col("h") < int((1 << 30) * min(1.0, 2 * per_language / n))))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = rows.where(near).select("id", "lang", "h").distinct().withColumn("r", rank).where(F.col("r") <= per_language).select("id", "lang")
    sample = rows.where(near & (F.octet_length("text") <= text_bytes)).join(F.broadcast(chosen), ["id", "lang"]).select("id", "lang", "text")

    def make():
        def run(batch):
            grams = [text_grams(t) for t in batch.column(2).to_pylist()]
            return {"id": batch.column(0), "lang": batch.column(1), "buckets": pa.array([b.astype("<i4").tobytes() for b, _ in grams], pa.binary()), "weights": pa.array([w.astype("<f4").tobytes() for _, w in grams], pa.binary())}

        return run

    got = map_rows(sample, make, f"id {dict(sample.dtypes)['id']}, lang string, buckets binary, weights binary").collect()
    got.sort(key=lambda r: (r.id, r.lang, bytes(r.buckets)))
    return train([(np.frombuffer(r.buckets, "<i4").astype(np.int64), np.frombuffer(r.weights, "<f4"), r.lang) for r in got if len(r.buckets)])


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted): one row per input row.

    A null text, one without a letter, or any text without a model is ``und`` with
    score 0 and not accepted; ``accepted`` is whether the calibrated score reaches
    the threshold.  Only the text is looked at: whole, of any length, so equal texts
    get equal results and repeated rows come out repeatedly; of equal probabilities the first
    language in order counts.  An empty table gives none; further columns are left out.
    """

    def make():
        def run(batch):
            column = batch.column(1)
            letters = pc.match_substring_regex(column.fill_null(""), _LETTER).to_pylist()
            if model is None:
                names, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                p = model.probabilities(column.to_pylist())
                score = np.where(letters, p.max(axis=1), 0.0)
                names = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(p.argmax(axis=1).tolist(), letters)]
            accepted = [n != UNDETERMINED and s >= model.threshold for n, s in zip(names, score.tolist())]
            return {"doc_id": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64()), "accepted": pa.array(accepted, pa.bool_())}

        return run

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double, accepted boolean")
