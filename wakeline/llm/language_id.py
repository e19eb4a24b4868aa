"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Method. The features of a text are its hashed character n-grams (letters only, other characters are one blank),
weighted by log term frequency and by an inverse document frequency counted over all training rows, scaled to length
one. A follow-the-regularised-leader learner with elastic-net penalties fits one weight column per language, which
leaves most weights exactly zero; a temperature fitted on rows kept out of the fit then calibrates the scores.

The document frequencies cover every training row and are summed by Spark. The fit itself sees a bounded sample: up to
``SAMPLE_PER_LANGUAGE`` training rows of each language, those of least id hash. Whole texts are used throughout. What
is broadcast is the model: ``FEATURES`` times the number of languages, and ids of the sample.

Defined cases: null text or a text without a letter gets ``und`` and score 0; rows with null id are never trained on
and count as not held out; rows without a language label are predicted but not trained on; without any training row
every text is ``und``; ties go to the smaller language code; repeated rows are predicted each; extra columns are
ignored unless carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import id_remainder, least_hashed

FEATURES = 1 << 15
ORDERS = 3
SAMPLE_PER_LANGUAGE = 600
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"
#: Characters of a text turned into n-grams at a time.
CHUNK = 1 << 20

_letters = np.zeros(0x110000, bool)


def letter_table() -> np.ndarray:
    """Which code points are letters; built once per worker."""
    if not _letters[ord("a")]:
        _letters[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _letters


def gram_counts(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of a text and their counts; None without a letter."""
    total = None
    for at in range(0, len(text), CHUNK):
        # pieces overlap so that no n-gram inside is lost
        part = text[max(0, at - ORDERS + 1) : at + CHUNK].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        word = letters[codes]
        if not word.any():
            continue
        codes = np.where(word, codes, np.uint32(32))
        keep = np.ones(len(codes), bool)
        keep[1:] = word[1:] | word[:-1]
        codes = np.concatenate([[np.uint32(32)], codes[keep], [np.uint32(32)]])
        gram, found = np.zeros(len(codes), np.uint32), []
        for n in range(ORDERS):
            gram = gram[: len(codes) - n] * np.uint32(0x01000193) + codes[n:] + np.uint32(n + 1)
            found.append((gram * np.uint32(0x9E3779B1)) >> np.uint32(17))
        counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=FEATURES)
        total = counts if total is None else total + counts
    if total is None:
        return None
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vector(self, grams: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        value = (1.0 + np.log(grams[1])) * self.idf[grams[0]]
        return value / np.sqrt((value * value).sum())

    def logits(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value @ self.weights[at] + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where((id_remainder(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Of every feature, over all rows: each task adds up, Spark sums the at most ``FEATURES`` rows of each."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, seen, n = letter_table(), np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                grams = gram_counts(text, letters)
                if grams is not None:
                    seen[grams[0]] += 1
                    n += 1
        seen[FEATURES] = n
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"feature": at, "n": seen[at]})

    summed = rows.select("text").mapInPandas(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(FEATURES + 1, np.int64)
    out[summed["feature"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return out[:FEATURES], int(out[FEATURES])


def sample(rows: DataFrame, per_language: int) -> DataFrame:
    """Up to ``per_language`` rows of each language, by least id hash: a bounded number of texts."""
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    ids = least_hashed(hashed, "lang", F.lit(per_language)).select("doc_id", "h").distinct()
    return rows.join(F.broadcast(ids), "doc_id")


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, one coordinate per feature and language; the bias is not penalised."""
    z = np.zeros((FEATURES + 1, n_languages))
    n = np.zeros_like(z)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    shuffle = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in shuffle.permutation(len(rows)):
            at, value, label = rows[k]
            at = np.append(at, FEATURES)
            value = np.append(value, 1.0)
            w = weights(at)
            p = softmax(value @ w)
            p[label] -= 1.0
            g = value[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    every = weights(slice(None))
    return every[:FEATURES], -z[FEATURES] / ((BETA + np.sqrt(n[FEATURES])) / ALPHA)


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm.

    A share of one in ``n + 2`` of the target goes to the other languages, as in Platt scaling: without it, rows that
    are all right would make every score 1.
    """
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    doubt = 1.0 / (len(labels) + 2)
    target = np.full(logits.shape, doubt / (logits.shape[1] - 1))
    target[np.arange(len(labels)), labels] = 1.0 - doubt

    def loss(t: float) -> float:
        return float(-(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-12))).sum(axis=1).mean())

    low, high, ratio = -5.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """The model from the training rows of ``docs``; the fit runs in one task over the bounded sample."""
    rows = training_rows(docs)
    seen, total = document_frequencies(rows)
    idf = np.log((1.0 + total) / (1.0 + seen)) + 1.0

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, data = letter_table(), []
        blank = Model([], idf, np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
        for batch in batches:
            for doc_id, lang, h, text in zip(batch["doc_id"], batch["lang"], batch["h"], batch["text"]):
                grams = gram_counts(text, letters)
                if grams is not None:
                    data.append((h, doc_id, lang, grams[0].astype(np.int32), blank.vector(grams).astype(np.float32)))
        # the shuffle sets no order, so rows repeated under one id are ordered by what they hold
        data.sort(key=lambda r: (*r[:3], zlib.crc32(r[4].tobytes(), zlib.crc32(r[3].tobytes()))))
        languages = sorted({r[2] for r in data})
        coded = [(r[3], r[4], languages.index(r[2])) for r in data]
        kept_out = coded[::4]
        weights, bias = fit([r for i, r in enumerate(coded) if i % 4], len(languages))
        model = Model(languages, idf, weights, bias, 1.0)
        logits = np.array([model.logits(at, v) for at, v, _ in kept_out]).reshape(len(kept_out), len(languages))
        t = temperature_of(logits, np.array([label for _, _, label in kept_out], np.int64))
        at, lang = np.nonzero(weights)
        yield pd.DataFrame({
            "feature": [*at.tolist(), *[FEATURES] * len(languages), FEATURES + 1],
            "lang": [*[languages[i] for i in lang], *languages, ""],
            "weight": [*weights[at, lang].tolist(), *bias.tolist(), t],
        })

    # a shuffle, not coalesce: all tasks read the texts, one takes the sample
    chosen = sample(rows, per_language).repartition(1)
    found = chosen.mapInPandas(learn, "feature long, lang string, weight double").toPandas()
    plain = found[found["feature"] <= FEATURES]
    languages = sorted(plain.loc[plain["feature"] == FEATURES, "lang"])
    weights = np.zeros((FEATURES + 1, len(languages)))
    weights[plain["feature"].to_numpy(np.int64), [languages.index(x) for x in plain["lang"]]] = plain["weight"]
    heat = found.loc[found["feature"] == FEATURES + 1, "weight"]
    return Model(languages, idf, weights[:FEATURES], weights[FEATURES], float(heat.iloc[0]) if len(heat) else 1.0)


def predict(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns with lang_pred and score; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # a text that is carried is not sent to the worker a second time
    column = "text" if "text" in carry else "_text"

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, m = letter_table(), shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch[column]:
                grams = gram_counts(text, letters) if text and m.languages else None
                if grams is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    p = softmax(m.logits(grams[0], m.vector(grams)) / m.temperature)
                    best = int(p.argmax())
                    names.append(m.languages[best])
                    scores.append(float(min(1.0, p[best])))
            yield batch[list(carry)].assign(lang_pred=names, score=scores)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    sent = docs.select(*carry) if column == "text" else docs.select(*carry, F.col("text").alias("_text"))
    return sent.mapInPandas(label, f"{fields}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_remainder(doc_id, 3) == 1, F.lit(False))


def identify(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learnt from its own training rows."""
    found = predict(docs, train(docs, per_language))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
