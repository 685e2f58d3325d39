"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag is labelled. Each sentence has a probability p (a smooth function of
the sum over its hashed words and word beginnings, see `hazard`); the document's is the noisy-or 1 - prod(1 - p). The
likelihood of the document labels is maximised through that same noisy-or, so the blame finds the sentences, which are
then reported with their places. The same p is learnt, combined and reported.

Fitting uses at most `SAMPLE_PER_CLASS` labelled rows per class (a documented parameter), drawn by a hash of the id; class
weights restore the classes' true proportion, counted over all labelled rows, at any proportion. Scoring reads every text whole, in Arrow
batches, without a shuffle.

Null or empty text: no sentence, score 0. Labels that are null are not learnt from; several labels of one id count as
their maximum. Without a label of either class every sentence scores 0. Repeated rows are scored alike; other columns
stay untouched. A text without a sentence border is one sentence of any length.
"""
from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rebuyflow.llm.tables import crc32_of, small_batches

BITS, MASK = 18, (1 << 18) - 1
SAMPLE_PER_CLASS = 2500
EPOCHS = 8
WORD_TABLE = 600_000
OFFENDING = 0.5
SOFT = 0.015
"""Hazards well below it count by their square: thousands of harmless sentences must not add up to an offence."""
SENTENCE = re.compile(r"[^.!?\n]+")
WORDS = re.compile(r"[^\W\d_]+").findall


def word_features(word: str) -> tuple[int, ...]:
    """Distinct slots of a word: itself and its first four to six bytes, so inflected forms share what they have in common."""
    raw = word.encode()
    if len(raw) < 4:
        return (zlib.crc32(raw, 1) & MASK,)
    four = zlib.crc32(raw[:4])
    five = zlib.crc32(raw[4:5], four)
    six = zlib.crc32(raw[5:6], five)
    return tuple(dict.fromkeys((four & MASK, five & MASK, six & MASK, zlib.crc32(raw[6:], six ^ 1) & MASK)))


@dataclass(frozen=True)
class ToxicityModel:
    weights: bytes  # float32 per slot
    bias: float


class _WordWeights(dict):
    """Weight of a word, computed at first sight; one table per worker and model, bounded in size."""

    def __init__(self, weights: bytes):
        super().__init__()
        self.weights = np.frombuffer(weights, np.float32).tolist()

    def __missing__(self, word: str) -> float:
        if len(self) > WORD_TABLE:
            self.clear()
        own = self.weights
        self[word] = value = sum([own[f] for f in word_features(word)])
        return value


_TABLES: dict[int, _WordWeights] = {}


def word_weights(model: ToxicityModel) -> _WordWeights:
    key = hash(model.weights)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = _WordWeights(model.weights)
    return _TABLES[key]


def hazard(z):
    """(-ln(1 - p), its slope) of sentences with sum z.

    With h = ln(1 + e^z), the hazard of the logistic probability, it is h^2 / (h + SOFT): h less SOFT for strong sentences,
    near h^2 / SOFT for weak ones, and without a step anywhere, so every sentence counts and can be learnt from.
    """
    z = np.clip(z, -30, 30)
    h = np.log1p(np.exp(z))
    return h * h / (h + SOFT), h * (h + 2 * SOFT) / (h + SOFT) ** 2 / (1 + np.exp(-z))


def fit_bags(bodies: list[str], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3,
             decay: float = 1e-4, seed: int = 7) -> ToxicityModel:
    """Adaptive gradient steps on the noisy-or likelihood; small batches of documents."""
    slots, sentence_of, doc_of, count = [], [], [], 0
    for d, body in enumerate(bodies):
        for s in SENTENCE.findall(body.lower()):
            own = [f for w in dict.fromkeys(WORDS(s)) for f in word_features(w)]  # as `sentence_scores` adds them: each word once
            if own:
                slots.append(np.array(own, np.int32))
                sentence_of.append(np.full(len(own), count, np.int32))
                doc_of.append(d)
                count += 1
    w, bias, g2, b2 = np.zeros(1 << BITS), -5.0, np.full(1 << BITS, 1e-2), 1.0
    if not count or len(set(y.tolist())) < 2:
        return ToxicityModel(w.astype(np.float32).tobytes(), -30.0)
    doc_of, rng = np.array(doc_of), np.random.default_rng(seed)
    first = np.searchsorted(doc_of, np.arange(len(bodies) + 1))
    for _ in range(epochs):
        for docs in np.array_split(rng.permutation(len(bodies)), max(1, len(bodies) // 64)):
            pick = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            if not len(pick):
                continue
            size = np.array([len(slots[i]) for i in pick])
            feats, own = np.concatenate([slots[i] for i in pick]), np.repeat(np.arange(len(pick)), size)
            z = bias + np.bincount(own, w[feats], len(pick))
            strength, slope = hazard(z)
            place = {d: k for k, d in enumerate(docs)}
            bag = np.array([place[d] for d in doc_of[pick]])
            none = np.exp(-np.bincount(bag, strength, len(docs)))  # no sentence offends
            pull = np.where(y[docs] > 0, -none / np.maximum(1 - none, 1e-6), 1.0) * weight[docs]
            g = slope * pull[bag]
            step = np.bincount(feats, g[own], 1 << BITS) + decay * len(docs) * w
            g2 += step ** 2
            w -= rate * step / np.sqrt(g2)
            gb = g.sum()
            b2 += gb ** 2
            bias -= rate * gb / np.sqrt(b2)
    return ToxicityModel(w.astype(np.float32).tobytes(), float(bias))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose CRC-32 of the id as text leaves 2 modulo 4 are never learnt from."""
    return F.coalesce(crc32_of(F.col(id_col)) % 4 == 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from at most `per_class` labelled rows of each class (a bounded sample, so one task holds it)."""
    small_batches(docs.sparkSession)
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y")))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("id"), "id"]
    chosen = known.filter("y = 1").orderBy(*order).limit(per_class).unionByName(known.filter("y = 0").orderBy(*order).limit(per_class))
    # at most 2 * per_class rows: a proven bound for the broadcast. Of repeated ids one text is taken.
    sample = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
              .join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.max("body").alias("body")))
    share = {y: n / min(per_class, n) for y, n in total.items()}  # rows that a sampled row stands for

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        y = frame["y"].to_numpy()
        weight = np.array([share[int(v)] for v in y])
        model = fit_bags(frame["body"].tolist(), y, weight / weight.mean())  # mean 1: steps do not depend on the proportion
        return pd.DataFrame({"weights": [model.weights], "bias": [model.bias]})

    rows = sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "weights binary, bias double").collect()
    if not rows:
        return ToxicityModel(np.zeros(1 << BITS, np.float32).tobytes(), -30.0)
    return ToxicityModel(bytes(rows[0]["weights"]), rows[0]["bias"])


def sentence_scores(body: str, weight, bias: float) -> list[tuple[int, int, float]]:
    """(start, end, p) of each sentence that has words; code points."""
    lowered = body.lower()
    if len(lowered) != len(body):  # a letter whose lower case is longer: keep places right
        lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in body)
    out = []
    for m in SENTENCE.finditer(lowered):
        if words := WORDS(m[0]):
            z = min(max(bias + sum(map(weight, set(words))), -30.0), 30.0)
            h = math.log1p(math.exp(z))
            out.append((m.start(), m.end(), -math.expm1(-h * h / (h + SOFT))))
    return out


def noisy_or(ps: list[float]) -> float:
    """1 - prod(1 - p) over all sentences."""
    return -math.expm1(sum(math.log1p(-min(p, 1 - 1e-12)) for p in ps))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score",
                   sentences_col: str = "offending") -> DataFrame:
    """Every row with its score and its offending sentences (start, end, p), code points, end exclusive."""
    small_batches(docs.sparkSession)
    found = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))
    kept = [f for f in docs.schema.fields if f.name not in (score_col, sentences_col)]
    schema = T.StructType([*kept, T.StructField(score_col, T.DoubleType()), T.StructField(sentences_col, found)])
    bias, keep = model.bias, [f.name for f in kept]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = word_weights(model).__getitem__
        for frame in frames:
            scores, places = [], []
            for body in frame[text_col]:
                own = sentence_scores(body, weight, bias) if isinstance(body, str) else []
                scores.append(noisy_or([p for _, _, p in own]))
                places.append([{"start": s, "end": e, "p": float(p)} for s, e, p in own if p >= OFFENDING])
            yield frame[keep].assign(**{score_col: scores, sentences_col: places})

    return docs.mapInPandas(run, schema)
