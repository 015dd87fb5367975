"""Toxicity by non-negative positive-unlabelled learning.

The classifier learns from confirmed toxic texts and from texts of which nothing is known. With the
class prior p, the risk of a scorer g is p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]): the second part
is what the unlabelled texts say about the negatives, and it must not fall below zero.

Features are a text's distinct words and their first four to six letters, hashed. A text's score is
the logistic function of the sum over its distinct words, so a long text isn't diluted.

Defined cases: a null or empty text gets the score of the bias alone; without any confirmed toxic
row in the training part all scores are practically 0 (under 1e-200); ties and repeated rows are scored alike; an empty table
gives no rows; columns other than doc_id and text are never inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import filled_text, keep_rows, keyed_text, over_chunks, per_chunk, remainder, words

#: Of the confirmed toxic texts, so many have a feature that takes part.
LEAST = 3
_STRIP = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def features(word: str) -> set[int]:
    """Hashes of a lower-cased word and of its beginnings."""
    word = _STRIP.sub("", word)
    return {xxhash.xxh32_intdigest(f) for f in ("w" + word, *(str(k) + word[:k] for k in (4, 5, 6) if len(word) >= k))} if word else set()


@dataclass
class ToxicityModel:
    weights: dict[int, float]
    bias: float

    def scorer(self):
        """Texts -> scores; keeps the weights of words it has met."""
        known: dict[str, float] = {}
        get = self.weights.get

        def score(texts: pa.Array) -> np.ndarray:
            distinct, code, counts = words(pc.utf8_lower(texts))
            values = distinct.to_pylist()
            for v in values:
                if v not in known:
                    if len(known) > 400_000:
                        known.clear()
                    known[v] = sum(get(f, 0.0) for f in features(v))
            weight = np.array([known[v] if v in known else sum(get(f, 0.0) for f in features(v)) for v in values])
            row = np.repeat(np.arange(len(counts)), counts)
            tells = np.flatnonzero(weight[code] != 0) if len(code) else np.zeros(0, np.int64)
            pairs = np.unique(row[tells] << 32 | code[tells])
            total = self.bias + np.bincount(pairs >> 32, weight[pairs & 0xFFFFFFFF], len(counts)) if len(pairs) else np.full(len(counts), self.bias)
            return 1 / (1 + np.exp(-np.clip(total, -500, 500)))

        return score


def nn_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 250, rate: float = 0.05, decay: float = 1e-3, least: int = LEAST, share: float = 0.3, z: float = 3) -> ToxicityModel:
    """Fits a linear scorer on feature sets by the non-negative risk estimator (full batches, Adam).

    A feature takes part if at least ``least`` positive texts have it, if by the class prior at least
    ``share`` of the texts with it are positive, and if its rates differ by ``z`` standard errors: the
    weights of all others are noise, which adds up in long texts.
    """
    names, seen = np.unique(np.concatenate([np.zeros(0, np.int64), *positive]), return_counts=True)
    names, seen = names[seen >= least], seen[seen >= least]
    other, count = np.unique(np.concatenate([names, *unlabelled]), return_counts=True)
    pp, pu = seen / len(positive), (count[np.searchsorted(other, names)] - 1) / len(unlabelled)
    clear = (prior * pp >= share * pu) & (pp - pu >= z * np.sqrt(pp * (1 - pp) / len(positive) + (pu + 1 / len(unlabelled)) / len(unlabelled)))
    names = names[clear]

    def matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([np.zeros(0, np.int64), *sets])
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(names, flat)
        hit = np.flatnonzero((at < len(names)) & (names[np.minimum(at, len(names) - 1)] == flat)) if len(names) else np.zeros(0, np.int64)
        return row[hit], at[hit]

    (prow, pcol), (urow, ucol) = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(len(names)), np.log(prior / (1 - prior))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    soft = lambda x: np.logaddexp(0, x)  # noqa: E731  logistic loss of -x
    for t in range(1, steps + 1):
        gp = b + np.bincount(prow, w[pcol], len(positive))
        gu = b + np.bincount(urow, w[ucol], len(unlabelled))
        negative = soft(gu).mean() - prior * soft(gp).mean()
        dp, du = np.zeros(len(gp)), np.zeros(len(gu))
        if negative >= 0:
            dp += prior * -sigmoid(-gp) / len(gp)
        sign = 1 if negative >= 0 else -1  # below zero the step goes back up
        du += sign * sigmoid(gu) / len(gu)
        dp -= sign * prior * sigmoid(gp) / len(gp)
        g = np.append(np.bincount(pcol, dp[prow], len(names)) + np.bincount(ucol, du[urow], len(names)) + decay * w / max(len(names), 1), dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    gp, gu = np.bincount(prow, w[pcol], len(positive)), np.bincount(urow, w[ucol], len(unlabelled))
    return ToxicityModel(dict(zip(names.tolist(), w.tolist(), strict=True)), -_split(gp, gu, prior))


def _split(gp: np.ndarray, gu: np.ndarray, prior: float) -> float:
    """The sum at which the estimated error p P+(g<t) + Pu(g>=t) - p P+(g>=t) is least, in the middle of the best gap."""
    at = np.unique(np.concatenate([gp, gu]))
    middle = np.concatenate([(at[1:] + at[:-1]) / 2, [at[-1] + 1]])
    p, u = np.sort(gp), np.sort(gu)
    missed = np.searchsorted(p, middle) / len(p)
    error = prior * missed + np.maximum(0, 1 - np.searchsorted(u, middle) / len(u) - prior * (1 - missed))
    best = np.flatnonzero(error <= error.min() + 1e-12)
    gaps = np.append(np.diff(at), 0)
    return float(middle[best[np.argmax(gaps[best])]])


def _of_texts(texts: pa.Array, only: set[int] | None = None) -> list[set[int]]:
    """Each text's features."""
    distinct, code, counts = words(pc.utf8_lower(texts))
    each = [features(w) if only is None else features(w) & only for w in distinct.to_pylist()]
    ends = np.cumsum(counts).tolist()
    return [set().union(*(each[c] for c in set(code[e - n : e].tolist()))) for e, n in zip(ends, counts.tolist(), strict=True)]


def _shared(rows: DataFrame, least: int) -> np.ndarray:
    """The features that at least ``least`` of the texts have, ascending."""

    def make():
        def run(part: pa.RecordBatch) -> dict:
            name, n = np.unique(np.array([f for s in _of_texts(part.column("text")) for f in s], np.int64), return_counts=True)
            return {"feature": name, "n": n}

        return run

    counted = per_chunk(rows, make, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r.feature for r in counted.select("feature").toLocalIterator()], np.int64))


def _sets(rows: DataFrame, only: np.ndarray) -> list[np.ndarray]:
    """The feature sets of a bounded number of texts, of the features in ``only``."""

    def make():
        listed = set(only.tolist())
        return lambda part: {"features": [np.array(sorted(s), "<u4").tobytes() for s in _of_texts(part.column("text"), listed)]}

    return [np.frombuffer(r.features, "<u4").astype(np.int64) for r in per_chunk(rows, make, "features binary").toLocalIterator()]


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, most_positive: int = 2000, most_unlabelled: int = 6000) -> ToxicityModel:
    """Learns from rows whose crc32(doc_id) mod ``folds`` isn't 0.

    Bounds of the sample, taken in the order of a hash of doc_id: ``most_positive`` confirmed toxic
    documents and ``most_unlabelled`` documents of any kind. The class prior is the share of toxic
    rows among the labelled ones of the training part.
    """
    train = keyed_text(docs).where(remainder("doc_id", folds) != 0)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("bad"))
    count = known.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).first()
    if not count.bad:
        return ToxicityModel({}, -1000.0)
    prior = min(0.9, max(0.001, count.bad / count.n))
    order = F.xxhash64("doc_id")
    toxic = known.where("bad").select("doc_id").distinct().orderBy(order, "doc_id").limit(most_positive)
    toxic_texts = train.join(F.broadcast(toxic), "doc_id", "left_semi")
    names = _shared(toxic_texts, LEAST)  # nn_pu leaves the others out; so the driver gets short sets, however long the texts are
    positive = _sets(toxic_texts, names)
    chosen = train.select("doc_id").dropna().orderBy(order, "doc_id").limit(most_unlabelled).distinct()
    unlabelled = _sets(train.join(F.broadcast(chosen), "doc_id", "left_semi"), names)
    return nn_pu(positive, unlabelled, prior) if positive and unlabelled else ToxicityModel({}, -1000.0)


def toxicity(docs: DataFrame, model: ToxicityModel, folds: int = 5) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        score = model.scorer()
        for part in parts:
            s = score(part.column("text"))
            yield {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return over_chunks(keyed_text(docs).withColumn("held_out", remainder("doc_id", folds) == 0), run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents, with all their columns, that aren't predicted toxic."""

    def make():
        score = model.scorer()
        return lambda batch: score(filled_text(batch)) < 0.5

    return keep_rows(docs, make)
