"""Toxicity scores, learnt from confirmed examples and unlabelled texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .stable_bpe import as_text, slices
from .word_hash import SLICE_BYTES, WordHasher

BITS = 18
CONFIRMED_ROWS = 4_000
UNLABELLED_ROWS = 16_000
FEATURES = 4_096


@dataclass
class Toxicity:
    """Weights of hashed words; a score is ``sigmoid(offset + sum of weights)``."""

    weights: np.ndarray
    offset: float

    def margins(self, docs: list[np.ndarray]) -> np.ndarray:
        return np.array([self.offset + self.weights[d].sum() for d in docs])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def _word_ids(column: pa.Array, hasher: WordHasher):
    """Distinct hashed words of every text."""
    for _, part in slices(as_text(column), SLICE_BYTES):
        words, first = hasher(part)
        ids = (words >> np.uint64(64 - BITS)).astype(np.int32)
        for i in range(len(part)):
            yield np.unique(ids[first[i]:first[i + 1]])


def _features(texts: DataFrame, text: str) -> list[np.ndarray]:
    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            found = list(_word_ids(batch.column(0), hasher))
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["words"])

    table = texts.select(text).mapInArrow(run, "words array<int>").toArrow()
    return [np.asarray(x.values) for x in table.column("words")]


def _sample(ids: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` ids, those of least hash."""
    return ids.select(key).distinct().orderBy(F.xxhash64(key), key).limit(rows)


def train(confirmed: list[np.ndarray], unlabelled: list[np.ndarray], prior: float,
          steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> Toxicity:
    """Non-negative positive-unlabelled learning of a linear model.

    The risk is ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the
    logistic loss: unlabelled texts count as negative, corrected for the ``prior``
    share of positives among them.  Where the corrected part falls below zero, the
    step goes up on it instead.  Features are words whose share of texts differs
    most between the two sides.
    """
    size = 1 << BITS
    if not confirmed or not unlabelled:
        return Toxicity(np.zeros(size), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    prior = min(max(prior, 1e-3), 0.5)

    def share(docs):
        return np.bincount(np.concatenate(docs), minlength=size) / len(docs)

    p, u = share(confirmed), share(unlabelled)
    both = (p * len(confirmed) + u * len(unlabelled)) / (len(confirmed) + len(unlabelled))
    spread = np.sqrt(both * (1 - both) * (1 / len(confirmed) + 1 / len(unlabelled))) + 1e-9
    z = np.abs(p - u) / spread
    chosen = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    chosen = chosen[z[chosen] > 4]
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))

    def flat(docs):
        at = [place[d] for d in docs]
        at = [a[a >= 0] for a in at]
        return np.concatenate(at).astype(np.int64), np.repeat(np.arange(len(at)), [len(a) for a in at])

    sides = [(*flat(confirmed), len(confirmed)), (*flat(unlabelled), len(unlabelled))]
    theta = np.zeros(len(chosen) + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def margin(side):
        words, owner, n = side
        return theta[-1] + np.bincount(owner, theta[words], n)

    def pull(side, slope):
        words, owner, n = side
        return np.append(np.bincount(words, slope[owner], len(chosen)), slope.sum()) / n

    for step in range(1, steps + 1):
        m_p, m_u = margin(sides[0]), margin(sides[1])
        negative = np.logaddexp(0, m_u).mean() - prior * np.logaddexp(0, m_p).mean()
        as_negative = pull(sides[1], _sigmoid(m_u)) - prior * pull(sides[0], _sigmoid(m_p))
        if negative >= 0:
            slope = prior * pull(sides[0], _sigmoid(m_p) - 1) + as_negative
        else:
            slope = -as_negative
        slope[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope ** 2
        theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)

    # The place of 0.5: the best estimated F1, from the two shares and the prior.
    m_p, m_u = np.sort(margin(sides[0])), np.sort(margin(sides[1]))
    cuts = np.unique(np.concatenate([m_p, m_u]))
    recall = 1 - np.searchsorted(m_p, cuts) / len(m_p)
    marked = 1 - np.searchsorted(m_u, cuts) / len(m_u)
    best = int(np.argmax(2 * prior * recall / (prior + np.maximum(marked, prior * recall))))
    below = cuts[best - 1] if best else cuts[best] - 1
    weights = np.zeros(size)
    weights[chosen] = theta[:-1]
    return Toxicity(weights, float(theta[-1] - (cuts[best] + below) / 2))


def fit_toxicity(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                 label: str = "toxic", confirmed_rows: int = CONFIRMED_ROWS,
                 unlabelled_rows: int = UNLABELLED_ROWS) -> Toxicity:
    """A model from ``labels`` (``doc_id, toxic``) and ``texts``, on bounded samples.

    The library's records hold no toxicity labels; any labelled texts do.  Confirmed
    examples are at most ``confirmed_rows`` texts with label 1; ``unlabelled_rows``
    of all texts stand for the rest.  The class prior is the share of 1 among all
    labels.  Null labels and labels without a text count for nothing.
    """
    prior = labels.where(F.col(label).isNotNull()).agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
    texts = texts.select(key, text)

    def picked(ids: DataFrame, rows: int) -> list[np.ndarray]:
        # The sample's bound is the broadcast's.
        return _features(texts.join(F.broadcast(_sample(ids, key, rows)), key, "left_semi"), text)

    return train(picked(labels.where(F.col(label) == 1), confirmed_rows),
                 picked(texts, unlabelled_rows), prior or 0.0)


def score_texts(texts: DataFrame, model: Toxicity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every text, by its words alone.

    A null or empty text gets the score of no words; repeated rows get the same;
    null keys stay; other columns are ignored; an empty table gives no rows.
    """
    kind = texts.schema[key].dataType.simpleString()
    weights, offset = model.weights, model.offset

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            score = _sigmoid([offset + weights[d].sum() for d in _word_ids(batch.column(1), hasher)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=[key, "score", "predicted"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
