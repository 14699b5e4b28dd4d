"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent space.

A document's terms are byte pairs (hashed), triples of character classes, and whether each word repeats the one before.
Term frequencies, weighted by inverse document frequency over the labelled sample, are projected on the leading singular vectors
of that sample. Every document is compared with every sampled one, by blocked cosine products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Labelled documents that vote, at most. They are those with the least hashes of their ids.
SAMPLE = 4000
#: Latent dimensions and neighbours per vote.
RANK, NEIGHBOURS = 48, 15
_PAIRS, _BLOCK = 1024, 512
_PAIR_TERM = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int16)
# Classes: lower, upper, digit, space, line end, sentence marks, other signs, beyond ASCII.
_CLASS = np.full(256, 7, np.int16)
_CLASS[:128] = 6
for _c in range(128):
    _s = chr(_c)
    if _s.islower():
        _CLASS[_c] = 0
    elif _s.isupper():
        _CLASS[_c] = 1
    elif _s.isdigit():
        _CLASS[_c] = 2
    elif _s in " \t":
        _CLASS[_c] = 3
    elif _s in "\r\n":
        _CLASS[_c] = 4
    elif _s in ".,;:'\"?-()":
        _CLASS[_c] = 5
_WIDTH = _PAIRS + 512 + 4
_AT_ONCE = 1 << 22


def term_vector(text: bytes) -> np.ndarray:
    """Square roots of the term shares of one text, each group of terms with length 1; zeros for an empty text."""
    out = np.zeros(_WIDTH, np.float32)
    if not text:
        return out
    pairs, triples = np.zeros(_PAIRS, np.int64), np.zeros(512, np.int64)
    for at in range(0, len(text), _AT_ONCE):
        codes = np.frombuffer(text, np.uint8, min(_AT_ONCE + 2, len(text) - at), at).astype(np.int32)
        pairs += np.bincount(_PAIR_TERM[(codes[:-1][:_AT_ONCE] << 8) | codes[1 : _AT_ONCE + 1]], minlength=_PAIRS)
        kind = _CLASS[codes]
        triples += np.bincount((kind[:-2] << 6) | (kind[1:-1] << 3) | kind[2:], minlength=512)
    words = text.split()
    n = len(words)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    rare = len(set(words))
    out[:_PAIRS] = np.sqrt(pairs / max(pairs.sum(), 1))
    out[_PAIRS : _PAIRS + 512] = np.sqrt(triples / max(triples.sum(), 1))
    if n:
        out[-4:] = np.sqrt([repeats / n, 1 - repeats / n, rare / n, 1 - rare / n]) * np.sqrt(0.5)
    return out


@dataclass(frozen=True)
class Model:
    """Term weights, mean and projection of the latent space; vectors and labels of the voters; their mean label."""

    weights: np.ndarray
    mean: np.ndarray
    projection: np.ndarray
    voters: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def latent(self, terms: np.ndarray) -> np.ndarray:
        vectors = (terms * self.weights - self.mean) @ self.projection
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        return vectors / np.where(norms > 0, norms, 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest voters; the mean label where nothing is similar."""
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        for at in range(0, len(texts), _BLOCK):
            terms = np.stack([term_vector(t) for t in texts[at : at + _BLOCK]])
            near = self.latent(terms) @ self.voters.T
            k = min(self.neighbours, near.shape[1])
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** 4
            total = weight.sum(axis=1)
            share = (weight * self.labels[best]).sum(axis=1) / np.where(total > 0, total, 1)
            seen = (total > 0) & terms.any(axis=1)
            out[at : at + _BLOCK] = np.where(seen, np.clip(share, 0.0, 1.0), self.prior)
        return out


def fit_arrays(terms: np.ndarray, labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    """Model from the term vectors and 0/1 labels of the sample; an empty sample scores 0.5 throughout."""
    if not len(labels):
        none = np.zeros((0, 1), np.float32)
        return Model(np.zeros(_WIDTH), np.zeros(_WIDTH), np.zeros((_WIDTH, 1)), none, np.zeros(0), 0.5, neighbours)
    held = (terms > 0).sum(axis=0)
    weights = np.log((len(terms) + 1) / (held + 1)).astype(np.float32) + 0.25
    weighted = terms * weights
    mean = weighted.mean(axis=0)
    centred = (weighted - mean).astype(np.float64)
    values, vectors = np.linalg.eigh(centred.T @ centred)
    projection = vectors[:, np.argsort(-values)[:rank]].astype(np.float32)
    model = Model(weights, mean, projection, np.zeros((0, 1)), labels.astype(np.float64), float(labels.mean()), neighbours)
    return Model(weights, mean, projection, model.latent(terms), model.labels, model.prior, neighbours)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a document's label must not be learnt from: crc32 of the id as text leaves 1 modulo 3. A NULL id is not."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    sample: int = SAMPLE,
) -> Model:
    """Model of the labelled documents outside the held-out fold, from at most ``sample`` of them.

    Ids whose labels are NULL or contradict each other are left out, as are labels without a document; of several
    texts with one id one votes. The sample's term vectors come to the driver: ``sample`` times six kilobytes.
    """
    known = (
        labels.where(F.col(id_column).isNotNull() & ~held_out(id_column))
        .groupBy(id_column)
        .agg(F.min(label_column).alias("least"), F.max(label_column).alias("most"))
        .where("least = most")
        .select(F.col(id_column).alias("known_id"), F.col("least").cast("int").alias("known_label"))
    )
    chosen = known.orderBy(F.xxhash64(F.col("known_id").cast("string"), F.lit(7)), "known_id").limit(sample)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "known_id": batch["known_id"],
                    "known_label": batch["known_label"],
                    "terms": [term_vector(bytes(t or b"")).tobytes() for t in batch["content"]],
                }
            )

    rows = (
        docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").cast("binary").alias("content"))
        .join(F.broadcast(chosen), F.col("id") == F.col("known_id"))
        .select("known_id", "known_label", "content")
        .mapInPandas(vectors, f"known_id {docs.schema[id_column].dataType.simpleString()}, known_label int, terms binary")
        .groupBy("known_id", "known_label")
        .agg(F.min("terms").alias("terms"))
        .orderBy("known_id")
        .collect()
    )
    terms = np.array([np.frombuffer(r.terms, np.float32) for r in rows]).reshape(len(rows), _WIDTH)
    return fit_arrays(terms, np.array([r.known_label for r in rows]))


def quality_score(docs: DataFrame, model: Model, text_column: str = "text") -> Column:
    """Score column of ``docs`` from 0 to 1, higher where label 1 is likelier; only the text is looked at.

    NULL and empty texts score the sample's mean label.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(shared.value.scores([bytes(t) if t is not None else b"" for t in part]))

    return score(F.col(text_column).cast("string").cast("binary"))


def classify(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality"
) -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 from 0.5 on).

    Each row is scored on its own and nothing is shuffled; repeated rows score alike. Long texts are read whole, in pieces
    of bounded memory. An empty table gives no rows; without usable labels every score is 0.5.
    """
    model = fit(docs, labels, id_column, text_column, label_column)
    scored = docs.select(id_column, held_out(id_column).alias("held_out"), quality_score(docs, model, text_column).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
