"""Quality score by compression (operator 10)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pingtrail.llm.common import map_arrow, sampled_pieces, stored, texts_of, winning_hashes
from pingtrail.llm.compression import compressor, pieces, size_under

LEVEL = 6


@dataclass(frozen=True)
class QualityModel:
    """Raw-content dictionaries of good and bad texts, and the logistic curve from size difference to probability."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    def score(self, difference: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * difference + self.offset))))


def differences(texts: list[str | None], good: bytes, bad: bytes) -> list[float]:
    """Bytes that the good dictionary saves against the bad one, as a share of the text's bytes; 0 for no text."""
    coders = compressor(good, LEVEL), compressor(bad, LEVEL)
    return [_difference(t, *coders) for t in texts]


def _difference(text: str | None, good, bad) -> float:
    data = (text or "").encode()
    parts = pieces(data)
    return (size_under(bad, parts) - size_under(good, parts)) / len(data) if data else 0.0


def learn_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", *,
                  texts_per_label: int = 1000, bytes_per_text: int = 256, texts_for_curve: int = 1000) -> QualityModel | None:
    """Dictionaries and curve from a bounded sample of labelled rows; None unless both labels occur.

    Up to ``texts_per_label`` texts of each label give ``bytes_per_text`` bytes each on average to its dictionary (256 KiB at
    most): pieces from anywhere in the whole text, picked by content, equal pieces once; texts that fit together are learnt
    whole. Up to ``texts_for_curve`` further texts of each fit the curve; each text is whole there. The
    two labels of the curve are weighted back to their shares among all labelled rows. Labels meet hashes of the
    texts; only sampled texts are fetched. Rows with null or empty text, a null id or a label
    other than 0 and 1 teach nothing; copies count once, a text under both labels counts for both.
    """
    known = labels.select(F.col(doc_id).alias("labelled_id"), F.col(quality).cast("int").alias("label")).where("label IN (0, 1)")
    hashed = (docs.where(F.length(text) > 0).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
              .join(known, F.col("id") == F.col("labelled_id")).select("label", "hash"))
    hashed = stored(hashed, "quality-labelled")
    counts = {r[0]: r[1] for r in hashed.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    sample = texts_of(docs, text, winning_hashes(hashed, texts_per_label + texts_for_curve))
    # half of the cells are for the dictionaries, the others for the curve
    first = F.pmod("hash", F.lit(texts_per_label + texts_for_curve)) < texts_per_label
    found = sampled_pieces(sample.where(first), str.encode, texts_per_label * bytes_per_text, "quality-pieces")
    content = {k: b"\n".join(found.get(k, [])) for k in (0, 1)}
    good, bad = content[1] or b"\n", content[0] or b"\n"

    def make():
        coders = compressor(good, LEVEL), compressor(bad, LEVEL)
        return lambda b: {"label": b.column(0), "x": [_difference(t, *coders) for t in b.column(1).to_pylist()]}

    measured = map_arrow(sample.where(~first).select("label", "text"), make, "label int, x double").collect()
    xs, ys = np.array([r.x for r in measured]), np.array([r.label for r in measured], dtype=float)
    total = sum(counts.values())
    weight = np.where(ys == 1, counts[1] / total / max(1, (ys == 1).sum()), counts[0] / total / max(1, (ys == 0).sum()))
    slope, offset = logistic_curve(xs, ys, weight * len(xs))
    return QualityModel(good, bad, slope, offset)


def logistic_curve(xs: np.ndarray, ys: np.ndarray, weights: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Weighted logistic fit of one variable by Newton steps on the standardised variable; ridge keeps separable data finite."""
    if not len(xs):
        return 0.0, 0.0
    centre, spread = float(xs.mean()), float(xs.std()) or 1.0
    design = np.column_stack([(xs - centre) / spread, np.ones(len(xs))])
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weights * (ys - p)) - ridge * beta
        hessian = (design * (weights * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / spread), float(beta[1] - beta[0] * centre / spread)


def score_quality(docs: DataFrame, model: QualityModel | None, text: str = "text", *, score: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality of each whole text.

    Null and empty texts get the curve's value at difference 0. Without a model every score is 0.5. Rows are
    scored one by one, so repeated rows, nulls in other columns and further columns do not matter; an input
    column named like the score is replaced.
    """
    kept = [c for c in docs.columns if c != score]
    if model is None:
        return docs.select(*kept, F.lit(0.5).alias(score))

    def make():
        coders = compressor(model.good, LEVEL), compressor(model.bad, LEVEL)

        def work(batch: pa.RecordBatch) -> dict:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            return {c: batch.column(batch.schema.get_field_index(c)) for c in kept} | {
                score: [model.score(_difference(t, *coders)) for t in texts]}

        return work

    return map_arrow(docs.select(*kept), make, StructType([*(docs.schema[c] for c in kept), StructField(score, DoubleType())]))
