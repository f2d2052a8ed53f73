"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

Hashed n-gram features of a bounded sample of labelled texts give a truncated singular value
decomposition; every text is projected to unit vectors of that space, its cosines to all labelled
vectors are computed exactly in blocks, and the nearest ``neighbours`` vote with their similarity as
weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import schema_with, small_batches
from factorloom.llm.features import quality_features


class LatentModel(NamedTuple):
    """What is broadcast: at most 2 x ``per_class`` labelled vectors of ``dims`` and one projection."""

    mean: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int
    power: float

    def embed(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.project
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by a power of the cosine; the prior for rows without features.

        Of equal cosines the vectors of lesser ids count first, so the sample alone decides.
        """
        if not len(self.labels):
            return np.full(len(x), self.prior)
        cosines = self.embed(x) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(cosines, near, 1).min(axis=1, keepdims=True)
        tied = np.flatnonzero((cosines >= least).sum(axis=1) > k)
        near[tied] = np.argsort(-cosines[tied], axis=1, kind="stable")[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(np.float64) ** self.power
        votes = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.where(x.any(axis=1), votes, self.prior)


def truncated_svd(x: np.ndarray, dims: int, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors by a randomised range finder with two power iterations."""
    dims = min(dims, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[0], min(dims + 16, *x.shape))).astype(np.float32)
    for _ in range(3):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:dims].T


def labelled_sample(documents: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, learn, per_class: int) -> DataFrame:
    """(id, label, text): per label 0 and 1 at most ``per_class`` ids, those with the smallest hashes, with their texts.

    Ids that are null, have no label 0 or 1, or have both, are left out. An id with several texts takes the least.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_label"), F.max(label_col).alias("_most")).where("_label = _most").select(F.col(id_col).alias("_id"), "_label")
    present = documents.select(F.col(id_col).alias("_id")).distinct()
    known = known.where(learn("_id")).join(present, "_id", "left_semi")
    ids = [known.where(F.col("_label") == y).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))  # at most 2 x per_class rows of two numbers
    return documents.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(chosen, "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))


def rounded_features(texts: list[str | None]) -> np.ndarray:
    """Features of texts in half precision, for sample and scored texts alike: a text of the sample is its own nearest neighbour."""
    return np.stack([quality_features(t).astype(np.float16) for t in texts])


def fit_quality(documents: DataFrame, labels: DataFrame, learn, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = 1536, dims: int = 64, neighbours: int = 9, power: float = 3.0) -> LatentModel:
    """Fit on a bounded sample: at most ``per_class`` labelled texts a class.

    ``learn`` takes a column name and gives the condition for ids that may be learnt from. The sample is in order of its texts' digests, which
    decides between equal neighbours, so ids have no part in a score. Without any
    labelled text every score is 0.5.
    """
    small_batches(documents.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.tobytes() for t in batch.column(1).to_pylist() for x in rounded_features([t])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["y", "x"])

    sample = labelled_sample(documents, labels, label_col, id_col, text_col, learn, per_class)
    rows = sample.select(F.col("_label").cast("int").alias("_label"), "_text").orderBy(F.sha2("_text", 256), "_label").mapInArrow(features, "y int, x binary").collect()
    y = np.array([r["y"] for r in rows], np.float32)
    width = len(quality_features(""))
    if not len(y):
        return LatentModel(np.zeros(width, np.float32), np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5, neighbours, power)
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    mean = x.mean(0)
    project = truncated_svd(x - mean, dims).astype(np.float32)
    model = LatentModel(mean, project, np.zeros((0, 1), np.float32), y, float(y.mean()), neighbours, power)
    return model._replace(vectors=model.embed(x))


def quality_scores(df: DataFrame, model: LatentModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with score (double, 0 to 1) and predicted (1 from 0.5 on) for every row.

    Whole texts are used. A null or empty text scores the share of label 1 in the fitted sample; repeated
    rows stay; an empty table gives an empty result; other columns of ``df`` are not read.
    """
    small_batches(df.sparkSession)
    fitted = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if not texts:
                continue
            s = np.clip(fitted.value.score(rounded_features(texts).astype(np.float32)), 0.0, 1.0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    schema = schema_with(df, keep, "score double, predicted int")
    return df.select(*keep, F.col(text_col).alias("_text")).mapInArrow(score, schema)
