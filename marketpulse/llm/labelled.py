"""Labelled training rows: folds, bounded samples, and column sums of small matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import crc_mod, map_batches, stored, texts


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    modulus: int,
    held_out: int,
    max_rows: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Up to ``max_rows`` labelled rows outside the held-out fold, as (doc_id, text, label).

    Distinct documents are joined with their labels first, so the bound holds for the rows
    learned from: a repeated id cannot exceed it, and labels without a document do not use it
    up. Rows are taken in the order of a hash, so the sample does not depend on partitioning;
    texts are read for the rows taken only. Rows without an id or a label teach nothing.
    """
    given = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
        .filter("_id IS NOT NULL AND label IN (0, 1)")
        .filter(crc_mod("_id", modulus) != held_out)
        .distinct()
    )
    found = texts(docs, id_col, text_col).withColumn("_digest", F.md5(F.col("text").cast("binary")))
    keys = found.select("doc_id", "_digest").distinct()
    picked = (
        keys.join(given, keys.doc_id == given._id)
        .select("_id", F.col("_digest").alias("_taken"), "label")
        .orderBy(F.xxhash64("_id", "_taken"), "_id", "_taken", "label")
        .limit(max_rows)
    )
    # At most max_rows ids and digests, so the texts need no shuffle.
    side = F.broadcast(picked)
    rows = found.join(side, (found.doc_id == side._id) & (found._digest == side._taken))
    return stored(rows.select("doc_id", "text", "label").distinct(), "sample")


def matrix_sum(df: DataFrame, add, shape: tuple[int, int], block_rows: int = 1024) -> np.ndarray:
    """Sum over all rows of ``df`` of what ``add(matrix, row)`` adds to a matrix of ``shape``.

    Each task adds into its own matrix and passes it on in blocks of rows, which are summed
    by block; the driver gets one matrix, whose size does not depend on the rows.
    """
    n, width = shape

    def partial(batches):
        total = np.zeros(shape, np.float32)
        for batch in batches:
            for row in zip(*batch.values(), strict=True):
                add(total, row)
        starts = [s for s in range(0, n, block_rows) if total[s : s + block_rows].any()]
        yield {"start": starts, "data": [total[s : s + block_rows].tobytes() for s in starts]}

    def merge(key, pdf):
        total = sum(np.frombuffer(x, np.float32) for x in pdf["data"])
        return pdf.iloc[:1].assign(data=[total.tobytes()])

    schema = "start long, data binary"
    blocks = map_batches(df, partial, schema).groupBy("start").applyInPandas(merge, schema)
    out = np.zeros(shape, np.float32)
    for row in blocks.collect():
        part = np.frombuffer(row.data, np.float32).reshape(-1, width)
        out[row.start : row.start + len(part)] = part
    return out


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights (bias last) of a logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) * l2 * max(1, len(x))
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w
        )
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
