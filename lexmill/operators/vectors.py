"""Exact nearest vectors by blocks of queries against blocks of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.lexical import top

#: Most vectors of a block.
BLOCK = 4096


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows of up to ``size`` vectors each: ids and unit vectors as bytes. Null vectors are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                m = np.array(part.column("vector").to_pylist(), np.float64)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["ids", "data"])

    return vectors.filter("id is not null and vector is not null").select("id", "vector").mapInArrow(pack, "ids binary, data binary")


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 10, size: int = BLOCK) -> DataFrame:
    """Best ``k`` of ``corpus`` (id, vector) by cosine for each of ``queries`` (id, vector), itself left out.

    Each pair of blocks gives its best k per query; the best of these are the
    result: ``qid, id, score, rank``. Equal scores (six decimals) go to the smaller id.
    """
    pairs = blocks(queries, size).select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data")).crossJoin(blocks(corpus, size))  # blocks, not rows

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for q_ids, q_data, ids, data in zip(f.q_ids, f.q_data, f.ids, f.data, strict=True):
                qi, ci = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                s = np.round(np.frombuffer(q_data).reshape(len(qi), -1) @ np.frombuffer(data).reshape(len(ci), -1).T, 6) + 0.0
                s[qi[:, None] == ci[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ci, s.shape), -s))[:, :k] if len(ci) <= 4 * k else np.array([(lambda c: c[np.lexsort((ci[c], -row[c]))][:k])(np.nonzero(row >= np.partition(row, -k)[-k])[0]) for row in s])
                rows = np.repeat(np.arange(len(qi)), order.shape[1])
                out = pd.DataFrame({"qid": qi[rows], "id": ci[order.ravel()], "score": s[rows, order.ravel()]})
                yield out[np.isfinite(out.score)]

    return top(pairs.mapInPandas(best, "qid bigint, id bigint, score double"), k)
