"""Similar pairs of vectors within a key, by blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def similar_pairs(rows: DataFrame, key: str, item: str, vector: str, threshold: float, block: int = 2048) -> DataFrame:
    """JOI-10 and VEC-04: key, a_id, b_id (a_id < b_id), cosine of all pairs of a key's items at or above the threshold;
    norms of at least 1e-9, cosines within [-1, 1].

    A key's items are dealt to blocks by a hash of the item; each pair of blocks is one unit of work, a matrix product, so
    a key with very many items spreads over tasks and no pair below the threshold leaves one. Items are copied once for each
    block of their key. Null vectors, and those with nulls, take no part; items are unique within a key."""
    kinds = dict(rows.dtypes)
    x = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull())).select(key, F.col(item).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    blocks = x.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    x = x.join(blocks, key).withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))
    cells = x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(key, "_id", "_v", "_b", F.least("_b", "_o").alias("_low"), F.greatest("_b", "_o").alias("_high"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        low, high = int(p["_low"].iloc[0]), int(p["_high"].iloc[0])
        ids, b = p["_id"].to_numpy(), p["_b"].to_numpy()
        v = np.array(p["_v"].tolist(), float).reshape(len(p), -1)
        v = v / np.maximum(np.sqrt((v * v).sum(1)), 1e-9)[:, None]
        one, two = np.flatnonzero(b == low), np.flatnonzero(b == high)
        c = np.clip(v[one] @ v[two].T, -1, 1)
        i, j = np.nonzero(c >= threshold)
        a, z = ids[one[i]], ids[two[j]]
        keep = a < z if low == high else np.ones(len(i), bool)
        return pd.DataFrame({key: p[key].iloc[0], "a_id": np.where(a < z, a, z)[keep], "b_id": np.where(a < z, z, a)[keep], "cosine": c[i, j][keep]})

    return cells.groupBy(key, "_low", "_high").applyInPandas(run, f"{key} {kinds[key]}, a_id {kinds[item]}, b_id {kinds[item]}, cosine double")
