"""Diversity by clusters of TF-IDF vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_tokens


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 20) -> np.ndarray:
    """The cluster of each row, by Lloyd's rounds from k-means++ centres; at most as many as there are different rows."""
    rng, k = np.random.default_rng(seed), min(k, len(np.unique(x, axis=0)))
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        far = ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
        centres = np.concatenate([centres, x[[rng.choice(len(x), p=far / far.sum())]]])
    for _ in range(rounds):
        at = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[at == c].mean(axis=0) if (at == c).any() else centres[c] for c in range(len(centres))])
    return ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)


def diverse(df: DataFrame, k: int = 5, terms: int = 128, seed: int = 42, key: str = "doc_id", group: str = "qid") -> DataFrame:
    """df: group, key, content, score -> for each group, whose rows are few, the best row of each of (at most) k clusters, with `cluster`."""
    words = df.withColumn("words", search_tokens(F.col("content")))
    kept = StopWordsRemover(inputCol="words", outputCol="kept").transform(words)
    tf = HashingTF(inputCol="kept", outputCol="tf", numFeatures=terms).transform(kept).select(group, key, "score", vector_to_array("tf").alias("tf"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(score_=-pdf["score"].round(9)).sort_values(["score_", key])
        x = np.stack(pdf["tf"].to_numpy())
        x = x * np.log((len(x) + 1) / ((x > 0).sum(axis=0) + 1))
        pdf["cluster"] = k_means(x, max(2, k), seed).astype(np.int32)
        return pdf.drop_duplicates("cluster").sort_values("cluster")[[group, key, "score", "cluster"]]

    kinds = {c: tf.schema[c].dataType.simpleString() for c in (group, key, "score")}
    return tf.groupBy(group).applyInPandas(best, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", cluster int")
