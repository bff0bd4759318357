"""Labelled rows to learn from: folds by crc32 of the id, and bounded samples in hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in no fold."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)).cast("int")


def sample(labels: DataFrame, label: str, learn: Column, most: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """id, y for at most `most` labelled ids (several labels: the greatest), in hash order."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & learn)
    one = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    return one.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most)


def texts_of(documents: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, y, text of the chosen ids; the sample's size is bounded, so it is broadcast. An id that rows repeat comes once, with its smallest text."""
    texts = documents.select(documents[id_col].cast("long").alias("id"), F.coalesce(documents[text_col].cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text"))


def fit_logistic(x, y, rounds: int = 60, ridge: float = 1e-3, even: bool = False):
    """Slope and offset of a logistic curve through (x, y), by Newton's method; `even`: as if both labels were equally frequent."""
    import numpy as np

    a, b = 1.0, 0.0
    each = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) if even else np.ones(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(each * (p - y) * x).sum() + ridge * a, (each * (p - y)).sum() + ridge * b])
        w = each * p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h, g)
        step = np.clip(step, -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
