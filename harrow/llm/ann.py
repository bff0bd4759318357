"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is taken relative to the nearest of a few centroids (k-means on a bounded
sample), turned by one random rotation, and kept as its sign bits and three scalars: its
distance to the centroid, the product of code and direction (the correction), and the
product of code and rotated centroid. With x the code over sqrt(d), f = <x, direction>,
<x, q> / f estimates <direction, q>, and the error is within

    z * sqrt((1 - f^2) / f^2 / (d - 1))  times |q|

but for a chance that falls as exp(-c z^2) (z = `error_scale`). A query first reranks the
vectors with the best estimates by their exact distances; the worst of its k best is a
radius, which shrinks as a partition's blocks go by. Every vector whose lower bound is inside
the radius is reranked as well, on the original components in double precision, so only a
failed bound can lose a neighbour.

The index holds every row. Queries are a stated set: they are dealt into chunks of at
most about `chunk` vectors, each chunk is broadcast (chunk x dimension x 4 bytes) and
meets all index rows where they lie; a partition gives k rows a query, merged by a window. For a
query set that grows with the table the work is its square, in bits: see the README for figures.

Defined results: vectors that are null, zero, of another length than `dim` (None: the
commonest length), or that hold null or non-finite components take no part; rows with
a null id neither; fewer candidates than k: all of them; ties go to the smaller id; rows that
repeat an id are candidates each, but never of a query with that id; no rows: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.scratch import Scratch


@dataclass(frozen=True)
class Index:
    """sample: most vectors that centroids are fitted on. chunk: expected queries broadcast at once."""

    centroids: int = 16
    sample: int = 4096
    iterations: int = 12
    error_scale: float = 3.0
    first_rerank: int = 48
    chunk: int = 8192
    seed: int = 11


def usable(vector: Column, dim: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, index: Index) -> np.ndarray:
    rng = np.random.default_rng(index.seed)
    k = min(index.centroids, len(sample))
    at = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(index.iterations):
        near = (((sample**2).sum(1)[:, None] - 2 * sample @ at.T) + (at**2).sum(1)[None]).argmin(1)
        for j in range(k):
            if (near == j).any():
                at[j] = sample[near == j].mean(0)
    return at


def encode(vectors: np.ndarray, centroids: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """Packed bits, centroid, distance to it, correction and code . rotated centroid, for each vector."""
    near = ((centroids**2).sum(1)[None] - 2 * vectors @ centroids.T).argmin(1)
    rest = vectors - centroids[near]
    norm = np.linalg.norm(rest, axis=1)
    turned = (rest / np.where(norm > 0, norm, 1)[:, None]) @ turn
    bits = turned > 0
    code = np.where(bits, 1.0, -1.0) / np.sqrt(vectors.shape[1])
    fix = np.where(norm > 0, (code * turned).sum(1), 1.0)
    return np.packbits(bits, axis=1), near, norm, fix, (code * (centroids @ turn)[near]).sum(1)


class Best:
    """The k nearest found so far of every query, over the blocks of a partition; the worst of them is the query's radius."""

    def __init__(self, q_ids: np.ndarray, queries: np.ndarray, k: int):
        self.q_ids, self.queries, self.k = q_ids, queries, k
        self.distance = np.full((len(queries), k), np.inf)
        self.id = np.zeros((len(queries), k), np.int64)

    def take(self, i: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Exact distances of vectors to query i, merged with what it has; of equal distances the smaller ids stay."""
        d = np.r_[self.distance[i], np.sqrt(((vectors - self.queries[i]) ** 2).sum(1))]
        every = np.r_[self.id[i], ids]
        order = np.lexsort((every, d))[: self.k]
        self.distance[i], self.id[i] = d[order], every[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.nonzero(np.isfinite(self.distance))
        return self.q_ids[i], self.id[i, j], self.distance[i, j]


def search_block(best: Best, ids, vectors, coded, centroids, turn, index: Index) -> None:
    """Reranks the vectors of a block whose lower bound is within a query's radius; a query that has
    no k neighbours yet takes those with the best estimates first."""
    bits, near, norm, fix, offset = coded
    dim = vectors.shape[1]
    code = (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    for start in range(0, len(best.queries), 256):
        q = best.queries[start : start + 256]
        gap2 = ((q[:, None] - centroids[None]) ** 2).sum(2)[:, near]  # |q - c|^2 for each vector's own centroid
        product = (q @ turn).astype(np.float32) @ code.T - offset.astype(np.float32)[None]
        estimate = norm[None] ** 2 + gap2 - 2 * norm[None] * product / fix[None]
        error = 2 * norm[None] * np.sqrt(gap2) * (index.error_scale * np.sqrt(np.maximum(0, 1 - fix**2) / fix**2 / max(1, dim - 1)))[None]
        estimate = np.where(best.q_ids[start : start + 256][:, None] == ids[None], np.inf, estimate)
        low = estimate - error
        for i in range(len(q)):
            live = np.isfinite(estimate[i])
            if not np.isfinite(best.distance[start + i, -1]):
                first = min(max(index.first_rerank, best.k), len(ids))
                at = np.argpartition(estimate[i], first - 1)[:first]
                at = at[live[at]]
                best.take(start + i, ids[at], vectors[at])
                live[at] = False
            radius = best.distance[start + i, -1]
            more = np.flatnonzero(live & (low[i] <= radius * radius * (1 + 1e-6) + 1e-9))
            if len(more):
                best.take(start + i, ids[more], vectors[more])


def _matrix(column) -> np.ndarray:
    """A list<float|double> column without nulls as a double matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def build_index(vectors: DataFrame, scratch: Scratch, dim: int, index: Index, id_col: str, vector_col: str):
    """(index table, centroids, rotation): every usable row with its code and scalars."""
    import pyarrow as pa

    rows = vectors.where(usable(F.col(vector_col), dim) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    picked = rows.orderBy(F.xxhash64(F.lit(index.seed), "vec_id"), "vec_id").limit(index.sample).select("vector").toPandas()
    if not len(picked):
        return None
    centroids, turn = fit_centroids(np.stack(picked["vector"].to_numpy()), index), rotation(dim, index.seed)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                bits, near, norm, fix, offset = encode(_matrix(batch.column(1)), centroids, turn)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(near.astype(np.int32)), pa.array(norm), pa.array(fix), pa.array(offset)],
                    names=["vec_id", "vector", "bits", "near", "norm", "fix", "offset"],
                )

    coded = rows.mapInArrow(run, "vec_id long, vector array<double>, bits binary, near int, norm double, fix double, offset double")
    return scratch.keep(coded, "index"), centroids, turn


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, dim: int | None = None, index: Index = Index(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): the k nearest of each query, its own id left out."""
    import pyarrow as pa

    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dim is None:
        common = vectors.groupBy(F.size(vector_col).alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), "dim").first()
        if common is None:
            return none
        dim = common["dim"]
    built = build_index(vectors, scratch, dim, index, id_col, vector_col)
    if built is None:
        return none
    table, centroids, turn = built
    asked = queries.where(usable(F.col(vector_col), dim) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = scratch.keep(asked.dropDuplicates(["query_id"]), "queries")
    n = asked.count()
    chunks = max(1, -(-n // index.chunk))
    parts = []
    for c in range(chunks):
        chunk = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == c).toPandas()
        if not len(chunk):
            continue
        sent = spark.sparkContext.broadcast((chunk["query_id"].to_numpy(np.int64), np.stack(chunk["vector"].to_numpy())))

        def run(batches, sent=sent):
            best = Best(*sent.value, k)
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    batch = whole.slice(at, 4096)
                    ids, matrix = batch.column(0).to_numpy(), _matrix(batch.column(1))
                    bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
                    search_block(best, ids, matrix, (bits, *(batch.column(i).to_numpy() for i in (3, 4, 5, 6))), centroids, turn, index)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows()], names=["query_id", "vec_id", "score"])

        found = table.mapInArrow(run, "query_id long, vec_id long, score double")
        parts.append(scratch.keep(found, f"found-{c}"))
    if not parts:
        return none
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
