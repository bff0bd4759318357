"""Vector code compression: product codes by exact integer Lloyd rounds over distinct parts.

Each component x becomes the integer floor(scale * x), each vector is cut into equal consecutive
parts, and every position's parts get a codebook of their own. Equal parts of a position are one
distinct row with a weight (how often it occurs), so a vector that a third of all rows repeat is
four rows. A round assigns every distinct row to its nearest entry (ties to the lower index) and
replaces each entry by the floor of its weighted mean; entries without rows stay. At the end codes
and errors go back to the vectors by a join on (position, part). All arithmetic is on whole
numbers, so the result doesn't depend on how Spark deals the rows.

Scale: the integers are written once and read twice, to be counted (partial aggregation, so copies
melt in their task) and to be joined. A round reads the distinct rows and shuffles one row of sums for
each task, position and entry; the driver gets those sums (positions x entries rows), and the
codebooks go out with the tasks: both of fixed size. In the join back, parts that hold more than
a HOT-th of all rows (so fewer than HOT of a position) are broadcast, all others
are joined by shuffle, where no key has more than that share. The sums by label do the same.

Defined results: vectors that are null, hold null or non-finite components, or a component whose
integer is beyond LIMIT (its squared errors wouldn't fit a long) take no part; nor do empty
vectors and those of another than the commonest length (the longest of equally common ones), which
has to be a multiple of `parts`. Zero vectors take part. Rows that repeat an id or a vector are rows of their own; null ids come after
all others in the choice of the first codebook. Fewer vectors than `entries`: as many entries.
Null labels are one label. Extra columns are ignored, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.scratch import Scratch

LIMIT, HOT = 1 << 28, 512
#: Up to this size a part's squared distances are exact in double precision.
EXACT = 1 << 21


def _integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def _sound(vector: Column, scale: int) -> Column:
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < LIMIT, F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def _nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equal ones) and its squared distance, for each row; exact."""
    kind = np.float64 if max(np.abs(rows).max(initial=0), np.abs(book).max(initial=0)) <= EXACT else np.int64
    x, c = rows.astype(kind), book.astype(kind)
    codes, errors = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 4096):
        block = x[at : at + 4096]
        far = (c * c).sum(1)[None, :] - 2 * (block @ c.T)
        best = far.argmin(1)
        codes[at : at + 4096] = best
        errors[at : at + 4096] = (far[np.arange(len(block)), best] + (block * block).sum(1)).astype(np.int64)
    return codes, errors


def _columns(batch):
    """Positions, parts as a matrix, weights of a batch of distinct rows."""
    parts = batch.column(1)
    width = len(parts[0].as_py()) if batch.num_rows else 0
    return np.asarray(batch.column(0)), np.asarray(parts.flatten()).reshape(batch.num_rows, width), np.asarray(batch.column(2))


def _round(batches, books: list[np.ndarray]):
    """Sums of weighted parts and of weights by position and entry, one row each for the whole task."""
    import pyarrow as pa

    sums = [np.zeros(b.shape, np.int64) for b in books]
    counts = [np.zeros(len(b), np.int64) for b in books]
    for batch in batches:
        if not batch.num_rows:
            continue
        positions, rows, weights = _columns(batch)
        for p, book in enumerate(books):
            own = positions == p
            if own.any():
                codes, _ = _nearest(rows[own], book)
                np.add.at(sums[p], codes, rows[own].astype(np.int64) * weights[own][:, None])
                np.add.at(counts[p], codes, weights[own])
    for p, book in enumerate(books):
        used = np.flatnonzero(counts[p])
        if len(used):
            columns = [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[p][used])]
            columns += [pa.array(sums[p][used, i].copy()) for i in range(book.shape[1])]
            yield pa.RecordBatch.from_arrays(columns, names=["position", "entry", "n", *[f"s{i}" for i in range(book.shape[1])]])


def _coded(batches, books: list[np.ndarray]):
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        positions, rows, _ = _columns(batch)
        codes, errors = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for p, book in enumerate(books):
            own = positions == p
            codes[own], errors[own] = _nearest(rows[own], book)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.astype(np.int32)), pa.array(errors)], names=["position", "part", "weight", "entry", "error"])


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """rows joined to facts (one for each key): the few facts that `hot` names are broadcast, all others meet their rows by shuffle."""
    few, others = F.broadcast(facts.where(hot)), facts.where(~hot)
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(others, keys))


class Codes:
    """`codes`: one row for each kept vector, with `vec_id`, `label`, `entries` (array, by position) and `error`;
    `books`: for each position its entries as a matrix of integers."""

    def __init__(self, codes: DataFrame, books: list[np.ndarray]):
        self.codes, self.books = codes, books

    def book_text(self) -> str:
        """All entries' components in decimal, by position, entry and place, joined by commas."""
        return ",".join(str(int(x)) for book in self.books for x in book.ravel())

    def decode(self, scale: int = 1024) -> DataFrame:
        """vec_id and the vector that its codes stand for (each entry's components over scale)."""
        books = [F.array(*[F.array(*[F.lit((int(x) + 0.5) / scale) for x in entry]) for entry in book]) for book in self.books]
        return self.codes.select("vec_id", F.concat(*[F.element_at(book, F.col("entries")[p] + 1) for p, book in enumerate(books)]).alias("vector"))


def compress(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> Codes:
    """Codes, errors and codebooks of all sound vectors; a row's codes are below `entries`."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    sound = vectors.where(_sound(vectors[vector_col], scale))
    ints = sound.select(sound[id_col].cast("long").alias("vec_id"), sound[label_col].alias("label"), _integers(sound[vector_col], scale).alias("v"))
    ints = scratch.keep(ints.withColumn("row", F.monotonically_increasing_id()), "integers")  # a row's number must not change between the uses
    common = ints.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    if not dim or dim % parts:
        empty = ints.where("false").select("vec_id", "label", F.array().cast("array<int>").alias("entries"), F.lit(0).cast("long").alias("error"))
        return Codes(empty, [np.zeros((0, 0), np.int64)] * parts)
    width = dim // parts
    ints = ints.where(F.size("v") == dim)
    start = ints.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    seeds = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, width)
    books = [seeds[:, p].copy() for p in range(parts)]

    cut = F.array(*[F.struct(F.lit(p).alias("position"), F.slice("v", p * width + 1, width).alias("part")) for p in range(parts)])
    pieces = ints.select("vec_id", "label", "row", F.explode(cut).alias("x")).select("vec_id", "label", "row", "x.*")
    distinct = scratch.keep(pieces.groupBy("position", "part").agg(F.count("*").alias("weight")), "distinct")
    sums = "position int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(width))
    for _ in range(rounds):
        met = distinct.mapInArrow(partial(_round, books=books), sums).groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
        books = [b.copy() for b in books]
        for r in met.collect():  # positions x entries rows
            books[r["position"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    coded = scratch.keep(distinct.mapInArrow(partial(_coded, books=books), "position int, part array<int>, weight long, entry int, error long"), "coded")
    scratch.drop("distinct")
    n = coded.where("position = 0").agg(F.sum("weight")).first()[0]
    back = join_hot(pieces, coded, ["position", "part"], F.col("weight") * HOT > n)
    by_row = back.groupBy("row", "vec_id", "label").agg(
        *[F.sum(F.when(F.col("position") == p, F.col("entry"))).cast("int").alias(f"e{p}") for p in range(parts)], F.sum("error").alias("error")
    )
    codes = scratch.keep(by_row.select("vec_id", "label", F.array(*[f"e{p}" for p in range(parts)]).alias("entries"), "error"), "codes")
    scratch.only("codes")
    return Codes(codes, books)


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with `label_error`: the error summed over all rows of the same label, nulls together."""
    # equal labels meet by value and by whether there is one
    rows = codes.withColumns({"label_text": F.coalesce(F.col("label").cast("string"), F.lit("")), "unlabelled": F.col("label").isNull()})
    sums = rows.groupBy("label_text", "unlabelled").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    total = codes.count()
    return join_hot(rows, sums, ["label_text", "unlabelled"], F.col("n") * HOT > total).drop("label_text", "unlabelled", "n")
