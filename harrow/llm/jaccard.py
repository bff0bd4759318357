"""N-gram Jaccard self-join over word shingles: count-vector R-trees over exact prefix partitions.

A document is the set of hashes of its distinct 5-word shingles. Two documents link when
100 |A n B| >= 75 |A u B|; components of the links are the groups. Steps:

1. Equal sets fall into classes; one representative (smallest doc_id) stands for a class.
2. Partitions. Linked sets share at least 3/4 of the larger one, so they share a shingle
   among the first n/4 + 1 of each, in any common order of shingles. The order is by hash,
   with shingles known to be frequent last, which keeps common passages out. The members of
   all such shingles with the same smallest member form one partition, each member once.
   (One tree over everything has nothing to split by: counts of hashed tokens differ less
   between unrelated documents of a size than a link allows, until there are more groups
   than an R-tree can separate. See the README.)
3. Count vectors. Shingles are hashed into GROUPS groups; a set's group counts are a point,
   and the summed coordinate minima of two points bound their overlap. A partition's points
   are packed into an R-tree; pairs of nodes whose upper corners allow too little overlap are
   dropped, then pairs of points. Only pairs that the tree lets through are candidates, and
   only candidates become links: by finer points first, then on the whole sets.
4. Rounds. The first round takes of a partition's candidates a spanning forest, the strongest
   bounds first: verified, it joins most groups with as many pairs as members. Partitions that
   still hold several components give a forest between these, then all candidates between
   different components that haven't been verified. Large partitions go in pieces: in the first
   round each with the smallest member; later, components too large for a piece meet the others
   piece by piece, never themselves.

Every linked pair is in one partition, and there is verified or already in one component:
no link between different components is lost. Shingles are compared by 64-bit hash.

Defined results: null or wordless texts have no shingles and link with nothing; texts of
fewer words than a shingle have one, the whole sequence; equal texts link; repeated rows
each give a row, and are one document to the join; null ids are their own component (null);
no rows: no rows; very long texts count whole; extra columns are ignored whatever their names.
A doc_id should name one text; where it names several, each row is grouped by its own text, and
texts for which the id stands as the smallest are one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.components import components
from harrow.scratch import Scratch

WIDTH = 5
#: Groups of a point by size of the set: unrelated sets of n shingles differ enough from about 0.1 n groups on.
GROUPS = 128
TIERS = ((1024, GROUPS), (8192, 1024), (1 << 62, 4096))
#: Words of 64 bits in the filter for the texts to verify (8 MB), used up to so many ids; beyond, texts are joined to the ids.
FILTER_WORDS, FILTER_IDS = 1 << 20, 1 << 23
#: So few ids are sent to the scan of the texts themselves (800 kB).
FEW_IDS = 100_000
#: A shingle in so many documents of one Python batch is a candidate for the frequent list.
BATCH_FREQUENT = 4
#: Frequent shingles: at least so many documents; the list is bounded, beyond it the order is by hash alone.
FREQUENT, FREQUENT_LIST = 24, 1 << 17
#: Members of a partition that a tree holds at once.
PIECE = 256
LEAF = 16


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; A-Z count as a-z."""
    import xxhash

    found = text.encode().lower().split() if text else []  # bytes: ASCII letters and white space only
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), len(found))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, found), np.uint64, len(found))
    n = len(found) - WIDTH + 1
    out = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def counts(hashes: np.ndarray) -> bytes:
    """The point of a set: how many of its hashes fall into each group, behind a byte that tells the width of a count. The finer tiers fold onto the coarser."""
    groups = next(g for most, g in TIERS if len(hashes) < most)
    found = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % groups, minlength=groups)
    width = 1 if found.max() < 1 << 8 else 2 if found.max() < 1 << 16 else 4
    return bytes([width]) + found.astype(f"<u{width}").tobytes()


def point_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """A point of a multiple of so many groups, on the coarser groups."""
    return point.astype(np.int64).reshape(-1, groups).sum(0)


def coarse_points(raws: list[bytes]) -> np.ndarray:
    """All points on GROUPS groups, a row each."""
    if all(len(r) == GROUPS + 1 for r in raws):  # one byte a count: only then a point is so short
        return np.frombuffer(b"".join(raws), np.uint8).reshape(-1, GROUPS + 1)[:, 1:].astype(np.int64)
    return np.stack([folded(point_of(r), GROUPS) for r in raws])


def fine_counts(hashes: np.ndarray) -> bytes:
    """A point of about two groups to a shingle, a byte each (empty if a count needs more)."""
    groups = max(GROUPS, 1 << (2 * len(hashes) - 1).bit_length())
    point = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % groups, minlength=groups)
    return point.astype(np.uint8).tobytes() if point.max() < 256 else b""


def prefix(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first n/4 + 1 hashes, frequent ones last."""
    n = len(hashes)
    need = n - (3 * n + 3) // 4 + 1
    if len(frequent):
        common = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
        hashes = np.concatenate([hashes[~common], hashes[common]])
    return hashes[:need]


def _frequent_of(batches):
    import pyarrow as pa

    for batch in batches:
        seen, sets = set(), []
        for text in batch.column(0):
            text = text.as_py()
            if text and (key := hash(text)) not in seen:  # copies in a batch count once
                seen.add(key)
                sets.append(shingles(text))
        if sets:
            values, n = np.unique(np.concatenate(sets), return_counts=True)
            values, n = values[n >= BATCH_FREQUENT], n[n >= BATCH_FREQUENT]
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])


def _sets_of(frequent):
    def run(batches):
        import pyarrow as pa
        import xxhash

        known = frequent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, first, second, heads, points = [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingles(text)
                    raw = s.tobytes()
                    sizes.append(len(s))
                    digest = np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64)
                    first.append(int(digest[0]))
                    second.append(int(digest[1]))
                    heads.append(prefix(s, known).view(np.int64) if len(s) else np.empty(0, np.int64))
                    points.append(counts(s))
                offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists, pa.array(points, pa.binary())],
                    names=["doc_id", "n", "c1", "c2", "head", "point"],
                )

    return run


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit for each id, gathered as at most FILTER_WORDS words; other ids may share a bit."""
    import pyarrow as pa

    def bits(batches):
        for batch in batches:
            at = (_mixed(batch.column(0).to_numpy()) % np.uint64(FILTER_WORDS * 64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    words = ids.mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_WORDS, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _whole_sets(batches, bits=None):
    """id, n, fine point and hashes of texts; with `bits` only of the ids that it has."""
    import pyarrow as pa

    for whole in batches:
        if bits is not None:
            whole = whole.filter(pa.compute.is_valid(whole.column(0)))
            at = (_mixed(whole.column(0).to_numpy()) % np.uint64(FILTER_WORDS * 64)).astype(np.int64)
            whole = whole.filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([fine_counts(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "n", "fine", "hashes"]
            )


def _close(batches):
    """Pairs whose fine points allow a link."""
    import pyarrow as pa

    for whole in batches:
        a, b, na, nb = (whole.column(i).to_numpy() for i in range(4))
        hit = np.ones(len(a), bool)
        for i, (x, y) in enumerate(zip(whole.column(4), whole.column(5), strict=True)):
            x, y = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
            if len(x) and len(y):
                groups = min(len(x), len(y))
                hit[i] = _can_link(na[i], nb[i], np.minimum(folded(x, groups), folded(y, groups)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(a[hit]), pa.array(b[hit])], names=["a", "b"])


def linked(na: int, nb: int, both: int) -> bool:
    return 100 * both >= 75 * (na + nb - both)


def _verified(batches):
    import pyarrow as pa

    for whole in batches:
        a, b = whole.column(0).to_numpy(), whole.column(1).to_numpy()
        hit = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(whole.column(2), whole.column(3), strict=True)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            hit[i] = linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a[hit]), pa.array(b[hit])], names=["a", "b"])


def _can_link(na: np.ndarray, nb: np.ndarray, most: np.ndarray) -> np.ndarray:
    return 175 * most >= 75 * (na + nb)


class RTree:
    """Points packed bottom-up in order of size, then of their coordinates; a node keeps its upper corner and least size."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        order = np.lexsort((points[:, 0], points[:, 1], sizes)) if len(sizes) > 1 else np.arange(len(sizes))
        self.order, self.sizes, self.points = order, sizes[order].astype(np.int64), points[order].astype(np.int32)
        upper, least, most = self.points, self.sizes, self.sizes
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(least) > 1 or not self.levels:
            starts = np.arange(0, len(least), LEAF)
            upper, least, most = np.maximum.reduceat(upper, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)
            self.levels.append((upper, least, most))
            if len(least) == 1:
                break

    def pairs(self, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of points (places in the input, each pair once) of different components that may link, with the bounds of their overlap."""
        comp = comp[self.order]
        todo = [(len(self.levels) - 1, 0, 0)]
        out_a, out_b, out_most = [], [], []
        while todo:
            level, x, y = todo.pop()
            if level == 0:
                i, j = np.arange(x * LEAF, min((x + 1) * LEAF, len(comp))), np.arange(y * LEAF, min((y + 1) * LEAF, len(comp)))
                bound = np.minimum(self.points[i][:, None], self.points[j][None]).sum(2, dtype=np.int64)
                na, nb = self.sizes[i][:, None], self.sizes[j][None]
                bound = np.minimum(bound, np.minimum(na, nb))
                fits = _can_link(na, nb, bound) & (comp[i][:, None] != comp[j][None])
                if x == y:
                    fits = np.triu(fits, 1)
                p, q = np.nonzero(fits)
                out_a.append(i[p])
                out_b.append(j[q])
                out_most.append(bound[p, q])
                continue
            upper, least, most = self.levels[level - 1]
            xs = np.arange(x * LEAF, min((x + 1) * LEAF, len(least)))
            ys = np.arange(y * LEAF, min((y + 1) * LEAF, len(least)))
            bound = np.minimum(upper[xs][:, None], upper[ys][None]).sum(2, dtype=np.int64)
            fits = _can_link(least[xs][:, None], least[ys][None], bound) & (4 * most[xs][:, None] >= 3 * least[ys][None]) & (4 * most[ys][None] >= 3 * least[xs][:, None])
            if x == y:
                fits = np.triu(fits)
            todo += [(level - 1, int(p), int(q)) for p, q in zip(*(v[k] for v, k in zip((xs, ys), np.nonzero(fits), strict=True)), strict=True)]
        if not out_a:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        return self.order[np.concatenate(out_a)], self.order[np.concatenate(out_b)], np.concatenate(out_most)


def forest(n: int, p: np.ndarray, q: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Places of the pairs (p, q) that form a spanning forest of the n nodes, the strongest first (Prim, from each node not reached yet)."""
    near = np.full((n, n), -1.0)
    place = np.zeros((n, n), np.int64)
    order = np.argsort(strength, kind="stable")  # of several pairs of the same nodes the strongest stays
    p, q, strength = p[order], q[order], strength[order]
    near[p, q] = near[q, p] = strength
    place[p, q] = place[q, p] = order
    out, rest = [], np.ones(n, bool)
    best, via = np.full(n, -1.0), np.zeros(n, np.int64)
    for _ in range(n):
        node = int(np.argmax(np.where(rest, best, -2.0)))
        if best[node] >= 0:
            out.append(via[node])
        rest[node] = False
        closer = rest & (near[node] > best)
        best[closer], via[closer] = near[node][closer], place[node][closer]
    return np.array(out, np.int64)


def _runs(batches, keys: int):
    """Tables of the rows that agree in the first `keys` columns; the rows come sorted by them."""
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        new = np.r_[True, np.zeros(batch.num_rows - 1, bool)]
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(int(c[a]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _candidates(batches, keys: int, sparse: bool):
    """Members sorted by partition and piece (keys, id, component, side, n, point) -> pairs that the R-tree lets through,
    of different components and sides (side 0 with itself and with 1; -1 with itself); `sparse`: a spanning forest of the components."""
    import pyarrow as pa

    for run in _runs(batches, keys):
        if run.num_rows < 2:
            continue
        ids, comp, side, sizes = (run.column(keys + i).to_numpy() for i in range(4))
        if (comp == comp[0]).all():
            continue
        raws = run.column(keys + 4).to_pylist()
        p, q, most = RTree(sizes, coarse_points(raws)).pairs(comp)
        keep = (side[p] != side[q]) | (side[p] < 0)  # two pieces: pairs inside a piece are found elsewhere
        for i in np.flatnonzero(keep).tolist():
            x, y = raws[p[i]], raws[q[i]]
            if len(x) > 4 * GROUPS + 1 and len(y) > 4 * GROUPS + 1:
                x, y = point_of(x), point_of(y)
                groups = min(len(x), len(y))
                keep[i] = _can_link(sizes[p[i]], sizes[q[i]], np.minimum(folded(x, groups), folded(y, groups)).sum())
        p, q, most = p[keep], q[keep], most[keep]
        if sparse and len(p):
            names, node = np.unique(comp, return_inverse=True)
            take = forest(len(names), node[p], node[q], most / (sizes[p] + sizes[q]))
            p, q = p[take], q[take]
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[p], ids[q])), pa.array(np.maximum(ids[p], ids[q]))], names=["a", "b"])


def _verify(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links among the pairs (a, b): by fine points first, then the whole sets are compared."""
    spark = pairs.sparkSession
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ids = scratch.keep(ids, f"{name}-ids")
    n = ids.count()
    schema = "id long, n long, fine binary, hashes binary"
    if n <= FEW_IDS:
        sets = texts.join(F.broadcast(ids), "id", "left_semi").mapInArrow(_whole_sets, schema)
    elif n <= FILTER_IDS:
        sent = spark.sparkContext.broadcast(_filter_of(ids))
        sets = texts.mapInArrow(lambda batches: _whole_sets(batches, sent.value), schema)
    else:
        sets = texts.join(ids, "id", "left_semi").mapInArrow(_whole_sets, schema)
    sets = scratch.keep(sets, f"{name}-sets")
    of = lambda side, n, col, to: sets.select(F.col("id").alias(side), F.col("n").alias(n), F.col(col).alias(to))
    both = pairs.join(of("a", "na", "fine", "x"), "a").join(of("b", "nb", "fine", "y"), "b").select("a", "b", "na", "nb", "x", "y")
    close = scratch.keep(both.mapInArrow(_close, "a long, b long"), f"{name}-close")
    both = close.join(of("a", "na", "hashes", "x"), "a").join(of("b", "nb", "hashes", "y"), "b").select("a", "b", "x", "y")
    links = scratch.keep(both.mapInArrow(_verified, "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-ids", f"{name}-sets", f"{name}-close")
    return links


def _first_round(bundles: DataFrame, classes: DataFrame) -> DataFrame:
    """bundles: least, id -> candidates: of every piece of a partition, with its smallest member, a spanning forest."""
    sizes = bundles.groupBy("least").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("k"))
    dealt = bundles.where("id != least").join(sizes, "least").select("least", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("piece"), "id")
    heads = sizes.select("least", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("piece"), F.col("least").alias("id"))
    members = dealt.unionByName(heads).join(classes.select("id", "n", "point"), "id")
    rows = members.select("least", "piece", "id", F.col("id").alias("component"), F.lit(-1).cast("int").alias("side"), "n", "point")
    rows = rows.repartition("least", "piece").sortWithinPartitions("least", "piece")
    return rows.mapInArrow(lambda batches: _candidates(batches, 2, True), "a long, b long")


def _next_round(bundles: DataFrame, classes: DataFrame, grouped: DataFrame, tried: DataFrame, sparse: bool, scratch: Scratch, name: str) -> DataFrame | None:
    """Candidates between the components of the partitions that still hold several, without those tried; None if there are no such partitions."""
    members = bundles.join(grouped.withColumnRenamed("node", "id"), "id", "left").select("least", "id", F.coalesce("component", "id").alias("component"))
    open_ones = members.groupBy("least").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("least")
    members = scratch.keep(members.join(open_ones, "least").join(classes.select("id", "n"), "id"), f"{name}-members")
    if members.isEmpty():
        return None
    # Units that meet: components of a piece or more, each by itself, and pools of the smaller ones.
    parts = members.groupBy("least", "component").agg(F.count("*").alias("c"))
    pools = parts.where(F.col("c") < PIECE).groupBy("least").agg(F.ceil(F.sum("c") / PIECE).cast("long").alias("pools"))
    large = parts.where(F.col("c") >= PIECE).select("least", "component", F.lit(0).alias("kind"), F.col("component").alias("unit"), F.ceil(F.col("c") / PIECE).cast("int").alias("k"))
    small = parts.where(F.col("c") < PIECE).join(pools, "least").select("least", "component", F.lit(1).alias("kind"), F.pmod(F.xxhash64("component"), "pools").alias("unit"), F.lit(1).alias("k"))
    members = members.join(large.unionByName(small), ["least", "component"])
    members = scratch.keep(members.select("least", "kind", "unit", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("piece"), "k", "id", "component", "n"), f"{name}-dealt")
    units = members.groupBy("least", "kind", "unit").agg(F.max("k").alias("k"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    a, b = units.alias("a"), units.alias("b")
    meet = (
        (F.col("a.least") == F.col("b.least"))
        & (F.struct("a.kind", "a.unit") <= F.struct("b.kind", "b.unit"))
        & ((F.col("a.lo") != F.col("b.lo")) | (F.col("a.hi") != F.col("b.hi")) | (F.col("a.lo") != F.col("a.hi")))
        & (F.col("a.most_n") * 4 >= F.col("b.least_n") * 3)
        & (F.col("b.most_n") * 4 >= F.col("a.least_n") * 3)
    )
    self_meets = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.unit") == F.col("b.unit"))
    of = lambda side: F.struct(f"{side}.kind", f"{side}.unit").alias(side)
    jobs = a.join(b, meet).select(F.col("a.least").alias("least"), of("a"), of("b"), self_meets.alias("alone"), F.col("a.k").alias("ka"), F.col("b.k").alias("kb"))
    jobs = jobs.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("ka") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)))
    jobs = scratch.keep(jobs.select(F.monotonically_increasing_id().alias("job"), "least", "a", "b", "x", "y", "alone"), f"{name}-jobs")
    sides = jobs.select("job", "least", "a.kind", "a.unit", F.col("x").alias("piece"), F.when(F.col("alone"), F.lit(-1)).otherwise(F.lit(0)).alias("side")).unionByName(
        jobs.where("not alone").select("job", "least", "b.kind", "b.unit", F.col("y").alias("piece"), F.lit(1).alias("side"))
    )
    rows = members.join(sides, ["least", "kind", "unit", "piece"]).join(classes.select("id", "point"), "id")
    rows = rows.select("job", "id", "component", "side", "n", "point").repartition("job").sortWithinPartitions("job")
    found = rows.mapInArrow(lambda batches: _candidates(batches, 1, sparse), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    found = scratch.keep(found, f"{name}-found")
    scratch.only(*(scratch.names - {n for n in scratch.names if n.startswith(f"{name}-")} | {f"{name}-found"}))
    return found


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = documents.select(documents[id_col].cast("long").alias("id"), documents[text_col].cast("string").alias("text"))
    counted = texts.select("text").mapInArrow(_frequent_of, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    listed = counted.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(FREQUENT_LIST).select("token")
    frequent = spark.sparkContext.broadcast(np.sort(listed.toPandas()["token"].to_numpy(np.int64).view(np.uint64)))

    docs = scratch.keep(texts.mapInArrow(_sets_of(frequent), "doc_id long, n long, c1 long, c2 long, head array<long>, point binary"), "docs")
    live = docs.where("n > 0 and doc_id is not null")
    classes = live.groupBy("c1", "c2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("head").alias("head"), F.first("point").alias("point"))
    classes = scratch.keep(classes, "classes")
    slim = scratch.keep(docs.select("doc_id", "n", "c1", "c2"), "slim")
    scratch.drop("docs")
    texts = texts.where("id is not null")
    if not slim.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        # rows that repeat an id and its text are one; only then do the texts move for it
        texts = texts.dropDuplicates(["id", "text"])

    tokens = classes.select(F.explode("head").alias("token"), "id")
    firsts = tokens.groupBy("token").agg(F.min("id").alias("least"), F.count("*").alias("m")).where("m > 1").select("token", "least")
    bundles = scratch.keep(tokens.join(firsts, "token").select("least", "id").distinct(), "bundles")
    classes = classes.select("id", "n", "point", "c1", "c2")

    tried = scratch.keep(_first_round(bundles, classes).distinct(), "first")
    links = _verify(tried, texts, scratch, "first")
    grouped = components(links, scratch, "grouped-first")
    for name, sparse in (("second", True), ("last", False)):
        found = _next_round(bundles, classes, grouped, tried, sparse, scratch, name)
        if found is None or found.isEmpty():
            break
        more = _verify(found, texts, scratch, name)
        tried = scratch.keep(tried.unionByName(found), f"{name}-tried")
        if not more.isEmpty():
            links = scratch.keep(links.unionByName(more), f"{name}-all")
            grouped = components(links, scratch, f"grouped-{name}")

    of_class = classes.select("c1", "c2", "id").join(grouped.withColumnRenamed("node", "id"), "id", "left").select("c1", "c2", F.coalesce("component", "id").alias("component"))
    out = slim.join(of_class, ["c1", "c2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = scratch.keep(out, "out")
    scratch.only("out")
    return out
