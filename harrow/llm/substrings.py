"""Substring dedup by windows at content-defined anchors of a gear rolling hash.

A text's UTF-8 bytes have a gear hash at every place, of the HASHED bytes from there on. In
every STRETCH places in a row the place of the smallest hash is an anchor (winnowing), and
the `min_run` bytes from an anchor on are a window; the first and the last `min_run` bytes of
a text are windows too. Anchors depend on nearby bytes only, so a passage has the same windows
wherever it stands. Windows are deduplicated by digest: the document with the smallest id
keeps them. In every other document, windows that an earlier document has are a repeated
passage, overlapping ones together; they are cut out of the text. What repeats inside one
document only stays.

A passage of min_run + STRETCH - 1 bytes (213) or more has an anchor whose window lies inside
it, so it is found wherever it stands; shorter ones of `min_run` bytes or more may be. 50 words
are some 300 bytes. At each end up to STRETCH - 1 bytes of a passage stay. Nothing shorter than
`min_run` bytes is cut: each window is so many bytes in a row of one earlier document.

Scale: one narrow row per window, about one for 32 bytes; digests are counted with map-side
partial aggregation, so a passage that all documents share is one row per task; the join back
meets only digests that occur twice. Texts move once, to meet their own runs.

Defined results: null texts stay null and empty ones empty; a row whose whole text is a
repeat keeps an empty text; rows that share a doc_id don't count as repeats of one
another; extra columns pass through whatever their names (one called `removed` is replaced);
rows with a null id keep their text and keep no passage from others; of several keepers of a
passage the one with most of its windows is named, then the smallest id; very long texts are
cut whole; no rows: no rows.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.scratch import Scratch

SEED = 20240229
#: A whole hash depends on so many bytes; of so many places in a row (a power of 2) one is an anchor; places looked at in one go.
HASHED, STRETCH, BLOCK = 16, 64, 1 << 20


def gear_table(seed: int = SEED) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, 256, dtype=np.uint32)


_GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of gear[byte] << distance over the window before it, by doubling: log2(window) passes."""
    h = _GEAR[data]
    span = 1
    while span < 16:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] << np.uint32(span)
        h = h + shifted
        span *= 2
    return h


def window_starts(data: np.ndarray, size: int) -> list[int]:
    """Starts of a text's windows of `size` bytes in ascending order: its first, its last and those at anchors."""
    last = len(data) - size
    if last < 0:
        return []
    # the hash of the bytes from s on is the rolling hash at s + HASHED - 1
    hashes = gear_hashes(data)[HASHED - 1 : last + HASHED]
    found = [np.array([0, last], np.uint64)]
    for at in range(0, len(hashes), BLOCK):
        key = hashes[at : at + BLOCK + STRETCH - 1].astype(np.uint64)
        key = (key << np.uint64(32)) | np.arange(at, at + len(key), dtype=np.uint64)
        span = 1
        while span < STRETCH and len(key) > span:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span == STRETCH:
            found.append(key & np.uint64(0xFFFFFFFF))
    return np.unique(np.concatenate(found)).tolist()


def _digests(raw: bytes, size: int) -> tuple[list[int], list[int]]:
    import xxhash

    starts = window_starts(np.frombuffer(raw, np.uint8), size)
    digest = xxhash.xxh3_64_intdigest
    return starts, [digest(raw[a : a + size]) for a in starts]


def _windows(batches, size: int):
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for at in range(0, len(ids), 512):
            docs, digests = [], []
            for doc, text in zip(ids[at : at + 512], batch.column(1).slice(at, 512).to_pylist(), strict=True):
                if text and doc is not None:
                    own = set(_digests(text.encode(), size)[1])
                    digests.extend(own)
                    docs.append(np.full(len(own), doc, np.int64))
            if docs:
                columns = [pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(np.concatenate(docs))]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "doc_id"])


def _runs(starts: list[int], kept_in: list[int | None], size: int) -> list[tuple[int, int, int]]:
    """Byte spans of overlapping or touching windows that earlier documents keep, and the document that keeps most of them (the smallest id of equal ones)."""
    spans, start, end, keepers = [], 0, 0, Counter()
    told = lambda: (start, end, min(keepers, key=lambda k: (-keepers[k], k)))
    for at, keeper in zip(starts, kept_in, strict=True):
        if keeper is None:
            continue
        if keepers and at > end:
            spans.append(told())
            keepers = Counter()
        start = start if keepers else at
        end = at + size
        keepers[keeper] += 1
    return [*spans, told()] if keepers else spans


def _on_letters(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The span drawn in to whole UTF-8 characters."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def dedup_substrings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 150) -> DataFrame:
    """documents with the repeated passages cut from the text, and `removed`: array of (start, length) in characters of the old text, with the document that keeps the passage."""
    import pyarrow as pa

    scratch = Scratch(documents.sparkSession, "substrings")
    size = max(min_run, HASHED)
    pairs = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    windows = scratch.keep(pairs.mapInArrow(partial(_windows, size=size), "digest long, doc_id long"), "windows")
    firsts = windows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    again = windows.join(firsts.select("digest", "first"), "digest").where("doc_id > first")
    seen = scratch.keep(again.groupBy("doc_id").agg(F.collect_set(F.struct("digest", "first")).alias("seen")), "seen")
    scratch.drop("windows")
    keep = [c for c in documents.columns if c != "removed"]
    at = keep.index(text_col)
    # the input's columns stay inside a struct until the join is done: whatever their names, none clashes
    joined = documents.select(documents[id_col].cast("long").alias("doc_id"), F.struct(*[documents[c] for c in keep]).alias("row")).join(seen, "doc_id", "left")
    removed_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("kept_in", T.LongType())]))
    whole = joined.where("seen is null").select("row.*", F.array().cast(removed_type).alias("removed"))
    schema = T.StructType([documents.schema[c] for c in keep] + [T.StructField("removed", removed_type)])

    def cut(batches):
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("kept_in", pa.int64())]))
        for whole_batch in batches:
            for k in range(0, whole_batch.num_rows, 512):
                batch = whole_batch.slice(k, 512)
                texts, removed = [], []
                for text, earlier in zip(batch.column(at).to_pylist(), batch.column(len(keep)).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    starts, digests = _digests(raw, size)
                    known = {e["digest"] % (1 << 64): e["first"] for e in earlier}
                    spans = _runs(starts, [known.get(d) for d in digests], size)
                    parts, told, last = [], [], 0
                    for a, b, keeper in spans:
                        a, b = _on_letters(raw, a, b)
                        parts.append(raw[last:a])
                        told.append({"start": len(raw[:a].decode()), "length": len(raw[a:b].decode()), "kept_in": keeper})
                        last = b
                    texts.append(b"".join([*parts, raw[last:]]).decode() if told else text)
                    removed.append(told)
                columns = [batch.column(i) for i in range(len(keep))]
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, span_type)], names=[*keep, "removed"])

    parts = joined.where("seen is not null").select(*[F.col("row")[c] for c in keep], F.col("seen"))
    return whole.unionByName(parts.toDF(*keep, "removed").mapInArrow(cut, schema))
