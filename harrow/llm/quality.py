"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line with a word is good or bad. Its features are binned measures of the line (length,
shares of capitals, digits, symbols, marks and bars, repeated and distinct words, ...), of
the line before and of the line after. Labels are on documents only: all lines of a good
document are good; in a bad one the field starts with all lines bad, and after each fit
the lines that it finds good are taken as good, except the worst line.

A document's quality is the mean of its lines' forward-backward marginals, weighted by
their lengths, put through a logistic curve fitted on the same documents.

Fitted on all lines of at most FIT_DOCS labelled documents; while the field is fitted, a
document of more than FIT_LINES lines goes as several chains, so that short and long ones move
side by side. Its features, the curve and every score are of whole chains and cover every line
of every text. The model is a few hundred numbers.

Defined results: null, empty and wordless texts have no lines: the score of a text all bad;
without labels of both kinds every score is 0.5; several labels of an id: the greatest; rows
that repeat an id each give a row, and are learnt from once (the smallest text); null ids
are scored, not held out and never learnt from; very long texts count whole; no rows: no rows;
ties of score at 0.5 are predicted 1; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.labels import fit_logistic, fold, sample, texts_of

FIT_DOCS, FIT_LINES = 6000, 400
#: Bytes of text whose features are worked out side by side.
SLICE_BYTES = 2 << 20
BINS = 6
#: Upper edges of the bins of each measure; the last bin is open.
EDGES = np.array(
    [
        [20, 60, 150, 400, 1200],  # bytes
        [0.001, 0.05, 0.15, 0.4, 0.7],  # capitals among letters
        [0.001, 0.03, 0.1, 0.2, 0.4],  # digits
        [0.001, 0.01, 0.04, 0.1, 0.25],  # symbols #*$%&|<>
        [0.001, 0.01, 0.04, 0.1, 0.25],  # other marks !?=_~^{}[]\/@+
        [0.001, 0.01, 0.03, 0.06, 0.1],  # stops and commas
        [3.0, 4.5, 6.0, 8.0, 12.0],  # bytes of a word
        [0.3, 0.5, 0.7, 0.85, 0.95],  # distinct words
        [0.001, 0.05, 0.2, 0.5, 0.8],  # words equal to the one before
        [0.5, 1.5, 2.5, 3.5, 4.5],  # earlier equal lines
    ]
)
MEASURES = len(EDGES)
#: Features of a line: its own, the previous line's and the next line's bins (one bin more: there is none), and a constant.
WIDTH = 3 * MEASURES * (BINS + 1) + 1

_KIND = np.zeros((7, 256), bool)
_KIND[0, 65:91] = True
_KIND[1, 65:91] = _KIND[1, 97:123] = _KIND[1, 128:] = True
_KIND[2, 48:58] = True
_KIND[3, list(b"#*$%&|<>")] = True
_KIND[4, list(b"!?=_~^{}[]\\/@+")] = True
_KIND[5, list(b".,;:")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def line_bins(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (lines x MEASURES), lengths in bytes and document of every line with a word, in order."""
    raw = "\n".join((t or "").replace("\0", " ") + "\n\0" for t in texts).encode()
    data = np.frombuffer(raw, np.uint8)
    breaks = np.flatnonzero(data == 10)
    starts, ends = np.r_[0, breaks[:-1] + 1], breaks  # the last line, "\0", has no break behind it
    doc = np.searchsorted(np.flatnonzero(data == 0), starts)
    blank = _SPACE[data] | (data == 0)
    first = ~blank & np.r_[True, blank[:-1]]
    word_at = np.flatnonzero(first)
    word_line = np.searchsorted(starts, word_at, "right") - 1
    n_words = np.bincount(word_line, minlength=len(starts))[: len(starts)]
    live = n_words > 0
    if not live.any():
        return np.empty((0, MEASURES), np.uint8), np.empty(0), np.empty(0, np.int64)
    # word hashes: letters weighed by place in the word
    word_of = np.cumsum(first) - 1
    inside = np.flatnonzero(~blank)
    place = inside - word_at[word_of[inside]]
    power = (np.arange(64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    term = (_LETTER[data[inside]] * power[place & 63]) ^ (_LETTER[data[inside]] >> np.uint64(31))
    hashes = np.add.reduceat(term, np.flatnonzero(np.diff(np.r_[-1, word_of[inside]])))
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (word_line[1:] == word_line[:-1])]
    order = np.lexsort((hashes, word_line))
    new = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (word_line[order][1:] != word_line[order][:-1])]
    total = len(starts)
    distinct = np.bincount(word_line[order][new], minlength=total)[:total]
    repeated = np.bincount(word_line[same], minlength=total)[:total]
    bytes_in = np.bincount(word_line[word_of[inside]], minlength=total)[:total]
    size = np.maximum(ends - starts, 1).astype(float)
    shares = [np.diff(np.r_[0, np.cumsum(_KIND[k][data])][np.c_[starts, ends]])[:, 0] for k in range(6)]
    letters, body, words = np.maximum(shares[1], 1), np.maximum(bytes_in, 1), np.maximum(n_words, 1)
    line_hash = np.zeros(total, np.uint64)
    np.add.at(line_hash, word_line, hashes * (np.arange(len(hashes), dtype=np.uint64) - np.r_[0, np.cumsum(n_words)[:-1]][word_line].astype(np.uint64) + np.uint64(1)))
    by = np.lexsort((np.arange(total), line_hash, doc))
    fresh = np.r_[True, (line_hash[by][1:] != line_hash[by][:-1]) | (doc[by][1:] != doc[by][:-1])]
    run = np.arange(total) - np.maximum.accumulate(np.where(fresh, np.arange(total), 0))
    earlier = np.empty(total)
    earlier[by] = run
    values = np.stack(
        [size, shares[0] / letters, shares[2] / body, shares[3] / body, shares[4] / body, shares[5] / body, bytes_in / words, distinct / words, repeated / words, earlier], axis=1
    )[live]
    bins = np.stack([np.searchsorted(EDGES[m], values[:, m], "right") for m in range(MEASURES)], axis=1).astype(np.uint8)
    return bins, size[live], doc[live]


def columns_of(bins: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each line the 3 MEASURES + 1 feature columns that are on."""
    n = len(bins)
    base = np.arange(MEASURES) * (BINS + 1)
    none = np.full((1, MEASURES), BINS, np.uint8)
    before, after = np.concatenate([none, bins[:-1]]), np.concatenate([bins[1:], none])
    edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    before[edge] = BINS
    after[np.r_[edge[1:] - 1, n - 1]] = BINS
    block = MEASURES * (BINS + 1)
    return np.concatenate([base + bins, block + base + before, 2 * block + base + after, np.full((n, 1), WIDTH - 1)], axis=1).astype(np.int64)


@dataclass
class Field:
    """weights: score of `good` for each feature; step[a, b]: score of state b after a (0 bad, 1 good); curve: of the document score."""

    weights: np.ndarray
    step: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def marginals(self, columns: np.ndarray, doc: np.ndarray, pairs: bool = False):
        """P(good) of each line, and with `pairs` the expected counts of steps, by forward-backward over all documents side by side."""
        n = len(columns)
        node = np.zeros((n, 2))
        node[:, 1] = self.weights[columns].sum(1)
        edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        length = np.diff(np.r_[edge, n])
        order = np.argsort(-length, kind="stable")
        edge, length = edge[order], length[order]
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        norm = lambda v: v - np.logaddexp(v[:, :1], v[:, 1:])
        live_at = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
        forward[edge] = norm(node[edge])
        for t in range(1, length[0]):
            at = edge[: live_at[t]] + t
            prior = forward[at - 1]
            forward[at] = norm(np.logaddexp(prior[:, :1] + self.step[:1], prior[:, 1:] + self.step[1:]) + node[at])
        for t in range(length[0] - 2, -1, -1):
            at = edge[: live_at[t + 1]] + t
            nxt = backward[at + 1] + node[at + 1]
            backward[at] = norm(np.logaddexp(nxt[:, :1] + self.step[:, 0], nxt[:, 1:] + self.step[:, 1]))
        both = norm(forward + backward)
        good = np.exp(both[:, 1])
        if not pairs:
            return good
        second = np.flatnonzero(np.r_[False, doc[1:] == doc[:-1]])
        joint = forward[second - 1][:, :, None] + self.step[None] + (node + backward)[second][:, None, :]
        joint = np.exp(joint - np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None])
        return good, joint.sum(0)


def fit_field(bins: np.ndarray, size: np.ndarray, doc: np.ndarray, quality: np.ndarray, rounds: int = 4, steps: int = 60) -> Field:
    """bins, size, doc: lines in order; quality[doc]: 1 good, 0 bad. Adam on the conditional likelihood of the lines."""
    columns = columns_of(bins, doc)
    n = len(columns)
    place = np.arange(n) - np.searchsorted(doc, doc)
    chain = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (place[1:] % FIT_LINES == 0)])
    state = quality[doc].astype(float)
    weight = np.zeros(WIDTH)
    step = np.zeros((2, 2))
    field = Field(weight, step)
    inner = np.flatnonzero(np.r_[False, chain[1:] == chain[:-1]])
    for turn in range(rounds):
        m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
        for t in range(1, steps + 1):
            good, joint = field.marginals(columns, chain, pairs=True)
            seen = np.zeros((2, 2))
            np.add.at(seen, (state[inner - 1].astype(int), state[inner].astype(int)), 1)
            g = np.zeros(WIDTH)
            np.add.at(g, columns.ravel(), np.repeat(state - good, columns.shape[1]))
            grad = np.r_[g - 0.5 * field.weights, (seen - joint).ravel() - 0.5 * field.step.ravel()] / n
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            move = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            field.weights, field.step = field.weights + move[:WIDTH], field.step + move[WIDTH:].reshape(2, 2)
        if turn + 1 < rounds:
            good = field.marginals(columns, chain)
            relabelled = np.where(quality[doc] == 1, 1.0, (good > 0.5).astype(float))
            worst = np.lexsort((good, doc))
            worst = worst[np.r_[True, doc[worst][1:] != doc[worst][:-1]]]
            relabelled[worst[quality[doc[worst]] == 0]] = 0.0
            state = relabelled
    present = np.unique(doc)
    raw = document_scores(field.marginals(columns, doc), size, doc, len(quality))[present]
    field.curve = fit_logistic(_logit(raw), quality[present].astype(float))
    return field


def document_scores(good: np.ndarray, size: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean marginal of each document; without lines 0."""
    return np.bincount(doc, good * size, n) / np.maximum(np.bincount(doc, size, n), 1e-9)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p) - np.log1p(-p)


def score_texts(field: Field, texts: list[str | None]) -> np.ndarray:
    bins, size, doc = line_bins(texts)
    raw = np.zeros(len(texts))
    if len(bins):
        raw = document_scores(field.marginals(columns_of(bins, doc), doc), size, doc, len(texts))
    a, b = field.curve
    return 1 / (1 + np.exp(-np.clip(a * _logit(raw) + b, -30, 30)))


def slices(batch, column: int):
    """A record batch in slices of at most SLICE_BYTES of text each, or one row: features take some 55 bytes of memory for a byte of text."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, n in enumerate(sizes):
        if i > at and size + n > SLICE_BYTES:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += int(n)
    if at < len(sizes):
        yield batch.slice(at)


def learn(documents: DataFrame, labels: DataFrame, learn_rows, seed: int = 23, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    import pyarrow as pa

    chosen = sample(labels.where("quality in (0, 1)"), "quality", learn_rows, FIT_DOCS, seed)

    def lines(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            bins, size, doc = line_bins(batch.column(2).to_pylist())
            n = batch.num_rows
            edge = np.searchsorted(doc, np.arange(n + 1))
            keep = [i for i in range(n) if edge[i + 1] > edge[i]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())),
                    batch.column(1).take(pa.array(keep, pa.int64())),
                    pa.array([bins[edge[i] : edge[i + 1]].tobytes() for i in keep], pa.binary()),
                    pa.array([size[edge[i] : edge[i + 1]].tolist() for i in keep], pa.list_(pa.float64())),
                ],
                names=["id", "y", "bins", "size"],
            )

    got = texts_of(documents, chosen, id_col, text_col).select("id", "y", "text").mapInArrow(lines, "id long, y int, bins binary, size array<double>").toPandas().sort_values("id", kind="stable")
    if got["y"].nunique() < 2:
        return None
    sizes = [np.asarray(s) for s in got["size"]]
    doc = np.repeat(np.arange(len(got)), [len(s) for s in sizes])
    bins = np.frombuffer(b"".join(got["bins"]), np.uint8).reshape(-1, MEASURES)
    return fit_field(bins, np.concatenate(sizes), doc, got["y"].to_numpy())


def score_quality(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (higher: good likelier), predicted; labels of the held-out fold are never learnt from."""
    import pyarrow as pa

    field = learn(documents, labels, fold(F.col("doc_id"), folds) != held, id_col=id_col, text_col=text_col)
    sent = documents.sparkSession.sparkContext.broadcast(field)

    def score(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            texts = batch.column(2).to_pylist()
            values = np.full(len(texts), 0.5) if sent.value is None else score_texts(sent.value, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values), pa.array((values >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(documents[id_col].cast("long").alias("doc_id"), F.coalesce(fold(documents[id_col], folds) == held, F.lit(False)).alias("held_out"), documents[text_col].cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
