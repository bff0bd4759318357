"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words and word beginnings of STEM letters of the labelled sample; every labelled
document of it, toxic or not, is an example. A text's vector is (1 + log tf) idf over the terms,
of length one. A term's idf is scaled by how unevenly the classes use it (the z value of its log
odds): among texts of one language most shared words say nothing about the label. No term is
left out for it; what a plain idf reaches is in the README.

The index holds, for each term, postings by example, in blocks of BLOCK examples; examples that
share their heaviest term lie together. Terms that many examples hold have for each block the
greatest weight. A query adds up the postings of its rarer terms; a block's bound is the best
such sum in it and the query's weights times the block's greatest for the common terms. The
blocks of the highest bounds are scored in full; of the rest only those whose bound reaches the
k-th best cosine so far, so the k nearest are exact (ties: smaller id). Votes of the k nearest, weighted
by 1 / (distance + SOFT) and drawn to the rate of the sample, go through a logistic curve fitted
on the examples themselves, each without its own vote and its own share in the weights, and both labels counted alike (most samples have few toxic texts): 0.5
is where a vote is as usual among toxic examples as among others.

Fitted on at most FIT_DOCS labelled documents; terms, examples and index are bounded by them, so
the index is broadcast. Scoring reads every word of every text.

Defined results: null and empty texts and texts without a known term get the curve's value for
a text without neighbours; without labels of both kinds every score is 0.5; several labels of an
id: the greatest; rows that repeat an id in the documents each get a row, and are one example
(that of the smallest text); null ids are scored, not held out and never learnt from; very long texts
count whole; no rows: no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.labels import fit_logistic, fold, sample, texts_of
from harrow.scratch import Scratch

FIT_DOCS = 4096
STEM, BLOCK, NEAREST, SOFT = 4, 64, 15, 0.05
#: A term that more than one in so many examples holds is a common one.
COMMON = 3
#: Blocks that are scored before there is a k-th best.
STRIDE = 3
WORD = re.compile(r"\w+")


def terms_of(text: str | None) -> Counter:
    """Words and beginnings (marked with a leading caret), with counts."""
    found = WORD.findall((text or "").lower())
    counts = Counter(found)
    for w, n in list(counts.items()):
        if len(w) > STEM:
            counts["^" + w[:STEM]] += n
    return counts


class Vocabulary:
    """Terms and their weights: idf, scaled by the z value of the log odds of the classes."""

    def __init__(self, terms: list[str], toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int):
        self.place = {t: i for i, t in enumerate(terms)}
        self.begins = {t[1:]: i for i, t in enumerate(terms) if t[0] == "^"}
        self.counts = np.stack([other, toxic])
        self.sizes = (n_other, n_toxic)
        self.weight = self.weigh(other, toxic, n_other, n_toxic)

    @staticmethod
    def weigh(other: np.ndarray, toxic: np.ndarray, n_other: int, n_toxic: int) -> np.ndarray:
        odds = np.log((toxic + 0.5) / (n_toxic + 1.0)) - np.log((other + 0.5) / (n_other + 1.0))
        z = np.abs(odds) / np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
        return np.log((n_toxic + n_other + 1) / np.maximum(toxic + other, 1)) * z

    def vector(self, text: str | None, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text's terms in ascending order and their weights, of length one. own: the label of
        a document of the sample, whose own share in the counts is left out."""
        counts = Counter(WORD.findall((text or "").lower()))
        found, stems = list(counts), [w[:STEM] if len(w) > STEM else "" for w in counts]  # no beginning is empty
        n = np.fromiter(counts.values(), np.int64, len(found))
        at = np.fromiter(chain(map(self.place.get, found, repeat(-1)), map(self.begins.get, stems, repeat(-1))), np.int64, 2 * len(found))
        known = np.flatnonzero(at >= 0)
        if not len(known):
            return np.empty(0, np.int64), np.empty(0)
        known = known[np.argsort(at[known])]
        at, tf = at[known], n[known % len(found)]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # words of one beginning count together
        at, tf = at[first], np.add.reduceat(tf, first)
        if own is None:
            weight = self.weight[at]
        else:
            rest = self.counts[:, at] - np.array([[1 - own], [own]])
            weight = np.where(rest.sum(0) > 0, self.weigh(*rest, self.sizes[0] - (1 - own), self.sizes[1] - own), 0.0)
        w = (1 + np.log(tf)) * weight
        length = math.sqrt(float(w @ w))
        live = w > 0
        return (at[live], w[live] / length) if length else (np.empty(0, np.int64), np.empty(0))


class Index:
    """Block-max inverted index of examples (ids in order, labels, vectors), with the curve."""

    def __init__(self, n_terms: int, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], base: float):
        self.base, self.curve = base, (1.0, 0.0)
        top = np.array([t[np.argmax(w)] if len(t) else n_terms for t, w in vectors], np.int64)
        order = np.lexsort((ids, top))
        self.ids, self.labels = ids[order], labels[order]
        n = len(ids)
        example = np.repeat(np.arange(n, dtype=np.int32), [len(vectors[e][0]) for e in order])
        term = np.concatenate([vectors[e][0] for e in order] or [np.empty(0, np.int32)]).astype(np.int32)
        weight = np.concatenate([vectors[e][1] for e in order] or [np.empty(0)])
        by = np.argsort(term, kind="stable")
        self.example, self.weight = example[by].astype(np.int64), weight[by]  # as bincount takes them
        self.edges = np.searchsorted(term[by], np.arange(n_terms + 1))
        common = np.flatnonzero(np.diff(self.edges) * COMMON > n)
        self.row = np.full(n_terms, -1, np.int64)
        self.row[common] = np.arange(len(common))
        self.n_blocks = -(-n // BLOCK)
        dense = np.zeros((len(common), self.n_blocks * BLOCK))
        for r, t in enumerate(common):
            span = slice(self.edges[t], self.edges[t + 1])
            dense[r, self.example[span]] = self.weight[span]
        self.dense = dense.reshape(len(common), self.n_blocks, BLOCK)
        self.block_max = self.dense.max(2)

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int = NEAREST, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a common term, exact."""
        terms, weights = vector
        if not len(terms) or not len(self.ids):
            return np.empty(0, np.int64), np.empty(0)
        rows = self.row[terms]
        rare, rows, heavy = terms[rows < 0], rows[rows >= 0], weights[rows >= 0]
        starts = self.edges[rare]
        lengths = self.edges[rare + 1] - starts
        at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        at += np.arange(len(at))
        product = np.repeat(weights[self.row[terms] < 0], lengths)
        product *= self.weight.take(at)
        partial = np.bincount(self.example.take(at), product, self.n_blocks * BLOCK)
        bounds = partial.reshape(-1, BLOCK).max(1) + heavy @ self.block_max[rows]
        visit = np.argsort(-bounds, kind="stable")
        found_e, found_s, done = np.empty(0, np.int64), np.empty(0), 0
        while done < len(visit) and bounds[visit[done]] > 0:
            # a few blocks for a first k-th best, then all that its cosine leaves
            last = min(done + STRIDE, len(visit))
            if len(found_e) >= k:
                last = int(np.searchsorted(-bounds[visit], -(found_s[-1] - 1e-9), "right"))
                if last <= done:
                    break
            blocks, done = visit[done:last], last
            places = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            score = partial[places]
            if len(rows):
                score = score + heavy @ self.dense[rows[:, None], blocks].reshape(len(rows), -1)
            score = np.round(score, 12)
            live = (score > 0) & (places != without)
            if len(found_e) >= k:
                live &= score >= found_s[-1]
            e, s = np.concatenate([found_e, places[live]]), np.concatenate([found_s, score[live]])
            best = np.lexsort((self.ids[e], -s))[:k]
            found_e, found_s = e[best], s[best]
        return found_e, found_s

    def vote(self, examples: np.ndarray, cosines: np.ndarray) -> float:
        weight = 1 / (np.maximum(0, 1 - cosines) + SOFT)
        return (float((weight * self.labels[examples]).sum()) + self.base) / (float(weight.sum()) + 1.0)

    def calibrated(self, vote: float) -> float:
        a, b = self.curve
        p = min(max(vote, 1e-4), 1 - 1e-4)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * math.log(p / (1 - p)) + b))))

    def judge(self, vector: tuple[np.ndarray, np.ndarray]) -> tuple[float, list[dict]]:
        """The score, and all the nearest examples that voted for it, with their labels and cosines."""
        examples, cosines = self.nearest(vector)
        score = self.calibrated(self.vote(examples, cosines))
        return score, [{"id": int(self.ids[e]), "label": int(self.labels[e]), "cosine": float(c)} for e, c in zip(examples, cosines, strict=True)]


def learn(documents: DataFrame, labels: DataFrame, learn_rows, seed: int = 29, id_col: str = "doc_id", text_col: str = "text") -> tuple[Vocabulary, Index] | None:
    import pyarrow as pa

    scratch = Scratch(documents.sparkSession, "toxicity")
    chosen = scratch.keep(sample(labels.where("toxic in (0, 1)"), "toxic", learn_rows, FIT_DOCS, seed), "chosen")
    texts = scratch.keep(texts_of(documents, chosen, id_col, text_col), "texts")

    def frequencies(batches):
        for batch in batches:
            toxic, other = Counter(), Counter()
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                (toxic if y else other).update(terms_of(text).keys())
            terms = list(toxic.keys() | other.keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([other[t] for t in terms], pa.int64())], names=["term", "k", "b"])

    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        scratch.only()
        return None
    counted = texts.select("id", "y", "text").mapInArrow(frequencies, "term string, k long, b long").groupBy("term").agg(F.sum("k").alias("k"), F.sum("b").alias("b"))
    rows = counted.toPandas().sort_values("term")
    words = Vocabulary(rows["term"].tolist(), rows["k"].to_numpy(float), rows["b"].to_numpy(float), sizes[1], sizes[0])
    sent = documents.sparkSession.sparkContext.broadcast(words)

    def vectors(batches):
        for batch in batches:
            found = [sent.value.vector(t) for t in batch.column(2).to_pylist()]
            raw = lambda k, kind: pa.array([v[k].astype(kind).tobytes() for v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw(0, np.int32), raw(1, np.float64)], names=["id", "y", "terms", "weights"])

    texts = texts.select("id", "y", "text")
    rows = texts.mapInArrow(vectors, "id long, y int, terms binary, weights binary").toPandas().sort_values("id", kind="stable")
    built = [(np.frombuffer(t, np.int32), np.frombuffer(w, np.float64)) for t, w in zip(rows["terms"], rows["weights"], strict=True)]
    ids, y = rows["id"].to_numpy(), rows["y"].to_numpy(float)
    index = Index(len(words.weight), ids, y, built, float((y.sum() + 0.5) / (len(y) + 1.0)))
    del rows, built
    both = documents.sparkSession.sparkContext.broadcast((words, index))

    def own_votes(batches):
        words, index = both.value
        place = {int(i): at for at, i in enumerate(index.ids)}
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            found = [index.vote(*index.nearest(words.vector(t, own), without=place[i])) for i, own, t in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["id", "y", "vote"])

    votes = texts.mapInArrow(own_votes, "id long, y int, vote double").toPandas().sort_values("id", kind="stable")
    both.destroy()
    scratch.only()
    clipped = np.clip(votes["vote"].to_numpy(), 1e-4, 1 - 1e-4)
    index.curve = fit_logistic(np.log(clipped / (1 - clipped)), votes["y"].to_numpy(float), even=True)
    return words, index


def score_toxicity(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (higher: toxic likelier), predicted, evidence (all the neighbours that voted, whatever the score); labels of the held-out fold are never learnt from."""
    import pyarrow as pa

    learnt = learn(documents, labels, fold(F.col("doc_id"), folds) != held, id_col=id_col, text_col=text_col)
    sent = documents.sparkSession.sparkContext.broadcast(learnt)
    evidence_type = "array<struct<id: bigint, label: int, cosine: double>>"
    arrow_type = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def score(batches):
        learnt = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(2).to_pylist()
                judged = [(0.5, []) if learnt is None else learnt[1].judge(learnt[0].vector(t)) for t in texts]
                values, shown = np.array([v for v, _ in judged]), [e for _, e in judged]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32)), pa.array(shown, arrow_type)], names=["doc_id", "held_out", "score", "predicted", "evidence"]
                )

    rows = documents.select(documents[id_col].cast("long").alias("doc_id"), F.coalesce(fold(documents[id_col], folds) == held, F.lit(False)).alias("held_out"), documents[text_col].cast("string").alias("text"))
    return rows.mapInArrow(score, f"doc_id long, held_out boolean, score double, predicted int, evidence {evidence_type}")
