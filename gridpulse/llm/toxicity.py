"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms: words, and their first 4, 5 and 6
bytes as stems. The score is logistic in the weights of the terms and in the
inner products of the factors of every pair of terms, so a pair can weigh more,
or less, than its terms by themselves. Every term of the labelled sample has a
weight and factors: the fit starts from the terms that tell something by
themselves and goes on over all of them.
"""

from __future__ import annotations

import hashlib
import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import ALNUM, Words, as_bytes, shared, sliced, span_hashes, text_or_empty, written

HASHED = 1 << 22
STEMS = (4, 5, 6)
TERMS = 4096
FACTORS = 4
SEED = 42


@dataclass
class Model:
    """``kept`` are the hashed terms that have a weight; a last row, of all others, is zero."""

    kept: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @property
    def slot(self) -> np.ndarray:
        """The row of every hashed term; one entry more, so that the largest is always the row of zeros."""
        out = np.full(HASHED + 1, len(self.kept), dtype=np.int32)
        out[self.kept] = np.arange(len(self.kept))
        return out

    def margins(self, doc: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """bias + sum of w_i + sum over pairs of <v_i, v_j>, for sorted distinct (doc, row)."""
        out = np.full(n, self.bias)
        if len(doc):
            out += np.bincount(doc, self.linear[row], n)
            for f in range(self.factors.shape[1]):
                v = self.factors[row, f]
                out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed term) of every word and stem."""
    w = Words(texts, ALNUM)
    of, size = w.texts_of(), w.end - w.start
    long = [np.flatnonzero(size > n) for n in STEMS]
    start = np.concatenate([w.start, *[w.start[i] for i in long]])
    end = np.concatenate([w.end, *[w.start[i] + n for i, n in zip(long, STEMS, strict=True)]])
    term = span_hashes(w.buf, start, end) % np.uint64(HASHED)
    return np.concatenate([of, *[of[i] for i in long]]), term.astype(np.int64)


def distinct_terms(texts: list[bytes], slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, term), or (text, row) of the terms that have a weight."""
    doc, term = terms(texts)
    width = HASHED
    if slot is not None:
        width = int(slot.max()) + 1
        term = slot[term].astype(np.int64)
        known = term < width - 1
        doc, term = doc[known], term[known]
    key = np.unique(doc * width + term)
    return key // width, key % width


def informative(doc: np.ndarray, term: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The terms whose log-likelihood ratio against the label's share (the G statistic) is more
    than chance reaches among as many terms, ``TERMS`` at most."""
    in_pos = np.bincount(term, label[doc], HASHED)
    in_all = np.bincount(term, minlength=HASHED).astype(float)
    p = (label.sum() + 0.5) / (len(label) + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        toxic = np.nan_to_num(in_pos * np.log(in_pos / (p * in_all)))
        clean = np.nan_to_num((in_all - in_pos) * np.log((in_all - in_pos) / ((1 - p) * in_all)))
    gain = 2 * (toxic + clean)
    best = np.argsort(-gain, kind="stable")[:TERMS]
    return best[gain[best] >= 2 * np.log(max(2, np.count_nonzero(in_all >= 2)))]


def train(doc: np.ndarray, term: np.ndarray, label: np.ndarray, rounds: int = 300, kept: np.ndarray | None = None) -> Model:
    """Fits the machine to rows given as distinct (row number, hashed term) and their labels.

    The ``kept`` terms, by default the informative ones, have weights. Full gradients with Adam.
    """
    n = len(label)
    best = informative(doc, term, label) if kept is None else kept
    row = Model(best, 0.0, best, best).slot[term]
    known = row < len(best)
    doc, row = doc[known], row[known].astype(np.int64)
    m = len(best) + 1
    rng = np.random.default_rng(SEED)
    x = np.concatenate([np.zeros(1 + m), rng.normal(0, 0.05, m * FACTORS)])
    x[m] = 0
    mean, var = np.zeros_like(x), np.zeros_like(x)

    def model(x):
        factors = x[1 + m :].reshape(m, FACTORS).copy()
        linear = x[1 : 1 + m].copy()
        linear[-1], factors[-1] = 0, 0
        return Model(best, float(x[0]), linear, factors)

    for step in range(1, rounds + 1):
        now = model(x)
        score = now.margins(doc, row, n)
        err = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - label) / max(1, n)
        grad = np.zeros_like(x)
        grad[0] = err.sum()
        per = err[doc]
        grad[1 : 1 + m] = np.bincount(row, per, m) + 1e-4 * x[1 : 1 + m] / m
        to_factors = grad[1 + m :].reshape(m, FACTORS)
        for f in range(FACTORS):
            v = now.factors[row, f]
            total = np.bincount(doc, v, n)[doc]
            to_factors[:, f] = np.bincount(row, per * (total - v), m) + 1e-3 * now.factors[:, f] / m
        mean = 0.9 * mean + 0.1 * grad
        var = 0.99 * var + 0.01 * grad * grad
        x -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    return model(x)


def train_all(doc: np.ndarray, term: np.ndarray, label: np.ndarray, epochs: int = 4, least: int = 400, rows: int = 256) -> Model:
    """Fits weights and factors of every term that occurs, to rows as ``train`` takes them, sorted by row number.

    Starts from ``train`` over the informative terms, all others at zero weight
    and small factors, and is drawn back to that start: a term moves as far as
    its rows, alone or in pairs, explain what the start doesn't. AdaGrad over
    ``rows`` rows at a time, for ``epochs`` passes and ``least`` steps at least.
    """
    start, n = train(doc, term, label), len(label)
    if not len(term):
        return start
    kept = np.unique(term)
    m = len(kept)
    row = Model(kept, 0.0, kept, kept).slot[term]
    size = np.bincount(doc, minlength=n)
    first = np.cumsum(size) - size
    rng = np.random.default_rng(SEED)
    x = np.zeros((1 + FACTORS, m), dtype=np.float32)
    at = np.searchsorted(kept, start.kept)
    x[0, at], x[1:, at] = start.linear[:-1], start.factors[:-1].T
    centre, bias = x.copy(), start.bias
    fresh = np.ones(m, dtype=bool)
    fresh[at] = False
    x[1:, fresh] = rng.normal(0, 0.1 / np.sqrt(max(1.0, size.mean())), (FACTORS, m))[:, fresh]
    squares, bias_squares = np.full_like(x, 1e-3), 1e-3
    rate, pull = [0.02] + [0.05] * FACTORS, np.float32(3 / n)
    queue = np.empty(0, dtype=np.int64)
    for _ in range(max(least, epochs * -(-n // rows))):
        if len(queue) < min(rows, n):
            queue = np.concatenate([queue, rng.permutation(n)])
        pick, queue = queue[:rows], queue[rows:]
        b, count = len(pick), size[pick]
        of = np.repeat(np.arange(b), count)
        r = row[np.arange(len(of)) + (first[pick] - np.cumsum(count) + count)[of]]
        score = bias + np.bincount(of, x[0, r], b)
        held = []
        for f in range(1, 1 + FACTORS):
            v = x[f, r]
            total = np.bincount(of, v, b)
            score += 0.5 * (total**2 - np.bincount(of, v * v, b))
            held.append((v, total))
        err = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - label[pick]) / b
        per = err[of]
        for k in range(1 + FACTORS):
            by = per if k == 0 else per * (held[k - 1][1][of] - held[k - 1][0])
            grad = np.bincount(r, by, m).astype(np.float32) + pull * (x[k] - centre[k])
            squares[k] += grad * grad
            x[k] -= np.float32(rate[k]) * grad / np.sqrt(squares[k])
        bias_squares += err.sum() ** 2
        bias -= rate[0] * err.sum() / np.sqrt(bias_squares)
    x = np.concatenate([x, np.zeros((1 + FACTORS, 1), dtype=np.float32)], axis=1)
    return Model(kept, float(bias), x[0], np.ascontiguousarray(x[1:].T))


def crc_fold(of: Column, folds: int = 5) -> Column:
    """crc32 of the value as text, modulo ``folds``; null has none."""
    return F.crc32(of.cast("string")) % folds


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    """Trains on documents with a label(doc_id, toxic), ``max_rows`` distinct ids at most.

    The ids of smallest hash are taken, an id of several labels by its largest;
    null labels and ids are left out; of several texts of an id the least is
    read. Only ids are dealt to the tasks that read the texts. With no row, or one class, scores stay at the bias (0.5 for none).
    """
    picked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumnRenamed("doc_id", "of")
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("of")).groupBy("of", "toxic").agg(F.min("text").alias("text"))
    rows = rows.select("text", "toxic")

    def bags(batches):
        for batch in sliced(batches):
            doc, term = distinct_terms(as_bytes(batch.column("text")))
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(term, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), lists], names=["toxic", "terms"])

    def one(batches):
        labels, sizes, all_terms = [], [], []
        for batch in batches:
            labels.append(batch.column("toxic").to_numpy())
            lists = batch.column("terms")
            sizes.append(np.diff(lists.offsets.to_numpy()))
            all_terms.append(lists.flatten().to_numpy())
        label = np.concatenate([*labels, np.empty(0, dtype=np.int32)]).astype(float)
        size = np.concatenate([*sizes, np.empty(0, dtype=np.int64)])
        term = np.concatenate([*all_terms, np.empty(0, dtype=np.int32)])
        del all_terms
        # bags come in any order: sort the rows by what is in them, so that reruns agree
        start = np.cumsum(size) - size
        bag = [term[a : a + k] for a, k in zip(start, size, strict=True)]
        order = sorted(range(len(label)), key=lambda i: (label[i], hashlib.blake2b(bag[i]).digest()))
        term = np.concatenate([np.empty(0, dtype=np.int32), *[bag[i] for i in order]])
        del bag
        doc = np.repeat(np.arange(len(order), dtype=np.int32), size[order])
        got = train_all(doc, term, label[order])
        out = io.BytesIO()
        np.savez(out, kept=got.kept, bias=got.bias, linear=got.linear, factors=got.factors)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    bagged, _ = written(rows.mapInArrow(bags, "toxic int, terms array<int>"), "toxicity-bags")
    model = bagged.repartition(1).mapInArrow(one, "model binary").first()[0]
    with np.load(io.BytesIO(bytes(model))) as m:
        return Model(m["kept"], float(m["bias"]), m["linear"], m["factors"])


def scores(texts: list[bytes], model: Model, slot: np.ndarray) -> np.ndarray:
    doc, row = distinct_terms(texts, slot)
    return 1 / (1 + np.exp(-np.clip(model.margins(doc, row, len(texts)), -30, 30)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, from the whole text; null and empty texts get the bias.

    Repeated rows keep a row each. Other columns are not read.
    """
    held = shared(docs.sparkSession, model)

    def run(batches):
        model = held()
        slot = model.slot
        for batch in sliced(batches):
            got = scores(as_bytes(batch.column("text")), model, slot)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], names=["doc_id", "score"])

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score below ``threshold``. No shuffle."""
    held = shared(docs.sparkSession, model)

    def run(batches):
        model = held()
        slot = model.slot
        for batch in sliced(batches):
            kept = batch.filter(pa.array(scores(as_bytes(batch.column("text")), model, slot) < threshold))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)
