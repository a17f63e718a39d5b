"""Toxicity scores by a factorization machine over hashed terms.

Terms are the words of a text (ASCII digits and letters, A-Z lower-cased, and bytes above ASCII) and their
first three and four bytes, hashed to 2^18 places; each counts once. The machine adds a weight for every term and
the products of hidden factors for every pair, so that a pair can count more or less than its terms alone.

It is fitted on telling terms: first those that toxic and other rows hold at different shares, then, again and again,
those that the toxic rows it still misses hold at other shares than rows that are not toxic. Terms that are toxic only
together stand out there, however common each is alone.

Defined cases: null and empty texts score the bias; label rows without a document or a mark teach nothing,
several marks of one id count as the largest; a repeated document counts each time, within the bound of the
sample; with no labels, or only
one kind, every text scores the share of toxic rows (0.5 with none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.llm import arrays
from dataward.llm.language_id import held_out
from dataward.llm.shared import extra_columns_dropped


@dataclass(frozen=True)
class Machine:
    """``sample`` bounds the labelled rows that the machine is fitted on; the least hashes of ids are taken."""

    bits: int = 18
    factors: int = 8
    sample: int = 8000
    epochs: int = 6
    batch: int = 64
    rate: float = 0.1
    factor_rate: float = 0.02
    decay: float = 1e-4
    evidence: float = 4.0
    least_rows: int = 3
    rounds: int = 3
    threshold: float = 0.3


def term_lists(data: np.ndarray, bounds: np.ndarray, bits: int) -> list[np.ndarray]:
    """The sorted distinct term places of each row."""
    words = arrays.Words(arrays.lower(data), bounds, arrays.PLAIN_WORDS)
    shift = np.uint64(64 - bits)
    terms = np.stack([(arrays.mix(c + np.uint64(k)) >> shift).astype(np.int32) for k, c in enumerate(
        (words.codes(), words.prefixes(3), words.prefixes(4)))], axis=1)
    return [np.unique(terms[words.first[i]:words.first[i + 1]]) for i in range(len(words.counts))]


def _terms(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in arrays.text_slices(batch.column(2)):
                lists = term_lists(data, bounds, bits)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(low, high - low) for k in (0, 1)] + [
                    arrays.list_array(np.concatenate(lists), [len(x) for x in lists])], ["place", "toxic", "terms"])

    return run


class Fitted:
    """bias, weights and factors of a machine."""

    def __init__(self, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.bias, self.weight, self.factor = bias, weight, factor

    def logits(self, lists: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(lists))
        for i, x in enumerate(lists):
            v = self.factor[x]
            total = v.sum(axis=0)
            out[i] = self.bias + self.weight[x].sum() + 0.5 * (total @ total - (v * v).sum())
        return out


def _telling(lists: list[np.ndarray], one: np.ndarray, two: np.ndarray, spec: Machine, least_one: int = 0) -> np.ndarray:
    """Which terms, held by ``least_rows`` rows and ``least_one`` of ``one``, do the rows ``one`` and ``two`` hold at shares
    that differ by ``evidence`` standard errors?"""
    a, b = (np.bincount(np.concatenate([lists[i] for i in rows]), minlength=1 << spec.bits) for rows in (one, two))
    share = (a + b) / (len(one) + len(two))
    error = np.sqrt(share * (1 - share) * (1 / len(one) + 1 / len(two)))
    return (a + b >= spec.least_rows) & (a >= least_one) & (np.abs(a / len(one) - b / len(two)) >= spec.evidence * np.maximum(error, 1e-12))


def fit(lists: list[np.ndarray], marks: np.ndarray, spec: Machine) -> Fitted:
    """Fit on telling terms, then on these and what the missed toxic rows add, at most ``rounds`` times."""
    toxic, other = np.flatnonzero(marks == 1), np.flatnonzero(marks == 0)
    if not len(toxic) or not len(other):
        share = float(np.clip(marks.mean(), 1e-3, 1 - 1e-3)) if len(marks) else 0.5
        return Fitted(float(np.log(share / (1 - share))), np.zeros(1 << spec.bits), np.zeros((1 << spec.bits, spec.factors)))
    kept = _telling(lists, toxic, other, spec)
    for left in reversed(range(spec.rounds)):
        machine = _descend(lists, marks, kept, spec)
        score = 1 / (1 + np.exp(-np.clip(machine.logits([lists[i] for i in toxic]), -30, 30)))
        missed = toxic[score < spec.threshold]
        if not left or len(missed) < spec.least_rows:
            break
        # Of few missed rows every rare word stands out; it must recur among them.
        more = kept | _telling(lists, missed, other, spec, spec.least_rows)
        if (more == kept).all():
            break
        kept = more
    return machine


def _descend(lists: list[np.ndarray], marks: np.ndarray, kept: np.ndarray, spec: Machine) -> Fitted:
    """Fit the ``kept`` terms by AdaGrad on the log loss, rows in a fixed shuffled order."""
    rng = np.random.default_rng(7)
    size = 1 << spec.bits
    share = float(np.clip(marks.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    weight = np.zeros(size)
    lists = [x[kept[x]] for x in lists]
    factor = rng.normal(0, 0.01, (size, spec.factors)) * kept[:, None]
    seen_w, seen_v, seen_b = np.full(size, 1e-2), np.full((size, spec.factors), 1e-2), 1e-2
    for _ in range(spec.epochs):
        order = rng.permutation(len(lists))
        for low in range(0, len(order), spec.batch):
            rows = order[low:low + spec.batch]
            used, local = np.unique(np.concatenate([lists[i] for i in rows]), return_inverse=True)
            owner = np.repeat(np.arange(len(rows)), [len(lists[i]) for i in rows])
            v = factor[used][local]
            total = np.stack([np.bincount(owner, v[:, k], len(rows)) for k in range(spec.factors)], axis=1)
            logit = bias + np.bincount(owner, weight[used][local], len(rows)) + 0.5 * (
                (total ** 2).sum(axis=1) - np.bincount(owner, (v ** 2).sum(axis=1), len(rows)))
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - marks[rows]
            each = error[owner]
            step_w = np.bincount(local, each, len(used)) + spec.decay * weight[used]
            inner = each[:, None] * (total[owner] - v)
            step_v = np.stack([np.bincount(local, inner[:, k], len(used)) for k in range(spec.factors)], axis=1) + spec.decay * factor[used]
            seen_w[used] += step_w ** 2
            seen_v[used] += step_v ** 2
            seen_b += error.sum() ** 2
            weight[used] -= spec.rate * step_w / np.sqrt(seen_w[used])
            factor[used] -= spec.factor_rate * step_v / np.sqrt(seen_v[used])
            bias -= spec.rate * error.sum() / seen_b ** 0.5
    return Fitted(bias, weight, factor)


def learned(docs: DataFrame, labels: DataFrame, spec: Machine = Machine()) -> Fitted:
    """A machine fitted on at most ``spec.sample`` rows of ``labels`` (doc_id, toxic) that are not held out."""
    marks = extra_columns_dropped(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id", 4, 2))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(spec.sample)
    # At most ``sample`` pairs of numbers: small enough to send to every task.
    rows = extra_columns_dropped(docs, "doc_id", "text").join(F.broadcast(marks), "doc_id")
    terms = rows.select(F.xxhash64("doc_id", "text"), "toxic", "text").mapInArrow(_terms(spec.bits), "place long, toxic int, terms array<int>")
    # Many documents of one id would exceed the bound: again the least hashes are taken, now over terms, not whole texts.
    found = terms.orderBy("place", "toxic", "terms").limit(spec.sample).toArrow()
    lists = [x.values.to_numpy() for x in found.column("terms").combine_chunks()] if found.num_rows else []
    order = sorted(range(len(lists)), key=lambda i: lists[i].tobytes())  # tasks end in any order
    marks = np.array(found.column("toxic").to_pylist(), dtype=np.float64)
    return fit([lists[i] for i in order], marks[order] if len(order) else marks, spec)


def _score(machine, spec: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in arrays.text_slices(batch.column(2)):
                logit = machine.value.logits(term_lists(data, bounds, spec.bits))
                score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(low, high - low) for k in (0, 1)] + [pa.array(score), pa.array((score >= spec.threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, spec: Machine = Machine()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text); no shuffle of texts."""
    machine = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, spec))
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = extra_columns_dropped(docs, "doc_id", "text")
    return base.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text").mapInArrow(
        _score(machine, spec), f"doc_id {kind}, held_out boolean, score double, predicted int")
