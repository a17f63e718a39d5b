"""Language identification with hyperdimensional letter profiles.

Every letter has a random vector of +1 and -1. A three-letter run binds the vectors of its letters, each
permuted by its place; a text bundles its runs; a language bundles its training texts. A text gets the
language whose bundle has the largest cosine with its own.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows without a language or an
id teach nothing; with nothing learned every text is ``und``; equal cosines go to the first language by
name; repeated rows each count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataward.llm import arrays
from dataward.llm.shared import extra_columns_dropped

SYMBOLS = 128  # 0 is anything but a letter, 1-26 are a-z, other letters share the rest
DIMENSIONS = 1024


class _Encoder:
    """Turns slices of texts into counts of letter runs and these into bundled vectors."""

    def __init__(self, dimensions: int):
        letters = np.random.default_rng(3).integers(0, 2, (SYMBOLS, dimensions)).astype(np.float32) * 2 - 1
        self.third, self.second, self.first = letters, np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
        self.symbol = np.full(0x110000, -1, dtype=np.int16)
        self.place = np.full(SYMBOLS ** 3, -1, dtype=np.int32)
        self.grams = np.empty(0, dtype=np.int64)
        self.vectors = np.empty((0, dimensions), dtype=np.float32)

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        out = self.symbol[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]):
                c = chr(p).lower()[0]
                self.symbol[p] = 0 if not c.isalpha() else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) * 40503 % (SYMBOLS - 27)
            out = self.symbol[points]
        return out

    def counted(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each run, index of each run, rows that have a letter)."""
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        if len(data):
            starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
        else:
            starts = bounds
        symbols = self._symbols(points)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(starts))
        keep = symbols != 0
        keep[1:] |= symbols[:-1] != 0
        symbols, row = symbols[keep].astype(np.int64), row[keep]
        lettered = np.zeros(len(bounds) - 1, dtype=bool)
        lettered[row[symbols > 0]] = True
        # Each text is read with a blank before and after it.
        n = len(bounds) - 1
        order = np.argsort(np.concatenate([row * 3 + 1, np.arange(n) * 3, np.arange(n) * 3 + 2]), kind="stable")
        symbols = np.concatenate([symbols, np.zeros(2 * n, np.int64)])[order]
        row = np.concatenate([row, np.arange(n), np.arange(n)])[order]
        if len(symbols) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64), lettered
        code = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
        same = (row[:-2] == row[2:]) & (symbols[1:-1] > 0)
        code, row = code[same], row[:-2][same]
        index = self.place[code]
        if (index < 0).any():
            fresh = np.unique(code[index < 0])
            self.place[fresh] = len(self.grams) + np.arange(len(fresh))
            self.grams = np.concatenate([self.grams, fresh])
            a, b, c = fresh // SYMBOLS ** 2, fresh // SYMBOLS % SYMBOLS, fresh % SYMBOLS
            self.vectors = np.concatenate([self.vectors, self.first[a] * self.second[b] * self.third[c]])
            index = self.place[code]
        return row, index, lettered

    def bundled(self, row: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        """One bundled vector for each of ``n`` rows."""
        used = np.zeros(len(self.grams), dtype=bool)
        used[index] = True
        grams = np.flatnonzero(used)
        local = np.zeros(len(self.grams), dtype=np.int64)
        local[grams] = np.arange(len(grams))
        out = np.zeros((n, self.vectors.shape[1]), dtype=np.float32)
        step = max(1, 4_000_000 // max(1, len(grams)))
        for low in range(0, n, step):
            high = min(n, low + step)
            i, j = np.searchsorted(row, [low, high])
            flat = np.bincount((row[i:j] - low) * len(grams) + local[index[i:j]], minlength=(high - low) * len(grams))
            out[low:high] = flat.reshape(high - low, len(grams)).astype(np.float32) @ self.vectors[grams]
        return out


def _learn(dimensions: int):
    """A map over (lang, text): for each language the bundle of this task's texts, one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = _Encoder(dimensions), {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for low, high, data, bounds in arrays.text_slices(batch.column(1)):
                row, index, _ = encoder.counted(data, bounds)
                here = {name: k for k, name in enumerate(sorted(set(names[low:high])))}
                group = np.array([here[x] for x in names[low:high]], dtype=np.int64)
                g = len(encoder.grams)
                table = np.bincount(group[row] * g + index, minlength=len(here) * g).reshape(len(here), g) if g else np.zeros((len(here), 0))
                for name, k in here.items():
                    old = counts.get(name, np.zeros(0))
                    counts[name] = table[k] + np.pad(old, (0, g - len(old)))
        for name, count in counts.items():
            bundle = np.pad(count, (0, len(encoder.grams) - len(count))).astype(np.float64) @ encoder.vectors.astype(np.float64)
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * dimensions, pa.string()), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(bundle)],
                ["lang", "dimension", "value"])

    return run


def profiles(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The unit-length bundle of every language of ``labelled`` (lang, text), learned from all its rows.

    Tasks bundle their own texts and the sums per language and dimension are combined; what reaches the
    driver is ``dimensions`` numbers for each language.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInArrow(
        _learn(dimensions), "lang string, dimension int, value double")
    out: dict[str, np.ndarray] = {}
    for r in rows.groupBy("lang", "dimension").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r["lang"], np.zeros(dimensions))[r["dimension"]] = r["value"]
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if np.linalg.norm(v)}


def _predict(learned: dict[str, np.ndarray], dimensions: int, keep: list[str]):
    names = pa.array([*learned, "und"], pa.string())
    table = np.array([*learned.values()], dtype=np.float32).reshape(len(learned), dimensions).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(dimensions)
        for batch in batches:
            for low, high, data, bounds in arrays.text_slices(batch.column(len(keep))):
                row, index, lettered = encoder.counted(data, bounds)
                best, score = np.full(high - low, len(learned)), np.zeros(high - low)
                if len(learned) and len(index):
                    vectors = encoder.bundled(row, index, high - low)
                    length = np.linalg.norm(vectors, axis=1)
                    cosine = (vectors @ table) / np.maximum(length, 1e-9)[:, None]
                    best = np.where(lettered, cosine.argmax(axis=1), len(learned))
                    score = np.where(lettered, np.clip(cosine.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(low, high - low) for k in range(len(keep))] + [names.take(pa.array(best)), pa.array(score.astype(np.float64))],
                    [*keep, "lang_pred", "score"])

    return run


def held_out(doc_id: str | Column, of: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; False for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(of)) == rest, F.lit(False))


def languages(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang).

    Learns from rows with a language whose held-out remainder (crc32 of the id mod 3) is not 1.
    """
    base = extra_columns_dropped(docs, "doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 3, 1))
    learned = profiles(base.where(~F.col("held_out") & F.col("doc_id").isNotNull()), dimensions)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return base.select("doc_id", "held_out", "text").mapInArrow(
        _predict(learned, dimensions, ["doc_id", "held_out"]), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
