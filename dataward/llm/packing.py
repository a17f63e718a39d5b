"""Sum-of-squares packing of tokenised documents into sequences.

A document is its token ids and an end id. One longer than a sequence is cut into pieces of full length,
of which the first takes the rest. The pieces that do not fill a sequence are placed from the longest on,
each where the sum of the squared numbers of open sequences per remaining gap becomes least; a new sequence
is begun only where no open one has room.

Defined cases: a null text is an empty one and gives one piece, the end id; repeated rows and null ids are
packed like others; an empty table gives no piece.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.llm import arrays
from dataward.llm.shared import extra_columns_dropped, written

#: Fixed value: how byte-level BPE files of this kind split a text into words.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Code points that the fast splitter knows; texts with others go to the tokenizer as they are.
KNOWN = 0x250
#: Distinct words whose ids a worker keeps before it starts afresh.
CACHE_WORDS = 1_500_000


def _classes() -> np.ndarray:
    """1 letter, 2 number, 3 white space, 4 anything else, for the known code points."""
    out = np.full(KNOWN, 4, dtype=np.uint8)
    for c in range(KNOWN):
        kind = unicodedata.category(chr(c))[0]
        out[c] = 1 if kind == "L" else 2 if kind == "N" else 3 if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) else 4
    return out


def _rank_coder(path: str):
    """A coder with the ranks of a byte-level BPE file, or None if its ids are not ranks."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # Bytes as byte-level files spell them: printable ones as they are, the others from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = model["vocab"]
    if [ids.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in ids.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class WordTokenizer:
    """Ids of many texts at once by a byte-level BPE file.

    The tokenizer splits a text into words by a fixed pattern and encodes each by itself. Here the words of
    all texts are found with array operations and only words not seen before are encoded. Where the ids of
    the file follow its merges, single words go through a faster coder that is given the same ranks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Tokens of the file's own that stand for themselves wherever a text holds them; such texts go to the library whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.coder = _rank_coder(path)
        self.classes = _classes()
        self.value = np.random.default_rng(10).integers(1, 1 << 63, KNOWN, dtype=np.uint64)
        self._empty()

    def _empty(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def _words(self, words: list[str]) -> list[list[int]]:
        if self.coder is None:
            return self._library(words)
        return [self.coder.encode_ordinary(w) for w in words]

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _starts(self, points: np.ndarray, first: np.ndarray, row_of: np.ndarray) -> np.ndarray:
        """Where words start, by the pattern: contractions; letters, numbers or other signs with at most one
        blank before them; white space up to the last sign before a word."""
        kind = self.classes[points]
        n = len(points)
        change = np.ones(n, dtype=bool)
        change[1:] = (kind[1:] != kind[:-1]) | (row_of[1:] != row_of[:-1])
        start = change.copy()
        follows = np.flatnonzero(change[1:] & (kind[1:] != 3) & (kind[:-1] == 3) & (row_of[1:] == row_of[:-1])) + 1
        start[follows - 1] = True
        start[follows[points[follows - 1] == 32]] = False
        quote = np.flatnonzero(start[:-1] & (points[:-1] == 39) & (kind[1:] == 1) & (row_of[1:] == row_of[:-1]))
        for i in quote[change[quote]]:
            end = i + 2
            letter = chr(points[i + 1])
            if letter not in "stmd":
                if i + 2 >= n or row_of[i + 2] != row_of[i] or letter + chr(points[i + 2]) not in ("re", "ve", "ll"):
                    continue
                end = i + 3
            start[i + 1] = False
            if end < n and row_of[end] == row_of[i]:
                start[end] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        plain = [(t.isascii() or max(t) < "ɐ") and not any(a in t for a in self.added) for t in texts]
        joined = "".join(t for t, p in zip(texts, plain, strict=True) if p)
        sizes = np.array([len(t) if p else 0 for t, p in zip(texts, plain, strict=True)], dtype=np.int64)
        counts = np.zeros(len(texts), dtype=np.int64)
        ids = np.empty(0, np.uint32)
        if joined:
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            row_of = np.repeat(np.arange(len(texts)), sizes)
            start = self._starts(points, np.cumsum(sizes) - sizes, row_of)
            end = np.append(start[1:], len(points))
            up, down = arrays._power(len(points) + 1)
            sums = np.zeros(len(points) + 1, dtype=np.uint64)
            np.cumsum(self.value[points] * up[:len(points)], out=sums[1:])
            codes, first, back = np.unique(arrays.mix((sums[end] - sums[start]) * down[start]), return_index=True, return_inverse=True)
            if len(self.known) > CACHE_WORDS:
                self._empty()
            place = np.searchsorted(self.known, codes)
            new = np.ones(len(codes), dtype=bool)
            near = place < len(self.known)
            new[near] = self.known[place[near]] != codes[near]
            if new.any():
                found = self._words([joined[start[i]:end[i]] for i in first[new]])
                length = np.array([len(x) for x in found], dtype=np.int64)
                begin = len(self.pool) + np.cumsum(length) - length
                self.pool = np.concatenate([self.pool, np.array([i for x in found for i in x], dtype=np.uint32)])
                self.known = np.insert(self.known, place[new], codes[new])
                self.at = np.insert(self.at, place[new], begin)
                self.size = np.insert(self.size, place[new], length)
                place = np.searchsorted(self.known, codes)
            at, size = self.at[place][back], self.size[place][back]
            total = np.cumsum(size)
            ids = self.pool[np.repeat(at - (total - size), size) + np.arange(total[-1])]
            counts = np.bincount(row_of[start], weights=size, minlength=len(texts)).astype(np.int64)
        if not all(plain):
            other = [i for i, p in enumerate(plain) if not p]
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, x in zip(other, self._library([texts[i] for i in other]), strict=True):
                parts[i] = np.array(x, dtype=np.uint32)
                counts[i] = len(x)
            ids = np.concatenate(parts)
        return ids, counts


class SumOfSquares:
    """Open sequences by their gap; ``place`` puts an item into the gap that keeps the squares least.

    Items should come from the longest on: then sequences are begun by the long ones and closed by the
    short ones, which leaves about 0.1 percent unfilled where arrival order leaves 4 percent.
    """

    def __init__(self, capacity: int, first: int):
        self.capacity, self.fresh = capacity, first
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = np.zeros(capacity + 1, dtype=np.int64)

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of an item of at most the capacity."""
        # Moving a sequence from gap g to g - size changes the sum by 2 (N[g - size] - N[g] + 1), closing it
        # by 1 - 2 N[g].
        change = 2 * (self.count[:self.capacity + 1 - size] - self.count[size:]) + 2
        change[0] = 1 - 2 * self.count[size]
        change[self.count[size:] == 0] = np.iinfo(np.int64).max
        gap = int(change.argmin()) + size
        if not self.count[gap]:
            gap = self.capacity
        if gap == self.capacity:
            sequence, self.fresh = self.fresh, self.fresh + 1
        else:
            sequence = self.open[gap].pop()
            self.count[gap] -= 1
        left = gap - size
        if left:
            self.open[left].append(sequence)
            self.count[left] += 1
        return sequence, self.capacity - gap


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at"]


def _cut_and_place(path: str, capacity: int, end_id: int):
    """A map over (doc_id, text): pieces with their sequence and offset inside this task's sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        packer = SumOfSquares(capacity, TaskContext.get().partitionId() << 32)
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            for low, high, data, bounds in arrays.text_slices(batch.column(1)):
                raw = data.tobytes()
                texts = [raw[bounds[i]:bounds[i + 1]].decode() for i in range(high - low)]
                ids, counts = tokenizer.encode(texts)
                begin = np.concatenate([[0], np.cumsum(counts)])
                owner, rows = [], []
                for i in range(high - low):
                    own = np.append(ids[begin[i]:begin[i + 1]], np.uint32(end_id)).astype("<u4")
                    cut = [0, *range(len(own) % capacity or capacity, len(own), capacity), len(own)]
                    for k in range(len(cut) - 1):
                        owner.append(low + i)
                        rows.append((k, cut[k], cut[k + 1] - cut[k], zlib.crc32(own[cut[k]:cut[k + 1]].tobytes())))
                columns = [np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)]
                part = pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner))] + [pa.array(c) for c in columns], _PIECE[:5])
                full = columns[2] == capacity
                if full.any():
                    own_bins = packer.fresh + np.arange(full.sum())
                    packer.fresh += int(full.sum())
                    yield placed(part.filter(pa.array(full)), own_bins, np.zeros(len(own_bins), np.int64))
                waiting.append(part.filter(pa.array(~full)))
        rest = pa.Table.from_batches(waiting).combine_chunks().to_batches() if waiting else []
        for part in rest:
            order = np.argsort(-part.column(3).to_numpy(), kind="stable")
            places = np.array([packer.place(int(n)) for n in part.column(3).to_numpy()[order]], dtype=np.int64).reshape(-1, 2)
            yield placed(part.take(pa.array(order)), places[:, 0], places[:, 1])

    def placed(part: pa.RecordBatch, bins: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(bins), pa.array(at)], _PIECE)

    return run


def _merge(capacity: int):
    """Groups of open sequences packed once more as items of their fill, largest first."""

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by([("fill", "descending"), ("bin", "ascending")])
        packer = SumOfSquares(capacity, 0)
        bins = order.column("bin").to_pylist()
        head: dict[int, int] = {}
        target, shift = [], []
        for b, fill in zip(bins, order.column("fill").to_pylist(), strict=True):
            sequence, at = packer.place(fill)
            target.append(head.setdefault(sequence, b))
            shift.append(at)
        return pa.table({"bin": pa.array(bins, pa.int64()), "target": pa.array(target, pa.int64()), "shift": pa.array(shift, pa.int64())})

    return run


def packed(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, fan_in: int = 64) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of ``docs`` (doc_id, text).

    Each task packs its own pieces as it reads them. What its open sequences hold is then packed again as
    one item each, ``fan_in`` tasks together, and so on up to one group, so that the unfilled sequences do not
    grow with the number of tasks. Pieces are written once, before sequences move.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = written(extra_columns_dropped(docs, "doc_id", "text").mapInArrow(
        _cut_and_place(path, capacity, end_id), f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, bin long, at long"))
    fills = written(pieces.groupBy("bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < capacity))
    tasks = pieces.agg(F.max(F.shiftright("bin", 32))).first()[0]
    moves = None
    span = 1
    while tasks is not None and (span == 1 or span <= tasks):
        span *= fan_in
        group = F.floor(F.shiftright("bin", 32) / span)
        step = written(fills.groupBy(group.alias("g")).applyInArrow(
            _merge(capacity), "bin long, target long, shift long"))
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("bin").alias("target"), F.col("target").alias("to"), F.col("shift").alias("more"))
            moves = moves.join(later, "target", "left").select(
                "bin", F.coalesce("to", "target").alias("target"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        fills = written(fills.join(step, "bin").groupBy(F.col("target").alias("bin")).agg(F.sum("fill").alias("fill")).where(F.col("fill") < capacity))
    if moves is None:
        moves = fills.select("bin", F.col("bin").alias("target"), F.lit(0).cast("long").alias("shift"))
    return pieces.join(moves, "bin", "left").select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", F.coalesce("target", "bin").alias("sequence_id"),
        (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))
