"""Benchmark passages in documents, with edits, by the pigeonhole principle and Myers' distance.

Words are compared: runs of letters and digits in lower case.  An item of ``m`` words may differ from a document's
passage by ``k = floor(budget * m)`` words added, left out or replaced.  The item is cut into
``k + 1`` pieces; whatever way ``k`` edits fall, one piece stays whole, so only the places of exact
piece hits need to be looked at.  There Myers' bit-parallel algorithm, one bit per item word, finds
the best end and distance over the passage, and the reversed words its start.

The benchmark is taken in blocks of ``block`` items; each block's pieces go to all tasks and every
document is read against them where it lies, so neither side is shuffled.

A missing text or item is empty.  An item of fewer than ``least`` words is too common to tell anything inside a text: it matches only
documents that hold the same words and no others; an item without words matches nothing.  Repeated documents and items are
reported each for itself.  Positions count code points of the text as given.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscript.llm import common

WORD = re.compile(r"[^\W_]+")
FOUND = "doc_id bigint, item_id bigint, distance int, n_words int, start bigint, end bigint"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def myers(item: list[int], text: list[int]) -> list[int]:
    """Edit distance of the item to the best passage ending with each word of the text."""
    m = len(item)
    if not m:
        return [0] * len(text)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    plus, minus, score, out = mask, 0, m, []
    for w in text:
        eq = places.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & mask
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        plus = (mh << 1 & mask) | ~(xv | ph) & mask
        minus = ph & xv
        out.append(score)
    return out


def piece_bounds(m: int, k: int) -> list[tuple[int, int]]:
    """``k + 1`` pieces of ``m`` words, their lengths as equal as can be."""
    return [(m * i // (k + 1), m * (i + 1) // (k + 1)) for i in range(k + 1)]


class Index:
    """Pieces of a block of items, by length and hash of their word numbers."""

    def __init__(self, items: list[tuple[int, str]], budget: float, least: int):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int], int]] = []
        self.short: dict[tuple[int, ...], list[int]] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            if not w:
                continue
            if len(w) < least:
                self.short.setdefault(tuple(w), []).append(item_id)
                continue
            k = int(budget * len(w))
            for a, z in piece_bounds(len(w), k):
                found.setdefault(z - a, []).append((int(self._hash(np.array(w[a:z]), z - a)[0]), len(self.items), a))
            self.items.append((item_id, w, k))
        self.pieces = {}
        for n, rows in found.items():
            rows.sort()
            self.pieces[n] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    @staticmethod
    def _hash(numbers: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of ``n`` numbers."""
        out = np.zeros(len(numbers) - n + 1, np.uint64)
        for i in range(n):
            out = common.mix(out ^ numbers[i:len(numbers) - n + 1 + i].astype(np.uint64), i)
        return out

    def hits(self, numbers: np.ndarray) -> dict[int, list[int]]:
        """For each item the places in the text where it would begin if a hit piece lay at its own place."""
        out: dict[int, set[int]] = {}
        unknown = np.concatenate([[0], np.cumsum(numbers == 0)])
        for n, (keys, item, offset) in self.pieces.items():
            if len(numbers) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for i in range(n):
                h = common.mix(h ^ numbers[at + i].astype(np.uint64), i)
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            for j in np.flatnonzero(hi > lo):
                for r in range(lo[j], hi[j]):
                    out.setdefault(int(item[r]), set()).add(int(at[j]) - int(offset[r]))
        return {i: sorted(s) for i, s in out.items()}

    def find(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item_id, distance, words of the item, start, end) of the best passage for each item in the text."""
        lowered = text.lower()
        # where lower case has other lengths, positions are taken word by word from the text itself
        spans = [m.span() for m in WORD.finditer(lowered if len(lowered) == len(text) else text)]
        source = lowered if len(lowered) == len(text) else text
        numbers = np.array([self.vocabulary.get(source[a:z].lower(), 0) for a, z in spans], dtype=np.int64)
        if not len(numbers):
            return
        for item_id in self.short.get(tuple(numbers.tolist()), ()):
            yield item_id, 0, len(numbers), spans[0][0], spans[-1][1]
        if not self.items or not numbers.any():
            return
        listed = numbers.tolist()
        for i, starts in self.hits(numbers).items():
            item_id, w, k = self.items[i]
            best: tuple[int, int, int] | None = None
            seen = -1
            for s in starts:
                a, z = max(0, s - k), min(len(listed), s + len(w) + k)
                if z <= seen:
                    continue
                seen = z
                scores = myers(w, listed[a:z])
                d = min(scores)
                if d <= k and (best is None or d < best[0]):
                    end = a + scores.index(d)
                    back = myers(w[::-1], listed[max(0, end + 1 - len(w) - k):end + 1][::-1])
                    best = d, end - back.index(min(back)), end
            if best:
                yield item_id, best[0], len(w), spans[best[1]][0], spans[best[2]][1]


def contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = 0.2, least: int = 5, block: int = 5000) -> DataFrame:
    """A row per document and item it holds: distance in words, words of the item, start and end of the best passage."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint"), F.coalesce(F.col("text"), F.lit(""))).orderBy("item_id")
    out: DataFrame | None = None
    part: list[tuple[int, str]] = []

    def scan(index) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = index.value
            for b in common.pieces(batches):
                rows = [(i, *hit) for i, t in enumerate(b.column(1).to_pylist()) for hit in found.find(t)]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column(0).take(pa.array(cols[0], pa.int64())), "item_id": pa.array(cols[1], pa.int64()),
                    "distance": pa.array(cols[2], pa.int32()), "n_words": pa.array(cols[3], pa.int32()),
                    "start": pa.array(cols[4], pa.int64()), "end": pa.array(cols[5], pa.int64())})

        return common.texts(docs).mapInArrow(run, FOUND)

    for row in items.toLocalIterator():
        part.append((row[0], row[1]))
        if len(part) == block:
            more = scan(spark.sparkContext.broadcast(Index(part, budget, least)))
            out, part = more if out is None else out.unionByName(more), []
    if part or out is None:
        more = scan(spark.sparkContext.broadcast(Index(part, budget, least)))
        out = more if out is None else out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``docs`` without those that hold a benchmark item; all columns are kept.

    Each document is decided where it is read, block by block of the benchmark.
    """
    spark = docs.sparkSession
    budget, least, block = (parameters.get(k, v) for k, v in (("budget", 0.2), ("least", 5), ("block", 5000)))
    part: list[tuple[int, str]] = []

    def keep(df: DataFrame, index) -> DataFrame:
        column = next(i for i, c in enumerate(df.columns) if c == "text")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = index.value
            for b in common.pieces(batches):
                yield b.filter(pa.array([not t or next(found.find(t), None) is None for t in b.column(column).to_pylist()], pa.bool_()))

        return df.mapInArrow(run, df.schema)

    for row in benchmark.select(F.col("item_id").cast("bigint"), F.coalesce(F.col("text"), F.lit(""))).orderBy("item_id").toLocalIterator():
        part.append((row[0], row[1]))
        if len(part) == block:
            docs, part = keep(docs, spark.sparkContext.broadcast(Index(part, budget, least))), []
    return keep(docs, spark.sparkContext.broadcast(Index(part, budget, least))) if part else docs
