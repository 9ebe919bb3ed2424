"""Words of two documents brought together by pair of documents.

A document's words are packed into one value where they lie, and go to the pairs of the document in that form; which words of which sentences
meet is worked out for some pairs at a time, so what meets is never shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscript.session import spread

# words that are looked at together, a pair of documents at least, and words that may meet at once
WORDS, HITS = 1 << 18, 1 << 21


def _pack(pos: np.ndarray, words: pa.Array) -> bytes:
    valid = pc.is_valid(words).to_numpy(zero_copy_only=False).astype(np.uint8)
    words = pc.fill_null(words, "").cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    size = np.diff(ends).astype("<i4")
    text = words.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])) if ends[-1] > ends[0] else b""
    raw = b"".join((np.diff(pos, prepend=np.int64(0)).astype("<i8").tobytes(), size.tobytes(), valid.tobytes(), text))
    return struct.pack("<QQ", len(pos), len(raw)) + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Positions, lengths, which are there, and the words' bytes."""
    n, size = struct.unpack_from("<QQ", data, 0)
    raw = pa.Codec("zstd").decompress(memoryview(data)[16:], size, asbytes=True)
    return np.cumsum(np.frombuffer(raw, "<i8", n)), np.frombuffer(raw, "<i4", n, 8 * n), np.frombuffer(raw, np.uint8, n, 12 * n), raw[13 * n:]


def _documents(words: DataFrame, side: Column) -> DataFrame:
    """``doc, side, data``: the words of a document, in a value for each batch of rows that has any."""
    kind = dict(words.dtypes)["doc"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(0).dictionary_encode()
            order = np.lexsort((b.column(1).to_numpy(), codes.indices.to_numpy()))
            sent, doc = b.column(1).to_numpy()[order], codes.indices.to_numpy()[order]
            word = b.column(2).take(pa.array(order))
            ends = np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc))
            starts = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_pydict({"doc": codes.dictionary.take(pa.array(doc[starts])), "data": pa.array(
                [_pack(sent[s:e], word.slice(s, e - s)) for s, e in zip(starts, ends)], pa.binary())})

    rows = words.select("doc", F.col("sent_pos").cast("bigint").alias("sent_pos"), "word").where("doc is not null and sent_pos is not null")
    return rows.mapInArrow(gather, f"doc {kind}, data binary").withColumn("side", side)


class Met:
    """Words of some pairs of documents: ``pair`` (a number, see ``ids``), ``side``, ``pos``, ``word`` (a number, in alphabetical order; see ``words``),
    ``there`` (whether the word is one), ``slope`` and ``n`` (words of the sentence)."""

    def __init__(self, rows: list[tuple], id_type: pa.DataType):
        parts = [_unpack(r[3]) for r in rows]
        sizes = np.array([len(p[0]) for p in parts], np.int64)
        ids = pa.array([r[0] for r in rows], id_type).dictionary_encode()
        self.ids = ids.dictionary
        self.pair = np.repeat(ids.indices.to_numpy().astype(np.int64), sizes)
        self.side = np.repeat(np.array([r[1] for r in rows], np.int64), sizes)
        self.slope = np.repeat(np.array([np.nan if r[2] is None else r[2] for r in rows]), sizes)
        self.pos = np.concatenate([p[0] for p in parts])
        self.there = np.concatenate([p[2] for p in parts]).astype(bool)
        ends = np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]), dtype=np.int64)])
        text = pa.LargeStringArray.from_buffers(len(self.pos), pa.py_buffer(ends), pa.py_buffer(b"".join(p[3] for p in parts))).dictionary_encode()
        order = pc.sort_indices(text.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        self.words, self.word = text.dictionary.take(order), rank[text.indices.to_numpy()]
        # a document counts once for each row of its pair
        _, row = np.unique(np.array([(r[4], r[1]) for r in rows], np.int64), axis=0, return_inverse=True)
        low, high = int(self.pos.min()), int(self.pos.max())
        _, of, n = np.unique(np.repeat(row.reshape(-1), sizes) * (high - low + 1) + self.pos - low, return_inverse=True, return_counts=True)
        self.n = n[of]

    def hits(self, width: int, middle: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of source words and of target words, of one pair and alike, in buckets of ``width`` sentences next to each other."""
        left = np.flatnonzero((self.side == 0) & self.there & np.isfinite(middle))
        right = np.flatnonzero((self.side == 1) & self.there)
        if not len(left) or not len(right):
            return
        # words of a pair in order of their sentences, as one number
        low = min(int(self.pos[right].min()), int(np.floor(middle[left].min()))) - 2 * width
        span = max(int(self.pos[right].max()), int(np.ceil(middle[left].max()))) + 2 * width - low
        key = (self.pair * len(self.words) + self.word) * span - low
        ordered = key[right] + self.pos[right]
        by = np.argsort(ordered)
        right, ordered = right[by], ordered[by]
        first = np.searchsorted(ordered, key[left] + np.ceil(middle[left] - width).astype(np.int64), side="left")
        last = np.searchsorted(ordered, key[left] + np.floor(middle[left] + width).astype(np.int64), side="right")
        n = np.maximum(last - first, 0)
        upto = np.cumsum(n)
        start = 0
        while start < len(left):
            before = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + HITS, side="right")))
            some = n[start:end]
            a = np.repeat(left[start:end], some)
            b = right[np.arange(len(a)) - np.repeat(np.cumsum(some) - some - first[start:end], some)]
            yield a, b
            start = end

    def order(self, pair: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of some pairs of sentences, and where in it another one begins."""
        if not len(pair):
            return np.zeros(0, int), np.zeros(0, int)
        low_i, low_j = int(i.min()), int(j.min())
        key = (pair * (int(i.max()) - low_i + 1) + i - low_i) * (int(j.max()) - low_j + 1) + j - low_j
        by = np.argsort(key)
        key = key[by]
        return by, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def meet(src: DataFrame, trg: DataFrame, pairs: DataFrame, work: Callable[[Met], Iterator[pa.RecordBatch]], schema: str, slope: Column | None = None) -> DataFrame:
    """``work`` on the words ``doc, sent_pos, word`` of both documents of each pair, some pairs at a time."""
    slope = F.lit(None).cast("double") if slope is None else slope.cast("double")
    sides = pairs.where("pair_id is not null").select("pair_id", slope.alias("slope"), F.monotonically_increasing_id().alias("row"), F.explode(F.array(*[
        F.struct(F.col(f"{name}_doc").alias("doc"), F.lit(k).alias("side")) for k, name in enumerate(("src", "trg"))])).alias("x"))
    sides = sides.select("pair_id", "slope", "row", "x.doc", "x.side")
    if src is trg:
        both = sides.join(_documents(src, F.lit(0)).drop("side"), "doc")
    else:
        both = sides.join(_documents(src, F.lit(0)).unionByName(_documents(trg, F.lit(1))), ["doc", "side"])
    rows = both.select("pair_id", "side", "slope", "data", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kind = [], 0, None
        for b in batches:
            kind = b.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # the rows of a pair come one after the other
                if n > WORDS and held[-1][0] != row[0]:
                    yield from work(Met(held, kind))
                    held, n = [], 0
                held.append(row)
                n += struct.unpack_from("<Q", row[3], 0)[0]
        if held:
            yield from work(Met(held, kind))

    return spread(rows, "pair_id").sortWithinPartitions("pair_id").mapInArrow(run, schema)
