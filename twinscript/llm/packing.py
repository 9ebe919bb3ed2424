"""Harmonic packing of documents into sequences of a fixed number of tokens.

Class ``j`` holds pieces of ``floor(capacity / j)`` ids, ``j`` to a sequence, as in the Harmonic
algorithm for bin packing; since documents may be cut, a piece is cut to the full length of its
class, so nothing but ``capacity - j * floor(capacity / j)`` ids of a sequence stay free.  Only
classes that leave at most ``waste`` ids free are used.  A document gives as many full sequences as
it can, and its rest the longest piece that fits, again and again.

Every task numbers the pieces of each class by itself.  With the numbers of pieces per task and
class, some rows per task, those numbers become numbers over all tasks, and a piece's sequence is its number
divided by the pieces of a sequence.  No text or id is shuffled, and one sequence per class at most is left
partly filled; the pieces of these few are then put together by first fit, longest first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinscript.llm import common
from twinscript.llm.tokens import Encoder
from twinscript.session import cut_lineage

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "task bigint, place bigint")


def classes(capacity: int, waste: int = 4) -> dict[int, int]:
    """Pieces per sequence by length of a piece, longest first."""
    out = {}
    for length in range(capacity, 0, -1):
        if capacity - capacity // length * length <= waste and capacity // (capacity // length) == length:
            out[length] = capacity // length
    return out


def cuts(n: int, lengths: list[int]) -> list[int]:
    """Lengths of the pieces of ``n`` ids; ``lengths`` is descending and ends with 1."""
    out = [lengths[0]] * (n // lengths[0])
    n %= lengths[0]
    for length in lengths:
        while n >= length:
            out.append(length)
            n -= length
    return out


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, waste: int = 4,
                  end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row per piece: document, first id, length, checksum, ids of the document, task, and its number among
    the pieces of its length in that task; ``with_ids`` adds the ids themselves.

    A missing text is empty and gives one piece with the end id; a missing ``doc_id`` stays missing, repeated rows
    are packed each for itself, and further columns are left out.
    """
    lengths = list(classes(capacity, waste))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder.shared(tokenizer), common.partition_id()
        of = {n: cuts(n, lengths) for n in range(capacity)}
        numbers = dict.fromkeys(lengths, 0)
        for b in common.pieces(batches):
            ids, bounds = encoder.encode(b.column(1))
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            raw = memoryview(ids.tobytes())
            doc, start, length, crc, total, place, content = [], [], [], [], [], [], []
            for i, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                n = z - a
                at = a
                for size in [capacity] * (n // capacity) + of[n % capacity]:
                    doc.append(i)
                    start.append(at - a)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * at:4 * (at + size)]))
                    total.append(n)
                    place.append(numbers[size])
                    numbers[size] += 1
                    if with_ids:
                        content.append(ids[at:at + size])
                    at += size
            out = {"doc_id": b.column(0).take(pa.array(doc, pa.int64())), "start": pa.array(start, pa.int64()),
                   "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                   "doc_tokens": pa.array(total, pa.int64()), "task": pa.array([task] * len(doc), pa.int64()),
                   "place": pa.array(place, pa.int64())}
            if with_ids:
                out["ids"] = pa.array(content, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return common.texts(docs).mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def rest_plan(totals: dict[int, int], of: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Places of the pieces that fill no sequence of their class: (length, number, sequence, offset), and the
    number of these sequences, which follow one another from 0.  At most ``sum(of.values())`` pieces."""
    plan, fill = [], []
    for length, j in of.items():
        for number in range(totals.get(length, 0) // j * j, totals.get(length, 0)):
            s = next((s for s, used in enumerate(fill) if used + length <= capacity), len(fill))
            if s == len(fill):
                fill.append(0)
            plan.append((length, number, s, fill[s]))
            fill[s] += length
    return plan, len(fill)


def pack(pieces: DataFrame, capacity: int = 1024, waste: int = 4) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces of ``cut_documents``.

    Sequences are numbered class by class, so a full sequence holds pieces of one length, side by side.
    """
    spark, of = pieces.sparkSession, classes(capacity, waste)
    pieces = cut_lineage(pieces)
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = cut_lineage(per_task.select("task", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    # a row per class
    totals = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("n")).collect()}
    plan, extra = rest_plan(totals, of, capacity)
    base, at = [], 0
    for length, j in of.items():
        base.append((length, j, at, totals.get(length, 0) // j * j))
        at += totals.get(length, 0) // j
    table = spark.createDataFrame(base, "length bigint, per int, base bigint, full bigint")
    rest = spark.createDataFrame([(a, b, at + c, d) for a, b, c, d in plan],
                                 "length bigint, number bigint, rest_sequence bigint, rest_offset bigint")
    numbered = (pieces.join(per_task.drop("n"), ["task", "length"]).join(F.broadcast(table), "length")
                .withColumn("number", F.col("before") + F.col("place")).join(F.broadcast(rest), ["length", "number"], "left"))
    whole = F.col("number") < F.col("full")
    return numbered.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(whole, F.col("base") + F.floor(F.col("number") / F.col("per"))).otherwise(F.col("rest_sequence")).alias("sequence_id"),
        F.when(whole, F.col("number") % F.col("per") * F.col("length")).otherwise(F.col("rest_offset")).alias("offset"),
        *[c for c in ("ids",) if c in pieces.columns])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, waste: int = 4, with_ids: bool = False) -> DataFrame:
    """All documents cut and packed; see ``cut_documents`` and ``pack``."""
    return pack(cut_documents(docs, tokenizer, capacity, waste, with_ids=with_ids), capacity, waste)
