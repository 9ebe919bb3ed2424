"""Context-triggered piecewise hashes of texts, and how alike two of them are.

A rolling hash of the last seven bytes decides where a chunk ends: after a place whose hash, plus one, is a
multiple of the block size ``3 * 2**i``.  As it depends on these bytes alone, an edit moves only the ends near it.
Each chunk gives one of 64 letters, and the smallest block size with at most ``LENGTH`` chunks is
taken.  The fingerprint is ``block size:letters:letters at twice that size``; the whole text counts, nothing is cut off.

Two fingerprints are compared at equal block sizes, at the first's doubled or the second's doubled.  Letters that share a
run of ``RUN`` are rated ``1 - distance / length of both``, the distance counting letters added and left
out; without such a run they are alike by chance, and rated 0 unless equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinscript.llm import common
from twinscript.session import cut_lineage

WINDOW = 7
LENGTH = 64
RUN = 4
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
GAP = b"\0" * WINDOW
ROWS = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, task int, edge int, text string")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprints of many texts at once; blocks of zeros between them empty the window."""
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    c = np.frombuffer(GAP + GAP.join(texts) + GAP, dtype=np.uint8)
    begin = WINDOW + np.cumsum(sizes + WINDOW) - (sizes + WINDOW)
    n = len(c) - WINDOW
    wide = c.astype(np.uint32)
    total = np.zeros(n, np.uint32)
    graded = np.zeros(n, np.uint32)
    shifted = np.zeros(n, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):  # i bytes ago
            part = wide[WINDOW - i:len(c) - i]
            total += part
            graded += part * np.uint32(WINDOW - i)
            shifted ^= part << np.uint32(5 * i) if 5 * i < 32 else np.uint32(0)
        h = total + graded + shifted + np.uint32(1)
        # hashes at a place of the whole array; the first bytes are a gap
        place = np.flatnonzero(h % np.uint32(3) == 0) + WINDOW
        owner = np.searchsorted(begin, place, side="right") - 1
        inside = (owner >= 0) & (place < begin[owner] + sizes[owner])
        place, owner = place[inside], owner[inside]
        g = h[place - WINDOW]
        low = g & (~g + np.uint32(1))
        level = np.where(g == 0, 32, np.bitwise_count(low - np.uint32(1)).astype(np.int64))
        # a trigger at the last byte ends the last chunk; else the rest of the text is one more
        counts = np.bincount(owner * 34 + level, minlength=34 * len(texts)).reshape(-1, 34)[:, ::-1].cumsum(axis=1)[:, ::-1]
        end = begin + sizes - 1
        closed = np.full(len(texts), -1, dtype=np.int64)
        at_end = place == end[owner]
        closed[owner[at_end]] = level[at_end]
        chunks = counts[:, :33] + ((closed[:, None] < np.arange(33)) & (sizes[:, None] > 0))
        chosen = (chunks <= LENGTH).argmax(axis=1)
        power, back = _powers(BASE, len(c)), _powers(BASE_INVERSE, len(c))
        sums = np.cumsum((wide.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)
        out = []
        for step in (0, 1):
            keep = level >= chosen[owner] + step
            # the end of each text closes its last chunk
            full = sizes > 0
            last = np.concatenate([place[keep], end[full]])
            who = np.concatenate([owner[keep], np.flatnonzero(full)])
            ordered = np.argsort(last, kind="stable")
            last, who = last[ordered], who[ordered]
            new = np.ones(len(last), dtype=bool)
            new[1:] = last[1:] != last[:-1]
            last, who = last[new], who[new]
            first = np.empty(len(last), dtype=np.int64)
            if len(last):
                first[0] = begin[who[0]]
                first[1:] = np.where(who[1:] == who[:-1], last[:-1] + 1, begin[who[1:]])
            value = (sums[last] - sums[first - 1]) * back[first]
            letters = LETTERS[(common.mix(value) >> np.uint64(58)).astype(np.int64)].tobytes().decode()
            cut = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(texts)))]).tolist()
            out.append([letters[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)])
    return [f"{3 << int(k)}:{a}:{b}" for k, a, b in zip(chosen, *out, strict=True)]


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per letter of ``a``."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for x in b:
        u = row & places.get(x, 0)
        row = (row + u | row - u) & mask
    return len(a) - row.bit_count()


def alike(a: str, b: str) -> float:
    """Likeness of two strings of letters."""
    if a == b:
        return 1.0 if a else 0.0
    runs = {a[i:i + RUN] for i in range(len(a) - RUN + 1)}
    if not any(b[i:i + RUN] in runs for i in range(len(b) - RUN + 1)):
        return 0.0
    return 2 * common_letters(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1 for two fingerprints; 1 for equal ones, 0 at incompatible block sizes."""
    if a == b:
        return 1.0
    x, a1, a2 = a.split(":")
    y, b1, b2 = b.split(":")
    x, y = int(x), int(y)
    if x == y:
        return max(alike(a1, b1), alike(a2, b2))
    if x == 2 * y:
        return alike(a1, b2)
    return alike(a2, b1) if y == 2 * x else 0.0


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``fingerprint`` of the text; a missing text is empty, with the fingerprint ``3::``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches, limit=2 << 20):
            found = fingerprints(b.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return common.texts(docs).mapInArrow(run, "doc_id bigint, fingerprint string")


def _edited(texts: list[str], following: list[str]) -> list[str]:
    return [t[:len(t) - len(t) // 2] + f[:len(t) // 2] for t, f in zip(texts, following, strict=True)]


def _compared(ids: list, texts: list[str], prints: list[str], following: list[str], next_prints: list[str]) -> dict:
    edited = [t.encode() for t in _edited(texts, following)]
    changed = []
    at, size = 0, 0
    for i, e in enumerate(edited):
        size += len(e)
        if size > 2 << 20 or i == len(edited) - 1:
            changed += fingerprints(edited[at:i + 1])
            at, size = i + 1, 0
    return {"doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            "fingerprint": pa.array(prints, pa.string()), "edited_fingerprint": pa.array(changed, pa.string()),
            "near_edited": pa.array([likeness(a, b) for a, b in zip(prints, changed, strict=True)], pa.float64()),
            "near_next": pa.array([likeness(a, b) for a, b in zip(prints, next_prints, strict=True)], pa.float64())}


def next_and_edited(docs: DataFrame) -> DataFrame:
    """A row per document: its fingerprint, that of its edited text, and its likeness to this one and to the next document's.

    In the edited text the last half is replaced by the beginning of the next document, by ascending ``doc_id``,
    then hash of the text; the first document follows the last.  Documents are range-sorted once and compared in
    passing; only the first and last text of each task are kept aside, and brought together afterwards.  A missing id comes
    first, a missing text is empty; a single document follows itself.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    rows = common.texts(docs).withColumn("_tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = common.partition_id()

        def edge(kind: int, i, t: str, f: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([i], pa.int64()), pa.array([len(t)], pa.int64()), pa.array([None], pa.string()), pa.array([f], pa.string()),
                pa.array([None], pa.string()), pa.array([None], pa.float64()), pa.array([None], pa.float64()),
                pa.array([task], pa.int32()), pa.array([kind], pa.int32()), pa.array([t], pa.string())], names=names)

        last: tuple | None = None
        for b in common.pieces(batches, limit=2 << 20):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            prints = fingerprints([t.encode() for t in texts])
            if last is None:
                yield edge(2, ids[0], texts[0], prints[0])
            else:
                ids, texts, prints = [last[0], *ids], [last[1], *texts], [last[2], *prints]
            last = ids[-1], texts[-1], prints[-1]
            if len(ids) > 1:
                out = _compared(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
                n = len(ids) - 1
                yield pa.RecordBatch.from_pydict(out | {"task": pa.array([task] * n, pa.int32()), "edge": pa.array([0] * n, pa.int32()),
                                                        "text": pa.array([None] * n, pa.string())})
        if last is not None:
            yield edge(1, *last)

    found = cut_lineage(dealt.mapInArrow(run, ROWS))
    # one row per task from here on
    w = Window.orderBy("task")
    starts = found.where("edge = 2").select("task")
    first = starts.agg(F.min("task")).first()[0]
    follows = starts.select("task", F.coalesce(F.lead("task").over(w), F.lit(first).cast("int")).alias("follower"))
    heads = found.where("edge = 2").select(F.col("task").alias("follower"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    open_ = found.where("edge = 1").join(follows, "task").join(heads, "follower").select(
        "doc_id", "text", "fingerprint", "next_text", "next_print")

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches):
            yield pa.RecordBatch.from_pydict(_compared(*(c.to_pylist() for c in b.columns)))

    result = names[:7]
    return found.where("edge = 0").select(*result).unionByName(open_.mapInArrow(close, ", ".join(ROWS.split(", ")[:7])))
