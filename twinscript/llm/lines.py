"""Lines that stand in many documents, found through Bloom filters of the lines seen once and twice.

A line's key is the line without white space at its ends, in small letters.  Each task sends the 64-bit hashes of its keys, a
key once for many documents, to shards by ranges of hashes.  A shard holds two Bloom filters: a hash that the first one knows already
goes into the second, and the first takes every hash.  The number of shards follows the number of lines, so no
filter grows.  The second filters, as large as the repeated hashes need, are written to the shared folder.

Tasks then ask these for each of their lines, and only suspected repeats are shuffled, with their places, a row for each key and batch.
Their keys are compared as text and their documents counted, so a filter's false alarm costs a row
and changes nothing.  A text is shuffled once, to meet the numbers of its dropped lines.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscript.llm import common
from twinscript.session import cut_lineage, scratch

U64 = np.uint64
SPACE = " \t\n\x0b\x0c\r"
PER_SHARD = 1 << 19
PER_FLUSH = 1 << 20
BITS, PROBES = 16, 6
SUSPECT = "key string, n bigint, first struct<doc_id: bigint, row: bigint, line: int>, at array<struct<row: bigint, line: int>>"


class Bloom:
    """A filter for about ``n`` hashes; it never denies one that it was given."""

    def __init__(self, n: int, bits: np.ndarray | None = None):
        self.size = 1 << max(6, math.ceil(math.log2(max(1, n) * BITS)))
        self.bits = np.zeros(self.size, dtype=bool) if bits is None else bits

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        mixed = common.mix(hashes, 5)
        step, mask = (mixed >> U64(32)) | U64(1), U64(self.size - 1)
        for probe in range(PROBES):
            yield (mixed + U64(probe) * step) & mask

    def add(self, hashes: np.ndarray) -> None:
        for at in self._places(hashes):
            self.bits[at] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for at in self._places(hashes):
            out &= self.bits[at]
        return out

    def packed(self) -> bytes:
        return np.packbits(self.bits, bitorder="little").tobytes()


class PackedBloom(Bloom):
    """A written filter, asked where it lies."""

    def __init__(self, raw: pa.Buffer):
        self.bits = np.frombuffer(raw, dtype=np.uint8)
        self.size = len(self.bits) * 8

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for at in self._places(hashes):
            out &= (self.bits[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
        return out


class Lines:
    """The keys of a batch of texts: ``keys`` (distinct), and of every line with a key its text, number in the text, and key."""

    def __init__(self, texts: pa.Array, min_chars: int):
        cut = pc.split_pattern(common.compact(texts), "\n")
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        keys = pc.ascii_lower(pc.ascii_trim(cut.flatten(), characters=SPACE))
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        line = np.arange(len(keys)) - np.repeat(bounds[:-1], np.diff(bounds))
        counted = pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False)
        coded = keys.filter(pa.array(counted)).dictionary_encode()
        self.keys = coded.dictionary
        self.text, self.line, self.key = text[counted], line[counted], coded.indices.to_numpy()
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.keys.to_pylist()), dtype=U64, count=len(self.keys))

    def texts_per_key(self) -> np.ndarray:
        pairs = np.unique(self.key.astype(np.int64) * (int(self.text.max(initial=0)) + 1) + self.text)
        return np.bincount(pairs // (int(self.text.max(initial=0)) + 1), minlength=len(self.keys))


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def seen_twice(texts: DataFrame, folder: str, shards: int, min_chars: int) -> list[str | None]:
    """The file of the second filter of each shard, none for a shard without hashes."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            # the last bit of a hash tells whether several documents have it
            marked = np.sort(np.concatenate(held))
            held.clear()
            alone, first, n = np.unique(marked >> U64(1), return_index=True, return_counts=True)
            more = (n > 1) | (marked[np.minimum(first + n - 1, len(marked) - 1)] & U64(1) == 1)
            out = alone << U64(1) | more.astype(U64)
            where = _shard(out, shards)
            starts = np.flatnonzero(np.diff(where, prepend=-1))
            parts = np.split(out, starts[1:])
            return pa.RecordBatch.from_pydict({
                "shard": pa.array(where[starts], pa.int32()), "hashes": pa.array([p.tobytes() for p in parts], pa.binary())})

        for b in common.pieces(batches):
            lines = Lines(b.column(0), min_chars)
            if len(lines.keys):
                held.append(lines.hashes & ~U64(1) | (lines.texts_per_key() > 1).astype(U64))
            if sum(map(len, held)) >= PER_FLUSH:
                yield flush()
        if held:
            yield flush()

    def filters(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_buffer(), dtype=U64) for x in rows.column("hashes").combine_chunks()]
        once, repeated = Bloom(sum(map(len, blobs))), []
        for blob in blobs:
            hashes = blob >> U64(1)
            repeated.append(hashes[once.has(hashes) | (blob & U64(1) == 1)])
            once.add(hashes)
        again = np.unique(np.concatenate(repeated))
        twice = Bloom(len(again))
        twice.add(again)
        path = common.write_file(folder, f"twice-{key[0].as_py():06d}.bloom", [twice.packed()])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "path": [path]})

    sent = texts.select("text").mapInArrow(send, "shard int, hashes binary")
    written = sent.groupBy("shard").applyInArrow(filters, "shard int, path string")
    paths: list[str | None] = [None] * shards
    for shard, path in written.collect():  # a row per file
        paths[shard] = path
    return paths


def suspects(rows: DataFrame, paths: list[str | None], min_chars: int) -> DataFrame:
    """``key, n, first, at`` of all lines of ``row, doc_id, text`` that the second filters know: for each batch and key the
    number of documents, the first place and all places."""
    shards = len(paths)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {shard: PackedBloom(common.mapped(path)) for shard, path in enumerate(paths) if path is not None}
        for b in common.pieces(batches):
            lines = Lines(b.column(2), min_chars)
            where, known = _shard(lines.hashes, shards), np.zeros(len(lines.keys), dtype=bool)
            for shard in np.unique(where):
                if shard in opened:
                    here = np.flatnonzero(where == shard)
                    known[here] = opened[shard].has(lines.hashes[here] >> U64(1))
            if not known.any():
                continue
            numbers, n = b.column(0).to_numpy(), lines.texts_per_key()
            ids = b.column(1).fill_null(-(1 << 63)).to_numpy()
            chosen = np.flatnonzero(known[lines.key])
            text, line, key = lines.text[chosen], lines.line[chosen], lines.key[chosen]
            order = np.lexsort((line, numbers[text], ids[text], key))
            text, line, key = text[order], line[order], key[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            places = pa.StructArray.from_arrays([pa.array(numbers[text]), pa.array(line, pa.int32())], ["row", "line"])
            head = text[starts]
            yield pa.RecordBatch.from_pydict({
                "key": lines.keys.take(pa.array(key[starts])).cast(pa.string()), "n": pa.array(n[key[starts]], pa.int64()),
                "first": pa.StructArray.from_arrays([b.column(1).take(pa.array(head)), pa.array(numbers[head]), pa.array(line[starts], pa.int32())],
                                                    ["doc_id", "row", "line"]),
                "at": pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), places)})

    return rows.select("row", "doc_id", "text").mapInArrow(ask, SUSPECT)


def without_repeated_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep_first: bool = True) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of all documents, without the lines whose key stands in ``min_docs`` (two at least) documents or more.

    Keys of fewer than ``min_chars`` code points always stay.  With ``keep_first`` the first such line stays: that of the smallest
    ``doc_id`` (a missing one before all others; of rows with the same id, the one read first), the first in its text.
    A missing text is an empty line; repeated rows are documents of their own; further columns are left out.
    """
    if min_docs < 2:
        raise ValueError("min_docs is two at least")
    spark = docs.sparkSession
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = cut_lineage(common.texts(docs).withColumn("row", F.monotonically_increasing_id()).withColumn("lines", breaks + 1))
    total = rows.agg(F.sum("lines")).first()[0] or 0
    paths = seen_twice(rows, scratch(spark, "lines"), max(1, math.ceil(total / PER_SHARD)), min_chars)
    found = cut_lineage(suspects(rows, paths, min_chars))
    repeats = found.groupBy("key").agg(F.sum("n").alias("docs"), F.min("first").alias("kept")).where(F.col("docs") >= min_docs)
    places = found.select("key", "at").join(repeats, "key").select("kept", F.explode("at").alias("place"))
    if keep_first:
        places = places.where((F.col("place.row") != F.col("kept.row")) | (F.col("place.line") != F.col("kept.line")))
    dropped = places.groupBy(F.col("place.row").alias("row")).agg(F.collect_list("place.line").alias("drop"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches):
            texts, n = b.column(1).to_pylist(), []
            for i, drop in enumerate(b.column(3).to_pylist()):
                n.append(len(drop or ()))
                if drop:
                    gone = set(drop)
                    texts[i] = "\n".join(line for at, line in enumerate(texts[i].split("\n")) if at not in gone)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": pa.array(texts, pa.string()),
                                              "n_lines": b.column(2), "n_dropped": pa.array(n, pa.int64())})

    return rows.join(dropped, "row", "left").select("doc_id", "text", F.col("lines").cast("bigint").alias("n_lines"), "drop").mapInArrow(
        cut, "doc_id bigint, text string, n_lines bigint, n_dropped bigint")


def digests(docs: DataFrame) -> DataFrame:
    """Each document's lines before, lines dropped, and digest of what stays, lines in ten documents or more losing all their places."""
    return without_repeated_lines(docs, 10, 1, keep_first=False).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def sql() -> str:
    """The same over table ``documents``."""
    return r"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT row_id, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
gone AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT row_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(g.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN gone g USING (k) GROUP BY row_id, doc_id"""
