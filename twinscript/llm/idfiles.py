"""Token ids of documents in binary files with a minimal perfect hash index per file.

File layout, all numbers little-endian::

    ids of record 0, 1, …            payload, 2 bytes an id if every id of the tokenizer fits, else 4
    hash levels                      bits of the minimal perfect hash, 64 to a word
    ranks                            set bits before each word
    slots                            fingerprint u32, first record u32, records u32, of each key
    records                          first id of each record (u64) and one more for the end
    footer                           64 bytes: magic, id width, counts, places of the parts

The hash works level by level: the keys that share their bit with no other key keep it, all others
go to the next level; a key's slot is the number of set bits before its own.  A foreign key meets a
wrong fingerprint (once in 4 billion it does not).  Files hold ascending ids, so a manifest with
the first and last key of each file, one row per file, leads a key to its file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscript.llm import common
from twinscript.llm.tokens import Encoder
from twinscript.session import cut_lineage, scratch

MAGIC = b"TSIDSv1\0"
FOOTER = struct.Struct("<8sIIQQQQQI4x")
GAMMA = 1.5
#: The key of records without a document id; smaller than any other, as nulls come first.
NO_KEY = -(1 << 63)
MANIFEST = "shard int, path string, n_docs bigint, n_tokens bigint, first_key bigint, last_key bigint"


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, built and asked for whole arrays."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum((sizes + 63) // 64)]).astype(np.int64)
        ones = np.bitwise_count(words).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(ones)])[:-1]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left, level = [], [], keys.astype(np.uint64), 0
        while len(left):
            size = max(64, int(GAMMA * len(left)))
            at = common.mix(left, level) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            bits = np.zeros((size + 63) // 64 * 64, dtype=np.uint8)
            bits[:size] = alone
            parts.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            left, level = left[~alone[at.astype(np.int64)]], level + 1
        return cls(np.array(sizes, dtype=np.int64), np.concatenate([*parts, np.zeros(0, "<u8")]))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for a key that is seen to be none of the index's."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = common.mix(keys[open_].astype(np.uint64), level) % np.uint64(size)
            word = self.starts[level] + (at >> np.uint64(6)).astype(np.int64)
            bit = at & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.ranks[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (common.mix(keys.astype(np.uint64), 977) >> np.uint64(32)).astype("<u4")


def file_parts(records: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> Iterator[bytes]:
    """Bytes of one file from groups of (keys, ids, bounds of each record), keys ascending."""
    all_keys, all_sizes, at = [], [], 0
    for keys, ids, bounds in records:
        raw = ids.astype(f"<u{width}").tobytes()
        at += len(raw)
        yield raw
        all_keys.append(keys)
        all_sizes.append(np.diff(bounds))
    keys = np.concatenate([*all_keys, np.zeros(0, np.int64)])
    first = np.concatenate([[0], np.cumsum(np.concatenate([*all_sizes, np.zeros(0, np.int64)]))]).astype("<u8")
    distinct, begin, count = np.unique(keys, return_index=True, return_counts=True)
    hashed = PerfectHash.build(distinct)
    slot = hashed.slots(distinct)
    slots = np.zeros(len(distinct), dtype=[("print", "<u4"), ("first", "<u4"), ("n", "<u4")])
    slots["print"][slot], slots["first"][slot], slots["n"][slot] = _fingerprint(distinct), begin, count
    pad = b"\0" * (-at % 8)
    levels = hashed.sizes.astype("<u8").tobytes()
    yield pad + levels
    places = [at + len(pad)]
    for part in (hashed.words.astype("<u8").tobytes(), first.tobytes(), slots.tobytes()):
        places.append(places[-1] + (len(levels) if len(places) == 1 else size))
        size = len(part)
        yield part
    yield FOOTER.pack(MAGIC, width, len(hashed.sizes), len(keys), len(distinct), *places[:3], places[3] - places[0])


class IdFile:
    """Keyed access to one file: the index is kept in memory, payloads are read where asked for."""

    def __init__(self, path: str):
        self.file = common.read_file(path)
        size = self.file.size()
        magic, self.width, levels, n_records, n_keys, at, words, first, slots = FOOTER.unpack(
            self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        index = self.file.read_at(size - FOOTER.size - at, at)
        sizes = np.frombuffer(index, "<u8", levels).astype(np.int64)
        self.hash = PerfectHash(sizes, np.frombuffer(index, "<u8", (first - words) // 8, words - at))
        self.first = np.frombuffer(index, "<u8", n_records + 1, first - at).astype(np.int64)
        self.slots = np.frombuffer(index, [("print", "<u4"), ("first", "<u4"), ("n", "<u4")], n_keys, slots)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; 0 records for a key that is not there."""
        slot = self.hash.slots(keys)
        hit = self.slots[np.maximum(slot, 0)] if len(self.slots) else np.zeros(len(keys), self.slots.dtype)
        known = (slot >= 0) & (hit["print"] == _fingerprint(keys))
        return hit["first"].astype(np.int64), np.where(known, hit["n"], 0).astype(np.int64)

    def ids(self, record: int) -> np.ndarray:
        start, stop = int(self.first[record]), int(self.first[record + 1])
        return np.frombuffer(self.file.read_at((stop - start) * self.width, start * self.width), f"<u{self.width}")


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Write the ids of all documents below ``folder`` in ascending ``doc_id`` order, one file per
    task, and return the manifest: a row per file.

    Documents are dealt out by ranges of ``(doc_id, hash of the text)``, so many rows of one id
    still spread over files.  A missing id comes first, a missing text is empty; rows of one id keep
    the order of their texts' hashes; further columns are left out.  An empty table gives no file.
    """
    width = 2 if Encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    rows = common.texts(docs).withColumn("_tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(tokenizer)
        seen = {"docs": 0, "tokens": 0, "first": None, "last": None}

        def records():
            for b in common.pieces(batches):
                keys = b.column(0).fill_null(NO_KEY).to_numpy()
                ids, bounds = encoder.encode(b.column(1))
                ids = np.insert(ids, bounds[1:], end_id)
                seen["first"] = int(keys[0]) if seen["first"] is None else seen["first"]
                seen["last"] = int(keys[-1])
                seen["docs"] += len(keys)
                seen["tokens"] += len(ids)
                yield keys, ids, bounds + np.arange(len(bounds))

        parts = file_parts(records(), width)
        head = next(parts)
        if seen["docs"]:
            number = common.partition_id()
            path = common.write_file(folder, f"shard-{number:06d}.ids", _chain(head, parts))
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([number], pa.int32()), "path": [path], "n_docs": [seen["docs"]],
                 "n_tokens": [seen["tokens"]], "first_key": [seen["first"]], "last_key": [seen["last"]]})

    return cut_lineage(dealt.select("doc_id", "text").mapInArrow(shard, MANIFEST))


def _chain(head: bytes, rest: Iterable[bytes]) -> Iterator[bytes]:
    yield head
    yield from rest


def lookup(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every record of the ``doc_id`` values in ``keys``: shard, record, doc_id, ids before it, its
    number of ids and the checksum of its ids as unsigned 32-bit integers.

    A key may lie in several files if they end and begin with it.  Unknown keys give no row.
    """
    before = F.coalesce(F.sum("n_tokens").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per file: all keys of a file go to the task that opens it
    files = sorted(manifest.select("shard", "path", "first_key", "last_key", before.alias("b")).collect())
    first = np.array([f[2] for f in files], dtype=np.int64)
    last = np.array([f[3] for f in files], dtype=np.int64)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).fill_null(NO_KEY).to_numpy()
            lo = np.searchsorted(last, key, side="left")
            n = np.maximum(np.searchsorted(first, key, side="right") - lo, 0)
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_pydict({"file": pa.array(at, pa.int64()), "key": pa.array(np.repeat(key, n))})

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, at = None, -1
        for b in batches:
            where, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(where, prepend=-1, append=-1)) if len(where) else []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if at != where[i]:
                    at, opened = int(where[i]), IdFile(files[int(where[i])][1])
                record, n = opened.find(keys[i:j])
                rows = np.repeat(record, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                key = np.repeat(keys[i:j], n)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(key, pa.int64(), mask=key == NO_KEY),
                    "start": pa.array(opened.first[rows] + files[at][4], pa.int64()),
                    "n_tokens": pa.array(opened.first[rows + 1] - opened.first[rows], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(opened.ids(r).astype("<u4").tobytes()) for r in rows], pa.int64())})

    routed = keys.select(F.col("doc_id").cast("bigint")).distinct().mapInArrow(route, "file bigint, key bigint")
    return (routed.repartition(common.tasks(keys.sparkSession), "file").sortWithinPartitions("file", "key")
            .mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def write_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents, then read each of them back by its key."""
    manifest = write(docs, tokenizer, scratch(spark, "ids"))
    return lookup(docs, manifest)
