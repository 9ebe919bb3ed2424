"""An n-gram language model in a trie of Elias-Fano coded levels, trained and asked in shards.

**Model.**  Words are runs of anything but ASCII white space, in lower case A-Z; each text ends with an end token.

* ``P(w) = (1 - u) c(w) / N`` for words of the training texts, ``u`` for all others together, where ``u`` is the
  share of words seen once (Good and Turing), so known words and "unknown" sum to one;
* ``P(w | v) = max(c(v w) - D, 0) / c(v) + r(v) P(w)`` and likewise for three words, ``r`` being what the
  discounts leave over; n-grams below ``least`` occurrences count as not seen, as is usual for longer ones.

**Storage.**  Words are numbered in the order of their 64-bit hashes; a file per range of hashes keeps these (Elias-Fano) and
exact counts.  Pairs and triples lie in shards by the hash of the pair.  A shard is a trie: first words, monotone pointers to
their successors, the successors, pointers on to third words, and these.  Successors of one node are ascending; adding up the
ends of the nodes before makes the whole level monotone.  A question goes from a node to its range and searches the successor
there, relative to its context.  Probabilities are kept as ``round(-4096 log10 p)`` in 16 bits.

**Training.**  Tasks count words, then pairs and triples, of their own texts first; what they found goes to the shards packed, a piece per task and shard.
No task sees all of a level: a frequent word's successors lie in all shards.  **Scoring** maps the shards' files into
memory and reads the pages it needs; texts are not shuffled.  On a store that cannot be mapped, a worker takes its own copy.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.llm import common
from twinscript.llm.eliasfano import EliasFano
from twinscript.session import cut_lineage, scratch

U64 = np.uint64
#: The hash of the end token; no word's, as words' hashes are odd.
END = 0
STEPS = 4096
NONE = 65535
DISCOUNT = 0.75
#: Ids counted at once by a task.
CHUNK = 1_000_000
HEAD = struct.Struct("<QQQQ")


class Words:
    """Hashes of the words of texts, each text followed by the end token."""

    @staticmethod
    def of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes (signed), the place of each token's hash among them, and the bounds of the texts."""
        cut = pc.ascii_split_whitespace(pc.ascii_lower(common.compact(column)))
        words = cut.flatten().dictionary_encode()
        names = common.compact(words.dictionary)
        ends = np.frombuffer(names.buffers()[1], np.int64)[:len(names) + 1].tolist()
        data, digest = memoryview(names.buffers()[2] or b""), xxhash.xxh3_64_intdigest
        h = np.fromiter((digest(data[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)), dtype=U64, count=len(names)) | U64(1)
        at = words.indices.to_numpy().astype(np.int64)
        sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        # what a splitter gives before leading and after trailing white space
        none = np.flatnonzero(np.diff(ends) == 0)
        if len(none):
            keep = at != none[0]
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
            at = at[keep]
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)
        tokens = np.full(bounds[-1], len(names), dtype=np.int64)
        inside = np.ones(len(tokens), dtype=bool)
        inside[bounds[1:] - 1] = False
        tokens[inside] = at
        distinct, place = np.unique(np.append(h, U64(END)).view(np.int64), return_inverse=True)
        return distinct, place[tokens], bounds


def shard_of_hash(h: np.ndarray, shards: int) -> np.ndarray:
    """The range a signed 64-bit hash lies in."""
    return np.minimum(np.floor((h.astype(np.float64) / 2.0 ** 64 + 0.5) * shards).astype(np.int64), shards - 1)


def shard_of_pair(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (common.mix(pairs, 5) % U64(shards)).astype(np.int64)


def quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(-np.log10(np.maximum(p, 1e-300)) * STEPS), 0, NONE - 1), NONE).astype("<u2")


def probability(q: np.ndarray) -> np.ndarray:
    return np.where(q == NONE, 0.0, 10.0 ** (q.astype(np.float64) / -STEPS))


class WordFile:
    """Hashes and counts of one range, numbered from ``base``."""

    @staticmethod
    def parts(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
        low = int(hashes[0]) if len(hashes) else 0
        offset = hashes.view(U64) - np.array([low], np.int64).view(U64)
        return [struct.pack("<qQ", low, len(hashes)), EliasFano.build(offset).dump(), counts.astype("<u8").tobytes()]

    def __init__(self, path: str):
        data = common.mapped(path)
        self.low, n = struct.unpack_from("<qQ", data, 0)
        self.hashes, at = EliasFano.load(data, 16)
        self.counts = np.frombuffer(data, "<u8", n, at)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number within the file, -1 if it is not there."""
        out = np.full(len(h), -1, dtype=np.int64)
        ok = h >= self.low
        out[ok] = self.hashes.find(h[ok].view(U64) - np.array([self.low], np.int64).view(U64))
        return out


def _level(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending values of each range made ascending over all ranges."""
    ends = np.append(starts[1:], len(values))
    last = np.where(ends > starts, values[np.maximum(ends, 1) - 1] + U64(1), U64(0)) if len(values) else np.zeros(len(starts), U64)
    offset = np.cumsum(last, dtype=U64) - last
    return values + np.repeat(offset, ends - starts)


class TrieFile:
    """First words, their successors, and the successors' successors of one shard."""

    @staticmethod
    def parts(pairs: np.ndarray, p2: np.ndarray, rest: np.ndarray, owner: np.ndarray, third: np.ndarray, p3: np.ndarray) -> list[bytes]:
        first = (pairs >> U64(32)).astype(np.int64)
        roots, starts = np.unique(first, return_index=True)
        children = np.searchsorted(owner, np.arange(len(pairs) + 1))
        seconds = _level(pairs & U64(0xFFFFFFFF), starts)
        thirds = _level(third.astype(U64), children[:-1])
        levels = [EliasFano.build(roots), EliasFano.build(np.append(starts, len(pairs))), EliasFano.build(seconds),
                  EliasFano.build(children), EliasFano.build(thirds)]
        out = [HEAD.pack(len(roots), len(pairs), len(third), 0)] + [e.dump() for e in levels]
        return out + [np.append(a, np.zeros(-len(a) % 4, "<u2")).astype("<u2").tobytes() for a in (quantised(p2), quantised(rest), quantised(p3))]

    def __init__(self, path: str):
        data = common.mapped(path)
        self.n1, self.n2, self.n3, _ = HEAD.unpack_from(data, 0)
        at, found = HEAD.size, []
        for _ in range(5):
            e, at = EliasFano.load(data, at)
            found.append(e)
        self.roots, self.to2, self.level2, self.to3, self.level3 = found
        out = []
        for n in (self.n2, self.n2, self.n3):
            out.append(np.frombuffer(data, "<u2", n, at))
            at += 2 * (n + -n % 4)
        self.p2, self.rest, self.p3 = out

    @staticmethod
    def _successor(pointers: EliasFano, level: EliasFano, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of a word among the successors of a node (-1: no node), -1 if it is none; questions come ordered by node."""
        out = np.full(len(node), -1, dtype=np.int64)
        known = np.flatnonzero(node >= 0)
        if not len(known):
            return out
        # a node's range is looked up once
        new = np.diff(node[known], prepend=-1) != 0
        of, once = np.cumsum(new) - 1, node[known][new]
        start, end = (pointers.get(once + i).astype(np.int64) for i in (0, 1))
        offset = np.where(start > 0, level.get(np.maximum(start - 1, 0)) + U64(1), U64(0)) if level.n else np.zeros(len(start), U64)
        full = (end > start)[of]
        known, of = known[full], of[full]
        at = level.find(offset[of] + word[known].astype(U64))
        out[known] = np.where((at >= start[of]) & (at < end[of]), at, -1)
        return out

    def pair(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Places of pairs, which come ordered by their first words."""
        new = np.diff(first, prepend=-1) != 0
        root = self.roots.find(first[new])[np.cumsum(new) - 1]
        return self._successor(self.to2, self.level2, root, second)

    def triple(self, node: np.ndarray, third: np.ndarray) -> np.ndarray:
        """Places of third words below pairs, which come ordered by the pairs' places."""
        return self._successor(self.to3, self.level3, node, third)


class Model:
    """Paths and totals of a trained model; files are opened where they are asked for."""

    def __init__(self, word_paths: list[str | None], bases: list[int], rest_paths: list[str | None], trie_paths: list[str | None],
                 n_tokens: int, n_words: int, n_once: int):
        self.word_paths, self.bases, self.rest_paths, self.trie_paths = word_paths, bases, rest_paths, trie_paths
        self.n_tokens, self.n_words = n_tokens, n_words
        self.unknown = n_once / n_tokens if 0 < n_once < n_tokens else 0.5 / (n_tokens + 0.5)
        self._open: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _file(self, kind, path: str):
        if path not in self._open:
            self._open[path] = kind(path)
        return self._open[path]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and training count of sorted distinct hashes."""
        out, counts = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        shard = shard_of_hash(hashes, len(self.word_paths))
        for s in np.unique(shard):
            if self.word_paths[s] is None:
                continue
            f, here = self._file(WordFile, self.word_paths[s]), np.flatnonzero(shard == s)
            at = f.find(hashes[here])
            ok = at >= 0
            out[here[ok]], counts[here[ok]] = at[ok] + self.bases[s], f.counts[at[ok]]
        return out, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), dtype=np.int64)
        shard = np.searchsorted(self.bases, ids, side="right") - 1
        for s in np.unique(shard):
            f = self._file(WordFile, self.word_paths[s])
            here = shard == s
            out[here] = f.counts[ids[here] - self.bases[s]]
        return out

    def rest_of(self, ids: np.ndarray) -> np.ndarray:
        """What a word leaves over for unseen successors; 1 for an unknown word."""
        out = np.ones(len(ids))
        known = np.flatnonzero(ids >= 0)
        shard = np.searchsorted(self.bases, ids[known], side="right") - 1
        for s in np.unique(shard):
            if self.rest_paths[s] is not None:
                q = self._file(_rests, self.rest_paths[s])
                here = known[shard == s]
                out[here] = probability(q[ids[here] - self.bases[s]])
        return out

    def _in_shards(self, shard: np.ndarray) -> Iterator[tuple[TrieFile, np.ndarray]]:
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            path = self.trie_paths[shard[order[a]]]
            if path is not None:
                yield self._file(TrieFile, path), order[a:z]

    def log10(self, ids: np.ndarray, counts: np.ndarray, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 probability of each token, from the numbers and counts of the distinct words."""
        p1 = np.where(ids >= 0, (1 - self.unknown) * counts / max(1, self.n_tokens), self.unknown)
        p = p1[tokens]
        word = ids[tokens]
        before = np.full(len(word), -1, dtype=np.int64)
        before[1:] = word[:-1]
        before[bounds[:-1]] = -1
        at = np.flatnonzero((before >= 0) & (word >= 0))
        rest = self.rest_of(ids)[tokens]
        follows = np.ones(len(word), dtype=bool)
        follows[bounds[:-1]] = False
        previous = np.ones(len(word))
        previous[1:] = rest[:-1]
        p = np.where(follows, previous * p, p)
        key, place = np.unique(before[at].astype(U64) << U64(32) | word[at].astype(U64), return_inverse=True)
        shard = shard_of_pair(key, len(self.trie_paths))
        node, alpha, left = np.full(len(key), -1, dtype=np.int64), np.zeros(len(key)), np.ones(len(key))
        for f, here in self._in_shards(shard):
            n = f.pair((key[here] >> U64(32)).astype(np.int64), (key[here] & U64(0xFFFFFFFF)).astype(np.int64))
            ok = n >= 0
            node[here] = n
            alpha[here[ok]], left[here[ok]] = probability(f.p2[n[ok]]), probability(f.rest[n[ok]])
        p[at] += alpha[place]
        # the pair that ends before each token, by its place among the distinct ones
        pair = np.full(len(word), -1, dtype=np.int64)
        pair[at] = place
        context = np.full(len(word), -1, dtype=np.int64)
        context[1:] = pair[:-1]
        context[bounds[:-1]] = -1
        at3 = np.flatnonzero(context >= 0)
        p[at3] *= left[context[at3]]
        at3 = at3[(node[context[at3]] >= 0) & (left[context[at3]] < 1) & (word[at3] >= 0)]
        key3, place3 = np.unique(context[at3].astype(U64) << U64(32) | word[at3].astype(U64), return_inverse=True)
        of, third = (key3 >> U64(32)).astype(np.int64), (key3 & U64(0xFFFFFFFF)).astype(np.int64)
        alpha3 = np.zeros(len(key3))
        for f, here in self._in_shards(shard[of]):
            n = f.triple(node[of[here]], third[here])
            ok = n >= 0
            alpha3[here[ok]] = probability(f.p3[n[ok]])
        p[at3] += alpha3[place3]
        return np.log10(np.minimum(p, 1.0))


def _rests(path: str) -> np.ndarray:
    return np.frombuffer(common.mapped(path), "<u2")


def _grouped(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts, and the place of each key among them."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64), place


def pack_counts(pairs: np.ndarray, n2: np.ndarray, owner: np.ndarray, third: np.ndarray, n3: np.ndarray) -> bytes:
    """Sorted pairs with counts, and triples as (place of their pair, third word, count), compressed."""
    first = (pairs >> U64(32)).astype(np.uint32)
    raw = b"".join((HEAD.pack(len(pairs), len(third), 0, 0), np.diff(first, prepend=np.uint32(0)).tobytes(),
                    (pairs & U64(0xFFFFFFFF)).astype("<u4").tobytes(), n2.astype("<u4").tobytes(),
                    np.diff(owner.astype(np.uint32), prepend=np.uint32(0)).tobytes(), third.astype("<u4").tobytes(), n3.astype("<u4").tobytes()))
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack_counts(blob: bytes) -> tuple[np.ndarray, ...]:
    size, = struct.unpack_from("<Q", blob, 0)
    raw = pa.Codec("zstd").decompress(blob[8:], size, asbytes=True)
    a, b, _, _ = HEAD.unpack_from(raw, 0)
    at, out = HEAD.size, []
    for n in (a, a, a, b, b, b):
        out.append(np.frombuffer(raw, "<u4", n, at))
        at += 4 * n
    first, second, n2, owner, third, n3 = out
    pairs = np.cumsum(first, dtype=np.uint32).astype(U64) << U64(32) | second.astype(U64)
    return pairs, n2, np.cumsum(owner, dtype=np.uint32).astype(np.int64), third, n3


def train_words(docs: DataFrame, folder: str, shards: int) -> tuple[list, list, int, int, int]:
    """Files of words by range of their hashes; paths, first numbers, tokens, words and words seen once."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in common.pieces(batches):
            h, tokens, _ = words.of(b.column(0))
            n = np.bincount(tokens, minlength=len(h))
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 0]), pa.array(n[n > 0], pa.int64())], names=["h", "c"])

    counted = docs.select("text").mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    shard = F.least(F.floor((F.col("h").cast("double") / F.lit(2.0 ** 64) + 0.5) * shards), F.lit(shards - 1)).cast("int")

    def store(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        by = np.argsort(table["h"].to_numpy(), kind="stable")
        h, c = table["h"].to_numpy()[by], table["c"].to_numpy()[by]
        path = common.write_file(folder, f"words-{s:06d}", WordFile.parts(h, c))
        return pa.table({"shard": pa.array([s], pa.int32()), "path": [path], "n": [len(h)], "tokens": [int(c.sum())], "once": [int((c == 1).sum())]})

    rows = counted.withColumn("shard", shard).groupBy("shard").applyInArrow(
        store, "shard int, path string, n bigint, tokens bigint, once bigint").collect()  # a row per shard
    by = {r.shard: r for r in rows}
    sizes = [by[s].n if s in by else 0 for s in range(shards)]
    bases = [sum(sizes[:s]) for s in range(shards)]
    return ([by[s].path if s in by else None for s in range(shards)], bases, sum(r.tokens for r in rows), sum(sizes), sum(r.once for r in rows))


def train(docs: DataFrame, spark: SparkSession, shards: int | None = None, least: tuple[int, int] = (2, 2), discount: float = DISCOUNT) -> Model:
    """A model of the texts of ``docs``; ``least`` are the smallest counts of pairs and triples kept."""
    shards = shards or common.tasks(spark)
    folder = scratch(spark, "ngrams")
    model = Model(*(lambda w: (w[0], w[1], [None] * shards, [None] * shards, *w[2:]))(train_words(docs, folder, shards)))
    shared = spark.sparkContext.broadcast(model)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, m = Words(), shared.value
        pending: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            # texts are told apart by -1, which no pair or triple holds
            w = np.concatenate(pending)
            two = np.flatnonzero((w[:-1] >= 0) & (w[1:] >= 0))
            pairs, place = np.unique(w[two].astype(U64) << U64(32) | w[two + 1].astype(U64), return_inverse=True)
            n2 = np.bincount(place, minlength=len(pairs))
            of = np.full(len(w), -1, dtype=np.int64)
            of[two] = place
            three = np.flatnonzero((of[:-2] >= 0) & (w[2:] >= 0)) if len(w) > 2 else np.zeros(0, np.int64)
            triples, n3 = np.unique(of[three].astype(U64) << U64(32) | w[three + 2].astype(U64), return_counts=True)
            owner = (triples >> U64(32)).astype(np.int64)
            third = triples & U64(0xFFFFFFFF)
            # sorted by shard, pairs and triples of one shard lie side by side, still ascending
            shard = shard_of_pair(pairs, shards)
            by2, by3 = np.argsort(shard, kind="stable"), np.argsort(shard[owner], kind="stable")
            cut2, cut3 = (np.searchsorted(x, np.arange(shards + 1)) for x in (shard[by2], shard[owner][by3]))
            rank = np.empty(len(pairs), dtype=np.int64)
            rank[by2] = np.arange(len(pairs)) - np.repeat(cut2[:-1], np.diff(cut2))
            pairs, n2, owner, third, n3 = pairs[by2], n2[by2], rank[owner][by3], third[by3], n3[by3]
            out = []
            for s in range(shards):
                a, z, c, d = cut2[s], cut2[s + 1], cut3[s], cut3[s + 1]
                if z > a:
                    out.append((s, pack_counts(pairs[a:z], n2[a:z], owner[c:d], third[c:d], n3[c:d])))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["shard", "counts"])

        for b in common.pieces(batches, limit=4 << 20):
            h, tokens, bounds = words.of(b.column(0))
            ids = m.ids(h)[0][tokens]
            pending.append(np.insert(ids, bounds[1:], -1))
            size += len(ids)
            if size >= CHUNK:
                yield flush()
                pending, size = [], 0
        if size:
            yield flush()

    def store(table: pa.Table) -> pa.Table:
        m = shared.value
        s = table["shard"][0].as_py()
        found = [unpack_counts(x) for x in table["counts"].to_pylist()]
        pairs, n2, place = _grouped(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        start = np.cumsum([0] + [len(f[0]) for f in found])
        owner = place[np.concatenate([f[2] + a for f, a in zip(found, start[:-1], strict=True)])]
        triples, n3, _ = _grouped(owner.astype(U64) << U64(32) | np.concatenate([f[3] for f in found]).astype(U64), np.concatenate([f[4] for f in found]))
        del found
        kept = n2 >= least[0]
        rank = np.cumsum(kept) - 1
        owner = (triples >> U64(32)).astype(np.int64)
        t = (n3 >= least[1]) & kept[owner]
        owner, third, n3 = rank[owner[t]], (triples[t] & U64(0xFFFFFFFF)), n3[t]
        pairs, n2 = pairs[kept], n2[kept]
        first = (pairs >> U64(32)).astype(np.int64)
        p2 = (n2 - discount) / np.maximum(1, m.counts_of(first)) if len(first) else np.zeros(0)
        p3 = (n3 - discount) / n2[owner] if len(owner) else np.zeros(0)
        rest = 1 - np.bincount(owner, weights=p3, minlength=len(pairs))
        common.write_file(folder, f"trie-{s:06d}", TrieFile.parts(pairs, p2, np.maximum(rest, 1e-9), owner, third, p3))
        roots, at = np.unique(first, return_inverse=True)
        taken = np.bincount(at, weights=p2, minlength=len(roots))
        return pa.table({"shard": pa.array([s] * (len(roots) + 1), pa.int32()), "word": pa.array(np.append(roots, -1), pa.int64()),
                         "taken": pa.array(np.append(taken, 0.0), pa.float64())})

    counted = docs.select("text").mapInArrow(count, "shard int, counts binary")
    taken = cut_lineage(counted.groupBy("shard").applyInArrow(store, "shard int, word bigint, taken double"))
    # the row with word -1 tells that the shard has a file
    tries = {r.shard for r in taken.where("word < 0").select("shard").collect()}
    bases = list(model.bases)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.searchsorted(bases, b.column(0).to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), b.column(0), b.column(1)], names=["file", "word", "taken"])

    def rests(table: pa.Table) -> pa.Table:
        m = shared.value
        s = table["file"][0].as_py()
        n = len(m._file(WordFile, m.word_paths[s]).counts)
        sums = np.bincount(table["word"].to_numpy() - m.bases[s], weights=table["taken"].to_numpy(), minlength=n)
        path = common.write_file(folder, f"rest-{s:06d}", [quantised(np.maximum(1 - sums, 1e-9)).tobytes()])
        return pa.table({"file": pa.array([s], pa.int32()), "path": [path]})

    by_word = taken.where("word >= 0").groupBy("word").agg(F.sum("taken").alias("taken")).mapInArrow(place, "file int, word bigint, taken double")
    rest_paths = dict(by_word.groupBy("file").applyInArrow(rests, "file int, path string").collect())  # a row per file
    return Model(model.word_paths, model.bases, [rest_paths.get(s) for s in range(shards)],
                 [f"{folder}/trie-{s:06d}" if s in tries else None for s in range(shards)],
                 model.n_tokens, model.n_words, round(model.unknown * model.n_tokens) if 0 < model.unknown else 0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and, of each text, tokens, known tokens, the base model's and the model's log10 probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, m = Words(), shared.value
        for b in common.pieces(batches, limit=3 << 20):
            h, tokens, bounds = words.of(b.column(1))
            ids, counts = m.ids(h)
            base = np.log10((counts + 0.5) / (m.n_tokens + 0.5 * (m.n_words + 1)))
            own = np.add.reduceat(m.log10(ids, counts, tokens, bounds), bounds[:-1])
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(np.add.reduceat((ids[tokens] >= 0).astype(np.int64), bounds[:-1])),
                pa.array(np.add.reduceat(base[tokens], bounds[:-1])), pa.array(own)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return common.texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
