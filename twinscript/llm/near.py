"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A document is the weighted set of its shingles (``shingle`` words in lower case, without marks at their
ends), a shingle seen ``c`` times weighing ``1 + ln c``.  The similarity of two documents is the probability Jaccard
of these sets, which for equal weights is the Jaccard similarity.  Documents of at least ``threshold``
are linked; classes are the connected components of the links.

1. Equal texts become one node, by two hashes of the text.
2. Each shingle sends arrivals of a Poisson process, its weight the rate, to random registers; a register
   keeps the shingle that came first.  A shingle stops as soon as its next arrival is later than
   the latest register.  Registers of two documents agree with the probability of their similarity.
3. ``rows`` registers make a band; nodes that share a band meet in a bucket.
4. First every node is compared with one other: of its buckets' most connected nodes the one it meets most often.
   That ties nearly every group together without any pair within it.
5. Then only pairs of a bucket that lie in different components are left.  Their registers say
   whether they may reach the threshold; those that may are compared exactly.  Buckets of any size
   are cut into blocks, and a task takes two blocks.

The exact similarity is computed for every link, so a link never rests on an estimate; at the threshold a pair
shares no band with a probability of 0.0005, and is left out by its registers with 0.001.

A missing text is empty.  Texts without any word are alike only if they are equal; texts shorter than a
shingle are one shingle.  Repeated rows fall into one class.  A class is named by its smallest ``doc_id`` (missing
if none of its rows has one).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscript.llm import common
from twinscript.llm.graphs import components
from twinscript.session import cut_lineage

MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„‘’«»…–—¿¡"
BLOCK = 1000
#: Rows of (node, two hashes) that may be sent to all tasks: 24 bytes each.
SENT_ROWS = 200_000
KEPT = 100_000


class Shingles:
    """Shingle hashes of texts."""

    def __init__(self, size: int = 5):
        self.size = size
        self.known: dict[str, int] = {}

    def _word(self, piece: str) -> int:
        word = piece.lower().strip(MARKS)
        return xxhash.xxh3_64_intdigest(word) | 1 if word else 0

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles, and the bounds of each text."""
        cut = pc.ascii_split_whitespace(common.compact(column))
        words = cut.flatten().dictionary_encode()
        pieces = words.dictionary.to_pylist()
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known = {}
            new = pieces
        self.known.update((p, self._word(p)) for p in new)
        h = np.array([self.known[p] for p in pieces], dtype=np.uint64)
        at = h[words.indices.to_numpy()] if len(pieces) else np.zeros(0, np.uint64)
        sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        row, at = row[at != 0], at[at != 0]
        n = np.bincount(row, minlength=len(sizes))
        starts = np.cumsum(n) - n
        # words beyond a short text's end count as none
        k = self.size
        out_n = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        place = np.arange(out_n.sum()) - np.repeat(np.cumsum(out_n) - out_n, out_n)
        owner = np.repeat(np.arange(len(sizes)), out_n)
        first = np.repeat(starts, out_n) + place
        padded = np.concatenate([at, np.zeros(k, np.uint64)])
        left = n[owner] - place
        value = np.zeros(len(first), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                value = common.mix(value ^ np.where(left > i, padded[first + i], np.uint64(0)), i)
        return value, np.concatenate([[0], np.cumsum(out_n)])


def weighted(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their weights, and the texts they belong to."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    by = np.lexsort((values, owner))
    v, o = values[by], owner[by]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(v)))
    return v[at], 1 + np.log(count), o[at]


def prob_min_hash(values: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """``m`` registers for each of ``n`` weighted sets; registers of an empty set are 0."""
    time = np.full(n * m, np.inf)
    kept = np.zeros(n * m, dtype=np.uint64)
    h, w, o = values, weights, owner
    x = np.zeros(len(h))
    arrival = 0
    while len(h):
        u = common.mix(h, arrival)
        x = x - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / w
        register = ((common.mix(u, 1) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64) + o * m
        np.minimum.at(time, register, x)
        won = time[register] == x
        kept[register[won]] = h[won]
        arrival += 1
        # whoever is later than the last register cannot come first any more
        go = x < time.reshape(n, m).max(axis=1)[o]
        h, w, o, x = h[go], w[go], o[go], x[go]
    return kept.reshape(n, m)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over shared elements of 1 / sum over all of the larger of both relative weights; ``a`` and ``b`` are sorted and distinct."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    xa, xb = wa[ia], wb[ib]
    ratio = xa / xb
    by = np.argsort(ratio, kind="stable")
    r, ca, cb = ratio[by], np.cumsum(xa[by]), np.cumsum(xb[by])
    lower = np.searchsorted(r, ratio, side="left")
    below = np.where(lower > 0, cb[np.maximum(lower - 1, 0)], 0.0)
    above = ca[-1] - np.where(lower > 0, ca[np.maximum(lower - 1, 0)], 0.0)
    only_a, only_b = wa.sum() - xa.sum(), wb.sum() - xb.sum()
    return float((1 / ((above + only_a) / xa + (below + only_b) / xb)).sum())


def with_keys(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and two hashes of the text, 128 bits in all."""
    return common.texts(docs).withColumn("a", F.xxhash64("text")).withColumn("b", F.xxhash64(F.lit(1), F.col("text")))


def nodes_of(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """A stored row per distinct text: node, both hashes, first doc_id, rows, bands and one byte of each register."""
    m = bands * rows

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingles(shingle)
        for b in common.pieces(batches, limit=1 << 20, rows=1000):
            value, weight, owner = weighted(*of.of(b.column(1)))
            kept = prob_min_hash(value, weight, owner, b.num_rows, m)
            some = np.zeros(b.num_rows, dtype=bool)
            some[owner] = True
            key = np.zeros((b.num_rows, bands), dtype=np.uint64)
            for i in range(rows):
                key = common.mix(key ^ kept[:, i::rows], i)
            key = common.mix(key ^ np.arange(bands, dtype=np.uint64), rows)
            sketch = (common.mix(kept.ravel(), 31) & np.uint64(255)).astype(np.uint8).reshape(kept.shape)
            n = np.where(some, bands, 0)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0), "a": b.column(2), "b": b.column(3),
                "bands": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()),
                                                  pa.array(key[some].ravel().view(np.int64))),
                "sketch": pa.array([s.tobytes() for s in sketch], pa.binary())})

    signed = with_keys(docs).mapInArrow(sign, "doc_id bigint, a bigint, b bigint, bands array<bigint>, sketch binary")
    grouped = signed.groupBy("a", "b").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    return cut_lineage(grouped.withColumn("node", F.monotonically_increasing_id()))


def buckets_of(nodes: DataFrame) -> DataFrame:
    """Stored rows (key, band, node, n) of the buckets that hold several nodes."""
    rows = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    full = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut_lineage(rows.join(full, "key"))


def leading_pairs(buckets: DataFrame) -> DataFrame:
    """For each node the leader it meets in most buckets; a bucket is led by the node that meets most others."""
    met = buckets.groupBy("node").agg(F.sum("n").alias("met"))
    known = buckets.join(met, "node")
    leaders = known.groupBy("key").agg(F.max(F.struct("met", "node"))["node"].alias("leader"))
    pairs = known.join(leaders, "key").where("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.groupBy("node").agg(F.max(F.struct("shared", "leader"))["leader"].alias("v")).withColumnRenamed("node", "u")


def open_pairs(buckets: DataFrame, nodes: DataFrame, comps: DataFrame, bands: int, rows: int, least: float) -> DataFrame:
    """Pairs of a bucket in different components whose registers agree in a share of ``least`` or more."""
    named = buckets.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"))
    left = named.join(mixed.where("lo <> hi").select("key", "size"), "key")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    # a block meets every other block of its bucket once, and itself
    spread = left.withColumn("blocks", blocks).withColumn("own", own).select(
        "key", "band", "node", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("key", "band", "node", "component", "own", F.least("own", "other").alias("lo"),
                           F.greatest("own", "other").alias("hi")).join(nodes.select("node", "sketch", "bands"), "node")

    def compare(table: pa.Table) -> pa.Table:
        node, comp = table["node"].to_numpy(), table["component"].to_numpy()
        own, band = table["own"].to_numpy(), int(table["band"][0].as_py())
        lo, hi = int(table["lo"][0].as_py()), int(table["hi"][0].as_py())
        s = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(node), bands * rows)
        keys = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), bands)
        us, vs = [], []
        for i in range(len(node)):
            if own[i] != lo:
                continue
            # within a block each pair once; of two blocks, this one's nodes with the other's
            with_ = np.flatnonzero((comp != comp[i]) & ((own == hi) if lo != hi else (node > node[i])))
            close = (s[with_] == s[i]).mean(axis=1) >= least if len(with_) else np.zeros(0, bool)
            with_ = with_[close]
            # a pair is told by the first band it shares, by the keys that make the buckets
            with_ = with_[(keys[with_] == keys[i]).argmax(axis=1) == band] if len(with_) else with_
            us.extend([node[i]] * len(with_))
            vs.extend(node[with_])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return spread.groupBy("key", "lo", "hi").applyInArrow(compare, "u bigint, v bigint")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs ``(u, v)`` whose exact similarity reaches the threshold, with it."""
    pairs = cut_lineage(pairs.select("u", "v"))
    wanted = cut_lineage(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
                         .join(nodes.select("node", "a", "b"), "node"))
    if wanted.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        wanted = F.broadcast(wanted)
    found = cut_lineage(with_keys(docs).select("a", "b", "text").join(wanted, ["a", "b"]).groupBy("node").agg(F.min("text").alias("text")))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingles(shingle)
        last: tuple = (None, None)
        for b in common.pieces(batches, "tu", 1 << 20):
            n = b.num_rows
            sides = []
            for name in ("tu", "tv"):
                value, weight, owner = weighted(*of.of(b.column(b.schema.get_field_index(name))))
                ends = np.searchsorted(owner, np.arange(n + 1))
                sides.append((value, weight, ends))
            (x, wx, ex), (y, wy, ey) = sides
            score = [probability_jaccard(x[ex[i]:ex[i + 1]], wx[ex[i]:ex[i + 1]], y[ey[i]:ey[i + 1]], wy[ey[i]:ey[i + 1]]) for i in range(n)]
            yield pa.RecordBatch.from_pydict({"u": b.column(0), "v": b.column(1), "similarity": pa.array(score, pa.float64())})

    joined = (pairs.join(found.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
              .join(found.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v").select("u", "v", "tu", "tv"))
    scored = joined.mapInArrow(compare, "u bigint, v bigint, similarity double")
    return cut_lineage(scored.where(F.col("similarity") >= threshold - 1e-12))


def classes(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 7) -> DataFrame:
    """A row per distinct text: both hashes, its class (smallest doc_id), the number of its rows and of its class's rows."""
    nodes = nodes_of(docs, shingle, bands, rows)
    buckets = buckets_of(nodes)
    links = verified(leading_pairs(buckets), nodes, docs, shingle, threshold)
    comps = cut_lineage(components(links.select("u", "v")))
    m = bands * rows
    # one register in 256 agrees by chance; three standard errors are left
    least = threshold + (1 - threshold) / 256 - 3.1 * (threshold * (1 - threshold) / m) ** 0.5
    more = verified(open_pairs(buckets, nodes, comps, bands, rows, least), nodes, docs, shingle, threshold)
    comps = cut_lineage(components(links.select("u", "v").unionByName(more.select("u", "v"))))
    named = nodes.select("node", "a", "b", "first_id", "n_rows").join(comps, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    whole = named.groupBy("component").agg(F.min("first_id").alias("class_id"), F.sum("n_rows").alias("class_size"))
    return cut_lineage(named.join(whole, "component").select("a", "b", "class_id", "class_size", "n_rows", "component"))


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """A row per document: ``doc_id``, ``class_id`` and ``class_size``."""
    found = classes(docs, **parameters)
    return with_keys(docs).drop("text").join(found.select("a", "b", "class_id", "class_size"), ["a", "b"]).select(
        "doc_id", "class_id", "class_size")


def without_copies(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest ``doc_id`` (a missing one counts last); all columns are kept."""
    found = classes(docs, **parameters)
    own, a, b, ka, kb, stays = common.free(docs.columns, "_id", "_a", "_b", "_ka", "_kb", "_stays")
    keys = with_keys(docs).drop("text").join(found.select("a", "b", "component"), ["a", "b"])
    rows = keys.groupBy("component", "doc_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")).alias("k"))
    marked = cut_lineage(rows.join(best, "component").withColumn(
        "first", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b").eqNullSafe(F.col("k"))).where(
        "not first or n > 1").select(F.col("doc_id").alias(own), F.col("a").alias(a), F.col("b").alias(b), F.col("first").alias(stays)))
    sent = F.broadcast(marked) if marked.limit(SENT_ROWS + 1).count() <= SENT_ROWS else marked
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(ka, F.xxhash64(text)).withColumn(kb, F.xxhash64(F.lit(1), text))
    same = (F.col("doc_id").cast("bigint").eqNullSafe(F.col(own))) & (F.col(ka) == F.col(a)) & (F.col(kb) == F.col(b))
    once = keyed.join(sent, same, "left_anti")
    # equal rows of the document that stays
    again = keyed.join(sent.where(F.col(stays)), same, "left_semi").dropDuplicates(["doc_id", ka, kb])
    return once.unionByName(again).drop(ka, kb)
