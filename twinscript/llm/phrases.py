"""Phrases of several words by a multikey quicksort of the places where they begin.

A place in a text stands for the words that follow it in its piece, four at most.  Places are sorted word by word
with three-way partitions: those whose word is smaller, equal or greater than a pivot's.  An equal partition at depth ``d`` is a phrase of ``d``
words and its size the phrase's count; a partition with fewer places than a candidate needs is abandoned, at any depth.

Globally, places are routed by their leading words, one word further each round, and only those that can still count go on:
words are counted first; places that begin with two frequent words are routed by both; those that begin with three words of two
frequent pairs by all three, with the fourth word if its pair is frequent.  Equal places of a task become one with a number before they are
routed, so a passage that half the documents share is a place per task.  Words become numbers by a sorted file of 128-bit hashes
of the frequent ones, and frequent pairs lie in sorted files, too; tasks map both from the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.llm import common
from twinscript.operators.numbering import number_rows
from twinscript.session import cut_lineage, scratch

U64 = np.uint64
#: The longest phrase, in words.
WORDS = 4
#: Words of text for each shard of places; its places lie in one task.
PER_SHARD = 1 << 22
PER_FLUSH = 1 << 21
WORDS_HELD = 250_000
#: Stands for no further word; no word has this number.
END = (1 << 32) - 1
SMALL = 1 << 15
SALTS = 64

#: What a byte is: part of a word, blank, or the end of a piece.
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[[0x20, 0x09]] = 1
KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def cut_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of a column of texts in small letters, and the piece each stands in; pieces never go on from text to text."""
    ended = pc.binary_join_element_wise(pc.ascii_lower(common.compact(texts)), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    size = np.frombuffer(ended.buffers()[1], dtype=np.int64)[len(ended)]
    data = np.frombuffer(ended.buffers()[2], dtype=np.uint8)[:size]
    kinds = KINDS[data]
    inside = kinds == 0
    edges = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return words.dictionary_encode(), np.cumsum(kinds == 2, dtype=np.int32)[starts]


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """Each language of ``lang, text`` with its texts."""
    coded = batch.column(0).dictionary_encode()
    codes = coded.indices.to_numpy()
    for code, lang in enumerate(coded.dictionary.to_pylist()):
        yield lang, batch.column(1) if len(coded.dictionary) == 1 else batch.column(1).take(pa.array(np.flatnonzero(codes == code)))


def hashes(lang: str, words: pa.Array) -> np.ndarray:
    """128 bits for each word of a language, as two signed numbers."""
    head = lang.encode() + b"\0"
    raw = b"".join([xxhash.xxh3_128_digest(head + w) for w in words.cast(pa.large_binary()).to_pylist()])
    return np.frombuffer(raw, dtype=">i8").reshape(-1, 2).astype(np.int64)


def count_words(texts: DataFrame) -> DataFrame:
    """``lang, word, n`` of ``lang, text``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found), pa.string()), "word": pa.array(list(found), pa.string()),
                                                  "n": pa.array(list(found.values()), pa.int64())})
            held.clear()

        for b in common.pieces(batches):
            for lang, of in by_language(b):
                words, _ = cut_words(of)
                known = held.setdefault(lang, {})
                get = known.get
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)).tolist()
                known.update([(w, get(w, 0) + c) for w, c in zip(words.dictionary.to_pylist(), n, strict=True)])
            if sum(map(len, held.values())) > WORDS_HELD:
                yield from flush()
        yield from flush()

    return texts.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def number_words(words: DataFrame, folder: str) -> tuple[DataFrame, list]:
    """``id, lang, word, n`` of all words, numbered in order of their hashes, and the files of the hashes: first hash, first number, path."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hashes(lang, pa.array([w])) for lang, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            both = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_pydict({"h1": pa.array(both[:, 0]), "h2": pa.array(both[:, 1]), "lang": b.column(0), "word": b.column(1), "n": b.column(2)})

    def write(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        h1, h2 = (rows.column(c).to_numpy() for c in ("h1", "h2"))
        path = common.write_file(folder, f"words-{key[0].as_py():06d}", [h1.tobytes(), h2.tobytes()])
        return pa.table({"hash": h1[:1], "id": rows.column("id").slice(0, 1), "path": [path]})

    numbered = number_rows(words.select("lang", "word", "n").mapInArrow(hashed, "h1 bigint, h2 bigint, lang string, word string, n bigint"),
                           order=["h1", "h2"], name="id").withColumn("id", F.col("id") - 1)
    files = numbered.select("_chunk", "h1", "h2", "id").groupBy("_chunk").applyInArrow(write, "hash bigint, id bigint, path string")
    # a row per file
    return numbered.select("id", "lang", "word", "n"), sorted(map(tuple, files.collect()))


class Numbers:
    """The numbers of words by their hashes."""

    def __init__(self, files: list):
        self.first = np.array([f[0] for f in files], dtype=np.int64)
        self.base = [f[1] for f in files]
        self.parts = [np.frombuffer(common.mapped(f[2]), dtype=np.int64).reshape(2, -1) for f in files]

    def of(self, both: np.ndarray) -> np.ndarray:
        """-1 for a word that has none."""
        out = np.full(len(both), -1, dtype=np.int64)
        where = np.searchsorted(self.first, both[:, 0], side="right") - 1
        for part in np.unique(where[where >= 0]):
            here = np.flatnonzero(where == part)
            h1, h2 = self.parts[part]
            at = np.searchsorted(h1, both[here, 0])
            for more in (0, 1):  # two words of one first half are told apart by the second
                next_ = np.minimum(at + more, len(h1) - 1)
                hit = (h1[next_] == both[here, 0]) & (h2[next_] == both[here, 1])
                out[here[hit]] = self.base[part] + next_[hit]
        return out


def _shard(mixed: np.ndarray, shards: int) -> np.ndarray:
    return ((mixed >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def combined(keys: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of the columns ``keys`` once, with the sum of their weights."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    fresh = np.zeros(len(order), dtype=bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(fresh)
    return [k[starts] for k in keys], np.add.reduceat(weights[order], starts) if len(starts) else weights[:0]


def partitions(columns: list[np.ndarray], weights: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Equal partitions of at least ``least`` places: depth, a pointer into each, and their sizes.

    ``columns`` are the places' words at each depth, ``weights`` how many places a row stands for.  Larger
    partitions are cut in three by a pivot; those of up to ``SMALL`` pointers are sorted at once, depth by depth.
    """
    stack = [(np.arange(len(weights)), 0)]
    while stack:
        at, depth = stack.pop()
        if weights[at].sum() < least:
            continue
        if len(at) <= SMALL:
            yield from _small(columns, weights, least, at, depth)
            continue
        key = columns[depth][at]
        pivot = np.sort(key[::len(key) // 99])[50]
        stack.append((at[key < pivot], depth))
        stack.append((at[key > pivot], depth))
        same = at[key == pivot]
        size = weights[same].sum()
        if pivot != END and size >= least:
            yield depth, same[:1], np.array([size])
            if depth + 1 < len(columns):
                stack.append((same, depth + 1))


def _small(columns: list[np.ndarray], weights: np.ndarray, least: int, at: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    at = at[np.lexsort([columns[d][at] for d in reversed(range(depth, len(columns)))])]
    fresh = np.zeros(len(at), dtype=bool)
    fresh[:1] = True
    for d in range(depth, len(columns)):
        key = columns[d][at]
        fresh[1:] |= key[1:] != key[:-1]
        starts = np.flatnonzero(fresh)
        size = np.add.reduceat(weights[at], starts)
        kept = (size >= least) & (key[starts] != END)
        if not kept.any():
            return
        yield d, at[starts[kept]], size[kept]
        stay = np.repeat(kept, np.diff(np.append(starts, len(at))))
        at, fresh = at[stay], fresh[stay]


class Places:
    """Numbers of the words of texts of one language, and where two frequent words follow each other."""

    def __init__(self, numbers: Numbers, n_words: int):
        self.numbers, self.n_words = numbers, n_words

    def of(self, lang: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each word, the places that begin with two frequent words, and the code of each such pair."""
        words, piece = cut_words(texts)
        ids = self.numbers.of(hashes(lang, words.dictionary))[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        begin = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (piece[:-1] == piece[1:]))
        return ids, begin, ids[begin].astype(U64) * U64(self.n_words) + ids[begin + 1].astype(U64)


def _route(columns: list[np.ndarray], weights: np.ndarray, mixed: np.ndarray, shards: int) -> pa.RecordBatch:
    """A row for each shard: its rows' columns and weights, one after the other."""
    where = _shard(mixed, shards)
    order = np.argsort(where, kind="stable")
    shard, starts = np.unique(where[order], return_index=True)
    bounds = np.append(starts, len(order))
    columns = [c[order] for c in (*columns, weights.astype(np.int64))]
    blobs = [b"".join(c[a:z].tobytes() for c in columns) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "places": pa.array(blobs, pa.large_binary()).cast(pa.binary())})


def _received(rows: pa.Table, n: int) -> list[np.ndarray]:
    """The ``n`` columns and the weights of a shard's rows, equal rows once."""
    parts = [np.frombuffer(x.as_buffer(), dtype=U64).reshape(n + 1, -1) for chunk in rows.column("places").chunks for x in chunk]
    keys, weights = combined([np.concatenate([p[i] for p in parts]) for i in range(n)], np.concatenate([p[n] for p in parts]).astype(np.int64))
    return [*keys, weights]


def _keys(numbers: list[np.ndarray]) -> pa.Array:
    """Each phrase as the bytes of its words' numbers, four a word."""
    raw = np.stack(numbers, axis=1).astype(">u4").tobytes()
    width = 4 * len(numbers)
    return pa.array([raw[i:i + width] for i in range(0, len(raw), width)], pa.binary())


def frequent_pairs(texts: DataFrame, files: list, n_words: int, shards: int, least: int, folder: str) -> tuple[DataFrame, list]:
    """``key, a`` of phrases of two words, and the file of sorted codes of each shard."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, held, n = Places(Numbers(files), n_words), [], 0

        def flush() -> pa.RecordBatch:
            keys, weights = combined([np.concatenate(held)], np.ones(n, dtype=np.int64))
            return _route(keys, weights, common.mix(keys[0]), shards)

        for b in common.pieces(batches):
            for lang, of in by_language(b):
                codes = places.of(lang, of)[2]
                held.append(codes)
                n += len(codes)
            if n >= PER_FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def count(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        codes, weights = _received(rows, 1)
        found = [(at, size) for _, at, size in partitions([codes], weights, least)]
        at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        a = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        common.write_file(folder, f"pairs-{key[0].as_py():06d}", [np.sort(codes[at]).tobytes()])
        common.release()
        return pa.table({"key": _keys([codes[at] // U64(n_words), codes[at] % U64(n_words)]), "a": pa.array(a, pa.int64()),
                         "shard": pa.array([key[0].as_py()] * len(at), pa.int32())})

    sent = texts.mapInArrow(send, "shard int, places binary")
    found = cut_lineage(sent.groupBy("shard").applyInArrow(count, "key binary, a bigint, shard int"))
    paths: list = [None] * shards
    for shard, in found.select("shard").distinct().collect():  # a row per file
        paths[shard] = f"{folder}/pairs-{shard:06d}"
    return found.select("key", "a"), paths


class Pairs:
    """Tells frequent pairs."""

    def __init__(self, paths: list):
        self.parts = [np.frombuffer(common.mapped(p), dtype=U64) if p else np.zeros(0, U64) for p in paths]

    def has(self, codes: np.ndarray) -> np.ndarray:
        distinct, place = np.unique(codes, return_inverse=True)
        out, where = np.zeros(len(distinct), dtype=bool), _shard(common.mix(distinct), len(self.parts))
        order = np.argsort(where, kind="stable")
        shard, starts = np.unique(where[order], return_index=True)
        for s, here in zip(shard, np.split(order, starts[1:]) if len(shard) else (), strict=True):
            if len(known := self.parts[s]):
                at = np.minimum(np.searchsorted(known, distinct[here]), len(known) - 1)
                out[here] = known[at] == distinct[here]
        return out[place]


def frequent_longer(texts: DataFrame, files: list, pairs: list, n_words: int, shards: int, least: int) -> DataFrame:
    """``key, a`` of phrases of three and four words."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, frequent, held, n = Places(Numbers(files), n_words), Pairs(pairs), [], 0

        def flush() -> pa.RecordBatch:
            keys, weights = combined([np.concatenate([h[i] for h in held]) for i in range(2)], np.concatenate([h[2] for h in held]))
            return _route(keys, weights, common.mix(common.mix(keys[0]) ^ (keys[1] >> U64(32))), shards)

        for b in common.pieces(batches):
            for lang, of in by_language(b):
                ids, begin, codes = places.of(lang, of)
                code = np.zeros(len(ids) + 2, dtype=U64)
                goes = np.zeros(len(ids) + 2, dtype=bool)
                code[begin], goes[begin] = codes, frequent.has(codes)
                at = np.flatnonzero(goes[:-2] & goes[1:-1])
                fourth = np.where(goes[at + 2], np.append(ids, [0, 0, 0])[at + 3], END).astype(U64)
                keys, weights = combined([code[at], ids[at + 2].astype(U64) << U64(32) | fourth], np.ones(len(at), dtype=np.int64))
                held.append((*keys, weights))
                n += len(weights)
            if n >= PER_FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def count(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        codes, rest, weights = _received(rows, 2)
        columns = [codes, rest >> U64(32), rest & U64(END)]
        keys, sizes = [], []
        for depth, at, size in partitions(columns, weights, least):
            if depth:  # the pair itself lies in several shards
                words = [codes[at] // U64(n_words), codes[at] % U64(n_words), columns[1][at], columns[2][at]]
                keys.append(_keys(words[:depth + 2]))
                sizes.append(size)
        common.release()
        return pa.table({"key": pa.concat_arrays([pa.array([], pa.binary()), *keys]), "a": pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]), pa.int64())})

    return cut_lineage(texts.mapInArrow(send, "shard int, places binary").groupBy("shard").applyInArrow(count, "key binary, a bigint"))


def _number(key: Column) -> Column:
    """The number of a phrase's first word."""
    return F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("bigint")


def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``key, a, l, r, score`` of every phrase by the cut that scores lowest, the first of equal ones."""
    cuts = phrases.select("key", "a", F.explode(F.sequence(F.lit(1), (F.length("key") / 4 - 1).cast("int"))).alias("k"))
    parts = cuts.select("key", "a", "k", F.col("key").substr(F.lit(1), F.col("k") * 4).alias("first"),
                        F.col("key").substr(F.col("k") * 4 + 1, F.length("key")).alias("rest"))
    found = parts.join(counts.select(F.col("key").alias("first"), F.col("a").alias("l")), "first").join(
        counts.select(F.col("key").alias("rest"), F.col("a").alias("r")), "rest")
    exact = F.expr("cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div cast(l + r as decimal(20,0)) as bigint)")
    best = found.select("key", "a", F.struct(exact.alias("score"), "k", "l", "r").alias("cut")).groupBy("key", "a").agg(F.min("cut").alias("cut"))
    return best.select("key", "a", "cut.l", "cut.r", "cut.score")


def maximal(phrases: DataFrame, scored_phrases: DataFrame, share: int) -> DataFrame:
    """The scored phrases without those that a longer phrase holds in ``share`` hundredths of their places or more."""
    longer = phrases.where(F.length("key") > 8)
    spans = F.expr("""flatten(transform(sequence(2, cast(length(key) / 4 as int) - 1), w ->
        transform(sequence(0, cast(length(key) / 4 as int) - w), s -> substring(key, 4 * s + 1, 4 * w))))""")
    over = longer.select(F.explode(spans).alias("key"), "a").groupBy("key").agg(F.max("a").alias("over"))
    held = _exact(F.col("over")) * 100 >= _exact(F.col("a")) * share
    return scored_phrases.join(over, "key", "left").where(F.col("over").isNull() | ~held).drop("over")


def first_of_each(rows: DataFrame, group: str, order: list[Column], top: int, spread: Column) -> DataFrame:
    """The rows that rank among the first ``top`` of their group, ties included; first within a fraction of a group, then over what these leave."""
    some = Window.partitionBy(group, "_part").orderBy(*order)
    whole = Window.partitionBy(group).orderBy(*order)
    left = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(SALTS))).withColumn("_rank", F.rank().over(some)).where(F.col("_rank") <= top)
    return left.withColumn("_rank", F.rank().over(whole)).where(F.col("_rank") <= top).drop("_rank", "_part")


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    Texts are put into small letters (A-Z) and cut at marks and line ends into pieces, and these at blanks into words.  A phrase is two to four
    words of a piece that follow one another at ``least`` places or more.  A missing text is empty, a missing language is ``und``; repeated rows
    count as often as they stand; further columns are left out.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "phrases")
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = cut_lineage(count_words(texts))
    totals = cut_lineage(counted.groupBy("lang").agg(F.sum("n").alias("n")))
    words, files = number_words(counted.where(F.col("n") >= least), folder)
    n_words = words.count()
    if n_words >= END:
        raise ValueError("more frequent words than 32 bits can number")
    shards = max(1, math.ceil((totals.agg(F.sum("n")).first()[0] or 0) / PER_SHARD))
    pairs, paths = frequent_pairs(texts, files, max(1, n_words), shards, least, folder)
    phrases = pairs.unionAll(frequent_longer(texts, files, paths, max(1, n_words), shards, least))
    key = F.unhex(F.lpad(F.hex("id"), 8, "0"))
    counts = words.select(key.alias("key"), F.col("n").alias("a")).unionAll(phrases)
    kept = maximal(phrases, scored(phrases, counts), share)
    spoken = kept.withColumn("id", _number(F.col("key"))).join(words.select("id", "lang"), "id").drop("id")
    order = [F.col("score").desc(), F.col("a").desc()]
    chosen = cut_lineage(first_of_each(spoken, "lang", order, top, F.col("key")))
    each = chosen.select("key", F.posexplode(F.expr(
        "transform(sequence(0, cast(length(key) / 4 as int) - 1), s -> cast(conv(hex(substring(key, 4 * s + 1, 4)), 16, 10) as bigint))")).alias("at", "id"))
    text = each.join(words.select("id", "word"), "id").groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("bigint")
    ranked = chosen.join(text, "key").withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql() -> str:
    """The same over table ``documents``."""
    return r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, * FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS body FROM documents)),
cut AS (SELECT piece, lang, regexp_extract_all(body, '[^\x20\x09]+') AS ws FROM pieces),
words AS (SELECT piece, lang, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM cut),
places AS (SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4 FROM words WINDOW p AS (PARTITION BY piece ORDER BY pos)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f AS (
  SELECT lang, [w1] AS ph, count(*) AS a FROM places GROUP BY ALL
  UNION ALL SELECT lang, [w1, w2], count(*) AS a FROM places WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3], count(*) AS a FROM places WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) AS a FROM places WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT * FROM f WHERE len(ph) > 1),
cuts AS (SELECT lang, ph, a, unnest(range(1, len(ph))) AS k FROM cand),
parts AS (
  SELECT c.*, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.ph = c.ph[1:c.k] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[c.k + 1:]),
best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
spans AS (SELECT lang, ph, a, unnest(range(2, len(ph))) AS m FROM cand WHERE len(ph) > 2),
inner_ AS (SELECT lang, ph, a, m, unnest(range(1, len(ph) - m + 2)) AS s FROM spans),
held AS (SELECT lang, ph[s:s + m - 1] AS ph, max(a) AS over_ FROM inner_ GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.ph = b.ph WHERE h.over_ IS NULL OR 100 * h.over_ < 80 * b.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank,
  array_to_string(ph, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM kept)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score FROM ranked k JOIN totals t ON t.lang = k.lang WHERE k.rank <= 2000"""
