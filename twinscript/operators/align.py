"""Sentence alignment of document pairs, and what is done with the links.

Links are rows ``(pair_id, link_pos, src_ids, trg_ids, score)``.  Sentence lengths travel as one
integer array per document, so texts are not shuffled for an alignment, and Spark spreads the
pairs over tasks.  A document is one row of the input, so a pair's arrays fit in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.functions.scores import (MAX_COST, MEAN, PRIORS, TAIL, TAIL_DENSITY, TAIL_SCALE, VARIANCE)
from twinscript.operators import meeting
from twinscript.session import cut_lineage, spread
from twinscript.sources import markup

# Thresholds of link filtering, size of the first search band, window of shared words.
SCORE_THRESHOLD, MAX_SRC, MAX_TRG = -10.0, 2, 2
BAND = 50
ANCHOR_WINDOW, ANCHOR_LETTERS = 5, 10
# how sources and the language identification of this package write that they are unsure
UNSURE = ("un", "unknown")

LINK_SCHEMA = "pair_id string, link_pos int, src_ids array<int>, trg_ids array<int>, score double"


def lengths(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each sentence's length and the running length up to and including it."""
    upto = Window.partitionBy(key).orderBy("sent_pos").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("text").cast("bigint")
    return sentences.select(key, "sent_pos", n.alias("length"), F.sum(n).over(upto).alias("running"))


def length_arrays(docs: DataFrame, sentences: Column, key: str = "doc_id") -> DataFrame:
    """``(key, lens)``: sentence lengths of each document from its own row, without a shuffle."""
    return docs.select(key, F.transform(sentences, lambda s: F.length(s)).alias("lens"))


def with_lengths(pairs: DataFrame, arrays: DataFrame, key: str = "doc_id") -> DataFrame:
    """Bring both documents' length arrays to each pair."""
    src = arrays.select(F.col(key).alias("src_doc"), F.col("lens").alias("src_lens"))
    trg = arrays.select(F.col(key).alias("trg_doc"), F.col("lens").alias("trg_lens"))
    return pairs.join(src, "src_doc").join(trg, "trg_doc")


def one_to_one(pairs: DataFrame, src_size: str = "src_size", trg_size: str = "trg_size",
               keep: tuple[str, ...] = ()) -> DataFrame:
    """The i-th sentence with the i-th; what is left over is linked to nothing.

    Sentence ids are 1…size, so the links follow from the two sizes alone.  ``keep`` names columns
    of the pairs to pass on.
    """
    longest = F.greatest(src_size, trg_size)
    steps = F.when(longest > 0, F.sequence(F.lit(1), longest.cast("int")))
    none = F.array().cast("array<int>")
    return (pairs.select("pair_id", *keep, src_size, trg_size, F.explode(steps).alias("link_pos"))
            .select("pair_id", *keep, "link_pos",
                    F.when(F.col("link_pos") <= F.col(src_size), F.array("link_pos")).otherwise(none).alias("src_ids"),
                    F.when(F.col("link_pos") <= F.col(trg_size), F.array("link_pos")).otherwise(none).alias("trg_ids"),
                    F.lit(None).cast("double").alias("score")))


def _cost(src: np.ndarray, trg: np.ndarray, mean: float, variance: float) -> np.ndarray:
    """``scores.length_cost`` for arrays."""
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs(mean * src - trg) / np.sqrt(variance * (src + trg / mean) / 2)
        t = 1 / (1 + TAIL_SCALE * z)
        poly = t * (TAIL[0] + t * (TAIL[1] + t * (TAIL[2] + t * (TAIL[3] + t * TAIL[4]))))
        tail = 2 * (1 - (1 - TAIL_DENSITY * np.exp(-z * z / 2) * poly))
        cost = np.where(tail > 0, -np.log(tail), MAX_COST)
    return np.where((src == 0) & (trg == 0), 0.0, cost)


def _band(n: int, m: int, band: int, pillow: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and last column searched in each row: around the diagonal of an n × m table."""
    if not band or not n:
        return np.zeros(n + 1, int), np.full(n + 1, m)
    i = np.arange(n + 1)
    reach = band + int(np.ceil(m / n)) + (2 * np.sqrt(np.minimum(i, n - i)).round().astype(int) if pillow else 0)
    middle = (i * (m / n)).astype(int)
    return np.maximum(0, middle - reach), np.minimum(m, middle + reach)


# rows whose costs are worked out at once, cells of these at most, and cells whose steps are kept without filling twice
BLOCK, COSTS, CELLS = 128, 1 << 20, 1 << 26
# cells of a full table that make a task; a larger pair has one of its own
TASK_CELLS, MOST_TASKS = 1 << 28, 100_000


def _gains(overlap: tuple[np.ndarray, np.ndarray, np.ndarray], kinds: list[tuple[int, int]],
           rows: np.ndarray, cols: np.ndarray) -> list[np.ndarray]:
    """For each kind of step, what the shared words of the sentences it takes save at each cell."""
    top, left = rows[0] - 2, cols[0] - 2
    at_i, at_j, value = overlap
    near = (at_i > top) & (at_i <= rows[-1]) & (at_j > left) & (at_j <= cols[-1])
    table = np.zeros((len(rows) + 3, len(cols) + 3))
    np.add.at(table, (at_i[near] - top, at_j[near] - left), value[near])
    total = table.cumsum(0).cumsum(1)
    i, j = (rows - top)[:, None], (cols - left)[None, :]
    return [total[i, j] - total[i - d1, j] - total[i, j - d2] + total[i - d1, j - d2] for d1, d2 in kinds]


def cheapest_path(src: np.ndarray, trg: np.ndarray, mean: float = MEAN, variance: float = VARIANCE,
                  priors: dict[tuple[int, int], float] | None = None, band: int | None = None,
                  pillow: bool = True, overlap: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
                  ) -> list[tuple[int, int, int, int, float]]:
    """Steps ``(i, i2, j, j2, cost)`` of the cheapest monotone path through both length arrays.

    ``overlap`` holds positions (from 1) of sentences that share words and how much that lowers the
    cost of a link with both.

    The search starts in a band around the diagonal and doubles it until ``_band_needed`` shows that no
    path beyond the band can be cheaper.  So texts that run side by side take little more than time and space
    with one text, and texts that are shifted against each other still get their cheapest path.  A
    given ``band`` is searched as it is (0: everything).
    """
    if band is not None:
        return _path_in_band(src, trg, mean, variance, priors, band, pillow, overlap)
    n, m = len(src), len(trg)
    spared = 0.0
    if overlap is not None:
        # a source sentence is linked with two target sentences at most
        best = np.zeros((n + 1, 2))
        for i, gain in zip(overlap[0], overlap[2]):
            best[int(i)] = sorted((*best[int(i)], max(0.0, float(gain))))[1:]
        spared = float(best.sum())
    band = BAND
    while True:
        lo, hi = _band(n, m, band, pillow)
        whole = not lo.any() and bool((hi == m).all())
        path = _path_in_band(src, trg, mean, variance, priors, 0 if whole else band, pillow, overlap)
        if whole or band >= _band_needed(n, m, sum(step[4] for step in path) + spared, priors or PRIORS):
            return path
        band *= 2


def _band_needed(n: int, m: int, cost: float, priors: dict[tuple[int, int], float]) -> float:
    """A distance from the diagonal that no path of at most ``cost`` goes beyond.

    A path that does moves away from the diagonal by as much, and back; seen along the target text, its steps
    add up to that much in either direction.  If ``-log p >= a d1 + b d2 + c max(0, d1 m / n - d2)`` holds for all
    kinds of steps, a path costs ``a n + b m + c distance`` at least.  The best such (a, b, c) is where
    three of these bounds meet.
    """
    if not n or not m:
        return 0.0
    steps = np.array([(d1, d2, max(0.0, d1 * m / n - d2)) for d1, d2 in priors])
    least = np.array([-np.log(p) for p in priors.values()])
    needed = np.inf
    for three in combinations(range(len(least)), 3):
        rows = steps[list(three)]
        if abs(np.linalg.det(rows)) < 1e-12:
            continue
        a, b, c = np.linalg.solve(rows, least[list(three)])
        if c > 1e-12 and (steps @ (a, b, c) <= least + 1e-9).all():
            needed = min(needed, (cost - a * n - b * m) / c)
    return needed


def _path_in_band(src: np.ndarray, trg: np.ndarray, mean: float, variance: float,
                  priors: dict[tuple[int, int], float] | None, band: int, pillow: bool,
                  overlap: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> list[tuple[int, int, int, int, float]]:
    """The cheapest path within a band.

    A row is filled at once: steps that take a source sentence look one or two rows up; steps that
    take a target sentence only are a running minimum along the row.  Costs are kept for two rows; how a cell was reached,
    for all rows if that takes at most ``CELLS`` bytes.  Beyond, the two rows before every piece of a table are kept, with about as many rows to a piece as pieces,
    and the pieces are filled again from the last to the first as the path is followed back: twice the time, and memory that grows
    with the root of the rows.
    """
    priors = priors or PRIORS
    n, m = len(src), len(trg)
    a = np.concatenate([[0.0], np.cumsum(src, dtype=float)])
    b = np.concatenate([[0.0], np.cumsum(trg, dtype=float)])
    kinds = [k for k in sorted(priors) if k[0] > 0]
    moves = [*kinds, (0, 1)]
    lo, hi = _band(n, m, band, pillow)
    along = np.concatenate([[0.0], np.cumsum(_cost(np.zeros(m), np.diff(b), mean, variance) - np.log(priors[(0, 1)]))])
    widest = int((hi - lo).max()) + 1

    def fill(begin: int, end: int, two: np.ndarray | None, one: np.ndarray | None, back: list | None) -> tuple:
        """Rows ``begin`` to ``end`` from the two before; notes in ``back`` how each cell is reached, and returns the last two."""
        costs, first, stop, left = [], 0, begin, 0
        for i in range(begin, end):
            if i == stop:
                first, stop = i, min(i + max(1, min(BLOCK, COSTS // widest)), end)
                left, right = lo[first:stop].min(), hi[first:stop].max() + 1
                r, c = np.arange(first, stop), np.arange(left, right)
                costs = [_cost((a[r] - a[np.maximum(r - d1, 0)])[:, None], (b[c] - b[np.maximum(c - d2, 0)])[None, :],
                               mean, variance) - np.log(priors[(d1, d2)]) for d1, d2 in kinds]
                if overlap is not None:
                    costs = [cost - gain for cost, gain in zip(costs, _gains(overlap, kinds, r, c))]
            best = np.full(hi[i] - lo[i] + 1, np.inf)
            step = np.full(len(best), -1, np.int8)
            if i == 0:
                best[0] = 0.0
            for k, (d1, d2) in enumerate(kinds):
                if d1 > i:
                    continue
                j0, j1 = max(lo[i], lo[i - d1] + d2), min(hi[i], hi[i - d1] + d2)
                if j0 > j1:
                    continue
                above = one if d1 == 1 else two
                total = above[j0 - d2 - lo[i - d1]:j1 - d2 - lo[i - d1] + 1] + costs[k][i - first, j0 - left:j1 - left + 1]
                here, how = best[j0 - lo[i]:j1 - lo[i] + 1], step[j0 - lo[i]:j1 - lo[i] + 1]
                better = total < here
                here[better], how[better] = total[better], k
            run = along[lo[i]:hi[i] + 1]
            passed = np.minimum.accumulate(best - run) + run
            skips = passed < best - 1e-9
            best[skips], step[skips] = passed[skips], len(kinds)
            two, one = one, best
            if back is not None:
                back.append(step)
        return two, one

    every = n + 1 if int((hi - lo + 1).sum()) <= CELLS else max(2, int(np.sqrt(16 * n)))
    pieces = [(at, min(at + every, n + 1)) for at in range(0, n + 1, every)]
    kept: list[tuple] = [(None, None)]
    for begin, end in pieces[:-1]:
        kept.append(fill(begin, end, *kept[-1], None))
    steps, i, j = [], n, m
    for (begin, end), before in zip(reversed(pieces), reversed(kept), strict=True):
        back: list[np.ndarray] = []
        fill(begin, end, *before, back)
        while (i or j) and i >= begin:
            d1, d2 = moves[back[i - begin][j - lo[i]]]
            steps.append((i - d1, i, j - d2, j))
            i, j = i - d1, j - d2
    return _priced(steps[::-1], a, b, mean, variance, priors, overlap)


def _priced(steps: list[tuple[int, int, int, int]], a: np.ndarray, b: np.ndarray, mean: float, variance: float,
            priors: dict[tuple[int, int], float], overlap: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> list[tuple[int, int, int, int, float]]:
    """The steps with the cost of each."""
    if not steps:
        return []
    i0, i1, j0, j1 = np.array(steps).T
    cost = _cost(a[i1] - a[i0], b[j1] - b[j0], mean, variance) - np.log([priors[d] for d in zip((i1 - i0).tolist(), (j1 - j0).tolist())])
    if overlap is not None:
        gain: dict[tuple[int, int], float] = {}
        for i, j, value in zip(*overlap):
            gain[int(i), int(j)] = gain.get((int(i), int(j)), 0.0) + float(value)
        cost = cost - [sum(gain.get((i, j), 0.0) for i in range(s[0] + 1, s[1] + 1) for j in range(s[2] + 1, s[3] + 1)) for s in steps]
    return [(*step, float(c)) for step, c in zip(steps, cost)]


FLUSH = 50000


def length_based(pairs: DataFrame, mean: float = MEAN, variance: float = VARIANCE,
                 priors: dict[tuple[int, int], float] | None = None, band: int | None = None,
                 pillow: bool = True) -> DataFrame:
    """Links by sentence length for ``pairs(pair_id, src_lens, trg_lens)``.

    With the columns of ``segments`` the ids continue where the segment starts (``src_from``,
    ``trg_from``); with the column of ``with_overlap`` shared words lower the cost.  The score of a
    link is its share of the path's cost.
    """
    shared = "overlap" in pairs.columns
    offsets = {"src_from", "trg_from"} <= set(pairs.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []

        def flush() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=["pair_id", "link_pos", "src_ids", "trg_ids", "score"])
            out.clear()
            return frame

        for batch in batches:
            for row in batch.itertuples(index=False):
                s0, t0 = (row.src_from, row.trg_from) if offsets else (1, 1)
                src, trg = np.asarray(row.src_lens), np.asarray(row.trg_lens)
                if len(src) and len(trg):
                    found = None
                    if shared and row.overlap is not None and len(row.overlap):
                        found = tuple(np.array([x[k] for x in row.overlap]) for k in ("i", "j", "gain"))
                    steps = cheapest_path(src, trg, mean, variance, priors, band, pillow, found)
                elif len(src) or len(trg):
                    steps = [(0, len(src), 0, len(trg), 0.0)]
                else:
                    continue
                for k, (i0, i1, j0, j1, cost) in enumerate(steps):
                    out.append((row.pair_id, s0 + t0 - 1 + k, list(range(s0 + i0, s0 + i1)),
                                list(range(t0 + j0, t0 + j1)), cost))
                if len(out) > FLUSH:
                    yield flush()
            if out:
                yield flush()

    extra = ["src_from", "trg_from"] if offsets else []
    rows = cut_lineage(pairs.select("pair_id", "src_lens", "trg_lens", *extra, *(["overlap"] if shared else [])))
    cells = F.size("src_lens").cast("double") * F.size("trg_lens")
    tasks = int(min(MOST_TASKS, (rows.agg(F.sum(cells)).first()[0] or 0) // TASK_CELLS))
    return spread(rows, "pair_id", *extra, least=tasks).mapInPandas(run, LINK_SCHEMA)


def anchors(src: DataFrame, trg: DataFrame, pairs: DataFrame, window: int = ANCHOR_WINDOW,
            letters: int = ANCHOR_LETTERS) -> DataFrame:
    """Sentence pairs at most ``window`` positions apart that share a long word.

    ``src``/``trg`` hold ``(doc, sent_pos, word)`` once each.  Words travel by document; a word that
    fills a document meets its neighbours only, never all of them.
    Of the hits of a source sentence the nearest target counts, and of those the first.
    """
    kinds = dict(pairs.dtypes)["pair_id"], dict(src.dtypes)["sent_pos"], dict(trg.dtypes)["sent_pos"]

    def nearest(met: meeting.Met) -> Iterator[pa.RecordBatch]:
        found = [np.zeros((4, 0), np.int64)]
        for a, b in met.hits(window, met.pos.astype(float)):
            apart = np.abs(met.pos[a] - met.pos[b])
            near = apart < window
            a, b, apart = a[near], b[near], apart[near]
            by = np.lexsort((met.word[a], met.pos[b], apart, met.pos[a], met.pair[a]))
            rows = np.stack([met.pair[a], met.pos[a], met.pos[b], met.word[a]])[:, by]
            found.append(rows[:, np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(0)])] if len(by) else rows)
        rows = np.concatenate(found, axis=1)
        by = np.lexsort((rows[3], rows[2], np.abs(rows[1] - rows[2]), rows[1], rows[0]))
        rows = rows[:, by]
        if not len(by):
            return
        pair, i, j, word = rows[:, np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(0)])]
        # keep the order: a sentence may anchor only behind all anchors before it
        low, high = int(j.min()), int(j.max()) + 2
        ahead = pair * (high - low) + j - low + 1
        last = np.maximum(np.concatenate([[-1], np.maximum.accumulate(ahead)[:-1]]), pair * (high - low))
        kept = ahead > last
        yield pa.RecordBatch.from_pydict({"pair_id": met.ids.take(pa.array(pair[kept])), "src_pos": pa.array(i[kept]), "trg_pos": pa.array(j[kept]),
                                          "word": met.words.take(pa.array(word[kept])).cast(pa.string())})

    long = src.where(F.length("word") >= letters)
    hits = meeting.meet(long, long if src is trg else trg.where(F.length("word") >= letters), pairs, nearest,
                        f"pair_id {kinds[0]}, src_pos bigint, trg_pos bigint, word string")
    return hits.select("pair_id", F.col("src_pos").cast(kinds[1]).alias("src_pos"), F.col("trg_pos").cast(kinds[2]).alias("trg_pos"), "word")


# what a full overlap of words takes off the cost of a link, and the weakest translation that counts:
# as probabilities of a word add up to one, it has at most ten of those
OVERLAP_GAIN, MIN_TRANSLATION = 5.0, 0.1


def sentence_overlap(words: DataFrame, pairs: DataFrame, table: DataFrame | None = None,
                     band: int = BAND, least: float = MIN_TRANSLATION) -> DataFrame:
    """``pair_id, i, j, overlap``: share of words two sentences near the diagonal have in common.

    ``words`` holds ``(doc, sent_pos, word)`` once each; ``pairs`` the sizes of both documents.  With
    a lexicon ``table(src, trg, p)`` words meet through their translations of probability ``least`` or more, each counting as much
    as it is probable; 0 takes all of them, in a band join on buckets of positions.  Without one, words travel by document as in ``anchors``.
    """
    slope = F.col("trg_size") / F.greatest("src_size", F.lit(1))
    if table is None:
        kinds = dict(pairs.dtypes)["pair_id"], dict(words.dtypes)["sent_pos"]

        def shared(met: meeting.Met) -> Iterator[pa.RecordBatch]:
            middle = met.pos * met.slope
            found = []
            for a, b in met.hits(band, middle):
                near = np.abs(middle[a] - met.pos[b]) <= band
                a, b = a[near], b[near]
                if not len(a):
                    continue
                by, starts = met.order(met.pair[a], met.pos[a], met.pos[b])
                one = by[starts]
                found.append((met.pair[a[one]], met.pos[a[one]], met.pos[b[one]], np.diff(np.append(starts, len(by))), np.maximum.reduceat(np.maximum(met.n[a], met.n[b])[by], starts)))
            if not found:
                return
            pair, i, j, hits, most = (np.concatenate(c) for c in zip(*found))
            by, starts = met.order(pair, i, j)
            pair, i, j = (c[by[starts]] for c in (pair, i, j))
            share = np.add.reduceat(hits[by].astype(float), starts) / np.maximum.reduceat(most[by], starts)
            for at in range(0, len(starts), FLUSH):
                some = slice(at, at + FLUSH)
                yield pa.RecordBatch.from_pydict({"pair_id": met.ids.take(pa.array(pair[some])), "i": pa.array(i[some]), "j": pa.array(j[some]), "overlap": pa.array(share[some])})

        met = meeting.meet(words, words, pairs, shared, f"pair_id {kinds[0]}, i bigint, j bigint, overlap double", slope)
        return met.select("pair_id", F.col("i").cast(kinds[1]).alias("i"), F.col("j").cast(kinds[1]).alias("j"), "overlap")
    width = 2 * band + 1
    count = words.groupBy("doc", "sent_pos").agg(F.count(F.lit(1)).alias("n"))
    named = words.join(count, ["doc", "sent_pos"])
    left = (pairs.select("pair_id", F.col("src_doc").alias("doc"), slope.alias("slope")).join(named, "doc")
            .select("pair_id", F.col("sent_pos").alias("i"), F.col("n").alias("src_n"), "word",
                    (F.col("sent_pos") * F.col("slope")).alias("middle")))
    strong = table.where(F.col("p") >= least).select(F.col("src").alias("word"), "trg", "p")
    left = left.join(strong, "word").drop("word").withColumnRenamed("trg", "word")
    middle = F.floor(F.col("middle") / width)
    left = left.withColumn("bucket", F.explode(F.array(middle - 1, middle, middle + 1)))
    right = (pairs.select("pair_id", F.col("trg_doc").alias("doc")).join(named, "doc")
             .select("pair_id", F.col("sent_pos").alias("j"), F.col("n").alias("trg_n"), "word",
                     F.floor(F.col("sent_pos") / width).alias("bucket")))
    near = left.join(right, ["pair_id", "word", "bucket"]).where(F.abs(F.col("middle") - F.col("j")) <= band)
    return near.groupBy("pair_id", "i", "j").agg(
        (F.sum("p") / F.max(F.greatest("src_n", "trg_n"))).alias("overlap"))


def with_overlap(pairs: DataFrame, overlap: DataFrame, gain: float = OVERLAP_GAIN) -> DataFrame:
    """Bring each pair its sentence overlaps, as one array: at most a band's width per sentence."""
    nested = overlap.groupBy("pair_id").agg(F.collect_list(F.struct(
        F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"),
        (F.col("overlap") * gain).alias("gain"))).alias("overlap"))
    return pairs.join(nested, "pair_id", "left")


def segments(pairs: DataFrame, fixed: DataFrame) -> DataFrame:
    """Cut each pair behind its anchors into independent pieces for ``length_based``.

    The anchors of a pair are gathered into one array; there are fewer of them than sentences.
    """
    points = fixed.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("src_pos").cast("int").alias("s"), F.col("trg_pos").cast("int").alias("t")))).alias("cuts"))
    end = F.struct(F.size("src_lens").alias("s"), F.size("trg_lens").alias("t"))
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("t"))
    cuts = F.coalesce("cuts", F.array().cast("array<struct<s:int,t:int>>"))
    bounds = F.array_distinct(F.concat(F.array(start), cuts, F.array(end)))
    both = pairs.join(points, "pair_id", "left").withColumn("_b", bounds)
    piece = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_b") - 1, F.lit(1))), lambda i: F.struct(
        F.element_at("_b", i).alias("lo"), F.get(F.col("_b"), i).alias("hi")))
    cut = both.select("pair_id", "src_lens", "trg_lens", F.explode(piece).alias("p")).where("p.hi is not null")
    return cut.select(
        "pair_id", (F.col("p.lo.s") + 1).alias("src_from"), (F.col("p.lo.t") + 1).alias("trg_from"),
        F.slice("src_lens", F.col("p.lo.s") + 1, F.col("p.hi.s") - F.col("p.lo.s")).alias("src_lens"),
        F.slice("trg_lens", F.col("p.lo.t") + 1, F.col("p.hi.t") - F.col("p.lo.t")).alias("trg_lens"))


def within_boundaries(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pieces of each pair for ``length_based``, cut before every sentence at which the pair's ``tag`` opens.

    ``units`` are sentences as ``markup.units`` gives them, ``pairs`` has ``pair_id, src_doc, trg_doc, tag`` (see ``best_boundary_tag``).  The
    ``n``-th boundary of one text meets the ``n``-th of the other; before a text's first sentence none is needed.
    """
    lens = units.where(F.col("tag").isNotNull()).groupBy("file").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("unit_no", F.length("text").alias("n")))), lambda x: x["n"]).alias("lens"))
    both = with_lengths(pairs, lens, "file")
    src, trg = (markup.boundaries(units, pairs, f"{side}_doc").select("pair_id", "n", F.col("pos").alias(f"{side}_pos")) for side in ("src", "trg"))
    return segments(both, src.join(trg, ["pair_id", "n"]))


def ladder_to_links(rungs: DataFrame) -> DataFrame:
    """Spans between consecutive rungs ``(pair_id, src_end, trg_end, score)`` as links.

    Rung ends count sentences passed so far; a span carries the score of the rung it starts from.
    """
    w = Window.partitionBy("pair_id").orderBy("src_end", "trg_end")
    def span(end: str, prev: str) -> Column:
        return F.when(F.col(end) > F.col(prev), F.sequence(F.col(prev) + 1, F.col(end))).otherwise(
            F.array().cast("array<bigint>"))
    prev = (rungs.withColumn("_s", F.lag("src_end", 1, 0).over(w)).withColumn("_t", F.lag("trg_end", 1, 0).over(w))
            .withColumn("_score", F.lag("score", 1, 0.0).over(w)).withColumn("link_pos", F.row_number().over(w)))
    return prev.select("pair_id", "link_pos", span("src_end", "_s").alias("src_ids"),
                       span("trg_end", "_t").alias("trg_ids"), F.col("_score").alias("score")).where(
        (F.size("src_ids") > 0) | (F.size("trg_ids") > 0))


def good_link(threshold: float = SCORE_THRESHOLD, max_src: int = MAX_SRC, max_trg: int = MAX_TRG) -> Column:
    return ((F.col("score") >= threshold) & (F.size("src_ids") <= max_src) & (F.size("trg_ids") <= max_trg))


def filter_links(links: DataFrame, **limits) -> DataFrame:
    """Links that score well enough and are not too large."""
    return links.where(good_link(**limits))


def skipped(links: DataFrame, **limits) -> DataFrame:
    """How much ``filter_links`` leaves out."""
    out = ~good_link(**limits)
    return links.agg(F.count_if(out).alias("skipped_links"),
                     F.coalesce(F.sum(F.when(out, F.size("src_ids"))), F.lit(0)).alias("skipped_src"),
                     F.coalesce(F.sum(F.when(out, F.size("trg_ids"))), F.lit(0)).alias("skipped_trg"))


def filter_lang(links: DataFrame, flags: DataFrame) -> DataFrame:
    """Links whose sentences are in their document's language.

    ``flags(pair_id, side, sent_id, detected)`` names sentences with another language found;
    unsure ones are let through unless all sentences of a link are unsure.
    """
    def side(name: str) -> DataFrame:
        return links.select("pair_id", "link_pos", F.lit(name).alias("side"),
                            F.explode(F.col(f"{name}_ids").cast("array<bigint>")).alias("sent_id"))
    parts = side("src").unionByName(side("trg")).join(flags, ["pair_id", "side", "sent_id"], "left")
    unsure = F.col("detected").isin(*UNSURE)
    ok = (parts.groupBy("pair_id", "link_pos")
          .agg(F.count_if(F.col("detected").isNotNull() & ~unsure).alias("_other"),
               F.count_if(unsure).alias("_unsure"), F.count(F.lit(1)).alias("_all"))
          .where("_other = 0 and _unsure < _all").select("pair_id", "link_pos"))
    return links.join(ok, ["pair_id", "link_pos"], "left_semi")


def link_type() -> Column:
    return F.concat_ws(":", F.size("src_ids").cast("string"), F.size("trg_ids").cast("string"))


def type_histogram(links: DataFrame) -> DataFrame:
    return links.groupBy("pair_id", link_type().alias("link_type")).agg(F.count(F.lit(1)).alias("n"))


def stats(links: DataFrame, by: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Links, sentences and costs of each pair."""
    return links.groupBy(*by).agg(
        F.count(F.lit(1)).alias("links"),
        F.sum(F.size("src_ids")).cast("bigint").alias("src_sents"),
        F.sum(F.size("trg_ids")).cast("bigint").alias("trg_sents"),
        F.count_if((F.size("src_ids") == 1) & (F.size("trg_ids") == 1)).alias("one_to_one"),
        F.sum("score").alias("cost"), F.avg("score").alias("mean_cost"))


def best_boundary_tag(tags: DataFrame, pairs: DataFrame) -> DataFrame:
    """The structural tag that occurs equally often, and most often, in both documents.

    ``tags(doc, tag, n)`` has one row per document and tag.
    """
    src = tags.select(F.col("doc").alias("src_doc"), "tag", "n")
    trg = tags.select(F.col("doc").alias("trg_doc"), "tag", "n")
    return (pairs.select("pair_id", "src_doc", "trg_doc").join(src, "src_doc").join(trg, ["trg_doc", "tag", "n"])
            .groupBy("pair_id").agg(F.min(F.struct((-F.col("n")).alias("neg"), "tag")).alias("b"))
            .select("pair_id", F.col("b.tag").alias("tag"), (-F.col("b.neg")).alias("n")))


def eval_counts(judgements: DataFrame, by: str = "pair_id") -> DataFrame:
    """Tally of link judgements."""
    kinds = ("ok", "wrong", "parts", "dontknow")
    return judgements.groupBy(by).agg(
        *[F.count_if(F.col("judgement") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("total"))


Aligner = Callable[[DataFrame], DataFrame]
_ALIGNERS: dict[str, Aligner] = {}


def register(name: str, fn: Aligner) -> None:
    """Add an aligner: pairs with lengths → links."""
    _ALIGNERS[name] = fn


def _by_position(pairs: DataFrame) -> DataFrame:
    return one_to_one(pairs.withColumn("src_size", F.size("src_lens")).withColumn("trg_size", F.size("trg_lens")))


register("one-to-one", _by_position)
register("length", length_based)
# by length and shared words; without the overlaps of ``with_overlap`` by length alone
register("lexical", length_based)


def register_missing(name: str) -> None:
    """Name a tool that is known but not there; its pairs are aligned by length."""
    _ALIGNERS[name] = length_based


def run(pairs: DataFrame, method: str = "length") -> DataFrame:
    """Align by method name; a name that was never registered is an error."""
    if method not in _ALIGNERS:
        raise ValueError(f"no aligner is called {method}; there are {sorted(_ALIGNERS)}")
    return _ALIGNERS[method](pairs)
