"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

* **Examples**: a bounded sample of the labelled rows of the training folds (``positives`` and ``negatives``,
  smallest hash of the id first), equal texts of a label kept once.
* **Terms**: words and the first letters of words that occur significantly more often in toxic examples, by a
  likelihood ratio with Bonferroni's bound over all terms tried.  Everything else of a text says
  nothing about the label and only blurs distances.  At most ``terms`` terms.
* **Index**: examples with like vectors lie side by side in blocks; for each term the largest weight in a
  block is kept.  A query adds these up to a bound per block and opens blocks, best bound first,
  until no bound exceeds its k-th score, which is exact.
* **Score**: neighbours vote by similarity, weighted so that the sample's classes count as in all labels;
  an isotonic fit over the examples, each asked without itself, turns votes into probabilities.
  A text without any term has no neighbour and gets the share of toxic ones among such examples.

The index is bounded by these parameters and goes to all tasks; texts are read once, where they lie.
A missing text is empty, a missing id stays missing, repeated rows get equal scores.  Without any
toxic label every text gets the same low score.  Labels that contradict each other count as toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinscript.llm import common
from twinscript.session import cut_lineage

LETTERS = re.compile(r"[^\W\d_]+")
STARTS = (4, 5, 6)
ALPHA = 0.05
KEPT = 200_000


def terms_of(word: str) -> list[str]:
    """Terms of a piece between blanks: its words, and how longer ones start."""
    out = []
    for w in LETTERS.findall(word.lower()):
        out.append(w)
        out.extend("^" + w[:n] for n in STARTS if len(w) > n)
    return out


def _distinct_words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces between blanks, the piece at each place, and the text of each place."""
    cut = pc.ascii_split_whitespace(common.compact(column))
    words = cut.flatten().dictionary_encode()
    sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
    return words.dictionary.to_pylist(), words.indices.to_numpy(), np.repeat(np.arange(len(column)), sizes)


class Vectors:
    """Term counts of texts for a fixed list of terms."""

    def __init__(self, terms: list[str]):
        self.ids = {t: i for i, t in enumerate(terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def _ids(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            found = self.known[word] = tuple(self.ids[t] for t in terms_of(word) if t in self.ids)
        return found

    def counts(self, column: pa.Array) -> dict[int, Counter]:
        """By place in the column, for texts with any term."""
        words, at, row = _distinct_words(column)
        of = [self._ids(w) for w in words]
        some = np.array([bool(x) for x in of], dtype=bool)
        out: dict[int, Counter] = {}
        for place in np.flatnonzero(some[at]) if len(of) else ():
            out.setdefault(int(row[place]), Counter()).update(of[at[place]])
        return out


class BlockMaxIndex:
    """Exact top-k by inner product over sparse unit vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = 64):
        lead = [int(t[np.argmax(w)]) if len(t) else n_terms for t, w in vectors]
        self.order = np.array(sorted(range(len(vectors)), key=lambda i: (lead[i], i)), dtype=np.int64)
        self.block, self.n = block, len(vectors)
        term = np.concatenate([np.zeros(0, np.int64), *[vectors[i][0] for i in self.order]]).astype(np.int64)
        weight = np.concatenate([np.zeros(0), *[vectors[i][1] for i in self.order]])
        row = np.repeat(np.arange(self.n), [len(vectors[i][0]) for i in self.order])
        by = np.lexsort((row, term))
        self.row, self.weight, term = row[by], weight[by], term[by]
        # a run: the postings of one term in one block
        key = term * (self.n // block + 1) + self.row // block
        self.run = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
        self.run_block = self.row[self.run] // block
        self.run_max = np.maximum.reduceat(self.weight, self.run) if len(self.run) else np.zeros(0)
        self.run_end = np.append(self.run[1:], len(self.row))
        self.first = np.searchsorted(term[self.run], np.arange(n_terms + 1))

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k best (score, example), best first, of those above zero; of equal ones those met first."""
        bound = np.zeros(self.n // self.block + 1)
        runs = [(slice(self.first[t], self.first[t + 1]), w) for t, w in zip(terms, weights, strict=True)]
        for s, w in runs:
            bound[self.run_block[s]] += w * self.run_max[s]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) >= k and bound[b] <= best[-1][0] + 1e-12:
                break
            score = np.zeros(self.block)
            for s, w in runs:
                at = s.start + int(np.searchsorted(self.run_block[s], b))
                if at < s.stop and self.run_block[at] == b:
                    r = slice(self.run[at], self.run_end[at])
                    score[self.row[r] - b * self.block] += w * self.weight[r]
            for i in np.flatnonzero(score > 0):
                example = int(self.order[b * self.block + i])
                if example != without:
                    best.append((float(score[i]), example))
            best.sort(key=lambda x: -x[0])
            del best[k:]
        return best


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps through (x, y) by pooling neighbours; each pool's level counts half a case of either label more."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        if pools and pools[-1][3] == x[i]:
            p = pools[-1]
            p[0] += w[i] * y[i]
            p[1] += w[i]
        else:
            pools.append([w[i] * y[i], w[i], x[i], x[i]])
    out: list[list[float]] = []
    for p in pools:
        out.append(p)
        while len(out) > 1 and out[-2][0] * out[-1][1] >= out[-1][0] * out[-2][1]:
            b = out.pop()
            a = out[-1]
            out[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    level = [(p[0] + 0.5) / (p[1] + 1) for p in out]
    return np.array([e for p in out for e in (p[2], p[3])]), np.maximum.accumulate(np.repeat(level, 2))


class Model:
    """Terms, their weights, the index with its examples' labels, and the calibration."""

    def __init__(self, terms, idf, examples, k, weights, prior):
        self.vectors, self.idf, self.k, self.prior = Vectors(terms), np.array(idf), k, prior
        self.ids = [e[0] for e in examples]
        self.label = np.array([e[1] for e in examples], dtype=float)
        self.share = np.array([weights[int(y)] for y in self.label]) if examples else np.zeros(0)
        found = [self.unit(e[2]) for e in examples]
        self.index = BlockMaxIndex(found, len(terms))
        some = [i for i, (t, _) in enumerate(found) if len(t)]
        votes = [self.vote(self.index.top(*found[i], k, without=i)) for i in some]
        none = [i for i, (t, _) in enumerate(found) if not len(t)]
        if none:
            s = self.share[none]
            self.prior = float((s * self.label[none]).sum() + 0.5 * prior) / float(s.sum() + 0.5)
        heard = [j for j, v in enumerate(votes) if v is not None]
        at = [some[j] for j in heard]
        self.steps = isotonic(np.array([votes[j] for j in heard]), self.label[at], self.share[at]) if heard else None
        self.asked: dict[tuple, tuple[float, list[int]]] = {}

    def unit(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(sorted(counts), dtype=np.int64)
        w = np.array([1 + np.log(counts[i]) for i in t]) * self.idf[t] if len(t) else np.zeros(0)
        return t, w / np.linalg.norm(w) if len(t) else w

    def vote(self, best: list[tuple[float, int]]) -> float | None:
        if not best:
            return None
        s = np.array([b[0] for b in best]) * self.share[[b[1] for b in best]]
        return float((s * self.label[[b[1] for b in best]]).sum() / s.sum())

    def score(self, counts: Counter | None) -> tuple[float, list[int]]:
        """Probability of the label, and the neighbours it rests on, nearest first."""
        if not counts:
            return self.prior, []
        key = tuple(sorted(counts.items()))
        if key not in self.asked:
            if len(self.asked) >= KEPT // 4:
                self.asked.clear()
            best = self.index.top(*self.unit(counts), self.k)
            vote = self.vote(best)
            # a term of no example left in the index cannot be: terms are chosen from the examples
            p = self.prior if vote is None or self.steps is None else float(np.interp(vote, *self.steps))
            self.asked[key] = (p, [self.ids[e] for _, e in best])
        return self.asked[key]


def _sample(docs: DataFrame, labels: DataFrame, positives: int, negatives: int) -> tuple[DataFrame, dict[int, int]]:
    """Labelled rows of the training folds with their texts, equal texts of a label once, and the sizes of both classes."""
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
             .where(common.fold("doc_id") != 0).select("doc_id", F.col("label").cast("int").alias("label")))
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = (known.where("label = 1").orderBy(*order).limit(positives)
              .unionByName(known.where("label = 0").orderBy(*order).limit(negatives)))
    found = docs.join(F.broadcast(chosen), "doc_id")
    # two hashes of the text, 128 bits in all: of equal texts of a label the smallest doc_id stays
    once = found.groupBy(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), F.col("text")).alias("b"), "label").agg(
        F.min(F.struct("doc_id", "text")).alias("k"))
    return cut_lineage(once.select("k.doc_id", "k.text", "label")), sizes


def _term_counts(sample: DataFrame, label: int, least: int, only: list[str] | None = None) -> dict[str, int]:
    """Number of examples of a label with each term, for terms of at least ``least`` examples; counted per task first."""
    wanted = set(only) if only is not None else None

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in common.pieces(batches):
            for text in b.column(0).to_pylist():
                found = {t for w in set(text.split()) for t in terms_of(w)}
                total.update(found if wanted is None else found & wanted)
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    counted = (sample.where(F.col("label") == label).select("text").mapInArrow(count, "term string, n bigint")
               .groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    return dict(counted.collect())


def train(docs: DataFrame, labels: DataFrame, positives: int = 3000, negatives: int = 5000,
          terms: int = 20_000, k: int = 15) -> Model:
    """Learn from the rows outside the held-out fold; ``docs`` as given by ``common.texts``."""
    sample, sizes = _sample(docs, labels, positives, negatives)
    n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    total = sum(sizes.values())
    prior = (sizes.get(1, 0) + 0.5) / (total + 2)
    toxic = _term_counts(sample, 1, 3)
    clean = _term_counts(sample, 0, 1, list(toxic)) if toxic else {}
    pi = n.get(1, 0) / max(1, sum(n.values()))
    least = 2 * np.log(max(1, len(toxic)) / ALPHA)

    def ratio(t: str) -> float:
        a, b = toxic[t], clean.get(t, 0)
        share = a / (a + b)
        if share <= pi:
            return 0.0
        return 2 * (a * np.log(share / pi) + (b * np.log((1 - share) / (1 - pi)) if b else 0.0))

    kept = sorted((t for t in toxic if ratio(t) > least), key=lambda t: (-ratio(t), t))[:terms]
    everything = sum(n.values())
    idf = [1 + np.log((1 + everything) / (1 + toxic[t] + clean.get(t, 0))) for t in kept]

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Vectors(kept)
        for b in common.pieces(batches):
            found = of.counts(b.column(1))
            rows = [found.get(i, {}) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0), "label": b.column(2), "t": pa.array([list(r) for r in rows], pa.list_(pa.int32())),
                "n": pa.array([list(r.values()) for r in rows], pa.list_(pa.int32()))})

    # at most as many rows as the sample, with terms of the list alone
    rows = sorted(sample.mapInArrow(vectors, "doc_id bigint, label int, t array<int>, n array<int>").collect())
    weights = {y: sizes.get(y, 0) / n[y] for y in n}
    return Model(kept, idf, [(r.doc_id, r.label, Counter(dict(zip(r.t, r.n, strict=True)))) for r in rows], k, weights, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``evidence`` (ids of the nearest examples); other columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted", "evidence")]
    # a name that the schema may hold only once
    given, = common.free(names, "_text")
    table = docs.select(*names, F.coalesce(F.col("text"), F.lit("")).alias(given))
    schema = table.drop(given).schema
    for name, kind in (("score", T.DoubleType()), ("predicted", T.IntegerType()), ("evidence", T.ArrayType(T.LongType()))):
        schema = schema.add(name, kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in common.pieces(batches, given):
            found = m.vectors.counts(b.column(len(names)))
            out = [m.score(found.get(i)) for i in range(b.num_rows)]
            p = np.clip([o[0] for o in out], 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(names)], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32()),
                 pa.array([o[1] for o in out], pa.list_(pa.int64()))], names=[*names, "score", "predicted", "evidence"])

    return table.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns are kept as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in common.pieces(batches):
            found = m.vectors.counts(b.column(at).fill_null(""))
            yield b.filter(pa.array([m.score(found.get(i))[0] < threshold for i in range(b.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
