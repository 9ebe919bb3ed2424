"""Language identification by ranked character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinscript.session import spread

# N-gram sizes, ranks kept, near-best factor and most alternatives.
LONGEST, TOP, NEAR, ALTERNATIVES = 5, 400, 1.05, 10
UNKNOWN = "unknown"


def sample_text(text: Column, margin: Column) -> Column:
    """A text without ``margin`` characters at both ends, where page furniture is likely."""
    return F.substring(text, margin + 1, F.greatest(F.length(text) - 2 * margin, F.lit(0)))


def ngrams(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, ngram, n``: 1–5-grams of each word, with ``_`` at both ends.

    Words are counted first, so n-grams are cut once per distinct word and key, not per
    occurrence.
    """
    words = df.select(*keys, F.explode(F.split(text, r"[0-9\s]+")).alias("word")).where("word != ''")
    counted = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("w"))
    # distinct words are few bytes, the n-grams cut from them are not
    counted = spread(counted, *keys, "word")
    padded = counted.select(*keys, "w", F.concat(F.lit("_"), "word", F.lit("_")).alias("word"))
    starts = padded.select(*keys, "w", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    longest = starts.select(*keys, "w", F.substring(F.col("word"), F.col("i"), F.lit(LONGEST)).alias("g"))
    heads = F.slice(F.array(*[F.substring("g", 1, k) for k in range(1, LONGEST + 1)]), F.lit(1), F.length("g"))
    return (longest.select(*keys, "w", F.explode(heads).alias("ngram"))
            .groupBy(*keys, "ngram").agg(F.sum("w").alias("n")))


def rank(counts: DataFrame, keys: list[str], top: int = TOP) -> DataFrame:
    """The ``top`` n-grams of each key, most frequent first, equal counts by n-gram.

    Spark cuts each task's rows to ``top`` per key before the shuffle, so a language with a third
    of all n-grams sends at most ``top`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("ngram"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def train(texts: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, ngram, rank`` models from texts of known language."""
    return rank(ngrams(texts, [lang], text), [lang]).select(F.col(lang).alias("lang"), "ngram", "rank")


# a model holds TOP n-grams, and there are fewer than 8,000 language codes
MOST_MODEL_ROWS = 8000 * TOP


def _model_table(models: DataFrame) -> tuple[list[str], dict[str, int], np.ndarray]:
    """Models as a matrix of ranks, n-grams by languages; 0 where a model lacks the n-gram."""
    rows = models.select("lang", "ngram", "rank").limit(MOST_MODEL_ROWS + 1).collect()
    if len(rows) > MOST_MODEL_ROWS:
        raise ValueError("these are no language models: more rows than languages times ranks")
    langs = sorted({r["lang"] for r in rows})
    grams = {g: i for i, g in enumerate(sorted({r["ngram"] for r in rows}))}
    ranks = np.zeros((len(grams), len(langs)), np.int32)
    column = {lang: i for i, lang in enumerate(langs)}
    for r in rows:
        ranks[grams[r["ngram"]], column[r["lang"]]] = r["rank"]
    return langs, grams, ranks


_SPLIT = re.compile(r"[0-9\s]+", re.ASCII)


@lru_cache(maxsize=50_000)
def word_ngrams(word: str) -> tuple[str, ...]:
    w = f"_{word}_"
    return tuple(w[i:i + n] for n in range(1, min(LONGEST, len(w)) + 1) for i in range(len(w) - n + 1))


def top_ngrams(text: str) -> list[str]:
    """The ranked n-grams of one text, as ``rank`` orders them."""
    words = filter(None, _SPLIT.split(text))
    counts = Counter(chain.from_iterable(map(word_ngrams, words)))
    least = sorted(counts.values(), reverse=True)[TOP - 1] if len(counts) > TOP else 0
    return [g for _, g in sorted([(-n, g) for g, n in counts.items() if n >= least])[:TOP]]


# words whose n-grams are counted together, a text at least
TOGETHER = 1 << 17


def _together(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts in order, some at a time: their words, and how many each has."""
    words, sizes = [], []
    for text in texts:
        own = [w for w in _SPLIT.split(text) if w]
        if sizes and len(words) + len(own) > TOGETHER:
            yield words, np.array(sizes)
            words, sizes = [], []
        words += own
        sizes.append(len(own))
    if sizes:
        yield words, np.array(sizes)


def _cut(words: list[str], grams: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of all words as places in alphabetical order, how many each word has, and which of ``grams`` each is (-1 if none)."""
    padded = [f"_{w}_" for w in words]
    signs, code = np.unique(np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
    base = len(signs) + 1
    if base ** LONGEST >= 1 << 63:
        cut = [word_ngrams(w) for w in words]
        names = sorted(set(chain.from_iterable(cut)))
        place = {g: i for i, g in enumerate(names)}
        return (np.array([place[g] for own in cut for g in own], np.int64), np.array([len(own) for own in cut], np.int64),
                np.array([grams.get(g, -1) for g in names], np.int64))
    # an n-gram is a number with a digit per sign, and zeros behind, so numbers have the order of n-grams
    size = np.array([len(w) for w in padded], np.int64)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))
    digits = np.concatenate([code + 1, np.zeros(LONGEST, np.int64)])
    found, total = np.zeros((len(code), LONGEST), np.int64), np.zeros(len(code), np.int64)
    for k in range(LONGEST):
        total = total + digits[k:k + len(code)] * base ** (LONGEST - 1 - k)
        found[:, k] = total
    names, flat = np.unique(found[np.arange(LONGEST) < left[:, None]], return_inverse=True)
    ends = np.cumsum(np.minimum(left, LONGEST))[np.cumsum(size) - 1] if len(size) else np.zeros(0, np.int64)
    model = np.full(len(names), -1, np.int64)
    known = {int(c): d + 1 for d, c in enumerate(signs)}
    for gram, number in grams.items():
        own = [known.get(ord(c), 0) for c in gram]
        if all(own) and 0 < len(own) <= LONGEST:
            want = sum(d * base ** (LONGEST - 1 - k) for k, d in enumerate(own))
            at = int(np.searchsorted(names, want))
            if at < len(names) and names[at] == want:
                model[at] = number
    return flat, np.diff(ends, prepend=0), model


def _rated(words: list[str], sizes: np.ndarray, grams: dict[str, int], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each text to each model, and whether they share an n-gram.

    The n-grams of a text are ranked as by ``top_ngrams``; those of all texts are counted by sorting one array of numbers.
    """
    numbers: dict[str, int] = {}
    code = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    flat, n, model = _cut(list(numbers), grams)
    total, n_names = len(sizes), max(1, len(model))

    def split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted numbers once each, and how often."""
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        return keys[starts], np.diff(np.append(starts, len(keys)))

    text = np.repeat(np.arange(total), sizes)
    each = n[code] if len(code) else np.zeros(0, np.int64)
    first = (np.cumsum(n) - n)[code] if len(code) else np.zeros(0, np.int64)
    at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each - first, each)
    keys, count = split(np.sort(np.repeat(text, each) * n_names + flat[at]))
    text, gram = keys // n_names, keys % n_names
    most = int(count.max(initial=0)) + 1
    # by text, then the most frequent first, equal ones by n-gram
    order = np.sort((text * most + (most - 1 - count)) * n_names + gram)
    text, gram = order // (most * n_names), order % n_names
    have = np.bincount(text, minlength=total)
    rank = np.arange(len(order)) - (np.cumsum(have) - have)[text] + 1
    known = np.flatnonzero((rank <= TOP) & (model[gram] >= 0)) if len(order) else np.zeros(0, int)
    theirs, text = ranks[model[gram[known]]], text[known]
    saved, seen = np.zeros((total, ranks.shape[1]), np.int64), np.zeros((total, ranks.shape[1]), bool)
    if len(known):
        starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        saved[text[starts]] = np.add.reduceat(np.where(theirs > 0, TOP - np.abs(theirs - rank[known][:, None]), 0), starts, axis=0)
        seen[text[starts]] = np.maximum.reduceat(theirs, starts, axis=0) > 0
    return np.minimum(have, TOP)[:, None] * TOP - saved, seen


_DISTANCES = T.ArrayType(T.StructType([T.StructField("distance", T.LongType()), T.StructField("model", T.StringType())]))


def _measured(texts: DataFrame, models: DataFrame, text: str) -> Column:
    """``array<distance, model>`` of a text against every model it shares an n-gram with, nearest first.

    The models are small by construction (their size is checked) and go to every task, so texts are
    rated where they are read: nothing is shuffled, whatever the sizes of texts or languages.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_model_table(models))

    @F.pandas_udf(_DISTANCES)
    def measure(column: pd.Series) -> pd.Series:
        langs, grams, ranks = shared.value
        out = []
        for words, sizes in _together([value or "" for value in column]):
            for far, seen in zip(*_rated(words, sizes, grams, ranks), strict=True):
                out.append(sorted(({"distance": int(far[i]), "model": langs[i]} for i in np.flatnonzero(seen)),
                                  key=lambda d: (d["distance"], d["model"])))
        return pd.Series(out)

    # so marked, the plan keeps one call per text instead of one per use of its result
    return measure.asNondeterministic()(text)


def distances(texts: DataFrame, keys: list[str], models: DataFrame, text: str = "text") -> DataFrame:
    """Out-of-place distance of each text to each model: rank differences, ``TOP`` if unseen."""
    rated = texts.select(*keys, F.explode(_measured(texts, models, text)).alias("d"))
    return rated.select(*keys, "d.model", "d.distance")


def classify(texts: DataFrame, keys: list[str], models: DataFrame, text: str = "text") -> DataFrame:
    """``keys, candidates, detected, confidence``: the languages within 5 % of the best, nearest first.

    With more than ten of them, or if a text shares no n-gram with any model, the language is
    unknown.  The confidence is how much nearer the best is than the second, as a share of the
    second's distance; 1 if there is no second, 0 if the language is unknown.  ``keys`` may name any columns to keep.
    """
    rated = texts.select(*keys, _measured(texts, models, text).alias("_d"))
    best, second = F.get("_d", F.lit(0))["distance"], F.get("_d", F.lit(1))["distance"]
    near = F.transform(F.filter("_d", lambda d: (d["distance"] < F.lit(NEAR) * best) | (d["distance"] == best)),
                       lambda d: d["model"])
    unclear = (F.size(near) > ALTERNATIVES) | (F.size(near) == 0)
    sure = F.when(unclear, 0.0).when(second.isNull(), 1.0).when(second > 0, 1 - best / second).otherwise(0.0)
    return rated.select(*keys, F.when(unclear, F.array(F.lit(UNKNOWN))).otherwise(near).alias("candidates"),
                        sure.alias("confidence")).withColumn("detected", F.element_at("candidates", 1))


def resolve(classified: DataFrame, declared: str = "lang") -> DataFrame:
    """The declared language if it is among the near-best, else the best; ``xx`` if none is known."""
    best = F.when(F.col("detected") != UNKNOWN, F.col("detected"))
    keep = F.array_contains("candidates", F.col(declared)) | best.isNull()
    return classified.withColumn("language", F.coalesce(
        F.when(keep, F.col(declared)), best, F.lit("xx")))


def flags(sentences: DataFrame, keys: list[str], models: DataFrame, lang: str = "lang",
          text: str = "text") -> DataFrame:
    """Sentences whose language differs from their document's, with the detected one and how sure that is."""
    found = classify(sentences, [*keys, lang], models, text)
    return found.where(F.col("detected") != F.col(lang)).select(*keys, lang, "detected", "confidence")


def link_flags(flagged: DataFrame, pairs: DataFrame) -> DataFrame:
    """``flags`` of sentences ``(doc_id, sent_pos)`` as ``align.filter_lang`` takes them, for the pairs their documents are in."""
    def side(name: str) -> DataFrame:
        return pairs.select("pair_id", F.col(f"{name}_doc").alias("doc_id")).join(flagged, "doc_id").select(
            "pair_id", F.lit(name).alias("side"), F.col("sent_pos").alias("sent_id"), "detected")
    return side("src").unionByName(side("trg"))


_CLASSIFIERS: dict[str, Callable[..., DataFrame]] = {"ngrams": classify}


def register(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add a classifier with the signature of ``classify``."""
    _CLASSIFIERS[name] = fn


def detect(name: str, *args, **kwargs) -> DataFrame:
    """Classify by name; a name that was never registered is an error."""
    if name not in _CLASSIFIERS:
        raise ValueError(f"no classifier is called {name}; there are {sorted(_CLASSIFIERS)}")
    return _CLASSIFIERS[name](*args, **kwargs)
