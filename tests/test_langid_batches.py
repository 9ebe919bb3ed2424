"""Texts are rated many at a time, as each would be alone."""

import random

import numpy as np

from twinscript.operators import langid


def test_rated_together_as_alone(monkeypatch):
    monkeypatch.setattr(langid, "TOGETHER", 60)
    rng = random.Random(8)
    many = "".join(chr(c) for c in range(0x4e00, 0x4e00 + 7000))  # too many signs for numbers
    texts = ["", "7 8", "a\U0001f600b é", " ".join(many[i:i + 50] for i in range(0, 7000, 50)), *(" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 200))) for _ in range(25))]
    names = sorted({g for t in texts for g in langid.top_ngrams(t)[:30]})
    grams = {g: i for i, g in enumerate(rng.sample(names, len(names) // 2))}
    ranks = np.array([[rng.choice([0, rng.randint(1, 400)]) for _ in range(3)] for _ in grams], np.int32)
    rows = [row for words, sizes in langid._together(texts) for row in zip(*langid._rated(words, sizes, grams, ranks), strict=True)]
    assert len(rows) == len(texts)
    for text, (far, seen) in zip(texts, rows, strict=True):
        mine = langid.top_ngrams(text)
        known = [(ranks[grams[g]], r) for r, g in enumerate(mine, 1) if g in grams]
        for k in range(3):
            assert far[k] == len(mine) * 400 - sum(400 - abs(a[k] - r) for a, r in known if a[k])
            assert seen[k] == any(a[k] for a, _ in known)


def test_texts_are_not_ranked_one_by_one(spark, monkeypatch):
    def fail(text):
        raise AssertionError("ranked alone")
    models = spark.createDataFrame([("en", "t", 1), ("en", "h", 2), ("fr", "t", 2)], "lang string, ngram string, rank int")
    monkeypatch.setattr(langid, "top_ngrams", fail)
    got = langid.distances(spark.createDataFrame([(1, "t h"), (2, "x")], "doc int, text string"), ["doc"], models).collect()
    # "_" and "_t", "_t_" and so on come before or after; both texts have ranks of their own
    assert {(r["doc"], r["model"]) for r in got} == {(1, "en"), (1, "fr")}
