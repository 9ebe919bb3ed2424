"""Words of two documents meet by pair, without a row per word and pair."""

import collections
import random

from twinscript.operators import align, meeting


def _tables(spark, seed=3):
    rng = random.Random(seed)
    docs = {d: [[rng.choice(["one", "two", "three", "four", "fünf", "sixes", None]) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 30))] for d in range(12)}
    pairs = [(f"p{k}", a, b, len(docs[a]), len(docs[b])) for k, (a, b) in enumerate((rng.randrange(12), rng.randrange(12)) for _ in range(20))]
    words = [(d, i + 1, w) for d, text in docs.items() for i, s in enumerate(text) for w in dict.fromkeys(s)]
    return (words, pairs, spark.createDataFrame(words, "doc bigint, sent_pos bigint, word string"),
            spark.createDataFrame([*pairs, (None, 1, 2, 3, 4), ("gone", 99, 1, 5, 5)], "pair_id string, src_doc bigint, trg_doc bigint, src_size bigint, trg_size bigint"))


def test_overlap_is_that_of_nested_loops(spark, monkeypatch):
    monkeypatch.setattr(meeting, "WORDS", 40)
    monkeypatch.setattr(meeting, "HITS", 7)
    words, pairs, w, p = _tables(spark)
    n = collections.Counter((d, i) for d, i, _ in words)
    for band in (3, 50):
        hits = collections.Counter((k, i, j, n[a, i], n[b, j]) for k, a, b, x, y in pairs for d, i, u in words if d == a and u
                                   for e, j, v in words if e == b and u == v and abs(i * (y / max(x, 1)) - j) <= band)
        want = {k[:3]: m / max(k[3:]) for k, m in hits.items()}
        found = align.sentence_overlap(w, p, band=band)
        got = {(r["pair_id"], r["i"], r["j"]): r["overlap"] for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert "Generate explode(array((" not in found._jdf.queryExecution().toString()


def test_anchors_are_those_of_nested_loops(spark, monkeypatch):
    monkeypatch.setattr(meeting, "WORDS", 40)
    monkeypatch.setattr(meeting, "HITS", 7)
    words, pairs, w, p = _tables(spark, seed=5)
    want = set()
    for k, a, b, _, _ in pairs:
        last = 0
        for i in range(1, 40):
            hits = [(abs(i - j), j, u) for d, x, u in words if d == a and x == i and u and len(u) >= 4 for e, j, v in words if e == b and u == v and abs(i - j) < 5]
            if hits:
                _, j, u = min(hits)
                if j > last:
                    want.add((k, i, j, u))
                last = max(last, j)
    for trg in (w, w.select("*")):
        assert {tuple(r) for r in align.anchors(w, trg, p, letters=4).collect()} == want
