"""The training-data operators on small tables, against plain versions and on awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from twinscript.llm import (common, decontaminate, fingerprints, idfiles, licences, mainpart, near, ngrams, packing, pii, queries, tokens,
                            toxicity)
from twinscript.llm.graphs import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a string, node int, score string, label string"
R = random.Random(11)
VOCABULARY = ["".join(R.choice("abcdefghijklmnoprstuvwz") for _ in range(R.randint(2, 9))) for _ in range(600)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def row(doc_id, text):
    return (doc_id, text, "en", "s", len(text or ""), "x", 1, "y", None)


BASE = prose(120, 1)
ROWS = [row(1, BASE), row(2, BASE), row(3, BASE + " tail"), row(4, prose(300, 2)), row(5, None), row(6, ""), row(7, "  \n "), row(None, prose(60, 3)),
        row(None, prose(60, 4)), row(8, prose(200, 5)), row(8, prose(200, 5)), row(8, prose(150, 6)), row(9, "one"), row(10, prose(20000, 7)),
        row(11, BASE[:len(BASE) // 2]), row(12, "é ß 中文 \U0001f600 " * 30), row(13, "moron scum trash " + prose(50, 8))]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (13, 0, 1), (13, 0, 0), (None, 1, 1), (4, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(prose(300, 2).split()[50:90])), (2, None), (3, "one"), (None, prose(30, 77)), (3, "one")], "item_id long, text string")


def by_library(text):
    return Tokenizer.from_file(tokens.default_path()).encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(messy, empty):
    pieces = packing.pack_documents(messy, tokens.default_path(), with_ids=True).collect()
    got, places = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == crc(p.ids) and p.length == len(p.ids)
        got[p.doc_id].append(p)
        places[p.sequence_id].append((p.offset, p.length))
    for doc_id, of in itertools.groupby(sorted(ROWS, key=lambda x: (x[0] is None, x[0] or 0)), key=lambda x: x[0]):
        want = collections.Counter(i for x in of for i in by_library(x[1]))
        assert collections.Counter(i for p in got[doc_id] for i in p.ids) == want
    for doc_id in (1, 4, 5, 10):
        parts = sorted(got[doc_id], key=lambda p: p.start)
        assert [i for p in parts for i in p.ids] == by_library(ROWS[[x[0] for x in ROWS].index(doc_id)][1])
        assert all(p.start == sum(q.length for q in parts[:n]) and p.doc_tokens == parts[-1].start + parts[-1].length for n, p in enumerate(parts))
    assert sorted(places) == list(range(len(places)))
    free = 0
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
        free += 0 if at & (at - 1) == 0 else 1024 - at
    assert free < 2048 and packing.pack_documents(empty, tokens.default_path()).collect() == []


def test_id_files(spark, messy, empty, tmp_path):
    folder = str(tmp_path / "ids")
    manifest = idfiles.write(messy, tokens.default_path(), folder)
    got = idfiles.lookup(messy, manifest).collect()
    want = collections.Counter((x[0], len(by_library(x[1])), crc(by_library(x[1]))) for x in ROWS)
    assert collections.Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == want
    at, last = 0, -math.inf
    for x in sorted(got, key=lambda x: x.start):
        key = -math.inf if x.doc_id is None else x.doc_id
        assert x.start == at and key >= last
        at, last = at + x.n_tokens, key
    asked = spark.createDataFrame([(4,), (4,), (123456,), (-7,)], "doc_id long")
    assert [x.doc_id for x in idfiles.lookup(asked, manifest).collect()] == [4]
    path = manifest.first().path
    f = idfiles.IdFile(path)
    first, n = f.find(np.array([10, 424242]))
    assert n.tolist() == [1, 0] and f.ids(int(first[0])).tolist() == by_library(ROWS[13][1]) if manifest.count() == 1 else True
    assert idfiles.write_and_read(spark, empty, tokens.default_path()).collect() == []


def test_hot_document_id_spreads_over_files(spark):
    rows = spark.range(2000).select(F.lit(5).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    got = idfiles.write_and_read(spark, rows, tokens.default_path()).collect()
    assert len(got) == 2000 and sorted(x.start for x in got)[-1] == sum(x.n_tokens for x in got) - max(got, key=lambda x: x.start).n_tokens


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in nodes}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def similar_classes(texts):
    of = near.Shingles()
    v, w, o = near.weighted(*of.of(pa.array(texts)))
    cut = np.searchsorted(o, np.arange(len(texts) + 1))
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = slice(cut[i], cut[i + 1]), slice(cut[j], cut[j + 1])
        if texts[i] == texts[j] or near.probability_jaccard(v[a], w[a], v[b], w[b]) >= 0.8:
            old, new = sorted((group[i], group[j]))[::-1]
            group = [new if g == old else g for g in group]
    return group


def test_near_duplicates(spark):
    r = random.Random(9)
    texts = []
    for g in range(6):
        words = prose(150, 100 + g).split()
        for _ in range(12):
            w = list(words)
            for place in r.sample(range(len(w)), r.choice([0, 1, 2, 4, 8, 20])):
                w[place] = r.choice(VOCABULARY)
            texts.append(" ".join(w))
    texts += ["", "", " ", "one", "one", "two words", "Two, words!"]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x for x in near.near_duplicates(docs).collect()}
    want = similar_classes(texts)
    assert [got[i * 3].class_id // 3 for i in range(len(texts))] == want
    sizes = collections.Counter(want)
    assert all(got[i * 3].class_size == sizes[g] for i, g in enumerate(want))


def test_blocks_of_large_buckets_lose_no_pair(spark, monkeypatch):
    words = prose(100, 55).split()
    r = random.Random(3)
    texts = []
    for _ in range(60):
        w = list(words)
        for place in r.sample(range(len(w)), 2):
            w[place] = r.choice(VOCABULARY)
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = near.nodes_of(docs, 5, 32, 7)
    buckets = near.buckets_of(nodes)
    alone = nodes.select("node", F.col("node").alias("component"))
    pairs = []
    for block in (1000, 7):
        monkeypatch.setattr(near, "BLOCK", block)
        pairs.append(sorted(tuple(sorted(p)) for p in near.open_pairs(buckets, nodes, alone, 32, 7, 0.6).collect()))
    assert pairs[0] == pairs[1] and len(set(pairs[0])) == len(pairs[0]) > 100


def test_bands_alike_in_the_sketch_alone_lose_no_pair(spark):
    # all registers agree in their sketch bytes; band 0 of the first two has different keys, so they meet in bands 1 and 2
    rows = [(1, [10, 20, 30], bytearray(21)), (2, [11, 20, 30], bytearray(21)), (3, [12, 21, 30], bytearray(21))]
    nodes = spark.createDataFrame(rows, "node long, bands array<long>, sketch binary")
    alone = nodes.select("node", F.col("node").alias("component"))
    found = near.open_pairs(near.buckets_of(nodes), nodes, alone, 3, 7, 0.6).collect()
    assert sorted(tuple(sorted(p)) for p in found) == [(1, 2), (1, 3), (2, 3)]


def test_one_of_each_class_stays(messy, empty):
    kept = near.without_copies(messy)
    assert kept.columns == messy.columns
    ids = collections.Counter(x.doc_id for x in kept.collect())
    assert ids == collections.Counter({1: 1, 4: 1, 5: 1, 7: 1, None: 2, 8: 2, 9: 1, 10: 1, 11: 1, 12: 1, 13: 1})
    assert near.without_copies(empty).collect() == [] and near.near_duplicates(empty).collect() == []
    found = near.near_duplicates(messy).collect()
    assert len(found) == len(ROWS) and {x.class_id for x in found if x.doc_id in (1, 2, 3)} == {1}


def test_near_duplicates_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(80, i // 3)) for i in range(30)], "doc_id long, text string")
    monkeypatch.setattr(near, "SENT_ROWS", 2)
    assert sorted(x.doc_id for x in near.without_copies(docs).collect()) == list(range(0, 30, 3))
    assert {x.doc_id: x.class_id for x in near.near_duplicates(docs).collect()} == {i: i // 3 * 3 for i in range(30)}


def test_benchmark_passages(messy, empty, benchmark):
    found = decontaminate.contaminated(messy, benchmark)
    rows = sorted((x.doc_id, x.item_id, x.distance) for x in found.collect())
    assert rows == [(4, 1, 0), (9, 3, 0), (9, 3, 0)]
    assert sorted(map(tuple, decontaminate.contaminated(messy, benchmark, block=1).collect())) == sorted(map(tuple, found.collect()))
    for block in (1, 5000):
        kept = decontaminate.clean(messy, benchmark, block=block)
        assert kept.columns == messy.columns
        assert collections.Counter(x.doc_id for x in kept.collect()) == collections.Counter(x[0] for x in ROWS if x[0] not in (4, 9))
    assert decontaminate.contaminated(empty, benchmark).collect() == [] and decontaminate.clean(messy, benchmark.limit(0)).count() == len(ROWS)
    assert decontaminate.contaminated(messy, benchmark.limit(0)).collect() == []


def test_disclosing_terms(spark):
    rows = [(1, "the secretname writes from box@mail.example.com every day of this week"), (2, "ask secretname at box@mail.example.com or nobody else there"),
            (3, "the day of this week for nobody else there"), (4, "every day from there ask or writes at this week of the"), (5, "box@other.example.com"),
            (6, None), (None, "secretname near BOX@mail.example.com"), (2, "ask secretname at box@mail.example.com or nobody else there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.defaultdict(list)
    for x in pii.spans(docs).collect():
        got[x.doc_id].append(x)
    assert len(got[2]) == 2 and got[2][0] == got[2][1]
    for doc_id, text in rows:
        x = got[doc_id][0]
        assert x.base_sha256 == pii.base_digest(text or "") and x.n_email == len(pii.EMAIL.findall(text or ""))
        terms = [text[int(a):int(b)] for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k == "term"]
        assert ("secretname" in terms) == (doc_id in (1, 2, None)) and not set(terms) & {"the", "day", "ask", "from"}
    masked = {x.doc_id: x.text for x in pii.sanitised(docs).collect()}
    assert masked[1] == "the [removed] writes from [email] every day of this week" and masked[6] is None and masked[3] == rows[2][1]


def test_copies_are_no_evidence(spark):
    docs = spark.createDataFrame([(i, "rareterm with me@mail.example.com here") for i in range(50)] + [(99, "with here")], "doc_id long, text string")
    assert all(x.spans.count("term") == 0 for x in pii.spans(docs).collect())


def test_personal_data_on_awkward_rows(messy, empty, monkeypatch):
    assert pii.spans(messy).count() == len(ROWS) and pii.spans(empty).collect() == []
    assert collections.Counter((x.doc_id, x.text, x.a) for x in pii.sanitised(messy).collect()) == collections.Counter((x[0], x[1], "x") for x in ROWS)
    assert pii.sanitised(empty).columns == empty.columns


def test_next_and_edited(messy, empty):
    got = sorted(fingerprints.next_and_edited(messy).collect(), key=lambda x: (x.doc_id is not None, x.doc_id or 0))
    assert len(got) == len(ROWS) and fingerprints.next_and_edited(empty).collect() == []
    assert {x.fingerprint for x in got if x.doc_id in (1, 2)} == {fingerprints.fingerprints([BASE.encode()])[0]}
    texts = {1: BASE, 2: BASE, 3: BASE + " tail", 4: ROWS[3][1], 5: "", 6: "", 9: "one", 10: ROWS[13][1], 11: ROWS[14][1], 12: ROWS[15][1]}
    for doc_id, after in ((1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (9, 10), (10, 11), (11, 12)):
        x = next(x for x in got if x.doc_id == doc_id)
        t, f = texts[doc_id], texts[after]
        edited = t[:len(t) - len(t) // 2] + f[:len(t) // 2]
        a, b, c = fingerprints.fingerprints([t.encode(), edited.encode(), f.encode()])
        assert tuple(x)[1:] == (len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, fingerprints.likeness(a, b), fingerprints.likeness(a, c))
    last = next(x for x in got if x.doc_id == 13)
    first = [x[1] for x in ROWS if x[0] is None]
    t = ROWS[16][1]
    assert last.edited_sha256 in {hashlib.sha256((t[:len(t) - len(t) // 2] + f[:len(t) // 2]).encode()).hexdigest() for f in first}


def plain_model(train, least=2, d=0.75):
    c, c2, c3 = collections.Counter(), collections.Counter(), collections.Counter()
    for w in train:
        c.update(w)
        c2.update(zip(w, w[1:]))
        c3.update(zip(w, w[1:], w[2:]))
    n = sum(c.values())
    u = sum(x == 1 for x in c.values()) / n
    k2, k3 = {k: x for k, x in c2.items() if x >= least}, {k: x for k, x in c3.items() if x >= least}
    r1, r2 = collections.defaultdict(lambda: 1.0), collections.defaultdict(lambda: 1.0)
    for (a, _), x in k2.items():
        r1[a] -= (x - d) / c[a]
    for (a, b, _), x in k3.items():
        r2[a, b] -= (x - d) / k2[a, b]

    def p(w, i):
        x = w[i]
        out = (1 - u) * c[x] / n if x in c else u
        if i >= 1:
            a = w[i - 1]
            out = (r1[a] if a in c else 1) * out + ((k2[a, x] - d) / c[a] if (a, x) in k2 else 0)
        if i >= 2:
            a, b = w[i - 2], w[i - 1]
            out = (r2[a, b] if (a, b) in k2 else 1) * out + ((k3[a, b, x] - d) / k2[a, b] if (a, b, x) in k3 else 0)
        return out

    return c, n, p


def test_ngram_scores(spark, messy, empty):
    r = random.Random(5)
    few = VOCABULARY[:40]
    texts = [" ".join(r.choice(few) for _ in range(r.randint(0, 60))) + r.choice(["", "  ", "\tEND\x0b", " NewWord%d" % i]) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    split = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(pii.LOWERED)) + [0] for t in texts]
    c, n, p = plain_model([w for i, w in enumerate(split) if i % 4])
    model = ngrams.train(docs.where("doc_id % 4 <> 0"), spark, shards=3)
    assert (model.n_tokens, model.n_words) == (n, len(c))
    for x in ngrams.score(docs, model).collect():
        w = split[x.doc_id]
        assert (x.n_tokens, x.n_known) == (len(w), sum(t in c for t in w))
        assert x.base_score == pytest.approx(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (len(c) + 1))) for t in w))
        assert abs(x.score - sum(math.log10(p(w, i)) for i in range(len(w)))) < 0.001 * len(w)
    texts_only = common.texts(messy)
    assert ngrams.score(texts_only, ngrams.train(texts_only, spark)).count() == len(ROWS)
    untrained = ngrams.train(common.texts(empty), spark)
    assert untrained.n_tokens == 0 and ngrams.score(texts_only, untrained).count() == len(ROWS) and ngrams.score(common.texts(empty), model).collect() == []


def test_registered_scores_rest_on_all_ngrams(spark, tmp_path):
    r = random.Random(6)
    texts = [" ".join(r.choice(VOCABULARY[:60]) for _ in range(r.randint(1, 40))) for _ in range(100)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    split = [t.split() + [0] for t in texts]
    c, n, p = plain_model([w for i, w in enumerate(split) if zlib.crc32(str(i).encode()) % 5 != 1], least=1)
    for x in queries.op2_score_texts(spark, str(tmp_path)).collect():
        w = split[x.doc_id]
        assert x.train_tokens == n and abs(x.score - sum(math.log10(p(w, i)) for i in range(len(w)))) < 0.001 * len(w)


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b d", "a b c", "c a b c d e", "b c a"] * 2 + ["f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = ngrams.train(docs, spark, shards=2)
    for context in ("a b", "b", "zz c", "e f"):
        asked = spark.createDataFrame([(i, f"{context} {w}".strip()) for i, w in enumerate([*"abcdef", "unknown", ""])], "doc_id long, text string")
        # the words alone: less what the context and the end give
        words = ngrams.Words()
        column = pa.array([x.text for x in asked.orderBy("doc_id").collect()])
        h, tokens_, bounds = words.of(column)
        p = 10 ** model.log10(*model.ids(h), tokens_, bounds)
        k = len(context.split())
        assert sum(p[b + k] for b in bounds[:-1]) == pytest.approx(1, abs=0.002)


def test_licences(spark, messy, empty):
    mit = ("MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files "
           "(the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, "
           "distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the "
           "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.")
    rows = [(1, mit), (2, "Nun mit. Das ist MIT."), (3, "SPDX-License-Identifier: GPL-3.0-or-later"), (4, None), (5, "foo bar\nThis work is licensed under a "
            "Creative Commons Attribution 4.0 International License."), (6, 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this '
            "file except in compliance with the License.\n"), (6, "Released under the MIT License."), (None, "Released under the MIT License.\nReleased under the MIT License."),
            (7, "RELEASED UNDER THE MIT LICENSE! İ K"), (8, "This is licensed under the sea."), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, licences.licences(docs).collect()))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    cursor = con.execute(licences.sql())
    names = [d[0] for d in cursor.description]
    assert got == sorted("Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(names, x)) + ")" for x in cursor.fetchall())
    found = {(x.doc_id, x.licence, x.rule) for x in licences.licences(docs).collect()}
    assert found == {(1, "MIT", "grant"), (1, "MIT", "title"), (3, "GPL-3.0", "spdx and name"), (5, "CC-BY-4.0", "statement"), (6, "Apache-2.0", "short header"),
                     (6, "MIT", "statement"), (None, "MIT", "statement"), (7, "MIT", "statement")}
    assert licences.licences(messy).collect() == [] and licences.licences(empty).collect() == []


def test_toxicity_learns_words(spark):
    bad, r = ["moron", "scum", "trash", "idiotish", "idiotic"], random.Random(2)
    rows = []
    for i in range(400):
        words = prose(40, 1000 + i).split()
        if i % 4 == 0:
            words[5], words[20] = r.choice(bad), r.choice(bad).upper() + "!"
        rows.append((i, " ".join(words), "en" if i % 2 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400) if i % 3], "doc_id long, toxic int")
    model = toxicity.train(common.texts(docs), labels)
    found = toxicity.score(docs, model)
    assert found.columns == ["doc_id", "text", "label", "score", "predicted", "evidence"]
    for x in found.collect():
        assert x.predicted == int(x.doc_id % 4 == 0) and 0 <= x.score <= 1 and (not x.predicted or x.evidence)
        assert all(e % 3 and zlib.crc32(str(e).encode()) % 5 for e in x.evidence)
    assert toxicity.accepted(docs, model).count() == 300 and toxicity.accepted(docs, model).columns == docs.columns


def test_only_equal_texts_of_a_label_are_left_out_of_the_examples(spark):
    common_words = " ".join(VOCABULARY[:40])
    texts = [f"{common_words} own{i} other{i * 7}" for i in range(200)] + ["left right", "right left", "left left right"]
    n = len(texts)
    # every text again under a larger id, and the first ten once more under the other label
    rows = [(i, t) for i, t in enumerate(texts)] + [(n + i, t) for i, t in enumerate(texts)] + [(2 * n + i, t) for i, t in enumerate(texts[:10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int((i % n % 3 == 0) ^ (i >= 2 * n))) for i, _ in rows], "doc_id long, toxic int")
    want = {}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5:
            want.setdefault((t, int((i % n % 3 == 0) ^ (i >= 2 * n))), i)
    sample, _ = toxicity._sample(docs, labels, 3000, 5000)
    assert sorted((x.text, x.label, x.doc_id) for x in sample.collect()) == sorted((*k, i) for k, i in want.items())


def test_toxicity_on_awkward_rows(messy, empty, labels):
    for table in (labels, labels.limit(0)):
        model = toxicity.train(common.texts(messy), table)
        found = toxicity.score(messy, model).collect()
        assert len(found) == len(ROWS) and all(0 <= x.score <= 1 for x in found)
        assert len({x.score for x in found if x.doc_id == 8}) <= 2
    assert toxicity.score(empty, model).collect() == [] and toxicity.train(common.texts(empty), labels).prior < 1


def test_pages(spark):
    page = "<nav><a>menu entry words</a></nav><article><h1>Head</h1><p>Text &eacute; of the page</p></article><footer>foot</footer>"
    pages = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, page, None), (2, "v", None, "x"), (3, "w", "", "x"), (4, "z", "<p>a<p>b", "x"),
                                   (5, "y", "<article>" + "<p>word word</p>" * 20000, "x")], "page_id long, url string, html string, text string")
    got = mainpart.main_text(pages).collect()
    assert collections.Counter((x.page_id, x.text if len(x.text) < 99 else len(x.text)) for x in got) == collections.Counter(
        {(1, "Head\nText é of the page"): 2, (None, "Head\nText é of the page"): 1, (2, ""): 1, (3, ""): 1, (4, "a\nb"): 1, (5, 199999): 1})
    assert all(x.n_chars == len(x.text) for x in got) and mainpart.main_text(pages.limit(0)).collect() == []


def test_pipeline_stages(messy, empty, spark, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (messy, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
                path = str(tmp_path / f"{name}-{docs is messy}-{out.count()}")
                out.write.mode("overwrite").parquet(path)
                docs = spark.read.parquet(path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_pipeline_on_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = common.table(spark, folder, "documents")
    texts = {x.doc_id: x.text for x in docs.collect()}
    toxic = {x.doc_id: x.predicted for x in queries.op10_toxicity(spark, folder).collect()}
    kept = corpus_pipeline.without_toxic(spark, docs, folder)
    left = sorted(x.doc_id for x in kept.select("doc_id").collect())
    assert left == sorted(i for i in texts if not toxic[i])
    unique = corpus_pipeline.without_copies(spark, kept, folder)
    group = similar_classes([texts[i] for i in left])
    first = sorted({left[g] for g in group})
    assert sorted(x.doc_id for x in unique.select("doc_id").collect()) == first
    clean = sorted(x.doc_id for x in corpus_pipeline.without_benchmark(spark, unique, folder).collect())
    items = [" ".join(decontaminate.words(x.text)) for x in common.table(spark, folder, "benchmark").collect()]
    verbatim = {i for i in first if any(t in " ".join(decontaminate.words(texts[i])) for t in items)}
    assert not verbatim & set(clean) and len(clean) >= len(first) - 2 * len(verbatim) - 2
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted({x.doc_id for x in rows}) == clean


def test_contracts_on_given_tables(spark):
    assert set(queries.SQL) <= set(queries.QUERIES) and {re.match(r"op(\d+)_", q)[1] for q in queries.QUERIES} == {str(n) for n in range(1, 14)}
