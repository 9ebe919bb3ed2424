"""Phrases, repeated lines and the manifest against plain versions, and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinscript.llm import common, lines, merkle, near, phrases, pii, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, i long, row string, digest string, `_A` int, key string, word long"
R = random.Random(3)
WORDS = ["alpha", "Beta", "GAMMA", "über", "d", "x y", "z1", "é"]


def row(doc_id, text, lang="en", n_chars=7):
    return (doc_id, text, lang, "s" if doc_id else None, n_chars, "g", 5, "r", "d", 1, "k", 2)


def prose(n, r):
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " \x0b"]) for _ in range(n))


PASSAGE = "the same passage stands here again"
ROWS = [row(i, prose(R.choice([0, 3, 40, 200]), R) + (PASSAGE if i % 2 else ""), R.choice(["en", "de", None, "und", ""])) for i in range(60)]
ROWS += [row(None, "alpha beta"), row(None, "alpha beta"), row(7, None), row(7, ""), row(7, "alpha beta", None, None), row(8, PASSAGE), row(8, PASSAGE),
         row(9, "word " * 30000, "en", None), row(-5, "line\n" * 3000 + "Line \nother")]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# -- phrases ---------------------------------------------------------------------------------

def plain_phrases(rows, least, share, top):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(r[1])):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= share * f[p[i:i + k]]:
                        gone.add(p[i:i + k])
        rated = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least, share, top", [(2, 80, 2000), (3, 101, 7), (30, 80, 2000)])
def test_phrases_are_those_a_full_count_finds(messy, least, share, top):
    got = sorted(map(tuple, phrases.collocations(messy, least, share, top).collect()))
    assert got == plain_phrases(ROWS, least, share, top)


def test_no_phrases_without_words(spark, empty):
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([row(1, " \n. "), row(2, None)], SCHEMA)).collect() == []


def test_partitions_of_any_size(monkeypatch):
    r = np.random.default_rng(5)
    for small in (1, 8, 1 << 15):
        monkeypatch.setattr(phrases, "SMALL", max(small, 100))
        for n, width in ((0, 3), (1, 3), (5000, 3), (3000, 40)):
            columns = [r.integers(0, width, n).astype(np.uint64) for _ in range(3)]
            columns[2][r.random(n) < 0.3] = phrases.END
            weights = r.integers(1, 4, n)
            want = collections.Counter()
            for i in range(n):
                key = ()
                for d in range(3):
                    if columns[d][i] == phrases.END:
                        break
                    key += (int(columns[d][i]),)
                    want[key] += int(weights[i])
            got = {}
            for depth, at, size in phrases.partitions(columns, weights, 30):
                for a, s in zip(at, size, strict=True):
                    got[tuple(int(columns[d][a]) for d in range(depth + 1))] = int(s)
            assert got == {k: v for k, v in want.items() if v >= 30}


def test_words_and_their_pieces():
    texts = ["a B, c\td", "", "É x.y", "e"]
    coded, piece = phrases.cut_words(pa.array(["zz", *texts], pa.string()).slice(1))
    assert coded.dictionary.take(coded.indices).to_pylist() == ["a", "b", "c", "d", "É", "x", "y", "e"]
    same = [int(p) for p in piece]
    assert same[0] == same[1] != same[2] == same[3] and same[4] == same[5] != same[6] != same[7] and same[3] != same[4]


# -- lines -----------------------------------------------------------------------------------

def plain_lines(rows, min_docs, min_chars, keep_first):
    def key(line):
        return lowered(line.strip(" \t\n\x0b\x0c\r"))
    docs = collections.Counter()
    for r in rows:
        docs.update({key(x) for x in (r[1] or "").split("\n")})
    gone = {k for k, n in docs.items() if n >= min_docs and len(k) >= min_chars}
    seen, out = set(), []
    # rows of one id and text are the same document for the reader: which of them keeps a line makes no difference
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        kept = []
        for line in (r[1] or "").split("\n"):
            k = key(line)
            if k not in gone or (keep_first and k not in seen):
                kept.append(line)
            if k in gone:
                seen.add(k)
        n = len((r[1] or "").split("\n"))
        out.append((r[0], "\n".join(kept), n, n - len(kept)))
    return collections.Counter(out)


UNIQUE = [r for k, r in enumerate(ROWS) if r[0] not in {x[0] for x in ROWS[:k]}]


@pytest.mark.parametrize("min_docs, min_chars, keep_first", [(10, 1, False), (2, 1, False), (3, 6, False), (2, 1, True), (2, 0, True)])
def test_repeated_lines(spark, messy, min_docs, min_chars, keep_first):
    rows, docs = (UNIQUE, spark.createDataFrame(UNIQUE, SCHEMA).repartition(4)) if keep_first else (ROWS, messy)
    got = lines.without_repeated_lines(docs, min_docs, min_chars, keep_first)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert collections.Counter(map(tuple, got.collect())) == plain_lines(rows, min_docs, min_chars, keep_first)


def test_repeated_lines_of_equal_rows(spark):
    rows = [row(3, "a\nb"), row(3, "a\nb"), row(3, "b\na"), row(None, "b")]
    got = lines.without_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert collections.Counter(x for r in got for x in r.text.split("\n") if x) == {"a": 1, "b": 1} and sum(r.n_dropped for r in got) == 5
    assert lines.without_repeated_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        lines.without_repeated_lines(spark.createDataFrame([], SCHEMA), min_docs=1)


def test_a_line_of_every_document_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(lines, "PER_SHARD", 50)
    rows = [row(i, f"own {i}\nshared\npair {i // 2}") for i in range(300)]
    got = lines.without_repeated_lines(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    want = {i: f"own {i}" + ("\nshared" if i == 0 else "") + (f"\npair {i // 2}" if i % 2 == 0 else "") for i in range(300)}
    assert {r.doc_id: r.text for r in got} == want


def test_a_filter_denies_nothing_it_was_given():
    r = np.random.default_rng(1)
    hashes = r.integers(0, 1 << 63, 20000, dtype=np.uint64)
    bloom = lines.Bloom(10000)
    bloom.add(hashes[:10000])
    packed = lines.PackedBloom(pa.py_buffer(bloom.packed()))
    assert bloom.has(hashes[:10000]).all() and packed.has(hashes[:10000]).all()
    assert (packed.has(hashes) == bloom.has(hashes)).all() and bloom.has(hashes[10000:]).mean() < 0.01


# -- manifest --------------------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, arity):
    def leaf(r, more=0):
        n_chars = None if r[4] is None else r[4] + more
        values = [r[0], r[3], r[2], n_chars, r[1]]
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def tree(nodes):
        """The root, and for each node what stands left and right of it at each level."""
        steps, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = range(0, len(nodes), arity)
            for first in runs:
                for k in range(first, min(first + arity, len(nodes))):
                    for i in at[k]:
                        steps[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1:first + arity])))
            at = [sum(at[f:f + arity], []) for f in runs]
            nodes = [sha(*nodes[f:f + arity]) for f in runs]
        return nodes[0], steps

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    found = []
    for lang in langs:
        of = sorted(([r[0], leaf(r), r] for r in rows if r[2] == lang), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subroot, steps = tree([x[1] for x in of])
        found.append((subroot, of, steps))
    root, above = tree([f[0] for f in found])
    out = []
    for (subroot, of, steps), up in zip(found, above, strict=True):
        for (doc_id, own, r), path in zip(of, steps, strict=True):
            path = path + up
            now = leaf(r, 1) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 else own
            for left, right in path:
                now = sha(left, now, right)
            out.append((doc_id, own, subroot, root, sha(*[a + b for a, b in path]), now, now == root))
    return collections.Counter(out)


@pytest.mark.parametrize("arity, levels", [(2, 10), (2, 2), (3, 1), (5, 2)])
def test_manifest(messy, arity, levels):
    found = merkle.manifest(messy, arity, levels)
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("p"),
                       merkle.fold(F.coalesce("tampered", "leaf"), F.col("steps")).alias("f")).withColumn("v", F.col("f") == F.col("root"))
    assert collections.Counter(map(tuple, got.collect())) == plain_manifest(ROWS, arity)


def test_manifests_of_few_rows(spark, empty):
    assert merkle.verified(empty).collect() == []
    for rows in ([row(4, "x")], [row(None, None, None, None)] * 3, [row(i, "x", "en") for i in range(5)]):
        got = merkle.verified(spark.createDataFrame(rows, SCHEMA)).collect()
        assert collections.Counter(map(tuple, got)) == plain_manifest(rows, 2)


def test_records_are_found_by_their_digests():
    nodes = [sha(str(i)) for i in range(37)]
    top, records = merkle.grow(nodes, merkle.height(37, 3), 3)
    assert merkle.unpack_records(merkle.pack_records(records)) == records
    for rank in (0, 1, 26, 36):
        reached, segment = merkle.walk(top, records, rank, merkle.height(37, 3), 3)
        assert reached == nodes[rank]
        for left, right in segment:
            reached = sha(left, reached, right)
        assert reached == top


# -- names of columns, contracts -------------------------------------------------------------

CLASHING = ("doc_id long, text string, lang string, source string, n_chars long, _id int, _A string, _ka long, _kb long, _terms string, "
            "_text string, first string, _stays int")


def test_columns_of_any_name(spark):
    texts = ["mail a@b.example now and then " * 4, "mail a@b.example now and then " * 4, None, "", "something else to read for everybody here"]
    rows = [(i, t, "en", "s", 5, 1, "a", 2, 3, "t", "z", "f", 4) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, CLASHING)
    model = toxicity.train(common.texts(docs), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    for out in (near.without_copies(docs), pii.sanitised(docs), toxicity.accepted(docs, model)):
        assert out.columns == docs.columns and {r["_terms"] for r in out.collect()} == {"t"}
    scored = toxicity.score(docs, model)
    assert scored.columns == [*docs.columns, "score", "predicted", "evidence"] and {r["_text"] for r in scored.collect()} == {"z"}
    # a missing text and an empty one are copies
    assert sorted(r["doc_id"] for r in near.without_copies(docs).collect()) == [0, 2, 4]


CONTRACTS = {
    "op1": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op6": "page_id bigint, url string, text string, n_chars bigint",
    "op7": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op8": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op13": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}


@pytest.mark.parametrize("number", list(CONTRACTS))
def test_columns_and_rows_of_contracts(spark, number):
    folder = "/root/testdata/sf0.001"
    name, = [q for q in queries.QUERIES if q.split("_")[0] == number]
    out = queries.QUERIES[name](spark, folder)
    have = dict(out.dtypes)
    want = dict(c.split() for c in CONTRACTS[number].split(", "))
    assert {c: have.get(c) for c in want} == want
    if number not in ("op1", "op11"):
        table, key = ("pages", "page_id") if number == "op6" else ("documents", "doc_id")
        ids = sorted(r[0] for r in common.table(spark, folder, table).select(key).collect())
        assert sorted(r[0] for r in out.select(key).collect()) == ids

