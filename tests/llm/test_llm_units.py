"""Parts of the training-data operators against plain versions of themselves, without Spark."""

import functools
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from twinscript.llm import decontaminate, fingerprints, idfiles, mainpart, near, ngrams, packing, pii, tokens, toxicity
from twinscript.llm.eliasfano import EliasFano


def test_piecewise_ids_equal_the_library():
    e, r = tokens.Encoder(tokens.default_path(), kept=300), random.Random(1)
    library = Tokenizer.from_file(tokens.default_path())
    alphabet = ["a", "b", " ", "  ", "\n", "1", ".", "'s", "é", "\t", "\xa0", "<|endoftext|>", "\x1c", "中", "!", "​", "́", "\x00", "\x01",
                "\x02", " x", " yy\n", "word. ", "Zé, ", "..."]
    for _ in range(20):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(200)]
        ids, bounds = e.encode(pa.array(texts))
        assert [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])] == [
            x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


class Counting:
    """A tokenizer that notes the texts it is asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **more):
        self.asked += texts
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_words_go_to_the_model_alone_wherever_they_stand():
    e = tokens.Encoder(tokens.default_path())
    e.tokenizer = Counting(e.tokenizer)
    library = Tokenizer.from_file(tokens.default_path())
    texts = ["Erste w\u00f6rter%%% stehen*** hier.%%%\nZeilen beginnen, \"enden\" (so)\nund", "Andere### ja&&&\nDritte"]
    ids, bounds = e.encode(pa.array(texts))
    assert [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])] == [x.ids for x in library.encode_batch(texts)]
    # a mark before a word makes it no plain one
    assert {c for t in e.tokenizer.asked for c in t if c.isalpha()} == set("enden" "so")


def test_frequent_words_stay_in_a_full_table():
    e = tokens.Encoder(tokens.default_path(), kept=100)
    library = Tokenizer.from_file(tokens.default_path())
    often, rare = " of the and", (f" {a}{b}" for a in "bcdfghjklmnp" for b in "aeioubcdfghjklmnpqrstvwxyz")
    for at in range(12):
        text = "x" + "".join(next(rare) for _ in range(25)) + often * (at < 4)
        ids, _ = e.encode(pa.array([text]))
        assert ids.tolist() == library.encode(text).ids and len(e.known) <= 100
        assert at < 3 or at > 6 or {p.strip() for p in often.split()} <= {p.strip() for p in e.known}


@pytest.mark.parametrize("kept", [40, 300_000])
def test_marks_lines_and_added_tokens_beside_words(kept):
    e, r = tokens.Encoder(tokens.default_path(), kept=kept), random.Random(5)
    library = Tokenizer.from_file(tokens.default_path())
    alphabet = ["word", "Stra\u00dfe", " ", " ", "\n", "'", "'s", "''", "%%%", ".%%%", "***", "<|endoftext|>", "<|", "|>", "12", "_", "\u00e9", "\u4e2d", "\u0301", "\u0120", "\u010a"]
    for _ in range(20):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(200)]
        ids, bounds = e.encode(pa.array(texts))
        assert [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])] == [
            x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_pieces_fill_their_classes():
    of = packing.classes(1024)
    assert list(of)[0] == 1024 and list(of)[-1] == 1 and all(1024 - n * j <= 4 for n, j in of.items())
    for n in range(1, 3000):
        parts = packing.cuts(n, list(of))
        assert sum(parts) == n and set(parts) <= set(of)


def test_rest_of_classes_is_packed_without_overlap():
    of = packing.classes(64)
    totals = {n: 3 * j + j // 2 for n, j in of.items()}
    plan, n = packing.rest_plan(totals, of, 64)
    used = {}
    for length, _, s, at in sorted(plan, key=lambda x: (x[2], x[3])):
        assert used.get(s, 0) == at
        used[s] = at + length
    assert len(used) == n and max(used.values()) <= 64 and len(plan) == sum(j // 2 for j in of.values())


def test_perfect_hash_is_minimal():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 20000):
        keys = np.unique(r.integers(-(1 << 62), 1 << 62, n))
        h = idfiles.PerfectHash.build(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))


def test_elias_fano_finds_and_gets():
    r = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (5, 3), (1000, 1 << 40), (1000, 500), (20000, 1 << 62)):
        v = np.sort(r.integers(0, u, n)).astype(np.uint64)
        e, _ = EliasFano.load(EliasFano.build(v).dump(), 0)
        assert (e.get(np.arange(n)) == v).all()
        q = np.concatenate([v, r.integers(0, u + 5, 500).astype(np.uint64)])
        first = {int(x): i for i, x in reversed(list(enumerate(v)))}
        assert e.find(q).tolist() == [first.get(int(x), -1) for x in q]


def test_packed_counts_come_back():
    pairs = np.array([5 << 32 | 7, 5 << 32 | 9, 8 << 32 | 1], dtype=np.uint64)
    out = ngrams.unpack_counts(ngrams.pack_counts(pairs, np.array([1, 2, 3]), np.array([0, 2, 2]), np.array([4, 1, 6]), np.array([1, 1, 9])))
    assert [x.tolist() for x in out] == [pairs.tolist(), [1, 2, 3], [0, 2, 2], [4, 1, 6], [1, 1, 9]]


def test_block_max_is_exact():
    r = np.random.default_rng(5)
    vectors = []
    for _ in range(700):
        t = np.sort(r.choice(50, r.integers(0, 6), replace=False))
        w = r.random(len(t)) + 0.1
        vectors.append((t, w / np.linalg.norm(w) if len(t) else w))
    index = toxicity.BlockMaxIndex(vectors, 50, block=16)
    dense = np.zeros((700, 50))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for _ in range(200):
        t = np.sort(r.choice(50, r.integers(1, 6), replace=False))
        w = r.random(len(t))
        scores = dense[:, t] @ w
        want = sorted((s for s in scores if s > 0), reverse=True)[:9]
        assert np.allclose([s for s, _ in index.top(t, w, 9)], want)


def test_isotonic_rises():
    x, level = toxicity.isotonic(np.array([0.1, 0.9, 0.5, 0.5]), np.array([0.0, 1.0, 1.0, 0.0]), np.ones(4))
    assert (np.diff(level) >= 0).all() and level[0] < 0.5 < level[-1] and x[0] == 0.1


def plain_jaccard(a, b):
    out = 0.0
    for i in set(a) & set(b):
        out += 1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in set(a) | set(b))
    return out


def test_probability_jaccard():
    r = random.Random(4)
    for _ in range(200):
        a, b = ({r.randint(0, 12): r.choice([1.0, 1.7, 2.1]) for _ in range(r.randint(1, 9))} for _ in range(2))
        sides = [(np.array(sorted(x), dtype=np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert near.probability_jaccard(*sides[0], *sides[1]) == pytest.approx(plain_jaccard(a, b))


def test_registers_agree_with_the_probability_of_the_similarity():
    r = np.random.default_rng(2)
    v = r.integers(1, 1 << 62, 300).astype(np.uint64)
    w = np.where(np.arange(300) % 5 == 0, 2.0, 1.0)
    a, b = np.arange(0, 250), np.arange(40, 300)
    kept = near.prob_min_hash(np.concatenate([v[a], v[b]]), np.concatenate([w[a], w[b]]), np.repeat([0, 1], [len(a), len(b)]), 2, 4000)
    exact = plain_jaccard(*({int(v[i]): w[i] for i in s} for s in (a, b)))
    assert abs((kept[0] == kept[1]).mean() - exact) < 0.03


def best_distances(item, text):
    rows = [[0] * (len(text) + 1)]
    for i in range(1, len(item) + 1):
        row = [i]
        for j in range(1, len(text) + 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (item[i - 1] != text[j - 1])))
        rows.append(row)
    return rows[-1][1:]


def test_myers_equals_the_table():
    r = random.Random(3)
    for _ in range(300):
        a, b = [r.randint(1, 3) for _ in range(r.randint(1, 70))], [r.randint(1, 4) for _ in range(r.randint(0, 40))]
        assert decontaminate.myers(a, b) == best_distances(a, b)


def test_items_are_found_with_as_many_edits_as_allowed():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(6, 40)))) for i in range(30)]
    index = decontaminate.Index(items, 0.2, 5)
    for i, text in items:
        words = text.split()
        k = int(0.2 * len(words))
        for edits in range(k + 3):
            w = list(words)
            for n, place in enumerate(r.sample(range(len(w)), min(edits, len(w)))):
                w[place] = ["zzz", "", f"{w[place]} yyy"][n % 3]
            around = [r.choice(vocabulary) for _ in range(200)]
            doc = " ".join(around[:90] + [x for x in w if x] + around[90:])
            exact = min(best_distances(words, decontaminate.words(doc)))
            found = {h[0]: h for h in index.find(doc)}
            assert (i in found) == (exact <= k)
            if i in found:
                assert found[i][1] == exact
                assert best_distances(words, decontaminate.words(doc[found[i][3]:found[i][4]]))[-1] == exact


def test_short_items_need_the_whole_text():
    index = decontaminate.Index([(1, "Yes, no."), (2, ""), (3, "yes no")], 0.2, 5)
    assert [h[0] for h in index.find("yes NO!")] == [1, 3] and not list(index.find("oh yes no")) and not list(index.find(""))


def test_values_of_personal_data():
    text = "a@b.co x.y+z@d-e.example.org, 1.2.3.4, 1.2.3.256, 4111 1111 1111 1111, 4111111111111112, 4111 1111 1111 1111 4111, +1 (988) 555-2485 +12"
    found = pii.values(text)
    assert [(k, text[a:z]) for k, a, z in found] == [
        ("email", "a@b.co"), ("email", "x.y+z@d-e.example.org"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (988) 555-2485")]
    assert pii.entity("email", "A@B.co") == "email:a@b.co" and pii.entity("ip", "01.2.3.4") == "ip:1.2.3.4"
    assert pii.generalise("mail a@b.co now", [("email", 5, 11), ("term", 0, 4)]) == "[removed] [email] now"
    assert pii.base_digest("") == pii.hashlib.sha256(b"").hexdigest()


def test_surroundings_reach_over_long_blanks():
    text = "Anna Bell " + " " * 900 + "a@b.co" + " " * 900 + "Carl"
    assert [t for t, _, _ in pii.surroundings(text, text.index("a@"), text.index(".co") + 3, [], 8)] == ["anna", "bell", "carl"]


PAGE = ('<body><div class="menu"><a>x y z</a></div><div id="content"><h1>Title</h1><p>Hello &amp; <b>bold</b> world<br>line  two &lt;x&gt; and many more '
        'words here</p><aside>side words here</aside><p>Second para with words words words words</p><div class="comments"><p>nice article, says a reader</p>'
        '</div></div><form>sub <input></form><footer>foot words</footer><script>var p = "</p> words words";</script></body>')


def test_main_text():
    weight = mainpart.DEFAULT
    assert mainpart.extract(PAGE, weight) == "Title\nHello & bold world line two <x> and many more words here\nSecond para with words words words words"
    assert mainpart.extract("", weight) == "" and mainpart.extract("<p></p>", weight) == "" and mainpart.extract("plain words", weight) == "plain words"
    inner = ('<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>one two</p></article><p>some words outside of it</p>'
             '<article class="comment"><p>I comment</p></article>')
    assert mainpart.extract(inner, weight) == "T\none two"
    assert mainpart.extract("<p>1 < 2 and <a title='x>y", weight) != ""


def test_weights_follow_labels():
    w = mainpart.weights({("word", True): 900, ("word", False): 100, ("<li>", False): 80, ("<p>", True): 60})
    assert w["word"] > 0 > w["<p>"] > w["<li>"] and mainpart.weights({}) == mainpart.DEFAULT


@pytest.mark.parametrize("scores", [[1, -2, 3, -1, 2, -9, 3], [-1, -2], [], [0, 2, 0, -1, 1]])
def test_best_run_has_the_largest_sum(scores):
    a, z = mainpart.best_run(scores)
    assert sum(scores[a:z]) == max([0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])


def plain_chunks(data, size):
    out, now = [], b""
    for k in range(len(data)):
        window = [data[k - j] if k >= j else 0 for j in range(7)]
        h = (sum(window) + sum(w * (7 - j) for j, w in enumerate(window)) + functools.reduce(
            lambda x, y: x ^ y, [(w << (5 * j)) & 0xFFFFFFFF for j, w in enumerate(window)])) & 0xFFFFFFFF
        now += data[k:k + 1]
        if ((h + 1) & 0xFFFFFFFF) % size == 0:
            out.append(now)
            now = b""
    return out + ([now] if now else [])


def test_chunks_end_where_the_rolling_hash_says():
    r = random.Random(2)
    texts = [bytes(r.choice(b"abcdefgh \n") for _ in range(r.choice([0, 1, 5, 30, 200, 700]))) for _ in range(30)] + [b"a" * 500]
    letter: dict[bytes, str] = {}
    for data, found in zip(texts, fingerprints.fingerprints(texts)):
        size = next(3 << i for i in range(40) if len(plain_chunks(data, 3 << i)) <= 64)
        got = found.split(":")
        assert int(got[0]) == size
        for letters, n in ((got[1], size), (got[2], 2 * size)):
            chunks = plain_chunks(data, n)
            assert len(letters) == len(chunks) and all(letter.setdefault(c, x) == x for c, x in zip(chunks, letters))


def test_likeness():
    r = random.Random(8)
    base = bytes(r.choice(b"abcdefghijklmnop ") for _ in range(3000))
    other = bytes(r.choice(b"abcdefghijklmnop ") for _ in range(3000))
    a, half, b, empty = fingerprints.fingerprints([base, base[:1500] + other[1500:], other, b""])
    assert fingerprints.likeness(a, a) == 1 and 0.3 < fingerprints.likeness(a, half) < 0.8 and fingerprints.likeness(a, b) == 0
    assert fingerprints.likeness(empty, empty) == 1 and fingerprints.likeness(empty, a) == 0 and empty == "3::"
    for _ in range(100):
        x, y = ("".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
        assert fingerprints.common_letters(x, y) == table[-1][-1]
