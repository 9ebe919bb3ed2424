"""Normalisation, segmentation and tokens on small texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinscript.functions import text as X
from twinscript.operators import langid


def apply(spark, values, fn, lang="en"):
    df = spark.createDataFrame([(i, v, lang) for i, v in enumerate(values)], "i int, t string, lang string")
    return [r["x"] for r in df.select("i", fn(F.col("t"), F.col("lang")).alias("x")).orderBy("i").collect()]


def test_normalisers(spark):
    assert apply(spark, [" a \n b "], lambda c, _: X.whitespace(c)) == ["a b"]
    assert apply(spark, ["ﬁne oﬃce ĳs…"], lambda c, _: X.ligatures(c)) == ["fine office ijs..."]
    assert apply(spark, ["a\r\nb\f"], lambda c, _: X.dos(c)) == ["ab"]
    assert apply(spark, ["<s>a|b< and ><unk>[and]\tc</s>"], lambda c, _: X.moses(c)) == ["a_bc"]
    assert apply(spark, ["Short head", "Short head\n", "x" * 27], lambda c, _: X.header(c)) == [
        "Short head\n", "Short head\n\n", "x" * 27]
    assert apply(spark, [" a \n b"], lambda c, _: X.normalize(c, "nothing, whitespace")) == ["a b"]
    assert apply(spark, ["a\x00b\x07c\td￾"], lambda c, _: X.clean_xml(c)) == ["abc\td"]


def test_registered_parts_are_used(spark):
    X.register_normalizer("shout", F.upper)
    X.register_splitter("bars", lambda c, lang: F.split(c, r"\|"))
    X.register_tokenizer("dots", lambda c, lang: F.split(c, r"\."))
    assert apply(spark, ["a"], lambda c, _: X.normalize(c, "shout")) == ["A"]
    assert apply(spark, ["a|b"], lambda c, lang: X.split_sentences(c, lang, "bars")) == [["a", "b"]]
    assert apply(spark, ["a.b"], lambda c, lang: X.tokens(c, lang, "dots")) == [["a", "b"]]


def test_sentences(spark):
    cases = {
        "Hello there. How are you? Fine.": ["Hello there.", "How are you?", "Fine."],
        "Mr. Smith met Dr. No. He left.": ["Mr. Smith met Dr. No.", "He left."],
        "It is No. 5 here. See pp. 7 and on.": ["It is No. 5 here.", "See pp. 7 and on."],
        "The U.S. Army came. 12 men left.": ["The U.S. Army came.", "12 men left."],
        'He said "Stop!" Then he ran.': ['He said "Stop!"', "Then he ran."],
        "Wait... What? (Really.) Yes": ["Wait...", "What?", "(Really.)", "Yes"],
        "Really? ' Yes\" (No.) 'Maybe' ... No.. Well": ["Really? '", "Yes\" (No.)", "'Maybe' ...", "No..", "Well"],
        "Stop! ¿Qué? \" Sí. «Ya» no! no": ["Stop!", "¿Qué? \"", "Sí.", "«Ya» no! no"],
        "end of line\nnext line. small letter": ["end of line", "next line. small letter"],
        "": [],
    }
    assert apply(spark, list(cases), lambda c, lang: X.split_sentences(c, lang)) == list(cases.values())


def test_unknown_language_splits_like_english(spark):
    text = "Mr. Smith. He left."
    assert apply(spark, [text], lambda c, lang: X.split_sentences(c, lang), "xx") == [["Mr. Smith.", "He left."]]


def test_paragraphs_and_headers(spark):
    df = spark.createDataFrame([(1, "en", "Title\nThis is the first line, which goes\non here. And on.\n\n \nNext one.\n")],
                               "doc int, lang string, text string")
    got = [(r["para_id"], r["sent_pos"], r["sentence"]) for r in X.read_text(df).orderBy("sent_pos").collect()]
    assert got == [(1, 1, "Title"), (1, 2, "This is the first line, which goes on here."), (1, 3, "And on."), (2, 4, "Next one.")]


def test_digits_at_the_start_of_a_paragraph_stay(spark):
    df = spark.createDataFrame([(1, "en", "0 a\n\n11 b\n\n22 c\n\n3 d")], "doc int, lang string, text string")
    assert [r["sentence"] for r in X.read_text(df).orderBy("sent_pos").collect()] == ["0 a", "11 b", "22 c", "3 d"]


@pytest.mark.parametrize("lang,text,want", [
    ("en", "It's 5,300 dollars, isn't it?", ["It", "'s", "5,300", "dollars", ",", "isn", "'t", "it", "?"]),
    ("en", "In the 1990's he (Mr. Li) won...", ["In", "the", "1990", "'s", "he", "(", "Mr.", "Li", ")", "won", "..."]),
    ("fr", "L'homme d'ici.", ["L'", "homme", "d'", "ici", "."]),
    ("de", "Geht's z.B. so?", ["Geht", "'", "s", "z.B.", "so", "?"]),
    ("en", "The U.S. army ended.", ["The", "U.S.", "army", "ended", "."]),
])
def test_tokens(spark, lang, text, want):
    assert apply(spark, [text], lambda c, l: X.tokens(c, l), lang) == [want]


def test_unicode_tokens(spark):
    assert apply(spark, ["don't stop -- now!! (yes)."], lambda c, l: X.tokens(c, l, "unicode")) == [
        ["don'", "t", "stop", "--", "now", "!!", "(", "yes", ")", "."]]


@pytest.mark.parametrize("lang,text", [
    ("en", 'He said: "It\'s fine," and left.'),
    ("en", "The boys' house (old) costs $5."),
    ("fr", "L'homme d'ici, là."),
    ("en", "\"One\" and \"two\" and 'three'."),
])
def test_detokenised_text_is_the_original(spark, lang, text):
    def there_and_back(c, l):
        return X.detokenize(X.tokens(c, l), l)
    assert apply(spark, [text], there_and_back, lang) == [text]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aZ é5.,'\"?!()-`", min_size=0, max_size=40), min_size=20, max_size=20))
def test_tokens_keep_all_characters(spark, texts):
    """Tokens without blanks are the text without blanks, quotes of all kinds taken as one."""
    def squeezed(s):
        return s.replace("`", "'").replace("''", '"').replace("'", "").replace('"', "").replace(" ", "")
    got = apply(spark, texts, lambda c, l: X.tokens(c, l))
    assert [squeezed("".join(g)) for g in got] == [squeezed(t) for t in texts]


def test_subtitle_times(spark):
    assert apply(spark, ["01:02:03,450"], lambda c, _: X.seconds(c)) == [3723.45]
    assert apply(spark, ["{y:i}''Hi''<i> you</i>"], lambda c, _: X.clean_cue(c)) == ['"Hi" you']


def test_ranked_ngrams_of_a_text_are_those_of_the_table(spark):
    texts = ["the cat sat on the mat 12 times", "ab", "x " * 300 + "the end of it all and more words to rank"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    ranked = langid.rank(langid.ngrams(df, ["id"]), ["id"]).collect()
    for i, text in enumerate(texts):
        want = [r["ngram"] for r in sorted((r for r in ranked if r["id"] == i), key=lambda r: r["rank"])]
        assert langid.top_ngrams(text) == want


def test_language_is_found_and_resolved(spark):
    known = spark.createDataFrame([("en", "the cat and the dog ran over the hill " * 5), ("de", "der hund und die katze liefen über den berg " * 5)],
                                  "lang string, text string")
    texts = spark.createDataFrame([(1, "de", "the dog and the hill"), (2, "de", "die katze und der berg"), (3, "fr", "12 34")],
                                  "id int, lang string, text string")
    models = langid.train(known)
    found = langid.classify(texts, ["id", "lang"], models)
    got = {r["id"]: r["language"] for r in langid.resolve(found).collect()}
    assert got == {1: "en", 2: "de", 3: "fr"}
    flagged = {r["id"]: (r["detected"], r["confidence"] > 0) for r in langid.flags(texts, ["id"], models).collect()}
    assert flagged == {1: ("en", True), 3: ("unknown", False)}


def test_acronyms_of_any_length_end_no_sentence(spark):
    text = "See A" + ".B" * 90 + ". Next one. The A.B.C... Then more."
    df = spark.createDataFrame([(text, "en")], "text string, lang string")
    got = df.select(X.split_sentences(F.col("text"), F.col("lang")).alias("s")).first()["s"]
    assert got == ["See A" + ".B" * 90 + ". Next one.", "The A.B.C...", "Then more."]
