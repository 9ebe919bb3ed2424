"""Document matching on small sets of names and pages."""

import random

from pyspark.sql import functions as F

from twinscript.functions import lang as L
from twinscript.functions import paths
from twinscript.operators import match


def docs(spark, names):
    rows = [("s", "b", lang, name, f"s/b/xml/{lang}/{name}", size) for lang, name, size in names]
    return spark.createDataFrame(rows, "slot string, branch string, lang string, basename string, path string, size int")


def test_names_without_their_language(spark):
    df = docs(spark, [("en", "report_en.xml", 9), ("sv", "report_sv.xml", 9), ("de", "Report-German.xml", 9), ("fr", "other.xml", 9)])
    names = {r["lang"]: r["stripped"] for r in match.stripped_names(df).collect()}
    assert names == {"en": "report", "sv": "report", "de": "Report", "fr": "other"}
    assert [(r["src_lang"], r["trg_lang"]) for r in match.no_lang(df).collect()] == [("en", "sv")]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_similar_names_are_those_a_full_comparison_finds(spark):
    rng = random.Random(5)
    def name():
        return "chapter " + "".join(rng.choice("abc") for _ in range(rng.choice([2, 4, 9, 15, 34])))
    have = sorted({name() for _ in range(60)} | {"abcdefghij" * 4})
    ask = sorted({name() for _ in range(60)} | {"123", "abcdefghij" * 3 + "bcdXfgYhij", "abXdefghijabcdefgXXjabcdefghijabcdefghj"})
    for n in have[::5]:
        w = list(n)
        for at in rng.sample(range(len(w)), len(w) // 10):
            w[at] = rng.choice(["", "z", "zz"])
        ask.append("".join(w))
    ask = sorted(set(ask))
    names = spark.createDataFrame([("s", "de", n, f"p/{n}") for n in have], "slot string, lang string, name string, path string")
    wanted = spark.createDataFrame([("s", n, "de") for n in ask], "slot string, name string, lang string")
    got = {r["name"]: (r["distance"], r["match"]) for r in match.similar(wanted, names).collect()}
    want = {}
    for n in ask:
        near = [(distance(n, h), h) for h in have if distance(n, h) <= -(-len(n) // 10)]
        if near and n != "123":
            want[n] = min(near)
    assert got == want


def test_cascade_prefers_the_earlier_stage(spark):
    def stage(rows):
        return spark.createDataFrame(rows, "slot string, family string, lang string, path string")
    got = match.cascade([stage([("s", "f", "en", "z")]), stage([("s", "f", "en", "a"), ("s", "f", "de", "b"), ("s", "f", "de", "c")])])
    assert {(r["lang"], r["path"], r["stage"]) for r in got.collect()} == {("en", "z", 0), ("de", "b", 1)}


def test_scores_of_marked_names(spark):
    df = docs(spark, [("en", "a_en.xml", 10), ("sv", "a_sv.xml", 8), ("de", "a_de.xml", 3), ("fr", "b.xml", 10)])
    known = spark.createDataFrame([("x", "y")], "src_path string, trg_path string")
    got = {(r["src_path"], r["trg_path"]): (round(r["match"], 3), r["aligned"])
           for r in match.scored(df, known, key=("slot", "branch")).collect()}
    assert got == {("s/b/xml/en/a_en.xml", "s/b/xml/sv/a_sv.xml"): (0.96, False), ("x", "y"): (1.0, True)}


def test_names_that_differ_in_one_stretch(spark):
    df = docs(spark, [("en", "report-2020_en.xml", 10), ("sv", "report-2021_sv.xml", 9), ("de", "report-1999x_de.xml", 9), ("fi", "quite else_fi.xml", 9),
                      ("en", "annual accounts 2020 part one_en.xml", 9), ("sv", "annual accounts 2020 part two_sv.xml", 9)])
    none = spark.createDataFrame([], "src_path string, trg_path string")
    got = {(r["src_path"].split("/")[-1], r["trg_path"].split("/")[-1]): r["name_match"] for r in match.scored(df, none, key=("slot", "branch")).collect()}
    # "report-2020_.xml" and "report-2021_.xml" differ in one character each, of 18 + 18
    want = {("report-2020_en.xml", "report-2021_sv.xml"): 1 - 2 / 36, ("annual accounts 2020 part one_en.xml", "annual accounts 2020 part two_sv.xml"): 1 - 6 / 72}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_a_hot_name_gives_a_pair_for_each_two_languages(spark):
    rows = [("s", f"b{i}", lang, "index_xx.xml", f"s/b{i:03}/xml/{lang}/index_xx.xml", 5) for i in range(200) for lang in ("en", "sv")]
    df = spark.createDataFrame(rows, "slot string, branch string, lang string, basename string, path string, size int")
    none = spark.createDataFrame([], "src_path string, trg_path string")
    assert [(r["src_path"], r["trg_path"]) for r in match.scored(df, none).collect()] == [("s/b199/xml/en/index_xx.xml", "s/b199/xml/sv/index_xx.xml")]
    numbered = [("s", "b", lang, f"report-{i + 300 * (lang == 'sv'):04}_{lang}.xml", f"s/b/xml/{lang}/report-{i + 300 * (lang == 'sv'):04}_{lang}.xml", 5)
                for i in range(300) for lang in ("en", "sv")]
    many = match.scored(spark.createDataFrame(numbered, "slot string, branch string, lang string, basename string, path string, size int"), none).collect()
    assert 0 < len(many) <= 600 and all(r["name_match"] >= 0.9 for r in many)


def test_many_names_with_one_long_beginning(spark):
    rng = random.Random(8)
    head = "proceedings of the annual meeting of the association, volume "  # 61 characters
    have = sorted({head + "".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(700)})
    ask = sorted({n[:-3] + "zzz" for n in have[::3]} | {n + "x" for n in have[::50]} | {"q" + n[:20] + n[21:40] + "yy" + n[40:] for n in have[::20]})
    names = spark.createDataFrame([("s", "de", n, f"p/{n}") for n in have], "slot string, lang string, name string, path string")
    wanted = spark.createDataFrame([("s", n, "de") for n in ask], "slot string, name string, lang string")
    got = {r["name"]: (r["distance"], r["match"]) for r in match.similar(wanted, names).collect()}
    some = rng.sample(ask, 25)
    assert {n: got[n] for n in some} == {n: min((distance(n, h), h) for h in have) for n in some}


def test_families_without_any_of_their_languages(spark):
    df = docs(spark, [("sv", "guide-swedish-english.xml", 1), ("sv", "tour_sv.xml", 1), ("fi", "guide-finnish.xml", 1), ("fi", "toursx.xml", 1), ("de", "x.xml", 1)])
    fam = spark.createDataFrame([("s", "guide-english-de.xml", ["en", "de"], "fi"), ("s", "guide-english-de.xml", ["en", "de"], "sv"), ("s", "tour_en.xml", ["en"], "sv"),
                                 ("s", "my tour_en.xml", ["en"], "sv"), ("s", "tours_en.xml", ["en"], "fi")],
                                "slot string, family string, langs array<string>, lang string")
    def found(fuzzy):
        return {(r["family"], r["lang"]): (r["path"].split("/")[-1], r["distance"]) for r in match.without_languages(fam, df, fuzzy=fuzzy).collect()}
    assert found(False) == {("guide-english-de.xml", "fi"): ("guide-finnish.xml", 0), ("tour_en.xml", "sv"): ("tour_sv.xml", 0)}
    assert found(True) == {**found(False), ("tours_en.xml", "fi"): ("toursx.xml", 1)}


PAGES = {
    "site/en/a.html": '<link rel="alternate" title="x" hreflang="sv-SE" href="/sv/a">',
    "site/fi/b.html": '<ul class="menu menu--language-switcher"><li><a href="/sv/b">SV</a></li></ul>',
    "site/fi/c.html": '<ul class="xx"><li class="en"><a href="../en/c.html">E</a></li><li class="fi"><a href="c.html">F</a></li>'
                      '<li class="sv"><a href="missinglanguageversion">S</a></li></ul>',
    "site/fi/d.html": '<a href="/sv/d">På svenska</a>',
    "site/fi/e.html": '<a href="/en/e" class="l"> In English </a> <a href="/x">other</a>',
    "site/fi/f.html": '<a href="/x">other</a>',
}


def test_each_link_style(spark):
    df = spark.createDataFrame(list(PAGES.items()), "path string, html string")
    got = {(r["page"], r["lang"]): r["href"] for r in match.extract_links(df).collect()}
    assert got == {("site/en/a.html", "sv"): "/sv/a.html", ("site/fi/b.html", "sv"): "/sv/b.html",
                   ("site/fi/c.html", "en"): "site/en/c.html", ("site/fi/d.html", "sv"): "/sv/d.html",
                   ("site/fi/e.html", "en"): "/en/e"}


def test_links_lead_to_imported_documents(spark):
    links = spark.createDataFrame([("en/a.html", "fi", "http://h/fi/a.html"), ("en/b.html", "fi", "../fi/b.html"), ("en/c.html", "en", "c.html")],
                                  "page string, lang string, href string")
    imported = spark.createDataFrame([("en/a.html", "A"), ("fi/a.html", "FA"), ("en/b.html", "B"), ("fi/b", "FB"), ("en/c.html", "C")],
                                     "imported_from string, path string")
    got = {(r["src_path"], r["trg_path"]) for r in match.language_links(links, imported).collect()}
    assert got == {("A", "FA"), ("B", "FB")}


def test_path_parts(spark):
    df = spark.createDataFrame([("s/b/xml/en/d/a.xml",), ("s/b/xml/en-sv/a.xml",), ("s/b/xml/en",), ("s/b/uploads/tmx/en/x.tmx",)], "p string")
    got = [tuple(r) for r in df.select(paths.resource_type(F.col("p")), paths.language(F.col("p")), paths.basename(F.col("p"))).collect()]
    assert got == [("xml", "en", "d/a.xml"), ("xces", "en-sv", "a.xml"), ("monolingual", "en", ""), ("tmx", "en", "en/x.tmx")]


def test_relative_links(spark):
    cases = [("../x/y.html", "a/b/c.html", "a/x/y.html"), ("y", "a/b/c.html", "a/b/y"), ("/z", "a/b", "z"), ("https://h/q/r", "a/b", "q/r")]
    df = spark.createDataFrame(cases, "h string, p string, want string")
    for r in df.select(paths.resolve_href(F.col("h"), F.col("p")).alias("got"), "want").collect():
        assert r["got"] == r["want"]


def test_the_longest_marker_goes(spark):
    df = spark.createDataFrame([("entry_English.xml", "en", "eng", "English"), ("entry_en.xml", "en", "eng", "English"), ("a_ENG.xml", "en", "eng", "English"),
                                ("plain", "sv", "swe", "Swedish")], "n string, two string, three string, name string")
    got = [r["x"] for r in df.select(L.without_last_marker(*map(F.col, ("n", "two", "three", "name"))).alias("x")).collect()]
    assert got == ["entry_.xml", "try_en.xml", "a_.xml", "plain"]


def test_language_forms(spark):
    df = spark.createDataFrame([("ger",), ("deu",), ("German",), ("de_AT",), ("qqq",)], "c string")
    assert [r["two"] for r in L.to_two(df, "c", "two").collect()] == ["de", "de", "de", "de", "qqq"]
