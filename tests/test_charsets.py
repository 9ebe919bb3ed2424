"""Files in many charsets, and corpus files with all their markup, written by hand and read."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from twinscript.operators import align
from twinscript.sources import charsets, markup, readers, writers

RUSSIAN = ("Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Всё смешалось в доме. Жена узнала, "
           "что муж был в связи с бывшею в их доме гувернанткой, и объявила мужу, что не может жить с ним в одном доме. Положение это "
           "продолжалось уже третий день и мучительно чувствовалось и самими супругами, и всеми членами семьи, и домочадцами. ")
CHINESE = ("話說天下大勢，分久必合，合久必分。周末七國分爭，并入於秦。及秦滅之後，楚漢分爭，又并入於漢。漢朝自高祖斬白蛇而起義，一統天下。"
           "後來光武中興，傳至獻帝，遂分為三國。推其致亂之由，殆始於桓靈二帝。桓帝禁錮善類，崇信宦官。")
POLISH = ("Litwo, ojczyzno moja, ty jesteś jak zdrowie. Ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą w całej "
          "ozdobie widzę i opisuję, bo tęsknię po tobie. Źdźbło żółtej gęsi. ")
FRENCH = ("Longtemps, je me suis couché de bonne heure. Parfois, à peine ma bougie éteinte, mes yeux se fermaient si vite que je n’avais pas "
          "le temps de me dire : « Je m’endors. » Et, une demi-heure après, la pensée qu’il était temps de chercher le sommeil m’éveillait ; "
          "où êtes-vous, cœur léger, forêt, naïf, île, garçon, sûr. ")
TEXTS = {"ru": RUSSIAN, "zh": CHINESE, "pl": POLISH, "fr": FRENCH}


@pytest.fixture(scope="module")
def models(spark):
    return charsets.train(spark.createDataFrame(list(TEXTS.items()), "lang string, text string"))


def test_charset_by_content(spark, tmp_path, models):
    r = random.Random(5)
    want = {}
    for lang, names in (("ru", charsets.CYRILLIC), ("zh", ["Big5", "GB18030"]), ("pl", charsets.CENTRAL), ("fr", ["windows-1252", "IBM850", "macintosh"])):
        words = TEXTS[lang].split() if lang != "zh" else list(TEXTS[lang])
        for name in (*names, "UTF-8", "UTF-16LE", "UTF-16BE"):
            some = words[:]
            r.shuffle(some)
            text = (" " if lang != "zh" else "").join(some[:len(some) * 2 // 3])
            raw = text.encode(charsets.codec(name), "replace")
            path = tmp_path / f"{lang}-{name}.txt"
            path.write_bytes(raw + "\n".encode(charsets.codec(name)))
            want[path.name] = (name, raw.decode(charsets.codec(name)))
    lang = F.regexp_extract("file", r"/([a-z]+)-[^/]*$", 1)
    files = charsets.of_files(spark, str(tmp_path), models, lang)
    got = {r["file"].rsplit("/", 1)[1]: r["charset"] for r in files.collect()}
    assert {k: v for k, v in got.items() if v != want[k][0]} == {}
    texts = {r["file"].rsplit("/", 1)[1]: r["text"].rstrip("\n") for r in readers.whole_files(spark, str(tmp_path), files).collect()}
    assert texts == {k: v[1] for k, v in want.items()}
    lines = {r["file"].rsplit("/", 1)[1]: (r["line_no"], r["text"]) for r in readers.numbered_lines(spark, str(tmp_path), files).collect()}
    assert lines == {k: (1, v[1]) for k, v in want.items()}
    unknown = {r["file"].rsplit("/", 1)[1]: r["charset"] for r in charsets.of_files(spark, str(tmp_path), models).collect()}
    assert unknown["zh-Big5.txt"] == "Big5" and unknown["fr-IBM850.txt"] == "IBM850" and unknown["pl-IBM852.txt"] == "IBM852"


def test_marks_and_declarations(spark, tmp_path):
    def write(name, raw):
        (tmp_path / name).write_bytes(raw)
    write("a", b"\xef\xbb\xbfabc")
    write("b", "﻿aé".encode("utf-16-le"))
    write("c", "﻿aé\nb".encode("utf-16-be"))
    write("d", b'<?xml version="1.0" encoding="ISO-8859-2"?><a>\xb1</a>')
    write("e", "<?xml version='1.0' encoding='UTF-8'?><a>é</a>".encode("cp1252"))
    write("f", b'<?xml version="1.0" encoding="no-such-charset"?><a/>')
    write("g", "Ω\nΩ\n".encode("utf-16-be"))
    write("h", '<?xml version="1.0" encoding="UTF-16"?><a>é</a>'.encode("utf-16-le"))
    write("i", b"")
    got = {r["file"].rsplit("/", 1)[1]: r["charset"] for r in charsets.of_files(spark, str(tmp_path)).collect()}
    got.pop("i", None)
    assert got == {"a": "UTF-8", "b": "UTF-16LE", "c": "UTF-16BE", "d": "ISO-8859-2", "e": "windows-1252", "f": "UTF-8", "g": "UTF-16BE", "h": "UTF-16LE"}
    texts = {r["file"].rsplit("/", 1)[1]: r["text"] for r in readers.whole_files(spark, str(tmp_path)).collect()}
    assert (texts["a"], texts["b"], texts["c"], texts["g"]) == ("abc", "aé", "aé\nb", "Ω\nΩ\n") and "ą" in texts["d"] and "é" in texts["e"]
    assert readers.whole_files(spark, str(tmp_path)).where("text is null").count() == 0


def test_translation_memories_in_any_charset(spark, tmp_path):
    body = '<tmx version="1.4"><header srclang="fr"/><body>{}</body></tmx>'
    unit = '<tu tuid="{}"><tuv xml:lang="fr"><seg>café {}</seg></tuv><tuv xml:lang="ru"><seg>{}</seg></tuv></tu>'
    for k, (name, mark) in enumerate((("utf-16-le", "﻿"), ("utf-16-be", ""), ("utf-8", "﻿"), ("utf-8", ""))):
        text = "\n".join(unit.format(f"{k}.{i}", i, "привет") for i in range(40))
        (tmp_path / f"{k}.tmx").write_bytes((mark + '<?xml version="1.0"?>' + body.format(text)).encode(name))
    (tmp_path / "l.tmx").write_bytes(('<?xml version="1.0" encoding="ISO-8859-1"?>' + body.format(unit.format("l", "x", "da"))).encode("latin-1"))
    (tmp_path / "k.tmx").write_bytes(('<?xml version="1.0" encoding="koi8-r"?>' + body.format(
        '<tu tuid="k"><tuv xml:lang="ru"><seg>привет</seg></tuv></tu>')).encode("koi8-r"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = sorted((r["tu_id"], r["lang"], r["seg"]) for r in readers.tmx(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(f"{k}.{i}", lang, seg) for k in range(4) for i in range(40) for lang, seg in (("fr", f"café {i}"), ("ru", "привет"))]
    assert got == sorted([*want, ("l", "fr", "café x"), ("l", "ru", "da"), ("k", "ru", "привет")])


CORPUS = """<?xml version="1.0"?>
<letsgo version="1"><head><title>no &lt;s&gt;</title></head><!-- <s id="c">none</s> <p> --><body>
<p id="1" type="a>b"><s id="1" n='x"y'>One &amp; two</s><s id="2"/><s/>
<s id="4" lang="fr"><![CDATA[a </s> b <p>]]> c</s></p><div type="q"><p id="2"><s id="5"><w pos="N">Three</w><w>four</w></s></p>
<gap/></div><s>Out</s></body></letsgo>
""".replace("a>b", "ab")


def test_structure_of_corpus_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(CORPUS)
    units = readers.corpus_units(spark, str(tmp_path / "in"))
    got = [(r["unit_no"], r["tag"] and dict(r["attributes"]), r["before"], r["text"]) for r in units.orderBy("unit_no").collect()]
    assert got == [
        (1, {"id": "1", "n": 'x"y'}, ['<letsgo version="1">', "<head>", "<title>", "</title>", "</head>", "<body>", '<p id="1" type="ab">'], "One & two"),
        (2, {"id": "2"}, [], ""), (3, {}, [], ""), (4, {"id": "4", "lang": "fr"}, [], "a </s> b <p> c"),
        (5, {"id": "5"}, ["</p>", '<div type="q">', '<p id="2">'], "Three four"), (6, {}, ["</p>", "<gap/>", "</div>"], "Out"),
        (7, None, ["</body>", "</letsgo>"], None)]
    named = units.withColumn("file", F.lit("out"))
    writers.corpus_units(named, str(tmp_path / "out"))
    again = readers.corpus_units(spark, str(tmp_path / "out"))
    assert [(r["unit_no"], r["tag"] and dict(r["attributes"]), r["before"], r["text"]) for r in again.orderBy("unit_no").collect()] == got
    flat = [(r["sent_id"], r["para_id"], r["lang"], r["text"]) for r in readers.corpus_xml(spark, str(tmp_path / "in")).collect()]
    assert sorted(flat) == sorted([("1", "1", None, "One & two"), ("2", "1", None, ""), ("3", "1", None, ""), ("4", "1", "fr", "a </s> b <p> c"),
                                   ("5", "2", None, "Three four"), ("6", None, None, "Out")])
    open_ = {r["unit_no"]: [markup_name(t) for t in r["open"]] for r in markup.with_open(units).collect()}
    assert open_ == {1: ["letsgo", "body", "p"], 2: ["letsgo", "body", "p"], 3: ["letsgo", "body", "p"], 4: ["letsgo", "body", "p"],
                     5: ["letsgo", "body", "div", "p"], 6: ["letsgo", "body"], 7: []}
    census = {r["tag"]: r["n"] for r in markup.tag_census(units).collect()}
    assert census == {"letsgo": 1, "head": 1, "title": 1, "body": 1, "p": 2, "div": 1, "gap": 1, "s": 6}


def markup_name(tag):
    return tag[1:].split()[0].rstrip(">")


def test_structure_does_not_depend_on_blocks(spark, tmp_path):
    r = random.Random(3)
    parts, want, stack, before = ["<text>"], [], ["text"], ["<text>"]
    for i in range(3000):
        for _ in range(r.choice((0, 0, 1, 2))):
            if len(stack) > 1 and r.random() < 0.55:
                before.append(f"</{stack.pop()}>")
            else:
                stack.append(r.choice("pqx"))
                before.append(f"<{stack[-1]}>")
            parts.append(before[-1])
        kind = r.random()
        text = f"s{i}" if kind < 0.9 else f"</s>{i}"
        parts.append(f"<s id='{i}'>" + (text if kind < 0.9 else f"<![CDATA[{text}]]>") + "</s>" + ("<!-- </s> -->" if i % 97 == 0 else ""))
        want.append((i + 1, str(i), text, before, list(stack)))
        before = []
    (tmp_path / "a.xml").write_text("\n".join(parts) + "".join(f"</{t}>" for t in reversed(stack)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = markup.with_open(readers.corpus_units(spark, str(tmp_path))).where("tag is not null").orderBy("unit_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(x["unit_no"], x["attributes"]["id"], x["text"], x["before"], [markup_name(t) for t in x["open"]]) for x in rows] == want


def test_links_stay_within_boundaries(spark, tmp_path):
    r = random.Random(9)
    def document(sizes):
        return "<text>" + "".join("<div><p>" + "".join(f"<s>{'x' * r.randint(5, 60)}</s>" for _ in range(n)) + "</p></div>" for n in sizes) + "</text>"
    sizes = {"a": [3, 5, 2, 7], "b": [4, 5, 1, 7]}
    for name, n in sizes.items():
        (tmp_path / f"{name}.xml").write_text(document(n))
    units = readers.corpus_units(spark, str(tmp_path)).withColumn("file", F.regexp_extract("file", r"([^/]+)\.xml$", 1))
    pairs = spark.createDataFrame([("1", "a", "b")], "pair_id string, src_doc string, trg_doc string")
    best = align.best_boundary_tag(markup.tag_census(units, None), pairs)
    assert [tuple(x) for x in best.collect()] == [("1", "div", 4)]
    cut = align.within_boundaries(units, pairs.join(best, "pair_id"))
    links = align.length_based(cut).collect()
    ends = [list(itertools.accumulate(sizes[k])) for k in "ab"]
    for x in links:
        places = {sum(i > e for e in ends[0]) for i in x["src_ids"]} | {sum(j > e for e in ends[1]) for j in x["trg_ids"]}
        assert len(places) == 1
    assert sorted(i for x in links for i in x["src_ids"]) == list(range(1, 18)) and sorted(j for x in links for j in x["trg_ids"]) == list(range(1, 18))
