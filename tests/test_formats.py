"""Formats written to files by hand, and what is read from them."""

import gzip

from pyspark.sql import functions as F

from twinscript.functions import text as X
from twinscript.plans import jobs
from twinscript.sources import readers, writers


def test_plain_and_gzip_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One line. Two.\n\nNew paragraph here.", "utf-8")
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress("Drei.".encode()))
    got = sorted((r["para_id"], r["sent_pos"], r["sentence"]) for r in readers.plain_text(spark, str(tmp_path), F.lit("en")).collect())
    assert got == [(1, 1, "Drei."), (1, 1, "One line."), (1, 2, "Two."), (2, 3, "New paragraph here.")]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    for name, n in (("big.en", 5000), ("small.en", 3)):
        (tmp_path / name).write_text("".join(f"line {i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = readers.numbered_lines(spark, str(tmp_path))
        rows = lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 5003
    assert all(r["text"] == f"line {r['line_no']}" for r in rows)


def test_translation_memory_forms(spark, tmp_path):
    (tmp_path / "m.tmx").write_text(
        '<tmx version="1.4"><header srclang="en"/><body><tu tuid="1"><tuv xml:lang="EN-GB"><seg>A  b</seg></tuv>'
        '<tuv lang="ger"><seg>C &amp; d</seg></tuv></tu></body></tmx>')
    got = {(r["lang"], r["seg"]) for r in readers.tmx(spark, str(tmp_path)).collect()}
    assert got == {("en", "A b"), ("de", "C & d")}


def test_alignment_file(spark, tmp_path):
    (tmp_path / "x.xml").write_text(
        '<cesAlign><linkGrp fromDoc="en/a.xml" toDoc="sv/a.xml"><link id="1" xtargets="s1 s2;t1" certainty="0.5"/>'
        '<link xtargets=";t2"/></linkGrp></cesAlign>')
    got = [(r["link_pos"], r["src_ids"], r["trg_ids"], r["score"]) for r in readers.xces(spark, str(tmp_path)).orderBy("link_pos").collect()]
    assert got == [(1, ["s1", "s2"], ["t1"], 0.5), (2, [], ["t2"], None)]


def test_corpus_file_ids(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<text><p id="1"><s id="a">One</s><s lang="fr">Deux</s></p><p id="2"><s>Three</s></p></text>')
    got = [(r["sent_id"], r["lang"], r["text"]) for r in readers.read(spark, "xml", str(tmp_path)).orderBy("para_id", "sent_id").collect()]
    assert sorted(got, key=str) == sorted([("a", None, "One"), ("2", "fr", "Deux"), ("3", None, "Three")], key=str)


def test_any_xml_keeps_head_out(spark):
    df = spark.createDataFrame([(1, "<r><head>no</head><a>One. Two.</a><b/>A &lt; b</r>")], "id int, text string")
    got = [(r["seg_pos"], r["sentence"]) for r in readers.xml_segments(df).orderBy("seg_pos", "sent_pos").collect()]
    assert got == [(1, "One."), (1, "Two."), (2, "A < b")]


def test_subtitles(spark):
    text = "1\r\n00:00:01,500 --> 00:00:02,000\r\n{x}<i>Hi</i>\r\nyou\r\n\r\n2\r\n00:01:00,000 --> 00:01:01,000\r\n''Bye''\r\n"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = [(r["cue"], r["t_start"], r["t_end"], r["text"]) for r in readers.srt(df).orderBy("cue").collect()]
    assert got == [(1, 1.5, 2.0, "Hi you"), (2, 60.0, 61.0, '"Bye"')]


def test_charsets(spark):
    rows = [("sv", "åäö".encode("iso-8859-1"), "åäö"), ("ru", "привет".encode("windows-1251"), "привет"),
            ("en", b"\xef\xbb\xbfabc", "abc"), ("en", b"\xff\xfe" + "aé".encode("utf-16-le"), "aé"), ("pl", "zażółć".encode(), "zażółć")]
    df = spark.createDataFrame([(l, bytearray(b), w) for l, b, w in rows], "lang string, content binary, want string")
    assert all(r["text"] == r["want"] for r in readers.decode_text(df).collect())


def test_one_language_units_are_not_written(spark, tmp_path):
    df = spark.createDataFrame([("1", "en", "a"), ("1", "fr", "b"), ("2", "en", "c")], "tu_id string, lang string, seg string")
    writers.write("tmx", df, str(tmp_path / "out"), files=2)
    assert {r["seg"] for r in readers.tmx(spark, str(tmp_path / "out")).collect()} == {"a", "b"}


def test_conversion_and_registered_formats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x|y\nz\n")
    jobs.convert(spark, "moses", str(tmp_path / "in"), "text", str(tmp_path / "out"), order=["line_no"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["x_y", "z"]
    readers.register("three", lambda s, path: s.range(3))
    assert readers.read(spark, "three", "").count() == 3


def test_normalised_tables(spark):
    rows = [("d", 1, "en", "a"), ("d", 1, "fr", "b"), ("d", 1, "de", "c"), ("d", 2, "en", "x"), ("d", 2, "fr", "  ")]
    out = writers.normalised(spark.createDataFrame(rows, "doc string, tu_id int, lang string, seg string"))
    assert {(r["src_lang"], r["trg_lang"]) for r in out["links"].collect()} == {("de", "en"), ("de", "fr"), ("en", "fr")}
    assert {r["kind"]: r["size"] for r in out["sizes"].collect()} == {"en": 2, "fr": 1, "de": 1, "de-en": 1, "de-fr": 1, "en-fr": 1}


def test_nested_values(spark):
    df = spark.createDataFrame([(["a"], {"k": "b"})], "l array<string>, m map<string,string>")
    row = df.select(X.map_tokens(F.col("l"), "array", F.upper).alias("l"), X.map_tokens(F.col("m"), "map", F.upper).alias("m")).first()
    assert (row["l"], row["m"]) == (["A"], {"k": "B"})
