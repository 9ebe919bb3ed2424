"""Licence statements and licence texts in documents, recognised sentence by sentence.

1. A text is cut into sentences twice: line by line, and with single line feeds read as blanks, as
   licence texts are often wrapped.  A sentence ends at ``. ! ? : ;`` before white space.
2. A sentence is normalised: ASCII letters in lower case and digits, all else one blank; the ways to say
   "licensed under" become one.
3. Known sentences have identifiers; a document is the sequence of those it holds, in order.
4. Rules are sequences of identifiers.  A rule holds where its identifiers follow one another with no other
   known sentence between; a rule that is part of a longer one that holds gives way to it.

All of it is column expressions: the known sentences are a small table, sent to all tasks, and only sentences that are known
are shuffled.  A missing text is empty; a text without known sentences gives no row; repeated rows are reported
each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = r"([.!?:;])[ \t\n\r\f]+"
OPENING = ("^(?:(?:this|the) (?:work|project|software|file|code|source code|program|document|text|package|library|repository|content|data|dataset) "
           "(?:is|are) )?(?:also )?(?:released|licensed|licenced|distributed|available|published|provided|made available|shared) under "
           "(?:the terms of )?(?:the |an |a )?")
UNDER = "under "

#: Names of licences as normalised sentences have them, the short ones after them.
NAMES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "MIT": (("mit license", "mit licence", "mit open source license", "expat license"), ("mit",)),
    "Apache-2.0": (("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0",
                    "apache software license version 2 0", "apache license version 2 0 the license"), ("apache 2 0",)),
    "GPL-2.0": (("gnu general public license version 2", "gnu general public license v2", "gnu general public license v2 0", "gnu gpl version 2", "gnu gpl v2",
                 "gplv2", "gpl version 2"), ("gpl 2 0", "gpl 2 0 only")),
    "GPL-3.0": (("gnu general public license version 3", "gnu general public license v3", "gnu general public license v3 0", "gnu general public license version 3 0",
                 "gnu gpl version 3", "gnu gpl v3", "gplv3", "gpl version 3"), ("gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later")),
    "LGPL-2.1": (("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl version 2 1", "lgplv2 1"), ("lgpl 2 1", "lgpl 2 1 only")),
    "LGPL-3.0": (("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl version 3", "lgplv3"), ("lgpl 3 0", "lgpl 3 0 only")),
    "AGPL-3.0": (("gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl version 3", "agplv3"), ("agpl 3 0", "agpl 3 0 only")),
    "MPL-2.0": (("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mpl 2 0 license"), ("mpl 2 0",)),
    "BSD-2-Clause": (("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license"), ("bsd 2 clause",)),
    "BSD-3-Clause": (("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license"), ("bsd 3 clause",)),
    "BSD": (("bsd license", "bsd style license"), ()),
    "ISC": (("isc license", "isc licence"), ("isc",)),
    "Unlicense": (("unlicense", "unlicense license"), ("unlicense",)),
    "CC0-1.0": (("cc0 1 0 universal", "creative commons zero v1 0 universal", "cc0 1 0", "creative commons cc0 1 0 universal public domain dedication"), ("cc0 1 0",)),
    "EPL-2.0": (("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0"), ("epl 2 0",)),
    "BSL-1.0": (("boost software license version 1 0", "boost software license 1 0"), ("bsl 1 0",)),
    "Artistic-2.0": (("artistic license 2 0", "artistic license version 2 0"), ("artistic 2 0",)),
    "Zlib": (("zlib license", "zlib libpng license"), ("zlib",)),
    "WTFPL": (("do what the fuck you want to public license", "wtfpl"), ("wtfpl",)),
    "PSF-2.0": (("python software foundation license", "python software foundation license version 2", "psf license"), ("psf 2 0",)),
}
CC_PARTS = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives",
            "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
for _part, _words in CC_PARTS.items():
    for _version in ("4.0", "3.0"):
        _short = f"cc {_part.lower().replace('-', ' ')} {_version.replace('.', ' ')}"
        _long = f"creative commons {_words} {_version.replace('.', ' ')}"
        NAMES[f"CC-{_part}-{_version}"] = ((_short, f"{_short} license", _long, f"{_long} license", f"{_long} international", f"{_long} international license",
                                            f"{_long} unported license"), (_short,))

#: Sentences of licence texts, normalised; fixed values.
SENTENCES = {
    "spdx": ("spdx license identifier",),
    "license-is": ("license", "licence", "licensed under"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
                  "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
                  "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit-condition": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit-warranty": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
                     "merchantability fitness for a particular purpose and noninfringement",),
    "mit-liability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract "
                      "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
                  "copyright notice and this permission notice appear in all copies",),
    "bsd-grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
                   "documentation and or other materials provided with the distribution",),
    "bsd-names": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
                  "software without specific prior written permission",),
    "apache-header": ("licensed under the apache license version 2 0 the license",),
    "apache-comply": ("you may not use this file except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at",),
    "apache-basis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
                     "warranties or conditions of any kind either express or implied",),
    "apache-see": ("see the license for the specific language governing permissions and limitations under the license",),
    "free-software": ("this program is free software", "this file is free software", "this library is free software"),
    "gpl2-terms": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
                   "either version 2 of the license or at your option any later version",),
    "gpl3-terms": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
                   "either version 3 of the license or at your option any later version",),
    "lgpl3-terms": ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software "
                    "foundation either version 3 of the license or at your option any later version",),
    "agpl3-terms": ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software "
                    "foundation either version 3 of the license or at your option any later version",),
    "unlicense-grant": ("this is free and unencumbered software released into the public domain",),
}
#: Licence, rule and its sentences in order.
RULES = [
    ("MIT", "text", ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")), ("MIT", "text without liability", ("mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", "grant", ("mit-grant",)), ("ISC", "grant", ("isc-grant",)), ("BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", "header", ("apache-header", "apache-comply", "apache-copy", "apache-basis", "apache-see")), ("Apache-2.0", "short header", ("apache-header", "apache-comply")),
    ("GPL-2.0", "notice", ("free-software", "gpl2-terms")), ("GPL-3.0", "notice", ("free-software", "gpl3-terms")),
    ("LGPL-3.0", "notice", ("free-software", "lgpl3-terms")), ("AGPL-3.0", "notice", ("free-software", "agpl3-terms")), ("Unlicense", "grant", ("unlicense-grant",)),
]


def known_sentences() -> list[tuple[str, str]]:
    """(normalised sentence, identifier); a sentence has one identifier."""
    out = {s: i for i, of in SENTENCES.items() for s in of}
    for licence, (long, short) in NAMES.items():
        for name in long:
            out.setdefault(UNDER + name, f"under {licence}")
            out.setdefault(name, f"name {licence}")
            out.setdefault("the " + name, f"name {licence}")
        for name in short:
            out.setdefault(UNDER + name, f"under {licence}")
            out.setdefault(name, f"short {licence}")
    # the notice rule for Apache names must not hide its header
    out[UNDER + "apache license version 2 0 the license"] = "apache-header"
    return sorted(out.items())


def all_rules() -> list[tuple[str, str, str]]:
    """(licence, rule, identifiers as they are looked for in a sequence)."""
    rows = [(licence, rule, "|" + "|".join(ids) + "|") for licence, rule, ids in RULES]
    for licence in NAMES:
        rows += [(licence, "statement", f"|under {licence}|"), (licence, "title", f"|name {licence}|"),
                 *[(licence, f"{before} and name", f"|{before}|{kind} {licence}|") for before in ("spdx", "license-is") for kind in ("name", "short")]]
    return rows


def sentences(text: Column) -> Column:
    """Normalised sentences of a text without line feeds that do not end one."""
    cut = F.regexp_replace(F.translate(text, UPPER, LOWER), END, "$1\n")
    plain = F.regexp_replace(cut, r"[^a-z0-9\n]+", " ")
    return F.transform(F.split(plain, "\n"), lambda s: F.regexp_replace(F.trim(s), OPENING, UNDER))


def licences(docs: DataFrame) -> DataFrame:
    """A row per document and rule that holds: ``doc_id``, ``licence``, ``rule``, number of the rule's sentences and the document's sequence."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    unwrapped = F.replace(F.replace(F.replace(text, F.lit("\n\n"), F.lit("\x1e")), F.lit("\n"), F.lit(" ")), F.lit("\x1e"), F.lit("\n"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       F.array(sentences(text), sentences(unwrapped)).alias("both"))
    cut = rows.select("doc_id", "row", F.posexplode("both").alias("way", "sentences")).select(
        "doc_id", "row", "way", F.posexplode("sentences").alias("place", "sentence"))
    known = spark.createDataFrame(known_sentences(), "sentence string, id string")  # some hundred rows
    found = cut.where("sentence <> ''").join(F.broadcast(known), "sentence").groupBy("row", "way").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("place", "id"))).alias("ids"))
    sequence = F.concat(F.lit("|"), F.concat_ws("|", F.col("ids.id")), F.lit("|"))
    rules = F.array(*[F.struct(F.lit(a).alias("licence"), F.lit(b).alias("rule"), F.lit(c).alias("pattern")) for a, b, c in all_rules()])
    held = found.withColumn("sequence", sequence).withColumn("held", F.filter(rules, lambda r: F.col("sequence").contains(r["pattern"])))
    # a rule gives way to one that holds and has it as a part
    last = F.filter("held", lambda r: ~F.exists("held", lambda q: (q["pattern"] != r["pattern"]) & q["pattern"].contains(r["pattern"])))
    each = held.select("row", "doc_id", "sequence", F.explode(last).alias("r"))
    return each.groupBy("row", "doc_id", "r.licence", "r.rule").agg(
        F.max(F.size(F.split("r.pattern", r"\|")) - 2).cast("bigint").alias("n_sentences"), F.max("sequence").alias("sequence")).drop("row")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql() -> str:
    """The same in SQL, over a table ``documents``."""
    known = ", ".join(f"({_literal(s)}, {_literal(i)})" for s, i in known_sentences())
    rules = ", ".join(f"({_literal(a)}, {_literal(b)}, {_literal(c)})" for a, b, c in all_rules())
    return f"""
with known(sentence, id) as (values {known}),
rules(licence, rule, pattern) as (values {rules}),
numbered as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
ways as (select row, doc_id, 0 as way, text from numbered union all
         select row, doc_id, 1, replace(replace(replace(text, chr(10) || chr(10), chr(30)), chr(10), ' '), chr(30), chr(10)) from numbered),
cut as (select row, doc_id, way, string_split(regexp_replace(regexp_replace(translate(text, '{UPPER}', '{LOWER}'),
          '{END}', '\\1' || chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)) as s from ways),
each as (select row, doc_id, way, unnest(range(len(s))) as place, unnest(s) as raw from cut),
named as (select e.row, e.doc_id, e.way, e.place, k.id from each e
          join known k on regexp_replace(trim(e.raw), {_literal(OPENING)}, '{UNDER}') = k.sentence),
found as (select row, doc_id, way, '|' || string_agg(id, '|' order by place) || '|' as sequence from named group by all),
held as (select f.*, r.* from found f join rules r on contains(f.sequence, r.pattern))
select h.doc_id, h.licence, h.rule, max(len(h.pattern) - len(replace(h.pattern, '|', '')) - 1) as n_sentences, max(h.sequence) as sequence
from held h where not exists (select 1 from held q where q.row = h.row and q.way = h.way and q.pattern <> h.pattern and contains(q.pattern, h.pattern))
group by h.row, h.doc_id, h.licence, h.rule
"""
