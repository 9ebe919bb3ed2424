"""Personal data: values of fixed shape, and the terms that give them away.

Values (e-mail and network addresses, card and phone numbers) are found by pattern and check.  Each value is a
protected entity.  A term close to it, within ``window`` words, may reveal it as well: a name that never stands
anywhere else identifies the owner of an address even where the address is masked.  How much it
reveals is measured in the corpus: with ``p`` the share of documents,

    PMI(term, entity) = log2 p(term, entity) / (p(term) p(entity)),   IC(entity) = -log2 p(entity)

and a term that carries ``disclosure`` of the entity's information content or more, ``PMI >= disclosure * IC``,
is taken out wherever it stands close to that entity.  A term seen with an entity in fewer than ``support`` different
surroundings tells nothing yet.

Terms are runs of letters and digits beyond ASCII marks, in lower case A-Z, of three characters or more.  Surroundings and values
are gathered where the text is read; only they, word counts of terms that may disclose, and the spans are shuffled, never texts.
A missing text is empty.  Spans count code points, the end excluded.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscript.llm import common
from twinscript.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]")
#: What lies between terms; written so that Python and the JVM take it alike.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = str.maketrans(UPPER, LOWER)
SHORTEST = 3
SENT_ROWS = 100_000
VALUES = ("doc_id bigint, n_chars bigint, a bigint, b bigint, kind array<string>, begin array<int>, finish array<int>, "
          "entity array<string>, near array<array<struct<term:string,begin:int,finish:int>>>, around array<bigint>")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def values(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all values: leftmost matches of each kind that do not overlap, those that fail a check left out."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in EMAIL.finditer(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    """One name for all ways to write a value."""
    if kind == "email":
        return f"email:{value.translate(LOWERED)}"
    if kind == "ip":
        return "ip:" + ".".join(str(int(p)) for p in value.split("."))
    return f"{kind}:{NOT_DIGIT.sub('', value)}"


def surroundings(text: str, start: int, end: int, spans: list[tuple[str, int, int]], window: int) -> list[tuple[str, int, int]]:
    """Terms among the ``window`` words on either side, in lower case, that are no part of a value."""
    found: list[tuple[str, int, int]] = []
    # look back and ahead until there are enough words; blanks may be any number
    for forward in (False, True):
        reach = 16 * window
        while True:
            a, z = (end, min(len(text), end + reach)) if forward else (max(0, start - reach), start)
            cut = [(m.start() + a, m.end() + a) for m in TERM.finditer(text[a:z])]
            # a word that the cut may have split
            if forward and z < len(text) and cut and cut[-1][1] == z:
                cut.pop()
            if not forward and a > 0 and cut and cut[0][0] == a:
                cut.pop(0)
            if len(cut) >= window or (z == len(text) if forward else a == 0):
                break
            reach *= 4
        found += cut[:window] if forward else cut[-window:]
    return [(text[a:z].translate(LOWERED), a, z) for a, z in found
            if z - a >= SHORTEST and not any(x < z and a < y for _, x, y in spans)]


def find_values(docs: DataFrame, window: int = 8) -> DataFrame:
    """A stored row per document: hashes of the text, its values, and the terms around each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches):
            cols: dict[str, list] = {k: [] for k in ("n_chars", "kind", "begin", "finish", "entity", "near", "around")}
            for text in b.column(1).to_pylist():
                spans = values(text)
                near = [surroundings(text, s, e, spans, window) for _, s, e in spans]
                cols["n_chars"].append(len(text))
                cols["kind"].append([k for k, _, _ in spans])
                cols["begin"].append([s for _, s, _ in spans])
                cols["finish"].append([e for _, _, e in spans])
                cols["entity"].append([entity(k, text[s:e]) for k, s, e in spans])
                cols["near"].append([[{"term": t, "begin": s, "finish": e} for t, s, e in n] for n in near])
                cols["around"].append([zlib.crc32(" ".join(t for t, _, _ in n).encode("utf-8", "surrogatepass")) for n in near])
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(cols["n_chars"], pa.int64()), b.column(2), b.column(3), pa.array(cols["kind"], pa.list_(pa.string())),
                pa.array(cols["begin"], pa.list_(pa.int32())), pa.array(cols["finish"], pa.list_(pa.int32())),
                pa.array(cols["entity"], pa.list_(pa.string())),
                pa.array(cols["near"], pa.list_(pa.list_(pa.struct([("term", pa.string()), ("begin", pa.int32()), ("finish", pa.int32())])))),
                pa.array(cols["around"], pa.list_(pa.int64()))],
                names=["doc_id", "n_chars", "a", "b", "kind", "begin", "finish", "entity", "near", "around"])

    keyed = common.texts(docs).withColumn("a", F.xxhash64("text")).withColumn("b", F.xxhash64(F.lit(1), F.col("text")))
    return cut_lineage(keyed.mapInArrow(run, VALUES).withColumn("row", F.monotonically_increasing_id()))


def disclosing_spans(docs: DataFrame, found: DataFrame, support: int = 2, disclosure: float = 0.9) -> DataFrame:
    """Stored rows (doc_id, a, b, begin, finish) of the terms that give away an entity they stand close to."""
    each = found.where(F.size("kind") > 0).select("row", "doc_id", "a", "b", F.explode(F.arrays_zip("entity", "near", "around")).alias("x")).select(
        "row", "doc_id", "a", "b", "x.entity", "x.around", F.explode("x.near").alias("t")).select(
        "row", "doc_id", "a", "b", "entity", "around", "t.term", "t.begin", "t.finish")
    # one row per surrounding, term and entity first, so that many copies of a text count as one
    seen = each.groupBy("entity", "term", "around").agg(F.count(F.lit(1)).alias("copies"))
    pairs = seen.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("surroundings")).where(F.col("surroundings") >= support)
    pairs = cut_lineage(pairs.drop("surroundings"))
    joint = each.join(pairs, ["entity", "term"]).select("entity", "term", "row").distinct().groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("n_both"))
    of_entity = found.where(F.size("kind") > 0).select(F.explode(F.array_distinct("entity")).alias("entity")).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_entity"))
    terms = cut_lineage(pairs.select("term").distinct())
    if terms.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        terms = F.broadcast(terms)
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    # words are counted before they are looked up: the terms asked for grow with the corpus, and so would the rows of a look-up
    of_term = docs.select(F.explode(F.array_distinct(F.split(lowered, BETWEEN))).alias("term")).groupBy(
        "term").agg(F.count(F.lit(1)).alias("n_term")).join(terms, "term")
    rated = (joint.join(of_entity, "entity").join(of_term, "term").withColumn("n_docs", F.lit(found.count()))
             .withColumn("pmi", F.log2(F.col("n_both") * F.col("n_docs") / (F.col("n_term") * F.col("n_entity"))))
             .withColumn("ic", F.log2(F.col("n_docs") / F.col("n_entity"))))
    telling = cut_lineage(rated.where((F.col("ic") > 0) & (F.col("pmi") >= disclosure * F.col("ic") - 1e-9)).select("entity", "term"))
    # copies of a row give the same spans once
    return cut_lineage(each.join(telling, ["entity", "term"]).select("doc_id", "a", "b", "begin", "finish").distinct())


def _count(kind: str) -> Column:
    return F.size(F.filter("kind", lambda k: k == kind)).cast("bigint")


def spans(docs: DataFrame, window: int = 8, support: int = 2, disclosure: float = 0.9) -> DataFrame:
    """A row per document: ``doc_id``, number of values of each kind, ``base_sha256`` and ``spans``."""
    found = find_values(docs, window)
    terms = disclosing_spans(docs, found, support, disclosure).groupBy("doc_id", "a", "b").agg(
        F.array_sort(F.collect_list(F.struct("begin", "finish"))).alias("terms"))  # at most 16 to a value of one text
    all_ = found.alias("f").join(terms.alias("t"), F.expr("f.doc_id <=> t.doc_id and f.a = t.a and f.b = t.b"), "left").select("f.*", "t.terms")
    listed = F.transform(F.arrays_zip("kind", "begin", "finish"), lambda x: F.concat_ws(":", x["kind"], x["begin"], x["finish"]))
    base = F.concat_ws(",", listed)
    extra = F.concat_ws(",", F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["begin"], x["finish"])))
    return all_.select(
        "doc_id", *[_count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.when(F.col("terms").isNull(), base).otherwise(F.concat_ws(",", F.nullif(base, F.lit("")), extra)).alias("spans"))


def generalise(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with a name of its kind in place of each span; of spans that overlap the one that starts first, then the longest."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], "[" + ("removed" if kind == "term" else kind) + "]"]
            at = end
        else:
            at = max(at, end)
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame, window: int = 8, support: int = 2, disclosure: float = 0.9) -> DataFrame:
    """``docs`` with values and disclosing terms replaced in ``text``, and ``n_chars`` to match if it is there.

    A missing text stays missing; all other columns are kept as they are.
    """
    found = find_values(docs, window)
    extra = disclosing_spans(docs, found, support, disclosure).groupBy("doc_id", "a", "b").agg(
        F.array_sort(F.collect_list(F.struct("begin", "finish"))).alias("_terms"))
    own, ta, tb, ka, kb, terms = common.free(docs.columns, "_id", "_a", "_b", "_ka", "_kb", "_terms")
    extra = cut_lineage(extra.select(F.col("doc_id").alias(own), F.col("a").alias(ta), F.col("b").alias(tb), F.col("_terms").alias(terms)))
    sent = F.broadcast(extra) if extra.limit(SENT_ROWS // 10 + 1).count() <= SENT_ROWS // 10 else extra
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(ka, F.xxhash64(text)).withColumn(kb, F.xxhash64(F.lit(1), text))
    joined = keyed.join(sent, F.col("doc_id").cast("bigint").eqNullSafe(F.col(own)) & (F.col(ka) == F.col(ta)) & (F.col(kb) == F.col(tb)), "left")
    table = joined.select(*docs.columns, terms)
    names, schema = docs.columns, docs.schema
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches):
            out = []
            for t, more in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if t is not None:
                    t = generalise(t, values(t) + [("term", m["begin"], m["finish"]) for m in more or ()])
                out.append(t)
            columns = list(b.columns[:len(names)])
            columns[at] = pa.array(out, pa.string())
            if count is not None:
                changed = [n if t is None else len(t) for t, n in zip(out, columns[count].to_pylist(), strict=True)]
                columns[count] = pa.array(changed, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return table.mapInArrow(run, schema)


def base_digest(text: str) -> str:
    """Checksum of the values of one text, as ``spans`` gives it."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in values(text)).encode()).hexdigest()
