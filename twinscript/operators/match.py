"""Which documents are translations of each other: by name, declared links and similarity.

All pair-producing joins are on keys that hold at most one document per language, so a group
yields pairs of languages, never pairs of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.functions import lang as L
from twinscript.functions import paths, scores
from twinscript.session import cut_lineage

# Thresholds and weights of scored matching, and the approximation rate of names.
MIN_SIZE_RATIO, MIN_NAME_MATCH = 0.7, 0.9
SIZE_WEIGHT, NAME_WEIGHT = 0.2, 0.8
NAME_ERRORS = 0.1

PAIR_COLUMNS = ["path", "lang", "size", "doc_id", "name"]


def _pair(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Join documents of the same key across languages, smaller language code first."""
    keep = [c for c in PAIR_COLUMNS if c in candidates.columns]
    a = candidates.select(*key, *[F.col(c).alias(f"a_{c}") for c in keep])
    b = candidates.select(*key, *[F.col(c).alias(f"b_{c}") for c in keep])
    joined = a.join(b, key).where(F.col("a_lang") < F.col("b_lang"))
    named = {c: c for c in keep} | {"doc_id": "doc"}
    return joined.select(
        F.concat_ws("|", "a_path", "b_path").alias("pair_id"), *key,
        *[F.col(f"a_{c}").alias(f"src_{named[c]}") for c in keep],
        *[F.col(f"b_{c}").alias(f"trg_{named[c]}") for c in keep])


def identical(resources: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Documents of one corpus with the same base name in different languages.

    ``key`` with ``lang`` identifies a document, so a key has at most one row per language.
    """
    return _pair(resources, key or ["slot", "branch", "basename"])


def pairs(docs: DataFrame, key: list[str]) -> DataFrame:
    """All language pairs (i < j) of each translation unit or document family."""
    return _pair(docs, key)


def stripped_names(resources: DataFrame, column: str = "basename") -> DataFrame:
    """Add ``stripped``: the name without its own language's marker."""
    codes = F.broadcast(L.codes(resources.sparkSession)).select(
        F.col("two").alias("lang"), "three", F.col("name").alias("name_en"))
    joined = resources.join(codes, "lang", "left")
    stem = paths.strip_suffix(F.col(column))
    known = L.strip_language(stem, F.col("lang"), F.col("three"), F.col("name_en"))
    return joined.withColumn("stripped", F.coalesce(
        known, F.trim(F.regexp_replace(stem, r"[^\p{L}\p{N}]+", " ")))).drop("three", "name_en")


def no_lang(resources: DataFrame, column: str = "basename",
            key: tuple[str, ...] = ("slot", "branch")) -> DataFrame:
    """Documents whose names are the same once language markers are removed.

    When several documents of one language share a stripped name, the last path stands for
    them, as one name maps to one file.
    """
    named = stripped_names(resources, column)
    keep = [c for c in PAIR_COLUMNS if c in named.columns and c != "lang"]
    one = (named.groupBy(*key, "stripped", "lang")
           .agg(F.max_by(F.struct(*keep), "path").alias("r")).select(*key, "stripped", "lang", "r.*"))
    return _pair(one, [*key, "stripped"])


def _tolerance(name: Column, max_edits: int | None) -> Column:
    edits = F.ceil(F.length(name) * NAME_ERRORS).cast("int")
    return edits if max_edits is None else F.least(edits, F.lit(max_edits))


# up to so many edits, partners meet through strings with as many characters deleted
DELETED = 2


BASE = np.uint64(0x9E3779B97F4A7C15)
# sizes of the stretches by which names with many edits meet
GRAMS = (2, 3, 4, 5)


def _prefixes(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all beginnings of a name, and the powers that put such hashes together."""
    signs = np.frombuffer(name.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    power = np.ones(len(signs) + 1, dtype=np.uint64)
    out = np.zeros(len(signs) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i, sign in enumerate(signs):
            power[i + 1] = power[i] * BASE
            out[i + 1] = out[i] * BASE + sign
    return out, power


def _cut_out(h: np.ndarray, power: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the name without its signs from ``start`` to ``stop``."""
    n = len(h) - 1
    with np.errstate(over="ignore"):
        return h[start] * power[n - stop] + h[n] - h[stop] * power[n - stop]


def deletions(name: str, edits: int) -> np.ndarray:
    """Hashes of all strings that are left when one or two characters, or fewer, are taken out of a name."""
    h, power = _prefixes(name)
    n = len(h) - 1
    i = np.arange(n)
    out = [h[n:], _cut_out(h, power, i, i + 1)]
    if edits > 1 and n > 1:
        i, j = np.triu_indices(n, 1)
        with np.errstate(over="ignore"):
            middle = h[j] - h[i + 1] * power[j - i - 1]
            tail = h[n] - h[j + 1] * power[n - j - 1]
            out.append((h[i] * power[j - i - 1] + middle) * power[n - j - 1] + tail)
    return np.unique(np.concatenate(out))


def infixes_out(name: str, longest: int) -> np.ndarray:
    """Hashes of where a stretch of at most ``longest`` characters, or none, is taken out of a name, and what is left."""
    h, power = _prefixes(name)
    n = len(h) - 1
    start, size = np.meshgrid(np.arange(n + 1), np.arange(min(longest, n) + 1), indexing="ij")
    some = start + size <= n
    start, size = start[some], size[some]
    with np.errstate(over="ignore"):
        return np.unique(_cut_out(h, power, start, start + size) * BASE + start.astype(np.uint64))


def _with_hashes(df: DataFrame, of: Callable[..., np.ndarray], *arguments: str) -> DataFrame:
    """A row for each hash that ``of`` gives for the columns named, in ``variant``."""
    columns = df.columns
    places = [columns.index(a) for a in arguments]

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [of(*row).view(np.int64) for row in zip(*[b.column(p).to_pylist() for p in places], strict=True)]
            ends = np.cumsum([0, *map(len, found)])
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *found]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*columns, "variants"])

    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in df.dtypes), "variants array<bigint>"])
    return df.mapInArrow(hashed, schema).withColumn("variant", F.explode("variants")).drop("variants")


def _grams(name: str, sizes: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each stretch of each size: its size ``q``, where it starts, and the stretch."""
    q = sizes.withColumn("q", F.explode(F.array(*[F.lit(x) for x in GRAMS]))).where(F.length(name) >= F.col("q"))
    at = F.sequence(F.lit(1), F.length(name) - F.col("q") + 1)
    return q.withColumn("at", F.explode(at)).select(*keep, "q", "at", F.substring(F.col(name), F.col("at"), F.col("q")).alias("gram"))


def _by_rare_grams(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of names within the tolerance of the wanted one that share one of its rarest stretches.

    An edit destroys ``q`` stretches of ``q`` characters at most, so of any ``q k + 1`` stretches of a name one stays whole
    in every name within ``k`` edits, at most ``k`` places away.  Those that the fewest names have are taken, of the size for
    which they are rarest: what all names of a corpus have in common is left out.
    """
    every = _grams("match", names.select("slot", "lang", F.col("name").alias("match"), "path"), ["slot", "lang", "match", "path"])
    counts = every.groupBy("slot", "lang", "q", "gram").agg(F.count(F.lit(1)).alias("n"))
    own = _grams("name", wanted.withColumn("k", _tolerance(F.col("name"), None)), ["slot", "lang", "name", "k"])
    asked = own.join(counts, ["slot", "lang", "q", "gram"], "left").fillna(0, ["n"])
    one = ["slot", "lang", "name", "q"]
    first = asked.withColumn("rank", F.row_number().over(Window.partitionBy(*one).orderBy("n", "at"))).where(F.col("rank") <= F.col("q") * F.col("k") + 1)
    # sizes that leave too few stretches do not count
    cost = first.groupBy(*one).agg(F.sum("n").alias("cost"), F.count(F.lit(1)).alias("found"), F.first("k").alias("k")).where(
        F.col("found") == F.col("q") * F.col("k") + 1)
    best = cost.groupBy("slot", "lang", "name").agg(F.min(F.struct("cost", "q"))["q"].alias("q"))
    chosen = first.join(best, one).select(*one, "gram", F.col("at").alias("place"), "k")
    hits = chosen.join(every, ["slot", "lang", "q", "gram"]).where(F.abs(F.col("at") - F.col("place")) <= F.col("k"))
    pairs = hits.select("slot", "lang", "name", "k", "match", "path").distinct()
    return pairs.withColumn("distance", F.levenshtein("name", "match")).where(F.col("distance") <= F.col("k")).select(
        "slot", "name", "lang", "distance", "path", "match")


def similar(wanted: DataFrame, names: DataFrame, max_edits: int | None = None) -> DataFrame:
    """The closest name in a missing language for each ``(slot, name, lang)`` that lacks one.

    ``wanted(slot, name, lang)`` asks for a partner of ``name`` in ``lang``;
    ``names(slot, lang, name, path)`` holds what there is.  A partner differs in at most one edit
    per ten characters, and ``max_edits`` at most if that is given.  Strings within k edits share a
    string made by k deletions, so candidates for one and two edits come from an equi-join on those; a name has
    as many neighbours as its spelling allows, however many rows there are.  Each further edit is tried only for
    names that found nothing closer; from three edits on these meet through whole pieces of the name.
    """
    wanted = wanted.where(F.col("name").rlike(r"\p{L}")).distinct()
    # one file stands for a name, the smallest path
    names = cut_lineage(names.groupBy("slot", "lang", "name").agg(F.min("path").alias("path")))
    found = (wanted.join(names, ["slot", "lang", "name"])
             .select("slot", "name", "lang", F.lit(0).alias("distance"), "path",
                     F.col("name").alias("match")))
    rest = cut_lineage(wanted.join(found, ["slot", "name", "lang"], "left_anti"))
    for k in range(1, min(DELETED, DELETED if max_edits is None else max_edits) + 1):
        asked = rest.where(_tolerance(F.col("name"), max_edits) >= k)
        if asked.isEmpty():
            break
        edits = F.lit(k).alias("edits")
        left = _with_hashes(asked.select("slot", "lang", "name", edits), deletions, "name", "edits").drop("edits")
        right = _with_hashes(names.select("slot", "lang", F.col("name").alias("match"), "path", edits), deletions, "match", "edits").drop("edits")
        hits = (left.join(right, ["slot", "lang", "variant"]).drop("variant").distinct()
                .withColumn("distance", F.levenshtein("name", "match", k)).where("distance >= 0"))
        best = cut_lineage(hits.groupBy("slot", "name", "lang")
                           .agg(F.min(F.struct("distance", "path", "match")).alias("b"))
                           .select("slot", "name", "lang", "b.*"))
        found = found.unionByName(best)
        rest = cut_lineage(rest.join(best, ["slot", "name", "lang"], "left_anti"))
    far = rest.where(_tolerance(F.col("name"), max_edits) > DELETED)
    if (max_edits is None or max_edits > DELETED) and not far.isEmpty():
        near = _by_rare_grams(far, names)
        if max_edits is not None:
            near = near.where(F.col("distance") <= max_edits)
        found = found.unionByName(near.groupBy("slot", "name", "lang").agg(
            F.min(F.struct("distance", "path", "match")).alias("b")).select("slot", "name", "lang", "b.*"))
    return found


def missing(resources: DataFrame, key: tuple[str, ...] = ("slot",),
            name: str = "basename") -> DataFrame:
    """Languages of the corpus each document family lacks; names without a letter are skipped."""
    languages = resources.groupBy(*key).agg(F.collect_set("lang").alias("corpus_langs"))
    families = (resources.where(paths.strip_suffix(F.col(name)).rlike(r"\p{L}"))
                .groupBy(*key, name).agg(F.collect_set("lang").alias("langs")))
    return families.join(languages, list(key)).select(
        *key, name, F.explode(F.array_except("corpus_langs", "langs")).alias("lang"))


def unaligned(candidates: DataFrame, aligned: DataFrame) -> DataFrame:
    """Candidates whose source has no document aligned in the target's language yet.

    Both directions of a pair count as one candidate; the smaller path is the source.
    """
    one_way = candidates.select(
        F.least("src_path", "trg_path").alias("src_path"),
        F.greatest("src_path", "trg_path").alias("trg_path")).distinct().withColumn(
        "trg_lang", paths.language(F.col("trg_path")))
    done = aligned.select("src_path", paths.language(F.col("trg_path")).alias("trg_lang")).distinct()
    return one_way.join(done, ["src_path", "trg_lang"], "left_anti").select("src_path", "trg_path")


def candidates(pairs_: DataFrame) -> DataFrame:
    """Per source document the sorted list of its candidate targets.

    A document has at most one candidate per language and matcher, which bounds the list.
    """
    return pairs_.groupBy("src_path").agg(F.array_sort(F.collect_set("trg_path")).alias("candidates"))


def cascade(stages: list[DataFrame]) -> DataFrame:
    """One partner per (family, language): from the first stage that has one.

    Each stage is ``(slot, family, lang, path)``, most trusted first; among several partners of a
    stage the smallest path is taken.
    """
    tagged = [s.select("slot", "family", "lang", "path").withColumn("stage", F.lit(i))
              for i, s in enumerate(stages)]
    union = tagged[0]
    for s in tagged[1:]:
        union = union.unionByName(s)
    return (union.groupBy("slot", "family", "lang").agg(F.min(F.struct("stage", "path")).alias("m"))
            .select("slot", "family", "lang", "m.path", "m.stage"))


def _one_of_each(docs: DataFrame, by: list[str]) -> DataFrame:
    """One document for all of a language that are the same in ``by``: that of the last path."""
    rest = [c for c in docs.columns if c not in by and c != "lang"]
    return docs.groupBy(*by, "lang").agg(F.max_by(F.struct(*rest), "path").alias("r")).select(*by, "lang", "r.*")


def _infix_pairs(docs: DataFrame, key: list[str], found: DataFrame, least: float) -> DataFrame:
    """Pairs of documents whose ``bare`` names differ in one stretch, for those that ``found`` gives no partner in a language of their key.

    Both names without the differing stretch are the same string, cut at the same place.  One document stands for all of a
    language that are the same without it, so a document has at most as many partners as its name has stretches, and its
    best one in each language is kept.  Stretches may be as long as ``least`` of the name match allows.
    """
    langs = docs.select(*key, F.col("lang").alias("other")).distinct()
    have = found.select(F.col("src_path").alias("path"), F.col("trg_lang").alias("other")).unionByName(
        found.select(F.col("trg_path").alias("path"), F.col("src_lang").alias("other")))
    lacking = docs.join(langs, key).where("lang <> other").join(have, ["path", "other"], "left_anti")
    # the stretches of both names together
    longest = F.floor((1 - least) * 2 * (F.length("name") + 8)).cast("int")
    asked = _with_hashes(lacking.withColumn("longest", longest), infixes_out, "bare", "longest").drop("longest")
    there = _with_hashes(_one_of_each(docs, [*key, "name"]).withColumn("longest", longest), infixes_out, "bare", "longest").drop("longest")
    one = there.groupBy(*key, "variant", F.col("lang").alias("other")).agg(F.min_by(
        F.struct("path", "size", "name", "bare"), F.struct(F.length("bare"), "path")).alias("o"))
    hits = asked.join(one, [*key, "variant", "other"])
    sides = hits.select(*key, "other", F.struct("path", "lang", "size", "name", "bare").alias("mine"),
                        F.struct("o.path", F.col("other").alias("lang"), "o.size", "o.name", "o.bare").alias("theirs"))
    ins, inf = scores.infixes(F.col("mine.bare"), F.col("theirs.bare"))
    paths_ = [F.length("mine.path"), F.length("theirs.path")]
    name_match = (1 - (F.length(ins) + F.length(inf)) / (F.length("mine.name") + F.length("theirs.name"))) * (F.least(*paths_) / F.greatest(*paths_))
    best = sides.withColumn("m", name_match).where(F.col("m") >= least).groupBy("mine", "other").agg(
        F.max(F.struct("m", "theirs"))["theirs"].alias("theirs"))
    swap = F.col("mine.lang") > F.col("theirs.lang")
    a, b = F.when(swap, F.col("theirs")).otherwise(F.col("mine")), F.when(swap, F.col("mine")).otherwise(F.col("theirs"))
    return best.select(a.alias("a"), b.alias("b")).distinct().select(
        *[F.col(f"{x}.{c}").alias(f"{side}_{c}") for x, side in (("a", "src"), ("b", "trg")) for c in ("path", "lang", "size", "name", "bare")])


def scored(resources: DataFrame, known: DataFrame, name: str = "basename",
           key: tuple[str, ...] = ("slot",), min_size: float = MIN_SIZE_RATIO,
           min_name: float = MIN_NAME_MATCH, stretches: bool = True) -> DataFrame:
    """Candidate pairs with a score from name and size; known alignments score 1.

    Names are equal; or both carry their language and are equal without it; or, with ``stretches`` and for documents without such a
    partner in a language, both carry it and differ in one more stretch.  Then the name score is the share of the full names' characters outside the
    differing infixes.  Of documents with one name and language the last path counts.
    """
    codes = F.broadcast(L.codes(resources.sparkSession)).select(F.col("two").alias("lang"), "three", F.col("name").alias("name_en"))
    docs = resources.select(*key, "path", "lang", "size", F.col(name).alias("name"))
    marks = [F.col("name"), F.col("lang"), F.col("three"), F.col("name_en")]
    marked = docs.join(codes, "lang", "left").withColumn("bare", L.without_last_marker(*marks)).withColumn(
        "has", F.coalesce(L.names_language(*marks), F.lit(False))).drop("three", "name_en")
    same = _pair(_one_of_each(docs, [*key, "name"]).withColumn("stripped", F.col("name")), [*key, "stripped"]).withColumn("kind", F.lit(0))
    cross = no_lang(docs, "name", key).withColumn("kind", F.lit(1))
    fields = ["kind", "src_lang", "trg_lang", "src_size", "trg_size", "src_name", "trg_name"]
    found = cut_lineage(same.unionByName(cross).groupBy("src_path", "trg_path").agg(
        F.min_by(F.struct(*fields), "kind").alias("p")).select("src_path", "trg_path", "p.*"))
    own = marked.select("path", "has", "bare")
    for side in ("src", "trg"):
        found = found.join(own.select(F.col("path").alias(f"{side}_path"), F.col("has").alias(f"{side}_has"), F.col("bare").alias(f"{side}_bare")), f"{side}_path")
    both = found
    if stretches:
        both = found.unionByName(_infix_pairs(marked.where("has").drop("has"), list(key), found, min_name).withColumns(
            {"kind": F.lit(2), "src_has": F.lit(True), "trg_has": F.lit(True)}))
    ins, inf = scores.infixes(F.col("src_bare"), F.col("trg_bare"))
    total = F.length("src_name") + F.length("trg_name")
    lengths = [F.length("src_path"), F.length("trg_path")]
    path_ratio = F.least(*lengths) / F.greatest(*lengths)
    name_match = F.when(F.col("kind") == 0, path_ratio).when(
        F.col("src_has") & F.col("trg_has"), (1 - (F.length(ins) + F.length(inf)) / total) * path_ratio)
    size_match = F.least("src_size", "trg_size") / F.greatest("src_size", "trg_size")
    out = (both.withColumn("size_match", F.coalesce(size_match, F.lit(0.0)))
           .where(F.col("size_match") >= min_size)
           .withColumn("name_match", name_match).where(F.col("name_match") >= min_name)
           .withColumn("match", F.lit(NAME_WEIGHT) * F.col("name_match") + F.lit(SIZE_WEIGHT) * F.col("size_match"))
           .select("src_path", "trg_path", "name_match", "size_match", "match", F.lit(False).alias("aligned")))
    done = known.select("src_path", "trg_path").distinct()
    fresh = out.join(done, ["src_path", "trg_path"], "left_anti")
    null = F.lit(None).cast("double")
    return fresh.unionByName(done.select(
        "src_path", "trg_path", null.alias("name_match"), null.alias("size_match"),
        F.lit(1.0).alias("match"), F.lit(True).alias("aligned")))


def without_languages(families: DataFrame, resources: DataFrame, column: str = "basename", fuzzy: bool = False,
                      key: tuple[str, ...] = ("slot",)) -> DataFrame:
    """``*key, family, lang, path, distance``: for each language that a family lacks, the document whose name without its language is the
    family's without all languages that the family has.

    ``families`` has ``*key, family, langs, lang``: its name, the languages it has, and one it lacks.  Of several documents the last path
    counts.  With ``fuzzy``, families that find none get the closest name, as ``similar`` does.
    """
    codes = F.broadcast(L.codes(resources.sparkSession))
    each = families.select(*key, "family", F.explode("langs").alias("two")).distinct().join(codes, "two").groupBy(*key, "family").agg(
        F.array_sort(F.collect_list(F.struct("two", "three", "name"))).alias("had"))
    bare = F.aggregate("had", paths.strip_suffix(F.col("family")), lambda text, x: L.strip_language(text, x["two"], x["three"], x["name"]))
    asked = families.select(*key, "family", "lang").distinct().join(each.select(*key, "family", bare.alias("name")), [*key, "family"])
    names = stripped_names(resources, column).groupBy(*key, "lang", F.col("stripped").alias("name")).agg(F.max("path").alias("path"))
    equal = asked.join(names, [*key, "lang", "name"]).select(*key, "family", "lang", "path", F.lit(0).alias("distance"))
    if not fuzzy:
        return equal
    rest = asked.join(equal, [*key, "family", "lang"], "left_anti")
    slot = F.to_json(F.struct(*key))
    near = similar(rest.select(slot.alias("slot"), "name", "lang"), names.select(slot.alias("slot"), "lang", "name", "path"))
    closest = near.select(F.col("slot").alias("_slot"), "name", "lang", "distance", "path")
    return equal.unionByName(rest.withColumn("_slot", slot).join(closest, ["_slot", "name", "lang"]).select(*key, "family", "lang", "path", "distance"))


# Forms in which web pages link to their translations.
ALTERNATE = r'(?s)<link\s+rel="alternate".*?hreflang="(..)(?:-..)?"\s+href="(.*?)"'
SWITCHER = r'(?s)<ul class="menu menu--language-switcher">(.*?)</ul>'
SWITCHER_ITEM = r'href="([^"]*)">([^>]*?)</a>'
SHORT_LIST = r'(?s)<ul\s+class="..">\s*(<li class="..".*?)</ul'
SHORT_ITEM = r'(?s)<li[^>]*class="(..)".*?href="(.*?)"'
SWEDISH, FINNISH = r'<a href="([^"]+)">På svenska</a>', r'<a href="([^"]+)">Suomeksi</a>'
GENERIC = {
    "sv": "på svenska|in swedish|svenska|swedish|sv|sv-se|sv_se|swe",
    "fi": "suomeksi|in finnish|finnish|fi|fi-fi|fi_fi|fin",
    "en": "in english|en|en-us|en-uk|en_us|en_uk|eng",
}


def _entries(html: Column, pattern: str, lang_group: int, href_group: int) -> Column:
    """All declarations of a form: the text is searched once, each hit then taken apart."""
    hits = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    return F.transform(hits, lambda x: F.struct(
        F.regexp_extract(x, pattern, lang_group).alias("lang"), F.regexp_extract(x, pattern, href_group).alias("href")))


def _as_links(entries: Column, suffix: str = "", lower: bool = False) -> Column:
    return F.transform(entries, lambda e: F.struct(
        (F.lower(e["lang"]) if lower else e["lang"]).alias("lang"),
        F.concat(e["href"], F.lit(suffix)).alias("href")))


def _maybe(html: Column, pattern: str, lang: str, suffix: str = "") -> Column:
    href = F.regexp_extract(html, pattern, 1)
    link = F.array(F.struct(F.lit(lang).alias("lang"), F.concat(href, F.lit(suffix)).alias("href")))
    return F.when(href != "", link).otherwise(F.slice(link, 1, 0))


def extract_links(pages: DataFrame, html: str = "html", page: str = "path") -> DataFrame:
    """``(page, lang, href)`` of declared translations: the first link style with a hit counts.

    Of several links of a style to one language the last is taken, except in the generic
    style, where it is the first.
    """
    h = F.col(html)
    alternate = _as_links(_entries(h, ALTERNATE, 1, 2), ".html")
    switcher = _as_links(_entries(F.regexp_extract(h, SWITCHER, 1), SWITCHER_ITEM, 2, 1), ".html", lower=True)
    short = _as_links(_entries(F.regexp_extract(h, SHORT_LIST, 1), SHORT_ITEM, 1, 2))
    short = F.filter(F.transform(short, lambda e: F.struct(
        e["lang"].alias("lang"), paths.resolve_href(e["href"], F.col(page)).alias("href"))),
        lambda e: ~e["href"].contains("missinglanguageversion") & (e["href"] != F.col(page)))
    nordic = F.concat(_maybe(h, SWEDISH, "sv", ".html"), _maybe(h, FINNISH, "fi", ".html"))
    generic = F.concat(*[_maybe(h, rf'(?i)href="([^"]+)"[^>]*>\s*(?:{words})\s*<', lang)
                         for lang, words in GENERIC.items()])
    styles = [alternate, switcher, short, nordic, generic]
    chosen = None
    for i, style in enumerate(styles):
        named = f"_style{i}"
        pages = pages.withColumn(named, style)
        hit = F.col(named)
        chosen = F.when(F.size(hit) > 0, hit) if chosen is None else chosen.when(F.size(hit) > 0, hit)
    links = pages.withColumn("_links", chosen).select(F.col(page).alias("page"), F.posexplode("_links").alias("n", "link"))
    return links.groupBy("page", "link.lang").agg(F.max_by("link.href", "n").alias("href"))


def language_links(links: DataFrame, imported: DataFrame) -> DataFrame:
    """Documents connected by a declared translation link.

    ``links(page, lang, href)``; ``imported(imported_from, path)`` says which document a page became.
    A link that names no imported page is tried again without its suffix; links to the page
    itself do not count.
    """
    one = imported.groupBy("imported_from").agg(F.max("path").alias("path"))
    l = links.withColumn("target", paths.resolve_href(F.col("href"), F.col("page"))).where(
        F.col("target") != F.col("page"))
    source = one.select(F.col("imported_from").alias("page"), F.col("path").alias("src_path"))
    full = one.select(F.col("imported_from").alias("target"), F.col("path").alias("_full"))
    short = one.select(F.col("imported_from").alias("_cut"), F.col("path").alias("_short"))
    return (l.withColumn("_cut", F.regexp_replace("target", r"(?i)\.[a-z]+$", ""))
            .join(source, "page").join(full, "target", "left").join(short, "_cut", "left")
            .withColumn("trg_path", F.coalesce("_full", "_short"))
            .where(F.col("trg_path") != F.col("src_path"))
            .select("src_path", F.col("lang").alias("trg_lang"), "trg_path"))
