"""Main text of web pages by the maximum-scoring run of words and tags.

A page is a sequence of words and tags.  Words score positive and tags negative, and the run with the largest sum,
found in one pass, is the content.  Weights are log odds of a kind of token inside and outside the article,
counted over a bounded sample of labelled pages, those that mark their article themselves (``<article>`` or
``<main>``); where nothing was learned fixed weights stand in.  On a page with such a mark, words outside it are a kind of
their own, which scores negative.

Elements that are not read as text at all (menus, forms, scripts, adverts, comments, …) are known by
name, role or the words of their class and id; they are left out of the sequence, and so out of the text.
Decoded text is put together by block: white space within one becomes one blank, blocks are joined by a
line feed.  Tags inside a mark cost next to nothing.  A missing or empty page, or one without words, gives an empty text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscript.llm import common

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKED = frozenset("article main".split())
#: Elements that are never part of the text.
LEFT_OUT = frozenset("nav footer aside form button select option menu dialog svg canvas object audio video map head datalist "
                     "fieldset label legend".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of classes and ids that name such parts.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar sidenav aside widget widgets menu "
    "menus nav navbar navigation breadcrumb breadcrumbs masthead topbar footer foot copyright share sharing social related recommended "
    "trending comment comments respond reply replies disqus discussion login search toolbar pagination pager skip hidden".split())
#: These name a part of the page only outside an article.
OUTER_HINTS = frozenset("header heading head top".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset dialog figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
WORD, OUTSIDE = "word", "word outside"
#: Used for kinds that no labelled page has: tags within text cost less than those that lay out a page.
DEFAULT = {WORD: 1.0, OUTSIDE: -1.0, "tag": -2.0} | {
    f"<{end}{name}>": -0.2 for end in ("", "/") for name in
    "p h1 h2 h3 h4 h5 h6 br b i em strong u s q small mark sub sup span code abbr cite time blockquote pre figure figcaption".split()}
HIGHEST = 8.0
HIGHEST_WORD = 1.0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _left_out(name: str, attributes: str, in_article: bool) -> bool:
    if name in LEFT_OUT or name == "header" and not in_article:
        return True
    if not attributes or name in MARKED or name in ("html", "body"):
        if name not in MARKED or not attributes:
            return False
    a = _attributes(attributes)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", "").lower()):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    parts = {p.lower() for p in NAME_PART.findall(a.get("class", "") + " " + a.get("id", ""))}
    if name in MARKED:
        # an article of its own kind: a reader's comment, a teaser
        return bool(parts & {"comment", "comments", "reply", "related", "teaser", "ad", "sponsored"})
    return bool(parts & HINTS) or not in_article and bool(parts & OUTER_HINTS)


def read(page: str) -> list[tuple[str, str, bool]]:
    """(kind, content, inside a marked article) of all tokens that count: text with kind "", tags with their name; an end tag begins with "/"."""
    out: list[tuple[str, str, bool]] = []
    stack: list[str] = []
    closed_at = -1  # height of the stack at the outermost element left out
    articles = 0
    at = 0

    def text(piece: str) -> None:
        if closed_at < 0 and piece and not piece.isspace():
            out.append(("", piece, articles > 0))
        elif closed_at < 0 and piece:
            out.append(("", " ", articles > 0))

    while True:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            return out
        text(page[at:m.start()])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"])
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        attributes = m["attributes"] if m["name"] else m["attributes2"]
        if m["end"] or m["end2"]:
            if name in stack:
                while True:
                    last = stack.pop()
                    if closed_at >= 0:
                        closed_at = -1 if len(stack) <= closed_at else closed_at
                        if closed_at < 0 and last != name:
                            out.append(("/" + last, "", articles > 0))
                    elif last in MARKED:
                        articles -= 1
                    if last == name:
                        break
                if closed_at < 0:
                    out.append(("/" + name, "", articles > 0))
            elif closed_at < 0 and name == "p":
                out.append(("/p", "", articles > 0))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if closed_at < 0 and name not in VOID and not attributes.endswith("/") and _left_out(name, attributes, articles > 0):
            closed_at = len(stack)
            out.append((name, "", articles > 0))
        if name in VOID or attributes.endswith("/"):
            if closed_at < 0:
                out.append((name, "", articles > 0))
            continue
        if closed_at < 0 or closed_at != len(stack):
            if closed_at < 0:
                out.append((name, "", articles > 0))
                if name in MARKED:
                    articles += 1
        stack.append(name)


def kinds(tokens: list[tuple[str, str, bool]]) -> Counter:
    """Numbers of tokens by (kind, inside the article) of a labelled page, empty for one without a mark."""
    if not any(t[2] for t in tokens):
        return Counter()
    out: Counter = Counter()
    for name, content, inside in tokens:
        if name:
            out["<" + name + ">", inside] += 1
        else:
            out[WORD, inside] += len(content.split())
    return out


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds by kind, words at least a little above zero and tags below; kinds seen seldom stay near their default."""
    n_in, n_out = (sum(n for (_, i), n in counts.items() if i is side) for side in (True, False))
    if not n_in or not n_out:
        return dict(DEFAULT)
    out = dict(DEFAULT)
    for kind in {k for k, _ in counts} - {WORD}:
        a, b = counts.get((kind, True), 0), counts.get((kind, False), 0)
        out[kind] = max(-HIGHEST, min(-0.05, math.log((a + 0.5) / (n_in + 1)) - math.log((b + 0.5) / (n_out + 1))))
    a, b = counts.get((WORD, True), 0), counts.get((WORD, False), 0)
    out[WORD] = max(0.1, min(HIGHEST_WORD, math.log((a + 0.5) / (n_in + 1)) - math.log((b + 0.5) / (n_out + 1))))
    out[OUTSIDE] = -out[WORD]
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the run with the largest sum, the first and then longest of equal ones; empty if none is above zero."""
    best, run = (0.0, 0, 0), (0.0, 0)
    for i, s in enumerate(scores):
        run = (run[0] + s, run[1]) if run[0] > 0 else (s, i)
        if run[0] > best[0] or run[0] == best[0] > 0 and run[1] == best[1]:
            best = run[0], run[1], i + 1
    return best[1], best[2]


def extract(page: str, weight: dict[str, float]) -> str:
    tokens = read(page)
    marked = any(inside and not name and content.strip() for name, content, inside in tokens)
    scores = []
    for name, content, inside in tokens:
        if name:
            # inside a mark, tags too are a kind of their own: all of these belong to the article
            scores.append(-0.05 if inside else weight.get("<" + name + ">", weight["tag"]))
        else:
            scores.append(len(content.split()) * weight[WORD if inside or not marked else OUTSIDE])
    start, end = best_run(scores)
    blocks, open_ = [], []
    for name, content, _ in tokens[start:end]:
        if not name:
            open_.append(content)
        elif name.lstrip("/") in BLOCKS:
            blocks.append("".join(open_))
            open_ = []
        elif name == "br":
            open_.append(" ")
    blocks.append("".join(open_))
    lines = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def fit(pages: DataFrame, sample: int = 2000) -> dict[str, float]:
    """Weights from the labelled ones among at most ``sample`` pages, smallest hash of the id first."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in common.pieces(batches, "html"):
            for page in b.column(0).to_pylist():
                total.update(kinds(read(page)))
        yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in total], pa.string()), "inside": pa.array([i for _, i in total], pa.bool_()),
                                          "n": pa.array(list(total.values()), pa.int64())})

    chosen = pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    found = pages.where("html is not null").join(F.broadcast(chosen), "page_id", "left_semi").select("html")
    # a row per kind of token
    rows = found.mapInArrow(count, "kind string, inside boolean, n bigint").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    return weights({(r.kind, r.inside): r.n for r in rows})


def main_text(pages: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page; extra columns are left out, repeated rows stay."""
    learned = fit(pages) if weight is None else weight

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches, "html", 4 << 20):
            out = [extract(page, learned) for page in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    table = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return table.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
