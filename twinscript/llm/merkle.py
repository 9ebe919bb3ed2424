"""A manifest of a dataset as a content-addressed tree of digests, and the proofs its leaves ask for.

A leaf is the digest of a row.  Per group the leaves stand in order, and every ``arity`` consecutive nodes become the
digest of their digests until one, the group's subroot, remains; the subroots, in order of their groups, likewise become the root.

Nodes are stored as records of a digest and its children's.  ``levels`` levels of a tree make a block, which is
stored under the digest of its topmost node, equal blocks once; the topmost nodes of a tier's blocks are the nodes
of the tier above.  A leaf asks from the root down: within a block the digits of its rank choose the child at each
level, the children that are not chosen are collected, and at the bottom the digest of the next tier's block is
reached.  The segments of a path are reversed at last, so that a proof reads from leaf to root.  All leaves of a block walk it in one task, and
the path to a block is walked once for all that lies below; no task holds more than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscript.llm import common
from twinscript.operators.numbering import number_rows, plain
from twinscript.session import cut_lineage

LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left: string, right: string>>"
BLOCK = "g bigint, block bigint, n bigint, digest string, records binary"


def digest(values: list[Column]) -> Column:
    """Hex SHA-256 of the values one after the other, each as its length in bytes, a colon and the value, or ``-`` if missing."""
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*[field(c) for c in values]), 256)


def height(n: int, arity: int) -> int:
    """Levels above ``n`` nodes."""
    out = 0
    while n > 1:
        n, out = ceil(n / arity), out + 1
    return out


def parent(children: Iterable[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def pack_records(records: dict[str, list[str]]) -> bytes:
    """Each record as its digest, the number of its children and their digests."""
    return b"".join(bytes.fromhex(d) + bytes([len(c)]) + bytes.fromhex("".join(c)) for d, c in records.items())


def unpack_records(raw: bytes) -> dict[str, list[str]]:
    out, at = {}, 0
    while at < len(raw):
        stop = at + 33 + 32 * raw[at + 32]
        out[raw[at:at + 32].hex()] = [raw[p:p + 32].hex() for p in range(at + 33, stop, 32)]
        at = stop
    return out


def grow(nodes: list[str], levels: int, arity: int) -> tuple[str, dict[str, list[str]]]:
    """The digest that ``levels`` levels above at most ``arity ** levels`` nodes end in, and the records of these levels."""
    records: dict[str, list[str]] = {}
    for _ in range(levels):
        runs = [nodes[i:i + arity] for i in range(0, len(nodes), arity)]
        nodes = [parent(r) for r in runs]
        records.update(zip(nodes, runs, strict=True))
    return nodes[0], records


def walk(top: str, records: dict[str, list[str]], rank: int, levels: int, arity: int) -> tuple[str, list[tuple[str, str]]]:
    """The node that the digits of ``rank`` lead to from ``top``, and what stood left and right of each chosen child, from the bottom up."""
    segment = []
    for level in reversed(range(levels)):
        children, digit = records[top], rank // arity ** level % arity
        segment.append(("".join(children[:digit]), "".join(children[digit + 1:])))
        top = children[digit]
    return top, segment[::-1]


def build(nodes: DataFrame, arity: int = 2, levels: int = LEVELS) -> list[DataFrame]:
    """The stored tiers above ``g, i, digest, n``: node ``i`` of ``n`` of tree ``g``.

    A tier has a row per block: tree, number of the block, nodes the tree has at the tier's foot, topmost digest, packed records.
    """
    width, tiers = arity ** levels, []
    most = nodes.agg(F.max("n")).first()[0] or 0

    def block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        n = rows.column("n")[0].as_py()
        order = rows.sort_by("i")
        top, records = grow(order.column("digest").to_pylist(), min(levels, height(n, arity)), arity)
        return pa.table({"g": [key[0].as_py()], "block": [key[1].as_py()], "n": [n], "digest": [top],
                         "records": pa.array([pack_records(records)], pa.binary())})

    while True:
        dealt = nodes.select("g", F.floor(F.col("i") / F.lit(width)).cast("bigint").alias("block"), "i", "digest", "n")
        tiers.append(cut_lineage(dealt.groupBy("g", "block").applyInArrow(block, BLOCK)))
        if most <= width:
            return tiers
        most = ceil(most / width)
        nodes = tiers[-1].select("g", F.col("block").alias("i"), "digest", F.ceil(F.col("n") / F.lit(width)).cast("bigint").alias("n"))


def descend(tiers: list[DataFrame], above: DataFrame, leaves: DataFrame, arity: int = 2, levels: int = LEVELS) -> DataFrame:
    """``leaves`` (tree ``g``, rank ``i``, ``n`` leaves in the tree, further columns) with ``digest``, the node their request ends at,
    ``steps``, what stands left and right of it and of each node above, from the leaf up, and the columns of
    ``above`` (a row per tree: ``g``, ``steps`` above its top, further columns)."""
    width, more = arity ** levels, [c for c in above.columns if c not in ("g", "steps")]
    kinds = dict(above.dtypes)
    paths = tiers[-1].join(above, "g").select("g", "block", "digest", "steps", *more)

    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table, path: pa.Table) -> pa.Table:
        # a tier has one path to each of its blocks
        top, steps = path.column("digest")[0].as_py(), path.column("steps")[0].as_py()
        records = unpack_records(path.column("records")[0].as_py())
        high = min(levels, height(asked.column("n")[0].as_py(), arity))
        rest = [(s["left"], s["right"]) for s in steps]
        reached, left, right, ends = [], [], [], [0]
        for rank in asked.column("i").to_pylist():
            node, segment = walk(top, records, rank % width, high, arity)
            reached.append(node)
            for a, z in (*segment, *rest):
                left.append(a)
                right.append(z)
            ends.append(len(left))
        out = {c: asked.column(c) for c in asked.column_names if c != "block"}
        out["digest"] = pa.array(reached, pa.string())
        out["steps"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
        for c in more:
            out[c] = pa.array([path.column(c)[0].as_py()] * asked.num_rows, path.column(c).type)
        return pa.table(out)

    for t in reversed(range(len(tiers))):
        if t:
            asked = tiers[t - 1].select("g", F.col("block").alias("i"), F.ceil(F.col("n") / F.lit(width)).cast("bigint").alias("n"))
        else:
            asked = leaves
        store = tiers[t].select("digest", "records").dropDuplicates(["digest"])
        found = paths.join(store, "digest").select("g", "block", "digest", "steps", "records", *more)
        dealt = asked.withColumn("block", F.floor(F.col("i") / F.lit(width)).cast("bigint"))
        schema = ", ".join([*(f"`{c}` {kind}" for c, kind in asked.dtypes), "digest string", f"steps {STEPS}", *(f"`{c}` {kinds[c]}" for c in more)])
        paths = dealt.groupBy("g", "block").cogroup(found.groupBy("g", "block")).applyInArrow(answer, schema)
        if t:
            paths = cut_lineage(paths.select("g", F.col("i").alias("block"), "digest", "steps", *more))
    return paths


def proofs(leaves: DataFrame, group: str, order: list[str], leaf: str, arity: int = 2, levels: int = LEVELS) -> DataFrame:
    """``leaves`` with the digest column ``leaf``, in ``order`` within ``group`` (missing values first), with ``subroot``, ``root`` and ``steps``.

    Rows equal in group and order stand by their digests; equal rows are leaves of their own.  The columns of ``leaves`` are
    the caller's to name apart from ``g``, ``i``, ``n``, ``digest``, ``steps``, ``block``, ``subroot`` and ``root``.  No rows give no rows.
    """
    numbered = plain(number_rows(leaves, order=[*order, leaf], group=[group], name="i"))
    sizes = cut_lineage(plain(number_rows(numbered.groupBy(group).agg(F.count(F.lit(1)).alias("n")), order=[group], name="g")))
    same = numbered[group].eqNullSafe(sizes[group])
    placed = cut_lineage(numbered.join(sizes, same).select(
        sizes["g"], (F.col("i") - 1).alias("i"), sizes["n"], *[numbered[c] for c in leaves.columns]))
    tiers = build(placed.select("g", "i", F.col(leaf).alias("digest"), "n"), arity, levels)
    spark, groups = leaves.sparkSession, sizes.count()
    tops = tiers[-1].select(F.lit(0).cast("bigint").alias("g"), (F.col("g") - 1).alias("i"), "digest", F.lit(groups).cast("bigint").alias("n"))
    upper = build(tops, arity, levels)
    start = spark.createDataFrame([(0, [])], f"g bigint, steps {STEPS}")
    root = upper[-1].select("digest").first()  # one row, or none
    asked = descend(upper, start, tops.select("g", "i", "n"), arity, levels)
    above = cut_lineage(asked.select((F.col("i") + 1).alias("g"), "steps", F.col("digest").alias("subroot"),
                                     F.lit(root and root[0]).cast("string").alias("root")))
    return descend(tiers, above, placed, arity, levels).drop("g", "i", "n", "digest")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` and its steps end in."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, arity: int = 2, levels: int = LEVELS) -> DataFrame:
    """Per document ``doc_id, leaf, tampered, subroot, root, steps``.

    ``tampered`` is the leaf of the row with one more in ``n_chars`` where 7 divides the checksum of its ``doc_id``, else
    missing; a missing ``doc_id`` is never tampered with, a missing ``n_chars`` stays missing.  Further columns are left out.
    """
    fields = {c: F.col(c) for c in FIELDS}
    changed = digest(list({**fields, "n_chars": F.col("n_chars") + 1}.values()))
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    leaves = docs.select(F.col("lang").alias("lang"), F.col("doc_id").cast("bigint").alias("doc_id"), digest(list(fields.values())).alias("leaf"),
                         F.when(key % 7 == 0, changed).alias("tampered"))
    return proofs(leaves, "lang", ["doc_id"], "leaf", arity, levels).select("doc_id", "leaf", "tampered", "subroot", "root", "steps")


def verified(docs: DataFrame) -> DataFrame:
    """Every document's proof, and the root that its row, tampered with or not, leads to."""
    found = manifest(docs)
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"),
                        fold(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def sql() -> str:
    """The same over table ``documents``, every level of every tree as a table."""
    def leaf(n_chars: str) -> str:
        fields = ["doc_id", "source", "lang", n_chars, "text"]
        return "sha256(" + " || ".join(
            f"coalesce(strlen(CAST({c} AS VARCHAR))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')" for c in fields) + ")"

    def tree(name: str, source: str, group: str) -> str:
        return f"""
{name}(grp, lvl, idx, digest, n) AS (
  SELECT {group}, 0, idx, digest, n FROM {source}
  UNION ALL
  SELECT grp, lvl + 1, idx // 2, sha256(digest || coalesce(nxt, '')), (n + 1) // 2 FROM (
    SELECT *, lead(digest) OVER (PARTITION BY grp ORDER BY idx) AS nxt FROM {name} WHERE n > 1) WHERE idx % 2 = 0)"""

    steps = """
  SELECT {keys}, t.lvl, CASE WHEN (l.idx >> t.lvl) % 2 = 1 THEN t.digest ELSE '' END AS lft, CASE WHEN (l.idx >> t.lvl) % 2 = 0 THEN t.digest ELSE '' END AS rgt
  FROM {rows} l JOIN {tree} t ON t.grp = l.{grp} AND t.n > 1 AND t.idx = xor(l.idx >> t.lvl, 1)"""
    return f"""
WITH RECURSIVE ids AS (
  SELECT row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, {leaf('n_chars')}) AS row_id, doc_id, lang, {leaf('n_chars')} AS leaf,
         {leaf('n_chars + 1')} AS changed, CAST(doc_id AS VARCHAR) AS id FROM documents),
sums AS (
  SELECT id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(id)), lambda k:
      CASE WHEN k % 8 = 0 THEN ascii(substr(id, (k // 8 + 1)::INTEGER, 1)) ELSE 0 END::BIGINT)),
      lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS crc
  FROM (SELECT DISTINCT id FROM ids WHERE id IS NOT NULL)),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS groups, n FROM (
  SELECT lang, count(*) AS n FROM ids GROUP BY lang)),
leaves AS (
  SELECT i.row_id, i.doc_id, i.leaf AS digest, CASE WHEN s.crc % 7 = 0 THEN i.changed ELSE i.leaf END AS given, l.g, l.n, l.groups,
         row_number() OVER (PARTITION BY l.g ORDER BY i.row_id) - 1 AS idx
  FROM ids i JOIN langs l ON i.lang IS NOT DISTINCT FROM l.lang LEFT JOIN sums s ON s.id = i.id),
{tree('low', 'leaves', 'g')},
tops AS (SELECT l.grp AS idx, l.digest, (SELECT count(*) FROM langs) AS n, 0 AS g FROM low l WHERE l.n = 1),
{tree('high', 'tops', 'g')},
steps AS ({steps.format(keys="l.row_id", rows="leaves", tree="low", grp="g")}
  UNION ALL SELECT l.row_id, 1000 + s.lvl, s.lft, s.rgt FROM leaves l JOIN ({steps.format(keys="l.idx AS g", rows="tops", tree="high", grp="g")}) s ON s.g = l.g),
heights AS (SELECT grp AS g, max(lvl) AS h FROM low GROUP BY grp),
high_height AS (SELECT max(lvl) AS h FROM high),
folded(row_id, place, h, hh, digest) AS (
  SELECT l.row_id, CASE WHEN t.h = 0 THEN 1000 ELSE 0 END, t.h, (SELECT h FROM high_height), l.given FROM leaves l JOIN heights t ON t.g = l.g
  UNION ALL
  SELECT f.row_id, CASE WHEN f.place + 1 = f.h THEN 1000 ELSE f.place + 1 END, f.h, f.hh, sha256(coalesce(s.lft, '') || f.digest || coalesce(s.rgt, ''))
  FROM folded f LEFT JOIN steps s ON s.row_id = f.row_id AND s.lvl = f.place WHERE f.place < 1000 + f.hh),
proofs AS (SELECT row_id, sha256(string_agg(lft || rgt, '' ORDER BY lvl)) AS proof FROM steps GROUP BY row_id)
SELECT l.doc_id, l.digest AS leaf, t.digest AS subroot, r.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
       f.digest AS folded_root, f.digest = r.digest AS verified
FROM leaves l JOIN tops t ON t.idx = l.g JOIN high r ON r.n = 1 JOIN folded f ON f.row_id = l.row_id AND f.place = 1000 + f.hh
LEFT JOIN proofs p ON p.row_id = l.row_id"""
