"""Path arithmetic on storage paths ``slot/branch/base/lang/name…``, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(path: Column) -> Column:
    return F.split(path, "/+")


def slot(path: Column) -> Column:
    return F.get(_parts(path), F.lit(0))


def branch(path: Column) -> Column:
    return F.get(_parts(path), F.lit(1))


def branch_root(path: Column) -> Column:
    """``slot/branch`` of a record at or below branch level, else null."""
    p = _parts(path)
    return F.when(F.size(p) > 1, F.concat_ws("/", F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def base(path: Column) -> Column:
    return F.get(_parts(path), F.lit(2))


def language(path: Column) -> Column:
    """Language element: ``a`` or ``a-b``; third for uploads, where the second is the format."""
    p = _parts(path)
    return F.when(F.get(p, F.lit(2)) == "uploads", F.get(p, F.lit(4))).otherwise(F.get(p, F.lit(3)))


def basename(path: Column) -> Column:
    """Path below the language folder."""
    p = _parts(path)
    return F.array_join(F.slice(p, 5, F.greatest(F.size(p) - 4, F.lit(0))), "/")


def strip_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def suffix(path: Column) -> Column:
    """Lower-case file suffix, looking through ``.gz``."""
    return F.lower(F.regexp_extract(path, r"(?i)\.([^./]+?)(?:\.gz)?$", 1))


def with_base(path: Column, new: str) -> Column:
    """The same path below another base folder."""
    return F.regexp_replace(path, r"^([^/]+/[^/]+)/[^/]+", f"$1/{new}")


def with_language(path: Column, lang: Column) -> Column:
    """The same path below another language folder."""
    return F.concat(F.regexp_extract(path, r"^([^/]+/[^/]+/[^/]+/)", 1), lang,
                    F.regexp_extract(path, r"^[^/]+/[^/]+/[^/]+/[^/]+(/.*)?$", 1))


def resource_type(path: Column) -> Column:
    """``xml``/``xces`` for files, ``monolingual``/``parallel`` for folders, else format or suffix."""
    p = _parts(path)
    pair = F.get(p, F.lit(3)).contains("-")
    is_file = path.rlike(r"\.xml(\.gz)?$")
    return (F.when(F.get(p, F.lit(2)) == "uploads", F.get(p, F.lit(3)))
            .when((F.get(p, F.lit(2)) == "xml") & (F.size(p) > 3),
                  F.when(pair & is_file, "xces").when(pair, "parallel")
                  .when(is_file, "xml").otherwise("monolingual"))
            .otherwise(F.nullif(suffix(path), F.lit(""))))


def resolve_href(href: Column, page: Column) -> Column:
    """A link made absolute: protocol and host dropped, relative links taken from the page's folder.

    Leading ``..`` elements each remove one folder; other elements are kept as they are.
    """
    local = F.regexp_replace(href, r"^https?://[^/]*/?", "/")
    folder = F.filter(F.split(F.regexp_replace(page, r"/?[^/]*$", ""), "/+"), lambda x: x != "")
    parts = F.filter(F.split(local, "/+"), lambda x: x != "")
    ups = F.size(F.split(F.regexp_extract(local, r"^((?:\.\./+)*)", 1), r"\.\.")) - 1
    kept = F.slice(folder, 1, F.greatest(F.size(folder) - ups, F.lit(0)))
    rest = F.slice(parts, ups + 1, F.greatest(F.size(parts) - ups, F.lit(0)))
    return F.when(local.startswith("/"), F.regexp_replace(local, r"^/+", "")).otherwise(
        F.array_join(F.concat(kept, rest), "/"))
