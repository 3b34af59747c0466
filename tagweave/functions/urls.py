"""URL and name columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.constants import LOGO_EXTENSIONS
from tagweave.functions.text import EDGE_BLANKS

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_domain(url: Column | str) -> Column:
    """Lower-case host without userinfo, port, brackets, one leading ``www.`` and
    trailing dots; '' where there is none. A scheme is only one at the start.

    One chain of replacements that names its input once, so it stays small wherever
    the optimizer copies it.
    """
    steps = (
        (EDGE_BLANKS, ""),
        (r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//", ""),  # scheme or bare slashes
        (r"[/?#][\s\S]*$", ""),  # path, query, fragment
        (r"^.*@", ""),  # userinfo
        (r"^(?:[^\[]*\[([^\]]*).*|([^:\[]*):.*)$", "$1$2"),  # brackets or port
    )
    host = F.coalesce(_c(url), F.lit(""))
    for pattern, value in steps:
        host = F.regexp_replace(host, pattern, value)
    return F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.+$", "")


def slugify(name: Column | str) -> Column:
    return F.translate(F.lower(_c(name)), " /", "__")


def _without_dots(path: Column) -> Column:
    """Remove '.' and '..' segments of an absolute path."""
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    last = F.element_at(parts, -1)
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    walked = F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def resolve_url(base: Column | str, ref: Column | str) -> Column:
    """Absolute form of ``ref`` seen from ``base``."""
    base, ref = _c(base), F.regexp_replace(_c(ref), r"^\s+", "")
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    host = F.regexp_extract(base, r"^[^:/?#]+:(//[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    origin = F.concat(scheme, F.lit(":"), host)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    ref_tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    merged = F.regexp_replace(F.concat(folder, ref_path), r"/{2,}", "/")
    return (
        F.when(ref == "", base)
        .when(ref.rlike(_SCHEME), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, _without_dots(ref_path), ref_tail))
        .when(ref.startswith("?"), F.concat(origin, path, ref))
        .when(ref.startswith("#"), F.concat(origin, path, query, ref))
        .otherwise(F.concat(origin, _without_dots(merged), ref_tail))
    )


def file_extension(url: Column | str, allowed=LOGO_EXTENSIONS, default: str = "png") -> Column:
    """Extension of the URL's path if it is an allowed one."""
    path = F.regexp_replace(F.regexp_replace(_c(url), r"[?#].*$", ""), r"^[^:/]*:?//[^/]*", "")
    ext = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    return F.when(ext.isin(*allowed), ext).otherwise(F.lit(default))
