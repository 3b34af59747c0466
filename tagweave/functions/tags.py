"""Columns over ordered tag arrays. A null array always counts as empty."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.constants import (
    GENERIC_SUBSECTOR,
    HORIZONTAL_SECTORS,
    HORIZONTAL_SUBSECTORS,
    REDIRECT_SUBSECTORS,
    UNCATEGORIZED,
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tags(col: Column | str) -> Column:
    return F.coalesce(_c(col), F.array().cast("array<string>"))


def literals(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def is_empty(col: Column | str) -> Column:
    return F.size(tags(col)) == 0


def has_tag(col: Column | str, tag: str) -> Column:
    return F.array_contains(tags(col), tag)


def is_subset(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_except(tags(a), tags(b))) == 0


def unique_tags(col: Column | str) -> Column:
    """Drop repeats, keeping first occurrences in order."""
    return F.array_distinct(tags(col))


def overlap(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.arrays_overlap(tags(a), tags(b)), F.lit(False))


def lenient_match(a: Column | str, b: Column | str) -> Column:
    """Pass unless both sides have tags and share none."""
    return is_empty(a) | is_empty(b) | overlap(a, b)


def jaccard(a: Column | str, b: Column | str) -> Column:
    a, b = tags(a), tags(b)
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)).cast("double") / both
    )


def has_vertical(col: Column | str, horizontal: Iterable[str] = HORIZONTAL_SUBSECTORS) -> Column:
    neither = literals([*horizontal, UNCATEGORIZED])
    return F.exists(tags(col), lambda s: ~F.array_contains(neither, s))


def drop_horizontal(
    subsectors: Column | str,
    sectors: Column | str,
    horizontal: Iterable[str] = HORIZONTAL_SUBSECTORS,
    exempt_sectors: Iterable[str] = HORIZONTAL_SECTORS,
) -> Column:
    """Remove horizontal tags next to a vertical one, unless every sector is exempt."""
    subs, horizontal = tags(subsectors), list(horizontal)
    exempt = ~is_empty(sectors) & is_subset(sectors, literals(exempt_sectors))
    kept = F.filter(subs, lambda s: ~F.array_contains(literals(horizontal), s))
    return F.when(exempt | ~has_vertical(subs, horizontal), subs).otherwise(kept)


def demote_generic(
    subsectors: Column | str,
    generic: str = GENERIC_SUBSECTOR,
    redirects: Iterable[str] = REDIRECT_SUBSECTORS,
) -> Column:
    """Remove the generic tag when a more precise one is present."""
    subs = tags(subsectors)
    return F.when(
        overlap(subs, literals(redirects)), F.filter(subs, lambda s: s != generic)
    ).otherwise(subs)


def drop_redundant_uncategorized(subsectors: Column | str) -> Column:
    subs = tags(subsectors)
    return F.when(F.size(subs) > 1, F.filter(subs, lambda s: s != UNCATEGORIZED)).otherwise(subs)


def default_uncategorized(subsectors: Column | str) -> Column:
    return F.when(is_empty(subsectors), literals([UNCATEGORIZED])).otherwise(tags(subsectors))


def audited_conflict(
    subsectors: Column | str, audited: Iterable[str], horizontal: Iterable[str]
) -> Column:
    """Audited horizontal tags of a row that also has a vertical tag, sorted; else empty."""
    subs = tags(subsectors)
    found = F.array_sort(F.array_intersect(subs, literals(audited)))
    return F.when(has_vertical(subs, horizontal), found).otherwise(literals([]))
