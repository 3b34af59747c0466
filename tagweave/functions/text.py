"""Small string, number and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# blanks beyond ASCII count too
BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
EDGE_BLANKS = f"^{BLANK}|{BLANK}$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def short_label(col: Column | str, limit: int = 20, kept: int = 18) -> Column:
    """Cut labels longer than ``limit`` and mark the cut."""
    return F.when(
        F.length(_c(col)) > limit, F.concat(F.left(_c(col), F.lit(kept)), F.lit("…"))
    ).otherwise(_c(col))


def percent(part: Column, whole: Column) -> Column:
    """Percentage to one decimal, half-even; 0 for an empty whole."""
    share = F.when(whole == 0, F.lit(0.0)).otherwise(
        F.lit(100.0) * part.cast("double") / whole.cast("double")
    )
    return F.bround(share, 1)


def clamp_score(col: Column | str) -> Column:
    """Numeric score within [0, 1]. Text that is no number, NaN and null give null."""
    number = _c(col).try_cast("double")
    usable = F.when(~F.isnan(number), number)
    return F.when(usable.isNotNull(), F.least(F.greatest(usable, F.lit(0.0)), F.lit(1.0)))


def reply_items(
    reply: Column | str, item: T.StructType, defaults: dict[str, str] | None = None
) -> Column:
    """Rows of a JSON reply: a bare array, or the first list among an object's values.
    Elements that are no objects are passed over; a text value is never a list. A field
    that an element lacks has its default; an explicit null stays null."""
    reply = _c(reply)
    by_name = T.MapType(T.StringType(), T.VariantType())
    values = T.ArrayType(T.VariantType())
    fields = F.from_json(reply, by_name)
    lists = F.filter(F.map_values(fields), lambda v: F.schema_of_variant(v).startswith("ARRAY"))
    inner = F.from_json(F.to_json(F.get(lists, F.lit(0))), values)
    chosen = F.when(F.ltrim(reply).startswith("["), F.from_json(reply, values)).otherwise(inner)
    objects = F.filter(chosen, lambda v: F.schema_of_variant(v).startswith("OBJECT"))

    def row(v: Column) -> Column:
        out = F.from_json(F.to_json(v), item)
        for name, value in (defaults or {}).items():
            given = F.map_contains_key(F.from_json(F.to_json(v), by_name), name)
            out = out.withField(name, F.when(given, out[name]).otherwise(F.lit(value)))
        return out

    return F.coalesce(F.transform(objects, row), F.array().cast(T.ArrayType(item)))
