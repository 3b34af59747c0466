"""Table schemas and the defaults of columns added later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()
_TAGS = T.ArrayType(_TEXT)

COMPANY = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", _TEXT, False),
        T.StructField("country", _TEXT),
        T.StructField("description", _TEXT),
        T.StructField("website", _TEXT),
        T.StructField("sectors", _TAGS),
        T.StructField("subsectors", _TAGS),
        T.StructField("sub_subsectors", _TAGS),
        T.StructField("linkedin_url", _TEXT),
        T.StructField("flaticon_url", _TEXT),
        T.StructField("logo_url", _TEXT),
        T.StructField("taxonomy_version", _TEXT),
    ]
)

EDGE = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("company_a", _TEXT, False),
        T.StructField("company_b", _TEXT, False),
        T.StructField("score", T.DoubleType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("checked", T.BooleanType()),
        T.StructField("validated", T.BooleanType()),
    ]
)

REVIEW = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("review_type", _TEXT, False),
        T.StructField("subject", _TEXT, False),
        T.StructField("date_diagnosed", T.TimestampType()),
        T.StructField("source_snapshot", _TEXT),
        T.StructField("verdict", _TEXT),
        T.StructField("resolution", _TEXT),
        T.StructField("notes", _TEXT),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

TAXONOMY = T.StructType(
    [
        T.StructField("sector", _TEXT, False),
        T.StructField("subsector", _TEXT),
        T.StructField("sub_subsector", _TEXT),
        T.StructField("definition", _TEXT),
    ]
)

# default of each column that older files may lack
LATER_COLUMNS = {
    "active": (T.BooleanType(), True),
    "checked": (T.BooleanType(), False),
    "validated": (T.BooleanType(), None),
    "updated_at": (T.TimestampType(), None),
}


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring a frame read from older files to ``schema``: a column the files lack
    takes its declared default, or null. A stored null stays null."""
    out = []
    for field in schema.fields:
        if field.name in df.columns:
            out.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            _, default = LATER_COLUMNS.get(field.name, (None, None))
            out.append(F.lit(default).cast(field.dataType).alias(field.name))
    return df.select(*out)
