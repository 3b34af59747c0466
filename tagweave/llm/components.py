"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.store import durable


def components(links: DataFrame) -> DataFrame:
    """(cls, comp) for every end of ``links`` (a, b): comp is the smallest end that can
    be reached.

    Each round a node takes the smallest label among its neighbours and then the label
    of that label, so long chains shorten by half; labels only fall, and the rounds end
    when none does. A hub's links are summed up before they are shuffled.
    """
    both = links.select("a", "b").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    ).filter("a <> b").distinct()
    both = durable(both, "component-links")
    labels = durable(
        both.groupBy(F.col("a").alias("cls")).agg(F.least("cls", F.min("b")).alias("comp")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("cls").alias("b"), F.col("comp").alias("near")), "b")
            .groupBy(F.col("a").alias("cls"))
            .agg(F.min("near").alias("near"))
        )
        lower = labels.join(near, "cls").select(
            "cls", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")
        )
        jump = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("far"))
        stepped = durable(
            lower.join(jump, "comp", "left").select(
                "cls", "old", F.least("comp", "far").alias("comp")
            ),
            "labels",
        )
        labels = stepped.select("cls", "comp")
        if stepped.filter("comp < old").isEmpty():
            return labels
