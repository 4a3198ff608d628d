"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._registry import keep


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` for every id in ``links (a, b)``; root is the smallest id of its component.

    Alternating large-star and small-star steps: each id sends its neighbours
    to the smallest one it sees. Neighbourhoods are reduced to a minimum by a
    map-side combined aggregate and joined back, never gathered. The steps end
    when the table of links no longer changes; each is written, so lineage
    stays short.
    """
    edges = keep(
        links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links"
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("m", "v"))
        large = both.join(low, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = keep(large.filter("v <> u").distinct(), "links")
        # Small star: ids with their neighbours below them.
        root = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(root, "v").filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = keep(moved.unionByName(root.select("v", F.col("m").alias("u"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(
        edges.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct()
    )
