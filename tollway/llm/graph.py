"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v): root is the least node that can be reached.

    Large-star and small-star steps in turn until nothing changes; each keeps at most one link per
    node and neighbour and is two joins on nodes, so no component is gathered anywhere.  Every
    round is a written table.  Loops and repeated links change nothing; no links give no rows.
    """

    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, size = _kept(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, _ = _kept(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after, new_size = _kept(small.distinct())
        if new_size == size:  # a round changes nothing but a forest of stars
            break
        links, size = after, new_size
    pairs = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _kept(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The written links with their number and a checksum that does not depend on their order."""

    links = materialize(links.select("u", "v"), "links")
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return links, (row["n"], row["h"])
