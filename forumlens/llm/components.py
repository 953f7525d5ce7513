"""Connected components over a table of links.

Alternating large-star and small-star steps: every link is re-hung on the
smallest neighbour until nothing moves. A star of any size is settled in two
steps, and no step gathers the neighbours of a vertex in one place: the minimum
is a partial aggregate, and the join back to it is one that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rehung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return rehung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links between ids to (id, component_id), the smallest id reachable.

    Links from an id to itself, NULL ends and repeated links are ignored. Ids
    without a link do not appear.
    """
    links = links.select("u", "v").filter("u != v").distinct()
    before, at = None, written(links, "links")
    while True:
        mark = tuple(at.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == before:
            break
        before, at = mark, written(_small_star(_large_star(at)), "links")
    stars = at.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return stars.unionByName(stars.select(F.col("component_id").alias("id"), "component_id").distinct())
