"""Connected components of a table of links, by alternating large and small stars.

Each round is two joins and aggregations, written to the shared folder; the rounds end when the set of links no longer
changes. Nothing but two numbers a round comes to the driver. Links to a hot node lie in one key of the joins only, which
adaptive execution splits, as the other side of each join has one row a node. The tables of past rounds are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(rows: DataFrame) -> DataFrame:
    """u, m: the least of u and its neighbours v."""
    return rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = _least(e)
    return e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """For links (a, b), long: node, component (the component's least node), one row for each node with a link to another."""
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    staged = common.Rounds(links.sparkSession, "links")
    e, seen = staged(e), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        e, seen = staged(_small_star(_large_star(e))), now
    ends = e.groupBy("u").agg(F.min("v").alias("component"))
    return ends.select(F.col("u").alias("node"), "component").union(e.select("v", F.col("v").alias("component")).distinct())
