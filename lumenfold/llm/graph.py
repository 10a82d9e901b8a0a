"""Connected components over links held as a table, and joins that split hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import stored

#: Rows of one key above which it is hot, if they are also more than a thousandth of all.
HOT = 1000


def joined_by_key(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with table (key, n: rows of the key, ..), whose keys are unique. Hot keys, of which there are a thousand at most, are broadcast; the others are dealt by key."""
    limit = F.greatest(F.lit(HOT), F.ceil(F.col("_total") / 1000))
    marked = table.join(F.broadcast(table.agg(F.sum("n").alias("_total"))), F.lit(True)).withColumn("_hot", F.col("n") > limit).drop("_total", "n")
    hot = F.broadcast(marked.filter("_hot").drop("_hot"))
    cold = rows.join(F.broadcast(marked.filter("_hot").select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(marked.filter("NOT _hot").drop("_hot"), key, how))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node reachable.

    Alternating large-star and small-star steps. Each takes a group's minimum, which is pre-aggregated before
    the shuffle, and joins it back; a hub's links stay where they are and get its minimum by broadcast. Every round is
    written to the shared folder, which cuts lineage. Null and self links are ignored; no links, no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = stored(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen[0] == 0 or seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = stored(joined_by_key(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        rest = joined_by_key(large, small, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.select("u", F.col("m").alias("v")).unionByName(rest).distinct())
