"""Connected components of a link table, by alternating star contractions.

Each round replaces links by links to smaller ids: a *large star* connects the
larger neighbours of every node to its smallest neighbour, a *small star*
connects the smaller ones. Both keep the components and end in stars centred
on the smallest id of each component, after a number of rounds that grows with
the logarithm of the table. A round is two aggregations and two joins on
``(long, long)`` rows; a node with very many links is one skewed join key whose
rows Spark can split, and its minimum is combined before the shuffle. Rounds
are stored in the shared folder; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedsearch.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    rest = (links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """``(node, root)`` for every node of ``links`` (``u``, ``v``) but the roots themselves.

    ``root`` is the smallest node of the component. Self links and repeated
    links change nothing; an empty table gives an empty result.
    """
    now = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), name)
    state = _state(now)
    while True:
        now = stored(_small_star(_large_star(now)), name)
        after = _state(now)
        if after == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = after
