"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored

MAX_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u")
    return joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; ``links`` has columns a and b of one orderable type.

    The component is the smallest node reachable. Self links and repeated links are harmless; nodes without links are not
    returned; an empty table gives an empty result. Each round is written to the shared folder, so lineage stays short
    and a lost executor costs one round at most. Nothing but a count and a checksum reaches the driver.
    """
    u, v = F.greatest("a", "b"), F.least("a", "b")
    links = stored(links.filter(F.col("a") != F.col("b")).select(u.alias("u"), v.alias("v")).distinct(), "links")
    state = _state(links)
    if state[0]:
        for _ in range(MAX_ROUNDS):
            links = stored(_small_star(_large_star(links)).filter("u != v").distinct(), "links")
            state, before = _state(links), state
            if state == before:
                break
        else:
            raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
