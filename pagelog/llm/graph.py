"""Connected components by alternating stars; every round is two joins and a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelog.llm.common import Scratch


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], int(r["s"] or 0)


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of edges(u, v), component being its smallest node.

    Large star: every node links its larger neighbours to the smallest of its neighbourhood. Small star:
    it links its smaller neighbours, and itself, to the smallest. Neighbourhoods are never gathered: the
    smallest is an aggregate that is joined back, and adaptive execution splits a node with many edges.
    The number of rounds grows with the logarithm of the longest chain.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "e0")
    before, name = _fingerprint(now), "e0"
    for k in range(1, most_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every edge of the large star leads from a larger to a smaller node
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        nxt = scratch.save(small.where("u <> v").distinct(), f"e{k}")
        after = _fingerprint(nxt)
        scratch.drop(name)
        now, name = nxt, f"e{k}"
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no end within {most_rounds} rounds")
    # now every component is a star around its smallest node
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
