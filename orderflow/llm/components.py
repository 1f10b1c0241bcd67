"""Connected components of a table of links, without collecting links or components.

Alternating large-star and small-star steps: in each, every vertex points its neighbours at the
smallest vertex it knows. The number of links never grows and every component ends as a star
around its smallest vertex, in a number of rounds that grows with the logarithm of its size.
Minima are aggregated before the shuffle, and joins spread a hot vertex by adaptive skew splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.tables import written


def _minimum(links: DataFrame) -> DataFrame:
    """The smallest vertex that each vertex ``u`` sees, itself included."""
    return links.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    if both_ways:  # large star: the larger neighbours of u point at its minimum
        seen = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moved = seen.join(_minimum(seen), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # small star: u itself and its smaller neighbours point at its minimum
        joined = links.join(_minimum(links), "u")
        moved = joined.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``links`` (a, b); the component is its smallest id.

    Links with a null end and links of a vertex with itself are left out.
    """
    now = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    state = None
    while True:
        now = written(_star(_star(now, both_ways=True), both_ways=False), "stars")
        seen = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if seen == state or not seen["n"]:
            break
        state = seen
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
