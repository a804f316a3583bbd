"""Connected components of a graph that lies in a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacart.llm.common import Steps


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step: nodes are linked to the smallest node of their neighbourhood.

    The large step takes each node's larger neighbours, the small step itself and the
    smaller ones. Minima are combined before the shuffle, and the join back is one that
    adaptive execution splits if a node has many links.
    """
    ends = F.col("a"), F.col("b")
    if large:
        around = links.select(*ends).union(links.select(F.col("b"), F.col("a")))
    else:
        around = links.select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b"))
    smallest = around.groupBy("a").agg(F.min("b").alias("least")).withColumn(
        "least", F.least("a", "least")
    )
    joined = around.join(smallest, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            smallest.select("a", F.col("least").alias("b"))
        )
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); a component is named by its
    smallest node. Null ends and loops link nothing.

    Alternates large and small stars (Kiveris et al., 2014) until the links no longer change;
    the number of rounds grows with the logarithm of the longest path. Each round is stored
    and the one before deleted; the last stays in the scratch folder.
    """
    now = Steps(links.sparkSession)
    found = now.store(links.where("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        done, now = now, Steps(links.sparkSession)
        found = now.store(_star(_star(found, large=True), large=False), "links")
        done.drop()
        state = found.agg(
            F.count("*"),
            F.bit_xor(F.xxhash64("a", "b")),
            F.sum(F.crc32(F.concat_ws(",", "a", "b"))),
        ).head()
        if state == before:
            break
        before = state
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
