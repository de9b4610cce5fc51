"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import boundary

FILE_ROWS = 1 << 20  # links of one file, where there are more than a file for each core holds


def _stored(edges: DataFrame, rows: int) -> DataFrame:
    """``boundary`` in files fit for ``rows``: a shuffle has its partitions however few the
    links are, and every file costs a commit and, on a local file system, forked processes.
    The links are dealt out again, as ``coalesce`` would hold the memory of all the
    partitions of a task at once."""
    files = max(edges.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))
    return boundary(edges.repartition(files))


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.bit_xor(h)).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every linked node; root is the smallest node it reaches.

    Every round rewrites the links as stars around smaller nodes: neighbours
    are never collected, a node's minimum is a partial aggregate joined back
    (a hot node's links are split by the adaptive skew join). Rounds grow with
    the logarithm of the longest path, and each is written to the shared
    folder. Nothing but counts and two checksums reaches the driver. ``links``
    is read twice, once to count it.
    """
    edges = _stored(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                    .filter("a != b").distinct(), links.count())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours move to the smallest of the neighbourhood
        large = (both.join(low, "a").filter("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())
        # small star: smaller neighbours and the node itself move to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a")
        small = moved.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = _stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), before[0])
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
