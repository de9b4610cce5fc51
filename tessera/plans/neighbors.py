"""Sliding context over consecutively numbered rows without per-group skew.

A window partitioned by article puts one whole article into one task. Here
rows are grouped into blocks of ``block`` consecutive ids (each block holds
at most ``block`` rows, so no block can be hot) and the few rows a block
needs from its neighbours are copied in as a halo. The window then runs over
``(block, group)`` and only the block's own rows are kept.

Precondition: inside a group the ids are consecutive integers (true for
sentence ids numbered per article, and for any subset that keeps or drops
whole articles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_context(df: DataFrame, id_col: str, group_col: str, text_col: str,
                 before: int, after: int, prev_out: str = "prev_context",
                 next_out: str = "next_context", block: int = 4096) -> DataFrame:
    """Add space-joined texts of up to ``before`` previous and ``after`` next
    rows of the same group (empty string when there are none)."""
    rel = F.col(id_col) - F.floor(F.col(id_col) / block) * block
    home = F.floor(F.col(id_col) / block).cast("long")
    targets = F.array(
        F.struct(home.alias("_blk"), F.lit(True).alias("_home")),
        F.when(rel < after, F.struct((home - 1).alias("_blk"), F.lit(False).alias("_home"))),
        F.when(rel >= block - before, F.struct((home + 1).alias("_blk"), F.lit(False).alias("_home"))),
    )
    spread = (df.withColumn("_t", F.explode(F.filter(targets, lambda t: t.isNotNull())))
              .select("*", "_t._blk", "_t._home").drop("_t"))
    w = Window.partitionBy("_blk", group_col).orderBy(id_col)
    prev_ctx = F.collect_list(text_col).over(w.rowsBetween(-before, -1)) if before else F.array()
    next_ctx = F.collect_list(text_col).over(w.rowsBetween(1, after)) if after else F.array()
    return (spread.withColumn(prev_out, F.array_join(prev_ctx, " "))
            .withColumn(next_out, F.array_join(next_ctx, " "))
            .filter(F.col("_home"))
            .drop("_blk", "_home"))
