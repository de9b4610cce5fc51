"""Joins against aggregates that are usually tiny (one row per class)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage

BROADCAST_ROWS = 10_000


def join_checked(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner",
                 max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` joined with an aggregate on ``keys``, null keys matching null.

    The aggregate is written to the shared folder and counted. Up to
    ``max_rows`` rows it is broadcast, so ``df`` is not shuffled and a class
    that holds most rows stays spread over all tasks. A larger one is
    shuffled with ``df``; its keys are then many, and the adaptive skew join
    splits a hot one."""
    small = cut_lineage(table)
    renamed = small.select(*[F.col(k).alias(f"__{k}") for k in keys],
                           *[c for c in small.columns if c not in keys])
    if small.count() <= max_rows:
        renamed = F.broadcast(renamed)
    on = [df[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return df.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])
