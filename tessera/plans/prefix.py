"""Global running totals and dense row numbers without a single-partition window.

``Window.orderBy(...)`` with no partition key moves every row into one task
(``Exchange SinglePartition``). Here the rows are range-partitioned on the
full (unique) order key instead, into at most ``spark.sql.shuffle.partitions``
slices (AQE may merge adjacent ones), so a hot value of the leading key is
split across tasks like any other range. Each task computes the running
total of its own contiguous slice with Arrow batches; the per-slice totals
(one row per slice: a bound fixed by configuration, not by the data) are
prefix-summed and broadcast back as offsets.

The stamped slice table is materialised once so the totals pass and the
offset pass read the same slices: two separate range exchanges over the same
input may sample different bounds (the sample seed depends on the RDD id).
It is written to the shared checkpoint folder: it survives executor loss, and
later plans start from a scan.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.joins import join_checked
from tessera.session import cut_lineage

_PART = "_slice"
_LOCAL = "_local_total"


def _slice_totals(value_col: str):
    def stamp(batches):
        from pyspark import TaskContext

        part, carry = TaskContext.get().partitionId(), 0
        for batch in batches:
            local = np.cumsum(batch.column(value_col).to_numpy(zero_copy_only=False).astype(np.int64)) + carry
            if len(local):
                carry = int(local[-1])
            # only the value column is looked at; the others pass as they are
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(local), part, np.int32)), pa.array(local, pa.int64())],
                [*batch.schema.names, _PART, _LOCAL])

    return stamp


def running_total(df: DataFrame, order: Sequence[Column | str], value: Column | str,
                  out: str, inclusive: bool = True,
                  num_slices: int | None = None) -> DataFrame:
    """Add ``out`` = running sum of ``value`` over the global ``order``.

    ``order`` must be a total order (end with a unique key). ``inclusive``
    selects whether a row's own value is part of its total.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    val = F.col(value) if isinstance(value, str) else value
    keyed = df.withColumn("_val", F.coalesce(val.cast("long"), F.lit(0)))
    # Without an explicit count the range exchange may be coalesced by AQE,
    # which only merges adjacent ranges: slices stay contiguous and ordered,
    # and their number follows the data size. The stamped table below is
    # materialised, so every consumer sees the same slices.
    ranged = (keyed.repartitionByRange(num_slices, *order_cols) if num_slices
              else keyed.repartitionByRange(*order_cols))
    staged = ranged.sortWithinPartitions(*order_cols)
    schema = T.StructType(staged.schema.fields + [
        T.StructField(_PART, T.IntegerType(), False),
        T.StructField(_LOCAL, T.LongType(), False),
    ])
    stamped = cut_lineage(staged.mapInArrow(_slice_totals("_val"), schema))
    per_slice = stamped.groupBy(_PART).agg(F.max(_LOCAL).alias("_slice_sum"))
    offsets = per_slice.select(
        _PART,
        F.coalesce(F.sum("_slice_sum").over(
            Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"))
    total = F.col("_offset") + F.col(_LOCAL)
    if not inclusive:
        total = total - F.col("_val")
    return (stamped.join(F.broadcast(offsets), _PART)
            .withColumn(out, total.cast("long"))
            .drop(_PART, _LOCAL, "_offset", "_val"))


def row_number(df: DataFrame, order: Sequence[Column | str], out: str,
               start: int = 0, num_slices: int | None = None) -> DataFrame:
    """Dense global row number in ``order`` starting at ``start``."""
    numbered = running_total(df, order, F.lit(1), out, inclusive=False, num_slices=num_slices)
    return numbered.withColumn(out, F.col(out) + F.lit(start)) if start else numbered


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                out: str, start: int = 0, num_slices: int | None = None) -> DataFrame:
    """Dense row number inside each group (like ``row_number`` over a window
    partitioned by ``group``) that stays balanced when one group holds a large
    share of the rows: a global number over ``group + order`` minus the
    group's first number (a partially aggregated ``min`` joined back)."""
    numbered = row_number(df, list(group) + list(order), "_g", num_slices=num_slices)
    first = numbered.groupBy(*group).agg(F.min("_g").alias("_g0"))
    return (join_checked(numbered, first, list(group))
            .withColumn(out, F.col("_g") - F.col("_g0") + F.lit(start))
            .drop("_g", "_g0"))


def number_by_key(df: DataFrame, key: str, needed: Sequence[str], order: Sequence[Column | str],
                  out: str, group: Sequence[str] = (), start: int = 0,
                  num_slices: int | None = None) -> DataFrame:
    """``row_number`` (or ``rank_within`` when ``group`` is given) computed on
    the narrow projection ``key + needed`` and joined back on the unique
    ``key``: wide columns (texts, arrays) never go through the range sort,
    the Arrow pass or the slice materialisation; they take part in one
    shuffle join on a unique key (no skew)."""
    cols = [key] + [c for c in dict.fromkeys(list(group) + list(needed)) if c != key]
    narrow = df.select(*cols)
    if group:
        numbered = rank_within(narrow, group, order, out, start=start, num_slices=num_slices)
    else:
        numbered = row_number(narrow, order, out, start=start, num_slices=num_slices)
    return df.join(numbered.select(key, out), key)
