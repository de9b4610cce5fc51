"""Run by test_fault.py in its own process: task retries enabled, the first
attempt of every prefix-slice task fails, the result must still be exact."""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tessera.plans import prefix  # noqa: E402
from tessera.session import build_session  # noqa: E402

flags = sys.argv[1]
original = prefix._slice_totals


def failing_once(value_col):
    inner = original(value_col)

    def stamp(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        flag = os.path.join(flags, f"slice-{ctx.stageId()}-{ctx.partitionId()}")
        if not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("injected task failure")
        yield from inner(batches)

    return stamp


prefix._slice_totals = failing_once
use_checkpoint = len(sys.argv) < 3 or sys.argv[2] != "no-checkpoint"
spark = build_session("local[4,4]", shuffle_partitions=6,
                      fallback_checkpoint_dir=tempfile.mkdtemp(prefix="fault-ckpt-", dir="/tmp")
                      if use_checkpoint else None)
df = spark.range(2000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") % 7 + 1).alias("v"))
got = prefix.running_total(df, [F.col("g").desc(), "id"], "v", "cum", num_slices=5)
naive = df.withColumn("cum", F.sum("v").over(
    Window.orderBy(F.col("g").desc(), "id").rowsBetween(Window.unboundedPreceding, 0)))
ok = sorted(got.select("id", "cum").collect()) == sorted(naive.select("id", "cum").collect())
failures = len(os.listdir(flags))
print(f"RESULT ok={ok} injected={failures}")
spark.stop()
