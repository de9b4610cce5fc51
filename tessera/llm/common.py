"""Shared-folder boundaries used by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` for working columns, changed where ``df`` has them already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the session's checkpoint folder, which every
    executor shares. A local folder is used only where the session has none
    (tests on one machine)."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tessera-llm-", dir="/tmp")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def boundary(df: DataFrame, compression: str = "zstd", group_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later
    steps start from a scan with column pruning, and a lost executor costs a
    re-read instead of a recomputation. The files belong to the session's
    checkpoint folder and go when its owner clears it.

    ``group_rows`` is for rows of megabytes: Parquet's writer looks at the size of a row
    group after 100 rows at the earliest, and its reader takes up to 4,096 rows of a group at once,
    so groups of so many rows are what tasks hold on both sides."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    out = df.write.option("compression", compression)
    if group_rows:
        out = out.option("parquet.block.row.count.limit", group_rows)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """``boundary`` as a bucketed table: grouping or joining it on ``column``
    later needs no shuffle of its rows."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    name = "tessera_" + os.path.basename(path)
    (df.write.option("path", path).option("compression", "uncompressed")
     .bucketBy(buckets, column).saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog forgets it; its files stay where they are
    return table


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
