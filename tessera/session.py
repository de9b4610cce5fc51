"""Session construction and lineage cutting.

The checkpoint folder is taken from ``spark.checkpoint.dir`` as the cluster
sets it. A folder of the caller's or of this module's own is used only where
the session has none (tests on one machine).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "tessera",
                  shuffle_partitions: int | None = None,
                  fallback_checkpoint_dir: str | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark, fallback_checkpoint_dir)
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    ``spark.checkpoint.dir`` wins, then ``fallback``. Where both are unset a new folder
    under ``/tmp`` stands in on one machine (as in tests); on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or fallback
        if not configured:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            configured = tempfile.mkdtemp(prefix="tessera-", dir="/tmp")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into a folder of its own under the shared
    checkpoint folder and read it back.

    Later plans start from a scan with column pruning and filter pushdown; a
    lost executor costs a re-read, not a recomputation. The files belong to
    the session's checkpoint folder and go when its owner clears it.

    ``group_rows`` is the size of Parquet's row groups where rows are megabytes: a task
    holds a group, and the writer would look at its bytes after 100 rows at the earliest.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    out = df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
