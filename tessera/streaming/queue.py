"""Incremental annotation queue as a Structured Streaming job (T1 + S10).

Annotators append ``(sentence_id, score)`` rows to a store (parquet files,
S10). A streaming query over that store keeps the high-water mark (A5, a
one-row aggregate in the state store) and, per micro-batch, rewrites the
queue of sentences after the mark with their annotator context (W3).

The queue rewrite runs in ``foreachBatch`` with an idempotent overwrite of
the batch's output folder, so a retried micro-batch (lost executor, driver
restart from the checkpoint) produces the same files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.pools import annotation_queue

STORE_SCHEMA = "sentence_id long, score int"


def start_queue(spark: SparkSession, sentences: DataFrame, store_path: str, queue_path: str,
                checkpoint_location: str, available_now: bool = True):
    """Start the streaming queue; returns the ``StreamingQuery``.

    ``sentences`` is the corpus (static); ``store_path`` the append-only
    annotation store; ``queue_path`` receives one ``batch=<id>/`` folder per
    micro-batch, and ``latest_queue`` reads the newest complete one."""
    marks = (spark.readStream.schema(STORE_SCHEMA).parquet(store_path)
             .agg(F.max("sentence_id").alias("sentence_id")))

    def emit(batch: DataFrame, batch_id: int) -> None:
        queue = annotation_queue(sentences, batch.filter(F.col("sentence_id").isNotNull()))
        out = queue.select("sentence_id", "paper_id", "text", "prev_context", "next_context")
        out.write.mode("overwrite").parquet(os.path.join(queue_path, f"batch={batch_id}"))

    writer = (marks.writeStream.outputMode("complete").foreachBatch(emit)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


BLOCK = 4096  # sentence ids that share a key of the delta stream's state


def start_deltas(spark: SparkSession, store_path: str, delta_path: str, checkpoint_location: str,
                 available_now: bool = True):
    """T1 as a stream of changes: the state holds the highest mark of every block of sentence ids,
    and a micro-batch emits the blocks that new marks touched, nothing else: ``(block, mark)``
    rows, at most as many as new marks, whatever the corpus's or the queue's size.

    Marks are aggregated by block before the shuffle, so no block is a hot key. A batch overwrites its own
    folder, so a retried one leaves the same rows; after a restart the state goes on from the checkpoint."""
    marks = spark.readStream.schema(STORE_SCHEMA).parquet(store_path).filter(F.col("sentence_id").isNotNull())
    blocks = marks.groupBy(F.floor(F.col("sentence_id") / BLOCK).cast("long").alias("block")).agg(F.max("sentence_id").alias("mark"))

    def emit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(delta_path, f"batch={batch_id}"))

    writer = (blocks.writeStream.outputMode("update").foreachBatch(emit)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def queue_of_deltas(spark: SparkSession, sentences: DataFrame, delta_path: str) -> DataFrame:
    """The queue as the deltas so far leave it: sentences after the highest mark, with their context."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(delta_path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [str(s.getPath().getParent()) for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "batch=*/_SUCCESS")) or []]
    if not done:
        return annotation_queue(sentences, None)
    deltas = spark.read.schema("block long, mark long").parquet(*done)
    return annotation_queue(sentences, deltas.select(F.col("mark").alias("sentence_id")))


def latest_queue(spark: SparkSession, queue_path: str) -> DataFrame:
    """The queue of the newest batch. A folder counts once its ``_SUCCESS``
    file is there, so a reader never sees a half-written queue; older batches
    stay readable until their owner removes them."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(queue_path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [s.getPath().getParent().getName() for s in
            fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "batch=*/_SUCCESS"))]
    newest = max(int(name.split("=")[1]) for name in done)
    return spark.read.parquet(os.path.join(queue_path, f"batch={newest}"))
