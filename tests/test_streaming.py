from pyspark.sql import functions as F

from tessera.sources import files
from tessera.streaming.queue import latest_queue, start_queue


def test_streaming_queue_follows_the_store(spark, tmp_path):
    sent = spark.createDataFrame([(i // 4, i, f"t{i}") for i in range(12)], "paper_id long, sentence_id long, text string")
    store, queue, ckpt = str(tmp_path / "store"), str(tmp_path / "queue"), str(tmp_path / "ckpt")
    files.append_rows(spark.createDataFrame([(1, 3), (4, 2)], "sentence_id long, score int"), store)
    q = start_queue(spark, sent, store, queue, ckpt)
    q.awaitTermination(120)
    latest = latest_queue(spark, queue)
    assert sorted(r.sentence_id for r in latest.collect()) == list(range(5, 12))
    files.append_rows(spark.createDataFrame([(9, 1)], "sentence_id long, score int"), store)
    q = start_queue(spark, sent, store, queue, ckpt)
    q.awaitTermination(120)
    latest = latest_queue(spark, queue)
    rows = {r.sentence_id: r.prev_context for r in latest.collect()}
    assert sorted(rows) == [10, 11]
    assert rows[10] == "t8 t9"


def test_delta_stream_emits_only_what_changed(spark, tmp_path):
    """Three runs over one store: each batch holds the blocks that its new marks touched, also
    after a restart, and the queue is that of all marks."""
    from tessera.operators.pools import annotation_queue
    from tessera.streaming.queue import queue_of_deltas, start_deltas

    sent = spark.createDataFrame([(i // 4, i, f"t{i}") for i in range(60)], "paper_id long, sentence_id long, text string")
    store, deltas, ckpt = str(tmp_path / "store"), str(tmp_path / "deltas"), str(tmp_path / "ckpt")
    assert queue_of_deltas(spark, sent, deltas).count() == 60
    written = 0
    for batch, want in (([5, 9, None], 50), ([7], 50), ([30, 9000, 31], 0), ([40], 0)):
        files.append_rows(spark.createDataFrame([(i, 1) for i in batch], "sentence_id long, score int"), store)
        start_deltas(spark, store, deltas, ckpt).awaitTermination(120)
        rows = spark.read.schema("block long, mark long").option("recursiveFileLookup", True).parquet(deltas).count()
        touched = len({i // 4096 for i in batch if i is not None})
        assert rows - written == touched
        written = rows
        got = queue_of_deltas(spark, sent, deltas)
        assert got.count() == want
        whole = annotation_queue(sent, files.read_store(spark, store))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
