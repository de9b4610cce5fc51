"""Documents packed into blocks with block-local word dictionaries.

A block holds consecutive documents of one scan task, about ``block_bytes`` of
text. It is stored as

* one row ``slot = -1``: the kept columns of its documents (Arrow IPC), the
  number of words of each document, and the documents' words as indexes into
  the block's dictionary, in text order (so a word's position is its place in
  the sequence);
* one row per word bucket ``slot >= 0`` (``xxh32(word) % slots``): the distinct
  words of that bucket, and how often each occurs in documents flagged for
  training.

A word that fills a third of all texts is one entry per block, so word-keyed
shuffles have no hot key, and what travels is the distinct words of each block
instead of one row per occurrence. ``answer`` sends every bucket to one group,
where each distinct word is handled once for the whole corpus, and returns one
reply row per (block, bucket); ``reunite`` brings the replies back to their
block. The table is bucketed by block, so the heavy sequence rows never move
again.
"""

from __future__ import annotations

import ctypes
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 1 << 20  # a block of short texts ends here
DOCS_SLOT = -1
SCHEMA = "block long, slot int, docs long, words long, payload binary"


def release() -> None:
    """Give freed memory back to the system: Spark keeps its Python workers for
    later stages, and what they hold idle counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def _squeeze(*parts: bytes) -> bytes:
    head = np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _expand(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [raw[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist())]


def pack_ints(values: np.ndarray) -> bytes:
    """Little-endian uint32 as four byte planes (similar bytes lie together)."""
    a = np.ascontiguousarray(values, dtype="<u4")
    return a.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_ragged(items: list[bytes]) -> list[bytes]:
    return [pack_ints(np.fromiter(map(len, items), np.uint32, len(items))), b"".join(items)]


def unpack_ragged(lengths: bytes, body: bytes) -> list[bytes]:
    ends = np.cumsum(unpack_ints(lengths), dtype=np.int64).tolist()
    return [body[s:e] for s, e in zip([0, *ends], ends)]


class Block:
    """The unpacked rows of one block (see ``unpack_block``)."""

    def __init__(self, number: int, docs: pa.Table, sizes: np.ndarray, sequence: np.ndarray,
                 bucket_of: np.ndarray, buckets: dict[int, list[bytes]]):
        self.number, self.docs, self.sizes, self.sequence = number, docs, sizes, sequence
        self.bucket_of, self.buckets = bucket_of, buckets

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])

    def spread(self, by_bucket: dict[int, list | np.ndarray], dtype=None):
        """Values listed by bucket, put in the order of the word indexes."""
        order = np.argsort(self.bucket_of, kind="stable")
        if dtype is None:
            out = [None] * len(self.bucket_of)
            for i, v in zip(order.tolist(), (v for slot in sorted(by_bucket) for v in by_bucket[slot])):
                out[i] = v
            return out
        out = np.zeros(len(self.bucket_of), dtype)
        if len(order):
            out[order] = np.concatenate([by_bucket[s] for s in sorted(by_bucket)])
        return out

    def words(self) -> list[bytes]:
        return self.spread(self.buckets)


def _flush(number: int, ids: dict, codes: np.ndarray, sizes: list[int], trained: np.ndarray,
           metas: list[pa.RecordBatch], slots: int) -> Iterator[tuple]:
    words = list(ids)
    n = len(words)
    total = np.bincount(codes, minlength=n) if n else np.zeros(0, np.int64)
    order = np.argsort(-total, kind="stable")
    rank = np.empty(n, np.uint32)
    rank[order] = np.arange(n, dtype=np.uint32)
    in_training = np.repeat(trained, sizes) if len(codes) else np.zeros(0, bool)
    learned = np.bincount(codes[in_training], minlength=n) if n else total
    # distinct words only; their bytes decide the bucket
    raw = [words[i] if isinstance(words[i], bytes) else words[i].encode("utf-8", "surrogatepass")
           for i in order.tolist()]
    bucket_of = np.fromiter((xxhash.xxh32_intdigest(w) % slots for w in raw), np.uint32, n)
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches(metas)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    sequence = rank[codes] if n else np.zeros(0, np.uint32)
    yield (number, DOCS_SLOT, len(sizes), len(codes), _squeeze(
        sink.getvalue().to_pybytes(), pack_ints(np.array(sizes, np.uint32)), pack_ints(sequence),
        pack_ints(bucket_of)))
    by_bucket = np.argsort(bucket_of, kind="stable")
    present, cuts = np.unique(bucket_of[by_bucket], return_index=True)
    learned = learned[order]
    for slot, at in zip(present.tolist(), np.split(by_bucket, cuts[1:])):
        yield (number, slot, 0, len(at), _squeeze(
            *pack_ragged([raw[i] for i in at.tolist()]), pack_ints(learned[at])))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    cols = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      ["block", "slot", "docs", "words", "payload"])


def pack(df: DataFrame, text: str, keep: list[str], split: Callable[[str], list], slots: int,
         train: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of ``df`` as a table bucketed by block.

    ``split`` cuts a text (null: empty) into words. ``keep`` columns stay with
    the documents, ``train`` names a boolean column (null: false) of the
    documents whose words are counted. Rows are never merged: repeated rows
    stay apart, and null keys are kept.
    """
    keep = list(dict.fromkeys(keep))
    picked = df.select(F.col(text).alias("__text"), (F.coalesce(F.col(train), F.lit(False))
                       if train else F.lit(True)).alias("__train"), *keep)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0

        def fresh():
            ids = defaultdict()
            ids.default_factory = ids.__len__
            return ids, [], [], [], [], 0

        ids, codes, sizes, trained, metas, size = fresh()

        def flush():
            all_codes = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
            yield from _flush((part << 16) | serial, ids, all_codes, sizes, np.array(trained, bool), metas, slots)

        for batch in batches:
            texts, flags, first = batch.column("__text"), batch.column("__train").to_pylist(), 0
            for i in range(batch.num_rows):
                t = texts[i].as_py() or ""
                ws = split(t)
                codes.append(np.fromiter(map(ids.__getitem__, ws), np.uint32, len(ws)))
                sizes.append(len(ws))
                trained.append(flags[i])
                size += len(t)
                full = size >= block_bytes or len(sizes) >= BLOCK_DOCS
                if full or i == batch.num_rows - 1:
                    metas.append(batch.select(keep).slice(first, i + 1 - first))
                    first = i + 1
                if full:
                    yield _rows(list(flush()))
                    serial += 1
                    ids, codes, sizes, trained, metas, size = fresh()
        if sizes:
            yield _rows(list(flush()))
        del ids, codes, metas
        release()

    packed = picked.mapInArrow(build, SCHEMA)
    return common.bucketed(packed, "block", common.shuffle_partitions(df.sparkSession))


def unpack_bucket(payload: bytes) -> tuple[list[bytes], np.ndarray]:
    lengths, body, learned = _expand(payload)
    return unpack_ragged(lengths, body), unpack_ints(learned)


def unpack_block(rows: pa.Table) -> Block | None:
    """The block whose table rows these are (None if its own row is missing)."""
    buckets, own, number = {}, None, None
    for number, slot, payload in zip(*(rows.column(c).to_pylist() for c in ("block", "slot", "payload"))):
        if slot == DOCS_SLOT:
            own = payload
        else:
            buckets[slot] = unpack_bucket(payload)[0]
    if own is None:
        return None
    docs, sizes, sequence, bucket_of = _expand(own)
    return Block(number, pa.ipc.open_stream(docs).read_all(), unpack_ints(sizes), unpack_ints(sequence),
                 unpack_ints(bucket_of), buckets)


def answer(table: DataFrame, reply: Callable[[list[bytes], np.ndarray], list[bytes]]) -> DataFrame:
    """One reply row ``(block, slot, payload)`` per (block, bucket).

    All rows of a bucket meet in one group, whose size is the distinct words
    of all blocks over the number of buckets. ``reply(words, counts)`` gets the
    bucket's distinct words and their training counts over all blocks and
    returns one value per word. ``learned`` is, in one row of each bucket, how
    many of its words occur in training.
    """

    def group(rows: pa.Table) -> pa.Table:
        place, counts, wanted = {}, [], []
        for payload in rows.column("payload").to_pylist():
            words, learned = unpack_bucket(payload)
            at = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
            counts.append(learned)
            wanted.append(at)
        total = np.zeros(len(place), np.int64)
        for at, learned in zip(wanted, counts):
            total[at] += learned
        values = reply(list(place), total)
        out = [_squeeze(*pack_ragged([values[i] for i in at.tolist()])) for at in wanted]
        learned = [0] * len(out)
        learned[0] = int((total > 0).sum())
        del place, values
        release()
        return pa.table({"block": rows.column("block"), "slot": rows.column("slot"),
                         "learned": pa.array(learned, pa.int64()),
                         "payload": pa.array(out, pa.binary())})

    buckets = table.filter(F.col("slot") != DOCS_SLOT).select("block", "slot", "payload")
    return buckets.groupBy("slot").applyInArrow(
        group, "block long, slot int, learned long, payload binary")


def unpack_reply(replies: pa.Table) -> dict[int, list[bytes]]:
    return {s: unpack_ragged(*_expand(p)) for s, p in
            zip(replies.column("slot").to_pylist(), replies.column("payload").to_pylist())}


def reunite(table: DataFrame, replies: DataFrame, finish: Callable[[Block, dict], pa.Table], schema) -> DataFrame:
    """``finish(block, replies by bucket)`` for every block; only the replies move."""

    def both(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = finish(unpack_block(rows), unpack_reply(answers))
        release()
        return out

    return (table.groupBy("block").cogroup(replies.select("block", "slot", "payload").groupBy("block"))
            .applyInArrow(both, schema))
