"""Language-model scoring with a log-frequency Bloom filter.

Training counts every word and every word pair of the training documents over
the whole corpus. Word counts stay exact. A pair's count ``c`` is quantised to
``1 + floor(log_base c)`` and the filter holds one item (pair, level) for each
level up to it; a probe asks level after level until one is missing and takes
the middle of the last level's range as the count. Scores are Dirichlet-smoothed:

    p(w | v) = (c(v, w) + mu * p(w)) / (c(v) + mu),    p(w) = (c(w) + 1) / (N + V + 1)

so an unseen pair falls back on the exact word probability. A document is its
words and one end token; the first word's context is the start, which occurs
once per training document.

Shape of the work: documents are packed into blocks (see ``blocks``); distinct
words of each block are summed by bucket and the sums go back to the blocks.
Pairs are 64-bit hashes (a pair that fills the corpus is one entry per block)
shuffled to shards of the filter by their top bits; each shard is built in one
task. The filter is cut into parts, equal ranges of hashes of at most ``part_bytes`` (or
one shard) each; their sizes are an aggregate over the shards. One part after the other is
broadcast, scores the pairs that belong to it into a written table, and is destroyed before
the next one is fetched, so the driver and the workers hold one part at a time, whatever the
corpus. Partial scores add up; no pair is left out at any size.

Null and empty texts are one token, the end; very long texts and words are scored
whole. Rows with null ids count as documents with an empty id text. Repeated rows are
scored, and learned from, row by row. An empty training set gives p(w) = 1 for every
token, an empty table an empty result. Columns of ``keep`` may have any name but the
result's; others are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import blocks
from tessera.llm.common import boundary, shuffle_partitions

MU = 1000.0
LEVEL_BASE = 2.0
BITS, PROBES = 8, 4  # bits of the filter per item, and places of an item
PART_BYTES = 32 << 20  # the most of the filter that is broadcast at once
KEPT = 6  # low bytes of a pair's hash that tell it apart within its shard
SHARD_ITEMS = 1 << 15  # about this many training tokens per shard
STEP = 1 << 18  # tokens scored at once
START = 0x9E3779B97F4A7C15  # stands for the start of a text
END_WORD = b"\x20end"  # no word holds a space


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() + [END_WORD]


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def pair_hashes(block: blocks.Block) -> np.ndarray:
    """One hash per token: of the token and the one before it (or the start)."""
    words = block.words()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    own = hashes[block.sequence] if len(words) else np.zeros(0, np.uint64)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[block.starts()[:-1]] = np.uint64(START)  # every text has its end token
    return _mix(before * np.uint64(0x9E3779B97F4A7C15) + own)


def quantised(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def level_count(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts (0 for level 0)."""
    low = LEVEL_BASE ** (levels - 1)
    return np.where(levels > 0, (low + np.maximum(low, LEVEL_BASE * low - 1)) / 2, 0.0)


def _places(pairs: np.ndarray, level: int, width: np.ndarray | int) -> np.ndarray:
    """``PROBES`` bit places of each (pair, level) within a shard of ``width`` bits."""
    h = _mix(pairs + np.uint64((level * 0xD6E8FEB86659FD93) & (2**64 - 1)))
    step = (h >> np.uint64(32)) | np.uint64(1)
    low = h & np.uint64(0xFFFFFFFF)
    return np.stack([(low + np.uint64(i) * step) % width for i in range(PROBES)])


def shard_of(pairs: np.ndarray, shard_bits: int) -> np.ndarray:
    return (pairs >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(pairs), np.int64)


def build_shard(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shard's filter bytes; its length follows from the items it holds."""
    levels = quantised(counts)
    width = max(64, -(-int(levels.sum()) * BITS // 64) * 64)
    bits = np.zeros(width, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        bits[_places(pairs[levels >= level], level, np.uint64(width)).ravel().astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


class Filter:
    """Shards ``first .. last`` of the filter, as one byte array."""

    def __init__(self, shard_bits: int, first: int, sizes: list[int], data: bytes):
        self.shard_bits, self.first = shard_bits, first
        self.widths = np.array(sizes, np.uint64) * np.uint64(8)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64) * 8
        self.data = np.frombuffer(data, np.uint8)

    def probe(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a pair belongs to this part, and its level there."""
        shard = shard_of(pairs, self.shard_bits) - self.first
        mine = (shard >= 0) & (shard < len(self.widths))
        level = np.zeros(len(pairs), np.int64)
        live = np.flatnonzero(mine)
        live = live[self.widths[shard[live]] > 0]
        step = 1
        while len(live):
            own = shard[live]
            at = _places(_low(pairs[live]), step, self.widths[own]).astype(np.int64) + self.starts[own]
            there = ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)
            live = live[there]
            level[live] = step
            step += 1
        return mine, level


def pair_counts(table: DataFrame, train: str, shard_bits: int) -> DataFrame:
    """``(shard, pairs, counts)``: each block's distinct training pairs, by shard."""

    def group(rows: pa.Table) -> pa.Table:
        block = blocks.unpack_block(rows)
        out = []
        if block is not None:
            flags = np.array(block.docs.column(train).to_pylist(), bool)
            pairs, counts = np.unique(pair_hashes(block)[np.repeat(flags, block.sizes)], return_counts=True)
            shard = shard_of(pairs, shard_bits)
            heads = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
            for a, b in zip(heads, [*heads[1:], len(shard)]):
                low = pairs[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT]
                many = np.flatnonzero(counts[a:b] > 1).astype("<u4")
                out.append((int(shard[a]), low.tobytes(), many.tobytes() + counts[a:b][many].astype("<u4").tobytes()))
        block = None
        blocks.release()
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({"shard": pa.array(cols[0], pa.int64()), "pairs": pa.array(cols[1], pa.binary()),
                         "counts": pa.array(cols[2], pa.binary())})

    return table.groupBy("block").applyInArrow(group, "shard long, pairs binary, counts binary")


def _low(pairs: np.ndarray) -> np.ndarray:
    return pairs & np.uint64((1 << 8 * KEPT) - 1)


def _merge(payloads: Iterator[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for p, c in payloads:
        raw = np.zeros((len(p) // KEPT, 8), np.uint8)
        raw[:, :KEPT] = np.frombuffer(p, np.uint8).reshape(-1, KEPT)
        keys.append(raw.view("<u8").ravel())
        n = np.ones(len(raw), np.int64)
        many = np.frombuffer(c, "<u4")
        n[many[:len(many) // 2]] = many[len(many) // 2:]
        counts.append(n)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def filter_shards(counted: DataFrame) -> DataFrame:
    """``(shard, distinct, size, data)``: the filter of each shard."""

    def group(rows: pa.Table) -> pa.Table:
        pairs, counts = _merge(zip(rows.column("pairs").to_pylist(), rows.column("counts").to_pylist()))
        data = build_shard(pairs, counts).tobytes()
        return pa.table({"shard": rows.column("shard").slice(0, 1), "distinct": pa.array([len(pairs)], pa.int64()),
                         "size": pa.array([len(data)], pa.int64()), "data": pa.array([data], pa.binary())})

    return counted.groupBy("shard").applyInArrow(group, "shard long, distinct long, size long, data binary")


def _part_bits(shards: DataFrame, part_bytes: int, shard_bits: int) -> int:
    """Bits of the hash that number the parts: the fewest with which every part has at most
    ``part_bytes``, or a part for every shard."""
    for bits in range(shard_bits):
        part = F.shiftright("shard", shard_bits - bits)
        if int(shards.groupBy(part).agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] or 0) <= part_bytes:
            return bits
    return shard_bits


def score(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), train: str = "train",
          slots: int | None = None, block_bytes: int = blocks.BLOCK_BYTES, part_bytes: int = PART_BYTES,
          shard_bits: int | None = None) -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score and score of every row;
    the model learns from the rows whose boolean column ``train`` is true."""
    spark = df.sparkSession
    # working columns have names of their own, whatever ``keep`` holds
    kept = [f"k{i}" for i in range(len(keep))]
    numbered = df.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col(text).alias("_t"),
                         F.coalesce(F.col(train), F.lit(False)).alias("_train"))
    slots = slots or max(16, 2 * shuffle_partitions(spark))
    table = blocks.pack(numbered, "_t", [*kept, "_train"], split, slots, train="_train", block_bytes=block_bytes)

    def reply(_words: list[bytes], counts: np.ndarray) -> list[bytes]:
        raw = counts.astype("<i8").tobytes()
        return [raw[i:i + 8].rstrip(b"\0") for i in range(0, len(raw), 8)]

    replies = boundary(blocks.answer(table, reply))
    v = int(replies.agg(F.sum("learned")).first()[0] or 0)
    totals = train_totals(table, "_train").first()
    n_train, n_docs = int(totals["tokens"] or 0), int(totals["docs"] or 0)
    if shard_bits is None:
        shard_bits = (n_train // SHARD_ITEMS).bit_length()
    shards = boundary(filter_shards(pair_counts(table, "_train", shard_bits)))
    figures = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
               T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType())]
    place, part_score = T.StructField("_place", T.LongType()), T.StructField("_part", T.DoubleType())
    bits = _part_bits(shards, part_bytes, shard_bits)
    wide, narrow, width = None, [], 1 << shard_bits - bits
    for first in range(0, 1 << shard_bits, width):
        held = spark.sparkContext.broadcast((shard_bits, first, *_gather(shards, first, width)))
        # the first part's table has the documents' columns, the others only scores
        own = kept if wide is None else []
        fields = [place, *[numbered.schema[c] for c in own], *(figures if wide is None else []), part_score]
        part = boundary(blocks.reunite(table, replies, _scorer(held, own, wide is None, n_train, n_docs, v), T.StructType(fields)))
        held.destroy()
        wide, narrow = (part, narrow) if wide is None else (wide, [*narrow, part])
    if narrow:
        more = narrow[0]
        for part in narrow[1:]:
            more = more.unionByName(part)
        more = more.groupBy("_place").agg(F.sum("_part").alias("_more"))
        wide = wide.join(more, "_place").withColumn("_part", F.col("_part") + F.col("_more"))
    return wide.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], *[f.name for f in figures], F.col("_part").alias("score"))


def _gather(shards: DataFrame, first: int, width: int) -> tuple[list[int], bytearray]:
    """Sizes and bytes of ``width`` shards from ``first`` on, fetched one Spark partition
    at a time into one buffer of a part's size."""
    own = shards.filter(F.col("shard").between(first, first + width - 1))
    sizes = [0] * width
    for r in own.select("shard", "size").toLocalIterator():
        sizes[r["shard"] - first] = r["size"]
    ends = np.cumsum(sizes, dtype=np.int64)
    data = bytearray(int(ends[-1]))
    for r in own.select("shard", "data").toLocalIterator():
        end = int(ends[r["shard"] - first])
        data[end - len(r["data"]):end] = r["data"]
    return sizes, data


def train_totals(table: DataFrame, train: str) -> DataFrame:
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = tokens = 0
            for payload in batch.column("payload").to_pylist():
                own, sizes, _, _ = blocks._expand(payload)
                flags = np.array(pa.ipc.open_stream(own).read_all().column(train).to_pylist(), bool)
                docs += int(flags.sum())
                tokens += int(blocks.unpack_ints(sizes)[flags].sum())
            yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([tokens])], ["docs", "tokens"])

    own = table.filter(F.col("slot") == blocks.DOCS_SLOT).select("payload")
    return own.mapInArrow(group, "docs long, tokens long").agg(F.sum("docs").alias("docs"),
                                                               F.sum("tokens").alias("tokens"))


def _scorer(held, keep: list[str], figures: bool, n_train: int, n_docs: int, v: int):
    """Scores of one filter part. A pair outside it scores nothing here."""

    def finish(block: blocks.Block, replies: dict) -> pa.Table:
        counts = np.array([int.from_bytes(x, "little") for x in block.spread(replies)], np.int64)
        c = counts[block.sequence] if len(counts) else np.zeros(0, np.int64)
        starts = block.starts()[:-1]
        p = (c + 1.0) / (n_train + v + 1.0)
        context = np.empty(len(c), np.float64)
        context[1:] = c[:-1]
        context[starts] = n_docs
        pairs = pair_hashes(block)
        part, logp = Filter(*held.value), np.zeros(len(pairs))
        for a in range(0, len(pairs), STEP):
            own = slice(a, a + STEP)
            distinct, at = np.unique(pairs[own], return_inverse=True)
            mine, level = part.probe(distinct)
            found = np.minimum(level_count(level)[at], context[own])
            logp[own] = np.where(mine[at], np.log10((found + MU * p[own]) / (context[own] + MU)), 0.0)

        def per_doc(x):
            return np.add.reduceat(x, starts) if len(starts) else np.zeros(0)

        out = {"_place": pa.array((np.int64(block.number) << 24) + np.arange(len(starts)), pa.int64())}
        for k in keep:
            out[k] = block.docs.column(k)
        if figures:
            out["n_tokens"] = pa.array(block.sizes.astype(np.int64))
            out["n_known"] = pa.array(per_doc((c > 0).astype(np.int64)).astype(np.int64))
            out["train_tokens"] = pa.array(np.full(len(starts), n_train, np.int64))
            out["base_score"] = pa.array(per_doc(np.log10(p)).astype(np.float64))
        out["_part"] = pa.array(per_doc(logp).astype(np.float64))
        return pa.table(out)

    return finish
