"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into ``max_bits // 2 + 1`` segments, so of two
fingerprints within ``max_bits`` at least one segment differs by at most one
bit. Every segment is indexed under its one-wildcard variants (one bit deleted
each): two segments at most one bit apart share a variant. Distinct
fingerprints meet by an equality shuffle on the variant and are verified
there. Each pair is taken up only at the first variant it shares; a bucket
returns the pairs themselves if it is small and a spanning forest of them
otherwise, so links grow with the fingerprints, not with the square of a
group. Buckets over ``bucket_rows`` are dealt out again as pairs of parts.

Equal fingerprints are one node from the start, so a group of copies of any
size costs one row after a partial aggregate.

A null or word-free text has fingerprint zero, which links like any other.
Null ids are kept; they never become a component's id unless it has no other.
Very long texts and words are hashed whole, repeated rows stay row by row, an empty table
gives an empty one. ``keep`` may hold any name but the result's. Of rows that share the smallest id
of a group, ``one_of_each`` keeps the one whose text has the smallest hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import boundary, free_names
from tessera.llm.components import components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
BUCKET_ROWS = 20_000  # rows of one variant compared in one task
PAIRWISE = 64  # buckets up to this size return their pairs, larger ones a forest
STEP = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit set where over half of the shingle hashes have it (0: no word)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    width = min(shingle, len(words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b - 1], SEED) for a, b in zip(starts, ends[width - 1:])),
                         np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        raw = hashes[i:i + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``_fp``, the fingerprint as a signed long."""
    picked = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("_fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text")
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))],
                                             [*batch.schema.names[:-1], "_fp"])

    return picked.mapInArrow(run, schema)


def segments(max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    n = max_bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(bit, rest, fp)``: each fingerprint's segments with one bit deleted."""
    rows = [(first + i, ((1 << size) - 1) << first, 1 << (first + i)) for first, size in segments(max_bits)
            for i in range(size)]

    def signed(x: int) -> int:
        return x - (1 << 64) if x >= 1 << 63 else x

    kept = F.array(*[F.lit(signed(mask & ~bit)).cast("long") for _, mask, bit in rows])
    return (fps.select("fp", F.posexplode(kept).alias("bit", "_mask"))
            .select("bit", F.col("fp").bitwiseAND(F.col("_mask")).alias("rest"), "fp"))


class _Matcher:
    def __init__(self, max_bits: int):
        self.max_bits = max_bits
        self.masks = [np.uint64(((1 << size) - 1) << first) for first, size in segments(max_bits)]
        self.firsts = [first for first, _ in segments(max_bits)]
        self.segment_of = np.concatenate([np.full(size, i) for i, (_, size) in enumerate(segments(max_bits))])

    def linked(self, bit: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Within the distance, and not met at an earlier variant."""
        ok = np.bitwise_count(x) <= self.max_bits
        own = self.segment_of[bit]
        for i, mask in enumerate(self.masks):
            part = x & mask
            ok &= ~((own > i) & (np.bitwise_count(part) <= 1))
            here = own == i
            first = (part == 0) & (bit == self.firsts[i])
            single = part == (np.uint64(1) << bit.astype(np.uint64))
            ok &= ~here | first | single
        return ok

    def small(self, bit, group, fp) -> list[tuple]:
        out, step = [], 1
        at = np.flatnonzero(group[1:] == group[:-1])
        while len(at):
            ok = self.linked(bit[at], fp[at] ^ fp[at + step])
            out.append((fp[at[ok]], fp[at[ok] + step]))
            step += 1
            at = at[at + step < len(fp)]
            at = at[group[at] == group[at + step]]
        return out

    def large(self, bit: int, fp) -> list[tuple]:
        """A spanning forest of one bucket's links."""
        out, rest = [], fp
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                one = front.pop()
                ok = self.linked(np.full(len(rest), bit), rest ^ one)
                if ok.any():
                    new, rest = rest[ok], rest[~ok]
                    out.append((np.full(len(new), one, np.uint64), new))
                    front.extend(new)
        return out

    def pairs(self, bit, group, fp) -> list[tuple]:
        """Links of whole buckets; ``group`` marks equal buckets by equal numbers, in order."""
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(heads, len(fp)))
        out = []
        for h in np.flatnonzero(sizes > PAIRWISE):
            a, b = heads[h], heads[h] + sizes[h]
            out += self.large(int(bit[a]), fp[a:b])
        few = np.repeat(sizes <= PAIRWISE, sizes)
        return out + self.small(bit[few], group[few], fp[few])


def _compare(max_bits: int, limit: int | None, keys: list[str]):
    """Sorted variant rows in, links ``(a, b)`` out; buckets over ``limit`` pass on as ``(bit, rest, a)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(max_bits)
        held: np.ndarray | None = None  # key columns and fp of the open bucket
        spilled = None  # the bucket that has outgrown the limit

        def links(rows: np.ndarray) -> list[pa.RecordBatch]:
            change = (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)
            group = np.concatenate([[0], np.cumsum(change)])
            found = matcher.pairs(rows[:, 0], group, rows[:, -1].view(np.uint64))
            if not found:
                return []
            a, b = (np.concatenate([p[i] for p in found]).view(np.int64) for i in (0, 1))
            none = pa.nulls(len(a), pa.int64())
            return [pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], ["a", "b", "bit", "rest"])]

        def passed(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[:, -1]), pa.nulls(len(rows), pa.int64()), pa.array(rows[:, 0]), pa.array(rows[:, 1])],
                ["a", "b", "bit", "rest"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.ascontiguousarray(np.stack(
                [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in [*keys, "fp"]], axis=1))
            if held is not None:
                rows = np.concatenate([held, rows])
            if spilled is not None:
                more = (rows[:, :-1] == spilled).all(axis=1)
                if more.any():
                    yield passed(rows[more])
                    rows = rows[~more]
                if not len(rows):
                    held = None
                    continue
                spilled = None
            last = (rows[:, :-1] == rows[-1, :-1]).all(axis=1)
            if not last.all():
                yield from links(rows[~last])
            held = rows[last]
            if limit and len(held) > limit:
                yield passed(held)
                spilled, held = held[0, :-1].copy(), None
        if held is not None and len(held):
            yield from links(held)

    return run


OUT = "a long, b long, bit long, rest long"


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` (signed long) whose
    connected components are those of all pairs within ``max_bits``; they are stored."""
    met = variants(fps, max_bits).repartition("bit", "rest").sortWithinPartitions("bit", "rest", "fp")
    first = boundary(met.mapInArrow(_compare(max_bits, bucket_rows, ["bit", "rest"]), OUT))
    found = first.filter(F.col("bit").isNull()).select("a", "b")
    passed = first.filter(F.col("bit").isNotNull()).select("bit", "rest", F.col("a").alias("fp"))
    if passed.isEmpty():
        return found
    sizes = passed.groupBy("bit", "rest").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / (bucket_rows // 2)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("_parts")).cast("int")
    dealt = (passed.join(sizes, ["bit", "rest"]).withColumn("_parts", parts).withColumn("_own", own)
             .select("bit", "rest", "fp", "_own", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
             .select("bit", "rest", F.least("_own", "_other").alias("p"), F.greatest("_own", "_other").alias("q"), "fp"))
    keys = ["bit", "rest", "p", "q"]
    again = boundary(dealt.repartition(*keys).sortWithinPartitions(*keys, "fp")
                     .mapInArrow(_compare(max_bits, None, keys), OUT))
    return found.unionByName(again.select("a", "b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``id_col``, ``keep`` columns, ``fingerprint`` (hex) and ``component_id``, one row per row of ``df``."""
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate((id_col, *keep))]  # names of their own
    docs = boundary(fingerprints(df.select(*kept, F.col(text).alias("text")), "text",
                                 tuple(f"k{i}" for i in range(len(kept))), shingle))
    nodes = docs.groupBy(F.col("_fp").alias("fp")).agg(F.min("k0").alias("_least"))
    roots = components(links(nodes.select("fp"), max_bits, bucket_rows))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "_least", F.coalesce("root", "fp").alias("_root"))
    least = placed.groupBy("_root").agg(F.min("_least").alias("component_id"))
    label = placed.join(least, "_root").select(F.col("fp").alias("_fp"), "component_id")
    return docs.join(label, "_fp").select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate((id_col, *keep))], F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with one row of each group: the smallest id (null last), then the
    smallest text hash; of rows equal in both, any one (they are repeats)."""
    h, group_name, winner, winner_hash = free_names(df, "_text_hash", "_group", "_winner", "_winner_hash")
    marked = df.withColumn(h, F.xxhash64(text))
    found = near_duplicates(marked.select(id_col, text, F.col(h).alias("_h")), id_col, text, ("_h",), **options)
    # a group without any id still has a place of its own: that of its fingerprints
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp:"), "fingerprint"))
    best = found.groupBy(group.alias(group_name)).agg(
        F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col("_h").alias("h"))).alias("w"))
    winners = best.select(group_name, F.col("w.id").alias(winner), F.col("w.h").alias(winner_hash))
    kept = marked.join(winners, F.col(id_col).eqNullSafe(F.col(winner)) & (F.col(h) == F.col(winner_hash)))
    return kept.dropDuplicates([group_name]).select(*df.columns)
