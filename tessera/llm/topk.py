"""Exact top-k inner products over norm-sorted blocks.

Vectors become integers ``floor(scale * x)``. They are ordered by descending
length and packed into blocks; a block's vectors are rotated by the
eigenvectors of the corpus Gram matrix (the right singular vectors), so the
first rotated components carry most of an inner product. For a query with a
known k-th best score ``t`` (from the longest vectors of all, then from the
block itself) a vector is dropped when

    |q| |x| < t                                  (and with it all shorter ones), or
    q_head . x_head + |q_tail| |x_tail| < t      (Cauchy-Schwarz on the rest).

What is left is scored exactly in integers. Bounds are widened by the rotation's
rounding error, so no vector with a score of ``t`` or more is lost.

Queries travel in blocks (a stated query set against all rows), and only to vector blocks
that can hold a result: the first threshold of a query over its own length is the least
length a vector needs, and the least of these over a block of queries is where the descending
vector blocks end for it. Which those are is a running count over block summaries, before any
payload moves. A block pair returns at most k rows per query row, merged in two steps.

Rows without an id, with a null vector, or with a null or non-finite component
take no part. Shorter vectors count as filled up with zeros. Repeated rows
(same id and vector) count once; rows that share an id but not the vector stay
apart, as candidates and as queries with results of their own, and never answer a query of
their own id. Empty tables, and those without a usable vector, give an empty result. Only the
id and the vector are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import boundary
from tessera.plans import prefix

SCALE = 256
SEEDS = 2048  # longest vectors that give every query its first threshold
BLOCK = 16_384  # vectors of a block
QUERY_BLOCK = 1024  # queries of a block
STRIP = 2048  # vectors compared at once within a block
HEAD = 0.5  # share of rotated components in the first partial sum


def quantise(df: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``(id, v, len)``: usable rows as integer vectors with their squared length."""
    x = F.col(vector)
    usable = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    rows = df.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.distinct().withColumn("len", F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    sizes = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten())
    if (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.int64)
    out = np.zeros((len(sizes), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, col] = flat
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, strongest first: tasks sum the
    dim x dim Gram matrix of their rows, which is all the driver sees."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total))], ["i", "g"])

    def add(lines: pa.Table) -> pa.Table:
        total = np.stack([np.asarray(x.values) for x in lines.column("g")]).sum(axis=0)
        return pa.table({"i": lines.column("i").slice(0, 1), "g": pa.array([total])})

    kind = "i long, g array<double>"
    out = np.zeros((dim, dim))
    for r in rows.select("v").mapInArrow(gram, kind).groupBy("i").applyInArrow(add, kind).collect():
        out[r["i"]] = r["g"]
    values, vectors = np.linalg.eigh(out)
    return np.ascontiguousarray(vectors[:, ::-1])


def _pack(rows: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(rows.column("id")), _matrix(rows.column("v").combine_chunks(), dim)


class _Searcher:
    """Top k of one block of vectors (descending length) for a block of queries."""

    def __init__(self, turn: np.ndarray, k: int):
        self.turn, self.k = turn, k
        self.head = max(1, int(turn.shape[0] * HEAD))

    def _turned(self, m: np.ndarray):
        r = m.astype(np.float64) @ self.turn
        head, tail = r[:, :self.head], r[:, self.head:]
        return head, np.sqrt((tail * tail).sum(axis=1)), np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))

    def search(self, qid, q, first, vid, v):
        """``first``: scores that k vectors are known to reach (or -inf). Yields
        (query row, vector row, score) with at most k per query."""
        n, k = len(qid), self.k
        q_head, q_tail, q_len = self._turned(q)
        best = np.full((n, k), -np.inf)
        kept_rows = np.full((n, k), -1, np.int64)
        live = np.arange(n)
        for a in range(0, len(vid), STRIP):
            block, ids = v[a:a + STRIP], vid[a:a + STRIP]
            v_head, v_tail, v_len = self._turned(block)
            bar = np.maximum(first, best[:, -1])
            slack = 1e-9 * (1.0 + q_len * v_len.max(initial=0.0))
            live = live[q_len[live] * v_len[0] + slack[live] >= bar[live]]
            if not len(live):
                break
            open_ = q_head[live] @ v_head.T + np.outer(q_tail[live], v_tail) + slack[live, None] >= bar[live, None]
            open_ &= qid[live][:, None] != ids[None, :]
            rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if not len(rows):
                continue
            open_ = open_[np.ix_(rows, cols)]
            score = np.where(open_, self._exact(q[live[rows]], block[cols]), np.iinfo(np.int64).min)
            limit = bar[live[rows]]
            if len(cols) > k:  # the k-th best here is a threshold too
                limit = np.maximum(limit, np.partition(score, -k, axis=1)[:, -k])
            row, col = np.nonzero(open_ & (score >= limit[:, None]))
            self._merge(best, kept_rows, live[rows[row]], cols[col] + a, score[row, col], vid)
        return best, kept_rows

    @staticmethod
    def _exact(q, v):
        """Integer inner products of all rows; doubles hold them exactly up to 2**53."""
        reach = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
        if reach < 2**53:
            return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
        return q @ v.T

    def _merge(self, best, kept, row, col, score, vid):
        if not len(row):
            return
        order = np.lexsort((vid[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        place = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
        top = place < self.k
        fresh = np.full((len(best), self.k), -np.inf)
        fresh_at = np.full((len(best), self.k), -1, np.int64)
        fresh[row[top], place[top]] = score[top]
        fresh_at[row[top], place[top]] = col[top]
        touched = np.unique(row)
        all_score = np.concatenate([best[touched], fresh[touched]], axis=1)
        all_at = np.concatenate([kept[touched], fresh_at[touched]], axis=1)
        ids = np.where(all_at >= 0, vid[all_at], np.iinfo(np.int64).max)
        pick = np.lexsort((ids, -all_score), axis=1)[:, :self.k]
        best[touched] = np.take_along_axis(all_score, pick, axis=1)
        kept[touched] = np.take_along_axis(all_at, pick, axis=1)


def search(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50,
           scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK, seeds: int = SEEDS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible by
    ``every``, its ``k`` best other rows (ties to the smaller id)."""
    schema = "query_id long, rank int, vec_id long, score long"
    rows = boundary(quantise(df, id_col, vector, scale))
    shape = rows.agg(F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    n, dim = int(shape["n"]), int(shape["dim"] or 0)
    if not dim:
        return df.sparkSession.createDataFrame([], schema)
    turn = rotation(rows, dim)

    # blocks of vectors in descending length: ranges of length, cut where the range sort cuts
    parts = -(-n // block)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial, held, size = TaskContext.get().partitionId(), 0, [], 0

        def emit():
            t = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as out:
                out.write_table(t)
            longest = int(t.column("len")[0].as_py())
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | serial], pa.int64()), pa.array([np.sqrt(float(longest))]),
                 pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["b", "longest", "data"])

        for batch in batches:
            for a in range(0, batch.num_rows, block):
                held.append(batch.slice(a, min(block, batch.num_rows - a)))
                size += held[-1].num_rows
                if size >= block:
                    yield emit()
                    serial, held, size = serial + 1, [], 0
        if held:
            yield emit()

    ordered = rows.repartitionByRange(parts, F.desc("len"), "id").sortWithinPartitions(F.desc("len"), "id")
    vectors = boundary(ordered.select("id", "v", "len").mapInArrow(pack, "b long, longest double, data binary"))
    asked = rows.filter(F.col("id") % every == 0)
    n_asked = asked.count()
    # by length: queries that need long vectors share blocks, so these reach less of the vectors
    queries = (asked.repartitionByRange(-(-max(1, n_asked) // query_block), F.desc("len"), "id")
               .select("id", "v", F.xxhash64("v").alias("h")))
    longest = rows.orderBy(F.desc("len"), "id").limit(seeds).select("id", "v")
    held_seeds = df.sparkSession.sparkContext.broadcast(_pack(longest.toArrow(), dim))  # ``seeds`` rows at most

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vid, v = held_seeds.value
        searcher = _Searcher(turn, k)
        for batch in batches:
            for a in range(0, batch.num_rows, query_block):
                t = pa.Table.from_batches([batch.slice(a, query_block)])
                qid, q = _pack(t, dim)
                best, _ = searcher.search(qid, q, np.full(len(qid), -np.inf), vid, v)
                t = t.append_column("first", pa.array(best[:, -1]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema) as out:
                    out.write_table(t)
                yield pa.RecordBatch.from_arrays([pa.array([_least_length(q, best[:, -1])]),
                                                  pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["least", "queries"])

    query_blocks = boundary(queries.mapInArrow(start, "least double, queries binary"))
    pairs = block_pairs(vectors.select("b", "longest"), query_blocks.withColumn("_q", F.monotonically_increasing_id()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, last, unpacked = _Searcher(turn, k), None, None
        for batch in batches:
            for b, data, asked_for in zip(batch.column("b").to_pylist(), batch.column("data"),
                                          batch.column("queries")):
                if b != last:
                    unpacked, last = _pack(pa.ipc.open_stream(data.as_py()).read_all(), dim), b
                vid, v = unpacked
                t = pa.ipc.open_stream(asked_for.as_py()).read_all()
                qid, q = _pack(t, dim)
                best, at = searcher.search(qid, q, np.asarray(t.column("first")), vid, v)
                row, place = np.nonzero(at >= 0)
                own = np.asarray(t.column("h"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid[row]), pa.array(own[row]), pa.array(vid[at[row, place]]),
                     pa.array(best[row, place].astype(np.int64))], ["query_id", "h", "vec_id", "score"])

    found = (pairs.join(vectors, "b").select("b", "data", "queries")
             .mapInArrow(compare, "query_id long, h long, vec_id long, score long"))
    # a query row gets at most k rows from each vector block; the first step leaves k of each part of these
    some = Window.partitionBy("query_id", "h", F.pmod(F.xxhash64("vec_id"), F.lit(16))).orderBy(F.desc("score"), "vec_id")
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _least_length(q: np.ndarray, first: np.ndarray) -> float:
    """The length below which no vector can reach the first threshold of any query of a block."""
    size = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    need = np.divide(first, size, out=np.full(len(first), np.inf), where=size > 0)
    # a query of length 0 has only scores of 0; widened by what the division rounds
    need = np.where(size > 0, need, np.where(first > 0, np.inf, -np.inf))
    return float(need.min(initial=np.inf)) * (1 - 1e-9) - 1e-9 if len(need) else np.inf


def block_pairs(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``(b, queries)`` of the block pairs to compare: to every row of ``queries`` (_q, least, queries)
    the vector blocks (b, longest) with a longest vector of ``least`` or more. A running count of
    blocks in the order of both lengths gives each query block its number of them."""
    both = (vectors.select(F.col("longest").alias("size"), F.lit(0).alias("kind"), F.col("b").alias("key"))
            .unionByName(queries.select(F.col("least").alias("size"), F.lit(1).alias("kind"), F.col("_q").alias("key"))))
    counted = prefix.running_total(both, [F.desc("size"), "kind", "key"], F.when(F.col("kind") == 0, 1).otherwise(0), "upto")
    blocks = counted.filter("kind = 0").select(F.col("key").alias("b"), F.col("upto").alias("at"))
    reach = counted.filter((F.col("kind") == 1) & (F.col("upto") > 0)).select(
        F.col("key").alias("_q"), F.explode(F.sequence(F.lit(1).cast("long"), "upto")).alias("at"))
    return reach.join(blocks, "at").join(queries.select("_q", "queries"), "_q").select("b", "queries")


SQL = f"""
WITH v AS (SELECT *, row_number() OVER () AS rid FROM (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
s AS (SELECT q.vec_id AS query_id, q.rid, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
