"""Ranked lexical search by range-maximum tables over posting lists.

``index`` cuts the documents into shards (rows of a written table): the terms,
and for each a posting list of documents and term counts. Documents count from 0 in
the order of their ids within a shard. Corpus figures (documents, terms,
document frequencies) are aggregates over the shards.

``search`` gives every posting of a query term its impact, the whole part of a
score that the term adds, and builds a sparse table of maximum positions over
the lists (``RangeMaxima``). A query starts with the interval of all documents of
a shard. The sum over its terms of the largest impact inside an interval bounds
every score there. Intervals are taken best bound first, a batch at once; each is
split at the document with its largest single impact, whose exact score is known
from the same look-up, and the parts on both sides get bounds of their own. An interval
whose bound cannot reach the ``k``-th best score known is dropped.

A first pass scores only the documents with the largest impacts of every shard, and the
``k``-th best of those over all shards is where every shard starts in the second pass.

Queries come in parts of ``part_terms`` terms at most (or one query, if it has
more), each broadcast by itself and compared with all shards: the stated query set against
all rows, in blocks. What reaches the driver is bounded by a part. Nothing
but ``k`` rows for each query and task is shuffled, merged in two steps.

Null and empty texts have no terms, match nothing and do not count as documents;
very long ones are indexed whole. Rows that share an id, and those with a null id
(last among equal scores), are documents of their own, and equal rows of the query table
are queries of their own. An empty corpus or query table gives an empty result. Only
the id and the text columns are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import boundary
from tessera.llm.terms import blanked, terms

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_BYTES, SHARD_DOCS = 8 << 20, 8192
PART_TERMS = 500_000
BATCH = 128  # intervals split at once
PROBES = 4  # documents of largest impact in each term's list that the first pass scores
LAST = np.iinfo(np.int64).max
SHARD = ("docs long, n_terms long, ids array<long>, sizes array<long>, terms array<binary>, df array<long>, "
         "at binary, tf binary")


def _shard(ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
    order = sorted(range(len(ids)), key=lambda i: LAST if ids[i] is None else ids[i])
    words, sizes = terms([texts[i] for i in order])
    coded = words.dictionary_encode()
    doc = np.repeat(np.arange(len(order)), sizes)
    keys, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(order) + doc, return_counts=True)
    term, at = np.divmod(keys, len(order))
    df = np.bincount(term, minlength=len(coded.dictionary))
    return pa.RecordBatch.from_arrays(
        [pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), pa.array([[ids[i] for i in order]], pa.list_(pa.int64())),
         pa.array([sizes]), pa.ListArray.from_arrays([0, len(df)], coded.dictionary.cast(pa.binary())), pa.array([df]),
         pa.array([at.astype(np.int32).tobytes()]), pa.array([tf.astype(np.int32).tobytes()])],
        ["docs", "n_terms", "ids", "sizes", "terms", "df", "at", "tf"])


def index(df: DataFrame, id_col: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES,
          shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per shard, written to the shared folder in row groups of their own: a task holds one at a time,
    however many shards its file has."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(blanked(t.as_py()))
                size += len(texts[-1])
                if size >= shard_bytes or len(ids) >= shard_docs:
                    yield _shard(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield _shard(ids, texts)

    return boundary(df.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(build, SHARD), group_rows=1)


class RangeMaxima:
    """Places of the largest values in ranges of an array: ``table[j][i]`` is that of
    ``2**j`` values from ``i`` on. Built up to ranges of ``longest`` values."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values, self.table = values, [np.arange(len(values), dtype=np.int32)]
        step = 1
        while 2 * step <= longest:
            low = self.table[-1]
            a, b = low[:-step], low[step:]
            self.table.append(np.where(values[a] >= values[b], a, b))
            step *= 2
        self.starts = np.cumsum([0, *map(len, self.table)])
        self.flat = np.concatenate(self.table)
        self.table = None

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the maxima of ``[left, right)``, none of them empty."""
        level = np.frexp((right - left).astype(np.float64))[1] - 1
        row = self.starts[level]
        a, b = self.flat[row + left], self.flat[row + right - (1 << level)]
        return np.where(self.values[a] >= self.values[b], a, b)


class _Lists:
    """Posting lists of the query terms in one shard, and their impacts."""

    def __init__(self, row: dict, vocabulary: pa.Array, weights: np.ndarray, docs: int, total: int):
        ids = row["ids"].values
        self.ids = pc.fill_null(ids, LAST).to_numpy()
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.n = len(self.ids)
        df = row["df"].values.to_numpy()
        code = pc.index_in(row["terms"].values, value_set=vocabulary)  # null: no query holds the term
        code = pc.fill_null(code, -1).to_numpy()
        wanted = np.flatnonzero(code >= 0)
        wanted = wanted[weights[code[wanted]] > 0]
        first = np.cumsum(df) - df
        place = np.repeat(first[wanted] - (np.cumsum(df[wanted]) - df[wanted]), df[wanted]) + np.arange(df[wanted].sum())
        at = np.frombuffer(row["at"].as_py(), np.int32)[place].astype(np.int64)
        tf = np.frombuffer(row["tf"].as_py(), np.int32)[place].astype(np.int64)
        sizes = row["sizes"].values.to_numpy()
        m = 25 + 75 * sizes * docs // max(1, total)
        self.impact = np.repeat(weights[code[wanted]], df[wanted]) * (1_000_000_000 * tf // (1000 * tf + 8 * m[at]))
        # one ascending array over all lists: list number * documents + document
        self.keys = np.repeat(np.arange(len(wanted)), df[wanted]) * self.n + at
        self.ends = np.cumsum(df[wanted])
        self.begin = self.ends - df[wanted]
        self.probes: dict[int, np.ndarray] = {}
        self.of = {int(c): i for i, c in enumerate(code[wanted])}
        self.maxima = RangeMaxima(self.impact, int(df[wanted].max(initial=1)))

    def pick(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of a query's terms that are here, and how often it holds each."""
        have = [(self.of[c], n) for c, n in zip(codes.tolist(), counts.tolist()) if c in self.of]
        lists, times = (np.array(x, np.int64) for x in zip(*have)) if have else (np.zeros(0, np.int64),) * 2
        return lists, times

    def scores(self, lists: np.ndarray, times: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return self._find(lists, docs)[2] @ times

    def _find(self, lists: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every document (row) and list (column): the first posting not before it,
        whether that is its own, and its impact (0 if not)."""
        wanted = lists[None, :] * self.n + docs[:, None]
        place = np.searchsorted(self.keys, wanted.T.ravel()).reshape(wanted.T.shape).T
        inside = np.minimum(place, len(self.keys) - 1)
        held = self.keys[inside] == wanted
        return place, held, np.where(held, self.impact[inside], 0)

    def probe(self, lists: np.ndarray, times: np.ndarray, count: int) -> np.ndarray:
        """Documents with the largest impacts of each list."""
        for i in lists.tolist():
            if i not in self.probes:
                own = self.impact[self.begin[i]:self.ends[i]]
                top = np.argpartition(-own, count)[:count] if len(own) > count else np.arange(len(own))
                self.probes[i] = self.keys[self.begin[i] + top] % self.n
        return np.unique(np.concatenate([self.probes[i] for i in lists.tolist()]))


class _Best:
    """The ``k`` best (score, id) of a query so far, and the limit others must pass."""

    def __init__(self, k: int, score: int = 0, doc: int = LAST):
        self.k, self.floor = k, (score, doc)
        self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = (score > self.floor[0]) | ((score == self.floor[0]) & (doc <= self.floor[1]) & (score > 0))
        if good.any():
            s, d, n = (np.concatenate(x) for x in ((self.score, score[good]), (self.doc, doc[good]), (self.null, null[good])))
            top = np.lexsort((d, -s))[:self.k]
            self.score, self.doc, self.null = s[top], d[top], n[top]

    def limit(self) -> tuple[int, int]:
        if len(self.score) < self.k:
            return self.floor
        return max(self.floor, (int(self.score[-1]), int(self.doc[-1])), key=lambda x: (x[0], -x[1]))


def _search(x: _Lists, lists: np.ndarray, times: np.ndarray, best: _Best, batch: int = BATCH) -> int:
    """Best-first over document intervals of one shard; returns the documents scored."""
    lo, hi = np.zeros(1, np.int64), np.full(1, x.n, np.int64)
    left, right = x.begin[lists][None, :], x.ends[lists][None, :]
    bound, split = _bounds(x, left, right, times, lo)
    scored = 0
    while True:
        score, doc = best.limit()
        open_ = (bound > score) | ((bound == score) & (bound > 0) & (x.ids[lo] <= doc))
        if not open_.all():
            lo, hi, left, right, bound, split = (v[open_] for v in (lo, hi, left, right, bound, split))
        if not len(lo):
            return scored
        take = np.zeros(len(lo), bool)
        take[np.argpartition(-bound, batch)[:batch] if len(lo) > batch else slice(None)] = True
        a, b, l, r, at = lo[take], hi[take], left[take], right[take], split[take]
        place, held, value = x._find(lists, at)
        best.add(value @ times, x.ids[at], x.null[at])
        scored += len(at)
        # the parts before and after the split; empty ones go
        parts = [(a, at, l, place), (at + 1, b, place + held, r)]
        lo2, hi2, l2, r2 = (np.concatenate([p[i] for p in parts]) for i in range(4))
        some = lo2 < hi2
        lo2, hi2, l2, r2 = lo2[some], hi2[some], l2[some], r2[some]
        bound2, split2 = _bounds(x, l2, r2, times, lo2)
        rest = ~take
        lo, hi, left, right, bound, split = (
            np.concatenate([v[rest], w]) for v, w in
            ((lo, lo2), (hi, hi2), (left, l2), (right, r2), (bound, bound2), (split, split2)))


def _bounds(x: _Lists, left, right, times, lo) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the lists' largest impacts in every interval, and the document of the largest."""
    row, col = np.nonzero(right > left)
    top = x.maxima(left[row, col], right[row, col])
    value = x.impact[top] * times[col]
    bound = np.zeros(len(lo), np.int64)
    np.add.at(bound, row, value)
    split = lo.copy()
    order = np.argsort(value, kind="stable")
    split[row[order]] = x.keys[top[order]] % x.n  # the last written is the largest
    return bound, split


def _queries(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(q, item)`` with the query's terms, each with how often it stands there."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return boundary(df.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("item"),
                              F.regexp_extract_all(lower, F.lit(PATTERN), F.lit(0)).alias("terms")))


def search(df: DataFrame, queries: DataFrame, id_col: str = "doc_id", text: str = "text", query_id: str = "item_id",
           query_text: str = "text", k: int = 10, part_terms: int = PART_TERMS, shard_bytes: int = SHARD_BYTES,
           shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``query_id, rank, doc_id, score``: the ``k`` best rows of ``df`` for every row of ``queries``."""
    shards = index(df, id_col, text, shard_bytes, shard_docs)
    figures = shards.agg(F.sum("docs"), F.sum("n_terms")).first()
    docs, total = int(figures[0] or 0), int(figures[1] or 0)
    asked = _queries(queries, query_id, query_text)
    held = boundary(asked.select("q", F.explode("terms").alias("term")).groupBy("q", "term")
                    .agg(F.count(F.lit(1)).alias("times")).withColumn("term", F.encode("term", "UTF-8")))
    n_held = held.count()
    schema = "query_id long, rank int, doc_id long, score long"
    if not docs or not n_held:
        return df.sparkSession.createDataFrame([], schema)
    wanted = held.select("term").distinct()
    df_of = (shards.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).select("p.terms", "p.df")
             .join(wanted, F.col("terms") == F.col("term"), "left_semi").groupBy("terms").agg(F.sum("df").alias("df")))
    weight = F.floor(1000 * F.log((2.0 * docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighed = boundary(held.join(df_of.select(F.col("terms").alias("term"), weight.alias("w")), "term")
                       .select("q", "term", "times", "w"))
    parts = -(-n_held // part_terms)
    found = []
    for part in range(parts):
        own = weighed.filter(F.pmod(F.xxhash64("q"), F.lit(parts)) == part)
        found.append(_search_part(shards, own, docs, total, k))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    ranked = _top(rows, k).join(asked.select("q", "item"), "q")
    return ranked.select(F.col("item").alias("query_id"), "rank", "doc_id", "score")


def _top(rows: DataFrame, k: int) -> DataFrame:
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("q", F.pmod(F.xxhash64("doc_id"), F.lit(32))).orderBy(*best)
    all_ = Window.partitionBy("q").orderBy(*best)
    return (rows.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
            .withColumn("rank", F.row_number().over(all_)).filter(F.col("rank") <= k))


FOUND = "q long, doc_id long, score long"


def _search_part(shards: DataFrame, weighed: DataFrame, docs: int, total: int, k: int) -> DataFrame:
    """``FOUND`` rows of the queries in ``weighed``, written; one broadcast of their terms."""
    sc = shards.sparkSession.sparkContext
    table = weighed.toArrow().combine_chunks()
    coded = table.column("term").combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy()
    weights = np.zeros(len(coded.dictionary), np.int64)
    weights[codes] = table.column("w").to_numpy()
    order = np.argsort(table.column("q").to_numpy(), kind="stable")
    q, first = np.unique(table.column("q").to_numpy()[order], return_index=True)
    cut = [*first.tolist(), len(order)]
    times = table.column("times").to_numpy()
    packed = {int(n): (codes[order[a:b]], times[order[a:b]]) for n, a, b in zip(q, cut, cut[1:])}
    shared = sc.broadcast((coded.dictionary.cast(pa.binary()), weights, packed))

    def run(limits):
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, weights, packed = shared.value
            floors = limits.value if limits else {}
            best = {n: _Best(k, *floors.get(n, (0, LAST))) for n in packed}
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    x = _Lists(row, vocabulary, weights, docs, total)
                    for n, (own, times) in packed.items():
                        lists, times = x.pick(own, times)
                        if not len(lists):
                            continue
                        if limits:
                            _search(x, lists, times, best[n])
                        else:
                            at = x.probe(lists, times, PROBES)
                            best[n].add(x.scores(lists, times, at), x.ids[at], x.null[at])
            for n, b in best.items():
                if len(b.score):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(b.score), n)), pa.array(b.doc, mask=b.null), pa.array(b.score)],
                        ["q", "doc_id", "score"])

        return over

    rows = shards.select("ids", "sizes", "terms", "df", "at", "tf")
    seen = _top(rows.mapInArrow(run(None), FOUND), k).filter(F.col("rank") == k)
    limits = sc.broadcast({r["q"]: (r["score"], LAST if r["doc_id"] is None else r["doc_id"]) for r in seen.collect()})
    found = boundary(rows.mapInArrow(run(limits), FOUND))
    shared.destroy()
    limits.destroy()
    return found


SQL = f"""
WITH words AS (SELECT rid, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PATTERN}')) AS term
               FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
post AS (SELECT rid, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT rid, sum(tf)::BIGINT AS n FROM post GROUP BY rid),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM size),
weight AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
           FROM post, whole GROUP BY term),
ask AS (SELECT qid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PATTERN}')) AS term
        FROM (SELECT row_number() OVER () AS qid, item_id, text FROM benchmark)),
scored AS (SELECT qid, item_id, rid, doc_id,
                  sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
           FROM ask JOIN post USING (term) JOIN weight USING (term) JOIN size USING (rid), whole GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
