"""Line dedup by overlapping three-line windows.

A text is cut into lines after each newline, and a line further wherever its words
say so: after a word whose key (of its MD5) is below those of the ``NEAR`` words before
it and not above those of the ``NEAR`` words after it, all in the same line. Such
cuts depend on nothing but the words nearby, so a passage repeated in the middle of a paragraph
is cut alike at both places, whatever surrounds it and however it is punctuated.
Pieces have about six words. A run of words that repeats in itself with
a period of ``NEAR`` or less has no cut.

Every three consecutive non-blank pieces (trimmed) are one window, known by a 96-bit
hash. A window stays where it occurs first: in the document with the smallest id, at its
first place there. Every later occurrence covers its three pieces; covered
pieces are merged into runs, and the runs are cut out together with blank lines inside them.

Tasks cut blocks of texts into numpy arrays. Within a block only the occurrence
in the smallest id stands for a window, so a hot window sends one row per block;
the others are later ones in any case. One shuffle brings the rows of a window
together, ranked by id. What comes back per document is at most one number per piece.

Texts with fewer than three pieces have no window and stay as they are, null
text stays null, very long texts are cut whole. Rows that share an id count as one
document: none of them is later than the other, and rows with a null id come after all
others. An empty table gives an empty one. Other columns are untouched, also those
named like working columns; a document that is all repeats keeps its row with an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_names

WINDOW = 3
NEAR = 3
BLOCK = 8 << 20  # bytes of text that a task cuts at once
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Pieces:
    """The non-blank pieces of a block of texts (UTF-8), in order."""

    def __init__(self, texts: list[bytes], near: int = NEAR):
        self.texts = texts
        self.whole = b"\n".join([*texts, b""])
        data = np.frombuffer(self.whole, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.end = self.begin + sizes
        solid = np.concatenate([[False], ~_BLANK[data], [False]])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        first, last = edges[::2], edges[1::2]
        self.breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(self.breaks, first)
        ends = self._cuts(data, solid[1:-1], first, last, line, near)
        ends[:-1] |= line[1:] != line[:-1]
        ends[-1:] = True
        tail = np.flatnonzero(ends)
        head = np.concatenate([[0], tail[:-1] + 1]) if len(tail) else tail
        self.first, self.last, self.line = first[head], last[tail], line[head]
        self.doc = np.searchsorted(self.begin, self.first, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts))

    @staticmethod
    def _cuts(data, solid, first, last, line, near) -> np.ndarray:
        offsets = np.zeros(len(first) + 1, np.int64)
        np.cumsum(last - first, out=offsets[1:])
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]).dictionary_encode()
        own = b"".join(hashlib.md5(w).digest()[:8] for w in words.dictionary.to_pylist())
        keys = np.frombuffer(own, ">u8").astype(np.uint64)[words.indices.to_numpy()]
        cuts = np.ones(len(first), bool)
        for d in range(1, near + 1):
            other = line[d:] != line[:-d]
            cuts[d:] &= other | (keys[d:] < keys[:-d])
            cuts[:-d] &= other | (keys[:-d] <= keys[d:])
        return cuts

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every window: two hashes, its document and its first piece's number there."""
        digest, whole = xxhash.xxh3_128_digest, memoryview(self.whole)
        own = b"".join(digest(whole[a:b]) for a, b in zip(self.first.tolist(), self.last.tolist()))
        low, high = np.frombuffer(own, "<u8").reshape(-1, 2).T
        at = np.flatnonzero(self.doc[WINDOW - 1:] == self.doc[:len(self.doc) - WINDOW + 1]) if len(self.doc) >= WINDOW else (
            np.zeros(0, np.int64))
        odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
        h, g = (sum((x[at + i] * np.uint64(odd[i]) for i in range(WINDOW)), np.zeros(len(at), np.uint64)) for x in (low, high))
        start = np.cumsum(self.counts) - self.counts
        return h.view(np.int64), (g >> np.uint64(32)).astype(np.uint32).view(np.int32), self.doc[at], at - start[self.doc[at]]

    def without(self, doc: int, covered: np.ndarray) -> tuple[bytes, int]:
        """The text without the pieces of the windows that begin at ``covered``, and their number."""
        start = int(self.counts[:doc].sum())
        gone = np.unique((covered[:, None] + np.arange(WINDOW)).ravel())
        runs = np.split(gone, np.flatnonzero(np.diff(gone) != 1) + 1)
        out, at = [], int(self.begin[doc])
        for run in runs:
            a, b = self._raw(start + int(run[0]), doc)[0], self._raw(start + int(run[-1]), doc)[1]
            out.append(self.whole[at:a])
            at = b
        out.append(self.whole[at:int(self.end[doc])])
        return b"".join(out), len(gone)

    def _raw(self, i: int, doc: int) -> tuple[int, int]:
        """Where piece ``i`` begins and ends with the blanks that belong to it."""
        line = self.line[i]
        if i and self.line[i - 1] == line:
            a = self.last[i - 1]
        else:
            a = max(self.begin[doc], self.breaks[line - 1] + 1 if line else 0)
        if i + 1 < len(self.line) and self.line[i + 1] == line:
            b = self.last[i]
        else:
            b = min(self.end[doc], self.breaks[line] + 1)
        return int(a), int(b)


def _blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with about ``limit`` bytes each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = int(np.searchsorted(size, (size[a - 1] if a else 0) + limit)) + 1
        yield a, min(b, len(texts))
        a = b


def _encoded(texts: pa.Array) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in texts.to_pylist()]


def later_windows(df: DataFrame, id_col: str, text: str, near: int = NEAR, block: int = BLOCK) -> DataFrame:
    """``(_id, _th, _covered)``: per document, the windows to cut, by first piece."""
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:2], *T._parse_datatype_string("h long, g int, o int, later boolean").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _blocks(batch.column(2), block):
                part = batch.slice(a, b - a)
                h, g, doc, o = Pieces(_encoded(part.column(2)), near).windows()
                if not len(h):
                    continue
                rank = pc.rank(part.column(0), sort_keys="ascending", null_placement="at_end", tiebreaker="dense")
                rank = rank.to_numpy().astype(np.int64)[doc]
                order = np.lexsort((o, doc, rank, g, h))
                h, g, doc, o, rank = h[order], g[order], doc[order], o[order], rank[order]
                same = np.concatenate([[False], (h[1:] == h[:-1]) & (g[1:] == g[:-1])])
                heads = np.flatnonzero(~same)
                least = np.repeat(rank[heads], np.diff(np.append(heads, len(h))))
                later = (rank > least) | (same & (doc == np.concatenate([[-1], doc[:-1]])))
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(h), pa.array(g),
                     pa.array(o.astype(np.int32)), pa.array(later)], schema.names)

    # what is later within its block has found its earlier one: its rows are only kept
    key = [F.when(F.col("later"), F.xxhash64("_th", "o")).otherwise(F.col("h")), "g", "later"]
    ranked = rows.mapInArrow(cut, schema).withColumn(
        "r", F.rank().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last("_id"))))
    return (ranked.filter(F.col("later") | (F.col("r") > 1)).groupBy("_id", "_th")
            .agg(F.sort_array(F.collect_set("o")).alias("_covered")))


def _cut(near: int, block: int):
    @F.arrow_udf("struct<text: string, lines: long, removed: long>")
    def cut(texts: pa.Array, covered: pa.Array) -> pa.Array:
        out, lines, removed = [], [], []
        for a, b in _blocks(texts, block):
            pieces = Pieces(_encoded(texts.slice(a, b - a)), near)
            lines += pieces.counts.tolist()
            for i, own in enumerate(covered.slice(a, b - a)):
                rest, n = pieces.without(i, own.values.to_numpy()) if own.is_valid else (None, 0)
                out.append(None if rest is None else rest.decode("utf-8", "surrogatepass"))
                removed.append(n)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(lines, pa.int64()),
                                           pa.array(removed, pa.int64())], ["text", "lines", "removed"])

    return cut


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", near: int = NEAR,
                lines: str = "_n_lines", removed: str = "_n_removed", block: int = BLOCK) -> DataFrame:
    """``df`` with ``text`` cut, and the columns ``lines`` (non-blank pieces) and
    ``removed`` (those that were cut)."""
    th, i, t, p, cut = free_names(df, "_text_hash", "_cover_id", "_cover_hash", "_cover", "_cut")
    cover = later_windows(df, id_col, text, near, block).toDF(i, t, p)
    marked = df.withColumn(th, F.xxhash64(text))
    joined = marked.join(cover, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(th) == F.col(t)), "left")
    out = joined.withColumn(cut, _cut(near, block)(F.col(text), F.col(p)))
    kept = [F.coalesce(F.col(cut)["text"], F.col(text)).alias(text) if c == text else F.col(c) for c in df.columns]
    return out.select(*kept, F.col(cut)["lines"].alias(lines), F.col(cut)["removed"].alias(removed))


_MARK = "chr(57344)"  # marks the line ends in the SQL twin
_KEYS = "min(key) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN {})"
_SOLID = r"[^ \t\r\n\x0b\x0c]"
SQL = f"""
WITH lines AS (
  SELECT doc_id, i, line, regexp_extract_all(line, '[ \\t\\r\\n\\x0b\\x0c]*{_SOLID}+') AS words FROM (
    SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
      SELECT doc_id, string_split(replace(coalesce(text, ''), chr(10), chr(10) || {_MARK}), {_MARK}) AS ls FROM documents))),
words AS (SELECT doc_id, i, j, word, j = m AS ends, left(md5(regexp_extract(word, '{_SOLID}+')), 16) AS key,
                 CASE WHEN j = m THEN line[sum(length(word)) OVER (PARTITION BY doc_id, i)::BIGINT + 1:] ELSE '' END AS blanks
          FROM (SELECT doc_id, i, line, unnest(words) AS word, generate_subscripts(words, 1) AS j, len(words) AS m FROM lines)),
cuts AS (SELECT *, ends OR (key < coalesce({_KEYS.format(f"{NEAR} PRECEDING AND 1 PRECEDING")}, 'x')
                            AND key <= coalesce({_KEYS.format(f"1 FOLLOWING AND {NEAR} FOLLOWING")}, 'x')) AS cut FROM words),
units AS (SELECT doc_id, u, row_number() OVER (PARTITION BY doc_id ORDER BY i, b) AS n, u <> '' AND regexp_matches(u, '{_SOLID}') AS solid
          FROM (SELECT doc_id, i, b, string_agg(word || blanks, '' ORDER BY j) AS u FROM (
                  SELECT *, sum(cut::INT) OVER (PARTITION BY doc_id, i ORDER BY j) - cut::INT AS b FROM cuts) GROUP BY doc_id, i, b
                UNION ALL SELECT doc_id, i, 0, line FROM lines WHERE len(words) = 0 AND line <> '')),
solid AS (SELECT doc_id, n, trim(u, chr(32) || chr(9) || chr(13) || chr(10) || chr(11) || chr(12)) AS s,
                 row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS o FROM units WHERE solid),
three AS (SELECT doc_id, o, [s, lead(s) OVER w, lead(s, 2) OVER w] AS k, lead(o, 2) OVER w AS last FROM solid
          WINDOW w AS (PARTITION BY doc_id ORDER BY o)),
ranked AS (SELECT doc_id, o, row_number() OVER (PARTITION BY k ORDER BY doc_id, o) AS r FROM three WHERE last IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, o + d AS o FROM ranked, (SELECT unnest([0, 1, 2]) AS d) WHERE r > 1),
runs AS (SELECT doc_id, min(n) AS a, max(n) AS b, count(*) AS lines FROM (
           SELECT doc_id, n, o - row_number() OVER (PARTITION BY doc_id ORDER BY o) AS g FROM gone JOIN solid USING (doc_id, o))
         GROUP BY doc_id, g),
cut AS (SELECT doc_id, u, n FROM units ANTI JOIN runs ON units.doc_id = runs.doc_id AND n BETWEEN a AND b),
joined AS (SELECT doc_id, string_agg(u, '' ORDER BY n) AS text FROM cut GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN r.lines IS NULL THEN d.text ELSE coalesce(j.text, '') END AS text,
       coalesce(s.n, 0)::BIGINT AS n_lines, coalesce(r.lines, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN joined j USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM solid GROUP BY doc_id) s
USING (doc_id) LEFT JOIN (SELECT doc_id, sum(lines) AS lines FROM runs GROUP BY doc_id) r USING (doc_id)
"""
