"""Token counts by rank-synchronous array merging.

Each Arrow batch is cut into pre-tokens; its distinct pre-tokens that the
worker has not met yet are merged together as ragged numpy arrays, every
sequence's lowest-ranked pair in each round, and the surviving symbols are
counted. A document's count is the sum over its pre-tokens. Scan, count and
write happen in one task: nothing is shuffled, so no key can be hot.

Null text counts as empty (0 bytes, 0 tokens); very long texts are counted whole;
repeated rows and null ids are kept row by row; an empty table gives an empty one. Other
columns are left out unless asked for with ``keep``, which may hold any name but the
result's (``n_bytes``, ``n_tokens``, ``over_limit``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytebpe import Vocabulary

VOCABULARY = "byte_bpe_50k.json"
CACHE = 400_000  # pre-tokens a worker remembers; beyond it starts anew
CHUNK = 1 << 20  # bytes of pre-tokens merged at once


class Counter:
    def __init__(self, vocabulary: Vocabulary, pattern: str, special: Sequence[str], cache: int = CACHE):
        """``special``: strings that are one token wherever they stand, the longest first."""
        self.vocabulary, self.special, self.cache = vocabulary, [x for x in special if x], cache
        self.parts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split
        self.find, self.seen = regex.compile(pattern).findall, {}

    def learn(self, items: list[str]) -> None:
        for part in _chunks([x.encode("utf-8", "surrogatepass") for x in items]):
            at = [i for i, _ in part]
            _, left = self.vocabulary.merge([b for _, b in part])
            self.seen.update(zip([items[i] for i in at], left.tolist()))

    def counts(self, texts: list[str]) -> list[int]:
        extra, cut = [0] * len(texts), []
        for i, t in enumerate(texts):
            if any(x in t for x in self.special):
                parts = self.parts(t)
                extra[i] = len(parts) - 1
                cut.append([w for p in parts for w in self.find(p)])
            else:
                cut.append(self.find(t))
        if len(self.seen) > self.cache:
            self.seen = {}
        fresh = set().union(*cut) - self.seen.keys()
        if fresh:
            self.learn(list(fresh))
        get = self.seen.__getitem__
        return [sum(map(get, ws)) + e for ws, e in zip(cut, extra)]


def _chunks(items: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Items of like length together, about ``CHUNK`` bytes each."""
    part, size = [], 0
    for i in sorted(range(len(items)), key=lambda i: len(items[i])):
        if part and size + len(items[i]) > CHUNK:
            yield part
            part, size = [], 0
        part.append((i, items[i]))
        size += len(items[i])
    if part:
        yield part


def _groups(texts: list[str], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with about ``limit`` characters each."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def token_counts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512,
                 vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN,
                 special: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit of every row. ``special``
    strings are the file's added tokens, unless others are given."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
        content = f.read()
    if special is None:
        special = [t["content"] for t in json.loads(content).get("added_tokens", [])]
    data = df.sparkSession.sparkContext.broadcast(content)  # one vocabulary file
    picked = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Vocabulary.from_json(data.value), pattern, special)
        for batch in batches:
            whole = [x or "" for x in batch.column("__text").to_pylist()]
            for a, b in _groups(whole):
                texts = whole[a:b]
                n = np.array(counter.counts(texts), np.int64)
                size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:-1], pa.array(size), pa.array(n), pa.array(n > limit)],
                    [*own.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"])

    return picked.mapInArrow(count, schema)
