"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Texts are cut by the pattern; each block of documents keeps its words'
   positions as an index sequence and lists its distinct words by bucket.
2. The distinct words are shuffled by bucket; every distinct word of the whole
   corpus is encoded once, in the one group it belongs to.
3. The ids go back to the blocks that asked for them and each document is put
   together by position.

Decoding looks every id up in the token-byte table (a fixed vocabulary of
some 50,000 rows, broadcast) and joins the bytes.

Null and empty texts have no ids and the digest of the empty string; very long ones are
encoded whole. Repeated rows and null ids stay row by row; an empty table gives an empty one.
Columns other than ``keep`` are left out; ``keep`` may hold any name but the result's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import blocks
from tessera.llm.bytebpe import Vocabulary
from tessera.llm.token_counts import _chunks

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_bytes(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


def encode_words(vocabulary: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """Ids of each word: itself if it is a token, else what merging leaves."""
    out: list = [None] * len(words)
    rest = []
    for i, w in enumerate(words):
        own = vocabulary.id_of.get(w)
        if own is None:
            rest.append(i)
        else:
            out[i] = np.array([own], "<u4")
    for part in _chunks([words[i] for i in rest]):
        symbols, left = vocabulary.merge([b for _, b in part])
        ends = np.cumsum(left)
        for (k, _), ids in zip(part, np.split(symbols.astype("<u4"), ends[:-1])):
            out[rest[k]] = ids
    return out


def _per_document(df: DataFrame, text: str, keep: tuple[str, ...], path: str | None, pattern: str,
                  columns: list[tuple[str, T.DataType]], make, slots: int | None = None,
                  block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """``make(words' ids, sequence of a document)`` for every document."""
    spark = df.sparkSession
    data = spark.sparkContext.broadcast(vocabulary_bytes(path))

    def split(t: str, _compiled=[]) -> list[str]:
        if not _compiled:
            _compiled.append(regex.compile(pattern).findall)
        return _compiled[0](t)

    slots = slots or max(16, 2 * blocks.common.shuffle_partitions(spark))
    table = blocks.pack(df, text, list(keep), split, slots, block_bytes=block_bytes)

    def reply(words: list[bytes], _counts) -> list[bytes]:
        return [x.tobytes() for x in encode_words(_vocabulary(data), words)]

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in columns])

    def finish(block: blocks.Block, replies: dict) -> pa.Table:
        ids = block.spread(replies)
        prepared = make.prepare(ids, data)
        starts, seq = block.starts().tolist(), block.sequence.tolist()
        rows = [make.document(prepared, seq[a:b]) for a, b in zip(starts, starts[1:])]
        values = list(zip(*rows)) if rows else [[] for _ in columns]
        out = block.docs
        for (name, _), v, kind in zip(columns, values, make.arrow):
            out = out.append_column(name, pa.array(v, kind))
        return out

    return blocks.reunite(table, blocks.answer(table, reply), finish, schema)


_CACHE: dict = {}


def _vocabulary(data) -> Vocabulary:
    """The worker's vocabulary (parsed once per Python worker)."""
    key = hashlib.sha1(data.value).digest()
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Vocabulary.from_ranks(data.value)
    return _CACHE[key]


class _Ids:
    arrow = [pa.list_(pa.int32())]

    @staticmethod
    def prepare(ids, data):
        return [np.frombuffer(x, "<u4") for x in ids]

    @staticmethod
    def document(ids, seq):
        return (np.concatenate([ids[i] for i in seq]).astype(np.int32) if seq else np.zeros(0, np.int32),)


class _Digests:
    """Per word: its ids in decimal and its decoded bytes; a document joins them."""

    arrow = [pa.int64(), pa.string(), pa.string()]

    @staticmethod
    def prepare(ids, data):
        token = _vocabulary(data).token_bytes
        lists = [np.frombuffer(x, "<u4").tolist() for x in ids]
        return ([len(x) for x in lists], [b",".join(b"%d" % i for i in x) for x in lists],
                [b"".join(map(token.__getitem__, x)) for x in lists])

    @staticmethod
    def document(prepared, seq):
        sizes, decimal, decoded = (p.__getitem__ for p in prepared)
        return (sum(map(sizes, seq)), hashlib.sha256(b",".join(map(decimal, seq))).hexdigest(),
                hashlib.sha256(b"".join(map(decoded, seq))).hexdigest())


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None,
           pattern: str = public_tokenizers.PATTERN, out: str = "ids", **sizes) -> DataFrame:
    """``keep`` columns and the text's token ids (array<int>)."""
    return _per_document(df, text, keep, path, pattern, [(out, T.ArrayType(T.IntegerType()))], _Ids, **sizes)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """All columns but ``ids``, and the joined bytes of its tokens (null ids: null).

    The token-byte table is as large as the vocabulary, so each task joins it
    in memory; an id outside the vocabulary is an error."""
    data = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))
    rest = [c for c in df.columns if c not in (ids, out)]
    picked = df.select(*rest, F.col(ids).alias("_ids"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField(out, T.BinaryType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _vocabulary(data).token_bytes
        for batch in batches:
            decoded = [None if x is None else b"".join(map(token.__getitem__, x))
                       for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(decoded, pa.binary())],
                                             [*batch.schema.names[:-1], out])

    return picked.mapInArrow(join, schema)


def round_trip(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None,
               pattern: str = public_tokenizers.PATTERN, **sizes) -> DataFrame:
    """``keep`` columns, n_tokens, and SHA-256 of the ids and of the bytes decoded from them."""
    return _per_document(df, text, keep, path, pattern,
                         [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()),
                          ("decoded_sha256", T.StringType())], _Digests, **sizes)
