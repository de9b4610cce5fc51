"""Language identification with averaged hashed subword embeddings.

A text's letters (lower case, other characters one blank) give byte n-grams of
two to four, none across a word border; each is hashed to one of ``BUCKETS``
embeddings. The mean embedding goes through a linear softmax. Embeddings and
softmax are trained together by mini-batch gradient descent in numpy on a
bounded sample: of every language about ``PER_LANGUAGE`` training rows, picked by
a hash, whole texts, about ``SAMPLE`` rows in all, and with many languages still
``FEW`` of each that has them, so the sample then grows with the languages (8 KB
a row on the driver). Rows of one id and text count once. A fifth of it, but no
language's last row, calibrates: the temperature of the softmax, and the lowest score at which
``PRECISION`` of the predictions hold; below that ``accepted`` is false.

Prediction reads whole texts in place, with the model (a few hundred KB)
broadcast. Text that is null or has no letter, or any text if nothing could be
learned, gives ``und`` with score 0. Labels, source and id are not features. Equal scores
go to the first label in order. Repeated rows and null ids stay row by row, an empty table
gives an empty one. ``keep`` may hold any name but the result's; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import boundary

BUCKETS = 2048
WIDTH = 16
PER_LANGUAGE = 600
FEW = 2  # training rows that a language keeps in any case, if it has them
BROADCAST_LANGUAGES = 100_000  # 60 bytes each
SAMPLE = 12_000  # training rows in all: with many languages, fewer of each
EPOCHS, RATE, BATCH = 60, 8.0, 32
PRECISION = 0.99
UNKNOWN = "und"

# letters keep their byte, bytes of non-ASCII characters too, all else is a blank
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Share of each bucket among the text's subwords (all zero without any)."""
    raw = _LETTER[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])]
    blank = raw == 32
    total = np.zeros(BUCKETS, np.int64)
    code = raw.astype(np.uint32)
    gram, inside = code[:-1] * np.uint32(257) + code[1:], np.ones(max(0, len(raw) - 1), bool)
    for n in (2, 3, 4):
        if n > 2:
            gram = gram[:-1] * np.uint32(257) + code[n - 1:]
            inside = inside[:-1] & ~blank[n - 2:-1]
        if not len(gram):
            break
        bucket = ((gram ^ np.uint32(n * 0x1F123BB5)) * np.uint32(2654435761)) >> np.uint32(33 - BUCKETS.bit_length())
        total += np.bincount(bucket[inside], minlength=BUCKETS)
    return (total / max(1, total.sum())).astype(np.float32)


class Model:
    def __init__(self, labels: list[str], embedding, weights, bias, temperature: float, accept: float):
        self.labels, self.embedding, self.weights, self.bias = labels, embedding, weights, bias
        self.temperature, self.accept = temperature, accept

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.embedding) @ self.weights + self.bias

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = _softmax(self.logits(x) / self.temperature)
        return p.argmax(axis=1), p.max(axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, labels: list[str], seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        cut = len(y) // 5
        calibrate, train = order[:cut], order[cut:]
        if not cut:
            calibrate = train
        else:  # every language is learned
            _, first = np.unique(y[order], return_index=True)
            lacking = order[first][~np.isin(y[order][first], y[train])]
            train, calibrate = np.concatenate([train, lacking]), calibrate[~np.isin(calibrate, lacking)]
            calibrate = calibrate if len(calibrate) else train
        model = cls(labels, (rng.standard_normal((BUCKETS, WIDTH)) * 0.5).astype(np.float32),
                    np.zeros((WIDTH, len(labels)), np.float32), np.zeros(len(labels), np.float32), 1.0, 0.0)
        share = np.bincount(y[train], minlength=len(labels)) / max(1, len(train))
        weight = 1 / np.maximum(share * len(labels), 1e-6)  # every language counts alike
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for part in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
                mean = x[part] @ model.embedding
                gap = _softmax(mean @ model.weights + model.bias)
                gap[np.arange(len(part)), y[part]] -= 1
                gap *= (weight[y[part]] / len(part))[:, None].astype(np.float32)
                back = gap @ model.weights.T
                model.weights -= 0.25 * rate * (mean.T @ gap)
                model.bias -= 0.25 * rate * gap.sum(axis=0)
                model.embedding -= 50 * rate * (x[part].T @ back)
        model._calibrate(x[calibrate], y[calibrate])
        return model

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        logits = self.logits(x)

        def loss(t: float) -> float:
            p = _softmax(logits / t)[np.arange(len(y)), y]
            return float(-np.log(np.maximum(p, 1e-12)).mean())

        self.temperature = min((float(t) for t in np.geomspace(0.2, 5, 41)), key=loss)
        best, score = self.predict(x)
        order = np.argsort(-score, kind="stable")
        right = np.cumsum((best == y)[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= PRECISION)
        self.accept = float(score[order][good[-1]]) if len(good) else 1.0


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_sample(df: DataFrame, id_col: str, text: str, lang: str, train: str, per_language: int) -> DataFrame:
    """``(lang, text, h)`` of the bounded sample: of each language the rows whose hash
    ``h`` lies in the share that leaves about ``per_language`` of them, and the rows of
    the least hash in each of ``FEW`` parts. Nothing is ranked or gathered by language,
    so a hot one is no task of its own."""
    usable = df.filter(F.col(train) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(id_col, text).alias("h"))
    least = F.array(*[F.min(F.when(F.pmod("h", F.lit(FEW)) == i, F.col("h"))) for i in range(FEW)])
    sizes = boundary(rows.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("n"), least.alias("least")))
    n = sizes.count()
    wanted = max(1, min(per_language, SAMPLE // max(1, n)))
    cuts = sizes.select("of", "least", (F.lit(2.0**64) * wanted / F.col("n") - 2.0**63).alias("last"))
    return (rows.join(F.broadcast(cuts) if n <= BROADCAST_LANGUAGES else cuts, F.col("lang") == F.col("of"))
            .filter((F.col("h") <= F.col("last")) | F.coalesce(F.array_contains("least", F.col("h")), F.lit(False)))
            .select("lang", "text", "h"))


def learn(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", train: str = "train",
          per_language: int = PER_LANGUAGE) -> Model | None:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                own = batch.slice(a, 256)
                x = [features(t) for t in own.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [own.column("lang"), own.column("h"), pa.array([v.tobytes() for v in x])], ["lang", "h", "x"])

    rows = (training_sample(df, id_col, text, lang, train, per_language)
            # equal rows hash alike and become one, so very many of them keep the bound
            .mapInArrow(extract, "lang string, h long, x binary").groupBy("lang", "h").agg(F.first("x").alias("x"))
            .select("lang", "x").toArrow().sort_by([("lang", "ascending"), ("x", "ascending")]))
    if not rows.num_rows:
        return None
    labels = sorted(set(rows.column("lang").to_pylist()))
    place = {v: i for i, v in enumerate(labels)}
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, BUCKETS)
    return Model.fit(x, np.array([place[v] for v in rows.column("lang").to_pylist()]), labels)


def identify(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score and accepted of every row."""
    held = df.sparkSession.sparkContext.broadcast(model)
    picked = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                own = batch.slice(a, 512)
                texts = own.column("__text").to_pylist()
                known = np.array([m is not None and has_letter(t) for t in texts], bool)
                label = np.full(len(texts), UNKNOWN, object)
                score = np.zeros(len(texts))
                if known.any():
                    x = np.stack([features(t) for t, k in zip(texts, known) if k])
                    best, p = m.predict(x)
                    label[known] = [m.labels[i] for i in best]
                    score[known] = np.clip(p, 0.0, 1.0)
                accepted = known & (score >= (m.accept if m else 1.0))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:-1], pa.array(label.tolist(), pa.string()), pa.array(score), pa.array(accepted)],
                    [*own.schema.names[:-1], "lang_pred", "score", "accepted"])

    return picked.mapInArrow(run, schema)
