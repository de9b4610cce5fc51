"""Labelled-corpus preparation: splits, balancing, context, consensus,
multi-task assembly, padded batches.

Operators: P1 canonical (text, score), P5 class filter, P9 mismatch filter,
P10 token-length cap, U1 union, U2 distinct, U3 difference, U4 split
integrity, M1 stratified split, M2 ordered split, M3 majority downsample,
W5 neighbour concatenation, A19 consensus label, M8 multi-task corpus,
M10 padded batches, M11 error extraction, J9 prediction alignment, O3
first n per class, A1 group counts, A6 null profile, P8 literal membership.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.plans import prefix
from tessera.plans.joins import join_checked

# Reference split ratios and batch/padding parameters.
TEST_SIZE = 0.2
VAL_SIZE = 0.1
BATCH_SIZE = 32
PAD_ID, BOS_ID, EOS_ID, UNK_ID = 0, 2, 3, 1


def canonical(df: DataFrame, text: Column | str, score: Column | str) -> DataFrame:
    """Project to the common ``(text string, score double)`` schema."""
    t = F.col(text) if isinstance(text, str) else text
    s = F.col(score) if isinstance(score, str) else score
    return df.select(t.cast("string").alias("text"), s.cast("double").alias("score"))


def drop_class(df: DataFrame, label, score: str = "score") -> DataFrame:
    """P5."""
    return df.filter(F.col(score) != label)


def stratified_split(df: DataFrame, id_col: str, score: str = "score", seed: int = 42,
                     test_size: float = TEST_SIZE, val_size: float = VAL_SIZE) -> DataFrame:
    """M1: per class, rows ordered by ``md5(seed-id)``; the first
    ``round(n*test_size)`` go to test, the next ``round(m*val_size)`` of the
    remaining ``m`` to val, the rest to train. Deterministic for a seed.

    Ranks come from the range-partitioned prefix, so a class holding most of
    the rows is still spread over all tasks."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string")))
    ranked = prefix.number_by_key(df.withColumn("_h", h), id_col, [score, "_h"], ["_h", id_col], "_r",
                                  group=[score])
    sizes = df.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    n_test = F.round(F.col("_n") * test_size)
    n_val = F.round((F.col("_n") - n_test) * val_size)
    return (join_checked(ranked, sizes, [score])
            .withColumn("split", F.when(F.col("_r") < n_test, "test")
                        .when(F.col("_r") < n_test + n_val, "val").otherwise("train"))
            .drop("_h", "_r", "_n"))


def ordered_split(df: DataFrame, order: Sequence[Column | str],
                  test_size: float = TEST_SIZE, val_size: float = VAL_SIZE,
                  key: str | None = None, needed: Sequence[str] = ()) -> DataFrame:
    """M2: no shuffle: the last ``ceil(n*test_size)`` rows in ``order`` are
    test, the last ``ceil(m*val_size)`` of the remaining ``m`` are val.
    With a unique ``key`` the ranks are computed on ``key + needed`` only."""
    ranked = (prefix.number_by_key(df, key, needed, order, "_r") if key
              else prefix.row_number(df, order, "_r"))
    n = F.col("_n")
    m = n - F.ceil(n * F.lit(test_size))
    train_end = m - F.ceil(m * F.lit(val_size))
    return (ranked.withColumn("_n", df.select(F.count(F.lit(1))).scalar())
            .withColumn("split", F.when(F.col("_r") >= m, "test")
                        .when(F.col("_r") >= train_end, "val").otherwise("train"))
            .drop("_r", "_n"))


def downsample_majority(df: DataFrame, order: Sequence[Column | str], majority=1, target=3,
                        score: str = "score") -> DataFrame:
    """M3: keep the first ``count(score = target)`` rows of the majority class
    in ``order`` (id order as in the code, or a hash order for a random cut);
    all other classes are kept whole."""
    n_keep = df.filter(F.col(score) == target).select(F.count(F.lit(1))).scalar()
    major = prefix.row_number(df.filter(F.col(score) == majority), order, "_r")
    kept = major.filter(F.col("_r") < n_keep).drop("_r")
    return df.filter(F.col(score) != majority).unionByName(kept)


def neighbour_text(df: DataFrame, id_col: str = "task", group: Sequence[str] = ("split", "paper_id"),
                   text: str = "text") -> DataFrame:
    """Prepend the previous and append the next row's text when its id is
    exactly one less / more inside the same group.

    With unique ids the neighbour is found by an equi-join on ``id +- 1``, so
    no window has to hold a whole group."""
    keys = list(group)
    prev = df.select(*keys, (F.col(id_col) + 1).alias(id_col), F.col(text).alias("_prev"))
    nxt = df.select(*keys, (F.col(id_col) - 1).alias(id_col), F.col(text).alias("_next"))
    return (df.join(prev, keys + [id_col], "left").join(nxt, keys + [id_col], "left")
            .withColumn(text, F.concat_ws(" ", "_prev", text, "_next"))
            .drop("_prev", "_next"))


def consensus(pairs: DataFrame, id_col: str = "pair_id", gold: str = "gold_label",
              labels: str = "annotator_labels") -> DataFrame:
    """The gold label, or when gold is '-', the median of the most
    frequent annotator labels (may be fractional). Per pair only the distinct
    labels (at most three) are collected."""
    m = F.create_map(*[x for k, v in tx.PAIR_LABELS.items() for x in (F.lit(k), F.lit(v))])
    counts = (pairs.select(id_col, F.explode(labels).alias("_l"))
              .groupBy(id_col, "_l").agg(F.count(F.lit(1)).alias("_n")))
    per = counts.groupBy(id_col).agg(F.collect_list(F.struct("_n", m[F.col("_l")].alias("_v"))).alias("_c"))
    top = F.array_max(F.transform("_c", lambda c: c["_n"]))
    vals = F.array_sort(F.transform(F.filter("_c", lambda c: c["_n"] == top), lambda c: c["_v"].cast("double")))
    k = F.size(vals)
    med = (F.element_at(vals, F.floor((k - 1) / 2).cast("int") + 1)
           + F.element_at(vals, F.ceil((k - 1) / 2).cast("int") + 1)) / 2
    tied = per.select(id_col, med.alias("_median"))
    return (pairs.join(tied, id_col, "left")
            .withColumn("score", F.when(F.col(gold) == "-", F.col("_median"))
                        .otherwise(m[F.col(gold)].cast("double")))
            .drop("_median"))


def split_violations(df: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """U4: texts that occur in more than one split (should be empty)."""
    return (df.groupBy(text).agg(F.countDistinct(split).alias("n_splits"), F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_splits") > 1))


def difference(df: DataFrame, subset: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``subset``."""
    return df.join(subset.select(key), key, "left_anti")


def multitask_corpus(parts: Sequence[tuple[dict, DataFrame]]) -> DataFrame:
    """M8: union of task datasets tagged with the registry entry; ``valid``
    checks the score against the declared label count (gaps allowed)."""
    out = None
    for entry, df in parts:
        tagged = df.select(
            F.lit(entry["name"]).alias("task_name"), F.lit(entry["type"]).alias("type"),
            F.lit(int(entry["num_labels"])).alias("num_labels"), "split", "text",
            F.col("score").cast("double").alias("score"))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    rng = (F.col("type") != "classification") | (
        (F.col("score") >= 0) & (F.col("score") < F.col("num_labels")))
    return out.withColumn("valid", rng & F.col("score").isNotNull())


def token_length_cap(df: DataFrame, ids: str, max_len: int) -> DataFrame:
    """P10: keep rows whose ids plus the two markers fit ``max_len``."""
    return df.filter(F.size(ids) + 2 <= max_len)


def padded_batches(df: DataFrame, ids: str, order: Sequence[Column | str],
                   batch_size: int = BATCH_SIZE, pad: int = PAD_ID,
                   bos: int = BOS_ID, eos: int = EOS_ID) -> DataFrame:
    """Markers once (F12), batch = rank div batch_size, ids padded to
    the longest sequence of the batch. A batch has at most ``batch_size``
    rows, so the per-batch max is a bounded aggregate."""
    key = order[0] if len(order) == 1 and isinstance(order[0], str) else None
    if key is None:
        numbered = prefix.row_number(df, order, "_r")
    else:  # ranks and widths from ids and lengths alone; the sequences join once, at the end
        numbered = prefix.row_number(df.select(key, F.size(ids).alias("_len")), [key], "_r")
    size = F.col("_len") if key else F.size(ids)
    batched = numbered.withColumn("batch_id", F.floor(F.col("_r") / batch_size).cast("long"))
    width = batched.groupBy("batch_id").agg((F.max(size) + 2).alias("width"))
    placed = batched.join(width, "batch_id")
    if key:
        placed = df.join(placed.select(key, "batch_id", "width"), key)
    wrapped = tx.wrap_markers(ids, bos, eos)
    return (placed.withColumn("padded", F.concat(wrapped, F.array_repeat(F.lit(pad), F.col("width") - F.size(ids) - 2)))
            .drop("_r"))


def align_predictions(examples: DataFrame, preds: DataFrame, key: str) -> DataFrame:
    """Predictions joined by explicit example id (never by position)."""
    return examples.join(preds, key, "left")


def mismatches(df: DataFrame, order: Sequence[Column | str], limit: int = 100,
               score: str = "score", pred: str = "pred") -> DataFrame:
    """P9 + O3 + M11: rows with a prediction that differs from the score,
    first ``limit`` in ``order`` (a top-k report; the limit is the feature)."""
    return (df.filter(F.col(pred).isNotNull() & (F.col(score) != F.col(pred).cast("int")))
            .orderBy(*order).limit(limit))


def first_per_class(df: DataFrame, n: int, order: Sequence[Column | str], score: str = "score") -> DataFrame:
    """O3: the first ``n`` rows of every class in ``order``. A bounded top-n
    (Spark plans it as a partial + final ``WindowGroupLimit``, so each map
    task keeps at most ``n`` rows per class before the shuffle)."""
    from pyspark.sql import Window

    w = Window.partitionBy(score).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count of rows per null pattern of ``cols``."""
    return df.groupBy(*[F.col(c).isNull().alias(f"{c}_is_null") for c in cols]).agg(
        F.count(F.lit(1)).alias("n"))


def group_counts(df: DataFrame, key: str) -> DataFrame:
    """A1: rows per key, most frequent first."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(key))


def keep_ids(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """P8 for a literal id list (an ``In`` predicate Catalyst can push into
    the scan); for id tables use the semi/anti joins."""
    return df.filter(F.col(key).isin(list(ids)))


def write_splits(df: DataFrame, path: str, cols: Sequence[str] = ("text", "score"),
                 split: str = "split", mode: str = "overwrite") -> None:
    """S9 for split corpora: one headed CSV folder per split
    (``split=train|val|test``) written in one pass; M8 reads them back by
    partition (``split`` is a partition column, so a per-split read prunes)."""
    (df.select(*cols, split).write.mode(mode).partitionBy(split)
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def collect_chunks(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], value: Column | str,
                   size: int = 1024) -> DataFrame:
    """A3: the values of every key in ``order``, as lists of at most ``size``: ``(key, chunk,
    values)`` with chunks from 0. The chunks of a key, one after the other, are its whole
    list; a key with a third of all rows is as many rows as others have between them. ``order``
    must be total within a key (end with a unique column)."""
    val = F.col(value) if isinstance(value, str) else value
    ranked = prefix.rank_within(df.withColumn("_v", val), list(key), list(order), "_r")
    chunk = F.floor(F.col("_r") / size).cast("long")
    return (ranked.groupBy(*key, chunk.alias("chunk"))
            .agg(F.sort_array(F.collect_list(F.struct("_r", "_v"))).alias("_s"))
            .select(*key, "chunk", F.transform("_s", lambda x: x["_v"]).alias("values")))
