"""Annotation pools: sentence context, honeypots, pilot pool, gold lookup,
incremental queue.

Operators: W3 annotator context, W4 pool context, O2 first-k papers,
J5/J6 keep/remove papers, J7 gold lookup with cardinality check,
A5/T1 incremental queue, M13 pool partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.plans.neighbors import with_context

# Context sizes (annotator view 2 before / 3 after, pool view
# 2 before / 4 after) and the marker around the target sentence.
ANNOTATOR_BEFORE, ANNOTATOR_AFTER = 2, 3
POOL_BEFORE, POOL_AFTER = 2, 4
TARGET_MARK = "**"


def annotator_context(sent: DataFrame, before: int = ANNOTATOR_BEFORE,
                      after: int = ANNOTATOR_AFTER) -> DataFrame:
    """previous/next sentences of the same article, space-joined."""
    return with_context(sent, "sentence_id", "paper_id", "text", before, after)


def pool_text(sent: DataFrame, before: int = POOL_BEFORE, after: int = POOL_AFTER,
              out: str = "pool_text") -> DataFrame:
    """``prev **target** next`` with spaces only where context exists."""
    ctx = with_context(sent, "sentence_id", "paper_id", "text", before, after)
    return (ctx.withColumn(out, tx.join_context("prev_context", "text", "next_context", TARGET_MARK))
            .drop("prev_context", "next_context"))


def article_pools(sents: str, form: Callable[[Column], Column] = lambda text: text,
                  before: int = POOL_BEFORE, after: int = POOL_AFTER) -> Column:
    """W4 within a row that holds a whole article as an array: ``form`` of every sentence's pool text."""
    return F.transform(F.transform(sents, lambda sentence, i: pool_at(sents, i, before, after)), form)


def pool_at(sents: str, i: Column, before: int = POOL_BEFORE, after: int = POOL_AFTER) -> Column:
    """The pool text of sentence ``i`` of an article's array."""
    prev = F.array_join(F.slice(sents, F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before))), " ")
    return tx.join_context(prev, F.get(sents, i), F.array_join(F.slice(sents, i + 2, F.lit(after)), " "), TARGET_MARK)


def near_sentences(sent: DataFrame, tasks: DataFrame, before: int = POOL_BEFORE, after: int = POOL_AFTER) -> DataFrame:
    """The sentences whose number is a ``task``, and all that their pool texts may show."""
    ids = tasks.select(F.explode(F.sequence(F.col("task") - before, F.col("task") + after)).alias("sentence_id")).distinct()
    return sent.join(ids, "sentence_id", "left_semi")


def first_papers(sent: DataFrame, k: int, order_col: str = "sentence_id") -> DataFrame:
    """O2: the first ``k`` distinct papers in order of appearance.

    Aggregate to one row per paper first (partial aggregation), then a
    bounded top-k (TakeOrderedAndProject keeps k rows per task)."""
    return (sent.groupBy("paper_id").agg(F.min(order_col).alias("first_seen"))
            .orderBy("first_seen", "paper_id").limit(k))


def keep_papers(df: DataFrame, papers: DataFrame) -> DataFrame:
    """J5 on paper ids; ``papers`` is bounded (top-k), broadcast is safe."""
    return df.join(F.broadcast(papers.select("paper_id")), "paper_id", "left_semi")


def drop_papers(df: DataFrame, papers: DataFrame) -> DataFrame:
    """J6 on paper ids; ``papers`` is bounded (top-k), broadcast is safe."""
    return df.join(F.broadcast(papers.select("paper_id")), "paper_id", "left_anti")


def assign_pools(sent: DataFrame, n_honeypot: int = 3, n_pilot: int = 5) -> DataFrame:
    """Split the corpus into ``honeypot``, ``pilot`` and ``full`` pools.

    Honeypots are the first ``n_honeypot`` papers; the pilot pool is the first
    ``n_pilot`` papers of what remains; every sentence lands in exactly one
    pool (a partition column, not three scans)."""
    honey = first_papers(sent, n_honeypot).select("paper_id", F.lit("honeypot").alias("pool"))
    rest = drop_papers(sent, honey)
    pilot = first_papers(rest, n_pilot).select("paper_id", F.lit("pilot").alias("pool"))
    chosen = honey.unionByName(pilot)
    return (sent.join(F.broadcast(chosen), "paper_id", "left")
            .withColumn("pool", F.coalesce("pool", F.lit("full"))))


def gold_lookup(pool: DataFrame, scores: DataFrame, key: str = "sentence_id",
                score_col: str = "score") -> DataFrame:
    """Attach the gold score; ``n_gold`` reports rows that do not have
    exactly one gold score (the reference raises on them).

    Scores are pre-aggregated per key before the join, so repeated keys never
    multiply pool rows."""
    per_key = scores.groupBy(key).agg(F.count(F.lit(1)).alias("n_gold"),
                                      F.min(score_col).alias("gold"))
    return (pool.join(per_key, key, "left")
            .withColumn("n_gold", F.coalesce("n_gold", F.lit(0)))
            .withColumn("gold", F.when(F.col("n_gold") == 1, F.col("gold"))))


def high_water_mark(marked: DataFrame | None, key: str = "sentence_id"):
    """A5: ``max(key)`` of the store as a scalar-subquery column, -1 when the
    store is empty or missing."""
    if marked is None:
        return F.lit(-1).cast("long")
    return marked.select(F.coalesce(F.max(key).cast("long"), F.lit(-1).cast("long"))).scalar()


def annotation_queue(sent: DataFrame, marked: DataFrame | None,
                     before: int = ANNOTATOR_BEFORE, after: int = ANNOTATOR_AFTER) -> DataFrame:
    """Sentences after the last marked id, with annotator context.

    Only the ``before`` sentences ahead of the mark can be context of a queued
    one, so everything earlier is filtered out below the context window; the
    mark is a scalar subquery, evaluated once."""
    mark = high_water_mark(marked)
    near = sent.filter(F.col("sentence_id") > mark - before)
    return annotator_context(near, before, after).filter(F.col("sentence_id") > mark)


def pool_rows(sent: DataFrame, pools: Sequence[str] | None = None) -> DataFrame:
    """Pool table ready for the crowd platform: (pool, sentence_id, pool_text)."""
    assigned = assign_pools(sent)
    if pools:
        assigned = assigned.filter(F.col("pool").isin(list(pools)))
    return pool_text(assigned).select("pool", "paper_id", "sentence_id", "pool_text")


# Column names of the crowd platform's pool files.
POOL_TEXT_COL, POOL_GOLD_COL = "INPUT:text", "GOLDEN:is_subjective"


def write_pools(pool: DataFrame, path: str, gold: DataFrame | None = None,
                with_ids: bool = False, mode: str = "overwrite") -> None:
    """M13 + S9: write every pool in one pass as headed TSV, one
    ``pool=<name>/`` folder each; ``gold`` (J7 output) adds the gold column,
    ``with_ids`` keeps ``sentence_id`` (the retrieval variant)."""
    out = pool
    cols = [F.col("pool"), F.col("pool_text").alias(POOL_TEXT_COL)]
    if gold is not None:
        out = gold_lookup(out, gold)
        cols.append(F.col("gold").alias(POOL_GOLD_COL))
    if with_ids:
        cols.append(F.col("sentence_id"))
    (out.select(*cols).write.mode(mode).partitionBy("pool")
     .option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"')
     .csv(path))
