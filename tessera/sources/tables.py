"""Driver tables and the fixture views derived from them.

Every view is a lazy DataFrame over the parquet tables, so column pruning and
filters still reach the scan. The DuckDB oracle defines the same views with
the same expressions (``tessera.oracle``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.plans import prefix
from tessera.session import cut_lineage

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Session setting, unset by default: partitions of a text table's rows.
SCAN_PARTITIONS = "tessera.scan.partitions"
TEXT_TABLES = ("documents", "pages")

# Fixture parameters (vote overlap, event type -> 0-5 score,
# start date of the derived article dates).
VOTE_OVERLAP = 3
EVENT_SCORE = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
ARTICLE_START_DATE = "2018-07-01"
ARTICLE_DATE_SPAN = 31
PAIR_CLASS_NAMES = {0: "contradiction", 1: "neutral", 2: "entailment"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, partitioned as the scan splits it. A caller whose text files hold fewer row
    groups than the cluster has cores sets ``SCAN_PARTITIONS``: the rows of text tables are then
    dealt over that many partitions, once, after column pruning and pushed filters."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    wanted = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted and name in TEXT_TABLES else df


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as raw news: (paper_id, domain, date, text)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("paper_id"),
        F.col("source").alias("domain"),
        F.date_add(F.lit(ARTICLE_START_DATE).cast("date"),
                   (F.col("doc_id") % ARTICLE_DATE_SPAN).cast("int")).alias("date"),
        F.col("text"),
    )


def corpus_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sentence corpus (paper_id, domain, date, text, sentence_id):
    a pipeline boundary for everything that reads it several times."""
    return cut_lineage(sentences(spark, sf_dir).select("paper_id", "domain", "date", "text", "sentence_id"))


def number_sentences(art: DataFrame, order, sents_col: str = "sents",
                     id_col: str = "sentence_id", key: str = "paper_id") -> DataFrame:
    """Explode per-article sentence arrays and number them 0..n-1 in
    ``order`` (article order) then position.

    The prefix sum runs on a narrow article table (order keys + count); the
    sentence arrays never pass through the Arrow pass or the slice
    materialisation, they meet their offset in one join on the unique
    article ``key``."""
    return (number_articles(art, order, sents_col, key)
            .select("*", F.posexplode(sents_col).alias("pos", "_sent"))
            .withColumn(id_col, F.col("_first") + F.col("pos"))
            .drop("_n", "_first", sents_col)
            .withColumnRenamed("_sent", "text_sentence"))


def article_offsets(art: DataFrame, order, sents_col: str = "sents") -> DataFrame:
    """Articles without their sentence array, with its size ``_n`` and the number ``_first`` of its
    first sentence. Only this narrow table is written."""
    counted = art.withColumn("_n", F.size(sents_col)).drop(sents_col)
    return prefix.running_total(cut_lineage(counted), order, "_n", "_first", inclusive=False)


def number_articles(art: DataFrame, order, sents_col: str = "sents", key: str = "paper_id", carried=None) -> DataFrame:
    """``article_offsets`` with the sentence array; ``art`` is read twice. With ``carried``, a column
    made of the array, that goes through the join and the array does not."""
    return article_offsets(art, order, sents_col).join(art.select(key, sents_col if carried is None else carried), key)


def split_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles with their sentences by rule F1 as an array ``sents``."""
    return articles(spark, sf_dir).withColumn("sents", tx.split_sentences("text")).drop("text")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles split by rule F1, numbered by (paper_id, pos). Texts are split twice, for
    the numbers and for the rows: the arrays, as large as the corpus, are never written."""
    return (number_sentences(split_articles(spark, sf_dir), ["paper_id"])
            .withColumnRenamed("text_sentence", "text")
            .select("paper_id", "domain", "date", "pos", "text", "sentence_id"))


def raw_score(event_type, event_id):
    m = F.create_map(*[x for k, v in EVENT_SCORE.items() for x in (F.lit(k), F.lit(v))])
    return F.when(event_id % 11 == 0, F.lit(0)).otherwise(m[event_type]).cast("int")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as crowd votes: (event_id, task, worker, raw, label)."""
    e = table(spark, sf_dir, "events")
    raw = raw_score(F.col("event_type"), F.col("event_id"))
    return e.select(
        "event_id",
        F.floor(F.col("event_id") / VOTE_OVERLAP).cast("long").alias("task"),
        F.col("user_id").alias("worker"),
        raw.alias("raw"),
    ).withColumn("label", tx.recode("raw", tx.COLLAPSE_SCALE).cast("int"))


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters per task: first and last vote (raw 0-5 scores)."""
    v = votes(spark, sf_dir)
    return v.groupBy("task").agg(
        F.min_by("raw", "event_id").alias("score"),
        F.max_by("raw", "event_id").alias("opp_score"),
    ).withColumnRenamed("task", "sentence_id")


def binary_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(
        "doc_id", "text", F.col("quality").alias("score"), F.col("toxic").alias("pred"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an experiment log: (run, epoch, f1); epoch 1.. per run by (ts, event_id)."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("f1"))
    return prefix.rank_within(e, ["run"], ["ts", "event_id"], "epoch", start=1)


def scores3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 3-class scores: softmax of the first three elements."""
    e = table(spark, sf_dir, "embeddings")
    ex = [F.exp(F.col("embedding")[i].cast("double")) for i in range(3)]
    z = ex[0] + ex[1] + ex[2]
    return e.select(
        "vec_id",
        F.array(*[(x / z) for x in ex]).alias("probs"),
        (F.col("label") % 3).cast("int").alias("score"),
    )


def annotated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair corpus from votes: per task the annotator labels are the class
    names of ``raw % 3`` (at most three per task by construction), gold is the
    label given at least twice, else '-'; sentence1/2 are the sentences with
    id = task and task + 1."""
    names = F.create_map(*[x for k, v in PAIR_CLASS_NAMES.items() for x in (F.lit(k), F.lit(v))])
    v = votes(spark, sf_dir).withColumn("name", names[F.col("raw") % 3])
    lab = v.groupBy("task").agg(F.collect_list("name").alias("annotator_labels"))
    top = (v.groupBy("task", "name").agg(F.count(F.lit(1)).alias("n"))
           .groupBy("task").agg(F.max(F.struct("n", "name")).alias("b"))
           .select("task", F.when(F.col("b.n") >= 2, F.col("b.name")).otherwise(F.lit("-")).alias("gold_label")))
    pairs = cut_lineage(lab.join(top, "task"))
    # of the corpus, only the sentences of a pair are joined
    wanted = pairs.select(F.col("task").alias("sentence_id")).unionByName(pairs.select((F.col("task") + 1).alias("sentence_id")))
    s = cut_lineage(sentences(spark, sf_dir).select("sentence_id", "text").join(wanted, "sentence_id", "left_semi"))
    s1 = s.select(F.col("sentence_id").alias("task"), F.col("text").alias("sentence1"))
    s2 = s.select((F.col("sentence_id") - 1).alias("task"), F.col("text").alias("sentence2"))
    return (pairs.join(s1, "task", "left").join(s2, "task", "left")
            .withColumnRenamed("task", "pair_id"))


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as stop-word-free word tokens (F6 + F7)."""
    d = table(spark, sf_dir, "documents").select("doc_id", tx.words("text").alias("words"))
    return tx.stop_word_remover("words", "tokens").transform(d).select("doc_id", "tokens")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token_rows`` as a pipeline boundary: every later pass reads the tokens, not the text."""
    return cut_lineage(token_rows(spark, sf_dir))
