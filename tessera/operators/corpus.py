"""Corpus curation: raw articles -> deduplicated, budgeted, numbered sentences.

Operators: P2 blank-to-null + drop, P3 minimum sentence count, W7 keep-first
dedup, A2/J5 sources over a threshold, W1 budget cut in curation order,
W2/F9 explode and number, M12 the whole chain, F1 with abbreviations and
sentence starters learned from the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.plans import prefix
from tessera.session import cut_lineage

# Reference defaults.
MIN_SENTENCES = 5
MIN_SOURCE_ARTICLES = 100
SENTENCE_BUDGET = 20000


def curation_order() -> list[Column]:
    """Newest first, then domain descending; ties by id."""
    return [F.col("date").desc(), F.col("domain").desc(), F.col("paper_id").asc()]


def drop_blank(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Whitespace-only values become null; rows with any null are dropped."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.when(~tx.is_blank(F.col(c).cast("string")), F.col(c)))
    return out.na.drop("any", subset=list(cols))


def min_length(df: DataFrame, n: int = MIN_SENTENCES, length_col: str = "length") -> DataFrame:
    """Keep articles with at least ``n`` sentences."""
    return df.filter(F.col(length_col) >= n)


def dedup_first(df: DataFrame, key: str = "text", order: Sequence[str] = ("domain", "paper_id")) -> DataFrame:
    """One row per ``key``: the smallest ``order`` tuple (ending in a unique id) wins.

    The group key is the text's SHA-256, so what is aggregated, shuffled and
    sorted are digests and order columns; a text repeated millions of times is
    one row per map task. The winners fetch their rows by digest and id in one
    semi join on narrow keys; texts are never sorted or compared.
    """
    fields = list(order)
    keyed = df.withColumn("_digest", F.sha2(F.col(key).cast("binary"), 256))
    best = (keyed.groupBy("_digest").agg(F.min(F.struct(*fields)).alias("_best"))
            .select(F.col("_digest").alias("_d"), *[F.col(f"_best.{c}").alias(f"_{c}") for c in fields]))
    same = keyed["_digest"].eqNullSafe(best["_d"])
    for c in fields:
        same = same & keyed[c].eqNullSafe(best[f"_{c}"])
    return keyed.join(best, same, "left_semi").drop("_digest")


def sources_over(df: DataFrame, threshold: int = MIN_SOURCE_ARTICLES,
                 key: str = "domain") -> DataFrame:
    """A2: keys with strictly more than ``threshold`` rows."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n_articles"))
            .filter(F.col("n_articles") > threshold))


def keep_sources(df: DataFrame, threshold: int = MIN_SOURCE_ARTICLES, key: str = "domain") -> DataFrame:
    """Semi-join with the sources over the threshold.

    The source table is an aggregate whose size is measured at run time: AQE
    broadcasts it when small and keeps a skew-aware shuffle join otherwise.
    """
    return df.join(sources_over(df, threshold, key).select(key), key, "left_semi")


def budget_cut(df: DataFrame, budget: int = SENTENCE_BUDGET, order: Sequence[Column] | None = None,
               length_col: str = "length", bucket: Sequence[str] = ("date", "domain"),
               bucket_order: Sequence[Column] | None = None, id_col: str = "paper_id",
               needed: Sequence[str] = ()) -> DataFrame:
    """Keep rows while the running sentence total (inclusive) is below
    ``budget``; adds ``first_sentence`` = sentences before the row.

    Two levels: per-bucket totals (``bucket`` = the leading order keys) get
    a running total of their own; buckets that start at or past the budget
    are dropped before any row is sorted, so with a small budget only a few
    buckets' rows reach the row-level range sort. Buckets are a prefix of
    the order, so the row-level totals over the survivors equal the totals
    over all rows. ``order`` may use the bucket columns, ``id_col`` (unique)
    and ``needed``."""
    order = list(order or curation_order())
    bucket_order = list(bucket_order or [F.col("date").desc(), F.col("domain").desc()])
    keys = list(bucket)
    totals = df.groupBy(*keys).agg(F.sum(length_col).alias("_bucket_total"))
    starts = prefix.running_total(totals, bucket_order + [F.col(k) for k in keys], "_bucket_total",
                                  "_bucket_start", inclusive=False)
    live = starts.filter(F.col("_bucket_start") < budget).select(*keys)
    # the live-bucket table is an aggregate measured at run time (AQE
    # broadcasts it when small, as it is for any budget far below the data)
    narrow = df.select(id_col, *[c for c in dict.fromkeys([*keys, *needed, length_col]) if c != id_col])
    # texts stay out of the range sort: kept rows are fetched by id
    cum = prefix.running_total(narrow.join(live, keys, "left_semi"), order, length_col, "_cum", inclusive=True)
    kept = cum.filter(F.col("_cum") < budget).select(
        id_col, (F.col("_cum") - F.col(length_col)).alias("first_sentence"))
    return df.join(kept, id_col)


def curate(articles: DataFrame, min_sentences: int = MIN_SENTENCES,
           min_source_articles: int = MIN_SOURCE_ARTICLES,
           budget: int = SENTENCE_BUDGET) -> DataFrame:
    """M12 up to the article table (``raw_dataset``):
    (paper_id, domain, date, text, length, first_sentence)."""
    clean = drop_blank(articles.select("paper_id", "domain", "date", "text"), ["text", "domain", "date"])
    # Identical texts have identical sentence counts, so the length filter and
    # the keep-first dedup commute: dedup first (cheap hashing before the
    # shuffle), split sentences after it on the surviving rows, in parallel.
    unique = dedup_first(clean, "text", ("domain", "paper_id"))
    split = min_length(unique.withColumn("length", F.size(tx.split_sentences("text"))), min_sentences)
    # pipeline boundary (the deduplicated article table): the two prefix
    # passes of the budget cut read it instead of redoing dedup and split
    kept = cut_lineage(keep_sources(split, min_source_articles))
    return budget_cut(kept, budget)


def curated_sentences(articles: DataFrame, **kw) -> DataFrame:
    """Sentence table (paper_id, domain, date, text, sentence_id) numbered
    in curation order. The sentence split runs again only on kept articles."""
    arts = curate(articles, **kw)
    return (arts.select("paper_id", "domain", "date", "first_sentence",
                        F.posexplode(tx.split_sentences("text")).alias("pos", "sentence"))
            .select("paper_id", "domain", "date", F.col("sentence").alias("text"),
                    (F.col("first_sentence") + F.col("pos")).alias("sentence_id")))


# ---------------------------------------------------------------- F1 learned from the corpus
BLANKS = r"[ \t\n\r\f]+"
WORD = "^[a-z.]*[a-z][a-z.]*$"
EXPECTED = 0.99  # how often an abbreviation is followed by its period
ABBREVIATION, STARTER = 0.3, 30.0  # least scores


def abbreviations(df: DataFrame, text: str = "text", least: float = ABBREVIATION) -> DataFrame:
    """``(word, n_period, n_plain, score)`` of the corpus's abbreviations, learned without labels.

    Words are runs of non-blanks, lower-cased, without a closing period; of letters and
    periods only. The score is the log-likelihood ratio of "followed by a period nearly always"
    against "as any word is", times factors for the length (shorter is likelier), for periods inside,
    and against occurrences without a period. Texts are reduced to counts of words in the first step."""
    words = df.select(F.explode(F.split(F.lower(F.col(text)), BLANKS)).alias("w"))
    typed = words.select(F.regexp_replace("w", "[.]$", "").alias("word"), F.col("w").endswith(".").cast("long").alias("p"))
    counts = cut_lineage(typed.filter(F.col("word").rlike(WORD)).groupBy("word")
                         .agg(F.sum("p").alias("n_period"), F.sum(1 - F.col("p")).alias("n_plain")))
    share = counts.select(F.sum("n_period") / F.sum(F.col("n_period") + F.col("n_plain"))).scalar()
    k, m = F.col("n_period"), F.col("n_plain")
    usual = k * F.log(share) + m * F.log(1 - share)
    close = k * F.log(F.lit(EXPECTED)) + m * F.log(F.lit(1 - EXPECTED))
    size = F.length(F.regexp_replace("word", "[.]", ""))
    inner = F.length("word") - size
    score = 2 * (close - usual) * F.exp(-size) * (inner + 1) * F.pow(size.cast("double"), -m.cast("double"))
    return (counts.filter("n_period > 0").withColumn("score", score).filter(F.col("score") >= least)
            .select("word", "n_period", "n_plain", "score"))


def _pieces(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rule's sentences with their first word and the word before their closing period, lower-cased."""
    rows = df.select(id_col, F.posexplode(tx.split_sentences(F.col(text))).alias("at", "piece"))
    first = F.lower(F.regexp_extract("piece", "^([a-zA-Z]+)", 1))
    last = F.regexp_replace(F.lower(F.regexp_extract("piece", r"([^ \t\n\r\f]+)[.]$", 1)), "^[^a-z]+", "")
    return rows.select(id_col, "at", "piece", first.alias("first"), last.alias("last"))


def sentence_starters(df: DataFrame, known: DataFrame, text: str = "text", id_col: str = "paper_id",
                      least: float = STARTER) -> DataFrame:
    """``(word, n_start, n_all, score)``: words that begin sentences far more often than they
    stand elsewhere, by the log-likelihood ratio of both shares. A text's first piece counts as a
    sentence, and those after a piece that does not end in a ``known`` abbreviation."""
    order = Window.partitionBy(id_col).orderBy("at")
    after = _pieces(df, id_col, text).select("first", F.lag("last").over(order).alias("word"))
    starts = (after.join(known.select("word"), "word", "left_anti").filter(F.col("first") != "")
              .groupBy(F.col("first").alias("word")).agg(F.count(F.lit(1)).alias("n_start")))
    words = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    both = cut_lineage(words.groupBy("word").agg(F.count(F.lit(1)).alias("n_all"))
                       .join(starts, "word", "left").select("word", F.coalesce("n_start", F.lit(0)).alias("n_start"), "n_all"))
    rest = F.greatest(F.col("n_all") - F.col("n_start"), F.lit(0))
    k1, k2 = F.col("n_start"), rest
    n1, n2 = both.select(F.sum("n_start")).scalar(), both.select(F.sum(rest)).scalar()

    def fits(k: Column, n: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)

    p1, p2, p = k1 / n1, k2 / n2, (k1 + k2) / (n1 + n2)
    score = 2 * (fits(k1, n1, p1) + fits(k2, n2, p2) - fits(k1, n1, p) - fits(k2, n2, p))
    return (both.filter(F.col("n_start") > 0).withColumn("score", score).filter((F.col("score") >= least) & (p1 > p2))
            .select("word", "n_start", "n_all", "score"))


def learned_sentences(df: DataFrame, known: DataFrame, starters: DataFrame, id_col: str = "paper_id",
                      text: str = "text") -> DataFrame:
    """F1 with what was learned: ``(id, sent_no, text)``. The rule's pieces; one that ends in a
    known abbreviation goes on with the next, unless that begins with a sentence starter. Pieces are
    joined by a blank. The fixed rule stays the default elsewhere."""
    rows = _pieces(df, id_col, text)
    rows = (rows.join(known.select(F.col("word").alias("last"), F.lit(True).alias("short")), "last", "left")
            .join(starters.select(F.col("word").alias("first"), F.lit(True).alias("opens")), "first", "left"))
    order = Window.partitionBy(id_col).orderBy("at")
    goes_on = F.lag("short").over(order).isNotNull() & F.col("opens").isNull()
    numbered = rows.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("sent_no", F.sum("_new").over(order) - 1)
    return (numbered.groupBy(id_col, "sent_no").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))
            .select(id_col, F.col("sent_no").cast("long").alias("sent_no"),
                    F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("text")))
