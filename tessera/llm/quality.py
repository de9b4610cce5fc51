"""Quality rules: divergence of a document's histograms from its language's.

References are learned from all documents: per language the shares of five
character classes and of its ``top_words`` most frequent words (all other words
are one more category; equal counts are taken in the order of the words). A
document is compared with the reference of its own language by the
Jensen-Shannon distance (base 2, 0 to 1) of both histograms. One rule holds for
languages of every size: each has a reference of its own, however few its
documents. References stay a table with one row per language, joined to the
documents by language and broadcast while it has at most ``BROADCAST_LANGUAGES``
rows (about 20 KB each). Documents of a null language have nothing to be compared with:
their distances are null and the base rule decides.

A row finds a word in its reference by ``slots``: the word's hash shifted by the
language's ``shift`` is the place where the hash must stand. The shift is the one
that keeps most of the reference's words apart; words that still share a place
are in ``extra``, which is searched through.

References count every document, but the copies of one text at most as often as
makes ``1 / COPY_PART`` of its language's distinct texts (once at least), so a
large group of copies does not bend them. Only exact copies are known as such.

Everything is DataFrame expressions: one pass finds such texts by a hash (one
short row per distinct text is shuffled), one counts words per language (a
partial aggregate, so a language with a third of all rows is one row per
distinct word and task), one pass scores every document in place, unshuffled.

Null and empty texts have no words and fail the base rule; very long ones are
judged whole. Rows are judged one by one: repeated rows and null ids stay. An
empty table gives an empty one. Other columns are untouched, also those that are
named like working columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import boundary, free_names

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CLASSES = {"lower": "[^a-z]+", "upper": "[^A-Z]+", "digit": "[^0-9]+", "symbol": r"[^#*$%&|<>]+",
           "mark": r"[^!-~]+|[0-9A-Za-z#*$%&|<>]+"}  # what to delete to leave the class; the rest is "other"
MIN_WORDS = 50  # the base rule: shorter documents fail
MAX_REPEAT_PERCENT = 50
TOP_WORDS = 64
SLOTS = 16  # places for each reference word
SHIFTS = 48  # tried for each language
BROADCAST_LANGUAGES = 1024
COPY_PART = 8  # copies of one text count up to this part of their language's distinct texts
BROADCAST_TEXTS = 100_000  # 50 bytes each
# Largest distance of a kept document of n words: a + b / sqrt(n). The second
# part is the distance that sampling alone gives a short clean document.
CHAR_LIMIT = (0.20, 0.8)
WORD_LIMIT = (0.28, 1.5)
WORD_GUARD = 50  # shorter documents are too short for the word histogram


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also under lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(hashes: Column) -> Column:
    """Words inside three-word windows that the text holds at least twice."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (
                F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
        return _let(ordered, lambda s: F.aggregate(
            positions(s), start,
            lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")),
            lambda a: a["n"]))

    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - 3),
                          lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)))
    many = _let(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), 0).otherwise(covered(t)))
    return F.when(F.size(hashes) < 3, 0).otherwise(many)


def class_counts(text: Column, solid: Column) -> Column:
    """Characters of each class in order, as an array; ``solid`` are the
    non-blank characters. Only what is no lower-case letter (a small part of
    most texts) is read again for the other classes."""
    rest = F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "")
    return _let(rest, lambda r: F.array(solid - F.char_length(r), *[
        F.char_length(F.regexp_replace(r, p, "")) for k, p in CLASSES.items() if k != "lower"]))


def heavy_copies(df: DataFrame, text: str, lang: str) -> DataFrame:
    """``(lang, h, g, copies, weight)`` of the texts whose copies are longer in all than
    ``1 / COPY_PART`` of their language's distinct texts; as many as are not count."""
    texts = df.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.hash(text).alias("g"),
                      F.octet_length(text).alias("size")).filter(F.col("size") > 0)
    groups = boundary(texts.groupBy("lang", "h", "g").agg(
        F.count(F.lit(1)).alias("copies"), F.max("size").cast("long").alias("size")), compression="lz4")
    sums = groups.groupBy(F.col("lang").alias("of")).agg(F.sum("size").alias("all"))
    own = (groups.filter("copies > 1").join(sums, F.col("lang").eqNullSafe(F.col("of")))
           .withColumn("weight", F.greatest(F.lit(1), F.floor(F.col("all") / COPY_PART / F.col("size")))))
    return boundary(own.filter("weight < copies").select("lang", "h", "g", "copies", "weight"))


def word_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """``(lang, word, n)`` over the whole texts, those of ``heavy_copies`` at their weight."""
    heavy = heavy_copies(df, text, lang)
    n_heavy = heavy.count()
    if not n_heavy:
        words = df.select(F.col(lang).alias("lang"), F.explode(words_of(F.col(text))).alias("word"))
        return words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    own = heavy.toDF("_l", "_h", "_g", "copies", "weight")
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    same = (F.col("lang").eqNullSafe(F.col("_l")) & (F.xxhash64("text") == F.col("_h")) & (F.hash("text") == F.col("_g")))
    words = (rows.join(F.broadcast(own) if n_heavy <= BROADCAST_TEXTS else own, same, "left")
             .select("lang", F.explode(words_of(F.col("text"))).alias("word"), "copies", "weight"))
    # all copies of a text have its words, so n is a multiple of copies
    counts = words.groupBy("lang", "word", "copies", "weight").agg(F.count(F.lit(1)).alias("n"))
    part = F.when(F.col("copies").isNull(), F.col("n")).otherwise(F.expr("n div copies") * F.col("weight"))
    return counts.groupBy("lang", "word").agg(F.sum(part).alias("n"))


def _top(counts: DataFrame, top_words: int) -> DataFrame:
    # two ranks: the first leaves top_words of each of 64 parts of a language, so no task sees a whole one
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("word"), F.lit(64))).orderBy(F.desc("n"), "word")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return (counts.withColumn("_r", F.row_number().over(parts)).filter(F.col("_r") <= top_words)
            .withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= top_words)
            .select("lang", F.xxhash64("word").alias("h"), "n"))


def _language_sums(counts: DataFrame) -> DataFrame:
    """``(lang, of, chars)``: word total and character class totals of every language."""
    size = F.char_length("word")
    typed = counts.select("lang", "n", size.alias("size"), class_counts(F.col("word"), size).alias("k"))
    known = F.aggregate("k", F.lit(0), lambda a, x: a + x)
    rows = typed.select("lang", "n", *[(F.col("k")[i] * F.col("n")).alias(k) for i, k in enumerate(CLASSES)],
                        ((F.col("size") - known) * F.col("n")).alias("other"))
    names = (*CLASSES, "other")
    return (rows.groupBy("lang").agg(F.sum("n").alias("of"), *[F.sum(k).alias(k) for k in names])
            .select("lang", "of", F.array(*names).alias("chars")))


def place(h: Column, shift: Column, width: int) -> Column:
    return F.call_function("shiftright", h, shift).bitwiseAND(F.lit(width - 1)).cast("int")


def slotted(top: DataFrame, width: int, shifts: int = SHIFTS) -> DataFrame:
    """``(lang, shift, kept, extra)``: of the words ``(lang, h, n)`` those with a place of
    their own, ``kept`` as a map of it, and the others."""
    tried = (top.select("lang", "h", F.explode(F.sequence(F.lit(0), F.lit(shifts - 1))).alias("shift"))
             .groupBy("lang", "shift").agg(F.count_distinct(place(F.col("h"), F.col("shift"), width)).alias("apart")))
    best = tried.groupBy("lang").agg(F.max(F.struct("apart", (-F.col("shift")).alias("s"))).alias("b"))
    own = (top.join(best.select("lang", (-F.col("b.s")).alias("shift")), "lang")
           .withColumn("at", place(F.col("h"), F.col("shift"), width)))
    same = Window.partitionBy("lang", "at").orderBy(F.desc("n"), "h")
    ranked = own.withColumn("_r", F.row_number().over(same))
    word = F.struct("at", F.struct("h", "n"))
    return ranked.groupBy("lang", "shift").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_r") == 1, word))).alias("kept"),
        F.sort_array(F.collect_list(F.when(F.col("_r") > 1, F.struct("h", "n")))).alias("extra"))


def references(df: DataFrame, text: str = "text", lang: str = "lang", top_words: int = TOP_WORDS,
               shifts: int = SHIFTS) -> DataFrame:
    """``(lang, shift, slots, extra, shares, chars)``, a row per non-null language. ``shares``
    are in the order of the slots, then the extra words, then all other words together."""
    width = 1 << (SLOTS * top_words - 1).bit_length()
    counts = boundary(word_counts(df.filter(F.col(lang).isNotNull()), text, lang))
    placed = slotted(_top(counts, top_words), width, shifts).join(_language_sums(counts), "lang")
    every = F.sequence(F.lit(0), F.lit(width - 1))
    at = lambda i: F.get(F.array(F.element_at("kept", i)), F.lit(0))
    # a free slot holds a hash that belongs to the next one, so nothing is found there
    free = lambda i: F.call_function(
        "shiftleft", (i + 1).bitwiseAND(F.lit(width - 1)).cast("long"), F.col("shift"))
    none = F.lit(0).cast("long")
    listed = (F.aggregate(F.map_values("kept"), none, lambda a, x: a + x["n"])
              + F.aggregate("extra", none, lambda a, x: a + x["n"]))
    total = F.greatest(F.aggregate("chars", none, lambda a, x: a + x), F.lit(1))
    return boundary(placed.select(
        "lang", "shift", F.transform(every, lambda i: F.coalesce(at(i)["h"], free(i))).alias("slots"),
        F.transform("extra", lambda x: x["h"]).alias("extra"),
        F.concat(F.transform(every, lambda i: F.coalesce(at(i)["n"], F.lit(0)) / F.col("of")),
                 F.transform("extra", lambda x: x["n"] / F.col("of")),
                 F.array((F.col("of") - listed) / F.col("of"))).alias("shares"),
        F.transform("chars", lambda x: x / total).alias("chars")))


def _term(p: Column, q: Column) -> Column:
    """A present category's part of twice the divergence, less its reference share."""
    m = (p + q) / 2
    return (F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
            + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0) - q)


def _distance(twice_less_one: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), (twice_less_one + 1.0) / 2))


def char_distance(counts: list[Column], total: Column, shares: Column) -> Column:
    """``counts`` of the classes, ``total`` characters, reference ``shares``."""
    n = F.greatest(total, F.lit(1))
    other = total - sum(counts, F.lit(0))
    return _distance(sum((_term(c / n, F.get(shares, F.lit(i))) for i, c in enumerate([*counts, other])), F.lit(0.0)))


def word_distance(hashes: Column, ref: Column, width: int) -> Column:
    """``hashes`` of the document's words against its reference's row."""
    found = _let(F.transform(hashes, lambda h: place(h, ref["shift"], width)), lambda p: F.filter(
        p, lambda k, i: F.get(ref["slots"], k) == F.get(hashes, i)))
    more = F.filter(F.transform(hashes, lambda h: (F.array_position(ref["extra"], h) + (width - 1)).cast("int")),
                    lambda k: k >= width)
    more = F.when(F.size(ref["extra"]) > 0, more).otherwise(F.array().cast("array<int>"))
    return _found_distance(F.concat(found, more), hashes, ref["shares"], F.size(ref["shares"]) - 1)


def _found_distance(found: Column, hashes: Column, shares: Column, rest_at: Column) -> Column:
    """``found`` are the places of the document's reference words in ``shares``, ``rest_at`` that of all others."""
    n = F.greatest(F.size(hashes), F.lit(1))

    def compare(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda k, j: F.when((j == 0) | (F.get(s, j - 1) != k), j).otherwise(-1)),
                          lambda j: j >= 0)

        def runs(at: Column) -> Column:
            parts = F.transform(at, lambda j, r: _term(
                (F.coalesce(F.get(at, r + 1), F.size(s)) - j) / n, F.get(shares, F.get(s, j))))
            return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)

        rest = (n - F.size(s)) / n
        q_rest = F.get(shares, rest_at)
        return _distance(_let(starts, runs) + F.when(rest > 0, _term(rest, q_rest))
                         .otherwise(0.0))

    return _let(F.sort_array(found), compare)


def judge(df: DataFrame, refs: DataFrame, text: str = "text", lang: str = "lang",
          char_limit: tuple[float, float] = CHAR_LIMIT, word_limit: tuple[float, float] = WORD_LIMIT,
          top_words: int = TOP_WORDS, out: str = "_q") -> DataFrame:
    """``df`` with the column ``out``: a struct of counts, distances and verdicts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    width = 1 << (SLOTS * top_words - 1).bit_length()
    split, name, own = free_names(df, "_words", "_ref_lang", "_ref")
    table = refs.select(F.col("lang").alias(name), F.struct("shift", "slots", "extra", "shares", "chars").alias(own))
    base = (df.join(F.broadcast(table) if refs.count() <= BROADCAST_LANGUAGES else table,
                    F.col(lang) == F.col(name), "left").drop(name).withColumn(split, words_of(F.col(text))))
    base = base.withColumn(out, _let(
        F.struct(F.transform(F.col(split), lambda w: F.xxhash64(w)).alias("h"), F.col(own).alias("r"),
                 _let(F.char_length(F.array_join(F.col(split), "")), lambda n: F.struct(
                     n.alias("n"), class_counts(whole, n).alias("k"))).alias("t")),
        lambda x: F.struct(
            F.size(x["h"]).cast("long").alias("n_words"),
            x["t"]["n"].cast("long").alias("word_chars"),
            F.get(x["t"]["k"], F.lit(list(CLASSES).index("symbol"))).cast("long").alias("n_symbols"),
            repeated_words(x["h"]).cast("long").alias("n_repeat_words"),
            F.when(F.size(x["h"]) < 1, 0.0).when(x["r"].isNotNull(), char_distance(
                [F.get(x["t"]["k"], F.lit(i)) for i in range(len(CLASSES))], x["t"]["n"], x["r"]["chars"])).alias("char_js"),
            F.when(F.size(x["h"]) < WORD_GUARD, 0.0).when(x["r"].isNotNull(), word_distance(x["h"], x["r"], width))
            .alias("word_js"))))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    q = F.col(out)
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    root = F.sqrt(F.greatest(q["n_words"], F.lit(1)).cast("double"))
    near = [F.coalesce(q[js] <= a + b / root, F.lit(True))
            for js, (a, b) in (("char_js", char_limit), ("word_js", word_limit))]
    good = near[0] & near[1]
    return base.drop(split, own).withColumn(out, F.struct(
        q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"), q["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & good).alias("kept"),
        F.round(q["char_js"], 4).alias("char_js"), F.round(q["word_js"], 4).alias("word_js")))


def quality(df: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the rule columns of every row."""
    refs = references(df, text, lang)
    (q,) = free_names(df, "_q")
    return judge(df, refs, text, lang, out=q).select(*keep, f"{q}.*")


def kept_documents(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` that the rules keep."""
    refs = references(df, text, lang)
    (q,) = free_names(df, "_q")
    return judge(df, refs, text, lang, out=q).filter(F.col(q)["kept"]).drop(q)


def _sql_classes(text: str) -> list[str]:
    return [f"length(regexp_replace({text}, '{p}', '', 'g'))" for p in CLASSES.values()]


def _sql_term(p: str, q: str) -> str:
    return (f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"
            f" + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END - {q})")


_N = len(CLASSES)
SQL = f"""
WITH docs AS (SELECT doc_id, lang, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
split AS (SELECT rid, lang, t, list_filter(string_split_regex(t, '{SPACE}'), lambda w: w <> '') AS ws FROM docs),
occ AS (SELECT rid, lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM split),
texts AS (SELECT lang, t, count(*) AS copies, strlen(t) AS size FROM docs WHERE lang IS NOT NULL AND t <> '' GROUP BY ALL),
weights AS (SELECT lang, t, least(copies, greatest(1, floor(sum(size) OVER (PARTITION BY lang) / {COPY_PART} / size))) AS w
            FROM texts),
counts AS (SELECT lang, word, sum(w)::BIGINT AS n FROM (
             SELECT lang, w, unnest(list_filter(string_split_regex(t, '{SPACE}'), lambda w: w <> '')) AS word FROM weights)
           GROUP BY ALL),
vocab AS (SELECT lang AS key, word, n FROM
          (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM counts) WHERE r <= {TOP_WORDS}),
totals AS (SELECT lang AS key, sum(n) AS n, [{", ".join(f"sum({c} * n)" for c in _sql_classes("word"))},
           sum((length(word) - ({" + ".join(_sql_classes("word"))})) * n)] AS k FROM counts GROUP BY lang),
chars AS (SELECT key, list_transform(k, lambda x: x / list_sum(k)) AS q FROM totals),
shares AS (SELECT key, word, v.n / t.n AS q FROM vocab v JOIN totals t USING (key)),
rest AS (SELECT key, greatest(0, 1 - sum(q)) AS q FROM shares GROUP BY key),
tri AS (SELECT rid, pos, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w AS tri FROM occ
        WINDOW w AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, tri) AS c FROM tri
          WHERE tri IS NOT NULL) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT pos + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM split),
base AS (SELECT s.rid, s.lang AS key, len(ws) AS n, list_sum(list_transform(ws, lambda w: length(w))) AS wc,
         {", ".join(f"{c} AS c{i}" for i, c in enumerate(_sql_classes("t")))}, coalesce(c.n, 0) AS rep,
         len(ls) - len(list_distinct(ls)) AS dup
         FROM split s LEFT JOIN covered c USING (rid) JOIN lines USING (rid)),
shared AS (SELECT b.*, q, [{", ".join(f"c{i} / greatest(wc, 1)" for i in range(_N))},
           (wc - {" - ".join(f"c{i}" for i in range(_N))}) / greatest(wc, 1)] AS p FROM base b LEFT JOIN chars USING (key)),
char_js AS (SELECT rid, CASE WHEN n < 1 THEN 0 WHEN q IS NULL THEN NULL ELSE sqrt(greatest(0, ({" + ".join(
    _sql_term(f"p[{i + 1}]", f"q[{i + 1}]") for i in range(_N + 1))} + 1) / 2)) END AS js FROM shared),
present AS (SELECT o.rid, o.word, count(*) AS c FROM occ o JOIN vocab v ON o.lang = v.key AND o.word = v.word GROUP BY ALL),
parts AS (SELECT p.rid, sum({_sql_term("(p.c / b.n)", "s.q")}) AS x, sum(p.c) AS c FROM present p JOIN base b USING (rid)
          JOIN shares s ON s.key = b.key AND s.word = p.word GROUP BY p.rid),
word_js AS (SELECT b.rid, CASE WHEN b.n < {WORD_GUARD} THEN 0 WHEN r.q IS NULL THEN NULL ELSE sqrt(greatest(0, (coalesce(x, 0)
            + CASE WHEN b.n > coalesce(c, 0) THEN {_sql_term("((b.n - coalesce(c, 0)) / b.n)", "r.q")} ELSE 0 END + 1) / 2))
            END AS js FROM base b LEFT JOIN rest r USING (key) LEFT JOIN parts USING (rid)),
judged AS (SELECT rid, b.n, coalesce(wc, 0) AS wc, c{list(CLASSES).index("symbol")} AS sym, dup, rep, c.js AS cj, w.js AS wj,
           b.n < {MIN_WORDS} OR 100 * rep > {MAX_REPEAT_PERCENT} * b.n AS failed
           FROM base b JOIN char_js c USING (rid) JOIN word_js w USING (rid))
SELECT doc_id, n::BIGINT AS n_words, wc::BIGINT AS word_chars, sym::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines,
       rep::BIGINT AS n_repeat_words, failed AS base_failed,
       NOT failed AND coalesce(cj <= {CHAR_LIMIT[0]} + {CHAR_LIMIT[1]} / sqrt(greatest(n, 1)), true)
           AND coalesce(wj <= {WORD_LIMIT[0]} + {WORD_LIMIT[1]} / sqrt(greatest(n, 1)), true) AS kept,
       round(cj, 4) AS char_js, round(wj, 4) AS word_js
FROM judged JOIN docs USING (rid)
"""
