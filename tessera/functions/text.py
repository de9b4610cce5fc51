"""Scalar column functions (string / array / math), all JVM-side.

Each function takes and returns ``Column`` objects so it stays inside
whole-stage code generation; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.stopwords import ENGLISH

# The sentence boundary rule (F1) and the whitespace class used
# for blank detection and stripping. RE2 and Java read them the same way.
SENTENCE_BOUNDARY = r"([.!?])[ \t\n\r\f]+"
SENTENCE_MARK = "\u0001"
WHITESPACE_CLASS = "[ \\t\\n\\r\\f\\x0B]"
WORD_PATTERN = "[A-Za-z]+"
# Curly quotes and their straight replacements (F2).
CURLY_QUOTES = "‘’“”"
STRAIGHT_QUOTES = "''\"\""


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_sentences(text) -> Column:
    """rule-based sentence split; empty pieces are dropped."""
    marked = F.regexp_replace(_c(text), SENTENCE_BOUNDARY, "$1" + SENTENCE_MARK)
    return F.filter(F.split(marked, SENTENCE_MARK), lambda s: s != F.lit(""))


def straighten_quotes(text) -> Column:
    """curly single/double quotes become straight ones."""
    return F.translate(_c(text), CURLY_QUOTES, STRAIGHT_QUOTES)


def drop_carriage_returns(text) -> Column:
    """F3."""
    return F.regexp_replace(_c(text), "\r", "")


def join_pair(a, b) -> Column:
    """join a sentence pair with one space and remove double quotes."""
    return F.regexp_replace(F.concat_ws(" ", _c(a), _c(b)), '"', "")


def strip_ws(text) -> Column:
    """strip leading/trailing whitespace (Spark ``trim`` only strips spaces)."""
    return F.regexp_replace(_c(text), f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$", "")


def is_blank(text) -> Column:
    """True for null, empty or whitespace-only strings."""
    return _c(text).isNull() | _c(text).rlike(f"^{WHITESPACE_CLASS}*$")


def words(text) -> Column:
    """lower-case alphabetic word tokens."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_PATTERN), 0)


def remove_stop_words(tokens, stop_words=None) -> Column:
    """F7 as a column expression: order- and duplicate-preserving (not
    ``array_except``). Linear in the list per token; for whole corpora use
    ``stop_word_remover`` (hash-set lookup)."""
    stop = F.array(*[F.lit(w) for w in (stop_words or ENGLISH)])
    return F.filter(_c(tokens), lambda t: ~F.array_contains(stop, t))


def stop_word_remover(input_col: str, output_col: str, stop_words=None):
    """F7 as Spark ML's ``StopWordsRemover`` (JVM hash set). Tokens are
    already lower-case, so matching is exact (case-sensitive)."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover(inputCol=input_col, outputCol=output_col, caseSensitive=True,
                            stopWords=list(stop_words or ENGLISH))


def wrap_markers(ids, begin, end) -> Column:
    """add begin/end markers once."""
    return F.concat(F.array(F.lit(begin)), _c(ids), F.array(F.lit(end)))


def argmax(scores) -> Column:
    """0-based position of the first maximum of a numeric array."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def join_context(prev, target, nxt, marker: str = "") -> Column:
    """``prev + ' ' + marker target marker + ' ' + next`` with spaces only
    where the context is non-empty."""
    centre = F.concat(F.lit(marker), _c(target), F.lit(marker)) if marker else _c(target)
    return F.concat_ws(" ", F.nullif(_c(prev), F.lit("")), centre, F.nullif(_c(nxt), F.lit("")))


def recode(col, mapping: dict) -> Column:
    """Many-to-one value map as a ``when`` chain.

    Keys and values of one type: unmapped values pass through unchanged. Keys
    and values of different types (text labels to numbers): the result has
    the values' type and unmapped values are null."""
    c, out = _c(col), F
    for k, v in mapping.items():
        out = out.when(c == F.lit(k), F.lit(v))
    same = {type(k) for k in mapping} == {type(v) for v in mapping.values()}
    return out.otherwise(c if same else F.lit(None))


# The 0-5 annotation scale collapsed to four classes
# (0 not applicable, 1 objective, 2 neutral, 3 subjective).
COLLAPSE_SCALE = {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 3}
LABEL_NAMES = {0: "Non-Applicable", 1: "Objective", 2: "Neutral", 3: "Subjective"}
# Pair-corpus labels.
PAIR_LABELS = {"entailment": 2, "neutral": 1, "contradiction": 0}
