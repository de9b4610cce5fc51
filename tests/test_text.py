from pyspark.sql import functions as F

from tessera.functions import text as tx


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_sentence_split(spark):
    got = one(spark, tx.split_sentences(F.lit("One. Two!  Three?\nFour\nstill four. ")))
    assert got == ["One.", "Two!", "Three?", "Four\nstill four."]
    # a rule, not a trained splitter: abbreviations followed by a space split
    assert one(spark, tx.split_sentences(F.lit("U.S. policy"))) == ["U.S.", "policy"]


def test_quotes_strip_words(spark):
    assert one(spark, tx.straighten_quotes(F.lit("‘a’ “b”"))) == "'a' \"b\""
    assert one(spark, tx.strip_ws(F.lit("\t x y \n\x0b"))) == "x y"
    assert one(spark, tx.words(F.lit("Don't STOP-me 42x"))) == ["don", "t", "stop", "me", "x"]


def test_stop_words_keep_order_and_duplicates(spark):
    got = one(spark, tx.remove_stop_words(F.array(*[F.lit(w) for w in ["the", "cat", "cat", "is", "a", "dog"]])))
    assert got == ["cat", "cat", "dog"]
    assert "the" in tx.ENGLISH and len(tx.ENGLISH) > 150


def test_recode_argmax_markers_context(spark):
    r = spark.createDataFrame([(v,) for v in range(7)], "v int").select(tx.recode("v", tx.COLLAPSE_SCALE).alias("r"))
    assert [x.r for x in r.orderBy("r").collect()] == [0, 1, 1, 2, 3, 3, 6]
    assert one(spark, tx.argmax(F.array(F.lit(0.1), F.lit(0.7), F.lit(0.7)))) == 1
    assert one(spark, tx.wrap_markers(F.array(F.lit(17)), 2, 3)) == [2, 17, 3]
    assert one(spark, tx.join_context(F.lit(""), F.lit("t"), F.lit("n"), "**")) == "**t** n"
    assert one(spark, tx.join_context(F.lit("p"), F.lit("t"), F.lit(""), "**")) == "p **t**"
