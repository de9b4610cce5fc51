"""Hot keys, learned rules and main-text extraction on planted inputs."""

import collections
import random

from pyspark.sql import functions as F

from tessera.operators import corpus
from tessera.operators import datasets as ds
from tessera.operators import features as fe
from tessera.operators import labelling as lb
from tessera.operators import votes as vt
from tessera.sources import tables as tb


# ---------------------------------------------------------------- J3
def pairs(left, right):
    by_text = collections.defaultdict(list)
    for t, i in right:
        by_text[t].append(i)
    return sorted((t, w, i) for t, w in left for i in by_text[t])


def test_hot_texts_are_dealt_over_cells(spark):
    """One text holds a third of both sides; results are those of the plain join, and no cell of the
    grid has more than twice the rows of the median one."""
    left = [("hot", w) for w in range(600)] + [(f"t{w % 400}", w) for w in range(1200)] + [("gone", 1)]
    right = [("hot", i) for i in range(450)] + [(f"t{i % 450}", i) for i in range(900)] + [("only left", 0)]
    a = spark.createDataFrame(left, "text string, worker long").repartition(4)
    b = spark.createDataFrame(right, "text string, sentence_id long").repartition(4)
    got = vt.text_join(a, b, hot_rows=100)
    assert sorted((r.text, r.worker, r.sentence_id) for r in got.collect()) == pairs(left, right)
    assert got.columns == ["text", "worker", "sentence_id"]
    # the deal itself: 6 parts of the left side, 5 of the right
    cells = collections.Counter(r[0] for r in a.filter("text = 'hot'").select(
        F.pmod(F.xxhash64("text", "worker", F.xxhash64("text")), F.lit(6))).collect())
    sizes = sorted(cells.values())
    assert len(sizes) == 6 and sizes[-1] <= 2 * sizes[3]
    outer = vt.text_join(a, b, how="left", hot_rows=100).collect()
    missed = [(r.text, r.worker) for r in outer if r.sentence_id is None]
    assert sorted(missed) == [("gone", 1)] and len(outer) == len(pairs(left, right)) + 1


def test_retrieval_with_hot_texts_and_carriage_returns(spark):
    left = [("a\rb", w) for w in range(50)] + [(None, 1), ("c", 2)]
    right = [("ab", 1), ("a\rb", 2), ("c", 3), (None, 4)]
    results = spark.createDataFrame(left, "text string, worker long")
    pool = spark.createDataFrame(right, "pool_text string, sentence_id long")
    for hot in (10, 1000):
        got = sorted((r.text, r.worker, r.sentence_id) for r in vt.retrieve_ids(results, pool, hot_rows=hot).collect())
        assert got == sorted([("ab", w, i) for w in range(50) for i in (1, 2)] + [("c", 2, 3)])
        kept = vt.retrieve_ids(results, pool, how="left", hot_rows=hot).collect()
        assert len(kept) == 102 and [r.worker for r in kept if r.sentence_id is None] == [1]


# ---------------------------------------------------------------- A3
def test_chunked_lists_are_the_whole_multiset(spark):
    """A key with most rows is many short rows; chunks one after the other are the ordered list."""
    random.seed(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, random.choice([0, 1, 2, None])) for i in range(3000)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v int").repartition(5)
    out = ds.collect_chunks(df, ["k"], ["i"], "v", 64).collect()
    assert max(len(r["values"]) for r in out) == 64
    lists = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r.k, r.chunk)):
        lists[r.k] += r["values"]
    assert lists == {k: [v for a, _, v in sorted(rows, key=lambda r: r[1]) if a == k] for k in {r[0] for r in rows}}
    assert all(len(r["values"]) == 64 for r in out if r.k == "hot" and r.chunk < 31)
    assert ds.collect_chunks(df.limit(0), ["k"], ["i"], "v").collect() == []


# ---------------------------------------------------------------- M10
def test_batches_of_any_lengths(spark):
    rows = [(i, list(range(i % 9))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<long>").repartition(3)
    by_key = {r.doc_id: r for r in ds.padded_batches(df, "ids", ["doc_id"], batch_size=8, pad=0, bos=2, eos=3).collect()}
    by_order = {r.doc_id: r for r in ds.padded_batches(df, "ids", [F.col("doc_id")], batch_size=8, pad=0, bos=2, eos=3).collect()}
    for i, ids in rows:
        width = max(len(x) for j, x in rows if j // 8 == i // 8) + 2
        want = [2, *ids, 3] + [0] * (width - len(ids) - 2)
        for got in (by_key[i], by_order[i]):
            assert (got.batch_id, got.width, got.padded) == (i // 8, width, want)


def test_vocabulary_from_token_arrays(spark):
    """Distinct terms within the row give the ids that (document, term) counts give; empty and null
    token arrays and repeated rows of tokens count as documents of their own."""
    words = ["a", "b", "c", "d", "é", "zz"]
    rows = [(i, random.Random(i).choices(words[: 1 + i % 6], k=i % 7)) for i in range(60)] + [(60, []), (61, None), (62, ["b", "b"])]
    toks = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    want = {r.term: r.id for r in fe.vocabulary(fe.term_counts(toks)).collect()}
    df = collections.Counter(t for _, x in rows for t in set(x or []))
    assert want == {t: fe.RESERVED_IDS + k for k, t in enumerate(sorted(df, key=lambda t: (-df[t], t.encode())))}
    assert {r.term: r.id for r in fe.token_vocabulary(toks).collect()} == want
    assert fe.token_vocabulary(toks.limit(0)).count() == 0


def test_encoding_in_blocks_of_any_size(spark):
    """Ids in token order for every row: repeated, null and empty rows too, one text over many blocks' size."""
    rnd = random.Random(2)
    rows = [(i % 50, [rnd.choice("abcdefgh") for _ in range(i % 12)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, ["x"] * 5), (203, [rnd.choice("abxy") for _ in range(500)]), (None, ["a", "x", "b"]), (None, ["a", "x", "b"])]
    toks = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    vocab = spark.createDataFrame([(t, 4 + i) for i, t in enumerate("abcdefg")], "term string, id long")
    ids = {t: 4 + i for i, t in enumerate("abcdefg")}
    want = sorted((d is None, d or 0, [ids[t] for t in x or [] if t in ids]) for d, x in rows)
    for size in (1, 16, 1 << 18):
        got = fe.encode(toks, vocab, block_tokens=size).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in got) == want
    assert fe.encode(toks.limit(0), vocab).count() == 0
    assert {tuple(r.ids) for r in fe.encode(toks, vocab.limit(0)).collect()} == {()}


# ---------------------------------------------------------------- scan option
def test_scan_partitions_deal_text_tables(spark, tmp_path):
    """The option changes how rows lie, never which; other tables are left as they are scanned."""
    for name in ("documents", "events"):
        spark.range(500).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set(tb.SCAN_PARTITIONS, "6")
    try:
        sizes = [n for (n,) in tb.table(spark, str(tmp_path), "documents").groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(sizes) == 6 and sum(sizes) == 500 and max(sizes) < 2 * min(sizes)
        assert tb.table(spark, str(tmp_path), "documents").distinct().count() == 500
        assert tb.table(spark, str(tmp_path), "events").select(F.spark_partition_id()).distinct().count() == 1
    finally:
        spark.conf.unset(tb.SCAN_PARTITIONS)
    assert tb.table(spark, str(tmp_path), "documents").select(F.spark_partition_id()).distinct().count() == 1


# ---------------------------------------------------------------- S8
PAGE = """<!DOCTYPE html><html><head><title>The title</title><style>p{x:1}</style><script>var t="<p>no text at all here</p>";</script></head>
<body><!-- <p>a comment of many words that nobody should ever read in the text of any page</p> -->
<nav><ul><li><a href="/a">Home and more</a></li><li><a href="/b">News of the day</a></li></ul></nav>
<div class="ad">Buy this now</div>
<div class="content"><h2>A heading of some words</h2><div>The first paragraph has a good many words, and so it is &lt;long&gt; enough to be
kept as <b>text</b> of <a href="/x">this</a> page.</div><p>Second one, also with a good many words, to be sure that it counts as a block of text here.</p>
<div>Short line of the text.</div></div>
<div><a href="/1">One link with quite a few words in it so that its length is no reason</a> <a href="/2">and another link with words</a></div>
<footer>All rights</footer></body></html>"""


def test_pages_without_article_give_their_text(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "just some words with no tags " * 4),
                                   (5, "<article><p>Short</p></article><div>" + "other words " * 20 + "</div>")], "page_id long, html string")
    got = {r.article_id: r for r in lb.extract_pages(pages).collect()}
    assert got[1].title == "The title"
    text = got[1].paragraphs
    assert len(text) == 4 and text[0] == "A heading of some words" and text[3] == "Short line of the text."
    assert text[1].startswith("The first paragraph") and "<long> enough" in text[1] and text[1].endswith("of this page.")
    assert got[2].paragraphs is None or got[2].paragraphs == []
    assert got[3].paragraphs == [] and len(got[4].paragraphs) == 1
    assert got[5].paragraphs == ["Short"]
    blocks = {b["text"]: b for b in pages.filter("page_id = 1").select(lb.page_blocks(F.col("html")).alias("b")).first().b}
    assert blocks["Home and more"].link_share == 1 and not blocks["Home and more"].kept
    linked = next(b for t, b in blocks.items() if t.startswith("One link"))
    assert linked.link_share == 1 and not linked.kept
    assert not any("comment" in t or "var t" in t for t in blocks)


# ---------------------------------------------------------------- F1
def test_planted_abbreviations_are_learned(spark):
    random.seed(3)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lnrst"]
    starters, rows = ["The", "But", "When", "However"], []
    for i in range(400):
        sentences = []
        for _ in range(6):
            body = [random.choice(words) for _ in range(random.randrange(6, 12))]
            if random.random() < 0.5:
                at = random.randrange(1, len(body))
                body[at:at] = random.choice([["Dr.", "Smith"], ["approx.", "nine"], ["e.g.", "that"]])
            sentences.append(" ".join([random.choice(starters), *body]) + ".")
        rows.append((i, " ".join(sentences)))
    rows += [(1000, "The dr. But when. The Dr. Smith came."), (1001, None), (1002, "")]
    df = spark.createDataFrame(rows, "paper_id long, text string")
    known = corpus.abbreviations(df)
    found = {r.word for r in known.collect()}
    assert {"dr", "e.g"} <= found and not found & set(words)
    starts = corpus.sentence_starters(df, known)
    assert {r.word for r in starts.collect()} == {"the", "but", "when", "however"}
    got = collections.defaultdict(list)
    for r in sorted(corpus.learned_sentences(df, known, starts).collect(), key=lambda r: (r.paper_id, r.sent_no)):
        got[r.paper_id].append(r.text)
    assert got[1000] == ["The dr.", "But when.", "The Dr. Smith came."]
    whole = [t for i, t in rows[:400]]
    assert all(" ".join(got[i]) == t for i, t in enumerate(whole))
    ends = sum(len(got[i]) for i in range(400))
    assert ends == 2400 + sum(t.count("approx. ") for t in whole) * ("approx" not in found)
