import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import datasets as ds
from tessera.operators import experiments as xp
from tessera.operators import labelling as lb
from tessera.operators import pools
from tessera.operators import votes as vt
from tessera.sources import tables as tb

from conftest import SF_CHECK


def test_wawa_on_votes_fixture(spark):
    v = tb.votes(spark, SF_CHECK)
    w = vt.wawa(v)
    counts = {r.label: r.n for r in vt.label_distribution(w).collect()}
    assert counts == {0: 253, 1: 1330, 2: 498, 3: 1253}
    mv = vt.majority_vote(v).withColumnRenamed("label", "mv")
    assert w.join(mv, "task").filter(F.col("label") != F.col("mv")).count() == 594
    assert vt.unaligned_workers(v, w).count() == 28


def test_weighted_vote_equals_majority_with_equal_skills(spark):
    v = spark.createDataFrame([(1, 10, 2), (1, 11, 2), (1, 12, 3), (2, 10, 0), (2, 11, 1)],
                              "task long, worker long, label int")
    skills = spark.createDataFrame([(w, 0.5) for w in (10, 11, 12)], "worker long, skill double")
    assert sorted(vt.weighted_vote(v, skills).collect()) == sorted(vt.majority_vote(v).collect())
    # tie on task 2 -> smallest label
    assert {r.task: r.label for r in vt.majority_vote(v).collect()} == {1: 2, 2: 0}


def test_majority_or_median(spark):
    v = spark.createDataFrame([(1, 1), (1, 3), (1, 2), (2, 3), (2, 3), (2, 0), (3, 0), (3, 3)], "task long, label int")
    assert {r.task: r.label for r in vt.majority_or_median(v).collect()} == {1: 2, 2: 3, 3: 1}


def test_threshold_argument_is_honoured(spark):
    v = tb.votes(spark, SF_CHECK)
    w = vt.wawa(v)
    assert vt.unaligned_workers(v, w, threshold=0.0).count() == 0


def test_padding_unit_case(spark):
    df = spark.createDataFrame([(0, [17]), (1, [5, 19, 17]), (2, [17, 18])], "id long, ids array<int>")
    got = {r.id: (r.padded, r.width) for r in ds.padded_batches(df, "ids", ["id"], pad=0).collect()}
    assert got == {0: ([2, 17, 3, 0, 0], 5), 1: ([2, 5, 19, 17, 3], 5), 2: ([2, 17, 18, 3, 0], 5)}


def test_splits_disjoint_and_covering(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(500)], "id long, score int")
    s = ds.stratified_split(df, "id")
    assert s.count() == 500 and s.select("id").distinct().count() == 500
    c = {(r.score, r.split): r.n for r in s.groupBy("score", "split").agg(F.count("*").alias("n")).collect()}
    assert c[(0, "test")] == round(167 * 0.2) and c[(1, "test")] == round(167 * 0.2)
    o = {r.split: r.n for r in ds.ordered_split(df, ["id"]).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert o == {"test": 100, "val": 40, "train": 360}


def test_downsample_and_neighbours(spark):
    df = spark.createDataFrame([(i, 1) for i in range(10)] + [(10 + i, 3) for i in range(4)] + [(20, 0)],
                               "task long, score int")
    d = ds.downsample_majority(df, ["task"])
    assert sorted(r.task for r in d.filter("score = 1").collect()) == [0, 1, 2, 3]
    assert d.count() == 9
    rows = spark.createDataFrame([("train", 1, 5, "a"), ("train", 1, 6, "b"), ("train", 2, 7, "c"), ("val", 1, 8, "d")],
                                 "split string, paper_id long, task long, text string")
    got = {r.task: r.text for r in ds.neighbour_text(rows).collect()}
    assert got == {5: "a b", 6: "a b", 7: "c", 8: "d"}


def test_consensus_fractional(spark):
    df = spark.createDataFrame([(1, "-", ["neutral", "entailment"]), (2, "-", ["neutral", "neutral", "contradiction"]),
                                (3, "entailment", ["entailment"])], "pair_id long, gold_label string, annotator_labels array<string>")
    assert {r.pair_id: r.score for r in ds.consensus(df).collect()} == {1: 1.5, 2: 1.0, 3: 2.0}


def test_islands_fix_and_round_trip(spark):
    s = spark.createDataFrame([(1, 0, i, f"s{i}.", p) for i, p in enumerate([1, 0, 1, 1, 3])],
                              "article_id long, para_no int, sent_no int, text string, pred int")
    spans = sorted((r.run_no, r.pred, r.text) for r in lb.runs(s).collect())
    assert spans == [(1, 1, "s0."), (2, 0, "s1."), (3, 1, "s2. s3."), (4, 3, "s4.")]
    arts = spark.createDataFrame([(1, None, None)], "article_id long, title string, image_url string")
    html = lb.render(arts, lb.runs(s)).first().html
    assert '<p>\n<span class="green-background">s0.</span> s1. <span class="green-background">s2. s3.</span> ' \
           '<span class="red-background">s4.</span> \n</p>' in html
    assert "<title>Labeled text</title>" in html and "<h1>" not in html


def test_queue_and_gold(spark):
    sent = spark.createDataFrame([(0, i, f"t{i}") for i in range(6)], "paper_id long, sentence_id long, text string")
    q = pools.annotation_queue(sent, None)
    assert q.count() == 6
    marked = spark.createDataFrame([(2, 4)], "sentence_id long, score int")
    q = {r.sentence_id: (r.prev_context, r.next_context) for r in pools.annotation_queue(sent, marked).collect()}
    assert q == {3: ("t1 t2", "t4 t5"), 4: ("t2 t3", "t5"), 5: ("t3 t4", "")}
    gold = spark.createDataFrame([(1, 3), (2, 4), (2, 5)], "sentence_id long, score int")
    g = {r.sentence_id: (r.gold, r.n_gold) for r in pools.gold_lookup(sent, gold).collect()}
    assert g[1] == (3, 1) and g[2] == (None, 2) and g[0] == (None, 0)


def test_best_epoch_first_maximum(spark):
    log = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.7), (1, 3, 0.7), (1, 4, 0.6), (2, 1, 0.2)],
                                "run long, epoch long, f1 double")
    b = {r.run: (r.best_epoch, r.best_f1, r.last_epoch) for r in xp.best_epoch(log).collect()}
    assert b == {1: (2, 0.7, 4), 2: (1, 0.2, 1)}
    c = {r.run: r.delta for r in xp.compare_to_baseline(xp.best_epoch(log), 2).collect()}
    assert c[1] == pytest.approx(0.5)


def test_weighted_vote_rounds(spark):
    v = tb.votes(spark, SF_CHECK)
    one, two = vt.wawa(v, 1), vt.wawa(v, 2)
    assert two.count() == one.count() == v.select("task").distinct().count()
    assert two.select("label").distinct().count() <= 4


def test_pool_files_one_folder_per_pool(spark, tmp_path):
    from tessera.sources import files

    sent = spark.createDataFrame([(p, p * 10 + i, f"s{p}{i}.") for p in range(10) for i in range(3)],
                                 "paper_id long, sentence_id long, text string")
    pool = pools.pool_text(pools.assign_pools(sent))
    gold = spark.createDataFrame([(0, 4), (1, 2)], "sentence_id long, score int")
    out = str(tmp_path / "pools")
    pools.write_pools(pool, out, gold=gold, with_ids=True)
    back = files.read_csv(spark, out, "`INPUT:text` string, `GOLDEN:is_subjective` int, sentence_id long, pool string",
                          sep="\t")
    counts = {r.pool: r.n for r in back.groupBy("pool").agg(F.count("*").alias("n")).collect()}
    assert counts == {"honeypot": 9, "pilot": 15, "full": 6}
    g = {r.sentence_id: r["GOLDEN:is_subjective"] for r in back.collect()}
    assert g[0] == 4 and g[1] == 2 and g[2] is None
    assert back.filter(F.col("sentence_id") == 1).first()["INPUT:text"] == "s00. **s01.** s02."


def test_split_files_round_trip(spark, tmp_path):
    from tessera.sources import files

    df = spark.createDataFrame([(i, f'line "{i}"\nmore', float(i % 3)) for i in range(60)], "id long, text string, score double")
    s = ds.ordered_split(df, ["id"])
    out = str(tmp_path / "corpus")
    ds.write_splits(s, out)
    back = files.read_csv(spark, out, "text string, score double, split string")
    assert back.count() == 60
    assert back.filter("split = 'test'").count() == 12


def test_pre_aggregated_votes_equal_expanded_votes(spark):
    rows = [(1, 10, 2, 3), (1, 11, 1, 1), (1, 12, 1, 2), (2, 10, 0, 1), (2, 12, 3, 2), (3, 11, 3, 1)]
    agg = spark.createDataFrame(rows, "task long, worker long, label int, n long")
    expanded = spark.createDataFrame([(t, w, l) for t, w, l, n in rows for _ in range(n)],
                                     "task long, worker long, label int")
    assert sorted(vt.wawa(agg).collect()) == sorted(vt.wawa(expanded).collect())
    assert sorted(vt.worker_f1(agg, vt.wawa(agg)).collect()) == sorted(vt.worker_f1(expanded, vt.wawa(expanded)).collect())


def test_recode_text_keys(spark):
    df = spark.createDataFrame([("pos",), ("neg",), ("other",), (None,)], "s string")
    got = df.select(tx.recode("s", {"pos": 1, "neg": 0}).alias("x"))
    assert got.schema["x"].dataType.simpleString() == "int"
    assert [r.x for r in got.collect()] == [1, 0, None, None]
    ints = spark.createDataFrame([(2,), (9,)], "s int").select(tx.recode("s", {2: 1}).alias("x"))
    assert [r.x for r in ints.collect()] == [1, 9]


def test_label_histogram_counts_every_vote(spark):
    v = spark.createDataFrame([(1, 0), (1, 5), (1, None), (1, 3), (2, 4)], "task long, label int")
    got = {r.task: (r.n0, r.n3, r.n_other) for r in vt.label_histogram(v).collect()}
    assert got == {1: (1, 1, 2), 2: (0, 0, 1)}


def test_encode_keeps_token_free_documents(spark):
    from tessera.operators import features as fe

    t = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["z"])], "doc_id long, tokens array<string>")
    v = spark.createDataFrame([("a", 4), ("b", 5)], "term string, id long")
    assert {r.doc_id: r.ids for r in fe.encode(t, v).collect()} == {1: [5, 4, 5], 2: [], 3: []}


def test_consolidate_weights_repeated_texts(spark):
    """n * m votes on one row give the same labels as the many-to-many rows."""
    sent = spark.createDataFrame([(i, t, "d", "2018-07-01", 1) for i, t in enumerate(["s", "s", "s", "q", "q", "r"])],
                                 "sentence_id long, text string, domain string, date string, paper_id long")
    pool = sent.select(F.concat(F.lit("**"), "text", F.lit("**")).alias("pool_text"), "sentence_id")
    crowd = spark.createDataFrame(
        [("**s**", 1, 1), ("**s**", 1, 1), ("**s**", 2, 3), ("**q**", 2, 3), ("**q**", 1, 1), ("**q**", 3, 1),
         ("**r**", 3, 2), ("**none**", 3, 2)], "text string, worker long, label int")
    expert = spark.createDataFrame([(1, 1000, 3), (4, 1000, 3)], "task long, worker long, label int")
    mapped = vt.retrieve_ids(crowd, pool).select(F.col("sentence_id").alias("task"), "worker", "label")
    every = expert.unionByName(mapped).join(sent.select(F.col("sentence_id").alias("task"), "text"), "task")
    canon = vt.canonical_task(every)
    want = vt.wawa(every.join(canon, "text").select(F.col("canonical_task").alias("task"), "worker", "label"))
    got = vt.consolidate(expert, crowd, pool, sent)
    assert {(r.task, r.score) for r in got.collect()} == {(r.task, r.label) for r in want.collect()}


def test_html_shards_hold_every_article(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"<p>{i}</p>") for i in range(50)], "article_id long, html string")
    lb.write_html(docs.coalesce(2), str(tmp_path / "html"))
    assert spark.read.parquet(str(tmp_path / "html")).count() == 50
    assert len(list((tmp_path / "html").glob("part-*"))) <= 2
