import json

import pytest

from pyspark.sql import functions as F

from tessera.sources import files


def test_tsv_pool_with_hints(spark, tmp_path):
    rows = [(f'text {i} "quoted"\nsecond line', i % 6, f"hint\t{i}") for i in range(16)]
    names = "`INPUT:text` string, `GOLDEN:is_subjective` int, `HINT:text` string"
    files.write_delimited(spark.createDataFrame(rows, names).coalesce(1), str(tmp_path / "pool"), sep="\t")
    got = files.read_csv(spark, str(tmp_path / "pool"), names, sep="\t").collect()
    assert sorted(map(tuple, got)) == sorted(rows)


REGISTRY = {"main-task": {"data-dir": "datasets/one", "type": "classification", "num-labels": 4},
            "additional-tasks": [{"data-dir": "datasets/two", "type": "classification", "num-labels": 2},
                                 {"data-dir": "datasets/three", "type": "regression", "num-labels": 1}]}


def test_registry(spark, tmp_path):
    p, single = tmp_path / "tasks.json", tmp_path / "single.json"
    p.write_text(json.dumps(REGISTRY, indent=2))
    single.write_text(json.dumps({"main-task": REGISTRY["main-task"]}))
    rows = sorted((r.role, r.type, r.num_labels) for r in files.read_registry(spark, str(p)).collect())
    assert rows == [("additional", "classification", 2), ("additional", "regression", 1), ("main", "classification", 4)]
    assert files.read_registry(spark, str(single)).count() == 1
    assert [t["name"] for t in files.registry_entries(str(p))] == ["one", "two", "three"]
    assert len(files.registry_entries(str(single))) == 1


def test_positional_latin1_tsv(spark, tmp_path):
    p = tmp_path / "sts.tsv"
    lines = ["a\tb\tc\td\t3.5\tCafé \"x\"\tnaïve\textra", "a\tb\tc\td\t0\tone\ttwo"]
    p.write_bytes(("\n".join(lines) + "\n").encode("latin-1"))
    got = sorted((r.text, r.score) for r in files.read_positional_tsv(spark, str(p)).collect())
    assert got == [("Café x naïve", 3.5), ("one two", 0.0)]


def test_jsonl_pairs_and_class_files(spark, tmp_path):
    p = tmp_path / "pairs.jsonl"
    p.write_text("\n".join(json.dumps(o) for o in [
        {"gold_label": "-", "annotator_labels": ["neutral", "entailment"], "sentence1": "a", "sentence2": "b"},
        {"gold_label": "neutral", "annotator_labels": ["neutral"], "sentence1": "c", "sentence2": "d"}]))
    assert files.read_pair_jsonl(spark, str(p)).filter(F.size("annotator_labels") == 2).count() == 1
    obj, subj = tmp_path / "obj.txt", tmp_path / "subj.txt"
    obj.write_bytes(" plot one \nplot two\n".encode("latin-1"))
    subj.write_bytes("quote é\n".encode("latin-1"))
    df = files.read_class_files(spark, [(str(obj), 1), (str(subj), 0)])
    assert sorted((r.text, r.score) for r in df.collect()) == [("plot one", 1.0), ("plot two", 1.0), ("quote é", 0.0)]


def test_csv_roundtrip_and_append(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"\nnext line'), (2, "plain")], "sentence_id int, text string")
    out = str(tmp_path / "out")
    files.write_delimited(df, out, sep="\t")
    back = files.read_csv(spark, out, "sentence_id int, text string", sep="\t")
    assert sorted(back.collect()) == sorted(df.collect())
    store = str(tmp_path / "store")
    files.append_rows(df.limit(1), store)
    files.append_rows(df.filter("sentence_id = 2"), store)
    assert spark.read.parquet(store).count() == 2


def test_text_article_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("First “line”\n\n  second \n \nthird\n", encoding="utf-8")
    arts = files.read_text_articles(spark, str(tmp_path))
    assert arts.first().paragraphs == ['First "line"', "second", "third"]


def test_missing_store_counts_as_empty(spark, tmp_path):
    from tessera.operators import pools

    sent = spark.createDataFrame([(0, i, f"t{i}") for i in range(4)], "paper_id long, sentence_id long, text string")
    store = str(tmp_path / "store")
    assert files.read_store(spark, store) is None
    assert pools.annotation_queue(sent, files.read_store(spark, store)).count() == 4
    files.append_rows(spark.createDataFrame([(1, 5)], "sentence_id long, score int"), store)
    assert sorted(r.sentence_id for r in pools.annotation_queue(sent, files.read_store(spark, store)).collect()) == [2, 3]


def quoted_csv(path, rows, newline="\n", last=True):
    """A headed CSV file as any writer makes it, with quotes only where needed."""
    import csv
    import io

    out = io.StringIO()
    w = csv.writer(out, lineterminator=newline)
    w.writerow(["id", "text", "n"])
    w.writerows(rows)
    data = out.getvalue()
    path.write_bytes((data if last else data[:-len(newline)]).encode())


@pytest.mark.parametrize("split_bytes", [7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_csv_in_splits_is_the_whole_file(spark, tmp_path, split_bytes, newline):
    """Fields with line breaks, quotes and separators, records longer than many splits, several
    files, no break at the end: the rows of a reader that sees each file whole."""
    rows = [(1, "plain", 1), (2, "two\nlines", 2), (3, 'a "quoted" word', 3), (4, "x\n" * 40 + '"', 4), (5, "", 5), (6, "a,b", None),
            (7, '"\n"\n""', 7), (8, "é日本\n", 8), (9, "end", 9)]
    (tmp_path / "d").mkdir()
    quoted_csv(tmp_path / "d" / "one.csv", rows, newline, last=False)
    quoted_csv(tmp_path / "d" / "two.csv", rows[::-1], newline)
    quoted_csv(tmp_path / "d" / "header.csv", [], newline)
    schema = "id long, text string, n int"
    got = files.read_csv_splits(spark, str(tmp_path / "d"), schema, split_bytes=split_bytes)
    want = files.read_csv(spark, str(tmp_path / "d"), schema)

    def lines(df):
        return sorted(((r.id, (r.text or "").replace("\r\n", "\n"), r.n) for r in df.collect()), key=str)

    assert lines(got) == lines(want) and len(lines(got)) == 18
    assert got.schema == want.schema


def test_csv_in_splits_uses_many_tasks(spark, tmp_path):
    (tmp_path / "big.csv").parent.mkdir(exist_ok=True)
    quoted_csv(tmp_path / "big.csv", [(i, f"row {i}\nof\nlines" * (i % 5), i) for i in range(5000)])
    source = spark.newSession()
    source.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    assert source.read.text(str(tmp_path / "big.csv")).rdd.getNumPartitions() > 5
    got = files.read_csv_splits(spark, str(tmp_path / "big.csv"), "id long, text string, n int", split_bytes=20_000)
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == 5000 and all((r.text or "") == f"row {i}\nof\nlines" * (i % 5) and r.n == i for i, r in rows.items())


def test_document_store_by_id(spark, tmp_path):
    docs = [(i, "é" * i + f"\ndoc {i}") for i in range(300)] + [(300, ""), (301, None), (302, "x" * 5000), (7, "again")]
    df = spark.createDataFrame(docs, "article_id long, html string").repartition(4)
    path = str(tmp_path / "store")
    files.write_documents(df, path, shard_bytes=2000)
    assert spark.read.parquet(f"{path}/shards").count() > 20
    everything = sorted((r.id, r.text) for r in files.read_documents(spark, path).collect())
    assert everything == sorted((i, t) for i, t in docs if t is not None)
    ids = spark.createDataFrame([(7,), (300,), (301,), (999,), (7,)], "id long")
    some = sorted((r.id, r.text) for r in files.read_documents(spark, path, ids).collect())
    assert some == [(7, "again"), (7, "é" * 7 + "\ndoc 7"), (300, "")]
    files.write_documents(df.limit(0), path)
    assert files.read_documents(spark, path).collect() == []


def test_registered_splits_are_read_by_folder(spark, tmp_path):
    import json

    from tessera.operators import datasets as ds

    registry = {"main-task": {"data-dir": "data/a", "type": "classification", "num-labels": 2},
                "additional-tasks": [{"data-dir": "data/b", "type": "regression", "num-labels": 1}]}
    (tmp_path / "tasks.json").write_text(json.dumps(registry, indent=1))
    rows = [("train", " two\nlines ", 1.0), ("val", 'say "x", y', 0.0), ("test", "plain", 0.25), ("train", "b", 3.5)]
    for folder in ("a", "b"):
        ds.write_splits(spark.createDataFrame(rows, "split string, text string, score double"), str(tmp_path / "data" / folder))
    parts = files.registered_parts(spark, str(tmp_path / "tasks.json"), str(tmp_path))
    assert [p[0]["name"] for p in parts] == ["a", "b"]
    whole = ds.multitask_corpus(parts)
    got = sorted((r.task_name, r.split, r.text, r.score, r.valid) for r in whole.collect())
    assert got == sorted((t, *r, t == "b" or r[2] in (0.0, 1.0, 0.25)) for t in "ab" for r in rows)
    only = files.registered_parts(spark, str(tmp_path / "tasks.json"), str(tmp_path), ("val",))[0][1]
    assert [r.text for r in only.collect()] == ['say "x", y']
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan or "PartitionFilters: [(split" in plan or "split#" in plan.split("PartitionFilters")[1][:80]
