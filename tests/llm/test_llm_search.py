"""Lexical search, Merkle manifest and license scan against brute force, and their odd rows."""

import collections
import random

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from tessera.llm import lexical, licenses, merkle
from tessera.llm.common import read_table
from tessera.llm.queries import Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


# ---------------------------------------------------------------- 11
def found(frame):
    return {(r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()}


@pytest.mark.parametrize("options", [{}, {"shard_docs": 7, "part_terms": 60}, {"shard_bytes": 3000}])
def test_search_scores_like_brute_force(spark, options):
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, SF, "documents").collect()]
    items = [r["text"] for r in read_table(spark, SF, "benchmark").collect()]
    frame = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = found(lexical.search(read_table(spark, SF, "documents").repartition(3), frame, **options))
    assert got == brute.ranked(docs, items)


def test_search_odd_rows(spark):
    """Ties, copies, shared and null ids, null and empty texts, other letters, clashing names."""
    rows = [(1, "a b c"), (2, "A-b C"), (2, "a b c"), (3, None), (4, ""), (None, "a b c"), (5, "ünder ÜNDER b"),
            (6, "x " * 5000 + "a"), (7, "--"), (8, "q7 q7 q7"), (9, "a b c d")] + [(100 + i, "hot words") for i in range(60)]
    items = ["a b c", "a a b", "hot", "", None, "zzz", "q7 ünder", "words hot hot x"]
    clash = ["q", "term", "ids", "at", "rank", "score"]
    docs = spark.createDataFrame([(*r, *["z"] * len(clash)) for r in rows],
                                 "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))
    asked = spark.createDataFrame([(i, t, "z") for i, t in enumerate(items)], "item_id long, text string, q string")
    for options in ({}, {"shard_docs": 2}):
        got = collections.Counter(map(tuple, lexical.search(docs, asked, **options).collect()))
        assert set(got) == brute.ranked(rows, items) and set(got.values()) == {1}
    twice = spark.createDataFrame([(1, "hot"), (1, "a b")], "item_id long, text string")
    assert lexical.search(docs, twice).count() == 10 + len([s for s in brute.ranked(rows, ["a b"])])
    assert lexical.search(docs.limit(0), asked).collect() == []
    assert lexical.search(docs, asked.limit(0)).collect() == []
    assert lexical.search(docs.filter("doc_id in (3, 4, 7)"), asked).collect() == []


def test_a_task_holds_one_shard_at_a_time(spark):
    """Shards of megabytes that share a file lie in row groups of their own."""
    docs = spark.createDataFrame([(i, f"a b c{i}") for i in range(12)], "doc_id long, text string").coalesce(1)
    shards = lexical.index(docs, shard_docs=2)
    assert shards.count() == 6
    groups = [m.row_group(i).num_rows for f in shards.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata]
              for i in range(m.num_row_groups)]
    assert groups == [1] * 6


def test_range_maxima_and_bounds():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 50, 300)
    table = lexical.RangeMaxima(values, 300)
    left = rng.integers(0, 299, 2000)
    right = left + 1 + (rng.random(2000) * (300 - left - 1)).astype(int)
    at = table(left, right)
    assert ((left <= at) & (at < right)).all()
    assert (values[at] == [values[a:b].max() for a, b in zip(left, right)]).all()


def test_search_leaves_most_documents_out(spark):
    """Of documents that a query's terms are in, few are scored one by one."""
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, "/root/testdata/sf0.01", "documents").collect()]
    batch = lexical._shard([i for i, _ in docs], [lexical.blanked(t) for _, t in docs])
    row = {c: batch.column(c)[0] for c in batch.schema.names}
    words, df = row["terms"].values, row["df"].values.to_numpy()
    n, total = row["docs"].as_py(), row["n_terms"].as_py()
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    x = lexical._Lists(row, words, weights, n, total)
    code, scored = {w: i for i, w in enumerate(words.to_pylist())}, 0
    items = [t for _, t in docs[:30] if t and len(t) < 600]
    for t in items:
        terms = collections.Counter(w for w in lexical.blanked(t).split())
        lists, times = x.pick(np.array([code[w] for w in terms]), np.array(list(terms.values())))
        scored += lexical._search(x, lists, times, lexical._Best(10), 8)
    assert scored < 0.6 * len(items) * len(docs)


# ---------------------------------------------------------------- 12
def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def proofs(frame, **options):
    where = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.proofs(merkle.manifest(frame, changed={"n_chars": F.col("n_chars") + 1}, where=where, **options))


@pytest.mark.parametrize("height", [1, 2, 3, 10])
def test_manifest_against_brute_force(spark, height):
    """Blocks of any height give the same tree; langs from one row to many, null among them."""
    random.seed(height)
    rows = [(i, random.choice(["s", None, ""]), random.choice(["en", "en", "en", "de", "é", None, f"l{i % 3}"]),
             random.choice([i, None]), random.choice(["", "x" * i, "日本", None])) for i in range(90)]
    rows += [(None, "s", "en", 1, "t"), (None, "s", "en", 1, "t"), (7, "s", "only", 1, "t"), rows[3], rows[3]]
    frame = spark.createDataFrame(rows, DOCS).withColumn("g", F.lit("z")).withColumn("pos", F.lit(1)).repartition(4)
    got = rows_of(proofs(frame, height=height))
    assert got == sorted(brute.merkle(rows), key=repr)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_small_tables(spark):
    for rows in ([], [(14, "s", "en", 1, "t")], [(1, None, None, None, None)], [(i, "s", "en", 1, "t") for i in range(3)],
                 [(1, "s", "en", 1, "t"), (2, "s", "de", 1, "t")]):
        got = rows_of(proofs(spark.createDataFrame(rows, DOCS)))
        assert got == sorted(brute.merkle(rows), key=repr)


def test_versions_share_what_they_do_not_copy():
    """A version's copies and the base nodes beside them are the tree of the changed rows."""
    for n in (1, 2, 5, 8, 13):
        leaves = [merkle.digest(str(i)) for i in range(n)]
        base = merkle.Block(leaves, n)
        before = [list(x) for x in base.levels]
        for i in range(n):
            new = [*leaves[:i], merkle.digest("new"), *leaves[i + 1:]]
            whole = merkle.Block(new, n)
            copied = base.version(i, new[i])
            assert [x[i >> j + 1] for j, x in enumerate(whole.levels[1:])] == copied
            for j, level in enumerate(whole.levels):
                assert [x for p, x in enumerate(level) if p != i >> j] == [x for p, x in enumerate(base.levels[j]) if p != i >> j]
        assert base.levels == before


def test_copied_root_is_the_folded_root(spark):
    docs = read_table(spark, SF, "documents")
    built = merkle.manifest(docs, changed={"text": F.lit("other")}, where=F.col("doc_id") % 3 == 0, height=4)
    rows = built.withColumn("f", merkle.fold(F.coalesce("changed_leaf", "leaf"), F.col("siblings"), F.col("turns"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["copied"] is None) == (r["doc_id"] % 3 != 0)
        assert r["f"] == (r["copied"][-1] if r["copied"] else r["root"])
        if r["copied"]:
            assert len(r["copied"]) == len(r["siblings"]) and r["f"] != r["root"]


# ---------------------------------------------------------------- 13
def garbled(text, edits):
    out = list(text)
    for _ in range(edits):
        i, kind = random.randrange(len(out)), random.randrange(3)
        if kind == 0:
            out[i] = random.choice("abcdefgh")
        elif kind == 1:
            out.insert(i, random.choice("xyz"))
        elif len(out) > 1:
            del out[i]
    return "".join(out)


def test_seeds_miss_no_match():
    """Every notice within its edits is found, at any place, and labels are those of the
    bounded-error pattern on whole texts."""
    random.seed(2)
    scanner, filler = licenses.Scanner(), "lorem ipsum dolor sit amet permission general all version".split()
    hits = 0
    for _ in range(1500):
        parts = [random.choice(filler) for _ in range(random.randrange(12))]
        for notice in random.sample(licenses.NOTICES, random.randrange(3)):
            parts.insert(random.randrange(len(parts) + 1), garbled(notice.text, random.randrange(notice.edits + 2)))
        words = brute.plain_terms(" ".join(parts))
        text = " " + " ".join(words) + " "
        got = {(p[0], p[4]) for p in scanner.places(words) if not p[1]}
        for notice, pattern in zip(scanner.notices, scanner.patterns):
            m = pattern.search(text)
            if m and set(notice.needs) <= set(m.group().split()):
                hits += 1
                assert any(x == notice.label and e <= sum(m.fuzzy_counts) for x, e in got), (text, notice)
        assert {x for x, _ in got} <= {n.label for n, p in zip(scanner.notices, scanner.patterns) if p.search(text)}
    assert hits > 500


def test_scan_spans_and_base(spark):
    texts = ["Released under the  MIT-License. See", "UNDER THE MIT LICENSE under the mit license!", "cc-by-nc cc by nc 4.0", None, "",
             "Licenced under teh Apache License, Version 2.0.", "Licensed under the Apache Licence, version 1.1", "x" * 50_000,
             "All right reserved", "under the mit licenses", "Ünder the mit license", "general reserved rights of all",
             "under the mit license " * 2000, "Gnu Generl Public License, version 3", "Gnu General Public License, version 9"]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, texts[0], "z"), (0, texts[0], "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, places string")
    scanned = licenses.scan(frame)
    got = collections.defaultdict(list)
    for r in scanned.collect():
        got[r["doc_id"]].append(r)
    assert len(got[0]) == 2 and len(got[None]) == 1 and got[0][0] == got[0][1]
    for i, t in enumerate(texts):
        r = got[i][0]
        assert r["n_words"] == len(brute.plain_terms(t))
        base = sorted((p["label"], p["first_word"], p["last_word"]) for p in r["places"] if p["base"])
        assert base == brute.phrase_places(t, licenses.PHRASES)
        for p in r["places"]:
            inside = brute.plain_terms(t[p["start"]:p["end"]])
            assert inside == brute.plain_terms(t)[p["first_word"]:p["last_word"] + 1]
            assert len(t[p["start"]:p["end"]].strip(" .,!-")) == p["end"] - p["start"]
    out = {r["doc_id"]: r for r in licenses.digest(scanned).collect()}
    assert [out[i]["labels"] for i in range(len(texts))] == [
        "mit", "mit", "cc-by-nc", "", "", "apache-2", "", "", "all-rights-reserved", "", "", "", "mit", "", ""]
    assert out[1][2:5] == (2, 0, 4) and out[3][1:5] == (0, 0, None, None) and out[5]["base_labels"] == "apache-2"
    assert out[0]["score"] == 1 and out[3]["score"] == 0 and 0.9 < out[8]["score"] < 1
    assert licenses.scan(frame.limit(0)).collect() == []


def test_license_query_on_the_corpus(spark):
    """Every base place is found; every other label has a pattern match in the whole text."""
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, SF, "documents").collect()}
    patterns = [(n.label, regex.compile(f"(?: {n.text} ){{e<={n.edits}}}")) for n in licenses.NOTICES]
    for r in Q["op13_licenses"](spark, SF).collect():
        t = texts[r["doc_id"]]
        base = brute.phrase_places(t, licenses.PHRASES)
        assert r["n_base"] == len(base) and r["base_labels"] == ",".join(sorted({b[0] for b in base}))
        assert (r["first_word"], r["last_word"]) == ((min(b[1] for b in base), max(b[1] for b in base)) if base else (None, None))
        more = set(filter(None, r["labels"].split(","))) - {b[0] for b in base}
        text = " " + " ".join(brute.plain_terms(t)) + " "
        assert all(any(label == x and p.search(text) for x, p in patterns) for label in more)
