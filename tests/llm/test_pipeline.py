"""The pipeline against brute-force stages, and odd rows in every stage."""

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, quality
from tessera.llm.common import boundary, read_table

SF = "/root/testdata/sf0.001"


def twin(docs, sql, folder):
    """What DuckDB's SQL gives on the rows of a stage."""
    docs.write.parquet(str(folder))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{folder}/*.parquet')")
    return con.sql(sql)


def test_stages_against_brute_force(spark, tmp_path):
    """Rows of every stage from the rows of the one before."""
    docs, rows = read_table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = boundary(stage(spark, docs, SF))
        rows[name] = got = {r["doc_id"]: r for r in out.collect()}
        if name == "quality rules":
            kept = {r[0] for r in twin(docs, quality.SQL, tmp_path / "q").filter("kept").fetchall()}
            assert set(got) == kept and all(got[i] == before[i] for i in got)
            for i in got:
                n, *_, rep = brute.base_quality(before[i]["text"])
                assert n >= 50 and 100 * rep <= 50 * n
        elif name == "line dedup":
            want = brute.cut_lines({i: r["text"] for i, r in before.items()})
            assert {i: r["text"] for i, r in got.items()} == want
            assert all(r["n_chars"] == len(r["text"]) for i, r in got.items() if r["text"] != before[i]["text"])
        elif name == "near duplicates":
            ids = sorted(before)
            roots = brute.components([brute.fingerprint(before[i]["text"]) for i in ids])
            assert set(got) == {ids[r] for r in roots}
        elif name == "mixing":
            assert set(got) == {r[0] for r in twin(docs, mixing.SQL, tmp_path / "m").filter("sampled").fetchall()}
        else:
            library = brute.library_encoder()
            assert set(got) == set(before)
            for i, r in got.items():
                assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == brute.digests(library, before[i]["text"])
        docs = out
    final = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert final == rows[corpus_pipeline.STAGES[-1][0]]


@pytest.mark.parametrize("number", range(5))
def test_odd_rows(spark, number):
    name, stage = corpus_pipeline.STAGES[number]
    rows = [(1, "a b\nc", None, None, 5), (None, None, "en", "src0", None), (2, "", "en", "src0", 0),
            (2, "", "en", "src0", 0), (3, ("good the of " * 3000 + "\n") * 3, "xx", "yy", 3)]
    clashing = ["word", "n", "_q", "_words", "_id", "_group", "_cell", "_sampled", "topic", "_n_lines", "_text_hash", "row"]
    df = spark.createDataFrame([(*r, *["z"] * len(clashing)) for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, "
                               + ", ".join(f"{c} string" for c in clashing))
    got = stage(spark, df, SF)
    assert got.count() <= len(rows)
    if number < 4:
        assert got.columns == df.columns
        assert all(r[c] == "z" for r in got.collect() for c in clashing)
    assert stage(spark, df.filter(F.lit(False)), SF).collect() == []
