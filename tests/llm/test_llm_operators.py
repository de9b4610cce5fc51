"""Each operator against brute force, and its defined results for odd rows."""

import collections
import gzip
import io
import random
import zlib

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, line_dedup, lm, mixing, quality, simhash, token_counts, topk, warc
from tessera.llm.common import boundary, read_table
from tessera.llm.components import components

SF = "/root/testdata/sf0.001"
random.seed(5)
ODD = ["", "a" * 3000, "aaaa bbbb  \n\n  ", "日本語テキスト" * 50, "<|endoftext|>x<|endoftext|>", "   ", "é" * 999,
       "'s'll we're I'D", "".join(random.choice("abcdefgh \n'1é日") for _ in range(20_000)),
       "".join(random.choice("etaoinshr") for _ in range(5_000)), " " * 500, "\x00\x01", None, "x y", "x y"]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 12 else i, t, i, "n", "w") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, word string, fp string")


# ---------------------------------------------------------------- 3 and 4
def test_token_counts(spark, texts, odd):
    library = brute.library_counter()

    def expect(t):
        return len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)

    for r in token_counts.token_counts(read_table(spark, SF, "documents")).collect():
        assert (r["n_bytes"], r["n_tokens"]) == expect(texts[r["doc_id"]])
        assert r["over_limit"] == (r["n_tokens"] > 512)
    got = token_counts.token_counts(odd, keep=("doc_id", "n", "word")).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert (r["n_bytes"], r["n_tokens"]) == expect(ODD[r["n"]])
    assert token_counts.token_counts(odd.limit(0)).collect() == []


def test_bpe_round_trip(spark, texts, odd):
    library = brute.library_encoder()
    for r in bpe.round_trip(read_table(spark, SF, "documents"), block_bytes=100_000).collect():
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == brute.digests(library, texts[r["doc_id"]])
    ids = bpe.encode(odd, keep=("n", "word"))
    assert {r["n"]: list(r["ids"]) for r in ids.collect()} == {
        i: library.encode_ordinary(t or "") for i, t in enumerate(ODD)}
    for r in bpe.decode(ids).collect():
        assert bytes(r["decoded"]) == (ODD[r["n"]] or "").encode()
    assert bpe.round_trip(odd.limit(0)).collect() == []


# ---------------------------------------------------------------- 10
def test_simhash_components(spark, texts):
    got = simhash.near_duplicates(read_table(spark, SF, "documents")).collect()
    ids = sorted(texts)
    prints = [brute.fingerprint(texts[i]) for i in ids]
    root = {i: ids[r] for i, r in zip(ids, brute.components(prints))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {
        i: (f"{p:016x}", root[i]) for i, p in zip(ids, prints)}


@pytest.mark.parametrize("bucket_rows", [20_000, 40])
def test_simhash_links_of_dense_groups(spark, bucket_rows):
    rng = np.random.default_rng(0)
    prints = set()
    for centre in rng.integers(0, 2**63, 6):
        for _ in range(120):
            x = int(centre)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, bucket_rows))
    root = {r["node"]: r["root"] for r in found.collect()}
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for i, (s, k) in enumerate(zip(signed, brute.components(prints))):
        got[root.get(s, s)].add(i)
        want[k].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_in_few_files(spark):
    cores = spark.sparkContext.defaultParallelism
    conf = {"spark.sql.shuffle.partitions": str(8 * cores), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    links = boundary(spark.range(3000).selectExpr("id AS a", "id - id % 30 AS b"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = components(links)
        assert {r["node"]: r["root"] for r in found.collect()} == {i: i - i % 30 for i in range(3000)}
        assert len(found.inputFiles()) <= cores
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_simhash_odd_rows(spark, odd):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "A b\tc d e"), (None, "a b c d e"), (None, None), (None, ""),
                                (5, "x"), (5, "x")], "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [
        (0, 0), (0, 0), (0, 1), (1, 1), (2, 1), (5, 5), (5, 5)]
    kept = simhash.one_of_each(df).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 5]
    assert simhash.near_duplicates(df.limit(0)).collect() == [] and simhash.one_of_each(df.limit(0)).collect() == []
    assert simhash.one_of_each(odd).columns == odd.columns
    assert simhash.near_duplicates(odd).count() == len(ODD)


# ---------------------------------------------------------------- 9
def test_quality_counts(spark, texts, odd):
    for r in quality.quality(read_table(spark, SF, "documents")).collect():
        n, wc, sym, dup, rep = brute.base_quality(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            n, wc, sym, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (r["kept"] and r["base_failed"])
    rows = odd.withColumn("lang", F.lit(None).cast("string"))
    for r in quality.quality(rows, keep=("n",)).collect():
        assert r["n_words"] == len(brute.words(ODD[r["n"]]))
    assert quality.quality(rows.limit(0)).collect() == []
    assert quality.kept_documents(rows).columns == rows.columns


def test_quality_keeps_clean_drops_noise(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    labels = read_table(spark, "/root/testdata/sf0.01", "labels")
    r = {(x["quality"], x["kept"]): x["count"] for x in quality.quality(docs).filter("not base_failed")
         .join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert r.get((1, False), 0) <= 0.01 * r[(1, True)]
    assert r.get((0, True), 0) <= 0.2 * (r.get((0, True), 0) + r[(0, False)])


def with_rare_languages(spark):
    """The corpus with three Spanish copies: a language of a few hundred documents, one
    of ten, and none at all."""
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    labels = read_table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "quality")
    es = docs.filter("lang = 'es'").join(labels, "doc_id").drop("lang")
    rows = [es.withColumn("lang", F.lit("r1")), es.withColumn("lang", F.lit(None).cast("string")),
            es.filter("quality = 1 and length(text) < 2000").orderBy("doc_id").limit(10).withColumn("lang", F.lit("r2"))]
    big = docs.filter("lang <> 'es'").withColumn("quality", F.lit(-1))
    for r in rows:
        big = big.select("doc_id", "text", "lang", "quality").unionByName(r)
    return big


def test_quality_keeps_clean_rare_languages(spark):
    big = with_rare_languages(spark)
    out = quality.quality(big, keep=("lang", "quality")).filter("quality >= 0 and not base_failed").collect()
    clean = collections.Counter((r["lang"], r["kept"], r["word_js"] is None) for r in out if r["quality"] == 1)
    assert set(clean) == {("r1", True, False), ("r2", True, False), (None, True, True)}
    noise = [r["kept"] for r in out if r["quality"] == 0 and r["lang"] == "r1"]
    assert sum(noise) <= 0.2 * len(noise)


def test_quality_twin_on_rare_null_and_copied_rows(spark, tmp_path):
    """The SQL twin gives the same rows, with near copies of a Spanish document, a text
    with a third of all rows, and null, empty and repeated rows as well."""
    big = with_rare_languages(spark).drop("quality")
    near = (read_table(spark, "/root/testdata/sf0.01", "documents").filter("doc_id = 221")
            .select((F.col("doc_id") * 10_000).alias("d"), "text").crossJoin(spark.range(96))
            .select((F.col("d") + F.col("id")).alias("doc_id"), F.concat("text", F.lit(" z"), "id").alias("text"),
                    F.lit("es").alias("lang")))
    hot = spark.range(600).select((F.col("id") + 10**9).alias("doc_id"), F.lit("una casa de la vida " * 30).alias("text"),
                                  F.lit("r1").alias("lang"))
    odd = spark.createDataFrame([(-1, None, "r3"), (-2, "", "r3"), (-3, "solo", "r4"), (-4, None, None)],
                                "doc_id long, text string, lang string")
    rows = big.unionByName(near).unionByName(hot).unionByName(odd)
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = quality.quality(read_table(spark, str(tmp_path), "documents")).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(quality.SQL).df()[list(got.columns)]

    def lines(frame):
        return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))

    assert lines(got) == lines(want)
    assert got["kept"].sum() > 500


def test_quality_references_bear_copies(spark):
    """Copies of one clean document with a third of its language's rows and words."""
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang").filter("lang = 'es'")
    labels = read_table(spark, "/root/testdata/sf0.01", "labels").filter("quality = 1")
    clean = docs.join(labels, "doc_id").select("doc_id", "text", "lang").filter("size(split(text, ' ')) between 100 and 250")
    rows = docs.count()
    plain = quality.quality(docs).filter("kept").join(labels, "doc_id").count()
    for one in clean.orderBy("doc_id").limit(3).collect():
        copies = max(rows // 2, int(docs.agg(F.sum(F.length("text"))).first()[0]) // (2 * len(one["text"])))
        more = spark.range(copies).select((-1 - F.col("id")).alias("doc_id"), F.lit(one["text"]).alias("text"),
                                          F.lit("es").alias("lang"))
        out = quality.quality(docs.unionByName(more)).filter("kept").select("doc_id")
        assert out.join(labels, "doc_id").count() >= plain
        assert out.filter("doc_id < 0").count() == copies
    counts = {r["word"]: r["n"] for r in quality.word_counts(spark.createDataFrame(
        [("a b a", None)] * 90 + [("c d", None)] * 8, "text string, lang string"), "text", "lang").collect()}
    assert counts == {"a": 2, "b": 1, "c": 1, "d": 1}


@pytest.mark.parametrize("shifts", [1, 8])
def test_slots_find_every_word_of_any_vocabulary(spark, shifts):
    """1,000 random vocabularies of 16 to 4,096 words: each word has a place or is an extra."""
    width, sizes = 1024, np.exp(np.random.default_rng(3).uniform(np.log(16), np.log(4096), 1000)).astype(int)
    words = (spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "lang long, size long")
             .select("lang", F.explode(F.sequence(F.lit(1), "size")).alias("n"))
             .select("lang", F.xxhash64("lang", "n").alias("h"), F.col("n")))
    table = boundary(quality.slotted(words, width, shifts))
    assert table.count() == 1000
    at = quality.place(F.col("h"), F.col("shift"), width)
    kept = F.element_at("kept", at)
    own = kept.isNotNull() & (kept["h"] == F.col("h")) & (kept["n"] == F.col("n"))
    extra = F.exists("extra", lambda x: (x["h"] == F.col("h")) & (x["n"] == F.col("n")))
    found = words.join(table, "lang").select("lang", own.alias("own"), extra.alias("extra"))
    assert found.filter(F.col("own") == F.col("extra")).isEmpty()
    counts = table.select(F.sum(F.size("kept") + F.size("extra"))).first()[0]
    assert counts == sizes.sum()


def test_quality_extra_words_change_nothing(spark):
    """One shift leaves many words as extras; the distances stay the same."""
    docs = read_table(spark, SF, "documents").select("doc_id", "text", "lang")
    got = [{r["doc_id"]: tuple(r["q"]) for r in quality.judge(docs, quality.references(docs, shifts=n), out="q")
            .select("doc_id", "q").collect()} for n in (1, 48)]
    assert got[0] == got[1]
    assert quality.references(docs, shifts=1).filter(F.size("extra") > 0).count()


# ---------------------------------------------------------------- 7
def test_lm_against_exact_counts(spark, texts):
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    marked = docs.withColumn("train", ~lm.held_out(F.col("doc_id")))
    got = {r["doc_id"]: r for r in lm.score(marked, block_bytes=100_000).collect()}
    ids = sorted(texts)
    rows = [(texts[i], zlib.crc32(str(i).encode()) % 7 != 2) for i in ids]
    want = brute.lm_scores(rows, lm.MU, lm.level_count)
    total = 0.0
    for i, k in enumerate(ids):
        n, known, train, base, exact = want[i]
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] >= exact - 1e-6  # the filter has no false negative
        total += r["score"] - exact
    assert total / sum(w[0] for w in want.values()) < 0.02  # few false positives
    parts = {r["doc_id"]: r["score"] for r in lm.score(marked, part_bytes=5_000, shard_bits=5).collect()}
    whole = {r["doc_id"]: r["score"] for r in lm.score(marked, shard_bits=5).collect()}
    assert parts == pytest.approx(whole)


def test_lm_names_and_part_sizes(spark, odd):
    """Columns named like working ones stay; parts are the fewest equal ranges that fit."""
    clash = ["_t", "_train", "_place", "_part", "k0", "block", "slot"]
    df = odd.select(F.col("n").alias("doc_id"), "text", *[F.lit(c).alias(c) for c in clash]).withColumn("train", F.lit(True))
    got = lm.score(df, keep=("doc_id", *clash), shard_bits=3, part_bytes=200).collect()
    assert len(got) == len(ODD) and all(r[c] == c for r in got for c in clash)
    plain = {r["doc_id"]: r["score"] for r in lm.score(df).collect()}
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(plain, abs=1.0)
    shards = spark.createDataFrame([(i, 10) for i in range(8)], "shard long, size long")
    assert [lm._part_bits(shards, n, 3) for n in (80, 79, 40, 39, 20, 10, 1)] == [0, 1, 1, 2, 2, 3, 3]


def test_many_buckets(spark, texts):
    """More buckets than 16 bits number."""
    docs = read_table(spark, SF, "documents").limit(60)
    library = brute.library_encoder()
    got = bpe.round_trip(docs, slots=70_001).collect()
    assert len(got) == 60
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == brute.digests(library, texts[r["doc_id"]])


def test_lm_odd_rows(spark, odd):
    df = spark.createDataFrame([(1, None, True), (None, "A b", False), (2, "", None), (2, "a b a b" * 500, True)],
                               "doc_id long, text string, train boolean")
    got = lm.score(df).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 3, 1502]
    assert lm.score(df.limit(0)).collect() == []
    assert {r["score"] for r in lm.score(df.withColumn("train", F.lit(False))).collect()} == {0.0}
    assert lm.score(odd.withColumn("train", F.lit(True)), keep=("doc_id", "n", "word")).count() == len(ODD)


# ---------------------------------------------------------------- 8
def test_top_k(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)) * rng.exponential(1, size=(1500, 1))
    x[100:400] = x[100]  # ties
    x = x.astype(np.float32)
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    rows += [(-50, [9.0] * 16), (5150, [1.0, 2.0])]
    good = {**dict(rows), 5250: []}  # an empty vector is a zero vector
    rows += [(None, [1.0]), (5000, None), (5050, [float("nan")] * 16), (5100, [None] * 16), (5150, [1.0, 2.0]),
             (5200, [float("inf")]), (5250, [])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<float>, id string")
    for sizes in ({}, {"block": 100, "query_block": 8, "seeds": 10}):
        assert {tuple(r) for r in topk.search(df, **sizes).collect()} == brute.top_k(good)
    assert topk.search(df.limit(0)).collect() == []
    assert topk.search(df.filter("vec_id = 3")).collect() == []


def test_top_k_query_rows_of_one_id(spark):
    """Two query rows share an id: each has its own best rows."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(i, [float(i % 7), float(i % 5)]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for sizes in ({}, {"block": 5, "query_block": 1, "seeds": 3}):
        got = sorted(tuple(r) for r in topk.search(df, **sizes).collect())
        want = []
        for axis in (0, 1):
            best = sorted(((-256 * int(v[axis]) * 256, i) for i, v in rows if i))[:5]
            want += [(0, r + 1, i, -s) for r, (s, i) in enumerate(best)]
        assert got == sorted(want)


def test_top_k_pairs_only_blocks_that_can_matter(spark):
    """Few long vectors, many short ones: most vector blocks meet no query block."""
    rng = np.random.default_rng(6)
    size = np.where(np.arange(4000) < 200, 50.0, 1.0)
    x = np.abs(rng.normal(size=(4000, 8))) * size[:, None]
    rows = [(int(i), [float(y) for y in v]) for i, v in zip(rng.permutation(4000), x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen, plain = [], topk.block_pairs

    def counted(vectors, queries):
        out = plain(vectors, queries)
        seen.append((out.count(), vectors.count() * queries.count()))
        return out

    topk.block_pairs = counted
    try:
        got = {tuple(r) for r in topk.search(df, block=100, query_block=16, seeds=300).collect()}
    finally:
        topk.block_pairs = plain
    assert got == brute.top_k(dict(rows))
    assert seen[0][0] < 0.2 * seen[0][1]


# ---------------------------------------------------------------- 2
def test_warc_round_trip(spark):
    big = "x\r\n\r\nWARC/1.1" * 300
    rows = [(1, "u", big), (2, None, big), (2, "v", big), (None, "w", big), (3, "a b\n", None), (4, "", "short"),
            (5, "", "short"), (6, "é", "y" * 3_000_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"])
           for r in warc.archive_round_trip(df, archive_bytes=2000).collect()]
    assert sorted(got, key=str) == sorted([
        (1, 3900, "revisit", 2), (2, 3900, "response", None), (2, 3900, "response", None), (None, 3900, "revisit", 2),
        (3, 0, "response", None), (4, 5, "response", None), (5, 5, "response", None),
        (6, 3_000_000, "response", None)], key=str)
    assert warc.archive_round_trip(df.limit(0)).collect() == []


def test_warc_index_points_at_members(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", "p" * i) for i in range(40)], "page_id long, url string, html string")
    whole = warc.write_archives(warc.with_targets(df), f"file://{tmp_path}/whole")
    index = warc.normalise(whole, f"file://{tmp_path}/records", 2).collect()
    assert len(index) == 40
    for r in index:
        with open(r["archive"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            record = gzip.decompress(f.read(r["length"]))
        assert record.startswith(b"WARC/1.1") and r["record_id"].encode() in record
    listed = sum(len(p.read_text().splitlines()) for p in (tmp_path / "records").glob("*.index.jsonl"))
    assert listed == 40


def test_warc_records_of_other_writers(spark, tmp_path):
    """Types without payload digests, HTTP heads or page ids, and digests in hex or of other kinds."""
    import hashlib

    def record(kind, body, more=""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{kind}>\r\n{more}Content-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    hexed = f"WARC-Payload-Digest: sha1:{hashlib.sha1(b'page').hexdigest().upper()}\r\nContent-Type: application/http; msgtype=response\r\n"
    parts = [record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields\r\n"),
             record("request", b"GET / HTTP/1.1\r\nContent-Length: 7\r\n\r\n", "Content-Type: application/http; msgtype=request\r\n"),
             record("response", http + b"page", hexed), record("metadata", b"a: b\r\n\r\nc"),
             record("resource", b"", "WARC-Payload-Digest: md5:00\r\n"), record("conversion", "é".encode())]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    archives = spark.createDataFrame([(f"file://{tmp_path}/in/a.warc.gz",)], "archive string")
    index = warc.normalise(archives, f"file://{tmp_path}/out", 1)
    got = {r["record_type"]: r for r in warc.read_records(index, 1).collect()}
    bodies = {"warcinfo": b"software: x\r\n", "request": b"", "response": b"page", "metadata": b"a: b\r\n\r\nc", "resource": b"",
              "conversion": "é".encode()}
    assert set(got) == set(bodies)
    for kind, body in bodies.items():
        r = got[kind]
        assert (r["page_id"], r["refers_to"], r["payload_bytes"]) == (None, None, len(body))
        assert r["payload_digest"] == hashlib.sha1(body).hexdigest()
    (tmp_path / "in" / "b.warc.gz").write_bytes(gzip.compress(record("response", http + b"other", hexed)))
    bad = warc.normalise(spark.createDataFrame([(f"file://{tmp_path}/in/b.warc.gz",)], "archive string"), f"file://{tmp_path}/out", 1)
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_records(bad, 1).collect()
    assert [warc._tasks(bad, n) for n in (0, 1, 10**6)] == [1, 1, 62_500]


def test_warc_stream_pieces():
    records = [warc.record_bytes(i, "u", random.randbytes(random.randint(0, 3000)), "00" * 20, None) for i in range(20)]
    for data in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        for piece in (1, 7, 1 << 16):
            assert [h + b"".join(b) for h, _, b in warc.RecordStream(io.BytesIO(data), piece)] == records
    with pytest.raises(ValueError):
        list(warc.RecordStream(io.BytesIO(gzip.compress(b"".join(records))[:-300])))


# ---------------------------------------------------------------- 5
def test_langid(spark, odd):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    marked = docs.withColumn("held_out", langid.held_out(F.col("doc_id"))).withColumn("train", ~F.col("held_out"))
    model = langid.learn(marked)
    got = langid.identify(marked.filter("held_out"), model).join(docs, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    for r in langid.identify(odd, model, keep=("n", "word")).collect():
        t = ODD[r["n"]]
        assert (r["lang_pred"] == "und") == (t is None or not any(c.isalpha() for c in t))
    assert langid.identify(odd.limit(0), model).collect() == []
    none = marked.withColumn("lang", F.lit(None).cast("string"))
    assert langid.learn(none) is None
    assert {r["lang_pred"] for r in langid.identify(none, None).collect()} == {"und"}


def test_langid_against_plain_sums(spark, odd):
    """Features and predictions of whole texts, counted and summed one by one."""
    docs = read_table(spark, SF, "documents").select("doc_id", "text", "lang")
    marked = docs.withColumn("train", ~langid.held_out(F.col("doc_id"))).withColumn("score", F.lit("z"))
    model = langid.learn(marked)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in langid.identify(marked.limit(60), model).collect():
        label, p = brute.language(model, texts[r["doc_id"]], langid.BUCKETS)
        assert r["lang_pred"] == label and r["score"] == pytest.approx(p, abs=1e-4)
    for r in langid.identify(odd, model, keep=("n",)).collect():
        label, p = brute.language(model, ODD[r["n"]], langid.BUCKETS)
        assert r["lang_pred"] == label or abs(r["score"] - p) < 1e-4
        assert r["score"] == pytest.approx(p, abs=1e-4)


def test_langid_training_lowers_the_loss_like_plain_descent():
    """Without noise of order, a fit on separable shares ends where every label is right and sure."""
    rng = np.random.default_rng(0)
    x = np.zeros((300, langid.BUCKETS), np.float32)
    y = rng.integers(0, 3, 300)
    for i, label in enumerate(y):
        at = rng.choice(200, 40) + 600 * label
        np.add.at(x[i], at, 1 / 40)
    model = langid.Model.fit(x, y, ["a", "b", "c"])
    best, p = model.predict(x)
    assert (best == y).all() and p.min() > 0.5 and model.accept <= p.max()
    again = langid.Model.fit(x, y, ["a", "b", "c"])
    assert np.array_equal(again.embedding, model.embedding) and again.temperature == model.temperature


def test_langid_learns_every_language(spark):
    rows = [(i, " ".join(chr(97 + i % 26) + chr(97 + i // 26 % 26) * 3 for _ in range(9)), f"l{i % 230:03}", True)
            for i in range(3 * 230)]
    df = spark.createDataFrame(rows + rows[:1] * 50, "doc_id long, text string, lang string, train boolean")
    assert langid.learn(df, per_language=1).labels == [f"l{i:03}" for i in range(230)]


# ---------------------------------------------------------------- 6
def test_line_dedup(spark, texts):
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == brute.cut_lines(texts)
    small = {2: "a\nb\nc\nd\ne", 1: "x\nb\nc\n\nd\ny\n", 3: "a\na\na\na\na\nq", 5: "", 6: "one\ntwo",
             7: "b\n \nc\nd\nz\nx\nb\nc", 8: "p\nq\nr\ns\n" * 400}
    df = spark.createDataFrame(list(small.items()), "doc_id long, text string")
    for block in (1, 40, 8 << 20):
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, block=block).collect()}
        assert got == brute.cut_lines(small)
    few = docs.repartition(5)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(few, block=20_000).collect()} == brute.cut_lines(texts)


@pytest.mark.parametrize("ends", [True, False])
def test_line_dedup_finds_passages_inside_paragraphs(spark, ends):
    """Runs of 51 to 60 words planted mid-text in two documents, with and without sentence
    ends: under 2 % have no window in common, and most of their words go."""
    rng, docs = random.Random(11), [r["text"] for r in read_table(spark, "/root/testdata/sf0.01", "documents").collect()]
    words, rows, plain = " ".join(docs).split(), [], []
    for i in range(500):
        a, n = rng.randrange(len(words) - 60), rng.randrange(51, 61)
        passage = [w if ends else w.replace(".", "") or "x" for w in words[a:a + n]]
        while len(set(passage)) < 20:  # noise of a few words over and over has no place of its own
            a = rng.randrange(len(words) - 60)
            passage = [w if ends else w.replace(".", "") or "x" for w in words[a:a + n]]
        for d in (2 * i, 2 * i + 1):
            before, after = (" ".join(f"{d}{rng.random():.9f}" for _ in range(30)) for _ in range(2))
            rows.append((d, f"{before} {' '.join(passage)} {after}"))
        plain.append(n)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    left = {r["doc_id"]: len(r["text"].split()) for r in line_dedup.dedup_lines(frame, block=30_000).collect()}
    gone = [60 + n - left[2 * i + 1] for i, n in enumerate(plain)]
    assert sum(g == 0 for g in gone) < 0.02 * len(gone)
    assert sum(gone) > 0.75 * sum(plain)
    assert sum(60 + n - left[2 * i] for i, n in enumerate(plain)) < 0.05 * sum(plain)


def test_line_dedup_odd_rows(spark, odd):
    df = spark.createDataFrame([(1, "a\nb\nc"), (None, "a\nb\nc"), (None, "p\nq\nr"), (4, None), (7, "k\nl\nm"),
                                (7, "k\nl\nm")], "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "a\nb\nc"), (None, ""), (None, "p\nq\nr"), (4, None), (7, "k\nl\nm"),
                                           (7, "k\nl\nm")], key=str)
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []
    assert line_dedup.dedup_lines(odd).columns == [*odd.columns, "_n_lines", "_n_removed"]


# ---------------------------------------------------------------- 1
def test_mixing_marginals(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    mixed = mixing.mixed_documents(docs)
    expected = F.sum(F.col("_tokens") * F.col("_prob") * F.col("_weight"))
    total = mixed.agg(expected).first()[0]
    for column in ("source", "lang"):
        for r in mixed.groupBy(column).agg(expected.alias("x")).collect():
            assert r["x"] / total == pytest.approx(mixing.TARGETS[column][r[column]], rel=1e-3)
    kept = mixed.agg(F.sum(F.col("_tokens") * F.col("_prob")) / F.sum("_tokens")).first()[0]
    assert kept == pytest.approx(mixing.FRACTION, rel=1e-6)


def test_mixing_odd_rows(spark, odd):
    df = spark.createDataFrame([(1, "a b", "src0", "en"), (None, "a b", "src0", None), (2, None, None, "xx"),
                                (2, None, None, "xx"), (3, "", "src1", "de")],
                               "doc_id long, text string, source string, lang string")
    got = mixing.mixed_documents(df).collect()
    assert len(got) == 5 and all(r["_prob"] == 0 and not r["_sampled"] for r in got if not r["_tokens"])
    assert mixing.mixed_documents(df.limit(0)).collect() == []


def test_rake_goes_on_until_it_converges_or_cannot():
    """Cells that tie the margins loosely need hundreds of rounds; margins that conflict end with their gap."""
    slow = [("x", "p", 1e6), ("x", "q", 1.0), ("y", "p", 1.0), ("y", "q", 1e6)]
    w, gap = mixing.rake(slow, [{"x": 0.9, "y": 0.1}, {"p": 0.1, "q": 0.9}])
    assert gap < mixing.TOLERANCE and w[0] + w[1] == pytest.approx(0.9) and w[0] + w[2] == pytest.approx(0.1)
    w, gap = mixing.rake([("x", "p", 5.0), ("y", "q", 5.0)], [{"x": 0.9, "y": 0.1}, {"p": 0.5, "q": 0.5}])
    assert gap == pytest.approx(0.4)


def test_mixing_warns_of_conflicts_and_keeps_names(spark):
    rows = [(i, "a b c", "x" if i % 2 else "y", "p" if i % 2 else "q", "kept", "kept") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _c0 string, _cell string")
    with pytest.warns(UserWarning, match="targets conflict"):
        out = mixing.mix(df, {"source": {"x": 0.9, "y": 0.1}, "lang": {"p": 0.5, "q": 0.5}}, 0.5).collect()
    assert len(out) == 200 and all(r["_c0"] == r["_cell"] == "kept" for r in out)


def test_rake_reaches_every_margin():
    rng = np.random.default_rng(1)
    cells = [(a, b, float(n)) for a in "xyz" for b in "pq" for n in [rng.integers(1, 100)]]
    w, gap = mixing.rake(cells, [{"x": 0.5, "y": 0.3, "z": 0.2}, {"p": 0.9, "q": 0.1}])
    assert gap < mixing.TOLERANCE
    for d, goal in enumerate(({"x": 0.5, "y": 0.3, "z": 0.2}, {"p": 0.9, "q": 0.1})):
        for k, v in goal.items():
            assert sum(x for c, x in zip(cells, w) if c[d] == k) == pytest.approx(v)
    n = np.array([c[-1] for c in cells])
    p, weight = mixing.probabilities(n, w, 0.7)
    assert (p * n).sum() == pytest.approx(0.7 * n.sum()) and (p <= 1).all()
    assert p * weight * n / (p * weight * n).sum() == pytest.approx(w)
