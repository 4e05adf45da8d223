"""Clashing column names, nulls, repeated rows, empty tables and very long texts, for the operators and the pipeline's stages."""

import random

import corpus_pipeline
import numpy as np
import pytest
from gazette.llm import bpe, fingerprint, neardup, quality, sharding, suffix_dedup, token_count, toxicity, url_filter
from pyspark.sql import functions as F

CLASHES = ("_k", "_id", "_text", "_row", "_n", "row", "id", "words", "n", "key", "group", "component", "removed", "c", "to")
KEEPERS = {
    "quality": quality.keep_documents, "neardup": neardup.keep_documents, "suffix": suffix_dedup.shorten_documents,
}


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    plain = [words(rng, 80) for _ in range(12)]
    return [*plain, plain[3], plain[4] + " one more", plain[5][:300] + plain[6][:300]]


def table(spark, texts, odd):
    rows = [(None if odd and i == 2 else i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    if odd:
        rows += [rows[1], (4, None, "en", "src1", 0), (4, "another text of the same id", "de", "src1", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.withColumns({c: F.concat(F.lit("x"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in CLASHES})


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("name", sorted(KEEPERS))
def test_clashing_columns_come_back_as_they_were(spark, texts, name, odd):
    docs = table(spark, texts, odd)
    out = KEEPERS[name](docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows
    for r in rows:
        want = "x" + ("null" if r.doc_id is None else str(r.doc_id))
        assert all(r[c] == want for c in CLASHES)
    plain = docs.drop(*CLASHES)
    side = lambda df: sorted(map(str, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))
    assert side(out) == side(KEEPERS[name](plain))


def test_near_copies_go_in_either_case(spark, texts):
    for odd in (False, True):
        kept = [r.text for r in neardup.keep_documents(table(spark, texts, odd)).collect()]
        assert kept.count(texts[3]) == 1 and (texts[4] in kept) != (texts[13] in kept)


def test_toxicity_keeps_clashing_columns(spark, texts):
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = table(spark, texts, True)
    out = toxicity.keep_documents(docs, labels)
    assert out.columns == docs.columns and out.count() == docs.count()


@pytest.mark.parametrize("stage", range(4))
def test_stages_on_an_empty_table(spark, texts, stage):
    docs = table(spark, texts, False).limit(0)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns and out.count() == 0


def test_urls_with_clashing_columns_repeats_and_nulls(spark):
    rows = [(1, "https://A.net/x", "k"), (1, "https://A.net/x", "k"), (None, None, "k"), (2, "https://example.net/en/", None), (3, "", "k")]
    out = url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, key string").withColumns({c: F.lit("z") for c in ("host", "path", "rule", "verdict")}))
    assert sorted((r.page_id or 0, r.rule, r.verdict) for r in out.collect()) == [(0, None, "allow"), (1, "net/", "block"), (1, "net/", "block"), (2, "example.net/en/", "allow"), (3, None, "allow")]
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_many_rules_of_one_host(spark):
    rng = random.Random(3)
    rules = [("block" if i % 2 else "allow", f"a.example/{i}/") for i in range(3000)] + [("block", "example/1"), ("allow", "example/")]
    urls = [f"https://b.a.example/{rng.randrange(4000)}/x" for _ in range(300)] + ["https://c.example/12", "https://c.example/2"]
    out = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules)
    for r in out.collect():
        host, path = urls[r.page_id][8:].split("/", 1)
        fits = [(rule, v) for v, rule in rules if ("." + host).endswith("." + rule.split("/")[0]) and ("/" + path).startswith("/" + rule.split("/", 1)[1])]
        assert (r.rule, r.verdict) == max(fits, key=lambda x: len(x[0]))


def test_likeness_of_very_many_equal_lines(spark):
    rows = spark.createDataFrame([("a line.\n" * 40_000, "a line.\n" * 20_000)], "a string, b string")
    vectors = rows.select(fingerprint.vector(F.col("a")).alias("x"), fingerprint.vector(F.col("b")).alias("y"))
    assert fingerprint.with_likeness(vectors, "x", "y", "like").first().like > 0.99
    back = vectors.select((fingerprint.add(fingerprint.add(F.col("x"), F.col("y")), F.col("y"), -1) == F.col("x")).alias("same"))
    assert back.first().same


def test_a_megabyte_without_a_space(spark):
    """One word of a megabyte and a long text of words, beside short ones."""
    import hashlib

    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh") for _ in range(1 << 20))
    texts = [long, words(rng, 100_000), "short", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    counts = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and got[i].n_tokens == counts[i]
    assert neardup.near_duplicates(docs).filter("kept").count() == 5
    assert {r.doc_id: r.n_removed for r in suffix_dedup.digests(docs).collect()}[1] == 0
    assert sharding.shard(docs).count() == 5 and quality.judge(docs).count() == 5


def test_toxicity_of_near_copies_and_more_labels_than_the_bound(spark):
    """A raw corpus in which one toxic text has very many near copies: its ordinary words must not pass for toxic ones."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    ordinary = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, labels = [], []
    base = [*ordinary(150), "scum", "moron"]
    for i in range(1600):
        toxic = i % 8 == 0
        text = ordinary(120)
        if i % 4 == 1:
            toxic, text = True, [w if rng.random() > 0.03 else rng.choice(vocabulary) for w in base]
        elif toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(("idiot", "scum", "moron", "trash"))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, marks, limit=1000)
    got = toxicity.scored(docs, model).select("_row.doc_id", "_score").join(marks, "doc_id").toPandas()
    assert (got[got["toxic"] == 1]["_score"] >= 0.5).mean() > 0.9
    assert (got[got["toxic"] == 0]["_score"] >= 0.5).mean() < 0.02


def test_windows_of_one_key_stream_through_their_task():
    """A million windows of one key, with one of other bytes among them, take little memory."""
    import tracemalloc

    import pyarrow as pa

    from gazette.llm import suffix_dedup

    window, other = b"x" * 100, b"y" * 100

    def batches():
        for k in range(200):
            doc = np.arange(k * 5000, k * 5000 + 5000, dtype=np.int64)
            blobs = [other if d == 7 or d == 999_999 else window for d in doc]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(5000, 3, np.int64)), pa.array(doc), pa.array(np.full(5000, 4, np.int32)), pa.array(np.zeros(5000, np.int32)), pa.array(blobs, pa.binary())], ["key", "doc", "start", "n", "bytes"])

    tracemalloc.start()
    removed = [np.asarray(out.column(0)) for out in suffix_dedup.compare_pieces(100)(batches())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert set(range(1_000_000)) - set(np.concatenate(removed).tolist()) == {0, 7}


@pytest.mark.parametrize("stage", ["quality", "toxicity", "neardup", "suffix_dedup"])
def test_columns_whose_names_are_no_identifiers(spark, stage):
    from gazette.llm import neardup, quality, suffix_dedup, toxicity

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = docs.selectExpr("*", "1 AS `my col`", "2 AS `a.b`", "3 AS `a-b`", "4 AS `x:y`", "5 AS `ünï`")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    keep = {"quality": quality.keep_documents, "toxicity": lambda d: toxicity.keep_documents(d, labels), "neardup": neardup.keep_documents, "suffix_dedup": suffix_dedup.shorten_documents}[stage]
    out = keep(docs)
    assert out.columns == docs.columns
    assert out.count() > 0


def test_a_scope_holds_its_own_tables_only(spark):
    """What one caller clears leaves another's lazy result readable."""
    from gazette.llm import neardup
    from gazette.llm.common import clear, scope

    docs = spark.createDataFrame([(i, f"{i} a b c d e f g") for i in range(30)], "doc_id bigint, text string")
    lazy = neardup.near_duplicates(docs)
    with scope() as folders:
        kept = neardup.keep_documents(docs)
        assert kept.count() == 30 and folders
        clear(spark, folders)
        assert not folders
    assert lazy.count() == 30


def test_likeness_follows_the_true_overlap(spark):
    """The likeness of two texts against the cosine of their sentences: 60 lanes err by about 0.13."""
    rng = random.Random(8)
    sentences = [f"sentence {i} {words(rng, 6)}.\n" for i in range(400)]
    rows, true = [], {}
    for i, share in enumerate([0.0, 0.2, 0.4, 0.6, 0.8, 0.9, 1.0] * 12):
        mine = rng.sample(sentences, 100)
        kept = int(100 * share)
        other = mine[:kept] + rng.sample([x for x in sentences if x not in mine], 100 - kept)
        rng.shuffle(other)
        rows.append((i, "".join(mine), "".join(other)))
        true[i] = share
    vectors = spark.createDataFrame(rows, "i int, a string, b string").select("i", fingerprint.vector(F.col("a")).alias("x"), fingerprint.vector(F.col("b")).alias("y"))
    found = {r.i: r.like for r in fingerprint.with_likeness(vectors, "x", "y", "like").collect()}
    errors = np.array([found[i] - true[i] for i in true])
    assert np.abs(errors).mean() < 0.12 and np.abs(errors).max() < 0.5
    assert all(found[i] == 1 for i in true if true[i] == 1)


def test_toxicity_with_repeats_nulls_and_a_megabyte(spark):
    """Every row has a score: repeated ones the same, null and empty texts one, and a megabyte without a space another."""
    rng = random.Random(12)
    rows = [(i, words(rng, 30) + (" scum moron idiot" if i % 5 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)] + [(7, 1, 0), (None, 1, 0), (9999, 1, 1)], "doc_id bigint, quality int, toxic int")
    odd = [(5, rows[5][1]), (None, None), (500, ""), (501, "y" * (1 << 20)), (None, "scum moron idiot")]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("score", "toxic", "my col")})
    found = toxicity.score_documents(docs, labels).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert len({r.score for r in found if r.doc_id == 5}) == 1
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_packing_and_fingerprints_of_a_megabyte(spark):
    from gazette.llm import packing

    docs = spark.createDataFrame([(1, "x" * (1 << 20)), (2, None), (2, None), (None, "a b")], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    pieces = packing.pack(docs).collect()
    assert {r.doc_id for r in pieces} == {1, 2, None} and sum(r.start == 0 for r in pieces) == 4
    assert fingerprint.fingerprints(docs).count() == 4
    assert packing.pack(docs.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "https://a.net/" + "p" * (1 << 20))], "page_id bigint, url string")
    assert url_filter.filter_urls(pages).first().verdict == "block"
