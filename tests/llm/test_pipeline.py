"""The pipeline's stages on the smallest tables."""

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    from gazette.llm import neardup, quality, suffix_dedup
    from gazette.llm.common import written

    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, ids = documents, set()
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SMALL), "stage")
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        if name != "packing":
            assert docs.dtypes == documents.dtypes
        now = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        if name == "quality rules":
            assert now == {r.doc_id for r in quality.judge(before).filter("kept").collect()}
        elif name == "near duplicates":
            assert now == {r.doc_id for r in neardup.near_duplicates(before).filter("kept").collect()}
        elif name == "repeated passages":
            # a character that is cut in two goes with what was removed
            left = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.digests(before).collect()}
            assert now == ids and all(len(r.text.encode()) <= left[r.doc_id] for r in docs.collect())
        elif name == "packing":
            assert now == ids
        else:
            assert now <= ids and len(now) > 0.5 * len(ids)


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_odd_documents(spark):
    """Repeated rows and null ids go through all stages that keep documents."""
    from gazette.llm import neardup, suffix_dedup

    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long, "en", "a", 5), (1, long, "en", "a", 5), (None, long + " x", None, None, None), (7, None, None, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(str(r.doc_id) for r in neardup.keep_documents(docs).collect()) == ["7", "None"]
    cut = suffix_dedup.shorten_documents(docs)
    assert cut.dtypes == docs.dtypes and cut.count() == 4


def test_a_run_leaves_other_results_readable(spark):
    """A lazy result of another query still reads its tables after the pipeline has deleted its own."""
    from gazette.llm import queries

    lazy = queries.op9_near_duplicates(spark, SMALL)
    before = lazy.count()
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert lazy.count() == before
