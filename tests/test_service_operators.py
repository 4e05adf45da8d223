from pyspark.sql import functions as F

from gazette.operators import decisions, writes


def test_retry_delay(spark):
    df = spark.range(12).select(writes.retry_delay(F.col("id")).alias("m"))
    assert [r.m for r in df.collect()] == [5, 10, 20, 40, 80, 160, 320, 640, 1280, 1280, 1280, 1280]


def test_observation(spark):
    rows = [("failed", 1, "2099-01-01 00:00:00", "a", "b"), ("failed", 3, "2020-01-01 00:00:00", "a", "b"), ("failed", 1, None, "a", "b"), ("success", 9, None, "a", "b"), ("failed", 3, None, "a", "a")]
    df = spark.createDataFrame(rows, "processing_status string, retry_count int, t string, last_processed_hash string, observed_hash string").withColumn("next_retry_at", F.col("t").cast("timestamp_ntz"))
    assert [r.d for r in df.select(decisions.observation("2026-01-01 00:00:00").alias("d")).collect()] == ["backoff", "retry_exhausted", "process", "process", "unchanged"]


def test_upsert_policies(spark):
    state = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, first string, note string")
    changes = spark.createDataFrame([(2, "B", None), (3, "c", "z")], "k int, first string, note string")
    got = writes.upsert(state, changes, ["k"], keep_old=("first",), keep_if_null=("note",))
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]


def test_gate_reasons(spark):
    schema = "g int, title string, author string, url string, detail_url string, external_id string, published_at string"
    rows = [(1, f"t{i}", None, "", f"mailto:{i}", None, None) for i in range(2)] + [(2, "same", "a", "", "https://x.example/1", "id", "2026-01-01")] * 3
    records = writes.identities(spark.createDataFrame(rows, schema))
    sources = spark.createDataFrame([(1, 2, 0, 0, False), (2, 3, 0, 0, False), (3, 0, 0, 0, True)], "g int, source_records int, rejected int, semantic_records int, failed boolean")
    got = {r["g"]: r for r in decisions.gate(records, records.limit(0), sources, "g").collect()}
    assert got[1]["reasons"] == ["INVALID_DETAIL_URLS", "INVALID_DATES"]
    assert (got[2]["duplicates"], got[2]["reasons"]) == (2, ["DUPLICATE_RECORDS"])
    assert got[3]["reasons"] == ["EXECUTION_FAILED", "NO_EXTRACTED_RECORDS"]


def test_choices(spark):
    schema = "target_id int, api_index int, score int, length int, has_repeated_records boolean, looks_like_telemetry boolean, looks_like_non_content boolean, has_title_key boolean, is_json_like boolean, has_list_key boolean, is_exact_target boolean, is_same_host boolean"
    one = lambda t, i, s, rec, tel=False: (t, i, s, 1, rec, tel, False, False, False, False, False, False)
    df = spark.createDataFrame([one(1, 0, 30, True), one(2, 0, 8, True), one(3, 0, 50, False), one(4, 0, 25, True), one(4, 1, 23, True), one(5, 0, 100, True, True)], schema)
    got = {r["target_id"]: r["decision"] for r in decisions.choices(df).collect()}
    assert got == {1: "accept_rule", 2: "defer_to_llm", 3: "reject_or_observe_more", 4: "defer_to_llm", 5: "reject_or_observe_more"}


def test_stream_of_observations(spark, tmp_path):
    from gazette.streaming.outbox import Snapshots, observe

    states = spark.createDataFrame([(i, "h0", "h0", "success", 0, None) for i in range(4)], "api_id bigint, last_processed_hash string, observed_hash string, processing_status string, retry_count bigint, next_retry_at timestamp_ntz")
    snaps = Snapshots(spark, f"file://{tmp_path}/snap")
    snaps.commit(-1, {"states": states})
    source = f"{tmp_path}/in"
    spark.createDataFrame([(0, "h0", "success"), (1, "h1", "success"), (2, "h2", "failed")], "api_id bigint, observed_hash string, status string").write.parquet(source)
    run = observe(snaps, "2026-01-01 00:00:00")
    stream = spark.readStream.schema("api_id bigint, observed_hash string, status string").parquet(source)
    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = {r["api_id"]: (r["last_processed_hash"], r["processing_status"], r["retry_count"]) for r in snaps.table("states").collect()}
    assert got == {0: ("h0", "success", 0), 1: ("h1", "success", 0), 2: ("h0", "failed", 1), 3: ("h0", "success", 0)}
    run(spark.createDataFrame([(3, "h9", "failed")], "api_id bigint, observed_hash string, status string"), 0)  # a replay changes nothing
    assert {r["api_id"]: r["retry_count"] for r in snaps.table("states").collect()}[3] == 0


def test_notices_from_before_hashes_are_found(spark):
    """By title, author and date, the lowest id; not if the notice has an identity or the record has one."""
    columns = "notice_id bigint, site_id bigint, title string, detail_url string, url string, external_id string, author string, published_at string, record_hash string"
    notices = spark.createDataFrame([(1, 7, "a", None, "u1", None, None, None, "h"), (2, 7, "a", None, "u2", None, None, None, None), (3, 7, "a", None, "u3", None, "", None, None), (4, 7, "b", "d", "u", None, "x", "2024-01-01", None)], columns)
    records = spark.createDataFrame([(7, "a", None, "new", None, "", None), (7, "b", None, "new", None, "x", "2024-01-01"), (7, "a", "d9", "new", None, None, None)], "site_id bigint, title string, detail_url string, url string, external_id string, author string, published_at string")
    got = {(r.title, r.detail_url): r.notice_id for r in writes.match_notices(notices, records).collect()}
    assert got == {("a", None): 2, ("b", None): None, ("a", "d9"): None}


def test_identities_of_one_document_ignore_case(spark):
    rows = spark.createDataFrame([(1, 0, "Ab", "t"), (1, 1, "aB", "t"), (1, 2, "c", "t")], "doc int, i int, external_id string, title string").withColumns({c: F.lit(None).cast("string") for c in ("detail_url", "author", "url", "published_at")})
    assert sorted(r.i for r in writes.first_of_identity(rows, ["doc"], "i").collect()) == [0, 2]
