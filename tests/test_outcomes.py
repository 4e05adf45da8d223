"""Outcomes, registration, comparisons and payloads on small tables: what their queries over the test tables don't reach."""

import pytest
from pyspark.sql import functions as F

from gazette.functions import payloads
from gazette.operators import comparison, outcomes, registration, writes

AS_OF = "2026-03-01 00:00:00"
NOTICE = "notice_id bigint, site_id bigint, title string, detail_url string, url string, external_id string, author string, created_at timestamp_ntz, published_at timestamp_ntz, scraped_at timestamp_ntz, is_active boolean"
RECORD = "site_id bigint, record_index bigint, title string, author string, url string, detail_url string, external_id string, published_at timestamp_ntz"


def record(site, i, title, detail=None, external=None):
    return (site, i, title, "a", "u", detail, external, None)


@pytest.mark.parametrize(("records", "refused"), [
    ([record(1, 0, "x", external="e1"), record(1, 1, "y", external="e1")], True),  # new under one external id
    ([record(1, 0, "x", external="old"), record(1, 1, "y", detail="https://h/old")], True),  # two that update one notice
    ([record(1, 0, "x", detail="https://h/n", external="e1"), record(1, 1, "y", detail="https://h/n")], True),  # the second finds the first
    ([record(1, 0, "y", detail="https://h/n"), record(1, 1, "x", detail="https://h/n", external="e1")], False),  # the first is looked up by id alone
    ([record(1, 0, "x"), record(1, 1, "x")], True),  # the same in all fields
    ([record(1, 0, "x"), record(1, 1, "y")], False),
])
def test_collisions(spark, records, refused):
    notices = spark.createDataFrame([(5, 1, "old", "https://h/old", "u", "old", "a", None, None, None, True)], NOTICE)
    results = spark.createDataFrame([(1, "success"), (2, "success"), (3, "valid_empty"), (4, None)], "site_id bigint, processing_status string")
    got = {r.site_id: r.refusal for r in outcomes.verdicts(notices, results, spark.createDataFrame(records, RECORD)).collect()}
    assert got == {1: "collision" if refused else None, 2: "no_records", 3: None, 4: "status"}


def test_old_notices_without_any_identity_are_found_by_their_content(spark):
    """Where notices keep a record_hash: those from before hashes are matched by title, author and date."""
    rows = [(5, 1, "old", None, "u", None, "a", None, None, None, True, None), (6, 1, "old", None, "u", None, "a", None, None, None, True, None), (7, 1, "kept", None, "u", None, "a", None, None, None, True, "h")]
    notices = spark.createDataFrame(rows, NOTICE + ", record_hash string")
    got = {r.title: r.notice_id for r in writes.match_notices(notices, spark.createDataFrame([record(1, 0, "old"), record(1, 1, "new")], RECORD)).collect()}
    assert got == {"old": 5, "new": None}


def test_a_result_without_a_verdict_counts_as_failed(spark):
    results = spark.createDataFrame([(1, "success"), (2, "success"), (3, "failed"), (4, None)], "site_id bigint, processing_status string")
    judged = spark.createDataFrame([(1, None), (3, "status")], "site_id bigint, refusal string")
    ended, seen = outcomes.observed(outcomes.completed(results, judged))
    got = {r.site_id: (r.status, r.error_code) for r in ended.collect()}
    assert got == {1: ("success", None), 2: ("failed", "DATABASE_ERROR"), 3: ("failed", "NOTICE_EXTRACTION_FAILED"), 4: ("failed", "NOTICE_EXTRACTION_FAILED")}
    assert seen.get == {"results": 4, "success": 1, "valid_empty": 0, "failed": 3, "refused": 1}


def test_registration_is_the_same_as_a_stream(spark, tmp_path):
    kinds = ["submitted", "succeeded", "failed", "queue_failed", "blocked", "unknown"]
    rows = [(i % 7, kinds[(i * i + i // 7) % 6], i // 2, i) for i in range(120)]
    schema = "site_id bigint, event string, at bigint, seq bigint"
    batch = sorted(map(tuple, registration.states(spark.createDataFrame(rows, schema)).collect()))
    state, code = {}, {}
    for site, event, _, _ in sorted(rows, key=lambda r: r[2:]):
        was = state.get(site)
        if event in ("submitted", "queue_failed"):
            state[site] = "active" if was == "active" else registration.TO[event]
        elif event != "unknown":
            state[site] = registration.TO[event]
        if event != "unknown":
            code[site] = None if state[site] == "active" else registration.CODES.get(event)
    assert {(r[0], r[1], r[2]) for r in batch} == {(s, state[s], code[s]) for s in state}
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.json(str(tmp_path / "in"), mode="append")
    stream = registration.states(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("registrations").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("registrations").collect())) == batch


def test_a_replayed_login_makes_no_second_user(spark):
    users = spark.createDataFrame([(1, "s1", 5), (2, "s2", None)], "user_id bigint, social_id string, max_sites_limit bigint")
    logins = spark.createDataFrame([("s1", "p", "a@x", None, 1), ("s3", "p", "c@x", "2", 1), ("s3", "p", "later@x", "1", 2), ("s4", "p", None, "99", 1), ("s5", "p", "@x", "no", 1)], "social_id string, provider string, email string, referrer_code string, at bigint")
    once, found = outcomes.get_or_create_users(users, logins, AS_OF)
    got = {r.social_id: (r.user_id, r.created) for r in found.collect()}
    assert got["s1"] == (1, False) and all(got[s][1] for s in ("s3", "s4", "s5")) and len({v[0] for v in got.values()}) == 4
    rows = {r.social_id: r for r in once.collect()}
    assert (rows["s3"].nickname, rows["s4"].nickname, rows["s5"].nickname) == ("c", "User", "User")
    assert (rows["s2"].max_sites_limit, rows["s1"].max_sites_limit) == (6, 5)
    again, found = outcomes.get_or_create_users(once, logins, AS_OF)
    assert {r.social_id: r.user_id for r in found.collect()} == {s: v[0] for s, v in got.items()} and again.count() == once.count()


def test_rollout_and_limits(spark):
    allowed = lambda *a: [r.x for r in spark.createDataFrame([(1, True, False), (2, False, True), (3, None, None)], "i int, p boolean, a boolean").orderBy("i").select(outcomes.rollout_allowed(F.col("p"), F.col("a"), *a).alias("x")).collect()]
    assert allowed(False, "all") == [False] * 3 and allowed(True, "all") == [True] * 3 and allowed(True, "new_sites") == [True, True, False] and allowed(True, "some") == [False] * 3
    usual, most = 5 << 20, 64 << 20
    assert [payloads.byte_limit(x) for x in (None, "", "x", "0", "-1", "1", str(most), str(most + 1))] == [usual, usual, usual, usual, usual, 1, most, usual]


def test_payload_edges(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(["", None, '{"a":1}', "[1]", "a=1&a=&b", "&", '"\\', 'x="y"'])], "i int, p string")
    got = [(r.k, r.b) for r in df.select("i", payloads.parsed_payload(F.col("p")).alias("x")).select("i", F.col("x.kind").alias("k"), F.col("x.body").alias("b")).orderBy("i").collect()]
    assert got == [("query_only", None), ("query_only", None), ("json", '{"a":1}'), ("form", '{"[1]":""}'), ("form", '{"a":["1",""],"b":""}'), ("raw", '{"_raw":"&"}'), ("form", '{"\\"\\\\":""}'), ("form", '{"x":"\\"y\\""}')]


def test_last_of_equal_titles_counts(spark):
    schema = "g int, i int, title string, author string, published_at string, detail_url string, external_id string"
    old = spark.createDataFrame([(1, 1, "T  x", "a", None, "u", "1"), (1, 2, "t X", "b", "", "u", "1"), (1, 3, None, "z", None, None, None)], schema)
    new = spark.createDataFrame([(1, 1, " T X ", "b", None, "v", "1"), (1, 2, "other", "q", None, None, None), (1, 3, "t x", "a", None, "u", None)], schema)
    got = {r.field: r.mismatches for r in comparison.field_mismatches(old, new, "g", "i").collect()}
    assert got == {"author": 1, "detail_url": 1, "external_id": 1}
