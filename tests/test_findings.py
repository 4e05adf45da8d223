"""Cases that a review found: views, registrations, JSON, pages and requests that came out wrong, or cost too much."""

import duckdb
import pandas as pd
import pytest

from gazette.plans import registry
from gazette.sources.entities import TABLES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """tables(name=SQL over the smallest tables): a folder with all of them, some replaced."""

    def make(**changed):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
        for t in TABLES:
            con.execute(f"copy ({changed.get(t, f'select * from {t}')}) to '{tmp_path}/{t}.parquet'")
        return str(tmp_path)

    return make


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, folder).toPandas(), con.execute(registry.ORACLES[name]).fetch_df()
    plain = lambda f: sorted(tuple("" if pd.api.types.is_scalar(v) and pd.isna(v) else str(v) for v in r) for r in f[sorted(want.columns)].astype(object).itertuples(index=False))
    assert len(want) and plain(got) == plain(want)


@pytest.mark.parametrize("name", ["rank_candidates", "diversity_pool", "prioritized_candidates", "candidate_evidence"])
def test_candidates_round_their_length(spark, tables, name):
    # ten candidates of one target and score, whose lengths are equal only when rounded, halves to even
    folder = tables(lineitem="select * replace (i as l_orderkey, 1 as l_partkey, 5.0 as l_quantity, 10.5 - (i % 7) / 10 as l_extendedprice, i % 7 + 1 as l_linenumber, 'N' as l_returnflag, 0.0 as l_discount, 0.0 as l_tax) from (select * from lineitem limit 1), range(1, 15) r(i)")
    same_as_sql(spark, folder, name)


def steps(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().split("\n")


def test_registration_forms_each_url_once(spark):
    from gazette.operators import registration

    requests = spark.createDataFrame([(1, u, 1) for u in ("https://c.example/", "https://b.example/", "https://a.example/")], "user_id bigint, url string, seq int")
    users = spark.createDataFrame([(1, 2)], "user_id bigint, max_sites_limit int")
    subscriptions = spark.createDataFrame([], "user_id bigint, site_id bigint, registration_completed_at timestamp_ntz")
    sites = spark.createDataFrame([(1, "https://a.example/", "active")], "site_id bigint, site_url string, crawl_status string")
    got = registration.answers(requests, users, subscriptions, sites)
    assert any("Aggregate [url#" in line for line in steps(got))
    # requests of one place in the order are answered by url
    assert sorted((r.site_url, r.answer) for r in got.collect()) == [("https://a.example/", "ACTIVE"), ("https://b.example/", "PENDING"), ("https://c.example/", "MAX_SITES_LIMIT")]


def test_json_documents_are_opened_once(spark):
    plan = steps(registry.QUERIES["json_extract"](spark, SMALL))
    assert sum(line.count("from_json") > 5 for line in plan) == 1


def test_first_of_equal_values_counts(spark):
    from gazette.functions.embedded import extract_embedded

    listed = '<script type="application/json">{"list": [{"title": "%s1"}, {"title": "%s2"}]}</script>'
    page = '<script type="application/json">{"list": [{"title": "one"}]}</script>' + listed % ("a", "a") + listed % ("b", "b")
    docs = spark.createDataFrame([(1, page, "https://a.example/"), (2, "<p>none</p>", "https://a.example/")], "id bigint, html string, base string")
    assert [(r.doc_id, r.record_index, r.title) for r in extract_embedded(docs, "id", "html", "base").orderBy("record_index").collect()] == [(1, 0, "a1"), (1, 1, "a2")]


@pytest.mark.parametrize("name", ["html_extract", "embedded_extract", "navigation_resolve"])
def test_a_page_holds_all_orders_of_its_customer(spark, tables, name):
    folder = tables(orders="select * replace (i * 10000 as o_orderkey, 7 as o_custkey) from (select * from orders limit 1), range(1, 6) r(i)")
    assert [r.doc_id for r in registry.QUERIES[name](spark, folder).collect()] == [7] * 5
    same_as_sql(spark, folder, name)


def test_payloads_are_parsed_once(spark):
    from pyspark.sql import functions as F

    from gazette.functions import payloads

    texts = [None, "", " {\"a\": 1}", "{\"a\": ", "[1]", "a=1&a=2", "&&", "{", "\u00a0{}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    got = rows.select("i", payloads.parsed_payload(F.col("p")).alias("x"))
    plan = "\n".join(steps(got))
    assert plan.count("parseJson") + plan.count("parse_json") == 1
    assert [r.x.kind for r in got.orderBy("i").collect()] == ["query_only", "query_only", "json", "form", "form", "form", "raw", "form", "form"]


def test_dates_and_urls_are_brought_into_form_once(spark):
    from pyspark.sql import functions as F

    from gazette.functions import text, urls

    rows = spark.createDataFrame([("2024. 1. 2", "HTTPS://A.example:443/x")], "d string, u string").repartition(1)
    got = rows.select(text.normal_dates("d").alias("d"), urls.canonical(F.col("u")).alias("u"))
    plan = "\n".join(steps(got))
    assert plan.count("translate(") == 1 and plan.count(r"\.+$") <= 1
    assert [tuple(r) for r in got.collect()] == [("2024-01-02", "https://a.example/x")]


def test_keywords_meet_titles_without_an_aggregate_of_all_pairs(spark):
    from gazette.operators import reads

    titles = spark.createDataFrame([(1, "Ring bolt"), (1, "bolt"), (2, "a RING"), (3, "x"), (None, "bolt"), (4, None)], "id int, title string")
    keywords = spark.createDataFrame([(7, "ring"), (7, "Bolt"), (8, "bolt"), (8, "x"), (9, ""), (None, "x")], "folder_id int, keyword string")
    got = reads.holds(titles, keywords)
    assert not any("Aggregate [folder_id" in line and ", id" in line for line in steps(got))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(7, 1), (8, 1), (7, 2), (8, 3), (None, 3), (7, None), (8, None)]))


@pytest.mark.parametrize("name", ["cascade_delete_user", "subscription_status", "user_feed"])
def test_order_lines_are_dealt_to_tasks_by_their_size(spark, monkeypatch, name):
    from gazette.sources import entities

    monkeypatch.setattr(entities, "PART_BYTES", 5000)
    parts = entities.Source(spark, SMALL).parts()
    assert parts == 24
    plan = steps(registry.QUERIES[name](spark, SMALL))
    # joined by orders in so many tasks at least, and grouped in as many
    assert sum(f"], {parts}" in line and "RepartitionByExpression [o_custkey" in line for line in plan) == 1
    assert sum(f"], {parts}" in line and "RepartitionByExpression [l_orderkey" in line for line in plan) >= 1
    if name != "cascade_delete_user":
        return same_as_sql(spark, SMALL, name)
    # whole numbers with nulls, which pandas would turn to doubles
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    got = registry.QUERIES[name](spark, SMALL).select("name", "user_id", "other_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(f"select name, user_id, other_id from ({registry.ORACLES[name]})").fetchall()))


def test_every_pair_of_pieces_is_found_by_one_look():
    import public_tokenizers

    from gazette.llm import bpe

    path = public_tokenizers.path(bpe.VOCABULARY)
    table, _ = bpe.rank_arrays(path)
    pairs = bpe.pair_table(bpe.read_ranks(path))
    starts = bpe.dealt_rows(pairs)
    look = lambda left, right: table[starts.get(left, 0) + right] ^ (left << 36 | left << 20 | starts.get(left, 0))
    for pair, joined in pairs.items():
        assert look((pair >> 32) - 1, pair >> 16 & 0xFFFF) >> 20 == joined
    assert all(look(a, b) >= bpe.JOINABLE for a in range(0, 50_000, 501) for b in range(0, 50_000, 77) if (a + 1 << 32 | b << 16) not in pairs)


def test_shared_words_fill_their_room(spark, monkeypatch):
    import public_tokenizers

    from gazette.llm import bpe

    monkeypatch.setattr(bpe, "SHARED", 100)
    monkeypatch.setattr(bpe, "SAMPLE_STEP", 1)
    docs = spark.createDataFrame([(i, f"twice word{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(400)], "doc_id bigint, text string")
    # one word of all documents, and of the 400 that are in one each about as many as there is room for
    assert 50 < len(bpe.shared_words(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN).numbers) < 150


def test_registration_answers_come_last_by_a_broadcast_of_lists(spark):
    plan = steps(registry.QUERIES["registration_answers"](spark, SMALL))
    answers = next(i for i, line in enumerate(plan) if "Join Inner" in line)
    assert "strategy=broadcast" in plan[answers]
    # each request of each user is made there, above all windows and shuffles
    assert not any("Window" in line or "RepartitionByExpression" in line or "Sort" in line for line in plan[:answers])


def test_each_site_of_a_requested_url_takes_a_place(spark, tables):
    # eight sites share each of 30 urls, in one list of requests or another; some are followed, some users follow several sites of one url
    supplier = "select * replace (s_suppkey + i * 10 as s_suppkey, concat('Supplier#', (s_suppkey + i * 10) % 30) as s_name) from supplier, range(24) r(i)"
    lineitem = "select * replace (o_custkey % 40 + 40 * (l_linenumber % 4) as l_suppkey) from lineitem join orders on o_orderkey = l_orderkey where o_custkey % 2 = 0"
    lineitem = f"select * exclude (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) from ({lineitem})"
    folder = tables(supplier=supplier, lineitem=lineitem)
    same_as_sql(spark, folder, "registration_answers")
    found = {r.answer for r in registry.QUERIES["registration_answers"](spark, folder).select("answer").distinct().collect()}
    assert found == {"ACTIVE", "PENDING", "INVALID_URL", "MAX_SITES_LIMIT"}


def test_registration_of_one_user_is_the_same_as_by_turns(spark):
    import random

    from gazette.operators import registration

    draw = random.Random(7)
    url = lambda i: f"https://s{i:02}.example/"
    status = {i: draw.choice(["active", "pending", None]) for i in range(20)}
    limits = {u: draw.choice([None, 0, 3, 8, 30]) for u in range(60)}
    follows = {(u, i): draw.random() < 0.5 for u in limits for i in range(20) if draw.random() < 0.15}
    asks = [(u, None if i == 25 else "ftp://x/" if i == 24 else url(i), seq) for u in limits for seq in range(15) for i in [draw.randrange(26)]]
    want = []
    for u, most in limits.items():
        own = {url(i): done for (v, i), done in follows.items() if v == u}
        held, new = len(own), set()
        for _, x, seq in [a for a in asks if a[0] == u]:
            web = x if x and x.startswith("https") else None
            i = int(x[9:11]) if web else None
            full = held >= (5 if most is None else most)
            ready = own.get(web, i in status and status[i] in ("active", None))
            want.append((u, seq, web, "MAX_SITES_LIMIT" if full else "INVALID_URL" if web is None else "ACTIVE" if ready else "PENDING"))
            if web and web not in own and web not in new:
                new.add(web)
                held += 1
    got = registration.answers(
        spark.createDataFrame(asks, "user_id bigint, url string, seq int"), spark.createDataFrame(list(limits.items()), "user_id bigint, max_sites_limit int"),
        spark.createDataFrame([(u, i, done) for (u, i), done in follows.items()], "user_id bigint, site_id bigint, done boolean").selectExpr("user_id", "site_id", "if(done, timestamp_ntz'2024-01-01 00:00:00', null) as registration_completed_at"),
        spark.createDataFrame([(i, url(i), s) for i, s in status.items()], "site_id bigint, site_url string, crawl_status string"),
    )
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
