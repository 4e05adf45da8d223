import datetime

from pyspark.sql import functions as F

from gazette.functions import json_records, records, text, urls


def one_column(spark, values, column):
    """column(F.col("v")) of each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_canonical(spark):
    wanted = {
        "HTTPS://Example.COM:443/notices/1/?b=2&utm_source=x&a=1#top": "https://example.com/notices/1/?a=1&b=2",
        "https://events.example/cs/a/0?url=https%3A%2F%2Fevents.example%2Fevent%2F42%3Fref%3Dmail": "https://events.example/event/42?ref=mail",
        "https://e.example/?return_url=https%253A%252F%252Fo.example%252Fa%253Fz%253D1": "https://o.example/a?z=1",
        "https://n.example//News/NoticeViews/123": "https://n.example/News/views/123",
        "http://u:p@h.example:8080/a?q=%zz&k": "http://h.example:8080/a?k=&q=%25zz",
        "https://x.example./?B=1&a=%EA%B0%80*~&b=0&B=1": "https://x.example/?a=%EA%B0%80%2A~&b=0&B=1",
        "https://x.example:99999/": None, "https://x.example": "https://x.example/", "ftp://example.com/x": None, "": None, None: None,
    }
    got = one_column(spark, list(wanted), urls.canonical)
    assert dict(zip(wanted, got, strict=True)) == wanted
    assert one_column(spark, got, urls.canonical) == got


def test_absolute(spark):
    wanted = {
        "/o/1": "https://h.example/o/1", "o?y": "https://h.example/list/o?y", "?z=1": "https://h.example/list/a?z=1", "#f": "https://h.example/list/a?x=1#f", "//q.example/z": "https://q.example/z",
        "../u/./v/..": "https://h.example/u/", "/a/../b#x": "https://h.example/b#x", "https://user@h.example/x": None, "mailto:a@b": None, "javascript:void(0)": None, " ": None, None: None,
    }
    got = one_column(spark, list(wanted), lambda v: urls.absolute(F.lit("https://h.example/list/a?x=1"), v))
    assert dict(zip(wanted, got, strict=True)) == wanted


def test_dates(spark):
    wanted = {
        "2026-08-24": "2026-08-24", "2026-08-25 18:17:37": "2026-08-25T18:17:37", "26.08.24": "2026-08-24", "2026년 8월 6일": "2026-08-06", "2026년 8월 6차 채용": None, "２０２６．８．６": "2026-08-06",
        "1787901382718": "2026-08-28", "July 3rd, 2026": "2026-07-03", "3 Sept. 2026": "2026-09-03", "2026-13-40 10:00": None, "": None, None: None, "31/02/2026": None,
    }
    got = one_column(spark, list(wanted), text.normal_dates)
    assert dict(zip(wanted, got, strict=True)) == wanted


def test_squeezed(spark):
    assert one_column(spark, [" a\t b\n", "ａ　ｂ ㈜", None, "", "é\u00a0x"], text.squeezed) == ["a b", "a b (주)", "", "", "é x"]


def test_redacted(spark):
    assert one_column(spark, ["https://A.example:8080/x?b=1&a=2&a=3#f", None, "x"], urls.redacted) == ["https://a.example:8080/x?a=&b=", "", ""]


def test_gallery_lists(spark):
    mobile, desktop = "https://m.dcinside.com/board/abc", "https://gall.dcinside.com/mgallery/board/lists/?id=abc&page=2"
    assert one_column(spark, [mobile, desktop, "https://gall.dcinside.com/board/lists?id=a&id=b", "https://x.example/board/abc", "https://m.dcinside.com:8080/board/abc", None], urls.gallery_list_id) == ["abc", "abc", None, None, None, None]
    assert one_column(spark, [f"{mobile}?recommend=1", f"{mobile}?recommend=2", f"{desktop}&exception_mode=recommend", desktop], urls.is_recommended_list) == [True, False, True, False]
    keep = lambda v: urls.keep_list_filter(F.lit(f"{mobile}?recommend=1&p=9"), v)
    assert one_column(spark, [desktop, mobile, "https://m.dcinside.com/board/other", f"{mobile}?recommend=1"], keep) == ["https://gall.dcinside.com/mgallery/board/lists/?id=abc&page=2&exception_mode=recommend", f"{mobile}?recommend=1", "https://m.dcinside.com/board/other", f"{mobile}?recommend=1"]
    post = lambda v: urls.mobile_detail(v, F.lit(mobile), F.lit("77"))
    assert one_column(spark, ["https://gall.dcinside.com/board/view/?id=abc&no=55&page=1", "https://gall.dcinside.com/board/view/?id=abc", "https://gall.dcinside.com/board/view/?id=zzz&no=1", None], post) == [f"{mobile}/55", f"{mobile}/77", "https://gall.dcinside.com/board/view/?id=zzz&no=1", None]


ITEMS = '{"response": {"items": [{"id": "notice-101", "title": "First  notice", "department": "Office", "publishedAt": "2026-07-27", "url": "/notices/101"}, {"id": "notice-102", "title": "Second", "publishedAt": "x", "url": "/notices/102"}]}}'


def extracted(spark, *bodies, base="https://r.example/l/"):
    docs = spark.createDataFrame([(i, b, base) for i, b in enumerate(bodies)], "doc_id bigint, body string, base string")
    return sorted((r.doc_id, r.record_index, r.title, r.author, r.detail_url, r.external_id, r.published_at, r.source_path) for r in json_records.extract(docs).collect())


def test_json_and_jsonp_records(spark):
    wanted = [("First notice", "Office", "https://r.example/notices/101", "notice-101", "2026-07-27"), ("Second", "", "https://r.example/notices/102", "notice-102", None)]
    got = extracted(spark, ITEMS, f"callback({ITEMS});", "not json", "", None, '[{"title": "top"}]', '{"a": []}')
    assert [r[2:7] for r in got] == 2 * wanted
    assert {r[0] for r in got} == {0, 1} and got[1][7] == "$.response.items[1]"


def test_dates_of_a_period_are_not_published(spark):
    got = extracted(spark, '{"data": {"list": [{"sdNm": "A", "rtNm": "Job one", "rtAcptStrtDttm": "2026.08.01 10:00", "rtAcptEndDttm": "2026.08.31 10:00", "rtSeq": 19483}, {"rtNm": "Job two", "rtSeq": 2}]}}')
    assert [(r[2], r[5], r[6]) for r in got] == [("Job one", "19483", None), ("Job two", "2", None)]


def test_keys_by_name_then_by_end_and_links_below(spark):
    own = '{"l": [{"z_title": "T", "thumbnailUrl": "https://a.example/x.png", "author": "A", "avatar": {"url": "https://no.example/1"}, "meta": {"deep": {"pageLink": "/p/1"}}, "endDate": "2020-01-01", "modDate": "2021.2.3"}]}'
    last = '{"l": [{"subject": "S", "Title": "T1", "title": "T2", "url": "https://a.example/x.PNG?1", "node": {"href": "  "}, "other": {"link": "/q"}}]}'
    got = extracted(spark, own, last)
    assert [(r[2], r[4], r[6]) for r in got] == [("T", "https://r.example/p/1", "2021-02-03"), ("T2", "https://r.example/q", None)]


def test_the_array_of_most_titles_wins_and_the_first_of_equals(spark):
    body = '{"b": {"deep": [[{"x": {"rows": [{"title": "no"}]}}]]}, "a": [{"name": "one", "k": 1}], "c": [{"name": "two", "k": 1}], "d": [{"name": ""}, {"name": null}]}'
    assert [r[2] for r in extracted(spark, body)] == ["one"]


def test_rule_outcomes(spark):
    from gazette.functions import rules

    rule = rules.JsonRule("$.l", {"title": "$.t", "external_id": "$.id", "detail_url": "$.u", "published_at": "$.d"})
    body = '{"l": [{"t": "A", "id": "1", "token": "s3cret", "u": "/a"}, {"t": " ", "id": "2"}, {"t": "B", "id": "1"}, 7, {"t": "C", "d": "2026.1.2"}, {"t": "c", "d": "2026-01-02"}]}'
    docs = spark.createDataFrame([(1, body), (2, '{"l": []}'), (3, '{"m": 1}'), (4, None), (5, '{"l": [{}]}')], "doc_id bigint, body string")
    rows = {(r.doc_id, r.record_index): r for r in rules.run(docs, rule, "doc_id", "body", "https://h.example/").collect()}
    assert {k: r.outcome for k, r in rows.items()} == {(1, 0): "notice", (1, 1): "rejected", (1, 2): "duplicate", (1, 4): "notice", (1, 5): "duplicate", (5, 0): "rejected"}
    first = rows[1, 0]
    assert (first.evidence_id, first.source_path, first.detail_url, first.field_values.detail_url) == ("executed-record-0", "$.l[0]", "https://h.example/a", "/a")
    assert "s3cret" not in first.visible_text and '"token":"[REDACTED]"' in first.visible_text
    assert rows[1, 1].evidence_id == "rejected-record-1" and rows[5, 0].visible_text == "{}"
    sums = {r.doc_id: tuple(r)[1:] for r in rules.results(docs, rule, "doc_id", "body", "https://h.example/").collect()}
    assert sums == {1: ("success", 5, 2, 2, 1), 2: ("empty", 0, 0, 0, 0), 3: ("failed", 0, 0, 0, 0), 4: ("failed", 0, 0, 0, 0), 5: ("empty", 1, 0, 0, 1)}


def test_html_records(spark):
    body = '<nav><ul><li><a href="/x">Menu entry</a></li><li><a href="/y">Other entry</a></li></ul></nav><table class="board"><tr><td><a href="/n/1">First notice</a></td><td class="author">Office</td><td><time datetime="2026-08-01">1</time></td></tr><tr><td><a href="/n/2">Second notice</a><td><time datetime="2026-08-02"></table>'
    docs = spark.createDataFrame([(1, body, "https://b.example/list"), (2, "", "https://b.example"), (3, ITEMS, "https://b.example/")], "doc_id bigint, body string, base string")
    got = sorted((r.doc_id, r.title, r.detail_url, r.published_at) for r in records.extract(docs, "doc_id", "body", "base").collect())
    assert got[:2] == [(1, "First notice", "https://b.example/n/1", "2026-08-01"), (1, "Second notice", "https://b.example/n/2", "2026-08-02")]
    assert [r[1] for r in got[2:]] == ["First notice", "Second"]


def test_relative_time(spark):
    now = F.lit("2026-08-25 18:17:37").cast("timestamp_ntz")
    df = spark.createDataFrame([("3시간 전",), ("2일 전",), ("1년 전",), ("",), ("방금",)], "s string").select(text.relative_time(F.col("s"), now).alias("t"))
    day = datetime.datetime
    assert [r.t for r in df.collect()] == [day(2026, 8, 25, 15), day(2026, 8, 23), day(2025, 8, 25), day(2026, 8, 25), day(2026, 8, 25, 18, 17, 37)]
