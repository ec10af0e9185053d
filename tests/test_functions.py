import datetime as dt

import pytest
from pyspark.sql import functions as F

from gazetide.functions import dates, outcomes, text, urls

D = dt.date


def test_clean_and_keys(evaluate):
    assert evaluate(text.clean_text, ["  一\n二\r\n三  ", "a　 b", ""]) == ["一 二 三", "a b", ""]
    assert evaluate(text.title_key, ["同一則（新聞）", "同一則 (新聞)"]) == ["同一則(新聞)"] * 2
    assert evaluate(text.match_text, ["AI （GPU）"]) == ["ai(gpu)"]
    assert evaluate(lambda c: text.collapsed_summary(c, 3), [" 一\n二三 四"]) == ["一 二"]


def test_limits_and_cjk(evaluate):
    assert len(evaluate(lambda c: text.cut(c, text.CELL_LIMIT), ["字" * 32_777])[0]) == 32_767
    assert evaluate(text.text_class, ["abc", "a字", "𠀀"]) == ["latin", "cjk", "cjk"]


def test_department(evaluate):
    got = evaluate(
        text.department_name,
        ["版權所有： 發布單位:民政司", "1.2.3.4.5", "https://x.test", "WWW.x.test", "A＞B>C", "來源單位", "版權\uf92d自：甲", "版權來自:乙"],
    )
    assert got == ["民政司", "", "", "", "A／B／C", "來源單位", "甲", "乙"]
    alias = evaluate(
        lambda c: text.is_department_alias(F.lit("國發會"), c), ["國發會", "國家發展委員會", "行政院國發會", "綜合處"]
    )
    assert alias == [True, True, True, False]


def test_labels_and_links(evaluate):
    assert evaluate(lambda c: text.labelled_value(c, "發布單位"), ["發布單位：路政司 x", "無"]) == ["路政司", ""]
    assert evaluate(text.first_web_url, ["x http://a https://b", "y http://a", "none"]) == ["https://b", "http://a", None]
    assert evaluate(lambda c: text.site_link(F.lit("甲"), c), ["https://a", "b"]) == ["甲官網：https://a", "b"]
    assert evaluate(lambda c: dates.labelled_date(c, "發布日期"), ["發布日期：115-08-06", "115-08-06"]) == [
        D(2026, 8, 6), None,
    ]


def test_parse_date(evaluate):
    cases = {
        "Wed, 24 Jun 2026 16:00:00 GMT": D(2026, 6, 25),
        "2026-06-24T16:30:00Z": D(2026, 6, 25),
        "2026-06-24": D(2026, 6, 24),
        "2026/6/4": D(2026, 6, 4),
        "2026年6月24日": D(2026, 6, 24),
        "2026-06-24T01:30:00.25+08:00": D(2026, 6, 24),
        "24 Jun 2026 23:59 +0800": D(2026, 6, 24),
        "Wed, 24 Jun 26 16:00:00 EST": D(2026, 6, 25),
        "posted 2026/06/24 12:00": D(2026, 6, 24),
        "Thu, 24 Jun 2026 16:00:00 GMT": None,
        "2026-13-40": None,
        "2026-02-30": None,
        "garbage": None,
        "": None,
    }
    assert evaluate(dates.parse_date, list(cases)) == list(cases.values())


def test_parse_list_date(evaluate):
    cases = {
        "115-08-06": D(2026, 8, 6),
        "115.8.6 消息": D(2026, 8, 6),
        "2026年8月6日": D(2026, 8, 6),
        "2026-08-06T01:00:00Z": D(2026, 8, 6),
        "115-08-061": None,
        "日期 2026/08/06": D(2026, 8, 6),
        "115-02-30": None,
        "none": None,
    }
    assert evaluate(dates.parse_list_date, list(cases)) == list(cases.values())


def test_roc(evaluate):
    day = lambda c: F.to_date(c)
    assert evaluate(lambda c: dates.roc_date(day(c)), ["2026-08-06"]) == ["民國115/8/6"]
    assert evaluate(lambda c: dates.roc_compact(day(c)), ["2026-08-06", "1999-01-02"]) == ["1150806", "0880102"]


def test_week_parameters():
    assert dates.resolve_range(date="2026-08-03") == dates.DateRange(D(2026, 8, 3), D(2026, 8, 9))
    assert dates.resolve_range(today=D(2026, 8, 3)) == dates.DateRange(D(2026, 7, 27), D(2026, 8, 2))
    assert dates.resolve_range(today=D(2026, 8, 5)) == dates.DateRange(D(2026, 8, 3), D(2026, 8, 9))
    assert dates.resolve_range(date="2026-08-03").roc_label() == "1150803至1150809"
    for bad in (
        dict(date="2026-08-03", start_date="2026-08-01", end_date="2026-08-02"),
        dict(start_date="2026-08-01"),
        dict(start_date="2026-08-05", end_date="2026-08-01"),
        dict(date="05/08/2026"),
    ):
        with pytest.raises(ValueError):
            dates.resolve_range(**bad)


def test_normalize_url(evaluate):
    cases = {
        "https://EXAMPLE.test/news?id=1&utm_source=test#part": "https://example.test/news?id=1",
        "https://example.test": "https://example.test/",
        "HTTP://Example.test:80/a/../b?UTM_Medium=1": "http://example.test/b",
        "https://example.test:8443/x?a=b c&d": "https://example.test:8443/x?a=b+c&d=",
        "https://example.test/路?名=值": "https://example.test/%E8%B7%AF?%E5%90%8D=%E5%80%BC",
        "https://example.test/a%2Fb?x=%zz": "https://example.test/a%2Fb?x=%25zz",
        "not-a-url": None,
        "ftp://example.test/": None,
        "https:///": None,
        "https://exa mple.test/": None,
        "https://example.test:99999/": None,
    }
    assert evaluate(urls.normalize_url, list(cases)) == list(cases.values())


def test_resolve_url(evaluate):
    base = F.lit("https://Example.test/dir/list?page=2#x")
    cases = {
        "/news/1": "https://example.test/news/1",
        "item": "https://example.test/dir/item",
        "../up?x=1": "https://example.test/up?x=1",
        "?page=3": "https://example.test/dir/list?page=3",
        "#frag": "https://example.test/dir/list?page=2#frag",
        "//other.test/a": "https://other.test/a",
        "https://Other.test": "https://other.test/",
        "mailto:a@b.test": "mailto:a@b.test",
        "/für": "https://example.test/f%C3%BCr",
        "": "https://example.test/dir/list?page=2",
    }
    assert evaluate(lambda c: urls.resolve_url(base, c), list(cases)) == list(cases.values())
    assert evaluate(urls.url_host, ["https://A.test:8/x", "nope"]) == ["a.test", ""]
    assert evaluate(urls.serialize_url, ["https://EXAMPLE.test/news?a=1&b=2", "uuid-only"]) == [
        "https://example.test/news?a=1&b=2", "uuid-only",
    ]


def test_outcomes(spark):
    rows = spark.createDataFrame(
        [
            ("html", 200, None, "ok", ""),
            ("html", 403, None, "", "access_blocked"),
            ("html", 503, None, "", "source_outage"),
            ("html", 404, None, "", "parser_regression"),
            ("html", None, "timeout", "", "runner_network"),
            ("html", None, "request", "", "source_outage"),
            ("html", None, "odd", "", "unknown"),
            ("browser", 200, None, "Request unsuccessful", "browser_runtime"),
            ("browser", 200, None, "fine", ""),
        ],
        "kind string, status int, err string, body string, want string",
    ).select("want", outcomes.capture_failure(F.col("kind"), F.col("status"), F.col("err"), F.col("body")).alias("got"))
    assert all(r.want == r.got for r in rows.collect())
    classes = spark.createDataFrame([("source_outage",), ("runner_network",), ("parser_regression",)], "c string")
    assert [r[0] for r in classes.select(outcomes.retryable(F.col("c"))).collect()] == [True, True, False]
    assert [r[0] for r in classes.select(outcomes.error_category(F.col("c"))).collect()] == [
        "connection", "connection", "parse",
    ]
