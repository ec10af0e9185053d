import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gazetide.operators import health, lookup
from gazetide.sources import catalog as C
from gazetide.sources import archive, details, extract, markup, profiles, reports

NOW = dt.datetime(2026, 8, 9)
SCHEMA = (
    "source string, route_id string, url string, kind string, parser string, priority int, status_code int, "
    "transport_error string, body string, elapsed_seconds double, fetched_at timestamp"
)


def parse(spark, rows):
    full = [
        (r["source"], r.get("route_id", "primary"), r.get("url", "https://example.test/list"), r.get("kind", "html"),
         r.get("parser", "standard"), 1, r.get("status", 200), r.get("error"), r["body"], 0.5, NOW)
        for r in rows
    ]
    captures = spark.createDataFrame(full, SCHEMA)
    done = extract.parse_captures(captures, profiles.default_profiles(spark)).collect()
    return {(r.source, r.route_id): r for r in done}


def one(spark, source, body, **more):
    return next(iter(parse(spark, [{"source": source, "body": body, **more}]).values()))


def test_catalog(spark):
    catalog = C.default_catalog(spark)
    assert catalog.count() == 72
    assert [r.name for r in C.source_names(catalog).take(2)] == ["行政院", "監察院"]
    routes = C.expand_routes(catalog)
    rows = {}
    for r in routes.orderBy("src_order", "attempt_no").collect():
        rows.setdefault(r.source, []).append(r)
    assert len(rows) == 72 and all(r.official and r.route_id and r.url for rs in rows.values() for r in rs)
    assert rows["漁業署"][0].route_id == "primary-html" and rows["漁業署"][1].kind == "rss"
    assert [r.kind for r in rows["文化部"]] == ["html", "browser"]
    assert any(r.coverage_reduced for r in rows["矯正署"])
    assert len(rows["財政部"]) == 2 and rows["財政部"][0].aggregate_routes and rows["財政部"][0].kind == "rss"
    assert [r.route_id for r in rows["司法院"]] == ["primary"] + [f"alternate-{i}" for i in range(1, 5)]
    assert [r.attempt_no for r in rows["司法院"]] == [1, 2, 3, 4, 5]


def test_selection_and_worklist(spark):
    catalog = C.default_catalog(spark)
    got = C.select_sources(catalog, ["財政部", "無此來源", "財政部", "行政院"]).orderBy("pos").collect()
    assert [(r.source, r.known) for r in got] == [("財政部", True), ("無此來源", False), ("行政院", True)]
    assert C.select_sources(catalog, []).count() == 72
    jobs = spark.createDataFrame([("乙", 1), ("甲", 2), ("丙", 2)], "source string, priority int")
    assert [r.source for r in C.worklist(jobs).collect()] == ["丙", "甲", "乙"]


def test_catalog_defaults(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps([
        {"src_order": 0, "name": "甲", "urls": ["https://a.test/x.XML", "https://a.test/y"]},
        {"src_order": 1, "name": "乙", "urls": ["https://b.test"], "routes": [
            {"id": "second", "url": "https://b.test/2", "priority": 2}, {"id": "first", "url": "https://b.test/1"}]},
    ], ensure_ascii=False), encoding="utf-8")
    rows = C.expand_routes(C.read_catalog(spark, str(path))).orderBy("src_order", "attempt_no").collect()
    assert [(r.route_id, r.kind, r.parser) for r in rows] == [
        ("primary", "rss", "standard"), ("alternate-1", "html", "standard"),
        ("first", "html", "primary"), ("second", "html", "primary"),
    ]


def test_latest_captures(spark):
    old = ("甲", "p", "https://a", "html", "standard", 1, 200, None, "old", 0.1, NOW - dt.timedelta(days=1))
    new = ("甲", "p", "https://a", "html", "standard", 1, 200, None, "new", 0.1, NOW)
    got = C.latest_captures(spark.createDataFrame([old, new, new], SCHEMA)).collect()
    assert [r.body for r in got] == ["new"]


FEED = """<?xml version="1.0"?><rss xmlns:dc="urn:dc"><channel><title>頻道</title>
<item><guid isPermaLink="false">uuid-only</guid><link>https://EXAMPLE.test/news?a=1&amp;b=2</link>
<title><![CDATA[完整  標題]]></title><description><![CDATA[<p>完整<b>摘要</b></p>]]></description>
<pubDate>Thu, 06 Aug 2026 03:00:00 GMT</pubDate><dc:title>不應覆寫</dc:title><dc:date>2026-08-05</dc:date>
<dc:creator>來源：新聞科</dc:creator><category>一</category><category>二</category></item>
<item><title>附件新聞</title><link>https://example.test/2</link>
<attachments><item><title>附件</title><link>https://example.test/file</link></item></attachments></item>
<item><title>沒有連結</title></item>
</channel></rss>"""


def test_feed(spark):
    r = one(spark, "行政", FEED, kind="rss")
    assert r.failure_class == "" and len(r["items"]) == 2
    a, b = r["items"]
    assert (a.title, a.link, a.date) == ("完整 標題", "https://example.test/news?a=1&b=2", "Thu, 06 Aug 2026 03:00:00 GMT")
    assert (a.summary, a.department, a.category, a.date_source) == ("完整 摘要", "新聞科", "一", "published")
    assert (b.title, b.link, b.department) == ("附件新聞", "https://example.test/2", "行政")


def test_atom(spark):
    body = (
        '<feed><entry><title><![CDATA[第一則]]></title><link href="https://example.test/1"/><updated>2026-08-04</updated>'
        "<author><name>某人</name></author><dc:creator>第一單位</dc:creator></entry>"
        '<entry><title>第二則</title><link href="https://example.test/2"/><published>2026-08-05</published></entry></feed>'
    )
    a, b = one(spark, "測試來源", body)["items"]
    assert (a.link, a.department, a.date_source) == ("https://example.test/1", "第一單位", "updated")
    assert (b.title, b.department, b.date) == ("第二則", "測試來源", "2026-08-05")


def test_feed_contact_department_and_errors(spark):
    body = (
        "<rss><channel><item><title>金融新聞</title><link>https://example.test/n</link><description><![CDATA[<p>聯絡單位："
        "銀行局本國銀行組 王科長 聯絡電話：(02)1234 聯絡單位：保險局 聯絡電話：1</p>]]></description></item></channel></rss>"
    )
    assert one(spark, "金管會", body, kind="rss")["items"][0].department == "銀行局本國銀行組、保險局"
    bad = one(spark, "甲", "<rss><item></rss>", kind="rss")
    assert bad.failure_class == "parser_regression" and bad["items"] == []
    assert markup.feed_fields("<rss><item><title>x</title></item>") == [[("title", "x")]]


EY = """<ul class="grid effect list-group-item"><li><a href="/Page/item-one"><div class="title">主權 AI</div>
<span class="date">115-08-06</span><p>不要</p></a></li><li><a href="https://other.test/two"><div class="title">記者會</div>
<span class="date">115-08-05</span></a></li><li><a href="/x"><div class="title">無日期</div></a></li></ul>"""


def test_dated_list(spark):
    r = one(spark, "行政院", EY, parser="ey-html")
    assert [(i.pos, i.date, i.title, i.link, i.summary, i.department) for i in r["items"]] == [
        (0, "2026-08-06", "主權 AI", "https://example.test/Page/item-one", "", "行政院"),
        (1, "2026-08-05", "記者會", "https://other.test/two", "", "行政院"),
    ]
    gone = one(spark, "行政院", "<p>維護中</p>", parser="ey-html")
    assert gone.failure_class == "parser_regression" and "does not contain" in gone.message


def test_table_layouts_and_title_rules(spark):
    table = (
        "<table><tr><td>115-08-06<td>民政司<td><a href='/n/1'>點擊前往 公告</a>"
        "<tr><td>115-08-05</td><td>內政部</td><td><a href='/n/2'>次則</a></td></tr></table>"
    )
    rows = parse(spark, [{"source": "內政部", "body": table}, {"source": "榮總", "body": table}])
    moi = rows["內政部", "primary"]["items"]
    assert [(i.title, i.department) for i in moi] == [("點擊前往 公告", "內政部／民政司"), ("次則", "內政部")]
    assert rows["榮總", "primary"]["items"][0].title == "公告"
    env = one(spark, "環境部", "<ul class='list_group'><li><a href='/a'>淨零 115-08-06</a><time>115-08-06</time></li></ul>")
    assert env["items"][0].title == "淨零"
    edu = one(spark, "國教院", "<ul class='page-list'><li><a class='txt' href='/a'>t</a><div class='page-list-info'>"
              "<span class='date'>2026/08/06</span><span class='unit'>中心</span><span class='type'>類</span></div></li></ul>")
    assert (edu["items"][0].department, edu["items"][0].category) == ("國教院／中心", "類")


def test_special_layouts(spark):
    pages = {
        "外交部": "<table><tbody><tr><td>2026-08-06</td><td><a href='/1'>外交</a></td></tr></tbody></table>",
        "僑委會": '<ul class="text_list"><li><a href="/1">2026/08/06 僑務新聞</a></li></ul>',
        "防檢署": "<a href='theme_data.php?theme=NewInfoListWS&id=1'>115-08-06 防疫</a>",
        "交通部": "<div class='list_group'><div class='list'><ul><li><a href='/1' title='路政'>路政 115-08-06 發布單位：路政司</a></li></ul></div></div>",
        "勞動部": "<div class='item_listblock'><div class='item_list2'><h3><a href='/1'>勞工</a></h3><div class='data'>發布單位：條平司 更新日期：115-08-06</div></div></div>",
        "中選會": "<div class='article-item'>115.08.06 選務</div>",
        "疾管署": "<a href='/Bulletin/Detail/x' title='疫情'><p class='icon-year'>2026 - 8</p><p class='icon-date'>6</p></a>",
        "經濟部": "<div id='holderContent_grdNews'><table><tr><td><span class='begin-date-yy'>115</span><span class='begin-date-mm'>8月</span>"
        "<span class='begin-date-dd'>06</span><a href='n.aspx?news_id=1'>產業</a><span class='org-name'>版權來自：工業局</span></td></tr></table></div>",
    }
    rows = parse(spark, [{"source": s, "body": b} for s, b in pages.items()])
    got = {s: rows[s, "primary"]["items"][0] for s in pages}
    assert {i.date for i in got.values()} == {"2026-08-06"}
    assert {s: i.title for s, i in got.items()} == {
        "外交部": "外交", "僑委會": "僑務新聞", "防檢署": "防疫", "交通部": "路政", "勞動部": "勞工", "中選會": "選務",
        "疾管署": "疫情", "經濟部": "產業",
    }
    assert got["交通部"].department == "交通部／路政司" and got["勞動部"].department == "勞動部／條平司"
    assert got["經濟部"].department == "經濟部／工業局" and got["中選會"].link == "https://example.test/list"


def test_json_sources(spark):
    cms = json.dumps([{"publish_up": "2026-08-06T01:00:00Z", "title": "公園新聞", "id": "abc", "jsh_unit": {"name": "國家公園署"}},
                      {"publish_up": "2026-08-06", "title": "二", "id": 7, "jsh_unit": {"name": "企劃組"}},
                      {"publish_up": "x", "title": "三", "id": 8}])
    thb = json.dumps([{"Source": "https://www.thb.gov.tw/a?s=1", "Title": "道路新聞", "公告日期": "2026-08-03T16:37:00",
                       "內容": "<p>施工<b>交管</b></p>", "資料來源": "東區養護工程分局-秘書室"}])
    nics = '<script id="__NEXT_DATA__" type="application/json">' + json.dumps(
        {"props": {"pageProps": {"data": {"content": [{"data": {"item": [{"date": "2026-08-06", "label": "資安", "link": "/n/1"}]}}]}}}}
    ) + "</script>"
    rows = parse(spark, [
        {"source": "國家公園署", "body": cms, "kind": "json"},
        {"source": "公路局", "body": thb, "parser": "thb-json"},
        {"source": "國家資通安全研究院", "body": nics},
        {"source": "國土管理署", "body": "oops", "kind": "json"},
        {"source": "國家資通安全研究院", "route_id": "b", "body": "<html/>"},
    ])
    park = rows["國家公園署", "primary"]["items"]
    assert [(i.date, i.link.rsplit("/", 1)[1], i.department) for i in park] == [
        ("2026-08-06", "abc", "國家公園署"), ("2026-08-06", "7", "國家公園署／企劃組")]
    road = rows["公路局", "primary"]["items"][0]
    assert (road.date, road.department, road.summary) == ("2026-08-03", "公路局／東區養護工程分局-秘書室", "施工 交管")
    assert rows["國家資通安全研究院", "primary"]["items"][0].link == "https://example.test/n/1"
    assert rows["國土管理署", "primary"].failure_class == "parser_regression"
    assert rows["國家資通安全研究院", "b"].message.endswith("missing __NEXT_DATA__")


def test_json_is_read_to_its_end(spark):
    one = '[{"publish_up":"2026-08-06","title":"一","id":1}]'
    bodies = {
        "plain": one, "spaces": f" \n{one}\n", "mark": "\ufeff" + one,
        "twice": '[{"publish_up":"2026-08-06","title":"a","title":"一","id":1}]',
        "junk": one + " junk]", "two": f"{one},{one}", "open": one[:-1], "object": '{"a":[]}', "none": " ",
    }
    rows = parse(spark, [{"source": "國家公園署", "route_id": k, "body": b, "kind": "json"} for k, b in bodies.items()])
    for name in bodies:
        row = rows["國家公園署", name]
        if name in ("plain", "spaces", "mark", "twice"):
            assert [i.title for i in row["items"]] == ["一"], name
        else:
            assert row.failure_class and not row["items"], name


def test_link_list_outcomes_and_unknown_parser(spark):
    rows = parse(spark, [
        {"source": "測試", "route_id": "l", "body": '<a class="news" href="/news/1">第一則新聞</a><a>無</a><a href="/2"> </a>'},
        {"source": "測試", "route_id": "u", "parser": "missing-adapter", "body": "<html></html>"},
        {"source": "測試", "route_id": "h", "status": 503, "body": "x"},
        {"source": "測試", "route_id": "t", "status": None, "error": "timeout", "body": None},
        {"source": "測試", "route_id": "b", "kind": "browser", "body": "Request unsuccessful"},
    ])
    links = rows["測試", "l"]["items"]
    assert [(i.title, i.link, i.date, i.department) for i in links] == [("第一則新聞", "https://example.test/news/1", "", "")]
    assert [rows["測試", k].failure_class for k in "uhtb"] == [
        "parser_regression", "source_outage", "runner_network", "browser_runtime"]
    assert rows["測試", "h"].message == "來源暫時故障：HTTP 503"


def test_html_tree():
    page = markup.parse_html("<div><p>a<b>b<p>c</div><p>d &amp; e<br>f<!-- x -->g")
    assert [p.text() for p in markup.select(page, "p")] == ["a b", "c", "d & e f g"]
    assert [p.text() for p in markup.select(page, "div > p:last-child")] == ["c"]
    assert markup.html_text("<p>a</p>b") == "a b"
    with pytest.raises(ValueError):
        markup.compile_selector("a + b")


def test_detail_summary_and_enrichment(spark):
    body = f"<article class='cpArticle'><p>{'字' * 1250}</p><p>第二段</p></article>"
    items = spark.createDataFrame(
        [(1, "數位發展部", "https://x/1", ""), (2, "數位發展部", "https://x/2", ""), (3, "財政部", "https://x/1", ""),
         (4, "國科會", "https://x/3", "有")],
        "ord long, source string, link string, summary string",
    )
    pages = spark.createDataFrame([("https://x/1", body), ("https://x/3", body), ("https://x/9", body)], "url string, body string")
    got = {r.ord: r.summary for r in details.enrich(items, pages).collect()}
    assert got == {1: "字" * 1200, 2: "", 3: "", 4: "有"}
    css = spark.createDataFrame([("經濟部", "<div class='cpArticle'> 文 <i>字</i></div>")], "s string, b string")
    assert css.select(details.detail_summary(F.col("s"), F.col("b"))).first()[0] == "文 字"


def test_legacy_report(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"status":"success","quality":{"alert_reasons":[]},"output_file":"a.xlsx"}')
    r = reports.read_reports(spark, str(path)).first()
    assert (r.status, r.failed_sources, r.output_file, r.report_file) == ("success", [], "a.xlsx", "")
    assert r.quality.alert_reasons == [] and r.failure_class_counts == {}


def attempts(spark, rows):
    full = [
        (s, n, f"r{n}", f"https://{s}/{n}", f"{s}", "html", "standard", n, reduced, together, status, 0.5, 3,
         "" if status == "success" else "source_outage", "" if status == "success" else "connection", "m")
        for s, n, status, together, reduced in rows
    ]
    return spark.createDataFrame(
        full,
        "source string, attempt_no int, route_id string, url string, url_host string, route_kind string, parser string, "
        "priority int, coverage_reduced boolean, aggregate_routes boolean, status string, elapsed_seconds double, "
        "item_count long, failure_class string, error_category string, message string",
    )


def test_health(spark):
    made = health.made_attempts(attempts(spark, [
        ("ok", 1, "success", False, False), ("ok", 2, "failed", False, False),
        ("fallback", 1, "failed", False, False), ("fallback", 2, "success", False, True),
        ("dead", 1, "failed", False, False),
        ("many", 1, "success", True, False), ("many", 2, "failed", True, False), ("many", 3, "success", True, False),
    ]))
    results = health.source_results(made)
    rows = {r.source: r for r in results.collect()}
    assert rows["ok"].attempt_count == 1 and not rows["ok"].unstable
    assert rows["fallback"].used_fallback and rows["fallback"].unstable and rows["fallback"].coverage_reduced
    assert (rows["dead"].status, rows["dead"].failure_class) == ("failed", "source_outage")
    assert rows["many"].final_route_id == "r3" and not rows["many"].used_fallback and rows["many"].attempt_count == 3
    roll = health.health_rollup(results).first()
    assert (roll.healthy_count, roll.unstable_count, roll.failed_count, roll.fallback_source_count) == (1, 2, 1, 1)
    assert roll.coverage_reduced_count == 1
    won = {(r.source, r.route_id) for r in health.winning_routes(made, results).collect()}
    assert won == {("ok", "r1"), ("fallback", "r2"), ("many", "r1"), ("many", "r3")}
    selected = spark.createDataFrame([("ok", True), ("ghost", False), ("mute", True)], "source string, known boolean")
    extra = {r.source: r for r in health.with_unknown_sources(results, selected).collect()}
    assert (extra["ghost"].failure_class, extra["ghost"].error_category) == ("unknown", "unexpected")
    assert extra["mute"].failure_class == "source_outage"
    assert {r.failure_class: r.source_count for r in health.failure_class_counts(results).collect()} == {"source_outage": 1}
    assert {r.error_category: r.attempt_count for r in health.error_category_counts(made).collect()} == {"connection": 3}


def test_default_catalog_is_as_published(spark):
    rows = {r.name: r for r in C.default_catalog(spark).collect()}
    assert len(rows) == 72
    # Fallback addresses are routes of their own and no addresses of the publisher.
    for name in ("矯正署", "農業金融署", "漁業署", "社家署", "環境部", "工程會"):
        assert len(rows[name].urls) == 1 and len(rows[name].routes) == 2
        assert rows[name].routes[0].url == rows[name].urls[0] != rows[name].routes[1].url
    assert [r.name for r in rows.values() if r.aggregate_routes] == ["司法院", "財政部"]


def test_json_pages_are_strict(spark):
    cases = {
        '{"error":"down"}': None, '{"title":"t","publish_up":"2026-08-05","id":1}': None, '[{"title":"t"}] junk': None, "": None, "[]": 0,
        '[{"title":"t","publish_up":"2026-08-05","id":1},7,"x",null]': 1, ' [{"title":"t","publish_up":"2026-08-05","id":"2"}]\n': 1,
    }
    rows = [("國家公園署", f"r{n}", "https://x.test", "json", "nps-json", 1, 200, None, body, 0.1, NOW) for n, body in enumerate(cases)]
    got = {r.route_id: r for r in extract.parse_captures(spark.createDataFrame(rows, SCHEMA), profiles.default_profiles(spark)).collect()}
    for n, want in enumerate(cases.values()):
        assert (None if got[f"r{n}"].failure_class else len(got[f"r{n}"]["items"])) == want, list(cases)[n]


def test_capture_gaps(spark):
    captures = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2")], "source string, route_id string")
    routes = spark.createDataFrame([("a", "1"), ("a", "2")], "source string, route_id string")
    assert sorted(tuple(r) for r in C.capture_gaps(captures, routes).collect()) == [("a", "2", "no_capture"), ("b", "2", "no_route")]


def test_archive_of_captures(spark, tmp_path):
    day = lambda n: NOW + dt.timedelta(days=n)
    row = lambda route, n, body, status=200: ("甲", route, "https://a", "html", "standard", 1, status, None, body, 0.1, n and day(n))
    rows = [row("p", 1, "first"), row("p", 2, "second"), row("p", 2, "second"), row("p", 9, "late"), row("q", 2, "x", 200),
            row("q", 2, "y", 404), row("r", 9, "outside"), row("s", None, "no time"), row("t", 1, None)]
    archive.add_captures(spark.createDataFrame(rows[:4], SCHEMA), str(tmp_path))
    archive.add_captures(spark.createDataFrame(rows[4:], SCHEMA), str(tmp_path))
    table = spark.read.parquet(str(tmp_path))
    days = archive.captures_between(table, day(1).date(), day(3).date())
    got = archive.newest_captures(days)
    assert sorted(got.columns) == sorted(c.split()[0] for c in SCHEMA.split(", "))
    assert {(r.route_id, r.body) for r in got.collect()} == {("p", "second"), ("q", "y"), ("t", None)} and got.count() == 3
    everything = archive.newest_captures(archive.captures_between(table, None, None))
    assert {(r.route_id, r.body) for r in everything.collect()} == {("p", "late"), ("q", "y"), ("r", "outside"), ("s", "no time"), ("t", None)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "fetch_day" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "Sort" not in plan and "hashpartitioning" not in plan  # nothing with a body is sorted or shuffled
    assert archive.newest_captures(days.where("false")).count() == 0


def test_only_hot_keys_are_salted(spark, monkeypatch):
    rows = [(f"s{i % 7}" if i % 2 else "hot", i + 1, "failed" if i % 3 else "success", i % 5 == 0, False) for i in range(200)]
    want = sorted(map(tuple, health.made_attempts(attempts(spark, rows)).select("source", "attempt_no").collect()))
    for least, share in ((50, 1000), (1, 1000), (50, 1)):
        monkeypatch.setattr(lookup, "HOT_ROWS", least)
        monkeypatch.setattr(lookup, "HOT_SHARE", share)
        got = health.made_attempts(attempts(spark, rows)).select("source", "attempt_no").collect()
        assert sorted(map(tuple, got)) == want
