import datetime as dt
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from gazetide.operators import affiliation as A
from gazetide.operators import digest as D
from gazetide.operators import numbering, policy
from gazetide.plans import weekly as W
from gazetide.sources import catalog as C
from gazetide.sources import profiles
from gazetide.streaming import progress

from test_sources import EY, NOW, SCHEMA

RSS = (
    "<rss><channel><item><title>主權AI及算力建設</title><link>https://mof.test/{n}</link><pubDate>2026-08-0{d}</pubDate></item>"
    "<item><title>舊聞</title><link>https://mof.test/old</link><pubDate>2020-01-01</pubDate></item></channel></rss>"
)


def captures(spark):
    rows = [
        ("行政院", "official-html", 500, EY), ("行政院", "official-rss", 200, RSS.format(n=1, d=5)),
        ("財政部", "primary", 200, RSS.format(n=2, d=3)), ("財政部", "alternate-1", 200, RSS.format(n=2, d=3)),
        ("內政部", "primary", 200, "<table><tr><td>115-08-06<td>x<td><a href='/1'>治安（新聞）</a></table>"),
        ("消防署", "primary", 200, "<table><tr><td><a href='/1'>治安(新聞)</a><td>組<td>115-08-06</table>"),
        ("數位發展部", "primary", 200, "<ul id='ListTable'><li><a href='/p'><b class='title5'>開源 AI</b></a><i class='listDate'>2026-08-07</i></li></ul>"),
        ("中選會", "primary", 200, "<p>維護</p>"),
    ]
    full = [(s, r, "x", "x", "x", 9, code, None, body, 0.25, NOW) for s, r, code, body in rows]
    return spark.createDataFrame(full, SCHEMA)


SOURCES = ["行政院", "財政部", "內政部", "消防署", "數位發展部", "中選會", "無名"]


@pytest.fixture(scope="module")
def run(spark):
    pages = spark.createDataFrame([("https://moda.gov.tw/p", "<article><p>詳情</p></article>")], "url string, body string")
    options = W.RunOptions(sources=SOURCES, date="2026-08-05", dedupe_affiliated=True)
    return W.run_week(
        captures(spark), C.default_catalog(spark), profiles.default_profiles(spark), A.default_affiliation(spark),
        policy.default_policy(), options, detail_pages=pages,
    )


def test_digest_rows(run):
    rows = {r.agency: r for r in run.rows.collect()}
    assert set(rows) == {"行政院", "財政部", "內政部", "數位發展部"}
    assert rows["內政部"].department_path == "消防署 / 組"
    assert rows["數位發展部"].summary == "詳情"
    assert rows["行政院"].link_text == "行政院官網：https://mof.test/1" and rows["行政院"].score == 100


def test_sheets(run):
    rows = run.sheets.collect()
    order = {}
    for r in sorted(rows, key=lambda r: (r.sheet, r.row_no)):
        order.setdefault(r.sheet, []).append((r.row_no, r.agency))
    assert order[D.SHEET_ALL] == [(1, "行政院"), (2, "內政部"), (3, "財政部"), (4, "數位發展部")]
    assert order["財政部"] == [(1, "財政部")] and order["數發部"] == [(1, "數位發展部")]
    # Same rank and score: topics, then digest order decide.
    assert [a for _, a in order[D.SHEET_SELECTED]] == ["行政院", "財政部", "數位發展部"]
    top = next(r for r in rows if r.sheet == D.SHEET_SELECTED and r.row_no == 1)
    assert (top.row_style, top.title_class, top.topic_highlight) == ("high", "cjk", True)
    assert top.link_url == "https://mof.test/1"


def test_report(run):
    report = W.report(run)
    assert report["status"] == "partial_failure" and report["failed_sources"] == ["中選會", "無名"]
    assert report["failure_class_counts"] == {"parser_regression": 1, "unknown": 1}
    assert report["error_counts"] == {"connection": 1, "parse": 1}
    health = report["source_health"]
    assert (health["healthy_count"], health["unstable_count"], health["failed_count"]) == (4, 1, 2)
    assert health["fallback_source_count"] == 1
    quality = report["quality"]
    # Both routes of 財政部 carry the same item: one is a duplicate.
    assert (quality["input_count"], quality["duplicate_count"], quality["output_count"]) == (5, 1, 4)
    assert quality["source_counts"]["無名"] == 0 and quality["source_counts"]["財政部"] == 1
    one = {d["source"]: d for d in report["source_diagnostics"]}
    assert one["行政院"]["route_failure_classes"] == ["source_outage"] and one["財政部"]["item_count"] == 2
    assert report["relevance_policy"]["ruleset_hash"] == "e75be08ee1c5dab8"
    json.dumps(report, default=str)


def test_write_run(spark, run, tmp_path):
    options = W.RunOptions(output_dir=str(tmp_path), fail_on_source_error=True)
    with pytest.raises(W.SourceFailure):
        W.write_run(run, options)
    W.write_run(run, W.RunOptions(output_dir=str(tmp_path)))
    digest = spark.read.parquet(f"{tmp_path}/digest")
    assert digest.where(F.col("sheet") == D.SHEET_ALL).count() == 4
    assert digest.select("week_start").distinct().first()[0] == dt.date(2026, 8, 3)
    book = tmp_path / "本週新聞整理（1150803至1150809）"
    assert spark.read.parquet(f"{book}/{D.SHEET_RULES}").count() == 114
    assert spark.read.parquet(f"{book}/{D.SHEET_VERSION}").count() == 17
    assert spark.read.parquet(f"{tmp_path}/issues").count() == 1
    reports = list(pathlib.Path(tmp_path, "執行紀錄").glob("run_*.json"))
    assert len(reports) == 1
    text = next(reports[0].glob("part-*")).read_text(encoding="utf-8")
    assert json.loads(text)["report_schema_version"] == 4
    W.export_csv(spark, f"{tmp_path}/digest", D.SHEET_ALL, f"{tmp_path}/all_csv")
    csv = spark.read.option("header", True).option("multiLine", True).csv(f"{tmp_path}/all_csv")
    assert csv.columns == D.HEADINGS and csv.count() == 4


def test_a_week_written_again_is_replaced(spark, tmp_path):
    rows = [(dt.date(2026, 8, 3), s, n) for s in ("a", "b") for n in range(3)] + [(dt.date(2026, 8, 10), "c", 1)]
    sheets = spark.createDataFrame(rows, "week_start date, sheet string, row_no long")
    W.write_sheets(sheets, f"{tmp_path}/d")
    W.write_sheets(sheets.where("sheet = 'b' and row_no = 0"), f"{tmp_path}/d")
    left = sorted((r.sheet, r.row_no) for r in spark.read.parquet(f"{tmp_path}/d").collect())
    assert left == [("b", 0), ("c", 1)]


def test_bad_parameters_raise_before_any_job(spark):
    with pytest.raises(ValueError):
        W.run_week(None, None, None, None, None, W.RunOptions(date="2026-08-05", end_date="2026-08-06"))


def test_number_rows_across_tasks(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"))
    got = numbering.number_rows(df.repartition(5), "g", [F.col("id").asc()]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.id, r.row_no))
    assert len(got) == 1000
    for pairs in groups.values():
        assert [n for _, n in sorted(pairs)] == list(range(1, len(pairs) + 1))


def test_progress(spark, tmp_path):
    events = [("a", 1, "started", 4), ("a", 2, "source_started", 4), ("a", 3, "source_finished", 4), ("a", 4, "source_failed", 4),
              ("b", 1, "started", 4), ("c", 1, "completed", 4), ("d", 1, "writing_outputs", 4)]
    df = spark.createDataFrame(events, "run_id string, seq int, kind string, total int")
    got = {r.run_id: (r.completed, r.failed, r.percent) for r in progress.run_progress(df).collect()}
    assert got == {"a": (2, 1, 50), "b": (0, 0, 5), "c": (0, 0, 100), "d": (0, 0, 95)}
    src = str(tmp_path / "in")
    df.where("seq < 3").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    progress.follow(stream(), out, log).awaitTermination()
    df.where("seq >= 3").coalesce(1).write.mode("append").parquet(src)
    progress.follow(stream(), out, log).awaitTermination()
    stored = {r.run_id: (r.completed, r.failed, r.percent) for r in progress.latest(spark.read.parquet(out)).collect()}
    assert stored == got


def test_resent_progress(spark, tmp_path):
    """Repeats within the delay meet the state, later ones the watermark; the state expires."""
    sent, out, log = (str(tmp_path / x) for x in ("sent", "out", "log"))
    kinds = ["source_started", "source_finished", "source_failed"]
    event = lambda n: (n % 3, n, kinds[n % 3 if n % 2 else 1], 40, 1_700_000_000 + n * 60)
    sendings = [range(100), [*range(100, 200), *range(95, 100), 150, 150], [*range(200, 300), *range(0, 20), 199]]
    schema = "run_id long, seq long, kind string, total int, at long"
    for numbers in sendings:
        rows = spark.createDataFrame([event(n) for n in numbers], schema).withColumn("at", F.timestamp_seconds("at"))
        rows.write.mode("append").parquet(sent)
        query = progress.follow_resent(spark.readStream.schema(rows.schema).parquet(sent), out, log, "30 minutes")
        query.awaitTermination()
    state = [p["stateOperators"][0] for p in query.recentProgress]
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 20
    assert state[-1]["numRowsTotal"] < 150
    stored = spark.read.parquet(out)
    once = spark.createDataFrame([event(n) for n in range(300)], schema)
    assert stored.select("epoch").distinct().count() >= 3
    columns = ["run_id", "completed", "failed", "total", "last_kind", "percent"]
    got = sorted(map(tuple, progress.merged(stored).select(columns).collect()))
    assert got == sorted(map(tuple, progress.run_progress(once).select(columns).collect()))
