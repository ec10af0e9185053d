"""Items, attempts, captures and policies derived from the driver's tables, which hold no
news themselves. Every derivation is a projection of whole tables (captures group eight
neighbouring documents to a page), so its work grows with them."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetide.functions.dates import DateRange, week_of
from gazetide.functions.outcomes import FAILURE_CLASSES
from gazetide.functions.text import clean_text
from gazetide.operators.policy import Policy, Topic
from gazetide.schemas import as_items
from gazetide.session import small_table

FIRST_DAY = "2026-07-27"
WEEK: DateRange = week_of(dt.date(2026, 8, 3))
NON_NEWS = "事求人機關徵才系統"

TEST_POLICY = Policy(
    version="test",
    topics=(
        Topic("Thandthe", "src1", ("ingre", "Ouon"), ("nt er", "thaner")),
        Topic("Leauou", "src2", ("eauxde", "çon"), ("éen", "La le")),
        Topic("schein", "src3", ("chund", "ungen"), ("der die", "ü")),
        Topic("ciónla", "src4", ("ñoes", "osde"), ("que los", "ía")),
    ),
    general=("AI", "of the", "des"),
    negative=("hat", "Bulletin"),
)

AFFILIATION_PATHS = {
    **{f"src{i}": ["src0", f"src{i}"] for i in range(1, 10)},
    "src11": ["src10", "src11"],
    "src12": ["src10", "src11", "src12"],
    "src0": [],
    "src10": [],
}
AGENCY_SHEETS = {"src0": "sheet-a", "src10": "sheet-b", "src13": "sheet-c"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def day_of(doc_id: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), (doc_id % 21).cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with ISO dates, among them empty titles, notices, bad links and copies."""
    i = F.col("doc_id")
    line = first_line(F.col("text"))
    title = (
        F.when(i % 97 == 0, F.lit(""))
        .when((i % 5 == 0) & (i % 1000 < 250), F.lit("Bulletin"))
        .when((i % 5 == 0) & (i % 1000 < 500), F.concat(F.lit("Bulletin "), F.col("source")))
        .when(i % 83 == 0, F.concat(line, F.lit(" " + NON_NEWS)))
        .otherwise(line)
    )
    number = F.when(i % 3 == 0, i % 500).otherwise(i).cast("string")
    link = F.when(i % 89 == 0, F.lit("not-a-url")).otherwise(
        F.concat(F.lit("https://EXAMPLE.test/"), "source", F.lit("/"), number, F.lit("?id=1&utm_source=x#p"))
    )
    return as_items(
        table(spark, sf_dir, "documents").select(
            i.alias("ord"),
            "source",
            F.date_format(day_of(i), "yyyy-MM-dd").alias("date"),
            F.col("lang").alias("department"),
            title.alias("title"),
            link.alias("link"),
            F.when(i % 7 == 0, F.lit("")).otherwise(F.col("text")).alias("summary"),
            F.when(i % 10 == 0, F.lit("updated")).otherwise(F.lit("published")).alias("date_source"),
        )
    )


def dated_text(day: Column, form: Column) -> Column:
    """A day written in one of seven ways; forms 3 to 5 are instants on the evening before
    in UTC, 6 is no date."""
    before = F.date_sub(day, 1)
    return (
        F.when(form == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(form == 1, F.date_format(day, "yyyy/M/d"))
        .when(form == 2, F.concat(F.lit("posted "), F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:00")))
        .when(form == 3, F.concat(F.date_format(before, "yyyy-MM-dd"), F.lit("T16:30:00Z")))
        .when(form == 4, F.concat(F.date_format(before, "EEE, dd MMM yyyy"), F.lit(" 16:30:00 GMT")))
        .when(form == 5, F.concat(F.date_format(before, "d MMM yyyy"), F.lit(" 11:30 -0500")))
        .otherwise(F.lit("soon"))
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose dates are written as publishers write them."""
    day = F.to_date("date", "yyyy-MM-dd")
    return items(spark, sf_dir).withColumn("date", dated_text(day, F.col("ord") % 7))


def affiliation(spark: SparkSession) -> DataFrame:
    return small_table(spark, list(AFFILIATION_PATHS.items()), "source string, path array<string>")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog with a publisher per supplier: src0, src1, ... in falling order."""
    k = F.col("s_suppkey").cast("int")
    base = F.concat(F.lit("https://Pub"), k.cast("string"), F.lit(".test/"))
    urls = F.when(k % 3 == 0, F.array(F.concat(base, F.lit("RSS")), F.concat(base, F.lit("b.XML")))).otherwise(
        F.array(F.concat(base, F.lit("list")))
    )

    def route(name: str, kind: str, priority: int, reduced: bool) -> Column:
        return F.struct(
            F.lit(name).alias("id"), F.concat(base, F.lit(name)).alias("url"), F.lit(kind).alias("kind"),
            F.lit("standard").alias("parser"), F.lit(priority).alias("priority"), F.lit(True).alias("official"),
            F.lit(reduced).alias("coverage_reduced"),
        )

    named = F.array(route("late", "browser", 2, True), route("early", "html", 1, False), route("later", "html", 2, False))
    return table(spark, sf_dir, "supplier").select(
        (F.lit(1_000_000_000) - k).alias("src_order"),
        F.concat(F.lit("src"), k.cast("string")).alias("name"),
        urls.alias("urls"),
        (k % 4 == 0).alias("aggregate_routes"),
        F.when(k % 5 == 0, named).otherwise(F.slice(named, 1, 0)).alias("routes"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route attempts from events: a user is a source, an error a failed attempt."""
    k = F.get_json_object("props", "$.k").cast("int")
    classes = F.array(*[F.lit(c) for c in FAILURE_CLASSES])
    failed = F.col("event_type") == "error"
    names = list(FAILURE_CLASSES)
    failure = F.when(failed, F.get(classes, k % len(names))).otherwise(F.lit(""))
    category = F.lit("")
    for name, row in FAILURE_CLASSES.items():
        category = F.when(failure == name, F.lit(row[0])).otherwise(category)
    host = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".test"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"),
        F.col("event_id").alias("attempt_no"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("route_id"),
        F.concat(F.lit("https://"), host, F.lit("/"), F.col("event_type")).alias("url"),
        host.alias("url_host"),
        F.lit("html").alias("route_kind"),
        F.lit("standard").alias("parser"),
        (k % 3 + 1).alias("priority"),
        (k % 5 == 0).alias("coverage_reduced"),
        (F.col("user_id") % 4 == 0).alias("aggregate_routes"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        F.col("value").alias("elapsed_seconds"),
        F.when(failed, F.lit(0)).otherwise(k).cast("long").alias("item_count"),
        failure.alias("failure_class"),
        category.alias("error_category"),
        F.when(failed, F.concat(F.lit("k="), k.cast("string"))).otherwise(F.lit("")).alias("message"),
    )


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_events_from(table(spark, sf_dir, "events"))


def run_events_from(events: DataFrame, *more: Column) -> DataFrame:
    """Run events: a user is a run with 200 sources, event types are its steps."""
    kind = (
        F.when(F.col("event_type") == "signup", "started")
        .when(F.col("event_type") == "view", "source_started")
        .when(F.col("event_type") == "error", "source_failed")
        .when(F.col("event_type") == "click", "source_finished")
        .otherwise("writing_outputs")
    )
    return events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.lit(200).alias("total"), *more
    )


SENDINGS = 4


def resent_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Run events with ``at`` and ``sending``, and the seconds that a sending spans: many come twice
    in their sending, some of its later half again in the next, some of the first again in the last."""
    events = run_events_from(table(spark, sf_dir, "events"), F.col("ts").cast("timestamp").alias("at"))
    low, high = events.agg(F.unix_micros(F.min("at")), F.unix_micros(F.max("at"))).first()
    span = ((high or 0) - (low or 0)) // SENDINGS + 1
    place = (F.unix_micros("at") - F.lit(low or 0)) / F.lit(span)
    own = F.floor(place).cast("int")
    sendings = F.array(
        own,
        F.when(F.col("seq") % 3 == 0, own),
        F.when((F.col("seq") % 5 == 0) & (place - own >= 0.5) & (own + 1 < SENDINGS), own + 1),
        F.when((F.col("seq") % 7 == 0) & (own == 0), F.lit(SENDINGS - 1)),
    )
    return events.withColumn("sending", F.explode(F.array_compact(sendings))), span // 1_000_000 + 1


# --- captures ------------------------------------------------------------------------

PER_PAGE = 8
PAGE_URL = "https://News.example/dir/list?page="

# layout -> (publisher, capture kind, parser, row template, page template). Names in braces
# are columns of ``_page_fields``.
PAGE_TEMPLATES = {
    "feed": (
        "財政部", "rss", "standard-rss",
        "<item><guid>g{id}</guid><title>{title}</title><link>https://News.example/a?id={id}&amp;x=1</link>"
        "<description>{twice}</description><pubDate>{mail}</pubDate><dc:creator>來源：{lang}</dc:creator></item>",
        '<?xml version="1.0"?><rss><channel>{rows}</channel></rss>',
    ),
    "dated": (
        "內政部", "html", "standard",
        "<tr><td>{roc}<td>{lang}<td><a href='/n/{id}'>{title}</a>", "<table>{rows}</table>",
    ),
    "row_text": (
        "外交部", "html", "standard",
        "<tr><td>{iso}</td><td><a href='n/{id}?s=1'>{title}</a></td></tr>", "<table>{rows}</table>",
    ),
    "prefixed": (
        "僑委會", "html", "standard",
        "<li><a href='/n/{id}'>{slash} {title}</a></li>", '<ul class="text_list">{rows}</ul>',
    ),
    "roc_prefixed": (
        "防檢署", "html", "standard",
        "<p><a href='theme_data.php?theme=NewInfoListWS&amp;id={id}'>{roc} {title}</a>", "<div>{rows}</div>",
    ),
    "tooltip": (
        "交通部", "html", "standard",
        "<li><a href='/n/{id}' title='{title}'>{roc} 發布單位：{lang} x</a></li>",
        "<div class='list_group'><div class='list'><ul>{rows}</ul></div></div>",
    ),
    "labelled": (
        "勞動部", "html", "standard",
        "<div class='item_list2'><h3><a href='/n/{id}'>{title}</a></h3>"
        "<div class='data'>發布單位：{lang} 更新日期：{roc}</div></div>",
        "<div class='item_listblock'>{rows}</div>",
    ),
    "in_text": (
        "中選會", "html", "standard", "<div class='article-item'>{dotted} {title}</div>", "<div>{rows}</div>",
    ),
    "year_day": (
        "疾管署", "html", "standard",
        "<a href='/Bulletin/Detail/{id}' title='{title}'><p class='icon-year'>{year} - {month}</p>"
        "<p class='icon-date'>{day}</p></a>",
        "<div>{rows}</div>",
    ),
    "three_part": (
        "經濟部", "browser", "moea-html",
        "<tr><td><span class='begin-date-yy'>{rocyear}</span><span class='begin-date-mm'>{month}月</span>"
        "<span class='begin-date-dd'>{day}</span><a href='n.aspx?news_id={id}'>{title}</a>"
        "<span class='org-name'>版權來自：{lang}</span></td></tr>",
        "<div id='holderContent_grdNews'><table>{rows}</table></div>",
    ),
    "cms_json": (
        "國家公園署", "json", "nps-json",
        '{"publish_up":"{iso}T01:00:00Z","title":{jtitle},"id":{id},"jsh_unit":{"name":"{lang}"}}', "[{rows}]",
    ),
    "open_data": (
        "公路局", "json", "thb-json",
        '{"公告日期":"{iso}T16:37:00","Title":{jtitle},"Source":"https://www.thb.gov.tw/n?s={id}",'
        '"資料來源":"{lang}","內容":{jtext}}',
        "[{rows}]",
    ),
    "next_data": (
        "國家資通安全研究院", "html", "standard",
        '{"date":"{iso}","label":{jtitle},"link":"/n/{id}"}',
        '<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"data":{"content":'
        '[{"data":{"item":[{rows}]}}]}}}}</script></html>',
    ),
    "links": ("警政署", "html", "standard", "<p><a href='/n/{id}'>{title}</a>", "<div>{rows}</div>"),
}
_JSON_LAYOUTS = {"cms_json", "open_data", "next_data"}


def _fill(template: str, columns: dict[str, Column]) -> Column:
    """Concatenate a template; unknown braces are text."""
    pattern = "(" + "|".join(re.escape("{" + name + "}") for name in columns) + ")"
    parts = [p for p in re.split(pattern, template) if p]
    known = {"{" + n + "}": c for n, c in columns.items()}
    return F.concat(*[known.get(p, F.lit(p)) for p in parts])


def _escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def _json_text(c: Column) -> Column:
    """JSON string literal that may stand inside a script."""
    literal = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.replace(literal, F.lit("<"), F.lit("\\u003c"))


def _page_fields() -> dict[str, Column]:
    day = day_of(F.col("doc_id"))
    title = clean_text(F.col("text"))
    roc_year = (F.year(day) - 1911).cast("string")
    month_day = F.date_format(day, "MM-dd")
    return {
        "id": F.col("doc_id").cast("string"),
        "title": _escaped(title),
        "jtitle": _json_text(title),
        "jtext": _json_text(F.concat(F.lit("<p>"), _escaped(F.col("text")), F.lit("</p>"))),
        "twice": _escaped(_escaped(F.col("text"))),
        "lang": F.col("lang"),
        "iso": F.date_format(day, "yyyy-MM-dd"),
        "slash": F.date_format(day, "yyyy/MM/dd"),
        "mail": F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 01:30:00 GMT")),
        "roc": F.concat(roc_year, F.lit("-"), month_day),
        "dotted": F.concat(roc_year, F.lit("."), F.date_format(day, "MM.dd")),
        "rocyear": roc_year,
        "year": F.year(day).cast("string"),
        "month": F.month(day).cast("string"),
        "day": F.date_format(day, "dd"),
    }


def captures(spark: SparkSession, sf_dir: str, layouts: list[str], failing: bool = False) -> DataFrame:
    """Pages of eight documents each, rendered in turn in the given layouts, with the whole text
    of a document as its title. With ``failing``, pages whose number divides by 13 failed
    with an HTTP status, by 17 with a time-out."""
    fields = _page_fields()
    page = F.floor(F.col("doc_id") / PER_PAGE)
    names = F.array(*[F.lit(x) for x in layouts])
    docs = table(spark, sf_dir, "documents").select(
        page.alias("page"), "doc_id", F.get(names, (page % len(layouts)).cast("int")).alias("layout"),
        "text", "lang",
    )
    row = F.lit("")
    whole = F.col("rows")
    source, kind, parser = (F.lit("") for _ in range(3))
    for layout in layouts:
        publisher, page_kind, page_parser, row_template, page_template = PAGE_TEMPLATES[layout]
        here = F.col("layout") == layout
        row = F.when(here, _fill(row_template, fields)).otherwise(row)
        whole = F.when(here, _fill(page_template, {"rows": F.col("rows")})).otherwise(whole)
        source = F.when(here, F.lit(publisher)).otherwise(source)
        kind = F.when(here, F.lit(page_kind)).otherwise(kind)
        parser = F.when(here, F.lit(page_parser)).otherwise(parser)
    pages = (
        docs.select("page", "layout", "doc_id", row.alias("row"))
        .groupBy("page", "layout")
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", "row"))).alias("_rows"))
    )
    comma = F.when(F.col("layout").isin(*_JSON_LAYOUTS), F.lit(",")).otherwise(F.lit(""))
    joined = F.aggregate(
        F.transform("_rows", lambda r: r["row"]),
        F.lit(None).cast("string"),
        lambda acc, r: F.when(acc.isNull(), r).otherwise(F.concat(acc, comma, r)),
    )
    broken, late = ((F.col("page") % n == 0) & F.lit(failing) for n in (13, 17))
    return pages.withColumn("rows", joined).select(
        source.alias("source"),
        F.concat(F.lit("p"), F.col("page").cast("string")).alias("route_id"),
        F.concat(F.lit(PAGE_URL), F.col("page").cast("string")).alias("url"),
        kind.alias("kind"),
        parser.alias("parser"),
        F.lit(1).alias("priority"),
        F.when(broken, F.get(F.array(F.lit(403), F.lit(404), F.lit(503)), (F.col("page") % 3).cast("int")))
        .otherwise(F.lit(200)).alias("status_code"),
        F.when(late, F.lit("timeout")).alias("transport_error"),
        whole.alias("body"),
        F.lit(0.5).alias("elapsed_seconds"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
    )


WEEK_SOURCES = 20


def weekly_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(captures, catalog) of a run: feed pages dealt to publishers, each page a route; even
    publishers have their routes read together, every fifth has a route nobody captured."""
    page = F.substring("route_id", 2, 20).cast("long")
    name = lambda k: F.concat(F.lit("src"), k.cast("string"))
    pages = captures(spark, sf_dir, ["feed"], failing=True).withColumn("source", name(page % WEEK_SOURCES))
    route = F.struct(
        F.concat(F.lit("p"), F.col("page").cast("string")).alias("id"),
        F.concat(F.lit(PAGE_URL), F.col("page").cast("string")).alias("url"), F.lit("rss").alias("kind"),
        F.lit("standard-rss").alias("parser"), F.col("page").cast("int").alias("priority"), F.lit(True).alias("official"),
        F.lit(False).alias("coverage_reduced"),
    )
    missing = F.struct(
        F.lit("missing").alias("id"), F.lit(PAGE_URL).alias("url"), F.lit("rss").alias("kind"), F.lit("standard-rss").alias("parser"),
        F.lit(1_000_000_000).alias("priority"), F.lit(True).alias("official"), F.lit(True).alias("coverage_reduced"),
    )
    k = F.col("k")
    routes = F.when(k % 5 == 0, F.concat("routes", F.array(missing))).otherwise(F.col("routes"))
    catalog = (
        table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / PER_PAGE).alias("page")).distinct()
        .groupBy((F.col("page") % WEEK_SOURCES).alias("k"))
        .agg(F.collect_list(route).alias("routes"))
        .select(
            k.cast("int").alias("src_order"), name(k).alias("name"), F.array().cast("array<string>").alias("urls"),
            (k % 2 == 0).alias("aggregate_routes"), routes.alias("routes"),
        )
    )
    return pages, catalog


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's web pages as captures of a publisher without a profile. Addresses lose
    their query: "feed" in one would have the page read as a feed."""
    return table(spark, sf_dir, "pages").select(
        F.lit("web").alias("source"),
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("route_id"),
        F.regexp_extract("url", r"^([^?#]*)", 1).alias("url"), F.lit("html").alias("kind"),
        F.lit("standard").alias("parser"), F.lit(1).alias("priority"),
        F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("transport_error"),
        F.col("html").alias("body"), F.lit(0.5).alias("elapsed_seconds"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
    )


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy with a topic per document: the words of its text as keywords."""
    words = F.array_distinct(F.filter(F.split("text", " "), lambda w: w != ""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("topic_no"),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("topic"),
        F.col("source").alias("lead_source"),
        F.filter(words, lambda w: F.char_length(w) > 6).alias("core"),
        F.filter(words, lambda w: F.char_length(w) <= 6).alias("supporting"),
    )


def word_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy with a topic per document: the long words of its text that no document before it
    holds, so that every word is the keyword of one topic."""
    docs = table(spark, sf_dir, "documents")
    words = (
        docs.select("doc_id", F.explode(F.split("text", " ")).alias("word"))
        .where("char_length(word) > 8")
        .groupBy("word")
        .agg(F.min("doc_id").alias("doc_id"))
    )
    kinds = [F.array_sort(F.collect_list(F.when(c, F.col("word")))) for c in (F.expr("char_length(word) > 10"), F.expr("char_length(word) <= 10"))]
    lists = words.groupBy("doc_id").agg(kinds[0].alias("core"), kinds[1].alias("supporting"))
    return docs.select("doc_id", "source").join(lists, "doc_id", "left").select(
        F.col("doc_id").alias("topic_no"),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("topic"),
        F.col("source").alias("lead_source"),
        "core", "supporting",
    )
