"""Captures to items. Python reads the markup into strings (Arrow batches, one pass over
the captures, no shuffle); every rule about dates, titles, links and departments is a
column expression on the strings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from gazetide.functions.dates import labelled_day_text, parse_list_date
from gazetide.functions.exprs import let, with_once
from gazetide.functions.outcomes import capture_failure, error_category, failure_message
from gazetide.functions.text import (
    FEED_SUMMARY_LIMIT,
    WHITE_SPACE,
    clean_text,
    cut_trim,
    department_name,
    is_department_alias,
    labelled_value,
    strip_space,
)
from gazetide.functions.urls import resolve_url, url_host
from gazetide.operators.numbering import number_rows
from gazetide.sources import profiles as P
from gazetide.sources.markup import flatten_feed, html_text, parsed_html, select, select_first

# Feed fields by the item column they fill.
FEED_SUMMARY_FIELDS = ["description", "summary", "content", "encoded"]
FEED_DATE_FIELDS = ["pubdate", "published", "datetime", "date", "updated"]
FEED_DEPARTMENT_FIELDS = ["departmentallname", "deptname", "source", "author", "creator", "publisher", "rights"]

# The publisher that names its department in the text, and titles of persons
# that may follow the department there.
CONTACT_SOURCE = "金管會"
CONTACT_PATTERN = r"(?U)聯絡單位\s*[:：]\s*(.*?)\s+聯絡電話\s*[:：]"
PERSON_TITLES = "科長|組長|主任|專員|秘書|視察|科員|技正|稽核|先生|小姐"

# Publishers whose titles carry something that is no title.
TRAILING_DATE_SOURCE, TRAILING_DATE = "環境部", r"(?U)\s+\d{2,4}-\d{1,2}-\d{1,2}$"
LEADING_LABEL_SOURCE, LEADING_LABEL = "榮總", r"(?U)^點擊前往\s*"

ITEM_ARRAY = (
    "array<struct<pos:int,date:string,department:string,title:string,link:string,"
    "category:string,summary:string,date_source:string>>"
)


_FEED_START = rf"(?i)\A\x{{FEFF}}*[{WHITE_SPACE}]*<(?:\?xml|rss|feed)"


def looks_like_feed(url: Column, body: Column) -> Column:
    """Feed by address or by its first characters after byte order marks and whitespace."""
    return F.lower(url).rlike("rss|feed") | body.rlike(_FEED_START)


def dispatch(source: Column, layout: Column, kind: Column, parser: Column, url: Column, body: Column) -> Column:
    """Name of the reader for a capture: cms_json, open_data, next_data, feed, a page
    layout, links or unsupported."""
    return (
        F.when(source.isin(list(P.CMS_PAGES)), F.lit("cms_json"))
        .when(source.isin(P.OPEN_DATA_SOURCES) & (parser == P.OPEN_DATA_PARSER), F.lit("open_data"))
        .when(source.isin(P.NEXT_DATA_SOURCES), F.lit("next_data"))
        .when(layout.isin(P.SPECIAL_LAYOUTS), layout)
        .when((kind == "rss") | looks_like_feed(url, body), F.lit("feed"))
        .when(layout.isNotNull(), layout)
        .when(parser.isin(P.LINK_LIST_PARSERS), F.lit("links"))
        .otherwise(F.lit("unsupported"))
    )


# --- markup to strings ---------------------------------------------------------------

_PAGE_ROW = ["row_text", "row_href", "row_tip", "link_text", "link_href", "link_tip"] + [
    f for f in P.FIELDS if f not in ("item", "link")
]
_PAGE_ARROW = pa.list_(pa.struct([(f, pa.string()) for f in _PAGE_ROW]))
_FEED_ARROW = pa.struct(
    [
        ("error", pa.string()),
        ("rows", pa.list_(pa.list_(pa.struct([(f, pa.string()) for f in ("name", "value", "plain")])))),
    ]
)


def _page_row(row, css: dict) -> dict:
    link = select_first(row, css["link"])
    out = {
        "row_text": row.text(), "row_href": row.attrs.get("href"), "row_tip": row.attrs.get("title"),
        "link_text": None, "link_href": None, "link_tip": None,
    }
    if link is not None:
        out.update(link_text=link.text(), link_href=link.attrs.get("href"), link_tip=link.attrs.get("title"))
    for field in _PAGE_ROW[6:]:
        node = select_first(row, css[field])
        out[field] = None if node is None else node.text()
    return out


PORTION = 1 << 20  # characters whose strings a task holds at a time


def _in_portions(found: Iterator, kind: pa.DataType) -> Iterator[pa.Array]:
    """Arrays of the values of (characters read, value), a new one once ``PORTION`` is reached: what
    is read from a batch is never in memory as a whole."""
    out, size = [], 0
    for read, value in found:
        out.append(value)
        size += read + 64
        if size >= PORTION:
            yield pa.array(out, kind)
            out, size = [], 0
    if out:
        yield pa.array(out, kind)


def _pages(body: pa.Array, css: pa.Array) -> Iterator:
    for text, selectors in zip(body, css):
        text, selectors = text.as_py(), selectors.as_py()
        if text is None or selectors["item"] is None:
            yield 0, None
        else:
            with parsed_html(text) as page:
                rows = [_page_row(row, selectors) for row in select(page, selectors["item"])]
            yield len(text), rows


@F.arrow_udf(from_arrow_type(_PAGE_ARROW))
def read_page(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Strings of every row of a list page (body, css); NULL for a NULL body."""
    for body, css in batches:
        yield from _in_portions(_pages(body, css), _PAGE_ARROW)


def _feeds(body: pa.Array) -> Iterator:
    for text in body:
        text = text.as_py()
        if text is None:
            yield 0, None
            continue
        try:
            yield len(text), {"error": None, "rows": flatten_feed(text)}
        except ValueError as error:
            yield len(text), {"error": str(error), "rows": []}


@F.arrow_udf(from_arrow_type(_FEED_ARROW))
def read_feed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Leaf fields of every feed item in document order; ``error`` for malformed text."""
    for body in batches:
        yield from _in_portions(_feeds(body), _FEED_ARROW)


def _fragments(values: pa.Array) -> Iterator:
    for fragments in values:
        texts = fragments.as_py()
        if texts is None:
            yield 0, None
        else:
            yield sum(len(x or "") for x in texts), [None if x is None else html_text(x) for x in texts]


@F.arrow_udf(T.ArrayType(T.StringType()))
def html_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Text of every HTML fragment in an array."""
    for values in batches:
        yield from _in_portions(_fragments(values), pa.list_(pa.string()))


_MARKUP_ARROW = pa.struct([("page", _PAGE_ARROW), ("feed", _FEED_ARROW), ("texts", pa.list_(pa.string()))])


def _markup(page: pa.Array, css: pa.Array, feed: pa.Array, fragments: pa.Array) -> Iterator:
    for (a, rows), (b, fields), (c, texts) in zip(_pages(page, css), _feeds(feed), _fragments(fragments)):
        yield a + b + c, {"page": rows, "feed": fields, "texts": texts}


@F.arrow_udf(from_arrow_type(_MARKUP_ARROW))
def read_markup(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """What ``read_page`` (page, css), ``read_feed`` and ``html_texts`` (fragments) read, in one pass: a
    task needs one Python worker for captures of all kinds."""
    for columns in batches:
        yield from _in_portions(_markup(*columns), _MARKUP_ARROW)


def _detail(text: str | None, selectors: list[str] | None) -> str:
    if not text or not selectors:
        return ""
    found = ""
    with parsed_html(text) as page:
        for one in selectors:
            box = select_first(page, one)
            if box is not None:
                found = " ".join(filter(None, (p.text() for p in select(box, "p")))) or box.text()
            if found:
                break
    return found


def _details(body: pa.Array, css: pa.Array) -> Iterator:
    for text, selectors in zip(body, css):
        text = text.as_py()
        yield len(text or ""), _detail(text, selectors.as_py())


@F.arrow_udf(T.StringType())
def read_detail(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Paragraphs of the first container (body, css) that has text, else the container's own text."""
    for body, css in batches:
        yield from _in_portions(_details(body, css), pa.string())


# --- strings to items ----------------------------------------------------------------
#
# Every reader says what it found per row: texts of the day, the title and the link, the
# department and what else there is. NULL as day, title or link drops the row. Reading
# days and resolving links is common to all and comes last, once.


def _found(day, title, link, department, category=None, summary=None, date_source=None) -> Column:
    empty = F.lit("")
    return F.struct(
        day.alias("day"),
        title.alias("title"),
        link.alias("link"),
        department.alias("department"),
        (empty if category is None else F.coalesce(category, empty)).alias("category"),
        (empty if summary is None else F.coalesce(summary, empty)).alias("summary"),
        (F.lit("published") if date_source is None else date_source).alias("date_source"),
    )


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def _under(source: Column, label: Column) -> Column:
    """``source／label``, or the source alone when the label adds nothing."""
    label = F.coalesce(label, F.lit(""))
    return F.when((label == "") | (label == source), source).otherwise(F.concat(source, F.lit("／"), label))


def feed_rows(source: Column, rows: Column) -> Column:
    """Rows of a feed. First value wins, except that the last link text replaces any other
    link."""

    def first(fields: Column, names: list[str]) -> Column:
        return F.get(F.filter(fields, lambda f: f["name"].isin(names)), F.lit(0))

    def build(fields: Column) -> Column:
        own_links = F.filter(fields, lambda f: f["name"] == "link")
        substitutes = F.filter(fields, lambda f: f["name"].isin("guid", "link@href") & (f["value"] != ""))
        link = F.coalesce(F.get(F.reverse(own_links), F.lit(0))["value"], F.get(substitutes, F.lit(0))["value"])
        names = F.filter(
            F.transform(
                F.filter(fields, lambda f: f["name"].isin(FEED_DEPARTMENT_FIELDS)),
                lambda f: department_name(f["value"]),
            ),
            lambda d: (d != "") & ~is_department_alias(source, d),
        )
        department = F.replace(
            clean_text(F.coalesce(F.get(names, F.lit(0)), source)), F.lit("Copyright&copy;"), F.lit("Copyright &copy;")
        )
        summary = F.coalesce(cut_trim(first(fields, FEED_SUMMARY_FIELDS)["plain"], FEED_SUMMARY_LIMIT), F.lit(""))
        day = first(fields, FEED_DATE_FIELDS)
        return let(
            summary,
            lambda text: _found(
                F.coalesce(day["value"], F.lit("")),
                clean_text(first(fields, ["title"])["value"]),
                link,
                F.when(source == CONTACT_SOURCE, _contact_units(text, department)).otherwise(department),
                first(fields, ["category"])["value"],
                text,
                F.when(day["name"] == "updated", F.lit("updated")).otherwise(F.lit("published")),
            ),
        )

    return F.transform(rows, build)


def _contact_units(summary: Column, fallback: Column) -> Column:
    """Departments named as contact in the text, else ``fallback``."""

    def unit(raw: Column) -> Column:
        words = F.split(clean_text(raw), " ")
        named = F.element_at(words, -1).rlike(f"(?:{PERSON_TITLES})$")
        kept = F.when(named, F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
        return F.regexp_replace(F.array_join(kept, " "), "^[ ，,、;；]+|[ ，,、;；]+$", "")

    units = F.array_distinct(
        F.filter(F.transform(F.regexp_extract_all(summary, F.lit(CONTACT_PATTERN), F.lit(1)), unit), lambda u: u != "")
    )
    return let(units, lambda u: F.when(F.size(u) > 0, F.array_join(u, "、")).otherwise(fallback))


_DAY_TITLE = r"(?U)^(\d{4}/\d{1,2}/\d{1,2})\s*(.+)$"
_ROC_DAY_TITLE = r"(?U)^(\d{2,3}-\d{1,2}-\d{1,2})\s+(.+)$"
_ROC_DOTTED = r"(?U)\b(\d{3}\.\d{2}\.\d{2})\b"
_YEAR_MONTH = r"(?U)(\d{4})\s*-\s*(\d{1,2})"


def _tip_or(tip: Column, text: Column) -> Column:
    return let(strip_space(F.coalesce(tip, F.lit(""))), lambda t: F.when(t != "", t).otherwise(text))


def _dated(r: Column, source: Column) -> Column:
    title = (
        F.when(source == TRAILING_DATE_SOURCE, strip_space(F.regexp_replace(r["title"], TRAILING_DATE, "")))
        .when(source == LEADING_LABEL_SOURCE, strip_space(F.regexp_replace(r["title"], LEADING_LABEL, "")))
        .otherwise(r["title"])
    )
    # The label of a department is its own node, or the category's where the profile has no
    # selector for departments.
    label = F.when(F.col("_css.department").isNotNull(), r["department"]).otherwise(r["category"])
    link = F.coalesce(r["row_href"], r["link_href"])
    return F.when(r["title"] != "", _found(r["date"], title, link, _under(source, label), r["category"], r["summary"]))


def _prefixed(text: Column, href: Column, pattern: str, source: Column) -> Column:
    title = _nonempty(strip_space(F.regexp_extract(text, pattern, 2)))
    return _found(F.regexp_extract(text, pattern, 1), title, href, source)


def _labelled(r: Column, source: Column) -> Column:
    published, updated = (labelled_day_text(r["date"], name) for name in ("發布日期", "更新日期"))
    day = F.when(parse_list_date(published).isNotNull(), published).otherwise(updated)
    return _found(day, r["link_text"], r["link_href"], _under(source, labelled_value(r["date"], "發布單位")))


def _in_text(r: Column, source: Column, url: Column) -> Column:
    day = F.regexp_extract(r["row_text"], _ROC_DOTTED, 1)
    title = _nonempty(strip_space(F.replace(r["row_text"], day, F.lit(""))))
    return F.when(day != "", _found(day, title, url, source))


def _year_day(r: Column, source: Column) -> Column:
    day = F.concat(
        F.regexp_extract(r["date"], _YEAR_MONTH, 1), F.lit("-"), F.regexp_extract(r["date"], _YEAR_MONTH, 2),
        F.lit("-"), r["part2"],
    )
    return _found(day, _tip_or(r["row_tip"], r["row_text"]), r["row_href"], source)


def _three_part(r: Column, source: Column) -> Column:
    month = F.regexp_extract(r["part2"], r"(\d+)", 1)
    day = F.concat(r["date"], F.lit("-"), month, F.lit("-"), r["part3"])
    label = strip_space(F.regexp_replace(r["department"], "^(?:版權來自：)*(?:版權來自:)*", ""))
    full = F.when((label != "") & label.startswith(source), label).otherwise(_under(source, label))
    return F.when(month != "", _found(day, r["link_text"], r["link_href"], full))


def page_rows(source: Column, layout: Column, url: Column, rows: Column) -> Column:
    """Rows of a list page. Layouts differ in where they look."""

    def look(r: Column) -> Column:
        tip = _tip_or(r["link_tip"], r["link_text"])
        unit = _under(source, labelled_value(r["link_text"], "發布單位"))
        return (
            F.when(layout == "dated", _dated(r, source))
            .when(layout == "links", _found(F.lit(""), _nonempty(r["row_text"]), r["row_href"], F.lit("")))
            .when(layout == "row_text", _found(r["row_text"], _nonempty(r["link_text"]), r["link_href"], source))
            .when(layout == "prefixed", _prefixed(r["link_text"], r["link_href"], _DAY_TITLE, source))
            .when(layout == "roc_prefixed", _prefixed(r["row_text"], r["row_href"], _ROC_DAY_TITLE, source))
            .when(layout == "tooltip", _found(r["link_text"], tip, r["link_href"], unit))
            .when(layout == "labelled", _labelled(r, source))
            .when(layout == "in_text", _in_text(r, source, url))
            .when(layout == "year_day", _year_day(r, source))
            .when(layout == "three_part", _three_part(r, source))
        )

    return F.transform(rows, look)


# Fields of the JSON layouts and where they are in an element.
_CMS_FIELDS = {"publish_up": "$.publish_up", "title": "$.title", "id": "$.id", "unit": "$.jsh_unit.name"}
_OPEN_FIELDS = {c: f"$['{c}']" for c in ("公告日期", "Title", "Source", "資料來源", "內容")}
_NEXT_FIELDS = {c: f"$.{c}" for c in ("date", "label", "link")}
_NEXT_ITEMS = "$.props.pageProps.data.content[0].data.item"
_NEXT_SCRIPT = r"""(?is)<script[^>]*\bid=["']?__NEXT_DATA__["']?[^>]*>(.*?)</script>"""


def json_elements(text: Column, path: str, fields: dict[str, str]) -> Column:
    """Elements of the JSON array at ``path`` as structs of strings: NULL if the text is not one
    whole JSON value or has no array there; an element that is no object has NULLs. The parser
    stops behind the first value of a text, so the text is read as the only element of an array.
    A byte order mark before it is no part of it. Of repeated keys the last counts where
    ``spark.sql.variant.allowDuplicateKeys`` is on, as ``parse_captures`` sets it."""
    whole = F.concat(F.lit("["), F.regexp_replace(text, "^\ufeff", ""), F.lit("]"))
    values = F.try_variant_get(F.try_parse_json(whole), "$", "array<variant>")
    elements = F.when(F.size(values) == 1, F.try_variant_get(F.get(values, F.lit(0)), path, "array<variant>"))
    return F.transform(
        elements, lambda e: F.struct(*[F.try_variant_get(e, at, "string").alias(name) for name, at in fields.items()])
    )


def cms_rows(source: Column, rows: Column) -> Column:
    pages = F.create_map(*[F.lit(x) for kv in P.CMS_PAGES.items() for x in kv])

    def build(r: Column) -> Column:
        unit = F.coalesce(strip_space(r["unit"]), F.lit(""))
        own = (unit == "") | unit.isin(P.CMS_OWN_NAMES)
        return _found(
            r["publish_up"], _nonempty(strip_space(r["title"])),
            F.concat(F.try_element_at(pages, source), _nonempty(r["id"])),
            F.when(own, source).otherwise(F.concat(source, F.lit("／"), unit)),
        )

    return F.transform(rows, build)


def open_data_rows(source: Column, rows: Column, texts: Column) -> Column:
    return F.transform(
        rows,
        lambda r, i: _found(
            r["公告日期"], _nonempty(strip_space(r["Title"])), _nonempty(strip_space(r["Source"])),
            _under(source, strip_space(r["資料來源"])), summary=F.get(texts, i),
        ),
    )


def next_data_rows(source: Column, rows: Column) -> Column:
    return F.transform(
        rows,
        lambda r: _found(r["date"], _nonempty(strip_space(r["label"])), _nonempty(strip_space(r["link"])), source),
    )


def _finish(found: Column, layout: Column, url: Column) -> Column:
    """Found rows to items: days become ISO text (feeds keep theirs as written, links have
    none), links are resolved against the page (a feed's links stand alone, JSON rows come
    with whole addresses)."""
    undated = layout.isin("feed", "links")
    whole = layout.isin("cms_json", "open_data", "in_text")

    def build(x: Column, pos: Column) -> Column:
        day = F.when(undated, x["day"]).otherwise(F.date_format(parse_list_date(x["day"]), "yyyy-MM-dd"))
        relative = ~x["link"].rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
        link = F.when(whole | ((layout == "feed") & relative), x["link"]).otherwise(resolve_url(url, x["link"]))
        usable = x["title"].isNotNull() & x["link"].isNotNull() & ((x["link"] != "") | (layout != "feed"))
        return let(
            day,
            lambda d: F.when(
                usable & d.isNotNull(),
                F.struct(
                    pos.cast("int").alias("pos"), d.alias("date"), x["department"].alias("department"),
                    x["title"].alias("title"), link.alias("link"), x["category"].alias("category"),
                    x["summary"].alias("summary"), x["date_source"].alias("date_source"),
                ),
            ),
        )

    return F.filter(F.transform(found, build), lambda i: i.isNotNull())


# --- the job -------------------------------------------------------------------------


def parse_captures(captures: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per capture, without its body: outcome and the array ``items``.

    Captures of all kinds go through the same pass: each reader gets the body only of its
    own captures. ``profiles`` is a small table, joined by what the planner knows of its
    size.
    """
    captures.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # One expression list, read top down; every step is a narrow projection.
    css = F.struct(*[F.col(f"_p.{f}").alias(f) for f in P.FIELDS])
    links_css = F.struct(*[F.lit("a[href]" if f == "item" else None).cast("string").alias(f) for f in P.FIELDS])
    source, body, url = F.col("source"), F.col("body"), F.col("url")
    looked_up = profiles.select(
        F.col("source").alias("_source"), F.col("layout").alias("_layout"), F.struct(*P.FIELDS).alias("_p")
    )
    early = F.col("_early")
    good_body = F.when(early == "", body)
    layout = F.col("_reader")
    page_layouts = ["dated", "links", *P.SPECIAL_LAYOUTS]

    read = (
        captures.join(looked_up, source == F.col("_source"), "left")
        .withColumn("_early", capture_failure(F.col("kind"), F.col("status_code"), F.col("transport_error"), body))
        .withColumn("_reader", dispatch(source, F.col("_layout"), F.col("kind"), F.col("parser"), url, body))
        .withColumn("_css", F.when(layout == "links", links_css).otherwise(css))
        .withColumn("_cms", json_elements(F.when(layout == "cms_json", good_body), "$", _CMS_FIELDS))
        .withColumn("_open", json_elements(F.when(layout == "open_data", good_body), "$", _OPEN_FIELDS))
        .withColumn(
            "_read",
            read_markup(
                F.when(layout.isin(page_layouts), good_body), F.col("_css"), F.when(layout == "feed", good_body),
                F.transform("_open", lambda r: r["內容"]),
            ),
        )
        .withColumns({"_page": F.col("_read.page"), "_feed": F.col("_read.feed"), "_texts": F.col("_read.texts")})
        .withColumn("_script", F.when(layout == "next_data", F.regexp_extract(good_body, _NEXT_SCRIPT, 1)))
        .withColumn("_next", json_elements(F.col("_script"), _NEXT_ITEMS, _NEXT_FIELDS))
    )
    found = (
        F.when(layout == "feed", feed_rows(source, F.col("_feed.rows")))
        .when(layout == "cms_json", cms_rows(source, F.col("_cms")))
        .when(layout == "open_data", open_data_rows(source, F.col("_open"), F.col("_texts")))
        .when(layout == "next_data", next_data_rows(source, F.col("_next")))
        .when(layout.isin(page_layouts), page_rows(source, layout, url, F.col("_page")))
    )
    no_rows = (layout != "links") & layout.isin(page_layouts) & (F.size("_page") == 0)
    problem = (
        F.when(early != "", F.lit(None).cast("string"))
        .when(layout == "unsupported", F.concat(F.lit("unsupported parser: "), F.col("parser")))
        .when(layout == "feed", F.col("_feed.error"))
        .when((layout == "cms_json") & F.col("_cms").isNull(), F.lit("not a JSON array"))
        .when((layout == "open_data") & F.col("_open").isNull(), F.lit("not a JSON array"))
        .when((layout == "next_data") & (F.col("_script") == ""), F.lit("missing __NEXT_DATA__"))
        .when((layout == "next_data") & F.col("_next").isNull(), F.lit("invalid item array"))
        .when(no_rows, F.concat(source, F.lit(" page does not contain "), F.col("_css.item")))
    )
    fetch_detail = F.coalesce(
        F.col("transport_error"),
        F.when(F.col("kind") == "browser", F.lit("challenge page")),
        F.concat(F.lit("HTTP "), F.col("status_code").cast("string")),
    )

    def outcome(p: Column) -> Column:
        failure = F.when(early != "", early).when(p.isNotNull(), F.lit("parser_regression")).otherwise(F.lit(""))
        return F.struct(
            failure.alias("failure_class"),
            F.when(early != "", failure_message(early, fetch_detail))
            .when(p.isNotNull(), failure_message(F.lit("parser_regression"), p))
            .otherwise(F.lit(""))
            .alias("message"),
            F.when(failure == "", _finish(found, layout, url)).otherwise(F.array().cast(ITEM_ARRAY)).alias("items"),
        )

    carried = [c for c in captures.columns if c not in ("body", "transport_error", "status_code", "fetched_at")]
    return with_once(read, let(problem, outcome).alias("_r")).select(
        *carried, F.col("_reader").alias("reader"), "_r.failure_class", "_r.message", "_r.items"
    )


def attempts_of(parsed: DataFrame) -> DataFrame:
    """Attempt rows (see operators.health) of parsed captures that carry route columns."""
    ok = F.col("failure_class") == ""
    return parsed.select(
        "source", "attempt_no", "route_id", "url", url_host(F.col("url")).alias("url_host"),
        F.col("kind").alias("route_kind"), "parser", "priority", "coverage_reduced", "aggregate_routes",
        F.when(ok, F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        F.round("elapsed_seconds", 3).alias("elapsed_seconds"),
        F.size("items").cast("long").alias("item_count"),
        "failure_class", error_category(F.col("failure_class")).alias("error_category"), "message",
        # Undated items pass parsing but can never reach a week: worth a look.
        F.size(F.filter("items", lambda i: i["date"] == "")).cast("long").alias("undated_dropped"),
    )


def items_of(parsed: DataFrame) -> DataFrame:
    """Item rows of parsed captures that carry src_order and attempt_no. ``ord`` numbers them
    from 0 by publisher, route and place on the page."""
    rows = parsed.select("source", "route_id", "src_order", "attempt_no", F.explode("items").alias("_i")).withColumn(
        "_all", F.lit(0)
    )
    order = [F.col(c).asc() for c in ("src_order", "attempt_no", "source", "route_id", "_i.pos")]
    return number_rows(rows, "_all", order, "_n").select(
        (F.col("_n") - 1).cast("long").alias("ord"),
        "source", "route_id",
        *[F.col(f"_i.{c}").alias(c) for c in ("date", "department", "title", "link", "category", "summary", "date_source")],
    )
