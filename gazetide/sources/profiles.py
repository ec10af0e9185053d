"""How list pages are laid out: one profile per publisher, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gazetide.session import small_table

# The layouts name how date and title are found:
#   dated      link, title and date each have a selector
#   row_text   the date is anywhere in the text of the row
#   prefixed   the link text is "date title"; roc_prefixed the same where the row is the link
#   tooltip    the link text holds the date, its title attribute the title
#   labelled   the date follows a label in a data cell
#   in_text    the row text is title and date; the link is the page itself
#   year_day   one node for year and month, one for the day
#   three_part one node each for year, month and day
FIELDS = ["item", "link", "title", "date", "summary", "department", "category", "part2", "part3"]

# Fixed values: (publishers, layout, selectors by field).
PROFILES = [
    (["行政院"], "dated", {"item": "ul.grid.effect.list-group-item > li", "link": "a[href]", "title": ".title", "date": ".date"}),
    (["國防部"], "dated", {"item": "div.news_list_box a.news_list", "link": "a[href]", "title": "div.title.headline-4", "date": "div.date span.en", "category": "div.category.body-2"}),
    (["中科院"], "dated", {"item": "div.newsNavArea ul", "link": "li.newsTit03 a[href]", "title": "li.newsTit03 a[href]", "date": "li.newsTit02"}),
    (["國防院"], "dated", {"item": "div.col-lg-6.card", "link": "a[href]", "title": "div.card-title", "date": "p.time1"}),
    (["運動部"], "dated", {"item": "table tbody tr", "link": "td[data-title='主題'] a[href]", "title": "td[data-title='主題'] a[href]", "date": "td[data-title='上版日期'] div.in", "department": "td[data-title='資料來源'] div.in"}),
    (["中央銀行"], "dated", {"item": "section.lp div.list ul li", "link": "a[href]", "title": "a[href]", "date": "time"}),
    (["內政部"], "dated", {"item": "table tbody tr", "link": "td:nth-child(3) a[href]", "title": "td:nth-child(3) a[href]", "date": "td:nth-child(1)", "department": "td:nth-child(2)"}),
    (["消防署"], "dated", {"item": "table tbody tr", "link": "td:nth-child(1) a[href]", "title": "td:nth-child(1) a[href]", "date": "td:nth-child(3)", "department": "td:nth-child(2)"}),
    (["公路局"], "dated", {"item": "#table_0 tbody tr", "link": "td[data-title='標題'] a[href]", "title": "td[data-title='標題'] a[href]", "date": "td[data-title='公告日期']", "department": "td[data-title='公告單位']"}),
    (["司法院"], "dated", {"item": "table.table_list tbody tr, div.table_list table tbody tr", "link": "td[data-title='標題'] a[href]", "title": "td[data-title='標題'] a[href]", "date": "td[data-title='張貼日']", "department": "td[data-title='單位/機關']"}),
    (["教育部"], "dated", {"item": "tr.question_tr", "link": "td:nth-child(2) a[href]", "title": "td:nth-child(2) a[href]", "date": "td:nth-child(1)", "department": "td:nth-child(3)"}),
    (["國教院"], "dated", {"item": "ul.page-list > li", "link": "a.txt[href], a[href]", "title": "a.txt[href], a[href]", "date": "div.page-list-info span.date, span.date", "department": "div.page-list-info span.unit, span.unit", "category": "div.page-list-info span.type, span.type"}),
    (["衛生福利部"], "dated", {"item": "section.list ul li", "link": "a[href]", "title": "p", "date": "time"}),
    (["國科會"], "dated", {"item": "div.news_list.marb_30 a[href]", "link": "a[href]", "title": "h3", "date": "div.date"}),
    (["國家實驗研究院"], "dated", {"item": "table.rwdTable tr", "link": "td.title a[href]", "title": "td.title a[href]", "date": "td.date"}),
    (["客委會"], "dated", {"item": "div.list ul li", "link": "a[href]", "title": "p.subject", "date": "p.color02"}),
    (["觀光署"], "dated", {"item": "div.columnBlock", "link": "a.columnBlock-title[href]", "title": "a.columnBlock-title[href]", "date": "span.date"}),
    (["農業金融署"], "dated", {"item": "tbody tr", "link": "td[data-th='標題'] a[href]", "title": "td[data-th='標題'] a[href]", "date": "td[data-th='發布日期']"}),
    (["漁業署"], "dated", {"item": "tbody tr", "link": "td:first-child a[href]", "title": "td:first-child a[href]", "date": "td:last-child"}),
    (["數位發展部", "數位產業署", "資通安全署"], "dated", {"item": "ul#ListTable > li", "link": "a[href]", "title": ".title5", "date": ".listDate", "department": ".listUnit"}),
    (["環境部"], "dated", {"item": "ul.list_group li, article.idx-news-card", "link": "a[href]", "title": ".idx-news-card__title, div.title, .title, h2, h3, a[href]", "date": ".idx-news-card__date, span.date, time, .date"}),
    (["退輔會"], "dated", {"item": "section.listTb table tbody tr", "link": "td[data-title='標題'] a[href]", "title": "td[data-title='標題'] a[href]", "date": "td[data-title='發布日期']"}),
    (["榮總"], "dated", {"item": "table.stackedTable tbody tr, table tbody tr", "link": "td:nth-child(3) a[href]", "title": "td:nth-child(3) a[href]", "date": "td:nth-child(1)", "department": "td:nth-child(2)"}),
    (["故宮"], "dated", {"item": "ul.mt-12.news-list > li", "link": "a[href]", "title": "a[href]", "date": "span.mr-5"}),
    (["外交部"], "row_text", {"item": "table tbody tr", "link": "a[href]"}),
    (["僑委會"], "prefixed", {"item": "ul.text_list li", "link": "a[href]"}),
    (["防檢署"], "roc_prefixed", {"item": "a[href*='theme_data.php?theme=NewInfoListWS']"}),
    (["交通部"], "tooltip", {"item": "div.list_group div.list ul > li", "link": "a[href]"}),
    (["勞動部"], "labelled", {"item": "div.item_listblock div.item_list2", "link": "h3 a[href]", "date": "div.data"}),
    (["勞動基金運用局"], "labelled", {"item": "div.item_listblock div.item_list2", "link": "div.item_title a[href]", "date": "div.data"}),
    (["中選會"], "in_text", {"item": "div.article-item"}),
    (["疾管署"], "year_day", {"item": "a[href*='/Bulletin/Detail/']", "date": ".icon-year", "part2": ".icon-date"}),
    (["經濟部"], "three_part", {"item": "#holderContent_grdNews tbody tr", "link": "a[href*='news_id=']", "date": "span.begin-date-yy", "part2": "span.begin-date-mm", "part3": "span.begin-date-dd", "department": ".org-name"}),
]

# Publishers read by layouts before any look at the kind of the capture.
SPECIAL_LAYOUTS = ["row_text", "prefixed", "roc_prefixed", "tooltip", "labelled", "in_text", "year_day", "three_part"]

# Publishers whose captures are JSON, and the page of one of their items.
CMS_PAGES = {
    "國家公園署": "https://www.nps.gov.tw/ch/titlelist/parknews/",
    "國土管理署": "https://www.nlma.gov.tw/ch/titlelist/news/",
}
CMS_OWN_NAMES = ["內政部國家公園署", "國家公園署"]
OPEN_DATA_SOURCES = ["公路局"]
OPEN_DATA_PARSER = "thb-json"
NEXT_DATA_SOURCES = ["國家資通安全研究院"]

# Parsers that fall back to a plain list of links.
LINK_LIST_PARSERS = [
    "primary", "standard", "mjac-html", "afna-html", "fa-html", "sfaa-html", "mohw-source-filter", "moenv-html",
    "moenv-news-portal-browser", "pcc-html",
]

# Where the text of a detail page is, by publisher, in order of trial.
DETAIL_SELECTORS = {
    "數位發展部": [".article1.cpArticle", ".cpArticle", "article"],
    "數位產業署": [".article1.cpArticle", ".cpArticle", "article"],
    "資通安全署": [".article1.cpArticle", ".cpArticle", "article"],
    "國科會": [".articleContent", ".article-content", "article"],
    "經濟部": ["#ctl00_ContentPlaceHolder1_divContent", ".article-content", ".cpArticle", "article"],
}


def default_profiles(spark: SparkSession) -> DataFrame:
    rows = [
        (source, layout, *[css.get(f) for f in FIELDS]) for sources, layout, css in PROFILES for source in sources
    ]
    return small_table(
        spark, rows, "source string, layout string, " + ", ".join(f"{f} string" for f in FIELDS)
    )
