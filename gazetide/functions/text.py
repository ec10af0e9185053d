"""Text clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazetide.functions.exprs import let

# The Unicode White_Space characters, as a regex class body. Patterns here
# begin with (?U), which makes \\s stand for the same set and runs faster than the class.
WHITE_SPACE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Labels that publishers put before a department name.
DEPARTMENT_LABELS = [
    "版權來自", "版權所有", "發佈單位", "發布單位", "提供機關", "資料來源", "資料來源單位", "來源",
]

# Long names that only repeat the publisher itself.
DEPARTMENT_ALIASES = [
    ("國發會", "國家發展委員會"),
    ("金管會", "金融監督管理委員會"),
    ("金管會", "行政院金融監督管理委員會"),
]

# Code-point ranges that count as CJK.
CJK_CLASS = (
    r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}"
    r"\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}]"
)

CELL_LIMIT = 32_767
FEED_SUMMARY_LIMIT = 4_000
DETAIL_SUMMARY_LIMIT = 1_200


def clean_text(c: Column) -> Column:
    """Collapse runs of Unicode whitespace to one space and trim."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_space(c: Column) -> Column:
    """Trim Unicode whitespace at both ends only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Nothing but whitespace."""
    return ~c.rlike(r"(?U)\S")


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def ascii_parentheses(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("（"), F.lit("(")), F.lit("）"), F.lit(")"))


def title_key(c: Column) -> Column:
    """Comparison form of a title: ASCII parentheses, no whitespace."""
    return ascii_parentheses(without_space(c))


def match_text(c: Column) -> Column:
    """Comparison form for keyword matching: no whitespace, lower case, ASCII parentheses."""
    return ascii_parentheses(F.lower(without_space(c)))


def cut(c: Column, limit: int) -> Column:
    """At most ``limit`` characters."""
    return F.substring(c, 1, limit)


def cut_trim(c: Column, limit: int) -> Column:
    return strip_space(cut(c, limit))


def collapsed_summary(c: Column, limit: int) -> Column:
    return cut(clean_text(c), limit)


def has_cjk(c: Column) -> Column:
    return (F.octet_length(c) > F.char_length(c)) & c.rlike(CJK_CLASS)


def text_class(c: Column) -> Column:
    return F.when(has_cjk(c), F.lit("cjk")).otherwise(F.lit("latin"))


def department_name(c: Column) -> Column:
    """Department text without leading labels; internal codes and URLs give ``''``."""
    # The compatibility form U+F92D of the third character of the first label counts too.
    labels = "|".join(DEPARTMENT_LABELS).replace("版權來自", r"版權[\x{4F86}\x{F92D}]自")
    bare = F.trim(F.regexp_replace(clean_text(c), rf"^(?:(?:{labels})[:：] ?)+", ""))

    def reject_codes(d: Column) -> Column:
        is_code = d.rlike(r"^\d+(?:\.\d+){3,}$")
        is_url = F.lower(without_space(d)).startswith("www.") | without_space(d).rlike("^(?:https?|ftp)://")
        return F.when(is_code | is_url, F.lit("")).otherwise(F.translate(d, "＞>", "／／"))

    return let(bare, reject_codes)


def is_department_alias(source: Column, department: Column) -> Column:
    """True when the department only repeats the publisher's own name."""
    listed = F.lit(False)
    for name, alias in DEPARTMENT_ALIASES:
        listed = listed | ((source == name) & (department == alias))
    suffixed = department.endswith(source) & (F.char_length(department) <= F.char_length(source) + 6)
    return (department == source) | listed | suffixed


def labelled_value(text: Column, label: str) -> Column:
    """First token after ``label`` and an optional colon; ``''`` when absent."""
    return F.regexp_extract(text, rf"(?U)\Q{label}\E\s*[:：]?\s*(\S+)", 1)


def site_link(source: Column, link: Column) -> Column:
    """Link cell text: web links carry the publisher's name."""
    is_web = link.startswith("http://") | link.startswith("https://")
    return F.when(is_web, F.concat(source, F.lit("官網："), link)).otherwise(link)


def first_web_url(text: Column) -> Column:
    """Text from the first https:// on, else from the first http:// on, else NULL."""
    secure, plain = F.locate("https://", text), F.locate("http://", text)
    return F.when(secure > 0, F.substr(text, secure)).when(plain > 0, F.substr(text, plain))
