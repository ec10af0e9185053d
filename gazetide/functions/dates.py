"""Date parsing and calendar helpers. Instants are cut to a date in Taipei time."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazetide.functions.exprs import let

ZONE = "Asia/Taipei"

# Zone names a mail-style date may end with.
MAIL_ZONES = {
    "GMT": "+00:00", "UT": "+00:00", "UTC": "+00:00", "Z": "+00:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}

# The forms dates are written in.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_YMD_PATTERNS = [
    r"(?U)^\s*([0-9]{1,4})-\s*([0-9]{1,2})-\s*([0-9]{1,2})$",
    r"(?U)^\s*([0-9]{1,4})/\s*([0-9]{1,2})/\s*([0-9]{1,2})$",
    r"(?U)^\s*([0-9]{1,4})年\s*([0-9]{1,2})月\s*([0-9]{1,2})日$",
]
_ANYWHERE = r"(?s)^.*?(20\d{2})[-/]([01]?\d)[-/]([0-3]?\d).*$"
_INSTANT = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"
_MAIL = (
    r"^\s*(?:([A-Za-z]{3})\s*,)?\s*(\d{1,2})\s+([A-Za-z]{3})\s+(\d{2,4})\s+"
    r"(\d{1,2})\s*:\s*(\d{2})(?:\s*:\s*(\d{2}))?\s*([A-Za-z]{1,3}|[+-]\d{4})\s*(?:\(.*\)\s*)?$"
)
_LIST_DATE = r"(?U)\b(\d{2,4})[-/.年](\d{1,2})[-/.月](\d{1,2})(?:日)?(?:\b|T|\s|$)"


def ymd(year: Column, month: Column, day: Column) -> Column:
    """Date from three digit strings; NULL for anything that is no calendar day."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


_MARK = "\u0001"


def _groups(c: Column, pattern: str, n: int, body) -> Column:
    """``body`` of the ``n`` groups of a pattern over the whole text, NULL without a match. One
    pass rewrites the text to its groups between marks; the text is divided there."""
    marked = F.regexp_replace(c, pattern, "".join(f"{_MARK}${i}" for i in range(1, n + 1)))
    return let(
        F.split(marked, _MARK),
        lambda g: F.when((F.size(g) == n + 1) & (F.get(g, F.lit(0)) == ""), body(lambda i: F.get(g, F.lit(i)))),
    )


def _from_pattern(c: Column, pattern: str) -> Column:
    return _groups(c, pattern, 3, lambda g: ymd(g(1), g(2), g(3)))


def _local_date(ts: Column) -> Column:
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit(ZONE), ts.cast("timestamp_ntz")))


def _instant_date(c: Column) -> Column:
    iso = F.concat(F.substring(c, 1, 10), F.lit("T"), F.upper(F.substr(c, F.lit(12))))
    return F.when(c.rlike(_INSTANT), _local_date(F.try_to_timestamp(iso)))


def _mail_date(c: Column) -> Column:
    def assemble(g) -> Column:
        short = F.char_length(g(4))
        number = g(4).cast("int")
        year = (
            F.when((short == 2) & (number < 50), number + 2000)
            .when(short <= 3, number + 1900)
            .otherwise(number)
        )
        at = F.instr(F.lit(_MONTHS), F.lower(g(3)))
        month = F.when((at > 0) & (at % 3 == 1), ((at + 2) / 3).cast("int"))
        zone = F.upper(g(8))
        named = F.try_element_at(F.create_map(*[F.lit(x) for kv in MAIL_ZONES.items() for x in kv]), zone)
        offset = (
            F.when(zone.rlike(r"^[+-]\d{4}$"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2)))
            .when(zone.rlike("^[A-Z]$"), F.lit("+00:00"))
            .otherwise(named)
        )
        clock = F.concat_ws(":", F.lpad(g(5), 2, "0"), g(6), F.when(g(7) == "", F.lit("00")).otherwise(g(7)))

        def on(day: Column) -> Column:
            same_day_name = (g(1) == "") | (F.lower(g(1)) == F.lower(F.date_format(day, "EEE")))
            stamp = F.try_to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), clock, offset))
            return F.when(same_day_name, _local_date(stamp))

        return let(ymd(year.cast("string"), month.cast("string"), g(2)), on)

    return _groups(c, _MAIL, 8, assemble)


def parse_date(c: Column) -> Column:
    """First reading that succeeds: three plain forms, ISO instant, mail-style instant,
    then any 20xx-m-d inside the text."""
    return F.coalesce(
        *[_from_pattern(c, p) for p in _YMD_PATTERNS], _instant_date(c), _mail_date(c), _from_pattern(c, _ANYWHERE)
    )


def iso_day(c: Column) -> Column:
    """Date of a string that is exactly year-month-day, else NULL."""
    return _from_pattern(c, _YMD_PATTERNS[0])


def parse_list_date(c: Column) -> Column:
    """First Gregorian or ROC date in a list cell; years before 1911 are ROC years."""

    def build(p: Column) -> Column:
        number = F.try_to_number(p.y, F.lit("9999")).cast("int")
        year = F.when(number < 1911, number + 1911).otherwise(number)
        return ymd(year.cast("string"), p.m, p.d)

    parts = F.struct(
        F.regexp_extract(c, _LIST_DATE, 1).alias("y"),
        F.regexp_extract(c, _LIST_DATE, 2).alias("m"),
        F.regexp_extract(c, _LIST_DATE, 3).alias("d"),
    )
    return F.when(c.rlike(_LIST_DATE), let(parts, build))


def labelled_day_text(text: Column, label: str) -> Column:
    """Text of the date after ``label`` and an optional colon, ``''`` when absent."""
    return F.regexp_extract(
        text, rf"(?U)\Q{label}\E\s*[:：]?\s*(\d{{2,4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}})", 1
    )


def labelled_date(text: Column, label: str) -> Column:
    return parse_list_date(labelled_day_text(text, label))


def roc_date(d: Column) -> Column:
    """``民國115/8/6``"""
    return F.concat(
        F.lit("民國"), (F.year(d) - 1911).cast("string"), F.lit("/"), F.month(d).cast("string"),
        F.lit("/"), F.day(d).cast("string"),
    )


def roc_compact(d: Column) -> Column:
    """``1150806``"""
    return F.format_string("%03d%02d%02d", F.year(d) - 1911, F.month(d), F.day(d))


@dataclass(frozen=True)
class DateRange:
    """Inclusive range of days."""

    start: dt.date
    end: dt.date

    def column(self, day: Column) -> Column:
        return day.between(F.lit(self.start), F.lit(self.end))

    def roc_label(self) -> str:
        def compact(d: dt.date) -> str:
            return f"{d.year - 1911:03d}{d.month:02d}{d.day:02d}"

        return f"{compact(self.start)}至{compact(self.end)}"


def week_of(day: dt.date) -> DateRange:
    start = day - dt.timedelta(days=day.weekday())
    return DateRange(start, start + dt.timedelta(days=6))


def default_week(today: dt.date) -> DateRange:
    """The current week, or on a Monday the week that has just ended."""
    return week_of(today - dt.timedelta(days=7) if today.weekday() == 0 else today)


def _argument(value: str) -> dt.date:
    try:
        return dt.datetime.strptime(value, "%Y-%m-%d").date()
    except ValueError as error:
        raise ValueError(f"dates must be YYYY-MM-DD: {value}") from error


def resolve_range(
    date: str | None = None, start_date: str | None = None, end_date: str | None = None,
    today: dt.date | None = None,
) -> DateRange:
    """Run parameters to a range; contradictory parameters raise before any job starts."""
    if date is not None and (start_date is not None or end_date is not None):
        raise ValueError("give either date or start_date/end_date")
    if (start_date is None) != (end_date is None):
        raise ValueError("start_date and end_date go together")
    if date is not None:
        return week_of(_argument(date))
    if start_date is not None:
        chosen = DateRange(_argument(start_date), _argument(end_date))
        if chosen.start > chosen.end:
            raise ValueError("start_date is after end_date")
        return chosen
    taipei = dt.timezone(dt.timedelta(hours=8))
    return default_week(today or dt.datetime.now(taipei).date())
