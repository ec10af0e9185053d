"""How a fetch or parse ended, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Failure class -> (report category, worth another try, message prefix).
FAILURE_CLASSES = {
    "source_outage": ("connection", True, "來源暫時故障："),
    "runner_network": ("connection", True, "執行器網路錯誤："),
    "tls_certificate": ("ssl", True, "TLS 憑證錯誤："),
    "access_blocked": ("http", False, "來源拒絕存取："),
    "parser_regression": ("parse", False, "來源解析錯誤："),
    "browser_runtime": ("browser", False, "瀏覽器執行錯誤："),
    "unknown": ("unexpected", False, "未知來源錯誤："),
}

# Phrases of a rendered page that is a bot challenge instead of content.
CHALLENGE_PHRASES = ["Request unsuccessful", "incapsula incident id"]


def _lookup(failure_class: Column, place: int, default) -> Column:
    table = F.create_map(*[F.lit(x) for name, row in FAILURE_CLASSES.items() for x in (name, row[place])])
    return F.coalesce(F.try_element_at(table, failure_class), F.lit(default))


def error_category(failure_class: Column) -> Column:
    return _lookup(failure_class, 0, "")


def retryable(failure_class: Column) -> Column:
    return _lookup(failure_class, 1, False)


def failure_message(failure_class: Column, detail: Column) -> Column:
    return F.concat(_lookup(failure_class, 2, ""), detail)


def http_failure(status_code: Column, transport_error: Column) -> Column:
    """Failure class of a captured response, ``''`` for a good one. ``transport_error`` is
    NULL or one of timeout, connect, request, body, tls, or anything else."""
    return (
        F.when(transport_error.isin("timeout", "connect"), "runner_network")
        .when(transport_error.isin("request", "body"), "source_outage")
        .when(transport_error == "tls", "tls_certificate")
        .when(transport_error.isNotNull() & (transport_error != ""), "unknown")
        .when(status_code.isin(401, 403), "access_blocked")
        .when((status_code == 429) | status_code.between(500, 599), "source_outage")
        .when(~status_code.between(200, 299), "parser_regression")
        .otherwise("")
    )


def is_challenge_page(kind: Column, body: Column) -> Column:
    hit = F.lit(False)
    for phrase in CHALLENGE_PHRASES:
        hit = hit | body.contains(phrase)
    return (kind == "browser") & hit


def capture_failure(kind: Column, status_code: Column, transport_error: Column, body: Column) -> Column:
    """Failure class of a capture before any parsing, ``''`` when its body can be parsed."""
    http = http_failure(status_code, transport_error)
    browser = F.when(
        (F.coalesce(transport_error, F.lit("")) != "") | is_challenge_page(kind, body), "browser_runtime"
    ).otherwise("")
    return F.when(kind == "browser", browser).otherwise(http)
