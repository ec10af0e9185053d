"""Memory of Python tasks does not follow the size of their batches."""

import gc
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gazetide.operators import relevance as R
from gazetide.sources import details, extract
from gazetide.sources import profiles as P


class Plain:
    """Stands for a table whose ``mapInArrow`` gives the function back."""

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("counted", [True, False])
def test_stretches_are_sent_in_portions(counted):
    letters = np.random.default_rng(1).integers(97, 123, 6_000_000, np.uint8).tobytes()
    texts = [letters[i : i + 2_000] for i in range(0, len(letters), 2_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["id", "norm"])
    run = R._grams_of(Plain(), [8], np.full(1 << 21, 255, np.uint8), counted)
    tracemalloc.start()
    rows = sizes = 0
    for out in run(iter([batch])):
        rows += out.num_rows
        sizes = max(sizes, out.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 5_000_000 < rows <= 6_000_000 and sizes <= 1 << 18
    assert peak < 128 << 20


def test_keywords_of_all_kinds(spark):
    """Shorter and longer than an anchor, alone, with white space and capitals, at the text's ends."""
    words = ["ab", "Ab c", "abcdefgh", "abcdefghi", "ABCDEFGHIJKLMNOPQ", "über alles", "x", "", "nowhere to be found", "abababababab"]
    texts = ["ab", "xab", "Ab-c ABC", "zzabcdefghijklmnopq", "abcdefgh", "ABCDEFGH I", "ÜBER ALLES x", None, "", "abababababababab", "ababababab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id, r.keyword) for r in R.keyword_matches(rows, spark.createDataFrame([(w,) for w in words], "keyword string")).collect()}
    norm = [R.squeezed(t or "") for t in texts]
    runs = [set("".join(c if c.isascii() and c.isalnum() else " " for c in t).split()) for t in norm]
    short = lambda k: len(k) <= 4 and k.isascii() and k.isalnum()
    want = {
        (i, w) for i, t in enumerate(norm) for w in words
        if (k := R.squeezed(w)) and (k in runs[i] if short(k) else k in t)
    }
    assert got == want


@pytest.mark.parametrize("reader", ["read_feed", "read_page", "html_texts", "read_detail"])
def test_pages_of_a_batch_are_read_one_after_another(reader):
    words = "wort ünd " * 400
    feed = "<rss><channel>" + f"<item><title>{words}</title><link>https://a.test/1</link><description>{words}</description></item>" * 4 + "</channel></rss>"
    page = "<article>" + f"<li class='x'><a href='/n'>{words}</a><p>{words}</p></li>" * 4 + "</article>"
    count = 600
    css = pa.array([{"item": "li", **{f: "a" for f in P.FIELDS if f != "item"}}] * count)
    arguments = {
        "read_feed": pa.array([feed] * count),
        "read_page": (pa.array([page] * count), css),
        "html_texts": pa.array([[page]] * count),
        "read_detail": (pa.array([page] * count), pa.array([["article"]] * count)),
    }[reader]
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        parts = [len(part) for part in getattr(extract, reader).func(iter([arguments]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        gc.enable()
    assert sum(parts) == count and max(parts) < count / 3
    assert peak < 16 << 20


def python_steps(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_captures_of_all_kinds_need_one_python_worker_a_task(spark):
    item = "<item><title>t</title><link>https://a.test/1</link><description>&lt;b&gt;s&lt;/b&gt;</description></item>"
    open_data = '[{"公告日期":"2026-08-03T00:00:00","Title":"o","Source":"https://b.test/1","資料來源":"","內容":"<p>x</p>"}]'
    rows = [
        ("財政部", "feed", "rss", "standard-rss", f"<rss><channel>{item}</channel></rss>"),
        ("外交部", "page", "html", "standard", "<table><tr><td>2026-08-03</td><td><a href='/n'>p</a></td></tr></table>"),
        ("公路局", "open", "json", "thb-json", open_data),
        ("財政部", "broken", "rss", "standard-rss", "<rss><item></rss>"),
        ("財政部", "nothing", "rss", "standard-rss", None),
    ]
    captures = spark.createDataFrame(rows, "source string, route_id string, kind string, parser string, body string").selectExpr(
        "source", "route_id", "concat('https://c.test/', route_id) AS url", "kind", "parser", "1 AS priority", "200 AS status_code",
        "CAST(NULL AS STRING) AS transport_error", "body", "0.5D AS elapsed_seconds", "CAST(NULL AS TIMESTAMP) AS fetched_at",
    )
    parsed = extract.parse_captures(captures, P.default_profiles(spark))
    assert python_steps(parsed) == 1
    got = {r.route_id: (r.failure_class, [(i.title, i.summary) for i in r["items"] or []]) for r in parsed.collect()}
    assert got["feed"] == ("", [("t", "s")])
    assert got["page"] == ("", [("p", "")])
    assert got["open"] == ("", [("o", "x")])
    assert got["broken"] == ("parser_regression", [])
    assert got["nothing"] == ("", [])


def test_detail_pages_are_read_once(spark):
    items = spark.createDataFrame([("web", "u", ""), ("web", "v", ""), ("web", "w", "own")], "source string, link string, summary string")
    pages = spark.createDataFrame([("u", "<article><p>a</p></article>"), ("v", "<p>b</p>")], "url string, body string")
    filled = details.enrich(items, pages, {"web": ["article"]})
    assert python_steps(filled) == 1
    assert sorted(tuple(r) for r in filled.collect()) == [("web", "u", "a"), ("web", "v", ""), ("web", "w", "own")]


def test_keywords_travel_once_to_a_chunk(spark):
    """What is shuffled are compressed blocks: no row for a hit, whatever the number of texts that hold a keyword."""
    words = [f"keyword number {i}" for i in range(200)]
    texts = spark.createDataFrame([(i, " ".join(words)) for i in range(2_000)], "id long, text string").coalesce(1)
    found = R.keyword_matches(texts, spark.createDataFrame([(w,) for w in words], "keyword string"))
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "SortMergeJoin" not in plan
    assert found.count() == 2_000 * 200
    norms = spark.createDataFrame([(R.squeezed(w).encode(), w) for w in words], "norm binary, keyword string")
    keyed = R._keyed(norms, 1)
    bits = R._filter(keyed, len(words))
    chunks = R._chunks(texts.selectExpr("0L AS part", "id", "cast(replace(text, ' ', '') AS binary) AS norm"))
    asked = R._asked(chunks, [14, 15, 16], bits, 1)
    (answer,) = R._answered(asked, keyed).collect()
    assert len(chunks.collect()) == 1 and len(asked.collect()) == 1
    assert sum(len(x) for x in (answer.norms, answer.written, answer.words)) < 20_000
    assert [w.as_py().decode() for w in R._unpacked_words(answer.norms)] == sorted(R.squeezed(w) for w in words)


def test_search_against_brute_force(monkeypatch):
    """Keywords of all lengths, some the beginning of others, across portions and at the ends of texts."""
    monkeypatch.setattr(R, "PORTION", 97)
    rng = np.random.default_rng(3)
    draw = lambda n: bytes(rng.choice(list(b"ab-\xc3\xa9"), n).astype(np.uint8))
    texts = [draw(int(n)) for n in rng.integers(0, 120, 60)] + [b"", b"a" * 300, b"ab", b""]
    words = {draw(int(n)) for n in rng.integers(1, 6, 40)} | {t[i : i + n] for t in texts for i in (0, 7, 50) for n in (7, 8, 9, 15, 16, 17, 18, 40)}
    words = sorted((words | {b"a" * n for n in range(1, 40)}) - {b""})
    sizes = np.array([len(t) for t in texts])
    got = R._held(b"".join(texts), np.cumsum(sizes) - sizes, pa.array(words, pa.large_binary()))
    letter = lambda b: b in b"abcdefghijklmnopqrstuvwxyz0123456789"

    def holds(t, w):
        if len(w) > 4 or not all(map(letter, w)):
            return w in t
        return any(
            t[i : i + len(w)] == w and not (i and letter(t[i - 1])) and not (i + len(w) < len(t) and letter(t[i + len(w)]))
            for i in range(len(t))
        )

    want = [i * len(words) + j for i, t in enumerate(texts) for j, w in enumerate(words) if holds(t, w)]
    assert got.tolist() == want and len(want) > 1_000
