import json
import random

import pytest
from pyspark.sql import functions as F

from gazetide.operators import affiliation, policy, quality, relevance, scoring
from gazetide.schemas import as_items


def items(spark, rows):
    base = {"source": "來源", "date": "2026-08-06", "department": "", "title": "題", "link": "https://example.test"}
    full = [{**base, **r, "ord": i} for i, r in enumerate(rows)]
    return as_items(
        spark.createDataFrame(
            [(r["ord"], r["source"], r["date"], r["department"], r["title"], r["link"]) for r in full],
            "ord long, source string, date string, department string, title string, link string",
        )
    )


def test_exact_dedupe(spark):
    got = quality.exact_dedupe(items(spark, [{"title": "一"}, {"title": "一"}, {"title": "二"}]))
    assert [r.title for r in got.orderBy("ord").collect()] == ["一", "二"]


def test_url_and_title_duplicates(spark):
    done = quality.process(
        items(spark, [{"link": "https://EXAMPLE.test/news?id=1&utm_source=test#part"},
                      {"link": "https://example.test/news?id=1", "title": "題 "}])
    )
    rows = done.orderBy("ord").collect()
    assert [r.verdict for r in rows] == ["kept", "duplicate"]
    assert rows[0].link == "https://example.test/news?id=1"
    assert rows[1].reason == "same_source_title_or_url" and rows[1].title == "題"


def test_invalid_and_non_news(spark):
    done = quality.process(
        items(spark, [{"link": "not-a-url"}, {"title": "轉知事求人機關徵才系統"}, {"title": " ", "date": ""},
                      {"date": "2026/08/06"}])
    )
    rows = done.orderBy("ord").collect()
    assert [(r.verdict, r.reason) for r in rows] == [
        ("invalid_item", "invalid_url"), ("excluded_non_news", "title_keyword"),
        ("invalid_item", "missing_fields:date,title"), ("invalid_item", "invalid_date"),
    ]
    counted = quality.with_alerts(quality.counters(done)).first()
    assert (counted.output_count, counted.invalid_count, counted.excluded_non_news_count) == (0, 3, 1)
    assert counted.alert_reasons == ["invalid_items"] and counted.summary_coverage_rate == 0.0
    assert quality.issues(done).count() == 4


def greedy(rows):
    t_seen, u_seen, kept = set(), set(), []
    for o, t, u in sorted(rows):
        if t not in t_seen and u not in u_seen:
            t_seen.add(t), u_seen.add(u), kept.append(o)
    return kept


def as_edges(spark, rows):
    return spark.createDataFrame(rows, "ord long, t string, u string").select(
        "ord", F.encode("t", "utf-8").alias("tkey"), F.encode("u", "utf-8").alias("ukey")
    )


@pytest.mark.parametrize("seed", [7, 8])
def test_first_come_equals_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"t{rng.randrange(40)}", f"u{rng.randrange(40)}") for i in rng.sample(range(1000), 300)]
    # one hot title with many links, one hot link with many titles, and chains
    rows += [(2000 + i, "hot", f"h{i}") for i in range(150)] + [(3000 + i, f"k{i}", "hotlink") for i in range(150)]
    rows += [(4000 + i, f"c{(i + 1) // 2}", f"d{i // 2}") for i in range(30)]
    rows += [(5000 + o, f"e{(i + 1) // 2}", f"f{i // 2}") for i, o in enumerate(rng.sample(range(60), 60))]
    assert sorted(r.ord for r in quality.first_come(as_edges(spark, rows)).collect()) == greedy(rows)


def test_first_come_of_a_long_chain(spark, monkeypatch):
    n = 100_000
    chain = spark.range(n).select(
        F.col("id").alias("ord"),
        F.encode(F.concat(F.lit("c"), F.floor((F.col("id") + 1) / 2)), "utf-8").alias("tkey"),
        F.encode(F.concat(F.lit("d"), F.floor(F.col("id") / 2)), "utf-8").alias("ukey"),
    )
    hot = spark.range(5000).select(
        (F.col("id") + n).alias("ord"), F.encode(F.lit("hot"), "utf-8").alias("tkey"),
        F.encode(F.concat(F.lit("h"), F.col("id")), "utf-8").alias("ukey"),
    )
    rounds = []
    inner = quality._chained
    monkeypatch.setattr(quality, "_chained", lambda e: rounds.append(1) or inner(e))
    kept = quality.first_come(chain.union(hot))
    # Every other row of the chain, and the first of the hot title.
    assert kept.count() == n // 2 + 1 and kept.where(f"ord < {n} and ord % 2 = 1").isEmpty()
    assert len(rounds) <= 3


def test_first_come_of_a_chain_with_later_rows_on_every_node(spark, monkeypatch):
    n = 10_000
    place = F.col("id")
    node = lambda name, at: F.encode(F.concat(F.lit(name), F.floor(at / 2)), "utf-8")
    chain = spark.range(n).select(place.alias("ord"), node("c", place + 1).alias("tkey"), node("d", place).alias("ukey"))
    own = F.encode(F.concat(F.lit("own"), place), "utf-8")
    later = spark.range(n).select(
        (place + n).alias("ord"),
        F.when(place % 2 == 0, node("c", place)).otherwise(own).alias("tkey"),
        F.when(place % 2 == 0, own).otherwise(node("d", place)).alias("ukey"),
    )
    rounds = []
    inner = quality._chained
    monkeypatch.setattr(quality, "_chained", lambda e: rounds.append(1) or inner(e))
    kept = quality.first_come(chain.union(later))
    assert kept.count() == n // 2 and kept.where(f"ord >= {n} or ord % 2 = 1").isEmpty()
    assert len(rounds) <= 2


def test_first_come_empty(spark):
    edges = spark.createDataFrame([], "ord long, tkey binary, ukey binary")
    assert quality.first_come(edges).count() == 0


def test_affiliated(spark):
    table = affiliation.default_affiliation(spark)
    got = affiliation.dedupe_affiliated(
        items(spark, [{"source": "內政部", "title": "同一則（新聞）"}, {"source": "警政署", "title": "同一則 (新聞)"},
                      {"source": "財政部", "title": "同一則(新聞)"}]), table)
    assert {r.source for r in got.collect()} == {"財政部", "警政署"} and got.count() == 2
    assert sorted(got.columns) == sorted(items(spark, [{}]).columns)
    both = affiliation.dedupe_affiliated(items(spark, [{"source": "甲"}, {"source": "乙"}]), table)
    assert both.count() == 2


def test_affiliated_order(spark):
    table = affiliation.default_affiliation(spark)
    rows = [{"source": "內政部", "title": "a"}, {"source": "獨立", "title": "b"},
            {"source": "內政部", "title": "c"}, {"source": "消防署", "title": "a", "department": "科"}]
    got = affiliation.dedupe_affiliated(items(spark, rows), table).orderBy("ord").collect()
    assert [(r.source, r.title) for r in got] == [("獨立", "b"), ("消防署", "a"), ("內政部", "c")]


def test_affiliated_refuses_numbers_that_do_not_fit(spark):
    table = affiliation.default_affiliation(spark)
    rows = items(spark, [{"source": "內政部", "title": "a"}, {"source": "消防署", "title": "a"}])
    again = affiliation.dedupe_affiliated(rows, table)
    assert again.count() == 1
    with pytest.raises(Exception, match="ord is not within"):
        affiliation.dedupe_affiliated(again, table).collect()


def test_agency_path(spark):
    table = affiliation.default_affiliation(spark)
    rows = items(spark, [{"source": "國土管理署", "department": "國土管理署／都市基礎工程組"},
                         {"source": "司法院", "department": "司法院／臺灣臺北地方法院"}])
    got = affiliation.with_affiliation(rows, table).orderBy("ord").select(
        affiliation.agency_path(F.col("source"), F.col("path"), F.col("department")).alias("p")
    ).collect()
    assert [tuple(r.p) for r in got] == [("內政部", "國土管理署 / 都市基礎工程組"), ("司法院", "臺灣臺北地方法院")]


def test_policy_known_answers(spark):
    default = policy.default_policy()
    summary = policy.policy_summary(default)
    assert (summary["topic_count"], summary["keyword_count"], summary["exclusion_count"]) == (10, 107, 7)
    assert summary["ruleset_hash"] == "e75be08ee1c5dab8"
    topics = policy.policy_topics(spark, default)
    rows = policy.rule_rows(topics, default.general, default.negative).orderBy("rule_group", "topic_no", "kind_no", "pos").collect()
    assert len(rows) == 114 and rows[0].keyword == "AI" and rows[-1].keyword == "轉知"
    assert rows[7].rule_type == "核心詞" and rows[7].keyword == "智慧生活圈"
    refs = policy.reference_rows(topics, default.general, default.negative).orderBy("topic_no").collect()
    assert len(refs) == 10 and refs[3].core_words == "矽光子、矽光子共同封裝"
    assert refs[0].excluded_words.startswith("徵才、招募")
    assert policy.version_rows(spark, default, "now").count() == 17


def test_policy_from_json(spark, tmp_path):
    path = tmp_path / "policy.json"
    path.write_text(json.dumps({
        "version": "9", "general_keywords": ["AI"], "negative_keywords": ["it's"],
        "initiatives": [{"name": "T", "lead_agency": "x", "lead_source": "s", "exact_phrases": [], "strong_keywords": ["a\\b"], "context_keywords": []}],
        "thresholds": {"high": 90, "possible": 30, "negative_penalty": 10},
    }), encoding="utf-8")
    got = policy.read_policy(spark, str(path))
    assert got == policy.Policy("9", (policy.Topic("T", "s", ("a\\b",), ()),), ("AI",), ("it's",), 90, 30, 10)
    df = spark.createDataFrame([("see a\\b, it's (AI)", "s", "")], "title string, source string, summary string")
    rel = relevance.score_items(df, got).first().rel
    assert (rel.score, rel.matched_keywords, rel.excluded_keywords) == (75, ["a\\b", "AI"], ["it's"])
    assert rel.relevance == "可能相關"


def test_keyword_matches(spark):
    texts = ["see the AI（x）", "aiming high", "generative ai, GPU", "", None, "a" * 50_000 + " zz 大語言 模型"]
    words = ["AI", "gpu", "（X）", "大語言模型", "z", " ", "", None, "aiming high", "AI", "ative ai,g"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = relevance.keyword_matches(table, spark.createDataFrame([(w,) for w in words], "keyword string")).collect()
    normal = table.select("id", relevance.keyword_hits(relevance.match_text(F.col("text")), [w for w in words if w and w.strip()]).alias("h"))
    want = {(r.id, w) for r in normal.collect() for w in r.h or []}
    assert sorted((r.id, r.keyword) for r in got) == sorted(want) and len(want) >= 3
    assert relevance.keyword_matches(table, spark.createDataFrame([], "keyword string")).collect() == []


def scored(spark, title, source, summary):
    df = spark.createDataFrame([(title, source, summary)], "title string, source string, summary string")
    return relevance.score_items(df, policy.default_policy()).first().rel


def test_scoring_known_answers(spark):
    top = scored(spark, "主權AI及算力建設正式啟動", "國科會", "國家算力建設")
    assert (top.relevance, top.score) == ("高度相關", 100)
    assert top.topics[0] == "主權AI及算力建設" and top.priority_sources == ["國科會"]
    low = scored(spark, "AI算力採購公告", "國科會", "")
    assert (low.relevance, low.score) == ("未納入", 35)
    assert low.excluded_keywords == ["採購"] and low.reasons[-1] == "主權AI及算力建設：命中排除詞，分數下修"


def test_scoring_branches(spark):
    manual = scored(spark, "認識 LLM", "甲", "")
    assert (manual.relevance, manual.score, manual.topics) == ("可能相關", 40, ["待人工判讀"])
    assert manual.reasons == ["僅命中全域脈絡詞，需人工判讀"] and manual.matched_keywords == ["LLM"]
    excluded = scored(spark, "LLM 徵才", "甲", "")
    assert (excluded.relevance, excluded.score) == ("未納入", 0)
    assert scored(spark, "天氣", "甲", "").relevance == ""
    assert scored(spark, "天氣徵才", "甲", "").relevance == "未納入"
    assert scored(spark, "aigpu", "甲", "").relevance == ""
    lead = scored(spark, "災防演練", "國科會", "")
    assert (lead.score, lead.reasons) == (50, ["全民智慧生活圈：優先關聯機關標題命中輔助詞"])
    pair = scored(spark, "災防 人工智慧", "國科會", "開源人工智慧")
    assert pair.score == 80 and pair.relevance == "高度相關"
    assert pair.topic_matches[1].score == 45 and pair.topics == ["全民智慧生活圈", "AI數位產業登峰"]


def test_score_by_table(spark):
    """A policy as tables gives what the same policy in the plan gives."""
    topics = (
        policy.Topic("Alpha Plan", "s1", ("quantum bit", "gpu"), ("chip", "cloud", "chip")),
        policy.Topic("Beta", "s2", ("robot",), ("chip", "arm")),
        policy.Topic("Gamma", "s3", (), ("cloud",)),
    )
    made = policy.Policy("t", topics, ("AI", "LLM"), ("hiring", "tender"))
    texts = [
        "alpha plan", "quantum  bit chip", "chip", "chip AI", "cloud LLM AI", "robot hiring", "hiring", "AI hiring", "AI", "arm cloud",
        "AIR chipset", "gpux", "GPU", "", None, "tender robot alphaplan cloud chip AI",
    ]
    rows = [(3 * (len(texts) * i + j) - 7, t, s, u) for i, t in enumerate(texts) for j, u in enumerate(texts) for s in [("s1", "s2", "s4", None)[(i + j) % 4]]]
    items = spark.createDataFrame(rows, "ord long, title string, source string, summary string")
    got = scoring.score_by_table(items, scoring.policy_table(spark, made))
    want = relevance.score_items(items.fillna("", ["title", "summary"]), made).select("ord", "rel").collect()
    matches = {(r.ord, r.name): r for r in got.matches.collect()}
    fields = ["priority_sources", "relevance", "score", "matched_keywords", "excluded_keywords", "reasons"]
    expected = {(r.ord, m.name): m for r in want for m in r.rel.topic_matches if m.name != relevance.MANUAL_TOPIC}
    assert len(expected) > 100
    assert {k: [m[f] for f in fields] for k, m in matches.items()} == {k: [m[f] for f in fields] for k, m in expected.items()}
    of_topic = {r.ord: [m for m in r.rel.topic_matches if m.name != relevance.MANUAL_TOPIC] for r in want}
    wanted_rows = {
        r.ord: (r.rel.relevance, r.rel.score, len(of_topic[r.ord]), next((m.name for m in r.rel.topic_matches if m.score == r.rel.score), ""))
        for r in want
    }
    assert {r.ord: tuple(r)[1:] for r in got.rows.collect()} == wanted_rows
    empty = scoring.PolicyTable(*[d.limit(0) for d in (policy.policy_topics(spark, made), *[scoring.word_table(spark, ["x"])] * 2)])
    silent = scoring.score_by_table(items, empty)
    assert silent.matches.isEmpty() and {tuple(r)[1:] for r in silent.rows.collect()} == {("", 0, 0, "")}
