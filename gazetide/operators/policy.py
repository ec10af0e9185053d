"""The topic policy: a parameter, read as data. The default set is below."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetide.functions.text import match_text
from gazetide.schemas import POLICY
from gazetide.session import small_table

# The default policy. A topic is (name, lead source, core keywords,
# supporting keywords).
DEFAULT_VERSION = "2.1.5"
DEFAULT_NAME = "AI 新十大建設預設範本"
DEFAULT_ORIGIN = "內建預設範本"
DEFAULT_TOPICS = [
    ("全民智慧生活圈", "國科會", ["智慧生活圈"],
     ["智慧交通", "智慧醫療", "AI醫療", "智慧健康", "AI健康", "智慧建築", "智慧電網", "智慧照護", "AI照護",
      "智慧防災", "韌性防災", "防災救難", "災防"]),
    ("百工百業智慧應用", "經濟部", ["產業AI化", "產業AI轉型"],
     ["百工百業", "中小微型企業", "中小企業", "智慧製造", "智慧製程", "產業轉型", "產業升級"]),
    ("AI數位產業登峰", "數位發展部", ["AI數位產業", "利基型AI平台", "利基型AI平臺", "AI服務輸出"],
     ["Team Taiwan", "AI服務", "AI軟體", "AI模型", "資服業", "軟體服務", "開源", "國際輸出"]),
    ("矽光子技術全球領先", "經濟部", ["矽光子", "矽光子共同封裝"],
     ["CPO", "共同封裝", "光電整合", "高速傳輸", "低功耗傳輸"]),
    ("全球量子能力登頂", "國科會", ["量子位元", "量子晶片", "量子運算", "量子科技", "後量子密碼"],
     ["量子", "量子研發實驗室", "量子產業鏈"]),
    ("全球AI機器人供應鏈樞紐", "國科會", ["AI機器人", "人形機器人", "智慧機器人", "機器人供應鏈"],
     ["機器人研發", "機器人產業", "機器人零組件", "自主機器人", "服務型機器人", "機器人樞紐"]),
    ("主權AI及算力建設", "國科會", ["主權AI", "AI算力", "算力建設", "國家算力", "AI超級電腦"],
     ["GPU", "先進運算系統", "雲端開發環境", "訓練語料庫", "語料庫"]),
    ("智慧政府與資料治理", "數位發展部", ["智慧政府", "資料治理", "數據治理", "政府AI治理"],
     ["AI治理", "跨域資料整合", "資料匯流", "政府資料", "資料標準", "開放資料"]),
    ("AI人才生態系引領國際", "國發會",
     ["AI人才生態系", "AI人才", "人工智慧人才", "AI教育", "AI素養", "AI公務人才", "AI共通核心能力"],
     ["跨域學習", "產業實作人才", "海外專業人才", "人才培育"]),
    ("千億資金驅動創新", "國發會", ["AI創新基金", "AI投資", "創新資金", "資金點火"],
     ["千億資金", "國發基金", "創業投資", "民間投資", "創新投資"]),
]
DEFAULT_GENERAL = ["AI", "人工智慧", "生成式AI", "生成式人工智慧", "大語言模型", "大型語言模型", "LLM"]
DEFAULT_NEGATIVE = ["徵才", "招募", "職缺", "採購", "招標", "決標", "轉知"]
DEFAULT_HIGH, DEFAULT_POSSIBLE, DEFAULT_PENALTY = 80, 40, 50

@dataclass(frozen=True)
class Topic:
    name: str
    lead_source: str
    core: tuple[str, ...]
    supporting: tuple[str, ...]


@dataclass(frozen=True)
class Policy:
    version: str
    topics: tuple[Topic, ...]
    general: tuple[str, ...]
    negative: tuple[str, ...]
    high: int = DEFAULT_HIGH
    possible: int = DEFAULT_POSSIBLE
    penalty: int = DEFAULT_PENALTY

    @property
    def keyword_count(self) -> int:
        return len(self.general) + sum(len(t.core) + len(t.supporting) for t in self.topics)


def default_policy() -> Policy:
    return Policy(
        DEFAULT_VERSION,
        tuple(Topic(n, s, tuple(core), tuple(sup)) for n, s, core, sup in DEFAULT_TOPICS),
        tuple(DEFAULT_GENERAL),
        tuple(DEFAULT_NEGATIVE),
    )


def read_policy(spark: SparkSession, path: str) -> Policy:
    """Policy from one JSON document."""
    rows = spark.read.schema(POLICY).json(path, multiLine=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one policy document in {path}, found {len(rows)}")
    row = rows[0]
    return Policy(
        row.version,
        tuple(
            Topic(t.name, t.lead_source, tuple(t.strong_keywords), tuple(t.context_keywords))
            for t in row.initiatives
        ),
        tuple(row.general_keywords),
        tuple(row.negative_keywords),
        row.thresholds.high,
        row.thresholds.possible,
        row.thresholds.negative_penalty,
    )


def policy_topics(spark: SparkSession, policy: Policy) -> DataFrame:
    """Topics as rows: topic_no, topic, lead_source, core, supporting."""
    return small_table(
        spark,
        [(i, t.name, t.lead_source, list(t.core), list(t.supporting)) for i, t in enumerate(policy.topics)],
        "topic_no long, topic string, lead_source string, core array<string>, supporting array<string>",
    )


def rule_id(kind: Column, topic: Column, keyword: Column) -> Column:
    """``default:<kind>:<16 hex digits>``, stable for the same rule. Pass a NULL topic for
    rules that belong to none."""
    payload = F.concat_ws("|", kind, match_text(topic), match_text(keyword))
    return F.concat(F.lit("default:"), kind, F.lit(":"), F.substring(F.sha2(payload, 256), 1, 16))


def rule_rows(topics: DataFrame, general: list[str], negative: list[str]) -> DataFrame:
    """Rule sheet, one row per keyword, with the order columns ``rule_group, topic_no,
    kind_no, pos``: global context first, then topics (core before supporting), then
    exclusions. A narrow explode, whatever the number of topics."""
    global_rules = small_table(
        topics.sparkSession,
        [(0, "global-context", "脈絡詞", "標題與摘要", n, w) for n, w in enumerate(general)]
        + [(2, "exclusion", "排除詞", "標題", n, w) for n, w in enumerate(negative)],
        "rule_group int, kind string, rule_type string, match_fields string, pos int, keyword string",
    ).select(
        "rule_group", F.lit(0).cast("long").alias("topic_no"), F.lit(0).alias("kind_no"), "pos",
        F.lit(None).cast("string").alias("topic"), "kind", "rule_type", "keyword", "match_fields",
    )
    lists = F.array(
        F.struct(F.lit(0).alias("kind_no"), F.lit("core").alias("kind"), F.lit("核心詞").alias("rule_type"), F.col("core").alias("words")),
        F.struct(F.lit(1).alias("kind_no"), F.lit("supporting").alias("kind"), F.lit("輔助詞").alias("rule_type"), F.col("supporting").alias("words")),
    )
    topic_rules = (
        topics.select("topic_no", "topic", F.inline(lists))
        .select("topic_no", "kind_no", "topic", "kind", "rule_type", F.posexplode("words").alias("pos", "keyword"))
        .select(
            F.lit(1).alias("rule_group"), "topic_no", "kind_no", "pos", "topic", "kind", "rule_type", "keyword",
            F.lit("標題與摘要").alias("match_fields"),
        )
    )
    rules = global_rules.unionByName(topic_rules)
    return rules.select(
        "rule_group", "topic_no", "kind_no", "pos",
        F.coalesce("topic", F.lit("全域")).alias("topic"),
        "rule_type", "keyword", "match_fields",
        F.lit("是").alias("enabled"),
        F.lit("default").alias("origin"),
        rule_id(F.col("kind"), F.col("topic"), F.col("keyword")).alias("rule_id"),
    )


def reference_rows(topics: DataFrame, general: list[str], negative: list[str]) -> DataFrame:
    """Topic sheet, one row per topic with its keyword lists joined."""
    return topics.select(
        "topic_no",
        "topic",
        F.lit("是").alias("enabled"),
        "lead_source",
        F.lit("是").alias("match_name"),
        F.lit("#FFFF00").alias("colour"),
        F.array_join("core", "、").alias("core_words"),
        F.array_join("supporting", "、").alias("supporting_words"),
        F.lit("").alias("topic_context_words"),
        F.lit("、".join(general)).alias("global_words"),
        F.lit("").alias("topic_excluded_words"),
        F.lit("、".join(negative)).alias("excluded_words"),
    )


def ruleset_hash(policy: Policy) -> str:
    """16 hex digits over the canonical JSON of the expanded policy."""

    def squeeze(word: str) -> str:
        return "".join(word.split()).lower().replace("（", "(").replace("）", ")")

    def ident(kind: str, *parts: str) -> str:
        payload = "|".join([kind, *map(squeeze, parts)])
        return f"default:{kind}:{hashlib.sha256(payload.encode()).hexdigest()[:16]}"

    def rule(kind: str, word: str, *owner: str) -> dict:
        return {"id": ident(kind, *owner, word), "text": word, "enabled": True, "origin": "default"}

    document = {
        "schema_version": 1,
        "include_unassigned_context_matches": True,
        "topics": [
            {
                "id": ident("topic", t.name),
                "name": t.name,
                "enabled": True,
                "match_name": True,
                "priority_sources": [t.lead_source],
                "core_keywords": [rule("core", w, t.name) for w in t.core],
                "supporting_keywords": [rule("supporting", w, t.name) for w in t.supporting],
                "context_keywords": [],
            }
            for t in policy.topics
        ],
        "global_context_keywords": [rule("global-context", w) for w in policy.general],
        "exclusions": [
            {**rule("exclusion", w), "topic_id": "", "match_fields": ["title"]} for w in policy.negative
        ],
    }
    text = json.dumps(document, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def policy_summary(policy: Policy) -> dict:
    """Counts and identity of a policy, as written into run reports."""
    topics, words, exclusions = len(policy.topics), policy.keyword_count, len(policy.negative)
    return {
        "schema_version": 1,
        "name": DEFAULT_NAME,
        "template_version": policy.version,
        "ruleset_hash": ruleset_hash(policy),
        "source": DEFAULT_ORIGIN,
        "topic_count": topics,
        "enabled_topic_count": topics,
        "disabled_topic_count": 0,
        "keyword_count": words,
        "enabled_keyword_count": words,
        "disabled_keyword_count": 0,
        "exclusion_count": exclusions,
        "enabled_exclusion_count": exclusions,
        "disabled_exclusion_count": 0,
        "custom_item_count": 0,
        "deleted_default_count": 0,
    }


# Labels of the policy version sheet, in the order of policy_summary().
VERSION_LABELS = [
    "設定格式版本", "設定名稱", "範本版本", "有效規則雜湊", "設定來源", "主題總數", "啟用主題數", "停用主題數",
    "關鍵字總數", "啟用關鍵字數", "停用關鍵字數", "排除詞總數", "啟用排除詞數", "停用排除詞數", "自訂項目數",
    "已刪除預設項目數",
]


def version_rows(spark: SparkSession, policy: Policy, exported_at: str) -> DataFrame:
    values = [str(v) for v in policy_summary(policy).values()]
    rows = [*zip(VERSION_LABELS, values), ("匯出時間", exported_at)]
    return small_table(
        spark, [(i, label, value) for i, (label, value) in enumerate(rows)], "row_no int, item string, content string"
    )
