"""SQL counterparts of the registered queries, written against the raw tables and sharing
no code path with the Spark side except fixed values."""

from __future__ import annotations

from gazetide.functions.outcomes import FAILURE_CLASSES
from gazetide.functions.text import WHITE_SPACE
from gazetide.functions.urls import TRACKING_KEYS
from gazetide.operators import relevance as R
from gazetide.operators.policy import Policy
from gazetide.operators.digest import DIGEST_COLUMNS
from gazetide.plans import tables as T

def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WHITE_SPACE}]+', ' ', 'g'))"


def bare(x: str) -> str:
    return f"regexp_replace({x}, '[{WHITE_SPACE}]+', '', 'g')"


def title_key(x: str) -> str:
    return f"translate({bare(x)}, '（）', '()')"


def match_text(x: str) -> str:
    return f"translate(lower({bare(x)}), '（）', '()')"


def day(i: str) -> str:
    return f"(DATE '{T.FIRST_DAY}' + CAST({i} % 21 AS INTEGER))"


def dated_text(d: str, form: str) -> str:
    b = f"({d} - 1)"
    return f"""CASE {form} WHEN 0 THEN strftime({d}, '%Y-%m-%d')
      WHEN 1 THEN year({d}) || '/' || month({d}) || '/' || day({d})
      WHEN 2 THEN 'posted ' || strftime({d}, '%Y-%m-%d') || ' 10:00'
      WHEN 3 THEN strftime({b}, '%Y-%m-%d') || 'T16:30:00Z'
      WHEN 4 THEN strftime({b}, '%a, %d %b %Y') || ' 16:30:00 GMT'
      WHEN 5 THEN day({b}) || strftime({b}, ' %b %Y') || ' 11:30 -0500'
      ELSE 'soon' END"""


def unique(l: str) -> str:
    return f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"


LINE = "split_part(text, chr(10), 1)"

ITEMS = f"""items AS (
  SELECT doc_id AS ord, source, CAST({day('doc_id')} AS VARCHAR) AS date, lang AS department,
    CASE WHEN doc_id % 97 = 0 THEN ''
         WHEN doc_id % 5 = 0 AND doc_id % 1000 < 250 THEN 'Bulletin'
         WHEN doc_id % 5 = 0 AND doc_id % 1000 < 500 THEN 'Bulletin ' || source
         WHEN doc_id % 83 = 0 THEN {LINE} || ' {T.NON_NEWS}'
         ELSE {LINE} END AS title,
    CASE WHEN doc_id % 89 = 0 THEN 'not-a-url'
         ELSE 'https://EXAMPLE.test/' || source || '/' || CASE WHEN doc_id % 3 = 0 THEN doc_id % 500 ELSE doc_id END
              || '?id=1&utm_source=x#p' END AS link,
    '' AS category, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS summary,
    CASE WHEN doc_id % 10 = 0 THEN 'updated' ELSE 'published' END AS date_source
  FROM documents)"""

# Week of raw items: every form of date except "soon" reads as the item's day.
WEEK_ITEMS = f"""witems AS (
  SELECT * FROM items WHERE ord % 7 <> 6 AND CAST(date AS DATE) BETWEEN DATE '{T.WEEK.start}' AND DATE '{T.WEEK.end}')"""


def norm_url(u: str) -> str:
    part = lambda n: f"regexp_extract({u}, '^(https?)://([^/?#]*)([^?#]*)([?][^#]*)?(#.*)?$', {n})"
    keys = ", ".join(q(k) for k in TRACKING_KEYS)
    pairs = (
        f"list_filter(string_split(substr({part(4)}, 2), '&'), "
        f"lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({keys}))"
    )
    kept = f"list_transform({pairs}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)"
    return f"""CASE WHEN regexp_matches({u}, '^https?://[^/?# ]+') THEN
      {part(1)} || '://' || lower({part(2)}) || CASE WHEN {part(3)} = '' THEN '/' ELSE {part(3)} END
      || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"""


def missing(date: str = "date") -> str:
    return "concat_ws(',', " + ", ".join(
        f"CASE WHEN {clean(c)} = '' THEN {q(n)} END" for n, c in
        (("source", "source"), ("date", date), ("title", "title"), ("link", "link"))
    ) + ")"


def judged(source: str, name: str = "judged", date_ok: str | None = None) -> str:
    ok = date_ok or f"regexp_matches(date, '^[0-9]{{1,4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$')"
    return f"""{name} AS (
  SELECT *, CASE WHEN bad IS NOT NULL THEN 'invalid_item' WHEN contains(ctitle, '{T.NON_NEWS}') THEN 'excluded_non_news' END AS verdict0,
    CASE WHEN bad IS NOT NULL THEN bad WHEN contains(ctitle, '{T.NON_NEWS}') THEN 'title_keyword' END AS reason0
  FROM (SELECT *, {clean('title')} AS ctitle, {norm_url('link')} AS nurl,
      CASE WHEN {missing()} <> '' THEN 'missing_fields:' || {missing()}
           WHEN NOT {ok} THEN 'invalid_date' WHEN {norm_url('link')} IS NULL THEN 'invalid_url' END AS bad
    FROM {source}))"""


def greedy(source: str, order: str = "ord") -> str:
    """CTEs from ``judged`` rows to ``done``; they need WITH RECURSIVE."""
    ctes = [
        judged(source),
        f"""l0 AS MATERIALIZED (SELECT {order} AS o, source || chr(31) || date || chr(31) || {title_key('ctitle')} AS tk,
      source || chr(31) || nurl AS uk FROM judged WHERE verdict0 IS NULL)""",
    ]
    # A step drops what touches a row kept in the step before, then keeps what comes first
    # in both groups; it ends when nothing is left.
    ctes.append("""steps AS (
  SELECT o, tk, uk, o = min(o) OVER (PARTITION BY tk) AND o = min(o) OVER (PARTITION BY uk) AS kept FROM l0
  UNION ALL
  SELECT o, tk, uk, o = min(o) OVER (PARTITION BY tk) AND o = min(o) OVER (PARTITION BY uk) AS kept
  FROM (SELECT o, tk, uk, bool_or(kept) OVER (PARTITION BY tk) AS t, bool_or(kept) OVER (PARTITION BY uk) AS u FROM steps)
  WHERE NOT t AND NOT u)""")
    ctes.append("kept AS MATERIALIZED (SELECT o FROM steps WHERE kept)")
    ctes.append(f"""done AS MATERIALIZED (
  SELECT *, CASE WHEN verdict0 IS NOT NULL THEN verdict0 WHEN {order} IN (SELECT o FROM kept) THEN 'kept'
      ELSE 'duplicate' END AS verdict FROM judged)""")
    return ",\n".join(ctes)


DONE_COLUMNS = """ord, verdict, CASE WHEN verdict = 'kept' THEN '' WHEN verdict0 IS NULL THEN 'same_source_title_or_url'
  ELSE reason0 END AS reason, CASE WHEN bad IS NULL THEN ctitle ELSE title END AS title,
  CASE WHEN verdict = 'kept' THEN nurl ELSE link END AS link"""


def affiliation_cte() -> str:
    rows = ", ".join(
        f"({q(s)}, [{', '.join(q(p) for p in path)}]::VARCHAR[])" for s, path in T.AFFILIATION_PATHS.items()
    )
    return f"aff(asource, path) AS (VALUES {rows})"


def affiliated(source: str = "items") -> str:
    return f"""{affiliation_cte()},
grouped AS (SELECT i.*, aff.path AS path, CASE WHEN len(aff.path) > 0 THEN aff.path[1] ELSE aff.asource END AS grp
  FROM {source} i LEFT JOIN aff ON i.source = aff.asource),
members AS (SELECT *, row_number() OVER (PARTITION BY grp, date, {title_key('title')} ORDER BY
    CASE WHEN len(path) > 0 THEN 0 ELSE 1 END, CASE WHEN department IN ('', source) THEN 1 ELSE 0 END,
    CASE WHEN link = '' THEN 1 ELSE 0 END, ord) AS rn, min(ord) OVER (PARTITION BY grp, date, {title_key('title')}) AS place
  FROM grouped WHERE grp IS NOT NULL AND date <> ''),
survivors AS (
  SELECT ord, source, date, department, title, link, category, summary, date_source FROM grouped WHERE grp IS NULL OR date = ''
  UNION ALL SELECT place + 1152921504606846976, source, date, department, title, link, category, summary, date_source
  FROM members WHERE rn = 1)"""


# --- relevance -----------------------------------------------------------------------


def hit(text: str, word: str) -> str:
    norm = R.squeezed(word)
    if len(norm) <= 4 and norm.isascii() and norm.isalnum():
        return f"regexp_matches({text}, '(^|[^a-z0-9]){norm}($|[^a-z0-9])')"
    return f"contains({text}, {q(norm)})"


def hits(text: str, words) -> str:
    if not words:
        return "[]::VARCHAR[]"
    cases = ", ".join(f"CASE WHEN {hit(text, w)} THEN {q(w)} END" for w in words)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def scoring(source: str, policy: Policy, key: str = "ord") -> str:
    """CTEs from ``source`` (with title, source, summary) to ``scored``."""
    topic_hits = ",\n".join(
        f"{hits('t', [p.name])} AS tn{i}, {hits('t', p.core)} AS tc{i}, {hits('t', p.supporting)} AS ts{i}, "
        f"{hits('s', [p.name])} AS sn{i}, {hits('s', p.core)} AS sc{i}, {hits('s', p.supporting)} AS ss{i}"
        for i, p in enumerate(policy.topics)
    )
    structs = []
    for i, p in enumerate(policy.topics):
        lead = f"source = {q(p.lead_source)}"
        n = lambda c: f"len({c}{i}) > 0"  # noqa: B023,E731
        rules = [
            (n("tn"), "100", R.TITLE_NAME[1]),
            (n("tc"), "85", R.TITLE_CORE[1]),
            (f"{n('ts')} AND len(tg) > 0", f"CASE WHEN {lead} THEN 80 ELSE 65 END", R.TITLE_PAIR[2]),
            (f"{n('ts')} AND len(tg) = 0 AND {lead}", "50", R.TITLE_LEAD[1]),
            (n("sn"), "70", R.SUMMARY_NAME[1]),
            (n("sc"), "60", R.SUMMARY_CORE[1]),
            (f"{n('ss')} AND len(sg) + len(tg) > 0", f"CASE WHEN {lead} THEN 55 ELSE 45 END", R.SUMMARY_PAIR[2]),
            (f"{n('ss')} AND len(sg) + len(tg) = 0 AND {lead}", "40", R.SUMMARY_LEAD[1]),
        ]
        best = "greatest(" + ", ".join(f"CASE WHEN {c} THEN {s} ELSE -1 END" for c, s, _ in rules) + ")"
        reasons = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(r)} END" for c, _, r in rules) + \
            f", CASE WHEN len(ex) > 0 THEN {q(R.PENALTY_REASON)} END], lambda x: x IS NOT NULL)"
        score = f"(CASE WHEN len(ex) > 0 THEN greatest({best} - {policy.penalty}, 0) ELSE {best} END)"
        words = f"flatten([tn{i}, tc{i}, ts{i}, tg, sn{i}, sc{i}, ss{i}, sg])"
        label = f"CASE WHEN {score} >= {policy.high} THEN '高度相關' WHEN {score} >= {policy.possible} THEN '可能相關' ELSE '未納入' END"
        structs.append(
            f"CASE WHEN {best} >= 0 THEN {{'name': {q(p.name)}, 'lead': {q(p.lead_source)}, 'score': {score}, "
            f"'relevance': {label}, 'words': {unique(words)}, 'reasons': {reasons}}} END"
        )
    manual = max(0, policy.possible - policy.penalty)
    from_topics = lambda field: unique(f"flatten(list_transform(c, lambda m: m.{field}))")
    named = unique("flatten(list_transform(c, lambda m: list_transform(m.reasons, lambda r: m.name || '：' || r)))")
    return f"""h AS MATERIALIZED (SELECT {key}, source, {hits('t', policy.general)} AS tg, {hits('s', policy.general)} AS sg,
  {hits('t', policy.negative)} AS ex, {topic_hits}
  FROM (SELECT {key}, source, {match_text('title')} AS t, {match_text('summary')} AS s FROM {source})),
c AS MATERIALIZED (SELECT {key}, tg, sg, ex, list_filter([{', '.join(structs)}], lambda x: x IS NOT NULL) AS c FROM h),
r AS (SELECT *, list_max(list_transform(c, lambda m: m.score)) AS best, {unique('list_concat(tg, sg)')} AS ctx FROM c),
scored AS MATERIALIZED (SELECT {key}, c,
  CASE WHEN len(c) > 0 THEN CASE WHEN best < {policy.possible} THEN '未納入' WHEN best >= 80 THEN '高度相關' ELSE '可能相關' END
       WHEN len(ctx) > 0 THEN CASE WHEN len(ex) = 0 THEN '可能相關' ELSE '未納入' END
       WHEN len(ex) > 0 THEN '未納入' ELSE '' END AS relevance,
  CAST(CASE WHEN len(c) > 0 THEN best WHEN len(ctx) > 0 THEN CASE WHEN len(ex) > 0 THEN {manual} ELSE {policy.possible} END ELSE 0 END AS INTEGER) AS score,
  CASE WHEN len(c) > 0 THEN list_transform(c, lambda m: m.name) WHEN len(ctx) > 0 THEN ['待人工判讀'] ELSE []::VARCHAR[] END AS topics,
  CASE WHEN len(c) > 0 THEN {unique('list_transform(c, lambda m: m.lead)')} ELSE []::VARCHAR[] END AS leads,
  CASE WHEN len(c) > 0 THEN {from_topics('words')} WHEN len(ctx) > 0 THEN ctx ELSE []::VARCHAR[] END AS words,
  ex AS exclusions,
  CASE WHEN len(c) > 0 THEN {named} WHEN len(ctx) > 0 THEN CASE WHEN len(ex) > 0 THEN [{q(R.MANUAL_REASON)}, {q(R.PENALTY_REASON)}]
    ELSE [{q(R.MANUAL_REASON)}] END ELSE []::VARCHAR[] END AS reasons,
  CASE WHEN len(c) > 0 THEN array_to_string(list_transform(c, lambda m: m.name || '（' || m.score || '分，' || m.relevance || '）'), '；')
    WHEN len(ctx) > 0 THEN '待人工判讀（' || CASE WHEN len(ex) > 0 THEN {manual} ELSE {policy.possible} END || '分，' ||
      CASE WHEN len(ex) = 0 THEN '可能相關' ELSE '未納入' END || '）' ELSE '' END AS topic_scores
  FROM r)"""


def policy_by_table() -> str:
    """``facts`` and ``matches`` of documents judged by a topic per document."""
    rules = [
        (0, 0, "TRUE", "100", R.TITLE_NAME[1]), (0, 1, "TRUE", "85", R.TITLE_CORE[1]),
        (0, 2, "ctx", "CASE WHEN own THEN 80 ELSE 65 END", R.TITLE_PAIR[2]), (0, 2, "own AND NOT ctx", "50", R.TITLE_LEAD[1]),
        (1, 0, "TRUE", "70", R.SUMMARY_NAME[1]), (1, 1, "TRUE", "60", R.SUMMARY_CORE[1]),
        (1, 2, "ctx", "CASE WHEN own THEN 55 ELSE 45 END", R.SUMMARY_PAIR[2]), (1, 2, "own AND NOT ctx", "40", R.SUMMARY_LEAD[1]),
    ]
    fires = [f"(f = {f} AND slot = {slot} AND {c})" for f, slot, c, _, _ in rules]
    best = "max(CASE " + " ".join(f"WHEN {c} THEN {r[3]}" for c, r in zip(fires, rules)) + " END)"
    reasons = ", ".join(f"CASE WHEN bool_or{c} THEN {q(r[4])} END" for c, r in zip(fires, rules))
    return f"""WITH tok AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS keyword FROM documents),
      topics AS (SELECT doc_id AS topic_no, source AS lead, source || '-' || doc_id AS name FROM documents),
      rules AS (SELECT topic_no, 0 AS slot, name AS keyword FROM topics UNION ALL
        SELECT min(doc_id), CASE WHEN length(keyword) > 10 THEN 1 ELSE 2 END, keyword FROM tok WHERE length(keyword) > 8 GROUP BY keyword),
      kw AS (SELECT keyword, {match_text('keyword')} AS norm FROM
        (SELECT keyword FROM rules UNION VALUES ('of the'), ('des'), ('hat'))),
      texts AS MATERIALIZED (SELECT doc_id AS ord, 0 AS f, {match_text(LINE)} AS t FROM documents
        UNION ALL SELECT doc_id, 1, {match_text('text')} FROM documents),
      places AS (SELECT ord, f, t, unnest(range(1, length(t) - 6)) AS i FROM texts),
      hit AS MATERIALIZED (SELECT DISTINCT ord, f, keyword FROM places JOIN kw ON length(norm) >= 8 AND substr(t, i, 8) = substr(norm, 1, 8)
          AND substr(t, i, length(norm)) = norm
        UNION ALL SELECT ord, f, keyword FROM texts JOIN kw ON length(norm) < 8 AND norm <> ''
          AND CASE WHEN length(norm) <= 4 AND regexp_matches(norm, '^[a-z0-9]+$')
          THEN list_contains(string_split_regex(t, '[^a-z0-9]+'), norm) ELSE contains(t, norm) END),
      facts AS MATERIALIZED (SELECT doc_id AS ord, source, coalesce(tg, FALSE) AS tg, coalesce(sg, FALSE) AS sg, coalesce(ex, FALSE) AS ex,
          coalesce(globals, 0) AS globals
        FROM documents LEFT JOIN (SELECT ord, bool_or(f = 0 AND keyword <> 'hat') AS tg, bool_or(f = 1 AND keyword <> 'hat') AS sg,
          bool_or(f = 0 AND keyword = 'hat') AS ex, count(DISTINCT keyword) FILTER (keyword <> 'hat') AS globals
          FROM hit WHERE keyword IN ('of the', 'des', 'hat') GROUP BY 1) m ON m.ord = doc_id),
      j AS (SELECT hit.ord, topic_no, f, slot, keyword, name, coalesce(source = lead, FALSE) AS own, tg OR (f = 1 AND sg) AS ctx, ex, globals
        FROM hit JOIN rules USING (keyword) JOIN topics USING (topic_no) JOIN facts ON facts.ord = hit.ord),
      judged AS (SELECT ord, topic_no, name, ex, {best} AS best, count(DISTINCT keyword) + globals AS keyword_count,
          concat_ws('；', {reasons}, CASE WHEN ex THEN {q(R.PENALTY_REASON)} END) AS reasons
        FROM j GROUP BY ord, topic_no, name, ex, globals),
      matches AS MATERIALIZED (SELECT *, CASE WHEN score >= 80 THEN '高度相關' WHEN score >= 40 THEN '可能相關' ELSE '未納入' END AS relevance
        FROM (SELECT * EXCLUDE (best), CAST(CASE WHEN ex THEN greatest(best - 50, 0) ELSE best END AS INTEGER) AS score
          FROM judged WHERE best IS NOT NULL)) """


def js(c: str, sep: str = "、") -> str:
    return f"coalesce(array_to_string({c}, '{sep}'), '')"


def path_cte(source: str) -> str:
    """``pathed``: agency and department path of rows with source and department."""
    steps = "list_filter(list_transform(flatten(list_transform(string_split(department, '／'), lambda a: string_split(a, ' / '))), lambda b: trim(b)), lambda b: b <> '')"
    return f"""based AS (SELECT i.*, CASE WHEN len(aff.path) > 0 THEN aff.path ELSE [i.source] END AS base,
  coalesce(CASE WHEN len(aff.path) > 0 THEN aff.path[1] ELSE aff.asource END, '') AS grp, {steps} AS steps
  FROM {source} i LEFT JOIN aff ON i.source = aff.asource),
walked AS (SELECT *, list_concat(base, steps) AS w0 FROM based),
pathed AS (SELECT *, base[1] AS agency, array_to_string(list_filter(w0, lambda x, i: i > 1 AND list_position(w0, x) = i), ' / ') AS department_path FROM walked)"""


def digest(source: str, title: str = "title", link: str = "link") -> str:
    return f"""{affiliation_cte()},
{path_cte(source)},
{scoring(source, T.TEST_POLICY)},
digest AS (SELECT p.ord, p.agency, p.date, p.department_path, p.title,
  CASE WHEN p.link LIKE 'http://%' OR p.link LIKE 'https://%' THEN p.source || '官網：' || p.link ELSE p.link END AS link_text,
  p.summary, p.date_source, {js('s.topics')} AS topics, {js('s.leads')} AS priority_sources, s.relevance, s.score,
  {js('s.reasons', '；')} AS reasons, {js('s.words')} AS keywords, {js('s.exclusions')} AS exclusions, s.topic_scores
  FROM pathed p JOIN scored s ON p.ord = s.ord)"""


SRC_ORDER = (
    "(SELECT 'src' || s_suppkey AS name, CAST(1000000000 - s_suppkey AS INTEGER) AS src_order FROM supplier)"
)
KEPT_WEEK = """kitems AS MATERIALIZED (SELECT ord, source, date, department, ctitle AS title, nurl AS link, category, summary, date_source
  FROM done WHERE verdict = 'kept')"""


# --- attempts ------------------------------------------------------------------------

_CLASSES = list(FAILURE_CLASSES)
K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def attempts(dead: bool = False) -> str:
    names = "[" + ", ".join(q(c) for c in _CLASSES) + "]"
    cats = " ".join(f"WHEN {q(n)} THEN {q(r[0])}" for n, r in FAILURE_CLASSES.items())
    is_dead = "regexp_matches('u' || user_id, '[147]$')" if dead else "FALSE"
    return f"""att AS (SELECT *, CASE failure_class {cats} ELSE '' END AS error_category FROM (
  SELECT 'u' || user_id AS source, event_id AS attempt_no, 'r' || event_id AS route_id, 'https://u' || user_id || '.test/' || event_type AS url,
    'u' || user_id || '.test' AS url_host, {K} % 3 + 1 AS priority, {K} % 5 = 0 AS reduced, user_id % 4 = 0 AS together,
    (event_type = 'error' OR {is_dead}) AS failed, value,
    CASE WHEN event_type = 'error' THEN {names}[{K} % {len(_CLASSES)} + 1] WHEN {is_dead} THEN 'unknown' ELSE '' END AS failure_class,
    CASE WHEN event_type = 'error' THEN 'k=' || {K} ELSE '' END AS message FROM events)),
made AS (SELECT * FROM (SELECT *, min(CASE WHEN NOT failed THEN attempt_no END) OVER (PARTITION BY source) AS firstok FROM att)
  WHERE together OR firstok IS NULL OR attempt_no <= firstok),
res AS (SELECT source, count(*) AS attempt_count, count(*) FILTER (failed) AS failed_attempts, count(*) FILTER (NOT failed) AS oks,
  round(sum(value), 3) AS elapsed_seconds, bool_or(together) AS together,
  coalesce(arg_max(failure_class, attempt_no) FILTER (failed), '') AS last_failure_class,
  coalesce(arg_max(error_category, attempt_no) FILTER (failed), '') AS last_category,
  coalesce(arg_max(url_host, attempt_no) FILTER (failed), '') AS evidence_host,
  coalesce(arg_max(message, attempt_no) FILTER (failed), '') AS evidence_message,
  CASE WHEN bool_or(together) THEN max(attempt_no) FILTER (NOT failed) ELSE min(attempt_no) FILTER (NOT failed) END AS final_no
  FROM made GROUP BY source),
results AS (SELECT res.*, CASE WHEN oks > 0 THEN 'success' ELSE 'failed' END AS status, oks > 0 AND failed_attempts > 0 AS unstable,
  CASE WHEN oks > 0 THEN '' ELSE last_failure_class END AS failure_class, CASE WHEN oks > 0 THEN '' ELSE last_category END AS error_category,
  coalesce(f.route_id, '') AS final_route_id, coalesce(f.url, '') AS final_url,
  coalesce(NOT res.together AND f.priority > 1, FALSE) AS used_fallback, coalesce(f.reduced, FALSE) AS coverage_reduced
  FROM res LEFT JOIN att f ON f.attempt_no = res.final_no)"""


# --- captures ------------------------------------------------------------------------

PAGE = f"CAST(floor(doc_id / {T.PER_PAGE}) AS BIGINT)"


def layout_items(layout: str) -> str:
    publisher = T.PAGE_TEMPLATES[layout][0]
    d, i = day("doc_id"), "doc_id"
    site = "'https://news.example"
    link = {
        "feed": f"{site}/a?id=' || {i} || '&x=1'",
        "row_text": f"{site}/dir/n/' || {i} || '?s=1'",
        "roc_prefixed": f"{site}/dir/theme_data.php?theme=NewInfoListWS&id=' || {i}",
        "in_text": f"'{T.PAGE_URL}' || {PAGE}",
        "year_day": f"{site}/Bulletin/Detail/' || {i}",
        "three_part": f"{site}/dir/n.aspx?news_id=' || {i}",
        "cms_json": f"'https://www.nps.gov.tw/ch/titlelist/parknews/' || {i}",
        "open_data": f"'https://www.thb.gov.tw/n?s=' || {i}",
    }.get(layout, f"{site}/n/' || {i}")
    labelled = {"dated", "tooltip", "labelled", "three_part", "cms_json", "open_data"}
    department = (
        "lang" if layout == "feed" else "''" if layout == "links"
        else f"'{publisher}／' || lang" if layout in labelled else q(publisher)
    )
    date = (
        f"strftime({d}, '%a, %d %b %Y') || ' 01:30:00 GMT'" if layout == "feed"
        else "''" if layout == "links" else f"CAST({d} AS VARCHAR)"
    )
    summary = (
        f"trim(substr({clean('text')}, 1, 4000))" if layout == "feed" else clean("text") if layout == "open_data" else "''"
    )
    return f"""SELECT 'p' || {PAGE} AS route_id, CAST({i} % {T.PER_PAGE} AS INTEGER) AS pos, {date} AS date, {department} AS department,
  {clean('text')} AS title, {link} AS link, '' AS category, {summary} AS summary, 'published' AS date_source
FROM documents"""


def weekly() -> str:
    """CTEs of a run: pages with their outcome, the routes that win, the items of the week."""
    return f"""pages AS (
  SELECT page, page % {T.WEEK_SOURCES} AS k, page % 17 <> 0 AND page % 13 <> 0 AS ok, n,
    row_number() OVER (PARTITION BY page % {T.WEEK_SOURCES} ORDER BY page) AS attempt_no,
    CASE WHEN page % 17 = 0 THEN 'runner_network'
      WHEN page % 13 = 0 THEN ['access_blocked', 'parser_regression', 'source_outage'][page % 3 + 1] ELSE '' END AS failure_class
  FROM (SELECT {PAGE} AS page, count(*) AS n FROM documents GROUP BY 1)),
firsts AS (SELECT k, min(attempt_no) FILTER (ok) AS first_ok, max(attempt_no) FILTER (ok) AS last_ok FROM pages GROUP BY k),
made AS (SELECT p.*, f.first_ok, f.last_ok FROM pages p JOIN firsts f USING (k)
  WHERE k % 2 = 0 OR first_ok IS NULL OR attempt_no <= first_ok),
witems AS (
  SELECT row_number() OVER (ORDER BY k, m.attempt_no, doc_id) AS ord, 'src' || k AS source, CAST({day('doc_id')} AS VARCHAR) AS date,
    lang AS department, {clean('text')} AS title, 'https://news.example/a?id=' || doc_id || '&x=1' AS link, '' AS category,
    trim(substr({clean('text')}, 1, 4000)) AS summary, 'published' AS date_source
  FROM documents d JOIN made m ON m.page = {PAGE} AND m.ok
  WHERE {day('doc_id')} BETWEEN DATE '{T.WEEK.start}' AND DATE '{T.WEEK.end}')"""


def capture_attempts() -> str:
    layouts = list(T.PAGE_TEMPLATES)
    pick = lambda n: "[" + ", ".join(q(T.PAGE_TEMPLATES[x][n]) for x in layouts) + f"][page % {len(layouts)} + 1]"
    cats = " ".join(f"WHEN {q(n)} THEN {q(r[0])}" for n, r in FAILURE_CLASSES.items())
    return f"""SELECT source, route_id, url_host, route_kind, parser, CASE WHEN failure_class = '' THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN failure_class = '' THEN n ELSE 0 END AS item_count, failure_class, CASE failure_class {cats} ELSE '' END AS error_category,
  CASE WHEN failure_class = '' AND source = {q(T.PAGE_TEMPLATES['links'][0])} THEN n ELSE 0 END AS undated_dropped
FROM (SELECT {pick(0)} AS source, 'p' || page AS route_id, 'news.example' AS url_host, {pick(1)} AS route_kind, {pick(2)} AS parser, n,
    CASE WHEN {pick(1)} = 'browser' THEN CASE WHEN page % 17 = 0 THEN 'browser_runtime' ELSE '' END
         WHEN page % 17 = 0 THEN 'runner_network'
         WHEN page % 13 = 0 THEN ['access_blocked', 'parser_regression', 'source_outage'][page % 3 + 1] ELSE '' END AS failure_class
  FROM (SELECT {PAGE} AS page, count(*) AS n FROM documents GROUP BY 1))"""


def paragraphs() -> str:
    """Summary of the driver's pages from their raw text."""
    inner = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
    pieces = f"list_filter(string_split({inner}, '<p>'), lambda x, i: i > 1)"
    text = "regexp_replace(regexp_replace(split_part(x, '</p>', 1), '<[^>]*>', ' ', 'g'), '&amp;?', '&', 'g')"
    plain = clean(f"replace({text}, '&quot;', '\"')")
    joined = f"array_to_string(list_filter(list_transform({pieces}, lambda x: {plain}), lambda x: x <> ''), ' ')"
    return f"trim(substr({joined}, 1, 1200))"


DEPARTMENT_RAW = """CASE doc_id % 7 WHEN 0 THEN lang WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN source || ' ／ ' || lang
  WHEN 4 THEN 'Dept ' || source WHEN 5 THEN source ELSE lang || ' office of ' || source END"""


def oracle_queries() -> dict[str, str]:
    out: dict[str, str] = {}
    d = "CAST(o_orderdate AS DATE)"
    out["date_formats"] = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL
      WHEN o_orderkey % 7 = 2 AND year({d}) < 2000 THEN NULL ELSE CAST({d} AS VARCHAR) END AS parsed, CAST({d} AS VARCHAR) AS listed,
      '民國' || (year({d}) - 1911) || '/' || month({d}) || '/' || day({d}) AS roc_date,
      lpad(CAST(year({d}) - 1911 AS VARCHAR), 3, '0') || strftime({d}, '%m%d') AS roc_compact FROM orders"""
    out["text_keys"] = f"SELECT doc_id, {clean('text')} AS clean, {title_key('text')} AS key, {match_text('text')} AS matching FROM documents"
    out["text_limits"] = f"""SELECT doc_id, substr(text, 1, 32767) AS cell, CASE WHEN doc_id % 3 = 0 THEN 'cjk' ELSE 'latin' END AS text_class,
      substr({clean('text')}, 1, 200) AS summary FROM documents"""
    out["department_names"] = f"""SELECT doc_id, d AS department, (d = source OR (ends_with(d, source) AND length(d) <= length(source) + 6)) AS is_alias
      FROM (SELECT doc_id, source, {DEPARTMENT_RAW} AS d FROM documents)"""
    out["labelled_values"] = f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS unit,
      CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST({day('doc_id')} AS VARCHAR) END AS published FROM documents"""
    noisy = "replace(split_part(url, '#', 1), '.example.', '.EXAMPLE.') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'GCLID=1&b=c+d&e'"
    out["url_normalize"] = f"""SELECT page_id, {norm_url('url')} AS norm, {norm_url('n')} AS noisy_norm,
      lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM (SELECT *, {noisy} AS n FROM pages)"""
    out["link_labels"] = f"""WITH {ITEMS} SELECT ord, CASE WHEN link LIKE 'http%' THEN source || '官網：' || link ELSE link END AS link_text,
      CASE WHEN link LIKE 'http%' THEN link END AS link_url FROM items"""
    cats = " ".join(f"WHEN {q(n)} THEN {q(r[0])}" for n, r in FAILURE_CLASSES.items())
    again = ", ".join(q(n) for n, r in FAILURE_CLASSES.items() if r[1])
    out["http_outcomes"] = f"""SELECT event_id, failure_class, CASE failure_class {cats} ELSE '' END AS error_category,
      failure_class IN ({again}) AS retryable FROM (SELECT event_id, CASE
        WHEN event_type = 'view' THEN CASE WHEN k % 10 >= 4 OR k % 7 = 0 THEN 'browser_runtime' ELSE '' END
        WHEN k % 10 IN (4, 5) THEN 'runner_network' WHEN k % 10 IN (6, 7) THEN 'source_outage' WHEN k % 10 = 8 THEN 'tls_certificate'
        WHEN k % 10 = 9 THEN 'unknown' ELSE ['', '', 'parser_regression', 'access_blocked', 'access_blocked', 'parser_regression',
          'source_outage', 'source_outage', 'source_outage'][k % 9 + 1] END AS failure_class
      FROM (SELECT *, {K} AS k FROM events))"""
    out["weekly_counts"] = f"""WITH {ITEMS} SELECT CAST(CAST(date_trunc('week', CAST(date AS DATE)) AS DATE) AS VARCHAR) AS week_start, source,
      count(*) AS item_count FROM items GROUP BY 1, 2"""

    out["week_filter"] = f"WITH {ITEMS}, {WEEK_ITEMS} SELECT ord, source, date, title FROM witems"
    # Only form 0 of the raw dates is plain year-month-day.
    out["validate_items"] = f"""WITH {ITEMS}, {judged('items', date_ok='(ord % 7 = 0)')}
      SELECT ord, coalesce(verdict0, '') AS verdict, coalesce(reason0, '') AS reason,
      CASE WHEN bad IS NULL THEN ctitle ELSE title END AS title FROM judged"""
    out["exact_dedupe"] = f"""WITH {ITEMS}, l AS (SELECT * REPLACE ('https://x.test/' || department AS link) FROM items)
      SELECT ord, source, date, title, link FROM (SELECT *, row_number() OVER (PARTITION BY source, date, title, link ORDER BY ord) AS rn FROM l) WHERE rn = 1"""
    base = f"WITH RECURSIVE {ITEMS}, {greedy('items')} "
    out["greedy_dedupe"] = base + f"SELECT {DONE_COLUMNS} FROM done"
    out["quality_issues"] = base + f"""SELECT d.ord, d.verdict AS issue, d.reason, i.source, i.date, i.department, d.title, i.link, i.category,
      i.summary, i.date_source FROM (SELECT {DONE_COLUMNS} FROM done) d JOIN items i ON i.ord = d.ord WHERE verdict <> 'kept'"""
    out["affiliated_dedupe"] = f"WITH {ITEMS}, {affiliated()} SELECT ord, source, date, title, link FROM survivors"
    out["affiliated_then_greedy"] = f"""WITH RECURSIVE {ITEMS}, {affiliated()}, {greedy('survivors')}
      SELECT source, verdict, count(*) AS item_count FROM done GROUP BY 1, 2"""
    out["agency_path"] = f"""WITH {ITEMS}, {affiliation_cte()},
      j AS (SELECT * REPLACE (source || '／' || department || ' / ' || date_source || '／ ' AS department) FROM items), {path_cte('j')}
      SELECT ord, agency AS parent, department_path, grp FROM pathed"""

    words = ["AI", "of", "the", "Ingre", "nt er", "ü", "çon", "des", "GPU", "que los"]
    out["keyword_hits"] = f"""SELECT doc_id, coalesce(array_to_string({hits('t', words)}, '|'), '') AS hits
      FROM (SELECT doc_id, {match_text('text')} AS t FROM documents)"""
    out["keyword_hits_table"] = f"""WITH kw AS (SELECT keyword, {match_text('keyword')} AS norm
        FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS keyword FROM documents) WHERE length(keyword) > 7),
      texts AS (SELECT doc_id AS id, {match_text('text')} AS t FROM documents),
      -- Texts meet keywords by their first 8 characters; the few that are shorter without white space one by one.
      places AS (SELECT id, t, unnest(range(1, length(t) - 6)) AS i FROM texts)
      SELECT DISTINCT id, keyword FROM places JOIN kw ON length(norm) >= 8 AND substr(t, i, 8) = substr(norm, 1, 8)
        AND substr(t, i, length(norm)) = norm
      UNION ALL SELECT id, keyword FROM texts JOIN kw ON length(norm) < 8 AND norm <> ''
        AND CASE WHEN length(norm) <= 4 AND regexp_matches(norm, '^[a-z0-9]+$')
        THEN list_contains(string_split_regex(t, '[^a-z0-9]+'), norm) ELSE contains(t, norm) END"""
    by_table = policy_by_table()
    out["policy_table_matches"] = by_table + "SELECT ord, topic_no, name, relevance, score, keyword_count, reasons FROM matches"
    out["policy_table_scores"] = by_table + f"""SELECT ord,
        CASE WHEN best < 40 THEN '未納入' WHEN best >= 80 THEN '高度相關' WHEN best IS NOT NULL THEN '可能相關'
          WHEN globals > 0 THEN CASE WHEN ex THEN '未納入' ELSE '可能相關' END WHEN ex THEN '未納入' ELSE '' END AS relevance,
        CAST(CASE WHEN best IS NOT NULL THEN best WHEN globals > 0 AND NOT ex THEN 40 ELSE 0 END AS INTEGER) AS score,
        coalesce(n, 0) AS topic_count,
        CASE WHEN best IS NOT NULL THEN top WHEN globals > 0 THEN {q(R.MANUAL_TOPIC)} ELSE '' END AS best_topic
      FROM facts LEFT JOIN (SELECT ord, max(score) AS best, count(*) AS n, first(name ORDER BY score DESC, topic_no) AS top
        FROM matches GROUP BY 1) USING (ord)"""
    score = f"WITH {ITEMS}, {scoring('items', T.TEST_POLICY)} "
    out["relevance_score"] = score + f"""SELECT ord, relevance, score, {js('topics')} AS topics, {js('leads')} AS priority_sources,
      {js('words')} AS matched_keywords, {js('exclusions')} AS excluded_keywords, {js('reasons', '；')} AS reasons FROM scored"""
    out["conversation_relevance"] = f"""WITH turns AS (SELECT conv_id, turn, role AS source, {LINE} AS title, text AS summary FROM conversations),
      {scoring('turns', T.TEST_POLICY, key='conv_id, turn')} SELECT conv_id, turn, relevance, score FROM scored"""
    out["relevance_topics"] = score + f"""SELECT ord, m.name AS topic, m.relevance AS relevance, m.score AS score,
      {js('m.reasons', '；')} AS reasons, {js('m.words')} AS keywords FROM (SELECT ord, unnest(c) AS m FROM scored)
      UNION ALL SELECT ord, '待人工判讀', relevance, score, {js('reasons', '；')}, {js('words')} FROM scored WHERE len(c) = 0 AND len(topics) > 0"""
    rows = f"WITH {ITEMS}, {digest('items')} "
    out["digest_rows"] = rows + "SELECT * FROM digest"
    out["digest_order"] = rows + f"""SELECT ord, agency, coalesce(src_order, 2147483647) AS src_order, date, department_path, title
      FROM digest LEFT JOIN {SRC_ORDER} c ON c.name = agency"""
    out["selected_digest"] = f"""WITH RECURSIVE {ITEMS}, {WEEK_ITEMS}, {greedy('witems')}, {KEPT_WEEK}, {digest('kitems')}
      SELECT * FROM digest WHERE relevance IN ('高度相關', '可能相關')"""
    run = f"WITH RECURSIVE {weekly()}"
    out["weekly_run"] = f"""{run}, {affiliated('witems')}, {greedy('survivors')}, {KEPT_WEEK},
      {digest('kitems').replace(affiliation_cte() + ',', '', 1)}
      SELECT {', '.join(DIGEST_COLUMNS)} FROM digest"""
    cats = " ".join(f"WHEN {q(n)} THEN {q(r[0])}" for n, r in FAILURE_CLASSES.items())
    out["weekly_attempts"] = f"""{run} SELECT 'src' || k AS source, CAST(attempt_no AS INTEGER) AS attempt_no, 'p' || page AS route_id,
      CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, CASE WHEN ok THEN n ELSE 0 END AS item_count, failure_class,
      CASE failure_class {cats} ELSE '' END AS error_category FROM made"""
    out["weekly_diagnostics"] = f"""{run}, tried AS (
        SELECT k, bool_or(ok) AS won, count(*) AS attempt_count, count(*) FILTER (NOT ok) AS failed_attempts,
          max(page) FILTER (ok AND attempt_no = CASE WHEN k % 2 = 0 THEN last_ok ELSE first_ok END) AS final_page,
          coalesce(string_agg(failure_class, ',' ORDER BY attempt_no) FILTER (NOT ok), '') AS route_failure_classes
        FROM made GROUP BY k),
      counted AS (SELECT source, count(*) AS n FROM witems GROUP BY 1)
      SELECT 'src' || k AS source, CASE WHEN won THEN 'success' ELSE 'failed' END AS status, won AND failed_attempts > 0 AS unstable,
        attempt_count, failed_attempts, coalesce('p' || final_page, '') AS final_route_id, coalesce(c.n, 0) AS item_count,
        route_failure_classes FROM tried LEFT JOIN counted c ON c.source = 'src' || k"""
    out["weekly_status"] = """WITH r AS (SELECT user_id % 50 AS run, count(*) FILTER (event_type = 'error' AND user_id < 100) AS failed,
        count(*) FILTER (event_type = 'click') AS dup, count(*) AS n FROM events GROUP BY 1),
      a AS (SELECT *, CASE WHEN dup >= 5 AND dup / n >= 0.2 THEN 'duplicate_spike' ELSE '' END AS alerts FROM r)
      SELECT run, CASE WHEN failed > 0 THEN 'partial_failure' WHEN alerts <> '' THEN 'attention' ELSE 'success' END AS status, alerts FROM a"""
    tie = "src_order, date, department_path, title, ord"
    sheet = " ".join(f"WHEN {q(a)} THEN {q(s)}" for a, s in T.AGENCY_SHEETS.items())
    placed = f"placed AS (SELECT digest.*, coalesce(src_order, 2147483647) AS src_order FROM digest LEFT JOIN {SRC_ORDER} c ON c.name = agency)"
    shown = f"""agency, date, substr(title, 1, 32767) AS title, score, CASE relevance WHEN '高度相關' THEN 'high' WHEN '可能相關' THEN 'possible' ELSE 'base' END AS row_style,
      topics <> '' AS topic_highlight, CASE WHEN regexp_matches(title, '[一-鿿]') THEN 'cjk' ELSE 'latin' END AS title_class,
      CASE WHEN contains(link_text, 'https://') THEN substr(link_text, strpos(link_text, 'https://')) ELSE '' END AS link_url"""
    out["digest_sheets"] = rows + f""", {placed}
      SELECT '全部新聞' AS sheet, row_number() OVER (ORDER BY {tie}) AS row_no, {shown} FROM placed
      UNION ALL SELECT '已初步篩選工作表', row_number() OVER (ORDER BY CASE relevance WHEN '高度相關' THEN 0 ELSE 1 END, score DESC, topics, {tie}), {shown}
        FROM placed WHERE relevance IN ('高度相關', '可能相關')
      UNION ALL SELECT CASE agency {sheet} END, row_number() OVER (PARTITION BY agency ORDER BY {tie}), {shown}
        FROM placed WHERE agency IN ({', '.join(q(a) for a in T.AGENCY_SHEETS)})"""
    cells = ", ".join(f"substr({c}, 1, 32767) AS {c}" if c != "score" else c for c in DIGEST_COLUMNS)
    out["digest_table"] = rows + f""", {placed}, numbered AS (
      SELECT '全部新聞' AS sheet, row_number() OVER (ORDER BY {tie}) AS row_no, * FROM placed
      UNION ALL SELECT '已初步篩選工作表', row_number() OVER (ORDER BY CASE relevance WHEN '高度相關' THEN 0 ELSE 1 END, score DESC, topics, {tie}), *
        FROM placed WHERE relevance IN ('高度相關', '可能相關')
      UNION ALL SELECT CASE agency {sheet} END, row_number() OVER (PARTITION BY agency ORDER BY {tie}), *
        FROM placed WHERE agency IN ({', '.join(q(a) for a in T.AGENCY_SHEETS)}))
      SELECT CAST(CAST(date_trunc('week', CAST(date AS DATE)) AS DATE) AS VARCHAR) AS week_start, sheet, row_no, {cells} FROM numbered"""
    out["date_choices"] = f"""WITH {ITEMS} SELECT date, count(*) AS row_count, '民國' || (year(CAST(date AS DATE)) - 1911) || '/' ||
      month(CAST(date AS DATE)) || '/' || day(CAST(date AS DATE)) AS roc_date FROM items GROUP BY date"""

    tokens = f"list_filter(string_split(text, ' '), lambda w: w <> '')"
    topics = f"""topics AS (SELECT doc_id AS topic_no, source || '-' || doc_id AS topic, source AS lead_source,
      list_filter(w, lambda x: length(x) > 6) AS core, list_filter(w, lambda x: length(x) <= 6) AS supporting
      FROM (SELECT *, {unique(tokens)} AS w FROM documents))"""
    ident = lambda kind, *parts: (
        f"'default:{kind}:' || substr(sha256('{kind}' || " + " || ".join(f"'|' || {match_text(p)}" for p in parts) + "), 1, 16)"
    )

    def rules(kind: str, label: str, number: int, column: str) -> str:
        return f"""SELECT 1 AS rule_group, topic_no, {number} AS kind_no, CAST(i - 1 AS INTEGER) AS pos, topic, '{label}' AS rule_type,
          {column}[i] AS keyword, '標題與摘要' AS match_fields, '是' AS enabled, 'default' AS origin,
          {ident(kind, 'topic', f'{column}[i]')} AS rule_id FROM (SELECT *, unnest(range(1, len({column}) + 1)) AS i FROM topics)"""

    def globals_(kind: str, label: str, group: int, fields: str, listed: list[str]) -> str:
        return " UNION ALL ".join(
            f"SELECT {group}, 0, 0, {n}, '全域', '{label}', {q(w)}, '{fields}', '是', 'default', {ident(kind, q(w))}"
            for n, w in enumerate(listed)
        )

    out["policy_rules"] = f"""WITH {topics} {rules('core', '核心詞', 0, 'core')} UNION ALL {rules('supporting', '輔助詞', 1, 'supporting')}
      UNION ALL {globals_('global-context', '脈絡詞', 0, '標題與摘要', ['AI', 'of the'])}
      UNION ALL {globals_('exclusion', '排除詞', 2, '標題', ['hat'])}"""
    out["policy_reference"] = f"""WITH {topics} SELECT topic_no, topic, '是' AS enabled, lead_source, '是' AS match_name, '#FFFF00' AS colour,
      {js('core')} AS core_words, {js('supporting')} AS supporting_words, '' AS topic_context_words, 'AI、of the' AS global_words,
      '' AS topic_excluded_words, 'hat' AS excluded_words FROM topics"""

    out["source_counts_zero_filled"] = base + """SELECT coalesce(s.source, n.source) AS source, coalesce(c, 0) AS item_count
      FROM (SELECT 'src' || s_suppkey AS source FROM supplier) s
      FULL JOIN (SELECT source, count(*) AS c FROM done WHERE verdict = 'kept' GROUP BY 1) n ON n.source = s.source"""
    out["date_source_counts"] = f"WITH {ITEMS} SELECT date_source, count(*) AS item_count FROM items GROUP BY 1"
    out["quality_counters"] = base + """SELECT count(*) AS input_count, count(*) FILTER (verdict = 'kept') AS output_count,
      count(*) FILTER (verdict = 'duplicate') AS duplicate_count, count(*) FILTER (verdict = 'invalid_item') AS invalid_count,
      count(*) FILTER (verdict = 'excluded_non_news') AS excluded_non_news_count,
      count(*) FILTER (verdict = 'kept' AND summary <> '') AS summary_count,
      round(count(*) FILTER (verdict = 'kept' AND summary <> '') / count(*) FILTER (verdict = 'kept'), 4) AS summary_coverage_rate FROM done"""
    out["alerts_status"] = base + """SELECT source, alerts, CASE WHEN alerts <> '' THEN 'attention' ELSE 'success' END AS status FROM (
      SELECT source, concat_ws(',', CASE WHEN inv >= 1 THEN 'invalid_items' END, CASE WHEN dup >= 5 AND dup / n >= 0.2 THEN 'duplicate_spike' END,
        CASE WHEN exc >= 3 AND exc / n >= 0.25 THEN 'non_news_spike' END) AS alerts
      FROM (SELECT source, count(*) AS n, count(*) FILTER (verdict = 'duplicate') AS dup, count(*) FILTER (verdict = 'invalid_item') AS inv,
        count(*) FILTER (verdict = 'excluded_non_news') AS exc FROM done GROUP BY 1))"""

    health = f"WITH {attempts()} "
    out["route_fallback"] = health + """SELECT source, status, final_route_id, final_url, used_fallback, coverage_reduced, failure_class,
      error_category FROM results"""
    out["source_diagnostics"] = health + """SELECT source, status, unstable, attempt_count, failed_attempts, elapsed_seconds, last_failure_class,
      evidence_host, evidence_message FROM results"""
    out["failure_trail"] = health + "SELECT source, attempt_no, failure_class FROM made WHERE failed"
    out["winning_routes"] = health + """SELECT source, route_id FROM made WHERE together AND NOT failed
      UNION ALL SELECT source, final_route_id FROM results WHERE NOT together AND status = 'success'"""
    out["failure_counts"] = f"WITH {attempts(dead=True)} SELECT failure_class, count(*) AS source_count FROM results WHERE status = 'failed' GROUP BY 1"
    out["error_category_counts"] = health + "SELECT error_category, count(*) AS attempt_count FROM att WHERE error_category <> '' GROUP BY 1"
    out["health_rollup"] = health + """SELECT count(*) FILTER (status = 'success' AND NOT unstable) AS healthy_count,
      count(*) FILTER (unstable) AS unstable_count, count(*) FILTER (status = 'failed') AS failed_count,
      count(*) FILTER (used_fallback) AS fallback_source_count, count(*) FILTER (coverage_reduced) AS coverage_reduced_count,
      CAST(0 AS BIGINT) AS ssl_fallback_host_count FROM results"""
    out["unknown_sources"] = health + """SELECT source, status, failure_class, error_category, attempt_count FROM results
      UNION ALL SELECT source, 'failed', CASE WHEN known THEN 'source_outage' ELSE 'unknown' END,
        CASE WHEN known THEN 'connection' ELSE 'unexpected' END, 0
      FROM (SELECT 'u' || s_suppkey AS source, (1000000000 - s_suppkey) % 2 = 0 AS known FROM supplier) WHERE source NOT IN (SELECT source FROM results)"""

    out["catalog_routes"] = """WITH s AS (SELECT s_suppkey AS k, CAST(1000000000 - s_suppkey AS INTEGER) AS src_order, 'src' || s_suppkey AS source,
        s_suppkey % 4 = 0 AS aggregate_routes, 'https://Pub' || s_suppkey || '.test/' AS base, 'pub' || s_suppkey || '.test' AS url_host FROM supplier),
      r AS (SELECT * FROM (VALUES (1, 'early', 'early', 'html', 1, FALSE), (2, 'late', 'late', 'browser', 2, TRUE), (3, 'later', 'later', 'html', 2, FALSE))
        v(attempt_no, route_id, p, kind, priority, coverage_reduced)),
      u AS (SELECT * FROM (VALUES (1, 'primary', 'RSS', 'rss', 1, FALSE), (2, 'alternate-1', 'b.XML', 'rss', 2, FALSE)) v(attempt_no, route_id, p, kind, priority, coverage_reduced))
      SELECT src_order, source, aggregate_routes, attempt_no, route_id, base || p AS url, url_host, kind, 'standard' AS parser, priority, coverage_reduced
        FROM s, r WHERE k % 5 = 0
      UNION ALL SELECT src_order, source, aggregate_routes, attempt_no, route_id, base || p, url_host, kind, 'standard', priority, coverage_reduced
        FROM s, u WHERE k % 5 <> 0 AND k % 3 = 0
      UNION ALL SELECT src_order, source, aggregate_routes, 1, 'primary', base || 'list', url_host, 'html', 'standard', 1, FALSE
        FROM s WHERE k % 5 <> 0 AND k % 3 <> 0"""
    out["source_selection"] = """SELECT pos, source, 'src' IN (substr(source, 1, 3)) AND source IN (SELECT 'src' || s_suppkey FROM supplier) AS known
      FROM (VALUES (0, 'src3'), (1, 'nobody'), (2, 'src1'), (3, 'src7')) v(pos, source)"""
    out["worklist_places"] = """SELECT row_number() OVER (ORDER BY priority DESC, source) AS place, source, priority
      FROM (SELECT 'c' || c_custkey AS source, c_custkey % 10 AS priority FROM customer)"""
    out["numbered_items"] = f"""SELECT row_number() OVER (ORDER BY CAST(route_id[2:] AS BIGINT), pos) - 1 AS ord, route_id, title, link
      FROM ({layout_items('feed')})"""
    out["latest_captures"] = """SELECT 'p' || page_id AS route_id, CAST(200 + n AS INTEGER) AS status_code, md5(html) AS body_md5
      FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seen DESC, n DESC) AS place
        FROM (SELECT page_id, html, n, page_id * (31 * n + 93) % 101 AS seen FROM pages, range(3) AS r(n))) WHERE place = 1"""
    out["archived_captures"] = """SELECT 'p' || page_id AS route_id, CAST(200 + n AS INTEGER) AS status_code, md5(html) AS body_md5
      FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seen DESC, n DESC) AS place
        FROM (SELECT page_id, html, n, page_id * (31 * n + 93) % 101 AS seen FROM pages, range(3) AS r(n)) WHERE seen BETWEEN 20 AND 70) WHERE place = 1"""
    out["source_list"] = "SELECT 'src' || s_suppkey AS name FROM supplier"
    out["capture_gaps"] = """WITH routes AS (
        SELECT 'src' || s_suppkey AS source, unnest(CASE WHEN s_suppkey % 5 = 0 THEN ['early', 'late', 'later']
          WHEN s_suppkey % 3 = 0 THEN ['primary', 'alternate-1'] ELSE ['primary'] END) AS route_id FROM supplier),
      captures AS (SELECT DISTINCT 'src' || c_custkey AS source, CASE WHEN c_custkey % 3 = 0 THEN 'alternate-1' ELSE 'primary' END AS route_id
        FROM customer)
      SELECT source, route_id, 'no_capture' AS gap FROM (SELECT * FROM routes EXCEPT SELECT * FROM captures)
      UNION ALL SELECT source, route_id, 'no_route' FROM (SELECT * FROM captures EXCEPT SELECT * FROM routes)"""
    out["worklist"] = "SELECT 'c' || c_custkey AS source, c_custkey % 10 AS priority FROM customer ORDER BY 2 DESC, 1"
    out["feed_sniff"] = """SELECT page_id, is_feed, CASE WHEN page_id % 11 = 0 THEN 'cms_json' WHEN page_id % 11 = 1 THEN 'row_text'
        WHEN is_feed THEN 'feed' WHEN page_id % 11 = 2 THEN 'dated' WHEN page_id % 5 = 0 THEN 'unsupported' ELSE 'links' END AS reader
      FROM (SELECT page_id, (page_id % 6 IN (0, 1) OR regexp_matches(lower(url), 'rss|feed')) AS is_feed FROM pages)"""
    for layout in T.PAGE_TEMPLATES:
        out[f"{layout}_items"] = layout_items(layout)
    out["capture_attempts"] = capture_attempts()
    safe = "replace(replace(url_encode(h), '%2F', '/'), '%2C', ',')"
    out["nav_links"] = f"""SELECT 'p' || page_id AS route_id, CAST(i - 1 AS INTEGER) AS pos, t AS title,
      regexp_extract(url, '^(https?://)', 1) || lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) || {safe} AS link, '' AS date
      FROM (SELECT page_id, url, i, hs[i] AS h, ts[i] AS t FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM (SELECT page_id, url,
        regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS ts
        FROM pages WHERE NOT regexp_matches(lower(regexp_extract(url, '^([^?#]*)', 1)), 'rss|feed'))))"""
    out["detail_summary"] = f"SELECT page_id, {paragraphs()} AS summary FROM pages"
    out["detail_enrichment"] = f"""WITH {ITEMS}, d AS (SELECT page_id, {paragraphs()} AS s FROM pages)
      SELECT ord, CASE WHEN ord % 4 < 2 THEN 'web' ELSE source END AS source, 'https://d.test/' || ord // 4 AS link,
        CASE WHEN ord % 2 = 1 AND summary <> '' THEN summary WHEN ord % 4 < 2 THEN coalesce(s, '') ELSE '' END AS summary
      FROM items LEFT JOIN d ON d.page_id = ord // 4"""
    out["legacy_reports"] = f"""SELECT event_id, event_type AS status, CASE WHEN k % 2 = 0 THEN 's' || k ELSE '' END AS failed_sources,
      CAST(CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS BIGINT) AS input_count, CASE WHEN k % 2 = 0 THEN 'invalid_items' ELSE '' END AS alert_reasons,
      CASE WHEN k % 2 = 0 THEN 'a.xlsx' ELSE '' END AS output_file, '' AS report_file FROM (SELECT *, {K} AS k FROM events)"""
    out["progress_of_runs"] = """SELECT run_id, completed, failed, 200 AS total, last_kind, CASE last_kind WHEN 'writing_outputs' THEN 95
        ELSE least(95, greatest(5, CAST(floor(5 + completed / 200 * 90 + 0.5) AS INTEGER))) END AS percent
      FROM (SELECT user_id AS run_id, count(*) FILTER (event_type IN ('click', 'error')) AS completed, count(*) FILTER (event_type = 'error') AS failed,
        arg_max(CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'source_started' WHEN 'error' THEN 'source_failed'
          WHEN 'click' THEN 'source_finished' ELSE 'writing_outputs' END, event_id) AS last_kind FROM events GROUP BY 1)"""
    out["progress_stream"] = out["progress_resent"] = out["progress_of_runs"]
    return out
