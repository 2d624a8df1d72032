"""The same results as plain SQL, for the engines' results to be compared."""

from __future__ import annotations

import re

from trendlens.functions import fixed, prompts
from trendlens.operators.countreg import Category
from trendlens.plans import models, roundtrips
from trendlens.sources.views import CORPUS_TERMS, EVENT_DAYS, JSON_SHAPES, LINE_SHAPES, REGION_CODES, SPELLINGS

ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
LABELS = ", ".join(f"'{x}'" for x in fixed.LABELS)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _terms(terms: list[str]) -> str:
    return _text("|".join(re.escape(t) for t in terms))


VIDEOS = f"""
videos AS (
  SELECT l_partkey AS video_id, r_name AS country_code, n_name,
         CAST(o_orderdate AS DATE) AS pub_day, CAST(l_shipdate AS DATE) AS trend_day,
         CASE l_returnflag WHEN 'R' THEN 'olympic' WHEN 'A' THEN 'other_sport' ELSE 'non_sport' END AS predicted_label,
         {ORDER}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

ROLLUP = """
SELECT country_code, date_clean, count(*) AS videos,
       CAST(sum(CASE WHEN predicted_label = 'non_sport' THEN 0 ELSE 1 END) AS BIGINT) AS sports_videos,
       CAST(sum(CASE WHEN predicted_label = 'olympic' THEN 1 ELSE 0 END) AS BIGINT) AS olympic_videos
FROM {source} GROUP BY country_code, date_clean"""


def _dated(day: str) -> str:
    return f"WITH {VIDEOS}, dated AS (SELECT *, {day} AS date_clean FROM videos)"


def _firsts(day: str) -> str:
    return f"""{_dated(day)}, firsts AS (
  SELECT * FROM dated QUALIFY row_number() OVER (
    PARTITION BY video_id, country_code ORDER BY date_clean, {ORDER}) = 1)"""


TRIMMED = f"""{_firsts('pub_day')}, trimmed AS (
  SELECT * FROM firsts WHERE date_clean > (SELECT min(date_clean) FROM firsts) + 14)"""
PANEL = f"{TRIMMED}, panel AS ({ROLLUP.format(source='trimmed')})"

CALENDAR = f"""{PANEL}, calendar AS (
  SELECT *, CAST(month(date_clean) AS INTEGER) AS month,
         CAST(date_clean - (SELECT min(date_clean) FROM panel) AS INTEGER) AS date_num,
         sports_videos / videos AS sports_pct, olympic_videos / videos AS olympic_pct FROM panel)"""


def _medals(event: str) -> str:
    first, last = EVENT_DAYS[event]
    return f"""
{event}_medals AS (
  SELECT CAST(o_orderdate AS DATE) AS date_clean,
         CASE WHEN r_name = 'MIDDLE EAST' THEN 'ROC' ELSE upper(substr(r_name, 1, 3)) END AS country_code,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS medal_code
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
    AND CAST(o_orderdate AS DATE) BETWEEN DATE '{first}' AND DATE '{last}'),
{event}_span AS (SELECT min(date_clean) AS first, max(date_clean) AS last FROM {event}_medals)"""


MEDALS = f"""{_medals('summer')}, {_medals('winter')}, daily AS (
  SELECT date_clean, CASE country_code WHEN 'ROC' THEN 'RUS' ELSE country_code END AS country_code_iso3,
         count(*) FILTER (medal_code = 1) AS gold, count(*) FILTER (medal_code = 2) AS silver,
         count(*) FILTER (medal_code = 3) AS bronze
  FROM (SELECT * FROM summer_medals UNION ALL SELECT * FROM winter_medals) GROUP BY 1, 2)"""


def _windows(event: str) -> str:
    first, last = f"(SELECT first FROM {event}_span)", f"(SELECT last FROM {event}_span)"
    out = [
        f"CAST(date_clean >= {first} - 7 AND date_clean < {first} AS INTEGER) AS {event}_week_minus_1",
        f"CAST(date_clean BETWEEN {first} AND {last} AS INTEGER) AS {event}_during",
    ]
    out += [
        f"CAST(date_clean > {last} AND date_clean <= {last} + {7 * w} AS INTEGER) AS {event}_week_plus_{w}"
        for w in (1, 2, 3)
    ]
    out.append(f"CAST(date_clean - {first} AS INTEGER) AS event_time_{event}")
    return ", ".join(out)


_CODE = "CASE country_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REGION_CODES.items()) + " END"
FULL = f"""{CALENDAR}, {MEDALS}, coded AS (
  SELECT *, {_CODE} AS country_code_iso3, {_windows('summer')}, {_windows('winter')} FROM calendar),
full_panel AS (
  SELECT coded.*, coalesce(gold, 0) AS gold, coalesce(silver, 0) AS silver, coalesce(bronze, 0) AS bronze,
         coalesce(gold + silver + bronze, 0) AS medal_count, coalesce(3 * gold + 2 * silver + bronze, 0) AS medal_score
  FROM coded LEFT JOIN daily USING (date_clean, country_code_iso3))"""


def _line(event: str) -> str:
    return f"""{FULL}
SELECT event_time_{event}, round(avg(sports_pct), 6) AS sports_pct FROM full_panel
WHERE event_time_{event} BETWEEN -7 AND (SELECT last - first FROM {event}_span) + 21 GROUP BY 1"""


def _bars(event: str) -> str:
    length = f"(SELECT last - first FROM {event}_span)"
    rows = []
    for label, lo_from, lo, hi_from, hi in fixed.EVENT_BINS:
        low = str(lo) if lo_from == "start" else f"{length} + {lo}"
        high = str(hi) if hi_from == "start" else f"{length} + {hi}"
        rows.append(f"SELECT '{label}' AS \"window\", {low} AS lo, {high} AS hi")
    bins = " UNION ALL ".join(rows)
    return f"""{FULL}, bins AS ({bins})
SELECT "window", (lo + hi) / 2 AS centre, CAST(hi - lo + 1 AS INTEGER) AS width, round(avg(sports_pct), 6) AS sports_pct
FROM full_panel JOIN bins ON event_time_{event} BETWEEN lo AND hi GROUP BY "window", lo, hi"""


_COUNTRY_WINDOW = "OVER (PARTITION BY country_code ORDER BY date_clean"


def _lags(col: str) -> str:
    return ", ".join(f"coalesce(lag({col}, {n}) {_COUNTRY_WINDOW}), 0) AS {col}_lag{n}" for n in range(1, 8))


def _rolling(col: str, prefix: str) -> str:
    return ", ".join(
        f"CAST(sum({col}) {_COUNTRY_WINDOW} ROWS BETWEEN {t - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS {prefix}_{t}"
        for t in range(1, 22)
    )


CORPUS = """
corpus AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS video_id, split_part(text, chr(10), 1) AS title, '' AS tags,
         text AS description, source AS "channelTitle", lang AS country_code FROM documents)"""
CORPUS_ALL = "concat_ws(' ', title, tags, description, \"channelTitle\", country_code)"
SIG = "sha1(title || '|' || \"channelTitle\" || '|')"
CANDIDATES = f"""WITH {CORPUS}, signed AS (SELECT *, {SIG} AS sig FROM corpus), candidates AS (
  SELECT * FROM signed WHERE regexp_matches({CORPUS_ALL}, {_terms(CORPUS_TERMS)}, 'i'))"""
NEGATIVES = f"{CANDIDATES}, negatives AS (SELECT * FROM signed WHERE sig NOT IN (SELECT sig FROM candidates))"
TRAIN = f"""WITH {CORPUS}, train AS (
  SELECT corpus.*, concat_ws(' ', title, tags, description) AS text,
         CASE WHEN toxic = 1 THEN 'olympic' WHEN quality = 1 THEN 'other_sport' ELSE 'non_sport' END AS label
  FROM corpus JOIN labels USING (doc_id))"""


def _md5(seed: int, key: str = "doc_id") -> str:
    return f"md5(CAST({key} AS VARCHAR) || ':{seed}')"


def _resampled(value: str, target: int, seed: int = 42) -> str:
    return f"""{TRAIN}, numbered AS (
  SELECT doc_id, label, row_number() OVER (ORDER BY {_md5(seed)}, doc_id) AS pos,
         count(*) OVER () AS size FROM train WHERE label = '{value}'),
draws AS (
  SELECT draw, CAST('0x' || substr(md5(CAST(draw AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT) %
         (SELECT max(size) FROM numbered) + 1 AS pos
  FROM range(1, {target + 1}) AS r(draw) WHERE draw <= {target} - (SELECT max(size) FROM numbered))
SELECT doc_id, label, CAST(0 AS BIGINT) AS draw FROM train WHERE label <> '{value}'
UNION ALL SELECT doc_id, label, 0 FROM numbered WHERE pos <= {target}
UNION ALL SELECT doc_id, label, draw FROM numbered JOIN draws USING (pos)"""


def _shape(shapes: list[str]) -> str:
    whens = " ".join(
        f"WHEN {i} THEN replace(replace({_text(s)}, '@L', l), '@R', r)" for i, s in enumerate(shapes)
    )
    return f"""said AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'olympic' WHEN 1 THEN 'other_sport' ELSE 'non_sport' END AS l,
         regexp_replace(text, '[^\\p{{L}}\\p{{N}} ]', ' ', 'g') AS r FROM documents),
shaped AS (SELECT doc_id, CASE doc_id % {len(shapes)} {whens} END AS raw_resp FROM said)"""


_WS = "[\\s\\x{85}\\x{a0}\\x{1c}-\\x{1f}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _count(x: str, ch: str) -> str:
    return f"(length({x}) - length(replace({x}, '{ch}', '')))"


def _strict(x: str, field: str) -> str:
    return f"""CASE WHEN json_valid({x}) THEN
      CASE WHEN json_type({x}, '$.label') = 'VARCHAR' AND json_type({x}, '$.reason') = 'VARCHAR'
            AND json_extract_string({x}, '$.label') IN ({LABELS}) THEN json_extract_string({x}, '$.{field}') END END"""


_JSON = f"""WITH {_shape(JSON_SHAPES)},
t0 AS (SELECT doc_id, {_strip('raw_resp')} AS raw FROM shaped),
t1 AS (SELECT *, coalesce(nullif(regexp_extract(raw, '(?s)\\{{.*\\}}'), ''), raw) AS c FROM t0),
t2 AS (SELECT *, c || repeat('}}', greatest({_count('c', '{')} - {_count('c', '}')}, 0)) AS b FROM t1),
t3 AS (SELECT *, CASE WHEN {_count('b', '"')} % 2 = 1 THEN b || '"' ELSE b END AS q FROM t2),
t4 AS (SELECT *, CASE WHEN contains(q, '"') AND right({_strip('q')}, 1) <> '}}'
                  AND {_count('q', '{')} = {_count('q', '}')} THEN q || '}}' ELSE q END AS fixed FROM t3),
t5 AS (SELECT *, {_strict('c', 'label')} AS l1, {_strict('c', 'reason')} AS r1,
       {_strict('fixed', 'label')} AS l2, {_strict('fixed', 'reason')} AS r2,
       lower(regexp_extract(c, '"label"\\s*:\\s*"([^"]+)"', 1)) AS l3,
       regexp_matches(c, '"reason"\\s*:\\s*"[^"]*') AS has_reason,
       rtrim({_strip("regexp_extract(c, '\"reason\"\\s*:\\s*\"([^\"]*)', 1)")}, ' ,;:') AS r3 FROM t4),
answers AS (SELECT doc_id,
  CASE WHEN raw = '' THEN 'non_sport' WHEN l1 IS NOT NULL THEN l1 WHEN l2 IS NOT NULL THEN l2
       WHEN l3 IN ({LABELS}) THEN l3 ELSE 'non_sport' END AS label,
  CASE WHEN raw = '' THEN 'empty_response' WHEN l1 IS NOT NULL THEN r1 WHEN l2 IS NOT NULL THEN r2
       WHEN NOT has_reason THEN 'parse_error' WHEN r3 = '' THEN 'parse_truncated' ELSE r3 END AS reason FROM t5)"""

_LINES = f"""WITH {_shape(LINE_SHAPES)},
split AS (SELECT doc_id, list_transform(string_split({_strip('raw_resp')}, chr(10)), lambda x: {_strip('x')}) AS ls
          FROM shaped),
found AS (SELECT doc_id,
  list_filter(list_transform(list_filter(ls, lambda x: starts_with(lower(x), 'label:')),
    lambda x: lower(regexp_extract({_strip('substr(x, 7)')}, '^[^\\s]+'))), lambda x: x IN ({LABELS})) AS lab,
  list_transform(list_filter(ls, lambda x: starts_with(lower(x), 'reason:')),
    lambda x: {_strip('substr(x, 8)')}) AS rea FROM split)
SELECT doc_id, coalesce(lab[-1], 'non_sport') AS label, coalesce(rea[-1], '') AS reason FROM found"""

_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
_GRAMS = f"""{TRAIN}, words AS (SELECT doc_id, {_TOKENS} AS w FROM train),
grams AS (
  SELECT doc_id, unnest(w) AS term FROM words
  UNION ALL SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM words
  UNION ALL SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM words)"""

_CELLS = f"""{TRAIN}, predicted AS (
  SELECT label, CASE WHEN regexp_matches(description, {_terms(CORPUS_TERMS)}, 'i') THEN 'olympic'
                     WHEN country_code = 'en' THEN 'other_sport' ELSE 'non_sport' END AS p FROM train)"""

_KEYWORD_REASON = "'keyword rule' AS reason"

_SPELT = f"([{', '.join(_text(t) for t in SPELLINGS)}])[doc_id // 2 % {len(SPELLINGS) // 3} * 3 + doc_id % 3 + 1]"
_TERMED = f"""SELECT doc_id, lang, CASE WHEN doc_id % 2 = 1 THEN text ELSE 'x' || {_SPELT} || 'x ' || text END AS text FROM documents"""

_KNOWN_PARTS = f"""WITH {VIDEOS}, known AS (
  SELECT video_id, country_code FROM videos QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY {ORDER}) = 1),
parts AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN -p_partkey ELSE p_partkey END AS video_id, p_name FROM part)"""


def _fit_sql(*names: str) -> str:
    """The terms of the named models, which of them are zero throughout, and that their equations hold."""
    arms = []
    for name in names:
        def arm(term: str, zero: str, source: str = "p", model: str = name) -> None:
            arms.append(f"SELECT '{model}' AS model, {term} AS term, {zero} AS dropped FROM {source}")

        def category(c: str) -> str:
            return f"(SELECT DISTINCT {c} FROM p WHERE {c} > (SELECT min({c}) FROM p))"

        arm("'Intercept'", "FALSE", "(SELECT 1)")
        for term in models.MODELS[name]:
            if isinstance(term, str):
                arm(f"'{term}'", f"sum(abs({term})) = 0")
            elif isinstance(term, Category):
                arm(f"'C({term.column})[T.' || {term.column} || ']'", "FALSE", category(term.column))
            else:
                c, x = term.category.column, term.number
                arm(f"'{x}'", f"sum(abs({x})) = 0")
                arm(f"'C({c})[T.' || {c} || ']'", "FALSE", category(c))
                arm(f"'C({c})[T.' || {c} || ']:{x}'", f"sum(abs({x})) = 0", f"p WHERE {c} > (SELECT min({c}) FROM p) GROUP BY {c}")
    return f"""{FULL}, p AS (SELECT *, summer_during + winter_during AS olympic_period FROM full_panel),
terms AS ({' UNION '.join(arms)})
SELECT model, term, (SELECT count(*) FROM p) AS n, dropped, TRUE AS converged, CAST(0 AS DOUBLE) AS score FROM terms"""

ORACLE = {
    "panel_published_nodup": TRIMMED + ROLLUP.format(source="trimmed"),
    "panel_published_dup": _dated("pub_day") + ROLLUP.format(source="dated"),
    "panel_trending_nodup": f"""{_firsts('trend_day')}, kept AS (
  SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY video_id) > 10)"""
    + ROLLUP.format(source="kept"),
    "panel_trending_dup": _dated("trend_day") + ROLLUP.format(source="dated"),
    "panel_trending_trim_days": f"""{_firsts('trend_day')}, kept AS (
  SELECT * FROM firsts QUALIFY date_clean >= min(date_clean) OVER (PARTITION BY country_code) + 10)"""
    + ROLLUP.format(source="kept"),
    "first_appearance": f"""{_firsts('pub_day')}
SELECT video_id, country_code, date_clean, predicted_label, l_orderkey, l_linenumber FROM firsts""",
    "panel_calendar": f"""{CALENDAR}
SELECT country_code, date_clean, videos, sports_videos, olympic_videos, month, date_num,
       round(sports_pct, 6) AS sports_pct, round(olympic_pct, 6) AS olympic_pct FROM calendar""",
    "event_windows": f"""{FULL}
SELECT country_code, date_clean, {', '.join(f'{e}_{p}' for e in ('summer', 'winter') for p in
    ('week_minus_1', 'during', 'week_plus_1', 'week_plus_2', 'week_plus_3'))},
       summer_during + winter_during AS olympic_period, event_time_summer, event_time_winter FROM full_panel""",
    "medal_daily": f"WITH {MEDALS} SELECT * FROM daily",
    "panel_with_medals": f"""{FULL}
SELECT country_code, country_code_iso3, date_clean, videos, gold, silver, bronze, medal_count, medal_score
FROM full_panel""",
    "medal_lags": f"{FULL} SELECT country_code, date_clean, medal_count, {_lags('medal_count')} FROM full_panel",
    "medal_rolling": f"""{FULL}
SELECT country_code, date_clean, {_rolling('medal_count', 'rolling_medals')} FROM full_panel""",
    "rolling_nulls": f"""{FULL}, rolled AS (SELECT {_rolling('medal_count', 'rolling_medals')} FROM full_panel)
SELECT {', '.join(f'count(*) FILTER (rolling_medals_{t} IS NULL) AS rolling_medals_{t}' for t in range(1, 22))}
FROM rolled""",
    "dense_rolling": f"""WITH daily AS (
  SELECT event_type AS country_code, CAST(ts AS DATE) AS date_clean, count(*) AS n FROM events GROUP BY 1, 2)
SELECT country_code, date_clean, n, {_lags('n')}, {_rolling('n', 'rolling_n')} FROM daily""",
    "event_study_line_summer": _line("summer"),
    "event_study_line_winter": _line("winter"),
    "event_study_bars_summer": _bars("summer"),
    "event_study_bars_winter": _bars("winter"),
    "country_effect_size": f"""{FULL}
SELECT country_code_iso3, round(avg(videos), 6) AS videos, round(avg(sports_videos), 6) AS sports_videos,
       round(median(sports_pct), 6) AS sports_pct FROM full_panel GROUP BY 1""",
    "overdispersion": f"""{PANEL}
SELECT round(var_samp(sports_videos), 6) AS variance, round(avg(sports_videos), 6) AS mean FROM panel""",
    "share_by_country_day": f"""{CALENDAR}
SELECT country_code, date_clean, round(sports_pct, 6) AS sports_pct, round(olympic_pct, 6) AS olympic_pct
FROM calendar""",
    "medals_by_country_day": f"{FULL} SELECT country_code_iso3, date_clean, medal_count FROM full_panel",
    "label_shares": f"""WITH {VIDEOS}
SELECT predicted_label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM videos GROUP BY 1""",
    "country_counts": f"WITH {VIDEOS} SELECT n_name AS country_code, count(*) AS n FROM videos GROUP BY 1",
    "distinct_counts": f"""WITH {VIDEOS}
SELECT count(DISTINCT video_id) AS distinct_videos,
       (SELECT count(*) FROM (SELECT DISTINCT video_id, country_code FROM videos)) AS distinct_pairs,
       count(*) AS "rows" FROM videos""",
    "distinct_countries": f"WITH {VIDEOS} SELECT DISTINCT n_name AS country_code FROM videos",
    "distinct_pairs": f"WITH {VIDEOS} SELECT DISTINCT country_code, video_id FROM videos",
    "label_flags": f"""WITH {VIDEOS}
SELECT CASE WHEN predicted_label = 'non_sport' THEN 0 ELSE 1 END AS sports,
       CASE WHEN predicted_label = 'olympic' THEN 1 ELSE 0 END AS olympic, count(*) AS n FROM videos GROUP BY 1, 2""",
    "country_codes": f"""
SELECT c_custkey, nullif({_CODE.replace('country_code', 'r_name')}, 'ASI') AS mapped,
       CASE WHEN r_name = 'MIDDLE EAST' THEN 'RUS' ELSE r_name END AS replaced,
       coalesce(nullif({_CODE.replace('country_code', 'r_name')}, 'ASI'), 'XX') AS filled
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "signatures": f"WITH {CORPUS} SELECT doc_id, {SIG} AS sig FROM corpus",
    "keyword_candidates": f'{CANDIDATES} SELECT doc_id, title, "channelTitle", country_code FROM candidates',
    "sport_pages": f"""
SELECT page_id, url FROM pages WHERE regexp_matches(url || ' ' || html, {_terms(fixed.SPORT_TERMS)}, 'i')""",
    "games_pages": f"""
SELECT tab, count(*) AS scanned, count(*) FILTER (regexp_matches(text, {_terms(fixed.GAMES_STEMS)}, 'i')) AS games,
       count(*) FILTER (regexp_matches(text, {_terms(fixed.SPORT_TERMS)}, 'i')) AS sport
FROM (SELECT 'documents' AS tab, text FROM documents UNION ALL SELECT 'pages', html FROM pages
      UNION ALL SELECT 'termed', text FROM ({_TERMED})) GROUP BY tab""",
    "sport_documents": f"SELECT doc_id, lang FROM ({_TERMED}) WHERE regexp_matches(text, {_terms(fixed.SPORT_TERMS)}, 'i')",
    "capped_candidates": f"""WITH {CORPUS}, capped AS (
  SELECT * FROM corpus WHERE regexp_matches(concat_ws(' ', title, tags, description), {_terms(CORPUS_TERMS)}, 'i')
  QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY doc_id) <= 60)
SELECT doc_id, country_code FROM capped QUALIFY row_number() OVER (ORDER BY {_md5(42)}, doc_id) <= 150""",
    "first_per_country": f"""WITH {VIDEOS}
SELECT n_name AS country_code, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM videos
QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY {ORDER}) <= 200""",
    "country_lookup": f"""{_KNOWN_PARTS}
SELECT p.video_id, p_name, coalesce(country_code, 'XX') AS country_code FROM parts p LEFT JOIN known USING (video_id)""",
    "lookup_metrics": f"""{_KNOWN_PARTS}
SELECT count(*) AS candidates, count(country_code) AS assigned, (SELECT count(*) FROM known) AS mapping
FROM parts LEFT JOIN known USING (video_id)""",
    "country_lookup_fallback": f"""WITH {CORPUS}, signed AS (SELECT *, {SIG} AS sig FROM corpus),
by_id AS (SELECT video_id, country_code FROM signed QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY doc_id) = 1),
by_sig AS (SELECT sig, country_code FROM signed QUALIFY row_number() OVER (PARTITION BY sig ORDER BY doc_id) = 1),
lost AS (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN sha1('lost ' || title || '|' || "channelTitle" || '|') ELSE sig END AS sig,
  CASE WHEN doc_id % 2 = 1 THEN 'lost-' || video_id ELSE video_id END AS video_id FROM signed)
SELECT doc_id, coalesce(by_id.country_code, by_sig.country_code, 'XX') AS country_code
FROM lost LEFT JOIN by_id USING (video_id) LEFT JOIN by_sig USING (sig)""",
    "negatives_anti": f"{NEGATIVES} SELECT doc_id, country_code FROM negatives",
    "sampled_pos": f"""{CANDIDATES} SELECT doc_id, country_code FROM candidates
QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY {_md5(0)}, doc_id) <= 50""",
    "sampled_neg": f"""{NEGATIVES} SELECT doc_id, country_code FROM negatives
QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY {_md5(0)}, doc_id) <= 50""",
    "sampled_rows": f"""SELECT doc_id, lang AS country_code FROM documents
QUALIFY row_number() OVER (ORDER BY {_md5(7)}, doc_id) <= 120""",
    "shuffled_rows": f"SELECT doc_id, row_number() OVER (ORDER BY {_md5(42)}, doc_id) AS position FROM documents",
    "upsampled_class": _resampled("olympic", 400),
    "downsampled_class": _resampled("other_sport", 40),
    "balanced_quota": f"""
SELECT row_number() OVER (PARTITION BY lang ORDER BY {_md5(42)}, doc_id) AS "round", lang AS country_code, doc_id
FROM documents QUALIFY "round" <= 100""",
    "stratified_split": f"""{TRAIN}
SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {_md5(42)}, doc_id)
       <= floor(count(*) OVER (PARTITION BY label) * 0.2 + 0.5) AS is_test FROM train""",
    "shard": f"""{TRAIN} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS "index", doc_id, country_code FROM train
QUALIFY "index" BETWEEN 30 AND 129""",
    "labelled_union": """
SELECT doc_id, lang AS country_code, CAST(NULL AS INTEGER) AS quality, CAST(NULL AS INTEGER) AS toxic FROM documents
UNION ALL SELECT doc_id, NULL, quality, toxic FROM labels
UNION ALL SELECT item_id, NULL, NULL, NULL FROM benchmark""",
    "preview": f"WITH {VIDEOS} SELECT {ORDER}, country_code FROM videos ORDER BY {ORDER} LIMIT 25",
    "run_metrics": f"""WITH {CORPUS}
SELECT count(*) AS scanned, count(*) FILTER (regexp_matches({CORPUS_ALL}, {_terms(CORPUS_TERMS)}, 'i')) AS matched,
       count(DISTINCT "channelTitle") AS keys FROM corpus""",
    "prompts": f"""WITH {CORPUS}
SELECT doc_id,
  replace(replace({_text(prompts.SLOT_TEMPLATE)}, '<<title>>', replace(title, chr(10), ' ')),
          '<<tags>>', replace(description, chr(10), ' ')) AS slot_prompt,
  {_text(prompts.EXAMPLES)} || chr(10) || 'Title: ' || substr(title, 1, 800) || chr(10) || 'Tags: ' || substr(description, 1, 400)
  || chr(10) || 'Description: ' || substr(description, 1, 800) || chr(10) || chr(10) || {_text(fixed.LINE_FORMAT)}
  AS line_prompt FROM corpus""",
    "parsed_json": f"{_JSON} SELECT doc_id, label, reason FROM answers",
    "parsed_lines": _LINES,
    "failed_answers": f"""{_JSON}
SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'non_sport' ELSE label END AS label,
       CASE WHEN l.doc_id IS NULL THEN 'generation_failed' ELSE reason END AS reason
FROM answers LEFT JOIN labels l USING (doc_id)""",
    "rule_labels": f"""
SELECT doc_id, CASE WHEN regexp_matches(text, {_terms(fixed.GAMES_STEMS)}, 'i') THEN 'olympic'
                    WHEN regexp_matches(text, {_terms(fixed.SPORT_TERMS)}, 'i') THEN 'other_sport'
                    ELSE 'non_sport' END AS label, {_KEYWORD_REASON} FROM ({_TERMED})""",
    "incremental_label": f"""
SELECT doc_id, lang AS country_code, CASE WHEN regexp_matches(text, {_terms(CORPUS_TERMS)}, 'i')
       THEN 'other_sport' ELSE 'non_sport' END AS label, {_KEYWORD_REASON} FROM documents""",
    "incremental_candidates": f"""
SELECT doc_id, lang AS country_code FROM documents WHERE regexp_matches(text, {_terms(CORPUS_TERMS)}, 'i')""",
    "incremental_lookup": f"""{_KNOWN_PARTS}
SELECT coalesce(country_code, 'XX') AS country_code, count(*) AS n FROM lineitem
LEFT JOIN known ON CASE WHEN l_partkey % 5 = 0 THEN -l_partkey ELSE l_partkey END = video_id GROUP BY 1""",
    "incremental_first_seen": """SELECT sha1(split_part(text, chr(10), 1)) AS title_sha1, lang FROM documents
WHERE text IS NOT NULL AND lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title_sha1 ORDER BY doc_id) = 1""",
    "dedup_train": f"""{TRAIN} SELECT doc_id, label FROM train
QUALIFY row_number() OVER (PARTITION BY country_code, {_strip("title")}, "channelTitle" ORDER BY doc_id) = 1""",
    "token_counts": f"""WITH words AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents)
SELECT doc_id, count(*) AS tokens, count(DISTINCT term) AS distinct_tokens FROM words GROUP BY doc_id""",
    "ngram_vocab": f"""{_GRAMS}
SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM grams GROUP BY term
HAVING count(DISTINCT doc_id) <= 0.98 * (SELECT count(*) FROM train) ORDER BY cf DESC, term LIMIT 80000""",
    "tfidf_terms": f"""{_GRAMS},
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
vocab AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term
          HAVING count(*) <= 0.98 * (SELECT count(*) FROM train) ORDER BY cf DESC, term LIMIT 80000),
raw AS (SELECT doc_id, term, tf, tf * (ln(((SELECT count(*) FROM train) + 1) / (df + 1)) + 1) AS x
        FROM tf JOIN vocab USING (term))
SELECT doc_id, term, tf, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""",
    "report_fixed": f"""{_CELLS}, classes AS (SELECT DISTINCT label AS c FROM predicted UNION SELECT p FROM predicted),
counts AS (SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (p = c) AS chosen,
                  count(*) FILTER (label = c AND p = c) AS hit FROM classes, predicted GROUP BY c),
ratios AS (SELECT *, coalesce(hit / nullif(chosen, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS re FROM counts),
scores AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f FROM ratios),
rows_ AS (
  SELECT c AS class, pr AS precision, re AS recall, f AS f1, support FROM scores
  UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support)
            FROM scores
  UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f), sum(support) FROM scores
  UNION ALL SELECT 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support),
            sum(f * support) / sum(support), sum(support) FROM scores)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM rows_""",
    "confusion_fixed": f"""{_CELLS}
SELECT label, {', '.join(f"count(*) FILTER (p = '{c}') AS {c}" for c in sorted(fixed.LABELS))}
FROM predicted GROUP BY label""",
    "nb_single_factor": f"""{PANEL}, means AS (
  SELECT country_code, avg(sports_videos) AS m, count(*) AS n FROM panel GROUP BY 1),
cells AS (SELECT country_code, m, n, sum((sports_videos - m) ** 2) / (n * n * m * m) AS v0
          FROM panel JOIN means USING (country_code) GROUP BY country_code, m, n),
ref AS (SELECT *, v0 / (1 - 1 / n) ** 2 AS v3 FROM cells
        WHERE country_code = (SELECT min(country_code) FROM cells))
SELECT 'Intercept' AS term, round(ln(m), 6) AS coef, round(sqrt(v0), 6) AS se_hc0, round(sqrt(v3), 6) AS se_hc3 FROM ref
UNION ALL
SELECT 'C(country_code)[T.' || c.country_code || ']', round(ln(c.m) - ln(r.m), 6), round(sqrt(c.v0 + r.v0), 6),
       round(sqrt(c.v0 / (1 - 1 / c.n) ** 2 + r.v3), 6)
FROM cells c, ref r WHERE c.country_code <> r.country_code""",
    "nb_records": """WITH items AS (
  SELECT r_name AS country_code, CAST(l_quantity AS DOUBLE) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
means AS (SELECT country_code, avg(y) AS m, count(*) AS n FROM items GROUP BY 1),
cells AS (SELECT country_code, m, n, sum((y - m) ** 2) / (n * m * n * m) AS v0
          FROM items JOIN means USING (country_code) GROUP BY country_code, m, n),
ref AS (SELECT *, v0 / (1 - 1 / n) ** 2 AS v3 FROM cells WHERE country_code = (SELECT min(country_code) FROM cells)),
total AS (SELECT CAST(sum(n) AS BIGINT) AS rows_seen FROM cells)
SELECT 'Intercept' AS term, rows_seen AS n, round(ln(m), 6) AS coef, round(sqrt(v0), 6) AS se_hc0, round(sqrt(v3), 6) AS se_hc3
FROM ref, total
UNION ALL
SELECT 'C(country_code)[T.' || c.country_code || ']', rows_seen, round(ln(c.m) - ln(r.m), 6), round(sqrt(c.v0 + r.v0), 6),
       round(sqrt(c.v0 / (1 - 1 / c.n) ** 2 + r.v3), 6)
FROM cells c, ref r, total WHERE c.country_code <> r.country_code""",
    "nb_base": _fit_sql("base"),
    "nb_trend": _fit_sql("trend"),
    "nb_season": _fit_sql("season"),
    "nb_hetero": _fit_sql("hetero"),
    "nb_pre_post": _fit_sql("pre_post"),
    "nb_medal_compare": f"SELECT * FROM ({_fit_sql('medal_count', 'medal_score')}) WHERE model = term",
    "nb_rolling_sweep": f"""{FULL} SELECT CAST(w AS INTEGER) AS rolling_window, count(*) AS n, TRUE AS converged,
  CAST(0 AS DOUBLE) AS score FROM full_panel, range(1, 22) AS r(w) GROUP BY w""",
    "classifier_fit": f"""{TRAIN}
SELECT label, CAST(floor(CASE label WHEN 'olympic' THEN 400 ELSE count(*) END * 0.2 + 0.5) AS BIGINT) AS n, TRUE AS converged,
       CAST(0 AS DOUBLE) AS gradient FROM train GROUP BY label""",
    "medal_file": f"""WITH {MEDALS}
SELECT date_clean, country_code, medal_code, count(*) AS n
FROM (SELECT * FROM summer_medals UNION ALL SELECT * FROM winter_medals) GROUP BY ALL""",
    "appended_answers": f"WITH {_shape(JSON_SHAPES)} SELECT doc_id AS \"index\", sha1(raw_resp) AS raw_sha1 FROM shaped",
    **roundtrips.ORACLE,
}
