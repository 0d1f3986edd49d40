"""DuckDB SQL that gives the same rows as the registered queries, over the driver's tables."""

from __future__ import annotations

from ..operators.segments import SEGMENTS
from .queries import ALERT_DAY, CATEGORY, DAY, DAY_FROM, END, INJECT_FROM, START, candidates
from .tables import SHOP
from .weights import FEATURES, GROUPS, WEIGHTS


def _bucket(column: str, edges: list[int]) -> str:
    steps = [f"WHEN {column} IS NULL OR {column} < 0 THEN '(null)' WHEN {column} < {edges[0]} THEN '<{edges[0]}'"]
    steps += [f"WHEN {column} < {b} THEN '{a if b - a == 1 else f'{a}-{b - 1}'}'" for a, b in zip(edges, edges[1:], strict=False)]
    return f"CASE {' '.join(steps)} ELSE '{edges[-1]}+' END"


def _label(segment: str) -> str:
    column, edges = SEGMENTS[segment]
    if edges:
        return _bucket(column, edges)
    if column in ("is_in_product_base", "is_article"):
        return f"CASE WHEN {column} THEN 'True' ELSE 'False' END"
    return f"coalesce(CAST({column} AS VARCHAR), '(null)')"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), 'ё', 'е'), '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def _ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def _index(today: str, base: str) -> str:
    return f"CASE WHEN direction = -1 THEN 200 - 100 * {_ratio(today, base)} ELSE 100 * {_ratio(today, base)} END"


_SESSIONS = """
  SELECT {k}, session_idx, min(ts) AS ts_start, max(ts) AS ts_end, count(*) AS n_events,
    count(*) FILTER (WHERE action_type = 'search') AS n_search, count(*) FILTER (WHERE action_type = 'view') AS n_view,
    count(*) FILTER (WHERE action_type = 'click') AS n_click, count(*) FILTER (WHERE action_type = 'to_cart') AS n_cart,
    count(*) FILTER (WHERE action_type = 'favorite') AS n_fav,
    count(DISTINCT search_query) FILTER (WHERE action_type = 'search') AS n_unique_queries,
    arg_min(search_query, (ts, event_id)) FILTER (WHERE action_type = 'search' AND search_query IS NOT NULL) AS first_query,
    arg_min(widget_name, (ts, event_id)) FILTER (WHERE action_type = 'search' AND widget_name IS NOT NULL) AS first_widget,
    count(DISTINCT category_name) AS n_unique_categories, min(ts) FILTER (WHERE action_type = 'to_cart') AS ts_first_cart
  FROM {t} LEFT JOIN fx_products USING (item_id) GROUP BY {k}, session_idx HAVING count(*) FILTER (WHERE action_type = 'search') > 0"""

BASE = f"""
WITH RECURSIVE fx_events AS (
  SELECT e.user_id, CAST(ts AS DATE) AS date, ts, event_id,
    CASE event_type WHEN 'signup' THEN 'search' WHEN 'purchase' THEN 'to_cart' WHEN 'error' THEN 'favorite' ELSE event_type END AS action_type,
    CASE WHEN event_type = 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'search_suggestions' WHEN 1 THEN 'mobile_search_bar' WHEN 2 THEN 'web_search_bar' END END AS widget_name,
    CASE WHEN event_type = 'signup' THEN CASE event_id % 5 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN upper(p_name) || '  '
      WHEN 2 THEN concat_ws(' ', p_name, p_brand) WHEN 3 THEN p_brand END END AS search_query,
    CASE WHEN event_type <> 'signup' THEN k END AS item_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e LEFT JOIN part p ON p.p_partkey = e.k
), fx_products AS (SELECT p_partkey AS item_id, p_name AS name, p_brand AS brand, p_type AS type, p_type AS category_name FROM part),
gaps AS (
  SELECT *, date_sub('second', lag(ts) OVER w, ts) AS gap_s FROM fx_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), numbered AS (
  SELECT *, sum(CASE WHEN gap_s IS NULL OR gap_s > {SHOP.gap_min * 60} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_idx FROM gaps
), modes AS (
  SELECT user_id, session_idx, category_name FROM (
    SELECT user_id, session_idx, category_name, row_number() OVER (PARTITION BY user_id, session_idx ORDER BY count(*) DESC, category_name) AS rn
    FROM numbered JOIN fx_products USING (item_id) WHERE category_name IS NOT NULL GROUP BY user_id, session_idx, category_name) WHERE rn = 1
), bare AS ({_SESSIONS.format(k='user_id', t='numbered')}),
sess AS (
  SELECT bare.*, category_name AS top_category_in_session, date_sub('second', ts_start, ts_end) AS duration_s, n_cart > 0 AS reached_cart,
    date_sub('second', ts_start, ts_first_cart) AS time_to_cart_s FROM bare LEFT JOIN modes USING (user_id, session_idx)
), cat_texts AS (
  SELECT DISTINCT text FROM (SELECT {_norm('t')} AS text FROM (SELECT unnest([name, brand, type, category_name]) AS t FROM fx_products)) WHERE text <> ''
), cat_articles AS (SELECT DISTINCT trim(CAST(item_id AS VARCHAR)) AS text FROM fx_products WHERE item_id IS NOT NULL),
clean AS (SELECT *, {_norm('first_query')} AS query_clean FROM sess),
worded AS (
  SELECT clean.*, CASE WHEN query_clean IS NULL OR query_clean = '' THEN 0 ELSE len(string_split(query_clean, ' ')) END AS query_len_words,
    query_clean IS NOT NULL AND query_clean IN (SELECT text FROM cat_texts) AS is_in_product_base,
    query_clean IS NOT NULL AND query_clean IN (SELECT text FROM cat_articles) AS is_article FROM clean
), enriched AS (
  SELECT *, greatest(0, least(5,
    CASE WHEN n_unique_queries <= 1 THEN 0 WHEN n_unique_queries <= 3 THEN 1 WHEN n_unique_queries <= 7 THEN 2 WHEN n_unique_queries <= 19 THEN 3 ELSE 4 END
    + CASE WHEN query_len_words <= 2 THEN 0 WHEN query_len_words <= 4 THEN 1 WHEN query_len_words <= 6 THEN 2 ELSE 3 END
    + CASE WHEN is_in_product_base THEN 0 ELSE 1 END + CASE WHEN n_click = 0 THEN 1 ELSE 0 END + CASE WHEN reached_cart THEN 0 ELSE 1 END
    - CASE WHEN is_article THEN 2 ELSE 0 END)) AS query_stratification_score FROM worded
), folded AS (
  SELECT *, CAST(ts_end AS DATE) AS date, CASE WHEN count(*) OVER (PARTITION BY coalesce(top_category_in_session, 'other')) >= {SHOP.min_category_sessions}
    THEN coalesce(top_category_in_session, 'other') ELSE 'other' END AS category FROM sess
), km_steps AS (
  SELECT date, category, CASE WHEN reached_cart THEN time_to_cart_s ELSE duration_s END AS t, count(*) FILTER (WHERE reached_cart) AS d, count(*) AS n FROM folded GROUP BY ALL
), km_risk AS (SELECT *, sum(n) OVER (PARTITION BY date, category ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM km_steps),
km_curve AS (SELECT *, product(1 - d / risk) OVER (PARTITION BY date, category ORDER BY t ROWS UNBOUNDED PRECEDING) AS alive FROM km_risk),
km AS (
  SELECT date, category, CASE WHEN sum(d) >= {SHOP.km_min_events} THEN CAST(min(t) FILTER (WHERE alive <= 0.5 AND d > 0) AS DOUBLE) END AS km_median_time_to_cart_s FROM km_curve GROUP BY date, category
), summ AS (
  SELECT date, category, count(DISTINCT user_id) AS n_users, count(*) AS n_sessions, avg(n_events) AS rate_events, avg(n_search) AS rate_searches, avg(n_view) AS rate_views,
    avg(n_click) AS rate_clicks, avg(n_fav) AS rate_favs, avg(n_unique_queries) AS rate_unique_queries, count(*) FILTER (WHERE reached_cart) AS is_cart, avg(n_cart) AS cart_rate,
    avg(CAST(reached_cart AS INT)) AS session_conversion_rate, avg(CAST(n_events = 1 AS INT)) AS bounce_rate, avg(CAST(n_click = 0 AS INT)) AS dead_search_rate,
    avg(CAST(n_unique_queries > 1 AS INT)) AS search_refinement_rate, avg(duration_s) AS mean_duration_s, avg(CAST(n_unique_categories > 1 AS INT)) AS multi_category_rate,
    {_ratio('sum(n_view)', 'sum(n_search)')} AS view_per_search, {_ratio('sum(n_click)', 'sum(n_view)')} AS click_per_view, {_ratio('sum(n_cart)', 'sum(n_click)')} AS cart_per_click,
    avg(n_search) FILTER (WHERE reached_cart) AS mean_searches_to_cart, avg(n_unique_queries) FILTER (WHERE reached_cart) AS mean_unique_queries_to_cart,
    avg(time_to_cart_s) FILTER (WHERE reached_cart) AS mean_time_to_cart_s
  FROM folded GROUP BY date, category
), summary AS (SELECT summ.*, km_median_time_to_cart_s FROM summ LEFT JOIN km USING (date, category)),
long AS ({' UNION ALL '.join(f"SELECT date, category, '{f}' AS feature, {'CAST(is_cart AS DOUBLE)' if f == 'session_conversion_rate' else f'{f} * n_sessions'} AS above, CASE WHEN {f} IS NOT NULL THEN CAST(n_sessions AS DOUBLE) END AS below FROM summary" for f in FEATURES)}),
daily AS (SELECT date, feature, {_ratio('sum(above)', 'sum(below)')} AS value FROM long GROUP BY date, feature),
w(grp, group_weight, feature, direction) AS (VALUES {', '.join(f"('{x.group}', {x.group_weight}, '{x.feature}', {x.direction})" for x in WEIGHTS)}),
base_v AS (SELECT feature, {_ratio('sum(above)', 'sum(below)')} AS base_value FROM long WHERE date BETWEEN '{START}' AND '{END}' GROUP BY feature),
idx AS (
  SELECT g.date, g.feature, grp, CAST(group_weight AS DOUBLE) AS group_weight, direction, value, base_value, {_index('value', 'base_value')} AS index_value
  FROM (SELECT DISTINCT date, w.* FROM daily, w) g LEFT JOIN daily ON daily.date = g.date AND daily.feature = g.feature LEFT JOIN base_v ON base_v.feature = g.feature
), groups AS (SELECT date, grp, group_weight, avg(index_value) AS score, count(index_value) AS n_used FROM idx GROUP BY ALL),
raw AS (SELECT date, sum(group_weight * score) / nullif(sum(group_weight) FILTER (WHERE score IS NOT NULL), 0) AS health FROM groups GROUP BY date),
c_today AS (SELECT date, category, feature, {_ratio('sum(above)', 'sum(below)')} AS value FROM long GROUP BY ALL),
c_base AS (SELECT category, feature, {_ratio('sum(above)', 'sum(below)')} AS base_value FROM long WHERE date BETWEEN '{START}' AND '{END}' GROUP BY ALL),
c_groups AS (
  SELECT t.date, t.category, grp, group_weight, avg({_index('t.value', 'b.base_value')}) AS score
  FROM c_today t JOIN w USING (feature) LEFT JOIN c_base b ON b.category = t.category AND b.feature = t.feature GROUP BY ALL
), c_health AS (SELECT date, category, sum(group_weight * score) / nullif(sum(group_weight) FILTER (WHERE score IS NOT NULL), 0) AS health FROM c_groups GROUP BY ALL),
shares AS (SELECT category, sum(n_sessions) / sum(sum(n_sessions)) OVER () AS base_weight FROM summary WHERE date BETWEEN '{START}' AND '{END}' GROUP BY category),
cats AS (
  SELECT d.date, s.category, base_weight, coalesce(n / n_day, 0.0) AS today_share, CAST(coalesce(n, 0) AS BIGINT) AS n_sessions_today, health,
    CASE WHEN n IS NULL THEN 'missing_today' WHEN n < {SHOP.min_sessions_per_category} THEN 'low_volume' WHEN health IS NULL THEN 'nan_health' END AS skip_reason
  FROM (SELECT date, sum(n_sessions) AS n_day FROM summary GROUP BY date) d CROSS JOIN shares s
  LEFT JOIN (SELECT date, category, sum(n_sessions) AS n FROM summary GROUP BY ALL) t ON t.date = d.date AND t.category = s.category
  LEFT JOIN c_health h ON h.date = d.date AND h.category = s.category
), strat AS (SELECT date, sum(base_weight * health) FILTER (WHERE skip_reason IS NULL) / sum(base_weight) FILTER (WHERE skip_reason IS NULL) AS stratified FROM cats GROUP BY date),
scores AS (SELECT date, health, stratified, stratified - health AS drift FROM raw LEFT JOIN strat USING (date)),
fit0 AS (
  SELECT daily.*, isodow(date) - 1 AS dow, avg(value) OVER (PARTITION BY feature, isodow(date)) AS dow_mean, median(value) OVER (PARTITION BY feature) AS center
  FROM daily JOIN w USING (feature) WHERE date BETWEEN '{START}' AND '{END}'
), fit1 AS (SELECT feature, coalesce(stddev_pop(value - dow_mean) / nullif(stddev_pop(value), 0), 1) < {SHOP.dow_threshold} AS use_dow FROM fit0 GROUP BY feature),
fit2 AS (SELECT fit0.*, use_dow, value - CASE WHEN use_dow THEN dow_mean ELSE center END AS residual FROM fit0 JOIN fit1 USING (feature)),
fit3 AS (SELECT *, median(residual) OVER (PARTITION BY feature) AS m FROM fit2),
state AS (
  SELECT feature, any_value(direction) AS direction, any_value(use_dow) AS use_dow, CASE WHEN any_value(use_dow) THEN NULL ELSE any_value(center) END AS center,
    any_value(m) AS median, median(abs(residual - m)) AS mad, 1.4826 * median(abs(residual - m)) AS sigma,
    any_value(m) - {SHOP.mad_k} * 1.4826 * median(abs(residual - m)) AS lo, any_value(m) + {SHOP.mad_k} * 1.4826 * median(abs(residual - m)) AS hi, count(residual) AS n
  FROM fit3 JOIN w USING (feature) GROUP BY feature
), dow_means AS (SELECT DISTINCT feature, dow, dow_mean FROM fit0 WHERE dow_mean IS NOT NULL),
centred AS (
  SELECT daily.date, daily.feature, daily.value, s.*EXCLUDE (feature), CASE WHEN use_dow THEN dow_mean ELSE center END AS mid
  FROM daily JOIN state s ON s.feature = daily.feature LEFT JOIN dow_means m ON m.feature = daily.feature AND m.dow = isodow(daily.date) - 1
), checked AS (
  SELECT date, feature, direction, value, use_dow AS dow_used, value - mid AS residual, sigma, (value - mid) / CASE WHEN sigma > 0 THEN sigma END AS residual_sigmas,
    coalesce(CASE WHEN direction = -1 THEN value - mid > hi ELSE value - mid < lo END, false) AS is_anomaly,
    coalesce(value - mid > hi, false) OR coalesce(value - mid < lo, false) AS is_two_sided, mid + lo AS corridor_lo, mid + hi AS corridor_hi FROM centred
), active AS (
  SELECT scores.*, n_sessions, n_users, converted_sessions, mean_searches_to_cart, mean_unique_queries_to_cart, mean_time_to_cart_s, coalesce(n_alerts, 0) AS n_anomalies_active,
    coalesce(names, '') AS alert_features, coalesce(n_alerts, 0) > 0 AS has_alert, CASE WHEN health IS NULL THEN 'none' WHEN health < 95 THEN 'bad' WHEN health > 105 THEN 'good' ELSE 'normal' END AS band
  FROM scores JOIN (
    SELECT date, CAST(sum(n_sessions) AS BIGINT) AS n_sessions, CAST(sum(n_users) AS BIGINT) AS n_users, CAST(sum(is_cart) AS BIGINT) AS converted_sessions,
      {', '.join(f"sum({c} * n_sessions) / nullif(sum(n_sessions) FILTER (WHERE {c} IS NOT NULL), 0) AS {c}" for c in ('mean_searches_to_cart', 'mean_unique_queries_to_cart', 'mean_time_to_cart_s'))}
    FROM summary GROUP BY date) USING (date)
  LEFT JOIN (SELECT date, count(*) AS n_alerts, string_agg(feature, ',' ORDER BY feature) AS names FROM checked WHERE is_anomaly GROUP BY date) USING (date)
), totals AS (SELECT date, sum(group_weight) AS total FROM groups WHERE n_used > 0 GROUP BY date),
decomp AS (
  SELECT date, 'group' AS level, grp AS "group", CAST(NULL AS VARCHAR) AS feature, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS DOUBLE) AS today_value, CAST(NULL AS DOUBLE) AS baseline_value, CAST(NULL AS INT) AS direction, score AS index_value, group_weight / total * score AS contribution,
    CAST(NULL AS BOOLEAN) AS is_anomaly, CAST(NULL AS BOOLEAN) AS dow_used, CAST(NULL AS DOUBLE) AS residual, CAST(NULL AS DOUBLE) AS sigma, CAST(NULL AS DOUBLE) AS corridor_lo, CAST(NULL AS DOUBLE) AS corridor_hi, CAST(NULL AS BIGINT) AS n_sessions_today, CAST(NULL AS DOUBLE) AS base_weight, CAST(NULL AS DOUBLE) AS today_share, CAST(NULL AS BOOLEAN) AS included, CAST(NULL AS VARCHAR) AS skip_reason
  FROM groups LEFT JOIN totals USING (date)
  UNION ALL SELECT i.date, 'feature', i.grp, i.feature, NULL, i.value, i.base_value, i.direction, i.index_value, g.group_weight / total * i.index_value / nullif(n_used, 0),
    CASE WHEN i.value IS NOT NULL THEN is_anomaly END, CASE WHEN i.value IS NOT NULL THEN dow_used END, residual, CASE WHEN i.value IS NOT NULL THEN sigma END, CASE WHEN i.value IS NOT NULL THEN corridor_lo END,
    CASE WHEN i.value IS NOT NULL THEN corridor_hi END, NULL, NULL, NULL, NULL, NULL
  FROM idx i JOIN groups g ON g.date = i.date AND g.grp = i.grp LEFT JOIN totals t ON t.date = i.date LEFT JOIN checked c ON c.date = i.date AND c.feature = i.feature
  UNION ALL SELECT date, 'category', NULL, NULL, category, NULL, NULL, NULL, health, CASE WHEN skip_reason IS NULL THEN base_weight * health / sum(base_weight) FILTER (WHERE skip_reason IS NULL) OVER (PARTITION BY date) END,
    NULL, NULL, NULL, NULL, NULL, NULL, n_sessions_today, base_weight, today_share, skip_reason IS NULL, skip_reason FROM cats
), labels AS (SELECT *, strftime(ts_end, '%Y-%m-%d') AS day FROM enriched),
seg_rows AS ({' UNION ALL '.join(f"SELECT '{s}' AS segment, {_label(s)} AS value, day, reached_cart, n_unique_queries, n_view, duration_s FROM labels" for s in SEGMENTS)}),
seg0 AS (
  SELECT segment, value, CASE WHEN grouping(day) = 1 THEN 'ALL' ELSE day END AS date, count(*) AS n_sessions, count(*) FILTER (WHERE reached_cart) AS n_success,
    median(n_unique_queries) AS median_n_queries, median(n_view) AS median_n_views, median(duration_s) AS median_time_s
  FROM seg_rows GROUP BY GROUPING SETS ((segment, value, day), (segment, value))
), seg AS (
  SELECT segment, value, date, n_sessions, n_success, n_success / n_sessions AS success_rate, n_sessions / sum(n_sessions) OVER t AS share,
    n_success / n_sessions - sum(n_success) OVER t / sum(n_sessions) OVER t AS lift_vs_overall, CAST(round_even(n_sessions * (1 - n_success / n_sessions), 0) AS BIGINT) AS failure_volume,
    median_n_queries, median_n_views, median_time_s FROM seg0 WINDOW t AS (PARTITION BY segment, date)
), deltas0 AS (SELECT date, feature, value - lag(value) OVER (PARTITION BY feature ORDER BY date) AS delta FROM daily),
deltas AS (SELECT * FROM deltas0 WHERE date NOT IN (SELECT date FROM deltas0 WHERE delta IS NULL)),
z AS (
  SELECT date, feature, (value * direction - avg(value * direction) OVER f) / nullif(stddev_pop(value * direction) OVER f, 0) AS z FROM daily JOIN w USING (feature) WINDOW f AS (PARTITION BY feature)
), corrs AS (
  SELECT a.feature AS feature_a, b.feature AS feature_b, corr(a.z, b.z) AS r FROM z a JOIN z b ON a.date = b.date AND a.feature <> b.feature WHERE a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY ALL
)
"""


def _r(*columns: str) -> str:
    """Rounded columns under their own names."""
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


_DATE = "strftime(date, '%Y-%m-%d') AS date"
_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
_SUMMARY_RATES = (
    "rate_events rate_searches rate_views rate_clicks rate_favs rate_unique_queries cart_rate session_conversion_rate bounce_rate dead_search_rate search_refinement_rate mean_duration_s "
    "multi_category_rate view_per_search click_per_view cart_per_click mean_searches_to_cart mean_unique_queries_to_cart mean_time_to_cart_s km_median_time_to_cart_s"
).split()
_CHANGED = _norm("CASE WHEN user_id % 2 = 0 THEN left(first_query, greatest(length(first_query) - 1, 0)) ELSE first_query END")
_DECOMP = f"""{_DATE}, level, "group", feature, category, {_r('today_value', 'baseline_value')}, CAST(direction AS BIGINT) AS direction, {_r('index_value', 'contribution')},
  is_anomaly, dow_used, {_r('residual', 'sigma', 'corridor_lo', 'corridor_hi')}, n_sessions_today, {_r('base_weight', 'today_share')}, included, skip_reason"""


def _delta(level: str) -> str:
    keys = '"group", feature, category'
    side = "SELECT coalesce(\"group\", '') AS g, coalesce(feature, '') AS f, coalesce(category, '') AS c, index_value AS i, contribution AS x FROM decomp WHERE level = '{}' AND date = '{}'"
    return f"""SELECT '{level}' AS level, nullif(g, '') AS "group", nullif(f, '') AS feature, nullif(c, '') AS category, a.i AS from_index, b.i AS to_index, a.x AS from_contribution, b.x AS to_contribution,
      b.i - a.i AS delta_index, b.x - a.x AS delta_contribution FROM ({side.format(level, DAY_FROM)}) a FULL JOIN ({side.format(level, DAY)}) b USING (g, f, c)"""


_SUITE_SIZE = """CASE WHEN scenario = 'spike' AND o = 0 THEN 5.0 WHEN scenario = 'step' THEN 3.0 WHEN scenario = 'drift' THEN 5.0 * least(1.0, (o + 1) / 10) ELSE 0.0 END"""
_CANDIDATES = ", ".join(f"('{c}', '{f}', {x!r})" for c, ws in candidates().items() for f, x in ws.items())


def _scheme(name: str, base: str) -> str:
    return f"""SELECT date, '{name}' AS scheme, sum(group_weight * score) / nullif(sum(group_weight) FILTER (WHERE score IS NOT NULL), 0) AS health FROM (
      SELECT date, grp, group_weight, avg({_index('value', 'base_value')}) AS score FROM ({base}) JOIN w USING (feature) GROUP BY ALL) GROUP BY date"""


def _rolling(n: int) -> str:
    return f"""SELECT t.date, t.feature, t.value, {_ratio('sum(p.above)', 'sum(p.below)')} AS base_value FROM daily t LEFT JOIN long p
      ON p.feature = t.feature AND p.date < t.date AND date_diff('day', p.date, t.date) <= {n} GROUP BY ALL"""


ORACLES: dict[str, str] = {
    "scan_events": f"SELECT {_DATE}, action_type, count(*) AS n, count(DISTINCT user_id) AS n_users, count(search_query) AS n_queries, CAST(sum(item_id) AS BIGINT) AS items FROM fx_events WHERE date BETWEEN '2024-01-05' AND '2024-01-12' GROUP BY fx_events.date, action_type",
    "session_gaps": "SELECT event_id, user_id, gap_s, CAST(session_idx AS BIGINT) AS session_idx FROM numbered",
    "chunked_sessions": f""", cg AS (SELECT *, date_sub('second', lag(ts) OVER (PARTITION BY user_id, date ORDER BY ts, event_id), ts) AS cgap FROM fx_events),
      cn AS (SELECT *, date AS chunk_start, sum(CASE WHEN cgap IS NULL OR cgap > {SHOP.gap_min * 60} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, date ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_idx FROM cg),
      cs AS ({_SESSIONS.format(k='user_id, chunk_start', t='cn')})
      SELECT user_id, strftime(chunk_start, '%Y-%m-%d') AS chunk_start, CAST(session_idx AS BIGINT) AS session_idx, n_events, n_search, date_sub('second', ts_start, ts_end) AS duration_s, n_cart > 0 AS reached_cart FROM cs""",
    "sessionize": f"""SELECT user_id, CAST(session_idx AS BIGINT) AS session_idx, {_TS.format('ts_start')}, {_TS.format('ts_end')}, n_events, n_search, n_view, n_click, n_cart, n_fav, n_unique_queries, first_query, first_widget,
      n_unique_categories, top_category_in_session, {_TS.format('ts_first_cart')}, duration_s, reached_cart, time_to_cart_s FROM sess""",
    "session_invariants": """SELECT rule, n FROM (SELECT count(*) FILTER (WHERE n_search < 1) AS has_search, count(*) FILTER (WHERE n_events <> n_search + n_view + n_click + n_cart + n_fav) AS counters_sum,
      count(*) FILTER (WHERE ts_start > ts_end) AS times_ordered, count(*) FILTER (WHERE reached_cart <> (n_cart > 0)) AS cart_flag,
      count(*) FILTER (WHERE (ts_first_cart IS NOT NULL) <> reached_cart OR NOT coalesce(time_to_cart_s BETWEEN 0 AND duration_s, true)) AS cart_time,
      count(*) FILTER (WHERE (n_unique_categories > 0) <> (top_category_in_session IS NOT NULL)) AS category_flag, count(*) FILTER (WHERE n_unique_queries > n_search) AS query_count,
      count(*) - count(DISTINCT (user_id, session_idx)) AS unique_key FROM sess) UNPIVOT (n FOR rule IN (has_search, counters_sum, times_ordered, cart_flag, cart_time, category_flag, query_count, unique_key))""",
    "gap_histogram": "SELECT round(floor(log10(gap_s / 60.0) * 40) / 40, 6) AS log10_gap_bin, count(*) AS n FROM gaps WHERE gap_s > 0 GROUP BY 1",
    "gap_valleys": """, h AS (SELECT floor(log10(gap_s / 60.0) * 40) / 40 AS b, count(*) AS n FROM gaps WHERE gap_s > 0 GROUP BY 1),
      edge AS (SELECT log10(1.0 / 60) AS low, (log10(60.0 * 24 * 7) - log10(1.0 / 60)) / 119 AS width),
      f AS (SELECT CAST(floor((b - low) / width) AS BIGINT) AS bin, sum(n) AS n FROM h, edge GROUP BY 1),
      g AS (SELECT r.bin, coalesce(f.n, 0) AS n FROM (SELECT unnest(range(119)) AS bin) r LEFT JOIN f USING (bin)),
      s AS (SELECT *, min(n) OVER (ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS l, min(n) OVER (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS r FROM g)
      SELECT bin, CAST(n AS BIGINT) AS n, round(pow(10.0, low + (bin + 0.5) * width), 6) AS centre_min FROM s, edge WHERE n < l AND n < r AND bin BETWEEN 4 AND 114 ORDER BY n, bin LIMIT 3""",
    "conversion_ci": "SELECT n, round(p, 6) AS rate, round(p - 1.96 * sqrt(p * (1 - p) / n), 6) AS low, round(p + 1.96 * sqrt(p * (1 - p) / n), 6) AS high FROM (SELECT count(*) AS n, avg(CAST(reached_cart AS INT)) AS p FROM sess)",
    "normalize_queries": f"SELECT event_id, {_norm('search_query')} AS query_clean FROM fx_events WHERE search_query IS NOT NULL",
    "catalog_texts": "SELECT text FROM cat_texts",
    "catalog_articles": "SELECT text FROM cat_articles",
    "enrich_sessions": "SELECT user_id, CAST(session_idx AS BIGINT) AS session_idx, query_clean, CAST(query_len_words AS BIGINT) AS query_len_words, is_in_product_base, is_article, CAST(query_stratification_score AS BIGINT) AS query_stratification_score FROM enriched",
    "enriched_contract": "SELECT count(*) AS n_rows, CAST(min(query_stratification_score) AS BIGINT) AS min_score, CAST(max(query_stratification_score) AS BIGINT) AS max_score, count(*) FILTER (WHERE query_stratification_score IS NULL OR query_stratification_score NOT BETWEEN 0 AND 5) AS n_bad FROM enriched",
    "verify_enriched": f""", c1 AS (SELECT *EXCLUDE (query_clean, query_len_words, is_in_product_base, is_article, query_stratification_score), query_clean AS q0, query_len_words AS l0, is_in_product_base AS b0, is_article AS a0, query_stratification_score AS s0, {_CHANGED} AS query_clean FROM enriched),
      c2 AS (SELECT *, CASE WHEN query_clean IS NULL OR query_clean = '' THEN 0 ELSE len(string_split(query_clean, ' ')) END AS l, query_clean IS NOT NULL AND query_clean IN (SELECT text FROM cat_texts) AS b, query_clean IS NOT NULL AND query_clean IN (SELECT text FROM cat_articles) AS a FROM c1),
      c3 AS (SELECT *, greatest(0, least(5, CASE WHEN n_unique_queries <= 1 THEN 0 WHEN n_unique_queries <= 3 THEN 1 WHEN n_unique_queries <= 7 THEN 2 WHEN n_unique_queries <= 19 THEN 3 ELSE 4 END
        + CASE WHEN l <= 2 THEN 0 WHEN l <= 4 THEN 1 WHEN l <= 6 THEN 2 ELSE 3 END + CASE WHEN b THEN 0 ELSE 1 END + CASE WHEN n_click = 0 THEN 1 ELSE 0 END + CASE WHEN reached_cart THEN 0 ELSE 1 END - CASE WHEN a THEN 2 ELSE 0 END)) AS s FROM c2)
      SELECT "column", n_different FROM (SELECT count(*) FILTER (WHERE q0 IS DISTINCT FROM query_clean) AS query_clean, count(*) FILTER (WHERE l0 IS DISTINCT FROM l) AS query_len_words, count(*) FILTER (WHERE b0 IS DISTINCT FROM b) AS is_in_product_base,
        count(*) FILTER (WHERE a0 IS DISTINCT FROM a) AS is_article, count(*) FILTER (WHERE s0 IS DISTINCT FROM s) AS query_stratification_score FROM c3)
      UNPIVOT (n_different FOR "column" IN (query_clean, query_len_words, is_in_product_base, is_article, query_stratification_score))""",
    "segment_labels": f"SELECT user_id, CAST(session_idx AS BIGINT) AS session_idx, {', '.join(f'{_label(s)} AS seg_{s}' for s in SEGMENTS)} FROM enriched",
    "category_fold": "SELECT category, count(*) AS n_sessions, count(DISTINCT date) AS n_days FROM folded GROUP BY category",
    "km_median": f"SELECT {_DATE}, category, {_r('km_median_time_to_cart_s')} FROM km",
    "day_summary": f"SELECT {_DATE}, category, n_users, n_sessions, is_cart, {_r(*_SUMMARY_RATES)} FROM summary",
    "daily_features": f"SELECT {_DATE}, feature, {_r('value')} FROM daily",
    "daily_delta": f"SELECT {_DATE}, feature, {_r('delta')} FROM deltas",
    "baseline_window": "SELECT strftime(min(date), '%Y-%m-%d') AS baseline_start, strftime(min(date) + INTERVAL 19 DAY, '%Y-%m-%d') AS baseline_end, count(DISTINCT date) AS n_days FROM summary WHERE date <= (SELECT min(date) + INTERVAL 19 DAY FROM summary)",
    "health_daily": f"SELECT {_DATE}, {_r('health', 'stratified', 'drift')} FROM scores",
    "health_indices": f'SELECT {_DATE}, feature, grp AS "group", group_weight, CAST(direction AS BIGINT) AS direction, {_r("value", "base_value", "index_value")} FROM idx',
    "health_stratified": f"SELECT {_DATE}, category, {_r('base_weight', 'today_share')}, n_sessions_today, {_r('health')}, skip_reason IS NULL AS included, skip_reason FROM cats",
    "daily_metrics": f"""SELECT {_DATE}, {_r('health', 'stratified', 'drift')}, n_sessions, n_users, converted_sessions, {_r('mean_searches_to_cart', 'mean_unique_queries_to_cart', 'mean_time_to_cart_s')}, n_anomalies_active, alert_features, has_alert, band,
      '{START}' AS baseline_start, '{END}' AS baseline_end, {', '.join(f"(SELECT round(score, 6) FROM groups g WHERE g.date = active.date AND grp = '{g}') AS group_{g}" for g in GROUPS)},
      {', '.join(f"(SELECT round(index_value, 6) FROM idx i WHERE i.date = active.date AND feature = '{f}') AS feature_{f}" for f in FEATURES)} FROM active""",
    "mad_thresholds": f"SELECT feature, CAST(direction AS BIGINT) AS direction, use_dow, {_r('center', 'median', 'mad', 'sigma', 'lo', 'hi')}, n FROM state",
    "detector_state": f"SELECT CAST(1 AS BIGINT) AS version, feature, CAST({SHOP.mad_k} AS DOUBLE) AS k, CAST(dow AS BIGINT) AS dow, {_r('dow_mean')} FROM dow_means",
    "mad_alerts": f"SELECT {_DATE}, feature, CAST(direction AS BIGINT) AS direction, {_r('value')}, dow_used, {_r('residual', 'sigma', 'residual_sigmas')}, is_anomaly, is_two_sided, {_r('corridor_lo', 'corridor_hi')} FROM checked",
    "mad_same_dow": f""", m AS (SELECT feature, CAST(isodow(date) - 1 AS BIGINT) AS dow, value, median(value) OVER (PARTITION BY feature, isodow(date)) AS m FROM daily)
      SELECT feature, dow, round(any_value(m), 6) AS median, round(median(abs(value - m)), 6) AS mad, round(1.4826 * median(abs(value - m)), 6) AS sigma, round(any_value(m) - {SHOP.mad_k} * 1.4826 * median(abs(value - m)), 6) AS lo,
      round(any_value(m) + {SHOP.mad_k} * 1.4826 * median(abs(value - m)), 6) AS hi, count(value) AS n FROM m GROUP BY feature, dow HAVING count(value) >= 3""",
    "decomposition": f"SELECT {_DECOMP} FROM decomp",
    "decomposition_check": f"""SELECT {_DATE}, level, {_r('total')}, {_r('expected')} FROM (SELECT d.date, level, sum(contribution) AS total, any_value(CASE WHEN level = 'category' THEN stratified ELSE health END) AS expected FROM decomp d JOIN scores USING (date) GROUP BY d.date, level)
      WHERE abs(total - expected) > 1e-4 OR (total IS NULL) <> (expected IS NULL)""",
    "top_contributors": f"""SELECT "group", feature, {_r('index_value', 'contribution')} FROM decomp WHERE level = 'feature' AND date = '{DAY}' AND contribution IS NOT NULL ORDER BY decomp.contribution, "group", feature LIMIT 10""",
    "explain_delta": f""", parts AS ({_delta('group')} UNION ALL {_delta('feature')} UNION ALL {_delta('category')}),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY coalesce(delta_contribution, 0), "group" NULLS FIRST, feature NULLS FIRST, category NULLS FIRST) AS rank FROM parts)
      SELECT level, "group", feature, category, {_r('from_index', 'to_index', 'from_contribution', 'to_contribution', 'delta_index', 'delta_contribution')}, rank, CAST(NULL AS BIGINT) AS n_flipped FROM ranked WHERE level = 'group' OR rank <= 10
      UNION ALL SELECT 'total', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
        round((SELECT coalesce(sum(contribution), 0) FROM decomp WHERE level = 'category' AND included AND date = '{DAY}') - (SELECT coalesce(sum(contribution), 0) FROM decomp WHERE level = 'category' AND included AND date = '{DAY_FROM}'), 6),
        round((SELECT coalesce(sum(contribution), 0) FROM decomp WHERE level = 'feature' AND date = '{DAY}') - (SELECT coalesce(sum(contribution), 0) FROM decomp WHERE level = 'feature' AND date = '{DAY_FROM}'), 6), 0,
        (SELECT count(*) FROM parts WHERE level = 'feature' AND (from_index IS NULL) <> (to_index IS NULL))
      WHERE EXISTS (SELECT 1 FROM decomp WHERE date = '{DAY}') AND EXISTS (SELECT 1 FROM decomp WHERE date = '{DAY_FROM}')""",
    "anomaly_summary": f"SELECT feature, {_r('today_value', 'residual', 'sigma', 'corridor_lo', 'corridor_hi')} FROM decomp WHERE level = 'feature' AND date = '{ALERT_DAY}' AND is_anomaly",
    "category_drilldown": f"""SELECT q.category, {_r('index_value', 'contribution')}, n_sessions_today, {_r('base_weight', 'today_share')}, included, skip_reason, d.category IS NOT NULL AS found
      FROM (SELECT '{CATEGORY}' AS category) q LEFT JOIN (SELECT * FROM decomp WHERE level = 'category' AND date = '{DAY}') d ON d.category = q.category""",
    "day_view": f"""SELECT level, "group", feature, category, {_r('index_value', 'contribution')}, round(residual / CASE WHEN sigma > 0 THEN sigma END, 6) AS residual_sigmas, included, skip_reason FROM decomp WHERE date = '{DAY}'""",
    "worst_categories": f"SELECT category, {_r('index_value', 'contribution')}, n_sessions_today FROM decomp WHERE level = 'category' AND date = '{DAY}' AND included ORDER BY decomp.contribution, category LIMIT 14",
    "timeline": f"""SELECT {_DATE}, {_r('health', 'stratified', 'drift')}, band, n_sessions, n_anomalies_active, has_alert, (SELECT strftime(min(date), '%Y-%m-%d') FROM active) AS available_from, (SELECT strftime(max(date), '%Y-%m-%d') FROM active) AS available_to
      FROM active WHERE active.date BETWEEN '2024-01-10' AND '2024-01-24'""",
    "timeline_kpis": """SELECT count(*) AS n_days, round(avg(health), 6) AS mean_health, round(avg(stratified), 6) AS mean_stratified, strftime(arg_min(date, (health, date)), '%Y-%m-%d') AS worst_day, count(*) FILTER (WHERE has_alert) AS alert_days,
      round(avg(CAST(has_alert AS INT)), 6) AS alert_share, CAST(sum(n_sessions) AS BIGINT) AS n_sessions, strftime(min(date), '%Y-%m-%d') AS baseline_start, strftime(min(date) + INTERVAL 19 DAY, '%Y-%m-%d') AS baseline_end,
      (SELECT count(DISTINCT date) FROM summary WHERE date <= (SELECT min(date) + INTERVAL 19 DAY FROM summary)) AS baseline_n_days FROM active""",
    "anomaly_days": f"SELECT {_DATE}, {_r('health')}, n_anomalies_active, alert_features FROM active WHERE has_alert",
    "segment_breakdown": f"SELECT segment, value, date, n_sessions, n_success, {_r('success_rate', 'share', 'lift_vs_overall')}, failure_volume, {_r('median_n_queries', 'median_n_views', 'median_time_s')} FROM seg",
    "segments_view": f"SELECT segment, value, n_sessions, {_r('success_rate', 'share')} FROM seg WHERE date = 'ALL' AND segment = 'query_len_bucket'",
    "weak_spots": f"SELECT segment, value, n_sessions, {_r('success_rate', 'lift_vs_overall')}, failure_volume FROM seg WHERE date = 'ALL' AND n_sessions >= {SHOP.min_volume_period} AND seg.lift_vs_overall <= {SHOP.min_lift} ORDER BY failure_volume DESC, segment, value LIMIT 20",
    "weak_spot_totals": f"SELECT segment, CAST(sum(failure_volume) AS BIGINT) AS failures FROM (SELECT * FROM seg WHERE date = 'ALL' AND n_sessions >= {SHOP.min_volume_period} AND lift_vs_overall <= {SHOP.min_lift} ORDER BY failure_volume DESC, segment, value LIMIT 20) GROUP BY segment",
    "segment_day_view": f""", norm AS (SELECT segment, value, sum(n_success) / sum(n_sessions) AS success_rate_period, CAST(sum(n_sessions) AS BIGINT) AS n_sessions_period FROM seg WHERE date <> 'ALL' AND date BETWEEN '{START}' AND '{END}' GROUP BY ALL),
      v AS (SELECT s.segment, s.value, s.n_sessions, s.success_rate, success_rate_period, n_sessions_period, s.success_rate - success_rate_period AS delta_vs_period FROM seg s LEFT JOIN norm n ON n.segment = s.segment AND n.value = s.value WHERE date = '{DAY}' AND n_sessions >= {SHOP.min_volume_day})
      SELECT segment, value, n_sessions, {_r('success_rate', 'success_rate_period')}, n_sessions_period, {_r('delta_vs_period')}, CAST(coalesce(round_even(n_sessions * -v.delta_vs_period, 0), 0) AS BIGINT) AS extra_failures, 'baseline' AS norm_source FROM v ORDER BY extra_failures DESC, segment, value LIMIT 20""",
    "example_failures": f"""SELECT CAST(session_idx AS BIGINT) AS session_idx, {_TS.format('ts_start')}, {_TS.format('ts_end')}, first_query, query_clean, n_unique_queries, n_view, n_click, duration_s, top_category_in_session, first_widget,
      CAST(query_stratification_score AS BIGINT) AS query_stratification_score, CAST(query_len_words AS BIGINT) AS query_len_words, is_in_product_base, is_article
      FROM enriched WHERE first_widget = 'web_search_bar' AND NOT reached_cart ORDER BY enriched.ts_end, user_id, enriched.session_idx LIMIT 10""",
    "quantile_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {', '.join(f'CAST(quantile_disc({c}, {q}) AS DOUBLE) AS q{q * 100:g}' for q in (0.9, 0.95, 0.99))}, CAST(max({c}) AS DOUBLE) AS max FROM enriched" for c in ("n_events", "n_search", "n_unique_queries", "query_len_words")),
    "score_histogram": "SELECT CAST(query_stratification_score AS VARCHAR) AS value, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM enriched GROUP BY query_stratification_score",
    "outcome_by_score": "SELECT CAST(query_stratification_score AS BIGINT) AS score, count(*) AS n_sessions, round(avg(n_cart), 6) AS mean_n_cart, round(avg(CAST(reached_cart AS INT)), 6) AS cart_rate FROM enriched GROUP BY query_stratification_score",
    "score_corr": "SELECT round(corr(query_stratification_score, n_cart), 6) AS corr_score_n_cart, round(corr(query_stratification_score, CAST(reached_cart AS INT)), 6) AS corr_score_reached_cart FROM enriched",
    "feature_corr": "SELECT feature_a, feature_b, round(r, 6) AS r, r < 0 AS negative FROM corrs",
    "mde_table": """SELECT segment, n, round(p, 6) AS p, round(2.8 * sqrt(2 * p * (1 - p) / n), 6) AS mde, round(100 * 2.8 * sqrt(2 * p * (1 - p) / n) / nullif(p, 0), 6) AS mde_percent FROM (
      SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS segment, CAST(sum(n_sessions) AS BIGINT) AS n, sum(is_cart) / sum(n_sessions) AS p FROM summary GROUP BY ROLLUP (category))""",
    "lead_lag_corr": f""", ll AS (SELECT date, health - lag(health) OVER (ORDER BY date) AS dh, value - lag(value) OVER (ORDER BY date) AS dk FROM scores JOIN daily USING (date) WHERE feature = 'session_conversion_rate'),
      l2 AS (SELECT *, {', '.join(f'lead(dk, {k}) OVER (ORDER BY date) AS k{k}' for k in range(4))} FROM ll) {' UNION ALL '.join(f'SELECT CAST({k} AS BIGINT) AS lead, round(corr(dh, k{k}), 6) AS r FROM l2' for k in range(4))}""",
    "mad_loo_fp": """, pr AS (SELECT a.feature, a.date, a.value, b.value AS v, median(b.value) OVER (PARTITION BY a.feature, a.date) AS m FROM daily a JOIN daily b ON a.feature = b.feature AND a.date <> b.date WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
      bd AS (SELECT feature, date, any_value(value) AS value, any_value(m) AS m, 1.4826 * median(abs(v - m)) AS s FROM pr GROUP BY feature, date)
      SELECT feature, k, count(*) AS n_days, round(avg(CAST(abs(value - m) > k * s AS INT)), 6) AS false_rate FROM bd, (VALUES (CAST(3.0 AS DOUBLE)), (CAST(3.5 AS DOUBLE))) ks(k) GROUP BY feature, k""",
    "health_bootstrap": """, hd AS (SELECT row_number() OVER (ORDER BY date) - 1 AS pick, round(health, 6) AS health FROM scores WHERE health IS NOT NULL),
      nn AS (SELECT count(*) AS n FROM hd), dr AS (SELECT b, CAST('0x' || substr(md5(b || '-' || i), 1, 8) AS BIGINT) % n AS pick FROM nn, (SELECT unnest(range(1000)) AS b), (SELECT unnest(range((SELECT n FROM nn))) AS i)),
      ms AS (SELECT b, median(health) AS m FROM dr JOIN hd USING (pick) GROUP BY b)
      SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(quantile_cont(m, 0.975) - quantile_cont(m, 0.025), 6) AS width, (SELECT n FROM nn) AS n_days, (SELECT round(median(health), 6) FROM hd) AS median FROM ms""",
    "injection_suite": f""", cl AS (SELECT c.*, date_diff('day', DATE '2024-01-21', date) AS o FROM centred c WHERE date >= '2024-01-21'),
      fa AS (SELECT cl.*, scenario, value - direction * {_SUITE_SIZE} * sigma AS bad FROM cl, (VALUES ('spike'), ('step'), ('drift')) sc(scenario)),
      al AS (SELECT *, coalesce(CASE WHEN direction = -1 THEN bad - mid > hi ELSE bad - mid < lo END, false) AND NOT coalesce(CASE WHEN direction = -1 THEN value - mid > hi ELSE value - mid < lo END, false) AS hit FROM fa),
      mv AS (SELECT al.*, g.group_weight / total / n_used * ((CASE WHEN al.direction = -1 THEN 200 - 100 * bad / base_value ELSE 100 * bad / base_value END) - index_value) AS delta
        FROM al JOIN idx i ON i.date = al.date AND i.feature = al.feature JOIN groups g ON g.date = al.date AND g.grp = i.grp JOIN totals t ON t.date = al.date)
      SELECT feature, scenario, count(*) FILTER (WHERE hit) AS n_alerts, min(o) FILTER (WHERE hit) AS first_alert_after, bool_or(hit) AS detected, round(min(delta), 6) AS delta_health FROM mv GROUP BY feature, scenario""",
    "baseline_schemes": f"SELECT {_DATE}, scheme, {_r('health')} FROM ({_scheme('fixed', 'SELECT date, feature, value, base_value FROM daily LEFT JOIN base_v USING (feature)')} UNION ALL {_scheme('rolling_14', _rolling(14))} UNION ALL {_scheme('rolling_30', _rolling(30))})",
    "scheme_spread": f""", hd AS (SELECT date, feature, value, value - CASE WHEN feature = 'cart_per_click' THEN direction * 5.0 * sigma ELSE 0 END AS bad FROM centred WHERE date = '{DAY}'),
      bs AS (SELECT 'fixed' AS scheme, feature, base_value FROM base_v UNION ALL SELECT 'rolling_14', feature, base_value FROM ({_rolling(14)}) WHERE date = '{DAY}' UNION ALL SELECT 'rolling_30', feature, base_value FROM ({_rolling(30)}) WHERE date = '{DAY}'),
      gs AS (SELECT scheme, grp, group_weight, avg({_index('value', 'base_value')}) AS a, avg({_index('bad', 'base_value')}) AS b FROM hd JOIN bs USING (feature) JOIN w USING (feature) GROUP BY ALL),
      sc AS (SELECT scheme, sum(group_weight * a) / nullif(sum(group_weight) FILTER (WHERE a IS NOT NULL), 0) AS clean_health, sum(group_weight * b) / nullif(sum(group_weight) FILTER (WHERE b IS NOT NULL), 0) AS injected_health FROM gs GROUP BY scheme)
      SELECT scheme, {_r('clean_health', 'injected_health')}, round(injected_health - clean_health, 6) AS delta_health, round(max(injected_health - clean_health) OVER () - min(injected_health - clean_health) OVER (), 6) AS spread FROM sc""",
    "stress_isolation": f""", st AS (SELECT date, grp, group_weight, avg(index_value) AS a, avg(CASE WHEN feature = 'dead_search_rate' THEN {_index('value * 1.2', 'base_value')} ELSE index_value END) AS b
        FROM idx WHERE date_diff('day', DATE '{INJECT_FROM}', date) BETWEEN 0 AND 4 GROUP BY ALL),
      hs AS (SELECT date, sum(group_weight * a) / nullif(sum(group_weight) FILTER (WHERE a IS NOT NULL), 0) AS a, sum(group_weight * b) / nullif(sum(group_weight) FILTER (WHERE b IS NOT NULL), 0) AS b FROM st GROUP BY date)
      SELECT score, round(avg(b - a), 6) AS mean_delta, count(b - a) AS n_days FROM (SELECT grp AS score, a, b FROM st UNION ALL SELECT 'health', a, b FROM hs) GROUP BY score""",
    "detection_quality": f""", cl AS (SELECT c.*, date_diff('day', DATE '{INJECT_FROM}', date) AS o FROM centred c WHERE date >= '{INJECT_FROM}'),
      fa AS (SELECT *, CASE WHEN scenario = 'spike' AND o = 0 THEN 0.2 WHEN scenario = 'step' THEN 0.1 WHEN scenario = 'drift' AND o < 10 THEN 0.01 * (o + 1) ELSE 0 END AS size FROM cl, (VALUES ('spike'), ('step'), ('drift')) sc(scenario)),
      al AS (SELECT feature, scenario, o, size > 0 AND value IS NOT NULL AS injected, coalesce(CASE WHEN direction = -1 THEN value * (1 + size) - mid > hi ELSE value * (1 - size) - mid < lo END, false) AS hit FROM fa)
      SELECT feature, scenario, count(*) FILTER (WHERE hit) AS n_alerts, count(*) FILTER (WHERE injected) AS n_injected, round(count(*) FILTER (WHERE hit AND injected) / nullif(count(*) FILTER (WHERE hit), 0), 6) AS precision,
        round(count(*) FILTER (WHERE hit AND injected) / nullif(count(*) FILTER (WHERE injected), 0), 6) AS recall, min(o) FILTER (WHERE hit AND injected) AS days_to_detect FROM al GROUP BY ALL""",
    "rolling_mad": f""", met AS (SELECT t.date, t.feature, p.value AS v, median(p.value) OVER (PARTITION BY t.date, t.feature) AS m FROM daily t JOIN daily p ON p.feature = t.feature AND p.date < t.date AND date_diff('day', p.date, t.date) <= 7 WHERE p.value IS NOT NULL),
      rb AS (SELECT date, feature, any_value(m) AS m, 1.4826 * median(abs(v - m)) AS s, count(*) AS n FROM met GROUP BY date, feature HAVING count(*) >= 3)
      SELECT strftime(d.date, '%Y-%m-%d') AS date, d.feature, round(value, 6) AS value, round(m, 6) AS median, round(s, 6) AS sigma, round(m - 3.5 * s, 6) AS lo, round(m + 3.5 * s, 6) AS hi, coalesce(n, 0) AS n,
        coalesce(CASE WHEN direction = -1 THEN value > m + 3.5 * s ELSE value < m - 3.5 * s END, false) AS is_anomaly FROM daily d JOIN w USING (feature) LEFT JOIN rb ON rb.date = d.date AND rb.feature = d.feature""",
    "weight_set_scores": f""", cw(candidate, feature, wt) AS (VALUES {_CANDIDATES}),
      fl AS (SELECT feature_a AS a, feature_b AS b, coalesce(r, 0) AS r FROM corrs UNION ALL SELECT DISTINCT feature_a, feature_a, 1.0 FROM corrs),
      rw AS (SELECT candidate, a, sum(r * CAST(wt AS DOUBLE)) AS rw FROM fl JOIN cw ON cw.feature = fl.b GROUP BY ALL),
      rr AS (SELECT rw.candidate, a, rw / sqrt(sum(coalesce(wt, 0) * rw) OVER (PARTITION BY rw.candidate)) AS r FROM rw LEFT JOIN cw ON cw.candidate = rw.candidate AND cw.feature = rw.a)
      SELECT candidate, a AS feature, round(r, 6) AS r, round(avg(r) OVER (PARTITION BY candidate), 6) AS mean_r, round(min(r) OVER (PARTITION BY candidate), 6) AS min_r FROM rr""",
}
ORACLES["sessions_in_two_runs"] = ORACLES["user_log_sessions"] = ORACLES["sessionize"]
ORACLES["user_log_gaps"], ORACLES["user_log_gap_histogram"] = ORACLES["session_gaps"], ORACLES["gap_histogram"]
ORACLES["health_default_baseline"] = ORACLES["health_daily"]  # the data begin on the day that the fixed baseline begins on
ORACLES = {name: BASE + sql if not sql.startswith(",") else BASE.rstrip() + sql for name, sql in ORACLES.items()}
