"""DuckDB statements over the same tables, one for each named query with a stable value hash.

The statements are written relationally, with every join spelled out, so that they check
the aggregation shortcuts of the Spark plans instead of repeating them.
"""

from __future__ import annotations

import re

from weekover.metrics import GROUP_MEASURES, GROUP_METRICS, GROWTH_METRICS, HOURLY_METRICS, RATE_METRICS
from weekover.metrics import MONEY_MEASURES, TRAFFIC_MEASURES, hourly_columns
from weekover.plans import catalog
from weekover.sources import retail
from weekover.sources.schemas import MONEY_COLUMNS

P = retail.default_params()
TODAY = f"DATE '{P.today}'"
LAST_WEEK = f"DATE '{P.last_week}'"
NOW = f"TIMESTAMP '{P.as_of_text}'"
COUPONS = ", ".join(f"'{c}'" for c in retail.SPECIAL_COUPON_CODES)
TEMPLATES = ", ".join(f"'{t}'" for t in retail.TEMPLATE_IDS)
KEY = "cluster, order_id, hr, dt"


def r(expression: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def m(column: str) -> str:
    return f"COALESCE(CAST({column} AS DECIMAL(18,4)), 0)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def growth(tw: str, lw: str) -> str:
    return f"{div(f'({tw} - {lw})', lw)} * 100"


def listed(parts) -> str:
    return ",\n  ".join(parts)


MONEY_LIST = ", ".join(MONEY_COLUMNS)
CDPO = f"{m('cart_discount')} + {m('merchant_discount_hit')} + {m('platform_discount_hit')}"
SDPO = f"{m('platform_discount')} + {m('platform_discount_hit')} + {m('alliance_discount')}"
RDPO = f"{m('merchant_discount_hit')} + {m('merchant_offers_discount')}"
PLATFORM = m("total_platform_discount")

CTES: dict[str, str] = {}

CTES["placed"] = f"""
  SELECT event_id AS order_id, ts AS created_on, CAST(ts AS DATE) AS dt, CAST(hour(ts) AS INTEGER) AS hr,
    c_nationkey AS city_code, CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS excluded_flag,
    CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS coupon_code,
    CAST(10 + o_custkey % 10 AS DOUBLE) / 10 AS banner_factor,
    o_totalprice AS order_bill, value AS cart_discount,
    CAST(o_orderkey % 60 AS DOUBLE) AS platform_discount,
    CASE WHEN event_type = 'click' THEN CAST(o_orderkey % 15 AS DOUBLE) END AS platform_discount_hit,
    CAST(o_orderkey % 40 AS DOUBLE) AS merchant_discount_hit,
    CAST(o_custkey % 25 AS DOUBLE) AS merchant_offers_discount,
    CASE WHEN event_type = 'purchase' THEN CAST(10 AS DOUBLE) END AS alliance_discount,
    CAST(o_orderkey % 60 + CASE WHEN event_type = 'click' THEN o_orderkey % 15 ELSE 0 END + 80 AS DOUBLE)
      AS total_platform_discount,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 80 AS VARCHAR) END AS first_total
  FROM events JOIN orders ON o_orderkey = event_id JOIN customer ON c_custkey = o_custkey
  WHERE ts <= {NOW} AND CAST(ts AS DATE) IN ({TODAY}, {LAST_WEEK})"""
CTES["order_facts"] = f"""
  SELECT * FROM placed
  UNION ALL SELECT * FROM placed WHERE order_id % {retail.COPY_EVERY} = 0
  UNION ALL SELECT * REPLACE (order_bill + 10 AS order_bill) FROM placed WHERE order_id % {retail.COPY_EVERY} = 1"""
CTES["day_orders"] = "SELECT * FROM order_facts WHERE excluded_flag = 0"
CTES["cluster_dim"] = """
  SELECT n_nationkey AS city_code,
    CASE WHEN n_nationkey < 5 THEN 'tier_1' WHEN n_nationkey < 15 THEN 'tier_2' ELSE 'tier_3' END AS cluster
  FROM nation
  UNION ALL SELECT n_nationkey, 'tier_next' FROM nation WHERE n_nationkey >= 5"""
CTES["clustered"] = "SELECT * FROM day_orders JOIN cluster_dim USING (city_code)"
CTES["cutoff"] = f"""
  SELECT cluster, strftime(MAX(created_on), '%H:%M:%S') AS max_hms
  FROM clustered WHERE dt = {TODAY} GROUP BY cluster"""
CTES["comparable"] = f"""
  SELECT * FROM clustered JOIN cutoff USING (cluster)
  WHERE dt = {TODAY} OR strftime(created_on, '%H:%M:%S') <= max_hms"""
CTES["offer_events"] = f"""
  SELECT p_partkey AS offer_id, p_brand AS template_id, {TODAY} - CAST(3 * p_size AS INTEGER) AS dt FROM part
  UNION ALL
  SELECT p_partkey, 'Brand#1', {TODAY} - CAST(3 * p_size AS INTEGER) FROM part WHERE p_partkey % 20 = 0"""
CTES["offers"] = f"""
  SELECT DISTINCT offer_id, template_id FROM offer_events
  WHERE dt >= {TODAY} - {P.lookback_days} AND template_id IN ({TEMPLATES})"""
CTES["cities"] = """
  SELECT n_nationkey AS city_code, n_name AS city, r_name AS state
  FROM nation JOIN region ON r_regionkey = n_regionkey"""
CTES["hourly_rows"] = f"""
  SELECT DISTINCT {KEY}, coupon_code, first_total, banner_factor, {MONEY_LIST} FROM comparable"""
CTES["city_rows"] = "SELECT c.*, g.city AS grp FROM comparable c JOIN cities g USING (city_code)"
CTES["state_rows"] = "SELECT c.*, g.state AS grp FROM comparable c JOIN cities g USING (city_code)"


def _spend_ctes(rows: str) -> None:
    prefix = rows.removesuffix("_rows")
    CTES[f"{prefix}_targeted"] = f"""
  SELECT {KEY}, SUM(CAST(l_quantity AS DECIMAL(18,4))) AS targeted
  FROM {rows} JOIN lineitem ON l_orderkey = order_id JOIN offers ON offer_id = l_partkey
  GROUP BY {KEY}"""
    CTES[f"{prefix}_special"] = f"""
  SELECT {KEY}, CASE WHEN coupon_code IN ({COUPONS}) THEN CAST(first_total AS DECIMAL(18,4)) END AS special
  FROM {rows}"""


for _rows in ("hourly_rows", "city_rows", "state_rows"):
    _spend_ctes(_rows)


def _kpis(joined: bool) -> str:
    special = "special" if joined else f"CASE WHEN coupon_code IN ({COUPONS}) THEN CAST(first_total AS DECIMAL(18,4)) END"
    joins = f"LEFT JOIN hourly_special USING ({KEY})" if joined else ""
    n = "COUNT(DISTINCT order_id)"
    return f"""
  SELECT cluster, hr, dt, {n} AS total_opd,
    {r(div(f"COUNT(DISTINCT CASE WHEN banner_factor > {P.banner_threshold} THEN order_id END)", n) + " * 100", 1)} AS ob_pct,
    {r(div(f"SUM({m('order_bill')})", n), 0)} AS amv,
    {r(div(f"SUM({CDPO})", n), 2)} AS cdpo_po,
    {r(div(f"SUM({SDPO})", n), 2)} AS sdpo_po,
    {r(div(f"SUM({RDPO})", n), 2)} AS rdpo_po,
    {r(div(f"SUM({PLATFORM})", n), 2)} AS total_platform_po,
    {r(div("SUM(COALESCE(targeted, 0))", n), 2)} AS targeted_po,
    {r(div(f"SUM(COALESCE({special}, 0))", n), 2)} AS special_po
  FROM hourly_rows LEFT JOIN hourly_targeted USING ({KEY}) {joins}
  GROUP BY cluster, hr, dt"""


CTES["kpis"] = _kpis(joined=True)
CTES["kpis_inline"] = _kpis(joined=False)

CTES["traffic_buckets"] = f"""
  SELECT CAST(date_trunc('hour', moment) AS DATE) AS dt, CAST(hour(moment) AS INTEGER) AS hr,
    CASE WHEN user_id % 2 = 1 THEN lower(n_name) ELSE n_name END AS city,
    CASE user_id % 3 WHEN 0 THEN 'Android' WHEN 1 THEN 'iOS' ELSE 'Web' END AS platform,
    CASE WHEN n_nationkey < 5 THEN 'class_1' WHEN n_nationkey < 15 THEN 'class_2' ELSE 'class_3' END AS classification,
    COUNT(*) FILTER (WHERE now_side) AS sessions, COUNT(*) FILTER (WHERE NOT now_side) AS lw_sessions,
    COUNT(*) FILTER (WHERE now_side AND event_type = 'purchase') AS conv_sessions,
    COUNT(*) FILTER (WHERE NOT now_side AND event_type = 'purchase') AS lw_conv_sessions
  FROM (
    SELECT *, ts AS moment, TRUE AS now_side FROM events WHERE CAST(ts AS DATE) = {TODAY} AND ts <= {NOW}
    UNION ALL
    SELECT *, ts + INTERVAL 7 DAY, FALSE FROM events WHERE CAST(ts AS DATE) = {LAST_WEEK}
  ) e JOIN nation ON n_nationkey = user_id % 25
  GROUP BY ALL"""
CTES["cluster_classes"] = "SELECT * FROM (VALUES {}) v(cluster, classification)".format(
    ", ".join(f"('{c}', '{k}')" for c, k in retail.CLUSTER_CLASSES)
)
CTES["app_traffic"] = f"""
  SELECT * FROM traffic_buckets JOIN cluster_classes USING (classification)
  WHERE dt = {TODAY} AND platform IN ('Android', 'iOS')"""
_TRAFFIC_SUMS = ", ".join(f"CAST(SUM({t}) AS BIGINT) AS {t}" for t in TRAFFIC_MEASURES)
CTES["by_hour"] = f"SELECT cluster, hr, {_TRAFFIC_SUMS} FROM app_traffic GROUP BY cluster, hr"
CTES["by_city"] = (
    f"SELECT cluster, lower(city) AS city_key, hr, {_TRAFFIC_SUMS} FROM app_traffic GROUP BY cluster, lower(city), hr"
)
CTES["by_state"] = f"""
  SELECT cluster, c.state, hr, {_TRAFFIC_SUMS}
  FROM app_traffic t JOIN cities c ON lower(c.city) = lower(t.city) GROUP BY cluster, c.state, hr"""


def _rate(side: str, name: str) -> str:
    return f"({side}.total_platform_po - {side}.special_po)" if name == "residual" else f"{side}.{name}"


def _triple(tw: str, lw: str, metric) -> list[str]:
    raw = growth(tw, lw) if metric.change_kind == "growth" else f"{tw} - {lw}"
    return [
        f"{r(tw, metric.digits)} AS {metric.tw}",
        f"{r(lw, metric.digits)} AS {metric.lw}",
        f"{r(raw, metric.change_digits)} AS {metric.change}",
    ]


def _traffic_triple(prefix: str = "") -> list[str]:
    s, ls, c, lc = (f"{prefix}{t}" for t in TRAFFIC_MEASURES)
    return [
        f"{s} AS sessions",
        f"{ls} AS lw_sessions",
        f"{r(growth(s, ls), 1)} AS traffic_gr",
        f"{r(div(c, s) + ' * 100', 2)} AS cvr",
        f"{r(div(lc, ls) + ' * 100', 2)} AS lw_cvr",
        f"{r(f'({div(c, s)} - {div(lc, ls)}) * 100', 2)} AS cvr_chg",
    ]


_detail = ["tw.total_opd", "lw.total_opd AS lw_opd", f"{r(growth('tw.total_opd', 'lw.total_opd'), 1)} AS opd_gr"]
_detail += _traffic_triple("t.")
for _metric in RATE_METRICS:
    _detail += _triple(_rate("tw", _metric.tw), _rate("lw", _metric.tw), _metric)
CTES["wow"] = f"""
  SELECT tw.cluster, CAST(tw.hr AS VARCHAR) AS hr,
  {listed(_detail)}, t.conv_sessions, t.lw_conv_sessions
  FROM kpis tw
  LEFT JOIN kpis lw ON lw.cluster = tw.cluster AND lw.hr = tw.hr AND lw.dt = {LAST_WEEK}
  LEFT JOIN by_hour t ON t.cluster = tw.cluster AND t.hr = tw.hr
  WHERE tw.dt = {TODAY}"""

_sums = [f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in ("total_opd", "lw_opd", *TRAFFIC_MEASURES)]
_sums += [f"{div(f'SUM({x.tw} * total_opd)', 'SUM(total_opd)')} AS {x.tw}" for x in RATE_METRICS]
_sums += [f"{div(f'SUM({x.lw} * lw_opd)', 'SUM(lw_opd)')} AS {x.lw}" for x in RATE_METRICS]
CTES["wow_sums"] = f"""
  SELECT k.cluster, {listed(_sums)}
  FROM (SELECT DISTINCT cluster FROM cluster_dim) k LEFT JOIN wow USING (cluster) GROUP BY k.cluster"""
_total = ["total_opd", "lw_opd", f"{r(growth('total_opd', 'lw_opd'), 1)} AS opd_gr", *_traffic_triple()]
for _metric in RATE_METRICS:
    _total += _triple(_metric.tw, _metric.lw, _metric)
CTES["report"] = f"""
  SELECT cluster, {", ".join(hourly_columns())}, CAST(hr AS INTEGER) AS pos FROM wow
  UNION ALL BY NAME
  SELECT cluster, 'Overall' AS hr, {listed(_total)}, 999 AS pos FROM wow_sums"""


def _group_facts(name: str, traffic: str, traffic_key: str) -> str:
    joined_traffic = ", ".join(f"CAST(MAX(COALESCE(t.{c}, 0)) AS BIGINT) AS {c}" for c in TRAFFIC_MEASURES)
    return f"""
  SELECT b.cluster, grp, b.hr, b.dt, COUNT(DISTINCT order_id) AS orders,
    COUNT(DISTINCT CASE WHEN coupon_code <> '' THEN order_id END) AS coupon_orders,
    SUM({CDPO}) AS cdpo_sum, SUM({SDPO}) AS sdpo_sum, SUM({RDPO}) AS rdpo_sum, SUM({PLATFORM}) AS platform_sum,
    SUM({m("platform_discount_hit")}) AS campaign_sum, SUM(COALESCE(targeted, 0)) AS targeted_sum,
    SUM(COALESCE(special, 0)) AS special_sum, {joined_traffic}
  FROM (SELECT * FROM {name}_rows LEFT JOIN {name}_targeted USING ({KEY}) LEFT JOIN {name}_special USING ({KEY})) b
  LEFT JOIN {traffic} t
    ON t.cluster = b.cluster AND {traffic_key} = lower(b.grp) AND t.hr = b.hr AND b.dt = {TODAY}
  GROUP BY b.cluster, grp, b.hr, b.dt"""


CTES["city_facts"] = _group_facts("city", "by_city", "t.city_key")
CTES["state_facts"] = _group_facts("state", "by_state", "lower(t.state)")


def _pack(prefix: str) -> dict[str, str]:
    """Ratio pack over columns with a prefix; last week's traffic comes from today's side."""
    n = f"{prefix}orders"
    sessions, conv = (
        ("tw_lw_sessions", "tw_lw_conv_sessions")
        if prefix == "lw_"
        else (f"{prefix}sessions", f"{prefix}conv_sessions")
    )
    per = {
        "cdpo": "{p}cdpo_sum",
        "sdpo": "{p}sdpo_sum",
        "rdpo": "{p}rdpo_sum",
        "residual": "({p}platform_sum - {p}special_sum)",
        "special": "{p}special_sum",
        "targeted": "{p}targeted_sum",
        "campaign": "{p}campaign_sum",
    }
    pack = {"orders": f"CAST({n} AS BIGINT)", "oc_pct": r(div(f"{prefix}coupon_orders", n) + " * 100", 1)}
    pack |= {name: r(div(total.format(p=prefix), n), 2) for name, total in per.items()}
    pack |= {"sessions": f"CAST({sessions} AS BIGINT)", "cvr": r(div(conv, sessions) + " * 100", 2)}
    return pack


def _sides() -> str:
    packs = {"tw": _pack("tw_"), "lw": _pack("lw_")}
    return listed(f"{packs[s][name]} AS {s}_{name}" for s in packs for name in GROUP_METRICS)


def _summary_change(name: str) -> str:
    tw, lw = f"tw_{name}", f"lw_{name}"
    return f"{r(growth(tw, lw), 1) if name in GROWTH_METRICS else r(f'{tw} - {lw}', 2)} AS d_{name}"


def _group_ctes(name: str) -> None:
    days = {"tw": TODAY, "lw": LAST_WEEK}
    CTES[f"{name}_sums"] = f"""
  SELECT cluster, COALESCE(NULLIF(grp, ''), 'Unknown') AS grp, COALESCE(hr, -1) AS hr, dt,
    {", ".join(f"SUM(COALESCE({c}, 0)) AS {c}" for c in GROUP_MEASURES)}
  FROM {name}_facts GROUP BY ALL"""
    for scope, keys in (("all_hours", "cluster, grp"), ("by_cell", "cluster, grp, hr")):
        both = listed(
            f"COALESCE(SUM({c}) FILTER (WHERE dt = {day}), 0) AS {side}_{c}"
            for side, day in days.items()
            for c in GROUP_MEASURES
        )
        CTES[f"{name}_{scope}"] = f"SELECT {keys}, {both} FROM {name}_sums GROUP BY {keys}"
    CTES[f"{name}_summary"] = f"""
  SELECT *, {listed(_summary_change(c) for c in GROUP_METRICS)}
  FROM (SELECT cluster, grp, {_sides()} FROM {name}_all_hours)"""
    CTES[f"{name}_cells"] = f"""
  SELECT g.cluster, g.grp, h.hr,
    {listed(f"COALESCE({s}_{c}, 0) AS {s}_{c}" for s in days for c in GROUP_MEASURES)}
  FROM (SELECT DISTINCT cluster, grp FROM {name}_sums) g
  JOIN (SELECT DISTINCT cluster, hr FROM {name}_sums WHERE hr >= 0) h USING (cluster)
  LEFT JOIN {name}_by_cell c ON c.cluster = g.cluster AND c.grp = g.grp AND c.hr = h.hr"""
    CTES[f"{name}_grid"] = f"SELECT cluster, grp, hr, {_sides()} FROM {name}_cells"


_group_ctes("city")
_group_ctes("state")

CTES["metric_rows"] = "\n  UNION ALL ".join(
    f"SELECT cluster, hr, '{x.section}' AS section, '{x.name}' AS metric, {str(x.inverted).upper()} AS inverted, "
    f"CAST({x.tw} AS DOUBLE) AS value, CAST({x.lw} AS DOUBLE) AS lw, CAST({x.change} AS DOUBLE) AS change FROM report"
    for x in HOURLY_METRICS
)


def _direction(neutral: str) -> str:
    return (
        f"CASE WHEN change IS NULL THEN 'na' WHEN {neutral} THEN 'neu' "
        "WHEN (change > 0) <> inverted THEN 'pos' ELSE 'neg' END"
    )


def _pivot(metric: str) -> str:
    def cell(hour: int) -> list[str]:
        tw, lw = (f"CAST(MAX({s}_{metric}) FILTER (WHERE hr = {hour}) AS DOUBLE)" for s in ("tw", "lw"))
        d = r(f"{tw} - {lw}", 2)
        if metric in GROWTH_METRICS:
            d = f"CASE WHEN {lw} <> 0 THEN {r(growth(tw, lw), 2)} ELSE {d} END"
        return [f"{tw} AS h{hour}_tw", f"{lw} AS h{hour}_lw", f"{d} AS h{hour}_d"]

    columns = listed(c for hour in range(24) for c in cell(hour))
    return f"SELECT cluster, grp, {columns} FROM city_grid GROUP BY cluster, grp"


def _heat(metric: str, above: str, below: str) -> str:
    return f"""
SELECT g.cluster, g.grp, g.hr, CAST(g.tw_{metric} AS DOUBLE) AS value,
  CASE WHEN g.tw_{metric} IS NULL OR a.total IS NULL THEN ''
    WHEN abs(CAST(g.tw_{metric} AS DECIMAL(18,2)) * a.n - a.total) < a.total * 0.05 THEN ''
    WHEN CAST(g.tw_{metric} AS DECIMAL(18,2)) * a.n > a.total THEN '{above}' ELSE '{below}' END AS tag
FROM city_grid g LEFT JOIN (
  SELECT cluster, grp, SUM(CAST(tw_{metric} AS DECIMAL(18,2))) AS total, COUNT(*) AS n
  FROM city_grid WHERE tw_{metric} > 0 GROUP BY cluster, grp
) a USING (cluster, grp)"""


def _matrix() -> str:
    def side(name: str, column: str) -> str:
        hours = ", ".join(f"MAX({column}) FILTER (WHERE hr = '{h}') AS h{h}" for h in range(24))
        return (
            f"SELECT cluster, metric, '{name}' AS side, MAX({column}) FILTER (WHERE hr = 'Overall') AS overall, "
            f"{hours} FROM metric_rows GROUP BY cluster, metric"
        )

    return " UNION ALL ".join(side(*s) for s in (("tw", "value"), ("lw", "lw"), ("delta", "change")))


def _reagg() -> str:
    hours = ", ".join(map(str, catalog.PICKED_HOURS))

    def total(c: str) -> str:
        return f"CAST(SUM({c}) AS BIGINT) AS {c}"

    def mean(s: str) -> str:
        return f"NULLIF({div(f'SUM(COALESCE({s}_cvr, 0) * {s}_sessions)', f'SUM({s}_sessions)')}, 0) AS {s}_mean"

    return f"""
SELECT cluster, grp, tw_orders, lw_orders, {r(growth("tw_orders", "lw_orders"), 2)} AS d_orders,
  tw_sessions, lw_sessions, {r(growth("tw_sessions", "lw_sessions"), 2)} AS d_sessions,
  {r("tw_mean", 2)} AS tw_cvr, {r("lw_mean", 2)} AS lw_cvr, {r("tw_mean - lw_mean", 2)} AS d_cvr
FROM (
  SELECT cluster, grp, {total("tw_orders")}, {total("lw_orders")}, {total("tw_sessions")}, {total("lw_sessions")},
    {mean("tw")}, {mean("lw")}
  FROM city_grid WHERE hr IN ({hours}) GROUP BY cluster, grp
)"""


def _plain_facts(facts: str, label: str) -> str:
    money = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MONEY_MEASURES)
    counts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("orders", "coupon_orders", *TRAFFIC_MEASURES))
    order = "dt NULLS FIRST, grp NULLS FIRST, hr NULLS FIRST"
    pos = f"CAST(ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY {order}) AS INTEGER) AS pos"
    placed = f", {pos}" if label != "grp" else ""
    return f"SELECT cluster, grp AS {label}, hr, dt, {counts}, {money}{placed} FROM {facts}"


_HOURLY = ", ".join(hourly_columns())
_GRID = ", ".join(f"{s}_{c}" for s in ("tw", "lw") for c in GROUP_METRICS)
_SUMMARY = ", ".join(f"{s}_{c}" for s in ("tw", "lw", "d") for c in GROUP_METRICS)
_DAY_KPIS = "total_opd, ob_pct, amv, cdpo_po, sdpo_po, rdpo_po, total_platform_po, targeted_po, special_po"
_MINUTES = f"date_sub('minute', created_on, {NOW})"
_DAYPART = (
    "CASE WHEN hr < 6 THEN 'late_night' WHEN hr < 12 THEN 'morning' WHEN hr < 15 THEN 'lunch' "
    "WHEN hr < 18 THEN 'afternoon' ELSE 'dinner' END"
)

FINAL: dict[str, str] = {
    "order_base": f"SELECT hr, dt, order_id, city_code, {MONEY_LIST} FROM day_orders",
    "cluster_members": "SELECT cluster, COUNT(*) AS cities FROM cluster_dim GROUP BY cluster",
    "cluster_filter": "SELECT cluster, order_id, city_code FROM clustered",
    "cluster_slug": """
SELECT request_id, label, CASE WHEN slug IN ('tier_1', 'tier_2', 'tier_3', 'tier_next') THEN slug ELSE 'tier_next' END
  AS cluster
FROM (
  SELECT request_id, label, replace(replace(lower(label), ' ', '_'), '+', '_') AS slug
  FROM (
    SELECT c_custkey AS request_id, 'Tier' || CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN '+' ELSE '_' END
      || CASE WHEN c_custkey % 5 = 4 THEN 'Next' ELSE CAST(c_custkey % 5 AS VARCHAR) END AS label
    FROM customer
  )
)""",
    "time_cutoff": "SELECT cluster, order_id, dt, hr, max_hms FROM comparable",
    "dedup_base": f"""
SELECT {KEY}, coupon_code, banner_factor, {MONEY_LIST},
  CAST(CASE WHEN first_total IS NULL THEN 0 ELSE 1 END AS BIGINT) AS totals
FROM hourly_rows""",
    "explode_offers": """
SELECT order_id, hr, dt, l_partkey AS offer_id, l_quantity AS discount
FROM day_orders JOIN lineitem ON l_orderkey = order_id""",
    "targeted_offers": "SELECT offer_id, template_id FROM offers",
    "targeted_spend": """
SELECT order_id, hr, dt, CAST(SUM(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS targeted_spend
FROM day_orders JOIN lineitem ON l_orderkey = order_id JOIN offers ON offer_id = l_partkey
GROUP BY order_id, hr, dt""",
    "special_spend": f"""
SELECT order_id, hr, dt, CASE WHEN coupon_code IN ({COUPONS}) THEN CAST(first_total AS DOUBLE) END AS special_spend
FROM day_orders""",
    "hourly_kpis": f"SELECT cluster, hr, dt, {_DAY_KPIS} FROM kpis",
    "special_inline": f"SELECT cluster, hr, dt, {_DAY_KPIS} FROM kpis_inline",
    "traffic_hourly": "SELECT * FROM by_hour",
    "traffic_city": "SELECT * FROM by_city",
    "traffic_state": "SELECT * FROM by_state",
    "hourly_wow": f"SELECT cluster, {_HOURLY} FROM wow",
    "hourly_overall": f"SELECT cluster, {_HOURLY}, pos FROM report",
    "report_meta": f"""
SELECT cluster, '{P.as_of_text}' AS as_of, COALESCE(MAX(CASE WHEN pos < 999 THEN pos END), 0) AS latest_hr,
  COUNT(*) FILTER (WHERE pos < 999) AS detail_rows, BOOL_OR(pos = 999) AS has_total
FROM report GROUP BY cluster""",
    "partial_hour": """
SELECT cluster, hr, CAST(hr AS INTEGER) = (SELECT MAX(CAST(x.hr AS INTEGER)) FROM wow x WHERE x.cluster = wow.cluster)
  AS is_partial
FROM wow""",
    "daypart_rollup": f"""
SELECT cluster, {_DAYPART} AS daypart, dt, CAST(SUM(total_opd) AS BIGINT) AS total_opd
FROM kpis GROUP BY ALL""",
    "metric_hour_matrix": _matrix(),
    "kpi_list": f"""
SELECT cluster, section, metric, value, lw, change, {_direction("change = 0")} AS direction
FROM metric_rows WHERE hr = 'Overall'""",
    "change_direction": f"""
SELECT cluster, hr, metric, change, {_direction("change = 0")} AS direction,
  {_direction("abs(change) < 0.005")} AS direction_band
FROM metric_rows WHERE hr <> 'Overall'""",
    "city_base": "SELECT cluster, order_id, hr, dt, grp AS city FROM city_rows",
    "city_hourly": _plain_facts("city_facts", "city"),
    "state_hourly": _plain_facts("state_facts", "state"),
    "group_hour_sums": _plain_facts("city_sums", "grp"),
    "group_keys": "SELECT DISTINCT cluster, grp FROM city_sums",
    "group_ratios": "SELECT cluster, grp, hr, dt, {}, {} FROM city_sums".format(
        ", ".join(f"{column} AS {name}" for name, column in _pack("").items()),
        f"CAST(lw_sessions AS BIGINT) AS lw_sessions, {r(div('lw_conv_sessions', 'lw_sessions') + ' * 100', 2)} AS lw_cvr",
    ),
    "group_summary": f"SELECT cluster, grp, {_SUMMARY} FROM city_summary",
    "state_summary": f"SELECT cluster, grp, {_SUMMARY} FROM state_summary",
    "group_hour_grid": f"SELECT cluster, grp, hr, {_GRID} FROM city_grid",
    "state_hour_grid": f"SELECT cluster, grp, hr, {_GRID} FROM state_grid",
    "nested_unfolded": f"""
SELECT cluster, grp, CAST(ROW_NUMBER() OVER (PARTITION BY cluster, grp ORDER BY hr) - 1 AS INTEGER) AS slot, hr, {_GRID}
FROM city_grid""",
    "group_rank": """
SELECT cluster, grp, tw_orders AS orders,
  CAST(ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY tw_orders DESC, grp) AS INTEGER) AS pos
FROM city_summary""",
    "filter_groups": "SELECT cluster, grp, {} FROM state_summary WHERE grp IN ({})".format(
        _SUMMARY, ", ".join(f"'{g}'" for g in catalog.PICKED_GROUPS)
    ),
    "hour_reagg": _reagg(),
    "sort_nulls_last": f"""
SELECT cluster, grp, {catalog.SORT_COLUMN} AS value,
  CAST(ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY {catalog.SORT_COLUMN} ASC NULLS LAST, grp) AS INTEGER) AS pos_asc,
  CAST(ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY {catalog.SORT_COLUMN} DESC NULLS LAST, grp) AS INTEGER) AS pos_desc
FROM city_summary""",
    "pivot_metric": _pivot("orders"),
    "pivot_metric_cvr": _pivot("cvr"),
    "heat_tag": _heat("cdpo", "good", "bad"),
    "heat_tag_inverted": _heat("oc_pct", "bad", "good"),
    "share_of_total": f"""
SELECT cluster, grp AS city, CAST(SUM(orders) AS BIGINT) AS orders,
  {r(div("SUM(orders)", "SUM(SUM(orders)) OVER (PARTITION BY cluster)") + " * 100", 1)} AS share_pct
FROM city_facts WHERE dt = {TODAY} GROUP BY cluster, grp""",
    "status_tier": f"""
SELECT cluster, grp AS city, hr, orders, CASE WHEN orders > {catalog.TIERS["critical"]} THEN 'CRITICAL'
  WHEN orders > {catalog.TIERS["warning"]} THEN 'WARNING' ELSE 'NORMAL' END AS status
FROM city_facts WHERE dt = {TODAY}""",
    "peak_hour": f"""
SELECT cluster, grp AS city, hr AS peak_hr, orders AS peak_orders
FROM city_facts WHERE dt = {TODAY}
QUALIFY ROW_NUMBER() OVER (PARTITION BY cluster, grp ORDER BY orders DESC, hr DESC) = 1""",
    "trailing_hours": f"""
SELECT cluster, grp AS city, hr, tw_orders AS orders,
  array_to_string(list(CAST(tw_orders AS VARCHAR)) OVER w, ',') AS series,
  {r("AVG(tw_orders) OVER w", 2)} AS avg_7
FROM city_grid WINDOW w AS (PARTITION BY cluster, grp ORDER BY hr RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "delayed_count": f"""
SELECT city_code, COUNT(*) FILTER (WHERE {_MINUTES} > 10) AS delayed, COUNT(*) FILTER (WHERE {_MINUTES} > 12) AS high,
  COUNT(*) FILTER (WHERE {_MINUTES} > 8 AND {_MINUTES} <= 12) AS medium
FROM day_orders WHERE dt = {TODAY} GROUP BY city_code""",
    "latest_n": """
SELECT order_id, created_on, CAST(ROW_NUMBER() OVER (ORDER BY created_on DESC, order_id) AS INTEGER) AS pos
FROM day_orders ORDER BY created_on DESC, order_id LIMIT 12""",
    "snapshot_roundtrip": f"SELECT cluster, {_HOURLY}, pos, '{P.as_of_text}' AS as_of FROM report",
    "snapshot_kinds": f"""
SELECT 'city' AS kind, '{P.as_of_text}' AS as_of, cluster, grp, {_SUMMARY} FROM city_summary
UNION ALL SELECT 'state', '{P.as_of_text}', cluster, grp, {_SUMMARY} FROM state_summary""",
    "snapshot_one_clock": f"""
SELECT 'hourly' AS kind, cluster, hr AS name, total_opd AS orders, '{P.as_of_text}' AS as_of FROM report
UNION ALL SELECT 'city', cluster, grp, tw_orders, '{P.as_of_text}' FROM city_summary
UNION ALL SELECT 'state', cluster, grp, tw_orders, '{P.as_of_text}' FROM state_summary""",
    "hourly_rollup": f"SELECT cluster, {_HOURLY}, pos FROM report",
    "hourly_bucketed": f"SELECT cluster, {_HOURLY}, pos FROM report",
    "offers_sliding": f"""
SELECT DISTINCT CAST({TODAY} - back AS DATE) AS day, offer_id, template_id
FROM offer_events, (VALUES {", ".join(f"({back})" for back in catalog.SLIDING_DAYS[1:])}) d(back)
WHERE dt >= {TODAY} - back - {P.lookback_days} AND dt <= {TODAY} - back AND template_id IN ({TEMPLATES})""",
    "incremental_delta": f"SELECT cluster, {_HOURLY}, pos FROM report",
    "incremental_refresh": f"SELECT cluster, {_HOURLY}, pos FROM report",
    "incremental_refresh_steps": f"SELECT cluster, {_HOURLY}, pos FROM report",
    "snapshot_one_cluster": f"SELECT cluster, {_HOURLY}, pos, '{P.as_of_text}' AS as_of FROM report WHERE cluster = 'tier_2'",
    "snapshot_emptied": f"SELECT cluster, {_HOURLY}, pos, '{P.as_of_text}' AS as_of FROM report WHERE cluster <> 'tier_2'",
    "hourly_kpis_nested": f"SELECT cluster, hr, dt, {_DAY_KPIS} FROM kpis",
    "city_hourly_nested": _plain_facts("city_facts", "city"),
    "nested_hourly": """
SELECT cluster, grp, CAST(COUNT(*) AS INTEGER) AS n_hours,
  string_agg(concat_ws('/', hr, tw_orders, lw_orders, tw_cvr, lw_cvr), ' ' ORDER BY hr) AS hours_text
FROM city_grid GROUP BY cluster, grp""",
    "scalar_functions": f"""
SELECT order_id, hr AS hour_of, strftime(created_on, '%H:%M:%S') AS time_of_day, {TODAY} AS today,
  {TODAY} - 7 AS last_week, lower(coupon_code) AS lower_code, COALESCE(platform_discount_hit, 0) AS hit_or_zero,
  NULLIF(coupon_code, '') AS code_or_null,
  CAST(ROUND(CAST(order_bill AS DECIMAL(18,2)), 1) AS DOUBLE) AS bill_1dp,
  CAST(hr AS VARCHAR) AS hr_text, hr AS hr_int, TRY_CAST(first_total AS DOUBLE) AS first_total,
  coupon_code IS NOT NULL AND coupon_code <> '' AS has_coupon,
  CASE WHEN dt = {TODAY} THEN 'today' ELSE 'last week' END AS day_label,
  coupon_code IN ('1-URGENT', '2-HIGH') AS is_listed, order_id / NULLIF(city_code, 0) AS quotient, dt AS date_prefix,
  abs(COALESCE(platform_discount_hit, 0) - platform_discount) AS distance
FROM order_facts""",
}


def _at(statement_now: str, hour: int, minute: int) -> str:
    """A statement with its clock set to another time of the day."""
    then = P.as_of.replace(hour=hour, minute=minute).strftime("%Y-%m-%d %H:%M:%S")
    return statement_now.replace(f"'{P.as_of_text}'", f"'{then}'")


_COPIES = {"bill_sum": m("order_bill"), "cdpo_sum": CDPO, "sdpo_sum": SDPO, "rdpo_sum": RDPO, "platform_sum": PLATFORM}
_COPIES |= {"campaign_sum": m("platform_discount_hit"), "special_sum": "COALESCE(special, 0)", "targeted_sum": "COALESCE(targeted, 0)"}


def _at_clocks() -> str:
    """Hourly counts and sums of both days at each of the clocks, every copy counted as it is met."""
    sums = ", ".join(f"CAST(SUM({amount}) AS DOUBLE) AS {name}" for name, amount in _COPIES.items())
    now = statement(f"""
SELECT '{P.as_of_text}' AS as_of, cluster, hr, dt, COUNT(DISTINCT order_id) AS orders,
  COUNT(DISTINCT CASE WHEN banner_factor > {P.banner_threshold} THEN order_id END) AS banner_orders, {sums}
FROM hourly_rows LEFT JOIN hourly_targeted USING ({KEY}) LEFT JOIN hourly_special USING ({KEY})
GROUP BY cluster, hr, dt""")
    return " UNION ALL ".join(f"SELECT * FROM ({_at(now, *clock)})" for clock in catalog.STEP_TIMES)


def _before_refresh() -> str:
    """The stored report at 11:00 for all clusters but the refreshed one."""
    now = statement(f"SELECT cluster, {_HOURLY}, pos, '{P.as_of_text}' AS as_of FROM report")
    then = _at(now, 11, 0)
    (one,) = P.for_cluster(catalog.REFRESHED_CLUSTER).clusters
    return (
        f"SELECT * FROM ({now}) WHERE cluster = '{one}' UNION ALL BY NAME "
        f"SELECT * FROM ({then}) WHERE cluster <> '{one}'"
    )


def statement(final: str) -> str:
    """``final`` with the named subqueries it needs, in order of definition."""
    needed: set[str] = set()
    pending = [final]
    while pending:
        text = pending.pop()
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN) {name}\b", text):
                needed.add(name)
                pending.append(body)
    parts = ",\n".join(f"{name} AS ({body})" for name, body in CTES.items() if name in needed)
    return f"WITH {parts}\n{final.strip()}" if parts else final.strip()


def _all_reports() -> str:
    hours = f"""
SELECT cluster, 'hourly' AS kind, CAST(NULL AS VARCHAR) AS grp, NULLIF(pos, 999) AS hr, {TODAY} AS dt, total_opd AS orders,
  amv AS bills, cdpo_po AS cdpo, targeted_po AS targeted, special_po AS special,
  CAST(NULL AS BIGINT) AS coupon_orders, CAST(NULL AS BIGINT) AS sessions
FROM report"""
    groups = [
        f"""
SELECT cluster, '{kind}', grp, hr, dt, orders, NULL, CAST(cdpo_sum AS DOUBLE), CAST(targeted_sum AS DOUBLE),
  CAST(special_sum AS DOUBLE), coupon_orders, sessions FROM {kind}_facts"""
        for kind in ("city", "state")
    ]
    return " UNION ALL ".join([hours, *groups])


def statements() -> dict[str, str]:
    return {name: statement(final) for name, final in FINAL.items()} | {
        "snapshot_refresh_one": _before_refresh(),
        "cutoff_prefix": _at_clocks(),
        "all_reports": statement(_all_reports()),
        "all_reports_nested": statement(_all_reports()),
    }
