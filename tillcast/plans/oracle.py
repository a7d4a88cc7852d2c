"""Independent SQL (DuckDB dialect) for the correctness gate.

The SQL follows the reference's steps literally (line-level windows, a join to
fill the grid, and so on), while the Spark jobs use cheaper equivalent forms
(day-level minimum against item maximum, in-row grid expansion). Agreement of
the two is the check.

Tables available to the SQL: ``lineitem``, ``part``, ``events`` and the other
supplied parquet tables. Retail views are CTEs: ``txn`` (orders), ``items_v``,
``infos_v``.
"""

from __future__ import annotations

import math
from dataclasses import replace

from tillcast.sources.fixtures import (EVENTS_CALENDAR, LINEITEM_CALENDAR, LINEITEM_DAYS, PROMO_ONE_DATE,
                                       PROMO_TWO_DATES, ZERO_PRICE_EVERY, Calendar)


def rn(x: str, places: int) -> str:
    """SQL twin of ``round_half_even``."""
    return f"(round_even(({x}) * {float(10 ** places)!r}, 0) / {float(10 ** places)!r})"


def xsum(x: str, places: int = 6, over: str = "") -> str:
    """SQL twin of ``exact_sum``."""
    return f"CAST(sum(CAST({x} AS DECIMAL(24,{places}))) {over} AS DOUBLE)"


def xavg(x: str, places: int = 6, over: str = "") -> str:
    """SQL twin of ``exact_avg``."""
    return f"({xsum(x, places, over)} / nullif(count({x}) {over}, 0))"


def r2(x: str) -> str:
    """Half-even rounding to 2 decimals, the SQL twin of ``round2``."""
    return rn(x, 2)


def dbl(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def d(s: str) -> str:
    return f"DATE '{s}'"


def div(a: str, b: str) -> str:
    """Division that is NULL for a zero divisor (Spark ``try_divide``)."""
    return f"(({a}) / nullif(({b}), 0))"


# --- fixture views ----------------------------------------------------------------

def lineitem_txn(cal: Calendar | None = LINEITEM_CALENDAR) -> str:
    inside = "" if cal is None else f"""
  WHERE l_shipdate >= CAST({d(cal.train_start)} AS TIMESTAMP)
    AND l_shipdate < CAST({d(cal.test_end)} + INTERVAL 1 DAY AS TIMESTAMP)"""
    return f"""txn AS (
  SELECT l_shipdate AS time, l_partkey AS itemID, CAST(l_quantity AS INT) AS "order",
         CASE WHEN l_orderkey % {ZERO_PRICE_EVERY} = 0 THEN CAST(0 AS DOUBLE)
              ELSE {r2('p_retailprice * (1 - l_discount)')} END AS salesPrice
  FROM lineitem JOIN part ON l_partkey = p_partkey{inside})"""


LINEITEM_ITEMS = """items_v AS (
  SELECT p_partkey AS itemID,
         CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS INT) AS brand,
         CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS INT) % 5 AS manufacturer,
         CAST(p_size % 6 AS DOUBLE) AS customerRating,
         p_type AS category1, p_size % 10 AS category2,
         string_split(p_name, ' ')[1] AS category3,
         p_retailprice AS recommendedRetailPrice
  FROM part)"""

LINEITEM_INFOS = f"""infos_v AS (
  SELECT p_partkey AS itemID, p_retailprice AS simulationPrice,
         CASE WHEN p_partkey % 10 = 0 THEN '{PROMO_TWO_DATES}'
              WHEN p_partkey % 4 = 0 THEN '{PROMO_ONE_DATE}' END AS promotion
  FROM part)"""

EVENTS_TXN = """txn AS (
  SELECT ts AS time, user_id AS itemID, 1 AS "order", value AS salesPrice FROM events)"""

EVENTS_ITEMS = """items_v AS (
  SELECT user_id AS itemID, CAST(user_id % 7 AS INT) AS brand,
         CAST(user_id % 3 AS INT) AS manufacturer, CAST(user_id % 6 AS DOUBLE) AS customerRating,
         min(event_type) AS category1, CAST(user_id % 10 AS INT) AS category2,
         max(event_type) AS category3, max(value) AS recommendedRetailPrice
  FROM events GROUP BY user_id)"""

EVENTS_INFOS = """infos_v AS (
  SELECT itemID, recommendedRetailPrice AS simulationPrice,
         CASE WHEN itemID % 4 = 0 THEN '2024-01-31' END AS promotion
  FROM items_v)"""


class SqlFixture:
    def __init__(self, txn: str, items: str, infos: str, cal: Calendar):
        self.txn, self.items, self.infos, self.cal = txn, items, infos, cal

    def views(self) -> list[str]:
        return [self.txn, self.items, self.infos]


LINEITEM = SqlFixture(lineitem_txn(), LINEITEM_ITEMS, LINEITEM_INFOS, LINEITEM_CALENDAR)
LINEITEM_ALL = SqlFixture(lineitem_txn(None), LINEITEM_ITEMS, LINEITEM_INFOS, LINEITEM_DAYS)
# The retail calendar as one series up to the day before the forecast.
WHOLE_SERIES = SqlFixture(lineitem_txn(), LINEITEM_ITEMS, LINEITEM_INFOS,
                          replace(LINEITEM_CALENDAR, split_date=LINEITEM_CALENDAR.test_end))
EVENTS = SqlFixture(EVENTS_TXN, EVENTS_ITEMS, EVENTS_INFOS, EVENTS_CALENDAR)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- pipeline steps (reference order) -------------------------------------------

def prep(cal: Calendar) -> str:
    """Split, zero prices removed (NULL kept), order value."""
    return f"""prep AS (
  SELECT time, itemID, "order", salesPrice, CAST(time AS DATE) AS date,
         CASE WHEN CAST(time AS DATE) <= {d(cal.split_date)} THEN 'train' ELSE 'test' END AS split,
         "order" * salesPrice AS orderValue
  FROM txn WHERE salesPrice IS DISTINCT FROM 0)"""


LINES = f"""lines0 AS (
  SELECT *, max(salesPrice) OVER (PARTITION BY split, itemID) AS maxPrice,
            min(salesPrice) OVER (PARTITION BY split, itemID) AS minPrice
  FROM prep),
lines1 AS (
  SELECT *, coalesce(CAST(salesPrice < maxPrice AS INT), 0) AS promotion,
            {r2('maxPrice - salesPrice')} AS discountAmount
  FROM lines0),
lines AS (SELECT *, {r2(div('discountAmount', 'maxPrice'))} AS discountPerc FROM lines1)"""

MED = f"""med AS (
  SELECT itemID, {r2('median(discountPerc)')} AS medianDiscPerc
  FROM (SELECT DISTINCT itemID, discountPerc FROM lines
        WHERE split = 'train' AND discountAmount IS DISTINCT FROM 0)
  GROUP BY itemID)"""


def daily(price_basis: str = "price") -> str:
    today = "PriceTodayRaw" if price_basis == "price" else "sales_value"
    return f"""daily0 AS (
  SELECT split, date, itemID, CAST(sum("order") AS BIGINT) AS qty_sold,
         coalesce({xsum('orderValue')}, 0) AS sales_value, max(promotion) AS promotion,
         max(maxPrice) AS maxItemPrice, max(minPrice) AS minItemPrice,
         {xavg('salesPrice')} AS PriceTodayRaw
  FROM lines GROUP BY split, date, itemID),
daily AS (
  SELECT d.split, d.date, d.itemID, d.qty_sold, d.sales_value, d.promotion,
         d.maxItemPrice, d.minItemPrice,
         {r2(div('d.sales_value', 'd.qty_sold'))} AS PricePerEachToday,
         {r2(xavg(f'd.{today}', 10, 'OVER (PARTITION BY d.split, d.itemID)'))} AS Price,
         d.{today} AS PriceToday, m.medianDiscPerc
  FROM daily0 d LEFT JOIN med m ON d.itemID = m.itemID)"""


def calendar(cal: Calendar) -> str:
    def days(a, b):
        return f"SELECT CAST(unnest(generate_series({d(a)}, {d(b)}, INTERVAL 1 DAY)) AS DATE) AS date"
    return f"""cal AS (
  SELECT 'train' AS split, date FROM ({days(cal.train_start, cal.split_date)})
  UNION ALL
  SELECT 'test' AS split, date FROM ({days(cal.test_start, cal.test_end)}))"""


def grid(cal: Calendar) -> str:
    sale = "d.qty_sold IS DISTINCT FROM 0"
    return f"""{calendar(cal)},
gkeys AS (SELECT DISTINCT split, itemID FROM daily),
grid0 AS (SELECT k.split, k.itemID, c.date FROM gkeys k JOIN cal c ON k.split = c.split),
grid AS (
  SELECT g.split, g.date, g.itemID,
         coalesce(d.qty_sold, 0) AS qty_sold, coalesce(d.sales_value, 0) AS sales_value,
         coalesce(d.promotion, 0) AS promotion,
         coalesce(d.maxItemPrice, max(d.maxItemPrice) OVER w) AS maxItemPrice,
         coalesce(d.minItemPrice, max(d.minItemPrice) OVER w) AS minItemPrice,
         {r2(f"coalesce(d.PricePerEachToday, {xavg(f'CASE WHEN {sale} THEN d.PricePerEachToday END', 10, 'OVER w')})")} AS PricePerEachToday,
         coalesce(d.Price, max(d.Price) OVER w) AS Price,
         {r2(f"coalesce(d.PriceToday, {xavg(f'CASE WHEN {sale} THEN d.PriceToday END', 10, 'OVER w')})")} AS PriceToday,
         coalesce(d.medianDiscPerc, max(d.medianDiscPerc) OVER w) AS medianDiscPerc
  FROM grid0 g LEFT JOIN daily d ON g.split = d.split AND g.itemID = d.itemID AND g.date = d.date
  WINDOW w AS (PARTITION BY g.split, g.itemID))"""


def week_of_month(col: str, eda: bool = False) -> str:
    off = "" if eda else " - 1"
    return (f"(CAST((day({col}) + (isodow(date_trunc('month', {col})) - 1){off}) // 7 AS INT) + 1)")


def md5_key(key_parts: list[str]) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in key_parts) + "))"


def hex_fraction(h: str, start: int) -> str:
    return (f"(CAST(CAST(('0x' || substr({h}, {start}, 13)) AS BIGINT) AS DOUBLE) "
            f"/ {dbl(float(16 ** 13))})")


def uniform(key_parts: list[str]) -> str:
    return hex_fraction(md5_key(key_parts), 1)


def hex32(h: str, k: int) -> str:
    return (f"(CAST(CAST(('0x' || substr({h}, {1 + 8 * k}, 8)) AS BIGINT) AS DOUBLE) "
            f"/ {dbl(float(2 ** 32))})")


def gaussian_pair(key_parts: list[str]) -> tuple[str, str]:
    h = md5_key(key_parts)
    u = [hex32(h, k) for k in range(4)]

    def bm(u1, u2):
        return f"(sqrt({dbl(-2.0)} * ln({dbl(1.0)} - {u1})) * cos({dbl(2 * math.pi)} * {u2}))"
    return bm(u[0], u[1]), bm(u[2], u[3])


def harmonic_sql(k: int, x: str = "qty_sold") -> str:
    omega = f"({dbl(2 * math.pi * k)} / L)"
    cos_t, sin_t = f"cos({omega} * t)", f"sin({omega} * t)"
    csum = f"sum({x} * {cos_t}) OVER wi"
    ssum = f"sum({x} * {sin_t}) OVER wi"
    scale = f"(CASE WHEN L = {2 * k} THEN {dbl(1.0)} / L ELSE {dbl(2.0)} / L END)"
    return f"(CASE WHEN L > {k} THEN {scale} * ({cos_t} * {csum} + {sin_t} * {ssum}) END)"


def features(drop_incomplete: bool = True) -> str:
    lags = (1, 2, 3, 7)
    lag_cols = ",\n         ".join(
        [f"lag(qty_sold, {k}) OVER o AS qty_sold_lag{k}" for k in lags]
        + [f"lag(PricePerEachToday, {k}) OVER o AS PricePerEach_lag{k}" for k in lags]
        + [f"lag(sales_value, {k}) OVER o AS sales_value_lag{k}" for k in lags])
    harm = ",\n         ".join(f"{harmonic_sql(i + 1)} AS harmonic_{i}" for i in range(5))
    where = "WHERE " + " AND ".join(f"qty_sold_lag{k} IS NOT NULL" for k in lags) \
        if drop_incomplete else ""
    s1 = "(CASE WHEN split = 'train' THEN 22 ELSE 23 END)"
    s2 = "(CASE WHEN split = 'train' THEN 66 ELSE 67 END)"
    g1, g2 = gaussian_pair(["itemID", "date", s1, s2])
    noise = [f"{r2(g1)} AS random_noise1", f"{r2(g2)} AS random_noise2"]
    noise_cols = ",\n         ".join(noise)
    return f"""fg AS (
  SELECT g.*, i.brand, i.manufacturer, i.customerRating, i.category1, i.category2,
         i.category3, i.recommendedRetailPrice,
         CAST(isodow(g.date) AS INT) AS weekDay, CAST(day(g.date) AS INT) AS day,
         {week_of_month('g.date')} AS weekOfMonth,
         CAST(row_number() OVER (PARTITION BY g.split, g.itemID ORDER BY g.date) - 1 AS DOUBLE) AS t,
         CAST(count(*) OVER (PARTITION BY g.split, g.itemID) AS DOUBLE) AS L
  FROM grid g LEFT JOIN items_v i ON g.itemID = i.itemID),
fw AS (
  SELECT *,
         {harm},
         CAST(sum(qty_sold) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_sum_order,
         CASE WHEN count(qty_sold) OVER r = 7 THEN avg(qty_sold) OVER r END AS rolling_qty_sold_mean,
         CASE WHEN count(qty_sold) OVER r = 7 THEN stddev_samp(qty_sold) OVER r END AS rolling_qty_sold_std,
         CASE WHEN count(qty_sold) OVER r = 7 THEN CAST(median(qty_sold) OVER r AS DOUBLE) END AS rolling_qty_sold_median,
         {lag_cols}
  FROM fg
  WINDOW wi AS (PARTITION BY split, itemID),
         o AS (PARTITION BY split, itemID ORDER BY date),
         r AS (PARTITION BY split, itemID ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
feat AS (
  SELECT *,
         {noise_cols}
  FROM fw {where})"""


FEATURE_SELECT = """date, itemID, qty_sold, qty_sold_lag1, qty_sold_lag2, qty_sold_lag3, qty_sold_lag7,
  promotion, maxItemPrice, minItemPrice, Price, PriceToday, medianDiscPerc, brand, manufacturer,
  customerRating, category1, category2, category3, recommendedRetailPrice, weekDay, day,
  weekOfMonth, harmonic_0, harmonic_1, harmonic_2, harmonic_3, harmonic_4, cum_sum_order,
  rolling_qty_sold_mean, rolling_qty_sold_std, rolling_qty_sold_median, PricePerEach_lag1,
  PricePerEach_lag2, PricePerEach_lag3, PricePerEach_lag7, sales_value_lag1, sales_value_lag2,
  sales_value_lag3, sales_value_lag7, random_noise1, random_noise2, split"""


def pipeline_ctes(fx: SqlFixture, upto: str = "feat", price_basis: str = "price",
                  drop_incomplete: bool = True) -> list[str]:
    """CTE chain of E1 up to ``prep``, ``lines``, ``daily``, ``grid`` or ``feat``."""
    steps = fx.views() + [prep(fx.cal)]
    if upto == "prep":
        return steps
    steps.append(LINES)
    if upto == "lines":
        return steps
    steps += [MED, daily(price_basis)]
    if upto == "daily":
        return steps
    steps.append(grid(fx.cal))
    if upto == "grid":
        return steps
    steps.append(features(drop_incomplete))
    return steps
