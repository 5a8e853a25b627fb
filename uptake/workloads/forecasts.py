"""Forecast queries. The oracle fits each series on its dense rows with plain SQL sums."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from uptake.functions.dates import last_period
from uptake.operators import forecast as fc
from uptake.operators.rollups import value_counts
from uptake.plans import reports
from uptake.plans.variants import BATCH, DASHBOARD, DEFAULT, ForecastPolicy
from uptake.workloads import facts
from uptake.workloads.facts import CATEGORY_EV, END_YEAR, HORIZON, MONTHLY, STATE_EV, r4
from uptake.workloads.registry import query, rounded

EV = "EV_Registrations"
GROWTH = DEFAULT.forecast
MEAN = DASHBOARD.forecast
PLAIN = BATCH.forecast
# Gates no series passes, so that every one takes the fallback.
NEVER = 10**6


def _sql(
    source: str, table: str, keys: tuple[str, ...], policy: ForecastPolicy = GROWTH,
    value: str = EV, end=HORIZON, grain: str = "month",
) -> str:
    """CTEs ``fc`` (forecast rows) and ``met`` (metrics) over a table, keyed by at least one column."""
    k = ", ".join(keys)
    period = "year(Date) * 12 + month(Date) - 1" if grain == "month" else \
        "date_diff('day', DATE '1970-01-01', CAST(Date AS DATE))"
    date = (
        "make_date(p // 12, p % 12 + 1, 1)" if grain == "month"
        else "CAST(DATE '1970-01-01' + CAST(p AS INTEGER) AS DATE)"
    )
    per_year = 12 if grain == "month" else 365
    first = "coalesce(min(p) FILTER (y > 0), min(p))" if policy.trim_leading_zeros else "min(p)"
    measure, keep = f"coalesce({value}, 0)", "HAVING y >= 0"
    if policy.clip_negative:
        measure, keep = f"greatest({measure}, 0)", ""
    quadratic = "true" if not policy.adaptive_degree else f"n >= {policy.quadratic_from}"
    growth = "0.0" if policy.fallback == "mean" else f"""
      pow(1 + least(greatest(coalesce(CASE WHEN y2 > y1 THEN pow(v2 / v1, 1.0 / (y2 - y1)) - 1 END,
        {policy.default_growth / 100}), {policy.growth_limits[0]}), {policy.growth_limits[1]}),
        1.0 / {per_year}) - 1"""
    high = "r2 IS NULL OR r2 >= 0.5" if policy.high_without_fit else "r2 IS NOT NULL AND r2 >= 0.5"
    name = {"growth": "Growth Fallback", "mean": "Fallback Average"}[policy.fallback]
    modelled = f"n >= {policy.min_periods} AND pos >= {policy.min_positive}"
    cubic = policy.degree == 3 and not policy.adaptive_degree
    curve = "c.w0 + c.w1 * t + c.w2 * t * t" + (" + c.w3 * t * t * t" if cubic else "")
    constant = "(sy - w1 * t1 - w2 * t2" + (" - w3 * t3" if cubic else "") + ") / n"
    slopes = _cubic_slopes(k, policy.ridge) if cubic else f"""
  slopes AS (SELECT *,
       CASE WHEN lo = hi THEN 0 WHEN {quadratic}
            THEN (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) ELSE b1 / a11 END AS w1,
       CASE WHEN lo = hi OR NOT ({quadratic}) THEN 0
            ELSE (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) END AS w2 FROM mats),"""
    return f"""{source},
  obs AS (SELECT {k}, CAST({period} AS BIGINT) AS p,
                 CAST(sum({measure}) AS DOUBLE) AS y FROM {table} GROUP BY ALL {keep}),
  span AS (SELECT {k}, {first} AS s, max(p) AS l, count(*) FILTER (y > 0) AS positive_rows
           FROM obs GROUP BY {k}),
  cal AS (SELECT {k}, s, l, positive_rows,
                 unnest(range(s, greatest(l, {last_period(end, grain)}) + 1)) AS p FROM span),
  dense AS (SELECT {k}, s, l, positive_rows, p, CAST(p - s AS DOUBLE) AS t,
                   CASE WHEN p <= l THEN coalesce(y, 0) END AS y, {date} AS Date
            FROM cal LEFT JOIN obs USING ({k}, p)),
  annual AS (SELECT {k}, year(Date) AS yr, sum(y) AS v FROM dense GROUP BY ALL HAVING sum(y) > 0),
  ends AS (SELECT {k}, min(yr) AS y1, max(yr) AS y2, arg_min(v, yr) AS v1, arg_max(v, yr) AS v2
           FROM annual GROUP BY {k}),
  sums AS (SELECT {k}, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (y > 0) AS pos,
                  sum(t) AS t1, sum(t * t) AS t2, sum(t * t * t) AS t3, sum(t * t * t * t) AS t4,
                  sum(y) AS sy, sum(t * y) AS ty, sum(t * t * y) AS tty,
                  min(y) AS lo, max(y) AS hi, avg(y) AS mean,
                  avg(y) FILTER (p > l - {policy.base_periods}) AS base,
                  stddev_pop(y) FILTER (p > l - {policy.band_periods}) AS tail_std
           FROM dense WHERE y IS NOT NULL GROUP BY {k}),
  mats AS (SELECT *, t2 - t1 * t1 / n + {policy.ridge} AS a11, t3 - t1 * t2 / n AS a12,
                  t4 - t2 * t2 / n + {policy.ridge} AS a22, ty - t1 * sy / n AS b1,
                  tty - t2 * sy / n AS b2, {modelled} AS modelled FROM sums),{slopes}
  coef AS (SELECT *, {constant} AS w0, {growth} AS g
           FROM slopes LEFT JOIN ends USING ({k})),
  fitted AS (SELECT dense.*, c.modelled, c.base, c.g, c.tail_std, c.mean, c.lo, c.hi,
                    {curve} AS f
             FROM dense JOIN coef c USING ({k})),
  quality AS (SELECT {k}, bool_or(modelled) AS modelled, max(l) AS l,
       max(positive_rows) AS positive_rows,
       CASE WHEN bool_or(modelled) THEN CASE WHEN max(lo) = max(hi) THEN 1.0
            ELSE 1 - sum((y - f) * (y - f)) / sum((y - mean) * (y - mean)) END END AS r2,
       CASE WHEN bool_or(modelled) THEN stddev_pop(y - f) ELSE max(tail_std) END AS sd
     FROM fitted WHERE y IS NOT NULL GROUP BY {k}),
  raw AS (SELECT {k}, p, Date, y AS Actual, sd,
       CASE WHEN q.modelled THEN greatest(f, 0) WHEN y IS NOT NULL THEN y
            ELSE greatest(base * pow(1 + g, p - q.l), 0) END AS Predicted
     FROM fitted JOIN quality q USING ({k})),
  fc AS (SELECT {k}, Date, Actual, {r4('Predicted')} AS Predicted,
                {r4('greatest(Predicted - 1.96 * sd, 0)')} AS CI_Lower,
                {r4('Predicted + 1.96 * sd')} AS CI_Upper,
                CAST(year(Date) AS INTEGER) AS Year, CAST(month(Date) AS INTEGER) AS Month FROM raw),
  met AS (SELECT {k}, {r4('r2')} AS Model_Fit_Score, positive_rows AS Nonzero_EV_Months,
       strftime({date.replace('p ', 'l ').replace('(p', '(l')}, '%b %Y') AS Last_Actual_Month,
       CASE WHEN modelled THEN 'Polynomial Ridge Regression' ELSE '{name}' END AS Forecast_Method,
       CASE WHEN positive_rows >= 36 AND ({high}) THEN 'High'
            WHEN positive_rows >= 18 THEN 'Medium' ELSE 'Low' END AS Forecast_Confidence
     FROM quality)"""


def _cubic_slopes(k: str, ridge: float) -> str:
    """CTE ``slopes`` of cubics: the powers are made orthogonal on the dense rows one after the other."""
    over = f"OVER (PARTITION BY {k})"
    return f"""
  o1 AS (SELECT {k}, y, t - avg(t) {over} AS u1, t * t - avg(t * t) {over} AS x2, t * t * t - avg(t * t * t) {over} AS x3
         FROM dense WHERE y IS NOT NULL),
  o2 AS (SELECT *, sum(x2 * u1) {over} / sum(u1 * u1) {over} AS r12, sum(x3 * u1) {over} / sum(u1 * u1) {over} AS r13 FROM o1),
  o3 AS (SELECT *, x2 - r12 * u1 AS u2 FROM o2),
  o4 AS (SELECT *, sum(x3 * u2) {over} / sum(u2 * u2) {over} AS r23 FROM o3),
  o5 AS (SELECT *, x3 - r13 * u1 - r23 * u2 AS u3, r12 * r23 - r13 AS e FROM o4),
  e1 AS (SELECT {k}, max(r12) AS r12, max(r23) AS r23, max(e) AS e, sum(u1 * y) AS c1, sum(u2 * y) AS c2, sum(u3 * y) AS c3,
                sum(u1 * u1) + {ridge} AS a11, -{ridge} * max(r12) AS a12, {ridge} * max(e) AS a13,
                sum(u2 * u2) + {ridge} * (max(r12) * max(r12) + 1) AS a22, {ridge} * (-max(r12) * max(e) - max(r23)) AS a23,
                sum(u3 * u3) + {ridge} * (max(e) * max(e) + max(r23) * max(r23) + 1) AS a33 FROM o5 GROUP BY {k}),
  e2 AS (SELECT *, a22 - a12 * a12 / a11 AS b22, a23 - a12 * a13 / a11 AS b23, a33 - a13 * a13 / a11 AS b33,
                c2 - a12 * c1 / a11 AS d2, c3 - a13 * c1 / a11 AS d3 FROM e1),
  e3 AS (SELECT *, (d3 - b23 * d2 / b22) / (b33 - b23 * b23 / b22) AS z3 FROM e2),
  e4 AS (SELECT *, (d2 - b23 * z3) / b22 AS z2 FROM e3),
  e5 AS (SELECT *, (c1 - a12 * z2 - a13 * z3) / a11 AS z1 FROM e4),
  slopes AS (SELECT mats.*, CASE WHEN lo = hi THEN 0 ELSE z1 - r12 * z2 + e * z3 END AS w1,
       CASE WHEN lo = hi THEN 0 ELSE z2 - r23 * z3 END AS w2, CASE WHEN lo = hi THEN 0 ELSE z3 END AS w3
     FROM mats JOIN (SELECT {k}, r12, r23, e, z1, z2, z3 FROM e5) USING ({k})),"""


def _rows(df, keys, policy=GROWTH, end=HORIZON, grain="month", value=EV):
    scored = fc.score(df, keys, value, "Date", end, policy, grain)
    return rounded(fc.forecast_rows(scored, keys, policy, grain))


def _state_scores(spark, sf, policy=GROWTH):
    return fc.score(facts.ev_rows(spark, sf), ["State"], end=HORIZON, policy=policy)


def _category_scores(spark, sf, policy=GROWTH):
    return fc.score(facts.ev_rows(spark, sf), ["Category"], end=HORIZON, policy=policy)


def _national_scores(spark, sf, policy=GROWTH):
    return fc.score(facts.order_rows(spark, sf), end=HORIZON, policy=policy)


_STATE = _sql(STATE_EV, "state_ev", ("State",))
_CATEGORY = _sql(CATEGORY_EV, "category_ev", ("Category",))
_NATIONAL = _sql(f"{MONTHLY}, m AS (SELECT *, 1 AS k FROM monthly)", "m", ("k",))


# ---- forecast rows ------------------------------------------------------------------------

@query(f"WITH {_NATIONAL} SELECT * EXCLUDE (k) FROM fc")
def forecast_national(spark, sf):
    return _rows(facts.order_rows(spark, sf), [])


@query(f"WITH {_CATEGORY} SELECT * FROM fc")
def forecast_category(spark, sf):
    return _rows(facts.ev_rows(spark, sf), ["Category"])


@query(f"WITH {_STATE} SELECT * FROM fc")
def forecast_state(spark, sf):
    return _rows(facts.ev_rows(spark, sf), ["State"])


@query(f"WITH {_sql(STATE_EV, 'state_ev', ('State',), MEAN)} SELECT * FROM fc")
def forecast_state_untrimmed(spark, sf):
    """No trimming, always a parabola, mean fallback."""
    return _rows(facts.ev_rows(spark, sf), ["State"], MEAN)


CUBIC = replace(MEAN, degree=3)


@query(f"WITH {_sql(STATE_EV, 'state_ev', ('State',), CUBIC)} SELECT * FROM fc")
def forecast_state_cubic(spark, sf):
    """Cubics instead of parabolas."""
    return _rows(facts.ev_rows(spark, sf), ["State"], CUBIC)


@query(f"WITH {_sql(STATE_EV, 'state_ev', ('State',), CUBIC)} SELECT * FROM met")
def forecast_metrics_cubic(spark, sf):
    scores = _state_scores(spark, sf, CUBIC)
    return rounded(fc.metrics(scores, ["State"], CUBIC))


_SIGNED = f"""{STATE_EV}, signed AS (
  SELECT State, Date, EV_Registrations - 2 AS EV_Registrations FROM state_ev)"""


@query(f"""
WITH {_sql(_SIGNED, 'signed', ('State',), PLAIN)}
SELECT * EXCLUDE (CI_Lower, CI_Upper) FROM fc""")
def forecast_state_plain(spark, sf):
    """The variant without a range that drops months with a negative sum."""
    ev = facts.state_ev(spark, sf)
    return _rows(ev.withColumn(EV, F.col(EV) - 2), ["State"], PLAIN)


@query(f"WITH {_sql(_SIGNED, 'signed', ('State',))} SELECT * FROM fc")
def forecast_state_clipped(spark, sf):
    """Negative months count as 0."""
    ev = facts.state_ev(spark, sf)
    return _rows(ev.withColumn(EV, F.col(EV) - 2), ["State"])


_LATE = f"""{STATE_EV}, late AS (
  SELECT State, Date, CASE WHEN Year >= {facts.START_YEAR + 5} THEN EV_Registrations
                           ELSE 0 END AS EV_Registrations FROM state_ev)"""


@query(f"WITH {_sql(_LATE, 'late', ('State',))} SELECT * FROM fc")
def forecast_state_trimmed(spark, sf):
    """Five leading years of zeros: they are cut, and the short rest gets a straight line."""
    ev = facts.ev_rows(spark, sf)
    started = F.year("Date") >= facts.START_YEAR + 5
    return _rows(ev.withColumn(EV, F.when(started, F.col(EV)).otherwise(0.0)), ["State"])


_EVENTS = """ev AS (SELECT event_type, CAST(ts AS DATE) AS Date, CAST(count(*) AS DOUBLE) AS n
  FROM events GROUP BY ALL)"""
_EVENTS_END = dt.date(2024, 3, 31)


@query(f"""
WITH {_sql(_EVENTS, 'ev', ('event_type',), value='n', end=_EVENTS_END, grain='day')}
SELECT * FROM fc""")
def forecast_daily_events(spark, sf):
    """A daily grain and another key."""
    daily = facts.table(spark, sf, "events").select(
        "event_type", F.to_date("ts").alias("Date"), F.lit(1.0).alias("n")
    )
    return _rows(daily, ["event_type"], end=_EVENTS_END, grain="day", value="n")


_FORCED = replace(GROWTH, min_periods=NEVER)
_FORCED_MEAN = replace(MEAN, min_periods=NEVER)


@query(f"WITH {_sql(STATE_EV, 'state_ev', ('State',), _FORCED)} SELECT * FROM fc")
def forecast_fallback_growth(spark, sf):
    """Every series takes the growth fallback."""
    return _rows(facts.ev_rows(spark, sf), ["State"], _FORCED)


@query(f"WITH {_sql(STATE_EV, 'state_ev', ('State',), _FORCED_MEAN)} SELECT * FROM fc")
def forecast_fallback_mean(spark, sf):
    """Every series takes the mean fallback."""
    return _rows(facts.ev_rows(spark, sf), ["State"], _FORCED_MEAN)


_CUSTOMER = """ev AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS Date,
  CAST(count(*) AS DOUBLE) AS EV_Registrations FROM orders GROUP BY ALL)"""


def _customer_scores(spark, sf):
    orders = facts.table(spark, sf, "orders").select(
        "o_custkey", facts.month_of("o_orderdate").alias("Date"), F.lit(1.0).alias(EV)
    )
    return fc.score(orders, ["o_custkey"], end=HORIZON)


@query(f"""
WITH {_sql(_CUSTOMER, 'ev', ('o_custkey',))}
SELECT o_custkey, {r4(f'sum(Predicted) FILTER (year(Date) = {HORIZON})')}
    AS Predicted_EV_Registrations_{HORIZON},
  any_value(m.Model_Fit_Score) AS Model_Fit_Score, any_value(m.Nonzero_EV_Months) AS Nonzero_EV_Months,
  any_value(m.Forecast_Method) AS Forecast_Method,
  any_value(m.Forecast_Confidence) AS Forecast_Confidence
FROM raw JOIN met m USING (o_custkey) GROUP BY o_custkey""")
def forecast_many_series(spark, sf):
    """One sparse series per customer: models and fallbacks side by side in one plan."""
    return rounded(reports.end_year_summary(_customer_scores(spark, sf), HORIZON, key="o_custkey"))


# ---- metrics ------------------------------------------------------------------------------

@query(f"WITH {_STATE} SELECT * FROM met")
def forecast_metrics_state(spark, sf):
    metrics = fc.metrics(_state_scores(spark, sf), ["State"])
    return rounded(reports.diagnostics(metrics, "State"))


@query(f"""
WITH {_sql(STATE_EV, 'state_ev', ('State',), _FORCED_MEAN)} SELECT * FROM met""")
def forecast_metrics_strict(spark, sf):
    """Fallback series may not be graded High in this variant."""
    metrics = fc.metrics(_state_scores(spark, sf, _FORCED_MEAN), ["State"], _FORCED_MEAN)
    return rounded(reports.diagnostics(metrics, "State"))


@query(f"""
WITH {_CATEGORY} SELECT * EXCLUDE (Nonzero_EV_Months, Forecast_Confidence) FROM met""")
def forecast_metrics_category(spark, sf):
    metrics = fc.metrics(_category_scores(spark, sf), ["Category"], graded=False)
    return rounded(reports.diagnostics(metrics, "Category"))


@query(f"WITH {_STATE} SELECT Forecast_Confidence, count(*) AS Count FROM met GROUP BY 1")
def confidence_counts(spark, sf):
    return value_counts(fc.metrics(_state_scores(spark, sf), ["State"]), "Forecast_Confidence")


# ---- reports ------------------------------------------------------------------------------

_ANNUAL = f"""{_NATIONAL},
  predicted AS (SELECT CAST(year(Date) AS INTEGER) AS Year, sum(Predicted) AS v FROM raw GROUP BY 1),
  actual AS (SELECT Year, sum(EV_Registrations) AS a FROM monthly GROUP BY 1),
  joined AS (SELECT Year, v, a, lag(v) OVER (ORDER BY Year) AS before,
                    Year <= (SELECT max(Year) FROM monthly) AS past
             FROM predicted LEFT JOIN actual USING (Year)),
  outlook AS (SELECT Year, {r4('v')} AS Predicted_EV_Registrations,
                     a AS Actual_EV_Registrations,
                     CASE WHEN past THEN 'Actual' ELSE 'Forecast' END AS Data_Type,
                     {r4('(v - before) / nullif(before, 0) * 100')} AS Forecast_YoY_Growth_Percent
              FROM joined)"""


@query(f"WITH {_ANNUAL} SELECT * FROM outlook")
def annual_actual_vs_predicted(spark, sf):
    return rounded(reports.annual_outlook(_national_scores(spark, sf)))


@query(f"WITH {_ANNUAL} SELECT * FROM outlook ORDER BY Year DESC LIMIT 10")
def annual_outlook_last10(spark, sf):
    return rounded(reports.annual_outlook(_national_scores(spark, sf), last_years=10))


@query(f"""
WITH {_CATEGORY} SELECT Category, CAST(year(Date) AS INTEGER) AS Year,
  {r4('sum(Predicted)')} AS Predicted_EV_Registrations FROM raw GROUP BY ALL""")
def category_forecast_yearly(spark, sf):
    return rounded(reports.predicted_by_year(_category_scores(spark, sf), ["Category"]))


@query(f"""
WITH {_CATEGORY} SELECT {HORIZON} AS Year, Category,
  {r4('sum(Predicted)')} AS Predicted_EV_Registrations
FROM raw WHERE year(Date) = {HORIZON} GROUP BY Category""")
def category_forecast_year(spark, sf):
    return rounded(reports.category_outlook(_category_scores(spark, sf), HORIZON))


@query(f"""
WITH {_CATEGORY} SELECT Category, {r4('sum(Predicted)')} AS Predicted_EV_Registrations
FROM raw WHERE year(Date) = {HORIZON} GROUP BY Category ORDER BY 2 DESC LIMIT 1""")
def category_forecast_top(spark, sf):
    outlook = reports.category_outlook(_category_scores(spark, sf), HORIZON)
    return rounded(reports.leading(outlook, "Category"))


@query(f"""
WITH {_CATEGORY} SELECT Category, Date, Predicted FROM fc
WHERE Category IN ('1-URGENT', '5-LOW')""")
def category_forecast_selected(spark, sf):
    rows = fc.forecast_rows(_category_scores(spark, sf), ["Category"])
    chosen = rows.where(F.col("Category").isin("1-URGENT", "5-LOW"))
    return rounded(chosen.select("Category", "Date", "Predicted"))


_OUTLOOK = f"""{_STATE},
  ahead AS (SELECT State, sum(Predicted) AS v FROM raw WHERE year(Date) = {HORIZON} GROUP BY 1),
  base_year AS (SELECT State, sum(EV_Registrations) AS b FROM state_ev WHERE Year = {END_YEAR}
                GROUP BY 1),
  outlook AS (SELECT State, {HORIZON} AS Year, {r4('v')} AS Predicted_EV_Registrations,
       b AS Actual_EV_Registrations_{END_YEAR}, Model_Fit_Score, Nonzero_EV_Months,
       Last_Actual_Month, Forecast_Method, Forecast_Confidence,
       {r4('(v - b) / nullif(b, 0) * 100')} AS Growth_vs_{END_YEAR}_Percent
     FROM ahead LEFT JOIN base_year USING (State) LEFT JOIN met USING (State))"""


def _outlook(spark, sf):
    return reports.state_outlook(_state_scores(spark, sf), HORIZON, END_YEAR)


@query(f"WITH {_OUTLOOK} SELECT * FROM outlook")
def state_forecast_growth(spark, sf):
    return rounded(_outlook(spark, sf))


@query(f"""
WITH {_OUTLOOK} SELECT * FROM outlook ORDER BY Predicted_EV_Registrations DESC, State LIMIT 12""")
def state_forecast_top12(spark, sf):
    return rounded(_outlook(spark, sf).limit(12))


@query(f"""
WITH {_OUTLOOK} SELECT State, Predicted_EV_Registrations FROM outlook
ORDER BY Predicted_EV_Registrations DESC, State LIMIT 1""")
def state_forecast_leader(spark, sf):
    return rounded(reports.leading(_outlook(spark, sf), "State"))


@query(f"""
WITH {_OUTLOOK} SELECT count(DISTINCT State) AS States_Forecasted,
  count(*) FILTER (Forecast_Confidence = 'High') AS High_Confidence_States,
  (SELECT strftime(max(Date), '%b %Y') FROM state_ev) AS Latest_Actual_Month FROM outlook""")
def state_forecast_kpis(spark, sf):
    return reports.outlook_kpis(_state_scores(spark, sf), HORIZON)


_TREND = f"""{_STATE}, trend AS (
  SELECT State, Date, EV_Registrations, 'Actual' AS Data_Type FROM state_ev
  UNION ALL SELECT State, Date, Predicted,
    CASE WHEN Date <= (SELECT max(Date) FROM state_ev) THEN 'Fitted' ELSE 'Forecast' END FROM fc)"""


@query(f"WITH {_TREND} SELECT * FROM trend")
def combined_trend(spark, sf):
    """Every state."""
    ev = facts.state_ev(spark, sf)
    scored = fc.score(ev, ["State"], end=HORIZON)
    return rounded(reports.combined_trend(scored, ev))


@query(f"WITH {_TREND} SELECT * FROM trend WHERE State = 'NATION_7'")
def combined_trend_state(spark, sf):
    ev = facts.state_ev(spark, sf)
    scored = fc.score(ev, ["State"], end=HORIZON)
    return rounded(reports.combined_trend(scored, ev, "NATION_7"))


@query(f"""
WITH {_sql(STATE_EV, 'state_ev', ('State',), MEAN)}
SELECT State, {r4(f'sum(Predicted) FILTER (year(Date) = {HORIZON})')}
    AS Predicted_EV_Registrations_{HORIZON},
  any_value(m.Model_Fit_Score) AS Model_Fit_Score, any_value(m.Nonzero_EV_Months) AS Nonzero_EV_Months,
  any_value(m.Forecast_Method) AS Forecast_Method,
  any_value(m.Forecast_Confidence) AS Forecast_Confidence
FROM raw JOIN met m USING (State) GROUP BY State""")
def summary_end_year(spark, sf):
    return rounded(reports.end_year_summary(_state_scores(spark, sf, PLAIN), HORIZON, PLAIN))
