"""Forecast every series of a frame in one plan.

A series is first summed per key and period; that shuffle combines on the map side, so a hot key
shrinks to at most one row per period of the calendar. One further shuffle by key feeds every
window below. The model needs no dense rows: absent periods add 0 to every sum with the value in
it, the sums over the time index alone have closed forms, and a row carries the residuals of the
gap behind it. Degrees above 2 use orthogonal polynomials of the time index, see ``_with_polynomial``. The dense calendar is generated last, from the gap to the next row, without a join.

``score`` returns all rows with all intermediate columns; the other functions select from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uptake.functions import dates
from uptake.functions.numeric import as_number, cagr, fill_and_clip, fill_zero, total
from uptake.plans.variants import DEFAULT, ForecastPolicy

FORECAST_END_YEAR = 2030
MODEL_NAME = "Polynomial Ridge Regression"
BAND_WIDTH = 1.96

PERIODS_PER_YEAR = {"month": 12, "day": 365}


def score(
    df: DataFrame,
    keys=(),
    value: str = "EV_Registrations",
    date: str = "Date",
    end=FORECAST_END_YEAR,
    policy: ForecastPolicy = DEFAULT.forecast,
    grain: str = "month",
) -> DataFrame:
    """All periods of all series: observed, filled and future ones.

    Besides the keys: Period and Step (axis position, and position from the start of the series;
    negative for trimmed leading zeros), Observed, Value, Actual, Predicted, Spread and the per
    series columns Start, Last, Modelled, Fit, Positive (periods with a value above 0).

    The input may be raw rows: there is no need to sum it per period first.
    """
    if not 1 <= policy.degree < policy.min_periods:
        raise ValueError("the degree is at least 1 and below the number of periods a model needs")
    keys = list(keys)
    series = _with_span(_observed(df, keys, value, date, policy, grain), keys, policy)
    series = _with_moments(series, keys, policy, grain)
    modelled = _with_polynomial(series, keys, policy) if _degree(policy) > 2 else _with_model(series, policy)
    return _dense(_with_quality(modelled, keys, policy), keys, end, grain, max(2, _degree(policy)))


def _over(keys, *more: str, order: str = "") -> str:
    """SQL window over one series; without keys the whole calendar-bounded frame is one series."""
    names = ", ".join([f"`{key}`" for key in keys] + list(more)) or "0"
    return f"OVER (PARTITION BY {names}{' ORDER BY ' + order if order else ''})"


def _observed(df, keys, value, date, policy, grain):
    """One row per key and period."""
    amount = as_number(df, value)
    measure = fill_and_clip(amount) if policy.clip_negative else fill_zero(amount)
    rows = (
        df.where(F.col(date).isNotNull())
        .groupBy(*keys, dates.period_index(F.col(date), grain).alias("Period"))
        .agg(total(measure).alias("Value"))
    )
    return rows if policy.clip_negative else rows.where("Value >= 0")


def _with_span(series, keys, policy):
    """First and last period of each series and the period of its next row."""
    whole = _over(keys)
    first = f"min(Period) {whole}"
    if policy.trim_leading_zeros:
        first = f"coalesce(min(CASE WHEN Value > 0 THEN Period END) {whole}, {first})"
    return series.selectExpr(
        "*",
        f"lead(Period) {_over(keys, order='Period')} AS __next",
        f"{first} AS Start",
        f"max(Period) {whole} AS Last",
    )


def _with_moments(series, keys, policy, grain):
    """Per series sums of the value times powers of the time index, and the fallback's inputs."""
    whole = _over(keys)
    t = "CAST(Period - Start AS DOUBLE)"
    out = series.selectExpr(
        "*",
        "CAST(Last - Start + 1 AS DOUBLE) AS __n",
        f"sum(Value) {whole} AS __y",
        f"sum({t} * Value) {whole} AS __ty",
        f"sum({t} * {t} * Value) {whole} AS __tty",
        f"count_if(Value > 0) {whole} AS Positive",
        f"count_if(Period >= Start) {whole} AS __seen",
        f"min(CASE WHEN Period >= Start THEN Value END) {whole} AS __low",
        f"max(CASE WHEN Period >= Start THEN Value END) {whole} AS __high",
        f"sum(CASE WHEN Period > Last - {policy.base_periods} THEN Value END) {whole} AS __tail",
        f"sum(CASE WHEN Period > Last - {policy.band_periods} THEN Value END) {whole}"
        " AS __band_sum",
    )
    if policy.fallback == "mean":
        return out.selectExpr("*", "0D AS __growth")

    out = out.withColumn("__year", F.year(dates.period_date(F.col("Period"), grain)))
    out = out.selectExpr("*", f"sum(Value) {_over(keys, '__year')} AS __annual")
    good_year = "CASE WHEN __annual > 0 THEN __year END"
    out = out.selectExpr(
        "*",
        f"max({good_year}) {whole} - min({good_year}) {whole} AS __years",
        f"min_by(__annual, {good_year}) {whole} AS __first_sum",
        f"max_by(__annual, {good_year}) {whole} AS __last_sum",
    )
    own = cagr(F.col("__first_sum"), F.col("__last_sum"), F.col("__years")) / 100
    low, high = policy.growth_limits
    rate = F.coalesce(own, F.lit(policy.default_growth / 100))
    return out.withColumn("__rate", rate).selectExpr(
        "*",
        f"pow(1 + least(greatest(__rate, {low}D), {high}D), 1D / {PERIODS_PER_YEAR[grain]}) - 1"
        " AS __growth",
    )


def _with_model(series, policy):
    """Ridge coefficients of 1, t, t^2 with a free intercept, in closed form.

    The intercept is not penalised, so the features are centred; t itself stays unscaled because
    the penalty depends on its unit. A constant series keeps slopes of exactly 0.
    """
    quadratic = "true" if policy.degree >= 2 else "false"
    if policy.adaptive_degree:
        quadratic += f" AND __n >= {policy.quadratic_from}"
    alpha = f"{float(policy.ridge)}D"
    sums = _with_gates(series, policy).selectExpr(
        "*",
        f"{quadratic} AS __quadratic",
        "__n * (__n - 1) / 2 AS __t1",
        "__n * (__n - 1) * (2 * __n - 1) / 6 AS __t2",
    )
    centred = sums.selectExpr(
        "*",
        f"__t2 - __t1 * __t1 / __n + {alpha} AS __s11",
        "__t1 * __t1 - __t1 * __t2 / __n AS __s12",
        f"__t2 * (3 * __n * __n - 3 * __n - 1) / 5 - __t2 * __t2 / __n + {alpha} AS __s22",
        "__ty - __t1 * __y / __n AS __b1",
        "__tty - __t2 * __y / __n AS __b2",
    )
    slopes = centred.selectExpr(
        "*",
        """CASE WHEN __constant THEN 0D
                WHEN __quadratic THEN try_divide(__s22 * __b1 - __s12 * __b2,
                                                 __s11 * __s22 - __s12 * __s12)
                ELSE try_divide(__b1, __s11) END AS __w1""",
        """CASE WHEN __constant OR NOT __quadratic THEN 0D
                ELSE try_divide(__s11 * __b2 - __s12 * __b1,
                                __s11 * __s22 - __s12 * __s12) END AS __w2""",
    )
    return slopes.selectExpr(
        "*",
        "(__y - __w1 * __t1 - __w2 * __t2) / __n AS __w0",
        "__y / __n AS __mean",
        f"__tail / least(__n, {float(policy.base_periods)}D) AS __base",
    )


def _degree(policy) -> int:
    """The highest degree a series may get; an adaptive one is a parabola at most."""
    return min(policy.degree, 2) if policy.adaptive_degree else policy.degree


def _with_gates(series, policy):
    """Which series are modelled, and which are constant."""
    return series.selectExpr(
        "*",
        f"__n >= {policy.min_periods} AND Positive >= {policy.min_positive} AS Modelled",
        "__low = __high AND (__seen = __n OR __high = 0) AS __constant",
    )


def _with_polynomial(series, keys, policy):
    """Ridge coefficients of 1, t, ..., t^k with a free intercept, for any degree k below the number of periods.

    The powers of t are nearly dependent, so their normal equations lose all digits from degree 4 on. Let P0, P1, ... be the
    polynomials that are orthogonal on t = 0 .. n - 1, with leading coefficient 1: with m = (n - 1) / 2 and
    b(j) = j^2 (n^2 - j^2) / (4 (4 j^2 - 1)), P(j+1) = (t - m) P(j) - b(j) P(j-1), and the squared norm of P(j) is
    n b(1) ... b(j). For their coefficients over the norms, v, the ridge reads (I + ridge N'N) v = (moments of the
    value), where column j of N holds the coefficients of t, t^2, ... in P(j) over its norm. That
    matrix is close to I and symmetric, so it is eliminated without pivots, as expressions per series.

    Needs one sum of the value per degree and nothing else from the rows; the squared residuals follow from
    the same sums, since the polynomials are orthonormal.
    """
    k, whole = _degree(policy), _over(keys)
    out = _with_gates(series, policy).selectExpr("*", "(__n - 1) / 2 AS __c", "CAST(Period - Start AS DOUBLE) - (__n - 1) / 2 AS __x")
    # Series too short for a model may have fewer periods than coefficients; their norms are kept from 0.
    out = out.selectExpr("*", *[
        f"CASE WHEN __n > {j} THEN {j * j}D * (__n * __n - {j * j}D) / {4 * (4 * j * j - 1)}D ELSE 1D END AS __beta{j}"
        for j in range(1, k + 1)])
    norm, values = "__n", ["1D", "__x"]
    for j in range(1, k + 1):
        norm += f" * __beta{j}"
        out = out.selectExpr("*", f"sqrt({norm}) AS __norm{j}", f"{values[j]} AS __p{j}")
        values[j] = f"__p{j}"
        values.append(f"__x * __p{j} - __beta{j} * {values[j - 1]}")
    out = out.selectExpr("*", *[f"sum(CASE WHEN Period >= Start THEN __p{j} * Value END) {whole} / __norm{j} AS __b{j}" for j in range(1, k + 1)])
    # Coefficients of t^i in P(j).
    coefficient = {(0, 0): "1D", (1, 0): "-__c", (1, 1): "1D"}
    for j in range(2, k + 1):
        parts = {}
        for i in range(j + 1):
            terms = [coefficient.get((j - 1, i - 1)), *(
                f"{f} * {coefficient[at]}" for f, at in (("-__c", (j - 1, i)), (f"-__beta{j - 1}", (j - 2, i))) if at in coefficient)]
            parts[i] = " + ".join(f"({term})" for term in terms if term)
        out = out.selectExpr("*", *[f"{text} AS __p{j}_{i}" for i, text in parts.items()])
        coefficient |= {(j, i): f"__p{j}_{i}" for i in parts}
    degrees = range(1, k + 1)
    out = out.selectExpr("*", *[
        f"{'1D + ' if j == l else ''}{float(policy.ridge)}D * (" + " + ".join(
            f"({coefficient[j, i]}) * ({coefficient[l, i]})" for i in range(1, min(j, l) + 1)) + f") / (__norm{j} * __norm{l}) AS __a{j}_{l}"
        for j in degrees for l in degrees if l >= j])
    # Elimination: the rows below j lose their column j.
    for j in degrees:
        below = range(j + 1, k + 1)
        out = out.selectExpr("*", *[f"__a{j}_{i} / __a{j}_{j} AS __f{j}_{i}" for i in below])
        out = out.withColumns({
            **{f"__a{i}_{l}": F.expr(f"__a{i}_{l} - __f{j}_{i} * __a{j}_{l}") for i in below for l in range(i, k + 1)},
            **{f"__r{i}": F.expr(f"{'__b' if j == 1 else '__r'}{i} - __f{j}_{i} * {'__b' if j == 1 else '__r'}{j}") for i in below},
        }) if j < k else out
    for j in reversed(degrees):
        right = " ".join([f"{'__b' if j == 1 else '__r'}{j}", *[f"- __a{j}_{l} * __v{l}" for l in range(j + 1, k + 1)]])
        out = out.selectExpr("*", f"CASE WHEN __constant THEN 0D ELSE ({right}) / __a{j}_{j} END AS __v{j}")
    out = out.selectExpr("*", "__y / __n AS __mean", f"__tail / least(__n, {float(policy.base_periods)}D) AS __base", *[
        f"{'__y / __n + ' if i == 0 else ''}" + " + ".join(f"__v{j} / __norm{j} * ({coefficient[j, i]})" for j in degrees if (j, i) in coefficient)
        + f" AS __w{i}" for i in range(k + 1)])
    # Squares of the value about its mean, less the model's: v'v - 2 v'b.
    explained = " + ".join(f"__v{j} * (2 * __b{j} - __v{j})" for j in degrees)
    return out.selectExpr("*", f"{explained} AS __explained")


def _with_quality(series, keys, policy):
    """Fit score and deviation per series, from the residuals themselves.

    Still one row per observed period: a row adds the residuals of the gap behind it, where the
    value is 0, and the gaps' share of the other sums is known from their number.
    """
    whole = _over(keys)
    tail = f"least(__n, {float(policy.band_periods)}D)"
    in_tail = f"Period >= Start AND Period > Last - {policy.band_periods}"
    if _degree(policy) > 2:
        rows = series.withColumn("__band_mean", F.expr(f"__band_sum / {tail}"))
        unexplained = "greatest(__variation - __explained, 0D)"
    else:
        rows, unexplained = _with_squares(series, tail), f"sum(__squares) {whole}"
    sums = rows.selectExpr(
        "*",
        f"""sum(CASE WHEN Period >= Start THEN pow(Value - __mean, 2) END) {whole}
            + (__n - __seen) * pow(__mean, 2) AS __variation""",
        f"""sum(CASE WHEN {in_tail} THEN pow(Value - __band_mean, 2) END) {whole}
            + ({tail} - count_if({in_tail}) {whole}) * pow(__band_mean, 2) AS __band_squares""",
    ).selectExpr("*", f"{unexplained} AS __unexplained")
    return sums.selectExpr(
        "*",
        f"sqrt(CASE WHEN Modelled THEN __unexplained / __n ELSE __band_squares / {tail} END)"
        " AS Spread",
        """CASE WHEN Modelled THEN CASE WHEN __constant THEN 1D
             ELSE 1 - try_divide(__unexplained, __variation) END END AS Fit""",
    )


def _with_squares(series, tail):
    """The squared residuals of a row of a parabola and of the gap behind it."""
    # With u counting from the start of a gap of m periods the model is c0 + c1 u + c2 u^2, so the
    # gap's squares have a closed form in m; no array of its periods is built.
    gaps = series.selectExpr(
        "*",
        "CAST(Period - Start AS DOUBLE) AS __t",
        "CAST(greatest(coalesce(__next - Period - 1, 0), 0) AS DOUBLE) AS __m",
    ).selectExpr(
        "*",
        "__w0 + __w1 * (__t + 1) + __w2 * (__t + 1) * (__t + 1) AS __c0",
        "__w1 + 2 * __w2 * (__t + 1) AS __c1",
        "__m * (__m - 1) / 2 AS __m1",
        "__m * (__m - 1) * (2 * __m - 1) / 6 AS __m2",
    )
    return gaps.selectExpr(
        "*",
        """CASE WHEN Modelled AND Period >= Start THEN
             pow(Value - (__w0 + __w1 * __t + __w2 * __t * __t), 2)
             + __c0 * __c0 * __m + 2 * __c0 * __c1 * __m1
             + (__c1 * __c1 + 2 * __c0 * __w2) * __m2 + 2 * __c1 * __w2 * __m1 * __m1
             + __w2 * __w2 * __m2 * (3 * __m * __m - 3 * __m - 1) / 5
           END AS __squares""",
        f"__band_sum / {tail} AS __band_mean",
    )


def _dense(series, keys, end, grain, degree):
    """Every period from the start to the end date: observed, gap (value 0) or future (no value)."""
    curve = f"__w{degree}"
    for i in reversed(range(degree)):
        curve = f"__w{i} + CAST(__at - Start AS DOUBLE) * ({curve})"
    if degree == 2:
        curve = "__w0 + __w1 * (__at - Start) + __w2 * CAST(__at - Start AS DOUBLE) * (__at - Start)"
    names = [f"`{key}`" for key in keys]
    until = (
        "CASE WHEN Period < Start THEN Period"
        f" ELSE coalesce(__next - 1, greatest(Last, {dates.last_period(end, grain)})) END"
    )
    dense = series.selectExpr("*", f"explode(sequence(Period, {until})) AS __at").selectExpr(
        *names, "__at AS Period", "__at - Start AS Step", "__at = Period AS Observed",
        "Start", "Last", "Positive", "Modelled", "Value", "Spread", "Fit",
        "CASE WHEN __at = Period THEN Value WHEN __at <= Last THEN 0D END AS Actual",
        f"""CASE WHEN Modelled THEN {curve}
                ELSE __base * pow(1 + __growth, __at - Last) END AS __curve""",
    )
    return dense.selectExpr(
        "*",
        """CASE WHEN Modelled OR Actual IS NULL THEN greatest(__curve, 0D)
                ELSE Actual END AS Predicted""",
    ).drop("__curve")


def forecast_rows(
    scored: DataFrame, keys=(), policy: ForecastPolicy = DEFAULT.forecast, grain: str = "month"
) -> DataFrame:
    """Date, Actual (NULL in the future), Predicted and its range, Year, Month per series."""
    dated = scored.where("Step >= 0").withColumn(
        "Date", dates.period_date(F.col("Period"), grain)
    )
    band = [
        f"greatest(Predicted - {BAND_WIDTH}D * Spread, 0D) AS CI_Lower",
        f"Predicted + {BAND_WIDTH}D * Spread AS CI_Upper",
    ]
    return dated.selectExpr(
        *[f"`{key}`" for key in keys], "Date", "Actual", "Predicted",
        *(band if policy.band else []), "year(Date) AS Year", "month(Date) AS Month",
    )


def method_name(policy: ForecastPolicy) -> Column:
    return F.when(F.col("Modelled"), F.lit(MODEL_NAME)).otherwise(F.lit(policy.fallback_name))


def confidence_tier(fit: Column, months: Column, policy: ForecastPolicy) -> Column:
    """High from 36 positive months with a fit of at least 0.5, Medium from 18, else Low."""
    fits = F.coalesce(fit >= 0.5, F.lit(policy.high_without_fit))
    return F.when((months >= 36) & fits, "High").when(months >= 18, "Medium").otherwise("Low")


def metrics(
    scored: DataFrame, keys, policy: ForecastPolicy = DEFAULT.forecast, grain: str = "month",
    graded: bool = True,
) -> DataFrame:
    """One row per series: fit, last actual month, method and, if graded, history and confidence.

    The scored rows already lie partitioned by key, so this adds no shuffle.
    """
    per_series = scored.groupBy(*keys).agg(
        F.max("Fit").alias("Model_Fit_Score"),
        F.max("Positive").alias("Nonzero_EV_Months"),
        F.max("Last").alias("__last"),
        F.bool_or("Modelled").alias("Modelled"),
    )
    months = F.col("Nonzero_EV_Months")
    label = dates.month_label(dates.period_date(F.col("__last"), grain))
    out = per_series.select(
        *keys, "Model_Fit_Score", months, label.alias("Last_Actual_Month"),
        method_name(policy).alias("Forecast_Method"),
        confidence_tier(F.col("Model_Fit_Score"), months, policy).alias("Forecast_Confidence"),
    )
    return out if graded else out.drop("Nonzero_EV_Months", "Forecast_Confidence")


def forecast(
    df: DataFrame, keys=(), value: str = "EV_Registrations", date: str = "Date",
    end=FORECAST_END_YEAR, policy: ForecastPolicy = DEFAULT.forecast, grain: str = "month",
    graded: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Forecast rows and metrics of every series."""
    scored = score(df, keys, value, date, end, policy, grain)
    return (
        forecast_rows(scored, keys, policy, grain),
        metrics(scored, keys, policy, grain, graded),
    )


def state_value_column(columns) -> str:
    """The adjusted registrations if the frame has them, else the registrations as they came."""
    adjusted = "EV_Registrations_Adjusted"
    return adjusted if adjusted in columns else "EV_Registrations"


def densify(
    df: DataFrame, keys=(), value: str = "EV_Registrations", date: str = "Date",
    trim: bool = False, grain: str = "month",
) -> DataFrame:
    """Every period between the first and last of each series, absent ones with value 0."""
    policy = ForecastPolicy(trim_leading_zeros=trim, fallback="mean")
    keys = list(keys)
    series = _with_span(_observed(df, keys, value, date, policy, grain), keys, policy)
    live = series.where("Period >= Start")
    dense = live.selectExpr(
        "*", "explode(sequence(Period, coalesce(__next - 1, Last))) AS __at"
    )
    filled = F.expr("CASE WHEN __at = Period THEN Value ELSE 0D END")
    return dense.select(
        *keys, dates.period_date(F.col("__at"), grain).alias("Date"), filled.alias(value)
    )
