"""Window functions and time series on orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import window as win
from .core import r
from .registry import query

_ORDER, _PART = ["o_orderdate", "o_orderkey"], ["o_custkey"]
_W = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey{})"
_RUN = _W.format(" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")

_WINDOWS = {
    "cumsum": f"round(sum(o_totalprice) OVER {_RUN}, 2) + 0.0", "cummean": f"round(avg(o_totalprice) OVER {_RUN}, 6) + 0.0", "cummax": f"max(o_totalprice) OVER {_RUN}", "cummin": f"min(o_totalprice) OVER {_RUN}",
    "cumcount": f"row_number() OVER {_W.format('')} - 1", "row_number": f"row_number() OVER {_W.format('')}", "lag": f"lag(o_totalprice) OVER {_W.format('')}", "lead": f"lead(o_totalprice) OVER {_W.format('')}",
    "rank": "rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice)", "dense_rank": "dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice)", "share": "round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) + 0.0",
}
for fn, sql in _WINDOWS.items():

    @query(f"window_{fn}", f"SELECT o_orderkey, {sql} AS x FROM orders")
    def windowed(t, fn=fn):
        out = win.window(t.orders, fn, "o_totalprice", "x", _ORDER, _PART).select("o_orderkey", "x")
        return out.withColumn("x", r("x", {"share": 8, "cummean": 6}.get(fn, 2))) if fn in ("cumsum", "cummean", "share") else out


_EO, _EP = ["ts", "event_id"], ["user_id"]
_E = "(PARTITION BY user_id ORDER BY ts, event_id{})"
_ROLL = {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "median": "median", "var": "var_samp", "std": "stddev_samp", "count": "count"}
for fn, sql in _ROLL.items():

    @query(f"rolling_{fn}", f"SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round(({sql}(value) OVER w)::DOUBLE, 6) + 0.0 END AS x FROM events WINDOW w AS {_E.format(' ROWS BETWEEN 4 PRECEDING AND CURRENT ROW')}")
    def rolled(t, fn=fn):
        return win.rolling(t.events, "value", "x", _EO, _EP, fn, 5).select("event_id", r("x", 6).alias("x"))


@query("rolling_centered", f"SELECT event_id, CASE WHEN count(value) OVER w >= 2 THEN round(avg(value) OVER w, 4) + 0.0 END AS x FROM (SELECT *  REPLACE (CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value) FROM events) WINDOW w AS {_E.format(' ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING')}")
def rolling_centered(t):
    holey = t.events.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return win.rolling(holey, "value", "x", _EO, _EP, "mean", 4, 2, center=True).select("event_id", r("x").alias("x"))


@query("expanding_mean", f"SELECT event_id, round(avg(value) OVER {_E.format(' ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}, 10) + 0.0 AS x FROM events")
def expanding_mean(t):
    return win.expanding(t.events, "value", "x", _EO, _EP).select("event_id", r("x", 10).alias("x"))


@query("expanding_std", f"SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN round(stddev_samp(value) OVER w, 4) + 0.0 END AS x FROM events WINDOW w AS {_E.format(' ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}")
def expanding_std(t):
    return win.expanding(t.events, "value", "x", _EO, _EP, "std", 3).select("event_id", r("x").alias("x"))


@query("difference", f"SELECT event_id, round(d - lag(d) OVER {_E.format('')}, 4) + 0.0 AS x FROM (SELECT *, value - lag(value) OVER {_E.format('')} AS d FROM events)")
def difference(t):
    return win.difference(t.events, "value", "x", _EO, _EP, times=2).select("event_id", r("x").alias("x"))


@query("integrate", f"SELECT event_id, CASE WHEN v IS NOT NULL THEN round(10 + sum(v) OVER {_E.format(' ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}, 2) + 0.0 END AS x FROM (SELECT *, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)")
def integrate(t):
    df = t.events.withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return win.integrate(df, "v", "x", _EO, _EP, 10.0).select("event_id", r("x", 2).alias("x"))


@query("pct_change", f"SELECT event_id, CASE WHEN lag(value) OVER {_E.format('')} <> 0 THEN round((value - lag(value) OVER {_E.format('')}) / lag(value) OVER {_E.format('')}, 4) + 0.0 END AS x FROM events")
def pct_change(t):
    return win.pct_change(t.events, "value", "x", _EO, _EP).select("event_id", r("x").alias("x"))


@query("interpolate", """
    WITH e AS (SELECT event_id, user_id, epoch(ts) AS sec, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events),
    s AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN sec END IGNORE NULLS) OVER b AS x0, last_value(v IGNORE NULLS) OVER b AS y0, first_value(CASE WHEN v IS NOT NULL THEN sec END IGNORE NULLS) OVER f AS x1, first_value(v IGNORE NULLS) OVER f AS y1 FROM e
      WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0 ELSE y0 + (sec - x0) * (y1 - y0) / (x1 - x0) END, 4) + 0.0 AS x FROM s""")
def interpolate(t):
    df = t.events.withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value"))).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return win.interpolate(df, "v", "at", "x", _EO, _EP, "both").select("event_id", r("x").alias("x"))


@query("ewma", """
    WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT event_id, user_id, n, value AS num, 1.0::DOUBLE AS den FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.n, e.value + 0.7 * s.num, 1 + 0.7 * s.den FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT event_id, round(num / den, 4) + 0.0 AS x FROM s""")
def ewma(t):
    return win.ewma(t.events, "value", "x", _EO, _EP).select("event_id", r("x").alias("x"))


@query("ewma_plain", """
    WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT event_id, user_id, n, value AS m FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.n, 0.2 * e.value + 0.8 * s.m FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT event_id, round(m, 4) + 0.0 AS x FROM s""")
def ewma_plain(t):
    return win.ewma(t.events, "value", "x", _EO, _EP, span=9, adjust=False).select("event_id", r("x").alias("x"))


@query("ewma_std")
def ewma_std(t):
    return win.ewma(t.events, "value", "x", _EO, _EP, fn="std").select("event_id", r("x").alias("x"))


def daily(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).cast("double").alias("n"))


_DAILY = "daily AS (SELECT ts::DATE AS day, sum(value) AS total, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY ts::DATE) AS k FROM events GROUP BY 1)"


@query("ses", f"""
    WITH RECURSIVE {_DAILY}, s AS (SELECT k, total AS level, 0.0::DOUBLE AS sse FROM daily WHERE k = 1 UNION ALL SELECT d.k, 0.3 * d.total + 0.7 * s.level, s.sse + (d.total - s.level) ^ 2 FROM s JOIN daily d ON d.k = s.k + 1)
    SELECT round(level, 4) + 0.0 AS level, round(sse, 2) + 0.0 AS sse FROM s ORDER BY k DESC LIMIT 1""")
def ses(t):
    return win.smoothing(daily(t), "total", ["day"]).select(r("level").alias("level"), r("sse", 2).alias("sse"))


@query("holt", f"""
    WITH RECURSIVE {_DAILY}, s AS (SELECT 1::BIGINT AS k, d.total AS level, (SELECT total FROM daily WHERE k = 2) - d.total AS trend FROM daily d WHERE k = 1
      UNION ALL SELECT d.k, 0.3 * d.total + 0.7 * (s.level + 0.9 * s.trend), 0.1 * (0.3 * d.total + 0.7 * (s.level + 0.9 * s.trend) - s.level) + 0.9 * 0.9 * s.trend FROM s JOIN daily d ON d.k = s.k + 1)
    SELECT round(level, 4) + 0.0 AS level, round(trend, 4) + 0.0 AS trend, round(level + 0.9 * trend, 4) + 0.0 AS next FROM s ORDER BY k DESC LIMIT 1""")
def holt(t):
    return win.smoothing(daily(t), "total", ["day"], beta=0.1, phi=0.9).select(r("level").alias("level"), r("trend").alias("trend"), r(F.col("forecast")[0]).alias("next"))


@query("seasonal_decompose", f"""
    WITH {_DAILY}, m AS (SELECT *, CASE WHEN count(*) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7 THEN avg(total) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS trend, (k - 1) % 7 AS phase FROM daily),
    p AS (SELECT phase, avg(total - trend) AS a FROM m GROUP BY 1), q AS (SELECT phase, a - avg(a) OVER () AS seasonal FROM p)
    SELECT m.k::BIGINT AS k, round(trend, 4) + 0.0 AS trend, round(seasonal, 4) + 0.0 AS seasonal, round(total - trend - seasonal, 4) + 0.0 AS resid FROM m JOIN q USING (phase)""")
def seasonal_decompose(t):
    d = daily(t).withColumn("k", F.datediff("day", F.lit("2023-12-31")).cast("long"))
    out = win.seasonal_decompose(d, "total", ["day"], period=7)
    return out.select("k", r("trend").alias("trend"), r("seasonal").alias("seasonal"), r("resid").alias("resid"))


@query("acf", f"""
    WITH {_DAILY}, c AS (SELECT k, total - (SELECT avg(total) FROM daily) AS u FROM daily)
    SELECT l.lag, round((SELECT sum(a.u * b.u) FROM c a JOIN c b ON a.k = b.k + l.lag) / (SELECT sum(u * u) FROM c), 6) + 0.0 AS acf FROM (SELECT unnest(range(0, 6)) AS lag) l""")
def acf(t):
    return win.acf(daily(t), "total", ["day"], 5).select("lag", r("acf", 6).alias("acf"))


@query("cross_correlation", f"""
    WITH {_DAILY}, c AS (SELECT k, total - (SELECT avg(total) FROM daily) AS u, n - (SELECT avg(n) FROM daily) AS v FROM daily)
    SELECT l.lag, round((SELECT sum(a.u * b.v) FROM c a JOIN c b ON a.k = b.k + l.lag) / sqrt((SELECT sum(u * u) FROM c) * (SELECT sum(v * v) FROM c)), 6) + 0.0 AS ccf FROM (SELECT unnest(range(0, 6)) AS lag) l""")
def cross_correlation(t):
    return win.cross_correlation(daily(t), "total", "n", ["day"], 5).select("lag", r("ccf", 6).alias("ccf"))


@query("pacf_three", f"""
    WITH {_DAILY}, c AS (SELECT k, total - (SELECT avg(total) FROM daily) AS u FROM daily), a AS (SELECT (SELECT sum(a.u * b.u) FROM c a JOIN c b ON a.k = b.k + 1) / sum(u * u) AS r1, (SELECT sum(a.u * b.u) FROM c a JOIN c b ON a.k = b.k + 2) / sum(u * u) AS r2, (SELECT sum(a.u * b.u) FROM c a JOIN c b ON a.k = b.k + 3) / sum(u * u) AS r3 FROM c),
    p AS (SELECT 0 AS lag, 1.0::DOUBLE AS v FROM a UNION ALL SELECT 1, r1 FROM a UNION ALL SELECT 2, (r2 - r1 ^ 2) / (1 - r1 ^ 2) FROM a UNION ALL SELECT 3, (r3 - 2 * r1 * r2 + r1 ^ 3 + r1 * r2 ^ 2 - r1 ^ 2 * r3) / (1 - 2 * r1 ^ 2 - r2 ^ 2 + 2 * r1 ^ 2 * r2) FROM a)
    SELECT lag, round(v, 6) + 0.0 AS pacf FROM p""")
def pacf_three(t):
    return win.pacf(daily(t), "total", ["day"], 3).select("lag", r("pacf", 6).alias("pacf"))


@query("ewma_whole_mean", "SELECT user_id, round(avg(value), 4) + 0.0 AS mean FROM events GROUP BY 1")
def ewma_whole_mean(t):
    """With a span so long that nothing decays, the last mean of a series is the plain one."""
    out = win.ewma(t.events, "value", "x", _EO, _EP, span=1e12)
    return out.groupBy("user_id").agg(r(F.max_by("x", F.struct("ts", "event_id"))).alias("mean"))


@query("pacf")
def pacf(t):
    return win.pacf(daily(t), "total", ["day"], 5).select("lag", r("pacf", 6).alias("pacf"))


@query("ar_fit", f"""
    WITH {_DAILY}, p AS (SELECT total AS y, lag(total) OVER (ORDER BY day) AS x FROM daily)
    SELECT round(regr_intercept(y, x), 4) + 0.0 AS intercept, round(regr_slope(y, x), 6) + 0.0 AS phi, round(regr_r2(y, x), 6) + 0.0 AS r2 FROM p""")
def ar_fit(t):
    f = win.ar_fit(daily(t), "total", ["day"])
    return t.spark.createDataFrame([(f["intercept"], f["coefficients"][0], f["r2"])], "intercept double, phi double, r2 double").select(r("intercept").alias("intercept"), r("phi", 6).alias("phi"), r("r2", 6).alias("r2"))


@query("ar_forecast")
def ar_forecast(t):
    out = win.ar_forecast(win.ar_fit(daily(t), "total", ["day"], 2), 5)
    return t.spark.createDataFrame([(k + 1, v) for k, v in enumerate(out)], "step long, forecast double")


@query("membership_runs", """
    WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'purchase'), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS island FROM d)
    SELECT user_id, strftime(min(day), '%Y-%m-%d') AS start, count(*) AS days, max(day) >= DATE '2024-01-30' AS open FROM g GROUP BY user_id, island""")
def membership_runs(t):
    df = t.events.select("user_id", "ts", (F.col("event_type") == "purchase").alias("member"))
    return win.membership_runs(df, "ts", "member", ["user_id"], "2024-01-30").select("user_id", F.date_format("start", "yyyy-MM-dd").alias("start"), "days", "open")


@query("sessions", """
    WITH e AS (SELECT event_id, user_id, ts, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts) > 7200 AS fresh FROM events)
    SELECT event_id, sum(coalesce(fresh, false)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS session FROM e""")
def sessions(t):
    return win.sessions(t.events.withColumn("ts", F.date_trunc("microsecond", "ts")), "ts", ["user_id"], 7200).select("event_id", F.col("session").cast("long").alias("session"))


@query("tumbling_windows", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 2) + 0.0 AS total FROM events GROUP BY 1, 2")
def tumbling_windows(t):
    from ..streaming.events import windowed

    return windowed(t.events, "6 hours").select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", r("total", 2).alias("total"))
