"""Record gates, yearly signatures, recession analysis and trends."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from driver_queries.registry import registry, rounded
from driver_queries.stand_ins import DAILY, GAP, GAPPY, RAIN, daily, gappy, rain
from freshet.operators import quality, recession, trends, yearly
from freshet.plans import signatures

SEASON_SQL = """CASE WHEN month IN (12, 1, 2) THEN 'win' WHEN month IN (3, 4, 5) THEN 'spr'
  WHEN month IN (6, 7, 8) THEN 'sum' ELSE 'fal' END"""


def _year_rows(df, digits=4):
    return df.select("gage_id", "year", "metric", F.round("value", digits).alias("value"))


def _union_sql(rows, source, keys="gage_id, year", digits=4):
    """Long rows out of a wide CTE: rows maps metric name to SQL expression."""
    parts = [
        f"SELECT {keys}, '{m}' AS metric, round(CAST({e} AS DOUBLE), {digits}) AS value FROM {source} WHERE ({e}) IS NOT NULL"
        for m, e in rows
    ]
    return "\nUNION ALL ".join(parts)


QUERIES, SQL, query = registry()

VALID = """
valid_years AS (
  SELECT gage_id, year, count(*) FILTER (WHERE q > 60) AS n_days FROM gappy GROUP BY 1, 2
  HAVING count(*) FILTER (WHERE q > 60) >= 250)"""


@query("q1_valid_years", f"WITH {GAPPY}, {VALID} SELECT gage_id, year, CAST(n_days AS BIGINT) AS n_days FROM valid_years")
def _(spark, d):
    return quality.valid_years(gappy(spark, d), min_q=60, min_days=250)


@query(
    "q2_min_years",
    f"""WITH {GAPPY}, {VALID} SELECT gage_id, CAST(count(*) AS BIGINT) AS num_years FROM valid_years
    GROUP BY gage_id HAVING count(*) >= 6""",
)
def _(spark, d):
    return quality.gages_with_years(quality.valid_years(gappy(spark, d), 60, 250), 6)


@query(
    "q3_raw_length",
    f"""WITH {GAPPY} SELECT gage_id, CAST(count(*) AS BIGINT) AS n_rows, max(date) AS last_date,
    CAST(count(DISTINCT year) AS BIGINT) AS n_years FROM gappy GROUP BY gage_id
    HAVING count(*) > 365 * 6 AND max(date) > DATE '1996-01-01'""",
)
def _(spark, d):
    return quality.long_enough(gappy(spark, d), 6, "1996-01-01")


@query(
    "q4_restrict_years",
    f"""WITH {GAPPY}, {VALID} SELECT gage_id, year, CAST(count(*) AS BIGINT) AS n, sum(q) AS q FROM gappy
    SEMI JOIN valid_years USING (gage_id, year)
    WHERE gage_id IN (SELECT gage_id FROM valid_years GROUP BY 1 HAVING count(*) >= 6) GROUP BY 1, 2""",
)
def _(spark, d):
    kept = quality.restrict_to_valid_years(gappy(spark, d), 60, 250, 6)
    return kept.groupBy("gage_id", "year").agg(F.count("*").alias("n"), F.sum("q").alias("q"))


@query(
    "q5_record_header",
    f"""WITH {DAILY} SELECT gage_id, CAST(count(DISTINCT year) AS BIGINT) AS num_years, min(year) AS start_year,
    max(year) AS end_year FROM daily GROUP BY 1""",
)
def _(spark, d):
    return quality.record_header(daily(spark, d))


def _volume_sql(how):
    cols = [("Qann", f"{how}(q)")] + [
        (f"Q{s}", f"{how}(q) FILTER (WHERE {SEASON_SQL} = '{s}')") for s in ("win", "spr", "sum", "fal")
    ]
    wide = ", ".join(f"{e} AS {m}" for m, e in cols)
    return f"WITH {GAPPY}, w AS (SELECT gage_id, year, {wide} FROM gappy GROUP BY 1, 2) " + _union_sql(
        [(m, m) for m, _ in cols], "w"
    )


@query("y1_y2_volumes", _volume_sql("sum"))
def _(spark, d):
    return _year_rows(yearly.volumes(gappy(spark, d)))


@query("y1_y2_mean_volumes", _volume_sql("avg"))
def _(spark, d):
    return _year_rows(yearly.volumes(gappy(spark, d), stat="mean"))


_P = yearly.FLOW_PERCENTILES


@query(
    "y3_y4_percentiles",
    f"WITH {GAPPY}, w AS (SELECT gage_id, year, "
    + ", ".join(f"quantile_cont(q, {p / 100}) AS Q{p}" for p in _P)
    + " FROM gappy WHERE q IS NOT NULL GROUP BY 1, 2) "
    + _union_sql([(f"Q{p}", f"Q{p}") for p in _P] + [("Q95_Q10", "Q95 - Q10")], "w"),
)
def _(spark, d):
    return _year_rows(yearly.flow_percentiles(gappy(spark, d)))


@query(
    "y5_fdc_slopes",
    f"""WITH {GAPPY}, r AS (
      SELECT gage_id, year, log10(q + 1e-10) AS y, row_number() OVER w / (count(q) OVER g + 1.0::DOUBLE) AS x, count(*) OVER g AS nn
      FROM gappy WHERE q IS NOT NULL WINDOW w AS (PARTITION BY gage_id, year ORDER BY q DESC), g AS (PARTITION BY gage_id, year)),
    f AS (SELECT gage_id, year, regr_slope(y, x) AS a, regr_slope(y, x) FILTER (WHERE x >= 0.9) AS b,
      regr_slope(y, x) FILTER (WHERE x BETWEEN 0.2 AND 0.8) AS c FROM r WHERE nn >= 30 GROUP BY 1, 2) """
    + _union_sql([("FDCall", "a"), ("FDC90", "b"), ("FDCmid", "c")], "f"),
)
def _(spark, d):
    return _year_rows(yearly.fdc_slopes(gappy(spark, d)))


FILLED = """
posn AS (SELECT *, row_number() OVER w AS p, count(*) OVER g AS nr, count(q) OVER g AS nq FROM gappy
  WINDOW w AS (PARTITION BY gage_id, year ORDER BY doy), g AS (PARTITION BY gage_id, year)),
nb AS (SELECT *, max(CASE WHEN q IS NOT NULL THEN p END) OVER (PARTITION BY gage_id, year ORDER BY doy) AS pb,
  min(CASE WHEN q IS NOT NULL THEN p END) OVER (PARTITION BY gage_id, year ORDER BY doy ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pa
  FROM posn),
filled AS (SELECT n.gage_id, n.year, n.doy, n.p, n.nr, n.nq,
  CASE WHEN n.q IS NOT NULL THEN n.q WHEN b.q IS NULL THEN a.q WHEN a.q IS NULL THEN b.q
       ELSE b.q + (a.q - b.q) * (n.p - n.pb) / (n.pa - n.pb) END AS q
  FROM nb n LEFT JOIN posn b ON b.gage_id = n.gage_id AND b.year = n.year AND b.p = n.pb
  LEFT JOIN posn a ON a.gage_id = n.gage_id AND a.year = n.year AND a.p = n.pa)"""


@query(
    "y6_flashiness",
    f"""WITH {GAPPY}, {FILLED}, s AS (
      SELECT *, abs(q - lag(q) OVER (PARTITION BY gage_id, year ORDER BY doy)) AS step FROM filled
      WHERE nr >= 30 AND (nr - nq) / nr::DOUBLE <= 0.2)
    SELECT gage_id, year, 'flashinessRB' AS metric, round(sum(step) / sum(q), 4) AS value FROM s GROUP BY 1, 2""",
)
def _(spark, d):
    return _year_rows(yearly.flashiness(gappy(spark, d)))


def _timing_sql(source):
    days = [(f"D{p}_day", f"min(doy) FILTER (WHERE share >= {p} * total)") for p in yearly.TIMING_PERCENTILES]
    wide = ", ".join(f"{e} AS {m}" for m, e in days)
    return f"""WITH {GAPPY}, c AS (
      SELECT *, count(*) OVER g AS nr, sum(q) OVER g AS total, max(q) OVER g AS highest,
        CASE WHEN count(*) OVER w = count(q) OVER w THEN 100 * sum(q) OVER w END AS share
      FROM {source} WINDOW g AS (PARTITION BY gage_id, year), w AS (PARTITION BY gage_id, year ORDER BY doy ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT gage_id, year, {wide}, min(doy) FILTER (WHERE share >= 75 * total) - min(doy) FILTER (WHERE share >= 25 * total) AS span,
      min(doy) FILTER (WHERE q = highest) AS peak FROM c WHERE nr >= 300 AND total > 0 GROUP BY 1, 2) """ + _union_sql(
        [(m, m) for m, _ in days] + [("D25_to_D75", "span"), ("Dmax", "peak")], "t"
    )


@query("y7_y8_y9_timing", _timing_sql("daily"))
def _(spark, d):
    return _year_rows(yearly.timing(daily(spark, d)))


@query("y7_timing_with_gaps", _timing_sql("gappy"))
def _(spark, d):
    return _year_rows(yearly.timing(gappy(spark, d)))


def _pulse_sql():
    kinds = {
        "high_year": "q > y90", "low_year": "q < y10", "high_all": "q > a90", "low_all": "q < a10",
    }
    flags = ", ".join(f"coalesce({e}, false) AS {k}" for k, e in kinds.items())
    starts = ", ".join(
        f"{k} AND NOT coalesce(lag({k}) OVER (PARTITION BY gage_id, year ORDER BY doy), false) AS s_{k}" for k in kinds
    )
    aggs = ", ".join(
        f"count(*) FILTER (WHERE s_{k}) AS n_{k}, count(*) FILTER (WHERE {k}) AS d_{k}" for k in kinds
    )
    rows = []
    for k in kinds:
        side, scope = k.split("_")
        rows.append((f"n_{side}_pulses_{scope}", f"n_{k}"))
        rows.append((f"dur_{side}_pulses_{scope}", f"CASE WHEN n_{k} > 0 THEN d_{k} / n_{k}::DOUBLE END"))
    return f"""WITH {GAPPY}, a AS (SELECT gage_id, quantile_cont(q, 0.9) AS a90, quantile_cont(q, 0.1) AS a10 FROM gappy GROUP BY 1),
    y AS (SELECT gage_id, year, quantile_cont(q, 0.9) AS y90, quantile_cont(q, 0.1) AS y10, count(*) AS nr FROM gappy GROUP BY 1, 2),
    f AS (SELECT gage_id, year, doy, {flags} FROM gappy JOIN a USING (gage_id) JOIN y USING (gage_id, year) WHERE nr >= 250),
    s AS (SELECT *, {starts} FROM f), w AS (SELECT gage_id, year, {aggs} FROM s GROUP BY 1, 2) """ + _union_sql(rows, "w")


@query("y10_y11_pulses", _pulse_sql())
def _(spark, d):
    return _year_rows(yearly.pulses(gappy(spark, d)))


@query(
    "y12_tqmean",
    f"""WITH {GAPPY}, m AS (SELECT *, avg(q) OVER g AS mean, count(*) OVER g AS nr FROM gappy WINDOW g AS (PARTITION BY gage_id, year))
    SELECT gage_id, year, 'TQmean' AS metric, round(count(*) FILTER (WHERE q > mean) / count(q)::DOUBLE * 100, 4) AS value
    FROM m WHERE nr >= 250 GROUP BY 1, 2""",
)
def _(spark, d):
    return _year_rows(yearly.tqmean(gappy(spark, d)))


def _reversal_sql():
    def turn(w):
        return (
            f"abs(lead(q) OVER {w} - q) > abs(0.02::DOUBLE * q) AND ((q - lag(q) OVER {w} >= 0 AND lead(q) OVER {w} - q < 0)"
            f" OR (q - lag(q) OVER {w} <= 0 AND lead(q) OVER {w} - q > 0))"
        )

    seasons = yearly.SEASON_LABELS
    gates = ", ".join(f"count(*) FILTER (WHERE season = '{k}') AS r_{k}" for k in seasons)
    rows = [("Flow_Reversals_annual", "annual")] + [
        (f"Flow_Reversals_{v}", f"CASE WHEN r_{k} >= 30 THEN n_{k} END") for k, v in seasons.items()
    ]
    counts = ", ".join(f"count(*) FILTER (WHERE st AND season = '{k}') AS n_{k}" for k in seasons)
    return f"""WITH {GAPPY}, d AS (SELECT *, {SEASON_SQL} AS season FROM gappy),
    g AS (SELECT gage_id, year, count(*) AS nr, {gates} FROM d GROUP BY 1, 2),
    t AS (SELECT gage_id, year, season, {turn('wa')} AS yt, {turn('ws')} AS st FROM d WHERE q IS NOT NULL
      WINDOW wa AS (PARTITION BY gage_id, year ORDER BY doy), ws AS (PARTITION BY gage_id, year, season ORDER BY doy)),
    c AS (SELECT gage_id, year, count(*) FILTER (WHERE yt) AS annual, {counts} FROM t GROUP BY 1, 2),
    w AS (SELECT * FROM c JOIN g USING (gage_id, year) WHERE nr >= 250) """ + _union_sql(rows, "w")


@query("y13_reversals", _reversal_sql())
def _(spark, d):
    return _year_rows(yearly.reversals(gappy(spark, d)))


def _runoff_sql():
    rows = [("annual", "true")] + [(v, f"{SEASON_SQL} = '{k}'") for k, v in yearly.SEASON_LABELS.items()]
    wide = ", ".join(
        f"CASE WHEN sum(ppt) FILTER (WHERE {c}) > 0.001 THEN sum(q) FILTER (WHERE {c}) / sum(ppt) FILTER (WHERE {c}) END AS {n}"
        for n, c in rows
    )
    return f"""WITH {GAPPY}, {RAIN}, b AS (SELECT gage_id, year, month, q, ppt FROM gappy JOIN rain USING (gage_id, date)
      WHERE q IS NOT NULL AND ppt IS NOT NULL), w AS (SELECT gage_id, year, {wide} FROM b GROUP BY 1, 2) """ + _union_sql(
        [(f"{n}_runoff_ratio", n) for n, _ in rows], "w", digits=8
    )


@query("y14_runoff_ratio", _runoff_sql())
def _(spark, d):
    both = gappy(spark, d).join(rain(spark, d), ["gage_id", "date"], "left")
    return _year_rows(yearly.runoff_ratios(both), 8)


def _bfi_sql(source):
    return f"""WITH RECURSIVE {GAPPY}, nr AS (
      SELECT gage_id, year, q, row_number() OVER w AS i, count(*) OVER g AS n, count(q) OVER g AS nq, sum(q) OVER g AS total
      FROM {source} WINDOW w AS (PARTITION BY gage_id, year ORDER BY doy), g AS (PARTITION BY gage_id, year)),
    u AS (SELECT * FROM nr WHERE n >= 250 AND (n - nq) / n::DOUBLE <= 0.2 AND total > 0),
    ek AS (
      SELECT gage_id, year, i, q * 0.8::DOUBLE AS b FROM u WHERE i = 1
      UNION ALL SELECT u.gage_id, u.year, u.i,
        CASE WHEN u.q IS NOT NULL AND e.b IS NOT NULL THEN
          greatest(least(((1 - 0.8::DOUBLE) * 0.98::DOUBLE * e.b + (1 - 0.98::DOUBLE) * 0.8::DOUBLE * u.q) / (1 - 0.98::DOUBLE * 0.8::DOUBLE), u.q), 0) END
      FROM ek e JOIN u ON u.gage_id = e.gage_id AND u.year = e.year AND u.i = e.i + 1),
    fw AS (
      SELECT gage_id, year, i, n, q, 0.0::DOUBLE AS f FROM u WHERE i = 1
      UNION ALL SELECT u.gage_id, u.year, u.i, u.n, u.q,
        CASE WHEN u.q IS NOT NULL AND e.q IS NOT NULL AND e.f IS NOT NULL THEN
          greatest(0, least(0.925::DOUBLE * e.f + (1.925::DOUBLE / 2) * (u.q - e.q), u.q)) END
      FROM fw e JOIN u ON u.gage_id = e.gage_id AND u.year = e.year AND u.i = e.i + 1),
    bw AS (
      SELECT gage_id, year, i, q, f, f AS k FROM fw WHERE i = n
      UNION ALL SELECT a.gage_id, a.year, a.i, a.q, a.f,
        CASE WHEN a.f IS NOT NULL AND e.f IS NOT NULL AND e.k IS NOT NULL THEN
          greatest(0, least(0.925::DOUBLE * e.k + (1.925::DOUBLE / 2) * (a.f - e.f), a.q)) END
      FROM bw e JOIN fw a ON a.gage_id = e.gage_id AND a.year = e.year AND a.i = e.i - 1),
    w AS (SELECT t.gage_id, t.year, coalesce(eb, 0) / total AS eck, coalesce(lb, 0) / total AS lyn
      FROM (SELECT DISTINCT gage_id, year, total FROM u) t
      LEFT JOIN (SELECT gage_id, year, sum(b) AS eb FROM ek GROUP BY 1, 2) e ON e.gage_id = t.gage_id AND e.year = t.year
      LEFT JOIN (SELECT gage_id, year, sum(CASE WHEN q IS NOT NULL AND k IS NOT NULL THEN greatest(q - k, 0) END) AS lb FROM bw GROUP BY 1, 2) l
        ON l.gage_id = t.gage_id AND l.year = t.year) """ + _union_sql([("BFI_Eckhardt", "eck"), ("BFI_LyneHollick", "lyn")], "w")


@query("y15_y16_baseflow", _bfi_sql("daily"))
def _(spark, d):
    return _year_rows(yearly.baseflow_indices(daily(spark, d)))


@query("y15_y16_baseflow_with_gaps", _bfi_sql("gappy"))
def _(spark, d):
    return _year_rows(yearly.baseflow_indices(gappy(spark, d)))


_T = yearly.TIMING_PERCENTILES


@query(
    "y17_median_flow_dates",
    f"""WITH {GAPPY}, t AS (SELECT gage_id, {", ".join(f"quantile_cont(q, {p / 100}) AS t{p}" for p in _T)} FROM gappy GROUP BY 1),
    y AS (SELECT gage_id, year, {", ".join(f"min(doy) FILTER (WHERE q <= t{p}) AS d{p}" for p in _T)} FROM gappy JOIN t USING (gage_id) GROUP BY 1, 2)
    SELECT gage_id, {", ".join(f"median(d{p}) AS D{p}_med_date" for p in _T)} FROM y GROUP BY 1""",
)
def _(spark, d):
    return yearly.median_flow_dates(gappy(spark, d))


# Daily noise seldom recedes for five days, so the recession queries run on a record
# that decays through each month and is broken on days of high flow.
_SETTLED = """SELECT gage_id, date, year, month, doy,
  1 + exp(-dayofmonth(date) / (3 + month / 4.0::DOUBLE)) * (1 + sum(q) OVER (PARTITION BY gage_id, year, month) / 1000)
    + CASE WHEN q >= 170 THEN 0.5 ELSE 0 END AS q"""
SETTLING = DAILY + f""",
settling AS ({_SETTLED} FROM daily)"""


def settling(spark, d):
    """Exponential recessions restarting each month, broken on days of high flow."""
    level = F.sum("q").over(Window.partitionBy("gage_id", "year", "month"))
    decay = F.exp(-F.dayofmonth("date") / (3 + F.col("month") / 4.0))
    bump = F.when(F.col("q") >= 170, 0.5).otherwise(0)
    return daily(spark, d).withColumn("q", 1 + decay * (1 + level / 1000) + bump)


_LEADS = [f"lead(q, {k}) OVER w AS q{k}" for k in range(1, 6)]
_FALL = " AND ".join(
    f"{a} > {b} AND abs({c} - {b}) < abs({b} - {a})"
    for a, b, c in [("q", "q1", "q2"), ("q1", "q2", "q3"), ("q2", "q3", "q4"), ("q3", "q4", "q5")]
)
EVENTS = SETTLING + f""",
ld AS (SELECT gage_id, year, doy, q, {", ".join(_LEADS)}, row_number() OVER w AS i, count(*) OVER (PARTITION BY gage_id, year) AS n
  FROM settling WINDOW w AS (PARTITION BY gage_id, year ORDER BY doy)),
fl AS (SELECT *, coalesce(i <= n - 5 AND {_FALL}, false) AS falling FROM ld),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY gage_id, year, falling ORDER BY doy) AS grp FROM fl),
ev AS (SELECT gage_id, year, min(i) AS "start", CASE WHEN max(i) = max(n) - 5 THEN max(n) ELSE max(i) END AS "end", max(i) = max(n) - 5 AS open
  FROM isl WHERE falling GROUP BY gage_id, year, grp),
kept AS (SELECT gage_id, year, "start", "end", "end" - "start" + 1 AS len FROM ev WHERE open OR "end" - "start" + 1 >= 5),
pts AS (SELECT k.gage_id, k.year, k.start, k.len, f.i - k.start + 1 AS pos, f.doy,
    CASE WHEN f.i < k.end AND f.q > 0 AND f.q - f.q1 > 0 THEN ln(f.q) END AS x,
    CASE WHEN f.i < k.end AND f.q > 0 AND f.q - f.q1 > 0 THEN ln(f.q - f.q1) END AS y
  FROM kept k JOIN fl f ON f.gage_id = k.gage_id AND f.year = k.year AND f.i BETWEEN k.start AND k.end),
fits AS (SELECT gage_id, year, "start", max(len) AS len, max(doy) FILTER (WHERE pos = ceil(len / 2.0)) AS doy,
    CASE WHEN count(x) FILTER (WHERE pos >= 2) >= 2 THEN regr_intercept(y, x) FILTER (WHERE pos >= 2) END AS log_a,
    CASE WHEN count(x) FILTER (WHERE pos >= 2) >= 2 THEN regr_slope(y, x) FILTER (WHERE pos >= 2) END AS b,
    CASE WHEN max(len) >= 6 AND count(x) FILTER (WHERE pos < len // 2) >= 2 AND count(x) FILTER (WHERE pos >= len // 2) >= 2 THEN
      regr_slope(y, x) FILTER (WHERE pos >= len // 2) - regr_slope(y, x) FILTER (WHERE pos < len // 2) END AS concavity
  FROM pts GROUP BY gage_id, year, "start"),
good AS (SELECT * FROM fits WHERE log_a IS NOT NULL AND b IS NOT NULL AND NOT isnan(b)),
mb AS (SELECT gage_id, year, median(b) AS median_b FROM good GROUP BY 1, 2),
cloud AS (SELECT p.gage_id, p.year, p.start, p.x, p.y, p.y - m.median_b * p.x AS shift, g.concavity
  FROM pts p JOIN good g ON g.gage_id = p.gage_id AND g.year = p.year AND g.start = p.start
  JOIN mb m ON m.gage_id = p.gage_id AND m.year = p.year WHERE p.pos >= 2 AND p.x IS NOT NULL),
ym AS (SELECT gage_id, year, CASE WHEN count(*) > 10 THEN median(shift) END AS la, CASE WHEN count(*) > 10 THEN regr_slope(y, x) END AS bp
  FROM cloud GROUP BY 1, 2),
es AS (SELECT gage_id, year, "start", median(shift) AS la FROM cloud GROUP BY 1, 2, 3),
ey AS (SELECT gage_id, year, median(la) AS la FROM es GROUP BY 1, 2),
cy AS (SELECT gage_id, year, avg(concavity) AS c FROM good GROUP BY 1, 2),
yr AS (SELECT m.gage_id, m.year, ym.la AS log_a_pointcloud, ey.la AS log_a_events, ym.bp AS b_pointcloud, m.median_b AS b_events, cy.c AS concavity,
    count(*) OVER (PARTITION BY m.gage_id) AS ny
  FROM mb m JOIN ym USING (gage_id, year) JOIN ey USING (gage_id, year) JOIN cy USING (gage_id, year))"""


@query(
    "r1_r2_recession_events",
    f"""WITH {EVENTS} SELECT gage_id, year, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end",
    CAST(len AS BIGINT) AS len FROM kept""",
)
def _(spark, d):
    ev = recession.events(settling(spark, d))
    return ev.select("gage_id", "year", *[F.col(c).cast("bigint").alias(c) for c in ("start", "end", "len")])


@query(
    "r3_r4_event_fit",
    f"""WITH {EVENTS} SELECT gage_id, year, CAST(doy AS INTEGER) AS doy, round(log_a, 4) AS log_a, round(b, 4) AS b,
    round(concavity, 4) AS concavity FROM good""",
)
def _(spark, d):
    fits = recession.event_fits(settling(spark, d))
    return fits.select("gage_id", "year", "doy", *[F.round(c, 4).alias(c) for c in ("log_a", "b", "concavity")])


@query(
    "r5_r6_r9_yearly_recession",
    f"WITH {EVENTS} " + _union_sql([(m, m) for m in trends.RECESSION_METRICS], "yr WHERE ny >= 3) z").replace(
        "FROM yr WHERE ny >= 3) z WHERE", "FROM (SELECT * FROM yr WHERE ny >= 3) z WHERE"
    ),
)
def _(spark, d):
    return _year_rows(recession.recession_metrics(recession.event_fits(settling(spark, d))))


def _season_fit_sql(name, cond):
    return f"""{name} AS (SELECT gage_id, count(*) AS n, sum(s) AS s, sum(c) AS c, sum(s * s) AS ss, sum(c * c) AS cc, sum(s * c) AS sc,
      sum(y) AS y, sum(s * y) AS sy, sum(c * y) AS cy FROM sn WHERE {cond} GROUP BY 1),
    {name}b AS (SELECT gage_id, n, ss - s * s / n AS a11, cc - c * c / n AS a22, sc - s * c / n AS a12, sy - s * y / n AS r1, cy - c * y / n AS r2 FROM {name}),
    {name}s AS (SELECT gage_id, CASE WHEN n >= 10 THEN (r1 * a22 - r2 * a12) / (a11 * a22 - a12 * a12) END AS b1,
      CASE WHEN n >= 10 THEN (r2 * a11 - r1 * a12) / (a11 * a22 - a12 * a12) END AS b2 FROM {name}b),
    {name}p AS (SELECT gage_id, sqrt(b1 * b1 + b2 * b2) AS amp, atan2(-b2, b1) * 365 / (2 * pi()) AS ph FROM {name}s),
    {name}m AS (SELECT gage_id, amp, CASE WHEN ph < 0 THEN ph + 365 ELSE ph END + 273.75 AS low FROM {name}p)"""


@query(
    "r7_r8_log_a_seasonality",
    f"""WITH {EVENTS}, md AS (SELECT gage_id, median(year) AS mid, count(*) AS ny FROM (SELECT DISTINCT gage_id, year FROM good) GROUP BY 1),
    sn AS (SELECT gage_id, year, mid, sin(2 * pi() * doy / 365) AS s, cos(2 * pi() * doy / 365) AS c, log_a AS y FROM good JOIN md USING (gage_id) WHERE ny >= 3),
    {_season_fit_sql("fa", "true")}, {_season_fit_sql("ff", "year <= mid")}, {_season_fit_sql("fl2", "year > mid")}
    SELECT fam.gage_id, round(fam.amp, 4) AS log_a_seasonality_amplitude_all,
      round(CASE WHEN fam.low > 365 THEN fam.low - 365 ELSE fam.low END, 3) AS log_a_seasonality_minimum_all,
      round(ffm.amp, 4) AS log_a_seasonality_amplitude_first_half,
      round(CASE WHEN ffm.low > 365 THEN ffm.low - 365 ELSE ffm.low END, 3) AS log_a_seasonality_minimum_first_half,
      round(fl2m.amp, 4) AS log_a_seasonality_amplitude_last_half,
      round(CASE WHEN fl2m.low > 365 THEN fl2m.low - 365 ELSE fl2m.low END, 3) AS log_a_seasonality_minimum_last_half
    FROM fam LEFT JOIN ffm USING (gage_id) LEFT JOIN fl2m USING (gage_id) WHERE fam.amp IS NOT NULL""",
)
def _(spark, d):
    out = recession.log_a_seasonality(recession.event_fits(settling(spark, d)))
    return out.select(
        "gage_id", *[F.round(c, 4 if "amplitude" in c else 3).alias(c) for c in out.columns if c != "gage_id"]
    )


# ---- trends -------------------------------------------------------------------

TRENDS = """
tv AS (SELECT gage_id, metric, year, value FROM yv WHERE value IS NOT NULL AND NOT isnan(value)),
tn AS (SELECT gage_id, metric, count(*) AS n, avg(value) AS mean, median(value) AS median FROM tv GROUP BY 1, 2 HAVING count(*) >= 3),
sen AS (SELECT a.gage_id, a.metric, median((b.value - a.value) / (b.year - a.year)) AS slp
  FROM tv a JOIN tv b ON a.gage_id = b.gage_id AND a.metric = b.metric AND b.year > a.year GROUP BY 1, 2),
rk AS (SELECT gage_id, metric, rank() OVER (PARTITION BY gage_id, metric ORDER BY value) +
    (count(*) OVER (PARTITION BY gage_id, metric, value) - 1) / 2.0::DOUBLE AS r,
    count(*) OVER (PARTITION BY gage_id, metric, value) AS same, row_number() OVER (PARTITION BY gage_id, metric ORDER BY year) AS yr FROM tv),
sp AS (SELECT gage_id, metric, CASE WHEN min(r) < max(r) THEN corr(yr, r) END AS rho, max(same) > 1 AS tied, sum((yr - r) * (yr - r)) AS s FROM rk GROUP BY 1, 2),
perms(n, used, s) AS (
  SELECT n, []::INTEGER[], 0 FROM (SELECT unnest([3, 4, 5, 6, 7]) AS n)
  UNION ALL SELECT p.n, list_append(p.used, r), p.s + (len(p.used) + 1 - r) * (len(p.used) + 1 - r)
  FROM perms p, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS r) WHERE r <= p.n AND NOT list_contains(p.used, r) AND len(p.used) < p.n),
pc AS (SELECT n, s, count(*) AS c FROM perms WHERE len(used) = n GROUP BY 1, 2),
pt AS (SELECT a.n, a.s, least(1.0, 2.0::DOUBLE * CASE WHEN a.s > (a.n ** 3 - a.n) / 6 THEN sum(b.c) FILTER (WHERE b.s >= a.s)
    ELSE sum(b.c) FILTER (WHERE b.s <= a.s) END / sum(b.c)) AS p FROM pc a JOIN pc b ON a.n = b.n GROUP BY a.n, a.s),
th AS (SELECT sp.*, n, mean, median, atan(abs(rho) * sqrt((n - 2) / greatest(1 - rho * rho, 1e-300)) / sqrt(n - 2.0::DOUBLE)) AS th FROM sp JOIN tn USING (gage_id, metric)),
pv AS (SELECT th.*, CASE WHEN rho IS NULL THEN NULL WHEN NOT tied THEN pt.p WHEN 1 - rho * rho < 1e-14 THEN 0 ELSE greatest(0, 1 - CASE th.n
    WHEN 3 THEN 2 * th / pi() WHEN 4 THEN sin(th) WHEN 5 THEN 2 / pi() * (th + sin(th) * cos(th))
    WHEN 6 THEN sin(th) * (1 + cos(th) ** 2 / 2)
    WHEN 7 THEN 2 / pi() * (th + sin(th) * (cos(th) + 2.0::DOUBLE / 3 * cos(th) ** 3)) END) END AS pval
  FROM th LEFT JOIN pt ON pt.n = th.n AND pt.s = th.s AND NOT tied),
tr AS (SELECT gage_id, metric, n, slp, rho, pval,
    CASE WHEN metric LIKE 'D%_day' OR metric IN ('D25_to_D75', 'Dmax') THEN round_even(mean, 0) ELSE mean END AS mean,
    CASE WHEN metric LIKE 'D%_day' OR metric IN ('D25_to_D75', 'Dmax') THEN round_even(median, 0) ELSE median END AS median
  FROM pv JOIN sen USING (gage_id, metric))"""

TREND_ROWS = """SELECT gage_id, metric, CAST(n AS BIGINT) AS n, round(slp, 4) AS slp, round(rho, 4) AS rho, round(pval, 4) AS pval,
  round(mean, 4) AS mean, round(median, 4) AS median FROM tr"""


def _trend_rows(df):
    return df.select("gage_id", "metric", "n", *[F.round(s, 4).alias(s) for s in trends.STATS])


def _yearly_sql(*names):
    """Unrounded yearly rows of several queries, on the record without gaps."""
    parts = []
    for name in names:
        text = SQL[name].replace(", 4) AS value", ", 13) AS value").replace(", 8) AS value", ", 13) AS value")
        parts.append("SELECT * FROM (" + text.replace(f"NOT ({GAP})", "true") + ")")
    return "\nUNION ALL ".join(parts)


def _trend_sql(*names):
    return f"WITH RECURSIVE yv AS ({_yearly_sql(*names)}), {TRENDS} "


@query("t1_t2_t3_t4_volume_trends", _trend_sql("y1_y2_volumes", "y3_y4_percentiles") + TREND_ROWS)
def _(spark, d):
    days = daily(spark, d)
    return _trend_rows(trends.trends(yearly.volumes(days).unionByName(yearly.flow_percentiles(days))))


@query("t3_t4_timing_trends", _trend_sql("y7_y8_y9_timing") + TREND_ROWS)
def _(spark, d):
    return _trend_rows(trends.trends(yearly.timing(daily(spark, d))))


_FAMILIES = [
    "y1_y2_volumes", "y3_y4_percentiles", "y5_fdc_slopes", "y6_flashiness", "y7_y8_y9_timing", "y10_y11_pulses",
    "y12_tqmean", "y13_reversals", "y15_y16_baseflow", "y14_runoff_ratio",
]
_WIDE = ", ".join(
    f"round(max({s}) FILTER (WHERE metric = '{m}'), 4) AS {m}_{s}"
    for m in trends.METRICS if m not in trends.RECESSION_METRICS for s in trends.STATS
)
_HEADER = f"""hd AS (WITH {DAILY} SELECT gage_id, CAST(count(DISTINCT year) AS BIGINT) AS num_years, min(year) AS start_year,
  max(year) AS end_year FROM daily GROUP BY 1), wd AS (SELECT gage_id, {_WIDE} FROM tr GROUP BY 1)"""


def _summary(spark, d, families):
    days = daily(spark, d)
    if "runoff" in families:
        days = days.join(rain(spark, d), ["gage_id", "date"], "left")
    return signatures.gage_summary(days, min_years=5, families=families)


def _rounded(df, keep=("gage_id", "num_years", "start_year", "end_year")):
    return rounded(df, keep)


@query("t5_gage_summary", _trend_sql(*_FAMILIES) + f", {_HEADER} SELECT * FROM hd JOIN wd USING (gage_id)")
def _(spark, d):
    wide = _rounded(_summary(spark, d, [*yearly.FAMILIES, "runoff"]))
    return wide.drop(*[f"{m}_{s}" for m in trends.RECESSION_METRICS for s in trends.STATS])


_VOLUME_WIDE = ", ".join(
    f"round(max({s}) FILTER (WHERE metric = '{m}'), 4) AS {m}_{s}" for m in yearly.VOLUME_METRICS for s in trends.STATS
)


@query(
    "entry_gage_summary",
    _trend_sql("y1_y2_volumes", "y3_y4_percentiles")
    + f", hd AS (WITH {DAILY} SELECT gage_id, CAST(count(DISTINCT year) AS BIGINT) AS num_years, min(year) AS start_year, "
    f"max(year) AS end_year FROM daily GROUP BY 1) SELECT * FROM hd JOIN (SELECT gage_id, {_VOLUME_WIDE} FROM tr GROUP BY 1) USING (gage_id)",
)
def _(spark, d):
    wide = _rounded(_summary(spark, d, ["volumes", "percentiles"]))
    keep = [f"{m}_{s}" for m in yearly.VOLUME_METRICS for s in trends.STATS]
    return wide.select("gage_id", "num_years", "start_year", "end_year", *keep)


# The whole product on the settling record, recession included: every family's SQL with
# the settling record in the place of the daily one.
_SETTLING_DAILY = DAILY.replace("daily AS (", "raw_daily AS (") + f""",
daily AS ({_SETTLED} FROM raw_daily)"""


def _on_settling(text):
    text = text.replace(SETTLING, DAILY + ",\nsettling AS (SELECT * FROM daily)")
    return text.replace(DAILY, _SETTLING_DAILY)


_ALL_WIDE = ", ".join(
    f"round(max({s}) FILTER (WHERE metric = '{m}'), 4) AS {m}_{s}" for m in trends.METRICS for s in trends.STATS
)


@query(
    "signature_product",
    _on_settling(_trend_sql(*_FAMILIES, "r5_r6_r9_yearly_recession"))
    + f", se AS ({_on_settling(SQL['r7_r8_log_a_seasonality'])}), "
    + _HEADER.replace(_WIDE, _ALL_WIDE)
    + " SELECT * FROM hd JOIN wd USING (gage_id) LEFT JOIN se USING (gage_id)",
)
def _(spark, d):
    """Every metric, trend and seasonality column of every gage."""
    days = settling(spark, d).join(rain(spark, d), ["gage_id", "date"], "left")
    wide = signatures.gage_summary(days, min_years=5)
    minimum = [c for c in wide.columns if c.startswith("log_a_seasonality_minimum")]
    return _rounded(wide.withColumns({c: F.round(c, 3) for c in minimum}))
