"""Gap filling, forecast products and the reservoir water balance."""

from pyspark.sql import functions as F

from driver_queries.registry import registry, round_sql, rounded
from driver_queries.signatures import FILLED
from driver_queries.stand_ins import DAILY, GAPPY, MEASURES, RESERVOIR, daily, gappy, measures, reservoir, traces
from freshet.functions.cleaning import drop_partial_month, drop_until_complete, overlay_observed
from freshet.operators import forecast, gaps
from freshet.operators import reservoir as res
from freshet.plans import weekly

QUERIES, SQL, query = registry()

GAGE = ["gage_id"]
START = "2000-10-01"  # a water year start inside the record
PRED = [f"Pred_{q}" for q in forecast.QUANTILES]
CLIM = [f"Clim_{q}" for q in forecast.QUANTILES]
YEARS = ["WaterYear_Curr", "WaterYear_1YrAgo", "WaterYear_2YrAgo", "WaterYear_3YrAgo"]

# The same interpolation over a whole record, not year by year.
WHOLE = (
    FILLED.replace("PARTITION BY gage_id, year", "PARTITION BY gage_id")
    .replace("ORDER BY doy", "ORDER BY date")
    .replace("AND b.year = n.year ", "")
    .replace("AND a.year = n.year ", "")
    .replace("SELECT n.gage_id, n.year, n.doy", "SELECT n.gage_id, n.date, n.q IS NULL AS gap, b.q IS NULL OR a.q IS NULL AS at_end, n.doy")
)


@query("g1_interpolate", f"WITH {GAPPY}, {WHOLE} SELECT gage_id, date, round(CASE WHEN NOT (gap AND at_end) THEN q END, 4) AS q FROM filled")
def _(spark, d):
    out = gaps.interpolate_linear(gappy(spark, d), GAGE, "date", "q")
    return out.select("gage_id", "date", F.round("q", 4).alias("q"))


@query("g2_interpolate_flat_ends", f"WITH {GAPPY}, {WHOLE} SELECT gage_id, date, round(q, 4) AS q FROM filled")
def _(spark, d):
    out = gaps.interpolate_linear(gappy(spark, d), GAGE, "date", "q", ends="flat")
    return out.select("gage_id", "date", F.round("q", 4).alias("q"))


@query(
    "g3_edge_fill",
    f"""WITH {GAPPY}, e AS (SELECT gage_id, min(date) AS lo, max(date) AS hi, arg_min(q, date) FILTER (WHERE q IS NOT NULL) AS fq,
      arg_max(q, date) FILTER (WHERE q IS NOT NULL) AS lq FROM gappy GROUP BY 1)
    SELECT gage_id, date, coalesce(q, CASE WHEN date = lo THEN fq END, CASE WHEN date = hi THEN lq END) AS q FROM gappy JOIN e USING (gage_id)""",
)
def _(spark, d):
    return gaps.fill_edges(gappy(spark, d), GAGE, "date", "q").select("gage_id", "date", "q")


@query(
    "g4_mean_fill",
    f"WITH {GAPPY} SELECT gage_id, date, round(coalesce(q, avg(q) OVER (PARTITION BY gage_id, year)), 4) AS q FROM gappy",
)
def _(spark, d):
    out = gaps.fill_mean(gappy(spark, d), ["gage_id", "year"], "q")
    return out.select("gage_id", "date", F.round("q", 4).alias("q"))


@query(
    "g5_median_fill",
    f"""WITH {MEASURES}, h AS (SELECT gage_id, member, date, CASE WHEN m2 > 30 THEN m2 END AS m2, CASE WHEN m3 < 90 THEN m3 END AS m3 FROM measures)
    SELECT gage_id, member, date, round(coalesce(m2, (SELECT median(m2) FROM h)), 4) AS m2, round(coalesce(m3, (SELECT median(m3) FROM h)), 4) AS m3 FROM h""",
)
def _(spark, d):
    holes = measures(spark, d).select(
        "gage_id", "member", "date", F.when(F.col("m2") > 30, F.col("m2")).alias("m2"), F.when(F.col("m3") < 90, F.col("m3")).alias("m3")
    )
    return rounded(gaps.fill_median(holes, ["m2", "m3"], bins=64), ["gage_id", "member", "date"])


@query(
    "g5_infinite",
    f"""WITH {MEASURES}, h AS (SELECT gage_id, member, date, CASE WHEN m2 > 60 THEN 'inf'::DOUBLE WHEN m2 > 30 THEN m2 WHEN m2 < 5 THEN '-inf'::DOUBLE END AS m2 FROM measures)
    SELECT gage_id, member, date, round(coalesce(m2, (SELECT median(m2) FROM h)), 4) AS m2 FROM h""",
)
def _(spark, d):
    inf, m2 = F.lit(float("inf")), F.col("m2")
    holes = measures(spark, d).select("gage_id", "member", "date", F.when(m2 > 60, inf).when(m2 > 30, m2).when(m2 < 5, -inf).alias("m2"))
    return rounded(gaps.fill_median(holes, ["m2"]), ["gage_id", "member", "date"])


@query(
    "g5_median_by_cube",
    f"""WITH {MEASURES}, h AS (SELECT gage_id, member, date, CAST(date_trunc('month', date) AS DATE) AS cube,
      CASE WHEN dayofyear(date) % 4 <> gage_id % 4 THEN m2 END AS m2, CASE WHEN dayofyear(date) % 3 <> 0 AND month(date) <> 5 THEN m3 END AS m3 FROM measures),
    k AS (SELECT cube, median(m2) AS k2, median(m3) AS k3 FROM h GROUP BY 1)
    SELECT gage_id, member, date, round(coalesce(m2, k2), 4) AS m2, round(coalesce(m3, k3), 4) AS m3 FROM h JOIN k USING (cube)""",
)
def _(spark, d):
    """Months as cubes, one in twelve without any value of m3."""
    day = F.dayofyear("date")
    holes = measures(spark, d).select(
        "gage_id", "member", "date", F.trunc("date", "month").alias("cube"),
        F.when(day % 4 != F.col("gage_id") % 4, F.col("m2")).alias("m2"),
        F.when((day % 3 != 0) & (F.month("date") != 5), F.col("m3")).alias("m3"),
    )
    filled = gaps.fill_median(holes, ["m2", "m3"], bins=64, by=["cube"]).drop("cube")
    return rounded(filled, ["gage_id", "member", "date"])


@query(
    "g4_mean_fill_null_key",
    f"""WITH {MEASURES}, h AS (SELECT nullif(gage_id, 3) AS gage_id, member, date, CASE WHEN dayofyear(date) % 5 <> 0 THEN m2 END AS m2 FROM measures)
    SELECT gage_id, member, date, round(coalesce(m2, avg(m2) OVER (PARTITION BY gage_id)), 4) AS m2 FROM h""",
)
def _(spark, d):
    gage = F.when(F.col("gage_id") != 3, F.col("gage_id")).alias("gage_id")
    holes = measures(spark, d).select(gage, "member", "date", F.when(F.dayofyear("date") % 5 != 0, F.col("m2")).alias("m2"))
    return rounded(gaps.fill_mean(holes, ["gage_id"], "m2"), ["gage_id", "member", "date"])


@query(
    "g6_next_value",
    f"""WITH {GAPPY} SELECT gage_id, date, first_value(q IGNORE NULLS) OVER (PARTITION BY gage_id ORDER BY date
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM gappy""",
)
def _(spark, d):
    return gaps.fill_next(gappy(spark, d), GAGE, "date", "q").select("gage_id", "date", "q")


@query(
    "p18_partial_month",
    f"""WITH {MEASURES}, l AS (SELECT gage_id, member, max(date) AS hi FROM measures GROUP BY 1, 2)
    SELECT gage_id, member, CAST(count(*) AS BIGINT) AS n, max(date) AS last_date FROM measures JOIN l USING (gage_id, member)
    WHERE hi = last_day(hi) OR date < date_trunc('month', hi) GROUP BY 1, 2""",
)
def _(spark, d):
    kept = drop_partial_month(measures(spark, d), ["gage_id", "member"])
    return kept.groupBy("gage_id", "member").agg(F.count("*").alias("n"), F.max("date").alias("last_date"))


@query(
    "p21_until_complete",
    f"""WITH {RESERVOIR}, f AS (SELECT gage_id, min(date) AS lo FROM reservoir WHERE stor IS NOT NULL AND inflow IS NOT NULL GROUP BY 1)
    SELECT gage_id, CAST(count(*) AS BIGINT) AS n, min(date) AS first_date FROM reservoir JOIN f USING (gage_id) WHERE date >= lo GROUP BY 1""",
)
def _(spark, d):
    kept = drop_until_complete(reservoir(spark, d), GAGE, ["stor", "inflow"])
    return kept.groupBy("gage_id").agg(F.count("*").alias("n"), F.min("date").alias("first_date"))


@query(
    "j10_ensemble",
    f"""WITH {MEASURES}, mb AS (SELECT DISTINCT gage_id, member FROM measures),
    ps AS (SELECT gage_id, param_id, sum(sim) AS total FROM traces GROUP BY 1, 2)
    SELECT gage_id, member, CAST(param_id AS INTEGER) AS param_id, round(total, 7) AS total FROM mb JOIN ps USING (gage_id)""",
)
def _(spark, d):
    members = measures(spark, d).select("gage_id", "member").distinct()
    params = traces(spark, d).groupBy("gage_id", "param_id").agg(F.round(F.sum("sim"), 7).alias("total"))
    return forecast.ensemble(members, params, GAGE)


@query(
    "j11_splice",
    f"""WITH {MEASURES}, hist AS (SELECT gage_id, date, q FROM daily WHERE date < DATE '2000-01-01'),
    cut AS (SELECT gage_id, max(date) AS hi FROM hist GROUP BY 1),
    s AS (SELECT h.gage_id, m.member, h.date, h.q, false AS is_forecast FROM hist h JOIN (SELECT DISTINCT gage_id, member FROM measures) m ON h.gage_id = m.gage_id
      UNION ALL SELECT x.gage_id, x.member, x.date, x.m1, true FROM measures x JOIN cut c ON x.gage_id = c.gage_id WHERE x.date > c.hi)
    SELECT gage_id, member, is_forecast, CAST(count(*) AS BIGINT) AS n, sum(q) AS q, min(date) AS lo, max(date) AS hi FROM s GROUP BY 1, 2, 3""",
)
def _(spark, d):
    history = daily(spark, d).filter("date < '2000-01-01'").select("gage_id", "date", "q")
    ahead = measures(spark, d).select("gage_id", "member", "date", F.col("m1").alias("q"))
    out = forecast.splice(history, ahead, GAGE)
    return out.groupBy("gage_id", "member", "is_forecast").agg(
        F.count("*").alias("n"), F.sum("q").alias("q"), F.min("date").alias("lo"), F.max("date").alias("hi")
    )


CLIMATOLOGY = f"""
ord AS (SELECT gage_id, date, q AS v, row_number() OVER (PARTITION BY gage_id ORDER BY date) AS i FROM gappy),
st AS (SELECT gage_id, i AS s FROM ord WHERE dayofyear(date) = dayofyear(DATE '{START}')),
bl AS (SELECT o.gage_id, s, o.i - s + 1 AS day_of_wy, date, v FROM st JOIN ord o ON o.gage_id = st.gage_id AND o.i BETWEEN s AND s + 364
  WHERE s < (SELECT max(s) FROM st z WHERE z.gage_id = st.gage_id)),
okb AS (SELECT gage_id, s, avg(v) AS mean FROM bl GROUP BY 1, 2 HAVING count(*) = 365 AND max(date) - min(date) <= 366),
cv AS (SELECT gage_id, s, day_of_wy, CASE WHEN day_of_wy = 1 AND coalesce(v, mean) < 1 THEN 1 ELSE coalesce(v, mean) END AS v FROM bl JOIN okb USING (gage_id, s)),
cc AS (SELECT gage_id, s, day_of_wy, sum(v) OVER (PARTITION BY gage_id, s ORDER BY day_of_wy) AS c FROM cv),
clim AS (SELECT gage_id, day_of_wy, {", ".join(f"quantile_cont(c, {p}) AS Clim_{q}" for q, p in forecast.QUANTILES.items())} FROM cc GROUP BY 1, 2)"""


# The raw record misses days, and a year of 365 rows would span too many of them: the
# climatology runs on a record without missing days.
def every_day(spark, d):
    """The gappy record on a complete calendar, one row per day from first to last."""
    rows = gappy(spark, d).select("gage_id", "date", "q")
    span = rows.groupBy("gage_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    spine = span.select("gage_id", F.explode(F.expr("sequence(lo, hi)")).alias("date"))
    return spine.join(rows, ["gage_id", "date"], "left")


FULL = GAPPY.replace("gappy AS", "sparse AS") + """,
gappy AS (SELECT s.gage_id, s.date, sparse.q FROM
  (SELECT gage_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM sparse GROUP BY gage_id) s
  LEFT JOIN sparse ON sparse.gage_id = s.gage_id AND sparse.date = s.date)"""


@query(
    "f1_wy_climatology",
    f"WITH {FULL}, {CLIMATOLOGY} SELECT gage_id, CAST(day_of_wy AS INTEGER) AS day_of_wy, {round_sql(CLIM, 6)} FROM clim",
)
def _(spark, d):
    return rounded(forecast.water_year_climatology(every_day(spark, d), START, "q", GAGE), ["gage_id", "day_of_wy"], 6)


@query(
    "f1_wy_climatology_missing_days",
    f"WITH {GAPPY}, {CLIMATOLOGY} SELECT gage_id, CAST(day_of_wy AS INTEGER) AS day_of_wy, {round_sql(CLIM, 6)} FROM clim",
)
def _(spark, d):
    return rounded(forecast.water_year_climatology(gappy(spark, d), START, "q", GAGE), ["gage_id", "day_of_wy"], 6)


PREDICTED = f"""
wyt AS (SELECT t.gage_id, t.member, t.param_id, t.date, coalesce(g.q, t.sim) AS v FROM traces t
  LEFT JOIN (SELECT gage_id, date, q FROM daily WHERE date BETWEEN DATE '{START}' AND DATE '2001-03-01') g ON g.gage_id = t.gage_id AND g.date = t.date
  WHERE t.date >= DATE '{START}' AND t.date < DATE '{START}' + INTERVAL 1 YEAR),
wyc AS (SELECT gage_id, date, sum(v) OVER (PARTITION BY gage_id, member, param_id ORDER BY date) AS c FROM wyt),
pred AS (SELECT gage_id, date, {", ".join(f"quantile_cont(c, {p}) AS Pred_{q}" for q, p in forecast.QUANTILES.items())} FROM wyc GROUP BY 1, 2)"""


def observed(spark, d):
    return daily(spark, d).filter("date <= '2001-03-01'").select("gage_id", "date", F.col("q").alias("obs"))


@query("f2_ensemble_quantiles", f"WITH {MEASURES}, {PREDICTED} SELECT gage_id, date, {round_sql(PRED, 6)} FROM pred")
def _(spark, d):
    return rounded(forecast.forecast_quantiles(traces(spark, d), START, observed(spark, d), keys=GAGE), ["gage_id", "date"], 6)


# One total per trace that stops at its first gap; a quantile needs a value of some trace.
@query(
    "f2_with_gaps",
    f"""WITH {MEASURES}, t AS (SELECT gage_id, member, param_id, date, CASE WHEN (dayofyear(date) + param_id) % 60 <> 0 THEN sim END AS v FROM traces
      WHERE date >= DATE '{START}' AND date < DATE '{START}' + INTERVAL 1 YEAR),
    c AS (SELECT gage_id, date, CASE WHEN count(*) FILTER (v IS NULL) OVER w = 0 THEN sum(v) OVER w END AS c FROM t WINDOW w AS (PARTITION BY gage_id, member, param_id ORDER BY date)),
    pred AS (SELECT gage_id, date, {", ".join(f"quantile_cont(c, {p}) AS Pred_{q}" for q, p in forecast.QUANTILES.items())} FROM c GROUP BY 1, 2)
    SELECT gage_id, date, {round_sql(PRED, 6)} FROM pred""",
)
def _(spark, d):
    holes = traces(spark, d).withColumn("sim", F.when((F.dayofyear("date") + F.col("param_id")) % 60 != 0, F.col("sim")))
    return rounded(forecast.forecast_quantiles(holes, START, keys=GAGE), ["gage_id", "date"], 6)


@query(
    "p20_overlay_observed",
    f"""WITH {MEASURES} SELECT t.gage_id, member, CAST(param_id AS INTEGER) AS param_id, round(sum(coalesce(g.q, t.sim)), 7) AS total FROM traces t
    LEFT JOIN (SELECT gage_id, date, q FROM daily WHERE date BETWEEN DATE '{START}' AND DATE '2001-03-01') g ON g.gage_id = t.gage_id AND g.date = t.date GROUP BY 1, 2, 3""",
)
def _(spark, d):
    out = overlay_observed(traces(spark, d), observed(spark, d), ["gage_id", "date"], since=START)
    return out.groupBy("gage_id", "member", "param_id").agg(F.round(F.sum("sim"), 7).alias("total"))


STORAGE_CLIM = f"""
sc AS (SELECT gage_id, dayofyear(date) AS doy, {", ".join(f"quantile_cont(stor, {p}) AS Clim_{q}" for q, p in forecast.QUANTILES.items())}
  FROM reservoir WHERE stor IS NOT NULL GROUP BY 1, 2),
sclim AS (SELECT gage_id, k + 1 AS day_of_wy, {", ".join(CLIM)} FROM sc JOIN (SELECT unnest(range(0, 365)) AS k) ON doy = dayofyear(DATE '{START}' + CAST(k AS INTEGER)))"""


@query(
    "f3_storage_climatology",
    f"WITH {RESERVOIR}, {STORAGE_CLIM} SELECT gage_id, CAST(day_of_wy AS INTEGER) AS day_of_wy, {round_sql(CLIM, 6)} FROM sclim",
)
def _(spark, d):
    held = reservoir(spark, d).filter("stor is not null")
    return rounded(forecast.storage_climatology(held, START, keys=GAGE), ["gage_id", "day_of_wy"], 6)


PAST = f"""
pw AS (SELECT gage_id, date, q, CASE WHEN date >= DATE '{START}' THEN 0 WHEN date >= DATE '{START}' - INTERVAL 1 YEAR THEN 1
    WHEN date >= DATE '{START}' - INTERVAL 2 YEAR THEN 2 WHEN date >= DATE '{START}' - INTERVAL 3 YEAR THEN 3 END AS ago FROM daily),
pn AS (SELECT gage_id, ago, row_number() OVER w AS day_of_wy, sum(q) OVER w AS c, q FROM pw WHERE ago IS NOT NULL WINDOW w AS (PARTITION BY gage_id, ago ORDER BY date)),
past AS (SELECT gage_id, day_of_wy, {", ".join(f"max(c) FILTER (WHERE ago = {k}) AS {n}" for k, n in enumerate(YEARS))} FROM pn WHERE day_of_wy <= 365 GROUP BY 1, 2)"""


@query("f4_wy_history", f"WITH {MEASURES}, {PAST} SELECT gage_id, CAST(day_of_wy AS INTEGER) AS day_of_wy, {', '.join(YEARS)} FROM past")
def _(spark, d):
    return forecast.water_year_history(daily(spark, d), START, "q", GAGE)


@query(
    "f4_with_gaps",
    f"""WITH {MEASURES}, {PAST.replace("q FROM daily)", "CASE WHEN dayofyear(date) % 97 <> 0 THEN q END AS q FROM daily)")
        .replace("sum(q) OVER w AS c", "CASE WHEN count(*) FILTER (q IS NULL) OVER w = 0 THEN sum(q) OVER w END AS c").replace("gage_id, date, q, CASE", "gage_id, date, CASE WHEN dayofyear(date) % 97 <> 0 THEN q END AS q, CASE")}
    SELECT gage_id, CAST(day_of_wy AS INTEGER) AS day_of_wy, {', '.join(YEARS)} FROM past""",
)
def _(spark, d):
    holes = daily(spark, d).withColumn("q", F.when(F.dayofyear("date") % 97 != 0, F.col("q")))
    return forecast.water_year_history(holes, START, "q", GAGE)


@query(
    "f4_storage_history",
    f"""WITH {MEASURES}, {PAST.replace("max(c)", "max(q)")} SELECT gage_id, CAST(day_of_wy AS INTEGER) AS day_of_wy, {', '.join(YEARS)} FROM past""",
)
def _(spark, d):
    return forecast.water_year_history(daily(spark, d), START, "q", GAGE, cumulative=False)


def product(spark, d):
    basins = daily(spark, d).select("gage_id").distinct()
    return forecast.forecast_product(
        basins,
        forecast.forecast_quantiles(traces(spark, d), START, observed(spark, d), keys=GAGE),
        forecast.water_year_climatology(every_day(spark, d), START, "q", GAGE),
        forecast.water_year_history(daily(spark, d), START, "q", GAGE),
        START,
        "streamflow",
        GAGE,
    )


PRODUCT = f"""{MEASURES}, {FULL[len(DAILY) + 1:]}, {CLIMATOLOGY}, {PREDICTED}, {PAST},
product AS (SELECT b.gage_id, k AS day_of_wy, DATE '{START}' + CAST(k - 1 AS INTEGER) AS date, {", ".join(PRED + CLIM + YEARS)}
  FROM (SELECT DISTINCT gage_id FROM daily) b CROSS JOIN (SELECT unnest(range(1, 366)) AS k)
  LEFT JOIN pred p ON p.gage_id = b.gage_id AND p.date = DATE '{START}' + CAST(k - 1 AS INTEGER)
  LEFT JOIN clim c ON c.gage_id = b.gage_id AND c.day_of_wy = k LEFT JOIN past h ON h.gage_id = b.gage_id AND h.day_of_wy = k)"""


@query(
    "f5_forecast_product",
    f"""WITH {PRODUCT} SELECT gage_id, CAST(day_of_wy AS INTEGER) AS day_of_wy, date, {round_sql(PRED + CLIM, 6)}, {', '.join(YEARS)},
    'Acre Feet' AS units, 'streamflow' AS storage_or_streamflow FROM product""",
)
def _(spark, d):
    keep = ["gage_id", "day_of_wy", "date", *YEARS, "units", "storage_or_streamflow"]
    return rounded(product(spark, d), keep, 6)


SIGNIF2 = "round_even(x * 10 ** -(floor(log10(abs(x))) - 1), 0) / 10 ** -(floor(log10(abs(x))) - 1)"


@query(
    "f6_percent_of_average",
    f"""WITH {PRODUCT}, l AS (SELECT gage_id, arg_max(WaterYear_1YrAgo / Clim_Q50, day_of_wy) FILTER (WHERE WaterYear_1YrAgo IS NOT NULL) AS x FROM product GROUP BY 1)
    SELECT gage_id, round({SIGNIF2} * 100, 6) AS percent_of_average FROM l""",
)
def _(spark, d):
    return rounded(forecast.percent_of_average(product(spark, d), GAGE, "WaterYear_1YrAgo"), ["gage_id"], 6)


@query(
    "f7_smooth_climatology",
    f"""WITH {FULL}, {CLIMATOLOGY}, w AS (SELECT a.gage_id, a.day_of_wy, exp(-0.5 * ((b.day_of_wy - a.day_of_wy) / (0.3706506::DOUBLE * 12)) ** 2) AS w, {", ".join("b." + c for c in CLIM)}
      FROM clim a JOIN clim b ON a.gage_id = b.gage_id AND abs(a.day_of_wy - b.day_of_wy) <= 17)
    SELECT gage_id, CAST(day_of_wy AS INTEGER) AS day_of_wy, {", ".join(f"round(sum(w * {c}) / sum(w), 6) AS {c}" for c in CLIM)} FROM w GROUP BY 1, 2""",
)
def _(spark, d):
    clim = forecast.water_year_climatology(every_day(spark, d), START, "q", GAGE)
    return rounded(forecast.smooth_climatology(clim, GAGE), ["gage_id", "day_of_wy"], 6)


@query(
    "f8_roll_years",
    f"""WITH {MEASURES}, {PAST} SELECT gage_id, CAST(day_of_wy AS INTEGER) AS day_of_wy, WaterYear_Curr, WaterYear_Curr AS WaterYear_1YrAgo,
    WaterYear_1YrAgo AS WaterYear_2YrAgo, WaterYear_2YrAgo AS WaterYear_3YrAgo FROM past""",
)
def _(spark, d):
    return forecast.roll_years(forecast.water_year_history(daily(spark, d), START, "q", GAGE), "2001-03-01", START)


# ---- reservoir ------------------------------------------------------------------

RECORDS = RESERVOIR + """,
r0 AS (SELECT gage_id, date, stor, inflow * 86400 / 43559.9::DOUBLE AS acft, row_number() OVER (PARTITION BY gage_id ORDER BY date) AS p FROM reservoir
  JOIN (SELECT gage_id, min(date) AS lo FROM reservoir WHERE stor IS NOT NULL AND inflow IS NOT NULL GROUP BY 1) USING (gage_id) WHERE date >= lo),
re AS (SELECT gage_id, max(p) AS last_p, arg_max(stor, p) FILTER (WHERE stor IS NOT NULL) AS last_s,
  arg_max(acft, p) FILTER (WHERE acft IS NOT NULL) AS last_i FROM r0 GROUP BY 1),
r1 AS (SELECT gage_id, date, p, coalesce(stor, CASE WHEN p = last_p THEN last_s END) AS s, coalesce(acft, CASE WHEN p = last_p THEN last_i END) AS a FROM r0 JOIN re USING (gage_id)),
r2 AS (SELECT *, max(CASE WHEN s IS NOT NULL THEN p END) OVER (PARTITION BY gage_id ORDER BY p) AS pb,
  min(CASE WHEN s IS NOT NULL THEN p END) OVER (PARTITION BY gage_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pa FROM r1),
r3 AS (SELECT n.gage_id, n.date, n.p, coalesce(n.s, b.s + (c.s - b.s) * (n.p - n.pb) / (n.pa - n.pb)) AS stor,
  coalesce(n.a, avg(n.a) OVER (PARTITION BY n.gage_id)) AS inflow
  FROM r2 n JOIN r1 b ON b.gage_id = n.gage_id AND b.p = n.pb JOIN r1 c ON c.gage_id = n.gage_id AND c.p = n.pa),
r4 AS (SELECT gage_id, date, stor, inflow, -(lead(stor) OVER w - stor - inflow) AS loss FROM r3 WINDOW w AS (PARTITION BY gage_id ORDER BY date)),
r5 AS (SELECT gage_id, date, CASE WHEN stor <= 1 THEN 1 ELSE stor END AS stor, CASE WHEN inflow <= 1 THEN 1 ELSE inflow END AS inflow,
  CASE WHEN loss <= 1 THEN 1 ELSE loss END AS loss FROM r4),
r6 AS (SELECT gage_id, date, stor, inflow, loss * (1 - (avg(loss) OVER g - avg(inflow) OVER g) / avg(loss) OVER g) AS loss FROM r5 WINDOW g AS (PARTITION BY gage_id)),
records AS (SELECT *, avg(loss) OVER (PARTITION BY gage_id, dayofyear(date)) AS doy_loss FROM r6)"""


@query("w1_w2_w3_loss", f"WITH {RECORDS} SELECT gage_id, date, {round_sql(['stor', 'inflow', 'loss', 'doy_loss'], 6)} FROM records")
def _(spark, d):
    return rounded(res.loss_records(reservoir(spark, d), GAGE), ["gage_id", "date"], 6)


@query(
    "w1_loss_older_form",
    f"""WITH {RECORDS}, o AS (SELECT gage_id, date, -(lead(stor) OVER w - stor - lead(inflow) OVER w) AS loss FROM r3 WINDOW w AS (PARTITION BY gage_id ORDER BY date))
    SELECT gage_id, date, round(loss, 6) AS loss FROM o""",
)
def _(spark, d):
    out = res.loss_records(reservoir(spark, d), GAGE, inflow_of="tomorrow", floors=False)
    return out.select("gage_id", "date", F.round("loss", 6).alias("loss"))


@query(
    "w3_mean_loss_by_doy",
    f"WITH {RECORDS} SELECT gage_id, CAST(dayofyear(date) AS INTEGER) AS doy, round(avg(loss), 6) AS doy_loss FROM records GROUP BY 1, 2",
)
def _(spark, d):
    return rounded(res.mean_loss_by_doy(res.loss_records(reservoir(spark, d), GAGE), GAGE), ["gage_id", "doy"], 6)


_X = {"inflow": "inflow", "stor": "stor", "doy": "doy_loss"}
_MODELS = [(f"{p}_{f}", x if f == "lin" else f"ln({x})") for p, x in _X.items() for f in ("lin", "log")]
MODELS = (
    RECORDS
    + ",\nfit AS (SELECT gage_id, "
    + ", ".join(
        f"""regr_slope(loss, {x}) AS {n}_slope, regr_intercept(loss, {x}) AS {n}_intercept,
        1 - (1 - regr_r2(loss, {x})) * (regr_count(loss, {x}) - 1) / (regr_count(loss, {x}) - 2) AS {n}_adj"""
        for n, x in _MODELS
    )
    + " FROM records GROUP BY 1),\nmodels AS (SELECT *, "
    + ", ".join(f"{n}_adj / ({' + '.join(m + '_adj' for m, _ in _MODELS)}) AS {n}_weight" for n, _ in _MODELS)
    + " FROM fit)"
)
_MODEL_COLS = [f"{n}_{part}" for n, _ in _MODELS for part in ("slope", "intercept", "weight")]


@query("w4_weights", f"WITH {MODELS} SELECT gage_id, {round_sql(_MODEL_COLS, 4)} FROM models")
def _(spark, d):
    return rounded(res.loss_models(res.loss_records(reservoir(spark, d), GAGE), GAGE), ["gage_id"], 4)


def _fit_sql(p, x):
    return " + ".join(f"{p}_{f}_weight * ({p}_{f}_intercept + {v} * {p}_{f}_slope)" for f, v in (("log", f"ln({x})"), ("lin", x)))


# Observed storage ends with September 2000; the traces carry on from there.
PROJECT = MODELS.replace("FROM raw_reservoir)", f"FROM raw_reservoir WHERE date < DATE '{START}')") + f""",
tr AS (SELECT gage_id, member, t.k AS param_id, date, CASE k WHEN 1 THEN m1 WHEN 2 THEN m2 WHEN 3 THEN m3 WHEN 4 THEN m4 ELSE m5 END AS sim FROM
  (SELECT gage_id, member, date, sum(l_quantity) AS m1, sum(round(l_extendedprice * 100)) / 150000 AS m2, sum(l_quantity * (100 + round(l_tax * 100))) / 100 AS m3,
    sum(l_quantity * (100 - round(l_discount * 100))) / 100 AS m4, count(*) * 25.0::DOUBLE AS m5 FROM shipments GROUP BY 1, 2, 3) CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) t(k)),
l0 AS (SELECT gage_id, max(date) AS hi, arg_max(stor, date) AS s0 FROM records GROUP BY 1),
dl AS (SELECT gage_id, dayofyear(date) AS doy, avg(loss) AS doy_loss FROM records GROUP BY 1, 2),
a0 AS (SELECT tr.gage_id, member, param_id, date, s0, CASE WHEN sim <= 1 THEN 1 ELSE sim END AS x, dl.doy_loss, models.* EXCLUDE (gage_id)
  FROM tr JOIN l0 ON l0.gage_id = tr.gage_id JOIN models ON models.gage_id = tr.gage_id
  LEFT JOIN dl ON dl.gage_id = tr.gage_id AND dl.doy = dayofyear(tr.date) WHERE tr.date >= hi),
a1 AS (SELECT *, CASE WHEN z < 0 THEN 0 ELSE z END AS lif FROM (SELECT *, {_fit_sql('inflow', 'x')} + {_fit_sql('doy', 'doy_loss')} AS z FROM a0)),
a2 AS (SELECT * EXCLUDE (z), CASE WHEN y < 1 THEN 1 ELSE y END AS s1 FROM (
  SELECT *, CASE WHEN count(*) FILTER (x IS NULL) OVER w = 0 THEN sum(x) OVER w END AS cx,
    CASE WHEN count(*) FILTER (x IS NULL OR lif IS NULL) OVER w = 0 THEN s0 + sum(x) OVER w - sum(lif / (1 - (stor_log_weight + stor_lin_weight))) OVER w END AS y FROM a1
  WINDOW w AS (PARTITION BY gage_id, member, param_id ORDER BY date))),
a3 AS (SELECT * EXCLUDE (z), CASE WHEN z < 0 THEN 0 ELSE z END AS lt FROM (SELECT *, lif + {_fit_sql('stor', 's1')} AS z FROM a2)),
proj AS (SELECT gage_id, member, param_id, date, CASE WHEN z < 1 THEN 1 ELSE z END AS stor FROM (
  SELECT *, CASE WHEN count(*) FILTER (lt IS NULL) OVER w = 0 THEN s0 + cx - sum(lt) OVER w END AS z FROM a3
  WINDOW w AS (PARTITION BY gage_id, member, param_id ORDER BY date)))"""


def projected(spark, d, unseen=0):
    levels = reservoir(spark, d).filter(F.col("date") < START).filter(F.dayofyear("date") != unseen)
    records = res.loss_records(levels, GAGE).persist()  # models, last level and seasonal means
    inflow = traces(spark, d).withColumnRenamed("sim", "inflow")
    return res.project_storage(inflow, records, res.loss_models(records, GAGE), GAGE)


@query(
    "w5_storage",
    f"WITH {PROJECT} SELECT gage_id, member, CAST(param_id AS INTEGER) AS param_id, date, round(stor, 4) AS stor FROM proj",
)
def _(spark, d):
    return rounded(projected(spark, d), ["gage_id", "member", "param_id", "date"], 4)


@query(
    "w5_unseen_day",
    f"""WITH {PROJECT.replace(f"WHERE date < DATE '{START}')", f"WHERE date < DATE '{START}' AND dayofyear(date) <> 330)")}
    SELECT gage_id, member, CAST(param_id AS INTEGER) AS param_id, date, round(stor, 4) AS stor FROM proj""",
)
def _(spark, d):
    return rounded(projected(spark, d, unseen=330), ["gage_id", "member", "param_id", "date"], 4)


@query(
    "w6_storage_quantiles",
    f"""WITH {PROJECT} SELECT gage_id, date, {", ".join(f"round(quantile_cont(stor, {p}), 4) AS Pred_{q}" for q, p in forecast.QUANTILES.items())}
    FROM proj GROUP BY 1, 2""",
)
def _(spark, d):
    return rounded(res.storage_quantiles(projected(spark, d), GAGE), ["gage_id", "date"], 4)


# ---- the weekly product -------------------------------------------------------------

# Observations end on the first of March; the traces, 1/100 of the shipping measures as
# depth over 1500 km2, carry on.
LAST_DAY = "2001-03-01"
_STRETCH = 1.41421356  # many decimals, so no level sits on a rounding border
_TO_ACFT = "/ 100 * 1500 * 247.105::DOUBLE / 304.8::DOUBLE"


def _product_sql(kind, largest, digits):
    return f"""SELECT DATE '{START}' + CAST(k - 1 AS INTEGER) AS "Date", b.gage_id AS "Reservoir", 'Acre Feet' AS "Units", 40.0::DOUBLE AS "Lat", -120.0::DOUBLE AS "Lon",
      {round_sql(PRED + CLIM + YEARS, digits)}, {largest} AS "MaxStorage", '{kind}' AS "StorageOrStreamflow"
    FROM (SELECT DISTINCT gage_id FROM daily) b CROSS JOIN (SELECT unnest(range(1, 366)) AS k)
    LEFT JOIN pred p ON p.gage_id = b.gage_id AND p.date = DATE '{START}' + CAST(k - 1 AS INTEGER)
    LEFT JOIN clim c ON c.gage_id = b.gage_id AND c.day_of_wy = k LEFT JOIN past h ON h.gage_id = b.gage_id AND h.day_of_wy = k"""


_FLOW_SQL = f"""WITH {MEASURES},
gappy AS (SELECT gage_id, date, q * 86400 / 43559.9::DOUBLE AS q FROM daily WHERE date <= DATE '{LAST_DAY}'),
scaled AS (SELECT gage_id, member, param_id, date, sim {_TO_ACFT} AS sim FROM traces),
{CLIMATOLOGY},
{PREDICTED.replace("FROM traces t", "FROM scaled t").replace("q FROM daily WHERE", "q FROM gappy WHERE")},
{PAST.replace("FROM daily)", "FROM gappy)")}
{_product_sql("Streamflow", "NULL::DOUBLE", 4)}"""

_STORAGE_SQL = f"""WITH {PROJECT.replace(f"WHERE date < DATE '{START}')", f"WHERE date <= DATE '{LAST_DAY}')").replace(
    "ELSE m5 END AS sim FROM", f"ELSE m5 END {_TO_ACFT} AS sim FROM").replace("CASE k WHEN 1", "1.0::DOUBLE * CASE k WHEN 1").replace("s / 100 END", f"s / 100 * {_STRETCH}::DOUBLE END")},
held AS (SELECT DISTINCT gage_id, member, param_id FROM tr),
both_parts AS (SELECT gage_id, member, param_id, date, stor FROM proj
  UNION ALL SELECT r.gage_id, held.member, held.param_id, r.date, r.stor FROM records r JOIN l0 USING (gage_id) JOIN held USING (gage_id) WHERE r.date < l0.hi),
pred AS (SELECT gage_id, date, {", ".join(f"quantile_cont(stor, {p}) AS Pred_{q}" for q, p in forecast.QUANTILES.items())} FROM both_parts
  WHERE date >= DATE '{START}' AND date < DATE '{START}' + INTERVAL 1 YEAR GROUP BY 1, 2),
{STORAGE_CLIM.replace("FROM reservoir WHERE stor IS NOT NULL", "FROM records").replace("sclim AS", "clim AS")},
{PAST.replace("date, q, CASE", "date, stor AS q, CASE").replace("FROM daily)", "FROM records)").replace("max(c)", "max(q)")}
{_product_sql("Storage", "9000.0::DOUBLE", 4)}"""


@query("s10_weekly_product", f"SELECT * FROM ({_FLOW_SQL}) UNION ALL SELECT * FROM ({_STORAGE_SQL})")
def _(spark, d):
    """Streamflow and storage products of all basins, stacked as published."""
    basins = daily(spark, d).select(F.col("gage_id").alias("basin")).distinct().withColumns(
        {"lat": F.lit(40.0), "lon": F.lit(-120.0), "max_storage": F.lit(9000.0), "area": F.lit(1500.0)}
    )
    sim = traces(spark, d).withColumnRenamed("gage_id", "basin").withColumn("sim", F.col("sim") / 100)
    sensor = daily(spark, d).filter(F.col("date") <= LAST_DAY).select(
        F.col("gage_id").alias("basin"), "date", F.col("q").alias("value")
    )
    levels = reservoir(spark, d).filter(F.col("date") <= LAST_DAY).withColumnRenamed("gage_id", "basin")
    levels = levels.withColumn("stor", F.col("stor") * _STRETCH)
    flow, stor = weekly.streamflow(basins, sim, sensor, START), weekly.storage(basins, sim, levels, START)
    keep = [c for c in flow.columns if c not in (*PRED, *CLIM, *YEARS)]
    return weekly.weekly_product(rounded(flow, keep, 4), rounded(stor, keep, 4))
