"""Hindcast verification, monthly features, lag screening and the release model."""

from pyspark.sql import functions as F

from driver_queries.forecasts import RECORDS
from driver_queries.registry import registry, round_sql, rounded
from driver_queries.stand_ins import MEASURES, RESERVOIR, daily, reservoir, traces
from freshet.operators import features, release, verify
from freshet.operators import reservoir as res
from freshet.plans.release import storage_by_lead
from freshet.sources.staging import Staging

QUERIES, SQL, query = registry()

GAGE = ["gage_id"]
TRACE_KEYS = ["gage_id", *verify.TRACE]

# Every month starts a seven-month hindcast: a day belongs to the seven starts before it.
# Observations end in May 2001, so the last leads of the latest starts have none.
LAST_OBS = "2001-05-31"


def hindcast(spark, d):
    obs = daily(spark, d).filter(F.col("date") <= LAST_OBS).select("gage_id", "date", F.col("q").alias("obs"))
    rows = traces(spark, d).withColumnRenamed("sim", "pred").join(obs, ["gage_id", "date"], "left")
    month = F.trunc("date", "MM")
    starts = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.add_months(month, -k))
    return rows.withColumn("init_date", F.explode(starts))


HINDCAST = MEASURES + f""",
hind AS (SELECT t.gage_id, CAST(date_trunc('month', t.date) - INTERVAL 1 MONTH * k AS DATE) AS init_date, member, param_id, t.date, sim AS pred, o.q AS obs
  FROM traces t LEFT JOIN (SELECT gage_id, date, q FROM daily WHERE date <= DATE '{LAST_OBS}') o ON o.gage_id = t.gage_id AND o.date = t.date,
  (SELECT unnest(range(0, 7)) AS k)),
hm AS (SELECT gage_id, init_date, member, param_id, month(date) AS month, min(date) AS fd, count(*) AS n, avg(pred) AS p, avg(obs) AS o FROM hind GROUP BY 1, 2, 3, 4, 5),
hl AS (SELECT *, row_number() OVER (PARTITION BY gage_id, init_date, member, param_id ORDER BY fd) AS lead FROM hm),
leads AS (SELECT gage_id, init_date, member, param_id, lead, fd + 14 AS date, sum(p * n) OVER w AS pred,
    CASE WHEN count(o) OVER w = count(*) OVER w THEN sum(o * n) OVER w END AS act
  FROM hl WINDOW w AS (PARTITION BY gage_id, init_date, member, param_id ORDER BY lead)),
started AS (SELECT *, CAST(date - INTERVAL 1 MONTH * (lead - 1) AS DATE) AS start_date FROM leads WHERE pred IS NOT NULL AND act IS NOT NULL),
mc AS (SELECT gage_id, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, avg(q) * count(*) AS total FROM daily GROUP BY 1, 2, 3),
cl AS (SELECT a.gage_id, a.year AS start_year, a.month AS start_month, k AS lead, sum(b.total) AS total FROM mc a JOIN (SELECT unnest(range(1, 8)) AS k) ON true
  JOIN mc b ON b.gage_id = a.gage_id AND b.year * 12 + b.month BETWEEN a.year * 12 + a.month AND a.year * 12 + a.month + k - 1
  WHERE a.year < (SELECT max(year) FROM mc z WHERE z.gage_id = a.gage_id) GROUP BY 1, 2, 3, 4 HAVING count(*) = k)"""

_Q = [(f"quantile_cont({{v}}, {p})", p) for p in verify.TERCILES]


def _skill_sql(match, clim, source="started"):
    return f""",
pq AS (SELECT gage_id, start_date, lead, date, month(start_date) AS start_month, month(date) AS month, quantile_cont(pred, 0.333) AS p1,
    quantile_cont(pred, 0.5) AS p2, quantile_cont(pred, 0.667) AS p3, min(act) AS act FROM {source} GROUP BY gage_id, start_date, lead, date),
cq AS (SELECT gage_id, {match}, quantile_cont(total, 0.333) AS c1, quantile_cont(total, 0.5) AS c2, quantile_cont(total, 0.667) AS c3 FROM {clim} GROUP BY gage_id, {match}),
skill AS (SELECT gage_id, start_date, CAST(pq.month AS INTEGER) AS month, CAST(lead AS INTEGER) AS leadTime,
    CASE WHEN p2 > c3 THEN 3 WHEN p2 > c1 THEN 2 ELSE 1 END AS predTerc, CASE WHEN act > c3 THEN 3 WHEN act > c1 THEN 2 ELSE 1 END AS actTerc,
    p1 - act AS predMAE25, c1 - act AS climMAE25, p2 - act AS predMAE50, c2 - act AS climMAE50, p3 - act AS predMAE75, c3 - act AS climMAE75
  FROM pq LEFT JOIN cq USING (gage_id, {match}))"""


SKILL = HINDCAST + _skill_sql("start_month, lead", "cl")
ERRORS = [f"{w}MAE{q}" for q in ("25", "50", "75") for w in ("pred", "clim")]


def skill(spark, d):
    leads = verify.with_start_date(verify.lead_months(hindcast(spark, d), GAGE))
    clim = verify.climatology_by_lead(verify.monthly_climatology(daily(spark, d), GAGE, "q"), GAGE)
    return verify.skill_rows(leads, clim, GAGE)


@query("v1_monthly_climatology", f"WITH {HINDCAST} SELECT gage_id, year, month, round(total, 4) AS total FROM mc")
def _(spark, d):
    return rounded(verify.monthly_climatology(daily(spark, d), GAGE, "q"), ["gage_id", "year", "month"])


@query(
    "v1_monthly_storage",
    f"""WITH {RECORDS}, m AS (SELECT gage_id, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, arg_max(stor, date) AS total FROM records GROUP BY 1, 2, 3)
    SELECT gage_id, year, month, round(total, 4) AS total FROM m WHERE year < (SELECT max(year) FROM m z WHERE z.gage_id = m.gage_id)""",
)
def _(spark, d):
    records = res.loss_records(reservoir(spark, d), GAGE)
    return rounded(verify.monthly_storage_climatology(records, GAGE), ["gage_id", "year", "month"])


@query(
    "v2_v4_lead_months",
    f"""WITH {HINDCAST} SELECT gage_id, init_date, member, CAST(param_id AS INTEGER) AS param_id, CAST(lead AS INTEGER) AS lead, date, start_date,
    round(pred, 7) AS pred, round(act, 7) AS act FROM started""",
)
def _(spark, d):
    out = verify.with_start_date(verify.lead_months(hindcast(spark, d), GAGE))
    return rounded(out, [*TRACE_KEYS, "lead", "date", "start_date"], 7)


_GAPS = (
    HINDCAST.replace("sim AS pred", "CASE WHEN day(t.date) <> 17 OR month(t.date) % 4 <> 0 THEN sim END AS pred")
    .replace("avg(pred) AS p", "CASE WHEN count(pred) = count(*) THEN avg(pred) END AS p")
    .replace("sum(p * n) OVER w AS pred", "CASE WHEN count(p) OVER w = count(*) OVER w THEN sum(p * n) OVER w END AS pred")
)


@query(
    "v2_with_gaps",
    f"""WITH {_GAPS} SELECT gage_id, init_date, member, CAST(param_id AS INTEGER) AS param_id, CAST(lead AS INTEGER) AS lead, date,
    round(pred, 7) AS pred, round(act, 7) AS act FROM leads""",
)
def _(spark, d):
    known = (F.dayofmonth("date") != 17) | (F.month("date") % 4 != 0)
    holes = hindcast(spark, d).withColumn("pred", F.when(known, F.col("pred")))
    return rounded(verify.lead_months(holes, GAGE), [*TRACE_KEYS, "lead", "date"], 7)


@query(
    "v3_lead_months_storage",
    f"""WITH {HINDCAST} SELECT gage_id, init_date, member, CAST(param_id AS INTEGER) AS param_id, CAST(lead AS INTEGER) AS lead, fd + 14 AS date,
    round(p, 9) AS pred, round(o, 9) AS act FROM hl""",
)
def _(spark, d):
    return rounded(verify.lead_months_storage(hindcast(spark, d), GAGE), [*TRACE_KEYS, "lead", "date"], 9)


@query(
    "v5_climatology_by_lead",
    f"WITH {HINDCAST} SELECT gage_id, start_year, start_month, CAST(lead AS INTEGER) AS lead, round(total, 4) AS total FROM cl",
)
def _(spark, d):
    clim = verify.climatology_by_lead(verify.monthly_climatology(daily(spark, d), GAGE, "q"), GAGE)
    return rounded(clim, ["gage_id", "start_year", "start_month", "lead"])


@query(
    "v6_terciles",
    f"WITH {SKILL} SELECT gage_id, start_date, month, leadTime, predTerc, actTerc, {round_sql(ERRORS, 9)} FROM skill",
)
def _(spark, d):
    return rounded(skill(spark, d), ["gage_id", "start_date", "month", "leadTime", "predTerc", "actTerc"], 9)


STORAGE_SKILL = HINDCAST + _skill_sql(
    "month", "(SELECT gage_id, year, month, sqrt(total) AS total FROM mc WHERE year < 2001)", "(SELECT *, CAST(fd + 14 - INTERVAL 1 MONTH * (lead - 1) AS DATE) AS start_date, fd + 14 AS date, sqrt(p) AS pred, sqrt(o) AS act FROM hl WHERE o IS NOT NULL)"
)


@query(
    "v6_storage_terciles",
    f"WITH {STORAGE_SKILL} SELECT gage_id, start_date, month, leadTime, predTerc, actTerc, {round_sql(ERRORS, 6)} FROM skill",
)
def _(spark, d):
    # Roots have no finite decimal form, so no value sits on a rounding border.
    leads = verify.with_start_date(verify.lead_months_storage(hindcast(spark, d), GAGE))
    leads = leads.withColumns({c: F.sqrt(c) for c in ("pred", "act")})
    clim = verify.monthly_climatology(daily(spark, d), GAGE, "q").filter("year < 2001")
    clim = clim.withColumn("total", F.sqrt("total"))
    out = verify.skill_rows(leads, clim, GAGE)
    return rounded(out, ["gage_id", "start_date", "month", "leadTime", "predTerc", "actTerc"], 6)


@query(
    "v7_contingency",
    f"""WITH {SKILL}, n AS (SELECT gage_id, leadTime, predTerc, actTerc, count(*) AS n FROM skill GROUP BY 1, 2, 3, 4)
    SELECT gage_id, leadTime, predTerc, actTerc, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY gage_id, leadTime, predTerc), 6) AS p_act_given_pred,
    round(n / sum(n) OVER (PARTITION BY gage_id, leadTime, actTerc), 6) AS p_pred_given_act FROM n""",
)
def _(spark, d):
    out = verify.tercile_contingency(skill(spark, d), GAGE)
    return rounded(out, ["gage_id", "leadTime", "predTerc", "actTerc", "n"], 6)


def _map_sql():
    cols = []
    for q in ("25", "50", "75"):
        rel = f"median((abs(predMAE{q}) - abs(climMAE{q})) / nullif(abs(climMAE{q}), 0)) * 100"
        cols += [f"median(predMAE{q}) AS absMae{q}", f"CASE WHEN {rel} > 100 THEN 99.9 ELSE {rel} END AS relMae{q}"]
    for label, t in (("low", 1), ("med", 2), ("high", 3)):
        cols.append(f"count(*) FILTER (WHERE actTerc = {t} AND predTerc = {t}) / nullif(count(*) FILTER (WHERE actTerc = {t}), 0)::DOUBLE AS {label}_hit_rate")
    return ", ".join(cols)


_MAP_COLS = [f"{w}Mae{q}" for q in ("25", "50", "75") for w in ("abs", "rel")] + [f"{x}_hit_rate" for x in ("low", "med", "high")]


@query(
    "v8_skill_maps",
    f"WITH {SKILL}, m AS (SELECT gage_id, leadTime, month, {_map_sql()} FROM skill GROUP BY 1, 2, 3) SELECT gage_id, leadTime, month, {round_sql(_MAP_COLS, 9)} FROM m",
)
def _(spark, d):
    return rounded(verify.skill_maps(skill(spark, d), GAGE), ["gage_id", "leadTime", "month"], 9)


# ---- monthly features -------------------------------------------------------------


def _monthly_sql(stor, factor):
    return RECORDS + f""",
monthly AS (SELECT gage_id, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, {stor} AS stor, avg(inflow) * {factor} AS inflow,
  avg(loss) * {factor} AS loss FROM records GROUP BY 1, 2, 3)"""


MONTHLY = _monthly_sql("avg(stor)", "30.4375::DOUBLE")
YM = ["gage_id", "year", "month"]


def monthly(spark, d, **kw):
    return features.monthly_table(res.loss_records(reservoir(spark, d), GAGE), GAGE, **kw)


@query("v9_monthly_table", f"WITH {MONTHLY} SELECT gage_id, year, month, {round_sql(['stor', 'inflow', 'loss'], 7)} FROM monthly")
def _(spark, d):
    return rounded(monthly(spark, d), YM, 7)


@query(
    "v9_monthly_table_last",
    f"""WITH {_monthly_sql("arg_max(stor, date)", "count(*)")} SELECT gage_id, year, month, {round_sql(['stor', 'inflow', 'loss'], 7)} FROM monthly""",
)
def _(spark, d):
    return rounded(monthly(spark, d, storage="last", scale="days"), YM, 7)


@query(
    "v9_monthly_table_daily_mean",
    f"""WITH {_monthly_sql("avg(stor)", "1")} SELECT gage_id, year, month, {round_sql(['stor', 'inflow', 'loss'], 7)} FROM monthly""",
)
def _(spark, d):
    return rounded(monthly(spark, d, scale="daily"), YM, 7)


@query(
    "v10_mean_loss_by_month",
    f"WITH {MONTHLY} SELECT gage_id, month, round(avg(loss), 4) AS mean_loss FROM monthly GROUP BY 1, 2",
)
def _(spark, d):
    return rounded(features.mean_loss_by_month(monthly(spark, d), GAGE), ["gage_id", "month"])


def _rolled(width, h):
    frame = f"OVER (PARTITION BY gage_id ORDER BY year, month ROWS BETWEEN {h + width - 1} PRECEDING AND {h} PRECEDING)"
    return ", ".join(
        f"CASE WHEN count({v}) {frame} = {width} THEN avg({v}) {frame} END AS {v}_mn_{width}" for v in ("stor", "inflow")
    )


@query(
    "v11_rolling_lag",
    f"""WITH {MONTHLY}, r AS (SELECT gage_id, year, month, {_rolled(1, 2)}, {_rolled(3, 2)}, {_rolled(12, 2)} FROM monthly)
    SELECT gage_id, year, month, {round_sql([f"{v}_mn_{w}" for v in ("stor", "inflow") for w in (1, 3, 12)], 7)} FROM r""",
)
def _(spark, d):
    out = features.rolling_means(monthly(spark, d), (1, 3, 12), 2, keys=GAGE).drop("stor", "inflow", "loss")
    return rounded(out, YM, 7)


# Every width that a two-month horizon leaves of two years.
WIDTHS = range(1, 23)


def _screen_sql(h, widths):
    """Tests of all widths at one horizon, over the table `monthly`."""
    return f"""rolled AS (SELECT gage_id, year, month, round(loss, 8) AS y, {", ".join(_rolled(w, h) for w in widths)} FROM monthly),
x AS ({" UNION ALL ".join(f"SELECT gage_id, year * 12 + month AS t, '{v}' AS series, {w} AS width, round({v}_mn_{w}, 8) AS x, y FROM rolled WHERE {v}_mn_{w} IS NOT NULL AND y IS NOT NULL" for v in ("stor", "inflow") for w in widths)}),
s AS (SELECT a.gage_id, a.series, a.width, sum(sign(b.x - a.x) * sign(b.y - a.y)) AS s FROM x a JOIN x b
  ON a.gage_id = b.gage_id AND a.series = b.series AND a.width = b.width AND b.t > a.t GROUP BY 1, 2, 3),
n AS (SELECT gage_id, series, width, count(*)::DOUBLE AS n FROM x GROUP BY 1, 2, 3),
tx AS (SELECT gage_id, series, width, sum(t * (t - 1) * (2 * t + 5)) AS v, sum(t * (t - 1)) AS p, sum(t * (t - 1) * (t - 2)) AS q
  FROM (SELECT gage_id, series, width, count(*)::DOUBLE AS t FROM x GROUP BY 1, 2, 3, x) GROUP BY 1, 2, 3),
ty AS (SELECT gage_id, series, width, sum(t * (t - 1) * (2 * t + 5)) AS v, sum(t * (t - 1)) AS p, sum(t * (t - 1) * (t - 2)) AS q
  FROM (SELECT gage_id, series, width, count(*)::DOUBLE AS t FROM x GROUP BY 1, 2, 3, y) GROUP BY 1, 2, 3),
z AS (SELECT s.gage_id, s.series, s.width, n, s, s / sqrt((n * (n - 1) * (2 * n + 5) - tx.v - ty.v) / 18 + tx.p * ty.p / (2 * n * (n - 1))
    + tx.q * ty.q / (9 * n * (n - 1) * (n - 2))) AS z
  FROM s JOIN n USING (gage_id, series, width) JOIN tx USING (gage_id, series, width) JOIN ty USING (gage_id, series, width)),
screened AS (SELECT *, row_number() OVER (PARTITION BY gage_id, series ORDER BY round(abs(z), 10) DESC, width) AS rank FROM z)"""

KENDALL = MONTHLY + ",\n" + _screen_sql(2, WIDTHS)


def screened(spark, d):
    return features.screen_lags(monthly(spark, d), WIDTHS, 2, keys=GAGE)


@query(
    "v12_kendall",
    f"""WITH {KENDALL} SELECT gage_id, series, CAST(width AS INTEGER) AS width, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS s, round(z, 6) AS z,
    CAST(rank AS INTEGER) AS rank FROM screened""",
)
def _(spark, d):
    return screened(spark, d).select("gage_id", "series", "width", "n", "s", F.round("z", 6).alias("z"), "rank")


@query(
    "v12_chosen_lags",
    f"""WITH {KENDALL} SELECT gage_id, series, CAST(width AS INTEGER) AS width, CAST(rank AS INTEGER) AS rank FROM screened WHERE rank <= 5 OR width = 22""",
)
def _(spark, d):
    return features.choose_lags(screened(spark, d), keys=GAGE).select("gage_id", "series", "width", "rank")


# A trace per gage and start month: inflow and losses of the following six months.
PROJECTION = (
    MONTHLY
    + """,
ml AS (SELECT gage_id, month, avg(loss) AS mean_loss FROM monthly GROUP BY 1, 2),
pm AS (SELECT a.gage_id, a.year AS start_year, a.month AS start_month, (b.year - a.year) * 12 + b.month - a.month AS lead, a.stor / 100 AS stor0, b.inflow, ml.mean_loss, b.loss AS model_loss
  FROM monthly a JOIN monthly b ON a.gage_id = b.gage_id AND (b.year - a.year) * 12 + b.month - a.month BETWEEN 1 AND 6 JOIN ml ON ml.gage_id = b.gage_id AND ml.month = b.month),
pl AS (SELECT *, mean_loss * (1 - 0.4::DOUBLE) + 0.4::DOUBLE * model_loss AS l, stor0 + sum(inflow) OVER (PARTITION BY gage_id, start_year, start_month ORDER BY lead) AS cap FROM pm),
o1 AS (SELECT * FROM pl WHERE lead = 1),
fold AS (SELECT gage_id, start_year, start_month, lead, cap, least(l, cap) AS used FROM o1
  UNION ALL SELECT p.gage_id, p.start_year, p.start_month, p.lead, p.cap, least(f.used + p.l, p.cap) FROM fold f JOIN pl p
  ON p.gage_id = f.gage_id AND p.start_year = f.start_year AND p.start_month = f.start_month AND p.lead = f.lead + 1)"""
)


def projected(months, inflow, model_loss):
    """Storage of a trace per gage and start month; inflow and model_loss are columns of months."""
    start = months.select(
        "gage_id", F.col("year").alias("start_year"), F.col("month").alias("start_month"), (F.col("stor") / 100).alias("stor0")
    )
    # Each month serves the six starts before it: an equi-join on the start month.
    back = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.struct(k.alias("lead"), (F.col("year") * 12 + F.col("month") - 1 - k).alias("at")))
    served = months.withColumn("_s", F.explode(back)).select(
        "gage_id", "month", inflow.alias("inflow"), model_loss.alias("model_loss"), F.col("_s.lead").alias("lead"),
        F.floor(F.col("_s.at") / 12).cast("int").alias("start_year"), (F.col("_s.at") % 12 + 1).alias("start_month"),
    )
    rows = (
        served.join(start, ["gage_id", "start_year", "start_month"])
        .join(features.mean_loss_by_month(months, GAGE), ["gage_id", "month"])
        .withColumn("r2", F.lit(0.4))
    )
    out = features.project_months(rows, ["gage_id", "start_year", "start_month"])
    return out.select("gage_id", "start_year", "start_month", "lead", F.round("stor", 4).alias("stor"))


@query(
    "v13_project_months",
    f"""WITH RECURSIVE {PROJECTION} SELECT gage_id, start_year, start_month, CAST(lead AS INTEGER) AS lead, round(cap - used, 4) AS stor FROM fold""",
)
def _(spark, d):
    return projected(monthly(spark, d), F.col("inflow"), F.col("loss"))


# Some months lack their inflow or the model's loss: the storage is unknown from there on.
GAPPED = (
    MONTHLY
    + """,
ml AS (SELECT gage_id, month, avg(loss) AS mean_loss FROM monthly GROUP BY 1, 2),
holes AS (SELECT *, CASE WHEN (year * 12 + month) % 17 <> 0 THEN inflow END AS seen, CASE WHEN (year * 12 + month) % 19 <> 0 THEN loss END AS told FROM monthly),
pm AS (SELECT a.gage_id, a.year AS start_year, a.month AS start_month, (b.year - a.year) * 12 + b.month - a.month AS lead, a.stor / 100 AS stor0, b.seen,
    ml.mean_loss * 0.6::DOUBLE + 0.4::DOUBLE * b.told AS l
  FROM monthly a JOIN holes b ON a.gage_id = b.gage_id AND (b.year - a.year) * 12 + b.month - a.month BETWEEN 1 AND 6 JOIN ml ON ml.gage_id = b.gage_id AND ml.month = b.month),
pl AS (SELECT *, CASE WHEN count(*) OVER w = count(seen) OVER w THEN stor0 + sum(seen) OVER w END AS cap FROM pm WINDOW w AS (PARTITION BY gage_id, start_year, start_month ORDER BY lead)),
fold AS (SELECT gage_id, start_year, start_month, lead, cap, CASE WHEN l IS NOT NULL AND cap IS NOT NULL THEN least(l, cap) END AS used FROM pl WHERE lead = 1
  UNION ALL SELECT p.gage_id, p.start_year, p.start_month, p.lead, p.cap, CASE WHEN f.used + p.l IS NOT NULL AND p.cap IS NOT NULL THEN least(f.used + p.l, p.cap) END
  FROM fold f JOIN pl p ON p.gage_id = f.gage_id AND p.start_year = f.start_year AND p.start_month = f.start_month AND p.lead = f.lead + 1)"""
)


@query(
    "v13_with_gaps",
    f"""WITH RECURSIVE {GAPPED} SELECT gage_id, start_year, start_month, CAST(lead AS INTEGER) AS lead, round(cap - used, 4) AS stor FROM fold""",
)
def _(spark, d):
    number = F.col("year") * 12 + F.col("month")
    return projected(monthly(spark, d), F.when(number % 17 != 0, F.col("inflow")), F.when(number % 19 != 0, F.col("loss")))


# The months that release models learn from: unfilled records, then the mean of the gage.
RAW_MONTHS = RESERVOIR + """,
unfilled AS (SELECT gage_id, date, stor, acft, -(lead(stor) OVER w - stor - lead(acft) OVER w) AS loss
  FROM (SELECT gage_id, date, stor, inflow * 86400 / 43559.9::DOUBLE AS acft FROM reservoir) WINDOW w AS (PARTITION BY gage_id ORDER BY date)),
known AS (SELECT gage_id, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, arg_max(stor, date) FILTER (WHERE stor IS NOT NULL) AS stor,
  avg(acft) * count(*) AS inflow, avg(loss) * count(*) AS loss FROM unfilled GROUP BY 1, 2, 3),
monthly AS (SELECT gage_id, year, month, coalesce(stor, avg(stor) OVER g) AS stor, coalesce(inflow, avg(inflow) OVER g) AS inflow,
  coalesce(loss, avg(loss) OVER g) AS loss FROM known WINDOW g AS (PARTITION BY gage_id))"""


def raw_months(spark, d):
    return features.backfilled_months(res.unfilled_records(reservoir(spark, d), GAGE), GAGE)


@query("w1_unfilled_records", f"WITH {RAW_MONTHS} SELECT gage_id, date, round(stor, 6) AS stor, round(acft, 6) AS inflow, round(loss, 6) AS loss FROM unfilled")
def _(spark, d):
    return rounded(res.unfilled_records(reservoir(spark, d), GAGE), ["gage_id", "date"], 6)


@query("v9_backfilled_months", f"WITH {RAW_MONTHS} SELECT gage_id, year, month, {round_sql(['stor', 'inflow', 'loss'], 6)} FROM monthly")
def _(spark, d):
    return rounded(raw_months(spark, d), YM, 6)


def _lead_rows_sql(h):
    longest = 24 - h
    return f"""SELECT * FROM (WITH {_screen_sql(h, range(1, longest + 1))},
    c AS (SELECT * FROM screened WHERE rank <= 5 OR width = {longest}), k AS (SELECT gage_id, count(*) AS wanted FROM c GROUP BY 1),
    l AS (SELECT x.gage_id, x.t, count(*) AS had, max(x.y) AS loss, sum(x.x) AS x_sum, string_agg(x.series || '_mn_' || x.width, ',' ORDER BY x.series DESC, x.width) AS lags
      FROM x JOIN c ON c.gage_id = x.gage_id AND c.series = x.series AND c.width = x.width GROUP BY 1, 2)
    SELECT l.gage_id, {h} AS lead, CAST((t - 1) // 12 AS INTEGER) AS year, CAST((t - 1) % 12 + 1 AS INTEGER) AS month, lags, round(loss, 4) AS loss, round(x_sum, 4) AS x_sum
    FROM l JOIN k ON k.gage_id = l.gage_id WHERE had = wanted)"""


@query("v11_lead_rows", f"WITH {RAW_MONTHS} " + " UNION ALL ".join(_lead_rows_sql(h) for h in range(1, 7)))
def _(spark, d):
    rows = features.lead_rows(Staging(spark, "months").keep(raw_months(spark, d)), keys=GAGE)
    added = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return rows.select(*GAGE, "lead", "year", "month", F.concat_ws(",", "lags").alias("lags"), F.round("loss", 4).alias("loss"), F.round(added, 4).alias("x_sum"))


@query("v13_by_lead")
def _(spark, d):
    """Storage of the six months after each start by a forest of its own for each gage and lead."""
    return storage_by_lead(reservoir(spark, d), GAGE)


@query(
    "v14_split_rows",
    f"""WITH {RECORDS}, p AS (SELECT gage_id, date, row_number() OVER (PARTITION BY gage_id ORDER BY date) AS i, count(*) OVER (PARTITION BY gage_id) AS n FROM records)
    SELECT gage_id, CAST(count(*) FILTER (WHERE i <= floor(n * 0.33::DOUBLE)) AS BIGINT) AS n_valid, max(date) FILTER (WHERE i <= floor(n * 0.33::DOUBLE)) AS last_valid FROM p GROUP BY 1""",
)
def _(spark, d):
    out = features.split_rows(res.loss_records(reservoir(spark, d), GAGE), GAGE)
    return out.groupBy("gage_id").agg(
        F.count_if("is_validation").alias("n_valid"), F.max(F.when(F.col("is_validation"), F.col("date"))).alias("last_valid")
    )


@query(
    "w7_closure",
    f"""WITH {MONTHLY}, s AS (SELECT gage_id, stor - lag(stor) OVER (PARTITION BY gage_id ORDER BY year, month) AS ds, inflow - loss AS net FROM monthly)
    SELECT gage_id, round(regr_r2(net, ds), 6) AS r2, round(regr_slope(net, ds), 6) AS slope, CAST(regr_count(net, ds) AS BIGINT) AS n FROM s GROUP BY 1""",
)
def _(spark, d):
    return rounded(res.closure(monthly(spark, d), GAGE), ["gage_id", "n"], 6)


@query(
    "w7_daily_closure",
    f"""WITH {RECORDS}, s AS (SELECT gage_id, stor - lag(stor) OVER (PARTITION BY gage_id ORDER BY date) AS ds, inflow - loss AS net FROM records)
    SELECT gage_id, round(regr_r2(net, ds), 6) AS r2, round(regr_slope(net, ds), 6) AS slope, CAST(regr_count(net, ds) AS BIGINT) AS n FROM s GROUP BY 1""",
)
def _(spark, d):
    return rounded(res.closure(res.loss_records(reservoir(spark, d), GAGE), GAGE, order=["date"]), ["gage_id", "n"], 6)


@query("l1_release_model")
def _(spark, d):
    """A forest for each basin's raw records, with all its folds, repeats and settings (hours, see
    README); scores of calibration and hold-out rows."""
    rows = release.training_rows(release.raw_records(reservoir(spark, d), GAGE), GAGE)
    return release.fit_quality(release.fit_by_basin(rows, GAGE), GAGE)
