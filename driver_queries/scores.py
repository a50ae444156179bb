"""Scoring and choice of model runs."""

from pyspark.sql import functions as F

from driver_queries.registry import registry, round_sql, rounded
from driver_queries.stand_ins import DAILY, GAP, MEASURES, gappy, runs, table, traces
from freshet.functions.cleaning import correct_monthly_bias
from freshet.operators import scoring

QUERIES, SQL, query = registry()

BASIN = ["gage_id"]
RUN = ["gage_id", "run_id"]
SCORE_COLS = [f"{s}{p}" for p in scoring.PERIODS for s in scoring.SCORES]
BIAS_COLS = [f"mnthBias_{m}" for m in range(1, 13)]


def pairs(spark, d):
    obs = gappy(spark, d).select("gage_id", "date", F.col("q").alias("obs"))
    return scoring.pair(runs(spark, d), obs, ["gage_id", "date"])


PAIRS = MEASURES + f""",
gappy AS (SELECT gage_id, date, CASE WHEN NOT ({GAP}) THEN q END AS q FROM daily),
pairs AS (SELECT r.gage_id, run_id, r.date, sim, q AS obs FROM runs r LEFT JOIN gappy g ON r.gage_id = g.gage_id AND r.date = g.date),
parted AS (SELECT *, row_number() OVER (PARTITION BY gage_id, run_id ORDER BY date) AS i, count(*) OVER (PARTITION BY gage_id, run_id) AS n FROM pairs),
split AS (SELECT *, i <= n // 3 OR i >= ceil(n / 1.5::DOUBLE) AS in_cal, i >= ceil(n / 3.0::DOUBLE) AND i <= floor(n / 1.5::DOUBLE) AS in_val FROM parted)"""


@query(
    "m1_split",
    f"""WITH {PAIRS} SELECT gage_id, CAST(run_id AS INTEGER) AS run_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE in_cal) AS BIGINT) AS n_cal,
    CAST(count(*) FILTER (WHERE in_val) AS BIGINT) AS n_val, max(date) FILTER (WHERE in_val) AS last_val FROM split GROUP BY 1, 2""",
)
def _(spark, d):
    return scoring.split_periods(pairs(spark, d), RUN).groupBy(*RUN).agg(
        F.count("*").alias("n"), F.count_if("in_cal").alias("n_cal"), F.count_if("in_val").alias("n_val"),
        F.max(F.when(F.col("in_val"), F.col("date"))).alias("last_val"),
    )


def _score_sql():
    out = []
    for period, cond in (("Calibration", "in_cal"), ("Validation", "in_val"), ("All", "true")):
        w = f"FILTER (WHERE {cond} AND obs IS NOT NULL AND sim IS NOT NULL)"
        out += [
            f"""1 - sqrt((corr(sim, obs) {w} - 1) ** 2 + (stddev(sim) {w} / stddev(obs) {w} - 1) ** 2
              + (avg(sim) {w} / avg(obs) {w} - 1) ** 2) AS kge{period}""",
            f"1 - sum((sim - obs) ** 2) {w} / (var_pop(obs) {w} * count(obs) {w}) AS nse{period}",
            f"avg(abs(sim - obs)) {w} AS mae{period}",
            f"sqrt(avg((sim - obs) ** 2) {w}) AS rmse{period}",
            f"100 * sum(sim - obs) {w} / sum(obs) {w} AS bias{period}",
        ]
    for m in range(1, 13):
        w = f"FILTER (WHERE month(date) = {m} AND obs IS NOT NULL AND sim IS NOT NULL)"
        out.append(f"100 * sum(sim - obs) {w} / sum(obs) {w} AS mnthBias_{m}")
    return ", ".join(out)


SCORED = PAIRS + f""",
scored0 AS (SELECT gage_id, run_id, {_score_sql()} FROM split GROUP BY 1, 2),
scored AS (SELECT *, ({" + ".join(f"abs({c})" for c in BIAS_COLS)}) / 12 AS mnthSumAbsBias FROM scored0)"""


@query(
    "m2_m6_scores",
    f"WITH {SCORED} SELECT gage_id, CAST(run_id AS INTEGER) AS run_id, {round_sql([*SCORE_COLS, *BIAS_COLS, 'mnthSumAbsBias'])} FROM scored",
)
def _(spark, d):
    return rounded(scoring.scores(pairs(spark, d), RUN), RUN)


# Accepting and ranking need many runs: each order is a run of its priority class.
MANY = """
many AS (SELECT o_orderpriority AS basin, o_orderkey + 1 AS run_number, o_orderkey AS run_id, o_totalprice / 500000 AS kgeCalibration,
  c_acctbal / 10000 AS kgeValidation, o_totalprice / 500000 AS kgeAll, c_acctbal - 4500 AS biasAll, c_acctbal / 9000 - o_totalprice / 600000 AS nseAll,
  abs(c_acctbal - 3000) AS maeAll, sqrt(c_acctbal * c_acctbal + o_totalprice / 100) AS rmseAll, c_acctbal - 4000 AS mnthSumAbsBias
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def many(spark, d):
    price, bal = F.col("o_totalprice"), F.col("c_acctbal")
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderpriority").alias("basin"),
        (F.col("o_orderkey") + 1).alias("run_number"),
        F.col("o_orderkey").alias("run_id"),
        (price / 500000).alias("kgeCalibration"),
        (bal / 10000).alias("kgeValidation"),
        (price / 500000).alias("kgeAll"),
        (bal - 4500).alias("biasAll"),
        (bal / 9000 - price / 600000).alias("nseAll"),
        F.abs(bal - 3000).alias("maeAll"),
        F.sqrt(bal * bal + price / 100).alias("rmseAll"),
        (bal - 4000).alias("mnthSumAbsBias"),
    )


@query(
    "m7_accept",
    f"""WITH {MANY}, t AS (SELECT *, round(0.81::DOUBLE - 0.01::DOUBLE * ((run_number - 1) // 1000 + 1), 10) AS threshold FROM many),
    r AS (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY run_number) AS rn FROM t WHERE kgeCalibration > threshold AND kgeValidation > threshold)
    SELECT basin, CAST(run_number AS BIGINT) AS run_number, threshold FROM r WHERE rn <= 200""",
)
def _(spark, d):
    return scoring.accept(many(spark, d), ["basin"], block=1000).select("basin", "run_number", "threshold")


@query(
    "m7_accept_many",
    f"""WITH {MANY}, t AS (SELECT *, round(0.81::DOUBLE - 0.2::DOUBLE * ((run_number - 1) // 1000 + 1), 10) AS threshold FROM many),
    r AS (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY run_number) AS rn FROM t WHERE kgeCalibration > threshold AND kgeValidation > threshold)
    SELECT basin, CAST(run_number AS BIGINT) AS run_number, threshold FROM r WHERE rn <= 2000""",
)
def _(spark, d):
    """More runs wanted than Spark limits by itself."""
    return scoring.accept(many(spark, d), ["basin"], block=1000, step=0.2, wanted=2000).select("basin", "run_number", "threshold")


@query(
    "m8_best",
    f"""WITH {MANY}, r AS (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY abs(mnthSumAbsBias), run_id) AS rn FROM many WHERE kgeAll IS NOT NULL)
    SELECT basin, run_id, mnthSumAbsBias, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 40""",
)
def _(spark, d):
    return scoring.best(many(spark, d), ["basin"]).select("basin", "run_id", "mnthSumAbsBias", "rank")


def _composite_sql():
    orders = {"kge": "kgeAll DESC", "bias": "abs(biasAll)", "nse": "nseAll DESC", "mae": "maeAll", "rmse": "rmseAll"}
    return "\nUNION ALL ".join(
        f"""SELECT basin, run_id, CAST(rn AS INTEGER) AS rank, '{s}' AS chosen_by FROM (SELECT *, row_number() OVER
          (PARTITION BY basin ORDER BY {orders[s]}, run_id) AS rn FROM many) WHERE rn <= {k}"""
        for s, k in (("kge", 20), ("bias", 10), ("nse", 4), ("mae", 4), ("rmse", 2))
    )


@query("m9_best_composite", f"WITH {MANY} {_composite_sql()}")
def _(spark, d):
    return scoring.best_composite(many(spark, d), ["basin"]).select("basin", "run_id", "rank", "chosen_by")


# Uniforms that both engines compute alike: multiples of the key over a prime.
_PRIMES = [7919, 104729, 1299709, 15485863, 32452843, 49979687, 67867967]


def _uniform(i):
    return f"((o_orderkey * {_PRIMES[i % 7]} + {31 * i + 7}) % 10007) / 10007.0"


def _parameter_sql():
    names = list(scoring.PARAMETER_RANGES)
    cols = []
    for i, (p, ranges) in enumerate(scoring.PARAMETER_RANGES.items()):
        u, mix = _uniform(2 * i) + "::DOUBLE", _uniform(2 * i + 1) + "::DOUBLE"
        parts = [f"{lo}::DOUBLE + ({hi}::DOUBLE - {lo}::DOUBLE) * ({u})" for lo, hi in ranges]
        cols.append(parts[0] + f" AS {p}" if len(parts) == 1 else f"CASE WHEN {mix} < 0.5 THEN {parts[0]} ELSE {parts[1]} END AS {p}")
    keep = [p for p in names if p not in ("k1", "k2", "uz1")]
    return f"""WITH a AS (SELECT o_orderkey AS run_id, {", ".join(cols)} FROM orders),
    b AS (SELECT * REPLACE (CASE WHEN k1 > k0 THEN k0 * 0.99 ELSE k1 END AS k1) FROM a),
    c AS (SELECT * REPLACE (CASE WHEN k2 > k1 THEN k1 * 0.99 ELSE k2 END AS k2, CASE WHEN uz1 < perc THEN perc * 1.01 ELSE uz1 END AS uz1) FROM b)
    SELECT run_id, {round_sql([*keep, "k1", "k2", "uz1"], 6)} FROM c"""


@query("m10_parameter_sets", _parameter_sql())
def _(spark, d):
    cols = {}
    for i, p in enumerate(scoring.PARAMETER_RANGES):
        cols[f"u_{p}"] = F.expr(f"cast({_uniform(2 * i)}D as double)")
        cols[f"mix_{p}"] = F.expr(f"cast({_uniform(2 * i + 1)}D as double)")
    uniforms = table(spark, d, "orders").withColumns(cols).withColumnRenamed("o_orderkey", "run_id")
    return rounded(scoring.parameter_sets(uniforms), ["run_id"], 6)


@query("m10_hashed_draws")
def _(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"))
    return scoring.parameter_sets(scoring.draw_uniforms(ids, seed=7))


WARM = PAIRS + """,
warm AS (SELECT * FROM parted WHERE i > 365 AND obs IS NOT NULL),
med AS (SELECT gage_id, date, median(sim) AS sim_median, any_value(obs) AS obs FROM warm GROUP BY 1, 2)"""


def warm(spark, d):
    return scoring.drop_warm_up(pairs(spark, d), RUN)


@query(
    "m11_ensemble_fit",
    f"""WITH {SCORED}, warm AS (SELECT * FROM parted WHERE i > 365 AND obs IS NOT NULL),
    med AS (SELECT gage_id, date, median(sim) AS sim_median, any_value(obs) AS obs FROM warm GROUP BY 1, 2),
    k AS (SELECT gage_id, {", ".join(f"median({s}All) AS {s}_median" for s in ("kge", "nse", "mae", "bias"))} FROM scored GROUP BY 1),
    f AS (SELECT gage_id, regr_r2(obs, sim_median) AS r2, count(*) AS n_days FROM med GROUP BY 1)
    SELECT gage_id, CAST(n_days AS BIGINT) AS n_days, {round_sql(["r2", "kge_median", "nse_median", "mae_median", "bias_median"])}
    FROM f JOIN k USING (gage_id)""",
)
def _(spark, d):
    both = pairs(spark, d)
    medians = scoring.ensemble_median(scoring.drop_warm_up(both, RUN), BASIN)
    return rounded(scoring.ensemble_fit(medians, scoring.scores(both, RUN), BASIN), ["gage_id", "n_days"])


@query(
    "m12_water_year_totals",
    f"""WITH {WARM} SELECT gage_id, CAST(run_id AS INTEGER) AS run_id, CAST(year(date + 92) AS INTEGER) AS water_year, round(sum(obs), 7) AS obs,
    round(sum(sim), 7) AS sim FROM warm GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return rounded(scoring.water_year_totals(warm(spark, d), RUN), [*RUN, "water_year"], 7)


@query(
    "m12_line_of_median",
    f"""WITH {WARM}, y AS (SELECT gage_id, run_id, year(date + 92) AS wy, sum(obs) AS obs, sum(sim) AS sim FROM warm GROUP BY 1, 2, 3),
    m AS (SELECT gage_id, wy, median(sim) AS sim, any_value(obs) AS obs FROM y GROUP BY 1, 2)
    SELECT gage_id, round(regr_slope(sim, obs), 4) AS slope, round(regr_r2(sim, obs), 4) AS r2, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1""",
)
def _(spark, d):
    totals = scoring.water_year_totals(warm(spark, d), RUN)
    return rounded(scoring.line_of_median(totals, BASIN, "water_year"), ["gage_id", "n"])


@query(
    "m13_monthly_depths",
    f"""WITH {WARM} SELECT gage_id, CAST(run_id AS INTEGER) AS run_id, CAST(month(date) AS INTEGER) AS month, round(avg(obs) * 30, 9) AS obs,
    round(avg(sim) * 30, 9) AS sim FROM warm GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return rounded(scoring.monthly_depths(warm(spark, d), RUN), [*RUN, "month"], 9)


@query(
    "m14_monthly_errors",
    f"""WITH {WARM} SELECT gage_id, CAST(run_id AS INTEGER) AS run_id, CAST(month(date) AS INTEGER) AS month,
    round(100 * (sum(sim) - sum(obs)) / sum(obs), 4) AS error FROM warm GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return rounded(scoring.monthly_errors(warm(spark, d), RUN), [*RUN, "month"])


@query(
    "p19_monthly_bias",
    f"""WITH {SCORED}, b AS (SELECT gage_id, run_id, m AS month, CASE m {" ".join(f"WHEN {m} THEN mnthBias_{m}" for m in range(1, 13))} END AS bias
      FROM scored, (SELECT unnest(range(1, 13)) AS m))
    SELECT gage_id, CAST(param_id AS INTEGER) AS param_id, member, CAST(b.month AS INTEGER) AS month, round(sum(sim * (100 - coalesce(bias, 0)) / 100), 3) AS sim
    FROM traces t LEFT JOIN b USING (gage_id) WHERE b.run_id = t.param_id AND b.month = month(date) GROUP BY 1, 2, 3, 4""",
)
def _(spark, d):
    params = scoring.scores(pairs(spark, d), RUN).withColumnRenamed("run_id", "param_id")
    out = correct_monthly_bias(traces(spark, d), params, ["gage_id", "param_id"])
    return out.groupBy("gage_id", "param_id", "member", F.month("date").alias("month")).agg(F.round(F.sum("sim"), 3).alias("sim"))
