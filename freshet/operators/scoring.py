"""Scoring, accepting and ranking of model runs.

Input is long: runs(keys, run_id, date, sim) and observed(keys, date, obs). A run has
one row per day; scores are algebraic aggregates, so partial sums combine before the
shuffle however many runs share a basin.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.calendar import water_year
from freshet.functions.moments import correlation
from freshet.operators.gaps import group_ranks, join_null_safe

PERIODS = ("Calibration", "Validation", "All")
SCORES = ("kge", "nse", "mae", "rmse", "bias")

# How many runs each score contributes to the composite choice.
COMPOSITE_COUNTS = {"kge": 20, "bias": 10, "nse": 4, "mae": 4, "rmse": 2}


def pair(runs: DataFrame, observed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every simulated row with its observation, null where there is none."""
    return runs.join(observed, list(on), "left")


def split_periods(pairs: DataFrame, run_keys: Sequence[str], date: str = "date") -> DataFrame:
    """Adds in_cal and in_val by row position: outer thirds calibrate, the middle validates.

    Rows at the borders belong to both when the length divides by three.
    """
    run = Window.partitionBy(*run_keys)
    third, two_thirds = F.col("_n") / 3, F.col("_n") / 1.5
    return (
        pairs.withColumns({"_i": F.row_number().over(run.orderBy(date)), "_n": F.count("*").over(run)})
        .withColumns(
            {
                "in_cal": (F.col("_i") <= F.floor(third)) | (F.col("_i") >= F.ceil(two_thirds)),
                "in_val": (F.col("_i") >= F.ceil(third)) & (F.col("_i") <= F.floor(two_thirds)),
            }
        )
        .drop("_i", "_n")
    )


def score_columns(inside: Column | None = None, sim: str = "sim", obs: str = "obs") -> dict[str, Column]:
    """kge, nse, mae, rmse and percent bias over the pairs where both values are present."""
    both = F.col(sim).isNotNull() & F.col(obs).isNotNull()
    if inside is not None:
        both = both & inside
    s, o = F.when(both, F.col(sim)), F.when(both, F.col(obs))
    err = s - o
    r = correlation(s, o)
    spread, level = F.try_divide(F.stddev(s), F.stddev(o)), F.try_divide(F.avg(s), F.avg(o))
    kge = 1 - F.sqrt(F.pow(r - 1, 2) + F.pow(spread - 1, 2) + F.pow(level - 1, 2))
    nse = 1 - F.try_divide(F.sum(err * err), F.var_pop(o) * F.count(o))
    return {
        "kge": kge,
        "nse": nse,
        "mae": F.avg(F.abs(err)),
        "rmse": F.sqrt(F.avg(err * err)),
        "bias": F.try_divide(100 * F.sum(err), F.sum(o)),
    }


def scores(pairs: DataFrame, run_keys: Sequence[str], date: str = "date") -> DataFrame:
    """One row per run: five scores for three periods, monthly bias and its mean size.

    One pass: the periods and months are conditions inside the aggregates.
    """
    parts = {"Calibration": F.col("in_cal"), "Validation": F.col("in_val"), "All": None}
    aggs = []
    for name, inside in parts.items():
        aggs += [c.alias(f"{score}{name}") for score, c in score_columns(inside).items()]
    both = F.col("sim").isNotNull() & F.col("obs").isNotNull()
    for m in range(1, 13):
        here = both & (F.col("_month") == m)
        err = F.sum(F.when(here, F.col("sim") - F.col("obs")))
        aggs.append(F.try_divide(100 * err, F.sum(F.when(here, F.col("obs")))).alias(f"mnthBias_{m}"))
    parted = split_periods(pairs, run_keys, date).withColumn("_month", F.month(date))
    wide = parted.groupBy(*run_keys).agg(*aggs)
    months = [F.abs(F.col(f"mnthBias_{m}")) for m in range(1, 13)]
    return wide.withColumn("mnthSumAbsBias", sum(months[1:], months[0]) / 12)


# Up to this many rows a group, Spark drops the others before the shuffle (its group limit).
GROUP_LIMIT = 1000
PARTS = 64


def first_rows(df: DataFrame, keys: Sequence[str], by: Column, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The k rows of each group that come first by a number and then by `tie`, with their rank.

    A null number comes last but counts. A longer list than Spark limits by itself is cut by the
    k-th number of its group first, which group_ranks() finds without sorting a group; then
    parts of each group are ranked, and the first k of these against each other, so no window
    holds more of a group than a part of the rows tied there, or PARTS * k rows.
    """
    order = [by.asc_nulls_last(), F.col(tie)]
    if k <= GROUP_LIMIT:
        ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked.filter(F.col(rank) <= k)
    number = by.cast("double")
    work = df.withColumn("_by", F.when(~F.isnan(number), number))
    last = group_ranks(work, keys, [("_by", lambda n: F.least(F.lit(k), n) - 1)])
    # Without k numbers all rows stay; the rows beyond the k-th number cannot be among the first k.
    counts = work.groupBy(*keys).agg(F.count("_by").alias("_n"))
    cut = join_null_safe(join_null_safe(work, last, keys), counts, keys)
    cut = cut.filter((F.col("_n") < k) | (F.col("_by") <= F.col("rank_0"))).drop("rank_0", "_n", "_by")
    part = F.pmod(F.xxhash64(tie), F.lit(PARTS))
    few = cut.withColumn("_part", part)
    few = few.withColumn(rank, F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).filter(F.col(rank) <= k)
    ranked = few.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k).drop("_part")


def accept(
    scored: DataFrame, keys: Sequence[str], run_number: str = "run_number", target: float = 0.81,
    block: int = 200_000, wanted: int = 200, step: float = 0.01,
) -> DataFrame:
    """First `wanted` runs per basin, in run order, whose calibration and validation KGE
    both beat a threshold that starts one step under target and falls a step per block.

    See first_rows() for how a basin with most of the runs is cut.
    """
    blocks = F.floor((F.col(run_number) - 1) / block)
    limit = F.round(F.lit(target) - step * (blocks + 1), 10)
    passed = scored.withColumn("threshold", limit).filter(
        (F.col("kgeCalibration") > F.col("threshold")) & (F.col("kgeValidation") > F.col("threshold"))
    )
    return first_rows(passed, keys, F.col(run_number), run_number, wanted, "_rank").drop("_rank")


def best(
    scored: DataFrame, keys: Sequence[str], k: int = 40, by: str = "mnthSumAbsBias", tie: str = "run_id"
) -> DataFrame:
    """The k runs per basin with the smallest absolute bias, among runs that have a KGE."""
    return first_rows(scored.filter("kgeAll is not null"), keys, F.abs(by), tie, k)


def best_composite(
    scored: DataFrame,
    keys: Sequence[str],
    counts: dict[str, int] | None = None,
    tie: str = "run_id",
    cache: bool = True,
) -> DataFrame:
    """Union of the best runs by each score; a run may appear once per score.

    Each score ranks all runs, so the scored table is cached (memory, then disk);
    spark.catalog.clearCache() frees it after the write. With cache=False each score goes
    back to the source.
    """
    counts = counts or COMPOSITE_COUNTS
    if cache:
        scored = scored.persist()
    orders = {
        "kge": -F.col("kgeAll"),
        "bias": F.abs("biasAll"),
        "nse": -F.col("nseAll"),
        "mae": F.col("maeAll"),
        "rmse": F.col("rmseAll"),
    }
    out = None
    for score, k in counts.items():
        known = scored.filter(F.col(f"{score}All").isNotNull())
        part = first_rows(known, keys, orders[score], tie, k).withColumn("chosen_by", F.lit(score))
        out = part if out is None else out.unionByName(part)
    return out


# Parameter ranges. Each entry lists uniform ranges mixed in equal parts.
PARAMETER_RANGES = {
    "sfcf": [(0.2, 1), (1, 3)],
    "tr": [(-6, 5)],
    "tt": [(-5, 6)],
    "fm": [(0.2, 1.5), (1.5, 8)],
    "fi": [(0.2, 1.5), (1.5, 10)],
    "fic": [(2, 10)],
    "fc": [(25, 150), (150, 1200)],
    "lp": [(0.2, 1)],
    "beta_soils": [(1, 3)],
    "k0": [(0.05, 0.5), (0.5, 0.999)],
    "k1": [(0.005, 0.09), (0.09, 0.5)],
    "k2": [(0.0001, 0.01), (0.01, 0.1)],
    "uz1": [(0.22, 10), (10, 40)],
    "perc": [(0.1, 0.5), (0.5, 20)],
}


def draw_uniforms(ids: DataFrame, id_col: str = "run_id", seed: int = 0) -> DataFrame:
    """Two uniforms per parameter from a hash of (seed, parameter, id).

    A hash rather than a generator: a lost task redraws the same values.
    """
    cols = {}
    for p in PARAMETER_RANGES:
        for kind in ("mix", "u"):
            h = F.xxhash64(F.lit(seed), F.lit(f"{p}.{kind}"), F.col(id_col))
            cols[f"{kind}_{p}"] = F.pmod(h, F.lit(1 << 52)) / F.lit(float(1 << 52))
    return ids.withColumns(cols)


def parameter_sets(uniforms: DataFrame, id_col: str = "run_id") -> DataFrame:
    """14 parameters from uniforms mix_<p>, u_<p> in [0, 1), made mutually consistent.

    k1 above k0 becomes 0.99 k0, then k2 above k1 becomes 0.99 k1, and uz1 below perc
    becomes 1.01 perc.
    """
    drawn = []
    for p, ranges in PARAMETER_RANGES.items():
        value = None
        for i, (low, high) in reversed(list(enumerate(ranges))):
            here = low + (high - low) * F.col(f"u_{p}")
            share = F.col(f"mix_{p}") < (i + 1) / len(ranges)
            value = here if value is None else F.when(share, here).otherwise(value)
        drawn.append(value.alias(p))
    sets = uniforms.select(id_col, *drawn)
    sets = sets.withColumn("k1", F.when(F.col("k1") > F.col("k0"), F.col("k0") * 0.99).otherwise(F.col("k1")))
    sets = sets.withColumn("k2", F.when(F.col("k2") > F.col("k1"), F.col("k1") * 0.99).otherwise(F.col("k2")))
    return sets.withColumn("uz1", F.when(F.col("uz1") < F.col("perc"), F.col("perc") * 1.01).otherwise(F.col("uz1")))


def drop_warm_up(pairs: DataFrame, run_keys: Sequence[str], days: int = 365, date: str = "date") -> DataFrame:
    """Rows after the first `days` days of each run that have an observation."""
    order = Window.partitionBy(*run_keys).orderBy(date)
    return (
        pairs.withColumn("_i", F.row_number().over(order))
        .filter((F.col("_i") > days) & F.col("obs").isNotNull())
        .drop("_i")
    )


def ensemble_median(pairs: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Median across the kept runs per day, with the observation of the day."""
    return pairs.groupBy(*keys, date).agg(F.median("sim").alias("sim_median"), F.first("obs").alias("obs"))


def ensemble_fit(medians: DataFrame, scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """r2 of observation and daily ensemble median, with the median scores of the kept runs."""
    fit = medians.groupBy(*keys).agg(F.regr_r2("obs", "sim_median").alias("r2"), F.count("*").alias("n_days"))
    kept = scored.groupBy(*keys).agg(
        *[F.median(f"{s}All").alias(f"{s}_median") for s in ("kge", "nse", "mae", "bias")]
    )
    return fit.join(kept, list(keys), "left")


def water_year_totals(pairs: DataFrame, run_keys: Sequence[str], date: str = "date") -> DataFrame:
    """Observed and simulated totals per run and water year."""
    return pairs.groupBy(*run_keys, water_year(F.col(date)).alias("water_year")).agg(
        F.sum("obs").alias("obs"), F.sum("sim").alias("sim")
    )


def monthly_depths(pairs: DataFrame, run_keys: Sequence[str], date: str = "date") -> DataFrame:
    """Mean daily depth times 30 per run and calendar month."""
    return pairs.groupBy(*run_keys, F.month(date).alias("month")).agg(
        (F.avg("obs") * 30).alias("obs"), (F.avg("sim") * 30).alias("sim")
    )


def monthly_errors(pairs: DataFrame, run_keys: Sequence[str], date: str = "date") -> DataFrame:
    """Percent error of the month total per run and calendar month."""
    sim, obs = F.sum("sim"), F.sum("obs")
    return pairs.groupBy(*run_keys, F.month(date).alias("month")).agg(
        F.try_divide(100 * (sim - obs), obs).alias("error")
    )


def line_of_median(periods: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Slope and r2 of the run median on the observation, over the periods of a basin."""
    medians = periods.groupBy(*keys, period).agg(F.median("sim").alias("sim"), F.first("obs").alias("obs"))
    return medians.groupBy(*keys).agg(
        F.regr_slope("sim", "obs").alias("slope"), F.regr_r2("sim", "obs").alias("r2"), F.count("*").alias("n")
    )
