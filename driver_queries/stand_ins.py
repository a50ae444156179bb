"""Hydrology-shaped views of the driver tables, as DataFrames and as SQL.

daily: five gages (supplier regions), q = quantity shipped per day.
gappy: the same with days blanked by key and date, the same share at every size: single days in two
  years of three, and March to July of one year in five.
rain:  order value per customer region and day.
measures: shipping measures per region, line status (ensemble member) and day.
Each view aggregates the whole table to one row per key and day, with partial sums
before the shuffle, so later windows are bounded by the calendar. Money and rates are
summed as whole cents and hundredths: such sums do not depend on the order of rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.calendar import with_calendar


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its supplier's region as gage_id and the ship day as date.

    The fact table joins one dimension at a time: the size of a join of two dimensions is
    only guessed, and a bad guess would broadcast the fact table.
    """
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumns({"gage_id": F.col("n_regionkey"), "date": F.col("l_shipdate").cast("date")})
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shipments(spark, sf_dir).groupBy("gage_id", "date").agg(F.sum("l_quantity").alias("q"))
    return with_calendar(rows)


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    gage, day = F.col("gage_id"), F.unix_date("date")
    single = ((day + 5 * gage) % 37 == 0) & ((F.col("year") + gage) % 3 != 0)
    season = ((F.col("year") + 2 * gage) % 5 == 0) & F.col("month").between(3, 7)
    return daily(spark, sf_dir).withColumn("q", F.when(~(single | season), F.col("q")))


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_regionkey").alias("gage_id"), F.col("o_orderdate").cast("date").alias("date"))
        .agg((F.sum(F.round(F.col("o_totalprice") * 100)) / 100).alias("ppt"))
    )


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    qty, hundredths = F.col("l_quantity"), lambda c: F.round(F.col(c) * 100)
    return (
        _shipments(spark, sf_dir)
        .groupBy("gage_id", F.col("l_linestatus").alias("member"), "date")
        .agg(
            F.sum(qty).alias("m1"),
            (F.sum(hundredths("l_extendedprice")) / 150000).alias("m2"),
            (F.sum(qty * (100 + hundredths("l_tax"))) / 100).alias("m3"),
            (F.sum(qty * (100 - hundredths("l_discount"))) / 100).alias("m4"),
            (F.count("*") * 25.0).alias("m5"),
        )
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated runs (gage_id, run_id, date, sim): five measures of the whole region."""
    whole = measures(spark, sf_dir).groupBy("gage_id", "date").agg(*[F.sum(f"m{k}").alias(f"m{k}") for k in range(1, 6)])
    return whole.selectExpr(
        "gage_id", "date", "stack(5, 1, m1, 2, m2, 3, m3, 4, m4, 5, m5) as (run_id, sim)"
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble traces (gage_id, member, param_id, date, sim)."""
    return measures(spark, sf_dir).selectExpr(
        "gage_id", "member", "date", "stack(5, 1, m1, 2, m2, 3, m3, 4, m4, 5, m5) as (param_id, sim)"
    )


def reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gage_id, date, stor, inflow): storage from prices, inflow from quantities.

    Both have gaps by key and date: pairs of days and some Mays without storage, single days and
    the first weeks without inflow.
    """
    rows = _shipments(spark, sf_dir).groupBy("gage_id", "date").agg(
        F.sum("l_quantity").alias("inflow"), (F.sum(F.round(F.col("l_extendedprice") * 100)) / 100).alias("stor")
    )
    gage, day, year = F.col("gage_id"), F.unix_date("date"), F.year("date")
    pair = ((day + 3 * gage) % 41 < 2) & ((year + gage) % 3 != 0)
    may = ((year + gage) % 4 == 0) & (F.month("date") == 5)
    single, early = (day + 7 * gage) % 53 == 0, day < 8045 + 7 * gage
    return rows.select(
        "gage_id",
        "date",
        F.when(~(pair | may), F.col("stor") / 100).alias("stor"),
        F.when(~(single | early), F.col("inflow")).alias("inflow"),
    )


DAILY = """
shipments AS (
  SELECT n_regionkey AS gage_id, l_linestatus AS member, CAST(l_shipdate AS DATE) AS date,
         l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
daily AS (
  SELECT gage_id, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
         CAST(dayofyear(date) AS INTEGER) AS doy, sum(l_quantity) AS q
  FROM shipments GROUP BY gage_id, date)"""

GAP = """(date_diff('day', DATE '1970-01-01', date) + 5 * gage_id) % 37 = 0 AND (year(date) + gage_id) % 3 <> 0
  OR (year(date) + 2 * gage_id) % 5 = 0 AND month(date) BETWEEN 3 AND 7"""

GAPPY = DAILY + f""",
gappy AS (SELECT gage_id, date, year, month, doy, CASE WHEN NOT ({GAP}) THEN q END AS q FROM daily)"""

RAIN = """
rain AS (
  SELECT n_regionkey AS gage_id, CAST(o_orderdate AS DATE) AS date, sum(round(o_totalprice * 100)) / 100 AS ppt
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""

MEASURES = DAILY + """,
measures AS (
  SELECT gage_id, member, date, sum(l_quantity) AS m1, sum(round(l_extendedprice * 100)) / 150000 AS m2,
         sum(l_quantity * (100 + round(l_tax * 100))) / 100 AS m3, sum(l_quantity * (100 - round(l_discount * 100))) / 100 AS m4, count(*) * 25.0::DOUBLE AS m5
  FROM shipments GROUP BY gage_id, member, date),
traces AS (
  SELECT gage_id, member, date, k AS param_id, CASE k WHEN 1 THEN m1 WHEN 2 THEN m2 WHEN 3 THEN m3 WHEN 4 THEN m4 ELSE m5 END AS sim
  FROM measures, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
runs AS (
  SELECT gage_id, param_id AS run_id, date, sum(sim) AS sim FROM traces GROUP BY 1, 2, 3)"""

RESERVOIR = DAILY + """,
raw_reservoir AS (
  SELECT gage_id, date, sum(l_quantity) AS i, sum(round(l_extendedprice * 100)) / 100 AS s FROM shipments GROUP BY 1, 2),
reservoir AS (
  SELECT gage_id, date,
    CASE WHEN NOT ((date_diff('day', DATE '1970-01-01', date) + 3 * gage_id) % 41 < 2 AND (year(date) + gage_id) % 3 <> 0
      OR (year(date) + gage_id) % 4 = 0 AND month(date) = 5) THEN s / 100 END AS stor,
    CASE WHEN NOT ((date_diff('day', DATE '1970-01-01', date) + 7 * gage_id) % 53 = 0
      OR date_diff('day', DATE '1970-01-01', date) < 8045 + 7 * gage_id) THEN i END AS inflow
  FROM raw_reservoir)"""
