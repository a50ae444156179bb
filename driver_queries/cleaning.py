"""Sources and sinks on columns cut from the driver tables, unit and calendar rules."""

from pyspark.sql import functions as F

from driver_queries.registry import registry, round_sql
from driver_queries.stand_ins import DAILY, MEASURES, daily, measures, rain, table
from freshet.functions import calendar, cleaning, units
from freshet.sources import catalogs, climate, sinks
from freshet.sources import daily as daily_sources
from freshet.sources import sensors

QUERIES, SQL, query = registry()

# ---- sources ------------------------------------------------------------------------

# Suppliers as gages, their balance as drainage area (no area below zero balance).
SITES = """
sites AS (SELECT CAST(s_suppkey AS VARCHAR) AS gage_id, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS area FROM supplier)"""


def sites(spark, d):
    bal = F.col("s_acctbal")
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("gage_id"), F.when(bal > 0, bal).alias("area")
    )


@query(
    "s1_s2_reference_gages",
    """WITH c AS (SELECT CAST(p_partkey AS VARCHAR) AS "STAID", CASE WHEN p_size > 25 THEN 'Ref' ELSE 'Non-ref' END AS "CLASS",
      CASE WHEN p_type = 'ECONOMY' THEN 'Alaska' ELSE p_type END AS "AGGECOREGION" FROM part)
    SELECT "STAID", "CLASS", "AGGECOREGION", s_name AS "STANAME", s_acctbal AS "DRAIN_SQKM" FROM c LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = "STAID"
    WHERE "CLASS" = 'Ref' AND "AGGECOREGION" = 'Alaska'""",
)
def _(spark, d):
    classes = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("STAID"),
        F.when(F.col("p_size") > 25, "Ref").otherwise("Non-ref").alias("CLASS"),
        F.when(F.col("p_type") == "ECONOMY", "Alaska").otherwise(F.col("p_type")).alias("AGGECOREGION"),
    )
    places = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("STAID"), F.col("s_name").alias("STANAME"), F.col("s_acctbal").alias("DRAIN_SQKM")
    )
    return catalogs.reference_gages(classes, places, region="Alaska")


@query(
    "s2_unregulated_gages",
    """SELECT c_name AS "STATION_NUMBER", o_orderstatus = 'F' AS "REGULATED", CAST(count(*) AS BIGINT) AS n
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' GROUP BY 1, 2""",
)
def _(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    regulation = joined.select(F.col("c_name").alias("STATION_NUMBER"), (F.col("o_orderstatus") == "F").alias("REGULATED"))
    stations = table(spark, d, "customer").select(F.col("c_name").alias("STATION_NUMBER"))
    kept = catalogs.unregulated_gages(stations, regulation)
    return kept.groupBy("STATION_NUMBER", "REGULATED").agg(F.count("*").alias("n"))


@query(
    "s3_p1_p9_usgs_series",
    f"""WITH {SITES}, r AS (SELECT CAST(l_suppkey AS VARCHAR) AS gage_id, CAST(l_shipdate AS DATE) AS date, l_quantity,
      CASE l_returnflag WHEN 'A' THEN 'A e' WHEN 'N' THEN 'P' ELSE 'X' END AS flag FROM lineitem)
    SELECT gage_id, CAST(year(date) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n, CAST(count(q) AS BIGINT) AS n_q, round(sum(q), 6) AS q FROM (
      SELECT gage_id, date, CASE WHEN flag IN ('A', 'A e', 'P', 'P e') THEN l_quantity * 86400 / (area * 3280.84::DOUBLE ** 3) * 1e6 END AS q
      FROM r JOIN sites USING (gage_id) WHERE date > DATE '1996-01-01') GROUP BY 1, 2""",
)
def _(spark, d):
    flag = F.when(F.col("l_returnflag") == "A", "A e").when(F.col("l_returnflag") == "N", "P").otherwise("X")
    raw = table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("site_no"), F.col("l_shipdate").cast("date").alias("Date"),
        F.col("l_quantity").alias("value"), flag.alias("qualifier"),
    )
    rows = daily_sources.usgs_series(raw, sites(spark, d), start="1996-01-01")
    return rows.groupBy("gage_id", "year").agg(
        F.count("*").alias("n"), F.count("q").alias("n_q"), F.round(F.sum("q"), 6).alias("q")
    )


@query(
    "s4_p2_hydat_series",
    f"""WITH {SITES}, r AS (SELECT CAST(l_suppkey AS VARCHAR) AS gage_id, CAST(l_shipdate AS DATE) AS date, l_quantity,
      CASE l_linestatus WHEN 'O' THEN 'Flow' ELSE 'Level' END AS p FROM lineitem)
    SELECT gage_id, CAST(year(date) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity * coalesce(86400 * 1e9 / (area * 1e12), 99999)), 4) AS q
    FROM r JOIN sites USING (gage_id) WHERE p = 'Flow' AND date > DATE '1996-01-01' GROUP BY 1, 2""",
)
def _(spark, d):
    kind = F.when(F.col("l_linestatus") == "O", "Flow").otherwise("Level")
    raw = table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("STATION_NUMBER"), F.col("l_shipdate").cast("date").alias("Date"),
        kind.alias("Parameter"), F.col("l_quantity").alias("Value"),
    )
    rows = daily_sources.hydat_series(raw, sites(spark, d), start="1996-01-01")
    return rows.groupBy("gage_id", "year").agg(F.count("*").alias("n"), F.round(F.sum("q"), 4).alias("q"))


@query(
    "s5_p10_sensor",
    """SELECT event_type AS station, CAST(ts AS DATE) AS date, CAST(count(*) AS BIGINT) AS n,
      CAST(count(*) FILTER (WHERE value >= 20) AS BIGINT) AS n_value, round(sum(value - 20) FILTER (WHERE value >= 20), 4) AS total FROM events GROUP BY 1, 2""",
)
def _(spark, d):
    """Event times as sensor stamps; low readings come as junk text, some below zero."""
    v = F.col("value")
    text = F.when(v < 10, "---").otherwise((v - 20).cast("string"))
    raw = table(spark, d, "events").select(
        F.col("event_type").alias("station"), F.date_format("ts", "yyyyMMdd HHmm").alias("DATE TIME"), text.alias("VALUE")
    )
    parsed = sensors.parse_sensor(raw).withColumn("value", cleaning.negative_to_null(F.col("value")))
    return parsed.groupBy("station", "date").agg(
        F.count("*").alias("n"), F.count("value").alias("n_value"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "s6_climate_layouts",
    """SELECT l_linenumber * 0.5::DOUBLE AS lon, CAST(1 + l_suppkey % 5 AS INTEGER) AS member, DATE '1990-01-01' + CAST(l_orderkey % 365 AS INTEGER) AS init_date,
      DATE '1990-01-01' + CAST(l_orderkey % 365 + l_partkey % 215 AS INTEGER) AS date, round(sum(l_quantity), 4) AS ppt
    FROM lineitem WHERE 1 + l_suppkey % 5 <= 3 GROUP BY 1, 2, 3, 4""",
)
def _(spark, d):
    raw = table(spark, d, "lineitem").select(
        (F.col("l_linenumber") * 0.5).alias("lon"), F.lit(0.0).alias("lat"), (1 + F.col("l_suppkey") % 5).alias("member"),
        (F.col("l_orderkey") % 365).alias("init_time"), (F.col("l_partkey") % 215).alias("lead_time"), F.col("l_quantity").alias("ppt"),
    )
    grid = climate.normalise_grid(raw, "seas5Multi", "1990-01-01", members=3)
    return grid.groupBy("lon", "member", "init_date", "date").agg(F.round(F.sum("ppt"), 4).alias("ppt"))


@query(
    "s7_p12_caravan",
    """SELECT 'hysets' AS data_project, CAST(l_suppkey AS VARCHAR) AS watershed_id, DATE '1970-01-01' + CAST(l_orderkey % 20000 AS INTEGER) AS date,
      sum(l_quantity) AS q, round(sum(l_extendedprice), 2) AS ppt FROM lineitem WHERE DATE '1970-01-01' + CAST(l_orderkey % 20000 AS INTEGER) BETWEEN DATE '1980-01-01' AND DATE '2004-12-31'
    GROUP BY 1, 2, 3""",
)
def _(spark, d):
    raw = table(spark, d, "lineitem").select(
        F.concat(F.lit("/landed/hysets_"), F.col("l_suppkey").cast("string"), F.lit(".csv")).alias("path"),
        F.lit("days since 1970-01-01 00:00:00").alias("units"), (F.col("l_orderkey") % 20000).alias("time_offset"),
        F.col("l_quantity").alias("streamflow"), F.col("l_extendedprice").alias("total_precipitation_sum"),
    )
    rows = daily_sources.caravan_series(daily_sources.with_watershed(raw), "1980-01-01", "2004-12-31")
    return rows.groupBy("data_project", "watershed_id", "date").agg(F.sum("q").alias("q"), F.round(F.sum("ppt"), 2).alias("ppt"))


@query("s8_resume", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    done = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("c_custkey"))
    return sinks.not_done(table(spark, d, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


@query(
    "s9_union_fill",
    f"""WITH {MEASURES} SELECT gage_id, date, q, CAST(NULL AS VARCHAR) AS member, CAST(NULL AS DOUBLE) AS m1 FROM daily
    UNION ALL SELECT gage_id, date, NULL, member, m1 FROM measures""",
)
def _(spark, d):
    return sinks.union_fill(daily(spark, d).select("gage_id", "date", "q"), measures(spark, d).select("gage_id", "date", "member", "m1"))


# ---- projections ---------------------------------------------------------------------

_UNITS = {
    "cfs_mm_usgs": "l_quantity * 86400 / (p_size * 3280.84::DOUBLE ** 3) * 1e6",
    "cms_mm": "l_quantity * (86400 * 1e9 / (p_size * 1e12))",
    "cfs_mm_sensor": "(l_quantity / 4.08735e-13) / (1e12 * p_size)",
    "cfs_acft": "l_quantity * 86400 / 43559.9::DOUBLE",
    "mm_cfs": "l_quantity * 4.08735e-13 * 1e12 * p_size",
    "mm_acft": "l_quantity * p_size * 247.105::DOUBLE / 304.8::DOUBLE",
}


@query(
    "p1_p5_units",
    "SELECT p_brand, " + ", ".join(f"round(sum({e}), 4) AS {n}" for n, e in _UNITS.items())
    + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def _(spark, d):
    q, km2 = F.col("l_quantity"), F.col("p_size")
    fns = {
        "cfs_mm_usgs": units.cfs_to_mm_usgs(q, km2), "cms_mm": units.cms_to_mm(q, km2), "cfs_mm_sensor": units.cfs_to_mm_sensor(q, km2),
        "cfs_acft": units.cfs_to_acft_day(q), "mm_cfs": units.mm_to_cfs(q, km2), "mm_acft": units.mm_to_acft(q, km2),
    }
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(*[F.round(F.sum(e), 4).alias(n) for n, e in fns.items()])


@query(
    "p6_p7_p8_calendar",
    """SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(dayofyear(date) AS INTEGER) AS doy,
      CAST(year(date + 92) AS INTEGER) AS water_year, CAST(date - make_date(CASE WHEN month(date) >= 10 THEN year(date) ELSE year(date) - 1 END, 10, 1) + 1 AS INTEGER) AS wy_day,
      CASE WHEN month(date) IN (12, 1, 2) THEN 'win' WHEN month(date) <= 5 THEN 'spr' WHEN month(date) <= 8 THEN 'sum' ELSE 'fal' END AS season,
      CAST(date - INTERVAL 3 MONTH AS DATE) AS lead_start, CAST(count(*) AS BIGINT) AS n
    FROM (SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem) GROUP BY date""",
)
def _(spark, d):
    days = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.count("*").alias("n"))
    date = F.col("date")
    return calendar.with_calendar(days).select(
        "date", "year", "month", "doy", calendar.water_year(date).alias("water_year"), calendar.wy_day(date).alias("wy_day"),
        calendar.season(F.col("month")).alias("season"), calendar.lead_start_date(date, F.lit(4)).alias("lead_start"), "n",
    )


@query(
    "p11_p13_p14_rules",
    f"""WITH {MEASURES}, m AS (SELECT gage_id, member, CASE WHEN m1 <= 40 THEN 40 ELSE m1 END AS floored, CASE WHEN m4 >= m2 THEN m2 - 0.1 ELSE m4 END AS tmin, m2 AS tmax, m3 * 0.5 AS ppt FROM measures)
    SELECT gage_id, member, {", ".join(f"round(sum({c}), 6) AS {c}" for c in ("floored", "tmin", "tmax", "ppt"))}, round(sum((tmin + tmax) / 2 + 1.5), 6) AS tavg FROM m GROUP BY 1, 2""",
)
def _(spark, d):
    m = measures(spark, d)
    tmin, tmax = cleaning.ordered_tmin(F.col("m4"), F.col("m2")), F.col("m2")
    cols = {
        "floored": cleaning.floor_at(F.col("m1"), 40), "tmin": tmin, "tmax": tmax,
        "ppt": cleaning.adjust(F.col("m3"), factor=0.5), "tavg": cleaning.adjust(cleaning.mean_temperature(tmin, tmax), offset=1.5),
    }
    return m.groupBy("gage_id", "member").agg(*[F.round(F.sum(c), 6).alias(n) for n, c in cols.items()])


def _signif_sql(x, n):
    e = f"(floor(log10(abs({x}))) - {n} + 1)"
    return f"CASE WHEN {x} = 0 THEN 0 WHEN {e} < 0 THEN round_even({x} * 10.0::DOUBLE ** -{e}, 0) / 10.0::DOUBLE ** -{e} ELSE round_even({x} / 10.0::DOUBLE ** {e}, 0) * 10.0::DOUBLE ** {e} END"


@query(
    "p15_signif",
    f"SELECT o_orderkey, {_signif_sql('o_totalprice', 2)} AS two, {_signif_sql('o_totalprice', 4)} AS four FROM orders",
)
def _(spark, d):
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", cleaning.signif(price, 2).alias("two"), cleaning.signif(price, 4).alias("four")
    )


@query(
    "p16_complete_cases",
    f"""WITH {DAILY}, rain AS (SELECT n_regionkey AS gage_id, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS ppt FROM orders
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT gage_id, date, q, round(ppt, 2) AS ppt FROM daily JOIN rain USING (gage_id, date)""",
)
def _(spark, d):
    both = daily(spark, d).select("gage_id", "date", "q").join(rain(spark, d), ["gage_id", "date"], "full")
    return cleaning.complete_cases(both).withColumn("ppt", F.round("ppt", 2))


@query(
    "j1_join_observed",
    f"""WITH {MEASURES} SELECT m.gage_id, member, m.date, m1, CASE WHEN q >= 150 THEN q END AS q FROM measures m
    LEFT JOIN (SELECT * FROM daily WHERE q >= 150) h ON h.gage_id = m.gage_id AND h.date = m.date""",
)
def _(spark, d):
    high = daily(spark, d).filter("q >= 150").select("gage_id", "date", F.col("q").alias("inflow"))
    rows = measures(spark, d).select("gage_id", "member", "date", "m1")
    return sensors.reservoir_series(rows, high, ["gage_id"]).withColumnRenamed("inflow", "q")
