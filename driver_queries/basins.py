"""River graph, spatial joins, basin climate."""

from pyspark.sql import functions as F

from driver_queries.registry import registry, round_sql, rounded
from driver_queries.stand_ins import table
from freshet.operators import climate, graph, spatial
from freshet.plans import climate as climate_plan
from freshet.sources.staging import Staging

QUERIES, SQL, query = registry()

# Suppliers form a binary river: s drains to floor(s / 2); 0 drains to itself.
RIVER = """
river AS (SELECT s_suppkey AS hybas_id, s_suppkey // 2 AS next_down, s_acctbal + 1000 AS sub_area FROM supplier),
up AS (SELECT hybas_id AS outlet, hybas_id AS member FROM river
  UNION SELECT u.outlet, r.hybas_id FROM up u JOIN river r ON r.next_down = u.member)"""


def river(spark, d):
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("hybas_id"),
        F.floor(F.col("s_suppkey") / 2).alias("next_down"),
        (F.col("s_acctbal") + 1000).alias("sub_area"),
    )


@query("j6_upstream", f"WITH RECURSIVE {RIVER} SELECT outlet, member FROM up")
def _(spark, d):
    basins = river(spark, d)
    return graph.upstream_closure(basins, basins.select(F.col("hybas_id").alias("outlet")))


@query(
    "j7_basin_summary",
    f"""WITH RECURSIVE {RIVER} SELECT outlet, CAST(count(*) AS BIGINT) AS num_upstream_basins, round(sum(sub_area), 2) AS area
    FROM up JOIN river ON member = hybas_id GROUP BY 1""",
)
def _(spark, d):
    basins = river(spark, d)
    out = graph.basin_summary(basins, basins, basins.select(F.col("hybas_id").alias("outlet")))
    return rounded(out, ["outlet", "num_upstream_basins"], 2)


@query(
    "j12_members_of",
    f"""WITH RECURSIVE {RIVER} SELECT hybas_id, round(sub_area, 2) AS sub_area FROM river
    SEMI JOIN (SELECT DISTINCT member FROM up WHERE outlet IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)) m ON m.member = hybas_id""",
)
def _(spark, d):
    basins = river(spark, d)
    outlets = basins.filter("sub_area < 1000").select(F.col("hybas_id").alias("outlet"))
    inside = graph.members_of(basins, graph.upstream_of(basins, outlets))
    return inside.select("hybas_id", F.round("sub_area", 2).alias("sub_area"))


@query(
    "q5_upstream_counts",
    f"""WITH RECURSIVE {RIVER} SELECT s.s_name AS gage_id, s.s_suppkey AS hybas_id, CAST(count(*) AS BIGINT) AS num_upstream_basins
    FROM supplier s JOIN up ON outlet = s.s_suppkey GROUP BY 1, 2""",
)
def _(spark, d):
    gages = table(spark, d, "supplier").select(F.col("s_name").alias("gage_id"), F.col("s_suppkey").alias("hybas_id"))
    basins = river(spark, d)
    return graph.gage_upstream_counts(gages, graph.river_sums(basins, basins))


@query(
    "j12_drains_to",
    f"""WITH RECURSIVE {RIVER}, p AS (SELECT DISTINCT l_suppkey AS member, l_suppkey // (1 + l_linenumber) + l_orderkey % 2 AS outlet FROM lineitem)
    SELECT p.member, p.outlet, u.member IS NOT NULL OR p.member = p.outlet AS drains FROM p LEFT JOIN up u ON u.outlet = p.outlet AND u.member = p.member""",
)
def _(spark, d):
    """Pairs of suppliers, some of them along one river, some unknown."""
    key = F.col("l_suppkey")
    outlet = F.floor(key / (1 + F.col("l_linenumber"))) + F.col("l_orderkey") % 2
    pairs = table(spark, d, "lineitem").select(key.alias("member"), outlet.alias("outlet")).distinct()
    return graph.drains_to(pairs, graph.river_labels(river(spark, d)))


# Suppliers as quadrilateral basins, customers as gage points, on one plane that grows
# northwards with the tables, so the number of basins around a point stays the same.
SHAPES = """
shapes AS (SELECT s_suppkey AS hybas_id, s_acctbal / 1000 AS x, s_suppkey / 10.0::DOUBLE AS y, 0.4 + (s_suppkey % 7) / 5.0::DOUBLE AS w FROM supplier),
corners AS (SELECT hybas_id, unnest([{'i': 0, 'lon': x, 'lat': y}, {'i': 1, 'lon': x + w, 'lat': y + w / 4}, {'i': 2, 'lon': x + w * 0.8::DOUBLE, 'lat': y + w},
  {'i': 3, 'lon': x - w / 3, 'lat': y + w * 0.7::DOUBLE}]) AS c FROM shapes),
sides AS (SELECT a.hybas_id, a.c.lon AS ax, a.c.lat AS ay, b.c.lon AS bx, b.c.lat AS b_y FROM corners a JOIN corners b ON a.hybas_id = b.hybas_id AND b.c.i = (a.c.i + 1) % 4),
spots AS (SELECT c_custkey AS gage_id, c_acctbal / 1000 AS lon, c_custkey / 150.0::DOUBLE AS lat FROM customer),
hits AS (SELECT gage_id, hybas_id FROM spots, sides WHERE (ay > lat) <> (b_y > lat) AND lon < (bx - ax) * (lat - ay) / (b_y - ay) + ax
  GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


def shapes(spark, d):
    x, y = F.col("s_acctbal") / 1000, F.col("s_suppkey") / 10.0
    w = 0.4 + (F.col("s_suppkey") % 7) / 5.0

    def corner(lon, lat):
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    ring = F.array(corner(x, y), corner(x + w, y + w / 4), corner(x + w * 0.8, y + w), corner(x - w / 3, y + w * 0.7))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("hybas_id"), ring.alias("ring"))


def spots(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("gage_id"),
        (F.col("c_acctbal") / 1000).alias("lon"),
        (F.col("c_custkey") / 150.0).alias("lat"),
    )


@query(
    "j5_point_in_polygon",
    f"""WITH {SHAPES} SELECT s.gage_id, min(hybas_id) AS hybas_id FROM spots s LEFT JOIN hits h ON h.gage_id = s.gage_id GROUP BY 1""",
)
def _(spark, d):
    return spatial.first_polygon(spots(spark, d), shapes(spark, d), "gage_id", "hybas_id").select("gage_id", "hybas_id")


@query(
    "j8_centroids",
    f"""WITH {SHAPES}, o AS (SELECT hybas_id, c.lon AS ox, c.lat AS oy FROM corners WHERE c.i = 0),
    k AS (SELECT hybas_id, (ax - ox) AS ax, (ay - oy) AS ay, (bx - ox) AS bx, (b_y - oy) AS b_y, ox, oy FROM sides JOIN o USING (hybas_id))
    SELECT hybas_id, round(max(ox) + sum((ax + bx) * (ax * b_y - bx * ay)) / (3 * sum(ax * b_y - bx * ay)), 6) AS lon,
      round(max(oy) + sum((ay + b_y) * (ax * b_y - bx * ay)) / (3 * sum(ax * b_y - bx * ay)), 6) AS lat FROM k GROUP BY 1""",
)
def _(spark, d):
    return spatial.centroids(shapes(spark, d)).select("hybas_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(
    "j9_zonal_mean",
    f"""WITH {SHAPES} SELECT hybas_id, round(avg(c_acctbal), 4) AS c_acctbal FROM hits JOIN customer ON c_custkey = gage_id GROUP BY 1""",
)
def _(spark, d):
    cells = spots(spark, d).join(
        table(spark, d, "customer").select(F.col("c_custkey").alias("gage_id"), "c_acctbal"), "gage_id"
    )
    return rounded(spatial.zonal_mean(cells, shapes(spark, d), "hybas_id", ["c_acctbal"]), ["hybas_id"])


# A climate grid out of lineitem: line number and tax give the cell, line status the
# member, ship month the date.
GRID = """
grid AS (SELECT l_linenumber * 0.75::DOUBLE AS lon, round(l_tax * 40, 1) AS lat, CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS member,
  CAST(date_trunc('year', l_shipdate) AS DATE) AS init_date, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  avg(l_quantity) AS tmin, avg(l_extendedprice) / 1500 AS tmax, sum(l_quantity) AS ppt, avg(l_discount) AS pet FROM lineitem GROUP BY 1, 2, 3, 4, 5),
subs AS (SELECT s_nationkey % 5 AS basin, s_suppkey AS hybas_id, s_acctbal / 1500 AS lon, s_nationkey / 8.0::DOUBLE + 0.03::DOUBLE AS lat, s_acctbal + 1000 AS sub_area FROM supplier),
ln AS (SELECT hybas_id, arg_min(v, abs(v - lon) * 1000000 + v / 1000) AS cell_lon FROM subs, (SELECT DISTINCT lon AS v FROM grid) GROUP BY 1),
lt AS (SELECT hybas_id, arg_min(v, abs(v - lat) * 1000000 + v / 1000) AS cell_lat FROM subs, (SELECT DISTINCT lat AS v FROM grid) GROUP BY 1),
near AS (SELECT subs.*, cell_lon, cell_lat FROM subs JOIN ln USING (hybas_id) JOIN lt USING (hybas_id))"""


def grid(spark, d):
    ship = F.col("l_shipdate")
    return (
        table(spark, d, "lineitem")
        .groupBy(
            (F.col("l_linenumber") * 0.75).alias("lon"),
            F.round(F.col("l_tax") * 40, 1).alias("lat"),
            F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("member"),
            F.trunc(ship, "year").alias("init_date"),
            F.trunc(ship, "month").alias("date"),
        )
        .agg(
            F.avg("l_quantity").alias("tmin"),
            (F.avg("l_extendedprice") / 1500).alias("tmax"),
            F.sum("l_quantity").alias("ppt"),
            F.avg("l_discount").alias("pet"),
        )
    )


def subbasins(spark, d):
    return table(spark, d, "supplier").select(
        (F.col("s_nationkey") % 5).alias("basin"),
        F.col("s_suppkey").alias("hybas_id"),
        (F.col("s_acctbal") / 1500).alias("lon"),
        (F.col("s_nationkey") / 8.0 + 0.03).alias("lat"),
        (F.col("s_acctbal") + 1000).alias("sub_area"),
    )


@query("j4_nearest", f"WITH {GRID} SELECT hybas_id, cell_lon, cell_lat FROM near")
def _(spark, d):
    cells = grid(spark, d)
    subs = subbasins(spark, d).select("hybas_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    out = spatial.nearest_on_axis(subs, cells.select("lon").distinct(), "x", "lon", out="cell_lon")
    out = spatial.nearest_on_axis(out, cells.select("lat").distinct(), "y", "lat", out="cell_lat")
    return out.select("hybas_id", "cell_lon", "cell_lat")


_CLIMATE = ["tmin", "tmax", "ppt", "pet", "tavg"]


def _climate_sql(tmin, offset="", factor=""):
    return f"""WITH {GRID}, f AS (SELECT * REPLACE ({tmin} AS tmin) FROM grid),
    c AS (SELECT basin, f.member, f.init_date, f.date, sum(tmin * sub_area) / sum(sub_area){offset} AS tmin, sum(tmax * sub_area) / sum(sub_area){offset} AS tmax,
      sum(ppt * sub_area) / sum(sub_area){factor} AS ppt, sum(pet * sub_area) / sum(sub_area) AS pet
      FROM near JOIN f ON f.lon = cell_lon AND f.lat = cell_lat GROUP BY 1, 2, 3, 4)
    SELECT basin, CAST(member AS INTEGER) AS member, init_date, date, {round_sql(_CLIMATE, 6)} FROM (SELECT *, (tmin + tmax) / 2 AS tavg FROM c)"""


@query("b1_area_mean", _climate_sql("CASE WHEN tmin >= tmax THEN tmax - 0.1 ELSE tmin END", " + 1.5", " * 0.5"))
def _(spark, d):
    out = climate.basin_climate(grid(spark, d), subbasins(spark, d), temp_offset=1.5, precip_factor=0.5)
    return rounded(out, ["basin", "member", "init_date", "date"], 6)


@query("b1_area_mean_era5", _climate_sql("tmin"))
def _(spark, d):
    out = climate.basin_climate(grid(spark, d), subbasins(spark, d), layout="era5")
    return rounded(out, ["basin", "member", "init_date", "date"], 6)


@query("j4_null_point", f"WITH {GRID} SELECT hybas_id, CASE WHEN hybas_id % 3 <> 0 THEN cell_lon END AS cell_lon FROM near")
def _(spark, d):
    x = F.when(F.col("hybas_id") % 3 != 0, F.col("lon"))
    subs = subbasins(spark, d).select("hybas_id", x.alias("x"))
    return spatial.nearest_on_axis(subs, grid(spark, d).select("lon").distinct(), "x", "lon", out="cell_lon").select("hybas_id", "cell_lon")


@query(
    "b1_null_cells",
    f"""WITH {GRID}, f AS (SELECT * REPLACE (CASE WHEN dayofyear(date) % 3 <> 0 OR tmin < tmax - 8 THEN tmax END AS tmax) FROM grid)
    SELECT basin, CAST(f.member AS INTEGER) AS member, f.init_date, f.date, round(sum(tmin * sub_area) / sum(sub_area), 6) AS tmin,
      CASE WHEN count(tmax) = count(*) THEN round(sum(tmax * sub_area) / sum(sub_area), 6) END AS tmax
    FROM near JOIN f ON f.lon = cell_lon AND f.lat = cell_lat GROUP BY 1, 2, 3, 4""",
)
def _(spark, d):
    known = (F.dayofyear("date") % 3 != 0) | (F.col("tmin") < F.col("tmax") - 8)
    holes = grid(spark, d).withColumn("tmax", F.when(known, F.col("tmax")))
    out = climate.basin_climate(holes, subbasins(spark, d), layout="era5")
    return rounded(out.select("basin", "member", "init_date", "date", "tmin", "tmax"), ["basin", "member", "init_date", "date"], 6)


@query(
    "b2_archive",
    f"""WITH {GRID}, h AS (SELECT * REPLACE (CASE WHEN dayofyear(date) % 3 <> 0 OR tmin < tmax - 8 THEN tmax END AS tmax, CASE WHEN lon > 1 THEN pet END AS pet) FROM grid),
    k AS (SELECT init_date, median(tmax) AS k_tmax, median(pet) AS k_pet FROM h GROUP BY 1),
    g AS (SELECT h.* REPLACE (coalesce(tmax, k_tmax) AS tmax, coalesce(pet, k_pet) AS pet) FROM h JOIN k USING (init_date)),
    f AS (SELECT * REPLACE (CASE WHEN tmin >= tmax THEN tmax - 0.1 ELSE tmin END AS tmin) FROM g),
    c AS (SELECT basin, f.member, f.init_date, f.date, sum(tmin * sub_area) / sum(sub_area) AS tmin, sum(tmax * sub_area) / sum(sub_area) AS tmax,
      sum(ppt * sub_area) / sum(sub_area) AS ppt, sum(pet * sub_area) / sum(sub_area) AS pet
      FROM near JOIN f ON f.lon = cell_lon AND f.lat = cell_lat GROUP BY 1, 2, 3, 4)
    SELECT basin, CAST(member AS INTEGER) AS member, init_date, date, {round_sql(_CLIMATE, 6)} FROM (SELECT *, (tmin + tmax) / 2 AS tavg FROM c)""",
)
def _(spark, d):
    """Basin climate with holes filled by cube, written by initialisation: a run that ends early, then one that goes on."""
    known = (F.dayofyear("date") % 3 != 0) | (F.col("tmin") < F.col("tmax") - 8)
    staging = Staging(spark, "archive")
    holes = staging.keep(
        grid(spark, d).withColumns({"tmax": F.when(known, F.col("tmax")), "pet": F.when(F.col("lon") > 1, F.col("pet"))})
    )
    path = f"{staging.folder}/archive"
    climate_plan.archive(holes, subbasins(spark, d), path, batch=3, most=1)
    out = climate_plan.archive(holes, subbasins(spark, d), path, batch=3)
    return rounded(out, ["basin", "member", "init_date", "date"], 6)
