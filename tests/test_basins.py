import math
import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import climate, graph, spatial
from freshet.sources import staging


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "hybas_id string, next_down string")


def test_closure_of_a_tree_with_a_stranger_and_a_cycle(spark):
    river = edges(spark, [("b", "a"), ("c", "a"), ("d", "b"), ("e", "d"), ("x", "y"), ("p", "q"), ("q", "p"), ("a", None)])
    outlets = spark.createDataFrame([("a",), ("b",), ("p",)], "outlet string")
    got = {}
    for r in graph.upstream_closure(river, outlets).collect():
        got.setdefault(r["outlet"], set()).add(r["member"])
    assert got == {"a": set("abcde"), "b": set("bde"), "p": set("pq")}


def test_closure_of_a_long_chain_takes_few_rounds(spark):
    river = edges(spark, [(str(i + 1), str(i)) for i in range(300)])
    outlets = spark.createDataFrame([("0",), ("250",)], "outlet string")
    counts = graph.upstream_closure(river, outlets).groupBy("outlet").count().collect()
    assert {r["outlet"]: r["count"] for r in counts} == {"0": 301, "250": 51}


def test_sums_of_a_chain_of_a_hundred_thousand_basins(spark):
    river = spark.range(1, 100_000).selectExpr("id as hybas_id", "id - 1 as next_down")
    outlets = spark.createDataFrame([(0,), (60_000,), (99_999,)], "outlet long")
    areas = spark.range(100_000).selectExpr("id as hybas_id", "1.0D as sub_area")
    got = {r["outlet"]: (r["num_upstream_basins"], r["area"]) for r in graph.river_sums(river, areas, outlets).collect()}
    assert got == {0: (100_000, 100_000.0), 60_000: (40_000, 40_000.0), 99_999: (1, 1.0)}


def upstream_by_hand(pairs):
    """{node: all nodes that drain to it}, itself included."""
    up = {}
    for a, b in pairs:
        if a is not None and b is not None:
            up.setdefault(b, set()).add(a)
    out = {}
    for node in {n for p in pairs for n in p if n is not None}:
        seen, todo = {node}, [node]
        while todo:
            for n in up.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        out[node] = seen
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sums_labels_and_marks_equal_walking_upstream(spark, seed):
    rng = random.Random(seed)
    # Trees, many basins above one node, self loops, unknown mouths, and cycles in seeds 2 and 3.
    pairs = [(i, rng.choice([0, max(0, i - rng.randint(1, 5)), i // 2])) for i in range(1, 120)] + [(0, None), (300, 300)]
    pairs += [(200 + i, 200 + (i + 1) % 4) for i in range(4)] if seed > 1 else []
    pairs += [(210, 202), (211, 210), (400, 401), (401, 400)] if seed > 2 else []
    want = upstream_by_hand(pairs)
    river = spark.createDataFrame(pairs, "hybas_id long, next_down long").repartition(3)
    area = {i: float(i % 7) for i in want if i % 5}
    areas = spark.createDataFrame(list(area.items()), "hybas_id long, sub_area double")
    got = {r["outlet"]: (r["num_upstream_basins"], r["area"]) for r in graph.river_sums(river, areas).collect()}
    assert got == {n: (len(m), sum(area[x] for x in m if x in area) if any(x in area for x in m) else None) for n, m in want.items() if n in got}
    assert set(got) >= set(want) - {300}
    labels = graph.river_labels(river)
    tests = spark.createDataFrame([(a, b) for a in want for b in rng.sample(sorted(want), 8)], "member long, outlet long")
    for r in graph.drains_to(tests, labels).collect():
        assert r["drains"] == (r["member"] in want[r["outlet"]]), r
    ends = rng.sample(sorted(want), 3)
    marked = graph.upstream_of(river, spark.createDataFrame([(e,) for e in ends], "outlet long"))
    assert sorted(r["member"] for r in marked.collect()) == sorted(set().union(*[want[e] for e in ends]))


def test_a_basin_with_two_ways_down_is_refused(spark):
    with pytest.raises(ValueError, match="more than one"):
        graph.river_sums(edges(spark, [("a", "b"), ("a", "c")]), spark.createDataFrame([], "hybas_id string, sub_area double"))


def test_summary_and_membership(spark):
    river = edges(spark, [("b", "a"), ("c", "a"), ("a", "sea")])
    outlets = spark.createDataFrame([("a",)], "outlet string")
    areas = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0), ("z", 8.0)], "hybas_id string, sub_area double")
    row = graph.basin_summary(river, areas, outlets).first()
    assert (row["num_upstream_basins"], row["area"]) == (3, 7.0)
    assert graph.members_of(areas, graph.upstream_of(river, outlets)).count() == 3
    gages = spark.createDataFrame([("g1", "a"), ("g2", None)], "gage_id string, hybas_id string")
    counts = {r["gage_id"]: r["num_upstream_basins"] for r in graph.gage_upstream_counts(gages, graph.river_sums(river, areas)).collect()}
    assert counts == {"g1": 3, "g2": None}


SQUARES = [(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]), (2, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)])]


def squares(spark):
    return spark.createDataFrame(SQUARES, "hybas_id int, ring array<struct<lon:double,lat:double>>")


def test_points_in_squares(spark):
    points = spark.createDataFrame(
        [("in1", 0.5, 0.5), ("both", 1.5, 1.5), ("in2", 2.5, 2.5), ("out", 5.0, 5.0), ("left edge", 0.0, 1.0), ("right edge", 2.0, 0.5), ("far", -170.0, 10.0)],
        "gage_id string, lon double, lat double",
    )
    got = {r["gage_id"]: r["hybas_id"] for r in spatial.first_polygon(points, squares(spark), "gage_id", "hybas_id", tile=0.7).collect()}
    assert got == {"in1": 1, "both": 1, "in2": 2, "out": None, "left edge": 1, "right edge": 1, "far": None}


def test_centroids_of_open_and_closed_rings(spark):
    got = {r["hybas_id"]: (r["lon"], r["lat"]) for r in spatial.centroids(squares(spark)).collect()}
    assert got[1] == pytest.approx((1, 1)) and got[2] == pytest.approx((2, 2))


def test_zonal_mean(spark):
    cells = spark.createDataFrame([(0.5, 0.5, 1.0), (1.5, 1.5, 3.0), (2.5, 2.5, 8.0)], "lon double, lat double, v double")
    got = {r["hybas_id"]: r["v"] for r in spatial.zonal_mean(cells, squares(spark), "hybas_id", ["v"]).collect()}
    assert got == {1: 2.0, 2: 5.5}


def test_nearest_prefers_the_first_on_a_tie_and_clamps(spark):
    axis = spark.createDataFrame([(0, 10.0), (1, 5.0), (2, -40.0), (3, 5.5)], "i int, v double")
    points = spark.createDataFrame([(7.75,), (5.2,), (-17.0,), (-18.0,), (99.0,), (-99.0,), (7.5,)], "x double")
    got = {r["x"]: r["near"] for r in spatial.nearest_on_axis(points, axis, "x", "v", rank="i", out="near").collect()}
    assert got == {7.75: 10.0, 5.2: 5.0, -17.0: 5.0, -18.0: -40.0, 99.0: 10.0, -99.0: -40.0, 7.5: 5.0 if abs(7.5 - 5) < abs(7.5 - 5.5) else 5.5}


def test_basin_climate_weighs_by_area_and_repairs_temperatures(spark):
    grid = spark.createDataFrame(
        [(x, 0.0, 1, "i", d, t, t + 5.0 if x else t, 10.0 * x, 1.0) for x in (0.0, 1.0) for d, t in (("d1", 2.0), ("d2", 4.0))],
        "lon double, lat double, member int, init_date string, date string, tmin double, tmax double, ppt double, pet double",
    )
    subs = spark.createDataFrame([("a", "1", 0.1, 0.0, 1.0), ("a", "2", 0.9, 0.0, 2.0), ("a", "3", 1.4, 3.0, 1.0)], "basin string, hybas_id string, lon double, lat double, sub_area double")
    row = climate.basin_climate(grid, subs).filter("date = 'd1'").first()
    assert row["tmin"] == pytest.approx((1.9 + 3 * 2.0) / 4)
    assert row["tmax"] == pytest.approx((2.0 + 3 * 7.0) / 4)
    assert row["ppt"] == pytest.approx(7.5) and row["tavg"] == pytest.approx((row["tmin"] + row["tmax"]) / 2)
    raw = climate.basin_climate(grid, subs, layout="era5", temp_offset=-1.0, precip_factor=2.0).filter("date = 'd1'").first()
    assert raw["tmin"] == pytest.approx(1.0) and raw["ppt"] == pytest.approx(15)


def test_a_mouth_with_most_basins_draining_straight_into_it(spark):
    river = edges(spark, [(f"n{i}", "mouth") for i in range(2000)] + [(f"m{i}", f"n{i}") for i in range(100)])
    closure = graph.upstream_closure(river, spark.createDataFrame([("mouth",), ("n7",)], "outlet string"))
    assert {r["outlet"]: r["count"] for r in closure.groupBy("outlet").count().collect()} == {"mouth": 2101, "n7": 2}


def test_a_tile_that_holds_most_points(spark):
    points = spark.range(3000).select(
        F.concat(F.lit("p"), F.col("id")).alias("gage_id"),
        F.when(F.col("id") % 3 < 2, 0.25).otherwise(F.col("id") / 100.0).alias("lon"),
        (F.col("id") % 7 / 10.0).alias("lat"),
    )
    got = spatial.first_polygon(points, squares(spark), "gage_id", "hybas_id", tile=0.5)
    inside = points.filter("lon <= 2 and lat <= 2").count()
    assert got.count() == 3000 and got.filter("hybas_id = 1").count() == inside


def test_nearest_with_a_value_far_off_and_hot_points(spark):
    values = [i * 0.37 for i in range(500)] + [1e9]
    xs = [i * 0.713 - 5 for i in range(300)] + [50.0] * 600 + [4e8, 6e8, 2e9, float("nan"), None]
    axis = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    points = spark.createDataFrame(list(enumerate(xs)), "id int, x double").repartition(4)
    near = spatial.nearest_on_axis(points, axis, "x", "v")
    got = {r["id"]: r["nearest"] for r in near.collect()}
    for i, x in enumerate(xs):
        want = None if x is None or x != x else min(values, key=lambda v: (abs(v - x), v))
        assert got[i] == want
    assert "SinglePartition" not in near._jdf.queryExecution().toString()
    assert spatial.nearest_on_axis(points, axis.limit(0), "x", "v").filter("nearest is not null").count() == 0


def inside_by_hand(x, y, ring):
    """Even-odd ray test with the border inside, edge by edge."""
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * ((y - ay) / (by - ay)) + ax:
            odd = not odd
    return odd


def matches(spark, rings, places, tile):
    polygons = spark.createDataFrame(list(enumerate(rings)), "hybas_id int, ring array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id int, lon double, lat double")
    found = spatial.points_in_polygons(points, polygons, ["hybas_id"], tile=tile)
    assert found.columns == ["id", "lon", "lat", "hybas_id"]
    return sorted((r["id"], r["hybas_id"]) for r in found.collect())


@pytest.mark.parametrize("tile", [1.0, 0.7, 3.0])
def test_points_on_a_lattice_in_rings_along_tile_lines(spark, tile):
    """Vertices, edges and points on tile lines and corners, rings that cross themselves, two alike."""
    rng = random.Random(5)
    rings = [[(float(rng.randint(-3, 6)), float(rng.randint(-3, 6))) for _ in range(rng.randint(3, 9))] for _ in range(25)]
    rings += [rings[0], [(x * 0.7, y * 0.7) for x, y in rings[1]], [(1.0, 1.0)], []]
    places = [(x / 2, y / 2) for x in range(-8, 14) for y in range(-8, 14)] + [(x * 0.7, y * 0.35) for x in range(-4, 9) for y in range(-8, 18)]
    want = sorted((i, k) for i, p in enumerate(places) for k, ring in enumerate(rings) if ring and inside_by_hand(*p, ring))
    assert matches(spark, rings, places, tile) == want


def test_a_ring_of_ten_thousand_points_over_a_thousand_tiles(spark):
    rng = random.Random(9)
    ring = []
    for i in range(10_000):
        t, r = 2 * math.pi * i / 10_000, 10 + 6 * math.sin(14 * math.pi * i / 10_000) + rng.uniform(-0.4, 0.4)
        ring.append((r * math.cos(t), r * math.sin(t)))
    places = [(rng.uniform(-17, 17), rng.uniform(-17, 17)) for _ in range(400)] + ring[:20] + [(float("nan"), 0.0), (0.0, None)]
    want = [(i, 0) for i, p in enumerate(places[:420]) if inside_by_hand(*p, ring)]
    assert matches(spark, [ring], places, 1.0) == want
    shape = spark.createDataFrame([(ring,)], "ring array<struct<lon:double,lat:double>>")
    tiles = spatial.tile_edges(shape, tile=1.0)
    assert "ring" not in tiles.columns and tiles.count() > 400
    # Each edge lies in the few tiles that it crosses.
    assert tiles.agg(F.sum(F.size("_edges"))).first()[0] < 15_000


def test_vertices_without_a_coordinate_are_left_out(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (None, 5.0), (2.0, 2.0), (1.0, float("nan")), (0.0, 2.0)]
    assert matches(spark, [square, [(None, None)]], [(1.0, 1.0), (1.0, 2.0), (3.0, 1.0)], 0.7) == [(0, 0), (1, 0)]


def test_no_temporary_checkpoints_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session())
