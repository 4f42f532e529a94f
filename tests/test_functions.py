import datetime as dt
import math

from pyspark.sql import functions as F

from epigrid.functions import numbers, places, text, timeidx
from epigrid.functions.nulls import clean_doubles, finite, nonfinite_counts, resolve_alias


def values(df, column):
    return [r[column] for r in df.collect()]


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (-float("inf"),)], "x double")
    assert values(df.select(finite("x").alias("f")), "f") == [True, False, False, False, False]
    assert values(clean_doubles(df), "x") == [1.0, None, None, None, None]
    assert nonfinite_counts(df, ["x"]).first()["n_nonfinite"] == 4
    assert resolve_alias(df, ["y", "x"]) == "x"


def test_weeks(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 3),), (dt.date(2020, 12, 31),), (dt.date(2024, 1, 1),)], "d date")
    got = timeidx.with_week(df, "d").select("epiyear", "epiweek", timeidx.week_start("epiyear", "epiweek").alias("s"), timeidx.week_label("epiyear", "epiweek").alias("l")).collect()
    assert [(r.epiyear, r.epiweek, r.l) for r in got] == [(2020, 53, "2020-W53"), (2020, 53, "2020-W53"), (2024, 1, "2024-W01")]
    assert got[0].s == dt.date(2020, 12, 28)
    y, w = timeidx.parse_week_label("l")
    labels = spark.createDataFrame([("2024-W5",), ("2024-W05",), ("x",)], "l string").select(y.alias("y"), w.alias("w")).collect()
    assert [(r.y, r.w) for r in labels] == [(2024, 5), (2024, 5), (None, None)]
    rolled = spark.range(1).select(timeidx.week_start(F.lit(2021), F.lit(53)).alias("s")).first().s
    assert rolled == dt.date(2022, 1, 3)


def test_last_complete_week_and_horizon(spark):
    dates = lambda *d: spark.createDataFrame([(dt.date(2024, 1, x),) for x in d], "d date")
    assert timeidx.last_complete_week(dates(1, 7, 15), "d").first().epiweek == 2
    assert timeidx.last_complete_week(dates(1, 14, 22), "d").first().epiweek == 3
    assert timeidx.last_complete_week(dates(1, 14, 21), "d").first().epiweek == 3
    assert timeidx.week_index(spark, "2024-01-01", "2024-01-21").count() == 3


def test_buckets_and_dates(spark):
    weeks = timeidx.week_index(spark, "2022-01-03", "2022-12-31")
    got = {r.time_index: r for r in timeidx.time_buckets(weeks).collect()}
    assert got[1].timestep_2wk == 1 and got[3].timestep_2wk == 2 and got[1].quarter_index == 1 and got[52].quarter_index == 4 and got[52].sixmo_index == 2 and got[52].year_index == 1
    one = spark.range(1).select(timeidx.day_of_year_date(F.lit(2024), F.lit(60)).alias("a"), timeidx.decimal_year_date(F.lit(2024.5)).alias("b")).first()
    assert one.a == dt.date(2024, 2, 29) and one.b == dt.date(2024, 7, 2)
    parsed = timeidx.parse_dates(spark.createDataFrame([("2024-01-02",), ("2024/01/03",), (None,)], "t string"), "t")
    assert values(parsed, "date") == [dt.date(2024, 1, 2), None, None]


def test_hosts_and_keys(spark):
    df = spark.createDataFrame([(" Bovino-Suino ",), ("Felino",), ("Dragón",), (None,)], "h string").withColumn("c", text.clean_host("h"))
    got = df.select("c", text.host_class("c").otherwise(None).alias("k"), text.multiple_hosts("c").alias("m")).collect()
    assert [(r.c, r.k, r.m) for r in got] == [("bovinosuino", "bovine", True), ("felino", "feline", False), ("dragn", None, False), (None, None, False)]
    assert df.select(text.host_group(F.lit("bird")).alias("g")).first().g == "wildlife"
    key = spark.createDataFrame([(None, 1.00000000000001)], "a string, x double").select(text.composite_key("a", text.significant("x")).alias("k")).first().k
    assert key == "<NA>|1.0"


def test_labels(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([1, 3],), ([],)], "s array<int>")
    assert values(df.select(text.range_label("s").alias("l")), "l") == ["1:3 (3 timesteps)", "1,3", ""]
    names = spark.createDataFrame([("Range for tier1_field",), ("Precision for admin_f",), ("size for the nbinomial",), ("other",)], "n string")
    assert [r.h.component for r in names.select(text.hyperparameter("n").alias("h")).collect()] == ["Tier 1 SPDE", "Tier 1 administrative IID", "Negative-binomial likelihood", "INLA hyperparameter"]
    assert spark.range(1).select(text.effect_label(F.lit("rhum")).alias("l")).first().l == "Relative humidity"


def test_masks_and_classes(spark):
    df = spark.createDataFrame([(1.0, 14.4), (2.0, 14.5), (None, 14.5), (4.0, None), (4.0, float("nan"))], "v double, t double")
    assert values(df.select(numbers.masked_by_temperature("v", "t", 14.5).alias("m")), "m") == [0.0, 2.0, None, None, None]
    warm = spark.createDataFrame([(1.0, 14.5), (2.0, 15.0), (3.0, 15.1), (None, 15.1)], "v double, t double")
    assert values(warm.select(numbers.masked_by_temperature("v", "t", 15.0).alias("m")), "m") == [0.0, 2.0, 3.0, None]
    c = spark.createDataFrame([(2.999,), (3.0,), (7.999,), (8.0,), (14.999,), (15.0,), (None,)], "x double")
    assert values(c.select(numbers.persistence_class("x").alias("c")), "c") == [0, 1, 1, 2, 2, 3, None]


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 0.6, 1.4, 0.1), (3.0, 2.6, 3.4, -1.0)], "m double, lo double, hi double, w double")
    mean, low, high = numbers.weighted_quantiles("m", "lo", "hi", "w")
    got = df.select(mean.alias("m"), low.alias("l"), high.alias("h")).collect()
    assert [round(x, 9) for x in got[0]] == [0.1, 0.06, 0.14] and list(got[1]) == [-3.0, -3.4, -2.6]


def test_intervals(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (3.0,), (9.0,), (-1.0,)], "x double").withColumn("b", F.array(*[F.lit(float(i)) for i in range(4)]))
    assert values(df.select(numbers.interval_bin("x", "b").alias("k")), "k") == [1, 2, 2, 3, 3, 1]
    assert values(df.limit(1).select(numbers.midpoints("b").alias("m")), "m") == [[0.5, 1.5, 2.5]]
    rows = spark.range(1, 11).select("id", numbers.evenly_spaced("id", F.lit(10), 4).alias("e")).where("e")
    assert sorted(values(rows, "id")) == [1, 4, 7, 10]


def test_grid_and_projection(spark):
    g = places.Grid(2, 2, 0.0, 2.0, 0.0, 2.0)
    df = spark.createDataFrame([(0.5, 1.5), (1.5, 0.5), (2.0, 0.0), (0.0, 2.0), (2.1, 0.0)], "x double, y double")
    assert values(df.select(g.cell("x", "y").alias("c")), "c") == [1, 4, 4, 1, None]
    x, y = places.albers(F.lit(-75.0), F.lit(20.0), -75.0, 20.0, 15.0, 25.0)
    at = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(at.x) < 1e-8 and abs(at.y) < 1e-8
    # Equal areas: a small square at the parallel of 15 degrees keeps its size on the ellipsoid.
    d = 0.01
    corners = [(-75 + a, 15 + b) for a, b in ((-d, -d), (d, -d), (d, d), (-d, d))]
    pts = spark.createDataFrame(corners, "lon double, lat double")
    x, y = places.albers("lon", "lat", -75.0, 20.0, 15.0, 25.0)
    p = [(r.x, r.y) for r in pts.select(x.alias("x"), y.alias("y")).collect()]
    area = abs(sum(p[i - 1][0] * p[i][1] - p[i][0] * p[i - 1][1] for i in range(4))) / 2
    e2 = places.FLATTENING * (2 - places.FLATTENING)
    s = math.sin(math.radians(15))
    exact = (places.SEMI_MAJOR / 1000) ** 2 * (1 - e2) / (1 - e2 * s * s) ** 2 * math.cos(math.radians(15)) * math.radians(2 * d) ** 2
    assert abs(area / exact - 1) < 1e-5
    assert places.unit_factor('PROJCS["a",UNIT["kilometre",1000]]') == 1000 and places.unit_factor('LENGTHUNIT["metre",1]') == 1


def test_units_of_well_known_texts():
    old = 'PROJCS["a ""b"" [c",GEOGCS["g",UNIT["degree",0.0174532925199433]],PROJECTION["Albers"],UNIT["US survey foot",0.304800609601219]]'
    new = 'PROJCRS["n",BASEGEOGCRS["g",ANGLEUNIT["degree",0.0174]],CS[Cartesian,2],AXIS["e",east,LENGTHUNIT["kilometre",1000]],AXIS["n",north,LENGTHUNIT["kilometre",1000]]]'
    assert places.unit_factor(old) == 0.304800609601219 and places.unit_factor(new) == 1000
    assert places.unit_factor('PROJCS["a",UNIT["kilometre"]]') == 1000 and places.unit_factor('PROJCS["a"]') == 1 and places.unit_factor("") == 1
    assert places.wkt_tree(old)[1] == 'a "b" [c'
    for bad in ('GEOGCS["g",UNIT["degree",0.017]]', 'PROJCS["a"', "]"):
        try:
            places.unit_factor(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_albers_there_and_back(spark):
    rows = [(float(lon), float(lat)) for lon in (-179, -96, 0, 60, 83) for lat in (-70, -10, 0, 23, 37.5, 60, 85)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    for at in ({"lon0": -96.0, "lat0": 23.0, "lat1": 29.5, "lat2": 45.5}, {"lon0": 0.0, "lat0": -20.0, "lat1": -35.0, "lat2": -10.0}, {"lon0": 10.0, "lat0": 40.0, "lat1": 40.0, "lat2": 40.0}):
        x, y = places.albers("lon", "lat", **at)
        back = df.withColumns({"x": x, "y": y}).withColumns(dict(zip(("lon2", "lat2"), places.albers_inverse("x", "y", **at), strict=True))).collect()
        assert max(max(abs(r.lon - r.lon2), abs(r.lat - r.lat2)) for r in back) < 1e-9
