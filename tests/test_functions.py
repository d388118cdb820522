"""Scalar functions: boundaries and golden values."""

import math

import pytest
from pyspark.sql import functions as F

from pingtrail.functions import angles, geo, solar, timeutil as tu


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("angle,sector", [
    (0.0, "North"), (22.5, "North"), (22.6, "Northeast"), (67.5, "Northeast"), (90.0, "East"),
    (337.5, "North"), (337.4, "Northwest"), (359.9, "North"), (-15.0, "North"), (-45.0, "Northwest"),
    (180.0, "South"), (None, "Unknown/Omni"),
])
def test_sectors(spark, angle, sector):
    assert one(spark, angles.compass_sector(F.lit(angle).cast("double")))[0] == sector


def test_literal_sectors_lack_north(spark):
    literal = [one(spark, angles.compass_sector(F.lit(a), wrap=False))[0]
               for a in (0.0, 359.0, -15.0, 22.5)]
    assert literal == ["Unknown/Omni"] * 3 + ["Northeast"]


def test_circular_mean(spark):
    def mean(rows):
        df = spark.createDataFrame(rows, "a DOUBLE, w DOUBLE")
        return df.agg(angles.circular_mean("a", "w")).first()[0]

    assert mean([(350.0, 1.0), (10.0, 1.0)]) % 360 == pytest.approx(0.0, abs=1e-9)
    assert mean([(0.0, 1.0), (180.0, 1.0)]) is None
    assert mean([(0.0, 1.0), (None, 1.0)]) is None
    base = mean([(20.0, 1.0), (80.0, 3.0)])
    turned = mean([(320.0, 1.0), (20.0, 3.0)])
    assert (base - turned) % 360 == pytest.approx(60.0)


def test_cut_and_bearing_category(spark):
    values = [0, 2, 3, 5, 10, 20, 21, None]
    df = spark.createDataFrame([(v,) for v in values], "n INT")
    bins = [r[0] for r in df.select(tu.cut("n", [0, 5, 10, 20, float("inf")])).collect()]
    assert bins == [None, "(0,5]", "(0,5]", "(0,5]", "(5,10]", "(10,20]", "(20,Inf]", None]
    cats = one(spark, *[angles.bearing_category(F.lit(a)) for a in (90, 0, 180, 270, 45)])
    assert list(cats) == ["N", "E", "S", "W", None]


def test_rounding(spark):
    t = F.lit("2021-01-01 00:00:02.500000").cast("timestamp")
    got = one(spark, *[tu.micros(tu.round_time(t, 5, how)) % 60_000_000
                       for how in ("nearest", "floor", "ceil")])
    assert list(got) == [5_000_000, 0, 5_000_000]


def test_malformed_time_bound_is_an_error(spark):
    from pingtrail.operators.filters import time_slice

    df = spark.range(1).select(F.current_timestamp().alias("ts"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        time_slice(df, "2021-01-20 19:18:000").collect()


def test_ids_compare_as_text(spark):
    from pingtrail.operators.filters import time_slice

    df = spark.createDataFrame([("61780778",), ("614B7878",)], "TagId STRING")
    assert time_slice(df, tag=61780778, tag_col="TagId").count() == 1


def _clock(ts):
    return ts.strftime("%Y-%m-%d %H:%M:%S")


def test_sun_times(spark):
    sites = spark.createDataFrame([(36.490484, -102.649942)], "lat DOUBLE, lon DOUBLE")
    cal = solar.sun_calendar(sites, "2021-01-20", "2021-03-28")
    assert cal.count() == 68
    first = cal.orderBy("date").select(
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in solar.TWILIGHT]
    ).first()
    assert list(first) == [
        "2021-01-20 13:01:32", "2021-01-20 14:00:50", "2021-01-21 00:04:50", "2021-01-21 01:04:08",
    ]


def test_polar_night_has_no_sunrise(spark):
    df = spark.createDataFrame([(80.0, 10.0)], "lat DOUBLE, lon DOUBLE")
    row = solar.add_sun_times(df, F.lit("2021-12-21"), "lat", "lon", ("sunrise", "sunset")).first()
    assert row["sunrise"] is None and row["sunset"] is None


def test_solar_date_keeps_evening_with_its_day(spark):
    times = ["2021-01-21 00:30:00", "2021-01-21 13:30:00"]
    df = spark.createDataFrame([(t,) for t in times], "t STRING").select(
        F.col("t").cast("timestamp").alias("ts"),
        F.lit(36.490484).alias("recvDeployLat"), F.lit(-102.649942).alias("recvDeployLon"),
    )
    rows = solar.time_of_day(solar.with_sun(df, keep=solar.TWILIGHT)).orderBy("ts").collect()
    assert [str(r["solar_date"]) for r in rows] == ["2021-01-20", "2021-01-21"]
    assert rows[0]["time_of_day"].startswith("Post-Sunset")
    assert rows[1]["time_of_day"].startswith("Pre-Sunrise")
    rel = solar.time_to_sun(df).orderBy("ts").collect()
    assert rel[0]["ts_since_set"] == pytest.approx(0.419, abs=0.01)
    assert rel[1]["ts_to_rise"] == pytest.approx(0.507, abs=0.01)
    for r in rel:
        assert r["ts_since_rise"] + r["ts_to_rise"] == pytest.approx(24, abs=0.1)


@pytest.mark.parametrize("doy,hours", [(2000, 14.65317), (1999, 14.65447), (1998, 14.6549)])
def test_day_length_golden(spark, doy, hours):
    got = one(spark, solar.day_length(F.lit(36.48946), F.lit(doy)))[0]
    assert got == pytest.approx(hours, abs=1e-5)


def test_geodesic(spark):
    def dist(*p):
        return one(spark, geo.geodesic_m(*[F.lit(float(c)) for c in p]))[0]

    # published quarter-degree facts of the WGS84 ellipsoid
    assert dist(0, 0, 0, 1) == pytest.approx(111319.490793, abs=1e-3)
    assert dist(0, 0, 1, 0) == pytest.approx(110574.388558, abs=1e-3)
    assert dist(36.5, -102.6, 36.5, -102.6) == 0
    antipodal = dist(0, 0, 0.5, 179.7)
    assert antipodal == pytest.approx(19_936_288, rel=0.01)


def test_utm(spark):
    east, north = geo.to_utm(F.lit(0.0), F.lit(-105.0), 13)
    assert list(one(spark, east, north)) == pytest.approx([500000.0, 0.0], abs=1e-6)
    east, north = geo.to_utm(F.lit(45.0), F.lit(-105.0), 13)
    # meridian arc to 45 degrees, times the central scale
    assert one(spark, north)[0] == pytest.approx(4984944.378 * 0.9996, abs=0.01)
    lo, _ = geo.to_utm(F.lit(36.5), F.lit(-106.0), 13)
    hi, _ = geo.to_utm(F.lit(36.5), F.lit(-104.0), 13)
    assert sum(one(spark, lo, hi)) == pytest.approx(1_000_000.0, abs=1e-6)


def test_local_plane(spark):
    x, y = geo.local_xy_m(F.lit(36.51), F.lit(-102.59), F.lit(36.5), F.lit(-102.6))
    got = one(spark, x, y)
    want_y = math.radians(0.01) * geo.EARTH_RADIUS
    assert got[1] == pytest.approx(want_y)
    assert got[0] == pytest.approx(want_y * math.cos(math.radians(36.5)))


def test_missing_coordinates_have_no_distance(spark):
    from pingtrail.functions import geo

    df = spark.createDataFrame([(None, 1.0), (1.0, None)], "a DOUBLE, b DOUBLE").withColumns({"c": F.lit(3.0), "d": F.lit(4.0)})
    for distance in (geo.haversine_m, geo.geodesic_m):
        assert [r[0] for r in df.select(distance("a", "b", "c", "d")).collect()] == [None, None]
