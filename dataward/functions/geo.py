"""Geometry literals and coordinate systems as column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataward.functions.barrier import once

_NUMBER = r"[+-]?(?:\d+(?:[.]\d*)?|[.]\d+)(?:[eE][+-]?\d+)?"
_POSITION = rf"\s*{_NUMBER}\s+{_NUMBER}\s*"
_BODY = rf"(?:POINT\s*\({_POSITION}\)|LINESTRING\s*\({_POSITION}(?:,{_POSITION})+\)|POLYGON\s*\(\({_POSITION}(?:,{_POSITION}){{3,}}\)\))"
WKT = rf"(?i)^\s*<([^<>\s]+)>\s+({_BODY})\s*$"
GML_POINT = (r"(?s)^\s*<gml:Point\s+[^>]*srsName=\"([^\"]+)\"[^>]*>\s*<gml:pos>\s*(" + _NUMBER + r")\s+(" + _NUMBER + r")\s*</gml:pos>\s*</gml:Point>\s*$")
MAX_BYTES = 65536
MAX_COORDINATES = 10000


@dataclass(frozen=True)
class Crs:
    kind: str                       # longlat | mercator | tmerc
    axis: str                       # en (east, north) or ne (north, east)
    lat0: float = 0.0
    lon0: float = 0.0
    k: float = 1.0
    x0: float = 0.0
    y0: float = 0.0


_OGC = "http://www.opengis.net/def/crs/"
# Supported coordinate systems with their axis order and projection parameters.
CRS = {
    _OGC + "OGC/1.3/CRS84": Crs("longlat", "en"),
    _OGC + "EPSG/0/4326": Crs("longlat", "ne"),
    _OGC + "EPSG/0/3857": Crs("mercator", "en"),
    _OGC + "EPSG/0/5179": Crs("tmerc", "ne", 38.0, 127.5, 0.9996, 1_000_000.0, 2_000_000.0),
    _OGC + "EPSG/0/5186": Crs("tmerc", "ne", 38.0, 127.0, 1.0, 200_000.0, 600_000.0),
}
RADIUS = 6378137.0
_F = 1 / 298.257222101            # GRS80
_N = _F / (2 - _F)
_A = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# Series of the transverse Mercator projection in the third flattening, to sixth order.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288 + 7891 * _N**6 / 37800,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630 - 1983433 * _N**6 / 1935360,
    61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880 + 167603 * _N**6 / 181440,
    49561 * _N**4 / 161280 - 179 * _N**5 / 168 + 6601661 * _N**6 / 7257600,
    34729 * _N**5 / 80640 - 3418889 * _N**6 / 1995840, 212378941 * _N**6 / 319334400)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512 + 96199 * _N**6 / 604800,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105 - 1118711 * _N**6 / 3870720,
    17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480 + 5569 * _N**6 / 90720,
    4397 * _N**4 / 161280 - 11 * _N**5 / 504 - 830251 * _N**6 / 7257600, 4583 * _N**5 / 161280 - 108847 * _N**6 / 3991680, 20648693 * _N**6 / 638668800)
_E = math.sqrt(_F * (2 - _F))


def parse_wkt(col: Column) -> Column:
    """Struct of crs, type and coordinates (array of [first, second]), NULL where not acceptable.

    Accepted: an explicit known CRS and a point, a line of two or more positions, or one closed ring
    of four or more, at most 10,000 positions and 65,536 bytes.
    """
    crs = F.regexp_extract(col, WKT, 1)
    kind = F.lower(F.regexp_extract(F.regexp_extract(col, WKT, 2), r"^([A-Za-z]+)", 1))
    body = F.regexp_replace(F.regexp_extract(col, WKT, 2), r"^[A-Za-z]+\s*\(+|\)+$", "")
    coords = F.transform(F.split(body, ","), lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda x: x.try_cast("double")))
    shape = F.struct(crs.alias("crs"), kind.alias("type"), coords.alias("coords"))
    finite = F.forall(shape["coords"], lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    closed = (kind != "polygon") | (F.element_at(coords, 1) == F.element_at(coords, -1))
    ok = (col.rlike(WKT) & (F.octet_length(col) <= MAX_BYTES) & crs.isin(*CRS) & (F.size(coords) <= MAX_COORDINATES))
    # Coordinates are only looked at where the text has the right form.
    return F.when(ok, F.when(finite & closed, shape))


def parse_gml_point(col: Column) -> Column:
    crs = F.regexp_extract(col, GML_POINT, 1)
    at = F.array(F.regexp_extract(col, GML_POINT, 2).try_cast("double"), F.regexp_extract(col, GML_POINT, 3).try_cast("double"))
    return F.when(col.rlike(GML_POINT) & crs.isin(*CRS), F.struct(crs.alias("crs"), F.lit("point").alias("type"), F.array(at).alias("coords")))


def to_wkt(geom: Column) -> Column:
    body = F.array_join(F.transform(geom["coords"], lambda c: F.concat_ws(" ", c[0].cast("string"), c[1].cast("string"))), ",")
    inner = F.when(geom["type"] == "polygon", F.concat(F.lit("(("), body, F.lit("))"))).otherwise(F.concat(F.lit("("), body, F.lit(")")))
    return F.concat(F.lit("<"), geom["crs"], F.lit("> "), F.upper(geom["type"]), inner)


def _to_lonlat(df: DataFrame, c: Crs, e: Column, n: Column) -> DataFrame:
    """Add _lon and _lat. Values that several terms share are columns of their own, computed once."""
    if c.kind == "longlat":
        return once(df, {"_lon": e, "_lat": n})
    if c.kind == "mercator":
        return once(df, {"_lon": F.degrees(e / RADIUS), "_lat": F.degrees(2 * F.atan(F.exp(n / RADIUS)) - math.pi / 2)})
    xi, eta, tau = F.col("_xi"), F.col("_eta"), F.col("_tau")
    df = once(df, {"_xi": (n - c.y0) / (c.k * _A) + _xi0(c.lat0), "_eta": (e - c.x0) / (c.k * _A)})
    xip, etap = xi, eta
    for j, b in enumerate(_BETA, 1):
        xip = xip - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        etap = etap - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    df = once(df, {"_xip": xip, "_etap": etap})
    lon = F.degrees(F.atan2(F.sinh("_etap"), F.cos("_xip"))) + c.lon0
    taup = F.sin("_xip") / F.sqrt(F.pow(F.sinh("_etap"), 2) + F.pow(F.cos("_xip"), 2))
    df = once(df, {"_lon": lon, "_taup": taup}).withColumn("_tau", F.col("_taup"))
    for _ in range(4):
        df = once(df, {"_root": F.sqrt(1 + tau * tau)})
        df = once(df, {"_sigma": F.sinh(_E * F.atanh(_E * tau / F.col("_root")))})
        df = once(df, {"_est": tau * F.sqrt(1 + F.pow("_sigma", 2)) - F.col("_sigma") * F.col("_root")})
        step = (F.col("_taup") - F.col("_est")) / F.sqrt(1 + F.pow("_est", 2)) * (1 + (1 - _E**2) * tau * tau) / ((1 - _E**2) * F.col("_root"))
        df = once(df, {"_tau": tau + step})
    return once(df, {"_lat": F.degrees(F.atan("_tau"))}).drop("_xi", "_eta", "_xip", "_etap", "_taup", "_tau", "_root", "_sigma", "_est")


def _xi0(lat0: float) -> float:
    """Northing of the latitude of origin, in units of the rectifying radius."""
    phi = math.radians(lat0)
    tau = math.tan(phi)
    sigma = math.sinh(_E * math.atanh(_E * tau / math.sqrt(1 + tau * tau)))
    taup = tau * math.sqrt(1 + sigma * sigma) - sigma * math.sqrt(1 + tau * tau)
    xip = math.atan(taup)
    return xip + sum(a * math.sin(2 * j * xip) for j, a in enumerate(_ALPHA, 1))


def _from_lonlat(df: DataFrame, c: Crs, lon: Column, lat: Column) -> DataFrame:
    """Add _e and _n."""
    if c.kind == "longlat":
        return once(df, {"_e": lon, "_n": lat})
    if c.kind == "mercator":
        return once(df, {"_e": F.radians(lon) * RADIUS, "_n": F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * RADIUS})
    df = once(df, {"_tau": F.tan(F.radians(lat)), "_lam": F.radians(lon - c.lon0)})
    tau = F.col("_tau")
    df = once(df, {"_root": F.sqrt(1 + tau * tau)})
    df = once(df, {"_sigma": F.sinh(_E * F.atanh(_E * tau / F.col("_root")))})
    df = once(df, {"_taup": tau * F.sqrt(1 + F.pow("_sigma", 2)) - F.col("_sigma") * F.col("_root")})
    df = once(df, {"_xip": F.atan2(F.col("_taup"), F.cos("_lam")),
                   "_etap": F.asinh(F.sin("_lam") / F.sqrt(F.pow("_taup", 2) + F.pow(F.cos("_lam"), 2)))})
    xi, eta = F.col("_xip"), F.col("_etap")
    for j, a in enumerate(_ALPHA, 1):
        xi = xi + a * F.sin(2 * j * F.col("_xip")) * F.cosh(2 * j * F.col("_etap"))
        eta = eta + a * F.cos(2 * j * F.col("_xip")) * F.sinh(2 * j * F.col("_etap"))
    return once(df, {"_e": c.x0 + c.k * _A * eta, "_n": c.y0 + c.k * _A * (xi - _xi0(c.lat0))}).drop(
        "_tau", "_lam", "_root", "_sigma", "_taup", "_xip", "_etap")


def reproject(df: DataFrame, x: str, y: str, source: str, target: str, out: tuple[str, str]) -> DataFrame:
    """Positions from one coordinate system to another; both in the axis order of their authority.

    Intermediate values are columns, so the long series are evaluated once per position.
    """
    a, b = CRS[source], CRS[target]
    e, n = (F.col(x), F.col(y)) if a.axis == "en" else (F.col(y), F.col(x))
    there = _from_lonlat(_to_lonlat(df, a, e, n), b, F.col("_lon"), F.col("_lat"))
    first, second = ("_e", "_n") if b.axis == "en" else ("_n", "_e")
    return there.withColumnsRenamed({first: out[0], second: out[1]}).drop("_lon", "_lat")


def reproject_geometry(df: DataFrame, geom: str, keys: list[str], source: str, target: str) -> DataFrame:
    """Geometries of one system to another: positions are exploded, mapped and put back in order.

    A geometry has at most 10,000 positions, which bounds each group.
    """
    rows = df.where(F.col(f"{geom}.crs") == source).select(*keys, F.col(f"{geom}.type").alias("_type"), F.posexplode(f"{geom}.coords").alias("_i", "_c"))
    flat = rows.select(*keys, "_type", "_i", F.col("_c")[0].alias("_x"), F.col("_c")[1].alias("_y"))
    moved = reproject(flat, "_x", "_y", source, target, ("_tx", "_ty"))
    back = moved.groupBy(*keys, "_type").agg(F.array_sort(F.collect_list(F.struct("_i", F.array("_tx", "_ty").alias("c")))).alias("_all"))
    return back.select(*keys, F.struct(F.lit(target).alias("crs"), F.col("_type").alias("type"), F.transform("_all", lambda s: s["c"]).alias("coords")).alias(geom))


def round_trip_error(df: DataFrame, x: str, y: str, source: str, through: str, out: str = "round_trip_error") -> DataFrame:
    """Distance between a position and its image after going there and back, in source units."""
    there = reproject(df, x, y, source, through, ("_rx", "_ry"))
    back = reproject(there, "_rx", "_ry", through, source, ("_bx", "_by"))
    return back.withColumn(out, F.hypot(F.col(x) - F.col("_bx"), F.col(y) - F.col("_by"))).drop("_rx", "_ry", "_bx", "_by")
