"""Distances, projections and grid arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmesh import constants as K


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else (value if isinstance(value, Column) else F.lit(value))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * K.HAVERSINE_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def mercator_x(lon) -> Column:
    return F.lit(K.MERCATOR_RADIUS_M) * F.radians(_col(lon))


def mercator_y(lat) -> Column:
    return F.lit(K.MERCATOR_RADIUS_M) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(_col(lat)) / 2))


def mercator_lon(x) -> Column:
    return F.degrees(_col(x) / K.MERCATOR_RADIUS_M)


def mercator_lat(y) -> Column:
    return F.degrees(F.atan(F.exp(_col(y) / K.MERCATOR_RADIUS_M)) * 2 - F.lit(math.pi / 2))


def cell_of(metres) -> Column:
    """Grid index of a Mercator coordinate."""
    return F.floor(_col(metres) / K.CELL_M).cast("int")


def cell_x(lon) -> Column:
    return cell_of(mercator_x(lon))


def cell_y(lat) -> Column:
    return cell_of(mercator_y(lat))


def cell_centre_lon(x) -> Column:
    return mercator_lon(_col(x) * K.CELL_M + K.CELL_M / 2)


def cell_centre_lat(y) -> Column:
    return mercator_lat(_col(y) * K.CELL_M + K.CELL_M / 2)


def cell_square(x, y) -> Column:
    """The four corners of a cell, counter-clockwise from the south-west."""
    x, y = _col(x), _col(y)

    def corner(dx: int, dy: int) -> Column:
        return F.struct(
            mercator_lat((y + dy) * K.CELL_M).alias("lat"), mercator_lon((x + dx) * K.CELL_M).alias("lon")
        )

    return F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))


def cell_key(x, y) -> Column:
    return F.concat_ws(":", _col(x).cast("string"), _col(y).cast("string"))


def cell_from_key(key) -> Column:
    parts = F.split(_col(key), ":")
    return F.struct(parts[0].cast("int").alias("cell_x"), parts[1].cast("int").alias("cell_y"))


def latitude_band(lat) -> Column:
    return F.floor(_col(lat) / K.LATITUDE_BAND).cast("int")


def bands_between(low, high, pad_m: float) -> Column:
    """The bands of latitude that a range touches, ``pad_m`` wider on both sides."""
    pad = pad_m / K.METERS_PER_DEGREE
    return F.sequence(latitude_band(_col(low) - pad), latitude_band(_col(high) + pad))


def band_latitude(band) -> Column:
    """The latitude whose scale holds in a band."""
    return (_col(band) + 0.5) * K.LATITUDE_BAND


def planar_x(lon, ref_lat) -> Column:
    return _col(lon) * K.METERS_PER_DEGREE * F.cos(F.radians(_col(ref_lat)))


def planar_y(lat) -> Column:
    return _col(lat) * K.METERS_PER_DEGREE


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def line_progress(px, py, ax, ay, bx, by) -> Column:
    """Where, from 0 at a to 1 at b, the foot of the perpendicular from p falls."""
    px, py, ax, ay, bx, by = map(_col, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    return F.when(square == 0, F.lit(0.0)).otherwise(clamp01(((px - ax) * dx + (py - ay) * dy) / square))


def line_distance(px, py, ax, ay, bx, by) -> Column:
    px, py, ax, ay, bx, by = map(_col, (px, py, ax, ay, bx, by))
    t = line_progress(px, py, ax, ay, bx, by)
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def near_bucket(value, size: float, pad: float = 0.0) -> Column:
    return F.floor((_col(value) + pad) / size).cast("long")


def buckets_between(low, high, size: float, pad: float) -> Column:
    """All bucket numbers touched by [low - pad, high + pad]."""
    return F.sequence(near_bucket(low, size, -pad), near_bucket(high, size, pad))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    y = F.sin(lon2 - lon1) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def one_decimal_percent(ratio) -> Column:
    return F.floor(_col(ratio) * 1000 + 0.5) / 10


def round_half_up(value) -> Column:
    """Nearest whole number, halves upwards also below zero."""
    return F.floor(_col(value) + 0.5)


def crosses_ray(lat, lon, a_lat, a_lon, b_lat, b_lon) -> Column:
    """Does the edge a-b cross the ray that leaves (lat, lon) along its latitude?"""
    lat, lon, a_lat, a_lon, b_lat, b_lon = map(_col, (lat, lon, a_lat, a_lon, b_lat, b_lon))
    at = (b_lon - a_lon) * (lat - a_lat) / (b_lat - a_lat) + a_lon
    return ((a_lat > lat) != (b_lat > lat)) & (lon < at)
