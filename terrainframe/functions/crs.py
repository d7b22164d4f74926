"""Coordinate systems as column expressions: EPSG:4326, 3857, 5070 (Albers on GRS80; NAD83 taken as WGS84), all UTM zones (326xx, 327xx, 269xx) and the
polar stereographic systems 3031, 3413, 3995, 32661 and 32761. Every expression is code-generated arithmetic; series are summed to the fourth order, below a tenth of a millimetre within a zone."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257222101
E2 = FLAT * (2 - FLAT)
E1 = math.sqrt(E2)


def _q(sin: float) -> float:
    return (1 - E2) * (sin / (1 - E2 * sin * sin) - math.log((1 - E1 * sin) / (1 + E1 * sin)) / (2 * E1))


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)


_P1, _P2, _P0, LON0 = (math.radians(x) for x in (29.5, 45.5, 23.0, -96.0))
N = (_m(_P1) ** 2 - _m(_P2) ** 2) / (_q(math.sin(_P2)) - _q(math.sin(_P1)))
C = _m(_P1) ** 2 + N * _q(math.sin(_P1))
RHO0 = A * math.sqrt(C - N * _q(math.sin(_P0))) / N


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    s = F.sin(F.radians(lat))
    q = (s / (1 - E2 * s * s) - F.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1)) * (1 - E2)
    rho, theta = F.sqrt(C - q * N) * (A / N), (F.radians(lon) - LON0) * N
    return rho * F.sin(theta), F.lit(RHO0) - rho * F.cos(theta)


def albers_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude; the latitude by six fixed-point steps from the authalic start."""
    dy = F.lit(RHO0) - y
    rho, theta = F.sqrt(x * x + dy * dy), F.atan2(x, dy)
    q = (F.lit(C) - rho * rho * (N * N / (A * A))) / N

    def nearer(qp: Column) -> Column:
        """One step, with q and phi bound as lambda variables, so that the expression grows by a step and not by a factor."""
        s = F.sin(qp.phi)
        w = 1 - E2 * s * s
        step = w * w / (2 * F.cos(qp.phi)) * (qp.q / (1 - E2) - s / w + F.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))
        return F.struct(qp.q.alias("q"), (qp.phi + step).alias("phi"))

    found = F.struct(q.alias("q"), F.asin(q / 2).alias("phi"))
    for _ in range(6):
        found = F.transform(F.array(found), nearer)[0]
    phi = found["phi"]
    return F.degrees(theta / N + LON0), F.degrees(phi)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * A, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * A


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)


#: Ellipsoid of the zones below (WGS84, fixed value); GRS80's differs by less than a tenth of a millimetre.
FLAT84 = 1 / 298.257223563
_E84 = math.sqrt(FLAT84 * (2 - FLAT84))
_N3 = FLAT84 / (2 - FLAT84)
#: Radius of the rectifying sphere, and Krueger's series in the third flattening: forward and inverse.
_RADIUS = A / (1 + _N3) * (1 + _N3**2 / 4 + _N3**4 / 64)
_FORTH = (
    _N3 / 2 - 2 * _N3**2 / 3 + 5 * _N3**3 / 16 + 41 * _N3**4 / 180, 13 * _N3**2 / 48 - 3 * _N3**3 / 5 + 557 * _N3**4 / 1440,
    61 * _N3**3 / 240 - 103 * _N3**4 / 140, 49561 * _N3**4 / 161280,
)
_BACK = (
    _N3 / 2 - 2 * _N3**2 / 3 + 37 * _N3**3 / 96 - _N3**4 / 360, _N3**2 / 48 + _N3**3 / 15 - 437 * _N3**4 / 1440,
    17 * _N3**3 / 480 - 37 * _N3**4 / 840, 4397 * _N3**4 / 161280,
)
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0


def utm_zone(lon: Column, lat: Column) -> Column:
    """The zone's number by place, 1 to 60, with the wider zones of south-west Norway and Svalbard."""
    plain = F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") % 60 + 1)
    norway = lat.between(56, 63.999999999999) & lon.between(3, 11.999999999999)
    svalbard = lat.between(72, 84) & lon.between(0, 41.999999999999)
    return F.when(norway, 32).when(svalbard, F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)).otherwise(plain).cast("int")


def _isometric(phi: Column) -> Column:
    """Tangent of the conformal latitude."""
    s = F.sin(phi)
    return F.sinh(F.atanh(s) - F.atanh(s * _E84) * _E84)


def _geodetic(tau: Column) -> Column:
    """The latitude whose conformal latitude has that tangent, by four Newton steps bound as lambda variables."""

    def nearer(p: Column) -> Column:
        sigma = F.sinh(F.atanh(p.t * _E84 / F.sqrt(1 + p.t * p.t)) * _E84)
        own = p.t * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + p.t * p.t)
        step = (p.tau - own) / F.sqrt(1 + own * own) * (1 + (1 - _E84**2) * p.t * p.t) / ((1 - _E84**2) * F.sqrt(1 + p.t * p.t))
        return F.struct(p.tau.alias("tau"), (p.t + step).alias("t"))

    found = F.struct(tau.alias("tau"), tau.alias("t"))
    for _ in range(4):
        found = F.transform(F.array(found), nearer)[0]
    return F.atan(found["t"])


def transverse_mercator(lon: Column, lat: Column, central: Column | float) -> tuple[Column, Column]:
    """Easting and northing at scale 1 around a central meridian (degrees)."""
    turn = F.radians(lon - central)
    turn = F.atan2(F.sin(turn), F.cos(turn))  # across the date line
    tau = _isometric(F.radians(lat))
    xi, eta = F.atan2(tau, F.cos(turn)), F.asinh(F.sin(turn) / F.sqrt(tau * tau + F.cos(turn) * F.cos(turn)))
    x, y = eta, xi
    for j, k in enumerate(_FORTH, 1):
        x, y = x + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * k, y + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * k
    return x * _RADIUS, y * _RADIUS


def transverse_mercator_inverse(x: Column, y: Column, central: Column | float) -> tuple[Column, Column]:
    eta, xi = x / _RADIUS, y / _RADIUS
    a, b = eta, xi
    for j, k in enumerate(_BACK, 1):
        a, b = a - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * k, b - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * k
    tau = F.sin(b) / F.sqrt(F.sinh(a) * F.sinh(a) + F.cos(b) * F.cos(b))
    lon = F.degrees(F.atan2(F.sinh(a), F.cos(b))) + central
    return F.pmod(lon + 180, F.lit(360.0)) - 180, F.degrees(_geodetic(tau))


def utm(lon: Column, lat: Column, zone: Column | None = None) -> tuple[Column, Column, Column]:
    """Easting, northing and EPSG code, in the zone of the place unless one is given; southern places count from ten million."""
    zone = utm_zone(lon, lat) if zone is None else zone
    x, y = transverse_mercator(lon, lat, zone * 6.0 - 183.0)
    south = lat < 0
    return x * UTM_SCALE + UTM_EAST, y * UTM_SCALE + F.when(south, UTM_SOUTH).otherwise(0.0), F.when(south, 32700).otherwise(32600) + zone


def utm_inverse(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude from a zone's coordinates; ``epsg`` is 326zz, 327zz or 269zz."""
    south, zone = (epsg >= 32700) & (epsg < 32800), epsg % 100
    return transverse_mercator_inverse((x - UTM_EAST) / UTM_SCALE, (y - F.when(south, UTM_SOUTH).otherwise(0.0)) / UTM_SCALE, zone * 6.0 - 183.0)


#: Polar stereographic systems (fixed values): north or south, central meridian, latitude of true scale (or none: scale at the pole), false easting and northing.
POLAR = {3031: (-1, 0.0, -71.0, 0.0), 3413: (1, -45.0, 70.0, 0.0), 3995: (1, 0.0, 71.0, 0.0), 32661: (1, 0.0, None, 2e6), 32761: (-1, 0.0, None, 2e6)}
_POLE_SCALE = 0.994
_AT_POLE = math.sqrt((1 + _E84) ** (1 + _E84) * (1 - _E84) ** (1 - _E84))


def _polar_radius(epsg: int) -> float:
    """Distance from the pole of a place whose colatitude term is 1."""
    _, _, true, _ = POLAR[epsg]
    if true is None:
        return 2 * A * _POLE_SCALE / _AT_POLE
    phi = math.radians(abs(true))
    s = math.sin(phi)
    m = math.cos(phi) / math.sqrt(1 - (_E84 * s) ** 2)
    return A * m / (math.tan(math.pi / 4 - phi / 2) / ((1 - _E84 * s) / (1 + _E84 * s)) ** (_E84 / 2))


def polar(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    pole, central, _, shift = POLAR[epsg]
    tau = _isometric(F.radians(lat * pole))
    root = F.sqrt(1 + tau * tau)
    rho = _polar_radius(epsg) * F.when(tau > 0, 1 / (root + tau)).otherwise(root - tau)
    turn = F.radians(lon - central)
    return rho * F.sin(turn) + shift, rho * F.cos(turn) * -pole + shift


def polar_inverse(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    pole, central, _, shift = POLAR[epsg]
    dx, dy = x - shift, (y - shift) * -pole
    t = F.sqrt(dx * dx + dy * dy) / _polar_radius(epsg)
    lat = F.when(t == 0, 90.0).otherwise(F.degrees(_geodetic((1 / F.greatest(t, F.lit(1e-300)) - t) / 2)))
    return F.pmod(F.degrees(F.atan2(dx, dy)) + central + 180, F.lit(360.0)) - 180, lat * pole


def pixel_of(x: Column, y: Column, origin_x: float, origin_y: float, size: float, compat: bool = False) -> tuple[Column, Column]:
    """Row and column that hold a point of a north-up raster; ``compat`` truncates toward zero as older tools do."""
    row, col = (origin_y - y) / size, (x - origin_x) / size
    whole = (lambda v: v.cast("long")) if compat else (lambda v: F.floor(v).cast("long"))
    return whole(row), whole(col)


def place_of(row: Column, col: Column, origin_x: float, origin_y: float, size: float, anchor: str = "centre") -> tuple[Column, Column]:
    """World coordinates of a pixel's centre or upper left corner."""
    shift = 0.5 if anchor == "centre" else 0.0
    return origin_x + (col + shift) * size, origin_y - (row + shift) * size
