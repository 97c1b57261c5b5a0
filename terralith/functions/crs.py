"""Coordinate reference systems by closed formulas, vectorised: degrees to plane coordinates and back.

Geographic systems (WGS 84, CGCS2000, NAD83) count as one, which is right to a metre. Planar:
spherical and ellipsoidal Mercator, UTM, and the three- and six-degree Gauss-Kruger zones of
CGCS2000, the transverse ones by Kruger's series (to about a micrometre within a zone).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

_A, _F = 6378137.0, 1 / 298.257223563
_E = math.sqrt(_F * (2 - _F))
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_UP = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_DOWN = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
GEOGRAPHIC = {4326, 4490, 4269, 4214, 4610}
Pair = tuple[np.ndarray, np.ndarray]


def code(crs: str | int) -> int:
    """The EPSG number of "EPSG:4326" or the like."""
    return int(str(crs).rsplit(":", 1)[-1])


def _isometric(lat: np.ndarray) -> np.ndarray:
    s = np.sin(lat)
    return np.arctanh(s) - _E * np.arctanh(_E * s)


def _latitude(psi: np.ndarray) -> np.ndarray:
    lat = 2 * np.arctan(np.exp(psi)) - math.pi / 2
    for _ in range(8):  # converges by a factor of 150 a round
        lat = np.arcsin(np.tanh(psi + _E * np.arctanh(_E * np.sin(lat))))
    return lat


def _transverse(lon0: float, k0: float, fe: float, fn: float) -> tuple[Callable, Callable]:
    def forward(x: np.ndarray, y: np.ndarray) -> Pair:
        lon = np.radians((x - lon0 + 180) % 360 - 180)
        t = np.sinh(_isometric(np.radians(y)))
        xi, eta = np.arctan2(t, np.cos(lon)), np.arctanh(np.sin(lon) / np.sqrt(1 + t * t))
        e, n = eta.copy(), xi.copy()
        for j, a in enumerate(_UP, 1):
            e, n = e + a * np.cos(2 * j * xi) * np.sinh(2 * j * eta), n + a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        return fe + k0 * _RADIUS * e, fn + k0 * _RADIUS * n

    def inverse(x: np.ndarray, y: np.ndarray) -> Pair:
        xi, eta = (y - fn) / (k0 * _RADIUS), (x - fe) / (k0 * _RADIUS)
        a, b = xi.copy(), eta.copy()
        for j, d in enumerate(_DOWN, 1):
            a, b = a - d * np.sin(2 * j * xi) * np.cosh(2 * j * eta), b - d * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        psi = np.arctanh(np.clip(np.sin(a) / np.cosh(b), -1 + 1e-16, 1 - 1e-16))
        return lon0 + np.degrees(np.arctan2(np.sinh(b), np.cos(a))), np.degrees(_latitude(psi))

    return forward, inverse


def _of(epsg: int) -> tuple[Callable, Callable]:
    if epsg in GEOGRAPHIC:
        return (lambda x, y: (x, y)), (lambda x, y: (x, y))
    if epsg in (3857, 900913):
        return (lambda x, y: (np.radians(x) * _A, np.log(np.tan(math.pi / 4 + np.radians(y) / 2)) * _A)), (lambda x, y: (np.degrees(x / _A), np.degrees(2 * np.arctan(np.exp(y / _A)) - math.pi / 2)))
    if epsg == 3395:
        return (lambda x, y: (np.radians(x) * _A, _isometric(np.radians(y)) * _A)), (lambda x, y: (np.degrees(x / _A), np.degrees(_latitude(y / _A))))
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return _transverse(6 * (epsg % 100) - 183, 0.9996, 500000.0, 0.0 if epsg < 32700 else 10_000_000.0)
    if 4491 <= epsg <= 4501:  # six degrees, zone 13 to 23 before the easting
        return _transverse(75 + 6 * (epsg - 4491), 1.0, 500000.0 + 1e6 * (13 + epsg - 4491), 0.0)
    if 4502 <= epsg <= 4512:
        return _transverse(75 + 6 * (epsg - 4502), 1.0, 500000.0, 0.0)
    if 4513 <= epsg <= 4533:  # three degrees, zone 25 to 45 before the easting
        return _transverse(75 + 3 * (epsg - 4513), 1.0, 500000.0 + 1e6 * (25 + epsg - 4513), 0.0)
    if 4534 <= epsg <= 4554:
        return _transverse(75 + 3 * (epsg - 4534), 1.0, 500000.0, 0.0)
    raise ValueError(f"no formulas for EPSG:{epsg}")


def transform(x, y, source: str | int, target: str | int) -> Pair:
    """Coordinates of one system in another; arrays or numbers."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    a, b = code(source), code(target)
    if a == b:
        return x, y
    return _of(b)[0](*_of(a)[1](x, y))
