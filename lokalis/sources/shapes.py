"""Geometry bytes to parts and centroids: well-known binary, GeoPackage blobs and shapefile records.

A geometry becomes its kind (0 none, 1 points, 2 lines, 3 polygons) and parts, each an array of coordinates with
a sign: rings of polygons that are holes count against the others.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np

Parts = list[tuple[float, np.ndarray]]


def from_wkb(blob: bytes, at: int = 0) -> tuple[int, Parts, int]:
    """Kind, parts and where the geometry ends. Heights and measures are passed over."""
    order = "<" if blob[at] == 1 else ">"
    code = struct.unpack_from(order + "I", blob, at + 1)[0]
    at += 5
    if code & 0x20000000:  # an embedded reference system
        at += 4
    extra = bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0xFFFFFFF
    extra = extra or {0: 0, 1: 1, 2: 1, 3: 2}.get(code // 1000, 0)
    kind = code % 1000
    width = 2 + extra

    def coordinates(n: int, at: int) -> tuple[np.ndarray, int]:
        a = np.frombuffer(blob, order + "f8", n * width, at).reshape(n, width)[:, :2].astype(float)
        return a, at + 8 * n * width

    if kind == 1:
        a, at = coordinates(1, at)
        return (0, [], at) if np.isnan(a).any() else (1, [(1.0, a)], at)
    n = struct.unpack_from(order + "I", blob, at)[0]
    at += 4
    parts: Parts = []
    if kind == 2:
        a, at = coordinates(n, at)
        return 2, [(1.0, a)], at
    if kind == 3:
        for k in range(n):
            m = struct.unpack_from(order + "I", blob, at)[0]
            a, at = coordinates(m, at + 4)
            parts.append((1.0 if k == 0 else -1.0, a))
        return 3, parts, at
    top = 0
    for _ in range(n):  # several geometries: the widest kind among them counts
        own, more, at = from_wkb(blob, at)
        if own > top:
            top, parts = own, []
        parts += more if own == top else []
    return top, parts, at


def from_package(blob: bytes | None) -> tuple[int, Parts]:
    """A GeoPackage geometry: a header with a box of known size, then well-known binary."""
    if not blob or blob[:2] != b"GP" or blob[3] & 16:
        return 0, []
    return from_wkb(blob, 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7])[:2]


def from_shape(record: bytes) -> tuple[int, Parts]:
    """A shapefile record's content. Rings turn one way, their holes the other, so that signed areas add up."""
    kind = struct.unpack_from("<i", record)[0] % 10
    if kind == 0:
        return 0, []
    if kind == 1:
        return 1, [(1.0, np.array([struct.unpack_from("<dd", record, 4)]))]
    if kind == 8:
        n = struct.unpack_from("<i", record, 36)[0]
        return 1, [(1.0, np.frombuffer(record, "<f8", 2 * n, 40).reshape(n, 2))]
    n_parts, n = struct.unpack_from("<ii", record, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", record, 44), n]
    a = np.frombuffer(record, "<f8", 2 * n, 44 + 4 * n_parts).reshape(n, 2)
    return (2 if kind == 3 else 3), [(0.0, a[i:j]) for i, j in zip(starts, starts[1:])]


def centroid(kind: int, parts: Parts) -> tuple[float | None, float | None]:
    """Mean of points, length-weighted middle of lines, area-weighted centroid of polygons; a shape without length or area gives the mean of its points."""
    if not kind or not parts:
        return None, None
    every = np.concatenate([a for _, a in parts])
    if not len(every):
        return None, None
    if kind == 2:
        mids = [((a[1:] + a[:-1]) / 2, np.hypot(*(a[1:] - a[:-1]).T)) for _, a in parts]
        total = sum(n.sum() for _, n in mids)
        if total > 0:
            x, y = sum((m * n[:, None]).sum(0) for m, n in mids) / total
            return float(x), float(y)
    if kind == 3:
        area, moment = 0.0, np.zeros(2)
        for sign, a in parts:
            cross = a[:-1, 0] * a[1:, 1] - a[1:, 0] * a[:-1, 1]
            turn = sign * (1 if cross.sum() >= 0 else -1) if sign else 1.0
            area += turn * cross.sum()
            moment += turn * ((a[:-1] + a[1:]) * cross[:, None]).sum(0)
        if area:
            x, y = moment / (3 * area)
            return float(x), float(y)
    x, y = every.mean(0)
    return float(x), float(y)


Bodies = list[list[np.ndarray]]
PAIR = re.compile(r"(-?[\d.]+(?:[eE][-+]?\d+)?)\s+(-?[\d.]+(?:[eE][-+]?\d+)?)(?:\s+-?[\d.]+(?:[eE][-+]?\d+)?)*")


def bodies_of(wkt: str | None) -> tuple[int, Bodies]:
    """Kind and bodies of a well-known text: a body is a point, a line, or a polygon's rings, the outer one first. Empty or other texts have kind 0."""
    m = re.match(r"\s*(MULTI)?(POINT|LINESTRING|POLYGON)\s*(?:ZM|Z|M)?\s*(\(.*\))\s*$", wkt or "", re.I | re.S)
    if not m:
        return 0, []
    nested = json.loads(PAIR.sub(r"[\1,\2]", m[3]).replace("(", "[").replace(")", "]"))
    kind = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3}[m[2].upper()]
    ring = lambda a: np.array(a, float).reshape(-1, 2)
    if kind == 1:
        return 1, [[ring(p)] for p in nested]
    return kind, [[ring(x) for x in (g if kind == 3 else [g])] for g in (nested if m[1] else [nested])]


def to_package(kind: int, bodies: Bodies, reference: int = 4326) -> bytes | None:
    """A GeoPackage geometry: a header without a box, then well-known binary; several bodies are one multi-geometry."""
    if not kind:
        return None
    points = lambda a: struct.pack("<I", len(a)) + np.ascontiguousarray(a, "<f8").tobytes()

    def one(rings: list[np.ndarray]) -> bytes:
        head = struct.pack("<BI", 1, kind)
        if kind == 1:
            return head + np.ascontiguousarray(rings[0], "<f8").tobytes()
        return head + (points(rings[0]) if kind == 2 else struct.pack("<I", len(rings)) + b"".join(map(points, rings)))

    body = one(bodies[0]) if len(bodies) == 1 else struct.pack("<BII", 1, kind + 3, len(bodies)) + b"".join(map(one, bodies))
    return b"GP\0\1" + struct.pack("<i", reference) + body


def turned(a: np.ndarray, clockwise: bool) -> np.ndarray:
    area = (a[:-1, 0] * a[1:, 1] - a[1:, 0] * a[:-1, 1]).sum()
    return a if (area < 0) == clockwise or not area else a[::-1]


def to_shape(kind: int, bodies: Bodies, of: int) -> bytes:
    """A shapefile record's content in a file of kind ``of``; another kind is written as no geometry. Outer rings turn clockwise, holes the other way."""
    if kind != of or not bodies:
        return struct.pack("<i", 0)
    if kind == 1:
        a = np.concatenate([b[0] for b in bodies])
        return struct.pack("<i4di", 8, *a.min(0), *a.max(0), len(a)) + np.ascontiguousarray(a, "<f8").tobytes()
    rings = [turned(a, k == 0) if kind == 3 else a for b in bodies for k, a in enumerate(b)]
    a = np.concatenate(rings)
    starts = np.cumsum([0, *(len(r) for r in rings[:-1])])
    return struct.pack("<i4dii", 3 if kind == 2 else 5, *a.min(0), *a.max(0), len(rings), len(a)) + starts.astype("<i4").tobytes() + np.ascontiguousarray(a, "<f8").tobytes()
