"""A small GeoTIFF codec: strips or tiles, classic or big files, uncompressed, deflate, LZW or PackBits, integers and floats."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SIZES = {1: 1, 13: 4, 17: 8, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """(byte order, tags of the first image); only the head and the tags' own bytes are looked at."""
    e = "<" if data[:2] == b"II" else ">"
    big = struct.unpack_from(e + "H", data, 2)[0] == 43
    word, count, entry, inline = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    at = struct.unpack_from(e + word, data, 8 if big else 4)[0]
    out = {}
    for i in range(struct.unpack_from(e + count, data, at)[0]):
        here = at + struct.calcsize(count) + entry * i
        tag, kind = struct.unpack_from(e + "HH", data, here)
        n = struct.unpack_from(e + word, data, here + 4)[0]
        value = here + 4 + inline
        place = value if _SIZES.get(kind, 1) * n <= inline else struct.unpack_from(e + word, data, value)[0]
        if kind == 2:
            out[tag] = (data[place : place + n].rstrip(b"\0").decode("latin-1"),)
        elif kind in _CODES:
            out[tag] = struct.unpack_from(f"{e}{n}{_CODES[kind]}", data, place)
    return e, out


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the most significant bit first; 256 clears the table and 257 ends."""
    out, table, width, held, bits, before = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        now = table[code] if code < len(table) else before + before[:1]
        out += now
        if before:
            table.append(before + now[:1])
        before = now
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


_UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def decode(data: bytes) -> tuple[np.ndarray, dict]:
    """(bands, rows, columns) and {nodata, scale, origin}."""
    e, t = _tags(data)
    w, h, n = t[256][0], t[257][0], t.get(277, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}[t.get(339, (1,))[0]]
    dtype = np.dtype(f"{e}{kind}{t[258][0] // 8}")
    pack, predictor, planar = t.get(259, (1,))[0], t.get(317, (1,))[0], t.get(284, (1,))[0]
    if pack not in _UNPACK or predictor not in (1, 2):
        raise ValueError(f"compression {pack} with predictor {predictor} isn't supported")
    tiled = 322 in t
    bw, bh = (t[322][0], t[323][0]) if tiled else (w, min(t.get(278, (h,))[0], h))
    offsets, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
    across, down = -(-w // bw), -(-h // bh)
    each = n if planar == 1 else 1
    out = np.zeros((n, down * bh, across * bw), dtype.newbyteorder("="))
    for k, (at, size) in enumerate(zip(offsets, sizes)):
        raw = data[at : at + size]
        a = np.frombuffer(_UNPACK[pack](raw), dtype).astype(dtype.newbyteorder("="))
        rows = len(a) // (bw * each)
        a = a.reshape(rows, bw, each)
        a = np.cumsum(a, 1, dtype=a.dtype) if predictor == 2 else a
        plane, cell = divmod(k, across * down)
        y, x = divmod(cell, across)
        band = slice(0, n) if planar == 1 else slice(plane, plane + 1)
        out[band, y * bh : y * bh + rows, x * bw : (x + 1) * bw] = a.transpose(2, 0, 1)
    none = t.get(42113, (None,))[0]
    return out[:, :h, :w], {"nodata": None if none is None else float(none), "scale": t.get(33550), "origin": t.get(33922)}


def encode(image: np.ndarray, x0: float = 0.0, y1: float = 0.0, size: float = 1.0, epsg: int = 4326, nodata: float | None = None) -> bytes:
    """A GeoTIFF of (bands, rows, columns), one deflate strip a band."""
    n, h, w = image.shape
    image = np.ascontiguousarray(image)
    strips = [zlib.compress(b.astype(b.dtype.newbyteorder("<")).tobytes()) for b in image]
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    geographic = 4000 <= epsg < 5000
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg)
    tags = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (image.dtype.itemsize * 8,) * n), (259, 3, (8,)), (262, 3, (1,)), (273, 4, None), (277, 3, (n,)), (278, 4, (h,)), (279, 4, tuple(map(len, strips))), (284, 3, (2,)), (339, 3, (kind,) * n), (33550, 12, (size, size, 0.0)), (33922, 12, (0.0, 0.0, 0.0, x0, y1, 0.0)), (34735, 3, keys)]
    if nodata is not None:
        tags.append((42113, 2, f"{nodata:g}".encode() + b"\0"))
    at = 8 + 2 + 12 * len(tags) + 4
    body, entries, strip_entry = b"", [], None
    for tag, code, v in tags:
        if v is None:
            v = (0,) * n
        raw = v if code == 2 else struct.pack(f"<{len(v)}{_CODES[code]}", *v)
        if tag == 273:
            strip_entry = (len(entries), len(body))
        if len(raw) <= 4:
            entries.append(struct.pack("<HHI", tag, code, len(v)) + raw.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", tag, code, len(v), at + len(body)))
            body += raw + b"\0" * (len(raw) % 2)
    first = at + len(body)
    places = [first + sum(map(len, strips[:i])) for i in range(n)]
    raw = struct.pack(f"<{n}I", *places)
    if n == 1:
        entries[strip_entry[0]] = struct.pack("<HHI", 273, 4, 1) + raw
    else:
        body = body[: strip_entry[1]] + raw + body[strip_entry[1] + len(raw) :]
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(entries) + struct.pack("<I", 0) + body + b"".join(strips)


def cells(name: str, image: np.ndarray, info: dict) -> Iterator[pa.RecordBatch]:
    """Cell rows of an image, a batch a band; NoData and NaN leave none."""
    for b, a in enumerate(image, 1):
        v = a.astype(np.float64)
        ok = ~np.isnan(v) & (v != info["nodata"] if info["nodata"] is not None else True)
        cy, cx = np.nonzero(ok)
        n = len(cx)
        yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([f"B{b}"] * n, pa.string()), pa.array(cx.astype(np.int32)), pa.array(cy.astype(np.int32)), pa.array(v[ok])], ["cov_id", "band", "cx", "cy", "v"])


def grid_of(info: dict, epsg: int = 4326) -> tuple[str, float, float, float]:
    """(crs, left, top, cell size) of a decoded image."""
    scale, o = info["scale"] or (1.0, 1.0, 0.0), info["origin"] or (0.0,) * 6
    return f"EPSG:{epsg}", o[3] - o[0] * scale[0], o[4] + o[1] * scale[1], scale[0]


def tiles(name: str, image: np.ndarray, info: dict, size: int) -> Iterator[pa.RecordBatch]:
    """Tile rows of an image, a batch a row of tiles; NoData is NaN."""
    n, h, w = image.shape
    for ty in range(-(-h // size)):
        rows: dict[str, list] = {"band": [], "tx": []}
        lists = []
        for b in range(n):
            for tx in range(-(-w // size)):
                v = np.full((size, size), np.nan)
                has = np.zeros((size, size), bool)
                part = image[b, ty * size : (ty + 1) * size, tx * size : (tx + 1) * size].astype(np.float64)
                if info["nodata"] is not None:
                    part = np.where(part == info["nodata"], np.nan, part)
                v[: part.shape[0], : part.shape[1]], has[: part.shape[0], : part.shape[1]] = part, True
                rows["band"].append(f"B{b + 1}")
                rows["tx"].append(tx)
                lists.append(pa.array(v.ravel(), mask=~has.ravel()))
        k = len(lists)
        cells_ = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * size * size, pa.int32()), pa.concat_arrays(lists))
        yield pa.RecordBatch.from_arrays([pa.array([name] * k, pa.string()), pa.array(rows["band"], pa.string()), pa.array(rows["tx"], pa.int32()), pa.array([ty] * k, pa.int32()), cells_], ["cov_id", "band", "tx", "ty", "cells"])
