"""Rasters: SRTM tiles in, GeoTIFF (tiles or strips, Deflate or LZW) in and out, as long tables (tile, row, col, z)."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_SCHEMA = "tile string, row int, col int, lon double, lat double, z double"
HGT_VOID = -32768


def hgt(spark: SparkSession, path: str) -> DataFrame:
    """Signed big-endian tiles named by their south-west corner (N39E032.hgt); voids are null. A tile is decoded by one task."""

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, raw in zip(part["path"], part["content"]):
                m = re.search(r"([NS])(\d{2})([EW])(\d{3})\.hgt$", name, re.I)
                side = {2 * n * n: n for n in (1201, 3601)}.get(len(raw))
                if not m or side is None:
                    raise ValueError(f"{name}: not a tile of 1201 or 3601 postings a side")
                south = int(m[2]) * (1 if m[1].upper() == "N" else -1)
                west = int(m[4]) * (1 if m[3].upper() == "E" else -1)
                z = np.frombuffer(raw, ">i2").reshape(side, side)
                for first in range(0, side, 200):
                    block = z[first : first + 200]
                    r, c = np.indices(block.shape)
                    r = r + first
                    value = np.where(block == HGT_VOID, np.nan, block.astype(float)).ravel()
                    yield pd.DataFrame({"tile": m[0][:-4], "row": r.ravel(), "col": c.ravel(), "lon": west + c.ravel() / (side - 1), "lat": south + 1 - r.ravel() / (side - 1), "z": pd.Series(value).astype(object).where(~np.isnan(value), None)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, _SCHEMA)


@dataclass(frozen=True)
class Layout:
    """What a GeoTIFF's directory says: the grid, its blocks (tiles or strips), and how a sample is written."""

    order: str
    width: int
    height: int
    kind: str
    compression: int
    predictor: int
    block_width: int
    block_height: int
    across: int
    west: float
    north: float
    step_x: float
    step_y: float
    half: float
    nodata: float | None


#: Compressions that are read (none, LZW, Deflate by two numbers), and sizes of field types.
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
_FIELDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 11: ("f", 4), 12: ("d", 8)}


def directory(read: Callable[[int, int], bytes]) -> tuple[Layout, list[int], list[int]]:
    """The layout, and offset and length of each block, by ``read(offset, length)``: only the header and the directory are looked at.

    North-up grids of one band in EPSG:4326, integers or floats; anything else is an error that says what it was.
    """
    head = read(0, 8)
    if head[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    e = {b"II": "<", b"MM": ">"}[head[:2]]
    magic, at = struct.unpack(e + "HI", head[2:])
    if magic != 42:
        raise ValueError("only classic TIFF files are read")
    (n,) = struct.unpack(e + "H", read(at, 2))
    listed, tags = read(at + 2, 12 * n), {}
    for i in range(n):
        tag, kind, count = struct.unpack(e + "HHI", listed[12 * i : 12 * i + 8])
        if kind not in _FIELDS:
            continue
        code, size = _FIELDS[kind]
        raw = listed[12 * i + 8 : 12 * i + 12][: size * count] if size * count <= 4 else read(struct.unpack(e + "I", listed[12 * i + 8 : 12 * i + 12])[0], size * count)
        tags[tag] = raw if kind == 2 else struct.unpack(f"{e}{count}{code}", raw)
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    if 34264 in tags:
        raise ValueError("rotated grids are not read")
    if one(277, 1) != 1:
        raise ValueError("more than one sample a pixel")
    bits, form = one(258, 8), one(339, 1)
    if (form, bits) not in ((1, 8), (1, 16), (1, 32), (2, 8), (2, 16), (2, 32), (3, 32), (3, 64)):
        raise ValueError(f"samples of {bits} bits and format {form} are not read")
    compression, predictor = one(259, NONE), one(317, 1)
    if compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"compression {compression} is not read")
    if predictor not in (1, 2) or (predictor == 2 and form == 3):
        raise ValueError(f"predictor {predictor} is not read for samples of format {form}")
    if 33550 not in tags or 33922 not in tags or min(tags[33550][:2]) <= 0:
        raise ValueError("pixel scale or tie point is missing")
    keys = tags.get(34735, ())
    geo_key = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    if geo_key.get(2048, 4326) != 4326 or 3072 in geo_key:
        raise ValueError("only EPSG:4326 is read")
    w, h, (dx, dy), tie = one(256), one(257), tags[33550][:2], tags[33922]
    tiled = 324 in tags
    bw, bh = (one(322), one(323)) if tiled else (w, min(h, one(278, h)))
    offsets, counts = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
    across = -(-w // bw)
    if not offsets or not counts or not len(offsets) == len(counts) == across * -(-h // bh):
        raise ValueError("block offsets and lengths do not fit the grid")
    nodata = None
    if 42113 in tags:
        try:
            nodata = float(tags[42113].rstrip(b"\0 "))
        except ValueError:
            nodata = None
    # pixels that are points lie on their corner, areas have their value in the middle
    half = 0.0 if geo_key.get(1025) == 2 else 0.5
    kind = e + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8)
    return Layout(e, w, h, kind, compression, predictor, bw, bh, across, tie[3] - tie[0] * dx, tie[4] + tie[1] * dy, dx, dy, half, nodata), list(offsets), list(counts)


def unpack_lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, that get longer one code early."""
    out, table, size, held, bits, before = bytearray(), [], 9, 0, 0, b""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        while bits >= size:
            bits -= size
            code = held >> bits
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, size, before = start.copy(), 9, b""
                continue
            if not table:
                raise ValueError("LZW data does not begin with a clear code")
            if code < len(table):
                entry = table[code]
            elif before:
                entry = before + before[:1]
            else:
                raise ValueError("LZW data is broken")
            out += entry
            if before:
                table.append(before + entry[:1])
            before = entry
            if len(table) + 1 >= 1 << size and size < 12:
                size += 1
    return bytes(out)


def decode_block(raw: bytes, index: int, layout: Layout) -> tuple[int, int, np.ndarray]:
    """First row, first column and values (NaN: none) of a block; what a tile holds beyond the grid is cut off."""
    row, col = index // layout.across * layout.block_height, index % layout.across * layout.block_width
    rows, cols = min(layout.block_height, layout.height - row), min(layout.block_width, layout.width - col)
    if layout.compression == LZW:
        raw = unpack_lzw(raw)
    elif layout.compression != NONE:
        raw = zlib.decompress(raw)
    z = np.frombuffer(raw, layout.kind)
    have = len(z) // layout.block_width
    z = z[: have * layout.block_width].reshape(have, layout.block_width)[:rows]
    if len(z) < rows:
        raise ValueError("a block is shorter than its rows")
    if layout.predictor == 2:
        z = np.cumsum(z, axis=1, dtype=z.dtype.newbyteorder("="))
    z = z[:, :cols].astype(float)
    return row, col, np.where(~np.isfinite(z) | (z == layout.nodata if layout.nodata is not None else False), np.nan, z)


def read_geotiff(raw: bytes) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """Values (NaN for no data) and (west, north, step_x, step_y) of a whole file in memory."""
    layout, offsets, counts = directory(lambda at, n: raw[at : at + n])
    out = np.full((layout.height, layout.width), np.nan)
    for i, (at, n) in enumerate(zip(offsets, counts)):
        row, col, z = decode_block(raw[at : at + n], i, layout)
        out[row : row + z.shape[0], col : col + z.shape[1]] = z
    return out, (layout.west, layout.north, layout.step_x, layout.step_y)


def _open(path: str):
    if path.startswith("file:"):  # as Spark writes it: not an escaped URI
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def _reader(source) -> Callable[[int, int], bytes]:
    def read(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    return read


def geotiff_blocks(files: DataFrame) -> DataFrame:
    """(path) -> (path, block, at, size, layout): a row a tile or strip of each file. Only directories are read."""

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name in part["path"]:
                with _open(name) as source:
                    layout, offsets, counts = directory(_reader(source))
                said = json.dumps(asdict(layout))
                yield pd.DataFrame({"path": name, "block": range(len(offsets)), "at": offsets, "size": counts, "layout": said})

    return files.select("path").repartition("path").mapInPandas(listed, "path string, block int, at long, size long, layout string")


def geotiff(spark: SparkSession, path: str) -> DataFrame:
    """The pixels of the GeoTIFF files of a path that Spark can list."""
    return geotiff_of(spark.read.format("binaryFile").load(path).select("path"))


def geotiff_of(files: DataFrame) -> DataFrame:
    """The pixels of GeoTIFF files (path). Blocks are dealt out one by one, so a large file is read and decoded by many tasks, each reading
    the bytes of its blocks only; files are opened through pyarrow's file systems."""

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, own in part.groupby("path", sort=False):
                with _open(name) as source:
                    read = _reader(source)
                    for block, at, size, said in zip(own["block"], own["at"], own["size"], own["layout"]):
                        layout = Layout(**json.loads(said))
                        row, col, z = decode_block(read(int(at), int(size)), int(block), layout)
                        r, c = np.indices(z.shape)
                        r, c = r.ravel() + row, c.ravel() + col
                        yield pd.DataFrame({"tile": name.rsplit("/", 1)[-1], "row": r, "col": c, "lon": layout.west + (c + layout.half) * layout.step_x, "lat": layout.north - (r + layout.half) * layout.step_y, "z": pd.Series(z.ravel()).astype(object).where(~np.isnan(z.ravel()), None)})

    return geotiff_blocks(files).repartition("path", "block").mapInPandas(decode, _SCHEMA)


def write_geotiff(values: np.ndarray, west: float, north: float, step_x: float, step_y: float, nodata: float = -9999.0, kind: str = "f4", block: tuple[int, int] | None = None, deflate: bool = False, predictor: int = 1) -> bytes:
    """A little-endian GeoTIFF (EPSG:4326), row 0 in the north: one strip, or tiles of ``block`` (rows, columns; multiples of 16), as
    they are or by Deflate, integers differenced by row with predictor 2. For a grid that was made to be looked at."""
    h, w = values.shape
    whole = np.where(np.isnan(values), nodata, values).astype("<" + kind)
    bh, bw = block or (h, w)
    parts = []
    for r in range(0, h, bh):
        for c in range(0, w, bw):
            part = np.full((bh, bw), nodata, whole.dtype)
            piece = whole[r : r + bh, c : c + bw]
            part[: piece.shape[0], : piece.shape[1]] = piece
            if predictor == 2:
                part[:, 1:] = part[:, 1:] - part[:, :-1]
            parts.append(zlib.compress(part.tobytes()) if deflate else part.tobytes())
    form = {"u": 1, "i": 2, "f": 3}[kind[0]]
    text = f"{nodata:g}\0".encode()
    fields = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (8 * whole.itemsize,)), (259, 3, (DEFLATE if deflate else NONE,)), (262, 3, (1,)), (277, 3, (1,)), (317, 3, (predictor,)), (339, 3, (form,)), (33550, 12, (step_x, step_y, 0.0)), (33922, 12, (0.0, 0.0, 0.0, west, north, 0.0)), (34735, 3, (1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)), (42113, 2, (text,))]
    sizes = tuple(map(len, parts))
    fields += [(322, 4, (bw,)), (323, 4, (bh,)), (324, 4, (0,) * len(parts)), (325, 4, sizes)] if block else [(273, 4, (0,)), (278, 4, (h,)), (279, 4, sizes)]
    fields.sort()
    base = 8 + 2 + 12 * len(fields) + 4
    # values of more than four bytes lie behind the directory, blocks behind those
    coded = [items[0] if t == 2 else struct.pack(f"<{len(items)}{_FIELDS[t][0]}", *items) for _, t, items in fields]
    begin = base + sum(len(x) + len(x) % 2 for x in coded if len(x) > 4)
    offsets = struct.pack(f"<{len(parts)}I", *(begin + sum(sizes[:i]) for i in range(len(parts))))
    entries, extra = [], b""
    for (tag, t, items), raw in zip(fields, coded):
        raw = offsets if tag in (273, 324) else raw
        count = len(raw) if t == 2 else len(items)
        if len(raw) <= 4:
            entries.append(struct.pack("<HHI", tag, t, count) + raw.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", tag, t, count, base + len(extra)))
            extra += raw + b"\0" * (len(raw) % 2)
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0) + extra + b"".join(parts)
