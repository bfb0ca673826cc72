"""FITS files: images and binary tables, read with NumPy inside Spark tasks.

Only the standard's basic parts are needed: 2880-byte blocks, 80-character cards, big-endian arrays, unscaled or
scaled by BSCALE and BZERO, and tables of numbers and fixed-width texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

BLOCK, CARD = 2880, 80
#: Types of arrays by BITPIX and of table columns by TFORM (fixed values of the standard).
PIXEL = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
COLUMN = {"L": "S1", "B": ">u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        return text[1 : text.rfind("'")].rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def units(raw: bytes) -> list[tuple[dict, int, int]]:
    """(header, start, length) of each unit's data."""
    out, at = [], 0
    while at + BLOCK <= len(raw):
        header, end = {}, False
        while not end and at < len(raw):
            for k in range(at, at + BLOCK, CARD):
                card = raw[k : k + CARD].decode("ascii", "replace")
                name = card[:8].strip()
                if name == "END":
                    end = True
                    break
                if card[8:10] == "= ":
                    header[name] = _value(card[10:])
            at += BLOCK
        axes = [header.get(f"NAXIS{n + 1}", 0) for n in range(header.get("NAXIS", 0))]
        size = abs(header.get("BITPIX", 8)) // 8 * int(np.prod(axes)) * max(1, header.get("GCOUNT", 1)) + header.get("PCOUNT", 0) if axes else 0
        out.append((header, at, size))
        at += -(-size // BLOCK) * BLOCK
    return out


def image(raw: bytes, header: dict, start: int, size: int) -> np.ndarray:
    shape = [header[f"NAXIS{n}"] for n in range(header["NAXIS"], 0, -1)]
    data = np.frombuffer(raw, PIXEL[header["BITPIX"]], int(np.prod(shape)), start).reshape(shape)
    return data.astype(float) * header.get("BSCALE", 1) + header.get("BZERO", 0) if "BSCALE" in header or "BZERO" in header else data.astype(data.dtype.newbyteorder("="))


def table(raw: bytes, header: dict, start: int) -> pd.DataFrame:
    fields = []
    for n in range(1, header["TFIELDS"] + 1):
        form = header[f"TFORM{n}"]
        count = int("".join(c for c in form[:-1] if c.isdigit()) or 1) if not form[-1].isdigit() else 1
        kind = next(c for c in form if c.isalpha())
        fields.append((header[f"TTYPE{n}"], f"S{count}" if kind == "A" else COLUMN[kind], () if kind == "A" or count == 1 else (count,)))
    rows = np.frombuffer(raw, np.dtype(fields), header["NAXIS2"], start)
    out = {}
    for name, kind, shape in fields:
        c = rows[name]
        if kind.startswith("S"):
            out[name] = c == b"T" if kind == "S1" else [x.decode("ascii", "replace").rstrip() for x in c]
        else:
            out[name] = list(c.astype(c.dtype.newbyteorder("="))) if shape else c.astype(c.dtype.newbyteorder("="))
    return pd.DataFrame(out)


def read_table(spark: SparkSession, path: str, schema: str, pattern: str = "*.fits", index: str | None = None) -> DataFrame:
    """Rows of the first binary table of every file below path, with the file's name. Only the columns of the schema are made; ``index`` names one that gets the row's number in its file, from 0."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        for b in batches:
            for file, raw in zip(b["path"], b["content"], strict=True):
                for header, start, _ in units(raw):
                    if header.get("XTENSION") == "BINTABLE":
                        t = table(raw, header, start)
                        if index:
                            t[index] = np.arange(len(t))
                        yield t.reindex(columns=names).assign(file=file.rsplit("/", 1)[-1])
                        break

    return _files(spark, path, pattern).mapInPandas(run, f"{schema}, file string")


def read_headers(spark: SparkSession, path: str, keys: list[str], pattern: str = "*.fits") -> DataFrame:
    """file and the named header values as texts, the first unit that has each."""

    def run(batches):
        for b in batches:
            rows = []
            for file, raw in zip(b["path"], b["content"], strict=True):
                found: dict = {}
                for header, _, _ in units(raw):
                    found = {k: header[k] for k in keys if k in header} | found
                rows.append([file.rsplit("/", 1)[-1], *[None if k not in found else str(found[k]) for k in keys]])
            yield pd.DataFrame(rows, columns=["file", *keys])

    return _files(spark, path, pattern).mapInPandas(run, "file string, " + ", ".join(f"`{k}` string" for k in keys))


def read_tiles(spark: SparkSession, path: str, unit: str = "SCI", core: int = 128, halo: int = 16, pattern: str = "*.fits") -> DataFrame:
    """Tiles of every image unit named ``unit`` (or of the first image where none is named)."""
    from skyspark.operators.images import TILE_SCHEMA, tiles

    names = [c.split()[0] for c in TILE_SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            for file, raw in zip(b["path"], b["content"], strict=True):
                every = [u for u in units(raw) if u[0].get("NAXIS", 0) == 2 and u[0].get("XTENSION", "IMAGE") == "IMAGE"]
                named = [u for u in every if u[0].get("EXTNAME") == unit] or every[:1]
                for chip, (header, start, size) in enumerate(named, 1):
                    for row in tiles(image(raw, header, start, size), file.rsplit("/", 1)[-1], header.get("EXTVER", chip), core, halo):
                        yield pd.DataFrame([row], columns=names)

    return _files(spark, path, pattern).mapInPandas(run, TILE_SCHEMA)


def _whole(spark: SparkSession, path: str) -> bytes:
    """One file's bytes, for what the driver broadcasts: a library's grid, some megabytes."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def read_psf(spark: SparkSession, path: str, offset: tuple[float, float] = (0.0, 0.0)):
    """The point-spread functions of a library file: a cube, with the nodes' positions in its header (IPSFX01.., JPSFY01..), or on a regular grid over 4096 pixels where it names none. Marks of missing data (below -0.001) count as 0."""
    from skyspark.operators.images import PsfGrid

    raw = _whole(spark, path)
    header, start, size = next(u for u in units(raw) if u[0].get("NAXIS", 0) >= 2)
    shape = [header[f"NAXIS{k}"] for k in range(header["NAXIS"], 0, -1)]
    cube = pixels(raw, header, start, shape).reshape(-1, *shape[-2:])
    cube = np.where(cube < -0.001, 0.0, cube)
    over, n = int(float(header.get("PSFSCALE", header.get("OVERSAMP", 4)))), len(cube)
    nx, ny = (header.get(f"N{a}PSFS", header.get(f"N{a}PSF")) for a in "XY")
    if n == 1:
        return PsfGrid(cube, [0.0], [0.0], over, offset)
    if nx is not None and ny is not None:
        nodes = [[next((float(header[k]) for k in (f"{name}{i:02d}", f"{name}{i:04d}") if k in header), None) for i in range(1, int(m) + 1)] for name, m in (("IPSFX", nx), ("JPSFY", ny))]
        if None not in nodes[0] and None not in nodes[1]:
            return PsfGrid(cube, nodes[0], nodes[1], over, offset)
    nx = int(np.ceil(np.sqrt(n)))
    ny = -(-n // nx)
    if nx * ny > n:  # the last row isn't whole
        ny -= 1
    return PsfGrid(cube[: nx * ny], np.linspace(0, 4096, nx), np.linspace(0, 4096, ny), over, offset)


def read_distortion(spark: SparkSession, path: str):
    """The distortion grid of a library file: its first three image units are corrected x, corrected y and the magnitude correction, as scaled integers or floats."""
    from skyspark.operators.distortion import Grid

    raw = _whole(spark, path)
    planes = [pixels(raw, h, start, (h["NAXIS2"], h["NAXIS1"])) for h, start, _ in units(raw) if h.get("NAXIS", 0) == 2 and h.get("XTENSION", "IMAGE") == "IMAGE"][:3]
    return Grid(*planes)


def pixels(raw: bytes, header: dict, start: int, shape) -> np.ndarray:
    """An array of a unit, scaled by BSCALE and BZERO."""
    kind = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[header["BITPIX"]]
    a = np.frombuffer(raw, kind, int(np.prod(shape)), start).astype(float).reshape(shape)
    return a * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0))


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def _cards(pairs: list[tuple[str, object]]) -> bytes:
    def one(k, v):
        v = ("T" if v else "F").rjust(20) if isinstance(v, bool) else f"'{v}'".ljust(20) if isinstance(v, str) else str(v).rjust(20)
        return f"{k:8}= {v}".ljust(CARD)

    text = "".join(one(k, v) for k, v in pairs) + "END".ljust(CARD)
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii")


def write(path: str, images: list[tuple[np.ndarray, dict]] = (), rows: pd.DataFrame | None = None, primary: dict | None = None) -> None:
    """A file with image units and, last, a table of numbers."""
    pad = lambda b: b + b"\0" * (-len(b) % BLOCK)
    out = [_cards([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), *(primary or {}).items()])]
    for data, header in images:
        out += [_cards([("XTENSION", "IMAGE"), ("BITPIX", -64), ("NAXIS", 2), ("NAXIS1", data.shape[1]), ("NAXIS2", data.shape[0]), ("PCOUNT", 0), ("GCOUNT", 1), *header.items()]), pad(data.astype(">f8").tobytes())]
    if rows is not None:
        kinds = {"i": ("K", ">i8"), "f": ("D", ">f8"), "b": ("L", "S1")}
        fields = [(c, *kinds[rows[c].dtype.kind]) for c in rows]
        a = np.zeros(len(rows), np.dtype([(c, k) for c, _, k in fields]))
        for c, form, _ in fields:
            a[c] = np.where(rows[c], b"T", b"F") if form == "L" else rows[c]
        cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", a.dtype.itemsize), ("NAXIS2", len(a)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(fields))]
        out += [_cards([*cards, *[x for n, (c, form, _) in enumerate(fields, 1) for x in ((f"TTYPE{n}", c), (f"TFORM{n}", f"1{form}"))]]), pad(a.tobytes())]
    with open(path, "wb") as f:
        f.write(b"".join(out))
