"""Image file formats: PGM, FITS and NIfTI-1 decoders and encoders in numpy, and distributed readers; ``sinks`` writes.

Files are read by ``binaryFile`` and decoded in ``mapInPandas`` tasks, one file per row, so any store that Spark reads will
do. HDF5 needs h5py and other picture formats need Pillow; both are used only where they can be imported.
"""

from __future__ import annotations

import io
import re
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

PIXELS = "image_id long, idx long, x int, y int, z int, g double"
# NIfTI-1 codes of sample types
_NIFTI_KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
_TILE = re.compile(r"-T(\d+)T\.[^.]*$")


class FormatError(ValueError):
    """The bytes are not a raster of the format."""


@dataclass(frozen=True)
class Raw:
    """Where a file's values lie, line by line: type, first byte, and value = stored * scale + zero. ``top``: the first line
    is the top one, y = height - 1."""

    shape: tuple[int, int, int]  # depth, height, width
    kind: str
    offset: int
    scale: float = 1.0
    zero: float = 0.0
    top: bool = False

    def values(self, data: bytes, lines: int) -> np.ndarray:
        """The values of ``lines`` whole lines."""
        n = lines * self.shape[2]
        if len(data) < n * np.dtype(self.kind).itemsize:
            raise FormatError("the image is cut short")
        return np.frombuffer(data, self.kind, n).astype(float) * self.scale + self.zero


def _raw_pgm(data: bytes) -> tuple[Raw, int]:
    fields, at = [], 2
    while len(fields) < 3:
        m = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d{1,9})").match(data, at)
        if not m:
            raise FormatError("bad PGM header")
        fields.append(int(m[1]))
        at = m.end()
    w, h, most = fields
    return Raw((1, h, w), "u1" if most < 256 else ">u2", at + 1, top=True), at


def _raw_fits(data: bytes) -> Raw:
    """The primary array of a FITS file: 2-D, 3-D, or 4-D with a last axis of 1; BSCALE and BZERO are applied."""
    cards, at, done = {}, 0, False
    while not done:
        block = data[at : at + 2880]
        if len(block) < 2880:
            raise FormatError("no END card")
        at += 2880
        for i in range(0, 2880, 80):
            card = block[i : i + 80].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                done = True
                break
            if card[8:10] == "= ":
                cards[key] = card[10:].split("/")[0].strip().strip("'").strip()
    kinds = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
    axes = [int(cards[f"NAXIS{i + 1}"]) for i in range(int(cards.get("NAXIS", 0)))]
    if int(cards.get("BITPIX", 0)) not in kinds or not 2 <= len(axes) <= 4 or (len(axes) == 4 and axes[3] != 1):
        raise FormatError("not a raster of two or three axes")
    w, h, d = (*axes, 1)[:3]
    return Raw((d, h, w), kinds[int(cards["BITPIX"])], at, float(cards.get("BSCALE", 1)), float(cards.get("BZERO", 0)))


def _raw_nifti(data: bytes) -> Raw:
    """A single-file NIfTI-1 image, either byte order, decoded by its datatype, slope and intercept applied."""
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", data[:4])[0] != 348:
        raise FormatError("not a NIfTI-1 header")
    dim = struct.unpack(order + "8h", data[40:56])
    kind = _NIFTI_KINDS.get(struct.unpack(order + "h", data[70:72])[0])
    offset, slope, intercept = struct.unpack(order + "3f", data[108:120])
    if kind is None or not 2 <= dim[0] <= 4 or (dim[0] == 4 and dim[4] != 1):
        raise FormatError("not a raster of two or three axes")
    shape = max(1, dim[3]) if dim[0] >= 3 else 1, dim[2], dim[1]
    return Raw(shape, order + kind, int(offset) or 352, *((slope, intercept) if slope else (1.0, 0.0)))


def raw(data: bytes) -> Raw | None:
    """Where a file's values lie, by its first bytes; None for formats that are not plain arrays."""
    if data[:2] == b"P5":
        return _raw_pgm(data)[0]
    if data[:9] == b"SIMPLE  =":
        return _raw_fits(data)
    if len(data) >= 352 and data[344:347] in (b"n+1", b"ni1"):
        return _raw_nifti(data)
    return None


def _hdf5(data: bytes, dataset: str) -> np.ndarray:
    try:
        import h5py
    except ImportError as e:
        raise FormatError("HDF5 needs h5py") from e
    with h5py.File(io.BytesIO(data)) as f:
        values = np.asarray(f[dataset], float)
    if not 2 <= values.ndim <= 3:
        raise FormatError("not a raster of two or three axes")
    return values.reshape((1,) * (3 - values.ndim) + values.shape)


def _picture(data: bytes) -> np.ndarray:
    try:
        from PIL import Image
    except ImportError as e:
        raise FormatError("this picture format needs Pillow") from e
    image = Image.open(io.BytesIO(data))
    return np.asarray(image if image.mode in ("L", "I", "F", "I;16") else image.convert("L"), float)[None, ::-1]


def decode(data: bytes, name: str = "", dataset: str = "data") -> np.ndarray:
    """The array (depth, height, width) of a file's bytes, y = 0 at the bottom; the format follows from the bytes, not from
    the name."""
    if (own := raw(data)) is not None:
        d, h, w = own.shape
        out = own.values(data[own.offset :], d * h).reshape(own.shape)
        return out[:, ::-1] if own.top else out
    if data[:2] == b"P2":
        own, at = _raw_pgm(data)
        values = np.array(data[at:].split()[: own.shape[1] * own.shape[2]], float)
        if len(values) != own.shape[1] * own.shape[2]:
            raise FormatError("the image is cut short")
        return values.reshape(own.shape)[:, ::-1]
    if data[:4] == b"\x89HDF":
        return _hdf5(data, dataset)
    return _picture(data)


def pgm_header(width: int, height: int, most: int) -> bytes:
    return f"P5\n{width} {height}\n{most}\n".encode()


def fits_header(shape: tuple[int, ...], kind: str = "f4") -> bytes:
    """The header of an array of two to four axes; types without a sign are those with one, shifted by BZERO."""
    bits = {"u1": 8, "i2": 16, "u2": 16, "i4": 32, "u4": 32, "f4": -32, "f8": -64}[kind]
    cards = ["SIMPLE  =                    T", f"BITPIX  = {bits:20d}", f"NAXIS   = {len(shape):20d}"]
    cards += [f"NAXIS{i + 1}  = {n:20d}" for i, n in enumerate(shape[::-1])]
    if kind in ("u2", "u4"):
        cards += [f"BZERO   = {1 << (15 if kind == 'u2' else 31):20d}", f"BSCALE  = {1:20d}"]
    head = "".join(c.ljust(80) for c in [*cards, "END"])
    return head.ljust(-(-len(head) // 2880) * 2880).encode()


def nifti_header(shape: tuple[int, ...], kind: str = "f4") -> bytes:
    """The header of a single-file NIfTI-1 of two to four axes, little-endian."""
    code = next(c for c, k in _NIFTI_KINDS.items() if k == kind)
    axes = (*shape[::-1], *(1,) * 7)[:7]
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, max(3, len(shape)), *axes)
    struct.pack_into("<hh", head, 70, code, 8 * int(kind[1]))
    struct.pack_into("<8f", head, 76, 1, 1, 1, 1, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    head[344:348] = b"n+1\0"
    return bytes(head)


def encode_pgm(values: np.ndarray) -> bytes:
    """A 2-D array as PGM of 8 or 16 bits, y = 0 at the bottom."""
    a = np.rint(values).clip(0, 65535)
    kind, most = (np.uint8, 255) if a.max(initial=0) < 256 else (">u2", 65535)
    return pgm_header(a.shape[-1], a.shape[-2], most) + a.reshape(a.shape[-2:])[::-1].astype(kind).tobytes()


def encode_fits(values: np.ndarray) -> bytes:
    """An array of two to four axes as a FITS file of 32-bit floats."""
    body = values.astype(">f4").tobytes()
    return fits_header(values.shape) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def encode_nifti(values: np.ndarray) -> bytes:
    """A volume as a single-file NIfTI-1 of 32-bit floats."""
    return nifti_header(values.reshape((1,) * (3 - values.ndim) + values.shape).shape) + values.astype("<f4").tobytes()


def read_rasters(spark: SparkSession, path: str, dataset: str = "data", tiled: bool = False) -> DataFrame:
    """``pixels`` of every file under ``path`` (a glob), image ids by the hash of the file's name.

    ``tiled``: names end in ``-T<k>T.<ext>``; all tiles of a name are one image id, and ``tile`` is k.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                values = decode(bytes(data), name, dataset)
                d, h, w = values.shape
                i = np.arange(values.size)
                found = _TILE.search(name)
                yield pd.DataFrame({"path": _TILE.sub("", name) if tiled else name, "tile": int(found[1]) if found else 0, "idx": i, "x": (i % w).astype(np.int32), "y": (i // w % h).astype(np.int32), "z": (i // (w * h)).astype(np.int32), "g": values.ravel()})

    rows = files.mapInPandas(run, "path string, tile int, idx long, x int, y int, z int, g double")
    rows = rows.withColumn("image_id", F.xxhash64("path"))
    return rows.select("image_id", "tile", "idx", "x", "y", "z", "g") if tiled else rows.select("image_id", "idx", "x", "y", "z", "g")


#: Lines' bytes of one scan task, about, and bytes in which a header ends.
SLAB_BYTES, HEADER_BYTES = 32 << 20, 1 << 20


def read_windows(spark: SparkSession, path: str, window: tuple[tuple[int, int], ...] | None = None) -> DataFrame:
    """``pixels`` of plain arrays (PGM, FITS, NIfTI-1) under ``path``, many tasks a file: each reads a slab of lines.

    ``window`` is half-open ranges of x, y and z; only lines inside it are read from the store, and places stay those of the
    whole image. Files of any size will do. The store must be one that ``pyarrow.fs`` opens."""
    from pyarrow import fs as stores

    (x0, x1), (y0, y1), (z0, z1) = (*(window or ()), *((0, 1 << 40),) * 3)[:3]
    files = spark.read.format("binaryFile").load(path).select("path")

    def open_at(name: str):
        store, inner = stores.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", name))
        return store.open_input_file(inner)

    def plan(batches):
        for batch in batches:
            for name in batch["path"]:
                with open_at(name) as f:
                    own = raw(f.read(HEADER_BYTES))
                if own is None:
                    raise FormatError(f"{name} is not a plain array")
                d, h, w = own.shape
                step = max(1, SLAB_BYTES // max(1, w * np.dtype(own.kind).itemsize))
                low, high = max(0, y0), min(h, y1)
                for z in range(max(0, z0), min(d, z1)):
                    for y in range(low, high, step):
                        yield pd.DataFrame({"path": [name], "z": [z], "y": [y], "n": [min(step, high - y)]})

    def scan(batches):
        for batch in batches:
            for name, z, y, n in zip(batch["path"], batch["z"], batch["y"], batch["n"]):
                with open_at(name) as f:
                    own = raw(f.read(HEADER_BYTES))
                    d, h, w = own.shape
                    first = h - y - n if own.top else y
                    line = w * np.dtype(own.kind).itemsize
                    f.seek(own.offset + (z * h + first) * line)
                    values = own.values(f.read(n * line), n).reshape(n, w)
                values = (values[::-1] if own.top else values)[:, max(0, x0) : min(w, x1)]
                for at in range(0, n, max(1, 1_000_000 // max(1, values.shape[1]))):
                    part = values[at : at + max(1, 1_000_000 // max(1, values.shape[1]))]
                    ys, xs = np.indices(part.shape)
                    xs, ys = xs.ravel() + max(0, x0), ys.ravel() + y + at
                    yield pd.DataFrame({"path": name, "idx": (z * h + ys) * w + xs, "x": xs.astype(np.int32), "y": ys.astype(np.int32), "z": np.int32(z), "g": part.ravel()})

    slabs = files.mapInPandas(plan, "path string, z long, y long, n long").repartition("path", "z", "y")
    rows = slabs.mapInPandas(scan, "path string, idx long, x int, y int, z int, g double")
    return rows.select(F.xxhash64("path").alias("image_id"), "idx", "x", "y", "z", "g")


# Fixed value: the first line that a threshold file must have.
LAMBDA_HEADER = "#LambdaVector file. Keep this exact line in all similar lambda vector files"


def parse_lambdas(text: str) -> list[float]:
    """The thresholds of a threshold file's text: the fixed first line, then numbers."""
    first, _, rest = text.partition("\n")
    if first.strip() != LAMBDA_HEADER:
        raise FormatError("the first line is not that of a threshold file")
    return [float(x) for x in rest.split()]
