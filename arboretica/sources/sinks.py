"""Sinks: rasters as PGM, FITS, NIfTI-1 or HDF5 files, spectra and tree tables as text, written from tasks.

A file is one image, written by one task that streams the image's values in the file's order: it holds a batch at a time,
whatever the image's size. Files get their name when they are complete, so a task that runs again replaces its own work.
Tables that need no single file are better written as Parquet, which any number of tasks do.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from .formats import FormatError, fits_header, nifti_header, pgm_header

FORMATS = {"pgm": "pgm", "fits": "fits", "fit": "fits", "nii": "nifti", "nifti": "nifti", "h5": "hdf5", "hdf5": "hdf5"}
#: Values of a gap that are written at once.
_STEP = 1 << 18


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        path = "file://" + posixpath.abspath(path)
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(posixpath.dirname(inner), recursive=True)
    return fs, inner


class _File:
    """A file under a name of its own until it is complete."""

    def __init__(self, path: str):
        self.fs, self.path = _open(path)
        self.own = f"{self.path}.{uuid.uuid4().hex}.part"
        self.stream, self.bytes = self.fs.open_output_stream(self.own), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def close(self) -> int:
        self.stream.close()
        self.fs.move(self.own, self.path)
        return self.bytes


def sample_kind(whole: bool, least: float, most: float) -> str:
    """The narrowest type of a raster's values: bytes, 16 or 32 bits with or without a sign, else 32-bit floats."""
    if not whole:
        return "f4"
    for kind in ("u1", "i2", "u2", "i4", "u4"):
        if np.iinfo(kind).min <= least and most <= np.iinfo(kind).max:
            return kind
    return "f4"


class _Raster:
    """Streams one raster's values, given with ascending places; places that are missing are 0."""

    def __init__(self, path: str, fmt: str, kind: str, shape: tuple[int, ...], dataset: str):
        self.fmt, self.kind, self.size, self.at = fmt, kind, int(np.prod(shape)), 0
        self.base = {"u2": 1 << 15, "u4": 1 << 31}.get(kind, 0) if fmt == "fits" else 0
        if fmt == "hdf5":
            self.file, self.shape, self.path, self.dataset, self.held = None, shape, path, dataset, np.zeros(self.size, kind)
            return
        self.file = _File(path)
        if fmt == "pgm":
            self.file.write(pgm_header(shape[-1], shape[-2], 255 if kind == "u1" else 65535))
        else:
            self.file.write(fits_header(shape, kind) if fmt == "fits" else nifti_header(shape, kind))

    def _put(self, values: np.ndarray) -> None:
        if self.fmt == "fits":
            signed = {"u2": ">i2", "u4": ">i4"}.get(self.kind, ">" + self.kind)
            self.file.write((values.astype(np.int64) - self.base).astype(signed).tobytes() if self.base else values.astype(signed).tobytes())
        else:
            self.file.write(values.astype((">" if self.fmt == "pgm" else "<") + self.kind).tobytes())

    def add(self, place: np.ndarray, values: np.ndarray) -> None:
        if self.file is None:
            self.held[place] = values
            return
        begin = 0
        while begin < len(place):
            # a stretch of places without a wide gap, filled up with zeros
            first = int(place[begin])
            while self.at < first:
                n = min(first - self.at, _STEP)
                self._put(np.zeros(n))
                self.at += n
            end = int(np.searchsorted(place, first + _STEP))
            out = np.zeros(int(place[end - 1]) - first + 1)
            out[place[begin:end] - first] = values[begin:end]
            self._put(out)
            self.at, begin = first + len(out), end

    def close(self) -> int:
        if self.file is None:
            return _write_hdf5(self.path, self.dataset, self.held.reshape(self.shape))
        while self.at < self.size:
            n = min(self.size - self.at, _STEP)
            self._put(np.zeros(n))
            self.at += n
        if self.fmt == "fits":
            self.file.write(b"\0" * (-self.file.bytes % 2880))
        return self.file.close()


def _write_hdf5(path: str, dataset: str, values: np.ndarray) -> int:
    try:
        import h5py
    except ImportError as e:
        raise FormatError("HDF5 needs h5py") from e
    import io

    data = io.BytesIO()
    with h5py.File(data, "w") as f:
        f.create_dataset(dataset, data=values)
    out = _File(path)
    out.write(data.getvalue())
    return out.close()


def extents(pixels: DataFrame) -> DataFrame:
    """Rows ``(image_id, w, h, d)``."""
    return pixels.groupBy("image_id").agg(*[(F.max(F.coalesce(F.col(c), F.lit(0))) + 1).cast("long").alias(n) for c, n in (("x", "w"), ("y", "h"), ("z", "d"))])


def write_rasters(values: DataFrame, sizes: DataFrame, path: str, fmt: str = "fits", floats: bool = False, planes: int = 1, dataset: str = "data") -> DataFrame:
    """Write a file for each image of ``values(image_id, idx, value[, k])`` with ``sizes(image_id, w, h, d)``; rows
    ``(image_id, path, bytes)``. ``{image}`` in ``path`` is replaced by the image's id.

    The sample type is the narrowest that holds the values, or 32-bit floats if ``floats``. With ``planes``, the raster of
    plane k = 1, 2 ... follows that of k - 1 along one more axis. PGM holds 2-D rasters of 8 or 16 bits without a sign; what
    does not fit becomes FITS, and the path's ending follows. Null values and missing pixels are 0.
    """
    if fmt not in FORMATS.values():
        raise ValueError(f"fmt must be one of {sorted(set(FORMATS.values()))}")
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    rows = values.withColumn("value", value).join(sizes, "image_id")
    spans = rows.groupBy("image_id").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.min(F.col("value") == F.rint("value")).alias("whole"))
    inside = F.col("idx") if planes == 1 else F.col("idx") + (F.col("k") - 1) * F.col("w") * F.col("h") * F.col("d")
    fits_pgm = F.lit(fmt == "pgm" and planes == 1 and not floats) & F.col("whole") & (F.col("least") >= 0) & (F.col("most") < 65536) & (F.col("d") == 1)
    rows = rows.join(spans, "image_id").withColumn("pgm", fits_pgm)
    # the first row of a PGM is the top one
    place = F.when(F.col("pgm"), (F.col("h") - 1 - F.floor(F.col("idx") / F.col("w"))) * F.col("w") + F.col("idx") % F.col("w")).otherwise(inside)
    ready = rows.select("image_id", place.cast("long").alias("place"), "value", "w", "h", "d", "least", "most", "whole", "pgm").repartition("image_id").sortWithinPartitions("image_id", "place")
    other = "fits" if fmt == "pgm" else fmt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, raster, name = None, None, ""
        done: list[tuple[int, str, int]] = []
        for batch in batches:
            image = batch.column("image_id").to_numpy()
            place, value = batch.column("place").to_numpy(), batch.column("value").to_numpy()
            cuts = [0, *(np.flatnonzero(image[1:] != image[:-1]) + 1).tolist(), len(image)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if raster is None or image[a] != now:
                    if raster is not None:
                        done.append((int(now), name, raster.close()))
                    now = image[a]
                    w, h, d, least, most, whole, pgm = (batch.column(c)[a].as_py() for c in ("w", "h", "d", "least", "most", "whole", "pgm"))
                    kind = "f4" if floats else sample_kind(whole, least, most)
                    shape = (*((planes,) if planes > 1 else ()), *((d, h, w) if d > 1 else (h, w)))
                    name = path.replace("{image}", str(int(now)))
                    if fmt == "pgm" and not pgm:
                        name = name[: -len(".pgm")] + ".fits" if name.endswith(".pgm") else name
                    raster = _Raster(name, "pgm" if pgm else other, "u2" if pgm and kind == "i2" else kind, shape, dataset)
                raster.add(place[a:b], value[a:b])
        if raster is not None:
            done.append((int(now), name, raster.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["image_id", "path", "bytes"])

    return ready.mapInArrow(run, "image_id long, path string, bytes long")


def _write_text(rows: DataFrame, order: list[str], header: str, line, path: str) -> DataFrame:
    """A text file for each image: the header, and ``line(batch)`` of the rows in order. Rows ``(image_id, path, bytes)``."""
    ready = rows.repartition("image_id").sortWithinPartitions("image_id", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out, name, done = None, None, "", []
        for pdf in batches:
            for image, own in pdf.groupby("image_id", sort=False):
                if out is None or image != now:
                    if out is not None:
                        done.append((now, name, out.close()))
                    now, name = image, path.replace("{image}", str(int(image)))
                    out = _File(name)
                    out.write((header + "\n").encode())
                out.write("".join(x + "\n" for x in line(own)).encode())
        if out is not None:
            done.append((now, name, out.close()))
        yield pd.DataFrame(done, columns=["image_id", "path", "bytes"])

    return ready.mapInPandas(run, "image_id long, path string, bytes long")


def write_spectrum(spectrum: DataFrame, path: str) -> DataFrame:
    """A spectrum as tab-separated text, a file an image: thresholds and sums, in the order of the bins."""
    two = "lambda1" in spectrum.columns
    columns = ["lambda1", "lambda2", "spectrum"] if two else ["lambda", "spectrum"]
    # The header lines
    header = "lambdas_attr1 \t lambda_attr2 \t spectra" if two else "lambdas \t spectra"
    return _write_text(spectrum, ["k2", "k1"] if two else ["k"], header, lambda own: (" \t ".join(f"{x:f}" for x in r) for r in own[columns].itertuples(index=False)), path)


# Decimals of a tree dump's columns; the others have two.
_DECIMALS = {"elong": 3, "flat": 3, "spars": 3, "ncomp": 4}


def write_tree(table: DataFrame, path: str) -> DataFrame:
    """A tree table as comma-separated text with a header, a file an image, nodes by their ids."""
    columns = [c for c in table.columns if c != "image_id"]
    whole = {c for c, t in table.dtypes if t in ("bigint", "int")}
    show = lambda c, x: str(int(x)) if c in whole else "" if x != x else f"{x:.{_DECIMALS.get(c, 2)}f}"
    return _write_text(table, ["index"], ",".join(columns), lambda own: (",".join(show(c, x) for c, x in zip(columns, r)) for r in own[columns].itertuples(index=False)), path)


def several_images(pixels: DataFrame) -> bool:
    """Whether a table has more than one image; two ids are looked at."""
    return len(pixels.select("image_id").distinct().limit(2).collect()) > 1

