"""Runs described by a configuration text, command-line flags or keyword arguments, and their execution."""

from __future__ import annotations

import logging
import re
import sys
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.attributes import attribute
from ..functions.preprocess import MODES, extrema, preprocess
from ..operators import queries as Q
from ..operators.tree import CONNECTIVITIES, build_tree, build_tree_tiled
from ..sources import formats, rasters, sinks

OPERATIONS = ("filter", "extract", "dmp", "csl", "pattern", "pattern2D", "tree", "check")


@dataclass(frozen=True)
class Run:
    """What to read, how to prepare it, which tree to build and what to ask of it."""

    input_name: str = ""
    output_name: str = ""
    hdf5_dataset: str = "data"
    image_options: str = "grayscale"
    save_output: int = 1
    save_tree: int = 0
    interactive: int = 0
    tile_overlap: int = 0
    mpi_grid: tuple[int, int, int] = (1, 1, 1)
    pixel_dim: tuple[float, float, float] = (1.0, 1.0, 1.0)
    threads: int = 1
    preprocessing: str = "None"
    pixel_connectivity: int = 4
    include_background: int = 1
    tree_type: str = "max"
    verbosity: str = "INFO"
    operation: tuple[tuple, ...] = field(default=())


log = logging.getLogger("arboretica")
#: Levels of ``verbosity``; TIMING stands between information and debugging.
TIMING = 15
LEVELS = {"OFF": 100, "ERROR": logging.ERROR, "WARN": logging.WARNING, "INFO": logging.INFO, "TIMING": TIMING, "DEBUG": logging.DEBUG, "TRACE": 1, "ALL": 1}

_TOKEN = re.compile(r'\s*(?:#[^\n]*|//[^\n]*|/\*.*?\*/|("(?:[^"\\]|\\.)*")|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|([A-Za-z_][\w-]*)|([=;:,()\[\]{}]))', re.S)


def _tokens(text: str):
    position = 0
    while position < len(text):
        m = _TOKEN.match(text, position)
        if m is None:
            if text[position:].strip():
                raise ValueError(f"cannot read the configuration at {text[position : position + 30]!r}")
            return
        position = m.end()
        if m[1] is not None:
            yield "text", re.sub(r"\\(.)", r"\1", m[1][1:-1])
        elif m[2] is not None:
            yield "number", float(m[2]) if re.search(r"[.eE]", m[2]) else int(m[2])
        elif m[3] is not None:
            yield "name", m[3]
        elif m[4] is not None:
            yield "mark", m[4]


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = list(_tokens(text)), 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def next(self):
        token = self.peek()
        self.at += 1
        return token

    def value(self):
        kind, x = self.next()
        if kind in ("text", "number"):
            return x
        if kind == "name":
            return {"true": 1, "false": 0}.get(x.lower(), x)
        if x in ("(", "["):
            end, out = ")" if x == "(" else "]", []
            while self.peek() != ("mark", end):
                out.append(self.value())
                if self.peek() == ("mark", ","):
                    self.next()
            self.next()
            return tuple(out)
        raise ValueError(f"unexpected {x!r} in the configuration")


def parse_value(text: str):
    """A value of the configuration's grammar: text, number, ``(...)`` or ``[...]``."""
    reader = _Reader(text)
    out = reader.value()
    if reader.peek()[0] != "end":
        raise ValueError(f"more than a value in {text!r}")
    return out


def parse_config(text: str) -> Run:
    """``key = value;`` settings; unknown keys are ignored, as are comments."""
    reader, found = _Reader(text), {}
    while reader.peek()[0] != "end":
        kind, key = reader.next()
        if kind == "mark" and key in (";", ","):
            continue
        if kind != "name" or reader.next() not in (("mark", "="), ("mark", ":")):
            raise ValueError(f"expected a setting at {key!r}")
        found[key] = reader.value()
    return make_run(**{k: v for k, v in found.items() if k in Run.__dataclass_fields__})


def make_run(base: Run | None = None, **settings) -> Run:
    """A checked run: operation, attribute, rule, preprocessing, connectivity and grid must exist."""
    run = replace(base or Run(), **settings)
    ops = run.operation
    run = replace(run, operation=(ops,) if ops and isinstance(ops[0], str) else tuple(ops), mpi_grid=tuple(run.mpi_grid), pixel_dim=tuple(map(float, run.pixel_dim)))
    if run.preprocessing not in MODES:
        raise ValueError(f"preprocessing must be one of {MODES}")
    if run.pixel_connectivity not in CONNECTIVITIES:
        raise ValueError(f"pixel_connectivity must be one of {CONNECTIVITIES}")
    if run.tree_type not in ("max", "min"):
        raise ValueError("tree_type must be max or min")
    if run.image_options not in ("grayscale", "rgb", "rgb_channels", "lofar", "sequence"):
        raise ValueError(f"unknown image_options {run.image_options!r}")
    if len(run.mpi_grid) != 3 or min(run.mpi_grid) < 1:
        raise ValueError("mpi_grid must be three positive numbers")
    for op in run.operation:
        name, *rest = op
        if name not in OPERATIONS:
            raise ValueError(f"unknown operation {name!r}; there are {OPERATIONS}")
        sizes = {"filter": (2, 3), "extract": (2, 3), "dmp": (2, 3), "csl": (2, 3), "pattern": (2, 3), "pattern2D": (6, 6), "tree": (1, 1), "check": (1, 1)}[name]
        if not sizes[0] <= len(rest) <= sizes[1]:
            raise ValueError(f"{name} takes {sizes[0]} to {sizes[1]} parameters, not {len(rest)}")
        attribute(rest[0])
        if name in ("filter", "extract") and len(rest) == 3:
            Q._rule(rest[2])
        if name == "pattern2D":
            attribute(rest[3])
    return run


_FLAGS = {"i": "input_name", "input_image": "input_name", "o": "output_name", "output_image": "output_name", "t": "threads", "c": "pixel_connectivity", "connectivity": "pixel_connectivity", "g": "mpi_grid", "grid": "mpi_grid", "v": "verbosity"}


def parse_args(args: list[str]) -> Run:
    """Command-line flags over the settings of ``-config <file>``; unknown flags are reported and skipped."""
    found, run, i = {}, Run(), 0
    while i < len(args):
        flag = args[i].lstrip("-")
        value = args[i + 1] if i + 1 < len(args) else ""
        name = _FLAGS.get(flag, flag)
        if flag == "config":
            with open(value, encoding="utf-8") as f:
                run = parse_config(f.read())
        elif name in Run.__dataclass_fields__:
            found[name] = parse_value(value) if name in ("operation", "mpi_grid", "pixel_dim") else int(value) if isinstance(getattr(run, name), int) else value
        else:
            print(f"unknown flag -{flag}", file=sys.stderr)
        i += 2
    return make_run(run, **found)


def _lambdas(spark: SparkSession, given) -> list[float]:
    if isinstance(given, str):
        return formats.parse_lambdas("\n".join(r.value for r in spark.read.text(given, wholetext=True).collect()))
    return [float(x) for x in given]


def read_pixels(spark: SparkSession, run: Run) -> DataFrame:
    """The run's pixels: a Parquet table of pixels, image files, colour channels, a stack, or a grid of tiles."""
    name = run.input_name
    stem, _, ext = name.rpartition(".")
    if ext == "parquet":
        return spark.read.parquet(name)
    if run.image_options in ("rgb", "rgb_channels"):
        channels = [formats.read_rasters(spark, f"{stem}-{c}.{ext}", run.hdf5_dataset).withColumn("image_id", F.lit(0).cast("long")) for c in rasters.LUMINANCE]
        return rasters.luminance(*channels)
    if run.image_options in ("sequence", "lofar"):
        names = spark.read.format("binaryFile").load(name).select("path")
        order = names.select(F.xxhash64("path").alias("image_id"), (F.row_number().over(Window.orderBy("path")) - 1).alias("n"))  # a row a file
        return rasters.stack_images(formats.read_rasters(spark, name, run.hdf5_dataset), order)
    if max(run.mpi_grid) > 1 and "-T" in name:
        tiles = formats.read_rasters(spark, name, run.hdf5_dataset, tiled=True)
        size = tiles.where("tile = 0").agg(F.max("x"), F.max("y"), F.max("z")).first()
        overlap = [run.tile_overlap if n > 1 else 0 for n in run.mpi_grid]
        return rasters.mosaic(tiles, run.mpi_grid, tuple(int(s) + 1 - o for s, o in zip(size, overlap)), run.tile_overlap)
    return formats.read_rasters(spark, name, run.hdf5_dataset)


def _written(run: Run, op: tuple, df: DataFrame, sizes: DataFrame, many: bool) -> None:
    """Write an operation's result under ``output_name``: ``<prefix>_<operation>_...`` in the format of its ending, rasters as
    files of that format, tables as text; with the ending ``parquet``, or none, everything as Parquet."""
    prefix, dot, ending = run.output_name.rpartition(".")
    prefix, ending = (prefix, ending.lower()) if dot and ending.lower() in (*sinks.FORMATS, "parquet") else (run.output_name, "parquet")
    prefix += "-{image}" if many and ending != "parquet" else ""
    name, a, *rest = op or ("", None)
    short = attribute(a).name if op else ""
    stem = {"": "", "csl": "", "tree": "_tree", "pattern": f"_PS_1D_{short}", "dmp": f"_dmp_{run.tree_type}_{short}"}.get(name, f"_{name}_{short}")
    stem += f"_{float(rest[0]):.3f}" if name in ("filter", "extract") else ""
    if name == "pattern2D":
        stem = f"_PS_2D_{short}_{attribute(rest[2]).name}"
    if ending == "parquet":
        df.write.mode("overwrite").parquet(prefix + (stem or (f"_csl_{short}" if name == "csl" else "")))
        return
    fmt = sinks.FORMATS[ending]
    if name in ("pattern", "pattern2D"):
        files = [sinks.write_spectrum(df, f"{prefix}{stem}.txt")]
    elif name == "tree":
        files = [sinks.write_tree(df, f"{prefix}{stem}.txt")]
    elif name == "csl":
        scale = float(rest[1]) if len(rest) > 1 else 1.0
        files = [sinks.write_rasters(df.withColumn("value", F.col(c)), sizes, f"{prefix}-{c[0].upper()}_{short}_{scale:.2f}.{ending}", fmt, dataset=run.hdf5_dataset) for c in ("contrast", "scale", "luminance")]
    elif name == "dmp":
        planes = df.agg(F.max("k")).first()[0] or 1
        files = [sinks.write_rasters(df, sizes, f"{prefix}{stem}.fits", "fits", floats=True, planes=int(planes))]
    elif name == "check":
        files = [sinks.write_rasters(df, sizes, f"{prefix}{stem}.fits", "fits", floats=True)]
    else:
        files = [sinks.write_rasters(df, sizes, f"{prefix}{stem}.{ending}", fmt, dataset=run.hdf5_dataset)]
    for one in files:
        for r in one.collect():  # a row a file
            log.info("wrote %s, %d bytes", r.path, r.bytes)


def execute(spark: SparkSession, run: Run, pixels: DataFrame | None = None) -> list[tuple[tuple, DataFrame]]:
    """(operation, result) for each operation; they share one persisted tree. No operation: the pixels themselves, in the
    output's format. Results are written if ``save_output`` and ``output_name`` say so, and the tree with ``save_tree``."""
    began = time.time()

    def phase(what: str) -> None:
        nonlocal began
        log.log(TIMING, "%s: %.3f s", what, time.time() - began)
        began = time.time()

    log.setLevel(LEVELS.get(run.verbosity.upper(), logging.INFO))
    pixels = read_pixels(spark, run) if pixels is None else pixels
    ready = preprocess(pixels, run.preprocessing, run.tree_type)
    save = bool(run.save_output and run.output_name)
    sizes = sinks.extents(ready) if save else None
    many = save and sinks.several_images(ready)
    phase("input")
    if not run.operation:
        if save:
            _written(run, (), ready.withColumn("value", F.col("g")), sizes, many)
            phase("output")
        return [((), ready)]
    if max(run.mpi_grid) > 1:
        size = ready.agg(F.max("x"), F.max("y"), F.max("z")).first()
        tile = tuple(-(-(int(s) + 1) // n) for s, n in zip(size, run.mpi_grid))
        tree = build_tree_tiled(ready, tile, run.pixel_connectivity).persist()
    else:
        tree = build_tree(ready, run.pixel_connectivity).persist()
    gmax = extrema(ready.withColumn("g", F.col("gmax"))).select("image_id", "gmax") if run.tree_type == "min" else None
    pd, back = run.pixel_dim, bool(run.include_background)
    out = []
    for op in run.operation:
        name, a, *rest = op
        if name == "filter":
            df = Q.filter_image(tree, a, rest[0], rest[1] if len(rest) > 1 else 0, pd)
            if gmax is not None:
                df = df.join(gmax, "image_id").withColumn("value", F.col("gmax") - F.col("value")).drop("gmax")
        elif name == "extract":
            df = Q.extract_image(tree, a, rest[0], rest[1] if len(rest) > 1 else 0, pd)
        elif name == "dmp":
            df = Q.dmp_image(tree, a, _lambdas(spark, rest[0]), rest[1] if len(rest) > 1 else 1.0, pd)
        elif name == "csl":
            df = Q.csl_image(tree, a, _lambdas(spark, rest[0]), rest[1] if len(rest) > 1 else 1.0, pd)
        elif name == "pattern":
            df = Q.pattern_spectrum(tree, a, _lambdas(spark, rest[0]), rest[1] if len(rest) > 1 else 1.0, pd, back)
        elif name == "pattern2D":
            df = Q.pattern_spectrum_2d(tree, a, _lambdas(spark, rest[0]), rest[2], _lambdas(spark, rest[3]), rest[1], rest[4], pd, back)
        elif name == "tree":
            size = ready.agg(F.max("x"), F.max("y")).first()
            df = Q.tree_table(tree, a, int(size[0]) + 1, int(size[1]) + 1, pd)
        else:
            df = Q.check_image(tree, a, pd)
        if save:
            _written(run, op, df, sizes, many)
        phase(f"{name} {attribute(a).name}")
        out.append((op, df))
    if run.save_tree and run.output_name:
        base = run.output_name.rpartition(".")[0] or run.output_name
        tree.nodes.write.mode("overwrite").parquet(f"{base}_nodes")
        tree.zones.write.mode("overwrite").parquet(f"{base}_zones")
        phase("tree")
    return out


def main(args: list[str] | None = None) -> int:
    """Run what flags and configuration say; with ``interactive``, then read further operations from the standard input."""
    run = parse_args(sys.argv[1:] if args is None else args)
    logging.basicConfig(stream=sys.stderr, format="%(levelname)s %(message)s")
    builder = SparkSession.builder.appName("arboretica")
    if run.threads > 1 and SparkSession.getActiveSession() is None:
        builder = builder.config("spark.default.parallelism", run.threads)
    spark = builder.getOrCreate()
    for op, df in execute(spark, run):
        print(op, df.count(), "rows")
    for line in sys.stdin if run.interactive else ():
        if not line.strip():
            break
        try:
            for op, df in execute(spark, make_run(run, operation=parse_value(line.strip()))):
                print(op, df.count(), "rows")
        except ValueError as e:
            print(e, file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
