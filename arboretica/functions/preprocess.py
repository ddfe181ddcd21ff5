"""Per-pixel maths before the tree: rescaling, transforms, inversion for min-trees, index to place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MODES = ("None", "ubyte", "ushort", "uint", "log", "log10", "exp", "sqrt")
_BITS = {"ubyte": 8, "ushort": 16, "uint": 32}


def extrema(pixels: DataFrame) -> DataFrame:
    """Least and greatest value of each image."""
    return pixels.groupBy("image_id").agg(F.min("g").alias("gmin"), F.max("g").alias("gmax"))


def _with_extrema(pixels: DataFrame) -> DataFrame:
    # one narrow row an image; the optimizer picks a broadcast where it is small
    return pixels.join(extrema(pixels), "image_id")


def preprocess(pixels: DataFrame, mode: str = "None", tree_type: str = "max") -> DataFrame:
    """Rescale, invert for a min-tree, transform; ``g_orig`` keeps the value before inversion and transform.

    Rescaling maps the extrema to 0 and 2^bits - 1 without rounding (a constant image becomes 0) and comes before the
    inversion ``g = gmax - g``; logarithms, roots and exponentials come after it, on the inverted values. For a min-tree
    ``gmax`` is what undoes the inversion: the greatest value before it, or after a transform the greatest transformed one.
    Values that a logarithm or root does not have become null, and the tree leaves such pixels out.
    """
    if mode not in MODES:
        raise ValueError(f"preprocessing must be one of {MODES}, not {mode!r}")
    if tree_type not in ("max", "min"):
        raise ValueError("tree_type must be max or min")
    pixels = pixels.withColumn("g", F.col("g").cast("double"))
    g = F.col("g")
    if mode in _BITS:
        span = F.col("gmax") - F.col("gmin")
        scaled = F.when(span > 0, (g - F.col("gmin")) * float(2 ** _BITS[mode] - 1) / span).otherwise(0.0)
        pixels = _with_extrema(pixels).withColumn("g", scaled).drop("gmin", "gmax")
    pixels = pixels.withColumn("g_orig", g)
    if tree_type == "min":
        pixels = _with_extrema(pixels).withColumn("g", F.col("gmax") - g).drop("gmin")
    change = {"log": F.when(g > 0, F.log(g)), "log10": F.when(g > 0, F.log10(g)), "sqrt": F.when(g >= 0, F.sqrt(g)), "exp": F.exp(g)}.get(mode)
    if change is not None:
        pixels = pixels.withColumn("g", change)
        if tree_type == "min":
            pixels = _with_extrema(pixels.drop("gmax")).drop("gmin")
    return pixels


def place(idx: Column, width: int, height: int) -> tuple[Column, Column, Column]:
    """x, y and z of a linear index."""
    return (idx % width).cast("int"), (F.floor(idx / width) % height).cast("int"), F.floor(idx / (width * height)).cast("int")
