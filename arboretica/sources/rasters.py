"""Rasters from tables: cells of grouped facts, vectors as images, mosaics of tiles, stacks and colour channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def full_grid(cells: DataFrame, width: int, height: int, depth: int = 1) -> DataFrame:
    """``pixels`` of one image from rows ``(x, y, z, s)``: missing cells are 0, ``idx = x + y*width + z*width*height``."""
    n = width * height * depth
    grid = cells.sparkSession.range(n).select(F.col("id").alias("idx"), (F.col("id") % width).cast("int").alias("x"), (F.floor(F.col("id") / width) % height).cast("int").alias("y"), F.floor(F.col("id") / (width * height)).cast("int").alias("z"))
    return grid.join(cells, ["x", "y", "z"], "left").select(F.lit(0).cast("long").alias("image_id"), "idx", "x", "y", "z", F.coalesce("s", F.lit(0)).cast("double").alias("g"))


def from_facts(facts: DataFrame, x: Column, y: Column, value: Column, width: int, height: int, z: Column | None = None, depth: int = 1) -> DataFrame:
    """``pixels`` of one image: an aggregate ``value`` of the facts of every cell. One scan of the columns that are named."""
    keyed = facts.withColumns({"x": x.cast("int"), "y": y.cast("int"), "z": (F.lit(0) if z is None else z).cast("int")})
    return full_grid(keyed.groupBy("x", "y", "z").agg(value.alias("s")), width, height, depth)


def quantise(pixels: DataFrame, levels: int) -> DataFrame:
    """Values as whole levels 0..levels-1 over each image's extrema."""
    span = pixels.groupBy("image_id").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
    return pixels.join(span, "image_id").withColumn("g", F.floor(levels * (F.col("g") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)).cast("double")).drop("lo", "hi")


def from_vectors(vectors: DataFrame, width: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``pixels`` of one image per vector, row by row."""
    return vectors.select(F.col(id_col).cast("long").alias("image_id"), F.posexplode(vector_col).alias("p", "g")).select(
        "image_id", F.col("p").cast("long").alias("idx"), (F.col("p") % width).alias("x"), F.floor(F.col("p") / width).cast("int").alias("y"), F.lit(0).alias("z"), F.col("g").cast("double").alias("g")
    )


# The shares of red, green and blue in luminance.
LUMINANCE = {"R": 0.2126, "G": 0.7152, "B": 0.0722}


def luminance(red: DataFrame, green: DataFrame, blue: DataFrame) -> DataFrame:
    """One gray raster of three channels, by a single grouped sum (no joins); pixels that a channel lacks count 0 there."""
    rows = None
    for channel, share in zip((red, green, blue), LUMINANCE.values()):
        own = channel.withColumn("g", F.col("g") * share)
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("image_id", "idx", "x", "y", "z").agg(F.sum("g").alias("g"))


def mosaic(tiles: DataFrame, grid: tuple[int, int, int], tile_size: tuple[int, int, int], overlap: int = 0) -> DataFrame:
    """One image from tiles: rows ``(image_id, tile, x, y, z, g)`` with places inside the tile, tile = col + row*gx + layer*gx*gy.

    With ``overlap``, a tile repeats that many pixels of its neighbours; repeated pixels count once.
    """
    (gx, gy, gz), (w, h, d) = grid, tile_size
    col, row, layer = F.col("tile") % gx, F.floor(F.col("tile") / gx) % gy, F.floor(F.col("tile") / (gx * gy))
    placed = tiles.select(
        "image_id",
        (F.col("x") + col * w - F.when(col > 0, overlap).otherwise(0)).cast("int").alias("x"),
        (F.col("y") + row * h - F.when(row > 0, overlap).otherwise(0)).cast("int").alias("y"),
        (F.col("z") + layer * d - F.when(layer > 0, overlap).otherwise(0)).cast("int").alias("z"), "g",
    ).where((F.col("x") < gx * w) & (F.col("y") < gy * h) & (F.col("z") < gz * d))
    one = placed.groupBy("image_id", "x", "y", "z").agg(F.max("g").alias("g"))
    return one.select("image_id", (F.col("x") + F.col("y") * (gx * w) + F.col("z") * (gx * w * gy * h)).cast("long").alias("idx"), "x", "y", "z", "g")


def split_tiles(pixels: DataFrame, tile_size: tuple[int, int, int], grid: tuple[int, int, int]) -> DataFrame:
    """The inverse of ``mosaic`` without overlap; the last tile of an axis takes what is left over."""
    (w, h, d), (gx, gy, gz) = tile_size, grid
    col, row, layer = (F.least(F.floor(F.col(c) / n), F.lit(g - 1)).cast("int") for c, n, g in (("x", w, gx), ("y", h, gy), ("z", d, gz)))
    return pixels.select("image_id", (col + row * gx + layer * gx * gy).alias("tile"), (F.col("x") - col * w).alias("x"), (F.col("y") - row * h).alias("y"), (F.col("z") - layer * d).alias("z"), "g")


def stack(slices: list[DataFrame]) -> DataFrame:
    """A volume of 2-D rasters of one size, in order along z (slices, channels, or slice-major both)."""
    out = None
    for z, one in enumerate(slices):
        own = one.withColumn("z", F.lit(z)).withColumn("n", F.lit(z))
        out = own if out is None else out.unionByName(own)
    size = slices[0].groupBy("image_id").agg((F.max("idx") + 1).alias("size"))
    return out.join(size, "image_id").withColumn("idx", F.col("idx") + F.col("n") * F.col("size")).drop("n", "size")


def stack_images(pixels: DataFrame, order: DataFrame) -> DataFrame:
    """One volume of the 2-D images of ``pixels``, placed along z by ``order(image_id, n)``: however many, one plan."""
    size = pixels.groupBy("image_id").agg(((F.max("x") + 1) * (F.max("y") + 1)).cast("long").alias("size"))
    placed = pixels.join(order.join(size, "image_id"), "image_id")
    return placed.select(F.lit(0).cast("long").alias("image_id"), (F.col("idx") + F.col("n") * F.col("size")).alias("idx"), "x", "y", F.col("n").cast("int").alias("z"), "g")
