"""The tree queries: filter, extract, dmp, csl, pattern, pattern2D, tree and check, as DataFrame code over a tree's nodes.

What a node becomes follows from the nodes above it: a fold along its path (``paths``), linear in nodes but for a logarithm of
the depth. Pixels are reached last, by one join of zones with values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.attributes import ATTRIBUTES, attribute, attribute_column, check_lambdas, csl_scale_index, scale_index
from .paths import down, down_best, marked_above
from .tree import Tree, spread

RULES = ("direct", "min", "max", "subtractive")
Dims = tuple[float, float, float]
ONE: Dims = (1.0, 1.0, 1.0)


def _rule(rule: int | str) -> str:
    name = RULES[rule] if isinstance(rule, int) and 0 <= rule < len(RULES) else str(rule).lower()
    if name not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    return name


def _with_attr(tree: Tree, attr: int | str, pixel_dim: Dims) -> DataFrame:
    return tree.nodes.select("image_id", "node_id", "h", "parent_id", "parent_h", attribute_column(attr, pixel_dim).alias("attr"))


def filter_nodes(tree: Tree, attr: int | str, lam: float, rule: int | str = "direct", pixel_dim: Dims = ONE) -> DataFrame:
    """Rows ``(image_id, node_id, value)``: what a node's pixels become when nodes with ``attr < lam`` are pruned.

    direct: the highest passing level on the node's path, else 0. subtractive: the sum of the passing steps. min: the level
    below the lowest failing step, the root's zone aside. max: as direct, where a node also passes if a descendant does.
    A null attribute (a weighted mean without weight) fails.
    """
    rule, nodes = _rule(rule), _with_attr(tree, attr, pixel_dim)
    ok, inner = F.col("ok"), F.col("parent_h").isNotNull()
    nodes = nodes.withColumn("ok", F.coalesce(F.col("attr") >= float(lam), F.lit(False)))
    if rule == "max":
        nodes = marked_above(nodes, "ok", tree.tiled)
    if rule == "subtractive":
        own, fold = F.when(ok, F.col("h") - F.coalesce("parent_h", F.lit(0.0))), "sum"
    elif rule == "min":
        own, fold = F.when(~ok & inner, F.col("parent_h")), "min"
    else:
        own, fold = F.when(ok, F.col("h")), "max"
    found = down(nodes.withColumn("own", own), {"value": (fold, "own")}, tiled=tree.tiled)
    value = F.coalesce("value", F.lit(0.0))
    if rule == "min":
        value = F.when(inner, F.coalesce("value", "h")).otherwise(F.when(ok, F.col("h")).otherwise(0.0))
    return found.select("image_id", "node_id", value.alias("value"))


def filter_image(tree: Tree, attr: int | str, lam: float, rule: int | str = "direct", pixel_dim: Dims = ONE, gmax: Column | None = None) -> DataFrame:
    """Rows ``(image_id, idx, value)``; ``gmax`` undoes the inversion of a min-tree."""
    out = spread(filter_nodes(tree, attr, lam, rule, pixel_dim), tree)
    return out if gmax is None else out.withColumn("value", gmax - F.col("value"))


def extract_image(tree: Tree, attr: int | str, lam: float, rule: int | str = "direct", pixel_dim: Dims = ONE) -> DataFrame:
    """Rows ``(image_id, idx, value)``: the top-hat, what the filter takes away."""
    kept = filter_nodes(tree, attr, lam, rule, pixel_dim).join(tree.nodes.select("image_id", "node_id", "h"), ["image_id", "node_id"])
    return spread(kept.select("image_id", "node_id", (F.col("h") - F.col("value")).alias("value")), tree)


def dmp_image(tree: Tree, attr: int | str, lambdas: Sequence[float], imscale: float = 1.0, pixel_dim: Dims = ONE, differential: bool = False) -> DataFrame:
    """Rows ``(image_id, idx, k, lambda, value)``: a top-hat for each threshold, all in one pass over the paths.

    ``differential`` gives the differences of successive top-hats instead.
    """
    lams = check_lambdas(lambdas, imscale)[1:]
    nodes = _with_attr(tree, attr, pixel_dim).withColumns({f"own{k}": F.when(F.col("attr") >= lam, F.col("h")) for k, lam in enumerate(lams)})
    found = down(nodes, {f"kept{k}": ("max", f"own{k}") for k in range(len(lams))}, tiled=tree.tiled)
    planes = [F.col("h") - F.coalesce(F.col(f"kept{k}"), F.lit(0.0)) for k in range(len(lams))]
    if differential:
        planes = [planes[0], *(b - a for a, b in zip(planes, planes[1:]))]
    rows = F.array(*[F.struct(F.lit(k + 1).alias("k"), F.lit(lam).alias("lambda"), p.alias("value")) for k, (lam, p) in enumerate(zip(lams, planes))])
    return spread(found.select("image_id", "node_id", rows.alias("planes")), tree).select("image_id", "idx", F.inline("planes"))


def csl_nodes(tree: Tree, attr: int | str, lambdas: Sequence[float], imscale: float = 1.0, pixel_dim: Dims = ONE) -> DataFrame:
    """Rows ``(image_id, node_id, contrast, scale, luminance)`` of the contrast, scale and luminance segmentation.

    Along a path from the last reset node (the root, or a node from the last threshold on), steps of one scale add up; the
    scale whose sum was the largest at some node wins, the deeper one among equals.
    """
    lams = check_lambdas(lambdas, imscale)
    ns = len(lams)
    nodes = _with_attr(tree, attr, pixel_dim).withColumn("scale", csl_scale_index(F.col("attr"), lams))
    above = nodes.select("image_id", F.col("node_id").alias("parent_id"), F.col("scale").alias("up_scale"))
    nodes = nodes.join(above, ["image_id", "parent_id"], "left")
    root = F.col("parent_h").isNull()
    nodes = nodes.select(
        "image_id", "node_id", "parent_id", ((F.col("scale") == ns) | root).alias("reset"), (F.coalesce(F.col("scale") != F.col("up_scale"), F.lit(True)) | (F.col("scale") == ns)).alias("begins"),
        F.when((F.col("scale") == ns) & ~root, F.lit(0.0)).otherwise(F.col("h")).alias("luminance"), F.when(root | (F.col("scale") == ns), F.lit(0.0)).otherwise(F.col("h") - F.col("parent_h")).alias("dh"),
        "scale",
    )
    sums = down(nodes, {"contrast": ("sum", "dh")}, "begins", tree.tiled)
    return down_best(sums, "contrast", ("scale", "luminance"), "reset", tree.tiled).select("image_id", "node_id", "contrast", "scale", "luminance")


def csl_image(tree: Tree, attr: int | str, lambdas: Sequence[float], imscale: float = 1.0, pixel_dim: Dims = ONE) -> DataFrame:
    return spread(csl_nodes(tree, attr, lambdas, imscale, pixel_dim), tree)


def csl_combine(opening: DataFrame, closing: DataFrame, n_lambdas: int, gmax: Column) -> DataFrame:
    """The larger contrast of the max-tree's and the min-tree's segmentation; the closing's scales follow behind the opening's.

    Equal contrasts have scale 0. ``n_lambdas`` counts the thresholds with the 0 before them.
    """
    o, c = opening.alias("o"), closing.alias("c")
    joined = o.join(c, [F.col("o.image_id") == F.col("c.image_id"), F.col("o.idx") == F.col("c.idx")])
    bright, dark = F.col("o.contrast") > F.col("c.contrast"), F.col("o.contrast") < F.col("c.contrast")
    return joined.select(
        "o.image_id", "o.idx", F.greatest("o.contrast", "c.contrast").alias("contrast"),
        F.when(bright, F.col("o.scale")).when(dark, F.lit(n_lambdas + 1) + F.col("c.scale")).otherwise(0).alias("scale"),
        F.when(dark, gmax - F.col("c.luminance")).otherwise(F.col("o.luminance")).alias("luminance"),
    )


def _steps(tree: Tree, background: bool) -> DataFrame:
    low = F.lit(0.0) if background else F.col("h")
    return tree.nodes.withColumn("mass", (F.col("h") - F.coalesce(F.col("parent_h"), low)) * F.col("area"))


def _bins(tree: Tree, sizes: list[int]) -> DataFrame:
    """Every bin of every image, so that empty ones have a row; bins are as many as thresholds, whatever the data."""
    out = tree.nodes.where("parent_id IS NULL").select("image_id").distinct()
    for i, n in enumerate(sizes):
        out = out.withColumn(f"k{i + 1}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out


def pattern_spectrum(tree: Tree, attr: int | str, lambdas: Sequence[float], imscale: float = 1.0, pixel_dim: Dims = ONE, include_background: bool = True) -> DataFrame:
    """Rows ``(image_id, k, lambda, spectrum)``: the mass of each node's step, summed by the scale of its attribute."""
    lams = check_lambdas(lambdas, imscale)
    rows = _steps(tree, include_background).withColumn("k1", scale_index(attribute_column(attr, pixel_dim), lams)).groupBy("image_id", "k1").agg(F.sum("mass").alias("s"))
    full = _bins(tree, [len(lams)]).join(rows, ["image_id", "k1"], "left")
    return full.select("image_id", F.col("k1").alias("k"), F.element_at(F.array(*map(F.lit, lams)), F.col("k1") + 1).alias("lambda"), F.coalesce("s", F.lit(0.0)).alias("spectrum"))


def pattern_spectrum_2d(tree: Tree, attr1: int | str, lambdas1: Sequence[float], attr2: int | str, lambdas2: Sequence[float], imscale1: float = 1.0, imscale2: float = 1.0, pixel_dim: Dims = ONE, include_background: bool = True) -> DataFrame:
    """Rows ``(image_id, k1, k2, lambda1, lambda2, spectrum)`` over two attributes of any groups."""
    l1, l2 = check_lambdas(lambdas1, imscale1), check_lambdas(lambdas2, imscale2)
    rows = _steps(tree, include_background).withColumns({"k1": scale_index(attribute_column(attr1, pixel_dim), l1), "k2": scale_index(attribute_column(attr2, pixel_dim), l2)})
    rows = rows.groupBy("image_id", "k1", "k2").agg(F.sum("mass").alias("s"))
    full = _bins(tree, [len(l1), len(l2)]).join(rows, ["image_id", "k1", "k2"], "left")
    at = lambda ls, k: F.element_at(F.array(*map(F.lit, ls)), F.col(k) + 1)
    return full.select("image_id", "k1", "k2", at(l1, "k1").alias("lambda1"), at(l2, "k2").alias("lambda2"), F.coalesce("s", F.lit(0.0)).alias("spectrum"))


# The columns of a tree dump by group of attributes, and the attributes they show.
TREE_COLUMNS = {
    0: {},
    1: {"area_enc_rect": "rectarea", "diag_enc_rect": "rectdiag", "x_extent": "xext", "y_extent": "yext", "z_extent": "zext"},
    2: {"x_mean": "xmean", "y_mean": "ymean", "z_mean": "zmean"},
    3: {"x_wmean": "xwmean", "y_wmean": "ywmean", "z_wmean": "zwmean"},
    4: {"x_mean": "xmean", "y_mean": "ymean", "z_mean": "zmean", "x_wmean": "xwmean", "y_wmean": "ywmean", "z_wmean": "zwmean", "elong": "elong", "flat": "flat", "spars": "spars", "ncomp": "ncomp"},
}


def tree_table(tree: Tree, attr: int | str, width: int, height: int, pixel_dim: Dims = ONE) -> DataFrame:
    """A row for each node with the columns of the attribute's group; parents are canonical ids, -1 above the root."""
    i = F.col("node_id")
    return tree.nodes.select(
        "image_id", i.alias("index"), (i % width).alias("x"), (F.floor(i / width) % height).alias("y"), F.floor(i / (width * height)).alias("z"),
        F.col("h").alias("gval"), F.coalesce("parent_id", F.lit(-1)).alias("parent"), ((F.col("h") - F.coalesce("parent_h", F.lit(0.0))) * F.col("area")).alias("flux"), "area",
        *[attribute_column(a, pixel_dim).alias(c) for c, a in TREE_COLUMNS[attribute(attr).group].items()],
    )


def check_image(tree: Tree, attr: int | str, pixel_dim: Dims = ONE) -> DataFrame:
    """Rows ``(image_id, idx, value)``: each pixel's node's attribute."""
    return spread(tree.nodes.select("image_id", "node_id", attribute_column(attr, pixel_dim).alias("value")), tree)


def attribute_table(tree: Tree, pixel_dim: Dims = ONE) -> DataFrame:
    """All attributes of all nodes, from one tree: what several queries share."""
    return tree.nodes.select("image_id", "node_id", "h", "parent_id", *[a.value(pixel_dim).alias(n) for n, a in ATTRIBUTES.items()])
