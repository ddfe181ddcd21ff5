"""Values along the paths of trees: folds from the root down to each node, and marks from nodes up to the root.

Both double their step in each round, so a tree of depth d takes log2(d) rounds and no row ever holds a path. Two ways:
images whose nodes fit a task go through numpy, many of them a task; a tiled tree's nodes never meet in a task, and rounds
are joins of narrow rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: How a fold joins what comes from above with a node's own value; nulls count as nothing.
FOLDS = ("max", "min", "sum")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the cluster's shared folder (``spark.checkpoint.dir``).

    A folder of this machine stands in where the setting is missing, in local mode only."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
            shared = "file://" + tempfile.mkdtemp(prefix="arboretica-")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


# ---- in one task

def whole_images(kernel: Callable[[pd.DataFrame], pd.DataFrame], rows: int = 20_000) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A ``mapInPandas`` function that hands ``kernel`` whole images, several at a time, of rows sorted by image."""
    def run(batches):
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= rows:
                every = pd.concat(held, ignore_index=True)
                end = int((every["image_id"].to_numpy() == every["image_id"].iloc[-1]).argmax())  # the last image may go on
                if end:
                    yield kernel(every[:end])
                held, size = [every[end:]], len(every) - end
        if size:
            yield kernel(pd.concat(held, ignore_index=True))

    return run


def row_of_parent(image: np.ndarray, node: np.ndarray, parent: pd.Series) -> np.ndarray:
    """The row of each row's parent, -1 at roots; rows are sorted by image and node."""
    first = np.concatenate([[True], image[1:] != image[:-1]]) if len(image) else np.zeros(0, bool)
    number = np.cumsum(first) - 1
    begin, end = np.flatnonzero(first), np.concatenate([np.flatnonzero(first)[1:], [len(image)]])
    has = parent.notna().to_numpy() & (parent.fillna(-1).to_numpy(np.int64) >= 0)
    want = parent.fillna(-1).to_numpy(np.int64)
    if len(begin) == 1:
        return np.where(has, np.searchsorted(node, want), -1)
    low, high = begin[number], end[number]  # a binary search for all rows at once, each within its image
    while (low < high).any():
        mid = (low + high) // 2
        right = (low < high) & (node[np.minimum(mid, len(node) - 1)] < want)
        low, high = np.where(right, mid + 1, low), np.where(right | (low >= high), high, mid)
    return np.where(has, low, -1)


def fold_down(up: np.ndarray, values: Sequence[np.ndarray], joins: Sequence[Callable], stop: np.ndarray | None = None) -> list[np.ndarray]:
    """For each row, ``join(above, own)`` over the rows from the root, or from the nearest row of ``stop``, to it."""
    at = up.copy()
    if stop is not None:
        at[stop] = -1
    out = [v.copy() for v in values]
    rows = np.flatnonzero(at >= 0)
    while len(rows):
        to = at[rows]
        new = [join(v[to], v[rows]) for v, join in zip(out, joins)]
        at[rows] = at[to]
        for v, x in zip(out, new):
            v[rows] = x
        rows = rows[at[rows] >= 0]
    return out


def depths(up: np.ndarray) -> np.ndarray:
    return fold_down(up, [(up >= 0).astype(np.int64)], [np.add])[0]


#: Levels beyond which sums rise by doubling: a step per level would cost more than log2(levels) steps over all rows.
MANY_LEVELS = 500


def rise(up: np.ndarray, columns: dict[str, np.ndarray], add: dict[str, Callable]) -> dict[str, np.ndarray]:
    """Each row's values joined with those of all rows below it; ``add`` gives the unbuffered operation of each column."""
    out = {c: v.copy() for c, v in columns.items()}
    depth = depths(up)
    levels = int(depth.max(initial=0))
    if levels <= MANY_LEVELS:
        order = np.argsort(depth, kind="stable")
        ends = np.cumsum(np.bincount(depth, minlength=levels + 1))
        for level in range(levels, 0, -1):  # all rows of a depth at once
            rows = order[ends[level - 1] : ends[level]]
            to = up[rows]
            for c, v in out.items():
                add[c].at(v, to, v[rows])
        return out
    at = up.copy()
    rows = np.flatnonzero(at >= 0)
    while len(rows):
        to = at[rows]
        for c, v in out.items():
            add[c].at(v, to, v[rows])
        at[rows] = at[to]
        rows = rows[at[rows] >= 0]
    return out


def _joins(kinds: Sequence[str]) -> list[Callable]:
    return [{"max": np.fmax, "min": np.fmin, "sum": np.add}[k] for k in kinds]


def _best(key: np.ndarray) -> Callable:
    """Row numbers: the row of the greatest key, the lower one of the path among equals."""
    return lambda above, own: np.where(key[above] > key[own], above, own)


# ---- the operators over tables of nodes

def _grouped(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("image_id").sortWithinPartitions("image_id", "node_id")


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def down(nodes: DataFrame, folds: dict[str, tuple[str, str]], stop: str | None = None, tiled: bool = False) -> DataFrame:
    """Adds columns of doubles: ``folds`` maps each to (kind of FOLDS, column), joined along the path from the root, or from
    the nearest node whose boolean ``stop`` is true, down to the node. Needs ``image_id, node_id, parent_id``."""
    if tiled:
        first = {o: F.coalesce(F.col(c).cast("double"), F.lit(0.0 if k == "sum" else None)) for o, (k, c) in folds.items()}
        return _down_joined(nodes, {o: (first[o], _combined(k)) for o, (k, _) in folds.items()}, stop)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        up = row_of_parent(pdf["image_id"].to_numpy(), pdf["node_id"].to_numpy(), pdf["parent_id"])
        values = [pdf[c].to_numpy(float, na_value=np.nan) for _, c in folds.values()]
        values = [np.nan_to_num(v) if k == "sum" else v for v, (k, _) in zip(values, folds.values())]
        got = fold_down(up, values, _joins([k for k, _ in folds.values()]), pdf[stop].to_numpy(bool) if stop else None)
        return pdf.assign(**dict(zip(folds, got)))

    out = _grouped(nodes).mapInPandas(whole_images(kernel), _schema(nodes, *(f"`{o}` double" for o in folds)))
    return out.select(*nodes.columns, *(F.nanvl(o, F.lit(None)).alias(o) for o in folds))


def down_best(nodes: DataFrame, key: str, payload: Sequence[str], stop: str, tiled: bool = False) -> DataFrame:
    """Each node's ``key`` and ``payload`` become those of the node of the greatest key between the nearest ``stop`` and it;
    the lower one of equals."""
    if tiled:
        best = lambda above, own: F.when(above[key] > own[key], above).otherwise(own)
        out = _down_joined(nodes, {"__best": (F.struct(key, *payload), best)}, stop)
        return out.select(*[F.col(f"__best.{c}").alias(c) if c in (key, *payload) else F.col(c) for c in nodes.columns])

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        up = row_of_parent(pdf["image_id"].to_numpy(), pdf["node_id"].to_numpy(), pdf["parent_id"])
        row = fold_down(up, [np.arange(len(pdf))], [_best(pdf[key].to_numpy(float))], pdf[stop].to_numpy(bool))[0]
        return pdf.assign(**{c: pdf[c].to_numpy()[row] for c in (key, *payload)})

    return _grouped(nodes).mapInPandas(whole_images(kernel), _schema(nodes))


def marked_above(nodes: DataFrame, flag: str, tiled: bool = False) -> DataFrame:
    """Makes the boolean ``flag`` true at every node that has a node below it, or is one, whose flag is true."""
    if tiled:
        return _marked_joined(nodes, flag)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        up = row_of_parent(pdf["image_id"].to_numpy(), pdf["node_id"].to_numpy(), pdf["parent_id"])
        return pdf.assign(**{flag: rise(up, {flag: pdf[flag].to_numpy(bool)}, {flag: np.logical_or})[flag]})

    return _grouped(nodes).mapInPandas(whole_images(kernel), _schema(nodes))


def _combined(kind: str):
    if kind == "sum":
        return lambda above, own: above + own
    return F.greatest if kind == "max" else F.least  # both leave out nulls


def _rounds(state: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Repeats ``step`` until no row has a node above it to look at."""
    state = cut(state)
    while state.where("__at IS NOT NULL").limit(1).count():
        state = cut(step(state))
    return state


def _down_joined(nodes: DataFrame, folds: dict[str, tuple[Column, Callable]], stop: str | None) -> DataFrame:
    at = F.when(~F.col(stop), F.col("parent_id")).otherwise(F.lit(None).cast("long")) if stop else F.col("parent_id")
    state = nodes.withColumns({"__at": at, **{o: c for o, (c, _) in folds.items()}})

    def step(now: DataFrame) -> DataFrame:
        above = now.select("image_id", F.col("node_id").alias("__at"), F.col("__at").alias("__next"), *(F.col(o).alias(f"__up_{o}") for o in folds))
        both = now.join(above, ["image_id", "__at"], "left")
        joined = {o: F.when(F.col("__at").isNotNull(), join(F.col(f"__up_{o}"), F.col(o))).otherwise(F.col(o)).alias(o) for o, (_, join) in folds.items()}
        return both.select(*nodes.columns, F.col("__next").alias("__at"), *joined.values())

    return _rounds(state, step).drop("__at")


def _marked_joined(nodes: DataFrame, flag: str) -> DataFrame:
    """A round marks the nodes 1, 2, 4, ... steps above marked ones, so that all on the way are marked in the end."""
    state = cut(nodes.select("image_id", "node_id", F.col("parent_id").alias("__at"), F.col(flag).alias("__on")))
    while state.where("__at IS NOT NULL AND __on").limit(1).count():
        hit = state.where("__on AND __at IS NOT NULL").select("image_id", F.col("__at").alias("node_id")).distinct().withColumn("__hit", F.lit(True))
        ahead = state.select("image_id", F.col("node_id").alias("__at"), F.col("__at").alias("__next"))
        state = state.join(hit, ["image_id", "node_id"], "left").join(ahead, ["image_id", "__at"], "left")
        state = cut(state.select("image_id", "node_id", F.col("__next").alias("__at"), (F.col("__on") | F.coalesce("__hit", F.lit(False))).alias("__on")))
    marked = state.select("image_id", "node_id", "__on")
    return nodes.join(marked, ["image_id", "node_id"]).select(*[F.col("__on").alias(c) if c == flag else F.col(c) for c in nodes.columns])
