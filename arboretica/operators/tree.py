"""Component trees of gray-level rasters: the one custom operator, whole or in tiles.

A node is a connected component of the pixels at or above a level that some pixel of it has; its id is the smallest index
of such a pixel. A tree is a table of nodes, with their parents and the sums that all attributes derive from, and a table of
zones, the pixels of each node's own level. Everything else in the library is DataFrame code over these two.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .paths import cut, rise, whole_images

CONNECTIVITIES = (4, 6, 8, 26)
#: The mergeable sums of a node; each begins at its own pixels and grows by its children's.
ADDED = ("area", "sx", "sy", "sz", "sg", "sgx", "sgy", "sgz", "sxx", "syy", "szz", "sxy", "syz", "sxz", "sg2")
LEAST, MOST = ("minx", "miny", "minz"), ("maxx", "maxy", "maxz")
_LONGS = ("area", "sx", "sy", "sz", "sxx", "syy", "szz", "sxy", "syz", "sxz", *LEAST, *MOST)
SUMS = (*ADDED, *LEAST, *MOST)
SUMS_SCHEMA = ", ".join(f"{c} {'long' if c in _LONGS else 'double'}" for c in SUMS)
NODE_SCHEMA = f"image_id long, node_id long, h double, parent_id long, parent_h double, is3d boolean, {SUMS_SCHEMA}"
_JOIN = {**{c: np.add for c in ADDED}, **{c: np.minimum for c in LEAST}, **{c: np.maximum for c in MOST}}


@dataclass(frozen=True)
class Tree:
    """``nodes`` (NODE_SCHEMA), a row each, and ``zones(image_id, node_id, pixels)``: the pixels of a node's own level, in one
    row or, of a tiled tree, in a row a tile. Nodes of a ``tiled`` tree's image are never brought together in a task."""

    nodes: DataFrame
    zones: DataFrame
    tiled: bool = False
    kept: tuple[DataFrame, ...] = ()

    def persist(self) -> Tree:
        """Several queries will read it: its tables are computed once. ``unpersist`` lets them go."""
        for df in self.kept:
            df.persist()
        return self

    def unpersist(self) -> None:
        for df in self.kept:
            df.unpersist()

    def count(self) -> int:
        return self.nodes.count()


def check_connectivity(connectivity: int, is3d: bool) -> int:
    """The connectivity that a raster of two or three dimensions gets: 4 means 6 and 8 means 26 in 3-D, 6 and 26 mean 4 and 8 in 2-D."""
    if connectivity not in CONNECTIVITIES:
        raise ValueError(f"connectivity must be one of {CONNECTIVITIES}, not {connectivity}")
    if is3d:
        return {4: 6, 8: 26}.get(connectivity, connectivity)
    return {6: 4, 26: 8}.get(connectivity, connectivity)


def offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Half of the neighbourhood: each pair of neighbours once."""
    out = []
    for dz in (0, 1):
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                steps = abs(dx) + abs(dy) + abs(dz)
                if (dz, dy, dx) <= (0, 0, 0):
                    continue
                if steps == 1 or connectivity == 26 or (connectivity == 8 and dz == 0):
                    out.append((dx, dy, dz))
    return out


def _grid_edges(x: np.ndarray, y: np.ndarray, z: np.ndarray, connectivity: int, is3d: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of neighbouring pixels; pixels that are missing have no neighbours."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y, z = x - x.min() + 1, y - y.min() + 1, z - z.min() + 1
    w, h, d = x.max() + 2, y.max() + 2, z.max() + 2
    at = (z * h + y) * w + x
    if w * h * d <= 4 * len(x) + 1_000_000:
        grid = np.full(w * h * d, -1, np.int64)
        grid[at] = np.arange(len(x))
        find = grid.__getitem__
    else:  # sparse rasters
        order = np.argsort(at)
        keys = at[order]

        def find(k):
            i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            return np.where(keys[i] == k, order[i], -1)

    ps, qs = [], []
    for dx, dy, dz in offsets(check_connectivity(connectivity, is3d)):
        q = find(at + (dz * h + dy) * w + dx)
        ok = q >= 0
        ps.append(np.flatnonzero(ok))
        qs.append(q[ok])
    return np.concatenate(ps), np.concatenate(qs)


#: Edges of a level, in the mean, from which levels are taken as a whole; fewer are joined one by one.
EDGES_OF_A_LEVEL = 300


def component_tree(g: np.ndarray, ids: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For a graph with values g, ids and edges (p, q): the row of each vertex's canonical parent, its own row at a root.

    A component's canonical vertex is the one of smallest id at its lowest level; others of that level have it as parent, and
    it has the canonical vertex of the component around it. Vertices are numbered by value, at equal values by id, and joined
    to the components of higher levels (union-find), by whole levels where these are few and vertex by vertex where not.
    """
    n = len(g)
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((ids, g))  # ascending
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    a, b = rank[p], rank[q]
    low, high = np.minimum(a, b), np.maximum(a, b)
    by = np.argsort(low, kind="stable")
    low, high, value = low[by], high[by], g[order]
    begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    up = (_by_levels if len(low) >= EDGES_OF_A_LEVEL * len(begin) else _by_vertices)(value, begin, low, high)
    return order[up[rank]]


def _by_levels(value: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Canonical parents; a level's edges join components by hooking the greater root on the smaller until none differ."""
    n = len(value)
    root, up = np.arange(n), np.arange(n)
    cuts = np.searchsorted(low, [*begin, n])

    def find(x: np.ndarray) -> np.ndarray:
        r = root[x]
        while True:
            above = root[r]
            if (above == r).all():
                root[x] = r
                return r
            root[x] = r = root[above]

    ends = [*begin[1:], n]
    for k in range(len(begin) - 1, -1, -1):
        one, two = find(low[cuts[k] : cuts[k + 1]]), find(high[cuts[k] : cuts[k + 1]])
        met = np.unique(np.concatenate([one, two]))  # what stood alone before
        while True:
            apart = one != two
            one, two = one[apart], two[apart]
            if not len(one):
                break
            root[np.maximum(one, two)] = np.minimum(one, two)
            one, two = find(one), find(two)
        up[met] = find(met)
        own = np.arange(begin[k], ends[k])
        up[own] = find(own)
    return up


def _by_vertices(value: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Canonical parents; vertices are taken from the greatest number down."""
    n = len(value)
    first, higher = np.searchsorted(low, np.arange(n + 1)).tolist(), high.tolist()
    parent, root = list(range(n)), list(range(n))
    for v in range(n - 1, -1, -1):
        for k in range(first[v], first[v + 1]):
            u = higher[k]
            while root[u] != u:  # halving
                root[u] = root[root[u]]
                u = root[u]
            if u != v:
                root[u] = parent[u] = v
    up = np.array(parent)
    # a parent's number is below its child's: one pass settles it
    out, same = up.tolist(), (value[up] == value).tolist()
    for v in range(n):
        w = out[v]
        if same[w] and out[w] != w:
            out[v] = out[w]
    return np.array(out, np.int64)


def _own_sums(pdf: pd.DataFrame, zone: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """The sums over each flat zone's own pixels."""
    x, y, z, g = (pdf[c].to_numpy() for c in ("x", "y", "z", "g"))
    x, y, z = x.astype(np.int64), y.astype(np.int64), z.astype(np.int64)
    values = {"area": np.ones(len(x), np.int64), "sx": x, "sy": y, "sz": z, "sg": g, "sgx": g * x, "sgy": g * y, "sgz": g * z, "sxx": x * x, "syy": y * y, "szz": z * z, "sxy": x * y, "syz": y * z, "sxz": x * z, "sg2": g * g}
    order = np.argsort(zone, kind="stable")
    starts = np.searchsorted(zone[order], np.arange(n))
    out = {k: np.add.reduceat(v[order], starts) for k, v in values.items()}
    for axis, v in zip("xyz", (x, y, z)):
        out[f"min{axis}"] = np.minimum.reduceat(v[order], starts)
        out[f"max{axis}"] = np.maximum.reduceat(v[order], starts) + 1  # half-open
    return out


def _zones(pdf: pd.DataFrame, connectivity: int, is3d: bool, lift: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each node's levelroot, number of each pixel's node, number of each node's parent or -1); rows are sorted."""
    g = pdf["g"].to_numpy(float)
    x, y, z = (pdf[c].to_numpy(np.int64) for c in "xyz")
    p, q = _grid_edges(x, y, z + lift, connectivity, is3d)
    up = component_tree(g, np.arange(len(pdf)), p, q)  # rows are in the order of the index
    is_node = (g[up] != g) | (up == np.arange(len(g)))
    roots = np.flatnonzero(is_node)
    number = np.full(len(g), -1, np.int64)
    number[roots] = np.arange(len(roots))
    zone = np.where(is_node, number, number[up])
    above = up[roots]
    return roots, zone, np.where(above == roots, -1, number[above])


_ORDER = [c.split()[0] for c in NODE_SCHEMA.split(", ")]


def _drop_unusable(pixels: DataFrame) -> DataFrame:
    """Without pixels that have no finite value or no place: a hole has no neighbours."""
    g = F.col("g").cast("double")
    usable = g.isNotNull() & ~F.isnan(g) & (F.abs(g) != float("inf"))
    return pixels.where(usable & F.col("idx").isNotNull()).select(
        F.col("image_id").cast("long"), F.col("idx").cast("long"), F.col("x").cast("int"), F.col("y").cast("int"), F.coalesce(F.col("z"), F.lit(0)).cast("int").alias("z"), g.alias("g")
    )


def _split(values: np.ndarray, zone: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(zone, kind="stable")
    return np.split(values[order], np.searchsorted(zone[order], np.arange(1, n)))


def _ids(ids: np.ndarray, rows: np.ndarray) -> pd.Series:
    """The ids of rows, null at -1."""
    return pd.Series(pd.array(ids[rows], "Int64")).where(rows >= 0) if len(rows) else pd.Series([], dtype="Int64")


def build_tree(pixels: DataFrame, connectivity: int = 4) -> Tree:
    """The max-tree of every image of ``pixels(image_id, idx, x, y, z, g)``. Images run in parallel, each in one task."""
    check_connectivity(connectivity, False)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole images, sorted by image and index: side by side along z, with a gap, they are one graph."""
        image = pdf["image_id"].to_numpy()
        first = np.concatenate([[True], image[1:] != image[:-1]])
        number = np.cumsum(first) - 1
        depth = pdf.groupby("image_id")["z"].transform("nunique").to_numpy()
        out = []
        for is3d in (False, True):
            rows = (depth > 1) == is3d
            if not rows.any():
                continue
            own = pdf[rows].reset_index(drop=True)
            gap = int(own["z"].max() - own["z"].min()) + 2
            roots, zone, parent = _zones(own, connectivity, is3d, number[rows] * gap)
            ids, h = own["idx"].to_numpy(), own["g"].to_numpy()[roots]
            sums = rise(parent, _own_sums(own, zone, len(roots)), _JOIN)
            out.append(pd.DataFrame({
                "image_id": own["image_id"].to_numpy()[roots], "node_id": ids[roots], "h": h, "parent_id": _ids(ids[roots], parent), "parent_h": np.where(parent >= 0, h[parent], np.nan),
                "is3d": is3d, **sums, "pixels": _split(ids, zone, len(roots)),
            })[[*_ORDER, "pixels"]])
        return pd.concat(out)

    ready = _drop_unusable(pixels).where("image_id IS NOT NULL").repartition("image_id").sortWithinPartitions("image_id", "idx")
    whole = ready.mapInPandas(whole_images(kernel), f"{NODE_SCHEMA}, pixels array<long>")
    return Tree(whole.drop("pixels"), whole.select("image_id", "node_id", "pixels"), kept=(whole,))


# ---- tiles

_LOCAL = f"image_id long, tx int, ty int, tz int, node_id long, h double, parent_id long, parent_h double, is3d boolean, reach boolean, {SUMS_SCHEMA}, pixels array<long>, edges array<struct<idx: long, x: int, y: int, z: int>>"
_LOCAL_ORDER = ["image_id", "tx", "ty", "tz", "node_id", "h", "parent_id", "parent_h", "is3d", "reach", *SUMS, "pixels", "edges"]
#: What a row of a merge is: a node of a block's border tree, a border pixel and its node, a link between two of them, a node
#: that is settled, and an id that another took over.
NODE, PORT, LINK, SETTLED, TAKEN = range(5)
_STATE = f"kind int, image_id long, tx int, ty int, tz int, {NODE_SCHEMA.split(', ', 1)[1]}, idx long, other long, last int"
_STATE_ORDER = [c.split()[0] for c in _STATE.split(", ")]


def _tile_trees(tiled: DataFrame, tile: tuple[int, int, int], connectivity: int) -> DataFrame:
    """Every tile's own tree: nodes, sums of what no other tile can change, and the border pixels of each."""
    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        is3d = bool(pdf["is3d"].iloc[0])
        roots, zone, parent = _zones(pdf, connectivity, is3d)
        ids, edge, n = pdf["idx"].to_numpy(), np.zeros(len(pdf), bool), len(roots)
        for axis, size in zip("xyz", tile):
            at = pdf[axis].to_numpy()
            inner = (at > pdf[f"least_{axis}"].iloc[0]) & (at % size == 0), (at < pdf[f"most_{axis}"].iloc[0]) & (at % size == size - 1)
            edge |= inner[0] | inner[1]
        touched = np.zeros(n, bool)
        touched[zone[edge]] = True
        reach = rise(parent, {"r": touched}, {"r": np.logical_or})["r"]
        sums = rise(np.where(reach, -1, parent), _own_sums(pdf, zone, n), _JOIN)
        h, places = pdf["g"].to_numpy()[roots], pdf[["idx", "x", "y", "z"]].to_numpy()
        edges = [[dict(zip(("idx", "x", "y", "z"), map(int, row))) for row in part] for part in _split(places[edge], zone[edge], n)] if edge.any() else [[]] * n
        return pd.DataFrame({
            "image_id": pdf["image_id"].iloc[0], **{c: pdf[c].iloc[0] for c in ("tx", "ty", "tz")}, "node_id": ids[roots], "h": h, "parent_id": _ids(ids[roots], parent),
            "parent_h": np.where(parent >= 0, h[parent], np.nan), "is3d": is3d, "reach": reach, **sums, "pixels": _split(ids, zone, n), "edges": edges,
        })[_LOCAL_ORDER]

    return tiled.groupBy("image_id", "tx", "ty", "tz").applyInPandas(local, _LOCAL)


def _merge(round_number: int):
    """A function of a block's rows: its border tree from those of its two halves. Links join their nodes; nodes that no later
    link can reach are settled, with the sums of all below them, and the others go on."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"].to_numpy()
        at_node = np.flatnonzero(kind == NODE)
        at_node = at_node[np.argsort(pdf["node_id"].to_numpy()[at_node])]
        nodes = pdf.iloc[at_node]
        ports, links = pdf[kind == PORT], pdf[kind == LINK]
        ids, h = nodes["node_id"].to_numpy(np.int64), nodes["h"].to_numpy(float)
        parent = nodes["parent_id"].fillna(-1).to_numpy(np.int64)
        has = np.flatnonzero(parent >= 0)
        at_port = np.searchsorted(ids, ports["node_id"].to_numpy(np.int64))
        of = pd.Series(at_port, index=ports["idx"].to_numpy(np.int64))
        of = of[~of.index.duplicated()]
        p, q = (of.reindex(links[c].to_numpy(np.int64)).to_numpy(np.int64) for c in ("idx", "other"))
        up = component_tree(h, ids, np.concatenate([has, p]), np.concatenate([np.searchsorted(ids, parent[has]), q]))
        is_node = (h[up] != h) | (up == np.arange(len(h)))
        node = np.where(is_node, np.arange(len(h)), up)
        above = up[node]
        above = np.where(above == node, -1, above)
        sums = {}
        for c in SUMS:  # nodes that became one
            v = nodes[c].to_numpy(np.int64 if c in _LONGS else float).copy()
            _JOIN[c].at(v, node[~is_node], v[~is_node])
            sums[c] = v
        later = ports["last"].to_numpy() > round_number
        touched = np.zeros(len(h), bool)
        touched[node[at_port[later]]] = True
        above = np.where(is_node, above, -1)
        reach = rise(above, {"r": touched}, {"r": np.logical_or})["r"]
        sums = rise(np.where(reach, -1, above), sums, _JOIN)
        # the nodes, then the border pixels that later links need
        still = np.flatnonzero(kind == PORT)[later]
        both = lambda own, port: np.concatenate([own, port])
        out = pdf.iloc[both(at_node, still)].reset_index(drop=True)
        none = np.full(len(still), -1)
        return out.assign(
            kind=both(np.where(~is_node, TAKEN, np.where(reach, NODE, SETTLED)), np.full(len(still), PORT)), node_id=both(ids, ids[node[at_port[later]]]),
            parent_id=_ids(ids, both(above, none)), parent_h=both(np.where(above >= 0, h[above], np.nan), none), other=both(ids[node], none),
            **{c: both(v, np.zeros(len(still), v.dtype)) for c, v in sums.items()},
        )[_STATE_ORDER]

    return run


def build_tree_tiled(pixels: DataFrame, tile: Sequence[int], connectivity: int = 4) -> Tree:
    """The same tree as ``build_tree``, for images that should not meet in one task.

    1. Every tile's own tree, a task each. Nodes that have no border pixel at or below them in the tree are settled.
    2. Border pixels list the places of their neighbours, and one equi-join links those of different tiles.
    3. Blocks are merged in pairs, one axis after the other. A block is represented by its border tree, the nodes that a
       pixel with a link to another block still reaches; links between the two halves join them, and what no later link
       reaches is settled. A task holds two border trees, never an image's pixels or nodes, and the blocks of a round run
       side by side.
    4. Ids that another node took over are followed to the last one, for parents and for the zones of tiles.
    """
    check_connectivity(connectivity, False)
    size = (*(int(t) for t in tile), 1 << 30)[:3]
    base = _drop_unusable(pixels).where("image_id IS NOT NULL")
    ends = base.groupBy("image_id").agg((F.max("z") > F.min("z")).alias("is3d"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("least", F.min), ("most", F.max))])
    placed = base.join(ends, "image_id").select("*", *[F.floor(F.col(c) / s).cast("int").alias(f"t{c}") for c, s in zip("xyz", size)])
    local = cut(_tile_trees(placed, size, connectivity))
    span = local.agg(*[F.min(f"t{c}") for c in "xyz"], *[F.max(f"t{c}") for c in "xyz"]).first()
    least = [span[k] or 0 for k in range(3)]
    halvings = [((span[3 + k] or 0) - least[k]).bit_length() for k in range(3)]
    # the axes take turns; after a round, tiles of one block agree in their shifted numbers
    shifts, now = [], [0, 0, 0]
    while now != halvings:
        for k in range(3):
            if now[k] < halvings[k]:
                now[k] += 1
                shifts.append(tuple(now))

    def block(prefix: str, shift: tuple[int, ...]) -> list:
        return [F.shiftright(F.col(f"{prefix}t{c}") - low, s) for c, low, s in zip("xyz", least, shift)]

    edges = local.where("size(edges) > 0").select("image_id", "tx", "ty", "tz", "is3d", "node_id", F.inline("edges"))
    near = {flag: F.array(*[F.struct(*map(F.lit, o)) for o in offsets(check_connectivity(connectivity, flag))]) for flag in (False, True)}
    ahead = edges.withColumn("o", F.explode(F.when(F.col("is3d"), near[True]).otherwise(near[False])))
    ahead = ahead.select("image_id", *[F.col(f"t{c}").alias(f"a_t{c}") for c in "xyz"], F.col("idx").alias("idx_a"), F.col("node_id").alias("node_a"), *[(F.col(c) + F.col(f"o.col{k + 1}")).alias(c) for k, c in enumerate("xyz")])
    here = edges.select("image_id", *[F.col(f"t{c}").alias(f"b_t{c}") for c in "xyz"], F.col("idx").alias("idx_b"), F.col("node_id").alias("node_b"), "x", "y", "z")
    links = ahead.join(here, ["image_id", "x", "y", "z"]).where("a_tx <> b_tx OR a_ty <> b_ty OR a_tz <> b_tz")
    met = F.lit(len(shifts))
    for r in range(len(shifts) - 1, -1, -1):
        same = F.lit(True)
        for a, b in zip(block("a_", shifts[r]), block("b_", shifts[r])):
            same = same & (a == b)
        met = F.when(same, F.lit(r)).otherwise(met)
    links = cut(links.withColumn("round", met))

    empty = {f.split()[0]: F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in _STATE.split(", ")}

    def rows(df: DataFrame, **given) -> DataFrame:
        return df.select(*[F.col(given[c]).alias(c) if c in given else F.col(c) if c in df.columns else e for c, e in empty.items()])

    side = [links.select("image_id", *[F.col(f"{s}_t{c}").alias(f"t{c}") for c in "xyz"], F.col(f"idx_{s}").alias("idx"), F.col(f"node_{s}").alias("node_id"), "round") for s in "ab"]
    ports = side[0].unionByName(side[1]).groupBy("image_id", "tx", "ty", "tz", "idx", "node_id").agg(F.max("round").alias("last"))
    state = rows(local.where("reach").withColumn("kind", F.lit(NODE))).unionByName(rows(ports.withColumn("kind", F.lit(PORT))))
    done = []
    for r, shift in enumerate(shifts):
        own = rows(links.where(F.col("round") == r).withColumn("kind", F.lit(LINK)), tx="a_tx", ty="a_ty", tz="a_tz", idx="idx_a", other="idx_b")
        keyed = state.unionByName(own).withColumns(dict(zip(("bx", "by", "bz"), block("", shift))))
        merged = cut(keyed.groupBy("image_id", "bx", "by", "bz").applyInPandas(_merge(r), _STATE))
        done.append(merged.where(F.col("kind") >= SETTLED))
        state = merged.where(F.col("kind") < SETTLED)

    inner = local.where("NOT reach").select(*_ORDER)
    zones = local.select("image_id", "node_id", "pixels")
    if not done:
        return Tree(local.select(*_ORDER), zones, tiled=True)
    every = done[0]
    for one in done[1:]:
        every = every.unionByName(one)
    taken = every.where(F.col("kind") == TAKEN).select("image_id", F.col("node_id").alias("id"), F.col("other").alias("by"))
    for _ in range(len(shifts).bit_length()):
        again = taken.select("image_id", F.col("id").alias("by"), F.col("by").alias("on"))
        taken = cut(taken.join(again, ["image_id", "by"], "left").select("image_id", "id", F.coalesce("on", "by").alias("by")))

    def followed(df: DataFrame, column: str) -> DataFrame:
        names = taken.select("image_id", F.col("id").alias(column), "by")
        return df.join(names, ["image_id", column], "left").withColumn(column, F.coalesce("by", column)).drop("by")

    nodes = followed(inner.unionByName(every.where(F.col("kind") == SETTLED).select(*_ORDER)), "parent_id").select(*_ORDER)
    whole = followed(zones, "node_id").select("image_id", "node_id", "pixels")
    return Tree(nodes, whole, tiled=True, kept=(nodes, whole))


def pixel_nodes(tree: Tree) -> DataFrame:
    """Rows ``(image_id, idx, node_id)``: the node of each pixel."""
    return tree.zones.select("image_id", F.explode("pixels").alias("idx"), "node_id")


def spread(values: DataFrame, tree: Tree) -> DataFrame:
    """Node-level values on the pixels: ``(image_id, idx, ...)``. Zones meet values, then come apart into pixels."""
    met = tree.zones.join(values, ["image_id", "node_id"])
    rest = [c for c in met.columns if c not in ("image_id", "node_id", "pixels")]
    return met.select("image_id", F.explode("pixels").alias("idx"), *rest)
