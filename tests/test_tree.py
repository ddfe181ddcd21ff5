"""Golden raster, brute force by level sets, rules, and tiled = untiled."""

import numpy as np
import pytest
from pyspark.sql import Row

from arboretica.functions.attributes import ATTRIBUTES, check_lambdas, register_attribute
from arboretica.functions.preprocess import preprocess
from arboretica.operators import queries as Q
from arboretica.operators.tree import build_tree, build_tree_tiled, offsets

GOLDEN = [1, 1, 2, 2, 1, 1, 4, 4, 2, 1, 1, 1, 2, 5, 5, 3, 1, 1, 5, 1]
PIXELS = "image_id long, idx long, x int, y int, z int, g double"


def raster(spark, values, w, h, image=0):
    return spark.createDataFrame([(image, i, i % w, i // w % h, i // (w * h), None if v is None else float(v)) for i, v in enumerate(values)], PIXELS)


def by_idx(df, column="value"):
    return [r[column] for r in df.orderBy("idx").collect()]


def brute(values, w, h, connectivity):
    """{(node, level): pixels} of all components, by flooding every level."""
    n, d = len(values), len(values) // (w * h)
    steps = offsets({4: 6, 8: 26}.get(connectivity, connectivity) if d > 1 else {6: 4, 26: 8}.get(connectivity, connectivity))
    steps = steps + [(-a, -b, -c) for a, b, c in steps]
    found = {}
    for level in sorted(set(values)):
        seen = set()
        for start in range(n):
            if values[start] >= level and start not in seen:
                todo, comp = [start], {start}
                while todo:
                    p = todo.pop()
                    x, y, z = p % w, p // w % h, p // (w * h)
                    for dx, dy, dz in steps:
                        a, b, c = x + dx, y + dy, z + dz
                        if 0 <= a < w and 0 <= b < h and 0 <= c < d:
                            q = a + b * w + c * w * h
                            if q not in comp and values[q] >= level:
                                comp.add(q)
                                todo.append(q)
                seen |= comp
                own = [p for p in comp if values[p] == level]
                if own:
                    found[(min(own), level)] = comp
    return found


@pytest.mark.parametrize("connectivity,filtered,spectrum", [
    (4, [1, 1, 2, 2, 1, 1, 2, 2, 2, 1, 1, 1, 2, 2, 2, 1, 1, 1, 2, 1], [2, 13, 9, 20]),
    (8, [1, 1, 2, 2, 1, 1, 4, 4, 2, 1, 1, 1, 2, 4, 4, 1, 1, 1, 4, 1], [2, 3, 19, 20]),
])
def test_golden(spark, connectivity, filtered, spectrum):
    tree = build_tree(raster(spark, GOLDEN, 5, 4), connectivity).persist()
    assert by_idx(Q.filter_image(tree, "area", 4)) == filtered
    assert by_idx(Q.extract_image(tree, "area", 4)) == [g - f for g, f in zip(GOLDEN, filtered)]
    assert [r.spectrum for r in Q.pattern_spectrum(tree, "area", [2, 4, 10]).orderBy("k").collect()] == spectrum
    assert sum(spectrum) == sum(GOLDEN)


def test_attributes_of_the_golden_raster(spark):
    tree = build_tree(raster(spark, GOLDEN, 5, 4))
    rows = {r.node_id: r for r in Q.attribute_table(tree).collect()}
    assert [round(rows[n].elong, 4) for n in (0, 2, 6, 13, 15)] == [1.5625, 1.931, 4.0, 2.1429, 1.0]
    assert [round(rows[n].ncomp, 4) for n in (0, 2, 6, 13, 15)] == [0.1708, 0.1941, 0.2083, 0.2037, 0.1667]
    assert [rows[n].flux for n in (0, 2, 6, 13, 15)] == [44, 31, 8, 15, 3] and rows[6].flat == -1
    table = {r["index"]: r for r in Q.tree_table(tree, "elong", 5, 4).collect()}
    assert [table[n].flux for n in (0, 2, 6, 13, 15)] == [20, 9, 4, 9, 2] and table[0].parent == -1


def table(tree):
    """The nodes of a tree and their zones' pixels."""
    zones = {}
    for r in tree.zones.collect():
        zones.setdefault((r.image_id, r.node_id), []).extend(r.pixels)
    nodes = {(r.image_id, r.node_id): r for r in tree.nodes.collect()}
    assert nodes.keys() == zones.keys()
    return {k: Row(**r.asDict(), pixels=sorted(zones[k])) for k, r in nodes.items()}


@pytest.mark.parametrize("w,h,d,connectivity", [(6, 5, 1, 4), (6, 5, 1, 8), (4, 4, 3, 6), (4, 3, 3, 26)])
def test_against_brute_force_and_tiled(spark, w, h, d, connectivity):
    rng = np.random.default_rng(w * h * d + connectivity)
    images = [rng.integers(-2, 4, w * h * d).tolist() for _ in range(4)]
    pixels = raster(spark, images[0], w, h)
    for i, v in enumerate(images[1:], 1):
        pixels = pixels.unionByName(raster(spark, v, w, h, i))
    whole, tiled = (table(build_tree(pixels, connectivity)), table(build_tree_tiled(pixels, (3, 2, 2), connectivity)))
    for i, v in enumerate(images):
        expected = {n: c for (n, _), c in brute(v, w, h, connectivity).items()}
        assert {n for (im, n) in whole if im == i} == set(expected)
        for n, comp in expected.items():
            r = whole[(i, n)]
            assert r.area == len(comp) and r.sg == sum(v[p] for p in comp) and r.maxx == max(p % w for p in comp) + 1
            above = [m for m, c in expected.items() if m != n and n in c and v[m] < v[n]]
            assert r.parent_id == (max(above, key=lambda m: v[m]) if above else None)
    assert whole == tiled


def test_rules_on_chains(spark):
    tree = build_tree(raster(spark, GOLDEN, 5, 4)).persist()
    chains = {0: [0], 2: [0, 2], 6: [0, 2, 6], 13: [0, 2, 13], 15: [0, 15]}
    h = {0: 1, 2: 2, 6: 4, 13: 5, 15: 3}
    attr = {r.node_id: r.elong for r in Q.attribute_table(tree).collect()}
    for lam in (1.2, 1.6, 2.0, 3.0, 9.0):
        ok = {n: attr[n] >= lam for n in h}
        anyok = {n: any(ok[m] for m, c in chains.items() if n in c) for n in h}
        expected = {"direct": {}, "max": {}, "subtractive": {}, "min": {}}
        for n, c in chains.items():
            expected["direct"][n] = max([h[m] for m in c if ok[m]], default=0)
            expected["max"][n] = max([h[m] for m in c if anyok[m]], default=0)
            expected["subtractive"][n] = sum(h[m] - (h[c[k - 1]] if k else 0) for k, m in enumerate(c) if ok[m])
            fails = [h[c[k - 1]] for k, m in enumerate(c) if k and not ok[m]]
            expected["min"][n] = (h[n] if ok[n] else 0) if len(c) == 1 else min(fails, default=h[n])
        for rule, want in expected.items():
            assert {r.node_id: r.value for r in Q.filter_nodes(tree, "elong", lam, rule).collect()} == want, (rule, lam)


def test_edges(spark):
    empty = spark.createDataFrame([], PIXELS)
    assert build_tree(empty).count() == 0 and Q.filter_image(build_tree(empty), "area", 2).count() == 0
    assert build_tree_tiled(empty, (2, 2)).count() == 0
    one = build_tree(raster(spark, [7], 1, 1)).nodes.collect()
    assert len(one) == 1 and one[0].area == 1 and one[0].parent_id is None
    flat = table(build_tree(raster(spark, [3] * 12, 4, 3)))
    assert list(flat) == [(0, 0)] and flat[(0, 0)].pixels == list(range(12))
    holes = raster(spark, [1, None, 2, float("nan"), 5, 5], 3, 2)
    assert sum(len(r.pixels) for r in table(build_tree(holes)).values()) == 4
    assert table(build_tree(holes)) == table(build_tree_tiled(holes, (1, 1)))
    steps = build_tree(raster(spark, list(range(20)), 20, 1))
    assert by_idx(Q.filter_image(steps, "area", 1, "subtractive")) == list(range(20))
    with pytest.raises(ValueError):
        build_tree(empty, 5)
    with pytest.raises(ValueError):
        check_lambdas([4, 2])


def test_preprocessing_and_min_tree(spark):
    pixels = raster(spark, GOLDEN, 5, 4)
    assert by_idx(preprocess(pixels, "ubyte"), "g") == [(g - 1) * 255 / 4 for g in GOLDEN]
    assert by_idx(preprocess(pixels, "sqrt"), "g") == pytest.approx([g**0.5 for g in GOLDEN])
    assert by_idx(preprocess(raster(spark, [0, -1, 1], 3, 1), "log"), "g") == [None, None, 0.0]
    inverted = preprocess(pixels, tree_type="min")
    low = Q.filter_image(build_tree(inverted), "area", 3)
    mirror = Q.filter_image(build_tree(raster(spark, [5 - g for g in GOLDEN], 5, 4)), "area", 3)
    assert by_idx(low) == by_idx(mirror)
    with pytest.raises(ValueError):
        preprocess(pixels, "cube")


def test_own_attribute(spark):
    from pyspark.sql import functions as F

    if "brightness" not in ATTRIBUTES:
        register_attribute("brightness", 3, lambda p: F.col("sg") / F.col("area"))
    assert by_idx(Q.check_image(build_tree(raster(spark, GOLDEN, 5, 4)), "brightness"))[6] == 4
    del ATTRIBUTES["brightness"]


def test_both_ways_to_join_levels():
    """Whole levels and single vertices give the same canonical parents."""
    from arboretica.operators import tree as T

    rng = np.random.default_rng(5)
    for levels, w in ((2, 30), (7, 25), (200, 20)):
        g = rng.integers(0, levels, w * w).astype(float)
        i = np.arange(w * w)
        p, q = T._grid_edges(i % w, i // w, np.zeros(w * w, np.int64), 8, False)
        order = np.lexsort((i, g))
        rank = np.empty(len(g), np.int64)
        rank[order] = i
        low, high = np.minimum(rank[p], rank[q]), np.maximum(rank[p], rank[q])
        by = np.argsort(low, kind="stable")
        value = g[order]
        begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        assert np.array_equal(T._by_levels(value, begin, low[by], high[by]), T._by_vertices(value, begin, low[by], high[by]))


def test_folds_along_paths(monkeypatch):
    """Doubling equals a walk, for chains deeper and shallower than MANY_LEVELS."""
    from arboretica.operators import paths

    rng = np.random.default_rng(8)
    up = np.array([-1] + [int(rng.integers(max(0, i - 4), i)) for i in range(1, 400)])
    v, stop = rng.random(400), rng.random(400) < 0.1
    best, sums = paths.fold_down(up, [v, v], [np.fmax, np.add], stop)
    for i in range(400):
        path = [i]
        while up[path[-1]] >= 0 and not stop[path[-1]]:
            path.append(up[path[-1]])
        assert best[i] == v[path].max() and sums[i] == pytest.approx(v[path].sum())
    whole = v.copy()
    for i in range(399, 0, -1):
        whole[up[i]] += whole[i]
    for most in (10**6, 3):
        monkeypatch.setattr(paths, "MANY_LEVELS", most)
        assert paths.rise(up, {"v": v}, {"v": np.add})["v"] == pytest.approx(whole)


def test_tiled_queries_equal_untiled_ones(spark):
    """Every rule, dmp, csl and spectra, where nodes of an image never meet in a task."""
    rng = np.random.default_rng(12)
    pixels = raster(spark, rng.integers(0, 9, 22 * 17).tolist(), 22, 17).unionByName(raster(spark, rng.integers(0, 3, 9 * 4).tolist(), 9, 4, 1))
    whole, tiled = build_tree(pixels, 8).persist(), build_tree_tiled(pixels, (5, 4), 8).persist()
    assert table(whole) == table(tiled)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for rule in Q.RULES:
        assert rows(Q.filter_image(whole, "elong", 1.7, rule)) == rows(Q.filter_image(tiled, "elong", 1.7, rule))
    for ask in (lambda t: Q.dmp_image(t, "area", (3, 20), differential=True), lambda t: Q.csl_image(t, "area", (2, 6, 40)), lambda t: Q.pattern_spectrum(t, "flux", (5, 50))):
        assert rows(ask(whole)) == rows(ask(tiled))
    whole.unpersist()
    tiled.unpersist()


def test_many_levels(spark):
    """A float raster of 10^5 levels in one chain: linear in nodes, and no row holds a path."""
    n = 100_000
    pixels = spark.range(n).selectExpr("0L AS image_id", "id AS idx", "CAST(id % 1000 AS INT) AS x", "CAST(id DIV 1000 AS INT) AS y", "0 AS z", "id / 7.0D AS g")
    tree = build_tree(pixels).persist()
    for rule in Q.RULES:
        out = Q.filter_image(tree, "area", n // 2, rule)
        assert out.where("idx = 70000").first().value == pytest.approx(n // 2 / 7)
    assert Q.csl_image(tree, "area", (10, 1000)).count() == n
    tree.unpersist()
