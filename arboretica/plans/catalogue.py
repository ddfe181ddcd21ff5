"""The registered queries over rasters of the driver's tables, and DuckDB SQL that builds the trees by recursion."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.attributes import ATTRIBUTES
from ..functions.preprocess import extrema, preprocess
from ..operators import queries as Q
from ..operators.tree import Tree, build_tree, build_tree_tiled
from ..sources import formats, rasters, sinks

CSL_LAMBDAS = (3, 10, 40)
#: A threshold for each attribute; those of irrational attributes are not attained.
LAMBDAS = {
    "area": 10, "rectarea": 12, "rectdiag": 20, "xext": 4, "yext": 4, "zext": 1, "xmean": 7.3, "ymean": 7.3, "zmean": 0, "xwmean": 7.3, "ywmean": 7.3, "zwmean": 0,
    "flux": 40, "inertiatrace": 30.53, "elong": 1.713, "flat": 0, "spars": 1.013, "ncomp": 0.2117,
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- rasters: a Spark and a DuckDB form of each

def lineitem_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 x 16: whole quantities by part and supplier, in 8 levels."""
    cells = rasters.from_facts(_table(spark, sf_dir, "lineitem"), F.col("l_partkey") % 16, F.col("l_suppkey") % 16, F.sum("l_quantity"), 16, 16)
    return rasters.quantise(cells, 8)


def event_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 6 x 4: events by hour, user and day, in 6 levels."""
    events = _table(spark, sf_dir, "events")
    cells = rasters.from_facts(events, F.hour("ts") % 8, F.col("user_id") % 6, F.count(F.lit(1)), 8, 6, F.dayofmonth("ts") % 4, 4)
    return rasters.quantise(cells, 6)


def order_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 x 12: orders by customer and day of the month, raw counts plus 1."""
    cells = rasters.from_facts(_table(spark, sf_dir, "orders"), F.col("o_custkey") % 12, F.dayofmonth("o_orderdate") % 12, F.count(F.lit(1)), 12, 12)
    return rasters.quantise(cells, 10).withColumn("g", F.col("g") + 1)


def vector_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 image per vector, in 4 levels."""
    return rasters.quantise(rasters.from_vectors(_table(spark, sf_dir, "embeddings"), 8), 4)


def _grid_sql(cells: str, w: int, h: int, d: int, levels: int, plus: str = "") -> str:
    return f"""cells AS ({cells}),
grid AS (SELECT i AS idx, i % {w} AS x, (i // {w}) % {h} AS y, i // {w * h} AS z FROM range({w * h * d}) t(i)),
raw AS (SELECT 0 AS image_id, idx, grid.x, grid.y, grid.z, coalesce(CAST(s AS DOUBLE), 0) AS s FROM grid LEFT JOIN cells USING (x, y, z)),
ext AS (SELECT min(s) AS lo, max(s) AS hi FROM raw),
px0 AS (SELECT image_id, idx, x, y, z, floor({levels} * (s - lo) / (hi - lo + 1e-9)){plus} AS g FROM raw, ext)"""


LINEITEM_SQL = _grid_sql("SELECT l_partkey % 16 AS x, l_suppkey % 16 AS y, 0 AS z, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2, 3", 16, 16, 1, 8)
VOLUME_SQL = _grid_sql("SELECT hour(ts) % 8 AS x, user_id % 6 AS y, day(ts) % 4 AS z, count(*) AS s FROM events GROUP BY 1, 2, 3", 8, 6, 4, 6)
ORDER_SQL = _grid_sql("SELECT o_custkey % 12 AS x, day(o_orderdate) % 12 AS y, 0 AS z, count(*) AS s FROM orders GROUP BY 1, 2, 3", 12, 12, 1, 10, " + 1")
VECTOR_SQL = """flat AS (SELECT vec_id AS image_id, generate_subscripts(embedding, 1) - 1 AS idx, unnest(embedding) AS v FROM embeddings),
ext AS (SELECT image_id, min(CAST(v AS DOUBLE)) AS lo, max(CAST(v AS DOUBLE)) AS hi FROM flat GROUP BY 1),
px0 AS (SELECT image_id, idx, idx % 8 AS x, idx // 8 AS y, 0 AS z, floor(4 * (CAST(v AS DOUBLE) - lo) / (hi - lo + 1e-9)) AS g FROM flat JOIN ext USING (image_id))"""

_NEAR = {
    4: "abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z)=1",
    8: "greatest(abs(a.x-b.x),abs(a.y-b.y))=1 AND a.z=b.z",
    26: "greatest(abs(a.x-b.x),abs(a.y-b.y),abs(a.z-b.z))=1",
}


def chain_sql(raster: str, near: int = 4, change: str = "SELECT * FROM px0") -> str:
    """CTEs up to ``ch``: a row for each pixel and each node that holds it, with all attributes of the node."""
    two_eigen = "sqrt((mxx-myy)*(mxx-myy)+4*mxy*mxy)"
    return f"""WITH RECURSIVE {raster}, px AS ({change}),
dims AS (SELECT max(z) > 0 AS is3d FROM px),
e AS (SELECT a.image_id AS im, a.idx AS p, b.idx AS q, least(a.g, b.g) AS w FROM px a JOIN px b ON a.image_id = b.image_id AND {_NEAR[near]}),
lv AS (SELECT DISTINCT image_id AS im, g AS h FROM px),
reach(im, h, p, q) AS (SELECT px.image_id, h, idx, idx FROM px JOIN lv ON lv.im = px.image_id AND px.g >= h
  UNION SELECT r.im, r.h, r.p, e.q FROM reach r JOIN e ON e.im = r.im AND e.p = r.q AND e.w >= r.h),
comp AS (SELECT im, h, p, min(q) AS c FROM reach GROUP BY im, h, p),
sums AS (SELECT m.im, m.h, m.c, CAST(count(*) AS DOUBLE) AS a, sum(px.x) AS sx, sum(px.y) AS sy, sum(px.z) AS sz, sum(px.g) AS sg, sum(px.g*px.x) AS sgx, sum(px.g*px.y) AS sgy, sum(px.g*px.z) AS sgz,
  sum(px.x*px.x) AS sxx, sum(px.y*px.y) AS syy, sum(px.z*px.z) AS szz, sum(px.x*px.y) AS sxy, sum(px.y*px.z) AS syz, sum(px.x*px.z) AS sxz,
  CAST(max(px.x)+1-min(px.x) AS DOUBLE) AS ex, CAST(max(px.y)+1-min(px.y) AS DOUBLE) AS ey, CAST(max(px.z)+1-min(px.z) AS DOUBLE) AS ez,
  min(CASE WHEN px.g = m.h THEN m.p END) AS node FROM comp m JOIN px ON px.image_id = m.im AND px.idx = m.p GROUP BY 1, 2, 3),
mom AS (SELECT *, sxx-CAST(sx AS DOUBLE)*sx/a+a/12 AS mxx, syy-CAST(sy AS DOUBLE)*sy/a+a/12 AS myy, szz-CAST(sz AS DOUBLE)*sz/a+a/12 AS mzz,
  sxy-CAST(sx AS DOUBLE)*sy/a AS mxy, syz-CAST(sy AS DOUBLE)*sz/a AS myz, sxz-CAST(sx AS DOUBLE)*sz/a AS mxz FROM sums WHERE node IS NOT NULL),
eig AS (SELECT *, (mxx+myy-{two_eigen})/2 AS l1, (mxx+myy+{two_eigen})/2 AS l2, (mxx+myy+mzz)/3 AS eq FROM mom),
eig3 AS (SELECT *, sqrt(((mxx-eq)*(mxx-eq)+(myy-eq)*(myy-eq)+(mzz-eq)*(mzz-eq)+2*(mxy*mxy+myz*myz+mxz*mxz))/6) AS ep,
  (mxx-eq)*((myy-eq)*(mzz-eq)-myz*myz)-mxy*(mxy*(mzz-eq)-myz*mxz)+mxz*(mxy*myz-(myy-eq)*mxz) AS det FROM eig),
eig4 AS (SELECT *, acos(CASE WHEN ep > 0 THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, det/(2*ep*ep*ep))) ELSE 1.0::DOUBLE END)/3 AS phi FROM eig3),
eig5 AS (SELECT *, eq+2*ep*cos(phi) AS t3, eq+2*ep*cos(phi+2*pi()/3) AS t1, 3*eq-(eq+2*ep*cos(phi))-(eq+2*ep*cos(phi+2*pi()/3)) AS t2 FROM eig4),
node AS (SELECT im, h, c, node, a AS area, ex*ey*ez AS rectarea, ex*ex+ey*ey+ez*ez AS rectdiag, ex AS xext, ey AS yext, ez AS zext, sx/a AS xmean, sy/a AS ymean, sz/a AS zmean,
  CASE WHEN sg <> 0 THEN sgx/sg END AS xwmean, CASE WHEN sg <> 0 THEN sgy/sg END AS ywmean, CASE WHEN sg <> 0 THEN sgz/sg END AS zwmean, sg AS flux,
  CASE WHEN is3d THEN mxx+myy+mzz ELSE mxx+myy END AS inertiatrace, CASE WHEN is3d THEN t3/t2 ELSE l2/l1 END AS elong, CASE WHEN is3d THEN t2/t1 ELSE -1 END AS flat,
  CASE WHEN is3d THEN pi()*sqrt(20*t1/a)*sqrt(20*t2/a)*sqrt(20*t3/a)/(6*a) ELSE pi()*sqrt(4*l2/a)*sqrt(4*l1/a)/a END AS spars,
  CASE WHEN is3d THEN (mxx+myy+mzz)/pow(a, 5.0/3) ELSE (mxx+myy)/(a*a) END AS ncomp FROM eig5, dims),
ch0 AS (SELECT m.p, n.* FROM comp m JOIN node n ON n.im = m.im AND n.h = m.h AND n.c = m.c),
ch AS (SELECT *, lag(h) OVER w AS ph, lag(node) OVER w AS pnode FROM ch0 WINDOW w AS (PARTITION BY im, p ORDER BY h))
"""


def _filter_sql(attr: str, lam: float, rule: str = "direct") -> str:
    ok = f"coalesce({attr} >= {lam}, false)"
    if rule == "direct":
        value = f"coalesce(max(h) FILTER ({ok}), 0)"
    elif rule == "subtractive":
        value = f"coalesce(sum(h - coalesce(ph, 0)) FILTER ({ok}), 0)"
    elif rule == "min":
        value = f"CASE WHEN count(*) = 1 THEN coalesce(max(h) FILTER ({ok}), 0) ELSE coalesce(min(ph) FILTER (NOT {ok} AND ph IS NOT NULL), max(h)) END"
    else:
        passing = f"(SELECT DISTINCT b.im, b.node FROM ch l JOIN ch b ON l.im = b.im AND l.p = b.p WHERE {ok.replace(attr, 'l.' + attr)} AND b.h <= l.h)"
        return f"SELECT ch.im, ch.p, coalesce(max(h) FILTER (k.node IS NOT NULL), 0) AS value, max(h) AS own FROM ch LEFT JOIN {passing} k ON k.im = ch.im AND k.node = ch.node GROUP BY 1, 2"
    return f"SELECT im, p, {value} AS value, max(h) AS own FROM ch GROUP BY 1, 2"


def _bucket_sql(attr: str, lams) -> str:
    return "CASE " + " ".join(f"WHEN {attr} >= {lam} THEN {k + 1}" for k, lam in reversed(list(enumerate(lams)))) + " ELSE 0 END"


_NODES = "nodes AS (SELECT DISTINCT im, node, h, ph, pnode, area, {cols} (h - coalesce(ph, 0)) * area AS mass FROM ch)"

_CSL_SQL = """, s AS (SELECT *, CASE WHEN area >= 40 THEN 4 WHEN area >= 10 THEN 2 WHEN area >= 3 THEN 1 ELSE 0 END AS sc FROM ch),
r AS (SELECT *, (sc = 4 OR ph IS NULL) AS rst FROM s),
k AS (SELECT *, max(h) FILTER (rst) OVER (PARTITION BY im, p) AS hr FROM r),
z AS (SELECT *, CASE WHEN rst THEN 0 ELSE h - ph END AS dh, CASE WHEN NOT rst AND sc <> lag(sc) OVER (PARTITION BY im, p ORDER BY h) THEN 1 ELSE 0 END AS brk FROM k WHERE h >= hr),
i AS (SELECT *, sum(brk) OVER (PARTITION BY im, p ORDER BY h) AS isl FROM z),
c AS (SELECT *, sum(dh) OVER (PARTITION BY im, p, isl ORDER BY h) AS cur FROM i),
w AS (SELECT *, row_number() OVER (PARTITION BY im, p ORDER BY cur DESC, h DESC) AS rn FROM c)
SELECT CAST(im AS BIGINT) AS image_id, CAST(p AS BIGINT) AS idx, cur AS contrast, CAST(CASE WHEN rst AND ph IS NOT NULL THEN 4 ELSE sc END AS INTEGER) AS scale, CASE WHEN rst AND ph IS NOT NULL THEN CAST(0 AS DOUBLE) ELSE h END AS luminance FROM w WHERE rn = 1"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


_HELD: dict[tuple, Tree] = {}
#: Trees that stay persisted for the queries to come; the one that was not asked for the longest goes first.
MOST_HELD = 4


def _shared(key: tuple, spark: SparkSession, sf: str, build: Callable[[], Tree]) -> Tree:
    """The tree of a raster, built once for all queries that ask for it in this session."""
    key = (spark.sparkContext.applicationId, sf, *key)
    tree = _HELD.pop(key, None) or build().persist()
    _HELD[key] = tree
    while len(_HELD) > MOST_HELD:
        _HELD.pop(next(iter(_HELD))).unpersist()
    return tree


def release() -> None:
    """Let all held trees go."""
    while _HELD:
        _HELD.popitem()[1].unpersist()


def _tree(raster, connectivity: int = 4, mode: str = "None", tree_type: str = "max"):
    return lambda spark, sf: _shared((raster.__name__, connectivity, mode, tree_type), spark, sf, lambda: build_tree(preprocess(raster(spark, sf), mode, tree_type), connectivity))


def _tiled(raster, tile: tuple[int, ...], connectivity: int = 4):
    return lambda spark, sf: _shared((raster.__name__, tile, connectivity), spark, sf, lambda: build_tree_tiled(raster(spark, sf), tile, connectivity))


def _values(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("image_id", "idx", F.round("value", digits).alias("value"))


def _value_sql(inner: str, value: str = "value") -> str:
    return f"SELECT CAST(im AS BIGINT) AS image_id, CAST(p AS BIGINT) AS idx, round(CAST({value} AS DOUBLE), 6) AS value FROM ({inner})"


LI = _tree(lineitem_raster)
LI_SQL = chain_sql(LINEITEM_SQL)
VOL6, VOL26 = _tree(event_volume, 6), _tree(event_volume, 26)
VOL6_SQL, VOL26_SQL = chain_sql(VOLUME_SQL, 4), chain_sql(VOLUME_SQL, 26)

for _a in ATTRIBUTES:
    _register(f"filter_{_a}_direct", lambda s, d, a=_a: _values(Q.filter_image(LI(s, d), a, LAMBDAS[a])), LI_SQL + _value_sql(_filter_sql(_a, LAMBDAS[_a])))
for _a, _rule in [("area", r) for r in ("min", "max", "subtractive")] + [("elong", r) for r in ("min", "max", "subtractive")] + [("ncomp", "subtractive"), ("xmean", "max")]:
    _register(f"filter_{_a}_{_rule}", lambda s, d, a=_a, r=_rule: _values(Q.filter_image(LI(s, d), a, LAMBDAS[a], r)), LI_SQL + _value_sql(_filter_sql(_a, LAMBDAS[_a], _rule)))
for _a in ("area", "ncomp"):
    _register(f"extract_{_a}", lambda s, d, a=_a: _values(Q.extract_image(LI(s, d), a, LAMBDAS[a])), LI_SQL + _value_sql(_filter_sql(_a, LAMBDAS[_a]), "own - value"))
for _a in ("area", "ncomp", "xmean", "flux", "elong", "spars", "rectdiag"):
    _register(f"check_{_a}", lambda s, d, a=_a: _values(Q.check_image(LI(s, d), a)), LI_SQL + _value_sql(f"SELECT im, p, arg_max({_a}, h) AS value FROM ch GROUP BY 1, 2"))
for _a in ("area", "elong", "flat", "spars", "ncomp", "inertiatrace", "zwmean"):
    _register(f"check_{_a}_3d", lambda s, d, a=_a: _values(Q.check_image(VOL6(s, d), a)), VOL6_SQL + _value_sql(f"SELECT im, p, arg_max({_a}, h) AS value FROM ch GROUP BY 1, 2"))

_DMP = (4, 10, 40)
_register("dmp_area", lambda s, d: Q.dmp_image(LI(s, d), "area", _DMP).select("image_id", "idx", "k", "lambda", "value"), LI_SQL + " UNION ALL ".join(
    f'SELECT CAST(im AS BIGINT) AS image_id, CAST(p AS BIGINT) AS idx, {k + 1} AS k, CAST({lam} AS DOUBLE) AS "lambda", max(h) - coalesce(max(h) FILTER (area >= {lam}), 0) AS value FROM ch GROUP BY im, p' for k, lam in enumerate(_DMP)))
_register("csl_area", lambda s, d: Q.csl_image(LI(s, d), "area", CSL_LAMBDAS), LI_SQL.rstrip() + _CSL_SQL)
for _a, _lams in (("area", (2, 4, 10, 50)), ("rectarea", (2, 6, 20, 100)), ("elong", (1.213, 1.713, 2.513)), ("flux", (5, 20, 100))):
    _n = ", " + _NODES.format(cols=f"{_a} AS attr,")
    _register(f"pattern_{_a}", lambda s, d, a=_a, ls=_lams: Q.pattern_spectrum(LI(s, d), a, ls), LI_SQL.rstrip() + _n + f""", bins AS (SELECT image_id, k, lam FROM (SELECT DISTINCT image_id FROM px), (VALUES (0, CAST(0 AS DOUBLE)){''.join(f', ({k + 1}, CAST({lam} AS DOUBLE))' for k, lam in enumerate(_lams))}) b(k, lam))
SELECT CAST(image_id AS BIGINT) AS image_id, k, lam AS "lambda", coalesce(sum(mass), 0) AS spectrum FROM bins LEFT JOIN nodes ON im = image_id AND {_bucket_sql('attr', _lams)} = k GROUP BY 1, 2, 3""")
for _name, _a, _la, _b, _lb in (("elong_area", "elong", (1.213, 1.713), "area", (4, 20)), ("yext_xext", "yext", (2, 4, 8), "xext", (2, 4, 8))):
    _n = ", " + _NODES.format(cols=f"{_a} AS a1, {_b} AS a2,")
    _grid = lambda c, ls: f"(VALUES (0, CAST(0 AS DOUBLE)){''.join(f', ({k + 1}, CAST({lam} AS DOUBLE))' for k, lam in enumerate(ls))}) {c}(k{c[1]}, lam{c[1]})"
    _register(f"pattern2d_{_name}", lambda s, d, a=_a, la=_la, b=_b, lb=_lb: Q.pattern_spectrum_2d(LI(s, d), a, la, b, lb), LI_SQL.rstrip() + _n + f""", bins AS (SELECT image_id, k1, lam1, k2, lam2 FROM (SELECT DISTINCT image_id FROM px), {_grid('b1', _la)}, {_grid('b2', _lb)})
SELECT CAST(image_id AS BIGINT) AS image_id, k1, k2, lam1 AS lambda1, lam2 AS lambda2, coalesce(sum(mass), 0) AS spectrum FROM bins LEFT JOIN nodes ON im = image_id AND {_bucket_sql('a1', _la)} = k1 AND {_bucket_sql('a2', _lb)} = k2 GROUP BY 1, 2, 3, 4, 5""")


def _tree_query(spark, sf, attr):
    table = Q.tree_table(LI(spark, sf), attr, 16, 16)
    return table.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes])


for _group, _a in enumerate(("area", "rectarea", "xmean", "flux", "elong")):
    _cols = Q.TREE_COLUMNS[_group]
    _register(f"tree_g{_group}", lambda s, d, a=_a: _tree_query(s, d, a), LI_SQL + "SELECT DISTINCT CAST(im AS BIGINT) AS image_id, CAST(node AS BIGINT) AS \"index\", CAST(node % 16 AS BIGINT) AS x, CAST((node // 16) % 16 AS BIGINT) AS y, CAST(node // 256 AS BIGINT) AS z, h AS gval, CAST(coalesce(pnode, -1) AS BIGINT) AS parent, round((h - coalesce(ph, 0)) * area, 6) AS flux, CAST(area AS BIGINT) AS area"
        + "".join(f", round(CAST({a} AS DOUBLE), 6) AS {c}" for c, a in _cols.items()) + " FROM ch")

_register("conn8_filter_area", lambda s, d: _values(Q.filter_image(_tree(lineitem_raster, 8)(s, d), "area", 10)), chain_sql(LINEITEM_SQL, 8) + _value_sql(_filter_sql("area", 10)))
_register("conn6_filter_area_3d", lambda s, d: _values(Q.filter_image(VOL6(s, d), "area", 5)), VOL6_SQL + _value_sql(_filter_sql("area", 5)))
_register("conn26_filter_area_3d", lambda s, d: _values(Q.filter_image(VOL26(s, d), "area", 5)), VOL26_SQL + _value_sql(_filter_sql("area", 5)))
_register("filter_elong_3d_subtractive", lambda s, d: _values(Q.filter_image(VOL6(s, d), "elong", 1.313, "subtractive")), VOL6_SQL + _value_sql(_filter_sql("elong", 1.313, "subtractive")))

_INVERT = "SELECT image_id, idx, x, y, z, max(g) OVER () - g AS g FROM px0"


def _min_tree(spark, sf):
    gmax = extrema(lineitem_raster(spark, sf)).select("image_id", "gmax")
    out = Q.filter_image(_tree(lineitem_raster, 4, "None", "min")(spark, sf), "area", 10).join(gmax, "image_id")
    return _values(out.withColumn("value", F.col("gmax") - F.col("value")))


_register("min_tree_filter_area", _min_tree, chain_sql(LINEITEM_SQL, 4, _INVERT) + _value_sql(_filter_sql("area", 10), "(SELECT max(g) FROM px0) - value"))
_register("min_tree_extract_area", lambda s, d: _values(Q.extract_image(_tree(lineitem_raster, 4, "None", "min")(s, d), "area", 10)), chain_sql(LINEITEM_SQL, 4, _INVERT) + _value_sql(_filter_sql("area", 10), "own - value"))
for _mode, _sql in (("ubyte", "(g - min(g) OVER ()) * 255.0::DOUBLE / (max(g) OVER () - min(g) OVER ())"), ("ushort", "(g - min(g) OVER ()) * 65535.0::DOUBLE / (max(g) OVER () - min(g) OVER ())"), ("uint", "(g - min(g) OVER ()) * 4294967295.0::DOUBLE / (max(g) OVER () - min(g) OVER ())"), ("log", "ln(g)"), ("log10", "log10(g)"), ("sqrt", "sqrt(g)"), ("exp", "exp(g)")):
    _register(f"prep_{_mode}", lambda s, d, m=_mode: _values(Q.filter_image(_tree(order_raster, 4, m)(s, d), "area", 6), 4), chain_sql(ORDER_SQL, 4, f"SELECT image_id, idx, x, y, z, {_sql} AS g FROM px0") + _value_sql(_filter_sql("area", 6)).replace("round(CAST(value AS DOUBLE), 6)", "round(CAST(value AS DOUBLE), 4)"))


def _rgb(spark, sf):
    base = lineitem_raster(spark, sf)
    channels = [base.withColumn("g", F.col("g") * k + F.col(c)) for k, c in ((1, "x"), (2, "y"), (3, "x"))]
    return rasters.luminance(*channels).select("image_id", "idx", F.round("g", 6).alias("value"))


_register("rgb_luminance", _rgb, f"WITH {LINEITEM_SQL} SELECT CAST(image_id AS BIGINT) AS image_id, CAST(idx AS BIGINT) AS idx, round(0.2126::DOUBLE * (g + x) + 0.7152::DOUBLE * (2 * g + y) + 0.0722::DOUBLE * (3 * g + x), 6) AS value FROM px0")


def mosaic_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineitem raster, cut into four tiles and put together again."""
    return rasters.mosaic(rasters.split_tiles(lineitem_raster(spark, sf_dir), (8, 8, 1), (2, 2, 1)), (2, 2, 1), (8, 8, 1))


_register("tile_mosaic_filter_area", lambda s, d: _values(Q.filter_image(_tree(mosaic_raster)(s, d), "area", 10)), LI_SQL + _value_sql(_filter_sql("area", 10)))
_register("tiled_build_filter_area", lambda s, d: _values(Q.filter_image(_tiled(lineitem_raster, (5, 6))(s, d), "area", 10)), LI_SQL + _value_sql(_filter_sql("area", 10)))
_register("tiled_build_check_ncomp_8", lambda s, d: _values(Q.check_image(_tiled(lineitem_raster, (5, 6), 8)(s, d), "ncomp")), chain_sql(LINEITEM_SQL, 8) + _value_sql("SELECT im, p, arg_max(ncomp, h) AS value FROM ch GROUP BY 1, 2"))
_register("tiled_build_3d_check_area", lambda s, d: _values(Q.check_image(_tiled(event_volume, (3, 4, 2), 26)(s, d), "area")), VOL26_SQL + _value_sql("SELECT im, p, arg_max(area, h) AS value FROM ch GROUP BY 1, 2"))


def stacked_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineitem raster and its negative as two slices."""
    base = lineitem_raster(spark, sf_dir)
    return rasters.stack([base, base.withColumn("g", 7 - F.col("g"))])


_register("z_stack_filter_area", lambda s, d: _values(Q.filter_image(_tree(stacked_volume, 6)(s, d), "area", 10)), chain_sql(LINEITEM_SQL, 4, "SELECT image_id, idx, x, y, 0 AS z, g FROM px0 UNION ALL SELECT image_id, idx + 256, x, y, 1, 7 - g FROM px0") + _value_sql(_filter_sql("area", 10)))
_register("vector_images_filter_area", lambda s, d: _values(Q.filter_image(_tree(vector_images)(s, d), "area", 4)), chain_sql(VECTOR_SQL) + _value_sql(_filter_sql("area", 4)))
_register("vector_images_pattern_area", lambda s, d: Q.pattern_spectrum(_tree(vector_images)(s, d), "area", (4, 16)), chain_sql(VECTOR_SQL).rstrip() + ", " + _NODES.format(cols="") + f""", bins AS (SELECT image_id, k, lam FROM (SELECT DISTINCT image_id FROM px), (VALUES (0, CAST(0 AS DOUBLE)), (1, CAST(4 AS DOUBLE)), (2, CAST(16 AS DOUBLE))) b(k, lam))
SELECT CAST(image_id AS BIGINT) AS image_id, k, lam AS "lambda", coalesce(sum(mass), 0) AS spectrum FROM bins LEFT JOIN nodes ON im = image_id AND {_bucket_sql('area', (4, 16))} = k GROUP BY 1, 2, 3""")
_register("passthrough", lambda s, d: _values(lineitem_raster(s, d).withColumn("value", F.col("g"))), f"WITH {LINEITEM_SQL} SELECT CAST(image_id AS BIGINT) AS image_id, CAST(idx AS BIGINT) AS idx, g AS value FROM px0")

# ---- parameters that the rows above leave at their defaults

_PD = (2.0, 1.0, 3.0)
_register("pixel_dim_filter_rectdiag", lambda s, d: _values(Q.filter_image(LI(s, d), "rectdiag", 30, pixel_dim=_PD)), LI_SQL + _value_sql(_filter_sql("(4 * xext * xext + yext * yext + 9 * zext * zext)", 30)))
_register("pixel_dim_check_inertiatrace", lambda s, d: _values(Q.check_image(LI(s, d), "inertiatrace", _PD), 5), LI_SQL.replace("mom AS (SELECT *, ", "mom AS (SELECT *, 6 * (4 * (sxx-CAST(sx AS DOUBLE)*sx/a+a/12) + (syy-CAST(sy AS DOUBLE)*sy/a+a/12)) AS scaled, ").replace("node AS (SELECT im, h, c, node, ", "node AS (SELECT im, h, c, node, scaled, ") + _value_sql("SELECT im, p, arg_max(scaled, h) AS value FROM ch GROUP BY 1, 2").replace(", 6) AS value", ", 5) AS value"))


def _spectrum_sql(lams, low: str) -> str:
    nodes = ", " + _NODES.format(cols="").replace("coalesce(ph, 0)", f"coalesce(ph, {low})")
    return LI_SQL.rstrip() + nodes + f""", bins AS (SELECT image_id, k, lam FROM (SELECT DISTINCT image_id FROM px), (VALUES (0, CAST(0 AS DOUBLE)){''.join(f', ({k + 1}, CAST({lam} AS DOUBLE))' for k, lam in enumerate(lams))}) b(k, lam))
SELECT CAST(image_id AS BIGINT) AS image_id, k, lam AS "lambda", coalesce(sum(mass), 0) AS spectrum FROM bins LEFT JOIN nodes ON im = image_id AND {_bucket_sql('area', lams)} = k GROUP BY 1, 2, 3"""


_register("imscale_pattern_area", lambda s, d: Q.pattern_spectrum(LI(s, d), "area", (4, 8, 20, 100), imscale=2.0), _spectrum_sql((2.0, 4.0, 10.0, 50.0), "0"))
_register("background_pattern_area", lambda s, d: Q.pattern_spectrum(LI(s, d), "area", (2, 4, 10, 50), include_background=False), _spectrum_sql((2, 4, 10, 50), "h"))
_register("dmp_differential_area", lambda s, d: Q.dmp_image(LI(s, d), "area", _DMP, differential=True).select("image_id", "idx", "k", "lambda", "value"), "SELECT image_id, idx, k, \"lambda\", value - coalesce(lag(value) OVER (PARTITION BY image_id, idx ORDER BY k), 0) AS value FROM (" + ORACLE_SQL["dmp_area"] + ")")
_register("imscale_csl_area", lambda s, d: Q.csl_image(LI(s, d), "area", (6, 20, 80), imscale=2.0), ORACLE_SQL["csl_area"])

_CSL_MIN_SQL = chain_sql(LINEITEM_SQL, 4, _INVERT).rstrip() + _CSL_SQL
_MIN = _tree(lineitem_raster, 4, "None", "min")
_register("csl_area_min_tree", lambda s, d: Q.csl_image(_MIN(s, d), "area", CSL_LAMBDAS), _CSL_MIN_SQL)


def _csl_both(spark, sf):
    gmax = extrema(lineitem_raster(spark, sf)).select("image_id", "gmax")
    both = Q.csl_combine(Q.csl_image(LI(spark, sf), "area", CSL_LAMBDAS), Q.csl_image(_MIN(spark, sf), "area", CSL_LAMBDAS).join(gmax, "image_id"), len(CSL_LAMBDAS) + 1, F.col("gmax"))
    return both.withColumn("scale", F.col("scale").cast("int"))


_register("csl_combine_area", _csl_both, f"""SELECT o.image_id, o.idx, greatest(o.contrast, c.contrast) AS contrast,
  CAST(CASE WHEN o.contrast > c.contrast THEN o.scale WHEN o.contrast < c.contrast THEN {len(CSL_LAMBDAS) + 2} + c.scale ELSE 0 END AS INTEGER) AS scale,
  CASE WHEN o.contrast < c.contrast THEN (SELECT max(g) FROM (WITH {LINEITEM_SQL} SELECT g FROM px0)) - c.luminance ELSE o.luminance END AS luminance
FROM ({ORACLE_SQL['csl_area']}) o JOIN ({_CSL_MIN_SQL}) c ON o.image_id = c.image_id AND o.idx = c.idx""")

for _mode, _sql in (("sqrt", "sqrt(max(g) OVER () - g)"), ("exp", "exp(max(g) OVER () - g)"), ("ubyte", "255 - (g - min(g) OVER ()) * 255.0::DOUBLE / (max(g) OVER () - min(g) OVER ())")):
    _register(f"min_tree_prep_{_mode}", lambda s, d, m=_mode: _values(Q.filter_image(_tree(order_raster, 4, m, "min")(s, d), "area", 6), 3), chain_sql(ORDER_SQL, 4, f"SELECT image_id, idx, x, y, z, {_sql} AS g FROM px0") + _value_sql(_filter_sql("area", 6)).replace(", 6) AS value", ", 3) AS value"))


# ---- files: what a run writes is read back

def _shared_folder(spark: SparkSession) -> str:
    return (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="arboretica-")).rstrip("/") + f"/files-{uuid.uuid4().hex}"


def _written_and_read(spark, sf, ending: str, windows: bool = False) -> DataFrame:
    tree, pixels = LI(spark, sf), lineitem_raster(spark, sf)
    path = f"{_shared_folder(spark)}/out-{{image}}.{ending}"
    sinks.write_rasters(Q.filter_image(tree, "area", 10), sinks.extents(pixels), path, sinks.FORMATS[ending]).collect()
    read = formats.read_windows if windows else formats.read_rasters
    rows = read(spark, path.replace("{image}", "0"))
    return _values(rows.select(F.lit(0).cast("long").alias("image_id"), "idx", F.col("g").alias("value")))


for _ending, _windows in (("pgm", False), ("fits", False), ("nii", False), ("fits", True), ("pgm", True)):
    _register(f"file_{_ending}{'_slabs' if _windows else ''}_filter_area", lambda s, d, e=_ending, w=_windows: _written_and_read(s, d, e, w), LI_SQL + _value_sql(_filter_sql("area", 10)))


def _volume_file(spark, sf):
    """A volume as FITS, and a window of it."""
    pixels = event_volume(spark, sf)
    path = f"{_shared_folder(spark)}/volume.fits"
    sinks.write_rasters(pixels.withColumn("value", F.col("g")), sinks.extents(pixels), path).collect()
    rows = formats.read_windows(spark, path, ((2, 7), (1, 5), (1, 3)))
    return rows.select(F.lit(0).cast("long").alias("image_id"), "idx", F.col("g").alias("value"))


_register("file_fits_window_3d", _volume_file, f"WITH {VOLUME_SQL} SELECT CAST(image_id AS BIGINT) AS image_id, CAST(idx AS BIGINT) AS idx, g AS value FROM px0 WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4 AND z BETWEEN 1 AND 2")
