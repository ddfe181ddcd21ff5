"""Formats, mosaics, configuration, command line, frame streams, and the driver's entry points."""

import duckdb
import numpy as np
import pytest

import __spark_entry__
from arboretica.operators import queries as Q
from arboretica.plans import config
from arboretica.sources import formats, rasters, sinks
from arboretica.streaming.frames import query_frames

SF = "/root/testdata/sf0.01"


def test_round_trips():
    a = np.arange(12.0).reshape(3, 4)
    assert np.array_equal(formats.decode(formats.encode_pgm(a))[0], a)
    assert np.array_equal(formats.decode(formats.encode_pgm(a * 1000))[0], a * 1000)
    volume = np.arange(24.0).reshape(2, 3, 4) / 8 - 1
    assert np.array_equal(formats.decode(formats.encode_fits(volume)), volume)
    assert np.array_equal(formats.decode(formats.encode_nifti(volume)), volume)
    assert np.array_equal(formats.decode(b"P2 # c\n2 2\n9\n1 2 3 4")[0], [[3, 4], [1, 2]])
    for bad in (b"P5\n4 4\n255\n12", b"SIMPLE  =" + b" " * 100):
        with pytest.raises(ValueError):
            formats.decode(bad)


def test_files_and_tiles(spark, tmp_path):
    a = np.arange(24).reshape(4, 6)
    (tmp_path / "one.pgm").write_bytes(formats.encode_pgm(a))
    got = formats.read_rasters(spark, str(tmp_path / "one.pgm")).orderBy("idx").collect()
    assert [r.g for r in got] == a.ravel().tolist()
    for k, (r, c) in enumerate([(0, 0), (0, 3), (2, 0), (2, 3)]):
        (tmp_path / f"t-T{k}T.pgm").write_bytes(formats.encode_pgm(a[r : r + 2, c : c + 3]))
    tiles = formats.read_rasters(spark, str(tmp_path / "t-T*T.pgm"), tiled=True)
    whole = rasters.mosaic(tiles, (2, 2, 1), (3, 2, 1)).orderBy("idx").collect()
    assert [r.g for r in whole] == a.ravel().tolist()
    again = rasters.mosaic(rasters.split_tiles(rasters.mosaic(tiles, (2, 2, 1), (3, 2, 1)), (3, 2, 1), (2, 2, 1)), (2, 2, 1), (3, 2, 1))
    assert [r.g for r in again.orderBy("idx").collect()] == a.ravel().tolist()


def test_configuration(spark, tmp_path):
    (tmp_path / "l.txt").write_text(formats.LAMBDA_HEADER + "\n2\n4\n10\n")
    run = config.parse_config(f"""# a comment
    input_name = "x.fits" ; tree_type = "max"
    pixel_connectivity = 8 # here too
    operation = (("filter", 0, 4), ("pattern", "area", "{tmp_path}/l.txt"), ("pattern2D", 1, [2, 4], 1, 3, [2], 1), ("tree", 4));""")
    assert run.pixel_connectivity == 8 and len(run.operation) == 4
    flags = config.parse_args(["-i", "y.pgm", "-c", "4", "-operation", '(("check", 17))', "-g", "[2,1,1]"])
    assert flags.operation == (("check", 17),) and flags.mpi_grid == (2, 1, 1)
    for bad in ('operation = (("cut", 0))', 'operation = (("filter", 99, 1))', 'preprocessing = "x"', "pixel_connectivity = 5", 'operation = (("filter", 0))'):
        with pytest.raises(ValueError):
            config.parse_config(bad)
    values = [1, 1, 2, 2, 1, 1, 4, 4, 2, 1, 1, 1, 2, 5, 5, 3, 1, 1, 5, 1]
    pixels = spark.createDataFrame([(0, i, i % 5, i // 5, 0, float(v)) for i, v in enumerate(values)], "image_id long, idx long, x int, y int, z int, g double")
    results = config.execute(spark, run, pixels)
    assert [r.spectrum for r in results[1][1].orderBy("k").collect()] == [2, 3, 19, 20]
    assert results[2][1].agg({"spectrum": "sum"}).first()[0] == sum(values)
    assert results[3][1].count() == 5


GOLDEN = [1, 1, 2, 2, 1, 1, 4, 4, 2, 1, 1, 1, 2, 5, 5, 3, 1, 1, 5, 1]


def test_a_run_writes_its_results(spark, tmp_path):
    """Every operation's result under its name and in its format, the passthrough too."""
    pixels = spark.createDataFrame([(0, i, i % 5, i // 5, 0, float(v)) for i, v in enumerate(GOLDEN)], "image_id long, idx long, x int, y int, z int, g double")
    ops = (("filter", 0, 4), ("extract", 0, 4), ("check", 17), ("dmp", 0, (2, 4)), ("csl", 0, (2, 4), 2), ("pattern", 0, (2, 4, 10)), ("pattern2D", 1, (2, 4), 1, 3, (2,), 1), ("tree", 15))
    run = config.make_run(operation=ops, output_name=str(tmp_path / "o.pgm"), save_tree=1, verbosity="TIMING")
    results = dict(zip([op[0] for op in ops], (df for _, df in config.execute(spark, run, pixels))))
    names = {p.name for p in tmp_path.iterdir()}
    assert {"o_filter_area_4.000.pgm", "o_extract_area_4.000.pgm", "o_check_ncomp.fits", "o_dmp_max_area.fits", "o-C_area_2.00.pgm", "o-S_area_2.00.pgm", "o-L_area_2.00.pgm", "o_PS_1D_area.txt", "o_PS_2D_rectarea_xext.txt", "o_tree.txt", "o_nodes", "o_zones"} == names
    at = lambda name: formats.decode((tmp_path / name).read_bytes())
    for name, df, column in (("o_filter_area_4.000.pgm", results["filter"], "value"), ("o_check_ncomp.fits", results["check"], "value"), ("o-C_area_2.00.pgm", results["csl"], "contrast"), ("o-S_area_2.00.pgm", results["csl"], "scale")):
        want = [r[column] for r in df.orderBy("idx").collect()]
        assert at(name).ravel().tolist() == pytest.approx(want)
    planes = [r.value for r in results["dmp"].orderBy("k", "idx").collect()]
    assert at("o_dmp_max_area.fits").shape == (2, 4, 5) and at("o_dmp_max_area.fits").ravel().tolist() == planes
    assert (tmp_path / "o_PS_1D_area.txt").read_text().splitlines()[:2] == ["lambdas \t spectra", "0.000000 \t 2.000000"]
    assert len((tmp_path / "o_PS_2D_rectarea_xext.txt").read_text().splitlines()) == 1 + 3 * 2
    tree = (tmp_path / "o_tree.txt").read_text().splitlines()
    assert tree[0].startswith("index,x,y,z,gval,parent,flux,area,") and len(tree) == 6 and tree[1].startswith("0,0,0,0,1.00,-1,20.00,20,")
    for ending, one in (("fits", None), ("nii", None), ("parquet", None), ("pgm", 7)):
        two = pixels if one is None else pixels.unionByName(pixels.withColumn("image_id", pixels.image_id + one))
        config.execute(spark, config.make_run(output_name=str(tmp_path / f"copy.{ending}")), two)
    for name in ("copy.fits", "copy.nii", "copy-0.pgm", "copy-7.pgm"):
        assert at(name).ravel().tolist() == GOLDEN
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 20
    config.execute(spark, config.make_run(run, save_output=0, save_tree=0, output_name=str(tmp_path / "no.pgm")), pixels)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("no")]


@pytest.mark.parametrize("kind,values", [("u1", [0, 255, 3]), ("i2", [-5, 300, 0]), ("u2", [0, 65535, 3]), ("i4", [-70000, 1, 2]), ("u4", [0, 4294967295, 7]), ("f4", [0.5, -1, 2])])
def test_sample_types(spark, tmp_path, kind, values):
    """The narrowest type of each raster; what a PGM cannot hold becomes FITS. Gaps are zeros."""
    rows = [(3, i, float(v)) for i, v in zip((0, 1, 5), values)]
    df, sizes = spark.createDataFrame(rows, "image_id long, idx long, value double"), spark.createDataFrame([(3, 3, 2, 1)], "image_id long, w long, h long, d long")
    want = [values[0], values[1], 0, 0, 0, values[2]]
    for fmt, ending in (("fits", "fits"), ("nifti", "nii"), ("pgm", "pgm")):
        (done,) = sinks.write_rasters(df, sizes, f"{tmp_path}/x.{ending}", fmt).collect()
        data = open(done.path.removeprefix("file://"), "rb").read()
        own = formats.raw(data)
        assert formats.decode(data).ravel().tolist() == want and len(data) == done.bytes
        if fmt != "pgm":
            assert sinks.sample_kind(kind != "f4", min(want), max(want)) == kind and np.dtype(own.kind).itemsize == int(kind[1])
        else:
            assert done.path.endswith(".pgm") == (kind in ("u1", "u2"))


def test_slices_and_channels(spark, tmp_path):
    """A volume of slice files by their names' order, and a gray raster of three channel files."""
    slices = [np.arange(12.0).reshape(3, 4) + 20 * k for k in range(3)]
    for k, a in enumerate(slices):
        (tmp_path / f"s{k}.pgm").write_bytes(formats.encode_pgm(a))
    rows = config.read_pixels(spark, config.make_run(input_name=str(tmp_path / "s*.pgm"), image_options="sequence")).orderBy("idx").collect()
    assert [r.g for r in rows] == np.concatenate([a.ravel() for a in slices]).tolist() and [r.z for r in rows] == [0] * 12 + [1] * 12 + [2] * 12
    for c, a in zip("RGB", slices):
        (tmp_path / f"c-{c}.pgm").write_bytes(formats.encode_pgm(a))
    gray = config.read_pixels(spark, config.make_run(input_name=str(tmp_path / "c.pgm"), image_options="rgb")).orderBy("idx").collect()
    assert [r.g for r in gray] == pytest.approx((0.2126 * slices[0] + 0.7152 * slices[1] + 0.0722 * slices[2]).ravel().tolist())


def test_slabs_and_windows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "SLAB_BYTES", 40)
    a = np.arange(7 * 9.0).reshape(7, 9)
    (tmp_path / "a.pgm").write_bytes(formats.encode_pgm(a))
    volume = np.arange(4 * 5 * 6.0).reshape(4, 5, 6)
    (tmp_path / "v.fits").write_bytes(formats.encode_fits(volume))
    got = formats.read_windows(spark, str(tmp_path / "a.pgm")).orderBy("idx").collect()
    assert [r.g for r in got] == a.ravel().tolist() and [(r.x, r.y) for r in got][10] == (1, 1)
    part = formats.read_windows(spark, str(tmp_path / "v.fits"), ((1, 4), (2, 4), (1, 3)))
    assert [r.g for r in part.orderBy("idx").collect()] == volume[1:3, 2:4, 1:4].ravel().tolist()
    (tmp_path / "bad.txt").write_bytes(b"none")
    with pytest.raises(Exception, match="not a plain array"):
        formats.read_windows(spark, str(tmp_path / "bad.txt")).count()


def test_frames(spark, tmp_path):
    rows = [(k, i, i % 2, i // 2, 0, float(i + k)) for k in range(2) for i in range(4)]
    schema = "image_id long, idx long, x int, y int, z int, g double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    frames = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query_frames(frames, lambda t: Q.check_image(t, "area"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


@pytest.mark.parametrize("name", ["filter_area_direct", "filter_area_max", "csl_area", "pattern2d_elong_area", "check_flat_3d", "min_tree_filter_area", "vector_images_filter_area"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    expected = con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert sorted(df.columns) == sorted(names) and sorted(got) == sorted(expected)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 256
