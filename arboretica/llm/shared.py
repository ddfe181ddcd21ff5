"""What the operators of this subpackage share: the cluster's shared folder, lineage cuts, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: White space of the contracts: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


#: Seconds that Spark's cleaner, which works beside the driver, gets to delete what the garbage collector has found.
CLEANING_S = 0.5

_HELD: dict = {}


def only(key, make):
    """What ``make`` gives, kept in this worker until another operator asks for something else: caches do not add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def tidy(run):
    """A task's function over batches that gives memory back to the system when it ends: Spark keeps its Python workers, and
    what their allocators keep is lost to the executor's other tasks."""
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def carried(name: str, own: list[str]) -> str:
    """What a carried column is called in a result with columns ``own``: its name, or ``carried_<name>`` where that is taken."""
    return f"carried_{name}" if name in own else name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a new one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="arboretica-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/arboretica/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(df: DataFrame) -> None:
    """Delete the files of a table made by ``keep`` once nothing reads it any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)


def drop_path(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of what has been written and is no longer referred to.

    It does so when the driver's garbage collector finds the frames; between phases that each move as much as the input, that
    may be too late for the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(CLEANING_S)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): rows ``(node, component)``, component the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014); each is one grouped minimum and one join, and the
    edge table of a round is written to the shared folder. Nodes without an edge to another node do not appear.
    The grouped minimum combines on the map side; the join's hot keys (a star's centre) are spread by a salt.
    """
    def pairs(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    now = keep(pairs(edges), "edges")
    for _ in range(max_rounds):
        # large star: every neighbour above a node hangs on the smallest node of the neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, "v > u")
        # small star: every neighbour below a node, and the node, hang on the smallest
        low = keep(pairs(large), "edges")
        small = _hang(low, "v <= u").union(low.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u AS a", "m AS b"))
        new = keep(pairs(small), "edges")
        # done when every tree is a star: no node is both a child and a centre, and no child has two centres
        unsettled = new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        if not unsettled:
            unsettled = new.groupBy("u").count().where("count > 1").limit(1).count()
        drop_kept(low)
        drop_kept(now)
        now = new
        if not unsettled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


SALTS = 32


def _hang(df: DataFrame, which: str) -> DataFrame:
    """For rows (u, v): m = the smallest of u and its v; rows (a=v, b=m) for the v that ``which`` selects.

    The minimum is taken per (u, salt) and then per u, and goes back to at most SALTS rows a node, so no task gets a whole hot node.
    """
    salted = df.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    part = salted.groupBy("u", "s").agg(F.min("v").alias("p"))
    whole = part.groupBy("u").agg(F.least(F.min("p"), F.col("u")).alias("m"))
    back = part.select("u", "s").join(whole, "u")
    return salted.where(which).join(back, ["u", "s"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
