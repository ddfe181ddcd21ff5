"""Tree queries over streams of frames: each micro-batch's complete images are built and asked like any others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.tree import Tree, build_tree


def query_frames(frames: DataFrame, ask: Callable[[Tree], DataFrame], path: str, checkpoint: str, connectivity: int = 4) -> StreamingQuery:
    """Start a query over streamed ``pixels``: per micro-batch, build the trees, ``ask(tree)``, append to ``path``.

    A frame's pixels must arrive in one micro-batch (a file per frame does that). Results are written under the batch's
    number, so a batch that runs again after a failure replaces its own output.
    """
    def batch(df: DataFrame, number: int) -> None:
        ask(build_tree(df, connectivity)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return frames.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
