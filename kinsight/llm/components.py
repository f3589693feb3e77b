"""Connected components of an edge table, without a driver-side structure."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kinsight.llm.common import Scratch
from kinsight.operators import linking


def components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """node, label (the smallest node reachable) of every node that has an edge. edges: a, b."""
    linking.prepare_checkpoints(edges.sparkSession)
    return keep.written(linking.components(edges).withColumnRenamed("component", "label"), "components")
