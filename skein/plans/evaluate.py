"""Evaluation of decisions on a labelled set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import series as M


def evaluate(labelled: DataFrame, kept: Column, category: Column | None = None) -> DataFrame:
    """Confusion counts of `label` (keep or reject), and correct categories among kept keeps."""
    out = M.confusion(labelled.where(F.col("label").isin("keep", "reject")), F.col("label") == "keep", kept)
    if category is None:
        return out
    right = labelled.where((F.col("label") == "keep") & kept).agg(F.count_if(category == F.col("expected_category")).alias("right_category"))
    return out.crossJoin(F.broadcast(right))
