"""The reader of labels.  Only scoring opens it; evaluation takes cases alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayline.sources.io import LABEL, _read_dataset


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The labels of a dataset file, in file order by pos."""
    return _read_dataset(spark, path, LABEL)
