"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Append columns whose expressions are evaluated exactly once per row.

    A filter on a projected column is pushed below the projection by copying
    its expression, which would parse the same JSON text once in the filter and
    again in the projection. Predicates are not pushed through a generator, so
    the parse is placed in a one-row one.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))



def read_or_empty(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Parquet files below a folder, none where nothing was written yet."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], ddl)
