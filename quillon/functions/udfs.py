"""Functions of one's own under a name, for SQL of any dialect: by row, by group, and tables. All get Arrow batches, never single rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def scalar(spark: SparkSession, name: str, f: Callable[..., pd.Series], returns: str) -> None:
    """f gets a Series for each argument and returns one of the same length."""
    spark.udf.register(name, F.pandas_udf(f, returnType=returns, functionType=F.PandasUDFType.SCALAR))


def aggregate(spark: SparkSession, name: str, f: Callable[..., Any], returns: str) -> None:
    """f gets a Series of a group's values for each argument and returns one value; a group must fit into a task."""
    spark.udf.register(name, F.pandas_udf(f, returnType=returns, functionType=F.PandasUDFType.GROUPED_AGG))


def table(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """handler has eval(self, *args), which yields rows (and terminate, for rows behind the last)."""
    spark.udtf.register(name, F.udtf(handler, returnType=returns))
