"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the control characters 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def fresh(*taken: DataFrame) -> str:
    """A column name that none of the tables has."""
    used = {c.lower() for df in taken for c in df.columns}
    while (name := f"c{uuid.uuid4().hex[:12]}") in used:
        pass
    return name
