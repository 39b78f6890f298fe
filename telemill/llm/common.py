"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six.
SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; of null, none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), lambda w: w != "")


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once however often use names it."""
    return F.transform(F.array(value), use)[0]


def counted(text: Column, characters: str) -> Column:
    """How many characters of a text are among these."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")
