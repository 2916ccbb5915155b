"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and tab to carriage return, no other characters.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def identity(key: str, digest: Column) -> list[Column]:
    """What tells documents apart where keys may be null or repeat: key and digest, never null."""
    return [
        F.col(key).isNull().alias("no_id"),
        F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"),
        digest.alias("digest"),
    ]


def kept_rows(df: DataFrame, key: str, digest: Column, kept: DataFrame) -> DataFrame:
    """Rows of ``df`` whose identity is in ``kept`` (no_id, id, digest), one row of each identity.

    Rows of one identity are combined before the shuffle, the least in order of all columns wins;
    the texts move once, as the join has the aggregate's partitioning.
    """
    rows = df.select(F.struct(*df.columns).alias("row"), *identity(key, digest))
    one = rows.groupBy("no_id", "id", "digest").agg(F.min("row").alias("row"))
    return one.join(kept, ["no_id", "id", "digest"], "left_semi").select("row.*")
