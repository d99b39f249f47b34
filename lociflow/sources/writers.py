"""Sinks: Parquet is the store, text and CSV are for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, compressed: bool = False) -> None:
    """CSV with header, a file for each partition."""
    df.write.mode("overwrite").option("header", True).csv(path, compression="gzip" if compressed else "none")


def write_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def bed_lines(df: DataFrame) -> DataFrame:
    """(value): chrom, start, end and what rest holds, joined by tabs."""
    rest = F.when(F.coalesce(F.col("rest"), F.lit("")) != "", F.col("rest")) if "rest" in df.columns else F.lit(None).cast("string")
    return df.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), rest).alias("value"))


def write_bed(df: DataFrame, path: str, compressed: bool = True) -> None:
    bed_lines(df).write.mode("overwrite").text(path, compression="gzip" if compressed else "none")


def write_peaks(df: DataFrame, path: str) -> None:
    """Four tab-separated columns, compressed."""
    df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("chrom", "start", "end", "signal"))).alias("value")).write.mode("overwrite").text(path, compression="gzip")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
