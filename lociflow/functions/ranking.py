"""Numbers and ranks over a whole table, in ranges: no window and no join holds all rows, or all rows of one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Values whose ranks go to every task; rows of a value that are never dealt into parts.
FEW, CROWD = 200_000, 10_000


def _ordered(rows: DataFrame, order: list[Column | str], number: str) -> tuple[DataFrame, int]:
    """numbered's result with __part, the range that a row lies in."""
    salted = written(rows.withColumn("__salt", F.monotonically_increasing_id()), "rows")
    by = [*order, "__salt"]
    ordered = salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("__salt")
    ordered = written(ordered.withColumn("__at", F.monotonically_increasing_id()), "ordered")  # range << 33 | row in it
    part = F.shiftright("__at", 33)
    counts = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()  # a row for each range
    bases, total = [], 0
    for c in counts:
        bases.append((c["__part"], total))
        total += c["n"]
    base = rows.sparkSession.createDataFrame(bases, "__part long, __base long")
    out = ordered.withColumn("__part", part).join(F.broadcast(base), "__part")
    return out.withColumn(number, F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__base", "__at"), total


def numbered(rows: DataFrame, order: list[Column | str], number: str) -> tuple[DataFrame, int]:
    """(rows with their number from 0 in this order, how many there are), for any number of partitions and any repeated keys.

    Rows are range-sorted and counted within their ranges, and each range adds what earlier ones hold. Rows that are equal
    in `order` are numbered in the order they came, which splits a key that many rows share.
    """
    out, total = _ordered(rows, order, number)
    return out.drop("__part"), total


def value_ranks(df: DataFrame, value: str) -> tuple[DataFrame, int, int]:
    """((__v, __n, __rank) of each known value of a column, how many values and how many rows there are).

    __n rows hold __v, and __rank is the mean of theirs. Rows are counted by value before the sort, so a range holds a value once.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ordered = written(counts.repartitionByRange("__v").withColumn("__part", F.spark_partition_id()), "values")
    sums = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("k"), F.sum("__n").alias("n")).orderBy("__part").collect()  # a row for each range
    bases, total = [], 0
    for c in sums:
        bases.append((c["__part"], total))
        total += c["n"]
    base = df.sparkSession.createDataFrame(bases, "__part int, __base long")
    to_here = Window.partitionBy("__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("__base") + F.col("__seen") - F.col("__n")
    ranks = ordered.withColumn("__seen", F.sum("__n").over(to_here)).join(F.broadcast(base), "__part").select("__v", "__n", (before + (F.col("__n") + 1) / 2).alias("__rank"))
    return written(ranks, "ranks"), sum(c["k"] for c in sums), total


def ranked_by(rows: DataFrame, value: str, rank: str, ranks: tuple[DataFrame, int, int]) -> DataFrame:
    """rows with the rank of their value, null where value_ranks doesn't know it.

    Many values meet their rows by a shuffle, in which a value of many rows, of which there are at most a thousand, is dealt
    into parts.
    """
    known, n, total = ranks
    if n <= FEW:
        return rows.join(F.broadcast(known.select("__v", F.col("__rank").alias(rank))), F.col(value) == F.col("__v"), "left").drop("__v")
    most = max(CROWD, -(-total // 1000))
    heavy = known.where(F.col("__n") > most).select(F.col("__v").alias("__h"), F.ceil(F.col("__n") / most).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = known.join(F.broadcast(heavy), F.col("__v") == F.col("__h"), "left").select("__v", F.col("__rank").alias(rank), F.explode(F.sequence(F.lit(0), parts - 1)).alias("__s"))
    some = rows.join(F.broadcast(heavy), F.col(value) == F.col("__h"), "left").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("__h", "__parts")
    return some.join(dealt, (F.col(value) == F.col("__v")) & (F.col("__salt") == F.col("__s")), "left").drop("__v", "__s", "__salt")


def with_global_rank(df: DataFrame, value: str, rank: str) -> DataFrame:
    """df with the average rank of value among all rows, ties sharing the mean of theirs; null values have none."""
    rows = written(df, "rows")
    known = F.col(value).isNotNull()
    ranked = ranked_by(rows.where(known), value, rank, value_ranks(rows, value))
    return ranked.unionByName(rows.where(~known).withColumn(rank, F.lit(None).cast("double")))
