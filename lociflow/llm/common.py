"""What the operators share: tables that cut lineage, texts of Arrow batches, joins on keys that may be hot, words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import numbered
from ..sources.scratch import shared_dir, written

__all__ = ["hot_keys", "numbered", "release", "shared_dir", "spread_join", "values", "words_of", "written"]

#: A key with more rows than this, and than a thousandth of all rows, is hot; so at most a thousand keys are.
HOT_ROWS, HOT_KEYS = 256, 1000


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """(key, parts) of the hot keys of counts(key, n), whose n sum to total at most: HOT_KEYS rows at most, so they may be broadcast."""
    most = max(HOT_ROWS, -(-total // HOT_KEYS))
    return F.broadcast(counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).alias("__parts")))


def spread_join(rows: DataFrame, one: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with one, which has at most a row a key: rows of a hot key are dealt into parts, its row of one goes to each."""
    left = rows.join(hot, key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*rows.columns), "__parts"), F.lit(0)).cast("long"))
    right = one.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)).cast("long") - 1)))
    return left.drop("__parts").join(right.drop("__parts"), [key, "__part"], how).drop("__part")


def values(batch: pa.RecordBatch | dict[str, pa.Array], name: str, step: int = 256) -> Iterator:
    """The values of a column as Python objects, few at a time."""
    column = batch[name]
    for a in range(0, len(column), step):
        yield from column.slice(a, step).to_pylist()


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers between stages, and what they hold counts as the executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than space and U+0009..U+000D, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
