"""Vectors as table columns: which are usable, their bytes, and moments over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, str]:
    """(id, vec) rows that take part, their dimension and numpy type.

    Left out are null ids, vectors that are null, zero or hold null or non-finite components, and vectors of another
    length than the most frequent one (the shorter, if there are two).
    """
    kind = "float" if "array<float>" in dict(rows.dtypes)[vec_col] else "double"
    vec = F.col(vec_col).cast(f"array<{kind}>")
    fine = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(vec, lambda x: x != 0)
    some = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).where(fine)
    top = some.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = top["d"] if top else 0
    return some.where(F.size("vec") == d), d, "<f4" if kind == "float" else "<f8"


def matrix(vectors) -> np.ndarray:
    """A float64 matrix of a column of arrays."""
    return np.stack(list(vectors)).astype(np.float64)


def from_bytes(column, d: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, d).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / top
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def second_moments(vectors: DataFrame, d: int) -> np.ndarray:
    """The d x d sum of outer products of the unit vectors, of all rows; the driver sees d * d sums."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for batch in batches:
            if len(batch):
                u = unit(matrix(batch["vec"]))
                total += u.T @ u
        yield pd.DataFrame({"i": np.arange(d * d), "v": total.ravel()})

    sums = vectors.select("vec").mapInPandas(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in sums]).reshape(d, d) if sums else np.eye(d)
