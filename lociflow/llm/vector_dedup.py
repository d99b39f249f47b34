"""Near-duplicate vectors by a subspace pigeonhole join.

For unit vectors, cosine >= c means squared distance <= 2 - 2c. Vectors are rotated to their principal directions, and
these are dealt into low-dimensional blocks. Each block gets a share of the squared distance in proportion to its
share of the variance; the shares sum to the whole, so a linked pair keeps the share of one block at least. Each
block is range-joined under its share on a grid over its two leading coordinates, whose cells are as wide as the
range: partners lie in the same or a neighbouring cell. Large cells are split into parts, and pairs of parts are the
unit of work. Candidates are verified by their exact cosine. A pair that several blocks find counts in the first of
them alone. Links are counted where they are found, and only a spanning forest of each unit leaves it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components
from .vectors import from_bytes, matrix, second_moments, unit, usable

PART = 8192
TILE = 1024
EDGE = 1e-9
NEIGHBOURS = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))


def turned(u: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """u @ rotation, summed in one fixed order so that a row's result doesn't depend on the other rows."""
    y = np.zeros((len(u), rotation.shape[1]))
    for j in range(u.shape[1]):
        y += u[:, j : j + 1] * rotation[j]
    return y


def at_most(value: np.ndarray, limit: float, exact) -> np.ndarray:
    """value <= limit, where entries near the limit are computed anew by exact(i, j)."""
    out = value <= limit
    i, j = np.nonzero(np.abs(value - limit) < EDGE)
    if len(i):
        out[i, j] = exact(i, j) <= limit
    return out


def linked_pairs(x: np.ndarray, y: np.ndarray, min_cosine: float, rotation: np.ndarray, blocks: list[np.ndarray], shares: np.ndarray, b: int, same: bool):
    """Index pairs (i, j) with cosine >= min_cosine that block b finds and no earlier block does; i < j if same. Yields tiles."""
    budget = (2 - 2 * min_cosine) * shares + EDGE
    ux, uy = unit(x), unit(y)
    rx, ry = turned(ux, rotation), turned(uy, rotation)

    def apart(k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        p, q = rx[i][:, blocks[k]], ry[j][:, blocks[k]]
        return (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * p @ q.T

    def precisely(k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return ((rx[i][:, blocks[k]] - ry[j][:, blocks[k]]) ** 2).sum(1)

    p32, q32 = rx[:, blocks[b]].astype(np.float32), ry[:, blocks[b]].astype(np.float32)
    qq = (q32 * q32).sum(1)
    for a in range(0, len(x), TILE):
        p = p32[a : a + TILE]
        near = (p * p).sum(1)[:, None] + qq[None, :] - 2 * p @ q32.T <= np.float32(budget[b] + 1e-4)
        if same:
            near &= np.arange(len(y))[None, :] > np.arange(a, a + len(p))[:, None]
        i, j = np.flatnonzero(near.any(1)) + a, np.flatnonzero(near.any(0))
        if not len(i):
            continue
        ok = near[np.ix_(i - a, j)]
        ok &= at_most(-(ux[i] @ uy[j].T), -min_cosine, lambda s, t, i=i, j=j: -cosines(x[i[s]], y[j[t]]))
        i, ok = i[ok.any(1)], ok[ok.any(1)]
        if not len(i):
            continue
        for k in range(b + 1):
            mine = at_most(apart(k, i, j), budget[k], lambda s, t, k=k, i=i, j=j: precisely(k, i[s], j[t]))
            ok &= mine if k == b else ~mine
        yield i, j, ok


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def vector_near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_cosine: float = 0.9, block_dims: int = 16) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    n_links counts the other rows at cosine >= min_cosine in double precision; component_id is the smallest id
    reachable by links, itself included; kept is true for that row. Rows that `usable` leaves out link with nothing:
    n_links 0, their own id as component, kept (a null id has a null component). Equal vectors are compared once and
    counted with their number. Rows that repeat an id are rows of their own. An empty table gives an empty one; other
    columns don't matter.
    """
    rows, d, kind = usable(vectors, id_col, vec_col)
    rows = written(rows, "vectors")
    grouped = rows.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    values, directions = np.linalg.eigh(second_moments(classes, d)) if d else (np.ones(1), np.eye(1))
    rotation, values = directions[:, ::-1], np.maximum(values[::-1], 1e-12)
    n_blocks = max(1, -(-max(d, 1) // block_dims))
    blocks = [np.arange(max(d, 1))[b::n_blocks] for b in range(n_blocks)]
    shares = np.array([values[x].sum() for x in blocks])
    shares = shares / shares.sum()
    widths = np.sqrt((2 - 2 * min_cosine) * shares + EDGE) * (1 + 1e-9)

    def placed(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch["vec"])
            y = turned(unit(x), rotation)
            raw = [v.tobytes() for v in x.astype(kind)]
            for b in range(n_blocks):
                lead = y[:, blocks[b][:2]]
                cell = np.floor(lead / widths[b]).astype(np.int64)
                cell = np.pad(cell, ((0, 0), (0, 2 - cell.shape[1])))
                yield pd.DataFrame({"node": batch["node"], "copies": batch["copies"], "b": b, "x": cell[:, 0], "y": cell[:, 1], "raw": raw})

    spots = written(classes.mapInPandas(placed, "node long, copies long, b int, x long, y long, raw binary"), "cells")
    cells = spots.groupBy("b", "x", "y").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in NEIGHBOURS)))
    to = cells.select("b", "x", "y", F.col("parts").alias("p"), steps.alias("s")).withColumns({"x2": F.col("x") + F.col("s.i"), "y2": F.col("y") + F.col("s.j")})
    pairs = written(to.join(cells.select("b", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("parts").alias("q")), ["b", "x2", "y2"]).drop("s"), "cell_pairs")
    own = lambda k: F.pmod(F.xxhash64("node"), F.col(k))
    every = lambda k: F.explode(F.expr(f"sequence(0L, {k} - 1)"))
    key = ["b", "x", "y", "i", "x2", "y2", "j"]
    left = spots.join(pairs, ["b", "x", "y"]).withColumn("i", own("p")).withColumn("j", every("q")).withColumn("side", F.lit(0))
    right = spots.withColumnsRenamed({"x": "x2", "y": "y2"}).join(pairs, ["b", "x2", "y2"]).withColumn("j", own("q")).withColumn("i", every("p")).withColumn("side", F.lit(1))
    inner = (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2"))
    both = left.select(*key, "side", "node", "copies", "raw").unionByName(right.select(*key, "side", "node", "copies", "raw")).where(~inner | (F.col("i") <= F.col("j")))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        head = group.iloc[0]
        same = (head["x"], head["y"], head["i"]) == (head["x2"], head["y2"], head["j"])
        one, two = (group[group["side"] == k].sort_values("node") for k in (0, 1))
        if not len(one) or not len(two):
            return pd.DataFrame({"node": [], "n": [], "root": []})
        names = one["node"].to_numpy() if same else np.concatenate([one["node"], two["node"]])
        counts, root = np.zeros(len(names), np.int64), np.arange(len(names))
        shift = 0 if same else len(one)
        ci, cj = one["copies"].to_numpy(), two["copies"].to_numpy()

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for i, j, ok in linked_pairs(from_bytes(one["raw"], d, kind), from_bytes(two["raw"], d, kind), min_cosine, rotation, blocks, shares, int(head["b"]), same):
            np.add.at(counts, i, ok @ cj[j])
            np.add.at(counts, j + shift, ci[i] @ ok)
            for s, k in enumerate(i):
                at = top(k)
                for t in np.unique(root[j[ok[s]] + shift]):
                    root[top(t)] = at
        hit = np.flatnonzero(counts)
        return pd.DataFrame({"node": names[hit], "n": counts[hit], "root": names[[top(k) for k in hit]]})

    found = written(both.groupBy(*key).applyInPandas(work, "node long, n long, root long"), "links")
    counted = found.groupBy("node").agg(F.sum("n").alias("n"))
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("node", "id").join(labels, "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = named.groupBy("c").agg(F.min("id").alias("component_id"))
    known = classes.join(named.join(least, "c").select("node", "component_id"), "node").join(counted, "node", "left")
    known = known.select("vec", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    kind_name = "float" if kind == "<f4" else "double"
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind_name}>").alias("vec"))
    out = slim.join(known, (F.col("vec_id").isNotNull()) & (slim["vec"] == known["vec"]), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: DuckDB SQL of the query at cosine 0.9: every pair, then the closure of the links.
NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a
), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN least m ON m.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""
