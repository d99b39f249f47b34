"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample (FIT_SAMPLE rows, chosen by a hash of their ids); every
row is indexed. A row is stored in the list of its centroid with the codes of its residual, a byte per subspace. A
query probes the lists nearest to it; within a list, rows are scored from asymmetric distance tables (the query's exact
products with all codewords), and the best `rerank` of a block, with all that tie, are reranked by the exact cosine of
the original vectors. Lists are dealt into blocks of bounded size and queries into blocks too, so a list that holds a
third of all rows is many units of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vector_dedup import cosines
from .vectors import from_bytes, matrix, unit, usable

#: Rows that centroids are fitted on, and of these the rows that codebooks are fitted on, at most.
FIT_SAMPLE, CODE_SAMPLE = 20_000, 5_000
#: Rows of the sample whose neighbours in it say how many lists to probe.
PROBE_SAMPLE = 500
LIST_BLOCK, QUERY_BLOCK, QUERY_TILE = 4096, 2048, 256
MOST_LISTS = 4096


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids by Lloyd's rounds; an empty cluster gets a random row."""
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


class Quantiser:
    """Coarse centroids, and a codebook of up to 256 words for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, sub_dims: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.d, self.sub = sample.shape[1], sub_dims
        self.m = -(-self.d // sub_dims)
        self.centres = k_means(sample, lists, 8, rng)
        some = sample[rng.permutation(len(sample))[:CODE_SAMPLE]]
        rest = self.split(some - self.centres[nearest(some, self.centres)])
        self.words = [k_means(rest[:, i], 256, 6, rng) for i in range(self.m)]

    def split(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.m * self.sub - self.d))).reshape(len(x), self.m, self.sub)

    def encode(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the codes of unit vectors."""
        lists = nearest(u, self.centres)
        rest = self.split(u - self.centres[lists])
        codes = np.stack([nearest(rest[:, i], w) for i, w in enumerate(self.words)], 1).astype(np.uint8)
        return lists, codes

    def probes_for(self, u: np.ndarray, k: int, recall: float) -> int:
        """How many lists hold that share of the k nearest rows of PROBE_SAMPLE rows of a sample, other than themselves."""
        if len(u) < 2:
            return len(self.centres)
        q = np.linspace(0, len(u) - 1, min(len(u), PROBE_SAMPLE)).astype(np.int64)
        near = u[q] @ u.T
        near[np.arange(len(q)), q] = -np.inf
        best = np.argpartition(-near, min(k, len(u) - 1) - 1, 1)[:, : min(k, len(u) - 1)]
        place = np.argsort(np.argsort(-(u[q] @ self.centres.T), 1, kind="stable"), 1)
        ranks = np.sort(np.take_along_axis(place, nearest(u, self.centres)[best], 1).ravel())
        return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each subspace, the products of the queries with its codewords."""
        parts = self.split(q)
        return [(parts[:, i] @ w.T).astype(np.float32) for i, w in enumerate(self.words)]


def search(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    lists: int | None = None,
    probe_share: float | None = None,
    recall: float = 0.95,
    rerank: int = 128,
    sub_dims: int = 2,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors that is_query picks, its k nearest other rows found.

    score is the cosine in double precision; ties go to the smaller id. Rows that `usable` leaves out are neither
    queries nor candidates; a query with fewer candidates gets them all. Rows that repeat an id are no candidates of
    each other, and a query's id is searched once, with its first vector in order. An empty table gives an empty one.
    Lists default to four times the square root of the number of rows, MOST_LISTS at most. A query probes probe_share of them; by default as
    many as hold the share `recall` of nearest rows within the sample, where neighbours are farther apart than among
    all rows, so that clustered vectors need few and vectors without structure most of them; and more where those hold
    fewer than k other rows.
    """
    rows, d, kind = usable(vectors, id_col, vec_col)
    rows = written(rows, "vectors")
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    n = rows.count()
    if not n:
        return spark.createDataFrame([], schema)
    every = max(1, n // FIT_SAMPLE)
    # every row has the same chance; the order is by another hash, so the limit cuts no range of ids off
    thinned = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    fit = thinned.orderBy(F.xxhash64("id", F.lit(1)), "id", "vec").limit(FIT_SAMPLE).select("vec").toPandas()
    sample = fit if len(fit) else rows.orderBy("id", "vec").limit(1).select("vec").toPandas()
    lists = lists or max(1, min(MOST_LISTS, round(4 * n**0.5)))
    units = unit(matrix(sample["vec"]))
    quantiser = Quantiser(units, lists, sub_dims)
    lists = len(quantiser.centres)
    probes = quantiser.probes_for(units, k, recall) if probe_share is None else max(1, min(lists, round(lists * probe_share)))
    fitted = spark.sparkContext.broadcast(quantiser)  # bounded by lists and 256 words

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = matrix(batch["vec"])
                at, codes = fitted.value.encode(unit(x))
                yield pd.DataFrame({"list": at.astype(np.int32), "id": batch["id"], "codes": [c.tobytes() for c in codes], "raw": [v.tobytes() for v in x.astype(kind)]})

    index = written(rows.mapInPandas(indexed, "list int, id long, codes binary, raw binary"), "index")
    held_by = np.zeros(lists, np.int64)
    for r in index.groupBy("list").count().collect():  # a row for each list
        held_by[r["list"]] = r["count"]

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = matrix(batch["vec"])
                near = np.argsort(-(unit(x) @ fitted.value.centres.T), 1, kind="stable").astype(np.int32)
                enough = (np.cumsum(held_by[near], 1) < k + batch["own"].to_numpy()[:, None]).sum(1) + 1  # until k other rows are there
                yield pd.DataFrame({"id": batch["id"], "raw": [v.tobytes() for v in x.astype(kind)], "lists": [a[: max(probes, n)] for a, n in zip(near, enough, strict=True)]})

    named = {id_col: F.col("id"), vec_col: F.col("vec")}
    wanted = rows.select("id", "vec", *(c.alias(k_) for k_, c in named.items() if k_ not in ("id", "vec"))).where(is_query)
    asked = wanted.groupBy("id").agg(F.min("vec").alias("vec"), F.count(F.lit(1)).alias("own")).mapInPandas(probed, "id long, raw binary, lists array<int>")
    asked = written(asked.select("id", "raw", F.explode("lists").alias("list")), "probes")
    sizes = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).alias("blocks"))
    loads = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("loads"))
    grid = sizes.join(loads, "list")  # a row for each list
    spread = lambda name: F.explode(F.expr(f"sequence(0L, {name} - 1)"))
    deal = lambda name: F.pmod(F.xxhash64("id"), F.col(name))
    held = index.join(grid, "list").select("list", deal("blocks").alias("block"), spread("loads").alias("load"), "id", "raw", "codes")
    sought = asked.join(grid, "list").select("list", spread("blocks").alias("block"), deal("loads").alias("load"), "id", "raw", F.lit(None).cast("binary").alias("codes"))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        quantiser = fitted.value
        mine = group["codes"].isna().to_numpy()
        queries, rows_ = group[mine], group[~mine].sort_values("id", kind="stable")
        if not len(queries) or not len(rows_):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids = rows_["id"].to_numpy()
        x = from_bytes(rows_["raw"], d, kind)
        codes = np.frombuffer(b"".join(rows_["codes"]), np.uint8).reshape(len(ids), -1).T.astype(np.intp)
        centre = quantiser.centres[int(group["list"].iat[0])]
        out: list[tuple[np.ndarray, ...]] = []
        for a in range(0, len(queries), QUERY_TILE):
            part = queries.iloc[a : a + QUERY_TILE]
            q = from_bytes(part["raw"], d, kind)
            uq = unit(q)
            about = np.repeat((uq @ centre).astype(np.float32)[:, None], len(ids), 1)
            for table, code in zip(quantiser.tables(uq), codes, strict=True):
                about += table[:, code]
            for r, name in enumerate(part["id"]):
                line = np.where(ids == name, -np.inf, about[r])
                least = np.partition(line, len(line) - rerank)[len(line) - rerank] if len(line) > rerank else -np.inf
                best = np.flatnonzero((line >= least) & (line > -np.inf))
                score = cosines(np.broadcast_to(q[r], (len(best), d)), x[best])
                top = np.lexsort((ids[best], -score))[:k]
                out.append((np.full(len(top), name), ids[best][top], score[top]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    hits = held.unionByName(sought).groupBy("list", "block", "load").applyInPandas(work, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
