"""Attribution of linear, tree and arbitrary models to bins."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import feature_key

#: Features of one order that are predicted together; numbers that a block of samples and leaves holds; rows of a default background.
STEPS, BLOCK_NUMBERS, CENTRES = 256, 4_000_000, 10
#: Samples that are explained together.
BLOCK = 256
# Parts of class and module names that tell the kind of a model.
TREE_NAMES = ("xgboost", "lightgbm", "catboost", "forest", "tree", "gradientboost")
LINEAR_MODULE, LINEAR_NAMES = "linear_model", ("lasso", "ridge", "elasticnet", "linearregression", "logisticregression")


def explainer_kind(model) -> str:
    """tree, linear or kernel, by the names of the model's class and module."""
    module, name = type(model).__module__.lower(), type(model).__name__.lower()
    if any(part in where for part in TREE_NAMES for where in (module, name)):
        return "tree"
    return "linear" if LINEAR_MODULE in module or name in LINEAR_NAMES else "kernel"


def predictor(model) -> Callable[[np.ndarray], np.ndarray]:
    """What a model is explained by: the second class's probability where it tells probabilities, else its prediction."""
    if not hasattr(model, "predict_proba"):
        return model.predict

    def probability(x: np.ndarray) -> np.ndarray:
        found = np.asarray(model.predict_proba(x))
        return found[:, 1] if found.ndim == 2 else found

    return probability


def last_class(values: DataFrame) -> DataFrame:
    """(sample_id, bin_key, value) of attributions with a class column: those of the last class."""
    last = values.agg(F.max("class").alias("class"))  # one row
    return values.join(F.broadcast(last), "class").select("sample_id", "bin_key", "value")


def shap_of_model(matrix: DataFrame, model, bins: list[str], background: np.ndarray | None = None, kind: str = "auto", orders: int = 64, seed: int = 0) -> DataFrame:
    """(sample_id, bin_key, value): attributions of a fitted model to bins, by the explainer for its kind.

    A tree model has trees, a list of Tree; a linear one coef_, a weight for each bin, and is explained against the
    background, or else the matrix; any other is sampled against the background, or else the centres of up to ten
    clusters of samples, drawn by the clusters' sizes.
    """
    kind = explainer_kind(model) if kind == "auto" else kind
    if kind == "tree":
        return forest_shap(wide_rows(matrix, bins), bins, model.trees)
    spark = matrix.sparkSession
    if kind == "linear":
        weights = spark.createDataFrame([(b, float(w)) for b, w in zip(bins, np.ravel(model.coef_), strict=True)], "bin_key string, weight double")
        rows = None if background is None else [(str(i), b, float(v)) for i, row in enumerate(background) for b, v in zip(bins, row, strict=True)]
        return linear_shap(matrix, weights, None if rows is None else spark.createDataFrame(rows, "sample_id string, bin_key string, value double"))
    rows, sizes = wide_rows(matrix, bins), None
    if background is None:
        background, sizes = cluster_centres(rows, seed=seed)
    return sampled_shap(rows, bins, predictor(model), background, orders, seed, sizes)


def cluster_centres(rows: DataFrame, k: int = CENTRES, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(centres, shares) of up to k clusters of wide_rows' samples, by k-means; missing values count as 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    known = F.transform("x", lambda v: F.when(F.isnan(v), 0.0).otherwise(v))
    distinct = rows.groupBy(known.alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    few = distinct.limit(k + 1).collect()  # k + 1 rows at most
    if not few:
        raise ValueError("no samples to take a background from")
    if len(few) <= k:
        centres, counts = np.array([row["x"] for row in few]), np.array([row["n"] for row in few])
    else:
        vectors = distinct.select(array_to_vector("x").alias("features"), "n")
        model = KMeans(k=k, seed=seed, initMode="random", weightCol="n").fit(vectors)
        centres = np.array(model.clusterCenters())
        counts = np.zeros(len(centres))
        for row in model.transform(vectors).groupBy("prediction").agg(F.sum("n").alias("n")).collect():
            counts[row["prediction"]] = row["n"]
    return centres, counts / counts.sum()


def linear_shap(matrix: DataFrame, weights: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """(sample_id, bin_key, value): weight times deviation from the background's mean, exact for a linear model.

    weights(bin_key, weight); the background is the matrix itself by default. Bins without weight are left out.
    """
    means = (matrix if background is None else background).groupBy("bin_key").agg(F.avg("value").alias("mean"))
    known = means.join(weights, "bin_key")
    return matrix.join(known, "bin_key").select("sample_id", "bin_key", (F.col("weight") * (F.col("value") - F.col("mean"))).alias("value"))


def component_weights(loadings: DataFrame, beta: DataFrame) -> DataFrame:
    """(bin_key, weight): loadings(bin_key, pc, w) times beta(pc, b), summed by bin. A component without b is an error."""
    joined = loadings.join(F.broadcast(beta), "pc", "left")
    b = F.when(F.col("b").isNull(), F.raise_error(F.concat(F.lit("no coefficient for "), "pc"))).otherwise(F.col("b"))
    return joined.groupBy("bin_key").agg(F.sum(F.col("w") * b).alias("weight"))


def mean_deviation(matrix: DataFrame) -> DataFrame:
    """(bin_key, mad): mean absolute deviation from the bin's mean."""
    means = matrix.groupBy("bin_key").agg(F.avg("value").alias("mean"))
    return matrix.join(means, "bin_key").groupBy("bin_key").agg(F.avg(F.abs(F.col("value") - F.col("mean"))).alias("mad"))


def weight_importance(weights: DataFrame, matrix: DataFrame | None = None, keep_missing: bool = True) -> DataFrame:
    """(feature, mean_abs_shap): |weight|, times the mean deviation if there is a matrix.

    Bins that the matrix lacks count as 0, or are left out if not keep_missing.
    """
    if matrix is None:
        return weights.select(F.col("bin_key").alias("feature"), F.abs("weight").alias("mean_abs_shap"))
    joined = weights.join(mean_deviation(matrix), "bin_key", "left" if keep_missing else "inner")
    return joined.select(F.col("bin_key").alias("feature"), F.coalesce(F.abs("weight") * F.col("mad"), F.lit(0.0)).alias("mean_abs_shap"))


def selected_coefficients(coefficients: DataFrame, choice: str | float = "min") -> DataFrame:
    """(bin_key, weight): the non-zero coefficients at one lambda, without the intercept.

    coefficients(lambda, is_min, is_1se, bin_key, weight); choice is min, 1se or a lambda.
    """
    picked = coefficients.where("is_min" if choice == "min" else "is_1se" if choice == "1se" else F.abs(F.col("lambda") - float(choice)) < 1e-12)
    return picked.where("weight <> 0 and bin_key <> '(Intercept)'").select("bin_key", "weight")


def genomic_importance(features: DataFrame) -> DataFrame:
    """(key, mean_abs_shap): features that are genomic bins, the largest value of each."""
    return features.withColumn("key", feature_key(F.col("feature"))).where("key is not null").groupBy("key").agg(F.max("mean_abs_shap").alias("mean_abs_shap"))


def wide_rows(matrix: DataFrame, bins: list[str]) -> DataFrame:
    """(sample_id, x): the values of each sample as an array in the order of bins, NaN where one is missing; of repeated ones the largest.

    A sample's known places are sorted and the gaps between them filled, so a row costs its length, and needs no Python.
    """
    d, nan = len(bins), F.lit(float("nan"))
    order = matrix.sparkSession.createDataFrame(list(enumerate(bins)), "i int, bin_key string")
    known = matrix.where("value is not null").join(order, "bin_key").groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("i", F.col("value").cast("double").alias("value")))).alias("m"))
    last = F.filter("m", lambda v, k: F.coalesce(F.get("m", k + 1)["i"] != v["i"], F.lit(True)))
    gap = lambda here, k: F.array_repeat(nan, here - F.coalesce(F.get("m", k - 1)["i"], F.lit(-1)) - 1)
    filled = F.flatten(F.transform("m", lambda v, k: F.concat(gap(v["i"], k), F.array(v["value"]))))
    tail = F.array_repeat(nan, d - 1 - F.element_at("m", -1)["i"])
    whole = F.when(F.size("m") == d, F.col("m.value")).otherwise(F.concat(filled, tail))
    samples = known.withColumn("m", last).select("sample_id", whole.alias("x"))
    blank = matrix.groupBy("sample_id").agg(F.count("value").alias("n")).where("n = 0")
    return samples.unionByName(blank.select("sample_id", F.array_repeat(nan, d).alias("x")))


def _attributed(rows: DataFrame, bins: list[str], values: Callable[[list, np.ndarray], np.ndarray], block: int) -> DataFrame:
    """(sample_id, bin_key, value) of wide_rows' samples: what values(names, x) returns for the x of up to `block` of them."""
    d = len(bins)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = pa.array(bins, pa.string())
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                n, names = part.num_rows, part.column("sample_id")
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, d)
                phi = values(names.to_pylist(), x)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(n), d))), pa.concat_arrays([keys] * n), pa.array(phi.ravel(), pa.float64(), from_pandas=True)], ["sample_id", "bin_key", "value"])

    kind = dict(rows.dtypes)["sample_id"]
    return rows.select("sample_id", "x").mapInArrow(work, f"sample_id {kind}, bin_key string, value double")


def sampled_shap(rows: DataFrame, bins: list[str], predict: Callable[[np.ndarray], np.ndarray], background: np.ndarray, orders: int = 64, seed: int = 0, shares: np.ndarray | None = None) -> DataFrame:
    """(sample_id, bin_key, value): Shapley values of any model, from random orders of the features and background rows.

    Orders come in reversed pairs; each sample has its own, drawn from seed and its id. Values sum to the prediction less
    the mean prediction of the background rows that were drawn, alike or by shares. rows is as wide_rows returns it;
    background is a small sample. All orders of a sample are predicted together, STEPS features and about BLOCK_NUMBERS numbers
    at a time, so memory grows with the number of bins, not with its square.
    """
    d, half = len(bins), -(-orders // 2)
    background = np.asarray(background)

    def of_sample(name, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
        drawn = [(rng.permutation(d), rng.choice(len(background), p=shares)) for _ in range(half)]
        way = np.array([w for order, _ in drawn for w in (order, order[::-1])]).reshape(2 * half, d)
        base = np.repeat([b for _, b in drawn], 2)
        place = np.argsort(way, axis=1)  # of each feature in each order
        phi = np.zeros(d)
        for a in range(0, d, STEPS):
            known = np.arange(a, min(a + STEPS, d) + 1)  # how many features of an order are the sample's
            runs = max(1, BLOCK_NUMBERS // (4 * len(known) * max(1, d)))
            for r in range(0, len(way), runs):
                steps = np.where(place[r : r + runs, None, :] < known[:, None], x, background[base[r : r + runs], None, :])
                gains = np.diff(np.reshape(predict(steps.reshape(-1, d)), steps.shape[:2]), axis=1)
                phi += np.bincount(way[r : r + runs, a : known[-1]].ravel(), gains.ravel(), d)
        return phi / max(1, len(way))

    return _attributed(rows, bins, lambda names, x: np.array([of_sample(*each) for each in zip(names, x, strict=True)]), BLOCK)


class Tree:
    """A regression tree as arrays: feature (-1 at leaves), threshold, left, right, value and weight of each node."""

    def __init__(self, feature, threshold, left, right, value, weight):
        self.feature, self.left, self.right = (np.asarray(x, np.int64) for x in (feature, left, right))
        self.threshold, self.value, self.weight = (np.asarray(x, np.float64) for x in (threshold, value, weight))

    def expected(self, x: np.ndarray, known: frozenset[int], node: int = 0) -> float:
        """The mean prediction with only the known features fixed, the others by the weights of branches."""
        f = self.feature[node]
        if f < 0:
            return float(self.value[node])
        left, right = self.left[node], self.right[node]
        if f in known:
            return self.expected(x, known, left if x[f] <= self.threshold[node] else right)
        total = self.weight[left] + self.weight[right]
        return (self.weight[left] * self.expected(x, known, left) + self.weight[right] * self.expected(x, known, right)) / total

    def paths(self) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
        """(value, {feature: (low, high, share)}) of each leaf: where x must lie to go there, and the branches' share of the weight if unknown."""
        found, stack = [], [(0, {})]
        while stack:
            node, path = stack.pop()
            f = int(self.feature[node])
            if f < 0:
                found.append((float(self.value[node]), path))
                continue
            whole, t = self.weight[self.left[node]] + self.weight[self.right[node]], float(self.threshold[node])
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, span in ((self.left[node], (low, min(high, t))), (self.right[node], (max(low, t), high))):
                stack.append((int(child), path | {f: (*span, share * self.weight[child] / whole)}))
        return found


class LeafPaths:
    """The leaves of trees as arrays, those with equally many features together: feature, low, high and share of (leaf, place), value of leaf."""

    def __init__(self, trees: list[Tree]):
        by_size: dict[int, list] = {}
        for tree in trees:
            for value, path in tree.paths():
                if path:
                    by_size.setdefault(len(path), []).append((value, path))
        self.groups = []
        for m, leaves in sorted(by_size.items()):
            spans = np.array([list(path.values()) for _, path in leaves])
            feature = np.array([list(path) for _, path in leaves])
            self.groups.append((feature, spans[:, :, 0], spans[:, :, 1], spans[:, :, 2], np.array([v for v, _ in leaves]), *half_rule(-(-m // 2))))

    def shap(self, x: np.ndarray) -> np.ndarray:
        """Path-dependent Shapley values of the sum of trees, for the rows of x.

        A leaf pays its value times a product over the features on its path: 1 or 0 for a known feature, by where x goes,
        and the share of the branch's weight for an unknown one. The Shapley value of feature k in such a product is
        (one_k - share_k) times the integral over t from 0 to 1 of the product of (1 - t) share_j + t one_j over the
        other features j. That is a polynomial in t below degree m, which a Gauss rule of m / 2 points sums exactly; products
        over the others come from running products of both ways. So a leaf costs the square of its features.
        """
        phi = np.zeros((x.shape[1], len(x)))
        for feature, low, high, share, value, points, weights in self.groups:
            m = feature.shape[1]
            step = max(1, BLOCK_NUMBERS // (m * len(x)))
            for a in range(0, len(feature), step):
                f, lo, hi, zero, v = (y[a : a + step] for y in (feature, low, high, share, value))
                at = x[:, f]
                one = (((hi == np.inf) | (at <= hi)) & ((lo == -np.inf) | ~(at <= lo))).astype(float)  # what is missing goes right
                mean = np.zeros_like(one)
                for t, w in zip(points, weights, strict=True):
                    terms = (1 - t) * zero + t * one
                    before, after = np.ones_like(terms), np.ones_like(terms)
                    np.cumprod(terms[:, :, :-1], axis=2, out=before[:, :, 1:])
                    after[:, :, :-1] = np.cumprod(terms[:, :, :0:-1], axis=2)[:, :, ::-1]
                    mean += w * before * after
                gain = (v[None, :, None] * (one - zero) * mean).reshape(len(x), -1)
                order = np.argsort(f.ravel(), kind="stable")
                names, first = np.unique(f.ravel()[order], return_index=True)
                phi[names] += np.add.reduceat(gain[:, order], first, axis=1).T
        return phi.T


def half_rule(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights of Gauss's rule on [0, 1], exact for polynomials below degree 2n."""
    points, weights = np.polynomial.legendre.leggauss(n)
    return (points + 1) / 2, weights / 2


def tree_shap(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """LeafPaths.shap at one x."""
    return LeafPaths(trees).shap(np.asarray(x, float)[None, :])[0]


def forest_shap(rows: DataFrame, bins: list[str], trees: list[Tree], block: int = BLOCK) -> DataFrame:
    """(sample_id, bin_key, value): path-dependent Shapley values of every sample, blocks of samples together; rows is as wide_rows returns it."""
    paths = LeafPaths(trees)
    return _attributed(rows, bins, lambda _, x: paths.shap(x), block)
