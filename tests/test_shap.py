import itertools
import math
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.operators import shap

MATRIX = "sample_id string, bin_key string, value double"


def random_tree(r, depth, d):
    """A full tree with random splits, in which features repeat on a path."""
    inner = 2**depth - 1
    n = 2 * inner + 1
    weight = np.zeros(n)
    weight[0] = 100
    for k in range(inner):
        weight[2 * k + 1] = weight[k] * r.uniform(0.1, 0.9)
        weight[2 * k + 2] = weight[k] - weight[2 * k + 1]
    feature = [int(r.integers(d)) if k < inner else -1 for k in range(n)]
    return shap.Tree(feature, r.normal(size=n), [2 * k + 1 if k < inner else 0 for k in range(n)], [2 * k + 2 if k < inner else 0 for k in range(n)], r.normal(size=n), weight)


def by_definition(trees, x):
    d = len(x)
    f = lambda known: sum(t.expected(x, frozenset(known)) for t in trees)
    out = np.zeros(d)
    for j in range(d):
        others = [k for k in range(d) if k != j]
        for s in range(d):
            w = math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d)
            out[j] += sum(w * (f((*c, j)) - f(c)) for c in itertools.combinations(others, s))
    return out


@pytest.mark.parametrize(("depth", "d"), [(1, 3), (3, 4), (5, 6)])
def test_batched_tree_values_by_definition(depth, d, monkeypatch):
    r = np.random.default_rng(depth)
    trees = [random_tree(r, depth, d) for _ in range(3)]
    x = r.normal(size=(7, d))
    x[2, 1] = np.nan
    want = np.array([by_definition(trees, row) for row in x])
    assert shap.LeafPaths(trees).shap(x) == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(shap, "BLOCK_NUMBERS", 40)
    assert shap.LeafPaths(trees).shap(x) == pytest.approx(want, abs=1e-12)
    assert shap.tree_shap(trees, x[0]) == pytest.approx(want[0], abs=1e-12)


def test_forest_over_samples(spark):
    r = np.random.default_rng(9)
    trees, bins = [random_tree(r, 3, 4) for _ in range(2)], [f"b{k}" for k in range(4)]
    x = r.normal(size=(11, 4))
    rows = [(f"s{i}", b, float(v)) for i, row in enumerate(x) for b, v in zip(bins, row, strict=True) if (i, b) != (3, "b2")]
    x[3, 2] = np.nan
    got = {(v["sample_id"], v["bin_key"]): v["value"] for v in shap.forest_shap(shap.wide_rows(spark.createDataFrame(rows, MATRIX), bins), bins, trees, block=4).collect()}
    assert len(got) == 44
    for i, row in enumerate(x):
        assert [got[f"s{i}", b] for b in bins] == pytest.approx(by_definition(trees, row))


def test_wide_rows(spark):
    rows = [("a", "x", 1.0), ("a", "z", 3.0), ("a", "z", 2.0), ("b", "y", None), ("a", "y", None), ("a", "unknown", 9.0)]
    got = {r["sample_id"]: r["x"] for r in shap.wide_rows(spark.createDataFrame(rows, MATRIX), ["z", "y", "x"]).collect()}
    assert got["a"][0] == 3.0 and got["a"][2] == 1.0 and math.isnan(got["a"][1]) and len(got) == 2 and all(math.isnan(v) for v in got["b"])


def test_wide_rows_in_linear_time(spark):
    """Two samples of 52,459 bins, the number of a published model: seconds, where a look-up of each bin took minutes."""
    d = 52_459
    matrix = spark.range(2 * d).select((F.col("id") % 2).cast("string").alias("sample_id"), F.concat(F.lit("b"), F.expr("id div 2").cast("string")).alias("bin_key"), F.col("id").cast("double").alias("value"))
    began = time.time()
    got = {r["sample_id"]: r["x"] for r in shap.wide_rows(matrix, [f"b{k}" for k in range(d)]).collect()}
    took = time.time() - began
    assert all(got[s] == [2.0 * k + int(s) for k in range(d)] for s in ("0", "1")) and took < 60


def test_default_background_is_clustered(spark):
    rows = [(f"s{i}", b, float(v)) for i in range(30) for b, v in (("x", i % 3), ("y", 10 * (i % 3)))]
    wide = shap.wide_rows(spark.createDataFrame(rows, MATRIX), ["x", "y"])
    centres, shares = shap.cluster_centres(wide, k=3)
    assert sorted(map(tuple, centres.round(6).tolist())) == [(0, 0), (1, 10), (2, 20)] and shares == pytest.approx([1 / 3] * 3)
    centres, shares = shap.cluster_centres(shap.wide_rows(spark.createDataFrame([(f"s{i}", b, float(100 * (i % 4) + i // 4 * f)) for i in range(40) for b, f in (("x", 1), ("y", 0))], MATRIX), ["x", "y"]), k=10)
    assert len(centres) == 10 and shares.sum() == pytest.approx(1) and shares @ centres == pytest.approx([154.5, 150])
    one = shap.cluster_centres(shap.wide_rows(spark.createDataFrame(rows[:2], MATRIX), ["x", "y"]))
    assert one[0].tolist() == [[0, 0]] and one[1].tolist() == [1]

    class Plain:
        def predict(self, x):
            return x @ np.array([1.0, 2.0])

    got = {(r["sample_id"], r["bin_key"]): r["value"] for r in shap.shap_of_model(spark.createDataFrame(rows, MATRIX), Plain(), ["x", "y"], orders=200).collect()}
    assert got["s0", "y"] == pytest.approx(-20, abs=6) and got["s2", "y"] == pytest.approx(20, abs=6)


def plain_orders(x, background, predict, orders, rng):
    """Sampled values feature by feature."""
    phi = np.zeros(len(x))
    for _ in range(orders // 2):
        order, base = rng.permutation(len(x)), background[rng.choice(len(background))]
        for way in (order, order[::-1]):
            now = base.copy()
            for j in way:
                before = predict(now[None, :])[0]
                now[j] = x[j]
                phi[j] += predict(now[None, :])[0] - before
    return phi / orders


@pytest.mark.parametrize(("steps", "numbers"), [(256, 4_000_000), (3, 300)])
def test_orders_are_predicted_together(spark, monkeypatch, steps, numbers):
    monkeypatch.setattr(shap, "STEPS", steps)
    monkeypatch.setattr(shap, "BLOCK_NUMBERS", numbers)
    r, bins = np.random.default_rng(2), [f"b{k}" for k in range(7)]
    x, background, least = r.normal(size=(5, 7)), r.normal(size=(4, 7)), 16 * 8 if steps > 7 else 2

    def predict(z):
        if len(z) < least:
            raise ValueError(f"{len(z)} rows at a time")
        return z[:, 0] * z[:, 3] + np.maximum(z[:, 1], z[:, 6])

    rows = spark.createDataFrame([(f"s{i}", b, float(v)) for i, row in enumerate(x) for b, v in zip(bins, row, strict=True)], MATRIX)
    got = {(v["sample_id"], v["bin_key"]): v["value"] for v in shap.sampled_shap(shap.wide_rows(rows, bins), bins, predict, background, orders=16).collect()}
    plain = lambda z: z[:, 0] * z[:, 3] + np.maximum(z[:, 1], z[:, 6])
    for i, row in enumerate(x):
        want = plain_orders(row, background, plain, 16, np.random.default_rng([0, zlib.crc32(f"s{i}".encode())]))
        assert [got[f"s{i}", b] for b in bins] == pytest.approx(want)


def test_one_python_worker_a_task(spark):
    """Samples become arrays without Python, so a task that explains them has one worker and not two."""
    rows = spark.createDataFrame([("a", "x", 1.0), ("b", "z", 3.0)], MATRIX)
    tree = shap.Tree([0, -1, -1], [0.0, 0, 0], [1, 0, 0], [2, 0, 0], [0, 1.0, 2.0], [2, 1, 1])
    plan = shap.forest_shap(shap.wide_rows(rows, ["x", "y", "z"]), ["x", "y", "z"], [tree])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
