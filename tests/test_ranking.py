import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.functions import ranking, stats
from lociflow.functions.ranking import _ordered, numbered, with_global_rank
from lociflow.operators import tissue


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def average_ranks(values):
    return {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in set(values)}


def test_half_of_all_values_are_equal(spark, many_ranges):
    r = np.random.default_rng(4)
    values = [0.0] * 2000 + [float(v) for v in r.normal(size=1500).round(2)] + [1e300, -1e300, None, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(7)
    got = with_global_rank(df, "v", "k")
    want = average_ranks([v for v in values if v is not None])
    rows = got.collect()
    assert len(rows) == len(values) and all(x["k"] == (None if x["v"] is None else want[x["v"]]) for x in rows)
    parts, n = _ordered(df.where("v is not null"), ["v"], "i")
    sizes = sorted(x["n"] for x in parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    assert n == 3502 and len(sizes) > 15 and sizes[-1] <= 5 * sizes[len(sizes) // 2]
    assert with_global_rank(df.where("false"), "v", "k").count() == 0


def test_numbers_in_descending_order(spark, many_ranges):
    rows = [(i % 5, i) for i in range(300)]
    got, n = numbered(spark.createDataFrame(rows, "a int, b int"), [F.desc("a"), "b"], "i")
    assert n == 300 and [(x["a"], x["b"]) for x in got.orderBy("i").collect()] == sorted(rows, key=lambda x: (-x[0], x[1])) and got.agg(F.max("i")).first()[0] == 299


def test_spearman(spark, many_ranges):
    r = np.random.default_rng(6)
    x = r.integers(0, 6, 400).astype(float)
    y = x * (r.random(400) < 0.5) + r.integers(0, 3, 400)
    got = stats.spearman(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0)], "x double, y double"), "x", "y").first()
    rx, ry = average_ranks(x.tolist()), average_ranks(y.tolist())
    assert got["n"] == 400 and got["rho"] == pytest.approx(np.corrcoef([rx[v] for v in x], [ry[v] for v in y])[0, 1])


def test_exact_law_at_any_size():
    ways = {}
    for k in range(math.comb(9, 3)):
        ways[k] = 0
    import itertools

    for some in itertools.combinations(range(9), 3):
        u = sum(a - i for i, a in enumerate(some))
        ways[u] += 1
    for u in range(19):
        high = max(u, 18 - u)
        assert stats.mann_whitney_p(u, 3, 6, 0) == pytest.approx(min(1.0, 2 * sum(n for k, n in ways.items() if k >= high) / 84))
    assert stats.mann_whitney_p(0, 2, 5000, 0) == pytest.approx(2 / math.comb(5002, 2))
    assert stats.mann_whitney_p(3, 1, 9999, 0) == pytest.approx(2 * 4 / 10_000)


def test_fraction_that_does_not_converge(monkeypatch):
    monkeypatch.setattr(stats, "TERMS", 4)
    with pytest.raises(ArithmeticError):
        stats.beta_fraction(5000.0, 5000.0, 0.49)


def test_permutations_with_a_threshold_are_exact(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(f"b{i}", t, float(r.normal())) for i in range(500) for t in ("x", "y")]
    spec = tissue.specificity(spark.createDataFrame(rows, "bin_key string, tissue string, value double")).cache()
    top = tissue.top_bins(spark.createDataFrame([(f"b{i}", 200.0 - i) for i in range(500)], "key string, importance double"), spec, (5, 20))
    take = lambda: sorted(map(tuple, tissue.permutation_p(spec, top, n_perm=60).collect()))
    got = take()
    monkeypatch.setattr(tissue, "_threshold", lambda k, n: 1.0)
    assert take() == got
    monkeypatch.setattr(tissue, "_threshold", lambda k, n: k / n)  # about half of the permutations come out short
    assert take() == got


def test_many_values_meet_their_ranks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FEW", 3)
    monkeypatch.setattr(ranking, "CROWD", 50)
    values = [0.0] * 700 + [-0.0] * 50 + [float(i % 90) for i in range(400)] + [math.nan] * 60 + [None]
    got = with_global_rank(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double"), "v", "k").collect()
    known = [math.inf if v is not None and math.isnan(v) else v for v in values]
    want = average_ranks([v for v in known if v is not None])
    assert len(got) == len(values) and all(x["k"] == (None if x["v"] is None else want[known[x["id"]]]) for x in got)


def test_correlations_rank_each_column_once(spark, monkeypatch):
    """Three targets known in the same rows take four rankings; a fourth that lacks rows ranks x anew among its own."""
    r = np.random.default_rng(8)
    x = r.integers(0, 40, 300).astype(float)
    ys = {k: x * (r.random(300) < 0.5) + r.integers(0, 9, 300) for k in "abcd"}
    rows = [(float(v), *(None if k == "d" and i % 7 == 0 else float(y[i]) for k, y in ys.items())) for i, v in enumerate(x)]
    ranked, first = [], stats.value_ranks
    monkeypatch.setattr(stats, "value_ranks", lambda df, c: ranked.append(c) or first(df, c))
    got = {v["target"]: v for v in stats.spearman_each(spark.createDataFrame(rows, "x double, a double, b double, c double, d double"), "x", list("abcd")).collect()}
    assert len(ranked) == 6
    for k, y in ys.items():
        keep = [i for i in range(300) if k != "d" or i % 7]
        a, b = ([v[i] for i in keep] for v in (x.tolist(), y.tolist()))
        ra, rb = average_ranks(a), average_ranks(b)
        assert got[k]["n"] == len(keep) and got[k]["rho"] == pytest.approx(np.corrcoef([ra[v] for v in a], [rb[v] for v in b])[0, 1])
