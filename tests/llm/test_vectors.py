import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm.ann import search
from lociflow.llm.vector_dedup import vector_near_duplicates

from .helpers import components, rng, rows_of, with_clashing_names

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def frame(spark, rows, clash=True):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return with_clashing_names(df) if clash else df


def vectors(seed=1, n=300, d=16):
    r = rng(seed)
    base = r.normal(size=(n, d))
    if n < 230:
        return [[float(x) for x in v] for v in base]
    base[100:160] = base[100] + r.normal(size=(60, d)) * 0.12  # a chain of near copies
    base[160:230] = base[160]  # exact copies
    return [[float(x) for x in v] for v in base]


ODD = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [float("inf")] + [1.0] * 15), (905, [])]


def test_near_vectors_match_all_pairs(spark):
    rows = [*enumerate(vectors()), *ODD]
    good = {i: v for i, v in rows if usable(v)}
    links = [(a, b) for a in good for b in good if a < b and cosine(good[a], good[b]) >= 0.9]
    degree = {i: sum(i in link for link in links) for i, _ in rows}
    root = components([i for i, _ in rows], links)
    got = rows_of(vector_near_duplicates(frame(spark, rows)), "vec_id")
    assert [tuple(r) for r in got] == [(i, degree[i], root[i], root[i] == i) for i, _ in sorted(rows)]


def test_near_vectors_repeated_ids_and_empty(spark):
    v = vectors(n=10)
    got = rows_of(vector_near_duplicates(frame(spark, [(1, v[0]), (1, v[0]), (2, v[0]), (None, v[0]), (3, v[1])])), "vec_id")
    assert [(r["vec_id"], r["component_id"], r["kept"]) for r in got] == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (None, None, True)]
    assert vector_near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in vector_near_duplicates(frame(spark, ODD[:2], clash=False)).orderBy("vec_id").collect()] == [(900, 0, 900, True), (901, 0, 901, True)]


def brute(rows, queries, k):
    good = [(i, v) for i, v in rows if usable(v)]
    out = {}
    for q, v in good:
        if q in queries:
            near = sorted(((-cosine(v, w), i) for i, w in good if i != q))[:k]
            out[q] = [i for _, i in near]
    return out


def test_search_recall_scores_and_order(spark):
    rows = [*enumerate(vectors(2, 600)), *ODD]
    want = brute(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    df = frame(spark, rows)
    got = {}
    for r in rows_of(search(df, F.col("vec_id") % 50 == 0, k=5), "query_id", "rank"):
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == set(want)
    by_id = dict(rows)
    hits = 0
    for q, found in got.items():
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        assert all(r["score"] == pytest.approx(cosine(by_id[q], by_id[r["vec_id"]]), abs=1e-12) and r["vec_id"] != q for r in found)
        hits += len({r["vec_id"] for r in found} & set(want[q]))
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_search_with_all_lists_is_exact(spark):
    rows = [*enumerate(vectors(3, 200))]
    df = frame(spark, rows, clash=False)
    got = {}
    for r in rows_of(search(df, F.col("vec_id") % 20 == 0, k=5, probe_share=1.0), "query_id", "rank"):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute(rows, {i for i, _ in rows if i % 20 == 0}, 5)


def test_search_few_or_no_candidates(spark):
    v = vectors(4, 3)
    df = frame(spark, [(0, v[0]), (1, v[1]), (2, v[2])], clash=False)
    assert [r["vec_id"] for r in search(df, F.col("vec_id") == 0, k=5, probe_share=1.0).orderBy("rank").collect()] in ([1, 2], [2, 1])
    alone = frame(spark, [(0, v[0]), (901, [0.0] * 16)], clash=False)
    assert search(alone, F.col("vec_id") == 0).count() == 0
    empty = frame(spark, [], clash=False)
    assert search(empty, F.col("vec_id") == 0).count() == 0


def test_search_ties_go_to_the_smaller_id(spark):
    v = vectors(6, 60)
    rows = [(0, v[0]), *((100 + i, v[0]) for i in (7, 3, 9, 1, 5, 2, 8)), *((i, v[i]) for i in range(1, 50))]
    got = [r["vec_id"] for r in search(frame(spark, rows), F.col("vec_id") == 0, k=5, probe_share=1.0).orderBy("rank").collect()]
    assert got == [101, 102, 103, 105, 107]


def test_search_probes_on_until_there_are_k_rows(spark):
    v = vectors(7, 200)
    got = search(frame(spark, list(enumerate(v))), F.col("vec_id") % 20 == 0, k=5, probe_share=0.01).groupBy("query_id").count().collect()
    assert len(got) == 10 and all(r["count"] == 5 for r in got)


def test_vectors_of_another_length_take_no_part(spark):
    v = vectors(8, 40)
    rows = [*enumerate(v), (500, v[0][:8]), (550, v[0][:8])]
    assert not {r["vec_id"] for r in search(frame(spark, rows), F.col("vec_id") % 50 == 0, k=50, probe_share=1.0).collect()} & {500, 550}
    got = {r["vec_id"]: tuple(r)[1:4] for r in vector_near_duplicates(frame(spark, rows)).collect()}
    assert got[500] == (0, 500, True) and got[550] == (0, 550, True)
