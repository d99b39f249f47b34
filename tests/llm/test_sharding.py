import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lociflow.llm.sharding import FIRST, LOW_BITS, SECOND, grid, round_keys, row_number_at, shard_report, sharded, shuffled, write_shards

from .helpers import documents, with_clashing_names


def place(x, n, seed):
    """The permutation in plain Python."""
    high, low = grid(n)
    while True:
        u, v = divmod(x, low)
        for k, key in enumerate(round_keys(seed)):
            m = (high, low)[k % 2]
            f = v * FIRST + key
            f = ((f ^ (f >> 29)) & LOW_BITS) * SECOND
            u, v = v, (u + (f ^ (f >> 27)) % m) % m
        x = u * low + v
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 13, 24, 97, 1000, 4099])
def test_permutation(spark, n):
    df = spark.range(n).select("id", shuffled(F.col("id"), n).alias("y")).withColumn("back", shuffled(F.col("y"), n, back=True))
    got = df.collect()
    assert sorted(r["y"] for r in got) == list(range(n))
    assert all(r["back"] == r["id"] and r["y"] == place(r["id"], n, 13) for r in got)


def test_large_domain(spark):
    n = (1 << 59) + 12345
    ids = [0, 1, n - 1, n // 3]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select("id", shuffled(F.col("id"), n).alias("y")).withColumn("back", shuffled(F.col("y"), n, back=True)).collect()
    assert [(r["id"], r["y"], r["back"]) for r in got] == [(i, place(i, n, 13), i) for i in ids]


def test_shards_against_plain_python(spark):
    rows = [(i % 40, f"text {i % 7} é\U0001f600" * (i % 5)) for i in range(500)] + [(None, "x"), (3, None), (3, None), (4, "")]
    df = documents(spark, rows, extra=True)
    got = [tuple(r) for r in shard_report(df).collect()]
    n = len(rows)
    plain = sorted(((i is not None, i or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows)
    want = []
    for number, ((known, i), crc, size) in enumerate(plain):
        y = place(number, n, 13)
        want.append((i if known else None, size, crc, "rows", y % 24, y // 24, None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    counts = Counter(r[4] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 24
    slots = defaultdict(list)
    for r in got:
        slots[r[4]].append(r[5])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in shard_report(df.repartition(7)).collect())


def test_where_a_slot_comes_from(spark):
    df = documents(spark, [(i, f"t{i}") for i in range(101)])
    got = sharded(df, shards=7, seed=5).withColumn("number", row_number_at(F.col("shard"), F.col("slot"), 101, shards=7, seed=5)).collect()
    assert all(r["number"] == r["row_number"] == r["doc_id"] for r in got)


def test_defined_cases(spark):
    assert shard_report(documents(spark, [])).count() == 0
    one = shard_report(documents(spark, [(9, None)])).collect()
    assert [tuple(r) for r in one] == [(9, 8, 0, "rows", 0, 0, None)]
    long = shard_report(documents(spark, [(1, "word " * 200_000), (2, "b")])).collect()
    assert {r["doc_id"]: r["size"] for r in long} == {1: 1_000_008, 2: 9}


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(60)] + [(5, "text 5")]
    df = with_clashing_names(documents(spark, rows))
    write_shards(df, str(tmp_path / "out"), shards=5, rows_a_file=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(df.columns) <= set(back.columns)
    assert sorted((r["doc_id"], r["text"], r["size"]) for r in back.collect()) == sorted((i, t, "clash") for i, t in rows)
    slots = defaultdict(list)
    for r in back.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 5
