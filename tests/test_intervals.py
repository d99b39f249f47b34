import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.operators import intervals
from lociflow.operators.intervals import crowded_bins, disjoint, overlap_join, point_join, union_coverage


def side(r, n, name, spread=3000, longest=3):
    """Intervals of very different lengths, some empty, some inverted, some repeated."""
    starts = r.integers(0, spread, n)
    lengths = (10.0 ** r.uniform(-1, longest, n)).astype(int) - 1
    rows = [(i, str(r.choice(["c", "d"], p=[0.8, 0.2])), int(a), int(a + w)) for i, (a, w) in enumerate(zip(starts, lengths, strict=True))]
    return rows + [(n, "c", 5, 5), (n + 1, "c", 9, 3), (n + 2, "e", 0, 10), (n + 3, *rows[0][1:])]


def pairs_of(left, right):
    return sorted((i, j, min(e, f) - max(s, t)) for (i, c, s, e), (j, d, t, f) in itertools.product(left, right) if c == d and e > s and f > t and min(e, f) > max(s, t))


@pytest.mark.parametrize(("width", "crowd"), [(8, 4096), (8, 5), (64, 3), (65_536, 20)])
def test_overlap_join_equals_plain_join(spark, width, crowd):
    r = np.random.default_rng(width + crowd)
    left, right = side(r, 120, "l"), side(r, 150, "r", longest=4)
    a, b = spark.createDataFrame(left, "l long, chrom string, start long, end long"), spark.createDataFrame(right, "r long, chrom string, start long, end long")
    got = sorted((x["l"], x["r"], x["overlap_bp"]) for x in overlap_join(a, b, width, crowd).collect())
    assert got == pairs_of(left, right)
    points = [(i, c, s) for i, c, s, _ in left]
    hits = point_join(spark.createDataFrame(points, "l long, chrom string, pos long"), b, width, crowd)
    assert hits.columns == ["l", "chrom", "pos", "r", "start", "end"]
    assert sorted((x["l"], x["r"]) for x in hits.collect()) == sorted((i, j) for (i, c, p), (j, d, s, e) in itertools.product(points, right) if c == d and s <= p < e)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "l long, chrom string, start long, end long")
    some = spark.createDataFrame([(1, "c", 0, 10)], "r long, chrom string, start long, end long")
    assert overlap_join(none, some).count() == 0 and overlap_join(some, none.withColumnRenamed("l", "x")).count() == 0


def test_a_long_interval_lies_in_two_bins(spark):
    whole = spark.createDataFrame([(0, 250_000_000), (10, 20)], "start long, end long")
    cells = whole.select(F.size(intervals._cells("start", "end", 65_536, {0, 1, 2, 3, 4, 5}, {0, 4})).alias("n")).collect()
    assert max(c["n"] for c in cells) <= 2 * intervals.LEVELS


def test_half_of_all_peaks_in_one_bin(spark):
    """The crowded bin is dealt out: no task of the join holds more than five times the median, and no pair is lost."""
    n = 40_000
    spot = F.when(F.col("id") % 2 == 0, F.lit(7_000_000) + F.col("id") % 500).otherwise((F.col("id") * 7919) % 100_000_000)
    peaks = spark.range(n).select(F.lit("c").alias("chrom"), spot.alias("start"), (spot + 100).alias("end"), F.col("id").alias("r"))
    regions = spark.range(2000).select(F.lit("c").alias("chrom"), (F.col("id") * 50_000).alias("start"), (F.col("id") * 50_000 + 50_000).alias("end"), F.col("id").alias("l"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt, _, _ = crowded_bins(regions, peaks.withColumnsRenamed({"start": "r_start", "end": "r_end"}), 65_536, 200)
        assert [r["q"] for r in dealt.where("bin = 7000000 div 65536").collect()] and dealt.agg(F.max("q")).first()[0] >= 100
        pairs = overlap_join(regions, peaks, crowd=200)
        assert pairs.count() == pairs.select("l", "r").distinct().count()
        want = peaks.withColumn("l", F.explode(F.expr("sequence(start div 50000, (end - 1) div 50000)"))).where("l < 2000")
        assert pairs.count() == want.count()
        sizes = sorted(r["n"] for r in pairs.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sizes[-1] <= 5 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("width", [7, 64, 65_536])
def test_disjoint_pieces(spark, width):
    r = np.random.default_rng(width)
    rows = [(str(r.choice(["t", "u"])), *x[1:]) for x in side(r, 300, "x")] + [(None, "c", 0, 9), (None, "c", 3, 5)]
    got = disjoint(spark.createDataFrame(rows, "t string, chrom string, start long, end long"), ["t"], width).collect()
    covered, pieces = {}, {}
    for t, c, s, e in rows:
        covered.setdefault((t, c), set()).update(range(s, e))
    for x in got:
        pieces.setdefault((x["t"], x["chrom"]), []).extend(range(x["start"], x["end"]))
    assert {k: sorted(v) for k, v in covered.items() if v} == {k: sorted(v) for k, v in pieces.items()}


def test_union_coverage_of_repeated_starts(spark):
    r = np.random.default_rng(5)
    left, right = side(r, 40, "l", 300), [(*x, float(i % 7)) for i, x in enumerate(side(r, 200, "r", 300, 2))]
    a = spark.createDataFrame(left, "l long, chrom string, start long, end long")
    b = spark.createDataFrame([x[1:] for x in right], "chrom string, start long, end long, signal double")
    got = {x["l"]: (x["union_bp"], x["signal_bp"]) for x in union_coverage(overlap_join(a, b, 64, 10), ["l"]).collect()}
    want = {}
    for i, c, s, e in left:
        own = [(max(s, t), min(e, f), v) for _, d, t, f, v in right if c == d and e > s and f > t and min(e, f) > max(s, t)]
        if own:
            want[i] = (len(set().union(*(range(x, y) for x, y, _ in own))), pytest.approx(sum((y - x) * v for x, y, v in own)))
    assert got == want


@pytest.mark.parametrize("crowd", [3, 50_000])
def test_sums_by_track_make_no_pairs(spark, monkeypatch, crowd):
    """Regions and peaks of any length and place, crowded and not, equal the sums over pairs, but no pair is made."""
    from lociflow.operators import intervals, marks, profiles

    r = np.random.default_rng(9)
    lengths = lambda n: np.where(r.random(n) < 0.1, r.integers(-2, 9_000_000, n), r.integers(-2, 60_000, n))
    left = [(i, str(r.choice(["c", "d"])), int(s), int(s + n)) for i, (s, n) in enumerate(zip(r.integers(0, 2_000_000, 60), lengths(60), strict=True))] + [(60, "none", 5, 9), (61, "c", None, 9)]
    right = [(str(r.choice(["t", "u"])), "x", str(r.choice(["c", "d"])), int(s), int(s + n), float(v)) for s, n, v in zip(r.integers(0, 2_000_000, 500), lengths(500), r.random(500) * 1e5, strict=True)]
    right += [("v", "x", "c", 100, 900_000, float("nan")), ("w", "x", "d", 0, 1_500_000, float("inf")), ("w", "x", "d", 5, 9, None)]
    a = spark.createDataFrame(left, "region_id long, chrom string, start long, end long")
    b = spark.createDataFrame(right, "tissue string, assay string, chrom string, start long, end long, signal double")
    names = [(t, "x") for t in ("t", "u", "v", "w", "no")]
    want = {(x["region_id"], x["tissue"]): (x["union_bp"], x["signal_bp"]) for x in union_coverage(overlap_join(a, b), ["region_id", "tissue"]).collect()}

    def forbidden(*_, **__):
        raise AssertionError("pairs")

    for module in (intervals, marks):
        monkeypatch.setattr(module, "overlap_join", forbidden, raising=False)
    got = profiles.track_sums(a, b, names, with_signal=True, crowd=crowd).collect()
    assert sorted(x["region_id"] for x in got) == list(range(62))
    for x in got:
        if x["end"] is None or x["start"] is None or x["end"] <= x["start"]:
            assert x["covered"] is None
            continue
        for (t, _), n, w in zip(names, x["covered"], x["weight"], strict=True):
            union, signal = want.get((x["region_id"], t), (0, 0.0))
            assert n == union and w == pytest.approx(signal or 0.0, rel=1e-12, abs=1e-4, nan_ok=True)
    assert [list(x["covered"]) for x in sorted(profiles.track_sums(a, b, names, crowd=crowd).collect(), key=lambda x: x["region_id"]) if x["covered"] is not None] == [list(x["covered"]) for x in sorted(got, key=lambda x: x["region_id"]) if x["covered"] is not None]
    tracks = spark.createDataFrame(names, "tissue string, assay string")
    assert marks.track_coverage(a, b, tracks).count() == 62 * 5 and marks.track_means(a, b, tracks).count() == 5 and marks.track_activity(a, b, tracks).count() == 62 * 5


@pytest.mark.parametrize("few", [0, 5, 64])
def test_signal_sums_with_and_without_running_sums(monkeypatch, few):
    from lociflow.operators import profiles

    monkeypatch.setattr(profiles, "FEW", few)
    r = np.random.default_rng(few)
    a, s = r.integers(0, 5000, 300), r.integers(0, 5000, 50)
    b, e = a + r.integers(1, 300, 300), s + r.integers(1, 900, 50)
    signal = r.random(300) * 1e5
    shared = np.maximum(0, np.minimum(b[None], e[:, None]) - np.maximum(a[None], s[:, None]))
    assert profiles.signal_sums(a, b, signal, s, e) == pytest.approx((shared * signal).sum(1), rel=1e-12, abs=1e-6)
    signal[:3] = np.nan, np.inf, -np.inf
    want = np.where(shared > 0, shared * signal, 0).sum(1)
    assert profiles.signal_sums(a, b, signal, s, e) == pytest.approx(want, rel=1e-12, abs=1e-6, nan_ok=True)


@pytest.mark.parametrize("crowd", [3, 50_000])
def test_states_make_no_pairs(spark, monkeypatch, crowd):
    """Regions of any length, crowded and not, one id twice, and segments that overlap and recur equal a plain sum, but no pair is made."""
    from functools import partial

    from lociflow.operators import annotate, intervals, profiles

    r = np.random.default_rng(crowd)
    lengths = lambda n: np.where(r.random(n) < 0.1, r.integers(-2, 9_000_000, n), r.integers(-2, 60_000, n))
    place = lambda n: [(str(r.choice(["c", "d"])), int(s), int(s + x)) for s, x in zip(r.integers(-100_000, 2_000_000, n), lengths(n), strict=True)]
    left = [(i, *x) for i, x in enumerate(place(90))] + [(90, "none", 5, 9), (91, "c", None, 9), (7, "d", 0, 400_000), (None, "c", 0, 900_000)]
    left += [(100 + i, f"short{i}", 5 * i, 5 * i + 20) for i in range(30)]
    right = [(*x, str(r.choice(["u", "v", "w"]))) for x in place(400)]
    right += right[:50] + [(f"short{i}", 5 * i + at, 5 * i + at + 6, "uv"[at % 2]) for i in range(30) for at in (-3, 4, 9)] + [(None, 0, 900_000, "u")]
    want = {}
    for i, c, s, e in left:
        for d, t, f, state in right:
            if i is not None and s is not None and c == d and e > s and f > t and min(e, f) > max(s, t):
                own = want.setdefault(i, {})
                bp, first = own.get(state, (0, t))
                own[state] = (bp + min(e, f) - max(s, t), min(first, t))
    a = spark.createDataFrame(left, "region_id long, chrom string, start long, end long")
    b = spark.createDataFrame(right, "chrom string, start long, end long, state string")

    def forbidden(*_, **__):
        raise AssertionError("pairs")

    for module in (intervals, annotate):
        monkeypatch.setattr(module, "overlap_join", forbidden, raising=False)
    monkeypatch.setattr(annotate, "state_lists", partial(profiles.state_lists, crowd=crowd), raising=False)
    monkeypatch.setattr(profiles, "GROUPS", 5, raising=False)  # so that tiles share groups
    got = annotate.annotate_regions(a, b, ("u",)).collect()
    assert sorted((x["region_id"] is None, x["region_id"] or 0, x["chrom"]) for x in got) == sorted((i is None, i or 0, c) for i, c, _, _ in left)
    for x in got:
        own = want.get(x["region_id"], {})
        total = sum(bp for bp, _ in own.values())
        assert x["covered_bp"] == total
        assert x["dominant_state"] == max(own, key=lambda k: (own[k][0], -own[k][1]), default=None)
        assert x["composition"] == {k: bp / total for k, (bp, _) in own.items()}
        assert x["active_fraction"] == (own.get("u", (0,))[0] / total if own else None)
    lists = annotate.state_overlaps(a.where("region_id <> 7"), b).collect()
    assert {x["region_id"]: {y["state"]: (y["bp"], y["first"]) for y in x["states"]} for x in lists if x["states"]} == {i: x for i, x in want.items() if i != 7}
    for rows, segments in ((a.where("false"), b), (a, b.where("false")), (a.where("chrom = 'none'"), b)):
        assert all(x["covered_bp"] == 0 and x["dominant_state"] is None and x["composition"] == {} for x in annotate.annotate_regions(rows, segments, ("u",)).collect())


@pytest.mark.parametrize("name", ["label_enrichment", "dominant_label_counts"])
def test_labels_are_counted_in_one_pass(spark, sf_dir, name):
    from lociflow.plans import catalogue

    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapCoGroups") == 1


def test_short_chromosomes_share_groups_of_track_sums(spark, monkeypatch):
    """Bases by a plain count, and fewer groups than chromosomes."""
    from lociflow.operators import profiles

    monkeypatch.setattr(profiles, "GROUPS", 4)
    r = np.random.default_rng(6)
    some = [(f"c{r.integers(40)}", int(a), int(a + r.integers(1, 300))) for a in r.integers(-50, 1000, 200)]
    peaks = [(str(r.choice(["t", "u"])), "m", f"c{r.integers(40)}", int(a), int(a + r.integers(1, 200)), 1.0) for a in r.integers(0, 1000, 300)]
    found = profiles.track_sums(spark.createDataFrame(some, "chrom string, start long, end long"), spark.createDataFrame(peaks, "tissue string, assay string, chrom string, start long, end long, signal double"), [("t", "m"), ("u", "m")])
    assert "__group" in found._jdf.queryExecution().optimizedPlan().toString()
    bases = lambda c, s, e, t: len({x for p in peaks if p[0] == t and p[2] == c for x in range(max(s, p[3]), min(e, p[4]))})
    assert sorted((x["chrom"], x["start"], x["end"], *x["covered"]) for x in found.collect()) == sorted((*x, bases(*x, "t"), bases(*x, "u")) for x in some)
