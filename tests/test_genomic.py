import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.functions import ranking, stats
from lociflow.functions.keys import bin_part, feature_key, normal_key, tissue_group
from lociflow.operators import annotate, atlas, attribute, enrich, liftover, marks, nulls, selection, shap, tissue
from lociflow.operators.intervals import overlap_join
from lociflow.schema import ACTIVE_MARKS, ACTIVE_STATES, MARKS, chromosome_sizes, panel_roles, state_vocabulary

REGION = "region_id long, chrom string, start long, end long"
PEAK = "tissue string, assay string, chrom string, start long, end long, signal double"


def regions(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], REGION)


def toy(spark):
    return spark.createDataFrame([("chrT", 0, 1000, "TssA"), ("chrT", 1000, 2000, "Quies")], "chrom string, start long, end long, state string")


def test_states_of_regions(spark):
    got = annotate.annotate_regions(regions(spark, ("chrT", 500, 1500), ("chrT", 0, 800), ("chrT", 5000, 6000), ("chrT", 500, 1500)), toy(spark), ACTIVE_STATES).orderBy("region_id").collect()
    assert [r["dominant_state"] for r in got] == ["TssA", "TssA", None, "TssA"]
    assert got[0]["composition"] == {"TssA": 0.5, "Quies": 0.5} and got[1]["active_fraction"] == 1.0
    assert got[2]["covered_bp"] == 0 and got[2]["active_fraction"] is None and got[2]["composition"] == {}


def test_overlap_join_equals_plain_join(spark):
    r = np.random.default_rng(1)
    side = lambda n: [("c", int(a), int(a + w)) for a, w in zip(r.integers(0, 900, n), r.integers(-3, 200, n), strict=True)]
    left, right = side(60), side(60)
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "l long, chrom string, start long, end long")
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(right)], "r long, chrom string, start long, end long")
    got = sorted((x["l"], x["r"], x["overlap_bp"]) for x in overlap_join(a, b, width=64).collect())
    want = sorted((i, j, min(x[2], y[2]) - max(x[1], y[1])) for (i, x), (j, y) in itertools.product(enumerate(left), enumerate(right)) if x[2] > x[1] and y[2] > y[1] and min(x[2], y[2]) > max(x[1], y[1]))
    assert got == want


def test_union_coverage_and_signal(spark):
    peaks = spark.createDataFrame([("t", "H3K27ac", "chr1", 120, 170, 5.0), ("u", "H3K27ac", "chr1", 100, 160, 1.0), ("u", "H3K27ac", "chr1", 140, 200, 1.0), ("n", "H3K27ac", "chr1", 0, 1000, 2.0), ("n", "H3K27ac", "chr1", 110, 120, 2.0)], PEAK)
    tracks = spark.createDataFrame([(t, "H3K27ac") for t in ("t", "u", "n", "none")], "tissue string, assay string")
    got = {r["tissue"]: r for r in marks.track_coverage(regions(spark, ("chr1", 100, 200)), peaks, tracks).collect()}
    assert got["t"]["coverage"] == 0.5 and got["t"]["mean_signal"] == 5.0
    assert got["u"]["coverage"] == 1.0 and got["u"]["mean_signal"] == pytest.approx(1.2)
    assert got["n"]["coverage"] == 1.0 and (got["none"]["coverage"], got["none"]["mean_signal"]) == (0, 0)


PANEL = {"signal": ("keratinocyte",), "background": ("neutrophil", "Bcell"), "inflammation": ("monocyte",), "control": ("K562",)}
ORDER = ("keratinocyte", "monocyte", "neutrophil", "Bcell", "K562")


@pytest.mark.parametrize("levels, call", [((0.8, 0, 0, 0, 0), "signal"), ((0.7,) * 5, "ambiguous"), ((0, 0.8, 0, 0, 0), "inflammation"), ((0,) * 5, "unexplained"), ((0, 0, 0.8, 0.7, 0), "background")])
def test_attribution(spark, levels, call):
    some = regions(spark, *[("chr1", 1000, 3000)] * 5)
    peaks = spark.createDataFrame([(t, m, "chr1", 1000, 1000 + int(2000 * c), 1.0) for t, c in zip(ORDER, levels, strict=True) for m in ACTIVE_MARKS], PEAK)
    tracks = spark.createDataFrame([(t, m) for t in ORDER for m in MARKS], "tissue string, assay string")
    got = attribute.attribute_regions(marks.activity(marks.track_coverage(some, peaks, tracks)), some, panel_roles(spark, PANEL))
    assert {(r["compartment"], r["called_open"]) for r in got.collect()} == {(call, call != "unexplained")}
    summary = attribute.attribution_summary(got).first()
    assert summary["n"] == 5 and summary["fractions"] == {call: 1.0} and summary["signal_fraction"] == float(call == "signal")


def test_roles_of_a_tissue_in_two(spark):
    roles = panel_roles(spark, {"signal": ("x",), "background": ("x", "y")})
    assert {r["tissue"]: r["role"] for r in attribute.panel_tissues(roles).collect()} == {"x": "signal", "y": "background"}
    assert {r["tissue"]: r["compartment"] for r in attribute.compartments(roles).collect()} == {"x": "background", "y": "background"}


def test_label_enrichment_is_the_binomial_law(spark):
    counts = spark.createDataFrame([("A", 9, 20, 30, 100), ("B", 0, 20, 0, 100)], "label string, q long, nq long, b long, nb long")
    got = {r["label"]: r for r in enrich.label_enrichment(counts).collect()}
    eps, p = 0.5 / 20, 0.3
    fold = lambda k: math.log2((k / 20 + eps) / (p + eps))
    want = sum(math.comb(20, k) * p**k * (1 - p) ** (20 - k) for k in range(21) if abs(fold(k)) >= abs(fold(9)) - 1e-12)
    assert got["A"]["p"] == pytest.approx(want) and got["A"]["log2_fold"] == pytest.approx(fold(9)) and got["B"]["p"] == pytest.approx(1.0)


def test_sequence_content_and_matched_background(spark):
    seq = "GC" * 500 + "at" * 400 + "N" * 200
    pieces = spark.createDataFrame([("chrT", i, seq[i * 64 : (i + 1) * 64]) for i in range(-(-len(seq) // 64))], "chrom string, chunk long, seq string")
    chunks = nulls.genome_chunks(pieces, 64)
    asked = regions(spark, ("chrT", 900, 1100), ("chrT", -50, 30), ("chrT", 1800, 5000), ("chrT", 1900, 1950), ("chrT", 3000, 3100), ("nowhere", 0, 10))
    got = nulls.region_content(asked, chunks, 64).orderBy("region_id").collect()
    for r, (a, b) in zip(got, ((900, 1100), (0, 30), (1800, 2000), (1900, 1950), (2000, 2000), (0, 0)), strict=True):
        s = seq[a:b].upper()
        known = len(s) - s.count("N")
        assert (r["length"], r["nfrac"]) == (len(s), s.count("N") / len(s) if s else 1.0)
        assert r["gc"] == (pytest.approx((s.count("G") + s.count("C")) / known) if known else None)
    null, meta = nulls.sample_matched(regions(spark, ("chrT", 0, 200), ("chrT", 1900, 1950)), chunks, 64, n_per=10, gc_tol=0.05)
    assert all(r["end"] - r["start"] == 200 and r["start"] <= 810 for r in null.collect()) and null.count() >= 8
    assert [(r["reason"], r["matched"]) for r in meta.orderBy("region_id").collect()][1] == ("query undefined GC", 0)
    assert null.exceptAll(nulls.sample_matched(regions(spark, ("chrT", 0, 200), ("chrT", 1900, 1950)), chunks, 64, n_per=10, gc_tol=0.05)[0]).count() == 0


def test_sums_by_track_equal_the_dense_frame(spark):
    r = np.random.default_rng(8)
    some = regions(spark, *[(f"chr{r.integers(2)}", int(a), int(a + r.integers(0, 900))) for a in r.integers(0, 200_000, 80)], ("chr9", 0, 10))
    rows = [(str(r.choice(["t", "u"])), str(r.choice(MARKS)), f"chr{r.integers(2)}", int(a), int(a + r.integers(-2, 4000)), 1.0) for a in r.integers(0, 200_000, 900)]
    peaks, tracks = spark.createDataFrame(rows, PEAK), spark.createDataFrame([(t, m) for t in ("t", "u", "none") for m in MARKS], "tissue string, assay string")
    dense = marks.track_coverage(some, peaks, tracks).cache()
    key = lambda df, *by: {tuple(x[b] for b in by): pytest.approx(x[df.columns[-1]]) for x in df.collect()}
    assert key(marks.track_activity(some, peaks, tracks), "region_id", "tissue") == key(marks.activity(dense), "region_id", "tissue")
    assert key(marks.track_means(some, peaks, tracks), "tissue", "assay") == key(marks.mean_coverage(dense), "tissue", "assay")


def test_any_number_of_chromosomes(spark):
    """More chromosomes than an expression could list: each has its place, and no draw is lost."""
    n = 100_002
    chunks = nulls.genome_chunks(spark.range(n).select(F.format_string("c%d", "id").alias("chrom"), F.lit(0).cast("long").alias("chunk"), F.lit("GATC").alias("seq")), 10)
    line, total, step = nulls.chromosome_places(chunks)
    assert total == 4 * n and line.select("chrom").distinct().count() == n
    spans = line.select("chrom", "begin", "size").distinct().agg(F.sum("size"), F.max(F.col("begin") + F.col("size")), F.count_distinct("begin")).first()
    assert tuple(spans) == (4 * n, 4 * n, n)
    sets = nulls.sample_sets(chunks, 10, n_sets=20, set_size=50, length=2)
    assert sets.count() == 1000 and sets.where("chrom is null or start < 0 or end > 4").count() == 0


def test_tries_do_not_go_to_every_task(spark):
    """A small table of queries comes to many tries; they meet the places, which are few, where they are."""
    chunks = nulls.genome_chunks(spark.range(5000).select(F.format_string("c%d", "id").alias("chrom"), F.lit(0).cast("long").alias("chunk"), F.lit("GATC").alias("seq")), 10)
    tries = spark.range(10).select(F.col("id").alias("region_id"), F.explode(F.sequence(F.lit(0), F.lit(9999))).alias("try"), F.lit(2).cast("long").alias("length"))
    placed = nulls._placed(tries, nulls.chromosome_places(chunks), 0, ["region_id", "try"])
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert placed.count() == 100_000


def test_enrichment_against_matched_background(spark):
    """Promoter regions stand out; blank background and calibration come from the same chain."""
    seq = "GATC" * 2500
    pieces = spark.createDataFrame([("chrT", i, seq[i * 500 : (i + 1) * 500]) for i in range(20)], "chrom string, chunk long, seq string")
    chunks = nulls.genome_chunks(pieces, 500)
    states = spark.createDataFrame([("chrT", 0, 1000, "TssA"), ("chrT", 1000, 10_000, "Quies")], "chrom string, start long, end long, state string")
    labels = spark.createDataFrame([("TssA", "Promoter"), ("Quies", "Quiescent")], "state string, label string")
    tests, meta = enrich.state_enrichment_test(regions(spark, *[("chrT", 0, 300)] * 10), states, chunks, 500, labels, n_per=20, gc_tol=1.0)
    got = {r["label"]: r for r in tests.collect()}
    assert got["Promoter"]["log2_fold"] > 2 and got["Promoter"]["p"] < 0.01 and got["Promoter"]["n_null"] == 200 and meta.agg(F.sum("matched")).first()[0] == 200
    peaks = spark.createDataFrame([("t", "DNase", "chrT", 0, 1000, 5.0)], PEAK)
    opened, _ = enrich.track_enrichment_test(regions(spark, *[("chrT", 0, 300)] * 10), peaks, spark.createDataFrame([("t", "DNase")], "tissue string, assay string"), chunks, 500, n_boot=200, n_per=20)
    row = opened.first()
    assert row["query_mean"] == 1.0 and row["null_mean"] < 0.3 and row["log2_fold"] > 1.5 and 0 < row["p"] <= 1
    summary, each = enrich.calibration_run(states, chunks, 500, labels, n_sets=12, set_size=8, region_length=300, n_per=10)
    assert each.count() == 24 and {r["label"] for r in summary.collect()} == {"Promoter", "Quiescent"} and all(r["n"] == 12 and r["fpr"] <= 0.5 for r in summary.collect())


def test_binomial_tails():
    for n, share, seen in ((20, 0.3, 9), (20, 0.0, 0), (7, 1.0, 7), (50, 0.01, 3), (400, 0.5, 170)):
        eps = 0.5 / n
        fold = lambda k: math.log2((k / n + eps) / (share + eps))  # noqa: B023, E731
        law = [math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(n + 1)]
        p, lo, hi = stats.fold_test(n, share, eps, fold(seen))
        assert p == pytest.approx(min(1.0, sum(m for k, m in enumerate(law) if abs(fold(k)) >= abs(fold(seen)) - 1e-12)))
        below = np.cumsum(law)
        assert [lo, hi] == pytest.approx([fold(int(np.argmax(below >= q - 1e-12))) for q in (0.025, 0.975)])


def test_global_rank_with_outliers(spark):
    values = [1e18, -1e18, None, *[float(i % 40) for i in range(500)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = sorted((r["v"], r["k"]) for r in ranking.with_global_rank(df, "v", "k").collect() if r["v"] is not None)
    known = sorted(v for v in values if v is not None)
    assert got == [(v, known.index(v) + (known.count(v) + 1) / 2) for v in known]


def test_coverage_enrichment_of_open_regions(spark):
    query = spark.createDataFrame([("t", i, 1.0) for i in range(2)], "assay string, item long, coverage double")
    null = spark.createDataFrame([("t", i, 0.0) for i in range(50)], "assay string, item long, coverage double")
    r = enrich.coverage_enrichment(query, null, n_boot=50).first()
    assert r["query_mean"] > 0.9 and r["null_mean"] < 0.01 and r["log2_fold"] > 2 and r["p"] == pytest.approx(1 / 51)


KEYS = [f"chr1:{i}-{i + 10}" for i in (10, 20, 30)]
MATRIX = "sample_id string, bin_key string, value double"


def test_rankings(spark):
    rows = [(s, k, sign * v) for k, v in zip(KEYS, (0.01, 0.5, 0.1), strict=True) for s, sign in (("a", 1), ("b", -1))]
    got = selection.rank_by_shap(spark.createDataFrame(rows, MATRIX)).orderBy("rank").collect()
    assert [r["bin_key"] for r in got] == [KEYS[1], KEYS[2], KEYS[0]] and all(abs(r["direction"]) < 1e-12 for r in got)
    r = np.random.default_rng(2)
    rows = [(f"{g}{i}", k, float(r.normal() + (g == "B" and k == KEYS[0]))) for g in "AB" for i in range(20) for k in KEYS]
    labels = spark.createDataFrame([(f"{g}{i}", g) for g in "AB" for i in range(20)], "sample_id string, label string")
    first = selection.rank_by_differential(spark.createDataFrame(rows, MATRIX), labels, positive="A").orderBy("rank").first()
    assert first["bin_key"] == KEYS[0] and first["direction"] < 0 and first["p"] < 0.05
    bins = spark.createDataFrame([(i,) for i in range(1, 11)], "rank int")
    assert selection.top_regions(bins, top_n=3).count() == 3 and selection.top_regions(bins, top_n=3, top_frac=0.5).count() == 5
    with pytest.raises(ValueError):
        selection.group_pair(labels.where("label = 'A'"))


def test_tails():
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.mann_whitney_p(0, 3, 3, 0) == pytest.approx(0.1) and stats.mann_whitney_p(50, 10, 10, 0) == 1.0
    assert stats.kolmogorov_sf(0.0, 10) == 1.0 and stats.kolmogorov_sf(1.0, 50) < 1e-9


def test_shapley_values(spark):
    tree = shap.Tree([0, 1, -1, -1, 0, -1, -1], [0.5, 0.3, 0, 0, 0.8, 0, 0], [1, 2, 0, 0, 5, 0, 0], [4, 3, 0, 0, 6, 0, 0], [0, 0, 1.0, 4.0, 0, 2.0, 7.0], [10, 6, 2, 4, 4, 1, 3])
    for x in ([0.2, 0.9], [0.6, 0.1], [0.9, 0.9]):
        x = np.array(x)
        f = lambda known: tree.expected(x, frozenset(known))  # noqa: E731,B023
        want = [(f({0}) - f(()) + f({0, 1}) - f({1})) / 2, (f({1}) - f(()) + f({0, 1}) - f({0})) / 2]
        assert shap.tree_shap([tree], x) == pytest.approx(want)
    rows = spark.createDataFrame([(s, k, float(v)) for s, row in (("a", (1, 2, 3)), ("b", (3, 2, 1))) for k, v in zip(KEYS, row, strict=True)], MATRIX)
    linear = shap.linear_shap(rows, spark.createDataFrame([(KEYS[0], 5.0)], "bin_key string, weight double"))
    assert sorted((r["sample_id"], r["value"]) for r in linear.collect()) == [("a", -5.0), ("b", 5.0)]
    got = shap.sampled_shap(shap.wide_rows(rows, KEYS), KEYS, lambda x: x @ np.array([1.0, 2.0, 3.0]), np.zeros((1, 3)), orders=4)
    assert {(r["sample_id"], r["bin_key"]): r["value"] for r in got.collect()}[("a", KEYS[2])] == pytest.approx(9.0)


class Lasso:
    coef_ = np.array([1.0, 2.0, 3.0])


class Doubt:
    def predict_proba(self, x):
        return np.stack([1 - x @ Lasso.coef_, x @ Lasso.coef_], 1)


class Plain:
    def predict(self, x):
        return x @ Lasso.coef_


def test_kinds_of_models(spark):
    rows = spark.createDataFrame([(s, k, float(v)) for s, row in (("a", (1, 2, 3)), ("b", (3, 2, 1))) for k, v in zip(KEYS, row, strict=True)], MATRIX)
    assert [shap.explainer_kind(m) for m in (Lasso(), Doubt(), type("RandomForestRegressor", (), {})())] == ["linear", "kernel", "tree"]
    want = {("a", KEYS[0]): -1.0, ("b", KEYS[0]): 1.0, ("a", KEYS[1]): 0.0, ("b", KEYS[1]): 0.0, ("a", KEYS[2]): 3.0, ("b", KEYS[2]): -3.0}
    for model in (Lasso(), Doubt(), Plain()):
        got = {(r["sample_id"], r["bin_key"]): r["value"] for r in shap.shap_of_model(rows, model, KEYS, np.full((1, 3), 2.0)).collect()}
        assert got == pytest.approx(want)
    got = {(r["sample_id"], r["bin_key"]): r["value"] for r in shap.shap_of_model(rows, Lasso(), KEYS, np.zeros((1, 3))).collect()}
    assert got[("a", KEYS[2])] == 9.0
    classes = rows.withColumn("class", F.lit(0)).unionByName(rows.withColumns({"class": F.lit(1), "value": F.col("value") + 1}))
    assert sorted(r["value"] for r in shap.last_class(classes).collect()) == [2.0, 2.0, 3.0, 3.0, 4.0, 4.0]


def test_long_atlas_takes_the_last_of_equal_keys(spark):
    wide = spark.createDataFrame([("chr1:0-5", 1.0, 9.0, 3.0), ("chr1:0-5", 2.0, 9.0, None)], "key string, C_lung double, C_infl_specific double, H_lung double").coalesce(1)
    assert atlas.tissue_columns(["C_lung", "C_background", "C_infl_specific", "H_lung", "key"], "C") == ["lung".join(["C_", ""])]
    assert [tuple(r) for r in atlas.long_atlas(wide, "C").collect()] == [("chr1:0-5", "lung", "C", 2.0)]
    rows = spark.createDataFrame([("lung", "D", "x"), ("skin", "D", "y")], "group string, assay string, file_accession string")
    assert atlas.panel_from_catalog(rows, F.col("assay"), groups=("lung",)).count() == 1


BLOCKS = "chrom string, start long, end long, to_chrom string, to_start long, to_strand string, to_size long, score double"


def test_lifting(spark):
    blocks = spark.createDataFrame([("chr1", 0, 1000, "chr1", 1000, "+", 9000, 9.0), ("chr1", 1000, 2000, "chrZ", 0, "+", 9000, 9.0), ("chr2", 0, 1000, "chr2", 8000, "-", 9000, 9.0)], BLOCKS)
    some = regions(spark, ("chr1", 100, 600), ("chr2", 200, 700), ("chr1", 900, 1100), ("chr3", 1, 5), ("chr1", 5, 5)).withColumn("importance", F.lit(1.5))
    lifted, counts = liftover.lift_regions(some, blocks)
    assert {(r["chrom"], r["start"], r["end"], r["importance"]) for r in lifted.collect()} == {("chr1", 1100, 1600, 1.5), ("chr2", 299, 799, 1.5)}
    assert counts.first().asDict() == {"n_in": 5, "n_mapped": 2, "mapping_rate": 0.4, "dropped_unmapped": 1, "dropped_diff_chrom": 1, "dropped_degenerate": 1, "dropped_round_trip": 0}


def test_atlas_bins_and_contrasts(spark):
    sizes = spark.createDataFrame([("chr1", 250)], "chrom string, size long")
    from lociflow.operators.intervals import bin_grid

    grid = bin_grid(sizes, 100)
    assert [(r["start"], r["end"]) for r in grid.orderBy("start").collect()] == [(0, 100), (100, 200), (200, 250)]
    peaks = spark.createDataFrame([("t", "DNase", "1", "chr1", 50, 150, 2.0), ("t", "DNase", "1", "chr1", 0, 100, 4.0), ("t", "DNase", "1", "chr9", 0, 5, 1.0)], "tissue string, assay string, replicate string, chrom string, start long, end long, signal double")
    cov = {r["bin_key"]: r["coverage"] for r in atlas.peaks_to_coverage(peaks, grid, 100).collect()}
    assert cov == {"chr1:0-100": 1.0, "chr1:100-200": 0.5, "chr1:200-250": 0.0}
    weighted = {r["bin_key"]: r["coverage"] for r in atlas.peaks_to_coverage(peaks, grid, 100, weighted=True).collect()}
    assert weighted["chr1:0-100"] == pytest.approx((50 * 2 + 100 * 4) / 150)
    z = [r["value"] for r in atlas.aggregate_replicates(atlas.peaks_to_coverage(peaks, grid, 100)).orderBy("bin_key").collect()]
    assert z == pytest.approx([math.sqrt(1.5), 0, -math.sqrt(1.5)])
    assert sum(-(-r["size"] // 50_000) for r in chromosome_sizes(spark, "hg19").collect()) == 57_633


def test_permutations_agree_with_closed_form(spark):
    r = np.random.default_rng(3)
    rows = [(f"b{i}", t, float(r.normal())) for i in range(200) for t in ("x", "y")]
    spec = tissue.specificity(spark.createDataFrame(rows, "bin_key string, tissue string, value double")).cache()
    top = tissue.top_bins(spark.createDataFrame([(f"b{i}", 200.0 - i) for i in range(200)], "key string, importance double"), spec, (20,))
    z = {x["tissue"]: x["abs_z"] for x in tissue.tissue_enrichment(spec, top).collect()}
    p = {x["tissue"]: x["abs_p"] for x in tissue.permutation_p(spec, top, n_perm=1000).collect()}
    for t in ("x", "y"):
        assert p[t] == pytest.approx(math.erfc(abs(z[t]) / math.sqrt(2)), abs=0.07)


def test_names(spark):
    names = ["chr19:50000000-50500000", "chr7_157000000_157500000", "x chr1:5-9"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(bin_part(F.col("n"), 1), bin_part(F.col("n"), 2), bin_part(F.col("n"), 3)).collect()
    assert [tuple(r) for r in got] == [("chr19", 50000000, 50500000), ("chr7", 157000000, 157500000), ("chr1", 5, 9)]
    r = spark.createDataFrame([("chr1:5:9", "CD34-positive", "adrenal gland")], "n string, a string, b string")
    row = r.select(normal_key(F.col("n")), feature_key(F.col("n")), tissue_group(F.col("a")), tissue_group(F.col("a"), whole_words=True), tissue_group(F.col("b"))).first()
    assert tuple(row)[:3] == ("chr1:5-9", "chr1:5-9", "Tcell") and row[4] == "kidney"
    assert state_vocabulary(spark).count() == 18


def test_readers_and_stream(spark, tmp_path):
    from lociflow.sources import readers, writers
    from lociflow.streaming.annotate import annotate_stream

    (tmp_path / "seg.bed").write_text("chrT\t0\t1000\tTssA\t0\nchrT\t1000\t2000\tQuies\t0\n")
    seg = readers.read_segmentation(spark, str(tmp_path / "seg.bed"))
    assert seg.count() == 2
    (tmp_path / "p.bed").write_text("chr1\t1\t5\t2.5\nchr1\t7\t9\nchr2\t1\t2\t.\nshort\t1\n")
    assert sorted(r["signal"] for r in readers.read_peaks(spark, str(tmp_path / "p.bed")).collect()) == [1.0, 1.0, 2.5]
    (tmp_path / "x.fa").write_text(">chrT\nACGT\nNNgc\n>more\nTT\n")
    seq = "".join(r["seq"] for r in readers.read_fasta(spark, str(tmp_path / "x.fa"), "chrT", width=3).orderBy("chunk").collect())
    assert seq == "ACGTNNgcTT"
    (tmp_path / "m.csv").write_text("sample,chr1:1-2,chr1:2-3\ns1,0.5,1\ns2,,2\n")
    assert sorted((r["sample_id"], r["bin_key"], r["value"]) for r in readers.read_matrix(spark, str(tmp_path / "m.csv")).where("value is not null").collect()) == [("s1", "chr1:1-2", 0.5), ("s1", "chr1:2-3", 1.0), ("s2", "chr1:2-3", 2.0)]
    (tmp_path / "t.csv").write_text('bin,s1,"s,2"\n"chr1:1-2",0.5,NA\nchr1:2-3,,2\n')
    assert sorted((r["sample_id"], r["bin_key"], r["value"]) for r in readers.read_matrix(spark, str(tmp_path / "t.csv"), samples_axis=1).where("value is not null").collect()) == [("s,2", "chr1:2-3", 2.0), ("s1", "chr1:1-2", 0.5)]
    (tmp_path / "j.csv").write_text("sample,chr1:1-2\ns1,junk\n")
    with pytest.raises(Exception, match="junk"):
        readers.read_matrix(spark, str(tmp_path / "j.csv")).collect()
    (tmp_path / "j.bed").write_text("chr1\t1\t5\tjunk\n")
    with pytest.raises(Exception, match="junk"):
        readers.read_peaks(spark, str(tmp_path / "j.bed")).collect()
    found = readers.with_tissue_group(spark.createDataFrame([("Liver", 1)], "`Biosample term name` string, n int"))
    assert found.first()["group"] == "liver"
    (tmp_path / "c.chain").write_text("chain 1000 chr1 9000 + 100 500 chr1 9000 + 1100 1510 1\n100 50 60\n250\n\n")
    assert [(r["start"], r["end"], r["to_start"]) for r in readers.read_chain(spark, str(tmp_path / "c.chain")).orderBy("start").collect()] == [(100, 200, 1100), (250, 500, 1260)]
    writers.write_parquet(regions(spark, ("chrT", 500, 1500), ("chrT", 0, 800)), str(tmp_path / "in"))
    stream = spark.readStream.schema(REGION).parquet(str(tmp_path / "in"))
    annotate_stream(stream, toy(spark), ACTIVE_STATES, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_queries_draw_as_often_as_their_operators(spark, sf_dir, monkeypatch):
    import inspect

    from lociflow.operators import enrich, nulls, shap, tissue
    from lociflow.plans import background, catalogue  # noqa: F401

    class Called(Exception):
        pass

    for query, module, name, draws in (
        ("matched_background", nulls, "sample_matched", {"n_per": 100, "tries": 200}), ("coverage_enrichment", enrich, "coverage_enrichment", {"n_boot": 1000}),
        ("tissue_permutations", tissue, "permutation_p", {"n_perm": 2000}), ("sampled_shap", shap, "sampled_shap", {"orders": 64}),
    ):
        signature = inspect.signature(getattr(module, name))

        def spy(*args, signature=signature, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            raise Called(bound.arguments)

        monkeypatch.setattr(module, name, spy)
        with pytest.raises(Called) as caught:
            catalogue.QUERIES[query](spark, sf_dir)
        arguments = caught.value.args[0]
        assert {k: arguments[k] for k in draws} == draws
        if query == "sampled_shap":
            assert len(arguments["background"]) == 10


def test_draws_of_one_assay_lie_in_many_tasks(spark, monkeypatch):
    """Each draw takes the row numbered by its task, so draws of one task alone would all have one mean."""
    rows = lambda n: spark.range(n).select(F.lit("a").alias("assay"), F.col("id").alias("item"), F.col("id").cast("double").alias("coverage"))
    monkeypatch.setattr(enrich, "unit_hash", lambda *_: F.spark_partition_id() / 1000.0)
    out = enrich.coverage_enrichment(rows(3), rows(1000), n_boot=64).first()
    assert out["null_lo"] < out["null_hi"]


def test_sums_of_chunks_go_on_over_segments(spark, monkeypatch):
    r = np.random.default_rng(5)
    texts = {f"c{i}": "".join(r.choice(list("ACGTNgc"), 64 * 40 + i)) for i in range(3)}
    pieces = spark.createDataFrame([(c, k, s[k * 64 : (k + 1) * 64]) for c, s in texts.items() for k in range(-(-len(s) // 64))], "chrom string, chunk long, seq string")
    monkeypatch.setattr(nulls, "SEGMENT", 7, raising=False)
    for c, k, gc, nn in nulls.genome_chunks(pieces, 64).select("chrom", "chunk", "cum_gc", "cum_nn").collect():
        before = texts[c][: 64 * k].upper()
        assert (gc, nn) == (before.count("G") + before.count("C"), before.count("N"))


def test_texts_are_cut_in_one_pass(spark, tmp_path):
    """No substring for each chunk, which reads a text from its start each time."""
    from lociflow.plans import adapters

    texts = ["ab\nc\u00e9\U0001f600\r\n" * 30, "x" * 64, "y" * 65, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = adapters.sequences(spark, str(tmp_path), 64)
    want = sorted((f"doc{i}", k, t[k * 64 : (k + 1) * 64]) for i, t in enumerate(texts) if t for k in range(-(-len(t) // 64)))
    assert sorted(map(tuple, got.collect())) == want and "substring" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_tries_are_counted_in_pages(spark, monkeypatch):
    """Matched regions by a plain loop: of chromosomes that share a page, of ones with several pages, and of regions longer than a page."""
    import hashlib

    r = np.random.default_rng(12)
    texts = {f"c{i}": "".join(r.choice(list("ACGTNgcn\u00e9"), n, p=(0.2, 0.15, 0.15, 0.2, 0.02, 0.12, 0.1, 0.02, 0.04))) for i, n in enumerate((40, 7, 64, 65, 500, 30, 1, 300, 20, 90))}
    pieces = spark.createDataFrame([(c, k, s[k * 8 : (k + 1) * 8]) for c, s in texts.items() for k in range(-(-len(s) // 8))], "chrom string, chunk long, seq string")
    asked = regions(spark, ("c4", 3, 23), ("c0", -5, 12), ("c3", 0, 64), ("c7", 10, 110), ("c2", 60, 200), ("c6", 5, 9), ("nowhere", 0, 10), ("c9", 70, 95))
    monkeypatch.setattr(nulls, "PAGE", 64)
    monkeypatch.setattr(nulls, "CROWD", 50)
    chunks = nulls.genome_chunks(pieces, 8)
    null, meta = nulls.sample_matched(asked, chunks, 8, n_per=6, gc_tol=0.05, seed=3, tries=70)
    order = sorted(texts, key=lambda c: (hashlib.md5(c.encode()).hexdigest()[:2], c))
    begins = np.concatenate([[0], np.cumsum([len(texts[c]) for c in order])])

    def unit(*parts):
        return int(hashlib.md5("/".join(map(str, parts)).encode()).hexdigest()[:12], 16) / 2**48

    def content(s):
        s = s.lower()
        known = len(s) - s.count("n")
        return (s.count("g") + s.count("c")) / known if known else None, s.count("n") / max(1, len(s))

    want, wanted = set(), {}
    for q, c, a, b in asked.collect():
        own = texts.get(c, "")[max(a, 0) : b]
        gc = content(own)[0]
        wanted[q] = (gc if gc is None else pytest.approx(gc), len(own), 0)
        for draw in range(6 if gc is not None else 0):
            for k in range(70):
                at = math.floor(unit(3, "chrom", q, draw, k) * begins[-1])
                home = order[np.searchsorted(begins, at, "right") - 1]
                if (room := len(texts[home]) - len(own)) > 0:
                    start = math.floor(unit(3, "start", q, draw, k) * room)
                    found, nfrac = content(texts[home][start : start + len(own)])
                    if found is not None and gc - 0.05 <= found <= gc + 0.05 and nfrac <= 0.1:
                        want.add((q, draw, home, start, start + len(own)))
                        wanted[q] = (*wanted[q][:2], wanted[q][2] + 1)
                        break
    assert {tuple(x) for x in null.collect()} == want and null.count() == len(want) and {q for q, *_ in want} >= {0, 2, 3}
    assert {x["region_id"]: (x["gc"], x["length"], x["matched"]) for x in meta.collect()} == wanted


@pytest.mark.parametrize("head", ["0/H3K27ac/7", "x" * 53, "y" * 61, "z" * 130, "\u00e9/1"])
def test_draws_in_arrays_are_the_hashes(spark, head):
    from lociflow.functions import draws
    from lociflow.functions.keys import unit_hash

    some = (0, 9, 10, 99, 100, 65_535, 65_536, 99_999, 100_000, 131_072, 140_000)
    got = np.concatenate(list(draws.unit_hashes(head, 140_001)))
    assert len(got) == 140_001
    want = spark.createDataFrame([(i,) for i in some], "i long").select(unit_hash(head, F.col("i"))).collect()
    assert [got[i] for i in some] == [x[0] for x in want]


def test_draws_are_made_where_the_background_is(spark, monkeypatch):
    """No draw is shuffled; a background in several parts, one with nulls, and one without rows."""
    import hashlib

    monkeypatch.setattr(enrich, "BLOCK", 8)
    monkeypatch.setattr(enrich, "PART", 32)
    values = {"t": [((7 * i) % 101) / 100 for i in range(101)], "u": [i / 7 if i % 3 else None for i in range(20)], "v": [0.5] * 32}
    null = spark.createDataFrame([(a, i, x) for a, xs in values.items() for i, x in enumerate(xs)], "assay string, item long, coverage double")
    query = spark.createDataFrame([(a, i, 0.3) for a in ("t", "u", "v", "none") for i in range(15)], "assay string, item long, coverage double")
    out = enrich.coverage_enrichment(query, null, n_boot=40, seed=5)
    got = {r["assay"]: r for r in out.collect()}
    for a, xs in values.items():
        mean = np.mean([x for x in xs if x is not None])
        folds = []
        for b in range(40):
            at = [math.floor(int(hashlib.md5(f"5/{a}/{b}/{i}".encode()).hexdigest()[:12], 16) / 2**48 * len(xs)) for i in range(15)]
            folds.append(math.log2((np.mean([xs[k] for k in at if xs[k] is not None]) + 1e-4) / (mean + 1e-4)))
        assert [got[a]["null_lo"], got[a]["null_hi"]] == pytest.approx(list(np.percentile(folds, [2.5, 97.5])), abs=1e-12)
        obs = math.log2((0.3 + 1e-4) / (mean + 1e-4))
        assert got[a]["p"] == pytest.approx((sum(abs(f) >= abs(obs) for f in folds) + 1) / 41) and got[a]["n_null"] == len(xs)
    assert got["none"]["n_null"] == 0 and got["none"]["p"] is None
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_of_a_matrix_is_parsed_once(spark, tmp_path):
    """Not once for each of its cells, which makes a wide line's cost grow with the square of its length."""
    (tmp_path / "m.csv").write_text('bin,s1,s2,s3\n"chr1:1-2",1,2,\nchr1:2-3,NA,5,6\n')
    from lociflow.sources import readers

    found = readers.read_matrix(spark, str(tmp_path / "m.csv"), samples_axis=1)
    above, below = found._jdf.queryExecution().optimizedPlan().toString().split("Generate ")
    assert "regexp_extract" not in above and "regexp_extract" in below
    assert sorted(map(tuple, found.where("value is not null").collect())) == [("s1", "chr1:1-2", 1.0), ("s2", "chr1:1-2", 2.0), ("s2", "chr1:2-3", 5.0), ("s3", "chr1:2-3", 6.0)]


def test_background_is_numbered_once_for_all_tracks(spark, monkeypatch):
    """Rows of coverage come to regions, not to regions times tracks, and the tests are those of single rows."""
    seq = "GATC" * 700
    chunks = nulls.genome_chunks(spark.createDataFrame([("chrT", i, seq[i * 100 : (i + 1) * 100]) for i in range(28)], "chrom string, chunk long, seq string"), 100)
    asked = regions(spark, *[("chrT", 40 * i, 40 * i + 60 + i) for i in range(6)])
    peaks = spark.createDataFrame([("t", a, "chrT", k, k + 30, 1.0) for a, step in (("DNase", 90), ("ATAC", 170)) for k in range(0, 2800, step)], PEAK)
    tracks = spark.createDataFrame([("t", a) for a in ("DNase", "ATAC", "none")], "tissue string, assay string")
    seen, own = [], enrich.numbered
    monkeypatch.setattr(enrich, "numbered", lambda rows, *rest: seen.append(rows.count()) or own(rows, *rest))
    monkeypatch.setattr(enrich, "BLOCK", 16)
    tests, meta = enrich.track_enrichment_test(asked, peaks, tracks, chunks, 100, n_boot=50, n_per=7, seed=2)
    got = {r["assay"]: r for r in tests.collect()}
    assert seen == [meta.agg(F.sum("matched")).first()[0]] and seen[0] > 30
    null, _ = nulls.sample_matched(asked, chunks, 100, n_per=7, seed=2)
    rows = lambda some: marks.track_coverage(some, peaks, tracks).select("assay", F.col("region_id").alias("item"), "coverage")
    want = enrich.coverage_enrichment(rows(asked), rows(null.withColumn("region_id", F.struct("region_id", "draw"))), 50, 2)
    assert {r["assay"]: pytest.approx(tuple(r)[1:]) for r in want.collect()} == {a: tuple(r)[1:] for a, r in got.items()} and len(got) == 3


def test_background_is_annotated_without_its_ids(spark):
    """The dominant states of annotate_regions, row by row; regions are shuffled once, to the group in which they are counted."""
    from lociflow.operators import profiles

    r = np.random.default_rng(4)
    some = regions(spark, *[(f"chr{r.integers(3)}", int(a), int(a + r.integers(0, 900))) for a in r.integers(0, 20_000, 60)])
    states = spark.createDataFrame([(f"chr{r.integers(2)}", int(a), int(a + r.integers(1, 900)), str(r.choice(["x", "y", "z"]))) for a in r.integers(0, 20_000, 80)], "chrom string, start long, end long, state string")
    want = {x["region_id"]: x["dominant_state"] for x in annotate.annotate_regions(some, states, ()).collect()}
    assert {x["region_id"]: x["dominant_state"] for x in annotate.dominant_states(some, states, ("region_id",)).collect()} == want and set(want.values()) > {None, "x"}
    placed, loads, levels = profiles._placed(some.where("end > start"), 5)
    dealt, *_ = profiles._dealt(placed, states.withColumns({"__low": F.lit(0).cast("long"), "__high": F.lit(99_999).cast("long")}), loads, levels)
    assert "strategy=broadcast" in dealt._jdf.queryExecution().optimizedPlan().toString()
