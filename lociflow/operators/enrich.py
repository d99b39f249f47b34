"""Enrichment of query regions against a background."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from ..functions.draws import unit_hashes
from ..functions.keys import unit_hash  # noqa: F401  what unit_hashes repeats
from ..functions.ranking import numbered
from ..functions.stats import fold_test_column, kolmogorov_column
from ..sources.scratch import written
from .annotate import annotate_regions, dominant_states
from .marks import coverage_lists
from .nulls import sample_matched, sample_sets

COVERAGE_PSEUDO = 1e-4
#: Numbered rows of a background in a block, and in the part of it that a task holds; draws are made again for each part.
BLOCK, PART = 1024, 1 << 26


def label_enrichment(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Tests counts(keys, label, q, nq, b, nb): q of nq query and b of nb background regions have the label.

    (keys, label, query_frac, null_frac, log2_fold, null_lo, null_hi, p, n_query, n_null). Labels of nq regions drawn
    from the background with replacement are binomial, so the two-sided p of |log2 fold| and the 95 % range of the
    background's own log2 fold are exact tails of that law rather than draws. Without queries or background they are null.
    """
    nq, nb = F.col("nq").cast("double"), F.col("nb").cast("double")
    eps = F.lit(0.5) / F.greatest(nq, F.lit(1.0))
    base = counts.withColumns({"query_frac": F.try_divide("q", nq), "null_frac": F.try_divide("b", nb), "eps": eps})
    base = base.withColumn("log2_fold", F.log2((F.col("query_frac") + F.col("eps")) / (F.col("null_frac") + F.col("eps"))))
    out = base.withColumn("t", fold_test_column(F.col("nq").cast("long"), "null_frac", "eps", "log2_fold"))
    return out.select(*keys, "label", "query_frac", "null_frac", "log2_fold", "t.null_lo", "t.null_hi", "t.p", F.col("nq").alias("n_query"), F.col("nb").alias("n_null"))


def label_counts(query: DataFrame, null: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The counts that label_enrichment tests, from query(keys, dominant_state) and null alike; regions without one don't count."""
    marked = lambda df, asked: df.select(*keys, "dominant_state", F.lit(asked).alias("asked"))
    return marked_counts(marked(query, True).unionByName(marked(null, False)), labels, keys)


def marked_counts(regions: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """label_counts of regions(keys, dominant_state, asked), read once: asked is true for a query, false for background and null for neither."""
    named = regions.where("dominant_state is not null").join(F.broadcast(labels), F.col("dominant_state") == F.col("state"))
    sums = named.groupBy(*keys, "label").agg(F.count_if("asked").alias("q"), F.count_if(~F.col("asked")).alias("b"))
    totals = sums.groupBy(*keys).agg(F.sum("q").alias("nq"), F.sum("b").alias("nb"), F.collect_list(F.struct("label", "q", "b")).alias("sums"))
    every = totals.join(F.broadcast(labels.select("label").distinct()), how="cross")
    own = F.get(F.filter("sums", lambda x: x["label"] == F.col("label")), F.lit(0))
    return every.select(*keys, "label", "nq", "nb", *(F.coalesce(own[c], F.lit(0)).alias(c) for c in ("q", "b")))


def coverage_enrichment(query: DataFrame, null: DataFrame, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """(assay, query_mean, null_mean, log2_fold, null_lo, null_hi, p, n_query, n_null) from (assay, item, coverage) of both.

    The background is resampled n_boot times at the query's size: draw i of resample b takes the row whose number is a
    hash of (assay, b, i). p counts resamples at least as far from the background's mean, plus one.
    """
    return _coverage_tests(_means(query, "query"), _means(null, "null"), _blocks(null), n_boot, seed)


def _means(rows: DataFrame, side: str) -> DataFrame:
    return rows.groupBy("assay").agg(F.avg("coverage").alias(f"{side}_mean"), F.count(F.lit(1)).alias(f"n_{side}"))


def _blocks(null: DataFrame) -> DataFrame:
    """(assay, block, values): coverage of the rows of each assay in the order of items, BLOCK of them in a row."""
    rows, _ = numbered(null.select("assay", "item", "coverage"), ["assay", "item", "coverage"], "number")
    first = rows.groupBy("assay").agg(F.min("number").alias("first"))  # a row for each assay
    placed = rows.join(F.broadcast(first), "assay").select("assay", "coverage", (F.col("number") - F.col("first")).alias("at"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("coverage").cast("double").alias("x")))), lambda v: v["x"])
    return placed.groupBy("assay", F.expr(f"at div {BLOCK}L").alias("block")).agg(values.alias("values"))


def _resampled(seed: int, width: int, names: list[str], draws: pa.Table, blocks: pa.Table) -> pa.Table:
    """(assay, b, s, n): what the draws of each resample add up to in a part of the background, and how many of them are known."""
    sums, counts = np.zeros(draws.num_rows), np.zeros(draws.num_rows, np.int64)
    if draws.num_rows and blocks.num_rows:
        block = blocks.column("block").to_numpy()
        low = int(block.min()) * width
        row, size = 0, sum(len(lists.flatten()) for lists in blocks.column("values").chunks)
        values, known = np.empty(size), np.empty(size, bool)
        for lists in blocks.column("values").chunks:
            flat, lengths = lists.flatten(), lists.value_lengths().to_numpy()
            x, valid = flat.to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
            for end, k in zip(np.cumsum(lengths), lengths, strict=True):
                at = int(block[row]) * width - low
                values[at : at + k], known[at : at + k] = x[end - k : end], valid[end - k : end]
                row += 1
        whole = known.all()
        for i, (name, b, n, of) in enumerate(zip(*(draws.column(c).to_pylist() for c in ("name", "b", "n_query", "n_null")), strict=True)):
            for u in unit_hashes(f"{seed}/{name}/{b}", n):
                at = (u * of).astype(np.int64)
                if of > len(values):
                    at = at[(at >= low) & (at < low + len(values))]
                at -= low
                if not whole:
                    at = at[known[at]]
                sums[i] += values[at].sum()
                counts[i] += len(at)
    return draws.select(names).append_column("s", pa.array(sums)).append_column("n", pa.array(counts))


def _coverage_tests(query: DataFrame, null: DataFrame, blocks: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """coverage_enrichment's rows from the means and counts of both sides and the background's _blocks.

    The draws are many and the background is few beside them: each task takes some resamples of an assay and makes
    their draws by itself, from a copy of the background's numbers. So no draw is shuffled.
    """
    sizes = written(query.join(null, "assay", "left"), "sizes")
    parts = F.ceil(F.col("n_null") / PART).cast("int")
    n = sizes.agg(F.sum(parts)).first()[0] or 0
    groups = max(1, min(n_boot, -(-4 * query.sparkSession.sparkContext.defaultParallelism // max(1, n))))
    draws = sizes.where("n_null > 0").select("assay", F.col("assay").cast("string").alias("name"), "n_query", "n_null", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"), F.sequence(F.lit(0), parts - 1).alias("parts"))
    draws = draws.withColumn("group", F.col("b") % groups).withColumn("part", F.explode("parts")).drop("parts")
    copies = written(blocks, "blocks").withColumn("part", F.expr(f"(block * {BLOCK}L) div {PART}L").cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = ["assay", "part", "group"]
    left, right = (df.repartition(4 * groups * max(1, n), *keys).groupBy(*keys) for df in (draws, copies))  # few groups share a task
    schema = StructType([query.schema["assay"]]).add("b", IntegerType()).add("s", DoubleType()).add("n", LongType())
    f = partial(_resampled, seed, BLOCK, ["assay", "b"])
    means = left.cogroup(right).applyInArrow(lambda a, b: f(a, b), schema).groupBy("assay", "b").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m"))
    fold = lambda x: F.log2((x + COVERAGE_PSEUDO) / (F.col("null_mean") + COVERAGE_PSEUDO))
    seen = means.join(sizes, "assay").withColumns({"fold": fold(F.col("m")), "obs": fold(F.col("query_mean"))})
    tests = seen.groupBy("assay").agg(
        F.expr("percentile(fold, 0.025)").alias("null_lo"),
        F.expr("percentile(fold, 0.975)").alias("null_hi"),
        ((F.count_if(F.abs("fold") >= F.abs("obs")) + 1) / (n_boot + 1)).alias("p"),
    )
    return sizes.withColumn("log2_fold", fold(F.col("query_mean"))).join(tests, "assay", "left").select("assay", "query_mean", "null_mean", "log2_fold", "null_lo", "null_hi", "p", "n_query", F.coalesce("n_null", F.lit(0)).alias("n_null"))


def state_enrichment_test(
    queries: DataFrame, segments: DataFrame, chunks: DataFrame, width: int, labels: DataFrame, active=(), keys: tuple[str, ...] = (), **matching
) -> tuple[DataFrame, DataFrame]:
    """(tests, meta): the dominant states of queries(keys, region_id, chrom, start, end) against matched background.

    Each query gets background regions of its length and GC share (sample_matched, which takes **matching and returns
    meta); both are annotated with segments, and label_enrichment tests the labels of labels(state, label), within keys.
    """
    null, meta = sample_matched(queries, chunks, width, **matching)
    if keys:
        null = null.join(queries.select("region_id", *keys).hint("merge"), "region_id")
    asked = annotate_regions(queries, segments, active, keys).select("dominant_state", *keys)
    return label_enrichment(label_counts(asked, dominant_states(null, segments, keys), labels, keys), keys), meta


def track_enrichment_test(queries: DataFrame, peaks: DataFrame, tracks: DataFrame, chunks: DataFrame, width: int, n_boot: int = 1000, seed: int = 0, **matching) -> tuple[DataFrame, DataFrame]:
    """(tests, meta): coverage of queries(region_id, chrom, start, end) by one tissue's marks, or by its open chromatin, against matched background.

    tracks(tissue, assay) names the tracks to test, of one tissue; meta is sample_matched's.
    """
    null, meta = sample_matched(queries, chunks, width, seed=seed, **matching)
    listed = sorted({(x["tissue"], x["assay"]) for x in tracks.select("tissue", "assay").collect()}, key=str)
    assays = [a for _, a in listed]
    asked = written(coverage_lists(queries.select("region_id", "chrom", "start", "end"), peaks, listed), "asked")
    background = written(coverage_lists(null, peaks, listed), "background")
    return _coverage_tests(_list_means(asked, assays, "query"), _list_means(background, assays, "null"), _list_blocks(background, assays), n_boot, seed), meta


def _each(assays: list[str], columns) -> Column:
    """A row for each assay, with the columns that columns(its number) gives."""
    return F.explode(F.array(*(F.struct(F.lit(a).cast("string").alias("assay"), *columns(i)) for i, a in enumerate(assays)))).alias("x")


def _list_means(rows: DataFrame, assays: list[str], side: str) -> DataFrame:
    """_means of rows whose coverage is an array with a value for each assay."""
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(F.col("coverage")[i]) for i in range(len(assays)))).alias("m")).where("n > 0")  # one row
    return sums.select(_each(assays, lambda i: [F.col("m")[i].alias(f"{side}_mean"), F.col("n").alias(f"n_{side}")])).select("x.*")


def _list_blocks(null: DataFrame, assays: list[str]) -> DataFrame:
    """_blocks of null(region_id, draw, coverage), whose rows are numbered once for all assays."""
    rows, _ = numbered(null.select("region_id", "draw", "coverage"), ["region_id", "draw"], "at")
    blocks = rows.groupBy(F.expr(f"at div {BLOCK}L").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "coverage"))).alias("v"))
    return blocks.select("block", _each(assays, lambda i: [F.transform("v", lambda v: v["coverage"][i]).alias("values")])).select("x.assay", "block", "x.values")


def calibration_run(
    segments: DataFrame, chunks: DataFrame, width: int, labels: DataFrame, n_sets: int = 100, set_size: int = 50, region_length: int = 50_000, n_per: int = 50, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(summary, tests): state_enrichment_test of n_sets sets of random regions, all sets in one job, and how far their p are from uniform."""
    sets = written(sample_sets(chunks, width, n_sets, set_size, region_length, seed=seed), "sets")
    tests, _ = state_enrichment_test(sets, segments, chunks, width, labels, keys=("set_id",), n_per=n_per, seed=seed + 1)
    tests = written(tests, "tests")
    return calibration_summary(tests.select("label", "p")), tests


def calibration_summary(tests: DataFrame, alpha: float = 0.05, least: int = 5) -> DataFrame:
    """(label, n, fpr, mean_p, ks_d, ks_p) of tests(label, p): how far p is from uniform; labels with few p are left out."""
    known = tests.where(F.col("p").isNotNull() & ~F.isnan("p")).groupBy("label", "p").agg(F.count(F.lit(1)).alias("c"))
    placed = known.withColumn("part", F.least(F.floor(F.col("p") * 1024), F.lit(1023)).cast("int"))  # values in ranges, so that no label is one task
    sums = placed.groupBy("label", "part").agg(F.sum("c").alias("s"))
    to_here = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    bases = sums.select("label", "part", (F.sum("s").over(to_here) - F.col("s")).alias("base"), F.sum("s").over(Window.partitionBy("label")).alias("n"))
    inside = F.sum("c").over(Window.partitionBy("label", "part").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.withColumn("inside", inside).join(bases, ["label", "part"]).withColumn("i", F.col("base") + F.col("inside"))
    gap = F.greatest(F.col("i") / F.col("n") - F.col("p"), F.col("p") - (F.col("i") - F.col("c")) / F.col("n"))
    mean = lambda x: F.sum(x * F.col("c")) / F.sum("c")
    out = ranked.groupBy("label").agg(F.sum("c").alias("n"), mean((F.col("p") < alpha).cast("double")).alias("fpr"), mean(F.col("p")).alias("mean_p"), F.max(gap).alias("ks_d"))
    return out.where(F.col("n") >= least).withColumn("ks_p", kolmogorov_column("ks_d", "n"))
