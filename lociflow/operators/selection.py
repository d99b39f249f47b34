"""Ranking of genomic bins, by attribution or by difference of groups, and what the ranking says of compartments.

A matrix is long: (sample_id, bin_key, value). Thousands of bins as columns would be thousands of plan nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import bin_part
from ..functions.ranking import numbered
from ..functions.stats import mann_whitney_column, spearman_each
from ..sources.scratch import written
from .attribute import panel_tissues


def with_coordinates(bins: DataFrame) -> DataFrame:
    """bins(bin_key, ...) with chrom, start and end parsed from the key."""
    key = F.col("bin_key")
    return bins.withColumns({"chrom": bin_part(key, 1), "start": bin_part(key, 2), "end": bin_part(key, 3)})


def ranked(bins: DataFrame) -> DataFrame:
    """bins with rank 1.. by importance, the largest first, nulls last; equal ones by chromosome, start and key."""
    out, _ = numbered(bins, [F.col("importance").desc_nulls_last(), "chrom", "start", "bin_key"], "rank")
    return out.withColumn("rank", (F.col("rank") + 1).cast("int"))


def importance_by_shap(matrix: DataFrame) -> DataFrame:
    """(bin_key, importance, direction): mean absolute value and mean over samples, without nulls and NaN."""
    value = F.when(~F.isnan(F.col("value").cast("double")), F.col("value").cast("double"))
    return matrix.groupBy("bin_key").agg(F.avg(F.abs(value)).alias("importance"), F.avg(value).alias("direction"))


def rank_by_shap(matrix: DataFrame) -> DataFrame:
    """(bin_key, chrom, start, end, importance, direction, rank)."""
    return ranked(with_coordinates(importance_by_shap(matrix))).select("bin_key", "chrom", "start", "end", "importance", "direction", "rank")


def group_pair(labels: DataFrame, positive: str | None = None) -> tuple[str, str]:
    """The positive label and the other of labels(sample_id, label), which must be two; the last in order is positive by default."""
    found = sorted(r["label"] for r in labels.where("label is not null").select("label").distinct().limit(3).collect())
    if len(found) != 2 or positive is not None and positive not in found:
        raise ValueError(f"two label groups are needed, found {found}")
    chosen = found[-1] if positive is None else positive
    return chosen, next(x for x in found if x != chosen)


def rank_sums(matrix: DataFrame, labels: DataFrame, positive: str | None = None) -> DataFrame:
    """(bin_key, n1, n2, u, ties, direction): Mann and Whitney's U of the positive group by bin, from tie-averaged ranks.

    ties sums t^3 - t over groups of equal values; direction is the difference of means.
    """
    chosen, other = group_pair(labels, positive)
    rows = matrix.join(labels.where(F.col("label").isin(chosen, other)).select("sample_id", (F.col("label") == chosen).alias("is_pos")), "sample_id").where("value is not null")
    counts = rows.groupBy("bin_key", "value").agg(F.count(F.lit(1)).alias("t"), F.count_if("is_pos").alias("tp"))
    before = F.sum("t").over(Window.partitionBy("bin_key").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")
    by_value = counts.withColumn("rank", before + (F.col("t") + 1) / 2)
    n1 = F.sum("tp")
    return by_value.groupBy("bin_key").agg(
        n1.alias("n1"),
        (F.sum("t") - n1).alias("n2"),
        (F.sum(F.col("rank") * F.col("tp")) - n1 * (n1 + 1) / 2).alias("u"),
        F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("ties"),
        (F.try_divide(F.sum(F.col("value") * F.col("tp")), n1) - F.try_divide(F.sum(F.col("value") * (F.col("t") - F.col("tp"))), F.sum("t") - n1)).alias("direction"),
    )


def rank_by_differential(matrix: DataFrame, labels: DataFrame, positive: str | None = None) -> DataFrame:
    """(bin_key, chrom, start, end, importance, direction, p, rank): importance is -log10 of the two-sided p, floored at 1e-300."""
    sums = rank_sums(matrix, labels, positive)
    p = F.coalesce(mann_whitney_column(F.col("u").cast("double"), F.col("n1").cast("int"), F.col("n2").cast("int"), "ties"), F.lit(1.0))
    scored = sums.withColumn("p", F.greatest(p, F.lit(1e-300))).withColumn("importance", -F.log10("p"))
    return ranked(with_coordinates(scored)).select("bin_key", "chrom", "start", "end", "importance", "direction", "p", "rank")


def top_regions(ranked_bins: DataFrame, top_n: int | None = None, top_frac: float | None = None) -> DataFrame:
    """The first top_n bins, or the first top_frac of them rounded up, which goes before; all if neither is given."""
    if top_frac is not None:
        n = ranked_bins.agg(F.ceil(F.count(F.lit(1)) * top_frac).alias("n"))
        return ranked_bins.join(F.broadcast(n), how="cross").where("rank <= n").drop("n")
    return ranked_bins if top_n is None else ranked_bins.where(F.col("rank") <= top_n)


def on_reference(ranked_bins: DataFrame, chroms: list[str] | tuple[str, ...]) -> DataFrame:
    """The bins of a ranking on chromosomes that a reference has; ranks stay as they are."""
    return ranked_bins.where(F.col("chrom").isin(*chroms))


def compartment_activity(activity: DataFrame, roles: DataFrame) -> DataFrame:
    """(region_id, signal_activity, background_activity, signal_specific): mean activity of the signal tissues, and of background and inflammation."""
    named = activity.join(F.broadcast(panel_tissues(roles)), "tissue")
    mean = lambda *which: F.coalesce(F.avg(F.when(F.col("role").isin(*which), F.col("activity"))), F.lit(0.0))
    out = named.groupBy("region_id").agg(mean("signal").alias("signal_activity"), mean("background", "inflammation").alias("background_activity"))
    return out.withColumn("signal_specific", F.col("signal_activity") - F.col("background_activity"))


def compartment_importance(bins: DataFrame, activities: DataFrame, use_abs_direction: bool = False) -> DataFrame:
    """(target, n, rho, p): rank correlation of a bin's score with each compartment's activity.

    bins(region_id, importance, direction); background_specific mirrors signal_specific.
    """
    score: Column = F.abs("direction") if use_abs_direction else F.col("importance")
    joined = bins.join(activities, "region_id", "left").withColumn("score", score)
    targets = written(spearman_each(joined, "score", ["signal_specific", "signal_activity", "background_activity"]), "targets")  # three rows
    mirror = targets.where("target = 'signal_specific'").select(F.lit("background_specific").alias("target"), "n", (-F.col("rho")).alias("rho"), "p")
    return targets.unionByName(mirror)
