"""Chromatin-state annotation of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .profiles import state_lists


def state_overlaps(regions: DataFrame, segments: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(region_id, chrom, start, end, keep, states) for every region: states is an array of (state, bp, first), bases of each state in the region, and where the first such segment starts.

    What rows of one region_id overlap is added up; without an id a row has no states.
    """
    regions = regions.select("region_id", "chrom", "start", "end", *keep)
    lists = state_lists(regions, segments)
    lists = lists.withColumn("states", F.when(F.col("region_id").isNotNull(), F.col("states")).otherwise(F.slice("states", 1, 0)))
    repeated = written(regions.groupBy("region_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("region_id"), "repeated")
    if repeated.isEmpty():
        return lists
    each = lists.join(repeated, "region_id").select("region_id", F.explode("states").alias("x")).groupBy("region_id", F.col("x.state").alias("state"))
    sums = each.agg(F.sum("x.bp").alias("bp"), F.min("x.first").alias("first")).groupBy("region_id").agg(F.collect_list(F.struct("state", "bp", "first")).alias("sums"))
    return lists.join(sums, "region_id", "left").withColumn("states", F.coalesce("sums", "states")).select(*lists.columns)


def _dominant() -> Column:
    """Of states the one with most bases, of equal ones that whose first segment is leftmost."""
    return F.array_max(F.transform("states", lambda x: F.struct(x["bp"].alias("bp"), (-x["first"]).alias("at"), x["state"].alias("state"))))["state"].alias("dominant_state")


def dominant_states(regions: DataFrame, segments: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, dominant_state) for every row of regions(chrom, start, end, keep), as annotate_regions gives it for regions of different ids."""
    return state_lists(regions.select("chrom", "start", "end", *keep), segments).select(*keep, _dominant())


def annotate_regions(regions: DataFrame, segments: DataFrame, active: list[str] | tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """(region_id, chrom, start, end, keep, dominant_state, covered_bp, active_fraction, composition) for every region.

    Fractions are of the covered bases; the state with most bases dominates, of equal ones that whose first segment is
    leftmost. A region that no segment overlaps has nulls, 0 covered bases and an empty composition. Columns of regions
    named in keep stay.
    """
    total = lambda states: F.aggregate(states, F.lit(0).cast("long"), lambda n, x: n + x["bp"])
    found = state_overlaps(regions, segments, keep).withColumn("covered_bp", total("states"))
    bases = F.map_from_entries(F.array_sort(F.transform("states", lambda x: F.struct(x["state"], x["bp"]))))
    covered = F.when(F.col("covered_bp") > 0, F.col("covered_bp"))
    return found.select(
        "region_id", "chrom", "start", "end", *keep,
        _dominant(),
        "covered_bp",
        (total(F.filter("states", lambda x: x["state"].isin(*active))) / covered).alias("active_fraction"),
        F.transform_values(bases, lambda _, bp: bp / covered).alias("composition"),
    )


def dominant_counts(annotated: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n, total, fraction) for every label of labels(state, label): how many regions it dominates.

    total counts the regions with a dominant state; without any the fraction is null. labels is a small vocabulary.
    """
    counts = annotated.where("dominant_state is not null").join(F.broadcast(labels), F.col("dominant_state") == F.col("state")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.collect_list(F.struct("label", "n")).alias("counts"))  # one row, so that regions are read once
    own = F.get(F.filter("counts", lambda x: x["label"] == F.col("label")), F.lit(0))
    every = labels.select("label").distinct().join(F.broadcast(whole), how="cross").select("label", F.coalesce(own["n"], F.lit(0)).alias("n"), "total")
    return every.withColumn("fraction", F.try_divide(F.col("n").cast("double"), F.col("total")))
