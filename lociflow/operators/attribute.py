"""Attribution of regions to compartments of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PSEUDO = 1e-3


def panel_tissues(roles: DataFrame) -> DataFrame:
    """(tissue, role, ord): each tissue once, with the first role in role order."""
    return roles.groupBy("tissue").agg(F.min_by("role", "ord").alias("role"), F.min("ord").alias("ord"))


def compartments(roles: DataFrame) -> DataFrame:
    """(tissue, compartment): a tissue in several roles counts for the last of signal, inflammation, background, control."""
    order = F.expr("case role when 'signal' then 0 when 'inflammation' then 1 when 'background' then 2 else 3 end")
    return roles.groupBy("tissue").agg(F.max_by("role", order).alias("compartment"))


def attribute_regions(activity: DataFrame, regions: DataFrame, roles: DataFrame, min_active: float = 0.05, margin: float = 0.5) -> DataFrame:
    """(region_id, compartment, top, runner_up, log2_margin, called_open, scores) for every region.

    A compartment's score is the largest activity of its tissues. Control isn't called. Below min_active everywhere a
    region is unexplained; else the top compartment is called if its log2 lead over the next reaches margin, and the
    region is ambiguous if not. Equal scores go by signal, inflammation, background.
    """
    score = activity.join(F.broadcast(compartments(roles)), "tissue").groupBy("region_id", "compartment").agg(F.greatest(F.max("activity"), F.lit(0.0)).alias("score"))
    order = F.expr("case compartment when 'signal' then 0 when 'inflammation' then 1 else 2 end")
    ranked = score.where("compartment <> 'control'").withColumn("k", F.row_number().over(Window.partitionBy("region_id").orderBy(F.desc("score"), order)))
    pick = lambda k, col: F.max(F.when(F.col("k") == k, F.col(col)))
    lead = ranked.groupBy("region_id").agg(pick(1, "compartment").alias("first"), pick(1, "score").alias("s1"), pick(2, "compartment").alias("second"), pick(2, "score").alias("s2"))
    scores = score.groupBy("region_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("compartment", "score")))).alias("scores"))
    out = regions.select("region_id").join(lead, "region_id", "left").join(scores, "region_id", "left")
    is_open = F.coalesce(F.col("s1") >= min_active, F.lit(False))
    gain = F.log2((F.col("s1") + PSEUDO) / (F.coalesce("s2", F.lit(0.0)) + PSEUDO))
    return out.select(
        "region_id",
        F.when(~is_open, "unexplained").when(gain >= margin, F.col("first")).otherwise("ambiguous").alias("compartment"),
        F.when(is_open, F.col("first")).alias("top"),
        F.when(is_open, F.col("second")).alias("runner_up"),
        F.when(is_open, gain).otherwise(0.0).alias("log2_margin"),
        is_open.alias("called_open"),
        F.coalesce("scores", F.create_map().cast("map<string,double>")).alias("scores"),
    )


def attribution_summary(attributed: DataFrame) -> DataFrame:
    """One row (n, counts, fractions, signal_fraction, background_fraction); the last counts inflammation too."""
    counts = attributed.groupBy("compartment").agg(F.count(F.lit(1)).alias("k"))
    share = lambda *names: F.coalesce(F.sum(F.when(F.col("compartment").isin(*names), F.col("k"))) / F.sum("k"), F.lit(0.0))
    return counts.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("compartment", "k")))).alias("counts"),
        share("signal").alias("signal_fraction"),
        share("inflammation", "background").alias("background_fraction"),
    ).withColumn("fractions", F.transform_values("counts", lambda _, k: k / F.col("n")))
