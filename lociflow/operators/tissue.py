"""Which tissues the most important bins are open in, against random bins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import coordinates_key, normal_key, unit_hash
from ..sources.scratch import written

# Names of key and importance columns, in order of preference.
KEY_COLUMNS, IMPORTANCE_COLUMNS = ("key", "interval", "bin"), ("mean_abs_shap", "importance", "abs_shap", "shap", "mean_shap")


def load_importance(table: DataFrame, importance_col: str | None = None, key_col: str | None = None) -> DataFrame:
    """(key, importance) of a table whose columns are told by name: absolute values, keys as chr:start-end."""
    names = table.columns
    if key_col in names:
        key = F.col(key_col)
    elif "key" in names:
        key = F.col("key")
    elif {"chrom", "start", "end"} <= set(names):
        key = coordinates_key(F.col("chrom"), F.col("start"), F.col("end"))
    else:
        found = next((c for c in KEY_COLUMNS[1:] if c in names), None)
        if found is None:
            raise KeyError("no key column")
        key = F.col(found)
    value = importance_col or next((c for c in IMPORTANCE_COLUMNS if c in names), None)
    if value is None:
        raise KeyError("no importance column")
    return table.select(normal_key(key.cast("string")).alias("key"), F.abs(value).alias("importance"))


def specificity(composite: DataFrame) -> DataFrame:
    """(bin_key, tissue, value, spec) of (bin_key, tissue, value): value less the bin's mean over the tissues."""
    return composite.select("bin_key", "tissue", "value", (F.col("value") - F.avg("value").over(Window.partitionBy("bin_key"))).alias("spec"))


def top_bins(importance: DataFrame, bins: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """(topn, bin_key, k): the most important bins that the atlas has, for each cut; k is how many there are."""
    known = importance.join(bins.select(F.col("bin_key").alias("key")).distinct(), "key", "left_semi")
    order = F.col("importance").desc_nulls_last(), F.col("key")
    first = known.orderBy(*order).limit(max(cuts))  # each task keeps that many, so the window sees the largest cut alone
    some = first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    each = some.withColumn("topn", F.explode(F.array(*map(F.lit, cuts)))).where("rank <= topn")
    return each.select("topn", F.col("key").alias("bin_key"), F.count(F.lit(1)).over(Window.partitionBy("topn")).alias("k"))


def tissue_enrichment(spec: DataFrame, top: DataFrame) -> DataFrame:
    """(topn, tissue, abs_obs, abs_z, spec_obs, spec_z, proportion, n_bins_used).

    z compares the mean of the top bins with the mean and deviation of a random sample of as many bins without
    replacement, which are known in closed form. proportion is a tissue's share of the positive specificities.
    """
    whole = spec.groupBy("tissue").agg(F.count("value").alias("n"), *(f(c).alias(f"{c}_{s}") for c in ("value", "spec") for f, s in ((F.avg, "mu"), (F.stddev_pop, "sd"))))
    seen = top.join(spec, "bin_key").groupBy("topn", "tissue").agg(F.avg("value").alias("abs_obs"), F.avg("spec").alias("spec_obs"), F.max("k").alias("k"))
    both = seen.join(F.broadcast(whole), "tissue")
    shrink = F.sqrt(F.try_divide((F.col("n") - F.col("k")).cast("double"), F.col("k") * F.greatest(F.col("n") - 1, F.lit(1))))
    z = lambda obs, c: (F.col(obs) - F.col(f"{c}_mu")) / (F.col(f"{c}_sd") * shrink + 1e-12)
    positive = F.greatest("spec_obs", F.lit(0.0))
    total = F.sum(positive).over(Window.partitionBy("topn"))
    share = positive / F.when(total > 0, total).otherwise(1.0)
    return both.select("topn", "tissue", "abs_obs", z("abs_obs", "value").alias("abs_z"), "spec_obs", z("spec_obs", "spec").alias("spec_z"), share.alias("proportion"), F.col("k").alias("n_bins_used"))


def permutation_p(spec: DataFrame, top: DataFrame, n_perm: int = 2000, seed: int = 0, plus_one: bool = False) -> DataFrame:
    """(topn, tissue, abs_p, spec_p): how often random bins lie as far from their mean as the top bins do.

    A permutation orders the bins by a hash of seed, permutation and bin; its first k bins are the sample for a cut of k.
    Only bins whose hash is below a threshold, which leaves few more than k, are ordered; a permutation in which fewer are
    left is drawn again without it. So the result is exact and the same in every run, and rows near n_perm times k move.
    """
    bins = written(spec.select("bin_key").distinct(), "bins")
    sizes = top.groupBy("topn").agg(F.max("k").alias("k"))  # a row for each cut
    n = bins.count()
    most = min(sizes.agg(F.max("k")).first()[0] or 0, n)
    drawn = written(_bottom(bins, range(n_perm), most, seed, _threshold(most, n)), "drawn")
    counts = {r["perm"]: r["n"] for r in drawn.groupBy("perm").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each permutation
    short = [k for k in range(n_perm) if counts.get(k, 0) < most]
    if short:  # too few hashes below the threshold: these are drawn without one
        drawn = drawn.where(~F.col("perm").isin(short)).unionByName(_bottom(bins, short, most, seed, 1.0))
    drawn = drawn.join(F.broadcast(sizes), F.col("i") <= F.col("k"))
    means = lambda df, *keys: df.join(spec, "bin_key").groupBy("topn", "tissue", *keys)
    null = written(means(drawn, "perm").agg(F.avg("value").alias("abs_null"), F.avg("spec").alias("spec_null")), "permutations")
    mid = null.groupBy("topn", "tissue").agg(F.avg("abs_null").alias("abs_mu"), F.avg("spec_null").alias("spec_mu"))
    seen = means(top).agg(F.avg("value").alias("abs_obs"), F.avg("spec").alias("spec_obs"))
    both = null.join(mid.join(seen, ["topn", "tissue"]), ["topn", "tissue"])
    far = lambda c: F.count_if(F.abs(F.col(f"{c}_null") - F.col(f"{c}_mu")) >= F.abs(F.col(f"{c}_obs") - F.col(f"{c}_mu")))
    p = (lambda c: (far(c) + 1) / (F.count(F.lit(1)) + 1)) if plus_one else (lambda c: far(c) / F.count(F.lit(1)))
    return both.groupBy("topn", "tissue").agg(p("abs").alias("abs_p"), p("spec").alias("spec_p"))


def _threshold(k: int, n: int) -> float:
    """A hash below which k of n bins lie, but for about one permutation in a billion."""
    return min(1.0, (k + 6 * math.sqrt(k) + 12) / max(n, 1))


def _bottom(bins: DataFrame, perms: range | list[int], k: int, seed: int, threshold: float) -> DataFrame:
    """(perm, bin_key, i): the k bins of the smallest hashes of each permutation, numbered from 1."""
    each = bins.withColumn("perm", F.explode(F.array(*map(F.lit, perms)) if isinstance(perms, list) else F.sequence(F.lit(0), F.lit(len(perms) - 1))))
    each = each.withColumn("u", unit_hash(seed, F.col("perm"), F.col("bin_key"))).where(F.col("u") < threshold) if threshold < 1 else each.withColumn("u", unit_hash(seed, F.col("perm"), F.col("bin_key")))
    order = Window.partitionBy("perm").orderBy("u", "bin_key")
    return each.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k).select("perm", "bin_key", "i")


def plot_order(enrichment: DataFrame, lead: str = "placenta") -> DataFrame:
    """(tissue, position): the lead tissue, then the others by specific z at the smallest cut."""
    first = enrichment.agg(F.min("topn").alias("least"))
    some = enrichment.join(F.broadcast(first), F.col("topn") == F.col("least"))
    return some.select("tissue", F.row_number().over(Window.orderBy(F.col("tissue") != lead, F.desc_nulls_last("spec_z"), "tissue")).alias("position"))
