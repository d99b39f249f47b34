"""Openness of genomic bins by tissue, from replicate peak tracks. The atlas is long: (bin_key, tissue, track, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import z_score
from ..schema import ACTIVE_MARKS
from ..sources.scratch import written
from .intervals import bins

# Names of contrasts and the lymphoid tissues.
CONTRAST_NAMES = ("background", "signal", "immune", "tumor")
LYMPHOID = ("Tcell", "CD8", "NK")


def is_contrast(name: str):
    return F.col(name).endswith("_specific") | F.col(name).isin(*CONTRAST_NAMES)


def peaks_to_coverage(peaks: DataFrame, grid: DataFrame, width: int, weighted: bool = False, keys: tuple[str, ...] = ("tissue", "assay", "replicate")) -> DataFrame:
    """(keys, bin_key, coverage) for every bin of grid(bin_key, chrom, start, end) and every track of the peaks.

    Overlaps are summed, not merged, divided by the full width even in a cut last bin, and clipped at 1; weighted
    multiplies by the mean signal of the overlaps. Bins off the grid don't count.
    """
    tracks = peaks.select(*keys).distinct()
    spread = peaks.where("end > start").withColumn("b", F.explode(bins("start", "end", width)))
    ov = F.least("end", (F.col("b") + 1) * width) - F.greatest("start", F.col("b") * width)
    sums = spread.withColumn("ov", ov).groupBy(*keys, "chrom", (F.col("b") * width).alias("start")).agg(F.sum("ov").alias("bp"), F.sum(F.col("signal") * F.col("ov")).alias("weight"))
    every = grid.select("bin_key", "chrom", "start").join(F.broadcast(tracks), how="cross")
    share = F.least(F.lit(1.0), F.coalesce(F.col("bp").cast("double"), F.lit(0.0)) / width)
    value = share * F.coalesce(F.try_divide("weight", "bp"), F.lit(0.0)) if weighted else share
    return every.join(sums, [*keys, "chrom", "start"], "left").select(*keys, "bin_key", value.alias("coverage"))


def aggregate_replicates(coverage: DataFrame, method: str = "zmean") -> DataFrame:
    """(tissue, assay, bin_key, value, n_replicates) from (tissue, assay, replicate, bin_key, coverage).

    zmean scales every replicate to mean 0 and deviation 1 over the bins before averaging, so depth cancels; mean and
    median take coverage as it is. Other names count as mean.
    """
    x = coverage.withColumn("v", z_score("coverage", "tissue", "assay", "replicate")) if method == "zmean" else coverage.withColumn("v", F.col("coverage"))
    value = F.expr("percentile(v, 0.5)") if method == "median" else F.avg("v")
    return x.groupBy("tissue", "assay", "bin_key").agg(value.alias("value"), F.count(F.lit(1)).alias("n_replicates"))


def tissue_tracks(assays: DataFrame) -> DataFrame:
    """(tissue, track, bin_key, value, n): D and A of each accessibility assay, ACC their mean z, H the mean of the active marks."""
    pick = lambda name, track: assays.where(F.col("assay") == name).select("tissue", F.lit(track).alias("track"), "bin_key", "value", F.col("n_replicates").alias("n"))
    open_ = pick("DNase", "D").unionByName(pick("ATAC", "A"))
    both = open_.withColumn("z", z_score("value", "tissue", "track")).groupBy("tissue", "bin_key").agg(F.avg("z").alias("value"), F.sum("n").alias("n"))
    marks = assays.where(F.col("assay").isin(*ACTIVE_MARKS)).groupBy("tissue", "bin_key").agg(F.avg("value").alias("value"), F.sum("n_replicates").alias("n"))
    named = lambda df, track: df.select("tissue", F.lit(track).alias("track"), "bin_key", "value", "n")
    return open_.unionByName(named(both, "ACC")).unionByName(named(marks, "H"))


def contrasts(tracks: DataFrame) -> DataFrame:
    """(tissue, track, bin_key, value): contrasts of each track, and the composite C of each tissue.

    background is the mean of neutrophil and Bcell where both are there; infl_specific and the lymphoid ones are z of
    the tissue less z of the background; C is the mean of z of H and z of ACC (else D), or the one there is. A track
    that is null throughout counts as absent.
    """
    known = tracks.where("value is not null").select("tissue", "track", "bin_key", "value")
    pair = known.where("tissue in ('neutrophil', 'Bcell')").groupBy("track", "bin_key").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("k")).where("k = 2")
    background = pair.select(F.lit("background").alias("tissue"), "track", "bin_key", "value")
    scaled = known.unionByName(background).withColumn("z", z_score("value", "tissue", "track"))
    base = scaled.where("tissue = 'background'").select("track", "bin_key", F.col("z").alias("z0"))
    name = F.when(F.col("tissue") == "monocyte", "infl_specific").otherwise(F.concat("tissue", F.lit("_specific")))
    special = scaled.where(F.col("tissue").isin("monocyte", *LYMPHOID)).join(base, ["track", "bin_key"])
    special = special.select(name.alias("tissue"), "track", "bin_key", (F.col("z") - F.col("z0")).alias("value"))
    agree = special.where("tissue = 'infl_specific' and track in ('H', 'D')").groupBy("bin_key").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("k")).where("k = 2")
    agree = agree.select(F.lit("infl_specific").alias("tissue"), F.lit("C").alias("track"), "bin_key", "value")
    tissue = scaled.where(~is_contrast("tissue") & F.col("track").isin("H", "ACC", "D"))
    at = lambda t: F.max(F.when(F.col("track") == t, F.col("z")))
    parts = tissue.groupBy("tissue", "bin_key").agg(at("H").alias("h"), F.coalesce(at("ACC"), at("D")).alias("a"))
    mean = F.when(F.col("h").isNotNull() & F.col("a").isNotNull(), (F.col("h") + F.col("a")) / 2).otherwise(F.coalesce("h", "a"))
    composite = parts.select("tissue", F.lit("C").alias("track"), "bin_key", mean.alias("value"))
    return background.unionByName(special).unionByName(agree).unionByName(composite)


def build_atlas(peaks: DataFrame, grid: DataFrame, width: int, method: str = "zmean", weighted: bool = False) -> DataFrame:
    """(tissue, track, bin_key, value): all tracks and contrasts of replicate peaks(tissue, assay, replicate, chrom, start, end, signal).

    The values by assay and the tracks are written, as contrasts refer to them many times.
    """
    assays = written(aggregate_replicates(peaks_to_coverage(peaks, grid, width, weighted), method), "assays")
    tracks = written(tissue_tracks(assays), "tracks")
    return tracks.drop("n").unionByName(contrasts(tracks))


def wide_atlas(atlas: DataFrame, grid: DataFrame, columns: list[str]) -> DataFrame:
    """The grid with a column for each of columns, which are track_tissue; for the CSV sink."""
    named = atlas.withColumn("name", F.concat_ws("_", "track", "tissue"))
    return grid.join(named.groupBy("bin_key").pivot("name", columns).agg(F.first("value")), "bin_key", "left")


def panel_from_catalog(catalog: DataFrame, key, groups: tuple[str, ...] | None = None) -> DataFrame:
    """(group, assay, accessions) of catalog(group, file_accession, ...): replicates by group and assay; key is assay_key's column.

    groups keeps these groups only.
    """
    catalog = catalog if groups is None else catalog.where(F.col("group").isin(*groups))
    return catalog.where("group is not null").withColumn("assay", key).where("assay is not null").groupBy("group", "assay").agg(F.array_sort(F.collect_list("file_accession")).alias("accessions"))


def tissue_columns(columns: list[str], prefix: str) -> list[str]:
    """The columns of a wide atlas that hold a tissue's track: by prefix, without contrasts."""
    named = [c for c in columns if c.startswith(f"{prefix}_")]
    return [c for c in named if not c.endswith("_specific") and c.removeprefix(f"{prefix}_") not in CONTRAST_NAMES]


def long_atlas(wide: DataFrame, prefix: str, order: str | None = None) -> DataFrame:
    """(bin_key, tissue, track, value) of a wide atlas(key, ..., prefix_tissue columns).

    Of rows with the same key the last one counts, by the order column that read_named_csv adds; without one, by the
    table's own order, which is that of its partitions.
    """
    names = tissue_columns(wide.columns, prefix)
    entry = lambda c: F.struct(F.lit(c.removeprefix(f"{prefix}_")).alias("tissue"), F.col(f"`{c}`").cast("double").alias("value"))
    at = F.monotonically_increasing_id() if order is None else F.col(order)
    rows = wide.withColumn("__i", at).select(F.col("key").alias("bin_key"), "__i", F.array(*map(entry, names)).alias("x"))
    last = rows.groupBy("bin_key").agg(F.max_by("x", "__i").alias("x"))
    return last.select("bin_key", F.explode("x").alias("v")).select("bin_key", "v.tissue", F.lit(prefix).alias("track"), "v.value")


def describe_catalog(catalog: DataFrame) -> DataFrame:
    """(modality, group, n_files, n_experiments) of catalog(modality, group, file_accession, experiment); a null group is what no pattern fits."""
    return catalog.groupBy("modality", "group").agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("experiment").alias("n_experiments"))
