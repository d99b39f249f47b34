"""Queries of the options and branches that no other query takes: other keys, scores, choices, means and tracks.

Importing this module registers them in the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import atlas, enrich, marks, selection, shap, tissue
from ..sources import readers, writers
from ..sources.scratch import new_path, written
from . import adapters as A
from .catalogue import ATLAS_PARTS, ORACLE_SQL, SHAP_RANKED, WEIGHTS, _weights, atlas_coverage, compartment_activity, query, r, with_ctes
from .files import PEAK_COLUMNS, lines, tabs


@query(with_ctes(A.MATRIX_SQL, SHAP_RANKED, "SELECT bin_key AS key, round(importance, 6) AS importance FROM rnk"))
def importance_by_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking without keys: they are made of its coordinates."""
    ranked = selection.rank_by_shap(A.matrix(spark, sf_dir)).drop("bin_key")
    return tissue.load_importance(ranked).withColumn("importance", r("importance"))


@query(ORACLE_SQL["compartment_importance"].replace("SELECT importance AS x", "SELECT abs(importance - 100000) AS x"))
def compartment_importance_by_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of the absolute direction instead of the importance."""
    bins = A.regions(spark, sf_dir).select("region_id", "importance", (F.col("importance") - 100_000).alias("direction"))
    found = selection.compartment_importance(bins, compartment_activity(spark, sf_dir), use_abs_direction=True)
    return found.select("target", "n", r("rho").alias("rho"))


HALF = "half AS (SELECT * FROM mat WHERE split_part(split_part(bin_key, ':', 2), '-', 1)::BIGINT // 50000 % 3 > 0)"
HALF_MAD = "mads AS (SELECT bin_key, avg(abs(value - m)) AS mad FROM half JOIN mns USING (bin_key) GROUP BY bin_key)"


def _importance_of_some(spark: SparkSession, sf_dir: str, keep_missing: bool) -> DataFrame:
    place = F.regexp_extract("bin_key", ":(\\d+)-", 1).cast("long")
    some = A.matrix(spark, sf_dir).where(F.floor(place / 50_000) % 3 > 0)
    found = shap.weight_importance(shap.component_weights(*_weights(spark, sf_dir)), some, keep_missing)
    return found.select("feature", r("mean_abs_shap").alias("mean_abs_shap"))


@query(with_ctes(A.MATRIX_SQL, WEIGHTS, HALF, HALF_MAD, "SELECT bin_key AS feature, round(coalesce(abs(w) * mad, 0), 6) AS mean_abs_shap FROM wts LEFT JOIN mads USING (bin_key)"))
def importance_with_missing_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all bins over a matrix that lacks a third of them, which count as 0."""
    return _importance_of_some(spark, sf_dir, True)


@query(with_ctes(A.MATRIX_SQL, WEIGHTS, HALF, HALF_MAD, "SELECT bin_key AS feature, round(abs(w) * mad, 6) AS mean_abs_shap FROM wts JOIN mads USING (bin_key)"))
def importance_without_missing_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with missing bins left out."""
    return _importance_of_some(spark, sf_dir, False)


@query(with_ctes(A.peaks_sql(A.ATLAS_ASSAYS), f"SELECT tissue, assay, {PEAK_COLUMNS} FROM pks WHERE assay IN ('DNase', 'ATAC')"))
def access_panel_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessibility tracks by a manifest that names assays, one record a line of its list."""
    folder = new_path(spark, "access")
    rows = A.peaks(spark, sf_dir, A.ATLAS_ASSAYS).where("assay in ('DNase', 'ATAC')").select("tissue", "assay", tabs("chrom", "start", "end", "signal"))
    rows.repartition("tissue", "assay").write.partitionBy("tissue", "assay").text(folder)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]+)", 1).alias(name)
    records = found.select(part("tissue"), part("assay"), F.regexp_extract("path", "(tissue=.*)$", 1).alias("file"))
    listed = records.agg(F.to_json(F.array_sort(F.collect_list(F.struct("tissue", "assay", "file")))).alias("value"))  # a record for each track
    return readers.read_panel(spark, folder, lines(spark, listed, "manifest.json"), "assay").drop("replicate")


@query(
    """SELECT choice, l_partkey::VARCHAR AS bin_key, sum(l_quantity) AS weight FROM lineitem JOIN (VALUES ('1se', 3), ('0.5', 5)) c(choice, n) ON l_linenumber = n
WHERE l_quantity <> 0 GROUP BY choice, l_partkey"""
)
def coefficients_by_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-zero coefficients at one standard error, and at a lambda that is named."""
    sums = A.table(spark, sf_dir, "lineitem").groupBy("l_linenumber", F.col("l_partkey").cast("string").alias("bin_key")).agg(F.sum("l_quantity").alias("weight"))
    rows = sums.select((F.col("l_linenumber") / 10).alias("lambda"), (F.col("l_linenumber") == 2).alias("is_min"), (F.col("l_linenumber") == 3).alias("is_1se"), "bin_key", "weight")
    path = new_path(spark, "path.json")
    writers.write_json(rows, path)
    read = readers.read_coefficients(spark, path, "lambda double, is_min boolean, is_1se boolean, bin_key string, weight double")
    picked = [shap.selected_coefficients(read, choice).select(F.lit(str(choice)).alias("choice"), "bin_key", "weight") for choice in ("1se", 0.5)]
    return picked[0].unionByName(picked[1])


@query(with_ctes(*ATLAS_PARTS, "SELECT tissue, assay, bin_key, round(avg(share), 6) AS value, count(*) AS n_replicates FROM cov GROUP BY tissue, assay, bin_key"))
def mean_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas.aggregate_replicates(atlas_coverage(spark, sf_dir), "mean").withColumn("value", r("value"))


OPEN = ("DNase",)


@query(ORACLE_SQL["coverage_enrichment"].replace(A.peaks_sql(), A.peaks_sql(A.ATLAS_ASSAYS)).replace(A.tracks_sql(), A.tracks_sql(OPEN)))
def open_chromatin_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placenta's one open-chromatin track in urgent regions against all others, by resampling."""
    peaks = A.peaks(spark, sf_dir, A.ATLAS_ASSAYS).where("tissue = 'placenta' and assay = 'DNase'")
    found = marks.track_coverage(A.regions(spark, sf_dir), peaks, A.tracks(spark, OPEN).where("tissue = 'placenta'"))
    found = written(found.join(A.regions(spark, sf_dir).select("region_id", "priority"), "region_id"), "coverage")
    part = lambda cond: found.where(cond).select("assay", F.col("region_id").alias("item"), "coverage")
    out = enrich.coverage_enrichment(part("priority = '1-URGENT'"), part("priority <> '1-URGENT'"))
    return out.select("assay", *(r(c).alias(c) for c in ("query_mean", "null_mean", "log2_fold", "null_lo", "null_hi", "p")), "n_query", "n_null")
