"""Coverage of regions by peaks of histone marks or open chromatin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ACTIVE_MARKS, MARKS, REPRESSIVE_MARKS
from .profiles import track_sums


def track_coverage(regions: DataFrame, peaks: DataFrame, tracks: DataFrame) -> DataFrame:
    """(region_id, tissue, assay, coverage, mean_signal) for every region and track.

    tracks(tissue, assay) is the small list of tracks to report; one without peaks, and a region without overlap, give
    0. coverage is the covered share of the region's whole length; mean_signal is the sum of signal times overlap by
    covered bases, so overlapping peaks may lift it above each.
    """
    listed = [(r["tissue"], r["assay"]) for r in tracks.select("tissue", "assay").collect()]
    names = sorted({x for x in listed if None not in x})
    rows = track_sums(regions.select("region_id", "chrom", "start", "end"), peaks, names, with_signal=True)
    track = [F.struct(F.lit(t).alias("tissue"), F.lit(a).alias("assay"), F.lit(names.index((t, a)) if (t, a) in names else None).cast("int").alias("i")) for t, a in listed]
    if not track:
        return rows.select("region_id", *(F.lit(None).cast(k).alias(c) for c, k in (("tissue", "string"), ("assay", "string"), ("coverage", "double"), ("mean_signal", "double")))).limit(0)
    each = rows.select("region_id", (F.col("end") - F.col("start")).alias("length"), "covered", "weight", F.explode(F.array(*track)).alias("x"))
    union, signal = (F.coalesce(F.get(F.col(c), F.col("x.i")), F.lit(0)) for c in ("covered", "weight"))
    coverage = F.when(F.col("length") > 0, union / F.col("length")).otherwise(0.0)
    return each.select("region_id", "x.tissue", "x.assay", coverage.alias("coverage"), F.coalesce(F.try_divide(signal, union), F.lit(0.0)).alias("mean_signal"))


def coverage_lists(regions: DataFrame, peaks: DataFrame, tracks: list[tuple]) -> DataFrame:
    """regions(chrom, start, end, ...) with coverage: an array of what track_coverage gives for each (tissue, assay) of tracks."""
    names = sorted({x for x in tracks if None not in x})
    length = F.col("end") - F.col("start")
    share = lambda x: F.when(length > 0, F.coalesce(F.get("covered", F.lit(names.index(x))), F.lit(0)) / length).otherwise(0.0) if x in names else F.lit(0.0)
    rows = track_sums(regions, peaks, names)
    return rows.select(*regions.columns, F.array(*map(share, tracks)).alias("coverage"))


def fingerprints(coverage: DataFrame, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """(region_id, tissue, coverage, mean_signal, active_minus_repressive): maps by mark from track_coverage's rows.

    The last is the mean coverage of the active marks among marks less that of the repressive ones; none counts as 0.
    """
    mean = lambda some: F.coalesce(F.avg(F.when(F.col("assay").isin(*some), F.col("coverage"))), F.lit(0.0)) if some else F.lit(0.0)
    entries = lambda col: F.map_from_entries(F.array_sort(F.collect_list(F.struct("assay", col))))
    active, repressive = [m for m in marks if m in ACTIVE_MARKS], [m for m in marks if m in REPRESSIVE_MARKS]
    return coverage.where(F.col("assay").isin(*marks)).groupBy("region_id", "tissue").agg(entries("coverage").alias("coverage"), entries("mean_signal").alias("mean_signal"), (mean(active) - mean(repressive)).alias("active_minus_repressive"))


def mean_coverage(coverage: DataFrame) -> DataFrame:
    """(tissue, assay, coverage): means over regions."""
    return coverage.groupBy("tissue", "assay").agg(F.avg("coverage").alias("coverage"))


def activity(coverage: DataFrame, marks: tuple[str, ...] = ACTIVE_MARKS) -> DataFrame:
    """(region_id, tissue, activity): mean coverage of the active marks, a missing one counting as 0."""
    return coverage.groupBy("region_id", "tissue").agg((F.coalesce(F.sum(F.when(F.col("assay").isin(*marks), F.col("coverage"))), F.lit(0.0)) / len(marks)).alias("activity"))


def track_means(regions: DataFrame, peaks: DataFrame, tracks: DataFrame) -> DataFrame:
    """What mean_coverage gives of track_coverage(regions, peaks, tracks), without a row for each region and track.

    Covered shares are summed by track; regions without overlap only count.
    """
    names = sorted({(r["tissue"], r["assay"]) for r in tracks.select("tissue", "assay").collect() if None not in (r["tissue"], r["assay"])})
    rows = track_sums(regions.select("chrom", "start", "end"), peaks, names)
    share = lambda i: F.sum(F.col("covered")[i] / (F.col("end") - F.col("start")))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*(share(i) for i in range(len(names)))).cast("array<double>").alias("s"))  # one row
    index = tracks.sparkSession.createDataFrame([(*x, i) for i, x in enumerate(names)], "tissue string, assay string, i int")
    every = tracks.join(F.broadcast(index), ["tissue", "assay"], "left").join(F.broadcast(sums), how="cross")
    return every.where("n > 0").select("tissue", "assay", (F.coalesce(F.get("s", F.col("i")), F.lit(0.0)) / F.col("n")).alias("coverage"))


def track_activity(regions: DataFrame, peaks: DataFrame, tracks: DataFrame, marks: tuple[str, ...] = ACTIVE_MARKS) -> DataFrame:
    """What activity gives of track_coverage(regions, peaks, tracks): (region_id, tissue, activity).

    Only peaks of these marks are read. tracks is the small list of tracks to report.
    """
    listed = sorted({(r["tissue"], r["assay"]) for r in tracks.select("tissue", "assay").collect()})
    tissues = sorted({t for t, _ in listed})
    used = [(t, m) for t, m in listed if m in marks]
    out = track_sums(regions.select("region_id", "chrom", "start", "end"), peaks, used).withColumn("length", F.col("end") - F.col("start"))

    def share(tissue: str):
        total = sum((F.col("covered")[i] / F.col("length") for i, (t, _) in enumerate(used) if t == tissue), F.lit(0.0))
        return F.when(F.col("length") > 0, total / len(marks)).otherwise(0.0)

    each = F.explode(F.array(*(F.struct(F.lit(t).alias("tissue"), share(t).alias("activity")) for t in tissues)))
    return out.select("region_id", each.alias("x")).select("region_id", "x.tissue", "x.activity")
