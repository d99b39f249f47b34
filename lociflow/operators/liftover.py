"""Crossing genome builds over the blocks of a chain file, with quality counts.

blocks(chrom, start, end, to_chrom, to_start, to_strand, to_size, score): an ungapped run of bases of the old build and
where it begins in the new one; on the minus strand to_start counts from the end of the chromosome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.readers import read_bed_rest
from ..sources.writers import write_bed
from .intervals import point_join

STATUSES = ("mapped", "unmapped", "diff_chrom", "degenerate", "round_trip")


def lift_points(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """(point_id, to_chrom, to_pos) for the points(point_id, chrom, pos) in some block; of several, that of the best score."""
    hits = point_join(points, blocks)
    ahead = F.col("to_start") + F.col("pos") - F.col("start")
    spot = F.struct((-F.col("score")).alias("s"), "to_chrom", F.when(F.col("to_strand") == "-", F.col("to_size") - 1 - ahead).otherwise(ahead).alias("to_pos"))
    return hits.groupBy("point_id").agg(F.min(spot).alias("h")).select("point_id", "h.to_chrom", "h.to_pos")


def reversed_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks of the way back. A minus strand stays one, counted from the other chromosome's end."""
    n = F.col("end") - F.col("start")
    minus = F.col("to_strand") == "-"
    begin = F.when(minus, F.col("to_size") - F.col("to_start") - n).otherwise(F.col("to_start"))
    size = F.coalesce("size", F.max("end").over(Window.partitionBy("chrom"))) if "size" in blocks.columns else F.max("end").over(Window.partitionBy("chrom"))
    back = F.when(minus, size - F.col("end")).otherwise(F.col("start"))
    return blocks.select(F.col("to_chrom").alias("chrom"), begin.alias("start"), (begin + n).alias("end"), F.col("chrom").alias("to_chrom"), back.alias("to_start"), "to_strand", size.alias("to_size"), "score")


def lift_status(regions: DataFrame, blocks: DataFrame, round_trip: bool = True, tolerance: float = 2, strict: bool = False) -> DataFrame:
    """regions(region_id, chrom, start, end, ...) with status and, where known, to_chrom, to_start and to_end.

    Both ends are lifted as points. A region is unmapped if an end has no block, diff_chrom if they part, degenerate if
    nothing is left between them. In the round trip both new ends are lifted back: it fails if one has no block or
    comes to another chromosome, or if both are off by more than tolerance times the length plus one; strict asks for
    either end to be within tolerance bases.
    """
    def ends(df: DataFrame, chrom: str, a: str, b: str) -> DataFrame:
        first = df.select(F.struct("region_id", F.lit(0).alias("side")).alias("point_id"), F.col(chrom).alias("chrom"), F.col(a).alias("pos"))
        return first.unionByName(df.select(F.struct("region_id", F.lit(1).alias("side")).alias("point_id"), F.col(chrom).alias("chrom"), F.col(b).alias("pos")))

    def both(lifted: DataFrame, name: str) -> DataFrame:
        pick = lambda k, c: F.max(F.when(F.col("point_id.side") == k, F.col(c)))
        return lifted.groupBy(F.col("point_id.region_id").alias("region_id")).agg(*(pick(k, c).alias(f"{name}_{c}{k}") for k in (0, 1) for c in ("to_chrom", "to_pos")))

    there = both(lift_points(ends(regions, "chrom", "start", "end"), blocks), "f")
    out = regions.join(there, "region_id", "left")
    out = out.withColumns({"__a": F.least("f_to_pos0", "f_to_pos1"), "__b": F.greatest("f_to_pos0", "f_to_pos1")})
    missing = F.col("f_to_pos0").isNull() | F.col("f_to_pos1").isNull()
    status = F.when(missing, "unmapped").when(F.col("f_to_chrom0") != F.col("f_to_chrom1"), "diff_chrom").when(F.col("__b") <= F.col("__a"), "degenerate").otherwise("mapped")
    out = out.withColumn("status", status)
    if round_trip:
        kept = out.where("status = 'mapped'").select("region_id", F.col("f_to_chrom0").alias("c"), "__a", "__b")
        back = both(lift_points(ends(kept, "c", "__a", "__b"), reversed_blocks(blocks)), "r")
        out = out.join(back, "region_id", "left")
        lost = F.coalesce((F.col("r_to_chrom0") != F.col("chrom")) | (F.col("r_to_chrom1") != F.col("chrom")), F.lit(True)) | F.col("r_to_pos0").isNull() | F.col("r_to_pos1").isNull()
        room = F.lit(tolerance) if strict else tolerance * (F.col("end") - F.col("start") + 1)
        off = [F.abs(F.col(f"r_to_pos{k}") - F.col(c)) > room for k, c in ((0, "start"), (1, "end"))]
        far = (off[0] | off[1]) if strict else (off[0] & off[1])
        out = out.withColumn("status", F.when((F.col("status") == "mapped") & (lost | far), "round_trip").otherwise(F.col("status")))
    ok = F.col("status") == "mapped"
    return out.select(*regions.columns, "status", F.when(ok, F.col("f_to_chrom0")).alias("to_chrom"), F.when(ok, F.col("__a")).alias("to_start"), F.when(ok, F.col("__b")).alias("to_end"))


def lift_regions(regions: DataFrame, blocks: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(lifted, counts): the mapped regions with new coordinates and all other columns, and one row of quality counts."""
    status = lift_status(regions, blocks, **options)
    rest = [c for c in regions.columns if c not in ("chrom", "start", "end")]
    lifted = status.where("status = 'mapped'").select(F.col("to_chrom").alias("chrom"), F.col("to_start").alias("start"), F.col("to_end").alias("end"), *rest)
    return lifted, lift_counts(status)


def lift_counts(status: DataFrame) -> DataFrame:
    """One row (n_in, n_mapped, mapping_rate, dropped_unmapped, dropped_diff_chrom, dropped_degenerate, dropped_round_trip)."""
    n, count = F.count(F.lit(1)), lambda s: F.count_if(F.col("status") == s)
    rate = F.coalesce(F.try_divide(count("mapped").cast("double"), n), F.lit(0.0))
    return status.agg(n.alias("n_in"), count("mapped").alias("n_mapped"), rate.alias("mapping_rate"), *(count(s).alias(f"dropped_{s}") for s in STATUSES[1:]))


def lift_bed_file(spark: SparkSession, path: str, out: str, blocks: DataFrame, round_trip: bool = False, compressed: bool = True, **options) -> DataFrame:
    """Lifts a BED file to another, further columns as they are, and returns the row of quality counts."""
    lifted, counts = lift_regions(read_bed_rest(spark, path), blocks, round_trip=round_trip, **options)
    write_bed(lifted, out, compressed)
    return counts
