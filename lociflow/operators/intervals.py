"""Joins of genomic intervals, which are 0-based and half-open.

An overlap join has only the chromosome as equality, so both sides are laid out in bins. An interval has a level by its
length, and the bins of a level are at least as wide as its intervals, so none touches more than two of them, however
long it is. Two intervals meet in the bins of the coarser level of theirs, and a pair counts in the first bin that both
touch, so it comes once. A histogram of both sides tells which bins are crowded; these are dealt into blocks, each of
which a part of one side meets a part of the other in. Empty and inverted intervals overlap nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

BIN = 65_536
#: A bin of level k is STEP ** k times as wide as one of level 0; intervals above the last level touch more of its bins.
STEP, LEVELS = 8, 9
#: Rows of one side that a bin holds before it is dealt out, and bins that may be dealt out at most.
CROWD, CROWDED_BINS = 4096, 1000
#: Rows of a side that go to every task instead of a shuffle of both.
FEW = 20_000


def bins(start: str, end: str, width: int) -> Column:
    return F.expr(f"sequence({start} div {width}, ({end} - 1) div {width})")


def _level(start: str, end: str, width: int) -> Column:
    longer = [F.when(F.col(end) - F.col(start) > width * STEP**k, 1).otherwise(0) for k in range(LEVELS - 1)]
    return reduce(lambda a, b: a + b, longer).cast("int")


def _cells(start: str, end: str, width: int, met: set[int], own: set[int]) -> Column:
    """The (level, bin) in which an interval, of a level in `own`, may meet ones of the levels in `met`: those of its own and of coarser levels."""
    level, none = _level(start, end, width), F.array().cast("array<struct<level:int,bin:bigint>>")
    at = lambda k: lambda b: F.struct(F.lit(k).alias("level"), b.cast("bigint").alias("bin"))
    parts = []
    for k in sorted(x for x in met | own if x >= min(met, default=LEVELS)):  # finer bins have none to meet
        here = F.transform(bins(start, end, width * STEP**k), at(k))
        parts.append(F.when((level == k) if k not in met else (level <= k), here).otherwise(none))
    return F.flatten(F.array(*parts)) if parts else none


def _counted(left: DataFrame, right: DataFrame, width: int) -> tuple[DataFrame, tuple[set[int], int], tuple[set[int], int]]:
    """(chrom, side, level, bin, n) of both sides by level and first bin; the levels and the number of rows of each side."""
    def counted(df: DataFrame, start: str, end: str, side: int) -> DataFrame:
        level = _level(start, end, width)
        first = reduce(lambda out, k: F.when(level == k, F.expr(f"{start} div {width * STEP**k}")).otherwise(out), range(LEVELS), F.lit(0).cast("bigint"))
        return df.select("chrom", F.lit(side).alias("side"), level.alias("level"), first.alias("bin"))

    both = counted(left, "start", "end", 0).unionByName(counted(right, "r_start", "r_end", 1))
    loads = written(both.groupBy("chrom", "side", "level", "bin").agg(F.count(F.lit(1)).alias("n")), "loads")
    seen = {0: (set(), 0), 1: (set(), 0)} | {r["side"]: (set(r["levels"]), r["n"]) for r in loads.groupBy("side").agg(F.collect_set("level").alias("levels"), F.sum("n").alias("n")).collect()}
    return loads, seen[0], seen[1]


def crowded_bins(left: DataFrame, right: DataFrame, width: int, crowd: int) -> tuple[DataFrame | None, set[int], set[int]]:
    """(chrom, level, bin, p, q) of the bins that hold many rows of a side and into how many parts to deal each side, or None; the levels of both sides.

    Both sides are counted once, by level and first bin, and the counts of coarser bins follow. A bin is crowded above
    `crowd` rows of a side and above a thousandth of that side, so at most 1000 bins a side and level are.
    """
    loads, (a, n), (b, m) = _counted(left, right, width)
    return _dealt(loads, a | b, n, m, crowd), a, b


def _dealt(loads: DataFrame, levels: set[int], n: int, m: int, crowd: int) -> DataFrame | None:
    most = [max(crowd, -(-x // CROWDED_BINS)) for x in (n, m)]
    if n <= most[0] and m <= most[1]:
        return None
    up = F.explode(F.array(*(F.lit(k) for k in sorted(levels)))).alias("at")
    wide = loads.select("chrom", "side", "level", "bin", "n", up).where("at >= level")
    wide = wide.withColumn("bin", F.expr(f"bin div cast(pow({STEP}, at - level) as bigint)"))
    parts = lambda k: F.ceil(F.greatest(F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)) / most[k], F.lit(1.0))).alias("pq"[k])
    dealt = wide.groupBy("chrom", F.col("at").alias("level"), "bin").agg(parts(0), parts(1)).where("p > 1 or q > 1")
    return None if dealt.isEmpty() else dealt


def _paired(left: DataFrame, right: DataFrame, width: int, crowd: int) -> DataFrame:
    """Overlapping pairs of left(chrom, start, end, ...) and right(chrom, r_start, r_end, ...), which are not empty."""
    loads, (a_levels, n), (b_levels, m) = _counted(left, right, width)
    few = min(n, m) <= FEW
    dealt = None if few else _dealt(loads, a_levels | b_levels, n, m, crowd)
    levels = sorted(a_levels | b_levels)
    if len(levels) == 1:  # as where all intervals are short: their bins without more ado
        one = F.lit(levels[0])
        a = left.withColumn("__bin", F.explode(bins("start", "end", width * STEP ** levels[0]))).withColumns({"__level": one, "__own": one})
        b = right.withColumn("__bin", F.explode(bins("r_start", "r_end", width * STEP ** levels[0]))).withColumns({"__level": one, "__r_own": one})
    else:
        a = left.withColumn("__cell", F.explode(_cells("start", "end", width, b_levels, a_levels))).withColumn("__own", _level("start", "end", width))
        b = right.withColumn("__cell", F.explode(_cells("r_start", "r_end", width, a_levels, b_levels))).withColumn("__r_own", _level("r_start", "r_end", width))
        a, b = (df.withColumns({"__level": F.col("__cell.level"), "__bin": F.col("__cell.bin")}).drop("__cell") for df in (a, b))
    keys = ["chrom", "__level", "__bin"]
    if dealt is not None:
        parts = F.broadcast(dealt.withColumnsRenamed({"level": "__level", "bin": "__bin"}))
        part = lambda df, k: F.pmod(F.xxhash64(*df.columns), F.coalesce(k, F.lit(1))).cast("int")
        each = lambda k: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(k), F.lit(1)).cast("int") - 1))
        a = a.join(parts, keys, "left").withColumn("__i", part(a, F.col("p"))).withColumn("__j", each("q")).drop("p", "q")
        b = b.join(parts, keys, "left").withColumn("__j", part(b, F.col("q"))).withColumn("__i", each("p")).drop("p", "q")
        keys += ["__i", "__j"]
    first = reduce(lambda out, k: F.when(F.col("__level") == k, F.expr(f"greatest(start, r_start) div {width * STEP**k}")).otherwise(out), levels, F.lit(0).cast("bigint"))
    # by rows counted: the optimizer doesn't see what explode makes of a side
    a, b = (a.hint("broadcast"), b) if few and n <= m else (a, b.hint("broadcast" if few else "merge"))
    pairs = a.join(b, keys).where((F.col("r_start") < F.col("end")) & (F.col("r_end") > F.col("start")) & (F.col("__level") == F.greatest("__own", "__r_own")) & (F.col("__bin") == first))
    return pairs.drop("__level", "__bin", "__own", "__r_own", "__i", "__j")


def overlap_join(left: DataFrame, right: DataFrame, width: int = BIN, crowd: int = CROWD) -> DataFrame:
    """Pairs of left(chrom, start, end, ...) and right(chrom, start, end, ...) that overlap.

    The columns are left's, right's with start and end named r_start and r_end, and overlap_bp. Column names other than
    these must not clash. Both sides are read twice, once for their histogram; starts are 0 or more.
    """
    a = left.where("end > start")
    b = right.where("end > start").withColumnsRenamed({"start": "r_start", "end": "r_end"})
    return _paired(a, b, width, crowd).withColumn("overlap_bp", F.least("end", "r_end") - F.greatest("start", "r_start"))


def union_coverage(overlaps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, union_bp, signal_bp) of overlap_join's rows with a signal: bases covered by any interval, and the sum of signal times overlap.

    The union is a running maximum of ends: each start adds what its longest piece has beyond all earlier ones. Pieces
    of one start are one row before that, so a window holds no more rows than its region has bases.
    """
    a, b = F.greatest("start", "r_start"), F.least("end", "r_end")
    starts = overlaps.groupBy(*keys, a.alias("__a")).agg(F.max(b).alias("__b"), F.sum(F.col("signal") * F.col("overlap_bp")).alias("__s"))
    order = Window.partitionBy(*keys).orderBy("__a").rowsBetween(Window.unboundedPreceding, -1)
    beyond = F.greatest(F.lit(0), F.col("__b") - F.greatest("__a", F.coalesce(F.max("__b").over(order), "__a")))
    return starts.withColumn("__new", beyond).groupBy(*keys).agg(F.sum("__new").cast("long").alias("union_bp"), F.sum("__s").alias("signal_bp"))


def disjoint(intervals: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """(keys, chrom, start, end): intervals cut to what lies beyond the earlier ones of their keys and chromosome.

    The pieces cover what the intervals cover, once, so sums of their overlaps are union coverage without a sort of all
    pairs. A running maximum of ends in segments: of intervals with one start the longest counts; within a segment of
    `width` bases they are ordered, and segments hand on the maximum of all earlier ones. So a window holds `width` rows
    at most, or a row for each segment of a chromosome.
    """
    by = [*keys, "chrom"]
    starts = intervals.where("end > start").groupBy(*by, "start").agg(F.max("end").alias("end")).withColumn("__seg", F.expr(f"start div {width}"))
    earlier = lambda *w: Window.partitionBy(*w[:-1]).orderBy(w[-1]).rowsBetween(Window.unboundedPreceding, -1)
    tops = starts.groupBy(*by, "__seg").agg(F.max("end").alias("__top"))
    carried = tops.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col("__seg").alias("__s"), F.max("__top").over(earlier(*by, "__seg")).alias("__carry"))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)), F.col("__seg") == F.col("__s"))
    inside = starts.withColumn("__seen", F.max("end").over(earlier(*by, "__seg", "start")))
    cut = inside.join(carried, same).withColumn("start", F.greatest("start", "__seen", "__carry"))  # greatest skips nulls
    return cut.where("end > start").select(*by, "start", "end")


def point_join(points: DataFrame, blocks: DataFrame, width: int = BIN, crowd: int = CROWD) -> DataFrame:
    """Pairs of points(chrom, pos, ...) and blocks(chrom, start, end, ...) with start <= pos < end; pos is 0 or more."""
    a = blocks.where("end > start")
    b = points.withColumns({"r_start": F.col("pos"), "r_end": F.col("pos") + 1})
    return _paired(a, b, width, crowd).drop("r_start", "r_end").select(*points.columns, *(c for c in blocks.columns if c != "chrom"))


def bin_grid(sizes: DataFrame, width: int) -> DataFrame:
    """(bin_key, chrom, start, end): tiles of sizes(chrom, size); the last one of a chromosome is cut."""
    tiles = sizes.select("chrom", "size", F.explode(F.expr(f"sequence(0L, size - 1, {width}L)")).alias("start"))
    end = F.least(F.col("start") + width, F.col("size"))
    return tiles.select(F.concat("chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), end.cast("string")).alias("bin_key"), "chrom", "start", end.alias("end"))
