"""Covered bases and signal of regions by track, without a row for each pair of a region and a peak.

Pairs grow with regions times peaks. What a track covers of a region is a difference of running sums instead: regions
are put in tiles, each with the peaks that reach into it, and a tile's sums are looked up at both ends of each region.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from ..sources.scratch import written
from .intervals import BIN, STEP

#: A tile of level k is TILE * STEP ** k wide and takes regions that start in it, of up to a quarter of its width.
TILE, LEVELS = 4 * BIN, 15
#: Regions of a tile that one task takes at a time.
CROWD = 50_000
#: So few peaks are added up one by one, which rounds as a plain sum does.
FEW = 64
#: Groups over which tiles are spread where many small ones share a group.
GROUPS = 4096


def _width(level: Column | str) -> str:
    return f"shiftleft({TILE}L, 3 * {level})"


def _tile(at: str, level: str = "__level") -> str:
    """The tile of a position, for negative ones too."""
    return f"(({at}) - pmod({at}, {_width(level)})) div {_width(level)}"


def _sums(ends: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ends in order, and running sums of their values from 0."""
    order = np.argsort(ends, kind="stable")
    return ends[order], np.concatenate([np.zeros(1, values.dtype), np.cumsum(values[order])])


def covered_bases(a: np.ndarray, b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Bases of each [s, e) that any of the intervals [a, b) covers."""
    order = np.argsort(a, kind="stable")
    a, top = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.concatenate([[True], a[1:] > top[:-1]]))
    a, b = a[first], top[np.concatenate([first[1:] - 1, [len(top) - 1]])]  # disjoint
    total = np.concatenate([[0], np.cumsum(b - a)])
    before = lambda x: total[i := np.searchsorted(a, x)] - np.where(i > 0, np.maximum(0, b[i - 1] - x), 0)
    return before(e) - before(s)


def signal_sums(a: np.ndarray, b: np.ndarray, signal: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The sum of signal times overlap with the intervals [a, b) for each [s, e): of more than FEW as a difference of running sums in extended precision."""
    order = np.argsort(a, kind="stable")
    a, b, signal = a[order], b[order], signal[order]
    first, last = np.searchsorted(np.maximum.accumulate(b), s, "right"), np.searchsorted(a, e)
    few, out = last - first <= FEW, np.zeros(len(s))
    for k in range(max(0, (last - first)[few].max(initial=0))):
        own = np.flatnonzero(few & (first + k < last))
        at = first[own] + k
        shared = np.minimum(b[at], e[own]) - np.maximum(a[at], s[own])
        out[own] += np.where(shared > 0, signal[at] * shared, 0)
    if not few.all():
        out[~few] = _running_sums(a, b, signal, s[~few], e[~few])
    return out


def _running_sums(a: np.ndarray, b: np.ndarray, signal: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    known = np.isfinite(signal)
    v = np.where(known, signal, 0).astype(np.longdouble)
    starts, begun = _sums(a, v)
    _, begun_at = _sums(a, v * a)
    ends, over = _sums(b, v)
    _, over_at = _sums(b, v * a)
    _, whole = _sums(b, v * (b - a))

    def before(x: np.ndarray) -> np.ndarray:
        i, j = np.searchsorted(starts, x), np.searchsorted(ends, x, "right")
        return whole[j] + (begun[i] - over[j]) * x - (begun_at[i] - over_at[j])

    out = (before(e) - before(s)).astype(np.float64)
    if not known.all():
        met = lambda some: np.searchsorted(np.sort(a[some]), e) > np.searchsorted(np.sort(b[some]), s, "right")
        for value in (np.inf, -np.inf):
            out = out + np.where(met(signal == value), value, 0.0)
        out = np.where(met(np.isnan(signal)), np.nan, out)
    return out


def _tile_sums(n: int, names: list[str], keys: list[str], with_signal: bool, regions: pa.Table, peaks: pa.Table) -> pa.Table:
    """The rows `names` of some tiles' regions with lists of what each of n tracks covers."""
    out = regions.select(names)
    if not regions.num_rows:
        return pa.Table.from_arrays([*out.columns, *(pa.array([], pa.list_(t)) for t in (pa.int64(), pa.float64())[: 1 + with_signal])], [*names, "covered", "weight"][: len(names) + 1 + with_signal])
    s, e, a, b, met = _side_by_side(keys, regions, peaks)
    track, a, b = peaks.column("__track").to_numpy()[met], a[met], b[met]
    order = np.argsort(track, kind="stable")
    bounds = np.searchsorted(track[order], np.arange(n + 1))
    covered, weight = np.zeros((len(s), n), np.int64), np.zeros((len(s) if with_signal else 0, n))
    signal = peaks.column("signal").to_numpy()[met] if with_signal else None
    for t in range(n):
        own = order[bounds[t] : bounds[t + 1]]
        if len(own):
            covered[:, t] = covered_bases(a[own], b[own], s, e)
            if with_signal:
                weight[:, t] = signal_sums(a[own], b[own], signal[own], s, e)
    at = pa.array(np.arange(len(s) + 1, dtype=np.int32) * n)
    out = out.append_column("covered", pa.ListArray.from_arrays(at, pa.array(covered.ravel())))
    return out.append_column("weight", pa.ListArray.from_arrays(at, pa.array(weight.ravel()))) if with_signal else out


def _placed(regions: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """regions, which are not empty, with their __level and __tile; (chrom, __level, __tile, __parts) of the tiles that hold any; the levels."""
    level = reduce(lambda x, y: x + y, (F.when(F.col("end") - F.col("start") > BIN * STEP**k, 1).otherwise(0) for k in range(LEVELS - 1)))
    placed = regions.withColumn("__level", level.cast("int")).withColumn("__tile", F.expr(_tile("start")))
    loads = written(placed.groupBy("chrom", "__level", "__tile").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("__parts")), "tiles")
    return placed, loads, sorted(r["__level"] for r in loads.select("__level").distinct().collect())


def _reaching(intervals: DataFrame, loads: DataFrame) -> DataFrame:
    """The intervals that lie near tiles with regions, with the span (__low, __high) of these on the chromosome."""
    span = F.expr(f"__tile * {_width('__level')}")
    reach = loads.groupBy("chrom").agg(F.min(span).alias("__low"), F.max(span + F.expr(f"{_width('__level')} div 4 * 5")).alias("__high"))
    return intervals.join(reach, "chrom").where("start < __high and end > __low")


def _dealt(placed: DataFrame, cut: DataFrame, loads: DataFrame, levels: list[int]) -> tuple[DataFrame, DataFrame, list[str]]:
    """The regions by tile, of crowded ones in parts; the intervals of cut by all tiles and parts that they reach into; the keys of both."""
    each = cut.withColumn("__level", F.explode(F.array(*map(F.lit, levels))))
    a, b = f"greatest(start, __low) - {_width('__level')} div 4", "least(end, __high) - 1"
    each = each.withColumn("__tile", F.explode(F.expr(f"sequence({_tile(a)}, {_tile(b)})"))).drop("__low", "__high")
    keys = ["chrom", "__level", "__tile"]
    each = each.join(loads, keys).withColumn("__part", F.explode(F.expr("sequence(0, __parts - 1)"))).drop("__parts")
    own = [c for c in placed.columns if c not in ("__level", "__tile")]
    # few tiles are crowded, which the optimizer doesn't see: it would shuffle the regions once more
    dealt = placed.join(F.broadcast(loads.where("__parts > 1")), keys, "left").withColumn("__part", F.pmod(F.xxhash64(*own), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    return dealt, each, [*keys, "__part"]


def track_sums(regions: DataFrame, peaks: DataFrame, tracks: list[tuple], with_signal: bool = False, crowd: int = CROWD) -> DataFrame:
    """regions(chrom, start, end, ...) with covered, an array of the bases that each of `tracks` covers, and weight, of the sums of signal times overlap.

    tracks is a list of different (tissue, assay), of peaks(tissue, assay, chrom, start, end, signal). Regions and peaks
    are each shuffled once, and work grows with their number. Peaks of one start are one row before, or of one start and
    end for the signal. Regions that are empty have nulls. Sums of signal carry the precision of their tile's sum.
    """
    spark = regions.sparkSession
    fields = [*regions.schema.fields]
    schema = StructType([*fields]).add("covered", ArrayType(LongType()))
    if with_signal:
        schema = schema.add("weight", ArrayType(DoubleType()))
    some = F.coalesce(F.col("end") > F.col("start"), F.lit(False))
    nothing = regions.where(~some).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[len(fields) :]))
    placed, loads, levels = _placed(regions.where(some), crowd)
    if not levels or not tracks:
        return regions.select("*", *(F.when(some, F.array_repeat(F.lit(0).cast(f.dataType.elementType), len(tracks))).alias(f.name) for f in schema.fields[len(fields) :]))

    index = spark.createDataFrame([(*t, i) for i, t in enumerate(tracks)], "__tissue string, __assay string, __track int")
    own = peaks.where("end > start").join(F.broadcast(index), (F.col("tissue") == F.col("__tissue")) & (F.col("assay") == F.col("__assay")))
    cut = _reaching(own, loads)
    by = ["chrom", "__track", "start"]
    if with_signal:
        cut = cut.groupBy(*by, "end", "__low", "__high").agg(F.sum(F.coalesce("signal", F.lit(0.0))).alias("signal"))
    else:
        cut = cut.groupBy(*by, "__low", "__high").agg(F.max("end").alias("end"))
    dealt, each, keys = _dealt(placed, cut, loads, levels)
    f, group = partial(_tile_sums, len(tracks), [x.name for x in fields], keys, with_signal), keys if with_signal else [_group(loads, keys)]
    sums = dealt.groupBy(*group).cogroup(each.groupBy(*group)).applyInArrow(lambda left, right: f(left, right), schema)
    return sums.unionByName(nothing)


def _group(loads: DataFrame, keys: list[str]) -> Column:
    """The group of a tile, so that many short chromosomes cost no group each. Sums of signal don't share one, whose precision is their tile's."""
    groups = max(GROUPS, loads.agg(F.sum("__parts")).first()[0] // GROUPS)
    return F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("__group")


def _side_by_side(keys: list[str], regions: pa.Table, segments: pa.Table) -> tuple[np.ndarray, ...]:
    """start and end of regions and of segments with all tiles of both laid on one line, each as long as its regions span, and which segments lie on it."""
    n, both = regions.num_rows, pa.concat_tables([regions.select([*keys, "start", "end"]), segments.select([*keys, "start", "end"])], promote_options="permissive")
    by = [(both.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices).to_numpy() for c in keys]
    order = np.lexsort(by)
    new = np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in by], axis=0)])[: len(order)]
    tile = np.empty(len(order), np.int64)
    tile[order] = np.cumsum(new) - 1
    start, end = (both.column(c).to_numpy() for c in ("start", "end"))
    low, high = np.full(tile.max(initial=-1) + 1, np.iinfo(np.int64).max), np.full(tile.max(initial=-1) + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, tile[:n], start[:n])
    np.maximum.at(high, tile[:n], end[:n])
    held = high > low  # a part of a tile may have got no region
    low, high = np.where(held, low, 0), np.where(held, high, 0)
    shift = np.concatenate([[0], np.cumsum(high - low)[:-1]]) - low
    start, end = (np.clip(x, low[tile], high[tile]) + shift[tile] for x in (start, end))
    return start[:n], end[:n], start[n:], end[n:], end[n:] > start[n:]


def _state_lists(names: list[str], keys: list[str], regions: pa.Table, segments: pa.Table) -> pa.Table:
    """The rows `names` of some tiles' regions with a list of (state, bp, first) of the states that reach into each."""
    s, e, a, b, on = _side_by_side(keys, regions, segments)
    a, b, n, origin = a[on], b[on], *(segments.column(c).to_numpy()[on] for c in ("n", "start"))
    states = segments.column("state").combine_chunks().dictionary_encode(null_encoding="encode")
    code = states.indices.to_numpy()[on]
    order, longest = np.argsort(s, kind="stable"), (e - s).max(initial=0)
    begun, by = s[order], np.lexsort((origin, a, code))
    bounds = np.searchsorted(code[by], np.arange(len(states.dictionary) + 1))
    found = [(np.zeros(0, np.int64),) * 4]
    for t in np.flatnonzero(np.diff(bounds)):
        own = by[bounds[t] : bounds[t + 1]]
        i, j, k = a[own], b[own], n[own]
        top = np.maximum.accumulate(j)
        near = order[np.searchsorted(begun, i[0] - longest) : np.searchsorted(begun, top[-1])]
        first = np.searchsorted(top, s[near], "right")  # the leftmost segment that ends beyond the region's start
        met = i[np.minimum(first, len(i) - 1)] < e[near]
        near, first = near[met], first[met]
        (starts, opened), (_, opened_at), (ends, closed), (_, closed_at) = _sums(i, k), _sums(i, k * i), _sums(j, k), _sums(j, k * j)
        p, q = (np.searchsorted(x, (s[near], e[near])) for x in (starts, ends))
        before = (opened[p] - closed[q]) * (s[near], e[near]) - (opened_at[p] - closed_at[q])  # bases of the state up to each end of a region
        found.append((near, np.full(len(near), t), before[1] - before[0], origin[own][first]))
    row, t, bp, first = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(s)))]).astype(np.int32)
    parts = [states.dictionary.take(pa.array(t[order])), pa.array(bp[order]), pa.array(first[order])]
    return regions.select(names).append_column("states", pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(parts, ["state", "bp", "first"])))


def state_lists(regions: DataFrame, segments: DataFrame, crowd: int = CROWD) -> DataFrame:
    """regions(chrom, start, end, ...) with states, an array of (state, bp, first): bases of each state in the region, and where the first such segment starts.

    segments(chrom, start, end, state) may overlap; each then counts. Regions and segments are each shuffled once, and no
    pairs are made; work grows with the regions times the states around them. Regions that are empty, or that no segment
    overlaps, have no states. Tiles share groups, so that many short chromosomes cost no group each.
    """
    lists = ArrayType(StructType().add("state", segments.schema["state"].dataType).add("bp", LongType()).add("first", LongType()))
    none = F.array().cast(lists)
    some = F.coalesce(F.col("end") > F.col("start"), F.lit(False))
    placed, loads, levels = _placed(regions.where(some), crowd)
    if not levels:
        return regions.withColumn("states", none)
    spans = segments.where("end > start").select("chrom", *(F.col(c).cast("long").alias(c) for c in ("start", "end")), "state")
    copies = _reaching(spans, loads).groupBy("chrom", "start", "end", "state", "__low", "__high").agg(F.count(F.lit(1)).alias("n"))
    dealt, each, keys = _dealt(placed, copies, loads, levels)
    group = _group(loads, keys)
    f, schema = partial(_state_lists, regions.columns, keys), StructType([*regions.schema.fields]).add("states", lists)
    found = dealt.groupBy(group).cogroup(each.groupBy(group)).applyInArrow(lambda left, right: f(left, right), schema)
    return found.unionByName(regions.where(~some).withColumn("states", none))
