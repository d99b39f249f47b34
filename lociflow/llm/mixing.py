"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Every source gets a target by weight, at most `cap` times its own words. It is taken in whole passes, and in one more
pass over part of its documents: first the large ones (those above an eighth of that pass), then the others, both in the
order of a hash of their ids up to the first that doesn't fit, and at last the one document that fits best what is left. A source's weight over training time is a piecewise linear schedule; its integral, scaled to the source's
target, is the cumulative demand for its words, and a document's place in its source's stream is turned into a training
position by inverting that demand. Sorting by position gives the curriculum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = "[^\\x20\\x09-\\x0D]+"
#: Knots (time, relative weight) by rank of source, repeating like the weights: fades out, stays, fades in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))

#: Documents above this part of the last pass go first, so that the smaller ones can fill what they leave.
SMALL = 8


def demand_inverse(knots: tuple[tuple[float, float], ...], share: Column) -> Column:
    """The time at which the integral of a piecewise linear schedule has reached this share of its whole."""
    pieces = list(zip(knots, knots[1:], strict=False))
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pieces]
    whole, done, out = sum(areas), 0.0, None
    for (((t0, w0), (t1, w1)), area) in zip(pieces, areas, strict=True):
        need = F.least(F.greatest(share * whole - done, F.lit(0.0)), F.lit(area))
        slope = (w1 - w0) / (t1 - t0)
        time = F.lit(t0) + (need / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0))) - w0) / slope)
        out = time if out is None else F.when(share * whole <= done, out).otherwise(time)
        done += area
    return out


def source_targets(sized: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size, n, i, target): one row per source; the caps are filled from the smallest cap per weight up."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    i = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = sums.withColumn("i", i).withColumn("w", weight).withColumn("most", cap * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("most") / F.col("w"), "i")
    earlier = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(Window.orderBy(F.desc(F.col("most") / F.col("w")), F.desc("i")).rowsBetween(Window.unboundedPreceding, 0))
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - earlier) / rest
    levels = ranked.withColumn("level", level)
    return levels.withColumn("target", F.least("most", F.col("w") * F.max("level").over(everything))).select("source", "source_size", "n", "i", "target")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, schedules=SCHEDULES) -> tuple[DataFrame, DataFrame]:
    """(rows, units): rows has doc_id, source, size of every row of docs; units has for each (source, doc_id) how often
    it is taken (times), its source's source_size and target, and the training position of each copy (positions).

    Rows of one source that repeat an id are one unit, taken alike. Null sources are a source of their own, null ids a
    unit of their own; null and blank texts have size 0. An empty table gives empty ones.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")), "sizes")
    targets = written(source_targets(rows, weights, cap), "targets")
    total = targets.agg(F.sum("n")).first()[0] or 0
    bits = min(40, max(6, (int(total) // 50_000).bit_length()))
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    units = rows.groupBy("source", "doc_id").agg(F.sum("size").alias("size")).withColumn("h", h).withColumn("part", F.shiftright("h", 60 - bits))
    units = written(units, "units")
    known = units.join(_small(targets.withColumnRenamed("source", "s3")), F.col("source").eqNullSafe(F.col("s3"))).drop("s3")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    known = known.withColumn("passes", whole.cast("long")).withColumn("more", F.col("target") - F.col("passes") * F.col("source_size"))
    known = known.withColumn("large", F.when(SMALL * F.col("size") > F.col("more"), F.col("size")).otherwise(0))
    known = with_running_sums(known, before="size", ahead="large")
    known = known.withColumn("place", F.when((F.col("large") > 0) & (F.col("ahead") + F.col("size") <= F.col("more")), F.col("ahead")))
    known = written(known.select("source", "doc_id", "size", "h", "part", "source_size", "i", "target", "passes", "more", "before", "place"), "taken")
    known = known.join(_small(_gaps(known)), F.col("source").eqNullSafe(F.col("s4")))
    can = SMALL * F.col("size") <= F.col("more")
    known = with_running_sums(known.withColumn("can", F.when(can, F.col("size")).otherwise(0)), behind="can")
    more = can & (F.col("behind") + F.col("size") <= F.col("gap"))
    known = known.withColumn("place", F.when(more, F.col("had") + F.col("behind")).otherwise(F.col("place"))).drop("can", "behind", "had", "gap", "s4")
    known = written(known, "filled")
    wide = known.join(_small(_gaps(known)), F.col("source").eqNullSafe(F.col("s4")))
    close = F.struct(F.abs(F.col("size") - F.col("gap")).alias("miss"), "h", "doc_id")
    best = wide.where("place is null and size > 0 and abs(size - gap) < gap").groupBy("source").agg(F.min(close).alias("b"))
    best = written(best.select(F.col("source").alias("s5"), F.col("b.h").alias("h5"), F.col("b.doc_id").alias("d5")), "fills")
    wide = wide.join(_small(best), F.col("source").eqNullSafe(F.col("s5")), "left")
    fill = F.coalesce((F.col("h") == F.col("h5")) & F.col("doc_id").eqNullSafe(F.col("d5")) & F.col("place").isNull(), F.lit(False))
    stream = F.greatest(F.col("passes") * F.col("source_size") + F.col("had"), F.lit(1))
    start = lambda j: F.when(j < F.col("passes"), j * F.col("source_size") + F.col("before")).otherwise(F.col("passes") * F.col("source_size") + F.when(fill, F.col("had")).otherwise(F.coalesce("place", F.lit(0))))
    times = (F.col("passes") + F.when(F.col("place").isNotNull() & (F.col("more") > 0) | fill, 1).otherwise(0)).cast("int")
    share = lambda j: F.least((start(j) + F.col("size") / 2) / stream, F.lit(1.0))

    def position(j: Column) -> Column:
        out = demand_inverse(schedules[0], share(j))
        for k, knots in enumerate(schedules[1:], 1):
            out = F.when(F.col("i") % len(schedules) == k, demand_inverse(knots, share(j))).otherwise(out)
        return out

    positions = F.when(F.col("times") > 0, F.transform(F.sequence(F.lit(0), F.col("times") - 1), position)).otherwise(F.array().cast("array<double>"))
    units = wide.withColumn("times", times).withColumn("positions", positions)
    return rows, units.select("source", "doc_id", "source_size", "target", "times", "positions")


def with_running_sums(units: DataFrame, **values: str) -> DataFrame:
    """units with sums of columns over earlier units of their source, by hash: parts are summed first, so no source fills one task."""
    to_here = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy("source", "part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = units.groupBy("source", "part").agg(*(F.sum(v).alias(n) for n, v in values.items()))
    bases = sums.select(F.col("source").alias("s2"), F.col("part").alias("p2"), *((F.sum(n).over(to_here) - F.col(n)).alias(f"{n}_base") for n in values))
    summed = units.withColumns({f"{n}_inside": F.sum(v).over(inside) for n, v in values.items()})
    out = summed.join(bases, F.col("source").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2")))
    return out.withColumns({n: F.col(f"{n}_base") + F.col(f"{n}_inside") - F.col(v) for n, v in values.items()}).select(*units.columns, *values)


def _gaps(known: DataFrame) -> DataFrame:
    """(s4, had, gap) by source: the words that units with a place have, and what is left of the last pass."""
    sums = known.groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("place").isNotNull(), F.col("size"))), F.lit(0)).alias("had"), F.first("more").alias("more"))
    return written(sums.select(F.col("source").alias("s4"), "had", (F.col("more") - F.col("had")).alias("gap")), "gaps")


def _few(sources: DataFrame, most: int = 10_000) -> bool:
    """Whether a table of sources is small enough to broadcast."""
    return sources.limit(most + 1).count() <= most


def _small(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if _few(sources) else sources


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_position, last_position) for every row of docs; positions are null where none is taken."""
    rows, units = mix_plan(docs, **options)
    u = units.toDF("s", "d", *units.columns[2:])
    out = rows.join(u, F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")))
    at = lambda k: F.try_element_at("positions", F.lit(k))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), at(1).alias("first_position"), at(-1).alias("last_position"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, as often as they are taken, range-sorted by training position; the columns are those of docs."""
    _, units = mix_plan(docs, id_col=id_col, source_col=source_col, **options)
    u = units.where("times > 0").select(F.col("source").alias("__s"), F.col("doc_id").alias("__d"), F.col("positions").alias("__p"))
    copies = docs.join(u, F.col(source_col).eqNullSafe(F.col("__s")) & F.col(id_col).eqNullSafe(F.col("__d")))
    placed = copies.withColumn("__at", F.explode("__p"))
    return placed.repartitionByRange("__at", id_col).sortWithinPartitions("__at", id_col).select(*docs.columns)


#: DuckDB SQL of the query, with the default parameters.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM sums
), weighed AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS most FROM ranked
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY most / w DESC, i DESC ROWS UNBOUNDED PRECEDING) AS level FROM weighed
), targets AS (
  SELECT source, source_size, i, least(most, w * max(level) OVER ()) AS target FROM levels
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS more FROM targets
), units AS (
  SELECT source, doc_id, h, sum(size)::BIGINT AS size FROM sized GROUP BY source, doc_id, h
), known AS (
  SELECT u.*, p.source_size, p.i, p.target, p.passes, p.more, CASE WHEN 8 * u.size > p.more THEN u.size ELSE 0 END AS big,
         sum(u.size) OVER (PARTITION BY u.source ORDER BY u.h, u.doc_id ROWS UNBOUNDED PRECEDING) - u.size AS before
  FROM units u JOIN parts p ON u.source IS NOT DISTINCT FROM p.source
), run AS (
  SELECT *, CASE WHEN big > 0 AND ahead + size <= more THEN ahead END AS place
  FROM (SELECT *, sum(big) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - big AS ahead FROM known)
), gaps AS (
  SELECT source, coalesce(sum(size) FILTER (WHERE place IS NOT NULL), 0) AS had, max(more) - had AS gap FROM run GROUP BY source
), run2 AS (
  SELECT * EXCLUDE (place), CASE WHEN small AND behind + size <= gap THEN had + behind ELSE place END AS place
  FROM (SELECT r.*, g.had, g.gap, 8 * r.size <= r.more AS small,
               sum(CASE WHEN 8 * r.size <= r.more THEN r.size ELSE 0 END) OVER (PARTITION BY r.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING)
               - CASE WHEN 8 * r.size <= r.more THEN r.size ELSE 0 END AS behind
        FROM run r JOIN gaps g ON r.source IS NOT DISTINCT FROM g.source)
), gaps2 AS (
  SELECT source, coalesce(sum(size) FILTER (WHERE place IS NOT NULL), 0) AS had2, max(more) - had2 AS gap2 FROM run2 GROUP BY source
), fills AS (
  SELECT r.source, r.doc_id, row_number() OVER (PARTITION BY r.source ORDER BY abs(r.size - g.gap2), r.h, r.doc_id) AS k
  FROM run2 r JOIN gaps2 g ON r.source IS NOT DISTINCT FROM g.source
  WHERE r.place IS NULL AND r.size > 0 AND abs(r.size - g.gap2) < g.gap2
), times AS (
  SELECT r.*, f.k IS NOT NULL AS fill, greatest(r.passes * r.source_size + g.had2, 1) AS stream,
         r.passes + CASE WHEN r.place IS NOT NULL AND r.more > 0 OR f.k IS NOT NULL THEN 1 ELSE 0 END AS times,
         r.passes * r.source_size + CASE WHEN f.k IS NOT NULL THEN g.had2 ELSE coalesce(r.place, 0) END AS tail
  FROM run2 r JOIN gaps2 g ON r.source IS NOT DISTINCT FROM g.source
  LEFT JOIN fills f ON f.k = 1 AND r.source IS NOT DISTINCT FROM f.source AND r.doc_id IS NOT DISTINCT FROM f.doc_id AND r.place IS NULL
), shares AS (
  SELECT *, least((CASE WHEN passes > 0 THEN before ELSE tail END + size / 2::DOUBLE) / stream, 1.0::DOUBLE) AS s1,
         least((CASE WHEN times - 1 < passes THEN (times - 1) * source_size + before ELSE tail END + size / 2::DOUBLE) / stream, 1.0::DOUBLE) AS s2
  FROM times
)
SELECT s.doc_id, s.size, t.source_size, t.target, (s.size * t.times)::BIGINT AS taken,
  CASE WHEN t.times > 0 THEN CASE t.i % 3  -- the integral of the weight schedule solved for time
    WHEN 0 THEN (sqrt(greatest(2.25::DOUBLE - 2.0::DOUBLE * s1, 0)) - 1.5::DOUBLE) / -1.0::DOUBLE WHEN 1 THEN s1
    ELSE CASE WHEN s1 * 0.875::DOUBLE <= 0.25::DOUBLE THEN s1 * 0.875::DOUBLE / 0.5::DOUBLE
              ELSE 0.5::DOUBLE + (sqrt(0.25::DOUBLE + 6.0::DOUBLE * least(s1 * 0.875::DOUBLE - 0.25::DOUBLE, 0.625::DOUBLE)) - 0.5::DOUBLE) / 3.0::DOUBLE END END END AS first_position,
  CASE WHEN t.times > 0 THEN CASE t.i % 3
    WHEN 0 THEN (sqrt(greatest(2.25::DOUBLE - 2.0::DOUBLE * s2, 0)) - 1.5::DOUBLE) / -1.0::DOUBLE WHEN 1 THEN s2
    ELSE CASE WHEN s2 * 0.875::DOUBLE <= 0.25::DOUBLE THEN s2 * 0.875::DOUBLE / 0.5::DOUBLE
              ELSE 0.5::DOUBLE + (sqrt(0.25::DOUBLE + 6.0::DOUBLE * least(s2 * 0.875::DOUBLE - 0.25::DOUBLE, 0.625::DOUBLE)) - 0.5::DOUBLE) / 3.0::DOUBLE END END END AS last_position
FROM sized s JOIN shares t ON s.source IS NOT DISTINCT FROM t.source AND s.doc_id IS NOT DISTINCT FROM t.doc_id
"""
