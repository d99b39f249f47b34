"""Queries that chain matched background, annotation and test, over documents as chromosomes, and their SQL.

Importing this module registers them in the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, nulls
from ..schema import MARKS
from . import adapters as A
from .catalogue import CHUNK, LABELS_CTE, query, r, state_labels, text_chunks, unit_sql, with_ctes

TILE, PEAK_STEP = 200, 150
#: Where SQL's waves of tries end.
WAVES = (8, 40)
SETS = {"n_sets": 100, "set_size": 50, "region_length": 500, "n_per": 50}


def text_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, start, end, state): tiles of each document."""
    rows = A.table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.length("text").alias("n"))
    tiles = rows.withColumn("k", F.explode(F.expr(f"sequence(0L, (n - 1) div {TILE})")))
    state = F.element_at(F.array(*(F.lit(s) for s, _ in A.STATE_LABELS)), ((F.col("doc_id") + F.col("k")) % len(A.STATE_LABELS) + 1).cast("int"))
    return tiles.select(F.format_string("doc%d", "doc_id").alias("chrom"), (F.col("k") * TILE).alias("start"), F.least("n", (F.col("k") + 1) * TILE).alias("end"), state.alias("state"))


def text_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tissue, assay, chrom, start, end, signal): peaks of one tissue, in turn for each mark, along each document."""
    rows = A.table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.length("text").alias("n"))
    steps = rows.withColumn("k", F.explode(F.expr(f"sequence(0L, (n - 1) div {PEAK_STEP})"))).withColumn("start", F.col("k") * PEAK_STEP + F.col("doc_id") % 40)
    assay = F.element_at(F.array(*map(F.lit, MARKS)), ((F.col("doc_id") + F.col("k")) % len(MARKS) + 1).cast("int"))
    end = F.col("start") + 60 + F.col("k") % 7 * 20
    return steps.select(F.lit("placenta").alias("tissue"), assay.alias("assay"), F.format_string("doc%d", "doc_id").alias("chrom"), "start", end.alias("end"), F.lit(1.0).alias("signal"))


TEXTS = (
    "texts AS MATERIALIZED (SELECT doc_id, 'doc' || doc_id AS chrom, text, length(text) AS size FROM documents WHERE length(text) > 0)",
    "line AS MATERIALIZED (SELECT chrom, size, (sum(size) OVER (ORDER BY substr(md5(chrom), 1, 2), chrom ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS begin FROM texts)",
    "tot AS (SELECT sum(size)::BIGINT AS total FROM texts)",
)
QUERY_REGIONS = """asks AS (SELECT doc_id AS region_id, chrom, greatest(doc_id * 37 % 700 - 100, 0) AS start, least(size, doc_id * 37 % 700 + 50 + doc_id * 53 % 3000) AS stop FROM texts)"""
COUNTS = "length(s) AS len, length(s) - length(translate(s, 'GCgc', '')) AS gc, length(s) - length(translate(s, 'Nn', '')) AS nn"
GC, NFRAC = "CASE WHEN len - nn > 0 THEN gc::DOUBLE / (len - nn) END", "nn::DOUBLE / len"


def placed_sql(name: str, source: str, keys: tuple[str, ...], seed: str, first: int, last: int) -> tuple[str, ...]:
    """CTE name with chrom, start and counts of tries first..last of source(keys, len): a chromosome by length and a place in it."""
    parts = [f"{k}::VARCHAR" for k in (*keys, "try")]
    u = lambda what: unit_sql(f"'{seed}'", f"'{what}'", *parts)
    return (
        f"{name}_t AS (SELECT d.*, try, floor({u('chrom')} * total)::BIGINT AS spot, {u('start')} AS u2 FROM {source} d, range({first}, {last}) y(try), tot)",
        f"{name}_p AS (SELECT t.* EXCLUDE (spot, u2), l.chrom, floor(u2 * (l.size - q_len))::BIGINT AS start FROM {name}_t t ASOF JOIN line l ON t.spot >= l.begin WHERE l.size > q_len)",
        f"{name} AS (SELECT * EXCLUDE (s), {COUNTS} FROM (SELECT p.*, substr(x.text, start + 1, q_len) AS s FROM {name}_p p JOIN texts x USING (chrom)))",
    )


def matched_sql(keys: tuple[str, ...], n_per: int, seed: str, tries: int = 200) -> tuple[str, ...]:
    """CTEs asked and nul for asks(region_id, chrom, start, stop)."""
    out = [
        f"""asked AS MATERIALIZED (SELECT region_id, len, {GC} AS gc FROM (
          SELECT region_id, {COUNTS} FROM (SELECT a.region_id, substr(x.text, a.start + 1, greatest(0, a.stop - a.start)) AS s FROM asks a JOIN texts x USING (chrom))))""",
        f"open0 AS (SELECT region_id, gc AS q_gc, len AS q_len, draw FROM asked, range({n_per}) x(draw) WHERE gc IS NOT NULL AND len > 0)",
    ]
    ends = [e for e in (*WAVES, tries) if e <= tries]
    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        out += placed_sql(f"w{k}", f"open{k}", ("region_id", "draw"), seed, a, b)
        good = f"{GC} BETWEEN q_gc - 0.02::DOUBLE AND q_gc + 0.02::DOUBLE AND {NFRAC} <= 0.1::DOUBLE"
        out.append(f"got{k} AS MATERIALIZED (SELECT region_id, draw, any_value(q_len) AS q_len, min_by(chrom, try) AS chrom, min_by(start, try) AS start FROM w{k} WHERE {good} GROUP BY region_id, draw)")
        out.append(f"open{k + 1} AS MATERIALIZED (SELECT o.* FROM open{k} o ANTI JOIN got{k} USING (region_id, draw))")
    out.append("nul AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT region_id, draw, chrom, start, start + q_len AS stop FROM got{k}" for k in range(len(ends))) + ")")
    return tuple(out)


@query(with_ctes(*TEXTS, QUERY_REGIONS, *matched_sql((), 100, "0"), """SELECT a.region_id, round(a.gc, 6) AS gc, a.len AS length, coalesce(n.matched, 0) AS matched,
  CASE WHEN a.gc IS NULL OR a.len <= 0 THEN 'query undefined GC' END AS reason FROM asked a LEFT JOIN (SELECT region_id, count(*) AS matched FROM nul GROUP BY region_id) n USING (region_id)"""))
def matched_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many matched regions each query got."""
    found = nulls.sample_matched(A.text_regions(spark, sf_dir), text_chunks(spark, sf_dir), CHUNK)[1]
    return found.withColumn("gc", r("gc"))


@query(with_ctes(*TEXTS, QUERY_REGIONS, *matched_sql((), 100, "0"), 'SELECT region_id, draw, chrom, start, stop AS "end" FROM nul'))
def matched_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched regions themselves."""
    return nulls.sample_matched(A.text_regions(spark, sf_dir), text_chunks(spark, sf_dir), CHUNK)[0]


STATES_SQL = f"{[s for s, _ in A.STATE_LABELS]}"


def dominant_sql(name: str, source: str, keys: str) -> str:
    """CTE name(keys, state) for regions of source(keys, chrom, start, stop), from the tiles they touch."""
    return f"""{name} AS (
  SELECT {keys}, max_by(state, (bp, -first)) AS state FROM (
    SELECT {keys}, state, sum(bp) AS bp, min(first) AS first FROM (
      SELECT {keys}, {STATES_SQL}[(x.doc_id + t) % {len(A.STATE_LABELS)} + 1] AS state, least(s.stop, x.size, (t + 1) * {TILE}) - greatest(s.start, t * {TILE}) AS bp, t * {TILE} AS first
      FROM {source} s JOIN texts x USING (chrom), unnest(range(greatest(s.start, 0) // {TILE}, (least(s.stop, x.size) - 1) // {TILE} + 1)) u(t) WHERE s.stop > s.start
    ) WHERE bp > 0 GROUP BY {keys}, state
  ) GROUP BY {keys}
)"""


def law_sql(keys: tuple[str, ...]) -> tuple[str, ...]:
    """CTE res: label_enrichment of both(keys, label, q)."""
    by = "".join(f"{k}, " for k in keys)
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys) or "true"
    return (
        f"totals AS (SELECT {by}count(*) FILTER (WHERE q) AS nq, count(*) FILTER (WHERE NOT q) AS nb FROM both_ {'GROUP BY ' + by[:-2] if keys else ''})",
        f"hits AS (SELECT {by}label, count(*) FILTER (WHERE q) AS kq, count(*) FILTER (WHERE NOT q) AS kb FROM both_ GROUP BY {by}label)",
        f"""obs AS (SELECT *, log2((qf + eps) / (nf + eps)) AS fold FROM (
          SELECT {''.join(f'a.{k}, ' for k in keys)}l.label, nq, nb, 0.5::DOUBLE / greatest(nq, 1) AS eps, coalesce(b.kq, 0) / nq::DOUBLE AS qf, coalesce(b.kb, 0) / nb::DOUBLE AS nf
          FROM totals a CROSS JOIN (SELECT DISTINCT label FROM labs) l LEFT JOIN hits b ON b.label = l.label AND {on}))""",
        f"""law AS (SELECT {by}label, fold, k, log2((k / nq::DOUBLE + eps) / (nf + eps)) AS f,
          exp(lgamma(nq + 1) - lgamma(k + 1) - lgamma(nq - k + 1) + CASE WHEN k = 0 THEN 0 ELSE k * ln(greatest(nf, 1e-300)) END + CASE WHEN k = nq THEN 0 ELSE (nq - k) * ln(greatest(1 - nf, 1e-300)) END) AS mass
          FROM obs, range((SELECT max(nq) + 1 FROM totals)) x(k) WHERE k <= nq)""",
        f"below AS (SELECT *, sum(mass) OVER (PARTITION BY {by}label ORDER BY k) AS c FROM law)",
        f"""res AS (SELECT {by}label, least(1, sum(CASE WHEN abs(f) >= abs(fold) - 1e-12 THEN mass ELSE 0 END)) AS p, min(f) FILTER (WHERE c >= 0.025 - 1e-12) AS null_lo,
          min(f) FILTER (WHERE c >= 0.975 - 1e-12) AS null_hi FROM below GROUP BY {by}label)""",
    )


LABELLED = "both_ AS (SELECT label, true AS q FROM dq JOIN labs USING (state) UNION ALL SELECT label, false FROM dn JOIN labs USING (state))"


@query(
    with_ctes(
        *TEXTS, QUERY_REGIONS, *matched_sql((), 100, "0"), dominant_sql("dq", "asks", "region_id"), dominant_sql("dn", "nul", "region_id, draw"), LABELS_CTE, LABELLED, *law_sql(()),
        """SELECT label, round(qf, 6) AS query_frac, round(nf, 6) AS null_frac, round(o.fold, 6) AS log2_fold, round(null_lo, 6) AS null_lo, round(null_hi, 6) AS null_hi, round(p, 6) AS p,
                  nq AS n_query, nb AS n_null FROM obs o JOIN res USING (label)""",
    )
)
def state_enrichment_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a window of each document against matched windows of all documents."""
    out, _ = enrich.state_enrichment_test(A.text_regions(spark, sf_dir), text_states(spark, sf_dir), text_chunks(spark, sf_dir), CHUNK, state_labels(spark))
    return out.select("label", *(r(c).alias(c) for c in ("query_frac", "null_frac", "log2_fold", "null_lo", "null_hi", "p")), "n_query", "n_null")


def covered_sql(name: str, source: str, keys: str) -> str:
    """CTE name(keys, assay, coverage) for every region of source(keys, chrom, start, stop) and mark, 0 without a peak; peaks of one mark never overlap."""
    end = f"k * {PEAK_STEP} + x.doc_id % 40 + 60 + k % 7 * 20"
    return f"""{name} AS (
  SELECT {keys}, m.assay, coalesce(c.bp, 0) / (s.stop - s.start)::DOUBLE AS coverage FROM {source} s CROSS JOIN (SELECT unnest({list(MARKS)}) AS assay) m LEFT JOIN (
    SELECT {keys}, {list(MARKS)}[(x.doc_id + k) % {len(MARKS)} + 1] AS assay, sum(greatest(0, least(s.stop, {end}) - greatest(s.start, k * {PEAK_STEP} + x.doc_id % 40))) AS bp
    FROM {source} s JOIN texts x USING (chrom), unnest(range(0, (x.size - 1) // {PEAK_STEP} + 1)) u(k) WHERE k BETWEEN s.start // {PEAK_STEP} - 2 AND s.stop // {PEAK_STEP} + 1 GROUP BY ALL
  ) c USING ({keys}, assay)
)"""


@query(
    with_ctes(
        *TEXTS, QUERY_REGIONS, *matched_sql((), 100, "0"),
        "whole AS (SELECT doc_id AS region_id, chrom, doc_id * 37 % 700 - 100 AS start, doc_id * 37 % 700 + 50 + doc_id * 53 % 3000 AS stop FROM texts)",
        covered_sql("cq", "whole", "region_id"), covered_sql("cn", "nul", "region_id, draw"),
        "qs AS (SELECT assay, avg(coverage) AS query_mean, count(*) AS n_query FROM cq GROUP BY assay)",
        "ns AS (SELECT assay, avg(coverage) AS null_mean, count(*) AS n_null FROM cn GROUP BY assay)",
        "numbered AS (SELECT assay, coverage, row_number() OVER (PARTITION BY assay ORDER BY region_id, draw) - 1 AS spot FROM cn)",
        f"""draws AS (SELECT assay, b, floor({unit_sql("'0'", "assay", "b", "i")} * n_null)::BIGINT AS spot
          FROM qs JOIN ns USING (assay), range(1000) x(b), range((SELECT max(n_query) FROM qs)) y(i) WHERE i < n_query)""",
        "means AS (SELECT assay, b, avg(coverage) AS m FROM draws JOIN numbered USING (assay, spot) GROUP BY assay, b)",
        """folds AS (SELECT *, log2((m + 1e-4::DOUBLE) / (null_mean + 1e-4::DOUBLE)) AS fold, log2((query_mean + 1e-4::DOUBLE) / (null_mean + 1e-4::DOUBLE)) AS obs
          FROM means JOIN qs USING (assay) JOIN ns USING (assay))""",
        """SELECT assay, round(any_value(query_mean), 6) AS query_mean, round(any_value(null_mean), 6) AS null_mean, round(any_value(obs), 6) AS log2_fold, round(quantile_cont(fold, 0.025), 6) AS null_lo,
                  round(quantile_cont(fold, 0.975), 6) AS null_hi, round((count(*) FILTER (WHERE abs(fold) >= abs(obs)) + 1) / 1001, 6) AS p, any_value(n_query) AS n_query, any_value(n_null) AS n_null
           FROM folds GROUP BY assay""",
    )
)
def track_enrichment_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by one tissue's marks of a window of each document against matched windows."""
    tracks = spark.createDataFrame([("placenta", m) for m in MARKS], "tissue string, assay string")
    out, _ = enrich.track_enrichment_test(A.text_regions(spark, sf_dir), text_peaks(spark, sf_dir), tracks, text_chunks(spark, sf_dir), CHUNK)
    return out.select("assay", *(r(c).alias(c) for c in ("query_mean", "null_mean", "log2_fold", "null_lo", "null_hi", "p")), "n_query", "n_null")


SETS_SQL = (
    f"slots AS (SELECT set_id, slot, {SETS['region_length']}::BIGINT AS q_len FROM range({SETS['n_sets']}) a(set_id), range({SETS['set_size']}) b(slot))",
    *placed_sql("st", "slots", ("set_id", "slot"), "0", 0, 50),
    f"""asks AS MATERIALIZED (SELECT set_id, set_id * {SETS['set_size']} + slot AS region_id, min_by(chrom, try) AS chrom, min_by(start, try) AS start, min_by(start, try) + {SETS['region_length']} AS stop
      FROM st WHERE {NFRAC} <= 0.1::DOUBLE AND {GC} IS NOT NULL GROUP BY set_id, slot)""",
)


@query(
    with_ctes(
        *TEXTS, *SETS_SQL, *matched_sql((), SETS["n_per"], "1"), dominant_sql("dq", "asks", "set_id, region_id"), dominant_sql("dn", "nul", "region_id, draw"), LABELS_CTE,
        f"both_ AS (SELECT set_id, label, true AS q FROM dq JOIN labs USING (state) UNION ALL SELECT region_id // {SETS['set_size']}, label, false FROM dn JOIN labs USING (state))",
        *law_sql(("set_id",)),
        """ranks AS (SELECT label, p, row_number() OVER (PARTITION BY label ORDER BY p) AS i, count(*) OVER (PARTITION BY label) AS n FROM res)""",
        "SELECT label, count(*) AS n, round(avg((p < 0.05)::INT), 6) AS fpr, round(avg(p), 6) AS mean_p, round(max(greatest(i / n - p, p - (i - 1) / n)), 6) AS ks_d FROM ranks GROUP BY label",
    )
)
def calibration_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred sets of fifty random windows of 500 letters, each tested against its own matched background."""
    summary, _ = enrich.calibration_run(text_states(spark, sf_dir), text_chunks(spark, sf_dir), CHUNK, state_labels(spark), **SETS)
    return summary.select("label", "n", *(r(c).alias(c) for c in ("fpr", "mean_p", "ks_d")))

