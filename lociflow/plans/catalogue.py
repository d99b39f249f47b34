"""Queries by name over the driver's tables, each over its whole tables, and the equivalent DuckDB SQL.

Numbers are rounded alike in both. Random numbers are md5 hashes, so that SQL repeats the draws; tails of laws are series
and fractions in SQL. sampled_shap draws by numpy and has no SQL; queries of models that it explains exactly have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import TISSUE_PATTERNS, assay_key, feature_key, normal_key, tissue_group
from ..functions.ranking import with_global_rank
from ..operators import annotate, atlas, attribute, enrich, liftover, marks, nulls, selection, shap, tissue
from ..operators.intervals import bin_grid
from ..schema import ACTIVE_MARKS, MARKS, REPRESSIVE_MARKS, panel_roles
from ..sources.readers import build_catalog, catalog_files
from ..sources.scratch import written
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CUTS = (100, 500, 1000)


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def with_ctes(*parts: str) -> str:
    return "WITH " + ", ".join(parts[:-1]) + " " + parts[-1]


def r(value: str | Column, digits: int = 6) -> Column:
    return F.round(value, digits)


def unit_sql(*parts: str) -> str:
    """unit_hash in SQL."""
    return f"(('0x' || substr(md5({" || '/' || ".join(parts)}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def erfc_sql(x: str) -> str:
    """erfc for x >= 0: a series near 0, else Laplace's continued fraction."""
    fraction = x
    for k in range(80, 0, -1):
        fraction = f"({x} + {k / 2}::DOUBLE / {fraction})"
    series = f"list_sum([2.0::DOUBLE * exp(-{x} * {x} + n * ln(2.0) + (2 * n + 1) * ln({x} + 1e-300) - lgamma(n + 1.5) + lgamma(0.5) - (n + 1) * ln(2.0)) for n in range(80)]) / sqrt(pi())"
    return f"CASE WHEN {x} < 2 THEN 1 - {series} ELSE exp(-{x} * {x}) / sqrt(pi()) / {fraction} END"


# Chromatin states

OVERLAPS = """ov AS (
  SELECT r.region_id, s.state, sum(least(r.stop, s.stop) - greatest(r.start, s.start))::BIGINT AS bp, min(s.start) AS first
  FROM regs r JOIN segs s ON r.chrom = s.chrom AND s.stop > r.start AND s.start < r.stop GROUP BY r.region_id, s.state
)"""
ANNOTATED = f"""ann AS (
  SELECT r.region_id, r.priority, o.dominant_state, coalesce(o.covered_bp, 0) AS covered_bp, o.active_bp / o.covered_bp AS active_fraction
  FROM regs r LEFT JOIN (
    SELECT region_id, max(state) FILTER (WHERE k = 1) AS dominant_state, sum(bp)::BIGINT AS covered_bp, coalesce(sum(bp) FILTER (WHERE state IN {A.ACTIVE}), 0)::DOUBLE AS active_bp
    FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY bp DESC, first) AS k FROM ov) GROUP BY region_id
  ) o USING (region_id)
)"""
LABELS_CTE = "labs(state, label) AS (VALUES " + ", ".join(map(str, A.STATE_LABELS)) + ")"


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.annotate_regions(A.regions(spark, sf_dir), A.segments(spark, sf_dir), A.ACTIVE, ("priority",))


def state_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(A.STATE_LABELS), "state string, label string")


@query(with_ctes(A.SEGMENTS_SQL, A.REGIONS_SQL, OVERLAPS, ANNOTATED, "SELECT region_id, dominant_state, covered_bp, round(active_fraction, 6) AS active_fraction FROM ann"))
def annotate_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate.annotate_regions(A.regions(spark, sf_dir), A.segments(spark, sf_dir), A.ACTIVE)
    return found.select("region_id", "dominant_state", "covered_bp", r("active_fraction").alias("active_fraction"))


@query(with_ctes(A.SEGMENTS_SQL, A.REGIONS_SQL, OVERLAPS, "SELECT region_id, state, round(bp / sum(bp) OVER (PARTITION BY region_id), 6) AS fraction FROM ov"))
def region_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate.annotate_regions(A.regions(spark, sf_dir), A.segments(spark, sf_dir), A.ACTIVE)
    return found.select("region_id", F.explode("composition").alias("state", "fraction")).select("region_id", "state", r("fraction").alias("fraction"))


@query(
    with_ctes(
        A.SEGMENTS_SQL, A.REGIONS_SQL, OVERLAPS, ANNOTATED, LABELS_CTE,
        """SELECT label, count(dominant_state) AS n, (SELECT count(dominant_state) FROM ann) AS total,
                  round(count(dominant_state) / (SELECT count(dominant_state) FROM ann), 6) AS fraction
           FROM labs LEFT JOIN ann ON dominant_state = state GROUP BY label""",
    )
)
def dominant_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.dominant_counts(annotated(spark, sf_dir), state_labels(spark)).select("label", "n", "total", r("fraction").alias("fraction"))


@query(
    with_ctes(
        A.SEGMENTS_SQL, A.REGIONS_SQL, OVERLAPS, ANNOTATED, LABELS_CTE,
        """named AS (SELECT label, priority = '1-URGENT' AS q FROM ann JOIN labs ON dominant_state = state),
        totals AS (SELECT count(*) FILTER (WHERE q) AS nq, count(*) FILTER (WHERE NOT q) AS nb FROM named),
        sums AS (
          SELECT label, nq, nb, 0.5::DOUBLE / greatest(nq, 1) AS eps, count(*) FILTER (WHERE q) / nq AS qf, count(*) FILTER (WHERE NOT q) / nb AS nf
          FROM named, totals GROUP BY label, nq, nb
        ), obs AS (SELECT *, log2((qf + eps) / (nf + eps)) AS fold FROM sums),
        law AS (
          SELECT label, log2((k / nq + eps) / (nf + eps)) AS f, o.fold, k,
                 exp(lgamma(nq + 1) - lgamma(k + 1) - lgamma(nq - k + 1) + k * ln(nf) + (nq - k) * ln(1 - nf)) AS mass
          FROM obs o, range(0, (SELECT nq + 1 FROM totals)) x(k)
        ), below AS (SELECT *, sum(mass) OVER (PARTITION BY label ORDER BY k) AS c FROM law),
        tests AS (
          SELECT label, sum(CASE WHEN abs(f) >= abs(fold) - 1e-12 THEN mass ELSE 0 END) AS p, min(f) FILTER (WHERE c >= 0.025) AS null_lo, min(f) FILTER (WHERE c >= 0.975) AS null_hi
          FROM below GROUP BY label
        )""",
        """SELECT label, round(qf, 6) AS query_frac, round(nf, 6) AS null_frac, round(fold, 6) AS log2_fold, round(null_lo, 6) AS null_lo, round(null_hi, 6) AS null_hi,
                  round(p, 6) AS p, nq AS n_query, nb AS n_null FROM obs JOIN tests USING (label)""",
    )
)
def label_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent regions against all others."""
    found = annotated(spark, sf_dir).select("dominant_state", (F.col("priority") == "1-URGENT").alias("asked"))
    out = enrich.label_enrichment(enrich.marked_counts(found, state_labels(spark)))
    return out.select("label", *(r(c).alias(c) for c in ("query_frac", "null_frac", "log2_fold", "null_lo", "null_hi", "p")), "n_query", "n_null")


# Marks and accessibility

COVERAGE = """cut AS (
  SELECT r.region_id, p.tissue, p.assay, p.signal, greatest(r.start, p.start) AS a, least(r.stop, p.stop) AS b
  FROM regs r JOIN pks p ON r.chrom = p.chrom AND p.start < r.stop AND p.stop > r.start
), swept AS (
  SELECT *, max(b) OVER (PARTITION BY region_id, tissue, assay ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM cut
), united AS (
  SELECT region_id, tissue, assay, sum(greatest(0, b - greatest(a, coalesce(seen, a)))) AS bp, sum(signal * (b - a)) AS weight FROM swept GROUP BY region_id, tissue, assay
), cov AS (
  SELECT r.region_id, t.tissue, t.assay, coalesce(u.bp, 0) / (r.stop - r.start) AS coverage, coalesce(u.weight / u.bp, 0) AS mean_signal
  FROM regs r CROSS JOIN trk t LEFT JOIN united u ON u.region_id = r.region_id AND u.tissue = t.tissue AND u.assay = t.assay
)"""
COVERAGE_PARTS = (A.REGIONS_SQL, A.peaks_sql(), A.tracks_sql(), COVERAGE)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.track_coverage(A.regions(spark, sf_dir), A.peaks(spark, sf_dir), A.tracks(spark))


@query(with_ctes(*COVERAGE_PARTS, "SELECT region_id, tissue, assay, round(coverage, 6) AS coverage, round(mean_signal, 3) AS mean_signal FROM cov"))
def mark_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(spark, sf_dir).select("region_id", "tissue", "assay", r("coverage").alias("coverage"), r("mean_signal", 3).alias("mean_signal"))


@query(with_ctes(*COVERAGE_PARTS, "SELECT tissue, assay, round(avg(coverage), 6) AS coverage FROM cov GROUP BY tissue, assay"))
def mean_track_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = marks.track_means(A.regions(spark, sf_dir), A.peaks(spark, sf_dir), A.tracks(spark))
    return found.select("tissue", "assay", r("coverage").alias("coverage"))


FINGERPRINT_SQL = f"""SELECT region_id, tissue, round(avg(coverage) FILTER (WHERE assay IN {ACTIVE_MARKS}) - avg(coverage) FILTER (WHERE assay IN {REPRESSIVE_MARKS}), 6) AS active_minus_repressive,
  round(max(coverage) FILTER (WHERE assay = 'H3K27ac'), 6) AS h3k27ac FROM cov GROUP BY region_id, tissue"""


@query(with_ctes(*COVERAGE_PARTS, FINGERPRINT_SQL))
def mark_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = marks.fingerprints(coverage(spark, sf_dir))
    return found.select("region_id", "tissue", r("active_minus_repressive").alias("active_minus_repressive"), r(F.col("coverage")["H3K27ac"]).alias("h3k27ac"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.track_activity(A.regions(spark, sf_dir), A.peaks(spark, sf_dir), A.tracks(spark))


ROLES_CTE = "rol(tissue, role, k) AS (VALUES " + ", ".join(f"('{t}', '{role}', {k})" for role, k in (("signal", 0), ("inflammation", 1), ("background", 2), ("control", 3)) for t in A.PANEL[role]) + ")"
ACTIVITY = f"act AS (SELECT region_id, tissue, sum(coverage) FILTER (WHERE assay IN {ACTIVE_MARKS}) / {len(ACTIVE_MARKS)} AS activity FROM cov GROUP BY region_id, tissue)"
CALLED = """scored AS (SELECT region_id, role, k, max(activity) AS s FROM act JOIN rol USING (tissue) WHERE role <> 'control' GROUP BY region_id, role, k),
placed AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY s DESC, k) AS n FROM scored),
lead AS (
  SELECT region_id, max(role) FILTER (WHERE n = 1) AS a, max(role) FILTER (WHERE n = 2) AS b, max(s) FILTER (WHERE n = 1) AS sa, max(s) FILTER (WHERE n = 2) AS sb FROM placed GROUP BY region_id
), called AS (
  SELECT region_id, a, b, sa >= 0.05 AS called_open, log2((sa + 1e-3::DOUBLE) / (sb + 1e-3::DOUBLE)) AS gain FROM lead
), att AS (
  SELECT region_id, CASE WHEN NOT called_open THEN 'unexplained' WHEN gain >= 0.5 THEN a ELSE 'ambiguous' END AS compartment, CASE WHEN called_open THEN a END AS top,
         CASE WHEN called_open THEN b END AS runner_up, CASE WHEN called_open THEN gain ELSE 0 END AS log2_margin, called_open FROM called
)"""
CALL_PARTS = (*COVERAGE_PARTS, ROLES_CTE, ACTIVITY, CALLED)


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute.attribute_regions(activities(spark, sf_dir), A.regions(spark, sf_dir), panel_roles(spark, A.PANEL))


@query(with_ctes(*CALL_PARTS, "SELECT region_id, compartment, top, runner_up, round(log2_margin, 6) AS log2_margin, called_open FROM att"))
def attribute_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(spark, sf_dir).select("region_id", "compartment", "top", "runner_up", r("log2_margin").alias("log2_margin"), "called_open")


@query(
    with_ctes(
        *CALL_PARTS,
        """SELECT count(*) AS n, round(count(*) FILTER (WHERE compartment = 'signal') / count(*), 6) AS signal_fraction,
                  round(count(*) FILTER (WHERE compartment IN ('inflammation', 'background')) / count(*), 6) AS background_fraction,
                  count(*) FILTER (WHERE compartment = 'unexplained') AS n_unexplained FROM att""",
    )
)
def attribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attribute.attribution_summary(attributed(spark, sf_dir))
    return found.select("n", r("signal_fraction").alias("signal_fraction"), r("background_fraction").alias("background_fraction"), F.coalesce(F.try_element_at("counts", F.lit("unexplained")), F.lit(0)).alias("n_unexplained"))


COMPARTMENT = """comp AS (
  SELECT region_id, avg(activity) FILTER (WHERE role = 'signal') AS signal_activity, avg(activity) FILTER (WHERE role IN ('background', 'inflammation')) AS background_activity
  FROM act JOIN rol USING (tissue) GROUP BY region_id
)"""


def compartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.compartment_activity(activities(spark, sf_dir), panel_roles(spark, A.PANEL))


@query(with_ctes(*COVERAGE_PARTS, ROLES_CTE, ACTIVITY, COMPARTMENT, "SELECT region_id, round(signal_activity, 6) AS signal_activity, round(background_activity, 6) AS background_activity, round(signal_activity - background_activity, 6) AS signal_specific FROM comp"))
def compartment_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compartments(spark, sf_dir).select("region_id", *(r(c).alias(c) for c in ("signal_activity", "background_activity", "signal_specific")))


@query(
    with_ctes(
        *COVERAGE_PARTS, ROLES_CTE, ACTIVITY, COMPARTMENT,
        """vals AS (
          SELECT importance AS x, unnest(['signal_specific', 'signal_activity', 'background_activity']) AS target,
                 unnest([round(signal_activity - background_activity, 6), round(signal_activity, 6), round(background_activity, 6)]) AS y FROM regs JOIN comp USING (region_id)
        ), ranks AS (
          SELECT target, rank() OVER (PARTITION BY target ORDER BY x) + (count(*) OVER (PARTITION BY target, x) - 1) / 2 AS rx,
                 rank() OVER (PARTITION BY target ORDER BY y) + (count(*) OVER (PARTITION BY target, y) - 1) / 2 AS ry FROM vals
        ), rho AS (SELECT target, count(*) AS n, corr(rx, ry) AS rho FROM ranks GROUP BY target)""",
        "SELECT target, n, round(rho, 6) AS rho FROM rho UNION ALL SELECT 'background_specific', n, round(-rho, 6) FROM rho WHERE target = 'signal_specific'",
    )
)
def compartment_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations alone; compartment_importance_test has p too."""
    return compartment_importance_test(spark, sf_dir).select("target", "n", r("rho").alias("rho"))


T_TAIL = """tt AS (SELECT target, n, n - 2 AS nu, rho, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t FROM rho),
th AS (SELECT *, atan(t / sqrt(nu)) AS theta FROM tt),
ser AS (
  SELECT target, n, rho, CASE WHEN nu % 2 = 0
    THEN sin(theta) * list_sum([exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1) + 2 * j * ln(cos(theta))) for j in range(nu // 2)])
    ELSE 2 / pi() * (theta + sin(theta) * coalesce(list_sum([exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5) + (2 * j + 1) * ln(cos(theta))) for j in range((nu - 1) // 2)]), 0)) END AS inner_
  FROM th
)"""


@query(
    with_ctes(
        *COVERAGE_PARTS, ROLES_CTE, ACTIVITY, COMPARTMENT,
        """vals AS (
          SELECT importance AS x, unnest(['signal_specific', 'signal_activity', 'background_activity']) AS target,
                 unnest([round(signal_activity - background_activity, 6), round(signal_activity, 6), round(background_activity, 6)]) AS y FROM regs JOIN comp USING (region_id)
        ), ranks AS (
          SELECT target, rank() OVER (PARTITION BY target ORDER BY x) + (count(*) OVER (PARTITION BY target, x) - 1) / 2 AS rx,
                 rank() OVER (PARTITION BY target ORDER BY y) + (count(*) OVER (PARTITION BY target, y) - 1) / 2 AS ry FROM vals
        ), rho AS (SELECT target, count(*) AS n, corr(rx, ry) AS rho FROM ranks GROUP BY target)""",
        T_TAIL,
        """SELECT target, n, round(rho, 6) AS rho, round(1 - inner_, 6) AS p FROM ser
           UNION ALL SELECT 'background_specific', n, round(-rho, 6), round(1 - inner_, 6) FROM ser WHERE target = 'signal_specific'""",
    )
)
def compartment_importance_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = A.regions(spark, sf_dir).select("region_id", "importance", (F.col("importance") - 100_000).alias("direction"))
    found = selection.compartment_importance(bins, compartment_activity(spark, sf_dir))
    return found.select("target", "n", r("rho").alias("rho"), r("p").alias("p"))


@query(
    with_ctes(
        *COVERAGE_PARTS,
        """own AS (SELECT c.assay, c.region_id, c.coverage, r.priority = '1-URGENT' AS urgent FROM cov c JOIN regs r USING (region_id) WHERE c.tissue = 'placenta'),
        sums AS (
          SELECT assay, avg(coverage) FILTER (WHERE urgent) AS query_mean, count(*) FILTER (WHERE urgent) AS n_query, avg(coverage) FILTER (WHERE NOT urgent) AS null_mean,
                 count(*) FILTER (WHERE NOT urgent) AS n_null FROM own GROUP BY assay
        ), numbered AS (
          SELECT assay, coverage, row_number() OVER (PARTITION BY assay ORDER BY region_id) - 1 AS spot FROM own WHERE NOT urgent
        )""",
        f"""draws AS (
          SELECT assay, b, floor({unit_sql("'0'", "assay", "b", "i")} * n_null)::BIGINT AS spot FROM sums, range(1000) x(b), range((SELECT max(n_query) FROM sums)) y(i) WHERE i < n_query
        ), means AS (SELECT assay, b, avg(coverage) AS m FROM draws JOIN numbered USING (assay, spot) GROUP BY assay, b),
        folds AS (
          SELECT s.*, log2((m + 1e-4::DOUBLE) / (null_mean + 1e-4::DOUBLE)) AS fold, log2((query_mean + 1e-4::DOUBLE) / (null_mean + 1e-4::DOUBLE)) AS obs FROM means JOIN sums s USING (assay)
        )""",
        """SELECT assay, round(any_value(query_mean), 6) AS query_mean, round(any_value(null_mean), 6) AS null_mean, round(any_value(obs), 6) AS log2_fold, round(quantile_cont(fold, 0.025), 6) AS null_lo,
                  round(quantile_cont(fold, 0.975), 6) AS null_hi, round((count(*) FILTER (WHERE abs(fold) >= abs(obs)) + 1) / 1001, 6) AS p, any_value(n_query) AS n_query, any_value(n_null) AS n_null
           FROM folds GROUP BY assay""",
    )
)
def coverage_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placenta's marks in urgent regions against all others, by resampling."""
    peaks, tracks = (df.where("tissue = 'placenta'") for df in (A.peaks(spark, sf_dir), A.tracks(spark)))
    found = written(marks.track_coverage(A.regions(spark, sf_dir), peaks, tracks).join(A.regions(spark, sf_dir).select("region_id", "priority"), "region_id"), "coverage")
    part = lambda cond: found.where(cond).select("assay", F.col("region_id").alias("item"), "coverage")
    out = enrich.coverage_enrichment(part("priority = '1-URGENT'"), part("priority <> '1-URGENT'"))
    return out.select("assay", *(r(c).alias(c) for c in ("query_mean", "null_mean", "log2_fold", "null_lo", "null_hi", "p")), "n_query", "n_null")


# Sequence content and matched background

#: Letters of a chunk; counting within one is what a lookup costs.
CHUNK = 64


@query(
    """WITH cut AS (
  SELECT doc_id AS region_id, substr(text, (greatest(doc_id * 37 % 700 - 100, 0) + 1)::BIGINT, greatest(0, least(length(text), doc_id * 37 % 700 + 50 + doc_id * 53 % 3000) - greatest(doc_id * 37 % 700 - 100, 0))::BIGINT) AS s
  FROM documents WHERE length(text) > 0
), n AS (
  SELECT region_id, length(s) AS len, length(s) - length(translate(s, 'GCgc', '')) AS gc, length(s) - length(translate(s, 'Nn', '')) AS nn FROM cut
) SELECT region_id, round(CASE WHEN len - nn > 0 THEN gc / (len - nn) END, 6) AS gc, round(CASE WHEN len > 0 THEN nn / len ELSE 1 END, 6) AS nfrac, len AS length FROM n"""
)
def region_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nulls.region_content(A.text_regions(spark, sf_dir), text_chunks(spark, sf_dir), CHUNK)
    return found.select("region_id", r("gc").alias("gc"), r("nfrac").alias("nfrac"), "length")


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(nulls.genome_chunks(A.sequences(spark, sf_dir, CHUNK), CHUNK), "chunks")


@query(
    """WITH t AS (SELECT l_returnflag AS label, (l_orderkey * 7919 + l_linenumber * 104729) % 100003 / 100003 AS p FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY p) AS i, count(*) OVER (PARTITION BY label) AS n FROM t),
s AS (SELECT label, count(*) AS n, avg((p < 0.05)::INT) AS fpr, avg(p) AS mean_p, max(greatest(i / n - p, p - (i - 1) / n)) AS d FROM k GROUP BY label),
x AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS x FROM s)
SELECT label, n, round(fpr, 6) AS fpr, round(mean_p, 6) AS mean_p, round(d, 6) AS ks_d,
       round(CASE WHEN x > 0.2 THEN least(1, greatest(0, 2 * list_sum([(CASE j % 2 WHEN 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * x * x) for j in range(1, 101)]))) ELSE 1 END, 6) AS ks_p FROM x"""
)
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("l_orderkey") * 7919 + F.col("l_linenumber").cast("long") * 104729) % 100_003 / 100_003
    tests = A.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), p.alias("p"))
    return enrich.calibration_summary(tests).select("label", "n", *(r(c).alias(c) for c in ("fpr", "mean_p", "ks_d", "ks_p")))


# Ranking and model attribution

SHAP_RANKED = "shp AS (SELECT bin_key, avg(abs(value)) AS importance, avg(value) AS direction FROM mat GROUP BY bin_key), rnk AS (SELECT *, (row_number() OVER (ORDER BY importance DESC, regexp_extract(bin_key, '^chr\\w+'), bin_key))::INTEGER AS rank FROM shp)"


@query(
    with_ctes(
        A.MATRIX_SQL, SHAP_RANKED,
        """SELECT bin_key, split_part(bin_key, ':', 1) AS chrom, split_part(split_part(bin_key, ':', 2), '-', 1)::BIGINT AS start, split_part(bin_key, '-', 2)::BIGINT AS "end",
                  round(importance, 6) AS importance, round(direction, 6) AS direction, rank FROM rnk""",
    )
)
def rank_by_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.rank_by_shap(A.matrix(spark, sf_dir)).select("bin_key", "chrom", "start", "end", r("importance").alias("importance"), r("direction").alias("direction"), "rank")


@query(with_ctes(A.MATRIX_SQL, SHAP_RANKED, "SELECT bin_key, rank FROM rnk WHERE rank <= ceil((SELECT count(*) FROM rnk) * 0.3)"))
def top_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top_regions(selection.rank_by_shap(A.matrix(spark, sf_dir)), top_frac=0.3).select("bin_key", "rank")


@query(
    with_ctes(
        A.MATRIX_SQL,
        """t AS (SELECT bin_key, value, label, rank() OVER w + (count(*) OVER (PARTITION BY bin_key, value) - 1) / 2 AS rk, count(*) OVER (PARTITION BY bin_key, value) AS c
          FROM mat WINDOW w AS (PARTITION BY bin_key ORDER BY value))""",
        """SELECT bin_key, count(*) FILTER (WHERE label = 'B') AS n1, count(*) FILTER (WHERE label = 'A') AS n2,
                  sum(rk) FILTER (WHERE label = 'B') - count(*) FILTER (WHERE label = 'B') * (count(*) FILTER (WHERE label = 'B') + 1) / 2 AS u,
                  round(sum(c * c - 1)::DOUBLE, 3) AS ties, round(avg(value) FILTER (WHERE label = 'B') - avg(value) FILTER (WHERE label = 'A'), 6) AS direction FROM t GROUP BY bin_key""",
    )
)
def differential_rank_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.rank_sums(A.matrix(spark, sf_dir), A.sample_labels(spark, sf_dir))
    return found.select("bin_key", "n1", "n2", "u", r("ties", 3).alias("ties"), r("direction").alias("direction"))


@query(
    with_ctes(
        A.MATRIX_SQL,
        """t AS (SELECT bin_key, value, label, rank() OVER w + (count(*) OVER (PARTITION BY bin_key, value) - 1) / 2 AS rk, count(*) OVER (PARTITION BY bin_key, value) AS c
          FROM mat WINDOW w AS (PARTITION BY bin_key ORDER BY value)),
        u AS (
          SELECT bin_key, count(*) FILTER (WHERE label = 'B')::DOUBLE AS m, count(*) FILTER (WHERE label = 'A')::DOUBLE AS n, sum(rk) FILTER (WHERE label = 'B') AS s, sum(c * c - 1)::DOUBLE AS ties,
                 avg(value) FILTER (WHERE label = 'B') - avg(value) FILTER (WHERE label = 'A') AS direction FROM t GROUP BY bin_key
        ), z AS (
          SELECT *, greatest(s - m * (m + 1) / 2, m * n - s + m * (m + 1) / 2) AS high, m * n / 12 * (m + n + 1 - ties / ((m + n) * (m + n - 1))) AS var FROM u
        ), y AS (SELECT *, (high - m * n / 2 - 0.5) / sqrt(var) / sqrt(2.0) AS x FROM z)""",
        f"p AS (SELECT *, least(1.0, {erfc_sql('greatest(x, 0)')}) AS p FROM y)",
        "SELECT bin_key, round(-log10(p), 5) AS importance, round(direction, 6) AS direction, round(p, 6) AS p, (row_number() OVER (ORDER BY p, regexp_extract(bin_key, '^chr\\w+'), bin_key))::INTEGER AS rank FROM p",
    )
)
def rank_by_differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.rank_by_differential(A.matrix(spark, sf_dir), A.sample_labels(spark, sf_dir))
    return found.select("bin_key", r("importance", 5).alias("importance"), r("direction").alias("direction"), r("p").alias("p"), "rank")


def _weights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Loadings of bins on four components, and the components' coefficients."""
    bins = A.matrix(spark, sf_dir).groupBy("bin_key").agg(F.avg("value").alias("m"))
    loadings = bins.withColumn("k", F.explode(F.array(*map(F.lit, range(1, 5))))).select("bin_key", F.format_string("PC%d", "k").alias("pc"), (F.col("m") * F.col("k")).alias("w"))
    return loadings, spark.createDataFrame([("PC1", 0.5), ("PC2", -1.25), ("PC3", 2.0), ("PC4", 0.1)], "pc string, b double")


WEIGHTS = "mns AS (SELECT bin_key, avg(value) AS m FROM mat GROUP BY bin_key), wts AS (SELECT bin_key, m * (1 * 0.5 - 2 * 1.25 + 3 * 2.0 + 4 * 0.1)::DOUBLE AS w FROM mns)"


@query(with_ctes(A.MATRIX_SQL, WEIGHTS, "SELECT bin_key, round(w, 6) AS weight FROM wts"))
def component_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shap.component_weights(*_weights(spark, sf_dir)).select("bin_key", r("weight").alias("weight"))


@query(with_ctes(A.MATRIX_SQL, WEIGHTS, "SELECT sample_id, bin_key, round(w * (value - m), 6) AS value FROM mat JOIN mns USING (bin_key) JOIN wts USING (bin_key)"))
def linear_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shap.linear_shap(A.matrix(spark, sf_dir), shap.component_weights(*_weights(spark, sf_dir)))
    return found.select("sample_id", "bin_key", r("value").alias("value"))


@query(with_ctes(A.MATRIX_SQL, WEIGHTS, "SELECT bin_key AS key, round(max(abs(w)) * avg(abs(value - m)), 6) AS mean_abs_shap FROM mat JOIN mns USING (bin_key) JOIN wts USING (bin_key) GROUP BY bin_key"))
def genomic_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shap.weight_importance(shap.component_weights(*_weights(spark, sf_dir)), A.matrix(spark, sf_dir))
    return shap.genomic_importance(found).select("key", r("mean_abs_shap").alias("mean_abs_shap"))


@query()
def sampled_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute sampled Shapley values of a product of two bins, by bin, against the ten samples of smallest id."""
    import numpy as np

    names = [row["bin_key"] for row in A.matrix(spark, sf_dir).select("bin_key").distinct().orderBy("bin_key").collect()]  # 64 names
    rows = shap.wide_rows(A.matrix(spark, sf_dir), names)
    background = np.array([row["x"] for row in rows.orderBy("sample_id").limit(10).collect()]).reshape(-1, len(names))
    found = shap.sampled_shap(rows, names, lambda x: x[:, 0] * x[:, 1], background)
    return selection.importance_by_shap(found)


class ForestOfStumps:
    """A stump for each of the first two bins, split at 0."""

    def __init__(self):
        self.trees = [shap.Tree([j, -1, -1], [0.0, 0, 0], [1, 0, 0], [2, 0, 0], [0, low, high], [4, 1, 3]) for j, low, high in ((0, -1.0, 2.0), (1, 0.5, 4.0))]


class TreeOfDepthThree:
    """A full tree over the first three bins: its value is a product-like mix of all three, so they interact; thresholds differ by branch."""

    #: Of each inner node: bin, threshold, share of the left branch. Children of node n are 2n + 1 and 2n + 2.
    SPLITS = ((0, 0.0, 0.25), (1, -0.02, 0.5), (1, 0.03, 0.75), (2, 0.0, 0.4), (2, 0.05, 0.5), (2, -0.05, 0.2), (0, 0.08, 0.6))
    VALUES = (1.0, -2.0, 3.5, 0.25, -1.5, 4.0, 2.0, -3.0)

    def __init__(self):
        weight = [1000.0]
        for n, (_, _, left) in enumerate(self.SPLITS):
            weight += [weight[n] * left, weight[n] * (1 - left)]
        inner = range(7)
        feature, threshold = [f for f, _, _ in self.SPLITS] + [-1] * 8, [t for _, t, _ in self.SPLITS] + [0] * 8
        left, right = [2 * n + 1 for n in inner] + [0] * 8, [2 * n + 2 for n in inner] + [0] * 8
        self.trees = [shap.Tree(feature, threshold, left, right, [0] * 7 + list(self.VALUES), weight)] * 2

    @classmethod
    def sql(cls) -> str:
        """The Shapley value of bin j of x1, x2, x3 by its definition: a sum over all coalitions of the others."""
        def mean(known: frozenset[int], n: int = 0) -> str:
            if n >= 7:
                return f"{cls.VALUES[n - 7]}::DOUBLE"
            f, t, left = cls.SPLITS[n]
            a, b = mean(known, 2 * n + 1), mean(known, 2 * n + 2)
            return f"(CASE WHEN x{f + 1} <= {t}::DOUBLE THEN {a} ELSE {b} END)" if f in known else f"({left}::DOUBLE * {a} + {1 - left}::DOUBLE * {b})"

        def value(j: int) -> str:
            others = [f for f in range(3) if f != j]
            terms = ((frozenset(f for k, f in enumerate(others) if bits >> k & 1), (2, 1, 1, 2)[bits]) for bits in range(4))
            return " + ".join(f"{w}::DOUBLE / 6 * ({mean(s | {j})} - {mean(s)})" for s, w in terms)

        return "CASE j " + " ".join(f"WHEN {j + 1} THEN 2 * ({value(j)})" for j in range(3)) + " ELSE 0 END"


class LinearRegression:
    """Weights 1, 2, ... of the bins in order."""

    def __init__(self, n: int):
        import numpy as np

        self.coef_ = np.arange(1.0, n + 1)


class Odds:
    """An additive model that tells two probabilities, the second of which is explained."""

    def predict_proba(self, x):
        import numpy as np

        p = x @ np.arange(1.0, x.shape[1] + 1) / 1000
        return np.stack([1 - p, p], 1)


def _modelled(spark: SparkSession, sf_dir: str, model, **options) -> DataFrame:
    names = [row["bin_key"] for row in A.matrix(spark, sf_dir).select("bin_key").distinct().orderBy("bin_key").collect()]  # 64 names
    found = shap.shap_of_model(A.matrix(spark, sf_dir), model(len(names)), names, **options)
    return found.select("sample_id", "bin_key", r("value").alias("value"))


ORDERED = "ord AS (SELECT bin_key, row_number() OVER (ORDER BY bin_key) AS j, avg(value) AS m FROM mat GROUP BY bin_key)"


@query(with_ctes(A.MATRIX_SQL, ORDERED, """SELECT sample_id, bin_key, round(CASE j WHEN 1 THEN CASE WHEN value <= 0 THEN -1 ELSE 2 END - (0.25 * -1 + 0.75 * 2)
  WHEN 2 THEN CASE WHEN value <= 0 THEN 0.5 ELSE 4 END - (0.25 * 0.5 + 0.75 * 4) ELSE 0 END::DOUBLE, 6) AS value FROM mat JOIN ord USING (bin_key)"""))
def shap_of_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modelled(spark, sf_dir, lambda n: ForestOfStumps())


@query(with_ctes(A.MATRIX_SQL, ORDERED, """firsts AS (
  SELECT sample_id, max(value) FILTER (WHERE j = 1) AS x1, max(value) FILTER (WHERE j = 2) AS x2, max(value) FILTER (WHERE j = 3) AS x3 FROM mat JOIN ord USING (bin_key) GROUP BY sample_id
)""", f"SELECT sample_id, bin_key, round({TreeOfDepthThree.sql()}, 6) AS value FROM mat JOIN ord USING (bin_key) JOIN firsts USING (sample_id)"))
def shap_of_deep_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modelled(spark, sf_dir, lambda n: TreeOfDepthThree())


@query(with_ctes(A.MATRIX_SQL, ORDERED, "SELECT sample_id, bin_key, round(j * (value - m), 6) AS value FROM mat JOIN ord USING (bin_key)"))
def shap_of_linear_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modelled(spark, sf_dir, LinearRegression)


@query(with_ctes(A.MATRIX_SQL, ORDERED, "SELECT sample_id, bin_key, round(j * (value - m) / 1000, 6) AS value FROM mat JOIN ord USING (bin_key)"))
def shap_of_other_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled values of an additive model are exact; the background is the mean of each bin."""
    import numpy as np

    means = [row["m"] for row in A.matrix(spark, sf_dir).groupBy("bin_key").agg(F.avg("value").alias("m")).orderBy("bin_key").collect()]  # 64 rows
    return _modelled(spark, sf_dir, lambda n: Odds(), background=np.array([means]))


@query(with_ctes(A.MATRIX_SQL, "SELECT sample_id, bin_key, round(value * 2, 6) AS value FROM mat"))
def shap_of_last_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = A.matrix(spark, sf_dir).withColumn("class", F.explode(F.array(*map(F.lit, range(3)))))
    return shap.last_class(each.withColumn("value", r(F.col("value") * F.col("class"))))


KEYS_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN '-' WHEN 1 THEN ':' ELSE '_' END AS sep, 'chr' || (1 + l_suppkey % 22) AS chrom, l_orderkey AS s, l_orderkey + 500 AS e FROM lineitem"""


@query(
    f"""WITH k AS (SELECT *, chrom || CASE WHEN sep = '-' THEN '_' ELSE ':' END || s || sep || e AS name FROM ({KEYS_SQL}))
SELECT name, count(*) AS n, max(CASE WHEN sep = ':' THEN chrom || ':' || s || '-' || e ELSE name END) AS normal, max(chrom || ':' || s || '-' || e) AS feature FROM k GROUP BY name"""
)
def bin_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    sep = F.expr("case l_linenumber % 4 when 0 then '-' when 1 then ':' else '_' end")
    chrom = F.format_string("chr%d", 1 + F.col("l_suppkey") % 22)
    name = F.concat(chrom, F.when(sep == "-", "_").otherwise(":"), F.col("l_orderkey").cast("string"), sep, (F.col("l_orderkey") + 500).cast("string"))
    rows = A.table(spark, sf_dir, "lineitem").select(name.alias("name"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", "n", normal_key(F.col("name")).alias("normal"), feature_key(F.col("name")).alias("feature"))


@query("SELECT o_totalprice, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS rank, o_orderkey FROM orders")
def global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_global_rank(A.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "rank")


# Openness atlas

BIN_COVERAGE = f"""spread AS (
  SELECT tissue, assay, replicate, chrom, b * {A.WIDTH} AS start, least(stop, (b + 1) * {A.WIDTH}) - greatest(p.start, b * {A.WIDTH}) AS bp, signal
  FROM pks p, range({-(-A.SIZE // A.WIDTH)}) x(b) WHERE b BETWEEN p.start // {A.WIDTH} AND (p.stop - 1) // {A.WIDTH}
), sums AS (SELECT tissue, assay, replicate, chrom, start, sum(bp) AS bp, sum(signal * bp) AS weight FROM spread GROUP BY ALL),
reps AS (SELECT DISTINCT tissue, assay, replicate FROM pks),
cov AS (
  SELECT r.tissue, r.assay, r.replicate, g.bin_key, least(1.0::DOUBLE, coalesce(s.bp, 0) / {A.WIDTH}) AS share, coalesce(s.weight / s.bp, 0) AS mean_signal
  FROM grid g CROSS JOIN reps r LEFT JOIN sums s ON s.chrom = g.chrom AND s.start = g.start AND s.tissue = r.tissue AND s.assay = r.assay AND s.replicate = r.replicate
)"""
ATLAS_PARTS = (A.GRID_SQL, A.peaks_sql(A.ATLAS_ASSAYS), BIN_COVERAGE)


def z_sql(value: str, keys: str) -> str:
    w = f"OVER (PARTITION BY {keys})"
    return f"({value} - avg({value}) {w}) / CASE WHEN stddev_pop({value}) {w} > 0 THEN stddev_pop({value}) {w} ELSE 1 END"


TRACKS = f"""zs AS (SELECT tissue, assay, bin_key, {z_sql('share', 'tissue, assay, replicate')} AS z FROM cov),
agg AS (SELECT tissue, assay, bin_key, avg(z) AS value, count(*) AS n FROM zs GROUP BY tissue, assay, bin_key),
opn AS (SELECT tissue, CASE assay WHEN 'DNase' THEN 'D' ELSE 'A' END AS track, bin_key, value, n FROM agg WHERE assay IN ('DNase', 'ATAC')),
oz AS (SELECT tissue, bin_key, n, {z_sql('value', 'tissue, track')} AS z FROM opn),
tracks AS (
  SELECT * FROM opn UNION ALL SELECT tissue, 'ACC', bin_key, avg(z), sum(n)::BIGINT FROM oz GROUP BY tissue, bin_key
  UNION ALL SELECT tissue, 'H', bin_key, avg(value), sum(n)::BIGINT FROM agg WHERE assay IN {ACTIVE_MARKS} GROUP BY tissue, bin_key
)"""
CONTRASTS = f"""known AS (
  SELECT tissue, track, bin_key, value FROM tracks
  UNION ALL SELECT 'background', track, bin_key, avg(value) FROM tracks WHERE tissue IN ('neutrophil', 'Bcell') GROUP BY track, bin_key HAVING count(*) = 2
), scaled AS (SELECT *, {z_sql('value', 'tissue, track')} AS z FROM known),
special AS (
  SELECT CASE a.tissue WHEN 'monocyte' THEN 'infl_specific' ELSE a.tissue || '_specific' END AS tissue, a.track, a.bin_key, a.z - b.z AS value
  FROM scaled a JOIN scaled b ON b.tissue = 'background' AND a.track = b.track AND a.bin_key = b.bin_key WHERE a.tissue IN ('monocyte', 'Tcell', 'CD8', 'NK')
), parts AS (
  SELECT tissue, bin_key, max(z) FILTER (WHERE track = 'H') AS h, max(z) FILTER (WHERE track = 'ACC') AS acc, max(z) FILTER (WHERE track = 'D') AS d
  FROM scaled WHERE tissue <> 'background' GROUP BY tissue, bin_key
), composite AS (
  SELECT tissue, bin_key, CASE WHEN h IS NULL THEN coalesce(acc, d) WHEN coalesce(acc, d) IS NULL THEN h ELSE (h + coalesce(acc, d)) / 2 END AS value FROM parts
), contr AS (
  SELECT tissue, track, bin_key, value FROM known WHERE tissue = 'background' UNION ALL SELECT * FROM special
  UNION ALL SELECT 'infl_specific', 'C', bin_key, avg(value) FROM special WHERE tissue = 'infl_specific' AND track IN ('H', 'D') GROUP BY bin_key HAVING count(*) = 2
  UNION ALL SELECT tissue, 'C', bin_key, value FROM composite
)"""


def atlas_coverage(spark: SparkSession, sf_dir: str, weighted: bool = False) -> DataFrame:
    return atlas.peaks_to_coverage(A.peaks(spark, sf_dir, A.ATLAS_ASSAYS), bin_grid(A.sizes(spark), A.WIDTH), A.WIDTH, weighted)


@query(with_ctes(A.GRID_SQL, 'SELECT bin_key, chrom, start, stop AS "end" FROM grid'))
def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_grid(A.sizes(spark), A.WIDTH)


@query(with_ctes(*ATLAS_PARTS, "SELECT tissue, assay, replicate, bin_key, round(share, 6) AS coverage FROM cov"))
def bin_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas_coverage(spark, sf_dir).withColumn("coverage", r("coverage"))


@query(with_ctes(*ATLAS_PARTS, "SELECT tissue, assay, replicate, bin_key, round(share * mean_signal, 6) AS coverage FROM cov"))
def weighted_bin_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas_coverage(spark, sf_dir, weighted=True).withColumn("coverage", r("coverage"))


@query(with_ctes(*ATLAS_PARTS, "SELECT tissue, assay, bin_key, round(quantile_cont(share, 0.5), 6) AS value, count(*) AS n_replicates FROM cov GROUP BY tissue, assay, bin_key"))
def median_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas.aggregate_replicates(atlas_coverage(spark, sf_dir), "median").withColumn("value", r("value"))


@query(with_ctes(*ATLAS_PARTS, TRACKS, CONTRASTS, "SELECT tissue, track, bin_key, round(value, 5) AS value FROM (SELECT tissue, track, bin_key, value FROM tracks UNION ALL SELECT * FROM contr)"))
def openness_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = atlas.build_atlas(A.peaks(spark, sf_dir, A.ATLAS_ASSAYS), bin_grid(A.sizes(spark), A.WIDTH), A.WIDTH)
    return found.withColumn("value", r("value", 5))


SCORED = f"""spec AS (SELECT bin_key, tissue, value, value - avg(value) OVER (PARTITION BY bin_key) AS spec FROM composite),
imp AS (SELECT chrom || ':' || start // {A.WIDTH} * {A.WIDTH} || '-' || least({A.SIZE}, (start // {A.WIDTH} + 1) * {A.WIDTH}) AS key, sum((l_price * 100)::BIGINT) AS importance FROM (SELECT *, signal AS l_price FROM pks) GROUP BY key),
ordered AS (SELECT key AS bin_key, row_number() OVER (ORDER BY importance DESC, key) AS k FROM imp WHERE key IN (SELECT bin_key FROM grid)),
tops AS (SELECT topn, bin_key, count(*) OVER (PARTITION BY topn) AS k FROM (SELECT unnest({list(CUTS)}) AS topn), ordered o WHERE o.k <= topn),
whole AS (SELECT tissue, count(value) AS n, avg(value) AS vm, stddev_pop(value) AS vs, avg(spec) AS sm, stddev_pop(spec) AS ss FROM spec GROUP BY tissue),
seen AS (SELECT topn, tissue, avg(value) AS abs_obs, avg(spec) AS spec_obs, max(k) AS k FROM tops JOIN spec USING (bin_key) GROUP BY topn, tissue),
enr AS (
  SELECT topn, tissue, abs_obs, (abs_obs - vm) / (vs * sqrt((n - k) / (k * greatest(n - 1, 1))) + 1e-12) AS abs_z, spec_obs, (spec_obs - sm) / (ss * sqrt((n - k) / (k * greatest(n - 1, 1))) + 1e-12) AS spec_z,
         greatest(spec_obs, 0) / coalesce(nullif(sum(greatest(spec_obs, 0)) OVER (PARTITION BY topn), 0), 1) AS proportion, k AS n_bins_used FROM seen JOIN whole USING (tissue)
)"""
SCORE_PARTS = (*ATLAS_PARTS, TRACKS, CONTRASTS, SCORED)


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Specificities of the composite track, and the bins with the largest sum of signal."""
    track = atlas.build_atlas(A.peaks(spark, sf_dir, A.ATLAS_ASSAYS), bin_grid(A.sizes(spark), A.WIDTH), A.WIDTH)
    composite = track.where((F.col("track") == "C") & ~atlas.is_contrast("tissue")).select("bin_key", "tissue", "value")
    at = F.expr(f"start div {A.WIDTH} * {A.WIDTH}")
    name = F.concat_ws(":", "chrom", at.cast("string"), F.least(F.lit(A.SIZE), at + A.WIDTH).cast("string"))
    rows = A.peaks(spark, sf_dir, A.ATLAS_ASSAYS).groupBy(name.alias("bin")).agg(F.sum(F.round(F.col("signal") * 100).cast("long")).alias("importance"))
    return written(tissue.specificity(composite), "specificity"), tissue.top_bins(tissue.load_importance(rows), bin_grid(A.sizes(spark), A.WIDTH), CUTS)


@query(with_ctes(*SCORE_PARTS, "SELECT topn, tissue, round(abs_obs, 5) AS abs_obs, round(abs_z, 4) AS abs_z, round(spec_obs, 5) AS spec_obs, round(spec_z, 4) AS spec_z, round(proportion, 5) AS proportion, n_bins_used FROM enr"))
def tissue_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tissue.tissue_enrichment(*scored(spark, sf_dir))
    digits = {"abs_obs": 5, "abs_z": 4, "spec_obs": 5, "spec_z": 4, "proportion": 5}
    return found.select("topn", "tissue", *(r(c, n).alias(c) for c, n in digits.items()), "n_bins_used")


@query(with_ctes(*SCORE_PARTS, f"SELECT tissue, row_number() OVER (ORDER BY tissue <> 'placenta', spec_z DESC, tissue)::INTEGER AS position FROM enr WHERE topn = {min(CUTS)}"))
def tissue_plot_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tissue.plot_order(tissue.tissue_enrichment(*scored(spark, sf_dir)))


@query(
    with_ctes(
        *SCORE_PARTS,
        f"""drawn AS (
          SELECT perm, bin_key, row_number() OVER (PARTITION BY perm ORDER BY u, bin_key) AS i FROM (
            SELECT perm, bin_key, {unit_sql("'0'", "perm", "bin_key")} AS u FROM (SELECT DISTINCT bin_key FROM spec), range(2000) x(perm)
          ) QUALIFY i <= (SELECT max(k) FROM tops)
        ), cut AS (SELECT DISTINCT topn, k FROM tops),
        nul AS (SELECT topn, tissue, perm, avg(value) AS a, avg(spec) AS s FROM drawn JOIN cut ON i <= k JOIN spec USING (bin_key) GROUP BY topn, tissue, perm),
        mid AS (SELECT topn, tissue, avg(a) AS am, avg(s) AS sm FROM nul GROUP BY topn, tissue)""",
        """SELECT topn, tissue, round(avg((abs(a - am) >= abs(abs_obs - am))::INT), 6) AS abs_p, round(avg((abs(s - m.sm) >= abs(spec_obs - m.sm))::INT), 6) AS spec_p
           FROM nul JOIN mid m USING (topn, tissue) JOIN seen USING (topn, tissue) GROUP BY topn, tissue""",
    )
)
def tissue_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tissue.permutation_p(*scored(spark, sf_dir)).select("topn", "tissue", r("abs_p").alias("abs_p"), r("spec_p").alias("spec_p"))


# Crossing builds

LIFTED = """ends AS (SELECT region_id, chrom, start AS pos, 0 AS side FROM regs UNION ALL SELECT region_id, chrom, stop, 1 FROM regs),
hits AS (
  SELECT e.region_id, e.side, b.to_chrom, CASE b.to_strand WHEN '-' THEN b.to_size - 1 - (b.to_start + e.pos - b.start) ELSE b.to_start + e.pos - b.start END AS p
  FROM ends e JOIN blk b ON e.chrom = b.chrom AND b.start <= e.pos AND e.pos < b.stop
  QUALIFY row_number() OVER (PARTITION BY e.region_id, e.side ORDER BY b.score DESC, b.to_chrom, p) = 1
), fw AS (
  SELECT r.region_id, r.chrom, r.start, r.stop, a.to_chrom AS c0, z.to_chrom AS c1, a.p AS p0, z.p AS p1 FROM regs r
  LEFT JOIN hits a ON a.region_id = r.region_id AND a.side = 0 LEFT JOIN hits z ON z.region_id = r.region_id AND z.side = 1
), st AS (
  SELECT *, CASE WHEN p0 IS NULL OR p1 IS NULL THEN 'unmapped' WHEN c0 <> c1 THEN 'diff_chrom' WHEN p0 = p1 THEN 'degenerate' ELSE 'mapped' END AS s0 FROM fw
), rev AS (
  SELECT to_chrom AS chrom, CASE to_strand WHEN '-' THEN to_size - to_start - (stop - start) ELSE to_start END AS start, stop - start AS n, chrom AS to_chrom, to_strand, start AS o, stop AS oe, score FROM blk
), back AS (
  SELECT s.region_id, k, r.to_chrom AS c, CASE r.to_strand WHEN '-' THEN r.oe - 1 - (q - r.start) ELSE r.o + q - r.start END AS p
  FROM (SELECT region_id, c0, unnest([0, 1]) AS k, unnest([least(p0, p1), greatest(p0, p1)]) AS q FROM st WHERE s0 = 'mapped') s
  JOIN rev r ON r.chrom = s.c0 AND r.start <= q AND q < r.start + r.n
  QUALIFY row_number() OVER (PARTITION BY s.region_id, k ORDER BY r.score DESC, c, p) = 1
), lft AS (
  SELECT s.*, CASE WHEN s0 <> 'mapped' THEN s0 WHEN a.p IS NULL OR z.p IS NULL OR a.c <> s.chrom OR z.c <> s.chrom
    OR abs(a.p - s.start) > 2 * (s.stop - s.start + 1) AND abs(z.p - s.stop) > 2 * (s.stop - s.start + 1) THEN 'round_trip' ELSE 'mapped' END AS status
  FROM st s LEFT JOIN back a ON a.region_id = s.region_id AND a.k = 0 LEFT JOIN back z ON z.region_id = s.region_id AND z.k = 1
)"""
LIFT_PARTS = (A.REGIONS_SQL, A.BLOCKS_SQL, LIFTED)


@query(with_ctes(*LIFT_PARTS, "SELECT region_id, status, CASE WHEN status = 'mapped' THEN c0 END AS to_chrom, CASE WHEN status = 'mapped' THEN least(p0, p1) END AS to_start, CASE WHEN status = 'mapped' THEN greatest(p0, p1) END AS to_end FROM lft"))
def lift_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liftover.lift_status(A.regions(spark, sf_dir), A.blocks(spark)).select("region_id", "status", "to_chrom", "to_start", "to_end")


@query(with_ctes(*LIFT_PARTS, "SELECT count(*) AS n_in, count(*) FILTER (WHERE status = 'mapped') AS n_mapped, round(count(*) FILTER (WHERE status = 'mapped') / count(*), 6) AS mapping_rate, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS dropped_{s}" for s in liftover.STATUSES[1:]) + " FROM lft"))
def lift_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return liftover.lift_counts(liftover.lift_status(A.regions(spark, sf_dir), A.blocks(spark))).withColumn("mapping_rate", r("mapping_rate"))


# Catalogs and labels


@query(
    """WITH x AS (SELECT 'ENCSR' || o_orderkey || 'XYZ' AS experiment, o_orderstatus, unnest([o_custkey, o_custkey + 1]) AS k FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT experiment, 'ENCFF' || k || 'ABC' AS file_accession, 'chip' AS modality, 's3a://bucket/chip/ENCFF' || k || 'ABC.csv.gz' AS file_path,
       CASE o_orderstatus WHEN 'F' THEN 'hg19' ELSE 'GRCh38, HG19' END AS genome
FROM x JOIN customer ON c_custkey = k AND c_acctbal > 0"""
)
def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = catalog_files(A.experiments(spark, sf_dir), A.present_files(spark, sf_dir), "chip", "hg19", "s3a://bucket/chip/{accession}.csv.gz")
    return build_catalog([part]).select("experiment", "file_accession", "modality", "file_path", F.col("Genome assembly").alias("genome"))


GROUP_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(name), '{p}')" for p in some) + f" THEN '{g}'" for g, some in TISSUE_PATTERNS) + " END"
KEY_CASE = f"CASE WHEN contains(lower(assay_name), 'dnase') THEN 'DNase' WHEN contains(lower(assay_name), 'atac') THEN 'ATAC' WHEN trim(target) IN {ACTIVE_MARKS} THEN trim(target) END"


@query(with_ctes(A.BIOSAMPLES_SQL, f"SELECT file_accession, name, {GROUP_CASE} AS grp, {KEY_CASE} AS assay FROM bio"))
def tissue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.biosamples(spark, sf_dir).select("file_accession", "name", tissue_group(F.col("name")).alias("grp"), assay_key(F.col("assay_name"), F.col("target"), ACTIVE_MARKS).alias("assay"))


@query(with_ctes(A.BIOSAMPLES_SQL, f"""SELECT grp AS "group", assay, string_agg(file_accession, ',' ORDER BY file_accession) AS accessions FROM (SELECT file_accession, {GROUP_CASE} AS grp, {KEY_CASE} AS assay FROM bio) WHERE grp IS NOT NULL AND assay IS NOT NULL GROUP BY grp, assay"""))
def panel_from_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.biosamples(spark, sf_dir).withColumn("group", tissue_group(F.col("name")))
    found = atlas.panel_from_catalog(rows, assay_key(F.col("assay_name"), F.col("target"), ACTIVE_MARKS))
    return found.select("group", "assay", F.array_join("accessions", ",").alias("accessions"))


@query(with_ctes(A.BIOSAMPLES_SQL, f"SELECT name, count(*) AS n FROM bio WHERE {GROUP_CASE} IS NULL GROUP BY name"))
def unmatched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that no group fits, with their counts."""
    rows = A.biosamples(spark, sf_dir)
    return rows.where(tissue_group(F.col("name")).isNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
