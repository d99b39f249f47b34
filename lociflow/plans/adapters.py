"""Genomic views over the driver's tables, so that every operator can run on them: as DataFrames, and as DuckDB CTEs.

Chromosomes, intervals and tracks are derived from keys by fixed arithmetic; every row of a table becomes a row of its view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import MARKS

CHROMS, SPAN, SIZE, WIDTH = 150, 2_500_000, 2_590_000, 50_000
STATE_LABELS = (("view", "Browse"), ("click", "Browse"), ("signup", "Convert"), ("purchase", "Convert"), ("error", "Fault"))
ACTIVE = ("signup", "purchase")
TISSUES = {"AF": "neutrophil", "AO": "monocyte", "NF": "Bcell", "NO": "placenta", "RF": "Tcell", "RO": "NK"}
PANEL = {"signal": ("placenta",), "background": ("neutrophil", "Bcell"), "inflammation": ("monocyte",), "control": ("Tcell",)}
ATLAS_ASSAYS = ("DNase", "ATAC", "H3K4me3", "H3K4me1", "H3K27ac", "H3K36me3")
#: Chain blocks: a shift, a gap, an inversion and a jump to another chromosome.
BLOCKS = tuple(
    row
    for c in range(CHROMS)
    for row in (
        (f"chr{c}", 0, 600_000, f"chr{c}", 1_000, "+", 3_000_000, 1000.0, SIZE),
        (f"chr{c}", 650_000, 1_200_000, f"chr{c}", 655_000, "+", 3_000_000, 900.0, SIZE),
        (f"chr{c}", 1_200_000, 1_700_000, f"chr{c}", 1_300_000, "-", 3_000_000, 800.0, SIZE),
        (f"chr{c}", 1_700_000, 2_400_000, f"chr{(c + 1) % CHROMS}", 1_710_000, "+", 3_000_000, 700.0, SIZE),
    )
)
#: Biosample names, dealt over parts.
BIOSAMPLES = (
    "Placenta, male embryo", "CD34-positive progenitor", "adrenal gland", "left renal pelvis", "CD3 T-cell", "HepG2", "naive B cell", "CD8 alpha-beta T cell", "Islet of Langerhans",
    "unknown thing", "umbilical vein", "sigmoid colon",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, start, end, state): what each user did, until the next event."""
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)").alias("start")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("chr"), F.col("user_id").cast("string")).alias("chrom"), start, "ts", "event_id", F.col("event_type").alias("state"))
    end = F.lead("start").over(Window.partitionBy("chrom").orderBy("ts", "event_id"))
    return rows.select("chrom", "start", end.alias("end"), "state").where("end > start")


SEGMENTS_SQL = """segs AS (
  SELECT * FROM (
    SELECT chrom, start, lead(start) OVER (PARTITION BY chrom ORDER BY ts, event_id) AS stop, state
    FROM (SELECT 'chr' || user_id AS chrom, floor(epoch(ts))::BIGINT - 1704067200 AS start, ts, event_id, event_type AS state FROM events)
  ) WHERE stop > start
)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, chrom, start, end, priority, importance): a region for each order."""
    chrom = F.concat(F.lit("chr"), (F.col("o_custkey") % CHROMS).cast("string"))
    start = F.col("o_orderkey") * 7919 % SPAN
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("region_id"), chrom.alias("chrom"), start.alias("start"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("importance"))
    return rows.withColumn("end", F.col("start") + F.col("region_id") * 31 % 60_000 + 20_000)


REGIONS_SQL = f"""regs AS (
  SELECT o_orderkey AS region_id, 'chr' || (o_custkey % {CHROMS}) AS chrom, o_orderkey * 7919 % {SPAN} AS start,
         o_orderkey * 7919 % {SPAN} + o_orderkey * 31 % 60000 + 20000 AS stop, o_orderpriority AS priority, o_totalprice AS importance
  FROM orders
)"""


def peaks(spark: SparkSession, sf_dir: str, assays: tuple[str, ...] = MARKS) -> DataFrame:
    """(tissue, assay, replicate, chrom, start, end, signal): a peak for each line item."""
    rows = table(spark, sf_dir, "lineitem")
    flag = F.concat("l_returnflag", "l_linestatus")
    tissue = F.coalesce(*(F.when(flag == k, v) for k, v in TISSUES.items()))
    assay = F.element_at(F.array(*map(F.lit, assays)), F.col("l_linenumber") % len(assays) + 1)
    start = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber").cast("long") * 1299709) % SPAN
    rows = rows.select(
        tissue.alias("tissue"), assay.alias("assay"), (F.col("l_orderkey") % 3).cast("string").alias("replicate"), F.concat(F.lit("chr"), (F.col("l_suppkey") % CHROMS).cast("string")).alias("chrom"),
        start.alias("start"), F.col("l_extendedprice").alias("signal"), (F.col("l_quantity") * 20).cast("long").alias("width"),
    )
    return rows.withColumn("end", F.col("start") + F.col("width")).drop("width")


def peaks_sql(assays: tuple[str, ...] = MARKS) -> str:
    tissue = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TISSUES.items())
    return f"""pks AS (
  SELECT tissue, assay, replicate, chrom, start, start + width AS stop, signal FROM (
    SELECT CASE l_returnflag || l_linestatus {tissue} END AS tissue, {list(assays)}[l_linenumber % {len(assays)} + 1] AS assay,
           (l_orderkey % 3)::VARCHAR AS replicate, 'chr' || (l_suppkey % {CHROMS}) AS chrom,
           (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber::BIGINT * 1299709) % {SPAN} AS start, (l_quantity * 20)::BIGINT AS width, l_extendedprice AS signal
    FROM lineitem)
)"""


def tracks(spark: SparkSession, assays: tuple[str, ...] = MARKS) -> DataFrame:
    """(tissue, assay): every track of the peaks."""
    return spark.createDataFrame([(t, a) for t in TISSUES.values() for a in assays], "tissue string, assay string")


def tracks_sql(assays: tuple[str, ...] = MARKS) -> str:
    return f"trk AS (SELECT t.x AS tissue, a.x AS assay FROM (SELECT unnest({list(TISSUES.values())}) AS x) t, (SELECT unnest({list(assays)}) AS x) a)"


def sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"chr{i}", SIZE) for i in range(CHROMS)], "chrom string, size long")


GRID_SQL = f"""grid AS (
  SELECT 'chr' || c AS chrom, b * {WIDTH} AS start, least((b + 1) * {WIDTH}, {SIZE}) AS stop,
         'chr' || c || ':' || b * {WIDTH} || '-' || least((b + 1) * {WIDTH}, {SIZE}) AS bin_key
  FROM range({CHROMS}) x(c), range({-(-SIZE // WIDTH)}) y(b)
)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, bin_key, value): a sample for each vector, a bin for each component."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("pos", "value"))
    key = F.format_string("chr%d:%d-%d", 1 + F.col("pos") % 22, F.col("pos") * 50_000, (F.col("pos") + 1) * 50_000)
    return rows.select("sample_id", key.alias("bin_key"), F.col("value").cast("double").alias("value"))


def sample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.when(F.col("label") < 5, "A").otherwise("B").alias("label"))


MATRIX_SQL = """mat AS (
  SELECT vec_id AS sample_id, 'chr' || (1 + pos % 22) || ':' || pos * 50000 || '-' || (pos + 1) * 50000 AS bin_key, embedding[pos + 1]::DOUBLE AS value,
         CASE WHEN label < 5 THEN 'A' ELSE 'B' END AS label
  FROM embeddings, range(64) r(pos) WHERE pos < len(embedding)
)"""


def blocks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BLOCKS), "chrom string, start long, end long, to_chrom string, to_start long, to_strand string, to_size long, score double, size long")


BLOCKS_SQL = "blk(chrom, start, stop, to_chrom, to_start, to_strand, to_size, score, size) AS (VALUES " + ", ".join(
    f"('{c}', {s}, {e}, '{tc}', {ts}, '{st}', {tz}, {sc}, {z})" for c, s, e, tc, ts, st, tz, sc, z in BLOCKS
) + ")"


def sequences(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """(chrom, chunk, seq): the text of each document in chunks, as if it were a chromosome."""
    rows = table(spark, sf_dir, "documents").where("length(text) > 0").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chrom"), "text")
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))  # in one pass; a substring for each chunk reads the text from its start
    return rows.select("chrom", F.posexplode(cut).alias("chunk", "seq")).select("chrom", F.col("chunk").cast("long").alias("chunk"), "seq")


def text_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, chrom, start, end): a window in each document, which may reach beyond its ends."""
    rows = table(spark, sf_dir, "documents").where("length(text) > 0")
    start = F.col("doc_id") * 37 % 700 - 100
    return rows.select(F.col("doc_id").alias("region_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chrom"), start.alias("start"), (start + 150 + F.col("doc_id") * 53 % 3000).alias("end"))


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An experiment index: Accession, Files (one or two file names, one of them twice) and Genome assembly."""
    rows = table(spark, sf_dir, "orders")
    one, two = (F.format_string("/files/ENCFF%dABC/", F.col("o_custkey") + k) for k in (0, 1))
    build = F.when(F.col("o_orderstatus") == "F", "hg19").when(F.col("o_orderstatus") == "O", "GRCh38, HG19").otherwise("GRCh38")
    return rows.select(F.format_string("ENCSR%dXYZ", "o_orderkey").alias("Accession"), F.concat_ws(", ", one, two, one).alias("Files"), build.alias("Genome assembly"))


def present_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.format_string("ENCFF%dABC", "c_custkey").alias("file_accession"))


def biosamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_accession, name, assay, target): a file for each part."""
    names = F.array(*map(F.lit, BIOSAMPLES))
    assays = F.array(*map(F.lit, ("DNase-seq", "ATAC-seq", "TF ChIP-seq", "Histone ChIP-seq")))
    targets = F.array(*map(F.lit, ("H3K27ac", "H3K9me3", " H3K4me1 ")))
    key = F.col("p_partkey")
    pick = lambda xs, n, k=1: F.element_at(xs, (F.floor(key / k) % n + 1).cast("int"))
    return table(spark, sf_dir, "part").select(key.alias("p_partkey"), F.format_string("ENCFF%dPRT", "p_partkey").alias("file_accession"), pick(names, len(BIOSAMPLES)).alias("name"), pick(assays, 4).alias("assay_name"), pick(targets, 3, 4).alias("target"))


BIOSAMPLES_SQL = f"""bio AS (
  SELECT p_partkey, 'ENCFF' || p_partkey || 'PRT' AS file_accession, {list(BIOSAMPLES)}[p_partkey % {len(BIOSAMPLES)} + 1] AS name,
         ['DNase-seq', 'ATAC-seq', 'TF ChIP-seq', 'Histone ChIP-seq'][p_partkey % 4 + 1] AS assay_name, ['H3K27ac', 'H3K9me3', ' H3K4me1 '][p_partkey // 4 % 3 + 1] AS target
  FROM part
)"""
