"""Readers of interval files, sequences, matrices, models' coefficients and catalogs.

Paths may be anything Spark reads, with globs. Compressed text is one task a file, so large tracks are worth converting
to Parquet once.
"""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import tissue_group
from ..schema import AUTOSOMES, STATES

AUTOSOME_NAMES = tuple(f"chr{i}" for i in range(1, len(AUTOSOMES["hg38"]) + 1))
SKIPPED_LINES = "^(#|track|browser)|^\\s*$"
FILE_ACCESSION = "ENCFF[0-9A-Z]+"


def fields(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(f, file): tab-separated fields of every line that isn't blank, and the path of its file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.where(F.trim("value") != "").select(F.split("value", "\t").alias("f"), "file")


def place() -> Column:
    """Where a row of a text or CSV source stands: these sort by file name, then by place in the file, however Spark splits and orders files."""
    m = F.col("_metadata")
    return F.struct(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("i"))


def placed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, at): lines and their place."""
    return spark.read.text(path).select("value", place().alias("at"))


def first_lines(spark: SparkSession, path: str, n: int = 1) -> list[str]:
    """The first n lines of a file, or of a folder's files by name."""
    found: list[str] = []
    for file in sorted(map(unquote, spark.read.text(path).inputFiles())):
        found += [r["value"] for r in spark.read.text(file).limit(n - len(found)).collect()]
        if len(found) == n:
            break
    return found


def only_chroms(df: DataFrame, chroms: list[str] | tuple[str, ...] | None) -> DataFrame:
    return df if chroms is None else df.where(F.col("chrom").isin(*chroms))


def read_segmentation(spark: SparkSession, path: str, chroms: list[str] | None = None) -> DataFrame:
    """(chrom, start, end, state) of a BED file of chromatin states; an unknown state is an error."""
    f = F.col("f")
    state = F.when(f[3].isin(*STATES), f[3]).otherwise(F.raise_error(F.concat(F.lit("unknown state: "), F.coalesce(f[3], F.lit("null")))))
    rows = only_chroms(fields(spark, path).select(f[0].alias("chrom"), "f"), chroms)
    return rows.select("chrom", f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), state.alias("state"))


def signal_of(value: Column) -> Column:
    """The fourth field as a number: 1 where it is missing, empty or a dot; an error where it is something else."""
    blank = value.isNull() | (F.trim(value) == "") | (F.trim(value) == ".")
    return F.when(blank, 1.0).otherwise(value.cast("double"))


def read_peaks(spark: SparkSession, path: str | list[str], chroms: list[str] | None = None) -> DataFrame:
    """(chrom, start, end, signal, file) of BED files with three or four columns; shorter lines are skipped."""
    f = F.col("f")
    rows = fields(spark, path).where(F.size("f") >= 3).select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), signal_of(F.try_element_at("f", F.lit(4))).alias("signal"), "file")
    return only_chroms(rows, chroms)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, one row each."""
    return spark.read.option("multiLine", True).json(path)


def read_panel(spark: SparkSession, folder: str, manifest: str, assay_col: str, chroms: list[str] | None = None) -> DataFrame:
    """(tissue, assay, replicate, chrom, start, end, signal) of all files that a manifest names; of files for one track the last counts.

    assay_col is mark or assay. All files are one scan.
    """
    listed = read_manifest(spark, manifest).select("tissue", F.col(assay_col).alias("assay"), "file").withColumn("ord", F.monotonically_increasing_id())
    last = listed.groupBy("tissue", "assay").agg(F.max_by("file", "ord").alias("file"))
    paths = [f"{folder}/{r['file']}" for r in last.select("file").collect()]  # a row for each track
    if not paths:
        return spark.createDataFrame([], "tissue string, assay string, replicate string, chrom string, start long, end long, signal double")
    inside = F.substring_index("file", "/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)  # the path within the folder: names alone may repeat
    found = read_peaks(spark, paths, chroms).withColumn("file", F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B"))))
    return found.join(F.broadcast(last), "file").select("tissue", "assay", F.col("file").alias("replicate"), "chrom", "start", "end", "signal")


def narrow_to_four(lines: DataFrame) -> DataFrame:
    """(chrom, start, end, signal) as strings from lines(value) of narrowPeak: fields 1, 2, 3 and 7; shorter lines go."""
    f = F.split("value", "\t")
    return lines.select(f.alias("f")).where(F.size("f") >= 7).select(*(F.col("f")[i].alias(n) for i, n in ((0, "chrom"), (1, "start"), (2, "end"), (6, "signal"))))


def read_any_peaks(spark: SparkSession, path: str, autosomes_only: bool = True) -> DataFrame:
    """(chrom, start, end, signal): a CSV whose header has seqnames, or tab-separated columns without header, told by the first line."""
    head = first_lines(spark, path)
    if head and "," in head[0] and "seqnames" in head[0]:
        rows = spark.read.option("header", True).csv(path).select(F.col("seqnames").alias("chrom"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("signalValue").cast("double").alias("signal"))
    else:
        rows = read_peaks(spark, path).drop("file")
    return only_chroms(rows, AUTOSOME_NAMES if autosomes_only else None)


def read_atlas_peaks(spark: SparkSession, path: str, autosomes_only: bool = True) -> DataFrame:
    """(chrom, start, end, signalValue, assay, target, tissue) of a self-describing peak CSV."""
    names = {"seqnames": "chrom", "start": "start", "end": "end", "signalValue": "signalValue", "Assay title": "assay", "Target of assay": "target", "Biosample_name": "tissue"}
    rows = spark.read.option("header", True).csv(path).select(*(F.col(f"`{a}`").alias(b) for a, b in names.items()))
    rows = rows.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long"), "signalValue": F.col("signalValue").cast("double")})
    return only_chroms(rows, AUTOSOME_NAMES if autosomes_only else None)


def matched_files(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """(tissue, assay, replicate, file) of entries(tissue, assay, path), a small table of paths or globs: a row for each file that a path fits."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf, rows = spark.sparkContext._jsc.hadoopConfiguration(), []
    for r in entries.collect():
        pattern = hadoop.Path(r["path"])
        fs = pattern.getFileSystem(conf)
        for found in fs.globStatus(pattern) or ():
            files = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
            names = [f.getPath() for f in files if f.isFile() and f.getPath().getName()[0] not in "_."]
            rows += [(r["tissue"], r["assay"], r["path"], f.toString()) for f in names]
    return spark.createDataFrame(rows, "tissue string, assay string, replicate string, file string")


def _plain_path(path: Column) -> Column:
    """A file's path as Hadoop writes it, from the URI that Spark tells."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "file:/")


def scan_replicates(spark: SparkSession, entries: DataFrame, autosomes_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(peaks, left_out): peaks(tissue, assay, replicate, chrom, start, end, signal) of entries(tissue, assay, path), and what couldn't be read.

    All files are one scan: paths and globs become a table of files, and lines find their entry by the file they come
    from. A file is a CSV if its header names seqnames, else tab-separated columns as read_peaks takes them. left_out is
    (file, reason): a file with a line that doesn't parse goes as a whole, and so does one of which nothing could be
    read; a path that matches nothing has no file. Spark skips the rest of a file whose compression is damaged.
    """
    files = matched_files(spark, entries)
    paths = [r["file"] for r in files.select("file").distinct().collect()]  # a row for each file of a small table
    schema = "tissue string, assay string, replicate string, chrom string, start long, end long, signal double"
    if not paths:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "file string, reason string")
    lines = spark.read.option("ignoreCorruptFiles", True).text(paths).where("trim(value) <> ''")
    lines = lines.select("value", _plain_path(F.col("_metadata.file_path")).alias("file"))
    is_head = F.col("value").contains("seqnames") & F.col("value").contains(",")
    cells = F.transform(F.regexp_extract_all("value", F.lit('("(?:[^"]|"")*"|[^,]*)(?:,|$)'), F.lit(1)), lambda c: F.regexp_replace(c, '^"|"$', ""))
    heads = F.broadcast(lines.where(is_head).select("file", cells.alias("names")).dropDuplicates(["file"]))
    known = lines.where(~is_head).join(heads, "file", "left")
    named = lambda name: F.try_element_at(cells, F.array_position("names", F.lit(name)).cast("int"))
    is_csv, f = F.col("names").isNotNull(), F.split("value", "\t")
    cell = lambda name, i: F.when(is_csv, named(name)).otherwise(F.try_element_at(f, F.lit(i)))
    raw = known.where(is_csv | (F.size(f) >= 3)).select("file", cell("seqnames", 1).alias("chrom"), cell("start", 2).alias("start"), cell("end", 3).alias("end"), cell("signalValue", 4).alias("signal"), is_csv.alias("csv"))
    blank = F.col("signal").isNull() | F.trim("signal").isin("", ".")
    signal = F.when(blank, F.when(~F.col("csv"), 1.0)).otherwise(F.col("signal").try_cast("double"))
    parsed = raw.select("file", "chrom", F.col("start").try_cast("long").alias("start"), F.col("end").try_cast("long").alias("end"), signal.alias("signal"), (~blank & signal.isNull()).alias("junk"))
    bad = parsed.where("start is null or end is null or junk").select("file").distinct()
    none = files.select("file").distinct().join(lines.select("file").distinct(), "file", "left_anti")
    left_out = bad.withColumn("reason", F.lit("a line doesn't parse")).unionByName(none.withColumn("reason", F.lit("nothing could be read")))
    good = parsed.drop("junk").join(F.broadcast(bad), "file", "left_anti").join(F.broadcast(files), "file")
    return only_chroms(good.select(*(c.split()[0] for c in schema.split(", "))), AUTOSOME_NAMES if autosomes_only else None), left_out


def read_replicates(spark: SparkSession, entries: DataFrame, autosomes_only: bool = True) -> DataFrame:
    """The peaks of scan_replicates."""
    return scan_replicates(spark, entries, autosomes_only)[0]


def read_fasta(spark: SparkSession, path: str, chrom: str, width: int = 10_000) -> DataFrame:
    """(chrom, chunk, seq): the bases of one chromosome in chunks of `width`, from a file or a folder's files by name, header lines dropped.

    A line's place is the length of the lines before it, summed by block of a file and then within blocks; a line is cut
    where it crosses chunks.
    """
    lines = placed_lines(spark, path).where(~F.col("value").startswith(">"))
    lines = lines.select(F.trim("value").alias("s"), "at.i", F.struct("at.file", "at.block").alias("part"))
    parts = lines.groupBy("part").agg(F.sum(F.length("s")).alias("n"))  # a row for each block of a file
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    inside = F.coalesce(F.sum(F.length("s")).over(Window.partitionBy("part").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("inside", inside).join(F.broadcast(base), "part").withColumn("at", F.col("base") + F.col("inside")).where("length(s) > 0")
    cut = placed.withColumn("chunk", F.explode(F.expr(f"sequence(at div {width}, (at + length(s) - 1) div {width})")))
    begin = F.greatest(F.lit(0), F.col("chunk") * width - F.col("at"))
    stop = F.least(F.length("s"), (F.col("chunk") + 1) * width - F.col("at"))
    pieces = cut.select("chunk", F.greatest("at", F.col("chunk") * width).alias("o"), F.substring(F.col("s"), (begin + 1).cast("int"), (stop - begin).cast("int")).alias("p"))
    whole = pieces.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "p"))), lambda x: x["p"]), "").alias("seq"))
    return whole.select(F.lit(chrom).alias("chrom"), "chunk", "seq")


def read_matrix(spark: SparkSession, path: str, samples_axis: int = 0) -> DataFrame:
    """(sample_id, bin_key, value) of a CSV matrix, however wide: samples as rows and bins as named columns, or with samples_axis=1 the other way round.

    Empty cells, NA and NaN are null; other text in a cell is an error. Names may be quoted.
    """
    head = first_lines(spark, path)
    names = next(csv.reader(head))[1:] if head else []
    rows = spark.read.text(path).where(~F.col("value").isin(*head, ""))
    quoted = F.regexp_extract("value", '^"((?:[^"]|"")*)",', 1)
    name = F.when(F.col("value").startswith('"'), F.replace(quoted, F.lit('""'), F.lit('"'))).otherwise(F.substring_index("value", ",", 1))
    rest = F.regexp_replace("value", '^(?:"(?:[^"]|"")*"|[^,]*),', "")
    cut = rows.select(name.alias("row"), F.split(rest, ",", -1).alias("cells"))  # once for a line; beside the generator a name would be sought in the line for each of its cells
    keyed = cut.select("row", F.posexplode("cells").alias("i", "v"))
    order = spark.createDataFrame(list(enumerate(names)), "i int, column string")
    text = F.trim(F.replace("v", F.lit('"'), F.lit("")))
    value = F.when(~F.lower(text).isin("", "na", "nan", "null"), text.cast("double"))
    first, second = ("sample_id", "bin_key") if samples_axis == 0 else ("bin_key", "sample_id")
    return keyed.join(order, "i").select(F.col("row").alias(first), F.col("column").alias(second), value.alias("value")).select("sample_id", "bin_key", "value")


def read_named_csv(spark: SparkSession, path: str, text: tuple[str, ...] = ("key", "chrom", "interval", "bin"), whole: tuple[str, ...] = ("start", "end"), order: str | None = None) -> DataFrame:
    """A CSV with header whose columns are numbers, but for names and coordinates: wide atlases and tables of importance.

    order names a further column that sorts the rows as they stand in the file, or in a folder's files by name.
    """
    head = first_lines(spark, path)
    names = next(csv.reader(head)) if head else []
    kind = lambda n: "string" if n in text else "long" if n in whole else "double"
    rows = spark.read.option("header", True).schema(", ".join(f"`{n}` {kind(n)}" for n in names)).csv(path)
    return rows if order is None else rows.select("*", place().alias(order))


def read_coefficients(spark: SparkSession, path: str, schema: str = "pc string, b double") -> DataFrame:
    """A model's coefficients, or loadings with another schema, from Parquet or JSON lines; models themselves aren't unpickled."""
    reader = spark.read.schema(schema)
    return reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.json(path)


def read_promoters(spark: SparkSession, path: str, flank: int = 2000) -> DataFrame:
    """(gene, chrom, start, end): windows around the start sites of a JSON list; starts aren't clamped."""
    return spark.read.option("multiLine", True).schema("gene string, chrom string, tss long, strand int").json(path).select("gene", "chrom", (F.col("tss") - flank).alias("start"), (F.col("tss") + flank).alias("end"))


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """blocks (see liftover) of a UCSC chain file.

    Header lines start chains; a chain's lines are its block lengths and gaps, whose running sums place the blocks.
    """
    lines = placed_lines(spark, path).where("trim(value) <> '' and not value like '#%'")
    f = F.split(F.trim("value"), "\\s+")
    head = F.when(F.col("value").startswith("chain"), F.struct("at", f.alias("f")))
    parted = lines.select("at", f.alias("f"), head.alias("head"), F.struct("at.file", "at.block").alias("part"))
    ends = parted.groupBy("part").agg(F.max("head").alias("last"))  # a row for each block of a file
    carried = ends.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    inside = F.last("head", ignorenulls=True).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    known = parted.withColumn("own", inside).join(carried, "part").withColumn("chain", F.coalesce("own", "earlier"))
    tagged = known.select("at", "f", F.col("chain.f").alias("h"), F.col("chain.at").alias("c"))
    body = tagged.where("f[0] <> 'chain'").select("c", "at", "h", F.col("f")[0].cast("long").alias("n"), *(F.coalesce(F.try_element_at("f", F.lit(k)).cast("long"), F.lit(0)).alias(a) for k, a in ((2, "dt"), (3, "dq"))))
    before = Window.partitionBy("c").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    run = lambda gap: F.coalesce(F.sum(F.col("n") + F.col(gap)).over(before), F.lit(0))
    h = F.col("h")
    start = h[5].cast("long") + run("dt")
    return body.select(h[2].alias("chrom"), start.alias("start"), (start + F.col("n")).alias("end"), h[7].alias("to_chrom"), (h[10].cast("long") + run("dq")).alias("to_start"), h[9].alias("to_strand"), h[8].cast("long").alias("to_size"), h[1].cast("double").alias("score"), h[3].cast("long").alias("size"))


def read_bed_rest(spark: SparkSession, path: str) -> DataFrame:
    """(region_id, chrom, start, end, rest) of a BED file without blank, comment, track and browser lines; rest keeps further columns as they are."""
    lines = spark.read.text(path).where(~F.col("value").rlike(SKIPPED_LINES)).withColumn("region_id", F.monotonically_increasing_id())
    f = F.split("value", "\t", 4)
    return lines.select("region_id", f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), F.try_element_at(f, F.lit(4)).alias("rest"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An experiment index of tab-separated strings; the header is the first of the first five lines with Accession and a tab, else the first."""
    lines, first = spark.read.text(path), first_lines(spark, path, 5)
    head = next((x for x in first if "Accession" in x and "\t" in x), first[0] if first else "")
    names = [n.strip() for n in head.split("\t")]
    skipped = first[: first.index(head) + 1] if first else []
    f = F.split("value", "\t", -1)
    return lines.where(~F.col("value").isin(*skipped) if skipped else F.lit(True)).select(*(F.try_element_at(f, F.lit(i + 1)).alias(n) for i, n in enumerate(names)))


def list_accessions(spark: SparkSession, folder: str) -> DataFrame:
    """(file_accession): distinct accessions in the names of a folder's files; contents aren't read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.substring_index("path", "/", -1).alias("name"))
    return names.select(F.regexp_extract("name", FILE_ACCESSION, 0).alias("file_accession")).where("file_accession <> ''").distinct()


def catalog_files(index: DataFrame, present: DataFrame, modality: str, genome: str | None, path: str) -> DataFrame:
    """File-level rows of an experiment index: its columns but Files, with file_accession, experiment, modality and file_path.

    Accessions are taken from the Files column, each once a row, if present(file_accession) has them; experiments of
    another assembly go. path is a pattern with {accession}.
    """
    low = {c.strip().lower(): c for c in index.columns}
    missing = [c for c in ("files", "accession") if c not in low]
    if missing:
        raise KeyError(f"the index has no column {missing[0]}")
    assembly = next((low[c] for c in ("genome assembly", "genome", "assembly") if c in low), None)
    rows = index.where(F.lower(F.coalesce(F.col(f"`{assembly}`"), F.lit(""))).contains(genome.lower())) if assembly and genome else index
    ids = F.explode(F.array_distinct(F.regexp_extract_all(F.col(f"`{low['files']}`"), F.lit(FILE_ACCESSION), F.lit(0))))
    kept = [F.col(f"`{c}`") for c in index.columns if c != low["files"]]
    files = rows.select(*kept, F.col(f"`{low['accession']}`").alias("experiment"), ids.alias("file_accession")).join(present, "file_accession", "left_semi")
    return files.withColumns({"modality": F.lit(modality), "file_path": F.replace(F.lit(path), F.lit("{accession}"), F.col("file_accession"))})


def build_catalog(parts: list[DataFrame]) -> DataFrame:
    """All modalities' files, by column name; what one lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def name_column(columns: list[str]) -> str | None:
    """The column of a catalog that holds biosample names: the first whose name has biosample and name in it."""
    return next((c for c in columns if "biosample" in c.lower() and "name" in c.lower()), None)


def with_tissue_group(catalog: DataFrame, name_col: str | None = None) -> DataFrame:
    """catalog with group, the tissue group of its biosample name."""
    found = name_col or name_column(catalog.columns)
    if found is None:
        raise KeyError("no column of biosample names")
    return catalog.withColumn("group", tissue_group(F.col(f"`{found}`")))
