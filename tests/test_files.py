import gzip

from pyspark.sql import functions as F

from lociflow.operators import atlas
from lociflow.sources import readers


def test_last_of_repeated_keys_over_files_of_unequal_size(spark, tmp_path):
    """Spark reads the larger file first; the last row by file name and place counts all the same."""
    folder = tmp_path / "atlas.csv"
    folder.mkdir()
    (folder / "part-00000.csv").write_text("key,C_lung\nk,1.0\n")
    (folder / "part-00001.csv").write_text("key,C_lung\n" + "".join(f"x{i},3.0\n" for i in range(500)) + "k,2.0\n")
    wide = readers.read_named_csv(spark, str(folder), order="line")
    assert {r["bin_key"]: r["value"] for r in atlas.long_atlas(wide, "C", order="line").collect()}["k"] == 2.0


def test_fasta_in_files_of_unequal_size(spark, tmp_path):
    folder, text = tmp_path / "x.fa", ""
    folder.mkdir()
    for i, n in enumerate((1, 400, 3)):
        bases = [("ACGT" * (k % 5 + 1))[: k % 17 + 1] for k in range(n)]
        (folder / f"part-{i:05}.txt").write_text((">chrT\n" if i == 0 else "") + "\n".join(bases) + "\n")
        text += "".join(bases)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r["chunk"]: r["seq"] for r in readers.read_fasta(spark, str(folder), "chrT", width=50).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert "".join(got[k] for k in sorted(got)) == text and all(len(got[k]) == 50 for k in got if k < max(got))


def test_chains_over_blocks_of_files(spark, tmp_path):
    """Chains with many gapped blocks that go on in another split of a file, and in another file."""
    folder, want, out = tmp_path / "c.chain", set(), []
    folder.mkdir()
    for c in range(9):
        start, to, n = 100 * c, 7 * c, 3 + 5 * c
        out.append(f"chain 1000 chr{c} 9000 + {start} 8000 new 9000 + {to} 8000 {c}")
        for k in range(n):
            size, dt, dq = 5 + k, k % 3, k % 2 * 4
            want.add((f"chr{c}", start, start + size, to))
            out.append(str(size) if k == n - 1 else f"{size} {dt} {dq}")
            start, to = start + size + dt, to + size + dq
        out.append("")
    cut = len(out) // 5
    (folder / "part-00000").write_text("\n".join(out[:cut]) + "\n")
    (folder / "part-00001").write_text("\n".join(out[cut:]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {(r["chrom"], r["start"], r["end"], r["to_start"]) for r in readers.read_chain(spark, str(folder)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want


def test_first_lines_come_from_the_first_file(spark, tmp_path):
    folder = tmp_path / "i.tsv"
    folder.mkdir()
    (folder / "part-00000").write_text("")
    (folder / "part-00001").write_text("made for tests\n")
    (folder / "part-00002").write_text("Accession\tFiles\n" + "".join(f"A{i}\tF{i}\n" for i in range(200)))
    got = readers.read_index(spark, str(folder))
    assert got.columns == ["Accession", "Files"] and got.count() == 200
    assert readers.first_lines(spark, str(folder), 2) == ["made for tests", "Accession\tFiles"]


def test_replicates_in_one_scan(spark, tmp_path):
    folder = tmp_path / "peaks"
    folder.mkdir()
    (folder / "a1.bed").write_text("chr1\t1\t5\t2.5\nchr1\t7\t9\nchrX\t1\t2\t1\nshort\n")
    with gzip.open(folder / "a2.csv.gz", "wt") as f:
        f.write('"seqnames","start","end","name","signalValue"\n"chr2",3,8,"x, y",4.5\nchr3,1,2,z,0.5\n')
    (folder / "bad.bed").write_text("chr1\t1\t5\t2.5\nchr1\t1\tjunk\t2.5\n")
    (folder / "broken.bed.gz").write_bytes(b"not gzip at all")
    entries = spark.createDataFrame([("t", "D", f"{folder}/a*"), ("u", "D", f"{folder}/a1.bed"), ("u", "D", f"{folder}/b*"), ("v", "D", f"{folder}/none*")], "tissue string, assay string, path string")
    peaks, left_out = readers.scan_replicates(spark, entries)
    got = sorted((r["tissue"], r["chrom"], r["start"], r["end"], r["signal"]) for r in peaks.collect())
    one = [("chr1", 1, 5, 2.5), ("chr1", 7, 9, 1.0)]
    assert got == sorted([("t", *x) for x in (*one, ("chr2", 3, 8, 4.5), ("chr3", 1, 2, 0.5))] + [("u", *x) for x in one])
    assert sorted((r["file"].rsplit("/", 1)[-1], r["reason"]) for r in left_out.collect()) == [("bad.bed", "a line doesn't parse"), ("broken.bed.gz", "nothing could be read")]
    plan = peaks._jdf.queryExecution().optimizedPlan().toString()
    many = spark.createDataFrame([("t", str(k), f"{folder}/a*") for k in range(60)], "tissue string, assay string, path string")
    more = readers.read_replicates(spark, many)
    assert more.count() == 60 * 4 and len(more._jdf.queryExecution().optimizedPlan().toString().splitlines()) == len(plan.splitlines())
    assert readers.read_replicates(spark, entries.where("tissue = 'v'")).count() == 0


def test_no_file_of_the_repeated_atlas_takes_half_of_the_rows(spark, sf_dir, monkeypatch):
    from lociflow.plans import catalogue, files

    sizes = []

    def spy(rows, path, f=files.writers.write_csv):
        sizes.extend(x["count"] for x in rows.groupBy(F.spark_partition_id()).count().collect())
        return f(rows, path)

    monkeypatch.setattr(files.writers, "write_csv", spy)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert catalogue.QUERIES["repeated_atlas_rows"](spark, sf_dir).count() > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 0.4 * sum(sizes)
