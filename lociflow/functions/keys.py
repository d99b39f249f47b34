"""Names of genomic bins, labels of biosamples, and reproducible random numbers, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BIN_NAME = "(chr\\w+)[:\\-_](\\d+)[\\-_](\\d+)"
# Origin groups and the substrings of biosample names that tell them, in order; the first that occurs decides.
TISSUE_PATTERNS = (
    ("placenta", ("placenta", "trophoblast", "cytotrophoblast", "chorion", "chorionic", "amnion")),
    ("neutrophil", ("neutrophil",)),
    ("monocyte", ("monocyte", "cd14")),
    ("macrophage", ("macrophage",)),
    ("Bcell", ("b cell", "b-cell", "cd19", "cd20")),
    ("CD8", ("cd8",)),
    ("CD4", ("cd4",)),
    ("Tcell", ("t cell", "t-cell", "cd3", "thymocyte")),
    ("NK", ("natural killer", "cd56")),
    ("erythroblast", ("erythroblast", "erythroid", "erythrocyte")),
    ("megakaryocyte", ("megakaryocyte", "platelet")),
    ("HSC", ("hematopoietic stem", "cd34", "myeloid progenitor", "lymphoid progenitor", "hematopoietic multipotent")),
    ("K562", ("k562",)),
    ("liver", ("hepatocyte", "liver", "hepg2")),
    ("lung", ("lung", "pneumocyte", "bronchial", "alveolar")),
    ("colon", ("colon", "colonic", "sigmoid", "intestine", "intestinal", "rectal")),
    ("kidney", ("kidney", "renal", "nephron")),
    ("pancreas", ("pancreas", "pancreatic", "islet")),
    ("heart", ("heart", "cardiac", "cardiomyocyte", "ventricle", "atrium", "aorta")),
    ("endothelial", ("endothelial", "huvec", "vein", "artery", "arterial", "vascular")),
    ("adipose", ("adipose", "adipocyte")),
    ("breast", ("breast", "mammary", "mcf-7", "mcf7")),
    ("skeletal_muscle", ("skeletal muscle", "myotube", "myoblast", "myocyte")),
    ("brain", ("brain", "neuron", "neural", "cortex", "astrocyte", "cerebell")),
    ("esophagus", ("esophagus", "esophageal")),
    ("stomach", ("stomach", "gastric")),
    ("spleen", ("spleen", "splenic")),
    ("thyroid", ("thyroid",)),
    ("adrenal", ("adrenal",)),
    ("ovary", ("ovary", "ovarian", "uterus", "uterine", "endometrium", "endometrial")),
    ("prostate", ("prostate", "prostatic")),
    ("keratinocyte", ("keratinocyte", "epidermis", "epidermal")),
)
# The groups of the default plasma panel, in order.
PLASMA_GROUPS = (
    "placenta", "neutrophil", "monocyte", "Bcell", "CD4", "CD8", "NK", "erythroblast", "megakaryocyte", "HSC", "liver", "endothelial", "lung", "colon",
    "kidney", "pancreas", "heart", "breast", "adipose", "skeletal_muscle", "brain",
)


def bin_part(name: Column, part: int) -> Column:
    """Chromosome (1), start (2) or end (3) of the first bin name that occurs; an error if none does."""
    found = F.regexp_extract(name, BIN_NAME, part)
    checked = F.when(found == "", F.raise_error(F.concat(F.lit("no genomic bin in: "), F.coalesce(name, F.lit("null"))))).otherwise(found)
    return checked if part == 1 else checked.cast("long")


def normal_key(name: Column) -> Column:
    """chr:start:end as chr:start-end; other names as they are."""
    return F.regexp_replace(name, "^(chr\\w+):(\\d+):(\\d+)$", "$1:$2-$3")


def feature_key(name: Column) -> Column:
    """The key of a feature that is a genomic bin with one of : _ . - between its parts, else null."""
    return F.when(name.rlike("^chr[0-9XYM]+[:_.][0-9]+[:_.-][0-9]+$"), F.regexp_replace(name, "^(chr[0-9XYM]+)[:_.]([0-9]+)[:_.-]([0-9]+)$", "$1:$2-$3"))


def coordinates_key(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("long").cast("string"), F.lit("-"), end.cast("long").cast("string"))


def tissue_group(name: Column, patterns=TISSUE_PATTERNS, whole_words: bool = False) -> Column:
    """The first group one of whose substrings occurs in the name, whatever its case; null if none does.

    whole_words asks for word boundaries, so that cd34 isn't taken for cd3, nor adrenal for renal.
    """
    low = F.lower(name)
    hit = (lambda p: low.rlike(f"\\b{p}")) if whole_words else (lambda p: low.contains(p))
    out = F.lit(None).cast("string")
    for group, some in reversed(patterns):
        out = F.when(reduce(lambda a, b: a | b, map(hit, some)), group).otherwise(out)
    return out


def assay_key(assay: Column, target: Column, marks: tuple[str, ...]) -> Column:
    """DNase, ATAC or the active mark that an experiment measures, else null."""
    low = F.lower(F.coalesce(assay, F.lit("")))
    return F.when(low.contains("dnase"), "DNase").when(low.contains("atac"), "ATAC").when(F.trim(target).isin(*marks), F.trim(target))


def unit_hash(*parts: Column | int | str) -> Column:
    """A number in [0, 1) from the md5 of the parts: the same in every run and on every executor."""
    text = F.concat_ws("/", *((p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(16**12)
