"""Fixed vocabulary, panels and genome sizes, and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The chromatin states in canonical order (position = code), their groups, and the active ones.
STATES = (
    "TssA", "TssFlnk", "TssFlnkU", "TssFlnkD", "Tx", "TxWk", "EnhG1", "EnhG2", "EnhA1", "EnhA2", "EnhWk", "ZNF/Rpts", "Het", "TssBiv", "EnhBiv",
    "ReprPC", "ReprPCWk", "Quies",
)
GROUPS = {
    "Promoter": ("TssA", "TssFlnk", "TssFlnkU", "TssFlnkD"),
    "Bivalent": ("TssBiv", "EnhBiv"),
    "Enhancer": ("EnhA1", "EnhA2", "EnhG1", "EnhG2", "EnhWk"),
    "Transcription": ("Tx", "TxWk"),
    "ZNF_Repeat": ("ZNF/Rpts",),
    "Heterochromatin": ("Het",),
    "Polycomb": ("ReprPC", "ReprPCWk"),
    "Quiescent": ("Quies",),
}
ACTIVE_STATES = ("TssA", "TssFlnk", "TssFlnkU", "TssFlnkD", "EnhA1", "EnhA2", "EnhG1", "EnhG2", "EnhWk", "Tx")

# Histone marks in canonical order, the active and the repressive ones.
MARKS = ("H3K4me3", "H3K4me1", "H3K27ac", "H3K36me3", "H3K27me3", "H3K9me3")
ACTIVE_MARKS = MARKS[:4]
REPRESSIVE_MARKS = MARKS[4:]

# Reference segmentations by tissue, and the roles of tissues in each panel.
SEGMENTATION_ACCESSIONS = {"placenta": "ENCFF024IDF", "neutrophil": "ENCFF412COT", "Bcell": "ENCFF004HFC", "K562": "ENCFF026ZCC", "keratinocyte": "ENCFF131MHN"}
ROLES = ("signal", "background", "inflammation", "control")
PANELS: dict[str, dict[str, tuple[str, ...]]] = {"fetal": {"signal": ("placenta",), "background": ("neutrophil", "Bcell"), "control": ("K562",)}}

# Lengths of chr1 to chr22.
AUTOSOMES = {
    "hg19": (
        249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747, 135006516, 133851895, 115169878,
        107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895, 51304566,
    ),
    "hg38": (
        248956422, 242193529, 198295559, 190214555, 181538259, 170805979, 159345973, 145138636, 138394717, 133797422, 135086622, 133275309, 114364328,
        107043718, 101991189, 90338345, 83257441, 80373285, 58617616, 64444167, 46709983, 50818468,
    ),
}



def group_of_state() -> dict[str, str]:
    return {state: group for group, states in GROUPS.items() for state in states}


def state_vocabulary(spark: SparkSession) -> DataFrame:
    """(state, code, grp, is_active), a row for each state."""
    group = group_of_state()
    return spark.createDataFrame([(s, i, group[s], s in ACTIVE_STATES) for i, s in enumerate(STATES)], "state string, code int, grp string, is_active boolean")


def panel_roles(spark: SparkSession, panel: str | dict[str, tuple[str, ...]]) -> DataFrame:
    """(tissue, role, role_ord, ord): the tissues of a panel, a row for each role that lists one."""
    roles = PANELS[panel] if isinstance(panel, str) else panel
    rows = [(t, role, i, 100 * i + j) for i, role in enumerate(ROLES) for j, t in enumerate(roles.get(role, ()))]
    return spark.createDataFrame(rows, "tissue string, role string, role_ord int, ord int")


def chromosome_sizes(spark: SparkSession, assembly: str) -> DataFrame:
    """(chrom, size) of the autosomes."""
    return spark.createDataFrame([(f"chr{i}", n) for i, n in enumerate(AUTOSOMES[assembly], 1)], "chrom string, size long")
