"""Fixtures that several tests share, and plain versions of what the operators define."""

import re

import numpy as np

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows, extra=False):
    """rows are (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCUMENTS)
    return with_clashing_names(df) if extra else df


def with_clashing_names(df):
    """Extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ["id", "size", "score", "node", "label", "key", "part", "rank", "component", "length", "h", "vec", "list", "host", "x"]
    return df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})


def components(nodes, links):
    """node -> smallest node reachable."""
    top = {n: n for n in nodes}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def rows_of(df, *keys):
    return sorted(df.collect(), key=lambda r: tuple((r[k] is None, r[k]) for k in keys))


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


def rng(seed=0):
    return np.random.default_rng(seed)
