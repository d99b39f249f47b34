"""Secrets in texts, in DataFrame functions only: fixed kinds by pattern, others by a battery of randomness tests.

Long tokens that no pattern claims are tested for looking uniformly random in the encoding inferred from their
characters: the chi-squared statistic of the alphabet (standardised exactly through the number of equal pairs), the
Wald-Wolfowitz runs of upper and lower half of the alphabet, and the lag-one serial correlation. The three tail
probabilities combine to one p by Fisher's rule. Random tokens have uniform p, language and code pile up near 0, more
so the longer they are. So within each class of encoding and length the share of random tokens is estimated from the
upper half of p, and the least cut-off is taken at which the expected share of others among the tokens above it is
at most `fdr`. A token that repeats counts once for this. Classes of under LEAST tokens are judged as one, however few
they hold together; the estimate counts one token more in the upper half than there are, and two more in all, so a lone
token is added if its own p lies in the upper half. Tokens of letters of one case, or with a capital before small ones,
are taken for words and not tested: as classes of their own they were tried, and long words of prose passed the tests.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The kinds in the order of the report, their patterns, the group that is measured and its least length.
KINDS = (
    ("assign", "(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
RANDOM = "random"
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WORDLIKE = "^[A-Z]?[a-z]+$|^[A-Z]+$|^[_=+/-]+$"
# Encodings by pattern, first that fits, with their alphabets.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("^[0-9]+$", DIGITS),
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+=*$", UPPER + "234567"),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("^", DIGITS + UPPER + LOWER + "+/_-"),
)
LENGTHS = (20, 24, 32, 48, 64)
BINS = 20
LEAST = 20
BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def match_starts(lengths: Column, gaps: Column) -> Column:
    """Where each match begins: the sum of the gaps up to it and the matches before it, in blocks to stay near linear."""
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(w: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / BLOCK).cast("int")), lambda b: add(F.slice(w, b * BLOCK + 1, F.lit(BLOCK))))
        sums = let(blocks, lambda s: F.transform(s, lambda _, i: add(F.slice(s, F.lit(1), i))))
        return let(sums, lambda s: F.transform(w, lambda _, i: s[F.floor(i / BLOCK).cast("int")] + add(F.slice(w, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)) + gaps[i].cast("long")))

    return let(F.zip_with(lengths, F.slice(gaps, F.lit(1), F.size(lengths)), lambda m, g: (m + g).cast("long")), of)


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, token, measured>> of the leftmost non-overlapping matches, in code points; empty if none."""
    kind = "array<struct<start:bigint,stop:bigint,token:string>>"
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))

    def spans(matches: Column) -> Column:
        gaps = lengths(F.split(text, pattern, -1))
        starts = let(lengths(matches), lambda m: let(gaps, lambda g: match_starts(m, g)))
        return F.zip_with(starts, matches, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("stop"), m.alias("token")))

    some = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast(kind))


def base_spans(text: Column) -> Column:
    """array<struct<start, no, stop>> of the fixed kinds, by start, then kind."""

    def of(no: int, pattern: str, group: int, least: int) -> Column:
        hits = F.filter(found(text, pattern), lambda x: F.length(F.regexp_extract(x["token"], pattern, group)) >= least)
        return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("no"), x["stop"].alias("stop")))

    return F.array_sort(F.concat(*(of(no, *kind[1:]) for no, kind in enumerate(KINDS))))


def upper_tail(value: Column) -> Column:
    """P(Z > value) of the normal law (Abramowitz and Stegun 26.2.17), from 1e-12 up."""

    def of(z: Column, t: Column) -> Column:
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        tail = F.exp(-z * z / 2) * poly * 0.3989422804014327
        return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-12))

    return let(value, lambda z: let(1 / (1 + 0.2316419 * F.abs(z)), lambda t: of(z, t)))


def summed(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def chi_squared_z(token: Column, alphabet: Column, n: Column) -> Column:
    """The standardised number of equal pairs of characters."""
    k, pairs = F.length(alphabet).cast("double"), n * (n - 1) / 2
    count = lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double")
    equal = summed(F.transform(F.split(alphabet, ""), lambda c: let(count(c), lambda m: m * (m - 1) / 2)))
    return (equal - pairs / k) / F.sqrt(pairs / k * (1 - 1 / k))


def runs_z(high: Column, n: Column) -> Column:
    """The standardised number of runs of 0 and 1; 6 if all are equal."""
    runs = 1 + summed(F.transform(high, lambda x, i: F.when((i > 0) & (x != high[F.greatest(i - 1, F.lit(0))]), 1.0).otherwise(0.0)))
    z = lambda both: let(both * (both - n) / (n * n * (n - 1)), lambda v: F.when(v > 0, (runs - both / n - 1) / F.sqrt(F.abs(v) + 1e-9)).otherwise(6.0))
    return let(summed(high), lambda ones: let(2 * ones * (n - ones), z))


def serial_z(r: Column, n: Column) -> Column:
    """The standardised lag-one correlation; 6 if all are equal."""

    def of(d: Column) -> Column:
        lag = summed(F.transform(d, lambda v, i: F.when(i > 0, v * d[F.greatest(i - 1, F.lit(0))]).otherwise(0.0)))
        return let(summed(F.transform(d, lambda v: v * v)), lambda var: F.when(var > 0, (lag / F.greatest(var, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(6.0))

    return let(summed(r) / n, lambda mean: let(F.transform(r, lambda x: x - mean), of))


def randomness(token: Column, alphabet: Column) -> Column:
    """Combined p of chi-squared uniformity, runs and serial correlation under uniformly random characters."""
    half = F.length(alphabet) / 2
    two_sided = lambda z: F.least(2 * upper_tail(F.abs(z)), F.lit(1.0))

    def of(r: Column, n: Column) -> Column:
        high = F.transform(r, lambda x: (x > half).cast("double"))
        tails = (upper_tail(chi_squared_z(token, alphabet, n)), let(let(high, lambda h: runs_z(h, n)), two_sided), let(serial_z(r, n), two_sided))
        return let(-(F.log(tails[0]) + F.log(tails[1]) + F.log(tails[2])), lambda x: F.exp(-x) * (1 + x + x * x / 2))

    ranks = F.filter(F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c).cast("double")), lambda x: x > 0)
    return let(ranks, lambda r: let(F.size(r).cast("double"), lambda n: of(r, n)))


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start, stop, cls, p, h>> of long tokens that aren't words and meet no fixed kind."""
    free = lambda x: ~F.exists(base, lambda b: (b["start"] < x["stop"]) & (b["stop"] > x["start"]))
    hits = F.filter(found(text, TOKEN), lambda x: ~x["token"].rlike(WORDLIKE) & free(x))

    def judged(x: Column) -> Column:
        no, alphabet = F.lit(len(ENCODINGS) - 1), F.lit(ENCODINGS[-1][1])
        for i, (pattern, letters) in reversed(list(enumerate(ENCODINGS[:-1]))):
            no = F.when(x["token"].rlike(pattern), i).otherwise(no)
            alphabet = F.when(x["token"].rlike(pattern), F.lit(letters)).otherwise(alphabet)
        size = sum(((F.length(x["token"]) >= n).cast("int") for n in LENGTHS[1:]), F.lit(0))
        p = let(alphabet, lambda a: randomness(x["token"], a))
        return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), (no * len(LENGTHS) + size).alias("cls"), p.alias("p"), F.xxhash64(x["token"]).alias("h"))

    return F.transform(hits, judged)


def cut_offs(tokens: DataFrame, fdr: float) -> dict[int, float]:
    """By class, the least p at which tokens above it are random but for a share of fdr; classes without one are left out.

    tokens(cls, p, h): h names a token, and equal ones count once.
    """
    binned = tokens.distinct().groupBy("cls", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count()
    counts: dict[int, list[int]] = {}
    for r in binned.collect():  # at most 40 classes of 20 bins
        counts.setdefault(r["cls"], [0] * BINS)[r["bin"]] = r["count"]
    sparse = [cls for cls, n in counts.items() if sum(n) < LEAST]
    pooled = [sum(counts[cls][b] for cls in sparse) for b in range(BINS)]
    groups = [([cls], n) for cls, n in counts.items() if cls not in sparse] + [(sparse, pooled)]
    return {cls: cut for classes, n in groups if (cut := cut_off(n, fdr)) is not None for cls in classes}


def cut_off(n: list[int], fdr: float) -> float | None:
    """From the tokens by bin of p; none if no part of them is random enough."""
    m = sum(n)
    share = min(1.0, (1 + sum(n[BINS // 2 :])) / (0.5 * (m + 2)))
    for b in range(BINS):
        above = sum(n[b:])
        if above and 1 - share * (1 - b / BINS) * m / above <= fdr:
            return b / BINS
    return None


def all_spans(base: Column, more: Column, cuts: dict[int, float]) -> Column:
    """array<struct<start, no, stop>>, by start, then kind; no counts KINDS, then the random tokens."""
    keep = lambda x: reduce(or_, ((x["cls"] == c) & (x["p"] >= p) for c, p in cuts.items()), F.lit(False))
    added = F.transform(F.filter(more, keep), lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("no"), x["stop"].alias("stop")))
    return F.array_sort(F.concat(base, added))


def examined(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with __base, the spans of fixed kinds, and __more, the judged tokens."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn("__base", base_spans(text)).withColumn("__more", candidates(text, F.col("__base")))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs.

    Spans are kind:start:end in code points, the end exclusive, joined by commas. Null and empty texts have none. Rows
    that repeat an id, or have a null one, are scanned each for itself. An empty table gives an empty one.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seen = written(examined(slim, "text").drop("text"), "spans")
    cuts = cut_offs(seen.select(F.explode("__more").alias("t")).select("t.cls", "t.p", "t.h"), fdr)
    names = F.array(*(F.lit(k[0]) for k in KINDS), F.lit(RANDOM))
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", names[x["no"]], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda no: F.size(F.filter("__base", lambda x: x["no"] == no)).cast("long")
    every = all_spans(F.col("__base"), F.col("__more"), cuts)
    return seen.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(told(F.col("__base")), 256).alias("base_sha256"), told(every).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by mark; spans that meet become one. Null texts stay null."""
    text = F.col(text_col)
    seen = written(examined(docs, text_col), "examined")  # each text is examined once
    cuts = cut_offs(seen.select(F.explode("__more").alias("t")).select("t.cls", "t.p", "t.h"), fdr)
    seen = seen.withColumn("__spans", all_spans(F.col("__base"), F.col("__more"), cuts))
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        apart = F.struct(F.concat(acc["out"], F.array(piece, F.lit(mark))).alias("out"), x["stop"].alias("at"))
        meets = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["stop"]).alias("at"))
        return F.when((x["start"] < acc["at"]) & (F.size(acc["out"]) > 0), meets).otherwise(apart)

    start = F.struct(none.alias("out"), F.lit(0).cast("long").alias("at"))
    joined = F.aggregate("__spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return seen.withColumn(text_col, F.when(F.size("__spans") > 0, joined).otherwise(text)).select(*docs.columns)
