import re
from collections import Counter, defaultdict

import pytest

from lociflow.llm import divergence
from lociflow.llm.divergence import document_runs, scanned_runs, source_divergence, terms_of

from .helpers import rng, with_clashing_names

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def plain(rows, min_docs=10, top=10):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source, words = lang or "", source or "", TERM.findall(lower(text or ""))
        groups[lang].add(source)
        counts[lang, source].update(words)
        df[lang].update(set(words))
    out = set()
    gap = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]

        def shares(c, kept=kept):
            whole = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // whole for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            found = [("pair", o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [("term", t, gap(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, limit in ((found, None), (terms, top)):
                for k, (kind, item, value) in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode()))[:limit], 1):
                    out.add((lang, s, kind, item, value, k))
    return out


def as_set(df):
    return {tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()}


def corpus(seed, n=300):
    r = rng(seed)
    words = ["the", "The", "été", "a-b", "中文", "x9y", "\U0001f600", "ÉTE", *(f"{a}{b}" for a in "klmnopq" for b in "aeiouy")]
    rows = []
    for i in range(n):
        some = r.integers(0, len(words), int(r.integers(0, 30)))
        rows.append((i % 200, " ".join(words[k] for k in some), str(r.choice(["en", "de", ""], p=[0.7, 0.2, 0.1])), f"s{int(r.integers(0, 7)) * int(r.integers(0, 2))}", 0))
    return [*rows, (None, None, None, None, 0), (n, "", "en", None, 0), (n + 1, "the 12 .", "fr", "only", 0), (n + 2, "one", "fr", "two", 0), *rows[:9]]


@pytest.mark.parametrize("chunk", [1 << 20, 60])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    rows = corpus(1)
    df = with_clashing_names(spark.createDataFrame(rows, DOCS))
    want = plain(rows)
    assert as_set(source_divergence(df)) == want and len(want) > 60
    assert as_set(source_divergence(df.repartition(5))) == want


def test_a_word_of_all_documents(spark):
    """A word's runs of many chunks and sources are one count each, and its language's total comes once."""
    rows = [(i, "same " * (1 + i % 3) + ("rare " if i < 12 else "") + ("few" if i < 9 else ""), "en", f"s{i % 50:02}", 0) for i in range(3000)]
    slim = spark.createDataFrame(rows, DOCS).selectExpr("doc_id as doc", "lang", "source", "text").repartition(40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = scanned_runs(document_runs(slim), 10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {(r["kind"], r["term"], r["source"]): r["n"] for r in got}
    assert len(found) == len(got) and {r["lang"] for r in got} == {"en"}
    want = {(0, "", f"s{k:02}"): 0 for k in range(50)}
    want |= {(1, "same", f"s{k:02}"): sum(1 + i % 3 for i in range(k, 3000, 50)) for k in range(50)}
    want |= {(1, "rare", f"s{k:02}"): 1 for k in range(12)} | {(2, "rare", None): 12, (2, "same", None): 6000}
    assert found == want


def test_many_sources_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    rows = [(i, f"w{'abc'[i % 3]} x w{'abc'[i % 2]}", "en", f"s{i % 11}", 0) for i in range(120)]
    assert as_set(source_divergence(spark.createDataFrame(rows, DOCS))) == plain(rows)


def test_defined_cases(spark):
    assert source_divergence(spark.createDataFrame([], DOCS)).count() == 0
    few = spark.createDataFrame([(1, "a b", "en", "x", 0), (2, None, "en", "y", 0)], DOCS)
    assert as_set(source_divergence(few)) == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}
    long = [(i, ("word" + chr(97 + i) + " ") * 30_000 + "z" * 100_000, "en", f"s{i % 2}", 0) for i in range(12)]
    assert as_set(source_divergence(spark.createDataFrame(long, DOCS))) == plain(long)


def test_terms():
    text = "A-ZÄbß 9 d'eau　[x]\x00q\x7f\u0080"
    assert [w.decode() for w in terms_of(text)] == TERM.findall(lower(text))
