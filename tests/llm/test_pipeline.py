"""Every stage of corpus_pipeline against plain versions: repeated ids, nulls, empty tables, long texts, clashing names."""

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lociflow.llm.mixing import mixed_sizes
from lociflow.llm.packing import pack
from lociflow.llm.quality import quality_scores
from lociflow.llm.secrets import secret_report

from .helpers import components, documents, prose, rng
from .test_classifiers import corpus as labelled
from .test_minhash import changed, shingles
from .test_packing import check_places
from .test_secrets import texts as secret_texts


def kept_rows(rows, k=5, percent=80):
    """Rows by (id, text) that one-of-a-group keeps, by all pairs of distinct sets."""
    sets = {}
    for i, t in rows:
        if i is not None and shingles(t, k):
            sets.setdefault(frozenset(shingles(t, k)), []).append((i, t))
    names = {s: (min(i for i, _ in some), n) for n, (s, some) in enumerate(sets.items())}
    links = [(names[a], names[b]) for a in sets for b in sets if names[a] < names[b] and 100 * len(a & b) >= percent * len(a | b)]
    root = components(list(names.values()), links)
    groups = {}
    for s, some in sets.items():
        groups.setdefault(root[names[s]], []).extend(some)
    return [r for r in rows if r[0] is None or not shingles(r[1], k)], groups


def check_dedup(got, rows):
    alone, groups = kept_rows(rows)
    left = Counter(got)
    for r in alone:
        left[r] -= 1
    for some in groups.values():
        heads = [r for r in some if r[0] == min(i for i, _ in some)]
        one = [r for r in set(heads) if left[r] > 0]
        assert len(one) == 1, some
        left[one[0]] -= 1
    assert not +left and not -left


def dedup(spark, rows):
    df = documents(spark, rows, extra=True)
    out = cp.near_duplicate_stage(spark, df, "")
    assert out.columns == df.columns
    return [(r["doc_id"], r["text"]) for r in out.collect()]


def test_dedup_goes_by_row_not_by_id(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    assert sorted(dedup(spark, [(3, b), (5, a), (5, b)])) == [(3, b), (5, a)]
    rows = [(3, b), (5, a), (5, b), (5, a), (5, a.upper()), (9, a), (None, a), (7, None), (7, None), (7, ""), (8, "one two"), (8, "one two"), (2, "one two")]
    check_dedup(dedup(spark, rows), rows)


def test_dedup_matches_all_pairs(spark):
    r = rng(11)
    base, rows = prose(r, 120), []
    for i in range(120):
        text = changed(r, base, float(r.choice([0.004, 0.01, 0.02, 0.05]))) if r.random() < 0.6 else prose(r, int(r.integers(1, 80)))
        rows.append((int(r.integers(0, 90)), text))
    rows += [(200, "a b c " * 8000), (201, "a b c " * 8000), (-5, base), (202, None)]
    check_dedup(dedup(spark, rows), rows)


def test_quality_stage_keeps_what_scores_accept(spark, tmp_path):
    rows, labels = labelled(4)
    rows += [(900, None), (901, ""), (None, "some words"), (1, rows[1][1]), (902, "word " * 30000)]
    pq.write_table(pa.table({"doc_id": [x[0] for x in labels], "quality": [x[1] for x in labels], "toxic": [x[2] for x in labels]}), tmp_path / "labels.parquet")
    df = documents(spark, rows, extra=True)
    out = cp.quality_stage(spark, df, str(tmp_path))
    known = spark.read.parquet(str(tmp_path / "labels.parquet"))
    good = Counter(r["doc_id"] for r in quality_scores(df, known).where("predicted = 1").collect())
    assert out.columns == df.columns and Counter(r["doc_id"] for r in out.collect()) == good and 0 < sum(good.values()) < len(rows)


def test_secret_stage_changes_texts_with_spans_only(spark):
    rows = list(enumerate(secret_texts(5)))
    df = documents(spark, rows, extra=True).withColumn("n_chars", F.lit(7).cast("long"))
    spans = {r["doc_id"]: r["spans"] for r in secret_report(df).collect()}
    out = cp.secret_stage(spark, df, "")
    assert out.columns == df.columns
    for r in out.collect():
        text = rows[r["doc_id"]][1]
        assert (r["text"] != text) == bool(spans[r["doc_id"]])
        assert r["n_chars"] == (len(r["text"]) if spans[r["doc_id"]] and len(r["text"]) != len(text) else 7)


def test_mixing_stage_takes_what_the_plan_says(spark):
    r = rng(6)
    rows = [(i % 70, prose(r, int(r.integers(0, 40))), str(r.choice(["a", "b", "c"]))) for i in range(100)] + [(None, "x y", None), (500, prose(r, 4000), "b"), (501, None, "a")]
    df = documents(spark, rows, extra=True)
    want = Counter()
    for x in mixed_sizes(df).collect():
        want[x["doc_id"]] += x["taken"]
    got = Counter()
    out = cp.mixing_stage(spark, df, "")
    assert out.columns == df.columns
    for x in out.collect():
        got[x["doc_id"]] += len((x["text"] or "").split())
    assert +got == +want


def test_packing_stage_packs_every_document(spark):
    r = rng(7)
    rows = [(i, prose(r, int(n))) for i, n in enumerate(r.integers(0, 300, 50))] + [(1, "again"), (None, "x"), (60, None), (61, prose(r, 6000))]
    df = documents(spark, rows, extra=True)
    out = cp.packing_stage(spark, df, "").collect()
    assert Counter(x["doc_id"] for x in out if x["piece"] == 0) == Counter(i for i, _ in rows)
    check_places(out, 4096)


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_stages_on_an_empty_table(spark, sf_dir, stage):
    assert stage(spark, documents(spark, []), sf_dir).count() == 0


def test_run_over_whole_tables(spark, sf_dir):
    """The stages one by one, each from its predecessor's rows, give what run() gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = [(r["doc_id"], r["text"]) for r in cp.quality_stage(spark, docs, sf_dir).collect()]
    df = documents(spark, before)
    check_dedup([(r["doc_id"], r["text"]) for r in cp.near_duplicate_stage(spark, df, sf_dir).collect()], before)
    out = cp.run(spark, sf_dir)
    assert check_places(out.collect(), 4096) == out.select("sequence_id").distinct().count()
    assert {r[0] for r in out.select("doc_id").distinct().collect()} <= {i for i, _ in before}
    assert out.columns == pack(docs, cp.tokenizer_path()).columns
