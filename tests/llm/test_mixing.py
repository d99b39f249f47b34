import re

import pytest

from lociflow.llm.mixing import mix, mixed_sizes

from .helpers import WORD, documents, prose, rng, rows_of

WEIGHTS = (5, 2, 1)


def targets(sizes):
    """Water-filling by hand: share by weight, stop at three times the size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, float(sum(sizes.values())), set(names)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if weight[s] * level > 3 * sizes[s] + 1e-9}
        if not full:
            return out | {s: weight[s] * level for s in free}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= full


def corpus(seed, n=400):
    r = rng(seed)
    rows = [(i, prose(r, int(r.integers(0, 60))), str(r.choice(["a", "B", "c", "\u00e9", "d"], p=[0.02, 0.5, 0.08, 0.1, 0.3]))) for i in range(n)]
    return [*rows, (n, None, "a"), (n + 1, "", "c"), (n + 2, "no source here", None), (n + 3, prose(r, 3000), "d")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    rows = corpus(seed)
    df = documents(spark, rows, extra=True)
    got = rows_of(mixed_sizes(df), "doc_id")
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    whole = {}
    for i, _, s in rows:
        whole[s] = whole.get(s, 0) + size[i]
    want, source, taken = targets(whole), {i: s for i, _, s in rows}, {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == whole[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 30), s
    assert got == rows_of(mixed_sizes(df.repartition(7)), "doc_id")


def test_copies_follow_the_plan_and_the_curriculum(spark):
    df = documents(spark, corpus(3))
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixed_sizes(df).collect() if r["size"]}
    out = mix(df)
    assert out.columns == df.columns
    seen = {}
    order = [r for r in out.collect()]
    for r in order:
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert {i: n for i, n in seen.items() if i in times} == {i: n for i, n in times.items() if n}
    rank = sorted({r["source"] for r in order if r["source"]})
    place = lambda s: [k / len(order) for k, r in enumerate(order) if r["source"] == s]
    mean = lambda s: sum(place(s)) / len(place(s))
    assert mean(rank[0]) < mean(rank[2])  # the first schedule fades out, the third in


def test_defined_cases(spark):
    got = rows_of(mixed_sizes(documents(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (2, None, None)])), "doc_id", "size")
    assert [(r["doc_id"], r["size"], r["source_size"]) for r in got] == [(1, 2, 5), (1, 2, 5), (2, 0, 0), (None, 1, 5)]
    assert mixed_sizes(documents(spark, [])).count() == 0 and mix(documents(spark, [])).count() == 0
    assert mixed_sizes(documents(spark, [(1, None), (2, " ")])).count() == 2


def test_word_pattern():
    assert re.findall(WORD.pattern, "a\u0085b c\x0bd") == ["a\u0085b", "c", "d"]
