import numpy as np

from lociflow.llm.minhash import WordHashes, near_duplicates, round_seeds, shingle_set, sketch, strongest_links

from .helpers import components, documents, prose, rng, rows_of


def shingles(text, k):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    n = min(k, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = components(ids, links)
    return [(i, len(sets[i]), root[i], root[i] == i) for i in ids]


def changed(r, text, share):
    words = text.split()
    for i in r.choice(len(words), max(1, int(share * len(words))), replace=False):
        words[i] = f"z{r.integers(1e6)}"
    return " ".join(words)


def corpus(seed=3):
    r = rng(seed)
    texts = [prose(r, int(n)) for n in r.integers(1, 120, 60)]
    base = prose(r, 90)
    texts += [changed(r, base, s) for s in np.linspace(0.01, 0.2, 40)]  # around the threshold
    texts += [base] * 30 + [base.upper()]
    texts += ["", None, " \t\n", "one", "ONE", "one two", "one two", "\u0085 x", " ", "É é", "a " * 5000, "a b " * 3000]
    return list(enumerate(texts))


def test_links_match_all_pairs(spark):
    rows = corpus()
    for k in (2, 5):
        got = rows_of(near_duplicates(documents(spark, rows, extra=True), shingle_words=k), "doc_id")
        assert [tuple(r)[:4] for r in got] == brute(rows, k)


def test_large_bucket_of_near_copies(spark):
    """Hundreds of texts that share most shingles: buckets far above the size that is compared in full."""
    r = rng(5)
    base = prose(r, 60)
    rows = list(enumerate([changed(r, base, s) for s in r.choice([0.02, 0.05, 0.09, 0.15], 300)]))
    got = rows_of(near_duplicates(documents(spark, rows), shingle_words=2), "doc_id")
    assert [tuple(x)[:4] for x in got] == brute(rows, 2)


def test_defined_cases(spark):
    same = "one two three four five six"
    got = rows_of(near_duplicates(documents(spark, [(5, same), (5, same), (7, same), (None, same), (8, None), (9, "")]), shingle_words=5), "doc_id")
    assert [tuple(r)[:4] for r in got] == [(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (8, 0, 8, True), (9, 0, 9, True), (None, 2, None, True)]
    assert near_duplicates(documents(spark, [])).count() == 0


def test_sketch_fills_and_concentrates():
    t, seeds = 200, round_seeds(200)
    r = rng(7)
    for size in (1, 3, 50, 5000):
        a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        assert len(sketch(a, t, seeds)) == t and (sketch(a, t, seeds) == sketch(a.copy(), t, seeds)).all()
    common, own = r.integers(0, 2**63, 800).astype(np.uint64), r.integers(0, 2**63, 200).astype(np.uint64)
    a, b = np.unique(np.concatenate([common, own[:100]])), np.unique(np.concatenate([common, own[100:]]))
    agree = (sketch(a, t, seeds) == sketch(b, t, seeds)).mean()
    assert abs(agree - 0.8) < 6 * np.sqrt(0.8 * 0.2 / t)


def test_shingles_of_whole_text():
    cache = WordHashes()
    assert len(shingle_set("a b c d", 2, cache)) == 3 and len(shingle_set("a", 5, cache)) == 1 and not len(shingle_set(None, 2, cache))
    assert set(shingle_set("A  b\tC", 2, cache)) == set(shingle_set("a B c", 2, cache))


def test_strongest_links_connect_what_agrees():
    r = rng(8)
    agree = r.integers(0, 100, (40, 40))
    agree = np.maximum(agree, agree.T)
    agree[agree < 92] = -1
    component = r.integers(0, 25, 40)
    same = component[:, None] == component[None, :]
    agree[same] = 101
    edges = strongest_links(lambda i: agree[i], component)
    links = [(i, j) for i in range(40) for j in range(40) if agree[i, j] >= 0]
    assert all(not same[i, j] and agree[i, j] >= 92 for i, j in edges)
    joined = components(range(40), [*edges, *((i, j) for i, j in links if same[i, j])])
    assert joined == components(range(40), links) and len(edges) < 25
