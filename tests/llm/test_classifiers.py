import zlib

import numpy as np
import pytest

from lociflow.llm.quality import FEATURES, Discriminant, good_documents, quality_scores, statistics
from lociflow.llm.toxicity import ConvNet, toxicity_scores

from .helpers import documents, prose, rng, rows_of

LABELS = "doc_id long, quality int, toxic int"


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()


def junk(r, n):
    return " ".join("".join(r.choice(list("ABC#$%|!?019xyz"), 5)) for _ in range(n))


def corpus(seed=1, n=300):
    r = rng(seed)
    rows, labels = [], []
    for i in range(n):
        bad, toxic = bool(r.random() < 0.4), bool(r.random() < 0.4)
        text = junk(r, 60) if bad else prose(r, 60).replace(" ", ". ", 4)
        words = text.split()
        if toxic:
            for k in r.choice(len(words), 5, replace=False):
                words[k] = str(r.choice(["foul", "nasty", "vile", "rotten"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


@pytest.mark.parametrize("scores, label, folds, fold, cut", [(quality_scores, 1, 5, 0, 0.3), (toxicity_scores, 2, 3, 1, 0.7)])
def test_held_out_accuracy_and_contract(spark, scores, label, folds, fold, cut):
    rows, labels = corpus()
    odd = [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "word " * 20000), (None, "no id")]
    df = documents(spark, [*rows, *odd], extra=True)
    known = spark.createDataFrame([*labels, (1, None, None), (777777, 1, 1)], LABELS)
    got = rows_of(scores(df, known), "doc_id")
    assert [r["doc_id"] for r in got] == [i for i, _ in [*rows, *odd]]
    truth = {x[0]: x[label] for x in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert auc([truth[r["doc_id"]] for r in held], [r["score"] for r in held]) > 0.97
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold)
    empty = {r["score"] for r in got if r["doc_id"] in (9000, 9001, 9002)}
    assert len(empty) == 1


@pytest.mark.parametrize("scores", [quality_scores, toxicity_scores])
def test_held_out_labels_and_other_columns_do_not_matter(spark, scores):
    rows, labels = corpus(2, 120)
    folds, fold = (5, 0) if scores is quality_scores else (3, 1)
    flipped = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % folds == fold else (i, q, t) for i, q, t in labels]
    score = lambda some, by: [r["score"] for r in rows_of(scores(by, spark.createDataFrame(some, LABELS)), "doc_id")]
    df = documents(spark, rows)
    other = documents(spark, [(i, t, f"source {i % 7}") for i, t in rows], extra=True)
    assert score(labels, df) == pytest.approx(score(flipped, other), abs=1e-9)


@pytest.mark.parametrize("scores", [quality_scores, toxicity_scores])
def test_defined_cases(spark, scores):
    none = spark.createDataFrame([], LABELS)
    assert scores(documents(spark, []), none).count() == 0
    got = rows_of(scores(documents(spark, [(1, "a"), (1, "a"), (2, None)]), none), "doc_id")
    assert len(got) == 3 and got[0]["score"] == got[1]["score"]
    one_class = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], LABELS)
    assert scores(documents(spark, [(1, "a b"), (2, "c d")]), one_class).count() == 2


def test_discriminant_matches_densities():
    r = rng(4)
    d = len(FEATURES)
    x = [r.normal(size=(400, d)) * r.uniform(0.5, 2, d) + c for c in (0, 0.3)]
    model = Discriminant({c: (len(m), m.sum(0), m.T @ m) for c, m in enumerate(x)})
    at = r.normal(size=(20, d))
    want = model.prior
    covs = [np.linalg.inv(root.T @ root) for root in model.roots]
    logs = [-0.5 * np.linalg.slogdet(2 * np.pi * c)[1] - 0.5 * np.einsum("ij,jk,ik->i", at - m, np.linalg.inv(c), at - m) for c, m in zip(covs, model.means, strict=True)]
    assert model.scores(at) == pytest.approx(1 / (1 + np.exp(-(want + logs[1] - logs[0]))), rel=1e-6)
    assert (statistics(None) == 0).all() and len(statistics("a")) == d


def test_good_documents_keeps_what_scores_accept(spark):
    rows, labels = corpus(3, 150)
    df, known = documents(spark, rows, extra=True), spark.createDataFrame(labels, LABELS)
    want = [r["doc_id"] for r in rows_of(quality_scores(df, known), "doc_id") if r["predicted"]]
    kept = good_documents(df, known)
    assert kept.columns == df.columns and [r["doc_id"] for r in rows_of(kept, "doc_id")] == want


def test_network_gradient_learns_a_pair_of_words():
    """What only a filter of width 2 can tell: the order of two words."""
    from lociflow.llm.toxicity import WordCodes, coded

    cache, r = WordCodes(), rng(6)
    texts, y = [], []
    for k in range(300):
        words = [f"w{i}" for i in r.integers(0, 50, 12)]
        words[5:7] = ["good", "bad"] if k % 2 else ["bad", "good"]
        texts.append(coded(" ".join(words), cache))
        y.append(k % 2)
    net = ConvNet()
    net.start_from_odds(texts[:200], np.array(y[:200]))
    net.train(texts[:200], np.array(y[:200]), epochs=20)
    assert auc(y[200:], [net.raw(t) for t in texts[200:]]) > 0.95


def test_convolution_and_pooling_by_plain_loops():
    """Scores of a network with random filters: every window of every width, the largest value of each filter, the logistic output."""
    from lociflow.llm import toxicity as T

    net, cache = T.ConvNet(seed=11), T.WordCodes()
    for w in T.WIDTHS:
        net.p[f"b{w}"] = rng(w).normal(0, 0.3, T.FILTERS).astype(np.float32)
    net.p["bias"][0] = 0.25
    r = rng(12)
    for n in (0, 1, 2, 3, 40, 5000):  # above 4096 words the text goes in chunks
        codes = T.coded(" ".join(f"w{i}" for i in r.integers(0, 300, n)), cache)
        vectors = [np.concatenate([net.p["t0"][c & 0xFFFF], net.p["t1"][c >> 16 & 0xFFFF]]) for c in codes.tolist()]
        zero = np.zeros(2 * T.HALF, np.float32)
        total = float(net.p["bias"][0])
        for k, w in enumerate(T.WIDTHS):
            for f in range(T.FILTERS) if n else ():
                best = -np.inf
                for i in range(n):
                    window = [vectors[i + j] if i + j < n else zero for j in range(w)]
                    best = max(best, sum(float(x @ net.p[f"w{w}"][j][:, f]) for j, x in enumerate(window)))
                total += max(0.0, best + float(net.p[f"b{w}"][f])) * float(net.p["out"][k * T.FILTERS + f])
        assert net.raw(codes) == pytest.approx(total, abs=1e-3), n
        assert net.score(codes) == pytest.approx(1 / (1 + np.exp(-total - net.shift[T.language(codes)])), abs=1e-3)


def test_one_training_step_follows_the_numeric_gradient():
    """The output's and a filter's gradients, from the loss of one text at slightly moved parameters."""
    from lociflow.llm import toxicity as T

    codes = T.coded("a b c d e f g a b", T.WordCodes())
    loss = lambda net: float(np.log1p(np.exp(-net.raw(codes))))  # noqa: E731  label 1
    for name, at in (("out", (3,)), ("w2", (1, 4, 5)), ("b3", (7,))):
        net = T.ConvNet(seed=2)
        before, grads = net.p[name][at], []
        for h in (1e-2, -1e-2):
            net.p[name][at] = before + np.float32(h)
            grads.append(loss(net))
        slope = (grads[0] - grads[1]) / 2e-2
        net.p[name][at] = before
        net.train([codes], np.array([1]), epochs=1, batch=1, rate=1e-3)
        moved = float(net.p[name][at] - before)  # a first Adam step moves by the rate against the sign of the gradient
        assert abs(slope) < 1e-4 or np.sign(moved) == -np.sign(slope), name
