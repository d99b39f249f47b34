import numpy as np

from lociflow.llm.licenses import ANCHORED, BAND, K, MIT_GRANT, NAMING, TEMPLATES, WINDOW, Templates, aligned, gram_hashes, license_report, winnowed, word_spans

from .helpers import documents, prose, rng, rows_of


def test_every_template_is_found_whole(spark):
    r = rng(1)
    rows = [(i, f"{prose(r, 40)}. {text}. {prose(r, 40)}") for i, (_, text) in enumerate(TEMPLATES)]
    got = rows_of(license_report(documents(spark, rows, extra=True)), "doc_id")
    for (i, text), r_ in zip(rows, got, strict=True):
        name, notice = TEMPLATES[i]
        a = text.index(notice.split('"')[0][:20])
        assert name in r_["licenses"].split(",") and r_["coverage"] >= 0.99
        assert any(s.startswith(f"{name}:{a}:") for s in r_["spans"].split(",")), (i, r_["spans"])


def test_changed_notices_are_found_and_prose_is_not(spark):
    r = rng(2)
    name, notice = "MIT", MIT_GRANT
    words = notice.split()
    for k in r.choice(len(words), len(words) // 10, replace=False):
        words[k] = "changed"
    rows = [(1, " ".join(words)), (2, prose(r, 500)), (3, None), (4, ""), (5, " ".join(notice.split()[:10])), (6, f"{notice} " * 50), (6, "All rights reserved. " * 8000)]
    out = license_report(documents(spark, rows)).collect()
    assert sorted(x["n_notices"] for x in out if x["doc_id"] == 6) == [50, 8000]  # a repeated id, each row for itself
    got = {x["doc_id"]: x for x in out}
    assert got[1]["licenses"] == name and 0.7 <= got[1]["coverage"] < 1
    assert [got[i]["n_notices"] for i in (2, 3, 4)] == [0, 0, 0]
    assert name not in got[5]["licenses"]


def test_winnowing_guarantee():
    r = rng(3)
    for _ in range(50):
        shared = [f"s{i}" for i in r.integers(0, 99, K + WINDOW - 1)]
        a, b = ([f"{x}{i}" for i in r.integers(0, 99, 20)] + shared + [f"{x}{i}" for i in r.integers(0, 99, 20)] for x in "ab")
        prints = [set(gram_hashes(t)[winnowed(gram_hashes(t))].tolist()) for t in (a, b)]
        assert prints[0] & prints[1]


def test_spans_are_code_points_and_empty_table(spark):
    text = "\U0001f600 \u00e9 All rights reserved."
    r = license_report(documents(spark, [(1, text)])).first()
    a, b = (int(x) for x in r["spans"].split(":")[1:])
    assert text[a:b] == "All rights reserved"
    assert license_report(documents(spark, [])).count() == 0
    assert Templates().scan("", 0.7) == [] and word_spans("a-b c")[0] == ["a-b", "c"] and np.size(winnowed(np.empty(0, np.uint64))) == 0


def test_short_notices_back_to_back():
    index = Templates()
    text = "x All rights reserved. y All rights reserved."
    assert [text[a:b] for _, _, a, b in index.scan(text, 0.7)] == ["All rights reserved"] * 2
    for name, notice in ((n, t.rstrip(".")) for n, t in TEMPLATES):
        for k in (2, 3, 40):
            text = f"{notice}.\n" * k
            assert [(n, text[a:b]) for n, _, a, b in index.scan(text, 0.7)] == [(name, notice)] * k, (notice, k)


def test_a_notice_needs_the_words_that_name_its_license():
    index = Templates()
    names = lambda text: [n for n, *_ in index.scan(f"Some words first. {text}. Some words last.", 0.7)]
    for text in (
        "Released under the BSD License", "Licensed under CC BY-ND 4.0", "Licensed under CC BY-NC 3.0", "This work is licensed under the GNU General Public License, version 1",
        "This work is licensed under the GNU Lesser General Public License, version 3", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
        "Licensed under the Apache License, Version 1.1",
    ):
        assert names(text) == [], text
    assert names("Licensed under CC BY-SA 4.0") == ["CC-BY-SA-4.0"] and names("This work is licensed under the GNU General Public License, version 2") == ["GPL-2.0"]
    assert names("Released under the BSD License. Released under the MIT License") == ["MIT"]
    assert names("Licensed under the Apache License, Version 2") == ["Apache-2.0"] and names("This work is licensed under the GNU General Public License, version 3.0") == ["GPL-3.0"]


def test_short_notices_with_any_other_word_changed_are_found():
    index = Templates()
    for name, notice in TEMPLATES:
        plain = [w.strip("(),.\"").lower() for w in notice.split()]
        if 4 < len(plain) < ANCHORED:
            for k, word in enumerate(plain):
                if word.removesuffix(".0") not in NAMING[name]:
                    for salt in range(10):
                        text = f"p{salt} " + " ".join([*notice.split()[:k], f"x{salt}", *notice.split()[k + 1 :]]) + f" q{salt}"
                        assert [n for n, *_ in index.scan(text, 0.7)] == [name], text


def plain_alignment(template, words, shift):
    """The best score of a local alignment within the band, cell by cell."""
    score, best = {}, 0
    for i in range(len(template)):
        for j in range(max(0, i + shift - BAND), min(len(words), i + shift + BAND + 1)):
            at = lambda a, b: score.get((a, b), 0)  # noqa: B023, E731
            score[i, j] = max(0, at(i - 1, j - 1) + (2 if template[i] == words[j] else -1), at(i - 1, j) - 1, at(i, j - 1) - 1)
            best = max(best, score[i, j])
    return best


def score_of(pairs):
    """A match counts 2, a mismatch or gap -1: between two matches, the longer of the two stretches."""
    return 2 * len(pairs) - sum(max(i2 - i - 1, j2 - j - 1) for (i, j), (i2, j2) in zip(pairs, pairs[1:], strict=False))


def test_banded_alignment_is_the_best_one():
    r = rng(9)
    for _ in range(200):
        template = r.integers(0, 12, int(r.integers(2, 40)))
        words = np.concatenate([r.integers(0, 12, int(r.integers(0, 10))), template, r.integers(0, 12, int(r.integers(0, 10)))])
        words = np.delete(words, r.integers(0, len(words), int(r.integers(0, 4))))
        shift = int(r.integers(-4, 12))
        pairs = aligned(template, words, shift)
        assert all(template[i] == words[j] and abs(j - i - shift) <= BAND for i, j in pairs) and pairs == sorted(set(pairs))
        assert score_of(pairs) == plain_alignment(template.tolist(), words.tolist(), shift)


def test_masked_words_match_nothing():
    template = np.array([0, 1, 2])
    assert aligned(template, np.array([-2, -2, -2]), 0) == [] and aligned(template, np.array([-1, 0, 1, 2]), 1) == [(0, 1), (1, 2), (2, 3)]
