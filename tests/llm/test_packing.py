import zlib
from collections import defaultdict

import numpy as np
import pytest

from lociflow.llm.packing import pack, packing_plan

from .helpers import documents, prose, rng, rows_of

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_places(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_pieces_are_the_tokens_and_places_are_gapless(spark):
    r = rng(2)
    odd = [
        "", None, " \n", "Hello, World!!! it's 3.14 \u2026 na\u00efve caf\u00e9.", "<|endoftext|> x <|STARTOFTEXT|>", "\u0130stanbul \u00dfcharf \u4e2d\u6587\u6587\u672c", "a.b,c;d:e!f?",
        "...", "x" * 3000, "\U0001f600 \U0001f600.", "e\u0301. a\u0301,", "\u00a0non\u00a0breaking\u2003space", "ABC! 12. \u00b2. \u00bd, \u2160;", "tab\tnew\u0085line\u2028sep",
        "\u0001control\u0000nul \ufffd", "\u0627\u0644\u0639\u0631\u0628\u064a\u0629.",
    ]
    texts = odd + [prose(r, int(n)) for n in r.integers(1, 400, 40)] + [prose(r, 9000)]
    got = rows_of(pack(documents(spark, list(enumerate(texts)), extra=True), PATH), "doc_id", "piece")
    want = []
    for i, ids in enumerate(plain_ids(texts)):
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[a : a + 4096], "<u4")
            want.append((i, k, a, len(part), zlib.crc32(part.tobytes())))
    assert [tuple(x)[:5] for x in got] == want
    check_places(got, 4096)


def test_plan_uses_few_bins():
    r = rng(4)
    for capacity, lengths in ((100, r.integers(1, 101, 3000)), (100, r.integers(1, 12, 3000)), (4096, np.clip(r.lognormal(5.5, 1.2, 20000), 1, 4096).astype(int)), (30, np.full(500, 11)), (30, np.array([30, 1]))):
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        plan = packing_plan(counts, capacity)
        rows, used = [], defaultdict(int)
        keys = list(zip(plan["length"].tolist(), plan["rank"].tolist(), strict=True))
        for length, n in counts.items():
            own = [j for j, key in enumerate(keys) if key[0] == length]
            for rank in range(n):
                j = max(j for j in own if keys[j][1] <= rank)
                k = rank - keys[j][1]
                rows.append({"sequence_id": plan["bin"][j] + k // plan["each"][j], "offset": plan["offset"][j] + k % plan["each"][j] * length, "length": length})
                used[rows[-1]["sequence_id"]] += length
        bins = check_places(rows, capacity)
        least = max(-(-int(lengths.sum()) // capacity), int((lengths > capacity / 2).sum()))
        assert bins <= best_fit_decreasing(lengths, capacity) * 1.01 + 1 and bins >= least


def best_fit_decreasing(lengths, capacity):
    """Bins that the plain rule needs, by a count of gaps."""
    gaps, bins = np.zeros(capacity + 1, int), 0
    for s in sorted(map(int, lengths), reverse=True):
        fit = np.flatnonzero(gaps[s:])
        if len(fit):
            g = s + int(fit[0])
            gaps[g] -= 1
            gaps[g - s] += 1
        else:
            bins += 1
            gaps[capacity - s] += 1
    return bins


def test_defined_cases(spark):
    got = rows_of(pack(documents(spark, [(1, "a"), (1, "a"), (None, "b c"), (2, None)]), PATH), "doc_id", "piece")
    assert [(r["doc_id"], r["piece"], r["length"]) for r in got] == [(1, 0, 2), (1, 0, 2), (2, 0, 1), (None, 0, 3)]
    check_places(got, 4096)
    assert pack(documents(spark, []), PATH).count() == 0
