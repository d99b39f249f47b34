import hashlib
import math
import zlib
from collections import defaultdict

import pytest

from lociflow.llm.trie import prefix_trie

from .helpers import rng, with_clashing_names

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0, role.encode(), digest), (role, text)))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    members = defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, d == len(path)))
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = set()
    for p, ms in members.items():
        ends = ",".join(map(str, sorted(c for c, e in ms if e)))
        parent = min(c for c, _ in members[p[:-1]]) if p else None
        out.add((min(c for c, _ in ms), len(p), parent, len(ms), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def as_set(df):
    rows = df.select(*COLUMNS).collect()
    out = {tuple(r) for r in rows}
    assert len(out) == len(rows)
    return out


def talk(seed, n=160):
    """Conversations from few different turns, so that prefixes are shared and whole conversations repeat; some are long."""
    r = rng(seed)
    rows = []
    for c in [*range(-3, n), *range(700, 703), 1000]:
        length = int(r.integers(1, 9)) if r.random() < 0.9 else int(r.integers(20, 60))
        same = r.random() < 0.6
        for t in range(length):
            text = f"turn {t}" if same else "é" * int(r.integers(0, 3)) + "x"
            rows.append((c, t if r.random() < 0.95 else None, "user" if t % 2 == 0 else "assistant", text))
    return [*rows, (None, 1, "user", "no id"), (5, 0, "user", "twice"), (5, 0, "user", "twice"), (6, 2, None, None), (6, 2, "", ""), (7, 3, "u", "\U0001f600")]


@pytest.mark.parametrize(("chunk", "parts"), [(64, 4), (2, 4), (3, 13), (7, 1)])
def test_against_brute_force(spark, chunk, parts):
    rows = talk(chunk)
    df = with_clashing_names(spark.createDataFrame(rows, TURNS)).repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = as_set(prefix_trie(df, chunk=chunk))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain(rows)
    assert got == want and len(want) > 200


def test_groups_of_long_copies_over_many_pieces(spark):
    """Two long conversations that part late, a third that ends where a piece ends, and copies that fill whole ranges."""
    rows = [(c, t, "user", f"t{t}" if t < 150 or c == 101 else f"own {c} {t}") for c, n in ((101, 200), (102, 200), (103, 128), (104, 151)) for t in range(n)]
    rows += [(c, t, "a", f"same {t}") for c in range(200, 290) for t in range(4)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert as_set(prefix_trie(spark.createDataFrame(rows, TURNS), chunk=4)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_defined_cases(spark):
    assert prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], TURNS)).count() == 0
    bare = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)  # keeps no turn and has no conversation 0 to borrow from
    got = as_set(prefix_trie(spark.createDataFrame([(bare, 0, "user", "x")], TURNS)))
    assert got == {(bare, 0, None, 1, 0, 1, 0, hashlib.sha256(str(bare).encode()).hexdigest())}
    long = [(1, 0, "u", "word " * 200_000), (2, 0, "u", "word " * 200_000), (2, 1, "u", None)]
    assert as_set(prefix_trie(spark.createDataFrame(long, TURNS))) == plain(long)
