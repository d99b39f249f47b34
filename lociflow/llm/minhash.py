"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle is hashed to a value and to one of t bins, and a bin keeps its smallest value of the
first round that reaches it; after t rounds, round t + j sends every shingle to bin j, so every coordinate fills. For
two sets each coordinate agrees with probability J, and the fraction that agrees concentrates as if coordinates were
independent. Bands of `rows` coordinates make bucket keys; documents that share a bucket are candidates.

Links are exact: equal sets are one class from the start, classes are compared on their full sets, and a link is
confirmed only by 100 * intersection >= percent * union. Buckets are never expanded into all pairs. First the members
of a bucket are compared with one member of it, and the classes joined so far collapse. Then pairs of one small bucket
in different components are compared in full. In a large bucket sketches tell, by their concentration, which classes
may link with which larger component (a pair at similarity 0.8 fails with probability below 1e-8). The strongest
agreements that connect a bucket, one for each of its classes at most, are confirmed first, and what they link collapses
again. A class that may still link with another component is compared with every member of it, in blocks, by products of
incidence matrices. So a pair that shares a bucket is found whatever the size of the bucket. Sketches are compared for the members outside a bucket's largest
component only, so a bucket costs its size times the share of members that don't belong to its main group; a large bucket
of texts that share much but link with nothing is the case that stays quadratic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, release, spread_join, values, words_of, written
from .components import connected_components

MASK = (1 << 64) - 1
CACHED_WORDS = 100_000
SMALL_BUCKET = 32
PARTNERS = 256
BUCKET_BLOCK, SET_BLOCK, SET_BLOCK_SHINGLES, COLUMNS = 2048, 256, 200_000, 8192


class WordHashes(dict):
    """Word to 64-bit hash; emptied when it holds CACHED_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer words, of the whole sequence; else empty."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = min(k, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        s = mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(s)


def round_seeds(t: int) -> np.ndarray:
    return mixed(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def sketch(x: np.ndarray, t: int, seeds: np.ndarray) -> np.ndarray:
    """The t coordinates of a non-empty set of 64-bit hashes (t at most 255)."""
    out = np.zeros(t, np.uint64)
    open_bins = np.ones(t, bool)
    edges = np.arange(t + 1, dtype=np.uint64) << np.uint64(56)
    low = np.uint64((1 << 47) - 1)
    at, step = 0, max(1, min(t, -(-6 * t // len(x))))
    while at < t and open_bins.any():
        rounds = np.arange(at, min(at + step, t))
        h = mixed(x[None, :] ^ seeds[rounds, None])
        bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        key = np.sort(((bins << np.uint64(56)) | (rounds.astype(np.uint64)[:, None] << np.uint64(47)) | (h & low)).ravel())
        first = np.searchsorted(key, edges)
        new = (first[1:] > first[:-1]) & open_bins
        out[new] = key[first[:-1][new]]
        open_bins &= ~new
        at = rounds[-1] + 1
    for j in np.flatnonzero(open_bins):
        h = (mixed(x ^ seeds[t + j]) & low).min()
        out[j] = (np.uint64(j) << np.uint64(56)) | (np.uint64(t + j) << np.uint64(47)) | h
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) 64-bit bucket keys of (documents, bands * rows) coordinates."""
    s = sketches.reshape(len(sketches), bands, rows)
    key = np.broadcast_to(mixed(np.arange(bands, dtype=np.uint64) + np.uint64(77)), s.shape[:2])
    for j in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, j])
    return key


def document_sketches(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, bands: int, rows: int) -> DataFrame:
    """(id, text_key, n_shingles, set, keys, bits): set is a 128-bit name of the set, null for empty sets; bits has 8 bits of each coordinate."""
    t = bands * rows
    schema = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set", pa.binary()), ("keys", pa.list_(pa.int64())), ("bits", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seeds = WordHashes(), round_seeds(t)
        for batch in batches:
            sizes, names, keys, bits = [], [], [None] * len(batch), [None] * len(batch)
            sketches, at = [], []
            for i, text in enumerate(values(batch, "text")):
                s = shingle_set(text, shingle_words, cache)
                sizes.append(len(s))
                names.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    sketches.append(sketch(s, t, seeds))
                    at.append(i)
            if at:
                sketches = np.stack(sketches)
                for i, k, b in zip(at, band_keys(sketches, bands, rows).view(np.int64), (mixed(sketches) & np.uint64(255)).astype(np.uint8), strict=True):
                    keys[i], bits[i] = k, b.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), *(pa.array(x, f.type) for x, f in zip((sizes, names, keys, bits), list(schema)[2:], strict=True))], schema=schema)
        del cache
        release()

    slim = _slim(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    return slim.mapInArrow(work, "id long, text_key long, n_shingles long, set binary, keys array<long>, bits binary")


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def candidate_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """(node, shingles) for wanted(node, set, id): the sorted hashes of the set, from a text of that id that has this set, as ids may repeat."""
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            found = []
            for node, name, text in zip(batch.column("node").to_pylist(), batch.column("set").to_pylist(), values(batch, "text"), strict=True):
                shingles = shingle_set(text, shingle_words, cache).tobytes()
                if xxhash.xxh3_128_digest(shingles) == name:
                    found.append((node, shingles))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], schema=schema)
        del cache
        release()

    found = _slim(docs, id_col, text_col).join(wanted.select("node", "set", "id").hint("merge"), "id").select("node", "set", "text")
    return found.mapInArrow(work, "node binary, shingles binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of distinct candidate pairs(a, b), from their full sets.

    The partners of a are dealt into blocks. A block gets a's set once and then its partners' sets, one after another, so
    no task holds more than a batch however many partners there are.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("linked", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, b, raw in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), values(batch, "shingles"), strict=True):
                y = np.frombuffer(raw, np.uint64)
                if b is None:
                    x = y
                else:
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    found.append((a, b, 100 * inter >= percent * (len(x) + len(y) - inter)))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], s.type) for k, s in enumerate(schema)], schema=schema)
        release()

    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    blocks = counts.select("a", F.ceil(F.col("n") / PARTNERS).alias("blocks"))
    partners = spread_join(pairs, blocks, "a", hot_keys(counts, "a", pairs.count())).select("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), "b", F.col("b").alias("node"))
    heads = blocks.select("a", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.lit(None).cast("binary").alias("b"), F.col("a").alias("node"))
    units = partners.unionByName(heads).join(sets, "node").select("a", "block", "b", "shingles")
    return units.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first()).mapInArrow(work, "a binary, b binary, linked boolean")


def strongest_links(agree_with, component: np.ndarray) -> list[tuple[int, int]]:
    """Edges between different components of a maximum spanning forest: agree_with(i) tells how far each agrees with i, below 0 where they can't link."""
    m = len(component)
    best, link, open_ = np.full(m, -1), np.zeros(m, np.int64), np.ones(m, bool)
    edges = []
    for _ in range(m):
        i = int(np.argmax(np.where(open_, best, -2)))
        if best[i] >= 0 and component[i] != component[link[i]]:
            edges.append((i, int(link[i])))
        open_[i] = False
        agree = agree_with(i)
        nearer = open_ & (agree > best)
        best[nearer], link[nearer] = agree[nearer], i
    return edges


def suspects(at: DataFrame, percent: int, t: int) -> DataFrame:
    """(node, n, c, components, partners) for classes of a large bucket whose sketch may link with a class of a larger component.

    at(key, node, n, c, size, bits): members of buckets with their component and its size. Members of a bucket's largest
    component are only compared with: of a bucket, blocks of the others meet blocks of all. partners are the classes with
    which a spanning forest of the strongest agreements in such a pair of blocks connects the node.
    """
    share = percent / 100
    need = t * share - 6.5 * np.sqrt(t * share * (1 - share))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(zip(group["size"], group["c"], strict=True)))  # the order of components is the same in every block
        code = {c: i for i, (_, c) in enumerate(names)}
        order, n, asks = group["c"].map(code).to_numpy(), group["n"].to_numpy(), group["side"].to_numpy() == 0
        bits = np.frombuffer(b"".join(group["bits"]), np.uint8).reshape(len(group), t)
        fits = lambda i, k: 100 * np.minimum(n[k], n[i]) >= percent * np.maximum(n[k], n[i])
        found = []
        for i in np.flatnonzero(asks):
            other = np.flatnonzero(~asks & (order > order[i]) & fits(i, slice(None)))
            agree = (bits[other] == bits[i]).sum(1)
            if len(some := np.unique(order[other[agree >= need]])):
                found.append((group["node"].iat[i], n[i], group["c"].iat[i], [names[c][1] for c in some], []))
        if found:
            own = np.flatnonzero(~group["node"].duplicated().to_numpy())

            def agree_with(i: int) -> np.ndarray:
                agree = np.where(order[own] == order[own[i]], t + 1, (bits[own] == bits[own[i]]).sum(1))
                return np.where((agree >= need) & ((agree > t) | fits(own[i], own)), agree, -1)

            found += [(group["node"].iat[own[i]], n[own[i]], group["c"].iat[own[i]], [], [group["node"].iat[own[j]]]) for i, j in strongest_links(agree_with, order[own])]
        return pd.DataFrame(found, columns=["node", "n", "c", "components", "partners"])

    size = lambda col: F.ceil(col / BUCKET_BLOCK)
    parts = at.groupBy("key", "c").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    buckets = parts.groupBy("key").agg(F.max(F.struct("size", "c", "n")).alias("top"), F.sum("n").alias("n"))
    buckets = written(buckets.select("key", "n", F.col("top.c").alias("top"), size(F.col("n") - F.col("top.n")).alias("p"), size(F.col("n")).alias("q")), "buckets")
    total = buckets.agg(F.sum("n")).first()[0] or 0
    known = spread_join(at, buckets.drop("n"), "key", hot_keys(buckets, "key", total)).withColumn("asks", F.col("c") != F.col("top"))
    own = lambda k: F.pmod(F.xxhash64("node"), F.col(k))
    span = lambda k: F.explode(F.expr(f"sequence(0L, {k} - 1)"))
    cols = ["key", "node", "n", "c", "size", "bits"]
    asking = known.where("asks").select(*cols, F.lit(0).alias("side"), own("p").alias("i"), span("q").alias("j"))
    asked = known.select(*cols, F.lit(1).alias("side"), span("p").alias("i"), own("q").alias("j"))
    found = asking.unionByName(asked).groupBy("key", "i", "j").applyInPandas(work, "node binary, n long, c binary, components array<binary>, partners array<binary>")
    gathered = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    return found.groupBy("node").agg(F.first("n").alias("n"), F.first("c").alias("c"), gathered("components"), gathered("partners"))


def shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of one with each of two, by products of incidence matrices."""
    both = np.intersect1d(np.unique(np.concatenate(one)), np.unique(np.concatenate(two)), assume_unique=True)
    out = np.zeros((len(one), len(two)), np.float32)
    at = [[np.searchsorted(both, x[np.isin(x, both, assume_unique=True)]) for x in side] for side in (one, two)]
    for a in range(0, len(both), COLUMNS):
        dense = []
        for side in at:
            m = np.zeros((len(side), COLUMNS), np.float32)
            for k, x in enumerate(side):
                m[k, x[np.searchsorted(x, a) : np.searchsorted(x, a + COLUMNS)] - a] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def links_with(asked: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) for links of asked(node, n, component) with any class of that component, on full sets, in blocks.

    labels is (node, n, component).
    """
    n_blocks = lambda n, w: F.ceil(F.greatest(n / SET_BLOCK, w / SET_BLOCK_SHINGLES))
    left, right = asked, labels.select("component", "node", "n")
    blocks = lambda df, name: df.groupBy("component").agg(n_blocks(F.count(F.lit(1)), F.sum("n")).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
    counts = written(blocks(left, "p").join(blocks(right, "q"), "component"), "blocks")
    total = counts.agg(F.sum("n_p").alias("p"), F.sum("n_q").alias("q")).first()
    dealt = lambda df, k: spread_join(df, counts.select("component", "p", "q"), "component", hot_keys(counts.select("component", F.col(f"n_{k}").alias("n")), "component", total[k] or 0))
    own = lambda k: F.pmod(F.xxhash64("node"), F.col(k))
    span = lambda k: F.explode(F.expr(f"sequence(0L, {k} - 1)"))
    left = dealt(left, "p").select("component", "node", F.lit(0).alias("side"), own("p").alias("i"), span("q").alias("j"))
    right = dealt(right, "q").select("component", "node", F.lit(1).alias("side"), span("p").alias("i"), own("q").alias("j"))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        sides = [group[group["side"] == k] for k in (0, 1)]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame({"a": [], "b": []})
        sets = [[np.frombuffer(x, np.uint64) for x in side["shingles"]] for side in sides]
        inter = shared_counts(*sets)
        size = [np.array([len(x) for x in side]) for side in sets]
        union = size[0][:, None] + size[1][None, :] - inter
        i, j = np.nonzero(100 * inter >= percent * union)
        keep = np.unique(i, return_index=True)[1]  # one link of a class with the component joins them
        return pd.DataFrame({"a": sides[0]["node"].to_numpy()[i[keep]], "b": sides[1]["node"].to_numpy()[j[keep]]})

    return left.unionByName(right).join(sets, "node").groupBy("component", "i", "j").applyInPandas(work, "a binary, b binary")


def class_name(id_col: str, set_col: str):
    """The id in 8 bytes that sort like it, then the name of the set: the least name of a component begins with its least id."""
    return F.concat(F.unhex(F.lpad(F.hex(F.col(id_col).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), set_col)


def id_of(name: str):
    return (F.conv(F.hex(F.substring(name, 1, 8)), 16, 10).cast("decimal(20,0)") - F.expr("9223372036854775808BD")).cast("long")


def merged_components(links: DataFrame, of: DataFrame) -> DataFrame:
    """(node, component) of the components of(node, c) that links(a, b) of their nodes join: node is the name of the old one."""
    name = of.select("node", "c")
    joined = links.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return connected_components(joined.where("a <> b").distinct())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = 40, rows: int = 5
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key, component) for every row of docs.

    Two documents link if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest id
    reachable by links, itself included; kept is true for that row. A pair at similarity 0.8 shares none of the 40
    buckets with probability 1.3e-7. Null and blank texts have empty sets and link with nothing; rows with a null id
    link with nothing, have a null component_id and are kept. Rows that repeat an id are rows of their own: equal ones
    share component and verdict. component tells groups apart even where unlinked rows share an id (null for empty sets
    and null ids), and text_key, a hash of the text, such rows. An empty table gives an empty one; other columns of docs
    don't matter.
    """
    rows_ = written(document_sketches(docs, id_col, text_col, shingle_words, bands, rows), "sketches")
    classes = rows_.where("set is not null and id is not null").groupBy("set")
    classes = classes.agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n_shingles", "keys", "bits"))).withColumnRenamed("n_shingles", "n")
    classes = written(classes.withColumn("node", class_name("id", "set")), "classes")
    in_bands = classes.select("node", "n", F.explode("keys").alias("key"))
    full = in_bands.select("key").groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = written(in_bands.join(full, "key").select("key", "m", "node", "n"), "members")
    nodes = written(classes.drop("keys").join(members.select("node").distinct(), "node", "left_semi"), "nodes")
    sets = written(candidate_sets(docs, nodes, id_col, text_col, shingle_words), "sets")

    fits = f"least(n, o_n) * 100 >= greatest(n, o_n) * {percent}"
    first = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n")).alias("s"))
    first = first.select("key", F.col("s.node").alias("o"), F.col("s.n").alias("o_n"))
    stars = members.join(first, "key").where(f"node <> o and {fits}").select(F.col("o").alias("a"), F.col("node").alias("b")).distinct()
    tried = written(verified(written(stars, "pairs"), sets, percent), "stars")
    labels = nodes.select("node", "n").join(connected_components(tried.where("linked").select("a", "b")), "node", "left")
    labels = written(labels.withColumn("component", F.coalesce("component", "node")), "labels")
    n_nodes, sizes = labels.count(), labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    of = written(spread_join(labels.select("node", "component"), sizes.withColumnRenamed("n", "size"), "component", hot_keys(sizes, "component", n_nodes)).withColumnRenamed("component", "c"), "sizes")
    at = written(members.join(of, "node"), "labelled")
    split = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    at = written(at.join(split, "key", "left_semi"), "split")

    few = at.where(F.col("m") <= SMALL_BUCKET)
    other = few.select("key", F.col("node").alias("o"), F.col("n").alias("o_n"), F.col("c").alias("d"))
    pairs = few.join(other, "key").where(f"c < d and {fits}").select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).distinct()
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    compared = written(pairs.join(known, ["a", "b"], "left_anti"), "pairs")
    found = written(verified(compared, sets, percent), "verified").where("linked").select("a", "b")
    many = at.where(F.col("m") > SMALL_BUCKET)
    if not many.isEmpty():
        asked = written(suspects(many.join(nodes.select("node", "bits"), "node"), percent, bands * rows), "suspects")
        if not asked.isEmpty():
            strong = asked.select("node", F.explode("partners").alias("o")).select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).distinct()
            done = known.unionByName(compared)
            strong = written(verified(written(strong.join(done, ["a", "b"], "left_anti"), "strongest"), sets, percent), "strong").where("linked").select("a", "b")
            found = written(found.unionByName(strong), "found")
            root = written(merged_components(found, of), "merged")
            n_asked = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
            rooted = lambda df, c: spread_join(df, root.toDF(c, f"{c}_root"), c, hot_keys(n_asked.withColumnRenamed("component", c), c, n_nodes), "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
            rest = rooted(rooted(asked.select("node", "n", "c", F.explode("components").alias("component")), "component"), "c").where("c <> component")
            rest = written(rest.select("node", "n", "component").distinct(), "asked")
            if not rest.isEmpty():
                found = found.unionByName(written(links_with(rest, rooted(labels, "component"), sets, percent), "links"))
    merged = merged_components(found, of)
    labels = spread_join(labels.select("node", "component"), merged.toDF("component", "root"), "component", hot_keys(sizes, "component", n_nodes), "left")
    labels = labels.select("node", F.coalesce("root", "component").alias("component"))
    named = written(classes.select("set", "node").join(labels, "node", "left").select("set", F.coalesce("component", "node").alias("component")), "components")
    out = rows_.select("id", "text_key", "n_shingles", "set").join(named, "set", "left").withColumn("component", F.when(F.col("id").isNotNull(), F.col("component")))
    component = F.when(F.col("id").isNotNull(), F.coalesce(id_of("component"), "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "text_key", "component")
