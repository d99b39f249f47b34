"""The prefix trie of conversations: turn arrays range-sorted, adjacent common prefixes, a stack sweep that makes nodes.

A turn is a 16-byte digest of role and text. The turns of a conversation are cut into pieces of CHUNK turns, so that no
row grows with a conversation; a piece's sort key is its number, a 128-bit name of all turns before it, and its own
turns. Pieces with the same name before them are a group, and a group's sorted pieces are swept with one stack: the
common prefix with the row before tells which nodes close and which open.

Nodes on the path of a range's first or last piece are open: other ranges may hold more of them. The same is true of
nodes from which conversations go on in another piece. Such nodes are emitted in parts and stitched by their keys: parts
are added up, then each node's own share goes to all its ancestors in its group, and what a group holds goes up the tree
of groups by doubling.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, numbered, release, spread_join, values, written

CHUNK, DIGEST, BLOCK = 64, 16, 1024
COMPLETE, OPEN, END = 0, 1, 2
FIRST_TURNS, EVERY = 6, 100
NODE_COLUMNS = ("key", "parent", "depth", "conv", "n", "children", "leaves", "saved", "ends")

NODE = pa.schema(
    [("kind", pa.int8()), ("key", pa.binary()), ("parent", pa.binary()), ("up", pa.list_(pa.binary()))]
    + [(c, pa.int64()) for c in ("depth", "conv", "n", "children", "leaves", "saved", "chars")]
    + [("ends", pa.string())]
)
NODE_DDL = "kind byte, key binary, parent binary, up array<binary>, depth long, conv long, n long, children long, leaves long, saved long, chars long, ends string"


def rebuilt_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, convs): turns(conv, at, digest, chars, total) of the rebuilt conversations, convs(conv, total)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    named = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.unhex(F.substring(named, 1, 2 * DIGEST)).alias("digest"), F.length(text).cast("long").alias("chars"))
    rows, total = numbered(rows.where("conv is not null"), ["conv", "turn", "role", "digest"], "number")
    convs = written(rows.groupBy("conv").agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("n")), "conversations")
    first = F.col("conv") % EVERY == 0
    base = convs.where(first).select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % FIRST_TURNS
    plan = convs.withColumns({"base": F.col("conv") - F.col("conv") % EVERY, "head": head}).join(base, "base", "left")
    plan = plan.withColumn("before", F.least("head", F.coalesce("n_base", F.lit(0))))
    plan = written(plan.withColumn("total", F.col("before") + F.greatest(F.col("n") - F.col("head"), F.lit(0))), "plan")
    placed = spread_join(rows.select("conv", "number", "digest", "chars"), plan.select("conv", "start", "head", "before", "total"), "conv", hot_keys(convs, "conv", total))
    placed = written(placed.withColumn("at", F.col("number") - F.col("start")).drop("number", "start"), "placed")
    own = placed.where("at >= head").select("conv", (F.col("at") - F.col("head") + F.col("before")).alias("at"), "digest", "chars", "total")
    heads = placed.where(first & (F.col("at") < FIRST_TURNS)).select(F.col("conv").alias("base"), "at", "digest", "chars")
    lent = plan.where("before > 0").select("base", "conv", "before", "total").join(heads, "base").where("at < before").select("conv", "at", "digest", "chars", "total")
    return own.unionByName(lent), plan.select("conv", "total")


def pieces(turns: DataFrame, convs: DataFrame, chunk: int) -> DataFrame:
    """(piece, f1, f2, path, conv, chars, goes_on, g1, g2): f1 and f2 name all turns before the piece, g1 and g2 those after it as well."""
    z = lambda seed: F.xxhash64("at", "digest", F.lit(seed))
    turns = turns.withColumns({"piece": F.expr(f"at div {chunk}"), "z1": z(1), "z2": z(2)})
    cut = turns.groupBy("conv", "piece").agg(F.sort_array(F.collect_list(F.struct("at", "digest", "chars"))).alias("t"), F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"), F.max("total").alias("total"))
    path = F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["digest"])), ""))
    cut = cut.select("conv", "piece", path.alias("path"), F.col("t.chars").alias("chars"), "z1", "z2", (F.col("total") > (F.col("piece") + 1) * chunk).alias("goes_on"), (F.col("total") > chunk).alias("long"))
    cut = written(cut, "pieces")
    none = F.lit(0).cast("long")
    short = cut.where("not long").withColumns({"f1": none, "f2": none})
    silent = convs.where("total = 0").select("conv", none.alias("piece"), F.lit(b"").alias("path"), F.array().cast("array<bigint>").alias("chars"), none.alias("z1"), none.alias("z2"), F.lit(False).alias("goes_on"), F.lit(False).alias("long"), none.alias("f1"), none.alias("f2"))
    longer = cut.where("long").withColumn("block", F.expr(f"piece div {BLOCK}"))
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    xor = lambda c, w: F.coalesce(F.bit_xor(c).over(w), none)
    blocks = longer.groupBy("conv", "block").agg(F.bit_xor("z1").alias("b1"), F.bit_xor("z2").alias("b2"))
    blocks = blocks.withColumns({f"e{k}": xor(f"b{k}", earlier("conv", "block")) for k in (1, 2)}).drop("b1", "b2")
    inside = longer.withColumns({f"i{k}": xor(f"z{k}", earlier("conv", "block", "piece")) for k in (1, 2)})
    longer = inside.join(blocks, ["conv", "block"]).withColumns({f"f{k}": F.col(f"i{k}").bitwiseXOR(F.col(f"e{k}")) for k in (1, 2)})
    out = short.unionByName(silent).unionByName(longer.select(*short.columns))
    return out.withColumns({f"g{k}": F.col(f"f{k}").bitwiseXOR(F.col(f"z{k}")) for k in (1, 2)}).drop("z1", "z2", "long")


def group_key(piece: int, f1: int, f2: int) -> bytes:
    return hashlib.blake2b(b"%d:%d:%d" % (piece, f1, f2), digest_size=DIGEST).digest()


class Node:
    """An open node: sums over what has closed below it."""

    __slots__ = ("key", "chars", "conv", "n", "children", "leaves", "saved", "ends", "open")

    def __init__(self, key: bytes, chars: int, is_open: bool):
        self.key, self.chars, self.open = key, chars, is_open
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends = array("q")


class Sweep:
    """Turns sorted pieces of a range into rows of NODE."""

    def __init__(self, chunk: int):
        self.chunk, self.group, self.path, self.stack, self.out = chunk, None, b"", [], []

    def add(self, piece: int, f1: int, f2: int, path: bytes, conv: int, chars: list[int], goes_on: bool, g1: int, g2: int) -> None:
        first = self.group is None
        if (piece, f1, f2) != self.group:
            self.close_to(-1)
            self.group, self.path = (piece, f1, f2), b""
            self.stack.append(Node(group_key(piece, f1, f2), 0, first or piece > 0))
        common = 0
        if path != self.path:
            most = min(len(path), len(self.path))
            while common < most and path[common : common + DIGEST] == self.path[common : common + DIGEST]:
                common += DIGEST
            common //= DIGEST
            self.close_to(common)
            for d in range(common, len(path) // DIGEST):
                if d + 1 == self.chunk:  # the root of the group in which its conversations go on
                    key = group_key(piece + 1, g1, g2)
                else:
                    key = hashlib.blake2b(self.stack[-1].key + path[d * DIGEST : (d + 1) * DIGEST], digest_size=DIGEST).digest()
                self.stack.append(Node(key, chars[d], first))
            self.path = path
        top = self.stack[-1]
        top.n += 1
        top.conv = conv if top.conv is None else min(conv, top.conv)
        if goes_on:
            top.open = True
        else:
            top.ends.append(conv)

    def close_to(self, depth: int, is_open: bool = False) -> None:
        """Close the nodes deeper than depth in their group."""
        piece = self.group[0] if self.group else 0
        while len(self.stack) > depth + 1:
            node = self.stack.pop()
            below = self.stack[-1] if self.stack else None
            level = piece * self.chunk + len(self.stack)
            if is_open or node.open:
                up = [x.key for x in self.stack]
                n = 0 if piece and below is None else node.n  # a group's root has its members in the group above
                self.out.append((OPEN, node.key, below.key if below else None, up, level, node.conv, n, node.children, node.leaves, node.saved, node.chars, None))
                self.out += [(END, node.key, None, None, None, c, *[None] * 6) for c in node.ends]
                if below:
                    below.open = True
            else:
                leaves, saved = node.leaves + (not node.children), node.saved + (node.n - 1) * node.chars
                ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
                self.out.append((COMPLETE, node.key, below.key if below else None, None, level, node.conv, node.n, node.children, leaves, saved, node.chars, ends))
                if below:
                    below.children += 1
                    below.leaves += leaves
                    below.saved += saved
            if below:
                below.n += node.n
                below.conv = node.conv if below.conv is None else min(below.conv, node.conv)

    def taken(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.out), 10_000):
            rows = self.out[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(NODE)], schema=NODE)
        self.out = []


def swept(rows: DataFrame, chunk: int) -> DataFrame:
    """Complete nodes, parts of open ones and the ends of these, from pieces in any order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(chunk)
        for batch in batches:
            for row in zip(*(values(batch, c) for c in columns), strict=True):
                sweep.add(*row)
                if len(sweep.out) >= 50_000:
                    yield from sweep.taken()
        sweep.close_to(-1, is_open=True)
        yield from sweep.taken()
        release()

    columns = ["piece", "f1", "f2", "path", "conv", "chars", "goes_on", "g1", "g2"]
    by = ["piece", "f1", "f2", "path", "conv"]
    ranges = rows.select(*columns).repartitionByRange(*by).sortWithinPartitions(*by)
    return ranges.mapInArrow(work, NODE_DDL)


def end_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends) for ends(key, conv): the SHA-256 of the sorted ids, streamed, as a digest can only be made in order."""
    schema = pa.schema([("key", pa.binary()), ("ends", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, found = None, None, []
        for batch in batches:
            for k, conv in zip(values(batch, "key"), values(batch, "conv"), strict=True):
                if k != key:
                    if sha:
                        found.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(b"%d" % conv)
                else:
                    sha.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], c.type) for i, c in enumerate(schema)], schema=schema)
            found = []
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], schema=schema)

    return ends.select("key", "conv").repartition("key").sortWithinPartitions("key", "conv").mapInArrow(work, "key binary, ends string")


def stitched(found: DataFrame) -> DataFrame:
    """The open nodes of swept's rows, whole: (key, parent, depth, conv, n, children, leaves, saved, ends)."""
    below = F.col("parent").isNull() & (F.col("depth") > 0)  # the root of a group: conversations go on from its node
    first = [F.max(c).alias(c) for c in ("parent", "up", "depth", "chars")] + [F.max(below).alias("below"), F.min("conv").alias("conv")]
    parts = found.where(F.col("kind") == OPEN).groupBy("key").agg(*first, *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")))
    parts = written(parts, "open")
    more = parts.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    parts = parts.join(more, "key", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more")
    own_leaves = F.col("leaves") + F.when(F.col("children") == 0, 1).otherwise(0)
    parts = parts.withColumns({"leaves": own_leaves, "saved": F.col("saved") + (F.col("n") - 1) * F.col("chars")})
    parts = written(parts.join(end_hashes(found.where(F.col("kind") == END)), "key", "left"), "parts")
    to_each = lambda df, keys: df.select(F.explode(keys).alias("key"), "leaves", "saved")
    summed = lambda df: df.groupBy("key").agg(F.sum("leaves").alias("all_leaves"), F.sum("saved").alias("all_saved"))
    sums = written(summed(to_each(parts, F.concat("up", F.array("key")))), "sums")
    groups = parts.where("below").join(sums, "key").select("key", "up", (F.col("all_leaves") - F.col("leaves")).alias("leaves"), (F.col("all_saved") - F.col("saved")).alias("saved"))
    groups = written(groups, "groups")
    if not groups.isEmpty():
        deep = to_each(with_groups_below(groups), "up")
        sums = summed(deep.unionByName(sums.withColumnsRenamed({"all_leaves": "leaves", "all_saved": "saved"})))
    whole = parts.drop("leaves", "saved").join(sums.withColumnsRenamed({"all_leaves": "leaves", "all_saved": "saved"}), "key")
    return whole.select(*NODE_COLUMNS)


def with_groups_below(groups: DataFrame) -> DataFrame:
    """groups(key, up, leaves, saved) with the sums over all groups below added, by doubling the distance to the group above."""
    at = groups.select("key", F.element_at("up", 1).alias("above"), "leaves", "saved")
    at = at.join(groups.select(F.col("key").alias("above"), F.lit(True).alias("known")), "above", "left").withColumn("above", F.when(F.col("known"), F.col("above"))).drop("known")
    at = written(at.select("key", "above", "leaves", "saved"), "groups")
    while not at.where("above is not null").isEmpty():
        gain = at.where("above is not null").groupBy(F.col("above").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        jump = at.select(F.col("key").alias("above"), F.col("above").alias("next"))
        none = F.lit(0)
        at = at.join(gain, "key", "left").join(jump, "above", "left")
        at = written(at.select("key", F.col("next").alias("above"), (F.col("leaves") + F.coalesce("l", none)).alias("leaves"), (F.col("saved") + F.coalesce("s", none)).alias("saved")), "groups")
    return at.drop("above").join(groups.select("key", "up"), "key")


def prefix_trie(conversations: DataFrame, chunk: int = CHUNK, **columns) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    Turns of one number are ordered by role and digest, turns without a number come first; repeated rows are turns of
    their own. Null roles and texts are empty strings. Rows without a conversation's id belong to none and don't count.
    A conversation without turns of its own can't occur; one that keeps none when rebuilt ends at the root. An empty
    table has no nodes, not even a root. Other columns don't matter. ends_sha256 of a node at which a third of all
    conversations end is one task's work, as a digest over sorted ids can only be made in order; it's streamed.
    """
    turns, convs = rebuilt_turns(conversations, **columns)
    found = written(swept(pieces(turns, convs, chunk), chunk), "nodes")
    nodes = found.where(F.col("kind") == COMPLETE).select(*NODE_COLUMNS).unionByName(stitched(found))
    nodes = written(nodes, "whole")
    counts = nodes.select(F.col("key").alias("parent"), F.col("children").alias("n"))
    of = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    named = spread_join(nodes, of, "parent", hot_keys(counts, "parent", nodes.count()), "left")
    ends = F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest()))
    return named.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), ends.alias("ends_sha256")
    )


#: DuckDB SQL of the query: nodes are the distinct lists of turns, and every node's share goes to the nodes on its path.
TRIE_SQL = """
WITH crc AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(sha256(length(role) || ':' || role || text), 32)) - 1 AS pos, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS base, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
         lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id), crc
), lent AS (
  SELECT c.conv_id, t.pos AS k, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
), rebuilt AS (
  SELECT * FROM lent
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + (SELECT count(*) FROM lent l WHERE l.conv_id = c.conv_id), t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h
), lists AS (
  SELECT c.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY r.k) FILTER (WHERE r.k IS NOT NULL), []) AS path
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), members AS (
  SELECT conv_id AS member, d AS depth, path[1:d] AS prefix, len(path) = d AS at_end FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM lists)
), nodes AS (
  SELECT min(member) AS conv_id, depth, prefix, count(*) AS n_convs, sha256(coalesce(string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (WHERE at_end), '')) AS ends_sha256,
         coalesce((count(*) - 1) * length(prefix[depth].text), 0) AS own
  FROM members GROUP BY depth, prefix
), of_member AS (
  SELECT m.member, n.conv_id, n.depth FROM members m JOIN nodes n ON m.depth = n.depth AND m.prefix = n.prefix
), parents AS (
  SELECT n.*, m.conv_id AS parent_conv_id FROM nodes n LEFT JOIN of_member m ON m.member = n.conv_id AND m.depth = n.depth - 1
), families AS (
  SELECT p.*, (SELECT count(*) FROM parents c WHERE c.depth = p.depth + 1 AND c.parent_conv_id = p.conv_id) AS n_children FROM parents p
), sums AS (
  SELECT m.conv_id, m.depth, sum((f.n_children = 0)::INTEGER) AS n_leaves, sum(f.own) AS saved
  FROM families f JOIN of_member m ON m.member = f.conv_id AND m.depth <= f.depth GROUP BY m.conv_id, m.depth
)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM families f JOIN sums s ON s.conv_id = f.conv_id AND s.depth = f.depth
"""
