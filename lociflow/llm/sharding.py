"""Sharding by a Feistel permutation with cycle walking over global row numbers, in DataFrame functions only.

Rows are numbered in the order of id and text, whatever their partitions. A keyed Feistel network permutes the grid of
high x low numbers, the smallest near-square one that holds them all. A number that falls outside the rows walks on
through the network until it is inside: fewer than `high` numbers lie outside, so a walk has fewer steps than that. Row
y of the shuffled order goes to shard y % shards, slot y div shards; both follow from a row's number alone, and
`row_number_at` leads back from shard and slot.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

ROUNDS, SHARDS, SEED = 6, 24, 13
#: Multipliers of the round function: odd and below 2^31, so that products with halves stay below 2^62.
FIRST, SECOND, LOW_BITS = 1_664_525_021, 1_103_515_245, (1 << 31) - 1


def round_keys(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:7], "big") for k in range(ROUNDS)]


def grid(n: int) -> tuple[int, int]:
    """(high, low): sides of the smallest near-square grid of n numbers or more, for n below 2^60."""
    high = math.isqrt(max(n, 1) - 1) + 1
    return high, max(1, -(-n // high))


def _scrambled(half: Column, key: Column, side: Column) -> Column:
    x = half * FIRST + key
    x = x.bitwiseXOR(F.shiftright(x, 29)).bitwiseAND(F.lit(LOW_BITS)) * SECOND
    return x.bitwiseXOR(F.shiftright(x, 27)) % side


def _pass(x: Column, n: int, seed: int, back: bool) -> Column:
    """One pass through the network over the grid of n, or back."""
    high, low = grid(n)
    steps = [(key, (high, low)[k % 2]) for k, key in enumerate(round_keys(seed))]
    rounds = F.array(*(F.struct(F.lit(key).cast("long").alias("key"), F.lit(side).cast("long").alias("side")) for key, side in (steps[::-1] if back else steps)))
    width = F.lit(low).cast("long")
    halves = F.struct(F.call_function("div", x, width).alias("u"), (x % width).alias("v"))

    def forth(s: Column, r: Column) -> Column:
        return F.struct(s["v"].alias("u"), ((s["u"] + _scrambled(s["v"], r["key"], r["side"])) % r["side"]).alias("v"))

    def undone(s: Column, r: Column) -> Column:
        return F.struct(F.pmod(s["v"] - _scrambled(s["u"], r["key"], r["side"]), r["side"]).alias("u"), s["u"].alias("v"))

    return F.aggregate(rounds, halves, undone if back else forth, lambda s: s["u"] * width + s["v"])


def shuffled(number: Column, n: int, seed: int = SEED, back: bool = False) -> Column:
    """The place of row `number` of n in the shuffled order; with back, the row at that place."""
    high, low = grid(n)
    if outside := high * low - n:
        walk = lambda y: F.aggregate(F.sequence(F.lit(1), F.lit(outside)), y, lambda z, _: F.when(z < n, z).otherwise(_pass(z, n, seed, back)))
        once = F.transform(F.array(_pass(number.cast("long"), n, seed, back)), lambda y: F.when(y < n, y).otherwise(walk(y)))
        return F.element_at(once, 1)
    return _pass(number.cast("long"), n, seed, back)


def row_number_at(shard: Column, slot: Column, n: int, shards: int = SHARDS, seed: int = SEED) -> Column:
    """The number of the row in this slot of this shard."""
    return shuffled(slot.cast("long") * shards + shard, n, seed, back=True)


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, shard, slot, ...keep) for every row of docs; the law of shards is `rows`.

    Shards differ by one row at most, slots of a shard are gapless from 0. A null text counts as an empty one; null ids
    come first in the numbering; rows that repeat id and text are rows of their own, and equal but for `keep`, so which
    of them gets which place doesn't show without it. keep names further columns of docs to carry along, which must not
    be named like the others. Groups of equal texts aren't kept together. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.col(c) for c in keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__text"), *kept)
    rows, n = numbered(rows, ["doc_id", "text_crc32", "size", "__text"], "row_number")
    placed = rows.drop("__text").withColumn("__place", shuffled(F.col("row_number"), n, seed))
    at = placed.withColumns({"shard": (F.col("__place") % shards).cast("int"), "slot": F.expr(f"__place div {shards}")})
    return at.select("doc_id", "size", "text_crc32", "row_number", "shard", "slot", *keep)


def shard_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): sharded's rows with the law that holds."""
    none = F.lit(None).cast("int").alias("grown_shard")
    return sharded(docs, **options).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", none)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, rows_a_file: int = 1_000_000, **options) -> None:
    """Write the columns of docs under path/shard=k, in files of consecutive slots whose rows are sorted by slot.

    A shard is split into files by slot, so a task holds rows_a_file rows at most, however large a shard is.
    """
    clash = [c for c in docs.columns if c in ("doc_id", "size", "text_crc32", "row_number", "shard", "slot")]
    own = docs.withColumnsRenamed({c: f"__own_{c}" for c in clash})
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    name = lambda c: f"__own_{c}" if c in clash else c
    placed = sharded(own, name(id_col), name(text_col), shards=shards, keep=tuple(own.columns), **options)
    parts = placed.withColumn("__file", F.expr(f"slot div {rows_a_file}"))
    dealt = parts.repartition("shard", "__file").sortWithinPartitions("shard", "slot")
    columns = [F.col(name(c)).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    dealt.select(*columns, "shard", "slot").write.partitionBy("shard").parquet(path)


def shard_sql(shards: int = SHARDS, seed: int = SEED) -> str:
    """DuckDB SQL of the query: the network as columns, the walk as a recursion, CRC-32 byte by byte through its table."""
    rounds, halves = [], ["u", "v"]
    for k, key in enumerate(round_keys(seed)):
        u, v = halves
        side = ("high", "low")[k % 2]
        rounds += [f"{v} * {FIRST} + {key} AS x{k}", f"(xor(x{k}, x{k} >> 29) & {LOW_BITS}) * {SECOND} AS y{k}", f"({u} + xor(y{k}, y{k} >> 27) % {side}) % {side} AS w{k}"]
        halves = [v, f"w{k}"]
    return f"""
WITH RECURSIVE table256 AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))
), rows AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), sized AS (
  SELECT doc_id, octet_length(b) + 8 AS size, xor(list_reduce(list_transform(regexp_extract_all(hex(b), '..'), lambda s: ('0x' || s)::BIGINT),
         lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM rows, table256
), numbers AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x, count(*) OVER () AS n FROM sized
), sides AS (
  SELECT *, ceil(n / high)::BIGINT AS low FROM (SELECT max(n) AS n, ceil(sqrt(max(n)))::BIGINT AS high FROM numbers)
), walk AS (
  SELECT x AS start, x AS y, 0 AS step FROM numbers
  UNION ALL
  SELECT start, {halves[0]} * low + {halves[1]} AS y, step + 1 AS step
  FROM (SELECT start, step, low, high, y // low AS u, y % low AS v, {", ".join(rounds)} FROM walk, sides WHERE step = 0 OR y >= n)
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (y % {shards})::INTEGER AS shard, (y // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM numbers JOIN walk ON x = start, sides WHERE step > 0 AND y < sides.n
"""
