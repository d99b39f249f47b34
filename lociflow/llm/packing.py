"""Best-fit packing of tokenised documents into sequences of fixed capacity, planned on the histogram of lengths.

Lengths are whole numbers from 1 to the capacity, so a histogram of at most `capacity` counts says all that packing
needs. The plan is made on it: pieces longer than a third of the capacity are matched greedily, at most two to a bin,
the largest with the largest that still fits; shorter ones, longest first, go to the smallest gap that holds them, and
new bins open only when no gap does. Equal bins are handled together as intervals of bin numbers, so the plan's size
depends on the capacity alone, not on the corpus. Pieces then take their places by their rank within their length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, values, written

END_ID = 1
#: Words that a Python worker keeps, and bytes of text whose words it looks up together.
CACHED_WORDS, TEXT_BLOCK = 1_000_000, 12_000_000
RANK_BITS = 44
FINAL_MARKS = b".,;:!?"


def ends_plain(word: bytes) -> bool:
    """Whether the last character is a letter or digit that lower-casing leaves one."""
    last = word[-4:].decode("utf-8", "replace")[-1:]
    return last.isalnum() and last < "\u0130"


class WordTokens:
    """Token ids of white-space separated chunks, by a lower-casing word-end tokenizer that never joins across white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        self.kind = np.dtype("<u2" if len(self.ends_word) <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}  # word to its ids' bytes

    def encoded(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each word; words of plain letters are one pre-token each, so they are encoded together and told apart by word ends."""
        plain = [w for w in words if w.isalpha() and max(w) < "\u0130"]
        out: dict[str, list[int]] = {}
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(plain) and ends[-1] == len(ids):
                flat = ids.tolist()
                out = {w: flat[a:b] for w, a, b in zip(plain, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)}
        rest = [w for w in words if w not in out]
        out.update(zip(rest, (e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        return out

    def learned(self, words: list[bytes]) -> list[bytes]:
        """Adds words and returns the new ones; final marks are a pre-token of their own after a letter or digit, so such words are put together."""
        new = list(set(words).difference(self.known))
        cores = [w.rstrip(FINAL_MARKS) for w in new]
        pairs = [(c, w[len(c) :]) if len(c) < len(w) and ends_plain(c) else (w, b"") for w, c in zip(new, cores, strict=True)]
        parts = list({x for pair in pairs for x in pair if x}.difference(self.known))
        names = [x.decode("utf-8", "replace") for x in parts]
        found = self.encoded(names)
        self.known.update((x, np.array(found[name], self.kind).tobytes()) for x, name in zip(parts, names, strict=True))
        self.known.update((w, self.known[c] + self.known[m]) for w, (c, m) in zip(new, pairs, strict=True) if m)
        return list({*new, *parts})

    def many(self, texts: Iterator[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order, then END_ID.

        Texts go in blocks, so that a block's new words are encoded together. Words stay known while there are fewer than
        CACHED_WORDS: frequent ones come early.
        """
        block, size = [], 0
        for text in texts:
            raw = text.encode("utf-8", "replace") if text else b""
            block.append((raw if b"<|" in raw else raw.lower()).split())  # the names of special tokens are told by case
            size += len(raw) + 1
            if size >= TEXT_BLOCK:
                yield from self._of_block(block)
                block, size = [], 0
        yield from self._of_block(block)

    def _of_block(self, block: list[list[bytes]]) -> Iterator[np.ndarray]:
        full = len(self.known) >= CACHED_WORDS
        new = self.learned(list(set().union(*block))) if block else []
        get = self.known.__getitem__
        for words in block:
            yield np.append(np.frombuffer(b"".join(map(get, words)), self.kind), self.kind.type(END_ID))
        for w in new if full else ():
            del self.known[w]

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.many(iter([text])))


@cache
def word_tokens(path: str) -> WordTokens:
    """One for each Python worker, which serves many tasks."""
    return WordTokens(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and END_ID, cut only where longer than capacity."""

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_path)
        for batch in batches:
            row, start, length, crc = [], [], [], []
            for i, ids in enumerate(tokens.many(values(batch, "text"))):
                ids = ids.astype("<u4")
                for a in range(0, len(ids), capacity):
                    part = ids[a : a + capacity]
                    row.append(i)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            start = np.array(start, np.int64)
            columns = (pa.array((start // capacity).astype(np.int32)), pa.array(start), pa.array(length, pa.int64()), pa.array(crc, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *columns], schema=schema)
        release()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packing_plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Moves over equal pieces: rank r from `rank` on of that length goes to bin + (r - rank) // each, place offset + ((r - rank) % each) * length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    used = np.zeros(capacity + 1, np.int64)
    moves: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def put(length: int, n: int, first_bin: int, each: int, offset: int) -> None:
        moves.append((length, int(used[length]), first_bin, each, offset))
        used[length] += n
        left[length] -= n

    for a in range(capacity, capacity // 3, -1):
        while left[a]:
            fit = np.flatnonzero(left[capacity // 3 + 1 : min(a, capacity - a) + 1])
            b = int(fit[-1]) + capacity // 3 + 1 if len(fit) else 0
            if b == a and left[a] < 2:
                fit = fit[:-1]
                b = int(fit[-1]) + capacity // 3 + 1 if len(fit) else 0
            n = int(left[a] if not b else left[a] // 2 if b == a else min(left[a], left[b]))
            put(a, n, bins, 1, 0)
            if b:
                put(b, n, bins, 1, a)
            if capacity - a - b:
                gaps.setdefault(capacity - a - b, []).append((bins, n))
            bins += n
    held = np.zeros(capacity + 1, bool)
    held[list(gaps)] = True
    for s in range(capacity // 3, 0, -1):
        for g in [int(x) + s for x in np.flatnonzero(held[s:])] if left[s] else []:
            each, rest = g // s, []
            for first, m in gaps.pop(g):
                full = min(m, int(left[s]) // each)
                over = min(int(left[s]) - full * each, each) if full < m else 0
                for at, n, k in ((first, full, each), (first + full, 1 if over else 0, over)):
                    if n:
                        put(s, n * k, at, k, capacity - g)
                        if g - k * s:
                            gaps.setdefault(g - k * s, []).append((at, n))
                            held[g - k * s] = True
                if m - full - bool(over):
                    rest.append((first + full + bool(over), m - full - bool(over)))
            held[g] = g in gaps or bool(rest)
            if rest:
                gaps.setdefault(g, []).extend(rest)
            if not left[s]:
                break
        if left[s]:
            each = capacity // s
            for n, k in ((int(left[s]) // each, each), (1, int(left[s]) % each)):
                if n and k:
                    put(s, n * k, bins, k, 0)
                    if capacity - k * s:
                        gaps.setdefault(capacity - k * s, []).append((bins, n))
                        held[capacity - k * s] = True
                    bins += n
    table = np.array(sorted(moves), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "bin", "each", "offset"), table.T, strict=True))


def ranked_by_length(pieces: DataFrame, total: int) -> DataFrame:
    """pieces with rank: numbers from 0 within each length, counted in parts so that no length fills one task."""
    parts = max(64, -(-total // 50_000))
    keyed = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    bases = keyed.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select("length", "part", before.alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start"))
    return keyed.withColumn("inside", inside).join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("inside") - 1).drop("part", "inside", "base")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds END_ID alone. Rows that repeat an id are packed each for itself; a null
    id stays null. An empty table gives an empty one. Other columns of docs don't matter. The tokenizer must not join
    across white space; its file is read from tokenizer_path on every executor.
    """
    pieces = written(token_pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = packing_plan(counts, capacity)
    keys = (plan["length"] << RANK_BITS) + plan["rank"]
    shipped = docs.sparkSession.sparkContext.broadcast((keys, plan))  # its size depends on the capacity alone

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, plan = shipped.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(keys, (length << RANK_BITS) + rank, "right") - 1
            r = rank - plan["rank"][at]
            batch["sequence_id"] = plan["bin"][at] + r // plan["each"][at]
            batch["offset"] = plan["offset"][at] + r % plan["each"][at] * length
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch.drop(columns="rank")

    ranked = ranked_by_length(pieces, sum(counts.values())).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInPandas(work, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
