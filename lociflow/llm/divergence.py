"""Audit of how the sources of a language differ in their words, by sort-based streaming.

Documents become runs in the order (lang, term, source, document): each task sorts what it holds and scans it for run
lengths before anything is shuffled, so a frequent word sends a row for each chunk of documents, not for each document.
The runs are dealt by (lang, term), sorted and scanned again. That scan holds a run and the sources of a term until the
term has enough documents, and no more. Another scan over the kept terms emits partial sums for pairs of sources, and
the leading terms of each run of terms.

A pair's value is a sum over all kept terms, but most sources lack most terms. With p0 the share of an absent term,
    sum f(p, q) = V f(p0, q0) + sum over a's terms (f(p, q0) - f(p0, q0)) + the same for b's + a correction for common terms,
so only terms that two sources share meet in pairs; the one-sided sums go by the distinct values of p.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, release, spread_join, values, written

#: Bytes that end terms become spaces; A-Z become a-z; those of other characters stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Occurrences that a task sorts at once, words whose numbers it keeps, sources of a language that a block of pairs has.
CHUNK, CACHED_TERMS, BLOCK = 1 << 21, 300_000, 64
SCALE = 1_000_000_000
RUN = ["lang", "term", "source"]
#: Kinds of scanned rows: a source of a language, a source's count of a kept term, a language's count of it.
GROUP, COUNT, TOTAL = 0, 1, 2


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


class TermIds(dict):
    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def document_runs(docs: DataFrame) -> DataFrame:
    """(lang, term, source, df, n): sorted runs of docs(doc, lang, source, text), a run for a task's chunk of documents at most.

    df is the run's number of documents, n of occurrences. A run of the empty term says that the language has the source.
    """
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("df", pa.int64()), ("n", pa.int64())])

    def runs(found: list[tuple[str, str, int, np.ndarray]], ids: TermIds) -> Iterator[pa.RecordBatch]:
        found.sort(key=lambda d: d[:3])
        n_docs = len(found)
        sizes = np.array([len(d[3]) for d in found])
        keys = np.concatenate([d[3] for d in found]).astype(np.int64) * n_docs + np.repeat(np.arange(n_docs), sizes)
        keys.sort()
        same_group = np.array([False] + [found[i][:2] == found[i - 1][:2] for i in range(1, n_docs)])
        group = np.cumsum(~same_group) - 1
        first = np.flatnonzero(~same_group)
        group_docs = np.diff(np.append(first, n_docs))
        new_doc = np.ones(len(keys), bool)
        new_doc[1:] = keys[1:] != keys[:-1]
        term, doc = np.divmod(keys, n_docs)
        new_run = np.ones(len(keys), bool)
        new_run[1:] = (term[1:] != term[:-1]) | (group[doc[1:]] != group[doc[:-1]])
        start = np.flatnonzero(new_run)
        df = np.add.reduceat(new_doc.astype(np.int64), start) if len(start) else np.empty(0, np.int64)
        n = np.diff(np.append(start, len(keys)))
        lang, source = (pa.array([found[i][k] for i in first], pa.string()) for k in (0, 1))
        words = pa.array([""] + [w.decode("utf-8", "surrogatepass") for w in ids], pa.string())
        g = np.concatenate([np.arange(len(first)), group[doc[start]]])
        t = np.concatenate([np.zeros(len(first), np.int64), term[start] + 1])
        counts = [np.concatenate([group_docs, df]), np.concatenate([np.zeros(len(first), np.int64), n])]
        for a in range(0, len(g), 20_000):
            at = slice(a, a + 20_000)
            cols = [lang.take(pa.array(g[at])), words.take(pa.array(t[at])), source.take(pa.array(g[at])), *(pa.array(c[at], pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, held = TermIds(), [], 0
        for batch in batches:
            for lang, source, doc, text in zip(*(values(batch, c) for c in ("lang", "source", "doc", "text")), strict=True):
                words = terms_of(text)
                found.append((lang, source, doc, np.fromiter(map(ids.__getitem__, words), np.int32, len(words))))
                held += len(words) + 20
                if held >= CHUNK:
                    yield from runs(found, ids)
                    found, held = [], 0
                    if len(ids) > CACHED_TERMS:
                        ids = TermIds()
        if found:
            yield from runs(found, ids)
        del ids, found
        release()

    return docs.select("doc", "lang", "source", "text").mapInArrow(work, "lang string, term string, source string, df long, n long")


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row differs from the one before in any key; the first does."""
    out = np.ones(len(table), bool)
    if len(table) > 1:
        differ = [pc.not_equal(table[k].slice(1), table[k].slice(0, len(table) - 1)) for k in keys]
        out[1:] = np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in differ])
    return out


def scanned_runs(runs: DataFrame, min_docs: int) -> DataFrame:
    """(kind, lang, term, source, n): groups, and for terms in min_docs documents of a language the counts of each source and of all."""
    schema = pa.schema([("kind", pa.int8()), ("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64())])

    def collapsed(rows: pa.Table) -> pa.Table:
        """A row for each run of equal (lang, term, source)."""
        start = np.flatnonzero(_changes(rows, RUN))
        out = rows.select(RUN).take(pa.array(start))
        for c in ("df", "n"):
            out = out.append_column(c, pa.array(np.add.reduceat(rows[c].to_numpy(), start)))
        return out

    def of_terms(rows: pa.Table, seen: tuple[int, int], ended: bool) -> Iterator[pa.RecordBatch]:
        """Rows of kept terms. seen is df and n of what has gone out of the first term; the last one gets its total if it has ended."""
        start = np.flatnonzero(_changes(rows, ["lang", "term"]))
        sums = [np.add.reduceat(rows[c].to_numpy(), start) for c in ("df", "n")]
        for x, before in zip(sums, seen, strict=True):
            x[0] += before
        is_group = pc.equal(rows["term"], "").to_numpy(zero_copy_only=False)
        keep = (sums[0] >= min_docs) & ~is_group[start]
        sizes = np.diff(np.append(start, len(rows)))
        kind = np.where(is_group, GROUP, COUNT).astype(np.int8)
        own = np.flatnonzero(np.repeat(keep, sizes) | is_group)
        out = pa.Table.from_arrays([pa.array(kind[own]), *(rows[c].take(pa.array(own)) for c in (*RUN, "n"))], schema=schema)
        yield from out.combine_chunks().to_batches()
        whole = np.flatnonzero(keep if ended else np.append(keep[:-1], False))
        at = pa.array(start[whole])
        cols = [pa.array(np.full(len(whole), TOTAL, np.int8)), rows["lang"].take(at), rows["term"].take(at), pa.nulls(len(whole), pa.string()), pa.array(sums[1][whole])]
        yield from pa.Table.from_arrays(cols, schema=schema).combine_chunks().to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, (0, 0)
        for batch in batches:
            rows = pa.table(batch)
            held = collapsed(rows if held is None else pa.concat_tables([held, rows]))
            last = int(np.flatnonzero(_changes(held, ["lang", "term"]))[-1])
            if last:
                yield from of_terms(held.slice(0, last), seen, ended=True)
                held, seen = held.slice(last).combine_chunks(), (0, 0)
            done = len(held) - 1  # the last run may go on
            df, n = (int(held[c].to_numpy()[:done].sum()) for c in ("df", "n"))
            if done and (seen[0] + df >= min_docs or held["term"][0].as_py() == ""):
                yield from of_terms(held.slice(0, done), seen, ended=False)
                held, seen = held.slice(done).combine_chunks(), (seen[0] + df, seen[1] + n)
        if held is not None and len(held):
            yield from of_terms(held, seen, ended=True)
        release()

    by_term = runs.repartition("lang", "term").sortWithinPartitions(*RUN)
    return by_term.mapInArrow(work, "kind byte, lang string, term string, source string, n long")


def share(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / whole), exactly; whole is count + 2 at least."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return F.call_function("div", scaled, whole.cast("decimal(19,0)")) + 1


def gap(p, q):
    """floor((p - q)^2 / (p + q)) for shares up to SCALE + 1, as columns or numbers."""
    if isinstance(p, Column):
        return F.call_function("div", (p - q) * (p - q), p + q)
    return (p - q) ** 2 // (p + q)


def partial_pairs_and_terms(rows: DataFrame, top: int) -> DataFrame:
    """(part, lang, source, item, value) from rows(lang, term, source, p, p0, q): partial sums of the corrections for pairs, partial leading terms."""
    schema = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def scan(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        run = np.cumsum(_changes(rows, ["lang", "term"]))
        lang, source = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
        n_sources = len(source.dictionary)
        s = source.indices.to_numpy().astype(np.int64)
        code = lang.indices.to_numpy().astype(np.int64) * n_sources + s
        p, p0, q = (rows[c].to_numpy() for c in ("p", "p0", "q"))
        sums: dict[tuple[int, int], int] = defaultdict(int)
        for d in range(1, int(np.bincount(run).max())):
            i = np.flatnonzero(run[d:] == run[:-d])
            j = i + d
            x = gap(p[i], p[j]) - gap(p[i], p0[j]) - gap(p0[i], p[j]) + gap(p0[i], p0[j])
            order = np.lexsort((s[j], code[i]))
            a, b, x = code[i][order], s[j][order], x[order]
            start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else []
            for k, v in zip(start, np.add.reduceat(x, start) if len(a) else (), strict=True):
                sums[int(a[k]), int(b[k])] += int(v)
        names, langs = source.dictionary.to_pylist(), lang.dictionary.to_pylist()
        pairs = [("pair", langs[a // n_sources], names[a % n_sources], names[b], v) for (a, b), v in sums.items()]
        above = np.flatnonzero(p > q)
        f = gap(p[above], q[above])
        above, f = (x[np.lexsort((above, -f, code[above]))] for x in (above, f))  # rows of a language are in the order of terms
        first = np.flatnonzero(np.append(True, code[above][1:] != code[above][:-1])) if len(above) else np.empty(0, int)
        place = np.arange(len(above)) - np.repeat(first, np.diff(np.append(first, len(above))))
        lead = place < top
        item = rows["term"].take(pa.array(above[lead])).to_pylist()
        terms = [("term", langs[c // n_sources], names[c % n_sources], t, int(v)) for c, t, v in zip(code[above[lead]], item, f[lead], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in (*pairs, *terms)], c.type) for k, c in enumerate(schema)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.table(batch)
            held = rows if held is None else pa.concat_tables([held, rows])
            last = int(np.flatnonzero(_changes(held, ["lang", "term"]))[-1])
            if last >= 10_000:  # the last term may go on in the next batch
                yield from scan(held.slice(0, last))
                held = held.slice(last).combine_chunks()
        if held is not None and len(held):
            yield from scan(held)
        release()

    by_term = rows.select("lang", "term", "source", "p", "p0", "q").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return by_term.mapInArrow(work, "part string, lang string, source string, item string, value long")


def pairs_of_sources(groups: DataFrame) -> DataFrame:
    """(lang, a, b, p0_a, p0_b, v) for all ordered pairs of different sources of a language, which is what the audit returns; dealt in blocks."""
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = groups.join(blocks, "lang")
    a = dealt.select("lang", F.col("source").alias("a"), F.col("p0").alias("p0_a"), "v", F.pmod(F.xxhash64("source"), "blocks").alias("block"))
    b = dealt.select("lang", F.col("source").alias("b"), F.col("p0").alias("p0_b"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    return a.join(b, ["lang", "block"]).where("a <> b").drop("block")


def source_divergence(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of each language lie apart, and the terms that set each off.

    Part `pair` has every other source of the language, part `term` the source's leading terms against its language. Null
    text, language and source count as empty strings; every row is a document of its own, whether or not its id is null
    or repeats. A language without kept terms has pairs of value 0 and no terms; ties go by item. An empty table gives an
    empty one. Other columns of docs don't matter.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    slim = slim.withColumn("doc", F.coalesce("doc", F.lit(-1)))
    scanned = written(scanned_runs(document_runs(slim), min_docs), "runs")
    of = lambda kind: scanned.where(F.col("kind") == kind)
    in_lang = of(TOTAL).select("lang", "term", F.col("n").alias("n_lang"))
    kept = written(of(COUNT).join(in_lang, ["lang", "term"]).select(*RUN, "n", "n_lang"), "kept")
    totals = in_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("all"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("rows"))
    groups = of(GROUP).select("lang", "source").join(totals, "lang", "left").join(sizes, ["lang", "source"], "left")
    v = F.coalesce("v", F.lit(0))
    none = F.lit(0).cast("long")
    groups = groups.select("lang", "source", v.alias("v"), (F.coalesce("size", none) + 2 * v).alias("d"), (F.coalesce("all", none) + 2 * v).alias("d_lang"), F.coalesce("rows", none).alias("n"))
    groups = groups.withColumns({"key": F.struct("lang", "source"), "p0": F.when(F.col("v") > 0, share(F.lit(0), F.col("d"))).otherwise(1)})
    groups = written(groups, "groups")
    n_rows = groups.agg(F.sum("n")).first()[0] or 0
    known = spread_join(kept.withColumn("key", F.struct("lang", "source")), groups.select("key", "d", "d_lang", "p0"), "key", hot_keys(groups, "key", n_rows))
    known = known.select(*RUN, share(F.col("n"), F.col("d")).alias("p"), "p0", share(F.col("n_lang"), F.col("d_lang")).alias("q"))
    known = written(known, "shares")
    found = written(partial_pairs_and_terms(known, top), "partial")

    pairs = written(pairs_of_sources(groups), "pairs")
    same = known.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count(F.lit(1)).alias("m"))
    one_sided = pairs.join(same, ["lang", "a"]).select("lang", "a", "b", (F.col("m") * (gap(F.col("p"), F.col("p0_b")) - gap(F.col("p0_a"), F.col("p0_b")))).alias("value"))
    one_sided = one_sided.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    common = found.where("part = 'pair'").groupBy("lang", F.col("source").alias("a"), F.col("item").alias("b")).agg(F.sum("value").alias("value"))
    half = one_sided.unionByName(common)
    absent = pairs.select("lang", "a", "b", (F.col("v") * gap(F.col("p0_a"), F.col("p0_b"))).alias("value"))
    both = absent.unionByName(half).unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    summed = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    of_pair = summed.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    of_term = found.where("part = 'term'").select("lang", "source", "part", "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_pair = of_pair.withColumn("rank", F.row_number().over(order))
    of_term = of_term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return of_pair.unionByName(of_term)


#: DuckDB SQL of the query, over the dense grid of groups and kept terms.
DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), occurrences AS (SELECT doc, lang, source, unnest(words) AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), grps AS (SELECT DISTINCT lang, source FROM docs
), counts AS (SELECT lang, source, term, count(*) AS n FROM occurrences GROUP BY lang, source, term
), grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang
  FROM grps g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n,
         (1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER g + 2 * count(*) OVER g))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (n_lang + 2)) // (sum(n_lang) OVER g + 2 * count(*) OVER g))::BIGINT AS q
  FROM grid WINDOW g AS (PARTITION BY lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
