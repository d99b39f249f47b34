"""Quality of documents by regularised quadratic discriminant analysis of transformed text statistics.

The moments of both classes (count, mean, second moments) are summed over the labelled training rows in Spark; the
driver sees numbers of the size of one covariance. Class covariances shrink towards the pooled one and that towards its
diagonal. A score is the logistic of the log-density difference plus the log prior ratio; Mahalanobis distances come
from the cached inverse Cholesky factors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, values, written

#: Statistics by name; each is a function of the whole text alone.
FEATURES = (
    "words", "word_length", "word_length_spread", "distinct_words", "repeated_pairs", "upper", "digits", "marks", "shouts", "bars", "signs",
    "other_bytes", "lines", "repeated_lines", "upper_words", "no_letter_words", "stops", "commas", "common_words", "joined_marks",
)
#: Labelled rows that the moments are summed over, about, if there are more.
FIT_ROWS = 100_000
KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 ! or ?, 6 |, 7 # $ % & * @ ^ ~ = + < > \ _, 8 . , 9 , ; : 10 other ASCII marks, 11 beyond ASCII
for kind, chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t\n\r\v\f"), (5, b"!?"), (6, b"|"), (7, b"#$%&*@^~=+<>\\_{}[]"), (8, b"."), (9, b",;:"), (10, b"\"'()-/`")):
    KIND[np.frombuffer(chars, np.uint8)] = kind
KIND[128:] = 11


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a text; zeros stand for what an empty text doesn't have."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return np.zeros(len(FEATURES))
    codes = np.frombuffer(raw, np.uint8)
    kinds = KIND[codes]
    c = np.bincount(kinds, minlength=12)
    solid = max(1, size - c[4])
    letters = max(1, c[1] + c[2] + c[11])
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper_words = sum(w.isupper() for w in words)
    no_letters = sum(not w.isalpha() and w.upper() == w.lower() and w.isascii() for w in words)
    marked = (kinds == 7) | (kinds == 5)
    runs = int((marked[1:] & marked[:-1]).sum())
    low = lambda x: np.log(x + 1e-3)
    return np.array([
        np.log1p(n), np.log1p(lengths.mean()), np.log1p(lengths.std()), low(len(distinct) / n ** 0.8), low(1 - pairs / max(1, n - 1)),
        low(c[2] / letters), low(c[3] / solid), low((c[5] + c[6] + c[7] + c[8] + c[9] + c[10]) / solid), low(c[5] / solid), low(c[6] / solid), low(c[7] / solid),
        low(c[0] / solid), low(len(lines) / n), low(1 - len(set(lines)) / len(lines)), low(upper_words / n), low(no_letters / n), low(c[8] / n), low(c[9] / n),
        low(sum(k for _, k in distinct.most_common(5)) / n), low(runs / solid),
    ])


class Discriminant:
    """Two Gaussians with shrunken covariances. moments[c] is (n, sum, sum of outer products)."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], class_shrinkage: float = 0.5, diagonal_shrinkage: float = 0.05):
        d = len(FEATURES)
        none = (0.0, np.zeros(d), np.zeros((d, d)))
        both = [moments.get(c, none) for c in (0, 1)]
        n = np.array([m[0] for m in both])
        total = max(n.sum(), 1.0)
        mean_all = sum(m[1] for m in both) / total
        self.means, scatter = [], []
        for k, s, ss in both:
            mean = s / k if k else mean_all
            self.means.append(mean)
            scatter.append(ss - k * np.outer(mean, mean) if k else np.zeros((d, d)))
        pooled = sum(scatter) / total
        pooled = (1 - diagonal_shrinkage) * pooled + diagonal_shrinkage * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
        self.roots, self.log_dets = [], []
        for k, s in zip(n, scatter, strict=True):
            a = min(1.0, class_shrinkage + d / (k + d))
            root = np.linalg.cholesky((1 - a) * s / max(k, 1.0) + a * pooled)
            self.roots.append(np.linalg.inv(root))
            self.log_dets.append(np.log(np.diag(root)).sum())
        self.prior = float(np.log((n[1] + 1) / (n[0] + 1)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        far = [(((x - m) @ r.T) ** 2).sum(1) / 2 + h for m, r, h in zip(self.means, self.roots, self.log_dets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.prior + far[0] - far[1], -500, 500)))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32(doc_id as text) mod folds = fold; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, x) for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t) for t in values(batch, "text")], schema.field("x").type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], schema=schema)
        release()

    return _slim(docs, id_col, text_col).mapInArrow(work, "doc_id long, x array<double>")


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def training_labels(labels: DataFrame, label_col: str, folds: int, fold: int) -> DataFrame:
    """(doc_id, label) of labels(doc_id, label) without the held-out fold and null labels: all, or about FIT_ROWS by a hash of the id if there are more.

    So it's small enough to broadcast, which is checked, and texts needn't be shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"), folds, fold))
    n = known.count()
    if n > FIT_ROWS:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(FIT_ROWS / n * (1 << 20)))
        n = known.count()
    return F.broadcast(known) if n <= 2 * FIT_ROWS else known


def fit(rows: DataFrame, value: str, statistic=np.asarray, **shrinkage) -> Discriminant:
    """From rows(label, value): the moments of statistic(value), summed over all rows."""
    d = len(FEATURES)
    schema = pa.schema([("c", pa.int32()), ("i", pa.int32()), ("v", pa.float64())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if len(batch):
                m = np.stack([statistic(v) for v in values(batch, value)])
                label = batch.column("label").to_numpy()
                for c in (0, 1):
                    some = m[label == c]
                    total[c] += np.concatenate([[len(some)], some.sum(0), (some.T @ some).ravel()])
        columns = (np.repeat([0, 1], total.shape[1]).astype(np.int32), np.tile(np.arange(total.shape[1], dtype=np.int32), 2), total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)
        release()

    found = rows.select("label", value).mapInArrow(sums, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros((2, 1 + d + d * d))
    for r in found:
        flat[r["c"], r["i"]] = r["v"]
    return Discriminant({c: (flat[c, 0], flat[c, 1 : d + 1], flat[c, d + 1 :].reshape(d, d)) for c in (0, 1)}, **shrinkage)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null and blank texts get the score of zero statistics. Rows that repeat an id are scored each for itself, and a
    label that is repeated counts again; a null id is never held out nor labelled. Without labels of a class its
    Gaussian is the pooled one. An empty table gives an empty one; other columns don't matter.
    """
    x = written(features(docs, id_col, text_col), "features")
    model = fit(x.join(training_labels(labels, label_col, folds, fold), "doc_id"), "x")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.scores(np.stack(list(batch["x"])))})

    scored = x.mapInPandas(work, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier accepts."""
    model = fit(_slim(docs, id_col, text_col).join(training_labels(labels, label_col, folds, fold), "doc_id"), "text", statistics)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            x = [statistics(t) for t in values({"text": part}, "text")]
            yield pa.array(model.scores(np.stack(x)) if x else [], pa.float64())
        release()

    return docs.where(score(F.col(text_col).cast("string")) >= threshold)
