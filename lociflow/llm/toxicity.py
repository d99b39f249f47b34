"""Toxicity of documents by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling.

A word's vector joins the rows of two tables at two hashes of the word, so that one collision doesn't make two words
alike. Filters of several widths slide over the words; each filter's largest value in the text feeds a logistic
output. The network is trained in numpy on a bounded sample of labelled rows: FIT_ROWS rows of each class, chosen by a
hash and whole whatever their length; texts are scored whole. One column of the tables starts from the log-odds of
words. The language of a text is inferred from its function words, and for each language the cut-off that is best on a
calibration part of the sample is moved to the fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of
from .quality import held_out

FIT_ROWS = 3000
BUCKETS, HALF, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 12
PAD = BUCKETS  # row of zeros
CACHED_WORDS = 200_000
EDGES = b".,;:!?\"'()[]{}<>-_*#%$&|"
# Function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that was for it with as on be at by this are from or an",
    "de": "der die und das ist den von zu mit sich des auf ein eine dem nicht im für",
    "fr": "le la les des et est une un du que dans qui pour sur au par pas de",
    "es": "el la los las y es una un del que en por con para se no al de",
}
LANGUAGES = tuple(FUNCTION_WORDS)


class WordCodes(dict):
    """Word to a number that packs two bucket numbers and, for each language, whether it is a function word of it."""

    def __init__(self):
        super().__init__()
        self.flags: dict[bytes, int] = {}
        for bit, words in enumerate(FUNCTION_WORDS.values()):
            for w in words.encode().split():
                self.flags[w] = self.flags.get(w, 0) | 1 << bit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        bare = word.strip(EDGES) or word
        h = xxhash.xxh3_64_intdigest(bare)
        code = self[word] = (h & (BUCKETS - 1)) | (h >> 32 & (BUCKETS - 1)) << 16 | self.flags.get(bare, 0) << 32
        return code


def coded(text: str | None, cache: WordCodes) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(cache.__getitem__, words), np.int64, len(words))


def language(codes: np.ndarray) -> int:
    """The language most of whose function words occur, the first of LANGUAGES if there are none."""
    flags = codes >> 32
    return int(np.argmax([(flags >> bit & 1).sum() for bit in range(len(LANGUAGES))]))


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


class ConvNet:
    """Tables of two times HALF columns, filters of WIDTHS, max pooling, and a logistic output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
        self.p = {"t0": draw(BUCKETS + 1, HALF), "t1": draw(BUCKETS + 1, HALF), "out": draw(len(WIDTHS) * FILTERS), "bias": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"], self.p[f"b{w}"] = draw(w, 2 * HALF, FILTERS), np.zeros(FILTERS, np.float32)
        self.shift = np.zeros(len(LANGUAGES))
        self._seal()

    def _seal(self) -> None:
        self.p["t0"][PAD] = self.p["t1"][PAD] = 0

    def embed(self, codes: np.ndarray) -> np.ndarray:
        """Rows for the words, and rows of zeros so that every filter fits."""
        a = np.concatenate([codes & 0xFFFF, np.full(max(WIDTHS) - 1, PAD)])
        b = np.concatenate([codes >> 16 & 0xFFFF, np.full(max(WIDTHS) - 1, PAD)])
        return np.concatenate([self.p["t0"][a], self.p["t1"][b]], 1)

    def pool(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest value and where it is; chunks bound the memory."""
        n = len(e) - max(WIDTHS) + 1
        best, at = np.full((len(WIDTHS), FILTERS), -np.inf, np.float32), np.zeros((len(WIDTHS), FILTERS), np.int64)
        for start in range(0, n, 4096):
            stop = min(n, start + 4096)
            for k, w in enumerate(WIDTHS):
                z = sum(e[start + j : stop + j] @ self.p[f"w{w}"][j] for j in range(w))
                i = z.argmax(0)
                v = z[i, np.arange(FILTERS)]
                more = v > best[k]
                best[k][more], at[k][more] = v[more], i[more] + start
        return best + np.stack([self.p[f"b{w}"] for w in WIDTHS]), at

    def raw(self, codes: np.ndarray) -> float:
        if not len(codes):
            return float(self.p["bias"][0])
        best, _ = self.pool(self.embed(codes))
        return float(np.maximum(best, 0).ravel() @ self.p["out"] + self.p["bias"][0])

    def score(self, codes: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(codes) + self.shift[language(codes)], -30, 30))))

    def start_from_odds(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """Column 0 of both tables: the clipped log-odds of a bucket's presence; filter 0 of width 1 reads it."""
        for name, move in (("t0", 0), ("t1", 16)):
            seen = np.zeros((2, BUCKETS + 1))
            for codes, label in zip(texts, y, strict=True):
                seen[label, np.unique(codes >> move & 0xFFFF)] += 1
            n = np.bincount(y, minlength=2)
            odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
            self.p[name][:, 0] = np.where(seen.sum(0) >= 5, np.clip(odds, -2, 2), -0.5)
        self.p["w1"][0, :, 0] = 0
        self.p["w1"][0, [0, HALF], 0] = 0.7
        self.p["b1"][0], self.p["out"][0] = -1.0, 1.5
        self.p["bias"][0] = -1.5
        self._seal()

    def train(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                grads: dict[str, np.ndarray] = {k: np.zeros_like(x) for k, x in self.p.items() if k[0] != "t"}
                rows: dict[str, list[np.ndarray]] = {"t0": [], "t1": [], "g0": [], "g1": []}
                for r in some:
                    codes = texts[r]
                    if not len(codes):
                        continue
                    e = self.embed(codes)
                    best, at = self.pool(e)
                    act = np.maximum(best, 0)
                    d = (1 / (1 + np.exp(-np.clip(act.ravel() @ self.p["out"] + self.p["bias"][0], -30, 30))) - y[r]) / len(some)
                    grads["out"] += d * act.ravel()
                    grads["bias"] += d
                    g = d * self.p["out"].reshape(best.shape) * (best > 0)
                    padded = np.concatenate([codes, np.full(max(WIDTHS) - 1, PAD | PAD << 16)])
                    for k, w in enumerate(WIDTHS):
                        grads[f"b{w}"] += g[k]
                        for j in range(w):
                            x = e[at[k] + j]
                            grads[f"w{w}"][j] += (g[k][:, None] * x).T
                            back = g[k][:, None] * self.p[f"w{w}"][j].T
                            c = padded[at[k] + j]
                            rows["t0"].append(c & 0xFFFF)
                            rows["t1"].append(c >> 16 & 0xFFFF)
                            rows["g0"].append(back[:, :HALF])
                            rows["g1"].append(back[:, HALF:])
                step += 1
                fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, gr in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * gr
                    v[k] = 0.999 * v[k] + 0.001 * gr * gr
                    self.p[k] -= (rate * fix * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
                if rows["t0"]:
                    for name in ("t0", "t1"):
                        at_, inverse = np.unique(np.concatenate(rows[name]), return_inverse=True)
                        gr = np.zeros((len(at_), HALF), np.float32)
                        np.add.at(gr, inverse, np.concatenate(rows["g" + name[1]]))
                        v[name][at_] += gr * gr
                        self.p[name][at_] -= rate * 5 * gr / (np.sqrt(v[name][at_]) + 1e-6)
                self._seal()

    def calibrate(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, threshold: float) -> None:
        """For each inferred language, moves the cut-off with the best weighted F1 to the threshold, given 20 texts of each class."""
        raw = np.array([self.raw(c) for c in texts])
        spoken = np.array([language(c) for c in texts])

        def best(pick: np.ndarray) -> float:
            order = np.argsort(-raw[pick])
            s, hit, w = raw[pick][order], y[pick][order], weight[pick][order]
            right, told = np.cumsum(w * hit), np.cumsum(w)
            f1 = 2 * right / (told + (w * hit).sum())
            k = int(f1.argmax())
            return float((s[k] + (s[k + 1] if k + 1 < len(s) else s[k] - 1)) / 2)

        if len(set(y)) < 2:
            return
        whole = best(np.ones(len(y), bool))
        for lang in range(len(LANGUAGES)):
            pick = spoken == lang
            enough = min(np.bincount(y[pick], minlength=2)[:2]) >= 20
            self.shift[lang] = logit(threshold) - (best(pick) if enough else whole)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, fold: int, threshold: float) -> ConvNet:
    """A network trained without the rows of the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"), folds, fold))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = {c: min(1.0, 1.5 * FIT_ROWS / max(1, n)) for c, n in counts.items()}
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    picked = known.where(h < F.when(F.col("label") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)))
    # at most 1.5 * FIT_ROWS rows a class are expected here, whatever the input, so this side may be broadcast
    small = F.broadcast(picked) if picked.limit(8 * FIT_ROWS + 1).count() <= 8 * FIT_ROWS else picked
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(small, "doc_id")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordCodes()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "codes": [coded(t, cache).tobytes() for t in batch["text"]]})

    rows = slim.mapInPandas(work, "doc_id long, label int, codes binary").where("length(codes) > 0")
    found = pd.concat([rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "codes").limit(FIT_ROWS).toPandas() for c in (0, 1)])
    net = ConvNet()
    if len(found):
        texts = [np.frombuffer(c, np.int64) for c in found["codes"]]
        y = found["label"].to_numpy().astype(np.int64)
        part = np.arange(len(y)) % 5 == 4  # calibrates, the rest trains
        weight = np.array([counts.get(c, 1) / max(1, (y == c).sum()) for c in (0, 1)])[y]
        train = [t for t, p in zip(texts, part, strict=True) if not p]
        net.start_from_odds(train, y[~part])
        net.train(train, y[~part])
        net.calibrate([t for t, p in zip(texts, part, strict=True) if p], y[part], weight[part], threshold)
    return net


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, fold: int = 1, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null and blank texts get the score of no words. Rows that repeat an id are scored each for itself; a null id is
    never held out nor labelled. Without labels the network is untrained. An empty table gives an empty one; other
    columns don't matter.
    """
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, folds, fold, threshold))  # of fixed size

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordCodes()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": [net.value.score(coded(t, cache)) for t in batch["text"]]})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = slim.mapInPandas(work, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
