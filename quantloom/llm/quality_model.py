"""Document quality by a generalised additive model with pairwise interactions.

Each feature of a text, and each of a few pairs of features, has a lookup table over bins.  The
tables are learned by cyclic boosting: one shallow tree after another on the gradient of the
log-loss, feature by feature, then pair by pair.  A score is the logistic of the sum of the
tables' entries, so scoring is a search for bins and an addition.

Learning sees a bounded sample of labelled rows (``max_rows``, those of the smallest hash of their
id); scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, fold

MAX_ROWS = 40_000
HELD_OUT_FOLDS = 5
THRESHOLD = 0.3

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
PLAIN_MARKS = b".,;:?"
#: Last bytes of a line that ends like a sentence (also the last byte of closing quotes).
LINE_ENDS = frozenset(b".!?:;\"')]\xa6\x9d\xbb\x82")

FEATURES = (
    "log_words", "word_length", "symbols", "upper", "digits", "exclamations", "bars", "marks", "distinct", "commonest",
    "adjacent", "trigrams", "log_lines", "repeated_lines", "ended_lines", "line_words", "short_words", "beyond_ascii",
)


def count(text: bytes, which: bytes) -> int:
    return len(text) - len(text.translate(None, which))


def features_of(text: bytes) -> tuple[float, ...]:
    """The features of one whole text; all are 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    size = sum(map(len, words))
    upper, lower = count(text, UPPER), count(text, LOWER)
    lines = [line for line in text.split(b"\n") if line.strip()]
    trigrams = max(1, n - 2)
    return (
        math.log1p(n),
        size / n,
        count(text, SYMBOLS) / n,
        upper / max(1, upper + lower),
        count(text, DIGITS) / size,
        text.count(b"!") / n,
        text.count(b"|") / n,
        count(text, PLAIN_MARKS) / n,
        len(set(words)) / n,
        max(Counter(words).values()) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:], words[2:]))) / trigrams,
        math.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(line.rstrip()[-1] in LINE_ENDS for line in lines) / len(lines),
        math.log1p(n / len(lines)),
        sum(len(w) < 4 for w in words) / n,
        1 - count(text, bytes(range(128))) / len(text),
    )


def feature_frame(texts: Iterator[bytes]) -> np.ndarray:
    return np.array([features_of(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int, least: int) -> np.ndarray:
    """Leaf values over the bins of one axis: up to 2**depth runs of bins, of at least ``least`` rows each."""

    def value(lo: int, hi: int) -> float:
        return gradient[lo:hi].sum() / (weight[lo:hi].sum() + 1.0)

    def grow(lo: int, hi: int, left: int) -> None:
        g, w, n = (np.cumsum(x[lo:hi]) for x in (gradient, weight, rows))
        if left and hi - lo > 1:
            gain = g[:-1] ** 2 / (w[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + 1)
            gain = np.where((n[:-1] >= least) & (n[-1] - n[:-1] >= least), gain, -1)
            k = int(np.argmax(gain))
            if gain[k] > g[-1] ** 2 / (w[-1] + 1) + 1e-9:
                grow(lo, lo + k + 1, left - 1)
                grow(lo + k + 1, hi, left - 1)
                return
        out[lo:hi] = value(lo, hi)

    out = np.zeros(len(gradient))
    grow(0, len(gradient), depth)
    return out


def cross_tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, float]:
    """Leaf values over the bins of two axes, one cut on the first and one on the second in each half; its gain."""
    best, best_gain = np.zeros_like(gradient), 0.0
    for turned in (False, True):
        g, w, n = (gradient.T, weight.T, rows.T) if turned else (gradient, weight, rows)
        ga, wa, na = (x.cumsum(0).cumsum(1) for x in (g, w, n))
        total_g, total_w = ga[-1, -1], wa[-1, -1]

        def halves(g2: np.ndarray, w2: np.ndarray, n2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Best second cut for each row of cumulated sums along the second axis, with its gain."""
            rest_g, rest_w = g2[:, -1:] - g2[:, :-1], w2[:, -1:] - w2[:, :-1]
            gain = g2[:, :-1] ** 2 / (w2[:, :-1] + 1) + rest_g**2 / (rest_w + 1)
            gain = np.where((n2[:, :-1] >= least) & (n2[:, -1:] - n2[:, :-1] >= least), gain, -1)
            k = gain.argmax(1)
            return k, gain[np.arange(len(k)), k]

        if g.shape[0] < 2 or g.shape[1] < 2:
            continue
        low, low_gain = halves(ga[:-1], wa[:-1], na[:-1])
        high, high_gain = halves(ga[-1:] - ga[:-1], wa[-1:] - wa[:-1], na[-1:] - na[:-1])
        gain = np.where((low_gain >= 0) & (high_gain >= 0), low_gain + high_gain, -1)
        a = int(gain.argmax())
        if gain[a] - total_g**2 / (total_w + 1) > best_gain:
            best_gain = float(gain[a] - total_g**2 / (total_w + 1))
            out = np.zeros_like(g)
            for side, b in ((slice(0, a + 1), int(low[a])), (slice(a + 1, None), int(high[a]))):
                for part in (slice(0, b + 1), slice(b + 1, None)):
                    out[side, part] = g[side, part].sum() / (w[side, part].sum() + 1.0)
            best = out.T if turned else out
    return best, best_gain


class AdditiveModel:
    """Lookup tables over bins of single features and of pairs."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, pairs: int = 8, rounds: int = 60, pair_rounds: int = 30, rate: float = 0.1, depth: int = 2, least: int = 5):
        self.bins, self.pair_bins, self.n_pairs, self.rounds, self.pair_rounds = bins, pair_bins, pairs, rounds, pair_rounds
        self.rate, self.depth, self.least = rate, depth, least

    @staticmethod
    def cuts(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)

    def binned(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """Without rows of both labels the score is the share of label 1, 0.5 without any row."""
        p = x.shape[1]
        self.edges = [self.cuts(x[:, j], self.bins) for j in range(p)]
        self.pair_edges = [self.cuts(x[:, j], self.pair_bins) for j in range(p)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(share / (1 - share)))
        if len(np.unique(y)) < 2:
            return self
        one, two = self.binned(x, self.edges), self.binned(x, self.pair_edges)
        logit = np.full(len(y), self.base)

        def sums(bin_of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Gradient, curvature and rows of each bin."""
            q = 1 / (1 + np.exp(-logit))
            return np.bincount(bin_of, y - q, size), np.bincount(bin_of, q * (1 - q), size), np.bincount(bin_of, minlength=size)

        for _ in range(self.rounds):
            for j in range(p):
                step = self.rate * shallow_tree(*sums(one[:, j], len(self.tables[j])), self.depth, self.least)
                self.tables[j] += step
                logit += step[one[:, j]]
        shapes = [len(e) + 1 for e in self.pair_edges]

        def crossed(a: int, b: int) -> tuple[np.ndarray, float]:
            found = sums(two[:, a] * shapes[b] + two[:, b], shapes[a] * shapes[b])
            return cross_tree(*(x.reshape(shapes[a], shapes[b]) for x in found), self.least)

        gains = sorted(((crossed(a, b)[1], a, b) for a, b in combinations(range(p), 2)), key=lambda t: (-t[0], t[1:]))
        self.pairs = [(a, b) for gain, a, b in gains[: self.n_pairs] if gain > 0]
        self.pair_tables = [np.zeros((shapes[a], shapes[b])) for a, b in self.pairs]
        for _ in range(self.pair_rounds):
            for k, (a, b) in enumerate(self.pairs):
                step = self.rate * crossed(a, b)[0]
                self.pair_tables[k] += step
                logit += step[two[:, a], two[:, b]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row: vectorised additions of the bins' entries."""
        one, two = self.binned(x, self.edges), self.binned(x, self.pair_edges)
        logit = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            logit += table[one[:, j]]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            logit += table[two[:, a], two[:, b]]
        return 1 / (1 + np.exp(-logit))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, folds: int = HELD_OUT_FOLDS) -> AdditiveModel:
    """Fits the model on labelled rows outside fold 0.

    Labels that are null or not 0 or 1 are left out; of several labels of an id the smallest holds,
    and of several texts one.  A null id has no label.
    """
    ids = (
        labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("key").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("key"), folds) != 0))
        .groupBy("key")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(max_rows)
    )
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    schema = f"key {kind}, label int, " + ", ".join(f"{f} double" for f in FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_frame(byte_texts(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, x.T)], ["key", "label", *FEATURES])

    # ids is at most max_rows rows of a key and a label
    rows = texts.join(F.broadcast(ids), "key").select("key", "label", "text").mapInArrow(run, schema)
    seen = rows.groupBy("key").agg(F.min("label").alias("label"), *(F.min(f).alias(f) for f in FEATURES)).toPandas().sort_values("key")
    return AdditiveModel().fit(seen[list(FEATURES)].to_numpy(float), seen["label"].to_numpy(float))


def quality_score(model: AdditiveModel, text: Column) -> Column:
    """The score of a text; a null text is an empty one."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array(model.score(feature_frame(byte_texts(part))))

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, folds: int = HELD_OUT_FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; repeated rows are scored alike.

    A null text is an empty one, a null id is in no fold (held_out false).  Other columns are
    ignored.  Without usable labels every score is the same; no documents give no rows.
    """
    model = learn(docs, labels, id_col, text_col, label_col, max_rows, folds)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(fold(F.col(id_col), folds) == 0, F.lit(False)).alias("held_out"),
        quality_score(model, F.col(text_col)).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, folds: int = HELD_OUT_FOLDS) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold.

    Nulls, empty texts and repeated rows are scored as in score_quality; without usable labels all stay or all go;
    an empty table gives an empty table.
    """
    model = learn(docs, labels, id_col, text_col, label_col, max_rows, folds)
    return docs.filter(quality_score(model, F.col(text_col)) >= threshold)
