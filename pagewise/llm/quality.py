"""Quality classifier: regularised quadratic discriminant analysis.

A document is described by transformed statistics of its whole text (sizes as
logarithms, shares as square roots). Each class has a mean and a covariance,
shrunk towards the pooled covariance and towards its diagonal; the Cholesky
factors are computed once. The log-density difference of the two classes, from
squared Mahalanobis distances and log-determinants, plus the log prior odds
gives the score.

Training reads all labelled rows: counts, sums and sums of products per class
are one aggregation, so only two rows of moments reach the driver.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import text_bytes
from pagewise.session import cut_lineage

TO_POOLED = 0.5
TO_DIAGONAL = 0.05
THRESHOLD = 0.3

_KIND = np.zeros(256, np.int64)  # 0 other ASCII, 1 upper, 2 lower, 3 digit, 4 stop, 5 mark, 6 blank, 7 newline, 8 beyond
_KIND[ord("A"):ord("Z") + 1] = 1
_KIND[ord("a"):ord("z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 3
for _c in ".,;:?'\"-()":
    _KIND[ord(_c)] = 4
_KIND[ord("!")] = 5
for _c in " \t\r\x0b\x0c":
    _KIND[ord(_c)] = 6
_KIND[ord("\n")] = 7
_KIND[128:] = 8

FEATURES = ("bytes", "words", "word_bytes", "upper", "digits", "stops", "marks", "symbols", "blanks", "newlines",
            "beyond", "variety", "line_variety", "top_word", "sentence_ends", "longest_word", "capitalised", "short_lines")


def statistics(text: bytes | None) -> np.ndarray:
    """The feature vector of a text; null and empty texts have that of no words."""
    text = text or b""
    n = max(1, len(text))
    by = np.bincount(_KIND, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 9)
    words = text.split()
    count = len(words)
    w = max(1, count)
    times = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(1.0, by[1] + by[2] + by[8])
    ends = sum(m for x, m in times.items() if x[-1] in b".?!")
    capitals = sum(m for x, m in times.items() if 65 <= x[0] <= 90)
    share = np.array([by[1] / letters, by[3] / n, by[4] / n, by[5] / n, by[0] / n, by[6] / n, by[7] / w, by[8] / n])
    more = np.array([max(times.values(), default=0) / w, ends / w, capitals / w,
                     sum(len(x) < 40 for x in lines) / max(1, len(lines))])
    upper, digits, stops, marks, symbols, blanks, newlines, beyond = np.sqrt(share)
    top, sentence, capital, short = np.sqrt(more)
    return np.array([
        np.log1p(len(text)), np.log1p(count), np.log1p(sum(map(len, words)) / w), upper, digits, stops, marks, symbols,
        blanks, newlines, beyond, np.log1p(len(times)) / np.log(w + 1.5), len(set(lines)) / max(1, len(lines)), top,
        sentence, np.log1p(max(map(len, words), default=0)), capital, short])


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and one double column for each of ``FEATURES``."""
    @F.arrow_udf("array<double>")
    def describe(texts: pa.Array) -> pa.Array:
        rows = np.array([statistics(t) for t in text_bytes(texts)]).reshape(len(texts), len(FEATURES))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(FEATURES), pa.int32()), pa.array(rows.ravel()))
    rows = docs.select(F.col(id_col), describe(F.col(text_col).cast("string")).alias("v"))
    return rows.select(id_col, *[F.get("v", i).alias(f) for i, f in enumerate(FEATURES)])


@dataclass
class Discriminant:
    log_odds: float  # of the priors, class 1 to class 0
    means: np.ndarray | None = None  # 2 x features
    whiten: np.ndarray | None = None  # inverse Cholesky factors, 2 x features x features
    log_scale: np.ndarray | None = None  # log-determinants of the factors

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.log_odds)
        if self.means is not None:
            for sign, k in ((-1, 0), (1, 1)):
                z = (x - self.means[k]) @ self.whiten[k].T
                odds += sign * (-0.5 * (z * z).sum(axis=1) - self.log_scale[k])
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -700, 700)))


def discriminant(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED,
                 to_diagonal: float = TO_DIAGONAL) -> Discriminant:
    """From label -> (rows, sums, sums of products). Without rows of both labels
    the score is the prior: 0.5 without any row."""
    n = [moments[k][0] if k in moments else 0 for k in (0, 1)]
    log_odds = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    if min(n) < 2:
        return Discriminant(log_odds)
    means = np.stack([moments[k][1] / n[k] for k in (0, 1)])
    own = [moments[k][2] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    whiten, log_scale = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * own[k] + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(pooled))
        factor = np.linalg.cholesky(c + 1e-6 * np.eye(len(c)))
        whiten.append(np.linalg.inv(factor))
        log_scale.append(np.log(np.diag(factor)).sum())
    return Discriminant(log_odds, means, np.stack(whiten), np.array(log_scale))


def fit(rows: DataFrame, label: Column) -> Discriminant:
    """Train on described rows whose ``label`` is 0 or 1."""
    rows = rows.withColumn("_label", label.cast("int")).where("_label IN (0, 1)")
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    moments = {}
    for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect():
        square = np.zeros((len(FEATURES), len(FEATURES)))
        for i, j in pairs:
            square[i, j] = square[j, i] = r[f"p{i}_{j}"]
        moments[r["_label"]] = (r["n"], np.array([r[f"s{i}"] for i in range(len(FEATURES))]), square)
    return discriminant(moments)


def score_column(model: Discriminant) -> Column:
    @F.arrow_udf("double")
    def score(*columns: pa.Array) -> pa.Array:
        return pa.array(model.score(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)))
    return score(*[F.col(f) for f in FEATURES])


def classify(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, score`` (share of belief in label 1) and ``predicted`` (1 from
    ``threshold`` on) for every row, learned from the labelled rows where
    ``trainable`` (over ``id_col``) holds.

    Defined results: null and empty texts are scored like any text, as texts
    without words; repeated rows stay and get equal scores; labels that are null
    or neither 0 nor 1 are not used, repeated labels count each; rows with a
    null id are scored and not learned from; other columns are not read; without
    rows of both labels the score is the prior; an empty table gives an empty
    result.
    """
    rows = cut_lineage(described(docs, id_col, text_col), "statistics")
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_mark"))
    known = rows.where(trainable).join(marks, F.col(id_col) == F.col("_id"))
    model = fit(known, F.col("_mark"))
    out = rows.select(id_col, score_column(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
