"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a vector of statistics (shares of kinds of bytes, word lengths, repetition), log- or root-transformed. For
each class the sample mean and a covariance shrunk towards the pooled one and a multiple of the identity,
    S_c = (1 - a - b) C_c + a C_pooled + b (tr C_pooled / d) I,
are fitted; the score is the logistic of the difference of the log-densities (Mahalanobis distance by the Cholesky factors,
which are computed once and cached in the model, and their log-determinants) plus the difference of the log-priors.

Learning: a bounded sample, `per_class` labelled documents a class (the smallest seeded hashes in as many hash buckets over
all labelled rows that may be learned from); only their statistics reach the driver. The priors are the classes' shares of
all those rows.

Edge cases: a null text counts as empty; an empty text has the statistics of zero bytes and words and a score as any other;
a document with two labels counts for both; null labels or ids are not learned from, a null id counts as held out; with fewer than two classes to learn from every
score is 1 if the class is 1 or there is none, else 0; repeated rows score alike; input columns named as outputs are
replaced.
"""

from __future__ import annotations

import dataclasses
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, table

FEATURES = ["bytes", "upper", "digit", "mark", "bar", "symbol", "exclamation", "space", "line", "high", "word_length", "distinct", "again", "bare", "long_words"]


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    for k, chars in enumerate((range(65, 91), range(48, 58), b".,;:'\"-?()", b"|", b"#$%&*@~^_=+<>{}[]\\/`", b"!", b" \t", b"\n\r", range(128, 256)), 1):
        kind[list(chars)] = k
    return kind


_KIND = _kinds()


def statistics(texts: list[str]) -> np.ndarray:
    """Texts x FEATURES."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    data = _KIND[np.frombuffer(b"".join(raw), np.uint8)]
    counts = np.bincount(np.repeat(np.arange(len(raw)) * 10, size) + data, minlength=10 * len(raw)).reshape(-1, 10)[:, 1:]
    rest = np.zeros((len(raw), 5))
    for k, (r, t) in enumerate(zip(raw, texts)):
        words = r.split()
        n = len(words)
        if n:
            upper = sum(map(str.isupper, t.split()))
            rest[k] = (sum(map(len, words)) / n, (len(set(words)) + 10) / (n + 10), sum(a == b for a, b in pairwise(words)) / (n + 10), upper / (n + 10), sum(len(w) > 24 for w in words) / (n + 10))  # ten words more: a few repeats in a short text say little
    share = counts / np.maximum(size, 1)[:, None]
    log = lambda x, e: np.log((x + e) / e)
    out = np.empty((len(raw), len(FEATURES)))
    out[:, 0] = np.log1p(size)
    out[:, 1:10] = log(share, 0.01)
    out[:, 7] = np.sqrt(share[:, 6])  # spaces: common, hence less skewed
    out[:, 9] = np.sqrt(share[:, 8])
    out[:, 10] = np.log1p(rest[:, 0])
    out[:, 11] = np.sqrt(rest[:, 1])
    out[:, 12:] = log(rest[:, 2:], 0.02)
    return out


@dataclasses.dataclass
class Qda:
    mean: np.ndarray  # classes x features
    factor: np.ndarray  # classes x features x features: cached Cholesky factors of the shrunk covariances
    log_det: np.ndarray
    log_prior: np.ndarray
    only: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        density = []
        for c in (0, 1):
            y = np.linalg.solve(self.factor[c], (x - self.mean[c]).T)  # its squares sum to the Mahalanobis distance
            density.append(self.log_prior[c] - self.log_det[c] - 0.5 * (y * y).sum(0))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, to_pooled: float = 0.3, to_identity: float = 0.05) -> Qda:
    if len(set(y.tolist())) < 2:
        return Qda(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), float(y[0]) if len(y) else 1.0)
    groups = [x[y == c] for c in (0, 1)]
    mean = np.array([g.mean(0) for g in groups])
    cov = [np.cov(g.T, bias=True).reshape(x.shape[1], -1) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, cov)) / len(x)
    ridge = max(np.trace(pooled) / x.shape[1], 1e-6) * np.eye(x.shape[1])
    factor = [np.linalg.cholesky((1 - to_pooled - to_identity) * c + to_pooled * pooled + to_identity * ridge) for c in cov]
    return Qda(mean, np.array(factor), np.array([np.log(np.diag(f)).sum() for f in factor]), np.log(prior / prior.sum()))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, seed: int = 9) -> Qda:
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    may = labels.filter(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"), key.alias("h"))
    slots = may.groupBy("quality", F.pmod("h", F.lit(per_class)).alias("slot")).agg(F.min("h").alias("h"), F.count("*").alias("n"))
    chosen = slots.collect()  # 2 x per_class rows at most, of numbers
    prior = np.array([sum(r.n for r in chosen if r.quality == c) for c in (0, 1)], float)
    spark = docs.sparkSession
    picked = spark.createDataFrame([(r.h, r.quality) for r in chosen], "h long, quality int")
    rows = docs.select("text", key.alias("h")).join(F.broadcast(picked), "h")  # as many rows as picked

    def make():
        return lambda texts: (pa.array(statistics(texts).tolist(), pa.list_(pa.float64())),)

    found = append_columns(rows, {"x": "array<double>"}, "text", make).groupBy("h", "quality").agg(F.min("x").alias("x")).collect()
    found = sorted(found, key=lambda r: (r.quality, r.h))
    x = np.array([r.x for r in found], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.quality for r in found], int), np.maximum(prior, 1))


def score(docs: DataFrame, model: Qda, threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted."""

    def make():
        return lambda texts: (pa.array(model.score(statistics(texts)), pa.float64()),)

    out = append_columns(docs.drop("predicted"), {"score": "double"}, "text", make)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
