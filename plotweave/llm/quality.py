"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Statistics of a text are transformed towards normal shape (logarithms of counts, logits of
shares). Each class gets its mean and a covariance shrunk towards its diagonal and, a little,
towards the pooled one; the score is the logistic function of the difference of the two
log densities (Mahalanobis distance and log determinant, both from cached Cholesky factors)
plus the log odds of the classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.bytekit import CHUNK_BYTES, NOT_SPACE, RollingHash, chunks, tokens, utf8

#: Labelled rows of each class that the classifier is fitted on, at most (those of smallest id hash).
FIT_ROWS = 10_000
#: Share of the diagonal and of the pooled covariance in each class covariance.
TO_DIAGONAL, TO_POOLED, RIDGE = 0.05, 0.05, 1e-3
FEATURES = 12

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_ALPHA = _UPPER | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
_DIGIT = (_B >= 48) & (_B <= 57)
_STOP = np.isin(_B, list(b".!?"))
_SYMBOL = np.isin(_B, list(b"#*$%&|<>{}[]\\/_=~^@"))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Logit of a share, with half a count on either side."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    n = len(offsets) - 1
    if not len(data):
        return np.tile(_empty(), (n, 1))
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(float)
    start, end, upto = tokens(data, offsets, NOT_SPACE)
    words, size = np.diff(upto).astype(float), np.diff(offsets).astype(float)
    row = np.repeat(np.arange(n), np.diff(upto))
    value = RollingHash(data)(start, end)
    solid = count(NOT_SPACE[data])
    # Distinct words, and words equal to the one before.
    order = np.lexsort((value, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (value[order][1:] != value[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][fresh], minlength=n).astype(float)
    again = np.zeros(len(value), bool)
    again[1:] = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
    twice = np.bincount(row[again], minlength=n).astype(float)
    length = end - start
    long_words = np.bincount(row[length > 12], minlength=n).astype(float)
    short_words = np.bincount(row[length <= 3], minlength=n).astype(float)
    bare = np.bincount(row[~_ALPHA[data[start]]], minlength=n).astype(float)
    spread = np.bincount(row, np.square(length - 6.0), minlength=n) / np.maximum(words, 1)
    return np.column_stack(
        [
            np.log1p(words),
            np.log1p(solid / np.maximum(words, 1)),
            np.log1p(spread),
            _share(distinct, words) - 0.5 * np.log1p(words),
            _share(twice, words),
            _share(long_words, words),
            _share(short_words, words),
            _share(bare, words),
            _share(count(_SYMBOL[data]), solid),
            _share(count(_DIGIT[data]), solid),
            _share(count(_STOP[data]), words),
            _share(count(data == 10), size),
        ]
    )


def _empty() -> np.ndarray:
    return np.zeros(FEATURES)


@dataclass
class Discriminant:
    """Two normal densities in whitened form; log odds of label 1."""

    shift: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    prior: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, prior: float) -> Discriminant:
        """prior: log odds of label 1. A class without rows takes part with the other's density."""
        shift, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
        z = np.clip((x - shift) / scale, -8, 8)
        parts = [z[y == k] if (y == k).any() else z for k in (0, 1)]
        covs = [np.cov(p, rowvar=False) if len(p) > 1 else np.eye(FEATURES) for p in parts]
        pooled = sum(c * max(1, len(p)) for c, p in zip(covs, parts, strict=True)) / max(2, sum(len(p) for p in parts))
        means = [p.mean(0) if len(p) else np.zeros(FEATURES) for p in parts]
        factors = []
        for c in covs:
            c = (1 - TO_DIAGONAL - TO_POOLED) * c + TO_DIAGONAL * np.diag(np.diag(c)) + TO_POOLED * pooled
            factors.append(np.linalg.cholesky(c + RIDGE * np.eye(FEATURES)))
        return cls(shift, scale, means, factors, [2 * float(np.log(np.diag(f)).sum()) for f in factors], prior)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.shift) / self.scale, -8, 8)
        logs = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets, strict=True):
            white = np.linalg.solve(factor, (z - mean).T)
            logs.append(-0.5 * (np.square(white).sum(0) + log_det))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.prior, -500, 500)))


def by_text(docs: DataFrame, keep: list[str], make, schema: str, name: str) -> DataFrame:
    """docs[keep] and one column of make(bytes, offsets), in Arrow batches cut to bounded chunks of text."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(len(keep)))
            for i, j in chunks(offsets, CHUNK_BYTES):
                made = make(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.record_batch([*(batch.column(k).slice(i, j - i) for k in range(len(keep))), made], [*keep, name])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, {name} {schema}".lstrip(", "))


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)).cast("int")


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, label and text of at most `rows` rows of each class, and the sizes of the classes.

    An id with contradicting labels takes the larger. Only rows for which `learn` holds count.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).where(learn)
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id", F.lit(7))
    picked = known.where("label = 0").orderBy(order, "doc_id").limit(rows).unionByName(known.where("label = 1").orderBy(order, "doc_id").limit(rows))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), sizes  # at most 2 * rows rows


def fitted(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = FIT_ROWS) -> Discriminant:
    sample, sizes = fit_sample(docs, labels, "quality", learn, rows)
    made = by_text(sample, ["label"], lambda d, o: pa.array(list(statistics(d, o)), pa.list_(pa.float64())), "array<double>", "x").collect()
    x = np.array([r["x"] for r in made]).reshape(-1, FEATURES)
    y = np.array([r["label"] for r in made], int)
    order = np.lexsort((*x.T, y))  # the order in which rows arrive does not matter
    return Discriminant.fit(x[order], y[order], float(np.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1))))


def scored(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of every row; null and empty texts have the statistics of an empty text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    return by_text(docs, ["doc_id"], lambda d, o: pa.array(sent.value.score(statistics(d, o)), pa.float64()), "double", "score")


def digest(scores: DataFrame, held_out: Column, threshold: float = 0.3) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: learned where the remainder by 5 is not 0.

    Null and empty texts have the statistics of an empty text; a row with a null id counts as
    learned from, but has no label. Repeated rows get equal scores. Without labels of both classes
    all texts score alike; an empty table gives no rows. Other columns are ignored.
    """
    model = fitted(docs, labels, remainder(5) != 0)
    return digest(scored(docs, model), remainder(5) == 0)
