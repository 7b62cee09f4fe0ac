"""Toxicity: bags of subword embeddings, averaged into a linear softmax, all trained together.

A word contributes itself and its character n-grams (of bytes, word boundaries included), each
hashed to a row of an embedding table, so misspellings share rows with what they were made
from. The bag of a segment of words is averaged and goes through a softmax of two classes. A
text is as toxic as its most toxic segment: training looks up that segment with the current
model and takes its gradient step there, and scoring takes the maximum over all segments, so
that a few words count the same in a short and in a very long text.

As the softmax is linear in the average, a trained table is folded to one number for each row,
and a text is scored by sums of looked-up numbers over its segments.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.bytekit import LOWER, LOWER_ALNUM, RollingHash, gather_ranges, mix64, tokens, written
from plotweave.llm.quality import by_text, digest, fit_sample, remainder

BITS = 17
DIM = 12
GRAMS = (3, 4, 5)
SEGMENT = 12
#: Labelled rows of each class in the training sample, and bytes of text of each class, at most; texts are always whole.
FIT_ROWS, FIT_BYTES = 2_000, 16 << 20
#: Passes over the sample (more over a small one, so that STEPS batches are seen), and step size.
EPOCHS, STEPS, RATE, SEED = 20, 1_000, 0.4, 11
#: Training texts that a subword must occur in.
SHARED = 4


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The words as a stream "<ab<cd<" with one boundary byte before, between and after them.

    Gives words up to each text, the stream position of each word's opening boundary (and the
    end), and for each kind of subword the stream positions where one starts and its table row.
    """
    data = LOWER[data]
    start, end, upto = tokens(data, offsets, LOWER_ALNUM)
    length = end - start
    at = np.concatenate([[0], np.cumsum(length + 1)])
    stream = np.full(at[-1] + 1, 1, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    stream[1:][inside] = data[gather_ranges(start, length)]
    rolling = RollingHash(stream)
    shift = np.uint64(64 - BITS)
    made = [(at[:-1], (rolling(at[:-1], at[1:] + 1) >> shift).astype(np.int32))]
    closing = np.repeat(at[1:], length + 1)  # of the word that a stream position belongs to
    for n in GRAMS:
        first = np.flatnonzero(np.arange(len(closing)) + n <= closing + 1)
        made.append((first, (mix64(rolling.grams(n)[first]) >> shift).astype(np.int32)))
    return upto, at, made


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of the subwords in the order of words; subwords up to each word; words up to each text."""
    upto, at, made = subwords(data, offsets)
    place = np.concatenate([p for p, _ in made])
    order = np.argsort(place, kind="stable")
    rows = np.concatenate([r for _, r in made])[order]
    return rows, np.searchsorted(place[order], at), upto


def segments(upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word and text of each segment: SEGMENT words, the last one moved back to be whole."""
    words = np.diff(upto)
    count = -(-words // SEGMENT)
    text = np.repeat(np.arange(len(words)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(nth * SEGMENT, np.maximum(words[text] - SEGMENT, 0)) + upto[text]
    return first, np.minimum(first + SEGMENT, upto[text + 1]), text


@dataclass
class Subwords:
    """What is left of a trained model: the log-odds weight of each table row, and the bias."""

    weight: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        upto, at, made = subwords(data, offsets)
        best = np.full(len(offsets) - 1, 0.0)
        if len(at) > 1:
            value, count = np.zeros(at[-1], np.float32), np.zeros(at[-1], np.int32)
            for place, rows in made:
                value[place] += self.weight[rows]
                count[place] += 1
            total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
            upto_sub = np.concatenate([[0], np.cumsum(count)])
            first, end, text = segments(upto)
            a, b = at[first], at[end]
            mean = (total[b] - total[a]) / np.maximum(upto_sub[b] - upto_sub[a], 1)
            best = np.full(len(best), -np.inf)
            np.maximum.at(best, text, mean)
            best[~np.isfinite(best)] = 0.0
        return 1 / (1 + np.exp(-np.clip(best + self.bias, -500, 500)))


def train(texts, labels: np.ndarray, odds: float) -> Subwords:
    """texts: table rows of all subwords of a text's segments, and subwords in each segment; gone through twice.

    odds: log odds of label 1 where the model is used.
    """
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    positive = int((labels == 1).sum())
    if 0 < positive < len(labels):
        # Subwords of fewer than SHARED texts could only be learned by heart: they count in the
        # length of a bag, as unseen ones will, but have no embedding.
        shared = np.zeros(1 << BITS, np.int32)
        for rows, _ in texts:
            shared[np.unique(rows)] += 1
        shared = shared >= SHARED
        table[~shared] = 0
        sizes, first, begin, flat = [], [0], [], []
        for rows, n in texts:
            kept = shared[rows]
            sizes.append(n)
            first.append(first[-1] + len(n))
            begin.append(np.diff(np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(n)])]))
            flat.append(rows[kept])
        sizes, first, flat = np.concatenate(sizes), np.array(first), np.concatenate(flat)
        begin = np.concatenate([[0], np.cumsum(np.concatenate(begin))])
        order = np.arange(len(labels))
        epochs = max(EPOCHS, STEPS * 32 // len(labels))
        for epoch in range(epochs):
            if epoch < max(2, epochs // 4):
                chosen = first[:-1] + rng.integers(0, np.maximum(1, np.diff(first)))
            else:
                chosen = _most_toxic(table @ (softmax[:, 1] - softmax[:, 0]), flat, begin, sizes, first)
            rng.shuffle(order)
            rate = RATE * (1 - epoch / epochs) + 0.02
            for some in np.array_split(order, max(1, len(order) // 32)):
                some = some[first[some] < first[some + 1]]
                if not len(some):
                    continue
                seg = chosen[some]
                rows = np.concatenate([flat[begin[s] : begin[s + 1]] for s in seg])
                owner = np.repeat(np.arange(len(seg)), begin[seg + 1] - begin[seg])
                hidden = np.zeros((len(seg), DIM), np.float32)
                np.add.at(hidden, owner, table[rows])
                hidden /= sizes[seg][:, None]
                z = hidden @ softmax + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(seg)), labels[some]] -= 1
                back = (p @ softmax.T) / sizes[seg][:, None]
                softmax -= rate * hidden.T @ p / len(seg) * 4
                bias -= rate * p.mean(0)
                np.add.at(table, rows, (-rate * 4 * back)[owner])
    weight = (table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    used = np.log(max(positive, 1) / max(len(labels) - positive, 1))
    return Subwords(weight, float(bias[1] - bias[0]) + odds - used)


def _most_toxic(weight, flat, begin, sizes, first, block: int = 256) -> np.ndarray:
    """The segment of largest mean weight of each text, for `block` texts at a time."""
    out = []
    for i in range(0, len(first) - 1, block):
        edge = first[i : i + block + 1]
        at = begin[edge[0] : edge[-1] + 1]
        total = np.concatenate([[0.0], np.cumsum(weight[flat[at[0] : at[-1]]], dtype=np.float64)])
        mean = np.diff(total[at - at[0]]) / np.maximum(sizes[edge[0] : edge[-1]], 1)
        out += [a + int(np.argmax(mean[a - edge[0] : b - edge[0]])) if a < b else 0 for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return np.array(out)


class Bags:
    """What `train` needs of whole texts, made anew each time it is gone through: texts are much smaller."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts

    def __iter__(self):
        for text in self.texts:
            data = np.frombuffer(text, np.uint8)
            rows, upto_word, upto = features(data, np.array([0, len(data)]))
            first, end, _ = segments(upto)
            size = upto_word[end] - upto_word[first]
            yield rows[gather_ranges(upto_word[first], size)], size.astype(np.int32)


def fitted(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Subwords:
    """Trains on the driver on whole texts: `rows` of each class at most, and `most_bytes` of each class at most (in the order of a hash of the id).

    A text of more than a sixteenth of `most_bytes` is not learned from (it is scored like all others),
    so that no text takes the place of many.
    """
    sample, sizes = fit_sample(docs, labels, "toxic", learn, rows)
    sample = written(sample, "sample")
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "bytes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lengths = sample.select("doc_id", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    some = lengths.where(F.col("bytes") <= most_bytes // 16).withColumn("upto", F.sum("bytes").over(order)).where(F.col("upto") <= most_bytes).select("doc_id").distinct()
    made = sample.join(some, "doc_id", "left_semi").toArrow()
    made = made.take(np.lexsort((pc.binary_length(made["text"].fill_null("")).to_numpy(), made["doc_id"].to_numpy())))
    texts = [(x or "").encode() for x in made["text"].to_pylist()]
    odds = float(np.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1)))
    return train(Bags(texts), made["label"].to_numpy().astype(int), odds)


def scored(docs: DataFrame, model: Subwords) -> DataFrame:
    """doc_id and score of every row; texts without words score as the bias alone does."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers
    return by_text(docs, ["doc_id"], lambda d, o: pa.array(sent.value.score(d, o), pa.float64()), "double", "score")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: learned where the remainder by 4 is not 2.

    Null and empty texts score as the bias alone does; a row with a null id counts as learned
    from, but has no label. Repeated rows get equal scores. Without labels of both classes all
    texts score alike; an empty table gives no rows. Other columns are ignored.
    """
    model = fitted(docs, labels, remainder(4) != 2)
    return digest(scored(docs, model), remainder(4) == 2)
