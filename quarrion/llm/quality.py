"""Quality scores from random-indexing word vectors and a small network.

Tokens are runs of letters and digits, and runs of other characters but white space; lower-cased, they fall into 2**CLASS_BITS
hashed classes. Each class has a fixed sparse index vector: SPARSE of DIMS places hold 1 or -1, from a seeded generator. Its
context vector is the sum of the index vectors of all tokens within REACH places of its own, over all documents: one scan, whose
sums of integers are added up per task and then by a shuffle, so they don't depend on the partitioning. A word vector is the
context vector (logarithms of its sums, less their mean) and the index vector, both of unit length, one added to the other.

A document's vector is the mean of its tokens' vectors. Two more index vectors count as words of their own wherever a
token is shouted (two or more letters, upper case only) or repeats the token before it. A network of one hidden layer with tanh
and one output, in numpy, is trained on about TRAIN_ROWS labelled rows (those whose hashed id falls below a bound; their whole
texts). Rows whose crc32(id as text) mod 5 is 0 are never learned from; where it is 4, rows fit the temperature by which the
output is divided before the logistic function, so that scores are calibrated; the others train the weights.

What passes through the driver is bounded by parameters: (2**CLASS_BITS) * DIMS sums, and TRAIN_ROWS vectors.

Defined results: a null or empty text has the zero vector, which is scored like any other. If no row teaches both qualities, the
score of all documents is the smoothed share of good ones, 0.5 without labels. Of several labels of an id the least counts; null
ids and null labels teach nothing. A null id counts as the empty text in the checksum. Repeated rows give repeated
results. Without documents there are no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm.arrow import list_of, slices, texts
from quarrion.llm.shared import crc_mod5
from quarrion.shipping import shipped

CLASS_BITS, DIMS, SPARSE, REACH = 13, 64, 4, 2
TRAIN_ROWS, HIDDEN, ROUNDS, BATCH, RATE, DECAY = 20_000, 24, 40, 128, 0.01, 1e-4
THRESHOLD = 0.3
#: Classes of their own: shouted tokens, repeated ones, and what stands between documents.
CLASSES = 1 << CLASS_BITS
SHOUTED, REPEATED, BETWEEN = CLASSES, CLASSES + 1, CLASSES + 2
#: Bytes of text whose tokens, and tokens whose contexts, are held at once.
PIECE, TOKENS = 1 << 18, 1 << 20

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
_SPACE = re.compile(rb"\s")
_SHOUT = 1 << 30


class Codes(dict):
    """Class of each token, and if it is shouted, kept for the tokens seen lately."""

    MOST = 100_000

    def __missing__(self, token: bytes) -> int:
        if len(self) > self.MOST:
            self.clear()
        code = xxhash.xxh3_64_intdigest(token.lower()) & (CLASSES - 1)
        if len(token) > 1 and token.isupper():
            code |= _SHOUT
        self[token] = code
        return code


def classes(text: bytes, codes: Codes) -> tuple[np.ndarray, int, int]:
    """Classes of a text's tokens, and how many are shouted and repeated."""
    parts, at = [], 0
    while at < len(text):
        gap = _SPACE.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        tokens = _TOKEN.findall(text, at, end)
        parts.append(np.fromiter(map(codes.__getitem__, tokens), np.int32, len(tokens)))
        at = end
    own = np.concatenate(parts) if parts else np.empty(0, np.int32)
    shouted = int((own >= _SHOUT).sum())
    own &= CLASSES - 1
    return own, shouted, int((own[1:] == own[:-1]).sum())


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero cells, by class; what stands between documents has none."""
    rng = np.random.default_rng(11)
    places = np.argsort(rng.random((BETWEEN + 1, DIMS)), axis=1)[:, :SPARSE]
    signs = rng.choice([-1, 1], (BETWEEN + 1, SPARSE))
    signs[BETWEEN] = 0
    return places, signs


def context_sums(own: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sums of the neighbours' index vectors, flat by class and place."""
    total = np.zeros((BETWEEN + 1) * DIMS)
    for reach in range(1, REACH + 1):
        left, right = own[:-reach].astype(np.int64), own[reach:].astype(np.int64)
        for a, b in ((left, right), (right, left)):
            for k in range(SPARSE):
                total += np.bincount(a * DIMS + places[b, k], signs[b, k], len(total))
    return total[: CLASSES * DIMS].astype(np.int64)


def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, total = Codes(), np.zeros(CLASSES * DIMS, np.int64)
    vectors, apart = index_vectors(), np.full(REACH, BETWEEN, np.int32)
    held, n = [], 0
    for batch in slices(batches):
        for text in texts(batch.column("text")):
            held += (classes(text, codes)[0], apart)
            n += len(held[-2]) + REACH
            if n >= TOKENS:
                total += context_sums(np.concatenate(held), *vectors)
                held, n = [], 0
    if held:
        total += context_sums(np.concatenate(held), *vectors)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], ["cell", "n"])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-12)


def word_vectors(rows: DataFrame, text_col: str = "text") -> np.ndarray:
    """Vectors by class, from the contexts in all rows."""
    own = shipped(rows).select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
    found = own.mapInArrow(_context, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(CLASSES * DIMS)
    sums[found["cell"].to_numpy()] = found["n"].to_numpy()
    context = (np.sign(sums) * np.log1p(np.abs(sums))).reshape(CLASSES, DIMS)
    seen = context.any(1)
    context[seen] -= context[seen].mean(0) if seen.any() else 0
    index = np.zeros((CLASSES + 2, DIMS))
    places, signs = index_vectors()
    np.put_along_axis(index, places[:BETWEEN], signs[:BETWEEN].astype(float), 1)
    vectors = _unit(index)
    vectors[:CLASSES] += _unit(context)
    return vectors.astype(np.float32)


def pooled(text: bytes, vectors: np.ndarray, codes: Codes) -> np.ndarray:
    own, shouted, repeated = classes(text, codes)
    total = shouted * vectors[SHOUTED].astype(np.float64) + repeated * vectors[REPEATED]
    for at in range(0, len(own), 1 << 16):
        total += vectors[own[at : at + (1 << 16)]].sum(0, dtype=np.float64)
    return total / max(1, len(own))


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.logits(x) / self.temperature)


def logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def loss(z: np.ndarray, y: np.ndarray) -> float:
    """Mean negative log likelihood of labels."""
    return float(np.mean(np.logaddexp(0, z) - y * z))


def trained(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, rounds: int = ROUNDS) -> Network:
    """Two layers by Adam on the log likelihood, from a fixed seed."""
    rng = np.random.default_rng(5)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    share = (y.sum() + 0.5) / (len(y) + 1)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log(share / (1 - share)))]
    first, second, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            h = np.tanh(x[rows] @ w[0] + w[1])
            wrong = (logistic(h @ w[2] + w[3]) - y[rows]) / len(rows)
            back = np.outer(wrong, w[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((x[rows].T @ back + DECAY * w[0], back.sum(0), h.T @ wrong + DECAY * w[2], wrong.sum())):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, w[0], w[1], w[2], float(w[3]))


def fitted_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the outputs that makes the labels likeliest, between 1/8 and 8. Labels are smoothed by one row more of
    either, so that rows which are told apart without a fault don't ask for certainty."""
    good = y.sum()
    smooth = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    return float(min(np.exp2(np.linspace(-3, 3, 241)), key=lambda t: loss(z / t, smooth))) if len(y) else 1.0


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray | None
    network: Network | None
    share: float

    def scores(self, found: list[bytes], codes: Codes) -> np.ndarray:
        if self.network is None:
            return np.full(len(found), self.share)
        return self.network.scores(np.array([pooled(t, self.vectors, codes) for t in found]).reshape(len(found), DIMS))


def _pooled(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    codes = Codes()
    for batch in slices(batches):
        x = [pooled(t, sent.value, codes) for t in texts(batch.column("text"))]
        yield pa.record_batch([batch.column("part"), batch.column("quality"), list_of(x, pa.float64())], ["part", "quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    known = labels.select(F.col(label_id_col).alias("id"), F.col(label_col).cast("int").alias("quality")).filter("id is not null and quality is not null")
    known = known.withColumn("part", crc_mod5("id")).filter("part != 0").groupBy("id", "part").agg(F.min("quality").alias("quality"))
    n, good = known.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if not 0 < good < n:
        return Model(None, None, (good + 0.5) / (n + 1))
    bound = int(min(1.0, train_rows / n) * (2**62 - 1))
    sample = known.filter(F.shiftright(F.xxhash64("id"), 1).between(-bound, bound))
    spark = docs.sparkSession
    vectors = word_vectors(docs, text_col)
    sent = spark.sparkContext.broadcast(vectors)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id").select("part", "quality", "text")
    found = rows.mapInArrow(partial(_pooled, sent=sent), "part long, quality int, x array<double>").toArrow()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, DIMS)
    y, part = found["quality"].to_numpy().astype(float), found["part"].to_numpy()
    order = np.lexsort((*x.T, y, part))
    x, y, part = x[order], y[order], part[order]
    train, check = part != 4, part == 4
    if len(set(y[train].tolist())) < 2:
        return Model(None, None, (good + 0.5) / (n + 1))
    network = trained(x[train], y[train])
    return Model(vectors, Network(**{**vars(network), "temperature": fitted_temperature(network.logits(x[check]), y[check])}), good / n)


def _scored(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    codes = Codes()
    for batch in slices(batches):
        scores = sent.value.scores(texts(batch.column("text")), codes)
        yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """Per row: doc_id, held_out, score (how likely a text is good), and predicted (1 from the threshold on)."""
    docs = shipped(docs)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, **options))
    rows = docs.select(F.col(id_col).alias("doc_id"), (crc_mod5(id_col) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    found = rows.mapInArrow(partial(_scored, sent=sent), f"doc_id {kind}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
