"""Language-model scores from a hidden Markov model, beside a unigram base score.

Texts are encoded once, in blocks of bounded size with a vocabulary of their own, in the order of the words' hashes. Word
counts over the whole training part come from the blocks' vocabularies: a block sends those of each range of hashes as
one array, a task sums one range and sends the sums back in the same order; no vocabulary is gathered anywhere. The hidden states emit word classes (a hash of the word), and a class emits its words by their
training counts, so the model's tables have a fixed size: states x classes. Baum-Welch counts are summed within each
task, then over tasks, and re-estimated on the driver for a fixed number of rounds. A text's score is the exact
likelihood of its whole sequence, by forward recursion with scaling at every token.

In training, texts are taken in segments of SEGMENT tokens. Every training token counts. A word unknown in training
shares one half-count slot of its class, as in the base score.

Defined results: a null text counts as empty and has one token, the end. A null id is held out as the empty text's
crc says. Without any training row, N and V are 0 and all tokens unknown. Repeated rows give repeated results. Only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm.arrow import slices, texts
from quarrion.llm.shared import crc_mod5, kind_of, written
from quarrion.shipping import shipped

STATES, CLASSES, ROUNDS, SEGMENT = 4, 16384, 4, 128
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: Words of all blocks in a range of hashes, about.
RANGE_WORDS = 400_000
STAY = 0.97

BLOCKS = "docs array<{kind}>, held array<boolean>, lengths array<int>, seq binary, classes binary, words array<binary>, n array<int>, n_words long"


class Local(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def classes_of(hashes: np.ndarray) -> np.ndarray:
    return hashes % np.uint64(CLASSES)


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unpacked(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    docs, held, seqs, local, size = [], [], [], Local(), 0

    def block() -> pa.RecordBatch:
        words = list(local)
        hashes = hashes_of(words)
        order = np.argsort(hashes)
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words))
        train = np.concatenate([np.empty(0, np.uint32), *(s for s, h in zip(seqs, held, strict=True) if not h)])
        n = np.bincount(rank[train].astype(np.int64), minlength=len(words))
        row = (docs, held, list(map(len, seqs)), _packed(rank[np.concatenate(seqs)]), _packed(classes_of(hashes[order]).astype(np.uint16)), [words[k] for k in order.tolist()], n, len(words))
        kinds = (pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.int64())
        return pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["docs", "held", "lengths", "seq", "classes", "words", "n", "n_words"])

    for batch in slices(batches, 64):
        kind = batch.column("doc_id").type
        for doc, h, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), texts(batch.column("text")), strict=True):
            words = text.lower().split()
            docs.append(doc)
            held.append(h)
            seqs.append(np.fromiter(map(local.__getitem__, words), np.uint32, len(words)))
            size += len(text) + 64
            if size >= block_bytes:
                yield block()
                docs, held, seqs, local, size = [], [], [], Local(), 0
    if docs:
        yield block()


@dataclass(frozen=True)
class Model:
    """start, move and emit of the hidden chain, over the word classes and, last, the end."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(class_counts: np.ndarray, states: int) -> Model:
    """Class frequencies, tilted differently for each state by a fixed generator, so that the states can part."""
    random = np.random.default_rng(20240229)
    emit = (class_counts + 0.5)[None, :] * np.exp(random.normal(0, 1, (states, len(class_counts))))
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY if states > 1 else 1)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


def _padded(seqs: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by falling length, and how many rows reach each place."""
    seqs = sorted(seqs, key=len, reverse=True)
    ids = np.full((len(seqs[0]), len(seqs)), end)
    for k, s in enumerate(seqs):
        ids[: len(s), k] = s
    lengths = np.array(list(map(len, seqs)))
    return ids, np.searchsorted(-lengths, -np.arange(len(seqs[0])), "left")


def expected_counts(model: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of the sequences (forward-backward)."""
    states, classes = model.emit.shape
    ids, reach = _padded(seqs, classes - 1)
    table = np.ascontiguousarray(model.emit.T)
    steps, rows = ids.shape
    alpha, scale = np.zeros((steps, rows, states)), np.ones((steps, rows))
    for t in range(steps):
        m = reach[t]
        a = (np.tile(model.start, (m, 1)) if t == 0 else alpha[t - 1, :m] @ model.move) * table[ids[t, :m]]
        scale[t, :m] = a.sum(1)
        alpha[t, :m] = a / scale[t, :m, None]
    moves, beta = np.zeros_like(model.move), np.ones((rows, states))
    for t in range(steps - 1, 0, -1):
        m = reach[t]
        ahead = table[ids[t, :m]] * beta[:m] / scale[t, :m, None]
        alpha[t, :m] *= beta[:m]
        moves += alpha[t - 1, :m].T @ ahead
        beta[:m] = ahead @ model.move.T
    alpha[0] *= beta
    inside = np.arange(rows)[None, :] < reach[:, None]
    flat, gamma = ids[inside], alpha[inside]
    emits = np.stack([np.bincount(flat, gamma[:, s], classes) for s in range(states)])
    return alpha[0].sum(0), moves * model.move, emits


def log10_likelihood(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Of each sequence, whole, by forward recursion."""
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    lengths = np.array([len(seqs[k]) for k in order])
    flat, first = np.concatenate([seqs[k] for k in order]), np.cumsum(lengths) - lengths
    table, total = np.ascontiguousarray(model.emit.T), np.zeros(len(seqs))
    reach = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
    alpha = model.start[None, :]
    for t, m in enumerate(reach.tolist()):
        alpha = (alpha[:m] @ model.move if t else np.tile(alpha, (m, 1))) * table[flat[first[:m] + t]]
        scale = alpha.sum(1)
        total[:m] += np.log10(scale)
        alpha /= scale[:, None]
    out = np.empty(len(seqs))
    out[order] = total
    return out


def _sequences(row: dict, end: int) -> list[np.ndarray]:
    """Classes of each text of a block, with the end."""
    classes = _unpacked(row["classes"], np.uint16)
    flat = classes[_unpacked(row["seq"], np.uint32)] if len(classes) else np.empty(0, np.uint16)
    return [np.append(s, np.uint16(end)) for s in np.split(flat, np.cumsum(row["lengths"])[:-1])]


def _trained(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model = sent.value
    states, classes = model.emit.shape
    sums = [np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))]
    for batch in slices(batches, 1):
        row = batch.to_pylist()[0]
        segments = [s[at : at + SEGMENT] for s, h in zip(_sequences(row, classes - 1), row["held"], strict=True) if not h for at in range(0, len(s), SEGMENT)]
        if segments:
            for total, x in zip(sums, expected_counts(model, segments), strict=True):
                total += x
    flat = np.concatenate([x.ravel() for x in sums])
    at = np.flatnonzero(flat)
    yield pa.record_batch([pa.array(at, pa.int32()), pa.array(flat[at], pa.float64())], ["at", "x"])


def train(blocks: DataFrame, class_counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training texts."""
    model, classes = first_model(class_counts, states), len(class_counts)
    sequences = blocks.select("held", "lengths", "seq", "classes")
    for _ in range(rounds):
        sent = blocks.sparkSession.sparkContext.broadcast(model)
        sums = sequences.mapInArrow(partial(_trained, sent=sent), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        flat = np.zeros(states + states * states + states * classes)
        flat[sums["at"].to_numpy()] = sums["x"].to_numpy()
        start, move, emit = flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 :].reshape(states, classes)
        prior = (class_counts + 0.5) / (class_counts + 0.5).sum()
        start, move, emit = start + 0.5, move + 0.5, emit + states * prior
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
        sent.unpersist()
    return model


def _dealt(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """A block's words and counts, one row for each range of hashes."""
    for batch in slices(batches, 1):
        words = batch.column("words").flatten().to_pylist()
        n = batch.column("n").flatten().to_numpy()
        of = ((hashes_of(words) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(of, prepend=-1))
        ends = [*cuts[1:].tolist(), len(words)]
        parts = [(b"\n".join(words[a:b]), n[a:b].astype(np.int32).tobytes()) for a, b in zip(cuts.tolist(), ends, strict=False)]
        yield pa.record_batch(
            [pa.array(np.repeat(batch.column("block").to_numpy(), len(parts))), pa.array(of[cuts]), pa.array([w for w, _ in parts], pa.binary()), pa.array([c for _, c in parts], pa.binary())], ["block", "of", "words", "n"]
        )


SUMMED = "c_block long, of int, counts binary, cls array<int>, tokens array<long>, words array<long>"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task has one range: the sums of each row's words, in their order, and sums of tokens and words by class."""
    rows: list[tuple] = []
    for batch in batches:
        rows += zip(*(batch.column(c).to_pylist() for c in ("block", "of", "words", "n")), strict=True)
    sums: dict[bytes, int] = {}
    for _, _, words, n in rows:
        for word, k in zip(words.split(b"\n"), np.frombuffer(n, np.int32).tolist(), strict=True):
            sums[word] = sums.get(word, 0) + k
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = [x.split()[0] for x in SUMMED.split(", ")]
    for block, of, words, _ in rows:
        counts = _packed(np.fromiter(map(sums.__getitem__, words.split(b"\n")), np.int64))
        yield pa.record_batch([pa.array([x], k) for x, k in zip((block, of, counts, None, None, None), kinds, strict=True)], names)
    seen = {w: k for w, k in sums.items() if k}
    cls = classes_of(hashes_of(list(seen))).astype(np.int64)
    tokens, words = np.bincount(cls, np.fromiter(seen.values(), np.int64, len(seen)), CLASSES).astype(np.int64), np.bincount(cls, minlength=CLASSES)
    at = np.flatnonzero(words)
    yield pa.record_batch([pa.array([x], k) for x, k in zip((None, None, None, at, tokens[at], words[at]), kinds, strict=True)], names)


SCORES = "doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model, total, distinct, ends, class_tokens, class_words = sent.value
    floor = total + 0.5 * (distinct + 1)
    within = np.log10(class_tokens + 0.5 * (class_words + 1))
    for batch in slices(batches, 1):
        row = batch.to_pylist()[0]
        seqs = _sequences(row, len(class_tokens))
        counts = np.concatenate([np.empty(0, np.int64), *(_unpacked(x["counts"], np.int64) for x in sorted(row["parts"] or (), key=lambda x: x["of"]))])
        seq, classes = _unpacked(row["seq"], np.uint32), _unpacked(row["classes"], np.uint16)
        part = np.cumsum([0, *row["lengths"]])
        c = counts[seq] if len(counts) else np.empty(0)

        def summed(x: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(x)])[part])

        # Sums run text by text, as differences of one long running sum lose digits.
        of = np.repeat(np.arange(len(seqs)), row["lengths"])
        half = np.bincount(of, np.log10(c + 0.5), len(seqs))
        n = np.array(row["lengths"], np.int64) + 1
        base = half + np.log10(ends + 0.5) - n * np.log10(floor)
        score = log10_likelihood(model, seqs) + half - np.bincount(of, within[classes[seq]] if len(classes) else np.empty(0), len(seqs))
        columns = [pa.array(row["docs"], batch.column("docs").type.value_type), pa.array(row["held"], pa.bool_()), pa.array(n), pa.array(summed(c > 0).astype(np.int64) + (ends > 0)), pa.array(np.full(len(n), total)), pa.array(base), pa.array(score)]
        yield pa.record_batch(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES, range_words: int = RANGE_WORDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = shipped(docs).select(F.col(id_col).alias("doc_id"), (crc_mod5(id_col) == 1).alias("held"), F.col(text_col).cast("string").alias("text"))
    blocks = written(rows.mapInArrow(partial(_blocks, block_bytes=block_bytes), BLOCKS.format(kind=kind_of(docs, id_col))).withColumn("block", F.monotonically_increasing_id()))

    ranges = max(1, -(-blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0] // range_words))
    dealt = blocks.select("block", "words", "n").mapInArrow(partial(_dealt, ranges=ranges), "block long, of int, words binary, n binary")
    summed = written(dealt.repartitionById(ranges, F.col("of")).mapInArrow(_summed, SUMMED))

    stats = summed.filter("cls is not null").select(F.explode(F.arrays_zip("cls", "tokens", "words")).alias("x")).groupBy("x.cls").agg(F.sum("x.tokens").alias("tokens"), F.sum("x.words").alias("words")).toArrow()
    tokens, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    tokens[stats["cls"].to_numpy()], distinct[stats["cls"].to_numpy()] = stats["tokens"].to_numpy(), stats["words"].to_numpy()
    ends = blocks.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()[0]
    model = train(blocks, np.append(tokens, ends), states, rounds)
    sent = spark.sparkContext.broadcast((model, int(tokens.sum() + ends), int(distinct.sum() + (ends > 0)), ends, tokens, distinct))
    whole = blocks.select("block", "docs", "held", "lengths", "seq", "classes")
    parts = summed.filter("c_block is not null").groupBy("c_block").agg(F.collect_list(F.struct("of", "counts")).alias("parts"))
    return whole.join(parts, F.col("block") == F.col("c_block"), "left").drop("block", "c_block").mapInArrow(partial(_scored, sent=sent), SCORES.format(kind=kind_of(docs, id_col)))
