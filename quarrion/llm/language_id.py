"""Language identification of spans and documents.

A word's script, by the range of its first letter, narrows the languages to those that were seen to use it. Among
these it is scored by the byte 3- and 4-grams of the lower-cased word with its boundaries (naive Bayes over hashed
grams). Viterbi over the words of a whole text, with a penalty for each switch, labels spans; the text's language is
the one whose spans hold most letters, and the score is their share.

The model is fitted on a bounded sample of the labelled rows: about TRAIN_ROWS per language, those whose hashed id
falls below a bound, whole texts; rows whose crc32(id as text) mod 5 is 0 are never learned from. Its tables have
languages x 2**GRAM_BITS cells. A prediction uses nothing but the text.

A word is a letter with the letters and combining marks that follow (so words of Indic scripts and Thai are whole).

Defined results: `und` with score 0 for null texts and texts without letters, and for all texts if there is no labelled
row. Ties go to the language that sorts first. Repeated rows give repeated results. The id keeps
its type. Only the named columns are read.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm.arrow import slices, texts
from quarrion.llm.shared import crc_mod5, kind_of
from quarrion.shipping import shipped

TRAIN_ROWS, GRAM_BITS, SWITCH, SCRIPT_SHARE = 2000, 16, 12.0, 0.01
#: Share of its letters that a text's language needs, to be kept in a filtering stage.
LEAST_SCORE = 0.3
#: How far below the worst language that uses a word's script the others score.
EXCLUDED = np.float32(1e4)
#: Words times languages that are held at once (a longer text is taken whole).
CELLS = 3_000_000

# Where each script's main ranges start.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2C00, "Glagolitic"), (0x2C60, "Latin"), (0x2DE0, "Cyrillic"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3400, "Han"), (0xA000, "Yi"), (0xA640, "Cyrillic"), (0xA720, "Latin"), (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
)
_STARTS, _NAMES = [s for s, _ in SCRIPTS], sorted({n for _, n in SCRIPTS})


@functools.cache
def word_pattern() -> re.Pattern:
    """Letters, and the combining marks (by their Unicode category) and letters after them; joiners don't part a word."""
    own = [c for c in range(0x300, 0x110000) if unicodedata.category(chr(c))[0] == "M"]
    starts = [c for c, before in zip(own, [-2, *own], strict=False) if c != before + 1]
    ends = [c for c, after in zip(own, [*own[1:], -1], strict=True) if after != c + 1]
    marks = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))
    # What comes before the first mark is ruled out at once.
    return re.compile(f"[^\\W\\d_]+(?:(?![\0-\u02ff])[{marks}\u200c\u200d]+[^\\W\\d_]*)*")


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text."""
    return word_pattern().findall(text.lower())


def script_of(letter: str) -> int:
    return _NAMES.index(SCRIPTS[max(0, bisect_right(_STARTS, ord(letter)) - 1)][1])


def gram_cells(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- and 4-grams of all words with their boundaries, and the word each belongs to."""
    flat = np.frombuffer(b"\x01\x01" + b"\x01\x01".join(words) + b"\x01\x01\x01", np.uint8).astype(np.uint32)
    ends = np.cumsum([len(w) + 2 for w in words])
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    of = np.searchsorted(ends, at, "right")
    three = flat[at] | flat[at + 1] << np.uint32(8) | flat[at + 2] << np.uint32(16)
    inside = at + 2 < ends[of] + 1 if len(at) else np.zeros(0, bool)
    four = (three | flat[at + 3] << np.uint32(24)) ^ np.uint32(0x5BD1E995)
    cells = np.concatenate([three[inside], four[inside]]) * np.uint32(0x9E3779B1) >> np.uint32(32 - GRAM_BITS)
    return cells.astype(np.int64), np.concatenate([of[inside], of[inside]])


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    grams: np.ndarray
    uses: np.ndarray


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of grams (cell below 2**GRAM_BITS) and of words by script (above), per language."""
    words: dict[str, Counter] = {}
    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text")), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text.decode()))
    for lang, counter in words.items():
        total = np.zeros((1 << GRAM_BITS) + len(_NAMES), np.int64)
        known, times = list(counter), np.fromiter(counter.values(), np.int64, len(counter))
        if known:
            cells, of = gram_cells([w.encode() for w in known])
            np.add.at(total, cells, times[of])
            np.add.at(total, [(1 << GRAM_BITS) + script_of(w[0]) for w in known], times)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "cell", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    lang = F.col(lang_col).cast("string")
    labelled = shipped(docs).filter(lang.isNotNull() & (crc_mod5(id_col) != 0)).select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"), F.shiftright(F.xxhash64(id_col), 1).alias("h"))
    rows = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(rows))
    if not langs:
        return Model((), np.zeros((0, 0)), np.zeros((0, 0)))
    bound = F.create_map(*(F.lit(x) for k, n in rows.items() for x in (k, int(min(1.0, train_rows / n) * (2**62 - 1)))))
    sample = labelled.filter(F.abs("h") <= F.element_at(bound, F.col("lang"))).select("lang", "text")
    counts = sample.mapInArrow(_counted, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    row = {k: i for i, k in enumerate(langs)}
    total = np.zeros((len(langs), (1 << GRAM_BITS) + len(_NAMES)))
    total[[row[k] for k in counts["lang"].to_pylist()], counts["cell"].to_numpy()] = counts["n"].to_numpy()
    grams, scripts = total[:, : 1 << GRAM_BITS] + 0.5, total[:, 1 << GRAM_BITS :]
    uses = scripts / np.maximum(1, scripts.sum(1, keepdims=True)) >= SCRIPT_SHARE
    return Model(langs, np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32).copy(), uses.T.copy())


class Scorer:
    """Score vectors and letters of words, and if a language uses their script, kept for the words seen lately."""

    MOST = 150_000

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.empty((0, len(self.model.langs)), np.float32)
        self.letters = np.empty(0, np.int32)
        self.known = np.empty(0, bool)

    def full(self) -> bool:
        return len(self.place) > self.MOST

    def rows(self, words: list[str]) -> np.ndarray:
        """Row of each word in scores and letters; rows hold until clear."""
        new = list(dict.fromkeys(w for w in words if w not in self.place))
        if new:
            cells, of = gram_cells([w.encode() for w in new])
            order = np.argsort(of, kind="stable")
            sums = np.add.reduceat(self.model.grams[cells[order]], np.searchsorted(of[order], np.arange(len(new))))
            uses = self.model.uses[[script_of(w[0]) for w in new]]
            known = uses.any(1)
            best = np.where(uses, sums, np.float32(-np.inf)).max(1, keepdims=True)
            worst = np.where(uses, sums, np.float32(np.inf)).min(1, keepdims=True)
            sums = np.where(uses, sums, worst - EXCLUDED) - best
            sums[~known] = 0
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, sums.astype(np.float32)])
            self.letters = np.concatenate([self.letters, np.fromiter(map(len, new), np.int32, len(new))])
            self.known = np.concatenate([self.known, known])
        return np.fromiter(map(self.place.__getitem__, words), np.int32, len(words))


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word. scores: the words of all texts, one after the other, by language; no length is 0."""
    if not len(lengths):
        return np.empty(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    reach = np.searchsorted(-lengths[order], -np.arange(lengths.max()), "left").tolist()
    came = np.empty(scores.shape, np.int8 if scores.shape[1] < 128 else np.int16)
    own = np.arange(scores.shape[1], dtype=came.dtype)
    value = scores[first].copy()
    for t in range(1, len(reach)):
        m = reach[t]
        v, at = value[:m], first[:m] + t
        top = v.argmax(1)
        best = v[np.arange(m), top][:, None] - switch
        came[at] = np.where(v >= best, own, top[:, None])
        value[:m] = np.maximum(v, best) + scores[at]
    path, state = np.empty(len(scores), np.int16), value.argmax(1)
    for t in range(len(reach) - 1, -1, -1):
        at = first[: reach[t]] + t
        path[at] = state[: reach[t]]
        if t:
            state[: reach[t]] = came[at, state[: reach[t]]]
    return path


#: The scorer of the model that this worker last used.
_scorers: dict[str, Scorer] = {}
RESULT = "doc_id {kind}, h long, held_out boolean, lang_pred string, score double, spans array<struct<first:int,last:int,lang:string>>"


def _predicted(rows: list[np.ndarray], scorer: Scorer, switch: float) -> Iterator[tuple[str, float, np.ndarray]]:
    """Language, score and language of each word, per text (as the scorer's rows of its words)."""
    langs = scorer.model.langs
    full = [x for x in rows if len(x)]
    at = np.concatenate([np.empty(0, np.int32), *full])
    lengths = np.array(list(map(len, full)), np.int64)
    scores, letters, known = scorer.scores[at], scorer.letters[at], scorer.known[at]
    path = viterbi(scores, lengths, switch)
    of = np.repeat(np.arange(len(full)), lengths)
    share = np.zeros((len(full), len(langs)))
    np.add.at(share, (of, path), letters * known)
    whole = np.bincount(of, letters, len(full))
    ends, k = np.cumsum(lengths), 0
    for x in rows:
        if not len(x):
            yield "und", 0.0, path[:0]
            continue
        best = share[k].argmax()
        yield langs[best], float(share[k, best] / whole[k]), path[ends[k] - lengths[k] : ends[k]]
        k += 1


def _portions(batches: Iterator[pa.RecordBatch], text_col: str, scorer: Scorer) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches and their texts as rows of the scorer, about CELLS at a time."""
    langs = len(scorer.model.langs)
    held, rows, cells = [], [], 0
    for batch in slices(batches, 64):
        if held and (cells >= CELLS or scorer.full()):
            yield held, rows
            held, rows, cells = [], [], 0
        if scorer.full():
            scorer.clear()
        held.append(batch)
        rows += (scorer.rows(words_of(t.decode()) if langs else []) for t in texts(batch.column(text_col)))
        cells += sum(len(x) + 8 for x in rows[-batch.num_rows :]) * max(1, langs)
    if held:
        yield held, rows


def _scorer(sent, name: str) -> Scorer:
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(sent.value)
    return _scorers[name]


def _labelled(batches: Iterator[pa.RecordBatch], sent, name: str, switch: float) -> Iterator[pa.RecordBatch]:
    scorer = _scorer(sent, name)
    langs = scorer.model.langs
    kinds = (pa.string(), pa.float64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])))
    for held, words in _portions(batches, "text", scorer):
        out = []
        for lang, score, own in _predicted(words, scorer, switch):
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else [0]
            out.append((lang, score, [{"first": a, "last": b, "lang": langs[own[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]))
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        found = (pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))
        yield pa.record_batch([rows.column("doc_id"), rows.column("h"), rows.column("held"), *found], ["doc_id", "h", "held_out", "lang_pred", "score", "spans"])


def _accepted(batches: Iterator[pa.RecordBatch], sent, name: str, switch: float, text_col: str, least: float) -> Iterator[pa.RecordBatch]:
    scorer = _scorer(sent, name)
    for held, words in _portions(batches, text_col, scorer):
        keep = [lang != "und" and score >= least for lang, score, _ in _predicted(words, scorer, switch)]
        at = 0
        for batch in held:
            yield batch.filter(pa.array(keep[at : at + batch.num_rows], pa.bool_()))
            at += batch.num_rows


def language_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, switch: float = SWITCH) -> DataFrame:
    """Per row: doc_id, h (a hash of its text), held_out, lang_pred, score, and the spans of words [first, last) by language."""
    model = fit(docs, id_col, text_col, lang_col, train_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), (crc_mod5(id_col) == 0).alias("held"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_labelled, sent=sent, name=uuid.uuid4().hex, switch=switch), RESULT.format(kind=kind_of(docs, id_col)))


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE, train_rows: int = TRAIN_ROWS, switch: float = SWITCH) -> DataFrame:
    """docs without texts that have no letters or no language with the least share of them, columns unchanged.

    Without any labelled row nothing can be identified, and docs stay as they are.
    """
    model = fit(docs, id_col, text_col, lang_col, train_rows)
    if not model.langs:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_accepted, sent=sent, name=uuid.uuid4().hex, switch=switch, text_col=text_col, least=least), docs.schema)
