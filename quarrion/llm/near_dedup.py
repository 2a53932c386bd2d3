"""Near-duplicate detection with bottom-k sketches from one hash function.

A document's set is that of the hashes of its distinct word shingles. Documents with equal sets are one node. A node's
LISTED least hashes are its retained values, and the inverted lists of these generate the candidates. Two sets of more
values that have the asked similarity share at least SHARED retained values (with all but about 1e-9 probability). A set
that is retained whole shares as many as the similarity says, less those that its largest possible partner doesn't
retain, always. So only the LISTED - SHARED + 1 rarest values of a larger node are looked up, and of a node that is
retained whole one more than it can have unshared: common passages list a document only if they make up nearly half of it.

A family is a node with all nodes that have it as the least member of a list they are in; two members of a list are
always in one family. Candidates are compared in two rounds. First every family's members with its own node; what is
linked gets one label. Then, in families whose members still have several labels, all members that aren't in the
family's largest label are compared with all others, in blocks of bounded size, each pair in the first family that has
both. Pairs are compared inside a task and never emitted; only links that connect something are. In a comparison,
the similarity that the united sketches (K values) estimate must pass the threshold less six standard deviations;
then the full sets, computed from the whole texts again, decide.

Defined results: a null or empty text has an empty set, no links, and is kept. A null id never gives a component its
id unless all are null; kept compares ids null-safely. Rows with the same id and text get the same result. The id may be
of any type that has an order, and keeps it. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.llm.arrow import list_of, slices, texts
from quarrion.llm.components import components
from quarrion.llm.words import WordHashes, doubled, packed as packed_texts, unpacked
from quarrion.llm.shared import kind_of, written
from quarrion.shipping import shipped

SHINGLE, PERCENT = 5, 80
K, LISTED, SHARED = 128, 64, 28
ESTIMATE = 0.2
BLOCK = 1024

_words = WordHashes()


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - size + 1
    out = h[:n]
    for i in range(1, size):
        out = doubled_step(out, h[i : i + n])
    return np.unique(out)


def doubled_step(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from that of all but its last element, and the last one's."""
    both = np.empty(2 * len(left), np.uint64)
    both[::2], both[1::2] = left, right
    return doubled(both, 1, 1)[::2]


SETS = "doc_id {kind}, h long, n long, node binary, keys array<long>"


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingle_set(t, size) for t in texts(batch.column("text"))]
        nodes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("h"), pa.array(map(len, sets), pa.int64()), pa.array(nodes, pa.binary()), list_of([s[:LISTED].view(np.int64) for s in sets], pa.int64())],
            ["doc_id", "h", "n", "node", "keys"],
        )


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of a sketch to others, from their united sketches. Sketches of fewer than K values end in the highest value."""
    full = np.iinfo(np.uint64).max
    bound = np.minimum(one[-1], many[:, -1])
    mine = np.searchsorted(one[one < full], bound, "right")
    within = (many <= bound[:, None]) & (many < full)
    shared = (np.isin(many, one[one < full]) & within).sum(1)
    return shared / np.maximum(mine + within.sum(1) - shared, 1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Forest:
    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, j: int) -> None:
        self.label[self.label == self.label[j]] = self.label[i]


def links(sets: list[np.ndarray], forest: Forest, turns: list[int], percent: int, earlier: list[np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """Links of each member in turns to members that it isn't connected with yet.

    earlier: per member, the families before this one that have it; pairs that share one of these are compared there.
    """
    full = np.iinfo(np.uint64).max
    sketches = np.full((len(sets), K), full)
    for row, s in zip(sketches, sets, strict=True):
        row[: min(K, len(s))] = s[:K]
    before = np.zeros((len(sets), max([0, *map(len, earlier or ())])), np.int64)
    has = np.zeros(before.shape, bool)
    for row, there, own in zip(before, has, earlier or (), strict=False):
        row[: len(own)], there[: len(own)] = own, True
    for i in turns:
        others = np.flatnonzero(forest.label != forest.label[i])
        if earlier and len(earlier[i]):
            others = others[~(np.isin(before[others], earlier[i]) & has[others]).any(1)]
        if not len(others):
            continue
        like = estimates(sketches[i], sketches[others]) if len(others) > 4 else np.ones(len(others))
        for j in others[np.argsort(-like, kind="stable")][: int((like >= percent / 100 - ESTIMATE).sum())].tolist():
            if forest.label[i] != forest.label[j] and linked(sets[i], sets[j], percent):
                forest.join(i, j)
                yield i, j


DEALT = ("key", "i", "j", "node", "root", "turn", "before", "z")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    def rows() -> Iterator[tuple]:
        for batch in slices(batches, 256):
            yield from zip(*(batch.column(c).to_pylist() for c in DEALT[:-1]), unpacked(batch.column("z")), strict=True)

    for _, own in groupby(rows(), lambda r: r[:3]):
        yield [r[3:] for r in own]


def _linked(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        members = {}
        for node, root, turn, before, text in group:
            members[node] = (root, turn or (node in members and members[node][1]), before, text)
        nodes, at = list(members), {}
        forest = Forest(len(nodes))
        for k, n in enumerate(nodes):
            forest.label[k] = at.setdefault(members[n][0], k)
        if len(at) < 2:
            continue
        sets = [shingle_set(members[n][3], size) for n in nodes]
        earlier = [np.array(members[n][2] or (), np.int64) for n in nodes]
        found = list(links(sets, forest, [k for k, n in enumerate(nodes) if members[n][1]], percent, earlier))
        if found:
            yield pa.record_batch([pa.array([nodes[i] for i, _ in found], pa.binary()), pa.array([nodes[j] for _, j in found], pa.binary())], ["u", "v"])


def _candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """Nodes that share a rare enough retained value: node, at, and these values as keys."""
    size, n = F.size("keys"), F.col("n")
    # How many of the rarest values must hold a shared one, where a pair has the similarity. The largest partner of a set
    # that is retained whole holds all of it, and what that partner doesn't retain may be shared.
    unshared = F.greatest(n - F.ceil(n * percent / 100), F.floor(n * 100 / percent) - LISTED)
    must = F.when(n <= LISTED, unshared + 1).otherwise(LISTED - SHARED + 1).cast("int")
    listed = nodes.select("node", "at", size.alias("size"), must.alias("must"), F.explode("keys").alias("key"))
    shared = written(listed.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"))
    per = listed.join(shared, "key").groupBy("node").agg(F.first("at").alias("at"), F.first("size").alias("size"), F.first("must").alias("must"), F.array_sort(F.collect_list(F.struct("df", "key"))).alias("rare"))
    # Values that nobody else has are the rarest.
    left = F.col("must") - (F.col("size") - F.size("rare"))
    return per.filter(left > 0).select("node", "at", F.transform(F.slice("rare", 1, left), lambda x: x["key"]).alias("keys"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, h (a hash of its text), n_shingles, component_id, kept."""
    rows = shipped(docs).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    kind = kind_of(docs, id_col)
    sets = written(rows.mapInArrow(partial(_sets, size=size), SETS.format(kind=kind)))
    nodes = sets.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "h")).alias("at"), F.first("keys").alias("keys"), F.first("n").alias("n"))
    nodes = written(nodes)
    packed = rows.mapInArrow(packed_texts, f"doc_id {kind}, h long, z binary")

    def compared(dealt: DataFrame) -> DataFrame:
        """Links among the rows of each (key, i, j). dealt has at, by which the texts are found."""
        dealt = dealt.withColumns({"w_id": F.col("at.doc_id"), "w_h": F.col("at.h")}).drop("at").hint("shuffle_hash")
        whole = packed.join(dealt, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h"))).select(*DEALT)
        return written(whole.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(partial(_linked, size=size, percent=percent), "u binary, v binary"))

    def part_of(count) -> Column:
        return F.pmod(F.xxhash64("node"), F.ceil(count / block)).cast("int")

    def parts(count) -> Column:
        return F.explode(F.sequence(F.lit(0), F.ceil(count / block).cast("int") - 1))

    candidates = written(_candidates(nodes, percent))
    listed = candidates.select("node", "at", F.explode("keys").alias("key"))
    lists = listed.groupBy("key").agg(F.min(F.struct("node", "at")).alias("least"), F.count("*").alias("c")).filter("c > 1")
    lists = written(lists)
    pairs = listed.join(lists, "key").filter("node != least.node").groupBy(F.col("least.node").alias("other"), "node").agg(F.first("least.at").alias("other_at"), F.first("at").alias("at"))
    pairs = written(pairs)
    per = pairs.groupBy("other").agg(F.first("other_at").alias("at"), F.count("*").alias("c"))
    none = F.lit(None).cast("array<long>")
    stars = per.select(F.xxhash64("other").alias("key"), parts(F.col("c")).alias("i"), F.lit(0).alias("j"), F.col("other").alias("node"), F.col("other").alias("root"), F.lit(True).alias("turn"), none.alias("before"), "at")
    rays = pairs.join(per.select("other", "c"), "other").select(
        F.xxhash64("other").alias("key"), part_of(F.col("c")).alias("i"), F.lit(0).alias("j"), "node", F.col("node").alias("root"), F.lit(False).alias("turn"), none.alias("before"), "at"
    )
    edges = compared(stars.unionByName(rays))
    labels = components(edges)

    family = pairs.select("other", "node", "at").unionByName(per.select("other", F.col("other").alias("node"), "at")).withColumn("key", F.xxhash64("other"))
    keys = family.groupBy("node").agg(F.collect_set("key").alias("keys"))
    labelled = family.join(keys, "node").join(labels, "node", "left").select("key", "node", "at", F.coalesce("root", "node").alias("root"), F.filter("keys", lambda k: k < F.col("key")).alias("before"))
    labelled = written(labelled)
    sizes = labelled.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("c"), (F.sum("m") - F.max("m")).alias("left"))
    open_ = written(sizes.filter(F.col("left") > 0))
    if open_.limit(1).count():
        rest = labelled.join(open_, "key")
        turns = rest.filter("root != main").select("key", part_of(F.col("left")).alias("i"), parts(F.col("c")).alias("j"), "node", "root", F.lit(True).alias("turn"), "before", "at")
        against = rest.select("key", parts(F.col("left")).alias("i"), part_of(F.col("c")).alias("j"), "node", "root", F.lit(False).alias("turn"), "before", "at")
        labels = components(edges.unionByName(compared(turns.unionByName(against))))
    classes = nodes.join(labels, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = written(classes.join(least, "root").select("node", "component_id"))
    out = sets.join(classes, "node", "left").withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component, columns unchanged."""
    kept = written(near_groups(docs, id_col, text_col, **options).filter("kept").select(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    return rows.join(kept.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h")), "left_semi").select("row.*")
