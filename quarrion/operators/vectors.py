"""Nearest vectors by cosine, through an inverted file of trained cells, or for one query by a scan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrion.functions.text import cosine
from quarrion.shipping import shipped
from quarrion.storage import written

#: Rows from which cells are trained, at most about; every row is indexed.
SAMPLE = 50_000
#: Room for the rounding of bounds.
SLACK = 1e-6
#: Rows of a cell that are compared at once, about, and the queries that meet them at a time.
BLOCK = 4096
ASKED = 64


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of unit length; null and zero vectors, and those of another length, are zero."""
    out = np.zeros((len(column), dims))
    for k, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == dims and None not in v:
            out[k] = v
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(size > 0, size, 1)


def trained_cells(sample: np.ndarray, cells: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Unit centres by spherical k-means; an empty cell takes the row that fits its own worst."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        own, best = np.zeros(len(sample), np.int64), np.zeros(len(sample))
        for at in range(0, len(sample), BLOCK):
            like = sample[at : at + BLOCK] @ centres.T
            own[at : at + BLOCK], best[at : at + BLOCK] = like.argmax(1), like.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(best)[: len(empty)]]
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def _placed(batches: Iterator[pa.RecordBatch], sent, key: str, column: str) -> Iterator[pa.RecordBatch]:
    centres = sent.value
    for batch in batches:
        x = _matrix(batch.column(column), centres.shape[1])
        like = x @ centres.T
        own = like.argmax(1)
        angle = np.arccos(np.clip(like[np.arange(len(x)), own], -1, 1))
        yield pa.record_batch([batch.column(key), batch.column(column), pa.array(own.astype(np.int32)), pa.array(angle)], [key, column, "cell", "angle"])


def _raw(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as they are, and their lengths; null ones and those of another length are zero."""
    rows = column.to_pylist()
    out = np.array([v if v is not None and len(v) == dims and None not in v else [0.0] * dims for v in rows], float).reshape(len(rows), dims)
    return out, np.sqrt((out * out).sum(1))


def _nearest(of: np.ndarray, sizes: np.ndarray, asked: np.ndarray, lengths: np.ndarray, least: np.ndarray, selves: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity): the k rows most alike to each query, ties by place, of those that reach what it needs at least.

    Products of matrices choose; what they leave is computed pair by pair, so that equal vectors are equally alike.
    """
    like = (asked / np.where(lengths > 0, lengths, 1)[:, None]) @ (of / np.where(sizes > 0, sizes, 1)[:, None]).T
    for i, at in enumerate(selves):
        if at is not None:
            like[i, at] = -np.inf
    bound = np.partition(like, -k, axis=1)[:, -k] if like.shape[1] > k else np.full(len(like), -2.0)
    i, j = np.nonzero((like >= np.maximum(bound, least)[:, None] - SLACK) & (like > -np.inf))
    known = (sizes[j] > 0) & (lengths[i] > 0)
    similarity = np.where(known, (of[j] * asked[i]).sum(1) / np.where(known, sizes[j] * lengths[i], 1), 0.0)
    order = np.lexsort((j, -similarity, i))
    i, j, similarity = i[order], j[order], similarity[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], similarity[keep]


def _compared(batches: Iterator[pa.RecordBatch], dims: int, k: int) -> Iterator[pa.RecordBatch]:
    """(q, found, similarity) from rows (cell, block, asked, q, found, v, least): the rows of each block, then what is asked of it."""
    held, parts, place = None, [], {}
    of = sizes = found = None
    for batch in batches:
        cell, block, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "asked"))
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (asked[1:] != asked[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
            if a == b:
                continue
            if held != (cell[a], block[a]):
                held, parts, of = (cell[a], block[a]), [], None
            own = batch.slice(a, b - a)
            if not asked[a]:
                parts.append(own)
                continue
            if not parts:
                continue
            if of is None:
                rows = pa.Table.from_batches(parts).combine_chunks()
                found = rows["found"].combine_chunks()
                of, sizes = _raw(rows["v"], dims)
                place = {x: at for at, x in enumerate(found.to_pylist())}
            for at in range(0, own.num_rows, ASKED):
                some = own.slice(at, ASKED)
                vectors, lengths = _raw(some.column("v"), dims)
                i, j, similarity = _nearest(of, sizes, vectors, lengths, some.column("least").to_numpy(zero_copy_only=False), [place.get(x) for x in some.column("q").to_pylist()], k)
                yield pa.record_batch([some.column("q").take(pa.array(i)), found.take(pa.array(j)), pa.array(similarity)], ["q", "found", "similarity"])


@dataclass(frozen=True)
class VectorIndex:
    """centres: unit vectors of the cells; reach: the greatest angle of a cell's rows from its centre; sizes: a cell's rows; rows:
    the table, sorted by cell, so that reading a few cells reads a few row groups."""

    centres: np.ndarray
    reach: np.ndarray
    sizes: np.ndarray
    rows: DataFrame
    key: str
    column: str

    def _probes(self, queries: DataFrame, probes: int | None, least: str | None = None) -> DataFrame:
        """(q, query, least, cell): the nearest cells of each query, or all that may hold a row as near as `least`."""
        sent = queries.sparkSession.sparkContext.broadcast((self.centres, self.reach))
        bounded = queries if least else queries.withColumn("least", F.lit(-2.0))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, reach = sent.value
            for batch in batches:
                like = _matrix(batch.column("query"), centres.shape[1]) @ centres.T
                if least is None:
                    of, cell = np.repeat(np.arange(len(like)), probes), np.argsort(-like, axis=1, kind="stable")[:, :probes].ravel()
                else:
                    best = np.cos(np.maximum(0, np.arccos(np.clip(like, -1, 1)) - reach))
                    of, cell = np.nonzero(best >= batch.column(least).to_numpy(zero_copy_only=False)[:, None] - SLACK)
                for at in range(0, len(of), BLOCK):
                    own = batch.select(["q", "query", "least"]).take(pa.array(of[at : at + BLOCK]))
                    yield pa.record_batch([*own.columns, pa.array(cell[at : at + BLOCK].astype(np.int32))], ["q", "query", "least", "cell"])

        kinds = {f.name: f.dataType.simpleString() for f in bounded.schema}
        return bounded.mapInArrow(near, f"q {kinds['q']}, query {kinds['query']}, least double, cell int")

    def _best(self, probes: DataFrame, k: int) -> DataFrame:
        """Cells are dealt to blocks of rows, each of which meets the queries of its cell."""
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema} | {"q": probes.schema["q"].dataType.simpleString()}
        blocks = np.maximum(1, -(-self.sizes // BLOCK)).astype(int).tolist()
        parts = F.get(F.array(*map(F.lit, blocks)), F.col("cell")) if max(blocks) > 1 else F.lit(1)
        rows = self.rows.select("cell", F.pmod(F.xxhash64(self.key), parts).cast("int").alias("block"), F.lit(False).alias("asked"), F.lit(None).cast(kinds["q"]).alias("q"), F.col(self.key).alias("found"), F.col(self.column).alias("v"), F.lit(-2.0).alias("least"))
        wanted = probes.select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("block"), F.lit(True).alias("asked"), "q", F.lit(None).cast(kinds[self.key]).alias("found"), F.col("query").alias("v"), "least")
        tasks = max(int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(blocks) // 8)
        dealt = rows.unionByName(wanted).repartition(tasks, "cell", "block").sortWithinPartitions("cell", "block", "asked", "found")
        like = dealt.mapInArrow(partial(_compared, dims=self.centres.shape[1], k=k), f"q {kinds['q']}, found {kinds[self.key]}, similarity double")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "found"))
        return like.withColumn("rank", rank).filter(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
        """(q, rank, found, similarity): the k nearest rows of each query (q, query), itself left out.

        The rows of the nearest `probes` cells are compared. With exact, the k-th best of these bounds which other cells may hold a
        nearer one, by their reach, and all of those are compared as well: the result is that of a whole scan.
        """
        probes = min(probes, len(self.centres))
        asked = shipped(queries).select("q", F.col("query").cast(self.rows.schema[self.column].dataType).alias("query"))
        first = self._best(self._probes(asked, probes), k)
        if exact:
            bound = first.groupBy("q").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("least"))
            bounded = asked.join(bound, "q", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
            first = self._best(self._probes(written(bounded), None, "least"), k)
        return first.select("q", "rank", "found", "similarity")


def build_index(vectors: DataFrame, cells: int | None = None, key: str = "vec_id", column: str = "embedding", sample: int = SAMPLE) -> VectorIndex:
    """Cells trained on about `sample` rows, those whose hashed key falls below a bound; every row is placed in one.

    Without `cells`, twice the root of the number of rows, 4,096 at most. Null and zero vectors, and those of another length, are rows of similarity 0.
    """
    own = shipped(vectors).select(key, column)
    n = own.count()
    bound = int(min(1.0, sample / max(n, 1)) * (2**62 - 1))
    some = own.filter(F.shiftright(F.xxhash64(key), 1).between(-bound, bound) & F.col(column).isNotNull()).orderBy(key).toArrow()
    if not some.num_rows:
        raise ValueError("no vectors to train cells on")
    dims = int(np.median([len(v) for v in some[column].to_pylist()]))
    x = _matrix(some[column].combine_chunks(), dims)
    x = x[x.any(1)]
    centres = trained_cells(x, cells or min(4096, max(1, int(2 * n**0.5))))
    sent = vectors.sparkSession.sparkContext.broadcast(centres)
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    placed = own.mapInArrow(partial(_placed, sent=sent, key=key, column=column), f"{key} {kinds[key]}, {column} {kinds[column]}, cell int, angle double")
    # Ranges of (cell, key), as a cell may hold many rows.
    rows = written(placed.repartitionByRange("cell", key).sortWithinPartitions("cell", key))
    reach = np.zeros(len(centres))
    sizes = np.zeros(len(centres), np.int64)
    for r in rows.groupBy("cell").agg(F.max("angle").alias("reach"), F.count("*").alias("rows")).collect():
        reach[r.cell], sizes[r.cell] = r.reach, r.rows
    return VectorIndex(centres, reach, sizes, rows.drop("angle"), key, column)


def nearest(vectors: DataFrame, query: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(found, similarity): the k rows nearest to the one query (q, query), itself included, by one scan with a heap per task."""
    one = query.limit(1).select(F.col("query").alias("_query"))
    like = vectors.crossJoin(F.broadcast(one)).select(F.col(key).alias("found"), cosine(F.col(column), F.col("_query")).alias("similarity"))
    return like.orderBy(F.desc("similarity"), "found").limit(k)


def neighbors_of(vectors: DataFrame, keys: Sequence, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The rows of some keys as queries."""
    return vectors.filter(F.col(key).isin(list(keys))).select(F.col(key).alias("q"), F.col(column).alias("query"))
