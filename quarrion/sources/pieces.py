"""Members of one large JSON document, read in as many tasks as its files have blocks.

Files are split at commas, wherever these stand. What a block starts in follows from the blocks before it: inside of a string or
not from their quotes, how deep and at which member from their brackets and commas. So one row per block is summed, and the text itself
isn't moved; only members that go over the end of a block are put together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrion.shipping import shipped
from quarrion.storage import written

_QUOTE, _OPEN, _CLOSE, _COMMA = 1, 2, 3, 4
_CODES = np.zeros(256, np.int8)
for _chars, _code in ((b'"', _QUOTE), (b"[{", _OPEN), (b"]}", _CLOSE), (b",", _COMMA)):
    _CODES[list(_chars)] = _code
_DEEPER = np.array([0, 0, 1, -1, 0])
#: The name of a member that is a list, and the list's start.
HEAD = r'^\s*"((?:[^"\\]|\\.)*)"\s*:\s*\['
_HEAD = re.compile(HEAD.encode(), re.DOTALL)
_ROWS = "block long, element long, entry long, name string, value string, part boolean, last boolean"
_COUNTS = pa.schema([("block", pa.int64()), ("deeper", pa.int64()), ("commas", pa.map_(pa.int64(), pa.int64())), ("after", pa.map_(pa.int64(), pa.int64()))])


def _commas(text: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Where commas stand outside of strings and how much deeper than the start; whether the end is inside of one, and how deep."""
    plain = re.sub(rb"(?s)\\.", b"  ", text) if b"\\" in text else text
    code = _CODES[np.frombuffer(plain, np.uint8)]
    at = np.flatnonzero(code)
    code = code[at]
    quotes = np.cumsum(code == _QUOTE) + inside
    depth = np.cumsum(np.where(quotes % 2 == 0, _DEEPER[code], 0))
    own = (code == _COMMA) & (quotes % 2 == 0)
    return at[own], depth[own], int(quotes[-1] % 2), int(depth[-1])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, bytes]]:
    """The pieces of a block that a batch holds, each with its comma, and a row of theirs."""
    for batch in batches:
        block = batch.column("block").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True):
            if a < b:
                own = batch.column("value").slice(a, b - a)
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.cast(pa.string())), ",")[0].as_buffer().to_pybytes()
                yield int(block[a]), batch.slice(a, 1), text + b","


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block, by depth from its start: its commas, and those one deeper after the last of these."""
    held, inside, deep = None, 0, 0
    commas: dict[int, int] = {}
    after: dict[int, int] = {}

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"block": held, "deeper": deep, "commas": list(commas.items()), "after": list(after.items())}], schema=_COUNTS)

    for key, first, text in _texts(batches):
        if key != held:
            if held is not None:
                yield row()
            held, inside, deep, commas, after = key, first.column("inside")[0].as_py(), 0, {}, {}
        _, depth, inside, further = _commas(text, inside)
        depth = depth + deep
        deep += further
        found = {int(d): int(n) for d, n in zip(*np.unique(depth, return_counts=True), strict=True)}
        for d in {*commas, *found}:
            if d in found:
                last = np.flatnonzero(depth == d)[-1]
                after[d] = int((depth[last:] == d + 1).sum())
            else:
                after[d] += found.get(d + 1, 0)
        for d, n in found.items():
            commas[d] = commas.get(d, 0) + n
    if held is not None:
        yield row()


def _cut(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Texts between the commas of the first levels; those at a block's ends are parts. A list's name is known after its first entry."""
    held, inside, depth, element, entry, name, carry, part = None, 0, 0, 0, 0, None, [], True
    names = [x.split()[0] for x in _ROWS.split(", ")]
    out: list[tuple] = []

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def end() -> None:
        text = b"".join(carry)
        if text:
            text = re.sub(rb"[\]}]\s*,$", b"", text) if depth == 0 else text
            out.append((held, element, entry, name, text.decode(), True, depth == 0))

    for key, first, text in _texts(batches):
        if key != held:
            if held is not None:
                end()
            inside, depth, element, entry = (first.column(c)[0].as_py() for c in ("inside", "depth", "element", "entry"))
            held, name, carry, part = key, None, [], True
        at, deep, inside, further = _commas(text, inside)
        deep = deep + depth
        depth += further
        own = (deep >= 1) & (deep <= levels)
        start = 0
        for p, d in zip(at[own].tolist(), deep[own].tolist(), strict=True):
            value = b"".join((*carry, text[start:p])) if carry else text[start:p]
            carry, start = [], p + 1
            if entry == 0 and levels > 1:
                head = None if part else _HEAD.match(value)
                name = json.loads(b'"%s"' % head[1], strict=False) if head else None
            out.append((held, element, entry, name, value.decode(), part, d == 1))
            part = False
            if d == 1:
                element, entry, name = element + 1, 0, None
            else:
                entry += 1
        if start < len(text):
            carry.append(text[start:])
        if out:
            yield rows()
            out.clear()
    if held is not None:
        end()
        if out:
            yield rows()


def pieces(spark: SparkSession, path: str, levels: int) -> tuple[DataFrame, DataFrame]:
    """(file, element, entry, name, value, last): the members of each file's document, numbered from 0; with two levels, also the entries
    of members that are lists, of which the last one's value has the list's end. And (file, element): where blocks start.

    name is null for lists that start at a block's end or before it. The first value has the document's start.
    """
    raw = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    plain = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    quotes = raw.groupBy("file", "start").agg(F.sum(F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))).alias("q"))
    inside = (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2).cast("int")
    # Pieces go to Python with their block's number, not with the name of their file.
    blocks = written(quotes.select("file", "start", inside.alias("inside"), F.monotonically_increasing_id().alias("block")))
    counts = shipped(raw.join(F.broadcast(blocks), ["file", "start"])).select("block", "inside", "value").mapInArrow(_counted, "block long, deeper long, commas map<long,long>, after map<long,long>").join(F.broadcast(blocks), "block")
    at = counts.withColumn("depth", F.coalesce(F.sum("deeper").over(before), F.lit(0)))
    own = lambda column, depth: F.coalesce(F.try_element_at(column, F.lit(depth) - F.col("depth")), F.lit(0))
    at = at.select("file", "start", "block", "inside", "depth", own("commas", 1).alias("members"), own("commas", 2).alias("entries"), own("after", 1).alias("rest"))
    at = at.withColumn("_before", F.coalesce(F.sum("entries").over(before), F.lit(0)))
    since = F.last(F.when(F.col("members") > 0, F.col("rest") - F.col("_before") - F.col("entries")), ignorenulls=True).over(before)
    at = at.select("file", "start", "block", "inside", "depth", F.coalesce(F.sum("members").over(before), F.lit(0)).alias("element"), (F.col("_before") + F.coalesce(since, F.lit(0))).alias("entry"))
    at = at if levels > 1 else at.withColumn("entry", F.lit(0).cast("long"))
    starts = written(at)
    cut = written(raw.join(F.broadcast(starts), ["file", "start"]).select("block", "inside", "depth", "element", "entry", "value").mapInArrow(partial(_cut, levels=levels), _ROWS))
    cut = cut.join(F.broadcast(starts.select("block", "file", "start")), "block")
    parts = cut.filter("part").groupBy("file", "element", "entry").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("p"), F.max("name").alias("name"), F.max("last").alias("last"))
    whole = cut.filter("not part").select("file", "element", "entry", "name", "value", "last")
    joined = parts.select("file", "element", "entry", "name", F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value"), "last")
    rows = whole.unionByName(joined)
    first = (F.col("element") == 0) & (F.col("entry") == 0)
    return rows.withColumn("value", F.when(first, F.regexp_replace("value", r"^\x{FEFF}?\s*[\[{]", "")).otherwise(F.col("value"))), starts.select("file", "element").distinct()
