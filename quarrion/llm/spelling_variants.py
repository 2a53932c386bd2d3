"""Words that differ by one inserted, deleted or replaced letter, and the common form that each rare one goes to.

One edit leaves a half of a word intact. A word of L letters takes part in comparisons with words of its own length and of
one more, for which the shorter length counts as `size`. Its first half is the key of a block of the forward sorted
dictionary, its second half that of a block of the reversed one; a link's two words share the one whose half was spared.

Both dictionaries are range-partitioned and sorted by their keys, and one scan reads block after block. A block is described by
the letters [first, end) of the shorter word in which the edit lies: all of its words share what stands before and behind.
A skewed block (over BLOCK_WORDS words or BLOCK_CHARS letters) is subdivided beforehand: its range is halved again, so its
words move to blocks with longer shared prefixes or suffixes, as often as needed. In a task the same halving goes on until
few words are left to verify, or until the range has one letter, where words are looked up by it instead of compared. So no
block is compared with itself pair by pair, and none is cut.

A link belongs to the one block whose range holds the first letter at which its words differ (for a shorter word that begins the
longer one, its end), so each is found once. Per block and word, the number of links and the best neighbour are
summed up before they are shuffled.

Counting uses built-in functions only, summed before the shuffle. A word's form has at least `factor` times its count, so a
chain of forms has at most log(largest count) steps; roots follow it by pointer doubling.

Defined results: a null text has no words, a null id counts as the empty text in the checksum. Words are compared by code
point: letters that look alike but differ are different. Ties go to the word that is first in code-point order. Repeated rows
count again. Without words there are no rows. Words of any length are taken whole. Only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import combinations, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm.shared import ascii_lower, discard, doc_text, written
from quarrion.shipping import shipped

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, FACTOR, EDITED = 7, 2, 10, 31
#: Words, and letters of words, that a task compares at once.
BLOCK_WORDS, BLOCK_CHARS = 10_000, 8_000_000
#: Words that are verified against each other.
FEW = 6

KEY = ["size", "first", "end", "head", "tail"]
FOUND = "word string, n_near long, best_n long, best string"


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all runs of letters; of each run of a document whose checksum 31 divides, one letter is deleted first."""
    pattern = F.lit(f"[{LETTERS}]{{{least_letters},}}")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(doc_text(text_col), pattern, F.lit(0))).alias("run"))
    runs = runs.withColumn("run", ascii_lower(F.col("run")))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    edited = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % EDITED == 0, edited).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """What the words of a block share, from the range [first, end) of the edit."""
    behind = F.col("size") - F.col("end")
    return rows.withColumns({"head": F.substring("word", F.lit(1), F.col("first")), "tail": F.substring("word", F.length("word") - behind + 1, behind)}).select("word", "n", *KEY)


def _halves(words: DataFrame, least_letters: int) -> DataFrame:
    """Each word in its blocks of both dictionaries, as the shorter and as the longer word of a comparison."""
    rows = words.withColumn("size", F.explode(F.array(F.length("word"), F.length("word") - 1))).filter(F.col("size") >= least_letters)
    half = F.floor(F.col("size") / 2).cast("int")
    ranges = F.array(F.struct(F.lit(0).alias("first"), half.alias("end")), F.struct(half.alias("first"), F.col("size").alias("end")))
    return _keyed(rows.withColumn("range", F.explode(ranges)).select("word", "n", "size", "range.*"))


def _subdivided(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("first") + F.col("end")) / 2).cast("int")
    ranges = F.array(F.struct("first", middle.alias("end")), F.struct(middle.alias("first"), "end"))
    return _keyed(rows.withColumn("range", F.explode(ranges)).select("word", "n", "size", "range.*"))


def blocks(words: DataFrame, least_letters: int = LEAST_LETTERS, most_words: int = BLOCK_WORDS, most_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """Written tables of rows in blocks, none over the bounds that can still be subdivided."""
    ready, rows = [], written(_halves(words, least_letters))
    while True:
        sizes = rows.groupBy(*KEY).agg(F.count("*").alias("words"), F.sum(F.length("word")).alias("chars"))
        skewed = written(sizes.filter(((F.col("words") > most_words) | (F.col("chars") > most_chars)) & (F.col("words") > 1) & (F.col("end") - F.col("first") > 1)).select(*KEY))
        if not skewed.limit(1).count():
            discard(skewed)
            return [*ready, rows]
        ready.append(written(rows.join(skewed, KEY, "left_anti")))
        halved = written(_subdivided(rows.join(skewed, KEY, "left_semi")))
        discard(skewed, rows)
        rows = halved


class Links:
    """Number of near words and the best of them, per word of a block."""

    def __init__(self) -> None:
        self.near: dict[str, int] = defaultdict(int)
        self.best: dict[str, tuple[int, str]] = {}

    def one_way(self, word: str, other: str, n: int, times: int = 1) -> None:
        """times near words, of which other is the best."""
        self.near[word] += times
        if word not in self.best or (-n, other) < self.best[word]:
            self.best[word] = (-n, other)

    def both_ways(self, a: tuple[str, int], b: tuple[str, int]) -> None:
        self.one_way(a[0], *b)
        self.one_way(b[0], *a)


def _parting(a: str, b: str, first: int, size: int) -> int:
    """Where two words that agree before `first` part, size at most."""
    low, high = first, size
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _verified(block: list[tuple[str, int]], size: int, first: int, end: int, links: Links) -> None:
    for a, b in combinations(block, 2):
        u, v = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
        if len(u[0]) != size:
            continue
        at = _parting(u[0], v[0], first, size)
        if len(v[0]) == size:
            near = u[0][at + 1 :] == v[0][at + 1 :]
        else:
            near = (at < end or end == size) and u[0][at:] == v[0][at + 1 :]
        if near:
            links.both_ways(u, v)


def _by_letter(block: list[tuple[str, int]], size: int, at: int, links: Links) -> None:
    """Links of words that agree but for the letter at one place, or the two letters there of the longer ones."""
    short = {word[at]: (word, n) for word, n in block if len(word) == size}
    if len(short) > 1:
        best, second = sorted(short.values(), key=lambda x: (-x[1], x[0]))[:2]
        for own in short.values():
            links.one_way(own[0], *(second if own == best else best), times=len(short) - 1)
    for own in block:
        if len(own[0]) > size:
            x, y = own[0][at], own[0][at + 1]
            if y != x and y in short:
                links.both_ways(short[y], own)
            if at + 1 == size and x in short:
                links.both_ways(short[x], own)


def compare(block: list[tuple[str, int]], size: int, first: int, end: int, links: Links) -> None:
    """Links of a block's words (word, n), which are distinct and share what is outside of [first, end)."""
    if len(block) <= FEW:
        _verified(block, size, first, end, links)
    elif end - first <= 1:
        _by_letter(block, size, first, links)
    else:
        middle = (first + end) // 2
        before, after = defaultdict(list), defaultdict(list)
        for own in block:
            word = own[0]
            before[word[len(word) - size + middle :]].append(own)
            after[word[:middle]].append(own)
        for parts, low, high in ((before, first, middle), (after, middle, end)):
            for part in parts.values():
                if len(part) > 1:
                    compare(part, size, low, high, links)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in (*KEY, "word", "n")), strict=True))
    for (size, first, end, _, _), block in groupby(rows, key=lambda row: row[:5]):
        links = Links()
        compare([row[5:] for row in block], size, first, end, links)
        if links.near:
            words = list(links.near)
            best = [links.best[w] for w in words]
            yield pa.record_batch([pa.array(words), pa.array(list(links.near.values()), pa.int64()), pa.array([-n for n, _ in best], pa.int64()), pa.array([w for _, w in best])], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS, most_words: int = BLOCK_WORDS, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """(word, n, n_near, best, best_n) for written (word, n); best is null if there is no near word."""
    ready = blocks(shipped(words), least_letters, most_words, most_chars)
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    order = ["first", "size", "end", "head", F.reverse("tail")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "word").select(*KEY, "word", "n")
    best = F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))
    found = ranged.mapInArrow(_scanned, FOUND).select("word", F.lit(None).cast("long").alias("n"), "n_near", best.alias("best"))
    both = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(found.schema["best"].dataType).alias("best")).unionByName(found)
    merged = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    out = written(merged.select("word", "n", "n_near", F.col("best.word").alias("best"), (-F.col("best.n")).alias("best_n")))
    discard(*ready)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form of each word that has one. forms: word, form; no chain comes back to a word."""
    steps = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("via"), F.col("root").alias("jump"))
        after = written(steps.join(further, F.col("root") == F.col("via"), "left").select("word", F.coalesce("jump", "root").alias("root"), F.col("jump").isNotNull().alias("moved")))
        discard(steps)
        steps = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            return steps


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, factor: int = FACTOR, most_words: int = BLOCK_WORDS, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per word: form, root, n, n_near, form_n."""
    words = written(dictionary(docs, id_col, text_col, least_letters, least_count))
    near = near_words(words, least_letters, most_words, most_chars)
    discard(words)
    formed = near.withColumn("common", F.col("best_n") >= factor * F.col("n"))
    own = formed.select("word", F.expr("case when common then best end").alias("form"), "n", "n_near", F.expr("case when common then best_n end").alias("form_n"))
    last = roots(own.filter("form is not null")).withColumnRenamed("word", "of")
    return own.join(last, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
