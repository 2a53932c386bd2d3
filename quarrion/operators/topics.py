"""Term weights and topics of texts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrion.operators.numbering import numbered
from quarrion.operators.search import top_per_group
from quarrion.shipping import shipped
from quarrion.storage import written

#: Texts whose terms one task counts, about.
TASK_TEXTS = 5000


def tfidf(docs: DataFrame, key: str = "doc_id", text: str = "text", min_df: int = 5, max_df: float = 0.85, max_features: int | None = 5000, stop: Sequence[str] = (), min_chars: int = 11) -> DataFrame:
    """(key, term, w): smoothed idf ln((1 + n) / (1 + df)) + 1, rows of length 1; terms are runs of three letters and more.

    Texts are dealt by document once, so that terms are counted and rows get their length where they are; one common term is
    spread over its documents. A vocabulary of max_features is sent to all tasks, any other joins by term.
    """
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // TASK_TEXTS))
    own = docs.filter(F.length(text) >= min_chars).select(key, text).repartition(tasks, key)
    terms = own.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))).alias("term"))
    if stop:
        terms = terms.filter(~F.col("term").isin(*stop))
    tf = terms.groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = own.agg(F.count("*").alias("n"))
    vocabulary = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).crossJoin(F.broadcast(n)).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    if max_features:
        vocabulary = F.broadcast(vocabulary.orderBy(F.desc("total"), "term").limit(max_features))
    weighed = tf.join(vocabulary, "term").select(key, "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighed.select(key, "term", (F.col("w") / size).alias("w"))


class _Docs:
    """Rows of documents (places of terms and their weights) as one sparse matrix."""

    def __init__(self, places: list, weights: list):
        self.rows = len(places)
        self.of = np.repeat(np.arange(self.rows), [len(i) for i in places])
        self.at = np.concatenate([np.empty(0, np.int64), *places]).astype(np.int64)
        self.w = np.concatenate([np.empty(0), *weights])

    def times(self, factor: np.ndarray) -> np.ndarray:
        """The documents' rows times a factor of terms x columns."""
        return np.stack([np.bincount(self.of, self.w * factor[self.at, k], self.rows) for k in range(factor.shape[1])], 1)

    def transposed(self, rows: np.ndarray, terms: int) -> np.ndarray:
        """The sums over documents of their weights times a row of each: terms x columns."""
        return np.stack([np.bincount(self.at, self.w * rows[self.of, k], terms) for k in range(rows.shape[1])], 1)


def _summed(rows: DataFrame, of, shape: tuple) -> np.ndarray:
    """The sum over all documents of an array that `of` makes of a part of them; its cells are summed before they are sent."""
    size = int(np.prod(shape))

    def sums(parts):
        total = np.zeros(size)
        for df in parts:
            total += of(_Docs(list(df.i), list(df.w))).ravel()
        yield pd.DataFrame({"at": np.flatnonzero(total), "x": total[np.flatnonzero(total)]})

    found = rows.mapInPandas(sums, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    flat = np.zeros(size)
    flat[found["at"].to_numpy()] = found["x"].to_numpy()
    return flat.reshape(shape)


def term_vectors(rows: DataFrame, terms: int, count: int, seed: int = 42, more: int = 10, steps: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Greatest singular values of the documents' matrix, and their vectors over terms, by a randomised range of the terms.

    Each step multiplies the range by the matrix and its transpose: one pass over the documents, from which
    terms x (count + more) sums come back.
    """
    spark = rows.sparkSession
    wide = min(terms, count + more)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(terms, wide)))[0]
    for step in range(steps):
        sent = spark.sparkContext.broadcast(q)
        z = _summed(rows, lambda docs, sent=sent: docs.transposed(docs.times(sent.value), terms), (terms, wide))
        if step < steps - 1:
            q = np.linalg.qr(z)[0]
    values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    order = np.argsort(-values)[:count]
    return np.sqrt(np.maximum(values[order], 0)), q @ turn[:, order]


def first_terms(rows: DataFrame, terms: int, topics: int, mean: float, seed: int = 42) -> np.ndarray:
    """The terms' factor (topics x terms) of the double singular value start, zeros filled with the matrix's mean.

    Of each pair of singular vectors the part of one sign stays, the one whose product of lengths is larger.
    """
    sizes, v = term_vectors(rows, terms, topics, seed)
    sent = rows.sparkSession.sparkContext.broadcast(v)

    def lengths(docs: _Docs) -> np.ndarray:
        u = docs.times(sent.value)
        return np.stack([(np.maximum(u, 0) ** 2).sum(0), (np.maximum(-u, 0) ** 2).sum(0)])

    left = np.sqrt(_summed(rows, lengths, (2, v.shape[1]))) / np.maximum(sizes, 1e-12)
    right = np.stack([np.sqrt((np.maximum(v, 0) ** 2).sum(0)), np.sqrt((np.maximum(-v, 0) ** 2).sum(0))])
    h = np.zeros((topics, terms))
    for k in range(v.shape[1]):
        both = left[:, k] * right[:, k]
        sign = int(both[1] > both[0])
        own = np.maximum(v[:, k] if not sign else -v[:, k], 0)
        h[k] = np.abs(v[:, 0]) * np.sqrt(sizes[0]) if k == 0 else own / max(right[sign, k], 1e-12) * np.sqrt(sizes[k] * both[sign])
    h[h <= 1e-9] = mean
    return h


def _descended(x: np.ndarray, linear: np.ndarray, gram: np.ndarray, sweeps: int) -> np.ndarray:
    """Non-negative rows that lower |row|^2 by gram less twice row times linear, one column after another."""
    x = x.copy()
    for _ in range(sweeps):
        for k in range(len(gram)):
            if gram[k, k] > 1e-12:
                x[:, k] = np.maximum(0, x[:, k] + (linear[:, k] - x @ gram[:, k]) / gram[k, k])
    return x


def folded(docs: _Docs, h: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """The documents' topic weights for fixed terms (topics x terms)."""
    linear, gram = docs.times(h.T), h @ h.T
    return _descended(np.maximum(linear, 0) / np.maximum(np.diag(gram), 1e-12) / len(h), linear, gram, sweeps)


def nmf(weights: DataFrame, key: str = "doc_id", topics: int = 15, rounds: int = 100, seed: int = 42, tol: float = 1e-4, most_terms: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Non-negative factors of (key, term, w): topic weights per document (key, topic, weight) and per term (topic, term, weight).

    The start comes from the greatest singular vectors. Each round is one pass: the documents' factor follows from the terms'
    document by document and is never stored, and two sums go back, terms x topics and topics x topics, from which
    coordinate descent renews the terms' factor. It stops when a round lowers the squared error by less than tol times the
    first one, or after so many rounds. Only sums come back, so the partitioning changes nothing but their rounding.

    The terms' factor and its sums have topics x terms cells and are held by the driver and by each task, so a vocabulary of more
    than most_terms is refused: bound it by tfidf's max_features.
    """
    spark = shipped(weights).sparkSession
    place = written(numbered(weights.select("term").distinct(), ["term"], "i").withColumn("i", (F.col("i") - 1).cast("int")))
    terms = place.count()
    if terms > most_terms:
        raise ValueError(f"{terms} terms; bound the vocabulary to {most_terms}, or raise most_terms if so many times topics fit into memory")
    if not terms:
        return (weights.select(key, F.lit(0).alias("topic"), F.col("w").alias("weight")).limit(0), spark.createDataFrame([], "topic int, term string, weight double"))
    listed = F.array_sort(F.collect_list(F.struct("i", "w")))
    rows = weights.join(place, "term").groupBy(key).agg(listed.alias("x")).select(key, F.transform("x", lambda x: x["i"]).alias("i"), F.transform("x", lambda x: x["w"]).alias("w"))
    rows = written(rows)
    n, total, square = rows.agg(F.count("*"), F.sum(F.aggregate("w", F.lit(0.0), lambda a, x: a + x)), F.sum(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x))).first()
    h = first_terms(rows, terms, topics, total / (n * terms), seed)
    first = last = None
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(h)

        def sums(docs: _Docs, sent=sent) -> np.ndarray:
            h = sent.value
            x = folded(docs, h)
            fit = 2 * (x * docs.times(h.T)).sum() - ((x @ (h @ h.T)) * x).sum()
            return np.concatenate([docs.transposed(x, terms).ravel(), (x.T @ x).ravel(), [fit]])

        flat = _summed(rows, sums, (topics * terms + topics * topics + 1,))
        error = square - flat[-1]
        first = error if first is None else first
        if last is not None and last - error < tol * max(first, 1e-12):
            break
        last = error
        top, inner = flat[: topics * terms].reshape(terms, topics), flat[topics * terms : -1].reshape(topics, topics)
        h = _descended(h.T, top, inner, 5).T
    sent = spark.sparkContext.broadcast(h)
    kind = weights.schema[key].dataType.simpleString()

    def weighed(parts):
        for df in parts:
            x = folded(_Docs(list(df.i), list(df.w)), sent.value)
            yield pd.DataFrame({key: np.repeat(df[key].to_numpy(), topics), "topic": np.tile(np.arange(topics, dtype=np.int32), len(df)), "weight": x.ravel()})

    def listed_terms(parts):
        for df in parts:
            at, topic = np.nonzero(sent.value.T[df.i.to_numpy()] > 1e-9)
            yield pd.DataFrame({"topic": topic.astype(np.int32), "term": df.term.to_numpy()[at], "weight": sent.value.T[df.i.to_numpy()][at, topic]})

    return rows.select(key, "i", "w").mapInPandas(weighed, f"{key} {kind}, topic int, weight double"), place.mapInPandas(listed_terms, "topic int, term string, weight double")


def top_terms(terms: DataFrame, n: int = 10) -> DataFrame:
    return top_per_group(terms, ["topic"], [F.desc("weight"), F.col("term")], n)


def topic_names(terms: DataFrame, n: int = 3) -> DataFrame:
    best = top_terms(terms, n).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    return best.select("topic", F.array_join(F.transform("t", lambda x: x["term"]), "-").alias("name"))


def dominant(doc_topics: DataFrame, key: str = "doc_id") -> DataFrame:
    """Topic of greatest weight per document, of equals the least."""
    return doc_topics.groupBy(key).agg(F.max_by("topic", F.struct("weight", -F.col("topic"))).alias("topic"), F.max("weight").alias("score"))


def topic_articles(assigned: DataFrame) -> DataFrame:
    """assigned: topic, url."""
    return assigned.groupBy("topic").agg(F.countDistinct("url").alias("articles"))


def label_sets(labels: DataFrame) -> DataFrame:
    """(url, labels), the distinct labels of each url, from rows of url and label; a frame that has such arrays stays as it is."""
    if "labels" in labels.columns:
        return labels.select("url", "labels")
    return labels.filter("url is not null").groupBy("url").agg(F.collect_set(F.struct("label")).alias("s")).select("url", F.col("s.label").alias("labels"))


def alignment(assigned: DataFrame, labels: DataFrame, best: int = 5, novel_below: float = 0.3) -> DataFrame:
    """Per topic, the labels that most of its labelled articles have, with their share; novel if none has enough.

    assigned: topic, url; labels: what label_sets takes. Topics and labels meet as one row per article; a further entry of its
    labels counts the article itself.
    """
    topics = assigned.filter("topic is not null").groupBy("url").agg(F.collect_set("topic").alias("topics"))
    entries = F.array_append(F.transform("labels", lambda x: F.named_struct(F.lit("label"), x)), F.lit(None))
    both = topics.join(label_sets(labels), "url").select(F.explode("topics").alias("topic"), entries.alias("entries"))
    counts = both.select("topic", F.explode("entries").alias("entry")).groupBy("topic", "entry").agg(F.count("*").alias("c"))
    n = F.max(F.when(F.col("entry").isNull(), F.col("c"))).over(Window.partitionBy("topic"))
    share = counts.withColumn("n", n).filter("entry is not null").select("topic", "entry.label", (F.col("c") / F.col("n")).alias("share"))
    ranked = top_per_group(share, ["topic"], [F.desc("share"), F.col("label")], best)
    return ranked.withColumn("novel", F.expr("max(share) over (partition by topic)") < novel_below)


def mislabelled(assigned: DataFrame, labels: DataFrame, aligned: DataFrame, least_score: float = 0.5, least_share: float = 0.3) -> DataFrame:
    """Articles whose first excerpt has a clear topic, with labels but none of the topic's aligned ones.

    assigned: url, position, topic, score; labels: what label_sets takes; aligned: a few rows of each topic, which are sent to all tasks.
    """
    first = assigned.groupBy("url").agg(F.min_by(F.struct("topic", "score"), "position").alias("f")).select("url", "f.topic", "f.score").filter(F.col("score") >= least_score)
    good = aligned.filter(F.col("share") >= least_share).groupBy("topic").agg(F.collect_set("label").alias("good"))
    known = first.join(label_sets(labels), "url").join(F.broadcast(good), "topic", "left")
    told = F.arrays_overlap(F.array_compact("labels"), "good")
    return known.filter(~F.coalesce(told, F.lit(False))).select("url", "topic", "score")


def topic_trends(dated: DataFrame, recent_months: int = 12, rising: float = 1.3, falling: float = 0.7) -> DataFrame:
    """Recent distinct articles of a topic against what its earlier rate would give. dated: topic, url, month."""
    ends = dated.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    rows = dated.crossJoin(F.broadcast(ends)).withColumn("cut", F.add_months("hi", -recent_months))
    per = rows.groupBy("topic").agg(
        F.countDistinct(F.when(F.col("month") >= F.col("cut"), F.col("url"))).alias("recent"), F.countDistinct(F.when(F.col("month") < F.col("cut"), F.col("url"))).alias("earlier"), F.max(F.datediff("cut", "lo")).alias("days")
    )
    expected = F.greatest(F.coalesce(F.try_divide(F.col("earlier"), F.col("days") / 30), F.lit(0.0)) * recent_months, F.lit(0.1))
    ratio = F.col("recent") / expected
    return per.select("topic", "recent", "earlier", ratio.alias("ratio"), F.when(ratio > rising, "rising").when(ratio < falling, "declining").otherwise("stable").alias("direction"))
