"""Pages as tables of nodes, and what follows from where a node stands: post bodies, labels and captions.

The standard library's parser streams events, from which one row per element and per text is made: its place in the page, the last
place inside it, its parent, and its place among the parent's children. An end tag closes the innermost open element of its name
and what is open inside; one without a start is ignored. Texts of scripts, styles and templates, and comments, are left out.

A null page has no rows, and neither has an empty one. Pages with the same key share one tree's numbers, so keys must be unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.shipping import shipped

# Elements without an end, elements whose text isn't shown, and elements that can be a caption after an image.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSHOWN = frozenset(("script", "style", "template"))
AFTER_IMAGE = ("span", "div", "p", "em", "i")
TEXT = "#text"
#: Nodes that are sent at once, about.
BATCH = 10_000
_FIELDS = "node int, last int, parent int, place int, tag string, attrs map<string,string>, text string"
_KIND = pa.map_(pa.string(), pa.string())


class _Tree(HTMLParser):
    """Collects [node, last, parent, place, tag, attrs, text]; node 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = [[0, 0, None, 0, "", None, None]]
        self.open, self.children = [0], [0]
        self.text: list[str] = []

    def add(self, tag: str, attrs: list | None, text: str | None) -> None:
        node = len(self.rows)
        self.rows.append([node, node, self.open[-1], self.children[-1], tag, attrs, text])
        self.children[-1] += 1

    def flush(self) -> None:
        if self.text and self.rows[self.open[-1]][4] not in UNSHOWN:
            self.add(TEXT, None, "".join(self.text))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        self.add(tag, list({k: v or "" for k, v in reversed(attrs)}.items()), None)
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)
            self.children.append(0)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if any(self.rows[k][4] == tag for k in self.open[1:]):
            while self.end() != tag:
                pass

    def end(self) -> str:
        node = self.open.pop()
        self.children.pop()
        self.rows[node][1] = len(self.rows) - 1
        return self.rows[node][4]

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def done(self) -> list[list]:
        self.close()
        self.flush()
        while self.open:
            self.end()
        return self.rows


def page_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, node, last, parent, place, tag, attrs, text): the elements and texts of each page. Of repeated attributes the first counts."""
    kind = pages.select(key).schema[0].dataType.simpleString()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), _KIND, pa.string())
        names = ["page", *(f.split()[0] for f in _FIELDS.split(", "))]
        for batch in batches:
            rows, of = [], []
            for k in range(batch.num_rows):
                tree = _Tree()
                tree.feed(batch.column("html")[k].as_py())
                own = tree.done()
                rows += own
                of += [k] * len(own)
                if len(rows) > BATCH or k == batch.num_rows - 1:
                    yield pa.record_batch([batch.column("page").take(pa.array(of)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)
                    rows, of = [], []

    rows = shipped(pages).select(F.col(key).alias("page"), F.col(html).cast("string").alias("html")).filter("html != ''")
    return rows.mapInArrow(parsed, f"page {kind}, {_FIELDS}").withColumnRenamed("page", key)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\u0085 ]+|[\s\x1c-\x1f\u0085 ]+$", "")


def subtree_texts(nodes: DataFrame, chosen: DataFrame, key: str = "page_id", separator: str = "", strip: bool = True) -> DataFrame:
    """(key, node, text): the texts inside each chosen element (key, node, last) in page order, joined; stripped ones leave out the empty."""
    own = chosen.select(F.col(key).alias("_page"), F.col("node").alias("_node"), F.col("last").alias("_last"))
    texts = nodes.filter(F.col("tag") == TEXT).select(key, "node", (_trimmed(F.col("text")) if strip else F.col("text")).alias("text"))
    if strip:
        texts = texts.filter("text != ''")
    inside = own.join(texts, (F.col(key) == F.col("_page")) & (F.col("node") > F.col("_node")) & (F.col("node") <= F.col("_last")), "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("node", "text"))))
    per = inside.groupBy("_page", "_node").agg(listed.alias("texts"))
    return per.select(F.col("_page").alias(key), F.col("_node").alias("node"), F.array_join(F.transform("texts", lambda x: x["text"]), separator).alias("text"))


def _has(name: str, value: str) -> Column:
    """Whether a list of words in an attribute has the value."""
    return F.coalesce(F.array_contains(F.split(F.element_at("attrs", F.lit(name)), r"\s+"), value), F.lit(False))


def _first(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(F.struct("node", "last")).alias("at")).select(key, "at.node", "at.last")


def post_bodies(nodes: DataFrame, key: str = "page_id", body_class: str = "post-body") -> DataFrame:
    """(key, text): the texts of the first div of the class, else of the whole page, one below the other."""
    bodies = _first(nodes.filter((F.col("tag") == "div") & _has("class", body_class)), key)
    whole = nodes.filter("node = 0").join(bodies.select(key), key, "left_anti").select(key, "node", "last")
    return subtree_texts(nodes, bodies.unionByName(whole), key, "\n", strip=False).select(key, "text")


def post_titles(nodes: DataFrame, key: str = "page_id", title_class: str = "post-title", prefix: str = "", most: int = 200) -> DataFrame:
    """(key, title): the first h3 of the class, else the page's title, without the site's prefix; Untitled if there is neither."""
    found = nodes.filter((F.col("tag") == "title") | ((F.col("tag") == "h3") & _has("class", title_class)))
    best = found.groupBy(key).agg(F.min(F.struct((F.col("tag") == "title").alias("t"), "node", "last")).alias("at")).select(key, "at.node", "at.last")
    texts = subtree_texts(nodes, best, key).select(key, F.col("text").alias("title"))
    title = F.coalesce("title", F.lit("Untitled"))
    if prefix:
        title = F.regexp_replace(title, r"^\Q" + prefix + r"\E\s*", "")
    return nodes.filter("node = 0").select(key).join(texts, key, "left").select(key, F.substring(title, 1, most).alias("title"))


def labels(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, place, label): the texts of links with rel=tag, in page order from 0."""
    found = nodes.filter((F.col("tag") == "a") & _has("rel", "tag")).select(key, "node", "last")
    place = F.row_number().over(Window.partitionBy(key).orderBy("node")) - 1
    return subtree_texts(nodes, found, key).select(key, place.alias("place"), F.col("text").alias("label"))


def image_captions(nodes: DataFrame, key: str = "page_id", longest: int = 500, least: int = 200) -> DataFrame:
    """(key, node, src, alt, caption) of every image with a source.

    The caption is the first figcaption inside the image's parent, else the next element after the image if it can be one and has
    fewer than `least` characters, else null.
    """
    images = nodes.filter((F.col("tag") == "img") & (F.coalesce(F.element_at("attrs", F.lit("src")), F.lit("")) != ""))
    images = images.select(key, "node", "parent", "place", F.element_at("attrs", F.lit("src")).alias("src"), F.coalesce(F.element_at("attrs", F.lit("alt")), F.lit("")).alias("alt"))
    around = nodes.select(F.col(key).alias("_page"), F.col("node").alias("_parent"), F.col("last").alias("_end"))
    parents = images.join(around, (F.col(key) == F.col("_page")) & (F.col("parent") == F.col("_parent"))).select(key, F.col("node").alias("image"), "_parent", "_end")
    caps = nodes.filter("tag = 'figcaption'").select(F.col(key).alias("_page"), F.col("node").alias("cap"), F.col("last").alias("cap_last"))
    inside = parents.join(caps, (F.col(key) == F.col("_page")) & (F.col("cap") > F.col("_parent")) & (F.col("cap") <= F.col("_end")))
    inside = inside.groupBy(key, "image").agg(F.min(F.struct(F.col("cap").alias("node"), F.col("cap_last").alias("last"))).alias("at")).select(key, "image", "at.*", F.lit(True).alias("figure"))
    after = nodes.filter(F.col("tag") != TEXT).select(F.col(key).alias("_page"), F.col("parent").alias("_parent"), F.col("place").alias("_place"), F.col("node").alias("sib"), F.col("last").alias("sib_last"), F.col("tag").alias("sib_tag"))
    next_ = images.join(after, (F.col(key) == F.col("_page")) & (F.col("parent") == F.col("_parent")) & (F.col("_place") > F.col("place")))
    next_ = next_.groupBy(key, F.col("node").alias("image")).agg(F.min(F.struct(F.col("sib").alias("node"), F.col("sib_last").alias("last"), "sib_tag")).alias("at"))
    next_ = next_.filter(F.col("at.sib_tag").isin(*AFTER_IMAGE)).select(key, "image", "at.node", "at.last", F.lit(False).alias("figure"))
    next_ = next_.join(inside.select(key, "image"), [key, "image"], "left_anti")
    found = inside.unionByName(next_)
    texts = subtree_texts(nodes, found.select(key, "node", "last").distinct(), key)
    own = found.join(texts, [key, "node"]).filter(F.col("figure") | (F.length("text") < least)).select(key, F.col("image").alias("node"), F.substring("text", 1, longest).alias("caption"))
    return images.select(key, "node", "src", "alt").join(own, [key, "node"], "left")
