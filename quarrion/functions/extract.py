"""Extraction of excerpts, citations, bibliography entries and links from text, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrion.functions.text import ascii_ratio, is_english, matches_at, resolve_url, text_hash, word_count

# Patterns of inline citations (author group, year group) by type, in their order.
AUTHOR = r"[A-Z][a-zé]+(?:\s+et\s+al\.?(?:\s+[A-Z][a-zé]+)?|\s+(?:and|&)\s+[A-Z][a-zé]+)?"
CITATIONS = (
    ("author_year", rf"({AUTHOR})\s*\((\d{{4}}[a-z]?)\)", 1, 2),
    ("parenthetical", rf"\(({AUTHOR})\s+(\d{{4}}[a-z]?)\)", 1, 2),
    ("parenthetical_comma", rf"\(({AUTHOR}),\s*(\d{{4}}[a-z]?)\)", 1, 2),
    ("year_after_quote", r'"\s*\((\d{4})\)', None, 1),
)
# Markers of a reference section, and the shapes of an entry's journal.
SECTION_MARKERS = ("references", "bibliography", "works cited", "sources", "literature", "citations", "notes")
JOURNALS = (r"[Ii]n\s+([A-Z][^,]+),", r",\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+\d+", r"Journal of ([^,]+)")
# What marks an excerpt of each kind, most telling kind first.
QUOTE, EMPHASIS = r'"([^"]{25,500})"', r"\*([^*]{30,500})\*"
SKIPPED_IMAGES = ("favicon", "icon", "button", "logo", "avatar", "emoji", "widget", "badge", "banner-ad", "advertisement")
IMAGE_TYPES = ("jpg", "jpeg", "png", "gif", "webp", "svg")
# Coordinate mentions.
COORDINATES = (r"[-+]?\d{1,3}\.\d{3,}\s*,\s*[-+]?\d{1,3}\.\d{3,}", r"\d{1,3}°\d{1,2}'[^NSEW]{0,8}[NSEW]", r"[+-]\d{3}[+-]\d{3}")
HAS_COORDINATES = r"[-+]?\d{1,3}\.\d{3,}"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _quoted(terms: Sequence[str]) -> str:
    return "|".join("\\Q" + t + "\\E" for t in terms)


def excerpts(text: Column, terms: Sequence[str], technical_most: int = 400, narrative_most: int = 250) -> Column:
    """English excerpts as array of struct text, hash, words, category; of equal texts the first category stays.

    Quotes, emphasised text, sentences with a term, and long sentences; at least 30 characters, 6 words and 80 % ASCII.
    """
    narrative = F.filter(_all(text, rf"([A-Z][a-z][^.!?]{{40,{narrative_most}}}[.!?])", 1), lambda s: ascii_ratio(s) > 0.95)
    technical = F.filter(_all(text, rf"([A-Z][^.!?]*(?:{_quoted(terms)})[^.!?]*[.!?])", 1), lambda s: F.length(s) < technical_most)
    kinds = (("quote", _all(text, QUOTE, 1)), ("emphasis", _all(text, EMPHASIS, 1)), ("technical", technical), ("narrative", narrative))

    def tagged(kind: str):
        return lambda s: F.struct(squeezed(s).alias("text"), F.lit(kind).alias("category"))

    each = F.concat(*(F.transform(x, tagged(k)) for k, x in kinds))
    good = F.filter(each, lambda e: (F.length(e["text"]) >= 30) & (ascii_ratio(e["text"]) >= 0.8) & (word_count(e["text"]) >= 6))
    return first_of_equal(F.transform(good, lambda e: F.struct(e["text"].alias("text"), text_hash(e["text"]).alias("hash"), word_count(e["text"]).alias("words"), e["category"].alias("category"))), "hash")


def spoken_excerpts(text: Column, terms: Sequence[str]) -> Column:
    """The stricter excerpts as array of struct text, words: quotes of 25 characters (6 words), text between asterisks of 30 (8
    words), sentences with a term (10 words, 90 % ASCII); all of 30 characters and 80 % ASCII. Of equal texts the first stays."""
    kinds = ((r'"([^"]{25,})"', 6, 0.8), (r"\*([^*]{30,})\*", 8, 0.8), (rf"([A-Z][^.!?]*(?:{_quoted(terms)})[^.!?]*[.!?])", 10, 0.9))

    def tidy(s: Column) -> Column:
        return F.replace(F.replace(F.regexp_replace(s, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))

    def fits(least: int, ascii_least: float):
        return lambda e: (F.length(e["text"]) >= 30) & (ascii_ratio(e["text"]) >= ascii_least) & (e["words"] >= least)

    def row(s: Column) -> Column:
        return F.struct(s.alias("text"), word_count(s).alias("words"))

    each = (F.filter(F.transform(F.transform(_all(text, p, 1), tidy), row), fits(words, share)) for p, words, share in kinds)
    return F.array_distinct(F.concat(*each))


def first_of_equal(items: Column, field: str) -> Column:
    """An array of structs without those whose field an earlier one has."""
    keys = F.transform(items, lambda x: x[field])
    return F.filter(items, lambda x, i: F.array_position(keys, x[field]) == i + 1)


def contained_once(sentences: Column) -> Column:
    """Keeps a sentence if no kept one before contains it or is contained in it."""
    return F.aggregate(sentences, F.array().cast("array<string>"), lambda kept, s: F.when(F.exists(kept, lambda k: F.contains(k, s) | F.contains(s, k)), kept).otherwise(F.concat(kept, F.array(s))))


def english_sentences(text: Column, least: int = 60) -> Column:
    """Quotes of 25 characters and sentences longer than least that pass the English test, containment removed."""
    quotes = _all(text, r'"([^"]{25,})"', 1)
    sentences = F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) > least)
    return contained_once(F.filter(F.concat(quotes, sentences), lambda s: is_english(s)))


def citations(text: Column) -> Column:
    """Inline citations as array of struct text, hash, type, author, year, position; of equal ones the first type stays."""
    def parted(kind: str, pattern: str, author: int | None, year: int):
        def row(m: Column) -> Column:
            name = _first(m["text"], pattern, author) if author else F.lit(None).cast("string")
            return F.struct(m["text"].alias("text"), text_hash(m["text"]).alias("hash"), F.lit(kind).alias("type"), name.alias("author"), _first(m["text"], pattern, year).alias("year"), m["start"].alias("position"))

        return row

    return first_of_equal(F.concat(*(F.transform(matches_at(text, c[1]), parted(*c)) for c in CITATIONS)), "hash")


def reference_section(text: Column) -> Column:
    """From the last section marker on, or the whole text."""
    low = F.lower(text)
    starts = [F.when(F.contains(low, F.lit(m)), F.length(text) - F.locate(m[::-1], F.reverse(low)) - len(m) + 2).otherwise(0) for m in SECTION_MARKERS]
    start = F.greatest(*starts)
    return F.when(start > 1, F.substring(text, start, F.length(text))).otherwise(text)


def bibliography_lines(text: Column) -> Column:
    """Entries of the reference section: blank lines and author lines part them, each needs a year."""
    lines = F.transform(F.split(reference_section(text), r"\n\s*\n|\n(?=[A-Z][a-z]+,?\s+[A-Z]\.)"), F.trim)
    return F.array_distinct(F.filter(lines, lambda s: (F.length(s) >= 20) & s.rlike(r"\(\d{4}[a-z]?\)") & (s.rlike(r"^[A-Z][a-zé]+") | s.rlike(r"\(\d{4}\)"))))


def bibliography_entry(entry: Column) -> Column:
    """An entry's parts as a struct."""
    year = _first(entry, r"\((\d{4}[a-z]?)\)")
    before = F.regexp_extract(entry, r"(?s)^(.*?)\(\d{4}[a-z]?\)", 1)
    after = F.regexp_replace(F.regexp_extract(entry, r"(?s)\(\d{4}[a-z]?\)(.*)$", 1), r"^[\s.,:]+", "")
    author = F.nullif(F.substring(F.regexp_replace(F.trim(before), r"[,.]+$", ""), 1, 200), F.lit(""))
    title = F.coalesce(_first(entry, r'"([^"]+)"'), F.when(year.isNotNull(), _first(after, r"^([^.]+)\.")))
    journal = F.coalesce(*(_first(entry, p) for p in JOURNALS))
    volume, both = _first(entry, r"(\d+)\s*[:(]\s*(\d+[-–]\d+)"), _first(entry, r"(\d+)\s*[:(]\s*(\d+[-–]\d+)", 2)
    return F.struct(
        F.substring(entry, 1, 500).alias("text"), text_hash(entry).alias("hash"), F.when(year.isNotNull(), author).alias("author"), year.alias("year"), F.substring(title, 1, 300).alias("title"), F.substring(journal, 1, 200).alias("journal"),
        volume.alias("volume"), F.coalesce(both, _first(entry, r"pp?\.?\s*(\d+[-–]\d+)")).alias("pages"), _first(entry, r"(10\.\d{4,}/\S+)").alias("doi"), _first(entry, r"(https?://\S+)").alias("url"),
    )


def coordinate_mentions(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*(_all(text, p, 0) for p in COORDINATES))))


def lat_lon(text: Column) -> Column:
    """A struct of both numbers of "lat, lon", or null."""
    parts = F.split(text, ",")
    lat, lon = (F.trim(F.try_element_at(parts, F.lit(i))).try_cast("double") for i in (1, 2))
    return F.when((F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def page_title(html: Column, site: str = "") -> Column:
    """The post's heading, else the page's title without the site's prefix; at most 200 characters."""
    heading = _first(html, r"(?is)<h3[^>]*class=\"[^\"]*post-title[^\"]*\"[^>]*>(.*?)</h3>")
    title = F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), "^" + _quoted([site]) if site else "^$", "")
    return F.substring(squeezed(F.regexp_replace(F.coalesce(heading, title), r"<[^>]+>", "")), 1, 200)


def page_labels(html: Column) -> Column:
    return F.transform(_all(html, r"(?is)<a[^>]*rel=[\"']tag[\"'][^>]*>(.*?)</a>", 1), squeezed)


def page_links(html: Column, pattern: str = r"[^\"']+") -> Column:
    return F.array_distinct(_all(html, rf"(?i)<a[^>]*href=[\"']({pattern})[\"']", 1))


def markdown_meta(text: Column, site_prefix: str = "Site:") -> Column:
    """Title and date of a page in markdown."""
    title = F.coalesce(_first(text, r"### \[([^\]]+)\]"), _first(text, "\\Q" + site_prefix + "\\E\\s*([^\\n]+)"), F.lit("Untitled"))
    return F.struct(F.substring(F.trim(title), 1, 200).alias("title"), _first(text, r"## ([A-Z][a-z]+ \d+, \d{4})").alias("date"))


def image_rows(html: Column, base: str) -> Column:
    """Content images of a page as array of struct url, hash, alt_text, width, height, file_type, is_header, position."""
    tags = F.transform(_all(html, r"(?is)<img\b[^>]*>", 0), lambda t, i: F.struct(t.alias("tag"), i.alias("position")))

    def attr(tag: Column, name: str) -> Column:
        return F.coalesce(_first(tag, rf"(?i)\s{name}=\"([^\"]*)\""), _first(tag, rf"(?i)\s{name}='([^']*)'"))

    def row(x: Column) -> Column:
        src = resolve_url(attr(x["tag"], "src"), base)
        width, height = (attr(x["tag"], n).try_cast("int") for n in ("width", "height"))
        kind = F.coalesce(*(F.when(F.contains(F.lower(src), F.lit("." + e)), e) for e in IMAGE_TYPES))
        header = F.contains(F.lower(src), F.lit("header")) | (x["position"] == 0)
        return F.struct(src.alias("url"), text_hash(src).alias("hash"), F.substring(attr(x["tag"], "alt"), 1, 500).alias("alt_text"), width.alias("width"), height.alias("height"), kind.alias("file_type"), header.cast("int").alias("is_header"), x["position"].alias("position"))

    rows = F.filter(F.transform(tags, row), lambda r: r["url"].isNotNull() & ~F.coalesce((r["width"] < 50) | (r["height"] < 50), F.lit(False)) & ~F.lower(r["url"]).rlike(_quoted(SKIPPED_IMAGES)))
    return first_of_equal(rows, "hash")
