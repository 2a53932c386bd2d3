"""Column functions on text. All are built-in expressions; null gives null unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The function words of the English test.
ENGLISH = (
    "the is are was were be have has had do does will would could should a an and or but if when at by for with about to from in on that this we they you it not no can all been being more"
).split()
KEYWORD_MODES = ("substring", "token")
REFERENCE, REFERENCE_ANY = r"FL-\d{6}", r"(?i)FL[-_]?(?:\d{6}|\d{2}[-/]\d{2}[-/]\d{2})"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM", "MMM d, yyyy", "MMM yyyy", "yyyy")


def matches_at(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their place (from 0): array of struct start, text."""
    kind = "array<struct<start:int,text:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        out = F.when(x["m"].isNotNull(), F.concat(acc["out"], F.array(F.struct(start.alias("start"), x["m"].alias("text"))))).otherwise(acc["out"])
        return F.struct((start + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"), out.alias("out"))

    folded = F.aggregate(both, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, folded).otherwise(F.array().cast(kind))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def ascii_ratio(text: Column) -> Column:
    """Share of characters below 128; null for the empty text."""
    return F.try_divide(F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")), F.length(text))


def is_english(text: Column, least: int = 3, share: float = 0.12, stop: Sequence[str] = tuple(ENGLISH)) -> Column:
    """At least so many distinct function words, and more than that share of the distinct words."""
    distinct = F.array_distinct(words(F.lower(text)))
    hits = F.size(F.array_intersect(distinct, F.array(*map(F.lit, stop))))
    return (hits >= least) & (hits > share * F.size(distinct))


def tag_terms(text: Column, terms: Sequence[str], mode: str = "substring") -> Column:
    """Terms, in their order, that the text has, in any case; as substrings or as whole tokens."""
    low = F.lower(text)
    tokens = F.split(low, r"[^\p{L}\p{N}]+") if mode == "token" else None
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.array_contains(tokens, F.lower(t)) if mode == "token" else F.contains(low, F.lower(t)))


def references(text: Column, broad: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(REFERENCE_ANY if broad else REFERENCE), F.lit(0))


def month_from_url(url: Column) -> Column:
    """yyyy-MM from /yyyy/MM/ in a URL, else null."""
    year, month = (F.regexp_extract(url, r"/(\d{4})/(\d{2})/", g) for g in (1, 2))
    return F.when(year != "", F.concat_ws("-", year, month))


def parse_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The first format that fits gives the date, else null."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats)).cast("date")


def clean_year(text: Column, low: int = 1000, high: int = 2030) -> Column:
    """A number's whole part in range, else a stand-alone four-digit run in range, else null."""
    number = text.try_cast("double").try_cast("int")
    run = F.nullif(F.regexp_extract(text, r"\b(\d{4})\b", 1), F.lit("")).cast("int")
    return F.when(text.try_cast("double").isNotNull(), F.when(number.between(low, high), number)).otherwise(F.when(run.between(low, high), run))


def clean_text(text: Column) -> Column:
    """Lower case, without URLs, letters only, single blanks."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"https?://\S+", " "), r"[^a-z\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def text_hash(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def highlight(text: Column, term: str, ignore_case: bool = True, most: int = 300) -> Column:
    flag = "(?i)" if ignore_case else ""
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(F.substring(text, 1, most), flag + "(" + quoted + ")", "<mark>$1</mark>")


def html_escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def url_encode(text: Column) -> Column:
    """Percent encoding, blanks as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def resolve_url(url: Column, base: str) -> Column:
    root = base.split("/")[0] + "//" + base.split("/")[2]
    return (
        F.when(url.startswith("//"), F.concat(F.lit(base.split(":")[0] + ":"), url))
        .when(url.startswith("/"), F.concat(F.lit(root), url))
        .when(url.rlike(r"^[a-z]+:"), url)
        .otherwise(F.concat(F.lit(base.rsplit("/", 1)[0] + "/"), url))
    )


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) for v in (a, b)]
    return F.when((size[0] > 0) & (size[1] > 0), dot / (size[0] * size[1])).otherwise(0.0)


def fenced_json(text: Column) -> Column:
    """What a fenced json block holds, else the text."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inner != "", F.trim(inner)).otherwise(F.trim(text))


def is_coined(label: Column, common: Sequence[str] = ()) -> Column:
    """Looks like a coined name: not ASCII, or a single capitalised word of up to six letters that isn't listed as common."""
    short = ~F.contains(label, F.lit(" ")) & (F.length(label) <= 6) & label.rlike("^[A-Z]")
    return label.rlike(r"[^\x00-\x7F]") | (short & ~label.isin(*common) if common else short)


def value_of(values: Column, key, default=0) -> Column:
    """What a map has for a key, else the default; also for a null map."""
    return F.coalesce(F.try_element_at(values, F.lit(key)), F.lit(default))


def by_value(values: Column, most: int | None = None) -> Column:
    """A map's entries (key, value) by falling value, then by key; the first so many."""
    entries = F.transform(F.map_entries(values), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("key"), e["value"].alias("value")))
    rows = F.transform(F.array_sort(entries), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return rows if most is None else F.slice(rows, 1, most)
