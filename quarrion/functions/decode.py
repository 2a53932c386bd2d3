"""Coded coordinates of the form ±NN±NN to ±NNN±NNN, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrion.functions.text import matches_at

# The code's pattern, the tags that mark a context, and the reach of a context in characters.
CODE = r"([+-]\d{2,3})([+-]\d{2,3})"
TAG_DSP, TAG_ORB, TAG_ANY = r"(?i)MilDSP", r"(?i)MilOrb|MilDSP", r"(?i)MilOrb|MilDSP|Cassini Diskus"
CONTEXT = 40

PLACE = "struct<lat:double,lon:double,method:string,is_celestial:boolean>"


def parse_code(code: Column) -> tuple[Column, Column]:
    """Both numbers of the first code in the text; null without one."""
    return tuple(F.nullif(F.regexp_extract(code, CODE, g), F.lit("")).cast("int") for g in (1, 2))


def _place(lat: Column, lon: Column, method: str, fits: Column) -> Column:
    ok = fits & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), F.lit(method).alias("method"), F.lit(False).alias("is_celestial")))


def decode_small(v1: Column, v2: Column) -> Column:
    return _place(v1 + 21, v2 / 4, "small", F.abs(v1) <= 90)


def decode_large(v1: Column, v2: Column) -> Column:
    return _place(v2 / 10, v1 / 10, "large", F.lit(True))


def decode_dsp(v1: Column, v2: Column) -> Column:
    return _place(-0.0197 * v1 + 37.61, 1.1247 * v2 - 93.96, "dsp", F.lit(True))


def decode_celestial(v1: Column, v2: Column) -> Column:
    """lat holds the declination in degrees and lon the right ascension in hours; the first number's sign doesn't count."""
    size = F.abs(v1)
    hours, minutes = F.when(size < 100, F.lit(0)).otherwise(F.floor(size / 100)), F.when(size < 100, size).otherwise(size % 100)
    ok = (hours <= 24) & (minutes <= 59) & F.abs(v2 / 10).between(0, 90)
    return F.when(ok, F.struct((v2 / 10).cast("double").alias("lat"), (hours + minutes / 60).cast("double").alias("lon"), F.lit("celestial").alias("method"), F.lit(True).alias("is_celestial")))


def decode(v1: Column, v2: Column, context: Column) -> Column:
    """A struct lat, lon, method, is_celestial: tagged codes by dsp or celestial; others by size, then the same two."""
    plain = F.when(F.abs(v1) <= 90, decode_small(v1, v2)).otherwise(decode_large(v1, v2))
    tagged = F.coalesce(decode_dsp(v1, v2), decode_celestial(v1, v2))
    return F.when(F.coalesce(context.rlike(TAG_DSP), F.lit(False)), tagged).otherwise(F.coalesce(plain, tagged))


def false_positive(code: Column, context: Column) -> Column:
    """Codes that look like dates, parts of identifiers, or small numbers, without a tag near them."""
    v1, v2 = parse_code(code)
    date = (F.abs(v1) <= 31) & (F.abs(v2) <= 31) & (v1 < 0) & (v2 < 0) & ~context.rlike(TAG_ANY)
    quoted = F.concat(F.lit(r"\Q"), code, F.lit(r"\E"))
    part = F.rlike(context, F.concat(F.lit("[A-Za-z0-9]"), quoted, F.lit("|"), quoted, F.lit("[A-Za-z/]"))) & ~context.rlike(TAG_ORB)
    small = (F.abs(v1) < 20) & (F.abs(v2) < 20) & ~context.rlike(TAG_ANY + r"|\+\d{2,3}[+-]\d{2,3}")
    return v1.isNull() | date | part | small


def codes_in(text: Column) -> Column:
    """Sorted distinct codes of a text with the context of each one's first place, without false positives."""
    near = F.transform(matches_at(text, CODE), lambda m: F.struct(m["text"].alias("code"), F.substring(text, F.greatest(F.lit(1), m["start"] + 1 - CONTEXT), F.length(m["text"]) + CONTEXT + F.least(m["start"], F.lit(CONTEXT))).alias("context")))
    kept = F.filter(near, lambda m: ~false_positive(m["code"], m["context"]))
    first = F.filter(kept, lambda m, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda e: e["code"] == m["code"]))
    return F.array_sort(first)
