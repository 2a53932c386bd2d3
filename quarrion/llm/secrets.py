"""Secret scans with corpus-wide ownership frequency.

The base kinds are fixed patterns. Besides them, long mixed tokens are candidates. Every candidate is known by the
SHA-256 of its value, never by the value; the hashes are counted by distinct repositories and owners over the whole
corpus. A value that several owners carry, or that is in more than MAX_REPOS repositories, is a widely copied example; any
other looks live. Live mixed tokens that don't overlap a base span are added to the spans of their text as kind `owned`.

Positions come from the pieces between matches (split) and the matches themselves, so everything is built-in
functions. The ownership counts are three partial aggregations, so one value on a third of the rows is pre-summed
before each shuffle. Verdicts are joined per distinct text.

Defined results: a null text counts as empty; it has no spans and the digest of the empty text. Null owners are one
owner, null ids one repository. Repeated rows give repeated results. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.llm.shared import doc_text, written

# The kinds in their order, with pattern, the group that holds the value, and its least length.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Candidates of the method: long runs that mix digits with letters.
OWNED, OWNED_PATTERN = "owned", r"[A-Za-z0-9+/_-]{24,}"
#: A value of more owners, or in more repositories, is an example.
MAX_OWNERS, MAX_REPOS = 1, 20
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,hash:string>>"


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches of which the group has the least length, with code point positions."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("m"), value.alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), F.sha2(x["v"], 256).alias("hash"))
        out = F.when(F.length(x["v"]) >= least, F.concat(F.coalesce(acc["out"], F.array().cast(SPAN)), F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    found = F.aggregate(both, start, step, lambda acc: acc["out"])
    return F.when(F.size(whole) > 0, F.coalesce(found, F.array().cast(SPAN))).otherwise(F.array().cast(SPAN))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and the ownership verdicts n_live and n_example.

    repo_col names the repository; without one each id is a repository. Repositories are counted as pairs with their
    owner.
    """
    text = doc_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col or id_col).cast("string").alias("repo"), text.alias("text"))
    for rank, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        rows = rows.withColumn(kind, _spans(F.col("text"), kind, rank, pattern, group, least))
    mixed = _spans(F.col("text"), OWNED, len(KINDS), OWNED_PATTERN, 0, 24)
    # sha256 hides the value, so the shape is tested on the matches before hashing: digits and letters together.
    shape = F.exists(F.regexp_extract_all("text", F.lit(OWNED_PATTERN), F.lit(0)), lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
    base = F.array_sort(F.concat(*KINDS))
    rows = rows.withColumn("base", base).withColumn("mixed", F.when(shape, mixed).otherwise(F.array().cast(SPAN)))
    free = F.filter("mixed", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    scan = written(
        rows.select("doc_id", "owner", "repo", F.sha2("text", 256).alias("sha"), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), "base", F.when(F.size("mixed") > 0, free).otherwise(F.col("mixed")).alias("free"))
    )

    found = scan.filter("size(base) + size(free) > 0")
    seen = found.select("owner", "repo", F.explode(F.array_distinct(F.transform(F.concat("base", "free"), lambda s: s["hash"]))).alias("hash"))
    owners = seen.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    owners = owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))

    texts = found.groupBy("sha").agg(F.first("base").alias("base"), F.first("free").alias("free"))
    cands = texts.select("sha", F.explode(F.concat("base", "free")).alias("s")).select("sha", "s", F.col("s.hash").alias("hash"))
    judged = cands.join(owners, "hash").withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    judged = judged.groupBy("sha").agg(
        F.collect_list(F.when(F.col("live") & (F.col("s.kind") == OWNED), F.col("s"))).alias("added"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_example"),
    )
    # Texts without candidates, empty ones above all, have nothing to join.
    none = scan.filter("size(base) + size(free) = 0")
    verdicts = ("added", "n_live", "n_example")
    out = found.join(judged, "sha").unionByName(none.select("*", *(F.lit(None).cast(judged.schema[c].dataType).alias(c) for c in verdicts)))
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN))))
    return out.select(
        "doc_id",
        *(f"n_{k}" for k in KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )
