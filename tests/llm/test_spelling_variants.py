"""Spelling variants against brute force, with blocks of any size, and their edge cases."""

from __future__ import annotations

import random
from itertools import combinations

import brute
import pytest
from pyspark.sql import functions as F
from test_llm import CLASH, COLUMNS, corpus, ordered

from quarrion.llm import spelling_variants as V

SMALL = [{}, {"most_words": 4}, {"most_words": 30, "most_chars": 100}]


def edited(rng: random.Random, word: str, letters: str) -> str:
    at = rng.randrange(len(word) + 1)
    return rng.choice([word[:at] + rng.choice(letters) + word[at:], word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at + 1 :]])


def variants(seed: int = 3) -> list[tuple]:
    """Common words and their edits, chains of forms, dense families of like words, accents, and awkward rows."""
    rng = random.Random(seed)
    out = []
    for k in range(25):
        base = "".join(rng.choices("abc", k=rng.randint(6, 12)))
        out.append((f"{base} " * rng.choice([30, 400])).split())
        for _ in range(12):
            other = edited(rng, base, "abcé")
            out.append([other] * rng.choice([1, 2, 3, 40]))
            out.append([edited(rng, other, "abcÿ")] * rng.choice([2, 4]))
    out.append(["aaaaaaa"] * 2 + ["aaaaaaaa"] * 30 + ["aaaaaaaaa"] * 500 + ["baaaaaaaa"] * 7000)
    out.append([f"common{a}{b}" for a in "abcdefghij" for b in "abcdefghij"] * 3 + [f"common{a}{b}{a}" for a in "abcdefghij" for b in "abcdefghij"] * 2)
    out.append("Ünlaut÷x× STRASSE straße strasse STRASSE Strasse l'orange".split() * 3)
    words = [w for part in out for w in part]
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", ", ", "1", "_", "日"]).join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]
    return rows + [(None, None), (None, "repeated repeated"), (None, "repeated repeated"), (-1, "")]


@pytest.mark.parametrize("small", SMALL)
def test_equals_brute_force(spark, small):
    rows = variants()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    docs = docs.select("*", *(F.lit(f"clash {c}").alias(c) for c in (*CLASH, "word", "run", "first", "end", "n_near", "best")if c not in docs.columns))
    got = V.spelling_variants(docs, **small).collect()
    want = brute.op12(rows)
    assert ordered(got) == ordered(want)
    assert any(w[1] and w[2] != w[1] for w in want) and len(want) > 300


def test_equals_brute_force_on_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in corpus()]
    got = V.spelling_variants(spark.createDataFrame(corpus(), COLUMNS), least_letters=4).collect()
    assert ordered(got) == ordered(brute.op12(rows, least=4))


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_each_link_is_found_once(letters):
    """All words of a block, compared however few are left to verify, give each link once and both of its ends."""
    rng = random.Random(len(letters))
    words = sorted({"".join(rng.choices(letters, k=rng.randint(3, 6))) for _ in range(400)})
    want = {w: sum(brute.near(w, x) for x in words) for w in words}
    links = V.Links()
    for size in range(3, 7):
        own = [(w, 1) for w in words if len(w) in (size, size + 1)]
        V.compare(own, size, 0, size, links)
    assert {w: links.near.get(w, 0) for w in words} == want
    assert {w: links.best[w][1] for w in links.best} == {w: min(x for x in words if brute.near(w, x)) for w in words if want[w]}


def test_blocks_hold_every_link_and_no_skew(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("ab", k=9)) for _ in range(300)} | {"".join(rng.choices("ab", k=10)) for _ in range(300)})
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    held: dict = {}
    for rows in V.blocks(table, most_words=5):
        for r in rows.collect():
            held.setdefault((r.size, r.first, r["end"], r["head"], r["tail"]), set()).add(r.word)
    assert all(len(b) <= 5 or k[2] - k[1] == 1 for k, b in held.items())
    pairs = {(u, v) for b in held.values() for u, v in combinations(sorted(b), 2)}
    assert all((u, v) in pairs for u, v in combinations(words, 2) if brute.near(u, v))


def test_long_words(spark):
    """Words of a hundred thousand letters are compared whole."""
    base = "abcdefghij" * 10_000
    other = base[:77_777] + "z" + base[77_777:]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([base] * 40 + [other] * 3)], "doc_id long, text string")
    got = {len(r.word): r for r in V.spelling_variants(docs).filter("n > 2").collect()}
    assert (got[100_001].root == base) == (got[100_001].form_n is not None) and got[100_000].n_near >= 1
    assert got[100_001].n_near >= 1


def test_empty_tables(spark):
    assert V.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert V.spelling_variants(spark.createDataFrame([(None, "once onlyonce")], "doc_id string, text string")).count() == 0
