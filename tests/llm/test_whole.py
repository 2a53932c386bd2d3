"""Language identification and the pipeline against brute force; ids of any type; words with combining marks; empty tables."""

from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F
from test_llm import COLUMNS, corpus, ordered

import corpus_pipeline
from quarrion.llm import decontamination, exact_dedup, language_id, lm_scoring, near_dedup


def multilingual(seed: int = 12) -> list[tuple]:
    """Texts of three invented languages in two scripts, mixed ones, and awkward rows: id, text, lang."""
    rng = random.Random(seed)
    sounds = {"aa": "bad kol mur tes", "bb": "shri två vnog ghla", "cc": "नमस्ते दुनिया हिन्दी भाषा"}
    word = {k: (lambda v=v.split(): "".join(rng.choices(v, k=rng.randint(1, 2)))) for k, v in sounds.items()}
    data = [(i, " ".join(word[k]() for _ in range(rng.randint(3, 40))), k) for i, k in enumerate(rng.choices(list(sounds), k=150))]
    for i in range(20):
        a, b = rng.sample(list(sounds), 2)
        data.append((500 + i, " ".join([word[a]() for _ in range(rng.randint(5, 30))] + ["漢字"] * (i % 3) + [word[b]() for _ in range(rng.randint(5, 30))]), None))
    return data + [(None, None, "aa"), (None, "", None), (900, "12 34 !", "bb"), (901, "漢字", None), (902, data[0][1], None), (902, data[0][1], None)]


def test_languages_equal_brute_force(spark):
    data = multilingual()
    got = language_id.language_spans(spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)).collect()
    want = brute.op4(data)
    assert ordered((r.doc_id, r.held_out, r.lang_pred, round(r.score, 4)) for r in got) == ordered((*w[:3], round(w[3], 4)) for w in want)
    assert {w[2] for w in want} == {"aa", "bb", "cc", "und"}


@pytest.mark.parametrize(("text", "words"), [("नमस्ते दुनिया हिन्दी भाषा", 4), ("สวัสดีครับที่นี่ วันนี้", 2), ("தமிழ் மொழி", 2), ("می‌خواهم", 1), ("naïve été, x_y 4z", 5), ("́ ं", 0)])
def test_words_keep_their_marks(text, words):
    assert len(language_id.words_of(text)) == words


def renamed(rows, kind):
    """Rows whose first field, the id, is given in another type."""
    return [(None if r[0] is None else kind(r[0]), *r[1:]) for r in rows]


def test_text_ids(spark):
    """Ids of text go through the operators as numbers do."""
    rows = renamed([tuple(r) for r in corpus()[:60]] + [(None, "a b c d e f", "en", "a", 1)], lambda d: f"{d:06}")
    named = spark.createDataFrame(rows, COLUMNS.replace("doc_id long", "doc_id string"))
    items = [(1, " ".join(rows[2][1].split()[25:45]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pairs = [r[:2] for r in rows]
    assert ordered(decontamination.contamination(named, bench).collect()) == ordered(brute.op5(pairs, items))
    assert ordered(near_dedup.near_groups(named, size=4).drop("h").collect()) == ordered(brute.op6(pairs))
    languages = language_id.language_spans(named).collect()
    assert ordered((r.doc_id, r.lang_pred) for r in languages) == ordered((w[0], w[2]) for w in brute.op4([r[:3] for r in rows]))
    scores = lm_scoring.lm_scores(named, rounds=1).collect()
    assert ordered((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in scores) == ordered(w[:5] for w in brute.op7(pairs))
    left = exact_dedup.drop_exact(named)
    assert left.schema == named.schema and ordered((r.doc_id,) for r in left.collect()) == ordered({(w[1],) for w in brute.op10(pairs)})


def pipeline_rows() -> list[tuple]:
    """Documents with something for every stage to drop, ids distinct: doc_id, text, lang, source, n_chars."""
    rng = random.Random(21)
    rows = [(100_000 + i, r[1], r[2], r[3], r[4]) for i, r in enumerate(corpus())]
    spoken = multilingual(5)
    rows += [(200_000 + i, t, k, rng.choice(["a", "b", "d", None]), len(t or "")) for i, (_, t, k) in enumerate(spoken)]
    return rows + [(300_000 + i, f"{r[1]} " if i % 2 else (r[1] or "").upper(), r[2], r[3], r[4]) for i, r in enumerate(rows[:60])]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = pipeline_rows()
    items = [(1, " ".join(rows[2][1].split()[25:45])), (2, "kol kol kol kol"), (3, None)]
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    spoken = [d for d, _, lang, score in brute.op4([r[:3] for r in rows]) if lang != "und" and score >= language_id.LEAST_SCORE]
    exact = {sha: keep for _, keep, _, sha in brute.op10([(d, text[d]) for d in spoken])}
    near = [d for d, *_, kept in brute.op6([(d, text[d]) for d in exact.values()], size=5) if kept]
    clean = [d for d, *_, bad in brute.op5([(d, text[d]) for d in near], items) if not bad]
    want = {d: n for d, n in brute.mixed([(d, text[d], source[d]) for d in clean]).items() if n}
    assert got == want
    assert len(rows) > len(spoken) > len(exact) > len(near) > len(clean) > 50


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    some = spark.createDataFrame(corpus()[:30], COLUMNS).withColumn("doc_id", F.col("doc_id") * 2)
    assert corpus_pipeline.STAGES[3][1](spark, some, str(tmp_path)).count() == 30
