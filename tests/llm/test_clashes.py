"""Tables whose columns are named like the operators' own, repeated rows, and empty tables."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from evenhand.llm import bagminhash, langid, linededup, nndescent, pii

TEXTS = [
    "The first line of a text stands here.\nA second line with jo@mail.example.com in it.",
    "A second line with jo@mail.example.com in it.\nAnother one that is its own.",
    "The first line of a text stands here.\nA second line with jo@mail.example.com in it.",
    None,
    "",
]
#: Every name that the operators give a column of their own on a table of the caller.
NAMES = ["_hash", "_key", "_doc", "_gone", "_text", "_new", "_n", "_node", "_winner", "n_lines", "n_dropped", "n_entities", "h1", "pos", "line", "node", "score", "lang_pred", "_lang_pred"]


def tables(spark):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(TEXTS)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    named = plain.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    return plain, named


def same(plain, named, replaced=()):
    """The caller's columns are untouched, and the rest is what it is without them."""
    kept = [n for n in NAMES if n not in replaced]
    got = named.collect()
    for r in got:
        assert all(r[n] == f"{n} {r['doc_id']}" for n in kept)
    key = lambda r: (r["doc_id"], str(r["text"]))
    columns = plain.columns
    assert sorted([tuple(r[c] for c in columns) for r in got], key=str) == sorted([tuple(r) for r in plain.collect()], key=str)
    assert sorted(named.columns) == sorted({*columns, *kept}), key


def test_line_dedup_surrogates_and_near_dedup(spark):
    plain, named = tables(spark)
    same(linededup.deduplicated(plain), linededup.deduplicated(named), {"n_lines", "n_dropped"})
    same(pii.replaced(plain), pii.replaced(named), {"n_entities"})
    same(bagminhash.deduplicated(plain), bagminhash.deduplicated(named))


def test_pipeline_stages(spark):
    plain, named = tables(spark)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        same(stage(spark, plain, ""), stage(spark, named, ""))
        assert stage(spark, named, "").columns == named.columns, name
    assert corpus_pipeline.STAGES[0][1](spark, named, "").columns == named.columns


def test_empty_pipeline_and_repeated_rows(spark, tmp_path):
    plain, _ = tables(spark)
    plain.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    twice = plain.union(plain)
    kept = corpus_pipeline.near_dedup(spark, twice, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3]


def test_a_superscript_is_no_word_of_its_own(spark):
    assert langid.words_of("m² CO₂ x²y a_b Zo") == ["m", "co", "x", "y", "a", "b", "zo"]
    rows = [(k, t, x) for k, (t, x) in enumerate([("the thing and the other thing", "en"), ("der und die ist das", "de")] * 8)]
    docs = spark.createDataFrame([*rows, (90, "the² thing", None), (91, "12 ² !", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert got[90] == "en" and got[91] == langid.UNDETERMINED


def test_words_beyond_64_letters_teach(spark):
    rows = [(k, ("ab" if k % 2 else "cd") * 60, "x" if k % 2 else "y") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == ("x" if r["doc_id"] % 2 else "y") for r in langid.identify(docs).collect())


def test_repeated_vectors_count_once(spark):
    rows = [(5, [1.0, 0.0], "a"), (5, [1.0, 0.0], "a"), (6, [0.0, 1.0], "a"), (7, [0.0, 1.0], "a"), (8, [0.01, 1.0], "a")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted(map(tuple, nndescent.grouped(table).collect()))
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (6, 2, 6, True), (7, 2, 6, False), (8, 2, 6, False)]
    cosine = np.array([0.0, 1.0]) @ (np.array([0.01, 1.0]) / np.hypot(0.01, 1.0))
    assert cosine >= nndescent.THRESHOLD
