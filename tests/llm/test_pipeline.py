"""The stages in a row, and each stage's own effect."""

import corpus_pipeline
from pyspark.sql import functions as F

from .test_text_ops import SCHEMA, brute_classes, brute_repeats


def test_stages(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(30))
    leak = " ".join(f"leak{i}" for i in range(12))
    long = lambda k: " ".join(f"{k}{i}" for i in range(40))
    texts = [long("a"), long("a"), f"{long('b')} {passage}", f"{long('c')} {passage}", f"{long('d')} {leak} {long('e')}", None, "12 !", long("a") + " more", "short text"]
    rows = [(i, t, "en", "s", None if t is None else len(t), "own", 7, "own") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {x.doc_id: x for x in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert set(seen["language_id"]) == {0, 1, 2, 3, 4, 7, 8}
    kept = {k for k, c in brute_classes([texts[i] for i in (0, 1, 2, 3, 4, 7, 8)], [0, 1, 2, 3, 4, 7, 8]).items() if k == c}
    assert set(seen["near_dedup"]) == kept == {0, 2, 3, 4, 8}
    repeats = {i: r for i, _, r, _ in brute_repeats([texts[i] for i in sorted(kept)], sorted(kept))}
    assert repeats[3] == 30 and seen["substring_dedup"][3].text == long("c") and seen["substring_dedup"][2].text == texts[2]
    assert seen["substring_dedup"][3].n_chars == len(long("c"))
    assert "leak3" not in seen["decontaminate"][4].text and long("d") in seen["decontaminate"][4].text
    assert seen["decontaminate"][0].text == texts[0]
    assert set(seen["byte_bpe"]) == kept and all(x.n_tokens == len(x.ids) > 0 for x in seen["byte_bpe"].values())
    assert docs.filter(F.col("n_tokens") <= 0).count() == 0


def test_documents_without_any_label_stay(spark):
    texts = ["some words", None, "12 !", "", "é"]
    docs = spark.createDataFrame([(i, t, None, "s", None, "own", 7, "own") for i, t in enumerate(texts)], SCHEMA)
    got = corpus_pipeline.identify_language(spark, docs, "")
    assert got.columns == docs.columns and {x.doc_id for x in got.collect()} == {0, 4}


def test_stages_take_columns_of_any_name_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words, "en", "s", 5, "own", 7, "own"), (1, words, "en", "s", 5, "own", 7, "own"), (None, words, None, "s", 5, "own", 7, "own"), (2, None, None, None, None, None, None, None)], SCHEMA)
    for c in ("my-col", "a.b", "_kept", "row", "_0", "k`k", "id", "k"):
        docs = docs.withColumn(c, F.lit(c))
    for rows, left in ((docs, 1), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            path = str(tmp_path / f"{left}{name}")
            stage(spark, rows, str(tmp_path)).write.parquet(path)
            rows = spark.read.parquet(path)
            assert rows.columns == docs.columns
        assert [(x.doc_id, x.text, x.lang, x["a.b"]) for x in rows.collect()] == [(1, words, "en", "a.b")] * left


def test_language_stage_names_the_language(spark):
    texts = ["der hund und die katze " * 8, "the dog and the cat " * 8, "der hund und die maus", None]
    docs = spark.createDataFrame([(i, t, [None, "en", "de", "de"][i], "s", None, "own", 7, "own") for i, t in enumerate(texts)], SCHEMA)
    assert {x.doc_id: x.lang for x in corpus_pipeline.identify_language(spark, docs, "").collect()} == {0: "de", 1: "en", 2: "de"}


def test_run_leaves_its_last_table_only(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda _: str(tmp_path / "own"))
    from veilgrid.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path / "own"))
    words = [" ".join(f"{k}{i}" for i in range(30)) for k in "abc"]
    spark.createDataFrame([(i, t, "en", "s", 5, "own", 7, "own") for i, t in enumerate([*words, words[0]])], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 1, 2]
    left = os.listdir(tmp_path / "own")
    assert len(left) == 1 and os.listdir(tmp_path / "own" / left[0]) == ["4-byte_bpe"]
