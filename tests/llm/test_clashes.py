"""Stages that keep a table's columns, given columns with the names of their own."""

from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
NAMES = ["kept", "n_words", "posterior", "votes", "base_failed", "n_symbols", "_base", "_near", "_terms", "_row", "id", "component_id", "n_shingles", "high", "entity", "seq", "base", "_bucket", "key"]


def test_stages_keep_columns_with_clashing_names(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    docs = plain.select("*", *(F.concat(F.lit(f"mine {n} "), "doc_id").alias(n) for n in NAMES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = {r["doc_id"]: r for r in out.collect()}
        assert rows
        for k, r in rows.items():
            assert [r[n] for n in NAMES] == [f"mine {n} {k}" for n in NAMES]
        assert {k: r["text"] for k, r in rows.items()} == {r["doc_id"]: r["text"] for r in stage(spark, plain, SF).collect()}, name


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
