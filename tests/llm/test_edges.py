"""Odd tables through every stage of the pipeline: nulls, empty texts, repeated rows, clashing names, no rows."""

import corpus_pipeline
import pytest

ITEM = " ".join(f"item{i}" for i in range(14))
CLEAN = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(12)]
ODD = [(20, None), (21, ""), (None, "a text without an id"), (22, "twice the same row"), (22, "twice the same row"), (23, "x" * 300_000), (24, f"before {ITEM} after " + "more words here " * 10)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    labels = [(i, 1, 0) for i, _ in CLEAN] + [(22, None, None), (22, 1, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, ITEM), (1, None), (2, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stages(spark, table, folder, where):
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = table.columns
        out = stage(spark, table, folder)
        out.write.parquet(f"{where}/{name}")
        table = spark.read.parquet(f"{where}/{name}")
        assert name == "bpe" or table.columns == before
        seen[name] = table.collect()
    return seen


def test_odd_rows(spark, docs, odd, folder, tmp_path):
    seen = stages(spark, odd(docs(CLEAN + ODD)), folder, tmp_path)
    assert len(seen["toxicity"]) == len(CLEAN) + len(ODD)
    # null and empty texts are copies of each other, a repeated row goes
    kept = sorted((r.doc_id for r in seen["simhash"]), key=str)
    assert kept == sorted([i for i, _ in CLEAN] + [20, None, 22, 23, 24], key=str)
    texts = {r.doc_id: r.text for r in seen["decontaminate"]}
    assert "item5" not in texts[24] and texts[20] is None and len(texts[23]) == 300_000
    assert len(seen["secrets"]) == len(kept) == len(seen["bpe"])


def test_no_rows(spark, docs, odd, folder, tmp_path):
    assert all(not rows for rows in stages(spark, odd(docs([])), folder, tmp_path).values())
