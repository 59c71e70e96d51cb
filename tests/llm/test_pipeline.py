import random
import zlib

import corpus_pipeline

from lattis.llm import bpe, decontaminate, secrets, toxicity
from lattis.llm.queries import tokenizer_path


def test_stages_keep_and_catch(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    clean = [(i, line(120)) for i in range(120)]
    toxic = [(200 + i, line(60) + f" {rng.choice(['blockhead', 'nitwit'])} " + line(30)) for i in range(60)]
    item = line(40)
    planted = [(300, clean[0][1]), (301, clean[1][1].replace(clean[1][1].split()[50], "other", 1)), (302, line(80) + " " + item + " " + line(80)), (303, item), (304, line(50) + " token = abcdef123456 " + line(5)), (305, None), (306, "")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [*clean, *toxic, *planted]]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic if zlib.crc32(str(i).encode()) % 5]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "bpe" or docs.columns == columns
    everything = {i for i, _ in [*clean, *toxic, *planted]}
    assert set(seen["toxicity"]) == everything - {i for i, _ in toxic}
    assert set(seen["toxicity"]) - set(seen["simhash"]) == {300, 301, 306}
    assert set(seen["simhash"]) - set(seen["decontaminate"]) == {303}
    assert item not in seen["decontaminate"][302].text and seen["decontaminate"][5].text == dict(clean)[5]
    assert "abcdef123456" not in seen["secrets"][304].text and "token" in seen["secrets"][304].text
    model = bpe.loaded(tokenizer_path())
    assert all(r.ids == model.encode(seen["secrets"][i].text or "") for i, r in seen["bpe"].items())
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen["bpe"])
    assert [f.__module__ for f in (toxicity.accept, decontaminate.clean, secrets.redact)]


def test_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
