import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import oracle  # noqa: E402

from lattis.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    assert oracle.difference(spark, oracle.connect(data), queries.queries()[name], queries.oracle_sql()[name], data) is None


@pytest.fixture(scope="module")
def odd_tables(spark, data, tmp_path_factory):
    """Tables that hold what the given ones lack: revisits, links, shared turns, repeated rows, nulls."""
    import random
    import shutil

    folder = tmp_path_factory.mktemp("odd")
    for name in oracle.TABLES:
        shutil.copy(f"{data}/{name}.parquet", folder)
    rng = random.Random(17)

    def put(name, rows, schema):
        (folder / f"{name}.parquet").unlink()
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{folder}/{name}.parquet")

    long = "<p>" + "again and again " * 80
    put("pages", [(i, f"http://a/{i}", [long, long + "é", "short", "", None][i % 5]) for i in range(40)], "page_id bigint, url string, html string")
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    vectors = [[x + rng.gauss(0, 0.02 if i % 2 else 0.3) for x in base[i % 12]] for i in range(120)]
    put("embeddings", [(i, v, 0) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int")
    words = ["colour", "color", "colours", "Colour", "coloor", "naïve", "naive", "naïves", "ab", "xcolour"]
    texts = [" ".join(rng.choices(words, [30, 14, 7, 9, 3, 12, 5, 3, 9, 3], k=20)) for _ in range(60)] + [None, "", "colour" * 2000]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    put("documents", rows + rows[:5] + [(None, "colour", "en", "s", 6)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    turns = [("user", "hello  there"), ("assistant", "well, hello"), ("user", None), (None, "x")]
    talk = [(c, t, *rng.choice(turns)) for c in range(90) if c % 11 for t in range(rng.choice([1, 2, 5]))]
    put("conversations", talk + [(100 + c, t, "user", f"same {t}") for c in range(15) for t in range(6)] + [(None, 0, "user", "nobody")], "conv_id bigint, turn bigint, role string, text string")
    return str(folder)


def connected(folder):
    """The same views, over files or folders of parts."""
    import os

    import duckdb

    con = duckdb.connect()
    for t in oracle.TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", ["op3_warc", "op4_multiindex", "op11_shards", "op12_spelling", "op13_prefixes"])
def test_query_equals_its_sql_on_odd_tables(spark, odd_tables, name):
    assert oracle.difference(spark, connected(odd_tables), queries.queries()[name], queries.oracle_sql()[name], odd_tables) is None
