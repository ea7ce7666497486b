"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from folioquery import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    held = duckdb.connect()
    for file in os.listdir(DIR):
        held.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DIR}/{file}'")
    return held


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DIR)
    rows = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=repr)
    assert rows or name in ("cross_reference_expand",)
    if name in registry.SQL:
        want = con.sql(registry.SQL[name])
        order = [want.columns.index(c) for c in sorted(want.columns)]
        assert sorted(got.columns) == sorted(want.columns)
        assert rows == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    spark.catalog.clearCache()


def test_text_features_on_odd_texts(spark, tmp_path):
    """Edges, white space and cases that regular expressions of Java and DuckDB take differently (none occur on the smallest tables)."""
    odd = ["ü", "é́", "́", "²", "½", "٣", "_", "ª", "\x0b", "\x00", "\x85", " ", "ſ", "K", "ı", "𐐀", "𐖀", "😀", "ࡰ", "a", "5", ".", ",", "-", "\n"]
    shapes = ["AB{}", "{}AB", "AB{}CD", "{}R51", "R52{}", "R{}53", "U{}D 54", "5 R6 thou{}and", "R7 b{}llion", "R8{}million", "123{}45", "{}124 45", "125 45{}"]
    texts = [None, "", "für 4936159572120256 Für 12", *(shape.format(c) for c in odd for shape in shapes)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["chunk_id"]: tuple(r) for r in registry.QUERIES["text_features"](spark, str(tmp_path)).collect()}
    assert got["c2"] == ("c2", "r12|r3million|r4936159572120256", "102 12", "r3")
    held = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        held.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = {r[0]: r for r in held.sql(registry.SQL["text_features"]).fetchall()}
    assert len(got) == len(texts) and got == want
