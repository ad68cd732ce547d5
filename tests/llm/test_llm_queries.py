"""What must hold of the text and vector queries on the smallest tables."""

from pathlib import Path

import pytest

from heliograph.llm import plans

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def tables(spark):
    found = {name: query(spark, str(FOLDER)).cache() for name, query in plans.QUERIES.items()}
    yield found
    for df in found.values():
        df.unpersist()


def test_vectors(tables):
    groups, pairs = tables["p1_clusters"], tables["p1_found"]
    assert groups.where("size < 1 OR size(typical) != least(size, 3)").isEmpty()
    assert groups.agg({"size": "sum"}).first()[0] - groups.count() == pairs.count() > 0


def test_texts(spark, tables):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    ids, packed = tables["p6_ids"], tables["p7_containers"]
    assert ids.count() == n and packed.select("doc_id").distinct().count() == n
    assert packed.groupBy("container").sum("n_tokens").where("container IS NOT NULL AND `sum(n_tokens)` > 2048").isEmpty()
    assert packed.agg({"n_tokens": "sum"}).first()[0] == ids.selectExpr("sum(size(ids))").first()[0]
    fill = tables["p7_fill"].first()
    assert fill.least_containers <= fill.containers <= fill.least_containers + 1
    assert {r.doc_id for r in tables["p8_found"].collect()} == {r.doc_id for r in tables["p8_restored"].collect()}
