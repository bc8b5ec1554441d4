from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
import corpus_pipeline
from hostvigil.llm import decontaminate, mixing, queries, simhash

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="test data not present")


def test_one_query_per_operator_and_the_pipeline_are_registered():
    names = [f"op{n}_" for n in range(1, 14)]
    assert all(sum(q.startswith(n) for q in entry.queries()) == 1 for n in names)
    assert entry.queries()["pipeline"] is corpus_pipeline.run and set(queries.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_statement(spark, name):
    assert check.compare(spark, check.connect(SMALL), SMALL, name) == ""


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {"documents": docs}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SMALL).cache()
        kept[name] = now
        if name != "mixing":
            assert now.columns == docs.columns
    ids = {k: [r.doc_id for r in f.select("doc_id").collect()] for k, f in kept.items()}
    order = ["documents", "quality", "near_duplicates", "decontamination", "personal_data", "mixing"]
    assert all(set(ids[b]) <= set(ids[a]) for a, b in zip(order, order[1:]))
    assert len(ids["quality"]) < len(ids["documents"])
    groups = simhash.near_duplicates(kept["quality"].select("doc_id", "text"))
    assert sorted(ids["near_duplicates"]) == sorted(r.component_id for r in groups.select("component_id").distinct().collect())
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    marked = decontaminate.search_benchmark(kept["near_duplicates"], items)
    assert sorted(ids["decontamination"]) == sorted(r.doc_id for r in marked.where("not contaminated").collect())
    assert ids["personal_data"] and sorted(ids["personal_data"]) == sorted(ids["decontamination"])
    assert kept["personal_data"].where(F.col("text").rlike(r"@[a-z0-9]+\.example\.com") | (F.length("text") != F.col("n_chars"))).count() == 0
    taken = mixing.mix(kept["personal_data"]).where("taken > 0").select("doc_id", "taken").collect()
    assert sorted(map(tuple, taken)) == sorted((r.doc_id, r.taken) for r in kept["mixing"].collect())
    run = corpus_pipeline.run(spark, SMALL)
    assert sorted((r.doc_id, r.taken) for r in run.collect()) == sorted((r.doc_id, r.taken) for r in kept["mixing"].collect())


def test_stages_accept_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert out.count() <= docs.count()
            if name != "mixing":
                assert out.columns == docs.columns
