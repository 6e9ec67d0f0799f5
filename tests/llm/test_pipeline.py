"""Each stage against what its operator says of the stage's own input, on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sitesieve.llm import decontamination, queries, simhash
from sitesieve.sources.storage import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    before = {}
    for name, stage in cp.STAGES:
        before[name] = docs
        docs = stored(stage(spark, docs, SF), name)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
        before["after " + name] = docs
    toxic = {r["doc_id"] for r in queries.op8_toxicity(spark, SF).filter("predicted = 1").collect()}
    ids = lambda frame: sorted(r["doc_id"] for r in frame.select("doc_id").collect())
    assert ids(before["after toxicity"]) == [i for i in ids(before["toxicity"]) if i not in toxic]
    classes = simhash.near_duplicates(before["simhash_near_dedup"])
    assert ids(before["after simhash_near_dedup"]) == sorted({r["component_id"] for r in classes.collect()})
    benchmark = queries.table(spark, SF, "benchmark")
    leaking = {r["doc_id"] for r in decontamination.leaks(before["decontamination"], benchmark).collect()}
    assert leaking
    assert ids(before["after decontamination"]) == [i for i in ids(before["decontamination"]) if i not in leaking]
    mixed = before["after source_mixing"].agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    words = before["source_mixing"].agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    assert abs(mixed / words - 1.5) < 0.05
    assert docs.count() == before["sharding"].count()


def test_leaks_leave_by_their_text(spark, documents, tmp_path):
    """A leak without an id goes, a clean document with the id of a leak stays."""
    text = "the quick zebu jumps over nine lazy okapis while seven tapirs watch from the old wooden bridge"
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(i, f"plain words number {i} about nothing") for i in range(30)]
    rows = [*clean, (None, "before " + text), (None, "clean without an id"), (5, text + " after"), (None, None), (40, "x " + text)]
    docs = documents(rows, extra=True)
    kept = cp.decontaminated(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    expected = [*clean, (None, "clean without an id"), (None, None)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    result = con.execute(queries.SQL[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    theirs = sorted(str(tuple(row[found.index(c)] for c in columns)) for row in result.fetchall())
    assert sorted(str(tuple(r[c] for c in columns)) for r in frame.collect()) == theirs
